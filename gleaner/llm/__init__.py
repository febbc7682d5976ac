"""Training-data operators: dedup, scans, classifiers, sharding, mixing, tokenising.

Nothing outside this subpackage imports it; it can be removed as a whole.
"""
