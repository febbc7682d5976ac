"""Queries over the test tables, one module per family of operators."""

from gleaner.plans import documents, flows, functions, pools, retrieval, statistics

MODULES = (functions, retrieval, pools, statistics, documents, flows)
