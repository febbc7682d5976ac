"""Text expressions: normalising, folding, tokens, signals.

All are plain columns but for Unicode normal forms, which Spark lacks: those run on Arrow batches.
"""

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Letters and digits with following marks; RE2 and Java agree on it.
WORD = r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*"
#: Blanks that are cut off ends: Unicode's separators of words (Zs), as in DuckDB's trim.
BLANKS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
HAN = r"[㐀-䶿一-鿿豈-﫿]"
HAN_RUN = HAN + "+"

# Vietnamese letters with their bases, for folding without a UDF.
VI_MARKED = (
    "àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđ"
)
VI_BASE = "a" * 17 + "e" * 11 + "i" * 5 + "o" * 17 + "u" * 11 + "y" * 5 + "d"
# Further Latin letters with marks and their bases.
LATIN_MARKED, LATIN_BASE = "äåçëîïñöûüÿœæ", "aaceiinouuyoa"

# English words, and words of study reports, that carry no topic.
ENGLISH_STOPWORDS = (
    "a an and are as at be been being by can could did do does doing for from had has have having he her hers him his how i if in into is it its "
    "may might more most no not of on or our ours she should than that the their theirs them then there these they this those to under up was we "
    "were what when where which who why will with would you your study studies result results conclusion conclusions method methods background "
    "objective patients patient group groups using use used based among between associated effect effects analysis data significant compared "
    "clinical medical disease treatment"
).split()


@F.pandas_udf(StringType())
def normalize_text(c: pd.Series) -> pd.Series:
    """Composed form (NFC), with every run of blanks as one space and none at the ends."""
    return c.map(lambda t: " ".join(unicodedata.normalize("NFC", t).split()), na_action="ignore")


@F.pandas_udf(StringType())
def accent_fold(c: pd.Series) -> pd.Series:
    """đ as d, then the compatibility decomposition (NFKD) without marks; the case stays."""

    def bare(t: str) -> str:
        if t.isascii():
            return t
        return "".join(x for x in unicodedata.normalize("NFKD", t.translate({0x111: "d", 0x110: "D"})) if unicodedata.category(x)[0] != "M")

    return c.map(bare, na_action="ignore")


def trim(c: Column) -> Column:
    """Without ``BLANKS`` at either end; not ``F.trim``, whose second argument ``F.transform`` would fill with the index."""
    return F.trim(c, F.lit(BLANKS))


def words(c: Column) -> Column:
    """Lower-cased word tokens, duplicates kept."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0))


def normalize_query(c: Column) -> Column:
    """The words of a query joined by single spaces."""
    return F.array_join(words(c), " ")


def fold(c: Column) -> Column:
    """Lower case without the marks of Vietnamese and common Latin letters; đ becomes d.  A plain column, for single words."""
    return F.translate(F.lower(c), VI_MARKED + LATIN_MARKED, VI_BASE + LATIN_BASE)


def normalize_folded(c: Column) -> Column:
    """Folded text with everything but letters and digits as single spaces."""
    return F.trim(F.regexp_replace(F.lower(accent_fold(c)), r"[^\p{L}\p{N}]+", " "))


def concise_query(c: Column, phrases: list[str], most: int = 24) -> Column:
    """Scaffolding phrases removed, longest first, and one-letter words; at most ``most`` words; else the original."""
    text = F.concat(F.lit(" "), normalize_folded(c), F.lit(" "))
    for p in sorted(phrases, key=lambda p: (-len(p), p)):
        text = F.regexp_replace(text, rf"(?<= ){p}(?= )", " ")
    kept = F.slice(F.filter(F.split(F.trim(text), r"\s+"), lambda w: F.length(w) > 1), 1, most)
    joined = F.array_join(kept, " ")
    return F.when(joined == "", c).otherwise(joined)


def han_ngrams(c: Column) -> Column:
    """Marked unigrams, then bigrams, of every run of Han characters."""
    runs = F.regexp_extract_all(c, F.lit(HAN_RUN), F.lit(0))
    grams = lambda n, tag: F.flatten(F.transform(runs, lambda r: F.when(F.length(r) >= n, F.transform(
        F.sequence(F.lit(1), F.length(r) - (n - 1)), lambda i: F.concat(F.lit(tag), F.substring(r, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))))
    return F.concat(grams(1, "h1:"), grams(2, "h2:"))


def lexical_tokens(c: Column) -> Column:
    """Marked word tokens without Han characters, and Han unigrams and bigrams: a multiset."""
    lower = F.lower(F.coalesce(c, F.lit("")))
    plain = F.regexp_extract_all(F.regexp_replace(lower, HAN, " "), F.lit(WORD), F.lit(0))
    return F.concat(F.transform(plain, lambda w: F.concat(F.lit("w:"), w)), han_ngrams(lower))


def fts_tokens(c: Column) -> Column:
    """Full-text tokens: runs of letters and digits of two characters or more."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.length(w) > 1)


def fts_query(c: Column) -> Column:
    """An OR of the distinct quoted tokens, in order of first appearance."""
    return F.array_join(F.transform(F.array_distinct(fts_tokens(c)), lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " OR ")


def english_tokens(c: Column) -> Column:
    """Lower-case Latin words of three characters or more that are no stopwords; duplicates kept."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"[a-z][a-z0-9-]{2,}"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(*ENGLISH_STOPWORDS))


def char_bigrams(c: Column, distinct: bool = False) -> Column:
    """Character bigrams within words (a one-letter word is itself), as multiset or set."""
    grams = F.flatten(F.transform(words(c), lambda w: F.when(F.length(w) < 2, F.array(w)).otherwise(
        F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2))))))
    return F.array_distinct(grams) if distinct else grams


def word_ngrams(tokens: Column, n: int = 5, at_least: int | None = None) -> Column:
    """Distinct n-grams of an array of words; none when there are fewer than ``at_least`` words."""
    def grams(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= max(n, at_least or n), F.array_distinct(each)).otherwise(F.array().cast("array<string>"))

    # bound as a variable: an expression named in the inner function would be cut anew for every gram
    return F.element_at(F.transform(F.array(tokens), grams), 1)


def with_folded_variants(tokens: Column, stopwords: list[str]) -> Column:
    """Tokens that are no stopwords, raw or folded, each followed by its folded form if that differs."""
    kept = F.filter(tokens, lambda w: ~w.isin(*stopwords) & ~fold(w).isin(*stopwords))
    return F.flatten(F.transform(kept, lambda w: F.when(fold(w) != w, F.array(w, fold(w))).otherwise(F.array(w))))


def language_signal(c: Column, han: int = 20, vietnamese: int = 5, latin: int = 20) -> Column:
    """zh, vi, latin or unknown by counts of characters."""
    return (
        F.when(F.regexp_count(c, F.lit(HAN)) >= han, "zh")
        .when(F.regexp_count(F.lower(c), F.lit(f"[{VI_MARKED}]")) >= vietnamese, "vi")
        .when(F.regexp_count(c, F.lit("[A-Za-z]")) >= latin, "latin").otherwise("unknown")
    )


def presence(c: Column, terms: list[str]) -> Column:
    """How many of the terms the lower-cased text contains."""
    lower = F.lower(c)
    total = F.lit(0)
    for t in terms:
        total = total + lower.contains(t).cast("int")
    return total


def first_category(c: Column, lists: dict[str, list[str]], default: str) -> Column:
    """The first category one of whose keywords the text contains."""
    lower, out = F.lower(c), None
    for name, terms in lists.items():
        hit = F.exists(F.array(*map(F.lit, terms)), lambda t: lower.contains(t))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def occurrences(c: Column, markers: list[str]) -> Column:
    """Non-overlapping occurrences of all markers together."""
    total = F.lit(0)
    for m in markers:
        total = total + F.floor((F.length(c) - F.length(F.replace(c, F.lit(m), F.lit("")))) / F.lit(len(m)))
    return total.cast("long")


def bucket(c: Column, bounds: list[int]) -> Column:
    """``<b0``, ``b0-b1``, ... and ``>=last`` of a number."""
    out = F.when(c < bounds[0], f"<{bounds[0]}")
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        out = out.when(c < hi, f"{lo}-{hi}")
    return out.otherwise(f">={bounds[-1]}")


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets; 0 of two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def promotional(c: Column, flags: list[str], share: float = 0.5) -> Column:
    """Two flagged segments or more that make up at least ``share`` of the text."""
    parts = F.filter(F.transform(F.split(c, r"[\n.!?]+"), trim), lambda s: s != "")
    flagged = F.filter(parts, lambda s: F.exists(F.array(*map(F.lit, flags)), lambda f: F.lower(s).contains(f)))
    total = lambda a: F.aggregate(a, F.lit(0), lambda n, s: n + F.length(s))
    return (F.size(flagged) >= 2) & (total(flagged) >= share * total(parts))


def clean_paragraphs(c: Column, navigation: list[str]) -> Column:
    """Paragraphs that are neither navigation nor lists of dates, joined by newlines."""
    dates = r"^(\s*\d{1,4}[-/.]\d{1,2}([-/.]\d{1,4})?\s*)+$"
    kept = F.filter(F.split(c, r"\n+"), lambda p: (F.trim(p) != "") & ~p.rlike(dates) & ~F.exists(
        F.array(*map(F.lit, navigation)), lambda m: F.lower(p).contains(m)))
    return F.array_join(kept, "\n")
