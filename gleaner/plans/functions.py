"""Queries over the scalar functions and tokenizers."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import hashing, text, urls, vectors
from gleaner.plans.registry import query
from gleaner.session import table

W = r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*"
PHRASES = ["the and", "of the", "in the"]
TERMS = ["heart", "the", "tion", "licen"]
CATEGORIES = {"legal": ["licen", "copyright"], "list": [" | "], "french": ["eaux"], "english": ["the "]}
MARKERS = ["###", "the", "%%%"]
BARE = "strip_accents(replace(replace(text, 'đ', 'd'), 'Đ', 'D'))"
FOLDED = f"translate(lower(text), '{text.VI_MARKED}{text.LATIN_MARKED}', '{text.VI_BASE}{text.LATIN_BASE}')"
STOP = ", ".join(f"'{w}'" for w in text.ENGLISH_STOPWORDS)
_GRAMS = "list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))"


@query("f1_normalize_text", r"SELECT doc_id, trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g')) AS normal FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.normalize_text("text").alias("normal"))


@query("f2_normalize_query", f"SELECT item_id, array_to_string(regexp_extract_all(lower(text), '{W}'), ' ') AS normal FROM benchmark")
def _(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", text.normalize_query(F.col("text")).alias("normal"))


@query("f3_normalize_folded", f"SELECT doc_id, trim(regexp_replace(lower({BARE}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS normal FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.normalize_folded(F.col("text")).alias("normal"))


@query("f4_accent_fold", f"SELECT doc_id, {BARE} AS folded FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.accent_fold("text").alias("folded"))


_NORMAL = rf"' ' || trim(regexp_replace(lower({BARE}), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) || ' '"


@query("f5_concise_query", f"""
SELECT item_id, CASE WHEN short = '' THEN text ELSE short END AS concise FROM (
  SELECT item_id, text, array_to_string(list_slice(list_filter(string_split_regex(trim(
    replace(replace(replace({_NORMAL}, ' the and ', '  '), ' in the ', '  '), ' of the ', '  ')), '\\s+'), lambda w: length(w) > 1), 1, 24), ' ') AS short FROM benchmark)""")
def _(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", text.concise_query(F.col("text"), PHRASES).alias("concise"))


@query("f6_query_variants", f"""
SELECT item_id, 'Q0' AS variant, text AS query FROM benchmark
UNION ALL SELECT item_id, 'Q1', array_to_string(list_slice(regexp_extract_all(lower(text), '{W}'), 1, 24), ' ') FROM benchmark""")
def _(spark, sf):
    short = F.array_join(F.slice(text.words(F.col("text")), 1, 24), " ")
    variants = F.array(F.struct(F.lit("Q0").alias("variant"), F.col("text").alias("query")), F.struct(F.lit("Q1").alias("variant"), short.alias("query")))
    return table(spark, sf, "benchmark").select("item_id", F.inline(variants))


@query("f7_host", r"SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '^www\.', '') AS host FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.host(F.col("url")).alias("host"))


@query("f8_fetchable_url", "SELECT page_id, CASE WHEN url LIKE 'http%://_%' THEN split_part(url, '#', 1) END AS fetch_url FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.fetchable(F.col("url")).alias("fetch_url"))


_URL = r"""u AS (SELECT page_id, url, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) AS host,
  regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages
), n AS (SELECT *, array_to_string(list_filter(string_split(q, '&'), lambda p: p <> '' AND split_part(p, '=', 1) NOT IN
  ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'gclid', 'fbclid', 'ref')), '&') AS kept FROM u),
norm AS (SELECT *, scheme || '://' || host || CASE WHEN regexp_matches(path, '^/*$') THEN '/' ELSE regexp_replace(path, '/+$', '') END || CASE WHEN kept = '' THEN '' ELSE '?' || kept END AS normal FROM n)"""


@query("f9_normalize_url", f"WITH {_URL} SELECT page_id, normal FROM norm")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.normalized(F.col("url")).alias("normal"))


@query("f10_canonical_key", f"WITH {_URL} SELECT page_id, regexp_replace(normal, '^[a-z]+:', '') AS key FROM norm")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.canonical_key(F.col("url")).alias("key"))


@query("f11_url_parts", f"WITH {_URL} SELECT page_id, scheme, host, path, q AS query, regexp_extract(url, '#(.*)$', 1) AS fragment FROM u")
def _(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", urls.part(u, 1).alias("scheme"), F.lower(urls.part(u, 2)).alias("host"), urls.part(u, 4).alias("path"),
        urls.part(u, 5).alias("query"), urls.part(u, 6).alias("fragment"))


@query("f12_url_features", rf"""WITH {_URL}, t AS (
  SELECT page_id, regexp_replace(host, '^www\.', '') || ' ' || path || ' ' || q AS text FROM u
), k AS (SELECT page_id, regexp_extract_all(lower(replace(replace(text, '_', ' '), '-', ' ')), '{W}') AS w FROM t),
r AS (SELECT *, CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: regexp_matches(x, '^\d+$'))) / len(w)::DOUBLE ELSE 0.0 END AS ratio FROM k)
SELECT page_id, len(w)::BIGINT AS n_tokens, round(ratio, 6) AS numeric_ratio,
  ratio >= 0.5 OR len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}{{2,}}'))) = 0 OR len(w) <= 1 AS opaque,
  sha256(array_to_string(w, ' '))[1:16] AS text_hash FROM r""")
def _(spark, sf):
    k = table(spark, sf, "pages").select("page_id", urls.url_tokens(F.col("url")).alias("w"))
    return k.select(
        "page_id", F.size("w").cast("long").alias("n_tokens"), F.round(urls.numeric_ratio(F.col("w")), 6).alias("numeric_ratio"),
        urls.opaque(F.col("w")).alias("opaque"), F.substring(F.sha2(F.array_join("w", " "), 256), 1, 16).alias("text_hash"))


@query("f13_url_predicates", f"""WITH {_URL} SELECT page_id, lower(regexp_extract(path, '\\.([A-Za-z0-9]{{1,8}})$', 1)) AS extension,
  scheme = 'https' AS is_https, q <> '' AS has_query, url LIKE '%#%' AS has_fragment, q <> kept AS has_tracking FROM n""")
def _(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", urls.extension(u).alias("extension"), (urls.part(u, 1) == "https").alias("is_https"), (urls.part(u, 5) != "").alias("has_query"),
        u.contains("#").alias("has_fragment"), urls.has_tracking(u).alias("has_tracking"))


@query("f14_hash_rank_fold", "SELECT doc_id, sha256('seed:' || doc_id::VARCHAR)[1:16] AS hash_rank, (('0x' || sha256('seed:' || doc_id::VARCHAR)[1:16])::UBIGINT % 5)::BIGINT AS fold FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", hashing.hash_rank("seed", F.col("doc_id")).alias("hash_rank"), hashing.hash_fold("seed", F.col("doc_id"), 5).alias("fold"))


@query("f15_rule_rank", "SELECT page_id, sha256('rule' || chr(0) || url || chr(0) || page_id::VARCHAR) AS rule_rank FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", hashing.joined_digest(F.lit("rule"), F.col("url"), F.col("page_id")).alias("rule_rank"))


@query("f16_digests", "SELECT doc_id, sha256(source || chr(0) || text) AS content_hash, sha256(doc_id::VARCHAR || chr(0) || '0' || chr(0) || text)[1:24] AS chunk_digest FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", hashing.joined_digest(F.col("source"), F.col("text")).alias("content_hash"),
        hashing.chunk_digest(F.col("doc_id"), F.lit(0), F.col("text")).alias("chunk_digest"))


@query("f18_language_signal", f"""SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '[㐀-䶿一-鿿豈-﫿]')) >= 20 THEN 'zh'
  WHEN len(regexp_extract_all(lower(text), '[{text.VI_MARKED}]')) >= 5 THEN 'vi'
  WHEN len(regexp_extract_all(text, '[A-Za-z]')) >= 20 THEN 'latin' ELSE 'unknown' END AS signal FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.language_signal(F.col("text")).alias("signal"))


@query("f19_likely_language", f"""WITH {_URL} SELECT page_id, CASE WHEN host LIKE '%.vn' THEN 'vi' WHEN host LIKE '%.cn' OR host LIKE '%.tw' OR host LIKE '%.hk' THEN 'zh'
  WHEN host LIKE '%.org' OR host LIKE '%.com' OR host LIKE '%.net' THEN 'en' ELSE 'unknown' END AS language FROM u""")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.likely_language(urls.host(F.col("url"))).alias("language"))


@query("f20_content_signals", f"""SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]'))::BIGINT AS n_latin,
  len(regexp_extract_all(lower(text), '[{text.VI_MARKED}]'))::BIGINT AS n_marked, ({" + ".join(f"contains(lower(text), '{t}')::INT" for t in TERMS)})::BIGINT AS n_terms FROM documents""")
def _(spark, sf):
    c = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", F.regexp_count(c, F.lit("[A-Za-z]")).cast("long").alias("n_latin"),
        F.regexp_count(F.lower(c), F.lit(f"[{text.VI_MARKED}]")).cast("long").alias("n_marked"), text.presence(c, TERMS).cast("long").alias("n_terms"))


@query("f21_first_category", """SELECT doc_id, CASE WHEN contains(lower(text), 'licen') OR contains(lower(text), 'copyright') THEN 'legal'
  WHEN contains(lower(text), ' | ') THEN 'list' WHEN contains(lower(text), 'eaux') THEN 'french' WHEN contains(lower(text), 'the ') THEN 'english' ELSE 'other' END AS category FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.first_category(F.col("text"), CATEGORIES, "other").alias("category"))


@query("f22_record_id", r"""SELECT page_id, CASE WHEN host = 'ththre.example.com' AND NOT contains(url, '?') AND NOT contains(url, '#') AND regexp_matches(path, '^/\d+/?$')
  THEN regexp_extract(path, '(\d+)', 1)::BIGINT END AS record_id FROM (SELECT page_id, regexp_replace(url, '/[a-z][a-z]/', '/') AS url,
  regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS host, regexp_extract(regexp_replace(url, '/[a-z][a-z]/', '/'), '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)""")
def _(spark, sf):
    # the test pages have a language segment before the number; it is cut first
    u = F.regexp_replace("url", "/[a-z][a-z]/", "/")
    return table(spark, sf, "pages").select("page_id", urls.record_id(u, "ththre.example.com").alias("record_id"))


@query("f23_unit_vectors", """SELECT vec_id, round(list_sum(list_transform(u, lambda x: x * x)), 6) AS square, round(u[1], 6) AS first FROM (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / greatest(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12)) AS u FROM embeddings)""")
def _(spark, sf):
    u = table(spark, sf, "embeddings").select("vec_id", vectors.unit(F.col("embedding")).alias("u"))
    return u.select("vec_id", F.round(vectors.dot(F.col("u"), F.col("u")), 6).alias("square"), F.round(F.col("u")[0], 6).alias("first"))


@query("f24_marker_counts", "SELECT doc_id, (" + " + ".join(f"(length(text) - length(replace(text, '{m}', ''))) // {len(m)}" for m in MARKERS) + ")::BIGINT AS n_markers FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.occurrences(F.col("text"), MARKERS).alias("n_markers"))


@query("f25_length_buckets", """SELECT bucket, count(*)::BIGINT AS n FROM (SELECT CASE WHEN n_chars < 200 THEN '<200' WHEN n_chars < 1000 THEN '200-1000'
  WHEN n_chars < 5000 THEN '1000-5000' ELSE '>=5000' END AS bucket FROM documents) GROUP BY 1""")
def _(spark, sf):
    return table(spark, sf, "documents").groupBy(text.bucket(F.col("n_chars"), [200, 1000, 5000]).alias("bucket")).agg(F.count("*").alias("n"))


@query("f26_path_families", f"""WITH {_URL}, s AS (SELECT host, list_filter(string_split(path, '/'), lambda x: x <> '') AS seg FROM u)
SELECT regexp_replace(host, '^www\\.', '') AS host, seg[1] AS family, max(len(seg))::BIGINT AS depth, count(*)::BIGINT AS n FROM s WHERE len(seg) > 0 GROUP BY 1, 2 HAVING count(*) >= 2""")
def _(spark, sf):
    s = table(spark, sf, "pages").select(urls.host(F.col("url")).alias("host"), urls.path_segments(F.col("url")).alias("seg")).where(F.size("seg") > 0)
    return s.groupBy("host", F.col("seg")[0].alias("family")).agg(F.max(F.size("seg")).cast("long").alias("depth"), F.count("*").alias("n")).where("n >= 2")


@query("f27_sampling_rules", f"""WITH {_URL} SELECT page_id, host LIKE '%.org' AND q <> '' AS org_with_query,
  scheme = 'https' AND regexp_extract(path, '\\.([A-Za-z0-9]{{1,8}})$', 1) = '' AS https_no_extension FROM u""")
def _(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", urls.matches_rule(u, {"suffix": ".org", "with_query": True}).alias("org_with_query"),
        urls.matches_rule(u, {"scheme": "https", "without_extension": True}).alias("https_no_extension"))


@query("f28_discovery_class", f"""WITH {_URL}, p AS (SELECT page_id, lower(path) AS path, len(list_filter(string_split(path, '/'), lambda x: x <> '')) AS depth FROM u)
SELECT page_id, CASE WHEN regexp_matches(path, 'sitemap.*\\.xml') THEN 'sitemap' WHEN contains(path, 'robots.txt') THEN 'robots' WHEN regexp_matches(path, '(search|tim-kiem)') THEN 'search'
  WHEN regexp_matches(path, '(tag|category|topic)') THEN 'listing' WHEN depth <= 1 THEN 'shallow' ELSE 'article' END AS page_class FROM p""")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", urls.discovery_class(F.col("url")).alias("page_class"))


@query("t1_lexical_tokens", f"""SELECT doc_id, term, count(*)::BIGINT AS tf FROM (
  SELECT doc_id, 'w:' || unnest(regexp_extract_all(lower(text), '{W}')) AS term FROM documents) GROUP BY 1, 2""")
def _(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", F.explode(text.lexical_tokens(F.col("text"))).alias("term"))
    return t.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


@query("t2_folded_variants", f"""WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '{W}')) AS text FROM benchmark), f AS (SELECT *, {FOLDED} AS folded FROM w)
SELECT item_id, term, count(*)::BIGINT AS n FROM (SELECT item_id, text AS term FROM f WHERE text NOT IN ({STOP}) AND folded NOT IN ({STOP})
  UNION ALL SELECT item_id, folded FROM f WHERE text NOT IN ({STOP}) AND folded NOT IN ({STOP}) AND folded <> text) GROUP BY 1, 2""")
def _(spark, sf):
    t = table(spark, sf, "benchmark").select("item_id", F.explode(text.with_folded_variants(text.words(F.col("text")), text.ENGLISH_STOPWORDS)).alias("term"))
    return t.groupBy("item_id", "term").agg(F.count("*").alias("n"))


@query("t3_fts_query", r"""SELECT item_id, array_to_string(list_transform(list_filter(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN list_position(w, w[i]) = i THEN w[i] END),
  lambda x: x IS NOT NULL), lambda x: '"' || x || '"'), ' OR ') AS fts FROM (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda x: length(x) > 1) AS w FROM benchmark)""")
def _(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", text.fts_query(F.col("text")).alias("fts"))


@query("t4_english_tokens", f"""SELECT doc_id, term, count(*)::BIGINT AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9-]{{2,}}')) AS term FROM documents)
WHERE term NOT IN ({STOP}) GROUP BY 1, 2""")
def _(spark, sf):
    t = table(spark, sf, "documents").select("doc_id", F.explode(text.english_tokens(F.col("text"))).alias("term"))
    return t.groupBy("doc_id", "term").agg(F.count("*").alias("n"))


_BIGRAMS = f"""w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '{W}')) AS w FROM benchmark),
g AS (SELECT item_id, unnest(CASE WHEN length(w) < 2 THEN [w] ELSE list_transform(range(1, length(w)), lambda i: substr(w, i, 2)) END) AS gram FROM w)"""


@query("t5_char_bigram_sets", f"WITH {_BIGRAMS} SELECT item_id, count(DISTINCT gram)::BIGINT AS n_grams, min(gram) AS first, max(gram) AS last FROM g GROUP BY 1")
def _(spark, sf):
    g = table(spark, sf, "benchmark").select("item_id", text.char_bigrams(F.col("text"), distinct=True).alias("g")).where(F.size("g") > 0)
    return g.select("item_id", F.size("g").cast("long").alias("n_grams"), F.array_min("g").alias("first"), F.array_max("g").alias("last"))


@query("t6_char_bigrams", f"WITH {_BIGRAMS} SELECT gram, count(*)::BIGINT AS n, count(DISTINCT item_id)::BIGINT AS n_items FROM g GROUP BY 1")
def _(spark, sf):
    g = table(spark, sf, "benchmark").select("item_id", F.explode(text.char_bigrams(F.col("text"))).alias("gram"))
    return g.groupBy("gram").agg(F.count("*").alias("n"), F.count_distinct("item_id").alias("n_items"))


@query("t9_token_statistics", f"""SELECT lang, count(*)::BIGINT AS n, min(n_tokens)::BIGINT AS low, round(quantile_cont(n_tokens, 0.5), 6) AS median, round(quantile_cont(n_tokens, 0.95), 6) AS p95,
  max(n_tokens)::BIGINT AS high, count(*) FILTER (n_tokens > 512)::BIGINT AS over_limit FROM (SELECT lang, len(regexp_extract_all(lower(text), '{W}')) AS n_tokens FROM documents) GROUP BY 1""")
def _(spark, sf):
    n = table(spark, sf, "documents").select("lang", F.size(text.words(F.col("text"))).alias("n_tokens"))
    return n.groupBy("lang").agg(
        F.count("*").alias("n"), F.min("n_tokens").cast("long").alias("low"), F.round(F.percentile("n_tokens", 0.5), 6).alias("median"),
        F.round(F.percentile("n_tokens", 0.95), 6).alias("p95"), F.max("n_tokens").cast("long").alias("high"), F.count_if(F.col("n_tokens") > 512).alias("over_limit"))


@query("t10_word_5grams", f"""WITH t AS (SELECT item_id, regexp_extract_all(lower(text), '{W}') AS w FROM benchmark)
SELECT item_id, gram FROM (SELECT DISTINCT item_id, unnest({_GRAMS}) AS gram FROM t WHERE len(w) >= 24)""")
def _(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.explode(text.word_ngrams(text.words(F.col("text")), 5, 24)).alias("gram"))


@query("p21_promotional", r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '[\n.!?]+'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM documents),
f AS (SELECT doc_id, parts, list_filter(parts, lambda x: contains(lower(x), '%%%') OR contains(lower(x), '###')) AS flagged FROM s)
SELECT doc_id, len(flagged) >= 2 AND coalesce(list_sum(list_transform(flagged, lambda x: length(x))), 0) >= 0.5 * coalesce(list_sum(list_transform(parts, lambda x: length(x))), 0) AS promotional FROM f""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.promotional(F.col("text"), ["%%%", "###"]).alias("promotional"))


@query("n20_clean_paragraphs", r"""SELECT doc_id, array_to_string(list_filter(string_split_regex(text, '\n+'), lambda p: trim(p) <> '' AND NOT contains(lower(p), 'licens')
  AND NOT regexp_matches(p, '^(\s*\d{1,4}[-/.]\d{1,2}([-/.]\d{1,4})?\s*)+$')), chr(10)) AS cleaned FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.clean_paragraphs(F.col("text"), ["licens"]).alias("cleaned"))
