"""Exact expectations on small fixtures."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gleaner.functions import hashing, text, urls, vectors
from gleaner.operators import aggregate, chunk, evaluate, extract, fuse, index, pack, pool, retrieve, sample, select, stats
from gleaner.operators.concepts import understand
from gleaner.sources import files, tables
from gleaner.streaming import ingest


def column(spark, expr, value, schema="c string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("x")).first()["x"]


def test_han_tokens_are_unigrams_then_bigrams(spark):
    assert column(spark, text.lexical_tokens(F.col("c")), "Tim 心脏病 x1") == ["w:tim", "w:x1", "h1:心", "h1:脏", "h1:病", "h2:心脏", "h2:脏病"]


def test_tokens_of_null_and_empty(spark):
    for value in (None, "", " \n"):
        assert column(spark, text.words(F.col("c")), value) == []
        assert column(spark, text.lexical_tokens(F.col("c")), value) == []


def test_fold(spark):
    assert column(spark, text.normalize_folded(F.col("c")), "Đường—Huyết Thấp!") == "duong huyet thap"


def test_concise_query_falls_back(spark):
    assert column(spark, text.concise_query(F.col("c"), ["what is"]), "What is") == "What is"
    assert column(spark, text.concise_query(F.col("c"), ["what is"]), "What is a stroke") == "stroke"


def test_word_ngrams_need_enough_words(spark):
    assert column(spark, text.word_ngrams(text.words(F.col("c"))), "a b c d") == []
    assert column(spark, text.word_ngrams(text.words(F.col("c"))), "a b c d e f") == ["a b c d e", "b c d e f"]


@pytest.mark.parametrize(("url", "normal"), [
    ("HTTP://Example.ORG:80/a/?utm_source=x&b=1#top", "http://example.org/a?b=1"), ("https://a.b/", "https://a.b/"), ("https://a.b:8443/x?ref=1", "https://a.b:8443/x"),
    (" https://A.b.:443/%7Euser/%c3%a9%2f//?q=a b&empty=&x=%E9&utm_id=1#f", "https://a.b/~user/%C3%A9%2F?q=a%20b&empty=&x=%EF%BF%BD&utm_id=1"), ("http://x.y/cafe\u0301?a=/:@", "http://x.y/caf\u00e9?a=/:@"),
    ("HTTPS://x.y?b=2&b=1", "https://x.y/?b=2&b=1"), ("http://x.y:no/", None), ("http://x.y:81", "http://x.y:81/")])
def test_normalized_url(spark, url, normal):
    assert column(spark, urls.normalized(F.col("c")), url) == normal


def test_unicode_forms(spark):
    assert column(spark, text.normalize_text(F.col("c")), " Vie\u0323\u0302t \u00a0 na\u0301m\n") == "Vi\u1ec7t n\u00e1m"
    assert column(spark, text.accent_fold(F.col("c")), "\u0110\u01b0\u1eddng Vie\u0323\u0302t \u2460 \ufb01n \u0153") == "Duong Viet 1 fin \u0153"
    assert column(spark, text.normalize_folded(F.col("c")), "\u0110\u1eb7c-bi\u1ec7t!") == "dac biet"


def test_query_set_in_blocks(spark, monkeypatch):
    from gleaner.operators import retrieve

    q = spark.range(50).select(F.col("id").alias("query_id"), F.array(F.col("id").cast("double")).alias("q"))
    v = spark.range(7).select(F.col("id").alias("doc"), F.array(F.lit(1.0)).alias("v"))
    whole = {tuple(r) for r in retrieve.dense_top_k(q, v, 3).collect()}
    monkeypatch.setattr(retrieve, "SENT_ROWS", 8)
    assert {tuple(r) for r in retrieve.dense_top_k(q, v, 3).collect()} == whole and len(whole) == 150


def test_url_without_scheme(spark):
    assert column(spark, urls.host(F.col("c")), "www.Example.org/x") == "example.org"


def test_hash_fold_is_the_unsigned_prefix(spark):
    import hashlib

    n = int.from_bytes(hashlib.sha256(b"seed:7").digest()[:8], "big")
    assert column(spark, hashing.hash_fold("seed", F.col("c"), 5), 7, "c long") == n % 5


def test_cosine_refuses_zero_and_nan(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 0.0], [float("nan"), 1.0]), ([1.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = [r["c"] for r in df.select(vectors.cosine(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got[:2] == [None, None] and got[2] == pytest.approx(2**-0.5)


def test_bm25_equals_brute_force(spark):
    import math

    docs = [(1, "heart attack heart"), (2, "attack"), (3, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    ix = index.build(df, "doc_id", text.words(F.col("text")))
    terms = index.query_terms(spark.createDataFrame([(9, "heart heart attack")], "q long, text string"), "q", text.words(F.col("text")))
    got = {r["doc"]: r["score"] for r in retrieve.bm25_top_k(ix, terms, 5).collect()}
    words = {d: t.split() for d, t in docs}
    avg = sum(map(len, words.values())) / 3
    want = {}
    for d, w in words.items():
        s = 0
        for t, qf in (("heart", 2), ("attack", 1)):
            df_ = sum(t in x for x in words.values())
            tf = w.count(t)
            if tf:
                s += qf * math.log(1 + (3 - df_ + 0.5) / (df_ + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avg))
        if s:
            want[d] = round(s, 9)
    assert got == pytest.approx(want)


def test_rrf_ties_end_in_the_item(spark):
    rows = [(1, "a", 7, 1), (1, "a", 5, 2), (1, "b", 5, 1), (1, "b", 7, 2), (1, "b", 5, 9)]
    got = fuse.rrf(spark.createDataFrame(rows, "query_id long, arm string, item long, rank long"), "item", ["a", "b"], 5).orderBy("rank").collect()
    assert [(r["item"], r["rank"]) for r in got] == [(5, 1), (7, 2)]
    assert got[0]["score"] == round(1 / 61 + 1 / 62, 12) and (got[0]["rank_a"], got[0]["rank_b"]) == (2, 1)


def test_pool_reports_conflicting_owners(spark):
    rows = [(1, "R", 10, 1, 1), (1, "A", 11, 1, 1), (1, "A", 10, 2, 2)]
    got = pool.unified_pool(spark.createDataFrame(rows, "query_id long, arm string, doc_id long, chunk_id long, rank long"), {"R": 5, "A": 5, "N": 5}, "R", 10)
    assert {(r["chunk_id"], r["conflict"], r["membership"], r["pool_rank"]) for r in got.collect()} == {(1, True, "A+R", 1), (2, False, "A", 2)}
    with pytest.raises(pool.PoolError):
        pool.assert_none(got.where("conflict"), "conflict")


def test_controlled_selection_couples_caps_and_texts():
    row = lambda c, d, t: {"chunk_id": c, "doc_id": d, "chunk_text": t}
    rows = [row(1, 1, "a"), row(2, 1, "A "), row(3, 1, "b"), row(4, 1, "c"), row(5, 2, "c")]
    # 2 repeats 1's text and takes no place; 4 is over the cap and does not mark its text
    assert [r["chunk_id"] for r in select.controlled(rows, 2, True, 10)] == [1, 3, 5]


def test_near_duplicate():
    assert select.near_duplicate("A  b", "a b") and not select.near_duplicate("a b c", "a b d")
    assert select.longest_spans([(0, 3, "x"), (2, 9, "y"), (9, 10, "z")]) == [(2, 9, "y"), (9, 10, "z")]


def test_domain_shares_fills_without_caps():
    rows = [{"doc_id": i, "domain": "d" if i < 6 else "e", "fallback": False} for i in range(8)]
    got = [r["doc_id"] for r in select.domain_shares(rows, 6, 0.34, 2, False, 0)]
    assert got[:5] == [0, 1, 2, 6, 7] and len(got) == 6


def test_aggregate_uses_the_chunks_there_are(spark):
    rows = [(1, 1, 1, 4.0), (1, 1, 2, 2.0), (1, 2, 3, 3.5)]
    got = aggregate.aggregate_documents(spark.createDataFrame(rows, "query_id long, doc_id long, chunk_id long, score double"), 3, 5).orderBy("rank").collect()
    assert [(r["doc_id"], r["doc_score"], r["best_chunk"]) for r in got] == [(2, 3.5, 3), (1, 3.0, 1)]


def test_known_positive_rates(spark):
    rank = spark.createDataFrame([(1, 7, 2), (2, 8, 30)], "query_id long, doc_id long, rank long")
    r = evaluate.known_positive(rank, spark.createDataFrame([(1, 7), (2, 8)], "query_id long, doc_id long")).first()
    assert (r["recall_20"], r["recall_100"], r["mrr"]) == (0.5, 1.0, round((1 / 2 + 1 / 30) / 2, 6))


def test_two_percentiles_differ(spark):
    df = spark.createDataFrame([("g", float(i)) for i in range(1, 11)], "g string, v double")
    assert df.agg(stats.linear("v", 0.95).alias("x")).first()["x"] == 9.55
    assert stats.nearest(df, ["g"], "v", 0.95).first()["value"] == 10.0


def test_sample_does_not_depend_on_order(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(60)], "id long, g long")
    key = lambda d: {r["id"] for r in sample.per_group(d, "g", "id", "s", 4).collect()}
    assert key(df) == key(df.orderBy(F.desc("id")).repartition(7)) and len(key(df)) == 12


ARTICLE = """<html><head><title>T &amp; U</title><script type="application/ld+json">{"@type": "NewsArticle"}</script></head>
<body><nav><a href="/x">menu</a></nav><article><h1>T &amp; U</h1><p>One <b>two</b>.</p><h2>Part</h2><p>Three.<p>Four.</article><div class="ad-box">buy</div></body></html>"""


def test_extract_sections_and_offsets():
    d = extract.extract(ARTICLE)
    assert d["title"] == "T & U" and d["status"] == "SUCCESS" and "menu" not in d["text"] and "buy" not in d["text"]
    for s in d["sections"]:
        assert d["text"][s["start"] : s["end"]] == s["text"]
    assert d["sections"][-1]["heading_path"] == ["T & U", "Part"] and d["sections"][-1]["text"] == "Part\n\nThree.\n\nFour."
    assert extract.probe(ARTICLE)["template"] == "NEWS"


def test_extract_questions_and_shells():
    page = "<body><script>x()</script><main><div class='question'><p>What is it, exactly, that hurts so much?</p></div><div class='answer'><p>It is the heart, as the doctor said before.</p></div></main></body>"
    assert [s["section_type"] for s in extract.extract(page)["sections"]] == ["question", "answer"]
    assert extract.extract("<body><script>x()</script></body>")["status"] == "JS_SHELL"


def test_decode_order():
    assert extract.decode("é".encode("latin-1"), "text/html; charset=latin-1")[:2] == ("é", "iso8859-1")
    assert extract.decode("﻿x".encode(), None)[0] == "x"
    assert extract.decode(b"\xff\xfe\xff\xff\xd8", "text/html; charset=nonsense")[2] in (True, False)


def test_chunks_are_verbatim_and_overlap():
    text_ = " ".join(f"w{i}" for i in range(30))
    section = [{"section_type": "content", "start": 0, "end": len(text_), "heading_path": []}]
    got = chunk.chunks_of(1, text_, section, chunk.Size("t", 10, 2))
    assert [(c["n_tokens"], c["chunk_text"].split()[0]) for c in got] == [(10, "w0"), (10, "w8"), (10, "w16"), (6, "w24")]
    assert all(text_[c["start"] : c["end"]] == c["chunk_text"] for c in got)


def test_chunk_stops_at_a_paragraph():
    text_ = "a b c d e f\n\ng h i j k l m n"
    got = chunk.cuts(text_, chunk.Size("t", 8, 1))
    assert got[0][:2] == (0, 6) and got[1][0] == 5


def test_title_joins_the_next_section_but_not_a_question():
    s = lambda k, a, z: {"section_type": k, "start": a, "end": z, "heading_path": []}
    assert [(r["section_type"], r["start"]) for r in chunk.ranges([s("title", 0, 2), s("content", 4, 9)])] == [("content", 0)]
    assert [r["section_type"] for r in chunk.ranges([s("title", 0, 2), s("question", 4, 9)])] == ["title", "question"]


@pytest.mark.parametrize("bounds", [(0, 3), (40, 60), (190, 200)])
def test_expanded_window_holds_the_chunk(bounds):
    text_ = " ".join(f"word{i}" for i in range(40))
    a, z = chunk.expand(text_, *bounds, 12)
    assert a <= bounds[0] and z >= bounds[1] and (a == 0 or text_[a - 1] == " ") and (z == len(text_) or text_[z] == " ")
    assert chunk.centred(0, 2, 40, 10) == (0, 10) and chunk.centred(38, 40, 40, 10) == (30, 40) and chunk.centred(10, 12, 40, 6) == (8, 14)


def test_packing_keeps_everything():
    text_ = "A. " * 50 + "\n" + "b" * 30
    assert "".join("".join(chunk.pack_paragraphs(text_, 40)).split()) == "".join(text_.split())
    assert all(len(p) <= 40 for p in chunk.pack_paragraphs(text_, 40))
    assert "".join(text_[a:z] for a, z in chunk.evidence_spans(text_, 20)) == text_


def test_records_and_violations(spark):
    q = spark.createDataFrame([(1,), (2,)], "query_id long")
    docs = spark.createDataFrame([(1, 5, 1), (1, 4, 2)], "query_id long, doc_id long, rank long")
    ch = spark.createDataFrame([(1, 50, 5, "x y", 1), (1, 51, 5, "x y", 2)], "query_id long, chunk_id long, doc_id long, chunk_text string, rank long")
    packed = pack.records(q, docs, ch, 10, 10)
    got = {r["id"]: (r["relevant_docs"], len(r["relevant_chunks"])) for r in packed.collect()}
    assert got == {1: ([5, 4], 1), 2: ([], 0)}
    texts = spark.createDataFrame([(5, "w x y z")], "doc_id long, text string")
    assert pack.violations(packed, q, texts).count() == 0
    assert [r["problem"] for r in pack.violations(packed, q, spark.createDataFrame([(5, "other")], "doc_id long, text string")).collect()] == ["not verbatim"]


def test_bodies_append_once_and_refuse_changes(spark):
    new = spark.createDataFrame([(1, bytearray(b"a")), (2, bytearray(b"b"))], "id long, body binary")
    held = tables.append_bodies(spark.createDataFrame([], "id long, body binary, sha256 string"), new)
    assert held.count() == 2 and tables.append_bodies(held, new).count() == 0 and tables.corrupted(held).count() == 0
    with pytest.raises(tables.SourceError):
        tables.append_bodies(held, spark.createDataFrame([(1, bytearray(b"z"))], "id long, body binary"))
    with pytest.raises(tables.SourceError):
        tables.merge_parts([new, new], "id")


def test_files_are_stable(spark, tmp_path):
    df = spark.createDataFrame([(2, "é"), (1, None)], "id long, t string")
    path = str(tmp_path / "a.json")
    assert files.write_records(df, path, "id") == 2
    back = files.read_json_array(spark, path, "id long, t string")
    assert [(r["id"], r["t"]) for r in back.orderBy("id").collect()] == [(1, None), (2, "é")]
    for name in ("a", "b"):
        files.write_stable_zip("m.json", b"{}", str(tmp_path / name))
    assert (tmp_path / "a").read_bytes() == (tmp_path / "b").read_bytes()
    assert files.canonical_json({"b": 1, "a": "é"}) == '{"a":"é","b":1}'
    assert files.rss_items("<rss><item><link>u</link></item><item><link>u</link></item></rss>", 5) == [{"rank": 1, "url": "u", "title": ""}]


def test_monotone_keeps_success(spark):
    rows = [("k", 1, "SUCCESS"), ("k", 2, "TIMEOUT"), ("m", 1, "TIMEOUT"), ("m", 3, "NOT_FOUND")]
    got = ingest.monotone(spark.createDataFrame(rows, "key string, seq long, status string"), "key", F.col("status") == "SUCCESS", ["seq"])
    assert {(r["key"], r["status"]) for r in got.collect()} == {("k", "SUCCESS"), ("m", "NOT_FOUND")}


def test_stream_twice_changes_nothing(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([("k", 1, "SUCCESS"), ("k", 2, "TIMEOUT")], "key string, seq long, status string").write.parquet(src)
    target = ingest.VersionedTable(spark, str(tmp_path / "table"))
    merge = lambda d: ingest.monotone(d, "key", F.col("status") == "SUCCESS", ["seq"])
    for _ in range(2):
        stream = spark.readStream.schema("key string, seq long, status string").parquet(src)
        got = ingest.run_available(stream, target, merge, str(tmp_path / "check"))
        assert [(r["key"], r["seq"], r["status"]) for r in got.collect()] == [("k", 1, "SUCCESS")]


def test_spaced_starts_equal_the_loop(spark):
    at = [0, 1, 50, 51, 52, 300]
    got = ingest.spaced_starts(spark.createDataFrame([("g", i, a) for i, a in enumerate(at)], "g string, i long, a long"), "g", "a", ["i"], 20).orderBy("i").collect()
    want, prev = [], None
    for a in at:
        prev = a if prev is None else max(a, prev + 20)
        want.append(prev)
    assert [r["start"] for r in got] == want


def test_signature_and_progress(spark):
    done = spark.createDataFrame([(0, "v1")], "part long, signature string")
    with pytest.raises(ingest.StateError):
        ingest.unfinished_parts(spark.range(10).withColumnRenamed("id", "k"), done, 5, "k", "v2")
    assert ingest.progress(999_999, 1_000_000, 10)["percent"] == 99.99 and ingest.progress(0, 5, 1)["seconds_left"] == "INDETERMINATE"


def test_understanding_takes_longest_spans():
    got = understand("Is chest pain not heart attack ?", {"pain": "p", "chest pain": "cp", "heart attack": "ha"}, ("not",))
    assert got["concepts"] == ["cp", "ha"] and got["negated"] == [False, True] and got["polar"]


def test_seed_scores_take_the_first_store(spark):
    pairs = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "query_id long, chunk_id long")
    a = spark.createDataFrame([(1, 1, 0.5)], "query_id long, chunk_id long, score double")
    b = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.7)], "query_id long, chunk_id long, score double")
    assert {(r["chunk_id"], r["score"], r["store"]) for r in pool.seed_scores(pairs, [a, b]).collect()} == {(1, 0.5, 0), (2, 0.7, 1), (3, None, None)}


def test_round_robin_rotates(spark):
    rows = [(1, d, x, 1.0) for x, ds in (("a", (1, 2)), ("b", (3, 4))) for d in ds]
    got = pool.round_robin(spark.createDataFrame(rows, "query_id long, doc_id long, domain string, score double"), 4).orderBy("rank")
    assert [r["domain"] for r in got.collect()] == ["b", "a", "b", "a"]


def test_pandas_is_not_needed_for_empty_groups(spark):
    empty = spark.createDataFrame([], "query_id long, chunk_id long, doc_id long, chunk_text string, score double")
    out = select.fold_groups(empty, ["query_id"], ["score"], lambda r: r, "query_id long, position long")
    assert out.count() == 0 and isinstance(out.toPandas(), pd.DataFrame)


def test_consensus_swap_needs_independent_windows(spark):
    from gleaner.operators import pool

    words = lambda k, n=30: [f"w{k}x{i}" for i in range(n)]
    ranking = spark.createDataFrame([(1, d, d) for d in range(1, 21)], "query_id long, doc_id long, rank long")
    rows = [
        (1, 50, 9, words(1)), (1, 50, 10, words(2)),  # independent
        (1, 51, 1, words(3)), (1, 51, 2, words(3)), (1, 51, 3, words(3)),  # one text three times
        (1, 52, 4, words(4, 23)), (1, 52, 5, words(5, 23)),  # too short
        (1, 53, 6, words(6)), (1, 53, 7, words(6)[:20] + words(7)),  # 16 of 26 5-grams shared
        (1, 54, 8, words(8)), (1, 54, 11, words(9)), (1, 54, 12, words(8)),  # more windows come first
        (1, 55, 13, words(10)), (1, 55, 14, words(11)),  # a third one finds no place
        (1, 20, 15, words(12)), (1, 20, 16, words(12)), (1, 19, 17, words(13)), (1, 3, 18, words(14)), (1, 3, 19, words(15))]
    windows = spark.createDataFrame(rows, "query_id long, doc_id long, place long, words array<string>")
    got = {r["rank"]: (r["doc_id"], r["swapped"]) for r in pool.swap_by_consensus(ranking, windows, 15, 20, 2).collect()}
    assert got == {r: (r, False) for r in range(1, 21)} | {19: (54, True), 18: (50, True)}  # 20 has two windows


@pytest.mark.parametrize(("n", "queries", "k"), [(0, 3, 4), (60, 9, 5), (60, 9, 16), (200, 40, 16), (30, 2, 6)])
def test_review_queue_by_brute_force(spark, n, queries, k):
    import random

    from gleaner.operators import sample

    rnd = random.Random(n + k)
    rows = [(rnd.choice("abcdef"), rnd.randrange(2), rnd.randrange(queries), f"{rnd.random():.9f}", rnd.random() < 0.4) for _ in range(n)]
    chosen = {}
    for stratum in sorted({r[:2] for r in rows}):
        for r in sorted((r for r in rows if r[:2] == stratum), key=lambda r: r[3]):
            if len(chosen) < k and r[2] not in chosen:
                chosen[r[2]] = r[3]
                break
    for r in sorted(rows, key=lambda r: (not r[4], r[3])):
        if len(chosen) < k and r[2] not in chosen:
            chosen[r[2]] = r[3]
    df = spark.createDataFrame(rows, "source string, quality int, query_id long, key string, development boolean")
    got = sample.review_queue(df, ["source", "quality"], "query_id", "key", "development", k).orderBy("position").collect()
    assert [(r["query_id"], r["key"]) for r in got] == list(chosen.items())


def test_rank_by_score(spark):
    from gleaner.operators import fuse

    rows = [(i, x) for i, x in enumerate([0.5, 0.5, 0.49999, 3.0, 1e-9, 0.0, -2.0, 7.0, 0.5])]
    got = fuse.ranked_by_score(spark.createDataFrame(rows, "doc_id long, s double"), "s", "doc_id").orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == [i for i, _ in sorted(rows, key=lambda r: (-r[1], r[0]))] and [r["rank"] for r in got] == list(range(1, 10))


def _same_as_sql(spark, monkeypatch, folder, name, **tables):
    """The query and its SQL on these tables alone."""
    from gleaner import catalog
    from tests import oracle

    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{t}.parquet")
    monkeypatch.setattr(oracle, "TABLES", [])
    sql = f"WITH {', '.join(f'''{t} AS (SELECT * FROM '{folder}/{t}.parquet/*.parquet')''' for t in tables)} SELECT * FROM ({catalog.oracle_sql()[name]})"
    found = oracle.rows_of(catalog.queries()[name](spark, str(folder)))
    assert found == oracle.sql_rows(sql, folder)
    return found[1]


def test_promotional_segments_lose_blanks_not_digits(spark, monkeypatch, tmp_path):
    texts = ["a### b.%%% c. abcdefgh", "###1.###1.         1 1 1", "　###.　###.  ab　 . 0", "12### 3.1%%%4.. 0 .", "", None]
    _same_as_sql(spark, monkeypatch, tmp_path, "p21_promotional", documents=(list(enumerate(texts)), "doc_id long, text string"))
    assert column(spark, text.promotional(F.col("c"), ["###"]), "###.###.         a .") is True  # 6 of 7 characters, 6 of 17 with the blanks


def test_titles_are_those_of_the_source(spark, monkeypatch, tmp_path):
    pages = ["<title>a&&amp</title>", '<title>\n &quot;b&amp;lt; &nbsp;\x0b\t\nc&#39;　</title>', "<h1>d</h1>", "<title lang='x'>e</title><title>f</title>", "<TITLE>g</TITLE>", "<title>é <b>h</title>", "", None]
    rows = _same_as_sql(spark, monkeypatch, tmp_path, "x2_titles", pages=(list(enumerate(pages)), "page_id long, html string"))
    assert len(rows) == 8


def test_dense_search_against_plain_loops(spark, monkeypatch):
    """Ties, NaN, infinity, nulls, other widths and several blocks; no pair passes a join."""
    monkeypatch.setattr(retrieve, "SENT_ROWS", 4)
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [1.0], [1.0, None, 2.0], [nan, 1.0, 1.0], [inf, 0.0, 1.0], [-inf, 1.0, 0.0], [0.0, 0.0, 0.0]]
    vs = [(i, [float(i % 3 - 1), float(i * 7 % 5), float(i % 2)]) for i in range(300)] + [(300 + i, v) for i, v in enumerate(odd)]
    qs = [(i, [1.0, float(i), -0.5]) for i in range(9)] + [(20 + i, v) for i, v in enumerate(odd)]
    q = spark.createDataFrame(qs, "query_id long, q array<double>")
    v = spark.createDataFrame(vs, "doc long, v array<double>")

    def score(a, b):
        if a is None or b is None or len(a) != len(b) or None in a or None in b:
            return None
        return sum((x * y for x, y in zip(a, b, strict=True)), 0.0)

    def order(s):  # NaN first, then descending, null last
        return (2, 0) if s is None else (0, 0) if s != s else (1, -s)

    for k in (1, 5, 400):
        found = retrieve.dense_top_k(q, v, k)
        assert "NestedLoop" not in found._jdf.queryExecution().toString()
        got = [(r["query_id"], r["rank"], r["doc"], repr(r["score"])) for r in found.collect()]
        want = []
        for i, a in qs:
            best = sorted(((order(score(a, b)), d, score(a, b)) for d, b in vs), key=lambda x: x[:2])[:k]
            want += [(i, n, d, repr(s)) for n, (_, d, s) in enumerate(best, 1)]
        plain = lambda rows: sorted((a, b, c, "0.0" if d == "-0.0" else d) for a, b, c, d in rows)
        assert plain(got) == plain(want)


def test_cosine_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "SENT_ROWS", 4)
    odd = [None, [], [1.0], [1.0, None], [float("nan"), 1.0], [float("inf"), 0.0], [0.0, 0.0]]
    vs = [(i, [float(i % 3 - 1), float(i % 5)]) for i in range(40)] + [(40 + i, v) for i, v in enumerate(odd)]
    v = spark.createDataFrame(vs, "b long, v array<double>")
    q = v.where("b % 4 = 0 or b >= 40").select(F.col("b").alias("a"), F.col("v").alias("q"))
    found = retrieve.cosine_pairs(q, v, 6)
    assert "NestedLoop" not in found._jdf.queryExecution().toString()
    got = {(r["a"], r["b"]): r["cosine"] for r in found.collect()}
    want = q.crossJoin(v).where("a <> b").select("a", "b", F.round(vectors.cosine(F.col("q"), F.col("v")), 6).alias("cosine")).collect()
    assert len(got) == len(want) == 17 * 46
    for r in want:
        assert got[r["a"], r["b"]] == r["cosine"], r


def test_word_ngrams_cut_their_text_once(spark):
    assert str(text.word_ngrams(text.words(F.col("c")))).count("regexp_extract_all") == 1


def test_chunk_texts_are_not_broadcast(spark, small):
    from gleaner.plans.retrieval import chunks

    joined = spark.range(100).withColumnRenamed("id", "query_id").withColumn("chunk_id", F.col("query_id") % 9 + 4).join(chunks(spark, small).select("chunk_id", "chunk_text"), "chunk_id")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
