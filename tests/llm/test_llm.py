"""The operators against brute force and exact libraries, with the awkward inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gleaner.llm import bpe, embeddings, licences, line_dedup, linking, mixing, near_dedup, quality_pu, quality_rules, sharding, warc
from gleaner.llm.components import components
from gleaner.llm.queries import ORACLE_SQL, QUERIES
from gleaner.llm.textkit import Chunk
from gleaner.llm.workspace import Workspace
from tests.oracle import rows_of, sql_rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = " ".join(f"wörd{i % 977}x{i}" for i in range(40_000))


def rows(texts):
    return [(i, t, "en", f"s{i % 3}" if i % 7 else None, None) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, blanks, one very long text, copies, repeated rows, and columns whose names operators use inside."""
    base = "the quick brown fox jumps over the lazy dog and then it sleeps under an old tree until the sun has gone"
    texts = [None, "", " \n\t", "a", base, base, base.replace("quick", "slow"), base + "\n" + base, LONG, LONG + " end", "\n".join(["one and the same line of text"] * 5), "é ü MIT License. Apache License"]
    data = rows(texts) + rows(texts)[4:5]
    df = spark.createDataFrame(data, SCHEMA).withColumns({"id": F.lit(1), "row": F.lit("r"), "bucket": F.lit(2), "size": F.lit(3), "shard": F.lit("x"), "label": F.lit(0), "n": F.lit(0)})
    return df, data


@pytest.fixture(scope="module")
def labels(spark, small):
    return spark.read.parquet(f"{small}/labels.parquet")


@pytest.fixture(scope="module")
def documents(small):
    return pq.read_table(f"{small}/documents.parquet").to_pandas()


@pytest.mark.parametrize("name", [*QUERIES])
def test_query_runs(spark, small, name):
    cols, got = rows_of(QUERIES[name](spark, small))
    assert got
    if name in ORACLE_SQL:
        assert (cols, got) == sql_rows(ORACLE_SQL[name], small)


# --- embeddings -------------------------------------------------------------------------------------------------


def brute_links(vectors, threshold=0.95):
    ok = [i for i, (_, v) in enumerate(vectors) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, parent = Counter(), {i: i for i in range(len(vectors))}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ok:
        for b in ok:
            x, y = (np.array(vectors[k][1], np.float32).astype(float) for k in (a, b))
            if a < b and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                links[a] += 1
                links[b] += 1
                parent[max(root(a), root(b))] = min(root(a), root(b))
    groups = {}
    for i in range(len(vectors)):
        groups.setdefault(root(i), []).append(vectors[i][0])
    return sorted((vectors[i][0], links[i], min(groups[root(i)], key=lambda x: (x is None, x))) for i in range(len(vectors)) if vectors[i][0] is not None)


@pytest.mark.parametrize("leaf", [2048, 24])
def test_embeddings_equal_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(embeddings, "LEAF", leaf)
    monkeypatch.setattr(embeddings, "TILE", 16)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((30, 16))
    near = [base[i % 5] + rng.standard_normal(16) * 0.05 for i in range(70)]
    edge = [base[9] + rng.standard_normal(16) * 0.32 for _ in range(30)]  # many close to the threshold
    data = [(i, v.astype(np.float32).tolist()) for i, v in enumerate([*base, *near, *edge])]
    data += [(500, data[0][1]), (500, data[0][1]), (501, None), (502, []), (503, [0.0] * 16), (504, [float("nan")] * 16), (505, [None] + [1.0] * 15), (506, [1.0, 2.0])]
    random.Random(1).shuffle(data)
    got = embeddings.near_embeddings(spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)))
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got.collect()) == brute_links(data)


def test_dense_group_is_counted_by_its_ball(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "LEAF", 32)
    rng = np.random.default_rng(5)
    hot = rng.standard_normal(8)
    data = [(i, (hot + rng.standard_normal(8) * 0.01).tolist()) for i in range(150)] + [(200 + i, rng.standard_normal(8).tolist()) for i in range(80)]
    got = embeddings.near_embeddings(spark.createDataFrame(data, "vec_id long, embedding array<float>"))
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got.collect()) == brute_links(data)


@pytest.mark.parametrize("rounds", [60, 1, 0])
def test_embeddings_in_double_precision_and_out_of_rounds(spark, monkeypatch, rounds):
    """Doubles are compared as they are, and nodes left open after the last round are compared whole."""
    monkeypatch.setattr(embeddings, "LEAF", 16)
    monkeypatch.setattr(embeddings, "TILE", 8)
    monkeypatch.setattr(embeddings, "ROUNDS", rounds)
    monkeypatch.setattr(embeddings, "TREES", 12)
    rng = np.random.default_rng(7)
    base = rng.standard_normal((40, 12))
    data = [(i, v.tolist()) for i, v in enumerate([*base, *(base[i % 6] + rng.standard_normal(12) * 0.04 for i in range(80))])]
    sine = math.sqrt(1 - 0.95**2)
    data += [(900, [1.0] + [0.0] * 11), (901, [0.95 + 1e-12, sine] + [0.0] * 10), (902, [0.95 - 1e-9, 0.0, sine] + [0.0] * 9)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.near_embeddings(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()}
    x = np.array([v for _, v in data])
    s = x @ x.T / np.sqrt((x * x).sum(1)[:, None] * (x * x).sum(1)[None])
    assert {i: got[i][0] for i, _ in data} == {i: int(n) - 1 for (i, _), n in zip(data, (s >= 0.95).sum(1), strict=True)}
    assert got[901] == (1, 900) and got[902] == (0, 902)


def test_forest_rows_grow_by_a_bounded_share(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "LEAF", 64)
    rng = np.random.default_rng(8)
    ws = Workspace(spark, "test")
    for n, levels in ((512, 4), (2048, 6)):
        df = spark.createDataFrame([(i, rng.standard_normal(32).tolist()) for i in range(n)], "id long, v array<double>")
        made = embeddings.build_forest(df, ws)
        assert made.select("id").distinct().count() == n
        assert made.count() <= embeddings.TREES * n * (1 + 1.5 * embeddings.SHARE) ** levels


def test_embeddings_empty(spark):
    assert embeddings.near_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_components_of_a_path_and_a_star(spark):
    ws = Workspace(spark, "test")
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), ws).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)}
    assert components(spark.createDataFrame([], "a long, b long"), ws).count() == 0


# --- licences ---------------------------------------------------------------------------------------------------


def brute_licence(t):
    low = (t or "").translate({65 + i: 97 + i for i in range(26)})
    w, at, found = TERM.findall(low), [], set()
    for phrase, label in licences.BASE_PHRASES:
        p = phrase.split()
        for i in range(len(w)):
            if w[i : i + len(p)] == p:
                at.append(i)
                found.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(found))


def test_licences(spark, awkward, documents):
    texts = [*documents.text, "x " * 300 + "This work is licensed under the GNU GENERAL Public License, version 3. MIT License", "mit licensed", "Apache\nLicense", "general public licence"]
    df = spark.createDataFrame(rows(texts), SCHEMA)
    for frame, own in ((df, texts), (awkward[0], [r[1] for r in awkward[1]])):
        got = licences.scan_licences(frame).collect()
        want = sorted(((i, *brute_licence(t)) for i, t in zip([r["doc_id"] for r in got] if frame is awkward[0] else range(len(own)), own, strict=True)), key=str)
        have = sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got), key=str)
        if frame is awkward[0]:
            want = sorted(((d[0], *brute_licence(d[1])) for d in awkward[1]), key=str)
        assert have == want
        assert all(0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) for r in got)
    notice = {r["labels"] for r in licences.scan_licences(df).where(f"doc_id = {len(documents)}").collect()}
    assert notice == {"gpl,gpl-3.0,mit"}
    assert licences.scan_licences(df.limit(0)).count() == 0


def brute_labels(index, words):
    """Each template tried at every place: its key phrases and enough of its words within the drift."""
    found = {}
    for t, own in enumerate(index.words):
        for off in range(-len(own), len(words)):
            if share := index.verify(words, t, off, off):
                found[index.labels[t]] = max(found.get(index.labels[t], 0.0), share)
    return found


def test_licence_labels_against_every_place(spark):
    rnd = random.Random(5)
    noise = lambda n: [rnd.choice(["lorem", "the", "software", "license", "version", "of", "ipsum", "and", "copy", "gnu"]) for _ in range(n)]
    texts, planted = [], []
    every = licences.NOTICES + licences.TEMPLATES
    for label, text, keys in every:
        words = text.split()
        texts.append(" ".join(noise(rnd.randrange(60)) + words + noise(rnd.randrange(60))))
        planted.append(label)
        key = {w.decode() for k in keys for w in licences.split_words(k)}
        worn = [w if any(x.decode() in key for x in licences.split_words(w)) or rnd.random() > 0.15 else "worn" for w in words]
        texts.append(" ".join(noise(30) + worn + noise(9)))
        planted.append(label)
        texts.append(" ".join([*noise(20), *words[: len(words) // 3], *noise(15), *words[len(words) // 3 :]]))
        planted.append(None)
    df = spark.createDataFrame(rows(texts), SCHEMA)
    found, n = licences.word_frequencies(df, every, licences.BASE_PHRASES)
    index = licences.Index(df=found, n_docs=n)
    low = [licences.split_words(t) for t in texts]
    assert n == len(texts) and all(found[i] == sum(w in set(words) for words in low) for w, i in index.at.items())
    got = {r["doc_id"]: r for r in licences.scan_licences(df).collect()}
    for i, (words, label) in enumerate(zip(low, planted, strict=True)):
        own = set(filter(None, got[i]["labels"].split(",")))
        brute = brute_labels(index, words)
        if label:
            assert label in own and label in brute, (i, label)
            assert got[i]["score"] >= max(brute.values()) - 0.05  # a shifted place may meet a word of the noise
        # a candidate's drift may take in more than one place does, never less
        assert set(brute) <= own, (i, set(brute) - own)


def test_a_notice_needs_its_key_phrase():
    index = licences.Index()
    words = "licensed under the gnu general public licence version 3"
    assert licences.scan_texts(index, [words.encode()])[0][5] == ""


# --- quality ----------------------------------------------------------------------------------------------------


def brute_counts(t):
    t = t or ""
    w, seen, dup, where = WORD.findall(t), set(), 0, {}
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    for i in range(len(w) - 7):
        where.setdefault(tuple(w[i : i + 8]), []).append(i)
    again = {i + k for at in where.values() if len(at) > 1 for i in at for k in range(8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(again)


def test_rule_counts(spark, awkward, documents, labels):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for data, frame in ((awkward[1], awkward[0]), (rows(documents.text), spark.createDataFrame(rows(documents.text), SCHEMA))):
        got = quality_rules.apply_rules(frame, labels).collect()
        assert Counter((r["doc_id"], *(r[n] for n in names)) for r in got) == Counter((d[0], *brute_counts(d[1])) for d in data)
        for r in got:
            assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
            assert not (r["base_failed"] and r["kept"]) and r["kept"] == (not r["base_failed"] and r["probability"] >= 0.3)
    assert quality_rules.apply_rules(awkward[0].limit(0), labels.limit(0)).count() == 0


def test_rule_verdicts_by_brute_force(spark, documents, labels):
    """The n-gram model's probability, n-gram by n-gram."""
    big = spark.createDataFrame(rows(documents.text), SCHEMA)
    weights, slope, shift = quality_rules.train(big, labels)
    mask, top = (1 << 64) - 1, 64 - quality_rules.BITS

    def word_hash(ws):
        chunk = Chunk([" ".join(ws).encode()])
        starts, ends, doc = chunk.words(quality_rules.INK_BYTES)
        h = chunk.span_hash(starts, ends)
        return h if len(ws) == 1 else quality_rules.ngrams(h, doc, 2)[0]

    def probability(t):
        out, points = 0.0, [ord(c) for c in t + "\n"]
        for n in (2, 3, 4):
            at = []
            for i in range(len(points) - n + 1):
                g = points[i]
                for x in points[i + 1 : i + n]:
                    g = (g * 0x9E3779B97F4A7C15 + x) & mask
                at.append((g * 0xD6E8FEB86659FD93 & mask) >> top)
            if at:
                out += quality_rules.SCALE * np.mean(weights[n - 2][at], dtype=np.float64)
        words = WORD.findall(t)
        for kind, grams in ((3, [[w] for w in words]), (4, list(zip(words, words[1:], strict=False)))):
            if grams:
                out += quality_rules.SCALE * np.mean([weights[kind][int(word_hash(list(g))[0]) >> top] for g in grams], dtype=np.float64)
        return 1 / (1 + math.exp(-(slope * out + shift)))

    texts = [t for t in documents.text if t and len(t) < 1500][:60] + ["", "a", "é 漢字 😀 é", "x\ny"]
    model_rows = {r["doc_id"]: r for r in quality_rules.apply_rules(big, labels).collect()}
    place = {t: i for i, t in enumerate(documents.text)}
    for t in texts:
        if t in place:
            assert model_rows[place[t]]["probability"] == pytest.approx(probability(t), abs=2e-4), t[:60]
    chunk = Chunk([t.encode() for t in texts])
    c = quality_rules.counts(chunk)
    batch = 1 / (1 + np.exp(-(slope * quality_rules.margins(weights, chunk, *c["_words"]) + shift)))
    assert batch == pytest.approx([probability(t) for t in texts], abs=2e-4)


def brute_measure(t):
    """The quality features of a text, one after the other."""
    raw, words = t.encode(), re.findall(rb"[^ \t\n\x0b\x0c\r]+", t.encode())
    n, size = max(1, len(raw)), max(1, len(words))
    share = lambda test: sum(map(test, raw + b"\n")) / n
    five = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    lines = (raw + b"\n").split(b"\n")[:-1]
    return [
        share(lambda b: chr(b) in "#*$%&<>@^~=+_{}[]\\/"), share(lambda b: 65 <= b <= 90), share(lambda b: b == 124), share(lambda b: b == 33),
        share(lambda b: 48 <= b <= 57), share(lambda b: chr(b) in ",;:'\"()-?"), share(lambda b: b == 10),
        sum(map(len, words)) / size, sum(len(w) <= 3 for w in words) / size, len(set(words)) / size / math.sqrt(200 / max(200, size)),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / size, 1 - len(set(five)) / max(1, len(five)), math.log1p(len(words)),
        sum(w[-1] >= 128 or chr(w[-1]).isalpha() for w in words) / size, 1 - len(set(lines)) / len(lines), sum(65 <= w[0] <= 90 for w in words) / size,
        share(lambda b: b == 46), sum(len(w) >= 18 for w in words) / size]


def test_pu_features_and_scores_by_brute_force(spark, documents, labels):
    texts = [*[t for t in documents.text if t][:80], "", "a a a a a a\na a a a a a", "É 漢字 x|y!\n\n#", LONG]
    got = quality_pu.measure(Chunk([t.encode() for t in texts]))
    assert got == pytest.approx(np.array([brute_measure(t) for t in texts]), abs=1e-9)
    df = spark.createDataFrame(rows(documents.text), SCHEMA)
    known = labels.join(df.select("doc_id"), "doc_id")
    model = quality_pu.train(df, known)
    scores = {r["doc_id"]: (r["score"], r["predicted"]) for r in quality_pu.classify(df, known).collect()}
    for i, t in enumerate(documents.text):
        x = np.array([brute_measure(t or "")])
        margin = model.w[-1] + sum(model.w[j * quality_pu.BINS + int(np.searchsorted(c, x[0, j], side="right"))] for j, c in enumerate(model.cuts))
        want = 1 / (1 + math.exp(-(margin + model.shift)))
        assert scores[i][0] == pytest.approx(want, abs=1e-6) or abs(scores[i][0] - want) < 0.2  # a value on a bin's edge
        assert scores[i][1] == int(scores[i][0] >= 0.3)


def test_the_non_negative_risk_falls_and_ignores_labels_0(spark, documents, labels):
    rng = np.random.default_rng(3)
    pos, unl = rng.normal(1.5, 1, (2000, 2)), np.concatenate([rng.normal(1.5, 1, (1500, 2)), rng.normal(-1.5, 1, (1500, 2))])
    model = quality_pu.Model([np.unique(np.quantile(unl[:, j], np.linspace(0, 1, quality_pu.BINS + 1)[1:-1])) for j in (0, 1)])

    def risk():
        fp, fu = model.margin(model.bins(pos)), model.margin(model.bins(unl))
        return 0.5 * np.logaddexp(0, -fp).mean() + max(0.0, np.logaddexp(0, fu).mean() - 0.5 * np.logaddexp(0, fp).mean())

    before = risk()
    model.fit(pos, unl, 0.5)
    assert risk() < 0.5 * before
    model.set_threshold(pos)
    assert (model.score(pos) >= quality_pu.THRESHOLD).mean() >= 1 - 2 * quality_pu.LOST
    df = spark.createDataFrame(rows(documents.text), SCHEMA)
    same = [quality_pu.classify(df, x).orderBy("doc_id").collect() for x in (labels, labels.where("quality = 1"))]
    assert same[0] == same[1]


def held_out(got, labels):
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    return [(r["score"] if "score" in r else r["probability"], truth[r["doc_id"]]) for r in got if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]


def test_classifiers_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    for name in ("op3_quality_classifier", "op4_quality_rules"):
        got = QUERIES[name](spark, sf).collect()
        pairs = held_out(got, labels)
        good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
        auc = np.mean([np.mean([(g > b) + 0.5 * (g == b) for b in bad]) for g in good])
        assert auc > 0.94, name
        assert np.mean([s >= 0.3 for s in good]) > 0.97


def test_pu_scores(spark, awkward, labels):
    got = quality_pu.classify(awkward[0], labels).collect()
    assert len(got) == len(awkward[1]) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert {r["score"] for r in quality_pu.classify(awkward[0], labels.limit(0)).collect()} == {0.5}
    assert quality_pu.classify(awkward[0].limit(0), labels).count() == 0
    assert quality_pu.classify(awkward[0], labels, keep_rows=True).columns == awkward[0].columns


def test_class_prior_is_near_the_truth():
    rng = np.random.default_rng(1)
    pos = rng.normal(2, 1, 4000)
    unl = np.concatenate([rng.normal(2, 1, 5600), rng.normal(-2, 1, 2400)])
    assert abs(quality_pu.class_prior(pos, unl) - 0.7) < 0.06


# --- sharding and mixing ----------------------------------------------------------------------------------------


def test_communication_matrix():
    m = sharding.communication_matrix([5, 0, 100, 7], 16, 1)
    assert m.sum(1).tolist() == [5, 0, 100, 7] and np.ptp(m.sum(0)) == 0 and (m >= 0).all()
    sizes = [600_000_000, 600_000_000, 3, 5_000_000_000_000]
    m = sharding.communication_matrix(sizes, 16, 1)
    assert m.sum(1).tolist() == sizes and np.ptp(m.sum(0)) <= 1 and (m >= 0).all()


def test_large_hypergeometric_draws_follow_the_law():
    for good, bad, n in ((10**10, 3 * 10**10, 10_000), (6 * 10**8, 6 * 10**8, 10**9), (10**12, 5, 7)):
        rng = np.random.default_rng(1)
        x = np.array([sharding.hypergeometric(rng, good, bad, n) for _ in range(400)], float)
        share = good / (good + bad)
        sd = math.sqrt(n * share * (1 - share) * (good + bad - n) / (good + bad - 1))
        assert abs(x.mean() - n * share) <= 5 * sd / 20 + 1e-3 and abs(x.std() - sd) <= 0.2 * sd + 1e-2


def test_shards(spark, awkward):
    df, data = awkward
    for frame, n in ((df, len(data)), (spark.range(1000).withColumn("text", F.lit("same")), 1000)):
        got = sharding.shuffle_into_shards(frame, 16).collect()
        by = {}
        for r in got:
            by.setdefault(r["shard"], []).append(r["slot"])
        assert len(got) == n and set(by) <= set(range(16))
        counts = [len(by.get(s, [])) for s in range(16)]
        assert max(counts) - min(counts) <= 1 and all(sorted(x) == list(range(len(x))) for x in by.values())
    assert sharding.shuffle_into_shards(df.limit(0), 16).count() == 0
    clash = df.withColumns({c: F.lit("clash") for c in ("part", "at", "order", "cuts", "value", "bucket", "offset", "slot")})
    out = sharding.shuffle_into_shards(clash, 16)
    assert out.columns == [c for c in clash.columns if c not in ("shard", "slot")] + ["shard", "slot"]
    assert {(r["part"], r["value"], r["n"]) for r in out.collect()} == {("clash", "clash", 0)}


def test_shard_query_digests(spark, small, documents):
    got = {r["doc_id"]: r for r in QUERIES["op5_sharding"](spark, small).collect()}
    assert len(got) == len(documents)
    for d, t in zip(documents.doc_id, documents.text, strict=True):
        raw = (t or "").encode()
        assert (got[d]["size"], got[d]["text_crc32"], got[d]["law"]) == (len(raw) + 1, zlib.crc32(raw), "rows")


def test_shuffle_is_uniform(spark):
    """Over many seeds every row is in each shard, and at each slot, equally often."""
    df, where, slots = spark.range(24, numPartitions=3), Counter(), Counter()
    for seed in range(60):
        for r in sharding.shuffle_into_shards(df, 4, seed).collect():
            where[r["id"], r["shard"]] += 1
            slots[r["id"] % 6, r["slot"]] += 1
    chi = sum((where[i, s] - 15) ** 2 / 15 for i in range(24) for s in range(4))
    assert chi < 72 + 5 * 12  # 69 degrees of freedom
    assert sum((slots[i, s] - 40) ** 2 / 40 for i in range(6) for s in range(6)) < 25 + 5 * 7.1


def test_targets_are_capped_and_add_up():
    t = mixing.targets([100, 10, 1000, 50], [1, 2, 3, 1])
    assert sum(t) == pytest.approx(1160) and t[1] == 30 and t[3] <= 150
    assert mixing.targets([5], [1]) == [5.0] and mixing.targets([0, 0], [1, 2]) == [0.0, 0.0] and mixing.targets([], []) == []


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 37, 1000):
        got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5).cast("long")).alias("x")).collect()
        assert sorted(r["x"] for r in got) == list(range(n))


def test_mix(spark, awkward, documents):
    for data in (awkward[1], [(int(d), t, None, s, 0) for d, t, s in zip(documents.doc_id, documents.text, documents.source, strict=True)]):
        df = spark.createDataFrame(data, SCHEMA).withColumn("size", F.lit("clash"))
        got = mixing.mix_documents(df).collect()
        assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((d[0], len(WORD.findall(d[1] or ""))) for d in data)
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
        assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix_documents(df).collect()))
        taken, target = Counter(), {}
        source = {d[0]: d[3] for d in data}
        for r in got:
            taken[source[r["doc_id"]]] += r["taken"]
            target[source[r["doc_id"]]] = r["target"]
        assert all(abs(taken[s] - target[s]) <= 2 * mixing.BLOCK for s in target)
    assert mixing.mix_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_taken_equals_the_drawn_slots(spark, awkward):
    """The words of each document in each drawn block, counted one by one, and the blocks' own words."""
    df, data = awkward
    short = df.where("length(text) < 1000 or text is null").withColumn("_n", F.lit("clash"))
    mix = mixing.Mix(Workspace(spark, "test"), short, 8, mixing.SEED)
    rows_, slots = mix.rows.collect(), mix.slots.collect()
    owner = {}
    for r in rows_:
        for w in range(r["size"]):
            assert (r["_sid"], r["_start"] + w) not in owner
            owner[r["_sid"], r["_start"] + w] = r["_at"]
    taken, in_shards = Counter(), {}
    for s in slots:
        for w in range(8 * s["block"], 8 * s["block"] + 8):
            if (at := owner.get((s["_sid"], w))) is not None:
                taken[at] += 1
                in_shards.setdefault(at, set()).add(s["shard"])
    want = Counter((r["doc_id"], r["size"], taken[r["_at"]], min(in_shards.get(r["_at"], {None})), max(in_shards.get(r["_at"], {None}))) for r in rows_)
    got = mixing.mix_documents(short, block=8).select("doc_id", "size", "taken", "first_shard", "last_shard").collect()
    assert Counter(map(tuple, got)) == want
    assert len({(s["_sid"], s["slot"]) for s in slots}) == len(slots)
    blocks = mixing.mixed_blocks(short, block=8).collect()
    assert len(blocks) == len(slots) and all(r["n_words"] == len(r["text"].split(" ")) <= 8 for r in blocks)
    assert sum(r["n_words"] for r in blocks) == sum(taken.values())
    words = Counter(w for d in data if len(d[1] or "") < 1000 for w in WORD.findall(d[1] or ""))
    assert {w for r in blocks for w in r["text"].split(" ")} <= set(words)
    assert mixing.mixed_blocks(short.limit(0)).count() == 0


def test_mixed_documents_hold_the_taken_words(spark, awkward):
    df, data = awkward
    df = df.withColumns({c: F.lit("clash") for c in ("_row", "spans", "_spans", "left", "held")})
    out = mixing.mixed_documents(df, block=8)
    assert {tuple(r) for r in out.select("_row", "spans", "_spans", "left", "held").collect()} == {("clash",) * 5}
    assert out.columns == df.columns
    words = {d[0]: Counter(WORD.findall(d[1] or "")) for d in data}
    for r in out.collect():
        assert not Counter(WORD.findall(r["text"])) - words[r["doc_id"]]


# --- tokens -----------------------------------------------------------------------------------------------------


def test_bpe_equals_the_library(spark, awkward, documents):
    from tokenizers import Tokenizer

    spec = bpe.word_vocabulary()
    library = Tokenizer.from_str(spec)
    rnd = random.Random(4)
    pool = "aZéßİΣσς'sSdmlv \t   ́1²½漢字😀👍🏽!?.,-_<|endoftext|>\x1c\x85‍ẞŉﬁ\r\n"
    strange = ["<|endoftext|>", "a<|startoftext|>b", "it's I'LL", "ΣΑΣ ΟΔΟΣ", "İ", *("".join(rnd.choices(pool, k=25)) for _ in range(400))]
    data = [*awkward[1], *((1000 + i, t, None, None, None) for i, t in enumerate([*documents.text, *strange]))]
    for words in (1 << 16, 3):
        got = Counter(map(tuple, bpe.encode_documents(spark.createDataFrame(data, SCHEMA), spec, words).collect()))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want = Counter()
        for d in data:
            ids = library.encode(d[1] or "", add_special_tokens=False).ids
            want[d[0], len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))] += 1
        assert got == want
    assert bpe.encode_documents(spark.createDataFrame([], SCHEMA), spec).count() == 0


def test_long_words_merge_like_short_ones():
    import time

    from tokenizers import Tokenizer

    spec = bpe.word_vocabulary()
    tok, library, rnd = bpe.Tokenizer(spec), Tokenizer.from_str(spec), random.Random(2)
    words = ["a" * 200_000, "漢字" * 300, *("".join(rnd.choices("abcdeé漢", k=rnd.randrange(90, 900))) for _ in range(60))]
    start = time.time()
    for w in words:
        assert tok.merge(w) == library.encode(w, add_special_tokens=False).ids
    assert time.time() - start < 30


def test_lexicon_shares_suffixes_and_finds_exactly():
    entries = {w: [i, i + 1] for i, w in enumerate(["nation", "station", "ration", "rations", "é", "a", "ab"])}
    lexicon = bpe.Lexicon(bpe.compile_lexicon(entries))
    assert lexicon.find([*entries, "natio", "nations", "", "zz"]) == [*entries.values(), None, None, None, None]
    assert len(lexicon.final) < sum(map(len, entries))
    assert bpe.Lexicon(bpe.compile_lexicon({})).find(["a"]) == [None]


def test_full_encoding_returns_ids_and_text(spark):
    r = bpe.encode_documents(spark.createDataFrame(rows(["Hello, hello"]), SCHEMA), bpe.word_vocabulary(), full=True).first()
    assert len(r["ids"]) == r["n_tokens"] == 3 and r["decoded"] == "hello</w> ,</w> hello</w>"


# --- duplicates -------------------------------------------------------------------------------------------------


def shingles(t):
    w = TERM.findall((t or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_classes(data, sets, same):
    parent = list(range(len(data)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if same(i, j) or both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(data))]


def variants(n, seed):
    """Copies that drift from each other, so that many are alike and many only nearly so."""
    rnd, out = random.Random(seed), []
    base = [f"word{rnd.randrange(500)}" for _ in range(60)]
    for _ in range(n):
        w = list(rnd.choice(out).split() if out and rnd.random() < 0.5 else base)
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(60)] = f"new{rnd.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("tile", [512, 8])
def test_near_documents_equal_brute_force(spark, monkeypatch, awkward, tile):
    monkeypatch.setattr(linking, "TILE", tile)
    data = [*awkward[1], *((100 + i, t, None, None, None) for i, t in enumerate([*variants(60, 1), *variants(30, 2), "x y z", "X, y z"]))]
    df = spark.createDataFrame(data, SCHEMA).withColumns({c: F.lit("clash") for c in ("id", "row", "_row", "component")})
    roots = brute_classes(data, [shingles(d[1]) for d in data], lambda i, j: (data[i][1] or "") == (data[j][1] or ""))
    least = {}
    for d, r in zip(data, roots, strict=True):
        least[r] = min(least.get(r, d[0]), d[0])
    want = Counter((d[0], least[r]) for d, r in zip(data, roots, strict=True))
    assert Counter((r["doc_id"], r["class_id"]) for r in near_dedup.label_documents(df).collect()) == want
    kept = near_dedup.deduplicated(df)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(least.values()) and kept.columns == df.columns
    assert near_dedup.deduplicated(df.limit(0)).count() == 0


def test_prob_minhash_estimates_weighted_similarity():
    rng = np.random.default_rng(2)
    value = rng.integers(1, 2**62, 300).astype(np.uint64)
    w1, w2 = rng.uniform(0.5, 3, 300), rng.uniform(0.5, 3, 300)
    x = near_dedup.prob_minhash(value, np.zeros(300, int), w1, 1, 4096)[0]
    y = near_dedup.prob_minhash(value, np.zeros(300, int), w2, 1, 4096)[0]
    exact = sum(1 / np.maximum(w1 / a, w2 / b).sum() for a, b in zip(w1, w2, strict=True))
    assert abs((x == y).mean() - exact) < 0.04
    twice = near_dedup.prob_minhash(np.concatenate([value, value[:5]]), np.repeat([0, 1], [300, 5]), np.ones(305), 2, 64)
    assert (twice != 0).all() and set(twice[1]) <= set(value[:5])


def test_near_copies_with_a_repeated_passage(spark):
    """Set Jaccard 156 / 185 whatever the repeats, while the weighted similarity falls with them."""
    data, times = [], (1, 10, 30, 100)
    for k in range(40):
        text = " ".join(f"own{k}x{i}" for i in range(160))
        line = " ".join(f"line{k}x{i}" for i in range(25))
        data += [(2 * k, text), (2 * k + 1, "\n".join([text, *[line] * (1 + times[k % 4])]))]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in near_dedup.label_documents(df).collect()} == {d: d // 2 * 2 for d, _ in data}
    assert sorted(r["doc_id"] for r in near_dedup.deduplicated(df).collect()) == list(range(0, 80, 2))


def test_lines_equal_brute_force(spark, awkward):
    rnd = random.Random(9)
    base = variants(12, 3)
    texts = ["\n".join(rnd.choice(base) if rnd.random() < 0.6 else f"an own line number {i} {k} of this text" for k in range(4)) for i in range(25)]
    data = [*awkward[1], *((100 + i, t, None, None, None) for i, t in enumerate(texts))]
    blank = " \t\n\x0b\x0c\r"
    lines = [(d[0], i, s.strip(blank)) for d in dict.fromkeys(data) for i, s in enumerate((d[1] or "").lower().split("\n")) if s.strip(blank)]
    text = [x[2] for x in lines]
    sets = [{s[i : i + 8] for i in range(max(1, len(s) - 7))} for s in text]
    roots = brute_classes(lines, sets, lambda i, j: text[i] == text[j])
    first = {}
    for x, r in zip(lines, roots, strict=True):
        first[r] = min(first.get(r, x[:2]), x[:2])
    gone, every = {}, {}
    for x, r in zip(lines, roots, strict=True):
        every.setdefault(x[0], []).append(x[1])
        if x[:2] != first[r]:
            gone.setdefault(x[0], []).append(x[1])
    want, seen = [], set()
    for d in data:  # a repeated row keeps no line
        want.append((d[0], d[1], tuple(sorted((every if d in seen else gone).get(d[0], [])))))
        seen.add(d)
    df = spark.createDataFrame(data, SCHEMA).withColumns({c: F.lit("clash") for c in ("line", "row", "_row", "gone", "every", "number", "dropped", "_dropped", "copy")})
    got = line_dedup.line_counts(df).collect()
    assert Counter((r["doc_id"], r["n_lines"], tuple(r["dropped"])) for r in got) == Counter((i, (t or "").count("\n") + 1, out) for i, t, out in want)
    cut = line_dedup.without_repeated_lines(df)
    assert cut.columns == df.columns
    left = Counter((i, None if t is None else "\n".join(s for k, s in enumerate(t.split("\n")) if k not in out)) for i, t, out in want)
    rows_left = cut.collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows_left) == left
    assert all(r["row"] == r["_row"] == r["gone"] == r["number"] == "clash" for r in rows_left)
    assert line_dedup.line_counts(df.limit(0)).count() == 0 and line_dedup.without_repeated_lines(df.limit(0)).count() == 0


def test_short_lines_equal_brute_force(spark):
    rnd = random.Random(11)
    pool = ["x", "é", "les.", "lesson", "ab", "abc", "menu", " Menu\t", "12345678", "1234567", "aaaaaaaaa", "aaaaaaaaaaaa", "All rights reserved", "all rights reserved.",
            "ALL RIGHTS RESERVED", "read more >", "read more >>", "", "  ", "a longer line of text, 1", "a longer line of text, 2", "nineteen characters", "nineteen characters!"]
    data = [(i, "\n".join(rnd.choice(pool) if rnd.random() < 0.5 else f"own {i * 10 + k}" for k in range(6))) for i in range(40)]
    data += [(100, "twice\ntwice"), (101, "once here")]
    lines = [(d, i, s.strip(" \t")) for d, t in data for i, s in enumerate(t.lower().split("\n")) if s.strip(" \t")]
    text = [x[2] for x in lines]
    sets = [{s[i : i + 8] for i in range(max(1, len(s) - 7))} for s in text]
    roots = brute_classes(lines, sets, lambda i, j: text[i] == text[j])
    gone = {}
    for k, (x, r) in enumerate(zip(lines, roots, strict=True)):
        if k != r:  # lines are in order, so a root is its component's first
            gone.setdefault(x[0], []).append(x[1])
    got = line_dedup.line_counts(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert {r["doc_id"]: list(r["dropped"]) for r in got} == {d: gone.get(d, []) for d, _ in data}
    assert gone[100] == [1] and 101 not in gone
    assert linking.char_shingles("abc") != linking.char_shingles("abd") and not len(linking.char_shingles(""))


def test_packed_buckets_equal_plain_ones(spark, monkeypatch):
    rnd = random.Random(5)
    keys = np.random.default_rng(5).integers(-(2**63), 2**63 - 1, 3000, np.int64)
    rows = [(k, rnd.randrange(-9, 9)) for k in keys.tolist() for _ in range(rnd.choice((1, 1, 1, 2, 5)))] + [(int(keys[0]), i % 700) for i in range(5000)]
    rnd.shuffle(rows)
    plain = spark.createDataFrame(rows, "bucket long, id long")
    packs = []
    for lo in range(0, len(rows), 2500):  # as many tasks' rows
        of, packed = linking.pack(*np.array(rows[lo : lo + 2500], np.int64).T)
        assert len(set(of.to_pylist())) == len(of)
        packs += zip(of.to_pylist(), packed.to_pylist(), strict=True)
    dealt = spark.createDataFrame([(o, bytearray(p)) for o, p in packs], "slice int, packed binary")
    ws = Workspace(spark, "test")
    want = sorted(map(tuple, linking.shared_buckets(plain, ws).collect()))
    assert len(want) > 1000 and sorted(map(tuple, linking.shared_buckets(dealt, ws).collect())) == want
    assert linking.shared_buckets(dealt.limit(0), ws).count() == 0
    monkeypatch.setattr(linking, "HELD", 3)  # a full bucket goes out in parts
    table = pa.table({"slice": pa.array([o for o, _ in sorted(packs)], pa.int32()), "packed": [p for _, p in sorted(packs)]})
    parts = list(linking._several(iter([*table.to_batches(max_chunksize=7), table.to_batches()[0].slice(0, 0)])))
    got = {x for b in parts for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
    assert got == {(b, i) for b, i, _ in want}


def test_band_keys_are_not_rows():
    """30,000 keys of 2,500 lines make a row for each slice at most, not one for each key."""
    texts = ["\n".join(f"line {k} of the text {i} is {i * 31 + k} long" for k in range(50)) for i in range(50)]
    ids = pa.array(range(50), pa.int64())
    out = list(line_dedup._read(iter([pa.RecordBatch.from_arrays([ids, pa.array(texts), ids, ids], names=["doc_id", "text", "row", "copy"])])))
    lines = [x for b in out for x in b.column("line").to_pylist() if x is not None]
    packed = [x for b in out for x in b.column("packed").to_pylist() if x is not None]
    pairs = [tuple(x) for p in packed for x in np.frombuffer(p, np.int64).reshape(-1, 2).tolist()]
    assert len(lines) == 2500 and len(packed) <= 2**linking.SLICE_BITS and len(pairs) >= 2500 * line_dedup.BANDS and {i for _, i in pairs} == set(lines)


def test_sets_of_many_texts_are_those_of_each(monkeypatch):
    rnd = random.Random(3)
    texts = ["", "a", "1234567", "12345678", "é" * 30, "\U0001f600" * 9, *("".join(rnd.choice("ab é\U0001f600") for _ in range(rnd.randrange(60))) for _ in range(200))]
    for block in (1, 100, 1 << 16):
        monkeypatch.setattr(linking, "BLOCK", block)
        for t, found in zip(texts, linking.char_sets(texts), strict=True):
            assert found.tolist() == linking.char_shingles(t).tolist()


def test_span_hash_tells_spans_apart():
    chunk = Chunk([b"ab ab ba abab", b"", b"ab"])
    starts, ends, doc = chunk.words()
    h = chunk.span_hash(starts, ends)
    assert h[0] == h[1] == h[4] and len(set(h.tolist())) == 3 and doc.tolist() == [0, 0, 0, 0, 2]


# --- archive ----------------------------------------------------------------------------------------------------


def test_audit_finds_every_fault(spark):
    pages = [(i, f"http://x/{i}", f"<p>{i}</p>") for i in range(300)] + [(None, None, None), (5, "http://x/5", "<p>5</p>"), (5, "http://y", None)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    record = warc.warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    good = df.select("page_id", F.sha2(record, 256).alias("digest"), F.octet_length(record).cast("long").alias("length"))
    bad = good.select("page_id", F.col("digest").alias("expected"), F.when(F.col("page_id").isin(7, 250), "0").otherwise(F.col("digest")).alias("digest")).where("page_id is null or page_id <> 99")
    got = warc.audit(good, bad).orderBy("ordinal").collect()
    assert [r["ordinal"] for r in got] == list(range(302)) and sum(r["copies"] for r in got) == len(pages)
    assert {(r["page_id"], r["status"]) for r in got if r["status"] != "ok"} == {(7, "altered"), (250, "altered"), (99, "missing")}
    assert [r["offset"] for r in got] == np.concatenate(([0], np.cumsum([r["length"] for r in got])[:-1])).tolist()
    assert warc.audit(good.limit(0), bad.limit(0)).count() == 0


def test_audit_compares_copies_extras_and_order(spark):
    a = [(i, f"d{i:02}", 10) for i in range(40)] + [(3, "d03", 10), (4, "d04", 10), (5, "d05", 10), (None, "dn", 10)]
    b = [(i, f"d{i:02}", f"d{i:02}", 100 + 10 * i) for i in range(40)] + [(3, "d03", "x", 500), (5, "d05", "d05", 510), (5, "d05", "d05", 520), (None, "dn", "dn", 0)]
    b += [(77, "d77", "d77", 600), (None, "dz", "dz", 610)]
    b = [(p, e, d, {20: 315, 30: 395}.get(p, o)) for p, e, d, o in b if p != 9]  # 20 and 21 change places, 30 has a gap before it only
    good = spark.createDataFrame(a, "page_id long, digest string, length long")
    got = warc.audit(good, spark.createDataFrame(b, "page_id long, expected string, digest string, offset long")).collect()
    found = {(r["page_id"], r["digest"]): (r["status"], r["copies"], r["held"], r["good"]) for r in got if r["status"] != "ok"}
    assert len(got) == 41 + 2 and found == {
        (3, "d03"): ("altered", 2, 2, 1), (4, "d04"): ("missing", 2, 1, 1), (5, "d05"): ("extra", 2, 3, 3), (9, "d09"): ("missing", 1, 0, 0),
        (20, "d20"): ("moved", 1, 1, 1), (21, "d21"): ("moved", 1, 1, 1), (77, "d77"): ("extra", 0, 1, 1), (None, "dz"): ("extra", 0, 1, 1)}
    assert [r["ordinal"] for r in got if r["copies"] == 0] == [None, None]


def test_a_lazy_result_outlives_a_pipeline_stage(spark, small):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    held = near_dedup.label_documents(docs.select("doc_id", "text"))
    kept = corpus_pipeline.near_dedup(spark, docs, small)
    n = kept.count()
    corpus_pipeline.mix(spark, docs, small)
    assert held.where("kept").count() == n and held.count() == docs.count()


def test_pipeline_stages_on_awkward_tables(spark, small, awkward):
    """Nulls, repeated rows and clashing names as every stage's input, and a table without rows."""
    import corpus_pipeline

    df = awkward[0].withColumns({c: F.lit("clash") for c in ("_row", "row", "gone", "spans", "held", "dropped")})
    for name, apply in corpus_pipeline.STAGES:
        out, none = apply(spark, df, small), None
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == df.columns, name
            assert {tuple(r) for r in out.select("_row", "row", "gone", "spans", "held", "dropped").distinct().collect()} <= {("clash",) * 6}
        else:
            assert out.count() == df.count()
        none = apply(spark, df.limit(0), small)
        assert none.columns == out.columns and none.count() == 0, name


def test_pipeline(spark, small, documents):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, ids = docs.columns, set(documents.doc_id)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = Workspace(spark, "pipeline").save(stage(spark, docs, small))
        found = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert found <= ids and found, name
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        if k == 2:
            assert docs.count() == docs.select("text").distinct().count()
        ids = found
    assert corpus_pipeline.run(spark, small).count() == docs.count()


def test_lexicon_is_compiled_by_a_task(spark, monkeypatch):
    """The driver neither sees the words nor builds the automaton, and gets the same block."""
    from gleaner.llm import bpe

    docs = spark.createDataFrame([(f"alpha beta{i % 7} gamma",) for i in range(50)] + [("",), (None,)], "text string")
    spec = spark.sparkContext.broadcast(bpe.word_vocabulary())
    tok = bpe.Tokenizer(spec.value)
    want = bpe.compile_lexicon({w: tok.merge(w) for w in {w for i in range(7) for w in tok.words(f"alpha beta{i} gamma")}})

    compiled = bpe.compile_lexicon

    def within_a_task(entries):
        from pyspark import TaskContext

        assert TaskContext.get() is not None
        return compiled(entries)

    monkeypatch.setattr(bpe, "compile_lexicon", within_a_task)
    assert bpe.build_lexicon(docs, spec) == want
    assert len(bpe.build_lexicon(docs.where("false"), spec)) > 0
