"""Embedding near-duplicates by a forest of random-projection trees with spill.

Exact copies are one class with a count.  Each of ``TREES`` trees splits the
vectors recursively along random projections.  A node's cut lies between the
``1 - MIDDLE`` and ``MIDDLE`` quantiles where the fewest vectors are near it, and
vectors within ``SPILL`` of the cut go to both sides, or within a smaller width
that takes ``SHARE`` of the node, so that a level makes at most that share more
rows.  A round splits every node over ``LEAF`` rows by a subtree fitted on a
bounded hashed sample of that node: the number of rounds grows with the logarithm
of the rows and no node is gathered in one task.  Vectors are compared in double
precision within leaves; a pair that shares several leaves counts in the least of
them only.  Nodes that cannot be cut so (a width under a quarter of ``SPILL``, or
``ROUNDS`` rounds over) are compared whole, in square tiles.

Dense groups: one more tree, without spill, looks for balls at each of its nodes:
a ball of half the linking angle holds only vectors that all link with each other
(the triangle inequality on angles), so its links are counted, not enumerated, and
only pairs across balls are compared.

Cases: vectors that are null, empty, zero or hold null or non-finite components
link with nothing, nor do rows without id; vectors of other lengths never link;
repeated rows are separate vectors; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from gleaner.llm.components import components
from gleaner.llm.textkit import give_back
from gleaner.llm.workspace import Workspace

THRESHOLD, TREES, LEAF, SAMPLE, TILE = 0.95, 6, 2048, 2048, 1024
SPILL, SHARE, MIDDLE, DEPTH, ROUNDS, GROUP = 0.02, 0.1, 0.65, 6, 60, 8192
PIVOTS, PIVOT_SHARE = 64, 0.004
MIXER = 0x9E3779B97F4A7C15


def _unit(vectors) -> np.ndarray:
    x = np.array(list(vectors), np.float64)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def pivots(sample: np.ndarray, threshold: float) -> np.ndarray:
    """Centres of balls that hold a good share of the sample, densest first."""
    reach, out = math.cos(math.acos(threshold) / 2 - 1e-6), []
    left = sample
    while len(left) and len(out) < PIVOTS:
        near = np.zeros(len(left), np.int64)
        for i in range(0, len(left), 512):
            near[i : i + 512] = (left[i : i + 512] @ left.T >= reach).sum(1)
        if near.max() < max(8, PIVOT_SHARE * len(sample)):
            break
        centre = left[near.argmax()]
        centre = left[left @ centre >= reach].mean(0)
        centre /= np.linalg.norm(centre)
        inside = left @ centre >= reach
        if not inside.any():
            break
        out.append(centre)
        left = left[~inside]
    return np.array(out)


def ball_of(x: np.ndarray, centres: np.ndarray, threshold: float) -> np.ndarray:
    """The first ball that holds each vector, or -1."""
    if not len(centres):
        return np.full(len(x), -1)
    inside = x @ centres.T >= math.cos(math.acos(threshold) / 2 - 1e-6)
    return np.where(inside.any(1), inside.argmax(1), -1)


def choose_cut(p: np.ndarray, spill: float) -> tuple[float, float] | None:
    """(cut, width) for a node's projections, or None where no cut keeps the overlap within its share."""
    p = np.sort(p)
    if p[0] == p[-1]:
        return None
    if not spill:
        return float(np.median(p)), 0.0
    at = p[np.linspace((1 - MIDDLE) * (len(p) - 1), MIDDLE * (len(p) - 1), 31).astype(int)]
    near = np.searchsorted(p, at + spill, "right") - np.searchsorted(p, at - spill)
    fewest = np.flatnonzero(near == near.min())
    cut = float(at[fewest[len(fewest) // 2]])
    width = min(spill, float(np.partition(np.abs(p - cut), int(SHARE * len(p)))[int(SHARE * len(p))]))
    return (cut, width) if width >= spill / 4 else None


def fit_subtree(root: int, sample: np.ndarray, rows: int, spill: float) -> list[float]:
    """Cuts and widths of a binary subtree in heap order; NaN marks a leaf."""
    depth = min(DEPTH, max(1, int(math.log2(max(2, len(sample) / 16)))))
    cuts = [math.nan] * (2 * (2**depth - 1))
    held: dict[int, np.ndarray] = {0: sample}
    for node in range(len(cuts) // 2):
        x = held.pop(node, None)
        if x is None or len(x) < 8 or node and len(x) * rows < 0.8 * LEAF * len(sample):
            continue
        p = x @ direction(root, node, x.shape[1])
        if chosen := choose_cut(p, spill):
            cut, width = cuts[2 * node], cuts[2 * node + 1] = chosen
            held[2 * node + 1], held[2 * node + 2] = x[p <= cut + width], x[p > cut - width]
    return cuts


def direction(root: int, node: int, dims: int) -> np.ndarray:
    g = np.random.default_rng([root & 0xFFFFFFFFFFFFFFFF, node]).standard_normal(dims)
    return g / np.linalg.norm(g)


def descend(root: int, cuts: np.ndarray, x: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(node, indices) of the leaves that rows reach; spilled rows reach several."""
    out, todo = [], [(0, np.arange(len(x)))]
    while todo:
        node, at = todo.pop()
        if not len(at):
            continue
        if 2 * node >= len(cuts) or math.isnan(cuts[2 * node]):
            out.append((node, at))
            continue
        p = x[at] @ direction(root, node, x.shape[1])
        cut, width = cuts[2 * node], cuts[2 * node + 1]
        todo += [(2 * node + 1, at[p <= cut + width]), (2 * node + 2, at[p > cut - width])]
    return out


def child_id(root: int, node: int) -> int:
    h = (root ^ (node + 1) * MIXER) & 0xFFFFFFFFFFFFFFFF
    h = ((h ^ (h >> 31)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    h ^= h >> 29
    return h - (1 << 64) if h >> 63 else h


def grow(open_: DataFrame, ws: Workspace, spill: float, reach: float | None = None) -> DataFrame:
    """Split ``open_`` (id, v, node) until nodes are leaves: (leaf, id, stuck, ball).

    With ``reach`` (a linking threshold) vectors in a ball of a node's sample leave the tree there.
    """
    kind = open_.schema["v"].dataType.elementType.simpleString()
    none = F.lit(None).cast("array<double>")
    done = [open_.limit(0).select(F.col("node").alias("leaf"), "id", F.lit(False).alias("stuck"), F.lit(-1).cast("long").alias("ball"))]
    open_ = ws.save(open_)
    for last in [False] * ROUNDS + [True]:
        sizes = ws.save(open_.groupBy("node").agg(F.count("*").alias("n")))
        if not sizes.limit(1).count():
            break
        counted = open_.join(sizes, "node")
        over = counted.where(F.col("n") > LEAF) if not last else counted.limit(0)
        stuck = F.col("n") > LEAF
        rest = counted.where(~stuck) if not last else counted
        done.append(ws.save(rest.select(F.col("node").alias("leaf"), "id", stuck.alias("stuck"), F.lit(-1).cast("long").alias("ball"))))
        chance = F.lit(2.0**63) * F.lit(float(SAMPLE)) / F.col("n")
        sample = over.where(F.abs(F.xxhash64("id", "node").cast("double")) < chance)
        model = ws.save(sample.groupBy("node").applyInPandas(_fit(spill, reach), "node long, n long, cuts array<double>, centres array<double>"))
        groups = lambda n: F.ceil(n / F.lit(GROUP)).cast("int")
        rows = over.withColumn("part", F.pmod(F.xxhash64("id"), groups(F.col("n"))))
        rows = rows.select("node", "part", "id", "v", none.alias("cuts"), none.alias("centres"))
        # a group's model comes with it as a row without a vector
        parts = model.withColumn("part", F.explode(F.sequence(F.lit(0), groups(F.col("n")) - 1))).select(
            "node", "part", F.lit(0).cast("long").alias("id"), F.lit(None).cast(f"array<{kind}>").alias("v"), "cuts", "centres")
        split = ws.save(
            rows.unionByName(parts).groupBy("node", "part")
            .applyInPandas(_split(reach), f"id long, v array<{kind}>, node long, stuck boolean, ball long"))
        ended = F.col("stuck") | (F.col("ball") >= 0)
        done.append(ws.save(split.where(ended).select(F.col("node").alias("leaf"), "id", "stuck", "ball")))
        after = ws.save(split.where(~ended).select("id", "v", "node"))
        ws.drop(open_, sizes, model, split)
        open_ = after
    ws.drop(open_)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _fit(spill: float, reach: float | None):
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        root, rows = int(pdf.node.iloc[0]), int(pdf.n.iloc[0])
        x = _unit(pdf.sort_values("id").v)
        centres = pivots(x, reach) if reach else np.empty((0, 0))
        if len(centres):
            x = x[ball_of(x, centres, reach) < 0]
        return pd.DataFrame({"node": [root], "n": [rows], "cuts": [fit_subtree(root, x, rows, spill) if len(x) else []], "centres": [centres.ravel().tolist()]})

    return fit


def _split(reach: float | None):
    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        root, model = int(pdf.node.iloc[0]), pdf[pdf.v.isna()]
        pdf = pdf[pdf.v.notna()]
        if not len(pdf):
            return pd.DataFrame({"id": [0], "v": [[0.0]], "node": [0], "stuck": [False], "ball": [0]})[:0]
        # a node of few rows may have an empty sample
        cuts, centres = (np.array(model[c].iloc[0] if len(model) else [], np.float64) for c in ("cuts", "centres"))
        x = _unit(pdf.v)
        ball = ball_of(x, centres.reshape(-1, x.shape[1]), reach)
        parts = [pd.DataFrame({"id": pdf.id, "v": pdf.v, "node": root, "stuck": False, "ball": [child_id(root, -2 - b) & (2**63 - 1) for b in ball.tolist()]})[ball >= 0]]
        free = np.flatnonzero(ball < 0)
        if not len(cuts) or math.isnan(cuts[0]):
            own = pdf.iloc[free]
            parts.append(pd.DataFrame({"id": own.id, "v": own.v, "node": root, "stuck": True, "ball": -1}))
        else:
            for node, at in descend(root, cuts, x[free]):
                own = pdf.iloc[free[at]]
                parts.append(pd.DataFrame({"id": own.id, "v": own.v, "node": child_id(root, node), "stuck": False, "ball": -1}))
        return pd.concat([p for p in parts if len(p)])

    return split


def build_forest(vectors: DataFrame, ws: Workspace) -> DataFrame:
    """(leaf, id, stuck) of all trees for ``vectors`` (id, v)."""
    roots = vectors.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))))
    return grow(roots.select("id", "v", F.xxhash64("tree", F.size("v"), F.lit("root")).alias("node")), ws, SPILL).drop("ball")


def find_balls(vectors: DataFrame, ws: Workspace, threshold: float) -> DataFrame:
    """(id, ball) of the vectors in dense groups, each in one ball."""
    root = vectors.select("id", "v", F.xxhash64(F.size("v"), F.lit("balls")).alias("node"))
    return grow(root, ws, 0.0, threshold).where("ball >= 0").select("id", "ball")


def tiles(leaves: DataFrame, ws: Workspace) -> DataFrame:
    """(leaf, tile_a, tile_b, id, ...): a leaf's rows by blocks, one group for each pair of blocks.

    Blocks hold one ball's vectors or vectors of no ball; blocks of one ball are
    not paired with each other or themselves, as those links are known.
    """
    sizes = ws.save(leaves.groupBy("leaf", "ball").agg(F.count("*").alias("n")))
    kinds = sizes.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("ball", "n"))).alias("kinds"))  # balls, not rows
    total = F.aggregate("kinds", F.lit(0).cast("long"), lambda a, k: a + k["n"])
    blocks = F.transform("kinds", lambda k: F.struct(k["ball"].alias("ball"), F.ceil(k["n"] / F.lit(TILE)).cast("int").alias("blocks")))
    plan = ws.save(kinds.select("leaf", (total <= 2 * TILE).alias("small"), blocks.alias("blocks")))
    rows = leaves.join(plan, "leaf")
    own = F.filter("blocks", lambda b: b["ball"] == F.col("ball"))[0]["blocks"]
    name = lambda ball, i: F.concat_ws(":", ball.cast("string"), i.cast("string"))
    mine = name(F.col("ball"), F.pmod(F.xxhash64("id"), own).cast("int"))
    others = F.flatten(F.transform(
        F.filter("blocks", lambda b: (b["ball"] != F.col("ball")) | (b["ball"] < 0)),
        lambda b: F.transform(F.sequence(F.lit(0), b["blocks"] - 1), lambda i: name(b["ball"], i))))
    rows = rows.withColumn("mine", F.when(F.col("small"), F.lit("all")).otherwise(mine))
    rows = rows.withColumn("other", F.explode(F.when(F.col("small"), F.array(F.lit("all"))).otherwise(others)))
    return rows.select("leaf", F.least("mine", "other").alias("tile_a"), F.greatest("mine", "other").alias("tile_b"), "mine", "id", "ball", "v", "copies", "leaves")


def first_shared(leaf: int, leaves: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether ``leaf`` is the least leaf that rows ``a`` and ``b`` share; rows of equal leaves are looked at once."""
    below = [x[x < leaf] for x in leaves]
    _, kept, code = np.unique([hash(x.tobytes()) for x in below], return_index=True, return_inverse=True)
    pairs, at = np.unique(code[a] * np.int64(len(kept)) + code[b], return_inverse=True)
    p, q = pairs // len(kept), pairs % len(kept)
    column, spot = np.unique(np.concatenate([below[k] for k in kept]), return_inverse=True)
    owner = np.repeat(np.arange(len(kept)), [len(below[k]) for k in kept])
    shared = np.zeros(len(pairs), bool)
    for lo in range(0, len(column), 4096):
        mine = (spot >= lo) & (spot < lo + 4096)
        has = np.zeros((len(kept), min(4096, len(column) - lo)), bool)
        has[owner[mine], spot[mine] - lo] = True
        bits = np.packbits(has, axis=1)
        for i in range(0, len(pairs), 32768):
            shared[i : i + 32768] |= (bits[p[i : i + 32768]] & bits[q[i : i + 32768]]).any(1)
    return ~shared[at]


def _compare(threshold: float):
    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        n, leaf = len(pdf), int(pdf.leaf.iloc[0])
        x = np.array(list(pdf.v), np.float64)
        norm = np.sqrt((x * x).sum(1))
        ball, copies, side = pdf.ball.to_numpy(), pdf.copies.to_numpy(), pdf.mine.to_numpy()
        cross = len(set(side)) > 1
        links, label = np.zeros(n, np.int64), np.arange(n)
        found_i, found_j = [], []
        for i in range(0, n, 256):
            s = (x[i : i + 256] @ x.T) / (norm[i : i + 256, None] * norm[None, :])
            ok = s >= threshold
            ok &= (ball[i : i + 256, None] != ball[None, :]) | (ball[None, :] < 0)
            if cross:
                ok &= side[i : i + 256, None] != side[None, :]
            a, b = np.nonzero(ok)
            keep = b > a + i
            found_i.append(a[keep] + i)
            found_j.append(b[keep])
        a, b = np.concatenate(found_i), np.concatenate(found_j)
        if len(a):
            mine = first_shared(leaf, [np.asarray(v, np.int64) for v in pdf.leaves], a, b)
            a, b = a[mine], b[mine]
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        while len(a):
            before = label.copy()
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            label = label[label]
            if (before == label).all():
                break
        hit = links > 0
        ids = pdf.id.to_numpy()
        out = pd.DataFrame({"id": ids[hit], "links": links[hit], "to": ids[label[hit]]})
        if n > TILE:
            del x, a, b, found_i, found_j, pdf
            give_back()
        return out

    return compare


def near_embeddings(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``df`` (vec_id, embedding) with the number of linked vectors and the component of each."""
    spark = df.sparkSession
    ws = Workspace(spark, "embeddings")
    kind = "float" if isinstance(df.schema["embedding"].dataType.elementType, FloatType) else "double"
    own = df.select(df["vec_id"].cast("long").alias("vec_id"), df["embedding"].cast(f"array<{kind}>").alias("v"))
    own = own.withColumn("v", F.transform("v", lambda c: F.when(c == 0, F.lit(0.0).cast(kind)).otherwise(c)))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    some = F.exists("v", lambda c: c != 0)
    valid = F.coalesce(F.col("vec_id").isNotNull() & (F.size("v") > 0) & fine & some, F.lit(False))
    own = ws.save(own.withColumn("valid", valid))
    vectors = ws.save(own.where("valid").groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")))
    dense = ws.save(find_balls(vectors, ws, threshold))
    classes = ws.save(vectors.join(dense, "id", "left").withColumn("ball", F.coalesce("ball", F.lit(-1).cast("long"))))
    ws.drop(vectors)
    balls = classes.where("ball >= 0").groupBy("ball").agg(F.sum("copies").alias("held"), F.min("id").alias("least"))
    leaves = ws.save(build_forest(classes.select("id", "v"), ws).select("leaf", "id").distinct())
    sets = ws.save(leaves.groupBy("id").agg(F.sort_array(F.collect_list("leaf")).alias("leaves")))
    rows = leaves.join(classes.join(sets, "id"), "id")
    compared = ws.save(
        tiles(rows, ws).groupBy("leaf", "tile_a", "tile_b").applyInPandas(_compare(threshold), "id long, links long, to long"))
    ws.drop(leaves, sets)
    marked = ws.save(classes.select("id", "copies", "ball").join(balls, "ball", "left"))
    edges = compared.select(F.col("id").alias("a"), F.col("to").alias("b")).unionByName(
        marked.where("least is not null").select(F.col("id").alias("a"), F.col("least").alias("b")))
    found = ws.save(components(edges, ws))
    links = compared.groupBy("id").agg(F.sum("links").alias("links"))
    facts = marked.join(links, "id", "left").join(found, "id", "left").select(
        "id", F.coalesce("component", "id").alias("component_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("held", "copies") - 1).alias("n_links"))
    facts = ws.save(classes.select("v", "id").join(facts, "id").select("v", "component_id", "n_links"))
    linked = own.where("valid").join(facts, "v").select("vec_id", "n_links", "component_id")
    alone = own.where("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
