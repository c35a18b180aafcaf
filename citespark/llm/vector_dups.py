"""Embedding near-duplicates by a forest of random-projection trees.

Every tree splits the vectors of a label again and again along random
directions; vectors in an overlap band around a threshold go to both sides
(spill). All pairs within a leaf are compared, with exact cosines, and links are
united. A pair is missed only if every tree separates it by more than its band.

Directions come from a seed and the place in the tree, thresholds from a bounded
sample of each node; the tree grows until no leaf holds more than ``leaf_rows``
vectors or a split no longer separates them. Leaves that stay large (vectors as
good as equal) are compared block by block, in as many tasks as they have pairs of
blocks. Tasks return counts and spanning links, never all pairs: a pair met in
several leaves counts in the first of them, which both rows know from their
list of leaves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citespark.llm.common import checkpoint, connected_components, forest, map_rows, usable_vector

MIN_COSINE = 0.93
TREES = 6
LEAF_ROWS = 256
#: Half the width of the overlap band, on unit vectors: pairs up to twice as far apart on an axis share a side.
SPILL = 0.03
#: A split whose sides hold more than this many times the rows costs more comparisons than it saves (two sides of 1 / sqrt 2 cost as much).
MAX_COPIES = 1.4
SPLITS_PER_ROUND = 8
SAMPLE_ROWS = 4096
BLOCK_ROWS = 1024
MAX_DEPTH = 48


def unit_rows(data: pd.Series | list, kind: str) -> np.ndarray:
    """Unit vectors in double precision from stored bytes; scaled first, so that no square overflows."""
    v = np.frombuffer(b"".join(data), kind).reshape(len(data), -1).astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def direction(tree: int, node: int, dim: int) -> np.ndarray:
    """A random unit direction that depends on the place in the forest only."""
    d = np.random.default_rng([tree, node]).standard_normal(dim)
    return d / np.linalg.norm(d)


def fit_node(v: np.ndarray, tree: int, node: int, total: float, leaf_rows: int, spill: float, levels: int) -> list[tuple[int, float]]:
    """(node, threshold) of the splits below ``node``, from a sample ``v`` of its ``total`` vectors. Children are 2n and 2n+1."""
    out, todo = [], [(node, np.arange(len(v)), levels)]
    scale = total / max(1, len(v))
    while todo:
        at, rows, left = todo.pop()
        if left == 0 or len(rows) * scale <= leaf_rows or len(rows) < 16 or at >= 1 << MAX_DEPTH:
            continue
        x = v[rows] @ direction(tree, at, v.shape[1])
        # a random quantile near the middle
        limit = float(np.quantile(x, 0.35 + 0.3 * np.random.default_rng([tree, at, 1]).random()))
        low, high = rows[x < limit + spill], rows[x >= limit - spill]
        if len(low) + len(high) > MAX_COPIES * len(rows):
            continue  # the band holds many vectors: the leaf stays whole and is compared in blocks
        out.append((at, limit))
        todo += [(2 * at, low, left - 1), (2 * at + 1, high, left - 1)]
    return out


def route(v: np.ndarray, tree: int, node: int, limits: dict[int, float], spill: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of vectors that stand at ``node``; rows in a band appear on both sides."""
    rows_out, nodes_out, todo = [], [], [(node, np.arange(len(v)))]
    while todo:
        at, rows = todo.pop()
        if not len(rows):
            continue
        limit = limits.get(at)
        if limit is None:
            rows_out.append(rows)
            nodes_out.append(np.full(len(rows), at, np.int64))
            continue
        x = v[rows] @ direction(tree, at, v.shape[1])
        todo += [(2 * at, rows[x < limit + spill]), (2 * at + 1, rows[x >= limit - spill])]
    return np.concatenate(rows_out), np.concatenate(nodes_out)


def grow(vectors: DataFrame, kind: str, trees: int, leaf_rows: int, spill: float) -> DataFrame:
    """(vec_key, label, tree, node): every vector with the leaves it reaches in each tree.

    One round splits each large node by up to ``SPLITS_PER_ROUND`` levels, fitted on at most
    ``SAMPLE_ROWS`` of its vectors; nodes within the bound, and nodes that a round
    could not split, are leaves.
    """
    placed = vectors.select("vec_key", "label", "vec", F.explode(F.array(*map(F.lit, range(trees)))).alias("tree"))
    placed = placed.withColumn("node", F.lit(1).cast("long"))
    done = None

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        tree, node, label = int(pdf["tree"].iloc[0]), int(pdf["node"].iloc[0]), int(pdf["label"].iloc[0])
        splits = fit_node(
            unit_rows(pdf["vec"], kind), tree, node, float(pdf["n"].iloc[0]), leaf_rows, spill, SPLITS_PER_ROUND
        )
        at, limits = [s[0] for s in splits], [s[1] for s in splits]
        return pd.DataFrame({"label": [label], "tree": [tree], "node": [node], "at": [at], "limits": [limits]})

    def send():
        def work(keys, labels, vecs, tree_ids, nodes, ats, limits) -> list:
            pdf = pd.DataFrame({"label": labels, "tree": tree_ids, "node": nodes})
            key_out, label_out, vec_out, tree_out, node_out = [], [], [], [], []
            for (label, tree, node), rows in pdf.groupby(["label", "tree", "node"], sort=False).indices.items():
                first = rows[0]
                v = unit_rows([vecs[i] for i in rows], kind)
                got, leaf = route(v, tree, node, dict(zip(ats[first] or [], limits[first] or [])), spill)
                for i, n in zip(rows[got].tolist(), leaf.tolist()):
                    key_out.append(keys[i])
                    label_out.append(label)
                    vec_out.append(vecs[i])
                    tree_out.append(tree)
                    node_out.append(n)
            return [key_out, label_out, vec_out, tree_out, node_out]

        return work

    key = ["label", "tree", "node"]
    while True:
        sizes = checkpoint(placed.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > leaf_rows))
        if sizes.isEmpty():
            leaves = placed.select("vec_key", *key)
            return leaves if done is None else done.unionByName(leaves)
        # a bounded sample by hash: rows come through with a chance that leaves about SAMPLE_ROWS of a node
        share = F.pmod(F.xxhash64("vec_key", "tree"), F.lit(1 << 20)) < F.lit(float(SAMPLE_ROWS) * (1 << 20)) / F.col("n")
        sample = placed.join(sizes, key).filter(share)
        plans = checkpoint(sample.groupBy(*key).applyInPandas(fit, "label long, tree int, node long, at array<long>, limits array<double>"))
        split = plans.filter(F.size("at") > 0)
        joined = placed.join(split, key, "left")
        fixed = joined.filter(F.col("at").isNull()).select("vec_key", *key)
        moved = map_rows(
            joined.filter(F.col("at").isNotNull()).select("vec_key", "label", "vec", "tree", "node", "at", "limits"),
            "vec_key long, label long, vec binary, tree int, node long", send, rows=2000,
        )
        fixed = checkpoint(fixed)
        done = fixed if done is None else done.unionByName(fixed)
        placed = checkpoint(moved)


def compare_block(pdf: pd.DataFrame, kind: str, min_cosine: float) -> pd.DataFrame:
    """Links within a block, or between its two halves (``side``): link counts by vector and a spanning forest."""
    tree, node = int(pdf["tree"].iloc[0]), int(pdf["node"].iloc[0])
    pdf = pdf.sort_values("vec_key", kind="stable", ignore_index=True)
    v, keys, copies = unit_rows(pdf["vec"], kind), pdf["vec_key"].to_numpy(), pdf["copies"].to_numpy()
    side = pdf["side"].to_numpy()
    both = pdf["i"].iloc[0] != pdf["j"].iloc[0]
    cosine = v @ v.T
    # products of a matrix and of two rows may differ in the last digits: those at the border are worked out anew
    a, b = np.nonzero(np.triu(cosine >= min_cosine - 1e-9, 1))
    if both:
        across = side[a] != side[b]
        a, b = a[across], b[across]
    keep = (v[a] * v[b]).sum(axis=1) >= min_cosine
    a, b = a[keep], b[keep]
    # a pair counts in the first leaf that holds both: the smallest common one of the first such tree
    here = (tree << MAX_DEPTH + 2) + node
    if len(a):
        numbers: dict[tuple, int] = {}
        number = np.zeros(len(v), np.int64)
        for i in np.union1d(a, b).tolist():
            number[i] = numbers.setdefault(tuple(sorted(pdf["leaves"].iat[i])), len(numbers))
        sets = [set(n) for n in numbers]
        pairs, back = np.unique(number[a] * len(sets) + number[b], return_inverse=True)
        mine = np.array([min(sets[p // len(sets)] & sets[p % len(sets)]) == here for p in pairs.tolist()], bool)
        a, b = a[mine[back]], b[mine[back]]
    if not len(a):
        return pd.DataFrame({"vec_key": [], "n": [], "root": []}).astype("int64")
    counts = np.bincount(a, copies[b], len(v)) + np.bincount(b, copies[a], len(v))
    nodes, roots = forest(keys[a], keys[b])
    found = pd.Series(roots, index=nodes)
    rows = np.flatnonzero(counts)
    return pd.DataFrame({"vec_key": keys[rows], "n": counts[rows].astype(np.int64), "root": found.loc[keys[rows]].to_numpy()})


def near_duplicates(
    table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    min_cosine: float = MIN_COSINE, trees: int = TREES, leaf_rows: int = LEAF_ROWS, spill: float = SPILL,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of ``table``.

    Vectors with the same label and the same components are one class, counted by
    an aggregate; classes are compared, members are not. Rows without a label or
    usable vector (NULL, zero, NULL or non-finite components), or with a vector
    of another length than most, link with rows of their own length only or with
    nothing. Rows with NULL ids count as links of others but name no component.
    """
    rows = table.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"),
        F.col(vector).alias("embedding"),
    )
    takes_part = F.col("label").isNotNull() & usable_vector(F.col("embedding"))
    usable = rows.filter(takes_part).withColumn("size", F.size("embedding"))

    # floats stay floats in storage, which halves what is shuffled; every computation is in double precision
    kind = "<f4" if table.select(vector).schema[0].dataType.elementType == T.FloatType() else "<f8"

    def pack():
        return lambda ids, labels, sizes, vectors: [
            ids, labels, sizes, [(np.asarray(x, kind) + np.zeros(1, kind)).tobytes() for x in vectors],
        ]

    # vectors of different length never meet: the length is part of the label
    packed = map_rows(usable.select("vec_id", "label", "size", "embedding"), "vec_id long, label long, size int, vec binary", pack, rows=2000)
    packed = checkpoint(packed)
    classes = packed.groupBy("label", "size", "vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    # the number of a class is fixed by writing it
    classes = classes.withColumn("group", F.xxhash64("label", "size")).withColumn("vec_key", F.monotonically_increasing_id())
    classes = checkpoint(classes)
    vectors = classes.select("vec_key", F.col("group").alias("label"), "vec")
    leaves = checkpoint(grow(vectors, kind, trees, leaf_rows, spill))
    coded = F.shiftleft(F.col("tree").cast("long"), MAX_DEPTH + 2) + F.col("node")
    own = leaves.groupBy("vec_key").agg(F.collect_set(coded).alias("leaves"))
    members = leaves.join(classes.select("vec_key", "vec", "copies").join(own, "vec_key"), "vec_key")
    sizes = checkpoint(leaves.groupBy("label", "tree", "node").agg(F.count("*").alias("n")).filter("n > 1"))
    blocks = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    placed = members.join(sizes, ["label", "tree", "node"]).withColumn("blocks", blocks)
    mine = F.pmod(F.xxhash64("vec_key", F.lit(7)), F.col("blocks")).cast("int")
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    dealt = placed.withColumn("mine", mine).withColumn("other", F.explode(others)).select(
        "label", "tree", "node", "vec_key", "vec", "copies", "leaves",
        F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
        (F.col("mine") > F.col("other")).alias("side"),
    )
    found = checkpoint(
        dealt.groupBy("label", "tree", "node", "i", "j")
        .applyInPandas(lambda pdf: compare_block(pdf, kind, min_cosine), "vec_key long, n long, root long")
    )
    counts = found.groupBy("vec_key").agg(F.sum("n").alias("n"))
    linked = connected_components(found.select(F.col("vec_key").alias("a"), F.col("root").alias("b")))
    named = classes.select("label", "size", "vec", "vec_key", "least", "copies").join(counts, "vec_key", "left")
    named = named.join(linked.withColumnRenamed("node", "vec_key"), "vec_key", "left")
    named = checkpoint(named.withColumn("class", F.coalesce("component", "vec_key")))
    least = checkpoint(named.groupBy("class").agg(F.min("least").alias("component_id")))
    named = checkpoint(
        named.join(least, "class").select("label", "size", "vec", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    result = packed.join(named, ["label", "size", "vec"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~takes_part).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = result.unionByName(alone)
    return both.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

