"""Merkle manifest of a dataset by nested-interval labels.

Every tree numbers its leaves in order; a node is labelled with the interval of
leaf numbers that it covers, so an ancestor's interval contains those of all
nodes below it. Leaves are numbered by a range sort and prefix counts over
partitions. Nodes of one level are found bottom-up, ``FAN`` intervals joined into
one. Ancestors are attached top-down by containment joins, bucketed by level:
nodes of a level meet their parent in the bucket of their interval, and the
siblings are the parent's children in the difference of both intervals. A bucket
never holds more than ``FAN`` nodes, so no key is hot, however large a tree is.

Digests are SHA-256 over the digests of the parts as hex text. The trees' roots
are the leaves of one more tree, whose root stands for the whole table.

Defined cases: a NULL value is written as ``-``; a NULL group is a tree of its
own, before the others; rows with a NULL or repeated id are leaves of their own,
NULL first, rows of one id by their digests; equal rows are interchangeable. An
empty table has no rows and no root.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citespark.llm.common import checkpoint, id_crc

FAN = 8
#: A lookup table of at most so many rows, which are counted, is sent to the tasks; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def hashed(parts: Column) -> Column:
    """The digest (32 bytes) over concatenated digests, which are read as hex text."""
    return F.unhex(F.sha2(F.lower(F.hex(parts)), 256))


def field(value: Column) -> Column:
    """A value as it stands in a leaf: its length in bytes, a colon and the value, or ``-`` for NULL."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: Sequence[Column]) -> Column:
    """The digest of a row from the values of its fields."""
    return F.unhex(F.sha2(F.concat(*(field(v) for v in values)), 256))


def glued(parts: Column) -> Column:
    """The digests of an array of nodes, one after the other."""
    return F.aggregate(parts, F.lit(b""), lambda done, node: F.concat(done, node["digest"]))


def looked_up(table: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join; ``few`` is sent to the tasks if its counted rows allow it."""
    return table.join(F.broadcast(few) if few.count() <= BROADCAST_ROWS else few, keys)


def numbered(rows: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``rank``, the number of a row within its tree from 0, and ``n``, the number of rows of the tree.

    Rows are sorted by range and written; only counts per partition and tree are
    summed up, so no tree is ever in one task. Rows equal in ``order`` are spread
    by their first position, so a large group of them is no hot range.
    """
    spread = checkpoint(rows.withColumn("_spread", F.monotonically_increasing_id()))
    keys = [tree, *order, "_spread"]
    ordered = spread.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_spread")
    placed = checkpoint(ordered.withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    pieces = placed.groupBy("_part", tree).agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(tree)
    before = F.sum("_rows").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    shift = (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift")
    shifts = checkpoint(pieces.select("_part", tree, shift, F.sum("_rows").over(whole).alias("n")))
    found = looked_up(placed, shifts, ["_part", tree])
    return found.withColumn("rank", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def nodes_at(level: int) -> Column:
    """How many nodes a tree of ``n`` leaves has at a level; leaves are level 0."""
    return F.ceil(F.col("n") / F.lit(FAN**level)).cast("long")


def joined(nodes: DataFrame, children: Column) -> DataFrame:
    """(tree, n, rank, lo, hi, digest, children): every ``FAN`` nodes of a tree that follow each other as one."""
    runs = nodes.groupBy("tree", "n", F.floor(F.col("rank") / FAN).alias("rank")).agg(F.array_sort(F.collect_list(children)).alias("children"))
    first, last = F.col("children")[0], F.element_at("children", -1)
    # a lone leaf stands for itself
    digest = F.when(F.col("n") == 1, first["digest"]).otherwise(hashed(glued(F.col("children"))))
    return runs.select("tree", "n", "rank", first["lo"].alias("lo"), last["hi"].alias("hi"), digest.alias("digest"), "children")


def grown(leaves: DataFrame) -> list[DataFrame]:
    """The levels above ``leaves`` (tree, n, rank, digest, item), each written; children of the first carry the items."""
    rank = F.col("rank")
    levels = [checkpoint(joined(leaves, F.struct(rank.alias("lo"), rank.alias("hi"), "digest", "item")))]
    most = levels[0].agg(F.max("n")).first()[0] or 0
    while FAN ** len(levels) < most:
        below = levels[-1].filter(nodes_at(len(levels)) > 1)
        levels.append(checkpoint(joined(below, F.struct("lo", "hi", "digest"))))
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """(tree, digest): the root of each tree."""
    found = [nodes.filter(nodes_at(k + 1) == 1).select("tree", "digest") for k, nodes in enumerate(levels)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def step(children: Column, lo: Column, hi: Column) -> Column:
    """What stands before and after an interval among its parent's children."""
    before = F.filter(children, lambda c: c["hi"] < lo)
    after = F.filter(children, lambda c: c["lo"] > hi)
    return F.struct(glued(before).alias("before"), glued(after).alias("after"))


def attached(levels: list[DataFrame], crown: DataFrame) -> DataFrame:
    """(item, digest, steps, subroot, root) of every leaf: its siblings on each level up to the root.

    ``crown`` (tree, steps, subroot, root) says how each tree goes on above its own root.
    """
    above = None
    for k in reversed(range(len(levels))):
        nodes = levels[k]
        here = nodes.filter(nodes_at(k + 1) == 1).join(crown, "tree")
        if above is not None:
            parents = above.select(
                "tree", F.col("rank").alias("bucket"), F.col("lo").alias("from"), F.col("hi").alias("to"),
                F.col("children").alias("family"), "steps", "subroot", "root",
            )
            below = nodes.filter(nodes_at(k + 1) > 1).withColumn("bucket", F.floor(F.col("lo") / FAN ** (k + 2)))
            held = below.join(parents, ["tree", "bucket"]).filter("from <= lo AND hi <= to")
            own = F.array(step(F.col("family"), F.col("lo"), F.col("hi")))
            here = here.unionByName(held.withColumn("steps", F.concat(own, "steps")).select(*here.columns))
        above = here
    leaf = above.select("n", "children", "steps", "subroot", "root", F.explode("children").alias("leaf"))
    own = F.array(step(F.col("children"), F.col("leaf.lo"), F.col("leaf.hi")))
    steps = F.when(F.col("n") == 1, F.col("steps")).otherwise(F.concat(own, "steps"))
    return leaf.select("leaf.item", "leaf.digest", steps.alias("steps"), "subroot", "root")


def no_steps() -> Column:
    return F.array().cast("array<struct<before: binary, after: binary>>")


def manifest(
    docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", doc_id: str = "doc_id", changed: dict[str, Column] | None = None,
) -> DataFrame:
    """(doc_id, leaf, steps, subroot, root, altered): one row per row of ``docs``; digests are binary.

    ``steps`` are the digests before and after the row's own path on each level,
    from its leaf to the root. ``changed`` gives fields other values; ``altered``
    is then the digest of the row with them, where it differs from ``leaf``.
    """
    changed = changed or {}
    leaf = leaf_digest([F.col(f) for f in fields])
    altered = leaf_digest([changed.get(f, F.col(f)) for f in fields]) if changed else F.lit(None).cast("binary")
    # '' sorts first, and no group has it
    tree = F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("."), F.col(group).cast("string")))
    rows = docs.select(tree.alias("tree"), F.col(doc_id).alias("doc_id"), leaf.alias("digest"), altered.alias("altered"))
    rows = rows.withColumn("altered", F.when(F.col("altered") != F.col("digest"), F.col("altered")))
    leaves = numbered(rows, "tree", ["doc_id", "digest"])
    levels = grown(leaves.select("tree", "n", "rank", "digest", F.struct("doc_id", "altered").alias("item")))
    subroots = tops(levels).select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    upper = grown(numbered(subroots, "tree", ["name"]).select("tree", "n", "rank", "digest", F.col("name").alias("item")))
    root = tops(upper).select("tree", no_steps().alias("steps"), F.lit(None).cast("binary").alias("subroot"), F.col("digest").alias("root"))
    trees = attached(upper, checkpoint(root))
    crown = checkpoint(trees.select(F.col("item").alias("tree"), "steps", F.col("digest").alias("subroot"), "root"))
    found = attached(levels, crown)
    return found.select("item.doc_id", F.col("digest").alias("leaf"), "steps", "subroot", "root", "item.altered")


def proof(steps: Column) -> Column:
    """The digest over all siblings, level by level, left to right, as hex."""
    glue = F.aggregate(steps, F.lit(b""), lambda done, s: F.concat(done, s["before"], s["after"]))
    return F.sha2(F.lower(F.hex(glue)), 256)


def folded(leaf: Column, steps: Column) -> Column:
    """The root (binary) that follows from a leaf and the siblings on its way up."""
    return F.aggregate(steps, leaf, lambda done, s: hashed(F.concat(s["before"], done, s["after"])))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def verified_manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """The manifest as hex text, with every row folded up again and held against the root.

    Where ``tampered`` is true the row that is folded has its text lower-cased
    (A-Z); a row whose id is NULL is not tampered with by the default rule.
    """
    if tampered is None:
        tampered = F.col("doc_id").isNotNull() & (id_crc(F.col("doc_id")) % 3 == 0)
    changed = {"text": F.when(tampered, lower_ascii(F.col("text"))).otherwise(F.col("text"))}
    found = manifest(docs, changed=changed)
    found = found.withColumn("folded", folded(F.coalesce("altered", "leaf"), F.col("steps")))
    digest = lambda name: F.lower(F.hex(name)).alias(name)
    return found.select(
        "doc_id", digest("leaf"), digest("subroot"), digest("root"), proof(F.col("steps")).alias("proof_sha256"),
        F.lower(F.hex("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )
