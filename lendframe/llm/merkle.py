"""Merkle manifest of a table: a binary tree of row digests for each group, and one over the groups' roots.

Rows are ranked inside their group by a range partitioning, so no task holds a group. Blocks of up to ``2 ** MOST_BITS``
neighbouring ranks are reduced to their top node where they lie. While more nodes than ``BOUND`` are left, the tops are reduced
in blocks again; then the driver builds the small top tree and broadcasts, for each block, the path above it (its suffix).
Executors put a row's path inside its block before that suffix and fold each row to the root.

Nodes are lowercase hex SHA-256 digests, hashed as text. A level pairs neighbours; an odd last node is hashed alone.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lendframe.llm.common import positions, stored

#: Nodes that the driver takes, and with them the rows that are broadcast. Their paths are below 10 MB.
BOUND = 4096
LEAST_BITS, MOST_BITS = 6, 12

PATH = T.ArrayType(T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())]))


def digest(fields: list[Column]) -> Column:
    """H of a row: each field is ``-`` if null, else its UTF-8 byte count, ``:`` and its text."""
    parts = []
    for field in fields:
        text = field.cast("string")
        parts.append(F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that ``leaf`` and its siblings lead to."""
    return F.aggregate(proof, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]).cast("binary"), 256))


def siblings_sha256(proof: Column) -> Column:
    """H of all siblings of a proof, from the leaf up."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


def _halve(nodes: Column) -> Column:
    def pair(i: Column) -> Column:
        return F.sha2(F.concat(F.get(nodes, 2 * i), F.coalesce(F.get(nodes, 2 * i + 1), F.lit(""))).cast("binary"), 256)

    return F.transform(F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / 2).cast("int")), pair)


def _levels(leaves: Column, n: Column, bits: int) -> Column:
    """All levels of a block, its leaves first. n: nodes of the whole tree; one that ends inside the block has fewer levels."""
    own = F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)
    depth = F.least(own, F.lit(bits))
    ups = F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(ups, F.array(leaves), lambda levels, _: F.concat(levels, F.array(_halve(F.element_at(levels, -1)))))


def _path(levels: Column, place: Column) -> Column:
    """Siblings of the node at ``place`` from the leaves of a block to the level below its top."""

    def step(nodes: Column, level: Column) -> Column:
        at = F.floor(place / F.pow(F.lit(2), level)).cast("int")
        odd = at % 2 == 1
        beside = F.coalesce(F.get(nodes, F.when(odd, at - 1).otherwise(at + 1)), F.lit(""))
        return F.struct(F.when(odd, beside).otherwise("").alias("left"), F.when(odd, "").otherwise(beside).alias("right"))

    return F.transform(F.slice(levels, 1, F.size(levels) - 1), step)


def _blocks(nodes: DataFrame, bits: int, label: str) -> DataFrame:
    """Nodes (tree, n, pos, node, and others) gathered in blocks of up to ``2 ** bits``, with the top of each."""
    rest = [c for c in nodes.columns if c not in ("tree", "n", "pos", "node")]
    size = 1 << bits
    grouped = nodes.groupBy("tree", F.floor(F.col("pos") / size).cast("long").alias("block")).agg(
        F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("pos", F.unhex("node").alias("node"), *rest))).alias("members")
    )
    top = F.element_at(F.element_at(_levels(_hex_nodes(), F.col("n"), bits), -1), 1)
    return stored(grouped.withColumn("top", top), label)


def _hex_nodes() -> Column:
    return F.transform("members", lambda m: F.lower(F.hex(m["node"])))


def _tops(blocks: DataFrame, bits: int) -> DataFrame:
    size = 1 << bits
    return blocks.select("tree", F.ceil(F.col("n") / size).cast("long").alias("n"), F.col("block").alias("pos"), F.col("top").alias("node"))


def _members(blocks: DataFrame, above: DataFrame, bits: int, small: bool) -> DataFrame:
    """The blocks' members with their whole paths: inside the block, then the suffix of the block."""
    suffix = above.select(F.col("tree").alias("t_"), F.col("pos").alias("p_"), "path", "subroot", "root")
    joined = blocks.join(F.broadcast(suffix) if small else suffix, F.col("tree").eqNullSafe(F.col("t_")) & (F.col("block") == F.col("p_")))
    levels = joined.withColumn("levels", _levels(_hex_nodes(), F.col("n"), bits))
    rows = levels.select(
        "tree", "n", "path", "subroot", "root", F.posexplode(F.transform("members", lambda m, i: F.struct(m.alias("m"), _path(F.col("levels"), i).alias("inside"))))
    )
    fields = [f.name for f in blocks.schema["members"].dataType.elementType.fields if f.name != "node"]
    return rows.select(
        "tree", "n", *[F.col("col.m")[f].alias(f) for f in fields], F.lower(F.hex(F.col("col.m.node"))).alias("node"),
        F.concat("col.inside", "path").alias("path"), "subroot", "root",
    )


def _python_levels(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [hashlib.sha256("".join(nodes[i : i + 2]).encode()).hexdigest() for i in range(0, len(nodes), 2)]
        levels.append(nodes)
    return levels


def _python_path(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    out = []
    for nodes in levels[:-1]:
        beside = at ^ 1
        sibling = nodes[beside] if beside < len(nodes) else ""
        out.append((sibling, "") if at % 2 else ("", sibling))
        at //= 2
    return out


def _top_tree(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """The driver's part: trees of at most ``BOUND`` nodes altogether, and the tree over their roots."""
    trees: dict = {}
    for tree, pos, node in nodes.select("tree", "pos", "node").collect():
        trees.setdefault(tree, []).append((pos, node))
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    built = {t: _python_levels([node for _, node in sorted(trees[t])]) for t in order}
    over = _python_levels([built[t][-1][0] for t in order]) if order else [[""]]
    rows = []
    for k, tree in enumerate(order):
        up = _python_path(over, k)
        rows += [(tree, at, _python_path(built[tree], at) + up, built[tree][-1][0], over[-1][0]) for at in range(len(built[tree][0]))]
    schema = T.StructType([
        T.StructField("tree", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("path", PATH),
        T.StructField("subroot", T.StringType()), T.StructField("root", T.StringType()),
    ])
    return spark.createDataFrame(rows, schema)


def _above(nodes: DataFrame, count: int, bound: int, most_bits: int) -> DataFrame:
    """(tree, pos, path, subroot, root) for every node of a forest: all that lies above it."""
    spark = nodes.sparkSession
    if count <= bound:
        return _top_tree(spark, nodes)
    if (nodes.agg(F.max("n")).first()[0] or 1) > 1:
        blocks = _blocks(nodes, most_bits, "merkle-above")
        tops = _tops(blocks, most_bits)
        n_tops = blocks.count()
        up = _above(tops, n_tops, bound, most_bits)
        return _members(blocks, up, most_bits, n_tops <= bound).select("tree", "pos", "path", "subroot", "root")
    # more groups than the driver takes: their roots become the leaves of one tree
    roots = positions(nodes.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node", F.lit(0).alias("tie")), ["name"])
    path = _above_one(roots, count, bound, most_bits)
    return path.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.col("node").alias("subroot"), "root")


def _above_one(nodes: DataFrame, count: int, bound: int, most_bits: int) -> DataFrame:
    """As ``_above`` for a single tree; keeps the nodes' other columns."""
    blocks = _blocks(nodes, most_bits, "merkle-over")
    n_tops = blocks.count()
    up = _above(_tops(blocks, most_bits), n_tops, bound, most_bits)
    return _members(blocks, up, most_bits, n_tops <= bound)


def manifest(
    docs: DataFrame, fields: list[str], group: str, order: str, carry: dict[str, Column] | None = None, bound: int = BOUND, most_bits: int = MOST_BITS
) -> DataFrame:
    """A row for each row of ``docs``: order, group, carried columns, leaf, position, n_leaves, subroot, root and proof.

    The proof lists the siblings from the leaf via the group's root to the root, each as (left, right) with one of them or both
    empty; ``fold`` goes up along it. Leaves ascend by ``order`` (NULL first), ties by digest; equal rows are interchangeable.
    Groups ascend by their UTF-8 bytes, NULL first. NULL fields are ``-``, empty texts ``0:``; texts of any length are hashed
    whole. An empty table gives no rows; other columns of ``docs`` are ignored, whatever their names.
    """
    carry = carry or {}
    leaves = docs.select(
        F.col(f"`{group}`").cast("string").alias("tree"), F.col(f"`{order}`").alias("id"),
        digest([F.col(f"`{f}`") for f in fields]).alias("node"), F.monotonically_increasing_id().alias("tie"), *[c.alias(f"c_{k}") for k, c in carry.items()],
    )
    binary = leaves.withColumn("node", F.unhex("node"))
    kept = stored(binary, "merkle-leaves")
    ranked = positions(kept, ["id"])
    total = kept.count()
    bits = min(most_bits, max(LEAST_BITS, (total // bound).bit_length()))
    blocks = _blocks(ranked.withColumn("node", F.lower(F.hex("node"))), bits, "merkle-blocks")
    n_blocks = blocks.count()
    rows = _members(blocks, _above(_tops(blocks, bits), n_blocks, bound, most_bits), bits, n_blocks <= bound)
    return rows.select(
        F.col("id").alias(order), F.col("tree").alias(group), *[F.col(f"c_{k}").alias(k) for k in carry],
        F.col("node").alias("leaf"), F.col("pos").alias("position"), F.col("n").alias("n_leaves"), "subroot", "root", F.col("path").alias("proof"),
    )


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def audit(docs: DataFrame, bound: int = BOUND, most_bits: int = MOST_BITS) -> DataFrame:
    """The manifest of ``documents``, and each row folded again after the fixed tampering of one id in seven.

    Where 7 divides the CRC-32 of the decimal id, 1 is added to ``n_chars`` (a NULL stays, as do rows with a NULL id) before the
    row is folded with its original siblings; ``verified`` says whether that still leads to the root.
    """
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    changed = digest([F.col("n_chars") + 1 if f == "n_chars" else F.col(f) for f in FIELDS])
    rows = manifest(docs, FIELDS, "lang", "doc_id", {"claimed": F.when(tampered, F.unhex(changed))}, bound, most_bits)
    claimed = F.coalesce(F.lower(F.hex("claimed")), F.col("leaf"))
    folded = rows.withColumn("folded_root", fold(claimed, F.col("proof"))).drop("claimed")
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
