"""Near-duplicate vectors by sorted projection passes.

Each pass hashes every vector to ``PLANES`` bits, one for each of as many random planes, sorts the vectors by the concatenated
bits, and compares neighbours: the order is cut into chunks of ``CHUNK_ROWS`` ranks that overlap by ``OVERLAP``, and all pairs of
a chunk are compared. Verified pairs of all passes are united into components.

Planes are cut at medians, so that vectors crowding in one direction are parted too: the first bits at the medians of what the
bits before them left together (a small tree fitted on a bounded sample), the others at the medians of the sample in that part.

How many passes a vector needs is measured: in each pass it gets a probe, a made partner at the threshold that is as far from the
mean direction of its crowd as the vector itself, and it leaves once ``NEED`` of its probes sorted into its chunk. If a pair meets
in a pass as often as the probes do, it is missed with a chance of at most 2 * 2 ** -NEED, 0.012 %. Those left are hashed with
trees of their own in the next round of passes; there is no other way to compare vectors, however few there are. After
``MOST_PASSES`` a vector leaves anyhow: that are the inner vectors of groups far denser than the threshold asks, of which each
pass links neighbours all along.

Equal vectors are one entry however many rows hold them, known by a 128-bit hash; entries of many rows are joined to them by
broadcast. An exact count of the links inside each component follows, by pairs of bounded chunks: passes find every component, but
not every pair of a dense one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendframe.llm.common import merged, positions, release, runs_of, shuffle_partitions, ship, spread_join, stored, unused
from lendframe.llm.components import components, local_roots

CHUNK_ROWS, OVERLAP = 256, 64
SAMPLE = 64
PLANES = 48
CHUNK = 512
NEED = 14
ROUND = 12
MOST_PASSES = 120
SEED = 20_240


def usable(vector: Column) -> Column:
    """Neither NULL, empty nor zero, and every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(frame: pd.DataFrame) -> np.ndarray:
    vectors = np.array(frame["vector"].tolist(), dtype=np.float64)
    vectors /= np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _planes(dim: int, number: int) -> np.ndarray:
    return np.random.default_rng([SEED, number]).standard_normal((dim, PLANES))


def _median_cuts(shades: np.ndarray) -> np.ndarray:
    """The cuts of a tree of one level a column, in heap order: node k has the children 2k + 1 and 2k + 2."""
    depth = shades.shape[1]
    cuts = np.zeros((1 << depth) - 1)
    at = np.zeros(len(shades), dtype=np.int64)
    for level in range(depth):
        for k in range((1 << level) - 1, (2 << level) - 1):
            part = shades[at == k, level]
            cuts[k] = np.median(part) if len(part) else 0.0
        at = 2 * at + 1 + (shades[:, level] > cuts[at])
    return cuts


def _bits(shades: np.ndarray, tree: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The concatenated bits of each row as a number: the way down the tree, then the sides of the medians of its end."""
    cuts, medians = tree
    depth = (len(cuts) + 1).bit_length() - 1
    at = np.zeros(len(shades), dtype=np.int64)
    for level in range(depth):
        at = 2 * at + 1 + (shades[:, level] > cuts[at])
    leaf = at - len(cuts)
    key = leaf
    for level in range(depth, shades.shape[1]):
        key = 2 * key + (shades[:, level] > medians[leaf, level - depth])
    return key


def _cuts_of(key: int, shared: int, tree: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Where the first ``shared`` planes were cut on the way to ``key``."""
    cuts, medians = tree
    depth = (len(cuts) + 1).bit_length() - 1
    way, at = [], 0
    for level in range(depth):
        way.append(cuts[at])
        at = 2 * at + 1 + (key >> (PLANES - 1 - level) & 1)
    return np.concatenate([way, medians[at - len(cuts)]])[:shared]


def _keys(frames: Iterator[pd.DataFrame], trees: dict[int, dict[int, tuple]], numbers: list[int]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for dim, part in frame.groupby(frame["vector"].map(len)):
            unit, own = _unit(part), trees[int(dim)]
            keys = np.stack([_bits(unit @ _planes(int(dim), number), own[number]) for number in numbers], axis=1)
            yield pd.DataFrame({"node": part["node"].to_numpy(), "dim": int(dim), "keys": list(keys)})


def _crowd(unit: np.ndarray, planes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The mean of the crowd that a leaf was cut from: that of the leaf, but on every plane at the cut.

    A partner is drawn towards the middle of the crowd; the mean of the leaf itself lies off it on the side of all cuts.
    """
    mean = unit.mean(axis=0)
    return mean + planes @ (np.linalg.pinv(planes.T @ planes) @ (cuts - planes.T @ mean)) if len(cuts) else mean


def _probes(unit: np.ndarray, mean: np.ndarray, threshold: float, own: np.random.Generator) -> np.ndarray:
    """A partner of each row at the threshold, in a random direction across the mean direction of their crowd."""
    mean = mean / max(np.sqrt(mean @ mean), 1e-300)
    along = (unit @ mean)[:, None] * mean
    rest = unit - along
    size = np.maximum(np.sqrt((rest * rest).sum(axis=1, keepdims=True)), 1e-12)
    rest = rest / size
    aside = own.standard_normal(unit.shape)
    aside -= (aside @ mean)[:, None] * mean
    aside -= (aside * rest).sum(axis=1, keepdims=True) * rest
    aside /= np.maximum(np.sqrt((aside * aside).sum(axis=1, keepdims=True)), 1e-12)
    turn = 2 * np.arcsin(np.minimum(1.0, math.sqrt(max(0.0, (1 - threshold) / 2)) / size))
    return along + size * (np.cos(turn) * rest + np.sin(turn) * aside)


def _window_links(frames: Iterator[pd.DataFrame], trees: dict[int, dict[int, tuple]], threshold: float, chunk_rows: int) -> Iterator[pd.DataFrame]:
    """(a, b, hit): b is the row that a is linked to in its chunk, or -1; hit: the probe of a sorted into the chunk."""
    for group in runs_of(frames, ["number", "chunk"]):
        number, chunk = int(group["number"].iat[0]), int(group["chunk"].iat[0])
        rng = np.random.default_rng([SEED, number, chunk])
        n, last = int(group["n"].iat[0]), len(group) - 1
        dims = group["dim"].to_numpy()
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            part = group.iloc[at]
            unit, node, key, pos = _unit(part), part["node"].to_numpy(), part["key"].to_numpy(), part["pos"].to_numpy()
            own = pos // chunk_rows == chunk
            # an end is open where the order, or the vectors of this length, begin or stop inside the chunk
            open_low, open_high = at[0] > 0 or pos[0] == 0, at[-1] < last or pos[-1] == n - 1
            hit = own.copy()
            if not (open_low and open_high):
                low, high = int(key[0]), int(key[-1])
                shared = PLANES if low == high else PLANES - (low ^ high).bit_length()
                tree, planes = trees[int(dim)][number], _planes(int(dim), number)
                crowd = _crowd(unit, planes[:, :shared], _cuts_of(low, shared, tree))
                seen = _bits(_probes(unit, crowd, threshold, rng) @ planes, tree)
                hit &= (open_low | (seen > low)) & (open_high | (seen < high))
            linked = unit @ unit.T >= threshold
            np.fill_diagonal(linked, False)
            label = local_roots(linked)
            b = np.where((label >= 0) & (label != np.arange(len(node))), node[label], -1)
            said = hit | (b >= 0)
            yield pd.DataFrame({"a": node[said], "b": b[said], "hit": hit[said].astype(np.int32)})


def _count_links(frames: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    for group in runs_of(frames, ["root", "i", "j"]):
        unit, node, rows = _unit(group), group["node"].to_numpy(), group["rows"].to_numpy()
        if group["i"].iat[0] == group["j"].iat[0]:
            linked = unit @ unit.T >= threshold
            np.fill_diagonal(linked, False)
            yield pd.DataFrame({"node": node, "links": linked @ rows})
        else:
            one, two = np.flatnonzero(group["side"].to_numpy() == 0), np.flatnonzero(group["side"].to_numpy() == 1)
            linked = unit[one] @ unit[two].T >= threshold
            yield pd.DataFrame({"node": np.concatenate((node[one], node[two])), "links": np.concatenate((linked @ rows[two], rows[one] @ linked))})


def _trees(rows: DataFrame, sizes: dict[int, int], numbers: list[int], chunk_rows: int) -> dict[int, dict[int, tuple]]:
    """Per length of vectors and per pass, the cuts of the first planes and the medians of the others; from a bounded sample."""
    out = {}
    for dim, count in sizes.items():
        # 2,097,152 numbers a sample at most, and 16 rows at least where the tree ends
        depth = max(0, min(math.ceil(math.log2(max(1, count / chunk_rows))), int(math.log2(max(1, (1 << 21) / (16 * dim))))))
        wanted = min(SAMPLE << depth, max(16 << depth, (1 << 21) // dim))
        step = max(1, count // wanted)
        drawn = rows.where((F.size("vector") == dim) & (F.pmod(F.xxhash64("node", F.lit(SEED)), F.lit(step)) == 0)).select("vector").toPandas()
        unit = _unit(drawn) if len(drawn) else np.zeros((1, dim))
        out[dim] = {}
        for number in numbers:
            shades = unit @ _planes(dim, number)
            cuts = _median_cuts(shades[:, :depth])
            ends = _bits(shades[:, :depth], (cuts, np.zeros((1 << depth, 0))))
            medians = np.tile(np.median(shades[:, depth:], axis=0), (1 << depth, 1))
            for leaf in np.unique(ends):
                medians[leaf] = np.median(shades[ends == leaf, depth:], axis=0)
            out[dim][number] = (cuts, medians)
    return out


def window_edges(classes: DataFrame, threshold: float, chunk_rows: int = CHUNK_ROWS, overlap: int = OVERLAP, most: int = MOST_PASSES) -> tuple[DataFrame, list[DataFrame], int]:
    """classes: (node, vector). Edges (a, b) that connect what the windows of all passes link.

    The second value lists the stored tables that the edges are read from, the third is the number of passes.
    """
    rows, found, held, passes = classes.select("node", "vector"), [], [], 0
    parts = shuffle_partitions(classes.sparkSession)
    while True:
        # one count a length
        sizes = {int(n): int(c) for n, c in rows.groupBy(F.size("vector")).count().collect()}
        if found and (max(sizes.values(), default=0) == 0 or passes >= most):
            break
        # what one chunk holds is compared whole, whatever the planes
        turns = 1 if sum(sizes.values()) <= chunk_rows else ROUND
        numbers = list(range(passes, passes + turns))
        trees = _trees(rows, sizes, numbers, chunk_rows)
        keyed = rows.mapInPandas(lambda frames, t=trees, k=numbers: _keys(frames, t, k), "node long, dim int, keys array<long>")
        light = keyed.select("node", "dim", F.posexplode("keys").alias("i", "key")).select(
            (F.col("i") + passes).cast("string").alias("tree"), "dim", "key", "node", F.lit(0).alias("tie")
        )
        ranked = positions(light, ["dim", "key"])
        chunk = F.floor(F.col("pos") / chunk_rows)
        both = F.when((F.col("pos") % chunk_rows < overlap) & (chunk > 0), F.array(chunk, chunk - 1)).otherwise(F.array(chunk))
        dealt = ranked.select(F.col("tree").cast("int").alias("number"), "n", "pos", "dim", "key", "node", F.explode(both).alias("chunk"))
        links = stored(
            dealt.join(rows, "node").select("number", "chunk", "pos", "n", "dim", "key", "node", "vector")
            .repartition(parts, "number", "chunk").sortWithinPartitions("number", "chunk", "pos")
            .mapInPandas(lambda frames, t=trees: _window_links(frames, t, threshold, chunk_rows), "a long, b long, hit int"),
            "window-links",
        )
        found.append(links)
        passes += turns
        if turns == 1:
            break
        hits = reduce(DataFrame.unionByName, found).where("hit = 1").groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("hits"))
        left = classes.join(hits, "node", "left").where(F.coalesce("hits", F.lit(0)) < NEED).select("node", "vector")
        before, rows = held, stored(left, "vectors-left")
        release(*before)
        held = [rows]
    edges = reduce(DataFrame.unionByName, [links.where("b >= 0").select("a", "b") for links in found])
    return edges, [*held, *found], passes


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95,
    chunk_rows: int = CHUNK_ROWS, overlap: int = OVERLAP,
) -> DataFrame:
    """Link vectors of a cosine of at least ``threshold``, in double precision.

    Returns every column of ``vectors`` and ``n_links`` (other rows linked directly), ``component_id`` (the smallest
    id that links reach, the row's own included) and ``kept`` (the id is the component's); input columns of these
    names are replaced.

    Defined results: vectors that are NULL, empty or zero, or hold a NULL or a non-finite component, link with
    nothing and are kept. Vectors of different lengths never link. Equal vectors link with each other, those just at
    the threshold too; rows that repeat an id each get their row. A NULL id gets the component of its vector and is kept only if alone. An empty
    table gives an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    parts = shuffle_partitions(spark)
    given = F.col(f"`{vector_col}`")
    own, one, two, count, component, links = unused(vectors, "vector", "h1", "h2", "rows", "component", "links")
    # floats are moved as such and widened where they are compared
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.withColumn(own, F.when(usable(given), given.cast(kind)))
    rows = rows.withColumns({one: F.when(F.col(own).isNotNull(), F.xxhash64(own)), two: F.when(F.col(own).isNotNull(), F.xxhash64(F.lit(1), F.col(own)))})
    classes = stored(
        rows.where(F.col(own).isNotNull()).groupBy(one, two)
        .agg(F.min(F.col(f"`{id_col}`")).alias("least"), F.count(F.lit(1)).alias("rows"), F.first(own).alias("vector"))
        .select(F.monotonically_increasing_id().alias("node"), F.col(one).alias("h1"), F.col(two).alias("h2"), "vector", "least", "rows"),
        "vector-classes",
    )
    entries, total = classes.agg(F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    edges, passed, _ = window_edges(classes, threshold, chunk_rows, overlap)
    roots = stored(components(edges), "vector-roots")
    release(*passed)
    members = classes.select("node", "least", "rows").join(roots, "node")
    sizes = members.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    placed = stored(spread_join(members, sizes, ["root"], "n", entries), "vector-members")
    chunked = placed.join(classes.select("node", "vector"), "node").withColumn("chunks", F.ceil(F.col("n") / F.lit(CHUNK)).cast("int")).withColumn(
        "chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    )
    keys = ["root", "i", "j"]
    counted = (
        chunked.select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
        .select(
            "root", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"),
            (F.col("chunk") > F.col("other")).cast("int").alias("side"), "node", "rows", "vector",
        )
        .repartition(parts, *keys).sortWithinPartitions(*keys, "node")
        .mapInPandas(lambda frames: _count_links(frames, threshold), "node long, links long")
        .groupBy("node").agg(F.sum("links").alias("links"))
    )
    named = stored(
        classes.select("node", "h1", "h2", "least", "rows")
        .join(placed.select("node", "component_id"), "node", "left").join(counted, "node", "left")
        .select(
            F.col("h1").alias(one), F.col("h2").alias(two), F.col("rows").alias(count), F.coalesce("component_id", "least").alias(component),
            (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias(links),
        ),
        "vector-names",
    )
    release(classes, roots, placed)
    known = rows.where(F.col(own).isNotNull())
    joined = spread_join(known, named, [one, two], count, total).drop(count)
    unknown = rows.where(F.col(own).isNull()).withColumns({component: F.col(f"`{id_col}`"), links: F.lit(0).cast("long")})
    joined = joined.unionByName(unknown)
    id_, alone = F.col(f"`{id_col}`"), F.col(links) == 0
    return merged(
        joined,
        {"n_links": F.col(links).cast("long"), "component_id": F.col(component), "kept": F.coalesce(id_ == F.col(component), alone)},
    ).drop(own, one, two, component, links)
