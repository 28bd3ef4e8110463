"""SimHash near-dedup over a byte-position inverted index with count filtering.

Two 64-bit fingerprints that differ in at most 3 bits agree in at least 5 of their 8 byte positions. The index has
a posting list for the bytes at each of 14 sets of four positions, chosen so that any five positions hold one of the
sets: every pair meets in a list, of 32 bits each. Inside a list the other positional bytes are tallied for each pair,
pairs with fewer than 5 shared bytes are left out, and the rest are verified by their differing bits. A list of
more than ``BLOCK`` entries is parted by one more position first, so that only pairs which reach the count meet.

Equal fingerprints are one entry of the index, however many documents have them. A part that is still longer is cut
into chunks and every pair of chunks becomes a task of its own, so no task holds more than two chunks. A task emits a
spanning star of each group that it finds, not the pairs, and the groups are joined by distributed connected
components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lendframe.llm.common import merged, release, runs_of, shuffle_partitions, ship, spread_join, stored, unused
from lendframe.llm.components import components, local_roots

SEED = 42
BLOCK = 2048
MAX_BITS = 3
#: Two bits of each half of the positions: the three ways to part four positions into two pairs.
_PAIRINGS = (((0, 1), (2, 3)), ((0, 2), (1, 3)), ((0, 3), (1, 2)))
#: The sets of four byte positions that key the posting lists: each half, and a pair of one half with a pair of the
#: other from the same pairing. Five positions hold four of one half, or three of one and two of the other; three
#: positions of a half hold one pair of each pairing.
SETS = [
    (0, 1, 2, 3), (4, 5, 6, 7),
    *[(*one, *(p + 4 for p in two)) for pairing in _PAIRINGS for one in pairing for two in pairing],
]
_ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CHUNK = 1 << 20


def _word_chunks(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text in bounded pieces; bytes.split() parts at exactly the six white-space bytes."""
    at = 0
    while at < len(data):
        stop = at + _CHUNK
        while stop < len(data) and data[stop] not in b" \t\n\x0b\f\r":
            stop += 1
        yield data[at:stop].split()
        at = stop


def fingerprint(text: str | None, width: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included."""
    carried: list[bytes] = []
    ones, total = np.zeros(64, dtype=np.int64), 0
    digest = xxhash.xxh64_intdigest

    def tally(hashes: list[int]) -> None:
        nonlocal ones, total
        raw = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        for start in range(0, len(raw), 1 << 14):
            ones += np.unpackbits(raw[start : start + (1 << 14)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(hashes)

    for part in _word_chunks((text or "").encode("utf-8", "surrogatepass").translate(_ASCII_LOWER)):
        words = carried + part
        if len(words) >= width:
            joined = b" ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words])
            starts = np.concatenate(([0], ends[:-1]))[: len(words) - width + 1].tolist()
            tally([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())])
            words = words[len(words) - width + 1 :]
        carried = words
    if not total:
        if not carried:
            return 0
        tally([digest(b" ".join(carried), SEED)])
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


@F.pandas_udf(LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _links(left: np.ndarray, right: np.ndarray, max_bits: int) -> np.ndarray:
    """Boolean matrix of the pairs that share enough positional bytes and differ in few enough bits."""
    shared = np.zeros((len(left), len(right)), dtype=np.uint8)
    a, b = left.view(np.uint8).reshape(-1, 8), right.view(np.uint8).reshape(-1, 8)
    for position in range(8):
        shared += a[:, position, None] == b[None, :, position]
    linked = shared >= 8 - max_bits
    rows, cols = np.nonzero(linked)
    linked[rows, cols] = np.bitwise_count(left[rows] ^ right[cols]) <= max_bits
    return linked


def _stars(groups: Iterator[pd.DataFrame], max_bits: int) -> Iterator[pd.DataFrame]:
    nodes, roots, held = [], [], 0
    for group in runs_of(groups, KEYS):
        fps = group["fp"].to_numpy().view(np.uint64)
        if len(fps) == 2:
            found = np.array([-1, 0]) if _links(fps[:1], fps[1:], max_bits)[0, 0] else None
            if found is not None:
                nodes.append(fps[1:])
                roots.append(fps[:1])
                held += 1
            continue
        side = group["side"].to_numpy()
        if (group["i"].iat[0] == group["j"].iat[0]):
            linked = _links(fps, fps, max_bits)
            np.fill_diagonal(linked, False)
        else:
            linked = np.zeros((len(fps), len(fps)), dtype=bool)
            one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            across = _links(fps[one], fps[two], max_bits)
            linked[np.ix_(one, two)] = across
            linked[np.ix_(two, one)] = across.T
        label = local_roots(linked)
        child = np.flatnonzero((label >= 0) & (label != np.arange(len(fps))))
        nodes.append(fps[child])
        roots.append(fps[label[child]])
        held += len(child)
        if held > 100_000:
            yield pd.DataFrame({"a": np.concatenate(nodes).view(np.int64), "b": np.concatenate(roots).view(np.int64)})
            nodes, roots, held = [], [], 0
    if held:
        yield pd.DataFrame({"a": np.concatenate(nodes).view(np.int64), "b": np.concatenate(roots).view(np.int64)})


#: What tells one group of compared entries from another: the set, its bytes, the parting position, its byte, the chunks.
KEYS = ["positions", "held", "more", "byte", "i", "j"]


def _sized(entries: DataFrame, keys: list[str], block: int) -> tuple[DataFrame, DataFrame]:
    """Entries of lists of 2 to ``block`` and of longer ones; the latter, of which there are few, with their length n."""
    lists = entries.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # most entries are alone in their lists: what is left is small and is read twice
    sized = stored(entries.join(lists, keys), "postings")
    return sized.where(F.col("n") <= block).drop("n"), sized.where(F.col("n") > block)


def links(fps: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """fps: distinct (fp). Edges (a, b) whose components are those of all pairs within ``max_bits`` bits."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the posting lists guarantee pairs of at most 3 differing bits")
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    masks = [signed(sum(0xFF << (8 * p) for p in four)) for four in SETS]
    lists = ["positions", "held"]
    postings = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("positions", "held"))
    short, long = _sized(postings, lists, block)
    others = F.array(*[F.array(*[F.lit(p) for p in range(8) if p not in four]) for four in SETS])
    parted = (
        long.drop("n").withColumn("more", F.explode(F.element_at(others, F.col("positions") + 1)))
        .withColumn("byte", F.expr("cast(shiftrightunsigned(fp, 8 * more) & 255 as int)"))
    )
    few, many = _sized(parted, [*lists, "more", "byte"], block)
    chunks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    cut = (
        many.withColumn("chunk", F.pmod(F.xxhash64("fp"), chunks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
        .select(
            *lists, "more", "byte", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"),
            (F.col("chunk") > F.col("other")).cast("int").alias("side"), "fp",
        )
    )
    whole = [F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "fp"]
    dealt = (
        short.select(*lists, F.lit(-1).alias("more"), F.lit(0).alias("byte"), *whole)
        .unionByName(few.select(*lists, "more", "byte", *whole)).unionByName(cut)
    )
    return (
        dealt.repartition(shuffle_partitions(fps.sparkSession), *KEYS).sortWithinPartitions(*KEYS, "fp")
        .mapInPandas(lambda batches: _stars(batches, max_bits), "a long, b long")
    )


def memberships(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row (doc_id, text_hash, fp, root, component_id) for each row of ``docs``; see ``near_duplicates``."""
    ship(docs.sparkSession)
    printed = stored(
        docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash"), fingerprints(F.col(f"`{text_col}`")).alias("fp")),
        "fingerprints",
    )
    classes = stored(printed.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "fingerprint-classes")
    size, entries = classes.agg(F.sum("n"), F.count(F.lit(1))).first()
    roots = components(links(classes.select("fp"), max_bits))
    placed = classes.join(roots, classes.fp == roots.node, "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root"))
    groups = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("entries"))
    named = stored(spread_join(placed, groups, ["root"], "entries", entries).select("fp", "n", "root", "component_id"), "fingerprint-names")
    release(classes)
    return spread_join(printed, named, ["fp"], "n", size or 0).select("doc_id", "text_hash", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """Group the documents whose fingerprints link, directly or over others.

    Returns every column of ``docs`` and ``fingerprint`` (16 lowercase hex digits) and ``component_id`` (the
    smallest id that links reach); input columns of these names are replaced.

    Defined results: a text without words, empty or NULL has the fingerprint zero, which links like any other;
    fewer words than a shingle count as one shingle. Texts of any length are read whole, a megabyte at a time. Rows
    that repeat an id or text each get their row. A NULL id gets the component of its fingerprint, NULL if no row in
    it has an id. An empty table gives an empty result.
    """
    own_hash, own_id, hash_, fp, component = unused(docs, "text_hash", "id", "hash", "fp", "component")
    member = memberships(docs, id_col, text_col, max_bits).select(
        F.col("doc_id").alias(own_id), F.col("text_hash").alias(hash_), F.col("fp").alias(fp), F.col("component_id").alias(component)
    ).distinct()
    joined = docs.withColumn(own_hash, F.xxhash64(F.col(f"`{text_col}`"))).join(
        member, F.col(f"`{id_col}`").eqNullSafe(F.col(own_id)) & (F.col(own_hash) == F.col(hash_))
    )
    return merged(joined, {"fingerprint": hexadecimal(F.col(fp)), "component_id": F.col(component)}).drop(own_hash, own_id, hash_, fp, component)


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each group of near duplicates: that of the smallest id, then of the smallest text hash; ids before NULL.

    Rows of equal id and text are taken for the same document, whichever of them stays. See ``near_duplicates``.
    """
    own_hash, id_, hash_, n = unused(docs, "text_hash", "id", "hash", "n")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "n"))
    chosen = (
        memberships(docs, id_col, text_col, max_bits).groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("root").agg(least.alias("one"))
        .select(F.col("one.doc_id").alias(id_), F.col("one.text_hash").alias(hash_), F.col("one.n").alias(n))
    )
    chosen = stored(chosen, "fingerprint-chosen")
    rows = docs.withColumn(own_hash, F.xxhash64(F.col(f"`{text_col}`")))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(id_)) & (F.col(own_hash) == F.col(hash_))
    single = rows.join(chosen.where(F.col(n) == 1), same)
    repeated = rows.join(chosen.where(F.col(n) > 1), same).dropDuplicates([id_, own_hash])
    return single.unionByName(repeated).select(*[F.col(f"`{c}`") for c in docs.columns])
