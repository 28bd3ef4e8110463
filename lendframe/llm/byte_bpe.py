"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

The leaf of a byte position holds the rank of the pair that starts there, every inner node the least rank below it
with the leftmost position on ties. The root names the next merge; a merge updates the leaves of the merged pair,
of its live left neighbour and of the byte that is no longer a start, each in logarithmic time, so that a piece of n
bytes takes O(n log n) whatever its length.

New pieces of up to ``WIDEST`` bytes are merged many at a time: the trees of equally wide pieces are the rows of one
matrix, and each step does one merge in every row that still has one. Longer pieces are merged one by one.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

from lendframe.llm.common import merged, ship, unused

#: Pieces that each of a worker's two generations keeps at most, and the longest kept.
KEPT_PIECES, KEPT_LENGTH = 150_000, 48
#: Bytes of the widest matrix rows, rows at a time, and characters of text looked at before their new pieces are merged.
WIDEST, ROWS, AHEAD = 64, 8_192, 1 << 20
#: Ids that a worker gathers before it sends them back.
HELD_IDS = 1 << 20
#: Leaf of a position without a pair: above rank << SHIFT | position of any.
SHIFT = 40
MASK = (1 << SHIFT) - 1
#: Bits of the right id in the key of a pair.
PAIR = 24
NONE = 1 << 62
_CODECS: dict[str, Codec] = {}


class Codec:
    """Ranks of a byte-level BPE file, with the pattern that parts a text into pieces."""

    def __init__(self, raw: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
        size = max(self.ranks.values()) + 1
        self.tokens: list[bytes | None] = [None] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.find = regex.compile(pattern).findall
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = sorted(
            (self.ranks[token[:cut]] << PAIR | self.ranks[token[cut:]], rank)
            for token, rank in self.ranks.items()
            for cut in range(1, len(token))
            if token[:cut] in self.ranks and token[cut:] in self.ranks
        )
        self.pair_keys, self.pair_ranks = np.array(pairs, dtype=np.int64).T.copy()
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        ranks, get = self.ranks, self.ranks.get
        if (whole := get(piece)) is not None:
            return [whole]
        n = len(piece)
        width = 1 << (n - 1).bit_length()
        tree = [NONE] * (2 * width)
        for i in range(n - 1):
            if (rank := get(piece[i : i + 2])) is not None:
                tree[width + i] = rank << SHIFT | i
        for node in range(width - 1, 0, -1):
            a, b = tree[2 * node], tree[2 * node + 1]
            tree[node] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        while (least := tree[1]) != NONE:
            at = least & MASK
            gone = after[at]
            after[at] = beyond = after[gone]
            own = None
            if beyond < n:
                before[beyond] = at
                own = get(piece[at : after[beyond]])
            changed = [(gone, NONE), (at, NONE if own is None else own << SHIFT | at)]
            if (ahead := before[at]) >= 0:
                left = get(piece[ahead:beyond])
                changed.append((ahead, NONE if left is None else left << SHIFT | ahead))
            for place, value in changed:
                node = width + place
                tree[node] = value
                while node > 1:
                    node >>= 1
                    a, b = tree[2 * node], tree[2 * node + 1]
                    if b < a:
                        a = b
                    if tree[node] == a:
                        break
                    tree[node] = a
        ids, at = [], 0
        while at < n:
            ids.append(ranks[piece[at : after[at]]])
            at = after[at]
        return ids

    def _leaf(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Leaf values of pairs of ids at byte positions."""
        key = left << PAIR | right
        place = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[place] == key, self.pair_ranks[place] << SHIFT | at, NONE)

    def merge_many(self, pieces: list[bytes], width: int) -> list[tuple[int, ...]]:
        """The ids of pieces of 2 to ``width`` bytes, none a token itself; ``width`` is a power of two."""
        m = len(pieces)
        size = np.array([len(p) for p in pieces])
        ids = self.bytes[np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(m, width)]
        tree = np.full((m, 2 * width), NONE, dtype=np.int64)
        leaf = self._leaf(ids[:, :-1], ids[:, 1:], np.arange(width - 1))
        tree[:, width:-1] = np.where(np.arange(1, width) < size[:, None], leaf, NONE)
        level = width
        while level > 1:
            half = level >> 1
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        after = np.tile(np.arange(1, width + 1), (m, 1))
        before = np.tile(np.arange(-1, width - 1), (m, 1))
        starts = np.arange(width) < size[:, None]
        live = np.arange(m)
        while len(live := live[tree[live, 1] != NONE]):
            root = tree[live, 1]
            at, joined = root & MASK, root >> SHIFT
            gone = after[live, at]
            beyond = after[live, gone]
            ids[live, at] = joined
            after[live, at] = beyond
            starts[live, gone] = False
            ahead = before[live, at]
            more, led = beyond < size[live], ahead >= 0
            before[live[more], beyond[more]] = at[more]
            own = self._leaf(joined, ids[live, np.minimum(beyond, width - 1)], at)
            left = self._leaf(ids[live, np.maximum(ahead, 0)], joined, ahead)
            tree[live, width + gone] = NONE
            tree[live, width + at] = np.where(more, own, NONE)
            tree[live[led], width + ahead[led]] = left[led]
            nodes = [width + gone, width + at, width + np.where(led, ahead, at)]
            for _ in range(width.bit_length() - 1):
                for k in range(3):
                    node = nodes[k] = nodes[k] >> 1
                    tree[live, node] = np.minimum(tree[live, 2 * node], tree[live, 2 * node + 1])
        flat, ends = ids[starts].tolist(), np.cumsum(starts.sum(axis=1)).tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends)]

    def _learn(self, pieces: set[str]) -> None:
        """Put the ids of new pieces into the current generation."""
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            ids = self.older.get(piece)
            if ids is None:
                data = piece.encode("utf-8", "surrogatepass")
                whole = self.ranks.get(data)
                if whole is not None:
                    ids = (whole,)
                elif len(data) > WIDEST:
                    ids = tuple(self.merge(data))
                else:
                    by_width.setdefault(max(4, 1 << (len(data) - 1).bit_length()), []).append((piece, data))
                    continue
            self.pieces[piece] = ids
        for width, group in sorted(by_width.items()):
            for start in range(0, len(group), ROWS):
                part = group[start : start + ROWS]
                self.pieces.update(zip([p for p, _ in part], self.merge_many([d for _, d in part], width)))

    def encode_all(self, texts: list[str | None]) -> Iterator[list[int]]:
        """The ids of each text. New pieces of a stretch of texts are learned together; a very long text is its own."""
        start = 0
        while start < len(texts):
            stop, chars = start, 0
            while stop < len(texts) and (stop == start or chars + len(texts[stop] or "") <= AHEAD):
                chars += len(texts[stop] or "")
                stop += 1
            found = [self.find(t or "") for t in texts[start:stop]]
            if len(self.pieces) >= KEPT_PIECES:
                self.older, self.pieces = self.pieces, {}
            known = self.pieces
            self._learn({piece for pieces in found for piece in pieces if piece not in known})
            for pieces in found:
                out: list[int] = []
                for ids in map(known.__getitem__, pieces):
                    out += ids
                yield out
            for piece in [p for p in known if len(p) > KEPT_LENGTH]:
                del known[piece]
            start = stop

    def encode(self, text: str | None) -> list[int]:
        return next(self.encode_all([text]))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _codec(raw: bytes, pattern: str) -> Codec:
    key = hashlib.sha256(raw + pattern.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(raw, pattern)
    return _CODECS[key]


class ByteBpe:
    """Column functions for one rank file and pattern; the file is read here and sent to the workers.

    ``encode`` gives the ids of a text, ``decode`` the bytes of ids, and ``both`` a struct of ids and the bytes that
    the ids decode to, in one pass through a worker.
    """

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        ship(spark)
        with open(path, "rb") as file:
            raw = spark.sparkContext.broadcast(file.read())
        pair = StructType([StructField("token_ids", ArrayType(IntegerType())), StructField("decoded", BinaryType())])

        @F.pandas_udf(ArrayType(IntegerType()))
        def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            codec = _codec(raw.value, pattern)
            for texts in batches:
                yield pd.Series([np.array(ids, dtype=np.int32) for ids in codec.encode_all(texts.tolist())], dtype=object)

        @F.pandas_udf(BinaryType())
        def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            codec = _codec(raw.value, pattern)
            for lists in batches:
                yield pd.Series([None if ids is None else codec.decode(ids.tolist()) for ids in lists], dtype=object)

        @F.pandas_udf(pair)
        def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            codec = _codec(raw.value, pattern)
            for texts in batches:
                ids, data, held = [], [], 0
                for one in codec.encode_all(texts.tolist()):
                    data.append(codec.decode(one))
                    ids.append(np.array(one, dtype=np.int32))
                    held += len(one)
                    if held > HELD_IDS:  # what goes back needn't wait for the rest of the batch
                        yield pd.DataFrame({"token_ids": pd.Series(ids, dtype=object), "decoded": pd.Series(data, dtype=object)})
                        ids, data, held = [], [], 0
                if ids:
                    yield pd.DataFrame({"token_ids": pd.Series(ids, dtype=object), "decoded": pd.Series(data, dtype=object)})

        self.encode, self.decode, self.both = encode, decode, both


def encode_and_decode(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """Every column of ``docs`` and ``token_ids`` (array of ids) and ``decoded`` (the bytes that these ids give).

    Each match of ``pattern`` is encoded by itself; special tokens play no part. Input columns of these names are
    replaced.

    Defined results: a NULL or empty text has no ids and decodes to no bytes. Rows are independent: ids of
    documents play no part, repeated rows repeat their result, and an empty table gives an empty result.
    """
    bpe = ByteBpe(docs.sparkSession, path, pattern)
    (both,) = unused(docs, "both")
    coded = docs.withColumn(both, bpe.both(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    return merged(coded, {"token_ids": F.col(both)["token_ids"], "decoded": F.col(both)["decoded"]}).drop(both)


def digests() -> list[Column]:
    """n_tokens, ids_sha256 (decimal ids joined by a space) and decoded_sha256 of an encoded and decoded table."""
    joined = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return [
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    ]
