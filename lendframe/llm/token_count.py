"""Token counts by heap-and-linked-list byte-pair merging, for word-level BPE files with an end-of-word mark.

A word starts as one symbol a byte, the last with the end mark. The adjacent pairs that can merge are in a heap by
rank; the lowest is popped again and again, its symbols are joined in a linked list, and the pairs with its new
neighbours are pushed. The count is the number of initial symbols less the merges; no identifiers are made.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lendframe.llm.common import merged, ship, unused

#: Words whose counts each of a worker's two generations keeps at most, and the longest kept.
KEPT_WORDS, KEPT_LENGTH = 300_000, 48
_MODELS: dict[str, WordCounter] = {}
#: Code points that newer Unicode tables call letters or numbers and the tokenizer library's do not (fixed values).
NEWER = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 "
    "10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF "
    "18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 "
    "1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 "
    "3D000-3FC3F "
)


def newer_class() -> str:
    """``NEWER`` as the inside of a character class."""
    return "".join("-".join(f"\\U{int(end, 16):08x}" for end in part.split("-")) for part in NEWER.split())


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class WordCounter:
    """A word-level BPE file read for counting: merges by symbol pair, the splitting pattern, special strings."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model, steps = spec["model"], [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or not model["end_of_word_suffix"]:
            raise ValueError("only lower-casing word BPE files with an end-of-word suffix are counted here")
        vocab, mark = model["vocab"], model["end_of_word_suffix"]
        self.inner = [vocab[s] for s in byte_symbols()]
        self.last = [vocab[s + mark] for s in byte_symbols()]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(model["merges"])}
        pattern, newer = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"], newer_class()
        self.find, self.newer = regex.compile(pattern).findall, regex.compile(f"[{newer}]").search
        older = pattern.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{newer}])")
        for kind in (r"[\p{L}]", r"[\p{N}]"):
            older = older.replace(kind, rf"(?:(?![{newer}]){kind})")
        self.find_older = regex.compile(older).findall
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.counts: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def symbols(self, word: str) -> int:
        data = word.encode()
        ids = [self.inner[b] for b in data]
        ids[-1] = self.last[data[-1]]
        size, merges = len(ids), self.merges
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = [(*merges[pair], at, *pair) for at, pair in enumerate(zip(ids, ids[1:])) if pair in merges]
        heapq.heapify(heap)
        while heap:
            _, joined, at, left, right = heapq.heappop(heap)
            to = after[at]
            if ids[at] != left or to >= len(ids) or ids[to] != right:
                continue  # one of the two has merged meanwhile
            ids[at], ids[to] = joined, -1
            size -= 1
            after[at] = beyond = after[to]
            if beyond < len(ids):
                before[beyond] = at
                if (found := merges.get((joined, ids[beyond]))) is not None:
                    heapq.heappush(heap, (*found, at, joined, ids[beyond]))
            if (ahead := before[at]) >= 0 and (found := merges.get((ids[ahead], joined))) is not None:
                heapq.heappush(heap, (*found, ahead, ids[ahead], joined))
        return size

    def plain(self, text: str) -> int:
        if not text.isascii():
            # lower-cased letter by letter, so without a final sigma, and by newer tables than Python's
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").replace("\ua7cb", "\u0264").replace("\ua7dc", "\u019b")
        total, known, text = 0, self.counts, text.lower()
        find = self.find if text.isascii() or not self.newer(text) else self.find_older
        for word in find(text):
            count = known.get(word)
            if count is None:
                count = self.older.get(word) or self.symbols(word)
                if len(word) <= KEPT_LENGTH:
                    if len(known) >= KEPT_WORDS:
                        self.older, self.counts = known, {}
                        known = self.counts
                    known[word] = count
            total += count
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.special is None:
            return self.plain(text)
        total, at = 0, 0
        for found in self.special.finditer(text):
            total += self.plain(text[at : found.start()]) + 1
            at = found.end()
        return total + self.plain(text[at:] if at else text)


def _model(raw: bytes) -> WordCounter:
    key = hashlib.sha256(raw).hexdigest()
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = WordCounter(raw)
    return _MODELS[key]


def counter(spark: SparkSession, path: str):
    """A function of a text column that gives its token count; the file is read here and sent to the workers."""
    ship(spark)
    with open(path, "rb") as file:
        raw = spark.sparkContext.broadcast(file.read())

    @F.pandas_udf(LongType())
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _model(raw.value)
        for texts in batches:
            yield pd.Series([model.count(t) for t in texts], dtype="int64")

    return counted


def token_counts(docs: DataFrame, path: str, text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Every column of ``docs`` and ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (n_tokens > limit).

    Tokens are those of the vocabulary file at ``path`` without added begin or end tokens; a special string inside
    a text counts one. Input columns of these names are replaced.

    Defined results: a NULL text counts as empty, 0 bytes and 0 tokens. Texts of any length are read whole. Rows are independent: ids play no part,
    repeated rows repeat their counts, and an empty table gives an empty result.
    """
    (tokens,) = unused(docs, "tokens")
    counted = docs.withColumn(tokens, counter(docs.sparkSession, path)(F.col(f"`{text_col}`")))
    return merged(
        counted,
        {
            "n_bytes": F.octet_length(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).cast("long"),
            "n_tokens": F.col(tokens),
            "over_limit": F.col(tokens) > limit,
        },
    ).drop(tokens)
