"""Spelling variants: each word of the vocabulary points to the far more frequent word one edit away.

The whole neighbourhood of a word (all distinct deletions, replacements and insertions over the observed alphabet) is emitted as
hash keys and joined to the vocabulary by key. An edit touches one segment of the word; what lies outside it, the frame, it shares
with the neighbour. So words are shuffled by their frames, a few rows each, and the candidates, hundreds a word, are emitted and
joined where vocabulary of the same frame lies instead of being shuffled. The two spellings of a joined key are compared for
equality, which settles any clash of keys; no distance is computed.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendframe.llm.common import ascii_lower, release, ship, shuffle_partitions, spread_join, stored

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: Letters in a segment, and the most segments of a word. Words of one frame differ in one segment only, so they are few.
SEGMENT, MOST_SEGMENTS = 4, 16
#: Rows of frames that a task is given; candidates that are looked up at once.
TASK_ROWS, AT_ONCE = 400_000, 1 << 20
_RATIO = 2


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): letter runs of whole texts, A-Z lower-cased, some with a planted slip, and how often they occur.

    Where 97 divides the CRC-32 of ``<doc_id>:<run>`` the run loses the code point at that CRC modulo its length. NULL and empty
    texts have no runs; a NULL id plants no slip.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(RUN), F.lit(0))).alias("run"))
    lowered = runs.where(F.length("run") >= least_length).select("doc_id", ascii_lower(F.col("run")).alias("run"))
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")).cast("binary"))
    hashed = lowered.select("run", h.alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    slipped = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % 97 == 0, slipped).otherwise(F.col("run"))
    counted = hashed.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least_count)


def _frames(words: DataFrame) -> DataFrame:
    """(key, word, n, segment): a word under the frames by which words of its length, one less and one more may reach it.

    ``segment`` is the one that the word itself edits under this key, or -1 where it is only there to be found.
    """
    length = F.length("word")
    classes = words.withColumn("of", F.explode(F.array(length - 1, length, length + 1)))
    segments = F.least(F.ceil(F.col("of") / SEGMENT), F.lit(MOST_SEGMENTS)).cast("int")
    each = classes.withColumn("segments", segments).withColumn("segment", F.explode(F.sequence(F.lit(0), F.col("segments") - 1)))
    start = F.floor(F.col("segment") * F.col("of") / F.col("segments")).cast("int")
    stop = F.floor((F.col("segment") + 1) * F.col("of") / F.col("segments")).cast("int")
    head, tail = F.substring("word", F.lit(1), start), F.right(F.col("word"), F.col("of") - stop)
    return each.select(
        F.xxhash64("of", "segment", head, tail).alias("key"), "word", "n", F.when(F.col("of") == length, F.col("segment")).otherwise(-1).alias("segment")
    )


def _mixed(values):
    """A fixed 64-bit mixing of code points (splitmix64's finaliser)."""
    import numpy as np

    x = values.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64


class _Pool:
    """The vocabulary of one task by key: the sum of mixed code points times powers of the base, modulo 2**64."""

    def __init__(self, words: list[str], counts) -> None:
        import numpy as np

        by_length: dict[int, list[int]] = {}
        for at, word in enumerate(words):
            by_length.setdefault(len(word), []).append(at)
        keys = np.zeros(len(words), dtype=np.uint64)
        for length, ats in by_length.items():
            step = max(1, AT_ONCE // length)
            for lo in range(0, len(ats), step):
                some = ats[lo : lo + step]
                codes = code_points([words[a] for a in some], length)
                keys[some] = (_mixed(codes) * powers(length)).sum(axis=1, dtype=np.uint64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.order, self.words, self.counts = keys[order], order, words, counts
        bits = min(24, max(10, len(words).bit_length() + 4))
        self.shift = np.uint64(64 - bits)
        self.filled = np.zeros(1 << bits, dtype=bool)
        self.filled[(self.keys >> self.shift).astype(np.int64)] = True

    def find(self, wanted):
        """Places in ``wanted`` (flat) and the first place in ``keys`` of those that are there."""
        import numpy as np

        maybe = np.flatnonzero(self.filled[(wanted >> self.shift).astype(np.int64)])
        at = np.searchsorted(self.keys, wanted[maybe])
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == wanted[maybe]
        return maybe[hit], at[hit]

    def same_key(self, at: int) -> Iterator[int]:
        """Words whose key is that at ``at``: one, but for a clash."""
        key = self.keys[at]
        while at < len(self.keys) and self.keys[at] == key:
            yield int(self.order[at])
            at += 1


def code_points(words: list[str], length: int):
    import numpy as np

    return np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), length)


def powers(count: int):
    import numpy as np

    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(0, count - 1), _BASE, dtype=np.uint64))])[:count]


def neighbours(words: list[str], length: int, start: int, stop: int, alphabet, pool: _Pool) -> Iterator[tuple[int, int]]:
    """(place in ``words``, word of the pool) for all edits of positions start to stop; each distinct candidate is emitted once."""
    import numpy as np

    codes = code_points(words, length)
    mixed, power = _mixed(codes), powers(length + 2)
    inverse = np.uint64(pow(_BASE, -1, 1 << 64))
    terms = mixed * power[:length]
    before = np.zeros((len(words), length + 1), dtype=np.uint64)
    np.cumsum(terms, axis=1, out=before[:, 1:])
    whole = before[:, -1]
    letters, n_letters = _mixed(alphabet), len(alphabet)

    def matched(wanted, keep, spell):
        flat = np.flatnonzero(keep.ravel())
        found, at = pool.find(wanted.ravel()[flat])
        for cell, place in zip(flat[found].tolist(), at.tolist()):
            row, column = divmod(cell, wanted.shape[1])
            made = spell(words[row], column)
            for other in pool.same_key(place):
                if pool.words[other] == made:
                    yield row, other

    signs = [chr(c) for c in alphabet.tolist()]
    last = stop == length
    for i in range(start, stop):
        deleted = before[:, i] + (whole - before[:, i + 1]) * inverse
        first = np.ones(len(words), dtype=bool) if i == 0 else codes[:, i] != codes[:, i - 1]
        yield from matched(deleted[:, None], first[:, None], lambda w, _, i=i: w[:i] + w[i + 1 :])
        replaced = (whole - terms[:, i])[:, None] + letters[None, :] * power[i]
        yield from matched(replaced, codes[:, i][:, None] != alphabet[None, :], lambda w, c, i=i: w[:i] + signs[c] + w[i + 1 :])
    for i in range(start, stop + last):
        inserted = (before[:, i] + (whole - before[:, i]) * np.uint64(_BASE))[:, None] + letters[None, :] * power[i]
        keep = np.ones((len(words), n_letters), dtype=bool) if i == 0 else codes[:, i - 1][:, None] != alphabet[None, :]
        yield from matched(inserted, keep, lambda w, c, i=i: w[:i] + signs[c] + w[i:])


def _joined(batches: Iterator, alphabet: list[int]) -> Iterator:
    import numpy as np
    import pandas as pd

    held = [b for b in batches if len(b)]
    if not held:
        return
    rows = pd.concat(held, ignore_index=True)
    del held
    known = rows.drop_duplicates("word")
    pool = _Pool(known["word"].tolist(), known["n"].to_numpy())
    letters = np.array(alphabet, dtype=np.uint32)
    own = rows[rows["segment"] >= 0]
    own = own.assign(length=own["word"].str.len())
    for (length, segment), part in own.groupby(["length", "segment"], sort=True):
        segments = min(-(-length // SEGMENT), MOST_SEGMENTS)
        start, stop = segment * length // segments, (segment + 1) * length // segments
        step = max(1, AT_ONCE // max(length, len(letters)))
        words = part["word"].tolist()
        for lo in range(0, len(words), step):
            some = words[lo : lo + step]
            near: dict[int, list[int]] = {}
            for row, other in neighbours(some, length, start, stop, letters, pool):
                near.setdefault(row, []).append(other)
            out = []
            for row, others in near.items():
                best = min(others, key=lambda o: (-pool.counts[o], pool.words[o]))
                out.append((some[row], len(others), int(pool.counts[best]), pool.words[best]))
            if out:
                yield pd.DataFrame(out, columns=["word", "n_near", "best_n", "best"])


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the words that have a form; forms never lead back, as each is twice as frequent as its word."""
    rows = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        total = rows.count()
        aims = rows.groupBy("root").agg(F.count("*").alias("aimed"))
        table = aims.join(rows.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        table = table.withColumn("next", F.coalesce("next", "root"))
        moved = stored(spread_join(rows, table, ["root"], "aimed", total).select("word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "spelling-roots")
        release(rows)
        rows = moved.select("word", "root")
        rows._scratch_path = moved._scratch_path
        if moved.where("moved").isEmpty():
            return rows


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of the vocabulary of ``docs`` (doc_id, text).

    Near words differ by one inserted, deleted or replaced code point. ``form`` is the most frequent near word (ties: smallest by
    code points) if it is at least twice as frequent, else NULL; ``root`` is where the forms lead, the word itself without one.
    NULL and empty texts add no words; repeated rows count again; very long runs are words like others, their neighbourhood taken
    in parts; an empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    words = stored(vocabulary(docs), "spelling-words")
    n_words = words.count()
    letters = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).where("c <> ''").distinct()
    alphabet = sorted(ord(r.c) for r in letters.collect())  # at most the letters of RUN
    parts = max(shuffle_partitions(spark), n_words * 12 // TASK_ROWS + 1)
    frames = _frames(words).repartition(parts, "key").select("word", "n", "segment")
    found = frames.mapInPandas(lambda batches: _joined(batches, alphabet), "word string, n_near long, best_n long, best string")
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("minus"), "best")).alias("top"))
    judged = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("top.minus") >= _RATIO * F.col("n"), F.struct(F.col("top.best").alias("form"), (-F.col("top.minus")).alias("form_n"))).alias("f")
    )
    formed = stored(judged.select("word", "n", "n_near", "f.form", "f.form_n"), "spelling-forms")
    release(words)
    roots = _roots(formed.where("form is not null"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
