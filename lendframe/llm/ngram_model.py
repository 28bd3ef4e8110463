"""Scoring whole texts by a trigram model of the corpus, held in Elias-Fano tries (``llm.trie``) that are dealt over shards.

1. Texts become blocks of some hundred thousand tokens: word hashes, and tokens as places among them.
2. Blocks ask the shards of words for numbers and counts; a shard adds up what the blocks counted and answers each of them.
3. Blocks send their distinct trigrams, with how often training documents of theirs have them, to the shards of middle words. A
   shard adds them up to a trie and answers the same trigrams from it.
4. Blocks take the answers up and add the log probabilities of each document's tokens.

So what a task holds is a block or a shard, of bounded size; what is moved is packed arrays. A frequent middle word is dealt over
several shards by a hash of the last word, so no shard has to hold it. Nothing is pruned: the model grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendframe.llm.common import let_go, release, ship, shuffle_partitions, stored

BLOCK_TOKENS, SHARD_TOKENS = 1 << 19, 1 << 19
#: Exponent by which the number of different successors is taken to grow with a context's count (Heaps' law).
GROWTH = 0.7
#: The empty word stands for the end; no text has it. The begin of a text is number 1, words count from 2.
END, BEGIN = "", 1
HELD_OUT = 2


def packed(values) -> bytes:
    """Whole numbers as planes of bytes, compressed: the high planes are nearly all zero."""
    import numpy as np
    import pyarrow as pa

    x = np.ascontiguousarray(values, dtype=np.uint64)
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = x.view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + len(x).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(np.ascontiguousarray(planes).tobytes(), asbytes=True)


def unpacked(raw: bytes):
    import numpy as np
    import pyarrow as pa

    width, size = raw[0], int.from_bytes(raw[1:9], "little")
    planes = np.frombuffer(pa.Codec("zstd").decompress(raw[9:], width * size), dtype=np.uint8).reshape(width, size)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.view(np.uint64).ravel().astype(np.int64)


def mixed(x):
    import numpy as np

    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _word_hashes(words) -> object:
    import numpy as np
    import pandas as pd

    return pd.util.hash_array(np.asarray(words, dtype=object), categorize=False)


def _tokenise(batches: Iterator, block_tokens: int) -> Iterator:
    """Record batches (doc_id, held, text) to blocks. Words are told apart by a 64-bit hash."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark import TaskContext

    serial = TaskContext.get().partitionId() << 32
    end = _word_hashes([END])[0]
    held: list = []
    size = 0

    def block():
        nonlocal serial, size
        ids = [x for part in held for x in part[0]]
        lengths, out = np.concatenate([p[1] for p in held]), np.concatenate([p[2] for p in held])
        words, token, times = np.unique(np.concatenate([p[3] for p in held]), return_inverse=True, return_counts=True)
        by_times = np.argsort(-times, kind="stable")
        place = np.empty(len(words), dtype=np.int64)
        place[by_times] = np.arange(len(words))
        row = {"block": [serial], "ids": [ids], "lengths": [lengths.tolist()], "held": [out.tolist()], "words": [words[by_times].tobytes()], "buckets": [packed(_buckets(words[by_times]))], "tokens": [packed(place[token])]}
        serial, size = serial + 1, 0
        held.clear()
        return row

    schema = None
    for batch in batches:
        schema = schema or pa.schema([
            ("block", pa.int64()), ("ids", pa.list_(batch.schema.field(0).type)), ("lengths", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("words", pa.binary()), ("buckets", pa.binary()), ("tokens", pa.binary()),
        ])
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(batch.column(2), "").cast(pa.large_string())))
        n_all = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        hashes = _word_hashes(names) if names else np.zeros(0, dtype=np.uint64)
        index = coded.indices.to_numpy(zero_copy_only=False)
        token = hashes[index]
        real = np.array([bool(w) for w in names], dtype=bool)[index]
        doc = np.repeat(np.arange(len(n_all)), n_all)
        counts = np.bincount(doc[real], minlength=len(n_all)) if len(doc) else np.zeros(len(n_all), dtype=np.int64)
        token = token[real]
        ids, out = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        ends = np.cumsum(counts)
        first = 0
        while first < len(ids):
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + block_tokens - size, side="right")))
            lengths = counts[first:last]
            part = np.insert(token[before : ends[last - 1]], np.cumsum(lengths), end)
            held.append((ids[first:last], lengths + 1, out[first:last], part))
            size += len(part)
            first = last
            if size >= block_tokens:
                yield pa.RecordBatch.from_pydict(block(), schema=schema)
    if held:
        yield pa.RecordBatch.from_pydict(block(), schema=schema)


def _training(lengths, held):
    """For each token of a block whether its document is for training."""
    import numpy as np

    return np.repeat(~np.asarray(held, dtype=bool), np.asarray(lengths, dtype=np.int64))


def _buckets(words):
    import numpy as np

    return (words >> np.uint64(40)).astype(np.int64)


def _shards_of(buckets, shards: int):
    """Shards of the 24-bit buckets that stand for words once their hashes have been sent."""
    return buckets * shards >> 24


def _ask_words(frames: Iterator, shards: int) -> Iterator:
    import numpy as np
    import pandas as pd

    for frame in frames:
        for r in frame.itertuples():
            words, token = np.frombuffer(r.words, dtype=np.uint64), unpacked(r.tokens)
            times = np.bincount(token, minlength=len(words))
            learnt = np.bincount(token[_training(r.lengths, r.held)], minlength=len(words))
            shard = _shards_of(_buckets(words), shards)
            order = np.argsort(shard, kind="stable")
            out = []
            for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                out.append((int(shard[part[0]]), r.block, words[part].tobytes(), packed(learnt[part]), packed(times[part])))
            yield pd.DataFrame(out, columns=["shard", "block", "words", "learnt", "times"])


def _answer_words(group, shards: int):
    """Number the words of a shard, the frequent ones first, and tell each block numbers and counts of its words."""
    import numpy as np
    import pandas as pd

    shard = int(group["shard"].iat[0])
    parts = [np.frombuffer(w, dtype=np.uint64) for w in group["words"]]
    words, where = np.unique(np.concatenate(parts), return_inverse=True)
    learnt = np.bincount(where, np.concatenate([unpacked(x) for x in group["learnt"]])).astype(np.int64)
    times = np.bincount(where, np.concatenate([unpacked(x) for x in group["times"]])).astype(np.int64)
    rank = np.empty(len(words), dtype=np.int64)
    rank[np.argsort(-times, kind="stable")] = np.arange(len(words))
    number = rank * shards + shard + BEGIN + 1
    out, at = [(-1, shard, int((learnt > 0).sum()), None, None, None)], 0
    for block, part in zip(group["block"], parts):
        here = where[at : at + len(part)]
        at += len(part)
        out.append((block, shard, 0, packed(number[here]), packed(learnt[here]), packed(times[here])))
    return pd.DataFrame(out, columns=["block", "shard", "n_words", "number", "learnt", "times"])


def _resolve(frames: Iterator, shards: int) -> Iterator:
    """Blocks whose words have become numbers and counts."""
    import numpy as np
    import pandas as pd

    for frame in frames:
        for r in frame.itertuples():
            order = np.argsort(_shards_of(unpacked(r.buckets), shards), kind="stable")
            answers, out = sorted(r.answers, key=lambda x: x["shard"]), {}
            for name in ("number", "learnt", "times"):
                whole = np.empty(len(order), dtype=np.int64)
                whole[order] = np.concatenate([unpacked(x[name]) for x in answers])
                out[name] = [packed(whole)]
            yield pd.DataFrame({"block": [r.block], "ids": [list(r.ids)], "lengths": [r.lengths], "held": [r.held], "tokens": [r.tokens], **out})


class _Block:
    """A block with the numbers and counts of its words, and its tokens' trigrams in the order in which they are sent."""

    def __init__(self, r, shards: int, learnt_begin: int, times_begin: int) -> None:
        import numpy as np

        from lendframe.llm.trie import sorted_by

        token, number, learnt, times = (unpacked(x) for x in (r.tokens, r.number, r.learnt, r.times))
        self.lengths = np.asarray(r.lengths, dtype=np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.train = _training(r.lengths, r.held)
        self.learnt = learnt[token]

        def back(values, by, begin):
            out = np.concatenate([np.full(by, begin), values])[: len(values)]
            for k in range(by):
                out[(self.starts + k)[self.lengths > k]] = begin
            return out

        c = number[token]
        b, a = back(c, 1, BEGIN), back(c, 2, BEGIN)
        self.learnt_b = back(self.learnt, 1, learnt_begin)
        # what training documents don't have needs no asking
        self.asked = np.flatnonzero((self.learnt > 0) & (self.learnt_b > 0))
        a, b, c, train = a[self.asked], b[self.asked], c[self.asked], self.train[self.asked]
        share = -(-back(times[token], 1, times_begin)[self.asked] // SHARD_TOKENS)
        salt = (mixed(c) >> np.uint64(20)).astype(np.int64) % np.maximum(share, 1)
        to = ((mixed(b * 1_000_003 + salt) >> np.uint64(11)) % np.uint64(shards)).astype(np.int64)
        order = sorted_by(b, c, a)
        order = order[np.argsort(to[order], kind="stable")]
        a, b, c, to = a[order], b[order], c[order], to[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])
        self.which = np.empty(len(order), dtype=np.int64)  # the place of each asked token among the distinct trigrams
        self.which[order] = np.cumsum(new) - 1
        heads = np.flatnonzero(new)
        self.a, self.b, self.c, self.to = a[heads], b[heads], c[heads], to[heads]
        self.counts = np.bincount(self.which[train], minlength=len(heads))


def _ask_trigrams(frames: Iterator, *settings: int) -> Iterator:
    import numpy as np
    import pandas as pd

    for frame in frames:
        for r in frame.itertuples():
            k = _Block(r, *settings)
            out = []
            for part in np.split(np.arange(len(k.to)), np.flatnonzero(np.diff(k.to)) + 1) if len(k.to) else []:
                b, c = k.b[part], k.c[part]
                same = np.r_[False, b[1:] == b[:-1]]
                # sorted by b, then c: differences, those of c only where b stays
                out.append((int(k.to[part[0]]), r.block, packed(np.diff(b, prepend=0)), packed(np.where(same, np.diff(c, prepend=0), c)), packed(k.a[part]), packed(k.counts[part])))
            if out:
                yield pd.DataFrame(out, columns=["shard", "block", "b", "c", "a", "counts"])


def _answer_trigrams(group):
    """Build the trie of a shard and answer what each block asks; the codes of the two frequencies go back."""
    import numpy as np
    import pandas as pd

    from lendframe.llm.trie import Trie, sorted_by

    parts = []
    for r in group.itertuples():
        step, c = unpacked(r.b), unpacked(r.c)
        heads = np.flatnonzero(np.r_[True, step[1:] > 0])
        total = np.cumsum(c)
        before = np.r_[0, total][heads]
        parts.append((np.cumsum(step), total - np.repeat(before, np.diff(np.r_[heads, len(c)])), unpacked(r.a), unpacked(r.counts)))
    b, c, a, counts = (np.concatenate([p[k] for p in parts]) for k in range(4))
    order = sorted_by(b, c, a)
    b, c, a, counts = b[order], c[order], a[order], counts[order]
    seen = counts > 0
    trie = Trie.over(Trie.of(b[seen], c[seen], a[seen], counts[seen]).to_bytes())
    # all blocks' queries in the order of the levels, then back to each block's own
    two, three = (np.empty(len(order), dtype=np.uint8) for _ in range(2))
    two[order], three[order] = trie.codes(b, c, a)
    out, at = [], 0
    for block, part in zip(group["block"], parts):
        here = slice(at, at + len(part[0]))
        at = here.stop
        out.append((block, int(group["shard"].iat[0]), packed(two[here]), packed(three[here])))
    return pd.DataFrame(out, columns=["block", "shard", "two", "three"])


def _interpolated(count, context, below):
    """(1 - w) count / context + w below, where w = t / (context + t) for t = context ** GROWTH successors; ``below`` unseen."""
    import numpy as np

    some = np.maximum(context, 1)
    w = np.where(context > 0, 1 / (1 + some ** (1 - GROWTH)), 1.0)
    return (1 - w) * np.minimum(count / some, 1) + w * below


def _score(frames: Iterator, n_train: int, n_words: int, *settings: int) -> Iterator:
    import numpy as np
    import pandas as pd

    from lendframe.llm.trie import LEVELS

    for frame in frames:
        for r in frame.itertuples():
            k = _Block(r, *settings)
            two, three = (np.zeros(len(k.learnt)) for _ in range(2))
            answers = sorted(r.trigrams if r.trigrams is not None else [], key=lambda x: x["shard"])
            if answers:
                two[k.asked] = LEVELS[np.concatenate([unpacked(x["two"]) for x in answers])][k.which]
                three[k.asked] = LEVELS[np.concatenate([unpacked(x["three"]) for x in answers])][k.which]
            one = (k.learnt + 1) / (n_train + n_words + 1)
            pair = _interpolated(two, k.learnt_b, one)
            # the frequency of (a, b) came with the token before
            context = np.r_[0.0, two[:-1]]
            context[k.starts] = 0
            score = _interpolated(three, context, pair)
            yield pd.DataFrame({
                "doc_id": pd.Series(list(r.ids), dtype=object), "held_out": list(r.held), "n_tokens": k.lengths,
                "n_known": np.add.reduceat((k.learnt > 0).astype(np.int64), k.starts), "train_tokens": n_train,
                "base_score": np.add.reduceat(np.log10(one), k.starts), "score": np.add.reduceat(np.log10(score), k.starts),
            })


def score(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs`` (doc_id, text).

    Rows whose CRC-32 of the id as text is 2 modulo 7 are held out from learning. Tokens are the words of the whole text with A-Z
    lower-cased, and one end. ``base_score`` adds add-one unigram probabilities (log10), ``score`` those of the interpolated
    trigram model: a context seen n times leaves the share 1 / (1 + n ** 0.3) to the order below, down to the add-one unigram.
    Frequencies above 128 come from the tries within 9 %. NULL and empty texts are one end; a NULL id trains; repeated rows count
    again; a long text is a block of its own; an empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == HELD_OUT, F.lit(False))
    rows = docs.select("doc_id", held.alias("held"), "text")
    schema = f"block long, ids array<{kind}>, lengths array<long>, held array<boolean>, words binary, buckets binary, tokens binary"
    blocks = stored(rows.mapInArrow(lambda x: _tokenise(x, block_tokens), schema), "lm-blocks")
    each = F.arrays_zip("lengths", "held")
    of = blocks.select(
        F.aggregate(each, F.lit(0).cast("long"), lambda s, x: s + x["lengths"]).alias("n"),
        F.aggregate(each, F.lit(0).cast("long"), lambda s, x: s + F.when(x["held"], 0).otherwise(x["lengths"])).alias("train"),
        F.aggregate("held", F.lit(0).cast("long"), lambda s, x: s + F.when(x, 0).otherwise(1)).alias("learnt"), F.size("held").cast("long").alias("docs"),
    ).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "train", "learnt", "docs")]).first()
    shards = max(shuffle_partitions(spark), of.n // SHARD_TOKENS + 1)
    shards_words = max(shuffle_partitions(spark), of.n // (8 * SHARD_TOKENS) + 1)
    asked = blocks.mapInPandas(lambda x: _ask_words(x, shards_words), "shard long, block long, words binary, learnt binary, times binary")
    words = stored(
        asked.groupBy("shard").applyInPandas(
            lambda g: _answer_words(g, shards_words), "block long, shard long, n_words long, number binary, learnt binary, times binary"
        ),
        "lm-words",
    )
    n_words = words.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    answers = words.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("shard", "number", "learnt", "times")).alias("answers"))
    joined = blocks.drop("words").join(answers, "block")
    known = f"block long, ids array<{kind}>, lengths array<long>, held array<boolean>, tokens binary, number binary, learnt binary, times binary"
    ready = stored(joined.mapInPandas(lambda x: _resolve(x, shards_words), known), "lm-ready")
    release(blocks, words)
    del asked, answers, joined
    let_go(spark)
    settings = (shards, of.learnt, of.docs)
    sent = ready.mapInPandas(lambda x: _ask_trigrams(x, *settings), "shard long, block long, b binary, c binary, a binary, counts binary")
    codes = sent.groupBy("shard").applyInPandas(_answer_trigrams, "block long, shard long, two binary, three binary")
    back = stored(codes.groupBy("block").agg(F.collect_list(F.struct("shard", "two", "three")).alias("trigrams")), "lm-codes")
    del sent, codes
    let_go(spark)
    out = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scores = stored(ready.join(back, "block", "left").mapInPandas(lambda x: _score(x, of.train, n_words, *settings), out), "lm-scores")
    release(ready, back)
    return scores
