"""The Elias-Fano trie against counters, and the scorer against a model in dictionaries."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lendframe.llm import ngram_model
from lendframe.llm.trie import LEVELS, EliasFano, Trie, quantised


@pytest.mark.parametrize("values", [[], [0], [7], [0, 0, 5, 5, 5, 900], list(range(300)), [1 << 40, (1 << 40) + 1]])
def test_elias_fano(values):
    v = np.array(values, dtype=np.int64)
    seq = EliasFano.of(v)
    assert seq.access(np.arange(len(v))).tolist() == values
    asked = np.array(sorted({0, 1, *values, *(x + 1 for x in values), *(max(0, x - 1) for x in values)}), dtype=np.int64)
    assert seq.successor(asked).tolist() == np.searchsorted(v, asked).tolist()


@pytest.mark.parametrize(("n", "words"), [(0, 5), (1, 5), (60, 4), (5000, 40)])
def test_trie_in_a_mapped_file(tmp_path, n, words):
    rng = np.random.default_rng(n)
    b, c, a = (rng.zipf(1.3, n) % words + 1 for _ in range(3))
    order = np.lexsort((a, c, b))
    b, c, a = b[order], c[order], a[order]
    (tmp_path / "trie").write_bytes(Trie.of(b, c, a, np.ones(n, dtype=np.int64)).to_bytes())
    trie = Trie.open(str(tmp_path / "trie"))
    two, three = Counter(zip(b.tolist(), c.tolist())), Counter(zip(b.tolist(), c.tolist(), a.tolist()))
    q = np.concatenate([rng.integers(1, words + 3, (3, 2000)), np.stack([b, c, a])], axis=1)
    q = q[:, np.lexsort((q[2], q[1], q[0]))]
    got = trie.codes(*q)
    assert got[0].tolist() == quantised(np.array([two[k] for k in zip(*q[:2].tolist())])).tolist()
    assert got[1].tolist() == quantised(np.array([three[k] for k in zip(*q.tolist())])).tolist()


def test_codes_of_counts():
    n = np.array([0, 1, 127, 128, 1000, 10**7])
    assert np.all(np.abs(LEVELS[quantised(n)] - n) <= 0.1 * n)


def brute(rows):
    words = [[w for w in re.split("[ \t\n\x0b\x0c\r]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if w] + [""] for _, text in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    one, two, three = Counter(), Counter(), Counter()
    begin = sum(not h for h in held)
    for out, tokens in zip(held, words):
        if not out:
            path = ["<s>", "<s>", *tokens]
            one.update(tokens)
            two.update(zip(path[1:], path[2:]))
            three.update(zip(path, path[1:], path[2:]))
    n, v = sum(one.values()), len(one)
    code = lambda k: float(LEVELS[quantised(np.array([k]))[0]])

    def mixed(count, context, below):
        if context == 0:
            return below
        w = 1 / (1 + context**0.3)
        return (1 - w) * min(count / context, 1) + w * below

    for (i, _), out, tokens in zip(rows, held, words):
        base = total = 0.0
        path = ["<s>", "<s>", *tokens]
        for k in range(2, len(path)):
            a, b, c = path[k - 2 : k + 1]
            p = (one[c] + 1) / (n + v + 1)
            base += math.log10(p)
            p = mixed(code(two[b, c]), begin if k == 2 else one[b], p)
            total += math.log10(mixed(code(three[a, b, c]), code(two[a, b]) if k > 2 else 0, p))
        yield i, out, len(tokens), sum(one[t] > 0 for t in tokens), n, base, total


def check(spark, rows, **settings):
    got = sorted(map(tuple, ngram_model.score(spark.createDataFrame(rows, "doc_id long, text string"), **settings).collect()), key=str)
    want = sorted(brute(rows), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_scores_equal_brute_force(spark):
    """NULLs, empty and long texts, odd white space, repeated rows, unknown words; small blocks."""
    rng = np.random.default_rng(5)
    vocabulary = np.array(["the", "The", "of", "é", "x1", "end.", " ", "zz"] + [f"w{k}" for k in range(60)])
    rows = [(k, " ".join(rng.choice(vocabulary, rng.integers(0, 40)))) for k in range(120)]
    rows += [(None, "the of the"), (None, None), (7, None), (8, ""), (9, " \t\n"), (500, "the\x0bof\x0cthe\r\n of"), *rows[:10], (501, "the of x1 " * 5000)]
    check(spark, rows, block_tokens=300)


def test_hot_middle_word_is_dealt_over_shards(spark, monkeypatch):
    monkeypatch.setattr(ngram_model, "SHARD_TOKENS", 50)
    rows = [(k, f"a{k % 7} hot b{k % 11} hot c{k}") for k in range(300)]
    check(spark, rows, block_tokens=200)


def test_nothing_to_learn_from(spark):
    check(spark, [])
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    check(spark, [(held, "only held out")])


def test_model_beats_the_base_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("words", F.lit(1)).withColumn("held", F.lit(1))
    r = ngram_model.score(docs).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b
