"""Spelling variants against a comparison of all words."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lendframe.llm import spelling

SCHEMA = "doc_id long, text string"


def counted(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i:] == b[i + 1 :] or (len(a) == len(b) and a[i + 1 :] == b[i + 1 :])


def brute(rows):
    n = counted(rows)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        yield (w, form[w], root, n[w], len(near[w]), n.get(form[w]))


def found(spark, rows):
    return sorted(map(tuple, spelling.variants(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)


def random_rows():
    """Chains of variants, ties of counts, accents, repeated letters, runs of some hundred letters, NULLs and repeated rows."""
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abéÀ"), rng.integers(5, 8))) for _ in range(150)] + ["aaaaa", "aaaaaa", "aaaaaaa"]
    long = "".join(rng.choice(list("xyz"), 700))
    words += [long, long[:350] + "q" + long[350:], long[:-1], "w" * 90, "w" * 91]
    rows = [(int(rng.integers(0, 90)), " ".join(rng.choice(words, 30)) + ("-" if k % 2 else "")) for k in range(200)]
    rows.append((None, "gizmo " * 20 + "gizmoz " * 9 + "gizmozo " * 4))
    return rows + [(None, "Maybe MAYBE maybe2maybe maybes maybes maybes"), (5, None), (6, ""), *rows[:20]]


def test_variants_equal_brute_force(spark):
    rows = random_rows()
    got = found(spark, rows)
    assert got == sorted(brute(rows), key=str)
    assert any(form and form != root for _, form, root, *_ in got)


def test_tables_without_words(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None), (2, ""), (3, "abc 12345")]) == []


@pytest.mark.parametrize("word", ["abcde", "aabbé", "zzzzzz"])
def test_each_candidate_once(word):
    """All 3 kinds of edits of a word, found in a pool of exactly its neighbourhood, each once."""
    letters = np.array(sorted(map(ord, "abcdeézyq")), dtype=np.uint32)
    signs = [chr(c) for c in letters]
    around = {word[:i] + word[i + 1 :] for i in range(len(word))}
    around |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in signs} | {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in signs}
    around.discard(word)
    names = sorted(around)
    pool = spelling._Pool(names, np.ones(len(names), dtype=np.int64))
    hits = [o for _, o in spelling.neighbours([word], len(word), 0, len(word), letters, pool)]
    assert sorted(hits) == list(range(len(names)))
