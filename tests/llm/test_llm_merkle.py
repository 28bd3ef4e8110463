"""The Merkle manifest against trees built in memory."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lendframe.llm import merkle

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, more=0):
    out = ""
    for field in merkle.FIELDS:
        value = row[field]
        if field == "n_chars" and value is not None:
            value += more
        out += "-" if value is None else f"{len(str(value).encode())}:{value}"
    return sha(out)


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
    return levels


def brute(rows):
    langs = sorted({r["lang"] for r in rows}, key=lambda t: (t is not None, (t or "").encode()))
    group = {t: sorted((r for r in rows if r["lang"] == t), key=lambda r: ((r["doc_id"] is not None, r["doc_id"] or 0), leaf(r))) for t in langs}
    trees = {t: tree([leaf(r) for r in group[t]]) for t in langs}
    top = tree([trees[t][-1][0] for t in langs]) if langs else []
    for k, t in enumerate(langs):
        for i, row in enumerate(group[t]):
            steps = []
            for levels, at in ((trees[t], i), (top, k)):
                for nodes in levels[:-1]:
                    steps.append((at % 2, nodes[at ^ 1] if at ^ 1 < len(nodes) else ""))
                    at //= 2
            hit = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 7 == 0
            node = leaf(row, int(hit))
            for odd, beside in steps:
                node = sha(beside + node) if odd else sha(node + beside)
            yield (row["doc_id"], leaf(row), trees[t][-1][0], top[-1][0], sha("".join(s for _, s in steps)), node, node == top[-1][0])


def audited(docs, **bounds):
    rows = merkle.audit(docs, **bounds).withColumn("proof_sha256", merkle.siblings_sha256(F.col("proof"))).select(*COLUMNS)
    return sorted(map(repr, map(tuple, rows.collect())))


@pytest.fixture(scope="module")
def odd(spark):
    """NULLs everywhere, repeated rows, ties on the id, a very long text, many groups, one of a third of the rows."""
    rows = [(None, None, "", "a", 1), (1, "", None, None, None), (1, "", None, None, None), (2, "abé" * 200_000, "é", "x", 3)]
    rows += [(i % 50, "t", f"l{i % 9}" if i % 3 else "en", "s", i % 4) for i in range(300)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize(("bound", "bits"), [(4096, 12), (4, 2), (3, 1)])
def test_manifest(odd, bound, bits):
    """Small bounds take further rounds of blocks, and the groups' roots through a tree of their own."""
    want = sorted(map(repr, brute([r.asDict() for r in odd.collect()])))
    assert audited(odd, bound=bound, most_bits=bits) == want


def test_tampered_rows_alone_fail(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = merkle.audit(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0)


def test_clashing_columns_and_empty_table(odd):
    docs = odd.where("doc_id < 9")
    extra = docs.withColumns({c: F.lit("x") for c in ("tree", "node", "pos", "n", "tie", "proof", "leaf", "__x")})
    assert audited(extra) == audited(docs)
    assert audited(odd.where("false")) == []
