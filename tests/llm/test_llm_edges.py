"""Odd tables: clashing column names, empty tables, repeated rows, very long texts; and more brute-force versions."""

import base64
import hashlib
import math
import random
import re
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_llm_operators import brute_fingerprint, brute_lines, brute_measures, clean_and_junk, prose, united, words

from lendframe.llm import (
    byte_bpe, embedding_dedup, label_model, license_scan, line_dedup, mixing, quality_classifier, quality_rules, queries, secret_scan, simhash, token_count,
)

WORD_FILE, BYTE_FILE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
OPERATORS = {
    "line": line_dedup.line_dedup,
    "simhash": simhash.near_duplicates,
    "chosen": simhash.representatives,
    "secret": secret_scan.scan,
    "tokens": lambda d: token_count.token_counts(d, WORD_FILE),
    "rules": quality_rules.judge,
    "license": license_scan.scan,
    "embedding": lambda d: embedding_dedup.near_duplicates(d.withColumn("v", F.array(F.col("doc_id").cast("double"), F.lit(1.0))), "doc_id", "v"),
    "mixing": lambda d: mixing.mix(d.withColumn("length", F.length("text")), "length"),
    "classifier": quality_classifier.classify,
    "bpe": lambda d: byte_bpe.encode_and_decode(d, BYTE_FILE, public_tokenizers.PATTERN),
}
#: Names that operators use or used for themselves.
CLASHING = (
    "__id", "__hash", "__text_hash", "__fp", "__component", "__dropped", "__votes", "__m", "__both", "__tokens", "__quality", "__vector", "__found", "__base",
    "__random", "__hot", "__hot___component", "__source", "__target", "__copies", "h1", "h2", "run", "batch", "first", "hot", "n", "root", "pattern", "posterior_", "a.b", "rows", "size_",
)


@pytest.fixture(scope="module")
def odd(spark):
    data = [(i, prose(40, i) + "\nThis very line is in every document here\n", "en", f"s{i % 3}", 1) for i in range(30)]
    data += [(3, data[3][1], "en", "s0", 1), (3, data[3][1], "en", "s0", 1), (4, None, "en", None, None), (None, "", None, "s1", 0), (None, None, None, None, None)]
    return spark.createDataFrame(data, SCHEMA)


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names_and_repeats(spark, odd, name):
    """Columns of any name stay as they are, and results don't change with them; every row comes back (or one a group)."""
    clashing = odd.withColumns({c: F.lit(f"kept {c}") for c in CLASHING})
    plain, got = OPERATORS[name](odd), OPERATORS[name](clashing)
    made = [c for c in plain.columns if c not in odd.columns or c == "text"]
    assert set(CLASHING) <= set(got.columns)
    rows = got.select(*[F.col(f"`{c}`") for c in CLASHING]).distinct().collect()
    assert len(rows) == 1 and all(v == f"kept {c}" for c, v in zip(CLASHING, rows[0]))
    key = lambda d: sorted(map(repr, d.select("doc_id", *made).collect()))
    assert key(plain) == key(got)
    if name != "chosen":
        assert plain.count() == 35


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_row_of_each_group(spark, odd):
    got = simhash.representatives(odd).collect()
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    fps = [brute_fingerprint(t) for _, t in texts]
    root = united(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3])
    assert len(got) == len(set(root)) == len({(r.doc_id, r.text) for r in got})
    nobody = spark.createDataFrame([(None, "same words in all of them"), (None, "same words in all of them")], "doc_id long, text string")
    assert simhash.representatives(nobody).count() == 1


def test_sets_cover_five_positions():
    assert all(any(set(s) <= set(five) for s in simhash.SETS) for five in combinations(range(8), 5))


def test_line_dedup_repeated_ids_as_in_sql(spark):
    line = "a line that is long enough to count"
    data = [(1, f"{line}\nx"), (1, f"{line}\ny"), (2, line), (5, "alone"), (6, f"shared by three documents here"), (7, "shared by three documents here"), (8, " SHARED by three documents here")]
    got = {(r.doc_id, r.n_dropped) for r in line_dedup.line_dedup(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == {(1, 0), (2, 0), (5, 0), (6, 1), (7, 1), (8, 0)}
    with duckdb.connect() as db:
        db.execute("create table documents (doc_id bigint, text varchar)")
        db.executemany("insert into documents values (?, ?)", [list(row) for row in data])
        assert {(r[0], r[2]) for r in db.execute(queries.ORACLE_SQL["op1_line_dedup"]).fetchall()} == got


def test_runs_hold_the_counts(spark):
    """Keys of many batches: each is in one run, whose count is right after compaction; without the runs nothing is shared."""
    own = random.Random(1)
    total, runs = Counter(), line_dedup.LineRuns(spark, 2)
    with line_dedup.ordered_scans(spark):
        for _ in range(5):
            batch = Counter(own.randint(0, 60) for _ in range(50))
            total += batch
            runs.add(spark.createDataFrame([(k, -k, n, k) for k, n in batch.items()], "h1 long, h2 long, n_docs long, max_doc long"))
        got = [r for r in runs.shared(1).collect()]
    assert len(got) == len(total) and {r.h1: r.n_docs for r in got} == dict(total)
    runs.close()
    assert not runs.paths


LONG = 3_000_000


@pytest.fixture(scope="module")
def long_texts():
    own = random.Random(3)
    vocabulary = [prose(1, i) for i in range(500)]
    body = " ".join(own.choice(vocabulary) for _ in range(LONG // 6))
    lines = "\n".join(" ".join(own.choice(vocabulary) for _ in range(12)) for _ in range(LONG // 80))
    return [body, lines, "x" * 1_200_000 + " end", "This very long shared line, " + "é" * 40 + "\n" + lines[:1_500_000]]


def test_very_long_texts(spark, long_texts):
    data = list(enumerate(long_texts)) + [(10, long_texts[3]), (11, long_texts[3][:100_000])]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.line_dedup(docs).collect()}
    assert got == {i: (a, b, t) for i, a, b, t in brute_lines(data)} and any(v[1] for v in got.values())
    member = {r.doc_id: r.fp for r in simhash.memberships(docs).collect()}
    assert all(member[i] % 2**64 == brute_fingerprint(t) for i, t in data[:2])
    measured = {r.doc_id: (r.n_words, r.word_chars) for r in quality_rules.judge(docs).collect()}
    assert all(measured[i] == (len(words(t)), sum(map(len, words(t)))) for i, t in data)
    key = hashlib.sha256(b"1").hexdigest()
    secret = spark.createDataFrame([(1, long_texts[0] + f" token={key[:20]} " + long_texts[1])], "doc_id long, text string")
    at = len(long_texts[0]) + 1
    assert secret_scan.scan(secret).first().spans == f"assign:{at}:{at + 26}"
    found = license_scan.scan(spark.createDataFrame([(1, long_texts[0] + " Released under the MIT License. " + long_texts[1])], "doc_id long, text string")).first()
    assert (found.license, found.n_found) == ("MIT", 1)


def test_very_long_tokens(spark, long_texts):
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    texts = [long_texts[0][:1_000_000], long_texts[1][:1_000_000], "ab" * 50_000]
    data = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    theirs = Tokenizer.from_file(WORD_FILE)
    for r in token_count.token_counts(data, WORD_FILE).collect():
        assert r.n_tokens == len(theirs.encode(texts[r.doc_id], add_special_tokens=False).ids)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE_FILE, "rb"))}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in byte_bpe.encode_and_decode(data, BYTE_FILE, public_tokenizers.PATTERN).collect():
        assert r.token_ids == other.encode_ordinary(texts[r.doc_id]) and bytes(r.decoded) == texts[r.doc_id].encode()


def test_word_splits_by_the_library_tables(spark):
    """Code points that newer tables call letters, and every block's first ones, count as the library counts them."""
    from tokenizers import Tokenizer

    theirs = Tokenizer.from_file(WORD_FILE)
    points = [int(end, 16) for part in token_count.NEWER.split() for end in part.split("-")] + [*range(0, 0x2000, 7), *range(0x10000, 0x32000, 331)]
    counter = token_count.WordCounter(open(WORD_FILE, "rb").read())
    texts = [f"a{chr(c)}b 1{chr(c)}" for c in points if not 0xD800 <= c <= 0xDFFF]
    assert [counter.count(t) for t in texts] == [len(e.ids) for e in theirs.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("keys", [3, 20, 300])
def test_planted_keys(spark, keys):
    """Random keys of any corpus size are found, readable names are not; spans agree with a battery of its own."""
    own = random.Random(keys)
    alphabet = secret_scan.ENCODINGS[3][1]
    real = []
    while len(real) < keys:
        token = "".join(own.choice(alphabet) for _ in range(40))
        if re.fullmatch("(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z]).*", token):
            real.append(token)
    names = [f"{own.choice('abcd')}/Reports-of-{own.choice(['May', 'June'])}/Final-version-{i % 10}{i % 7}-of-the-Summary" for i in range(keys)]
    data = [(i, f"we keep {t} here") for i, t in enumerate([*real, *names])]
    got = {r.doc_id: r.spans for r in secret_scan.scan(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert sum(got[i] == "random:8:48" for i in range(keys)) >= 0.9 * keys
    assert not any(got[i] for i in range(keys, 2 * keys))
    p = [brute_p(t, alphabet) for t in real[:20]]
    table = spark.createDataFrame([(t,) for t in real[:20]], "t string")
    ours = [r[0] for r in table.select(secret_scan.randomness(F.col("t"), alphabet)).collect()]
    assert np.allclose(ours, p, atol=1e-6)


@pytest.mark.parametrize("keys", [0, 20, 200])
def test_keys_among_readable_tokens_of_their_band(spark, keys):
    """Encoded prose, identifiers and ids of the length of the keys: nine keys in ten found, one accepted token in twenty false."""
    own = random.Random(keys + 1)
    alphabet, vocabulary = secret_scan.ENCODINGS[3][1], "the of report Final account to Please contact 2021 and invoice number 77 for".split()
    real = []
    while len(real) < keys:
        token = "".join(own.choice(alphabet) for _ in range(44))
        if re.fullmatch("(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z]).*", token):
            real.append(token)
    prose = [base64.b64encode((" ".join(own.choice(vocabulary) for _ in range(24)))[:33].encode()).decode() for _ in range(400)]
    names = ["".join(own.choice(vocabulary).title() for _ in range(24))[:41] + f"{own.randrange(100):03d}" for _ in range(200)]
    rows = [*real, *prose, *names]
    assert all(len(t) == 44 for t in rows)
    data = spark.createDataFrame([(i, f"see {t} there") for i, t in enumerate(rows)], "doc_id long, text string")
    found = {r.doc_id for r in secret_scan.scan(data).collect() if r.spans}
    assert len(found & set(range(keys))) >= 0.9 * keys
    false = len(found - set(range(keys)))
    assert false <= max(1, 0.05 * len(found))


@pytest.mark.parametrize("code", range(4))
def test_top_bits_of_decoded_bytes(spark, code):
    _, alphabet, _, _ = secret_scan.ENCODINGS[code]
    own = random.Random(code)
    coder = {0: lambda b: b.hex(), 1: lambda b: b.hex().upper(), 2: lambda b: base64.b32encode(b).decode(), 3: lambda b: base64.b64encode(b).decode()}[code]
    texts = [bytes(own.randrange(256) for _ in range(30)) for _ in range(20)] + [b"a plain text of thirty letters"]
    table = spark.createDataFrame([(coder(x),) for x in texts], "t string")
    got = [r[0] for r in table.select(secret_scan.decoded(F.col("t"), alphabet, code)).collect()]
    want = [math.erfc(abs(2 * sum(b < 128 for b in x) - 30) / math.sqrt(30) / math.sqrt(2)) for x in texts]
    assert np.allclose(got, want, atol=1e-6) and got[-1] < 1e-6


def brute_p(token, alphabet):
    x = [alphabet.index(c) for c in token.translate(str.maketrans("-_", "+/"))]
    n, k = len(x), len(alphabet)
    tail = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    chi = sum(c * c for c in Counter(x).values()) * k / n - n
    z_chi = (chi - (k - 1)) / math.sqrt(2 * (k - 1) * (1 - 1 / n))
    high = [v >= k // 2 for v in x]
    n1 = sum(high)
    runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
    expect = 2 * n1 * (n - n1) / n + 1
    z_runs = (runs - expect) / math.sqrt((expect - 1) * (expect - 2) / (n - 1))
    mean = sum(x) / n
    serial = sum((a - mean) * (b - mean) for a, b in zip(x, x[1:])) / sum((a - mean) ** 2 for a in x)
    z_serial = (serial + 1 / n) * math.sqrt(n)
    half = -sum(math.log(max(p, 1e-15)) for p in (tail(z_chi), 2 * tail(abs(z_runs)), 2 * tail(abs(z_serial))))
    return math.exp(-half) * (1 + half + half * half / 2)


def brute_votes(t):
    """The rules of the quality operator, on their own."""
    t = t or ""
    w = words(t)
    n, chars, symbols, dup, repeats = brute_measures(t)
    n_lines = len([x for x in t.split("\n") if words(x)])
    upper, stops, bangs, digits = (len(re.findall(p, t)) for p in ("[A-Z]", "[.!?]", "!", "[0-9]"))
    function, distinct = len(set(w) & set(quality_rules.FUNCTION_WORDS)), len(set(w))
    vote = lambda bad, good=False: -1 if bad else int(good)
    return [
        vote(n < 20), vote(chars < 3 * n or chars > 7 * n), vote(20 * symbols > n, symbols == 0), vote(10 * dup > 3 * n_lines), vote(100 * repeats > 15 * n),
        vote(5 * upper > chars), vote(n >= 60 and 100 * stops < 3 * n, 100 * stops >= 3 * n and 10 * stops <= 3 * n), vote(10 * bangs > n), vote(5 * digits > chars),
        vote(n >= 40 and function < 5, function >= 8), vote(n >= 40 and 5 * distinct < n, 10 * distinct >= 3 * n and n >= 40),
    ]


def brute_posterior(all_votes, prior=0.85, share_of_belief=0.05):
    """Expectation-maximisation over the rows themselves, in arrays."""
    v = np.array(all_votes) + 1
    n, rules = v.shape
    one_hot = np.eye(3)[v]
    belief = np.array(label_model.BELIEF)
    weight = share_of_belief * n + 1
    chances, share, good = np.repeat(belief[:, None, :], rules, axis=1), prior, np.full(n, -1.0)
    for _ in range(100):
        logs = np.log(chances)
        odds = math.log(share / (1 - share)) + (one_hot * (logs[1] - logs[0])[None]).sum(axis=(1, 2))
        now = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        moved, good = np.abs(now - good).max(), now
        if moved < 1e-7:
            break
        part = np.stack([1 - good, good])
        tally = np.einsum("sn,nrk->srk", part, one_hot) + weight * belief[:, None, :]
        chances = tally / (part.sum(axis=1) + weight)[:, None, None]
        mass = part.sum(axis=1) + weight * np.array([1 - prior, prior])
        share = mass[1] / mass.sum()
    return good


def test_quality_posterior(spark):
    data = [(i, t) for i, t, _ in clean_and_junk(150)] + [(900, None), (901, ""), (902, "one two"), (903, "A. " * 30)]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    want = brute_posterior([brute_votes(t) for _, t in data])
    for (i, t), q in zip(data, want):
        m = brute_measures(t)
        failed = m[0] < 20 or 100 * m[4] > 30 * m[0]
        assert abs(got[i].posterior - q) < 1e-6 and got[i].kept == (not failed and q >= 0.5)


def brute_quality(texts):
    """The classifier with every distinct text in its sample: votes, posteriors, features and scores of their own."""
    chosen = [1, 2, 3, *range(5, 11)]
    votes_ = [[brute_votes(t)[k] for k in chosen] for t in texts]
    posterior = brute_posterior(votes_)
    soft = {}
    for t, q in zip(texts, posterior):
        if words(t):
            soft[t] = q

    def share(t):
        out = Counter()
        for word in (t or "").encode().split():
            for slot in quality_classifier.slots(word):
                out[slot] += 1
        n = len((t or "").encode().split())
        return sorted((k, c / n) for k, c in out.items())

    return soft, share


def test_quality_classifier_against_its_parts(spark):
    data = [(i, t) for i, t, _ in clean_and_junk(120)] + [(500, None), (501, " ")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    soft, share = brute_quality([t for _, t in data])
    hashed = {r[0]: r[1] for r in docs.select("text", F.xxhash64("text")).collect()}
    order = sorted(soft, key=lambda t: hashed[t])
    rows = [share(t) for t in order]
    weights, bias = quality_classifier.train(
        np.array([len(r) for r in rows]), np.array([k for r in rows for k, _ in r]), np.array([v for r in rows for _, v in r], dtype=np.float32), np.array([soft[t] for t in order])
    )
    for r in quality_classifier.classify(docs, sample=10**9).collect():
        w = (r.text or "").encode().split()
        want = 1 / (1 + math.exp(-(sum(weights[s] for x in w for s in quality_classifier.slots(x)) / len(w) + bias))) if w else 0.0
        assert abs(r.quality - want) < 1e-4 and r.kept == (r.quality >= 0.5)


def test_classifier_sample_counts_texts(spark):
    """A text that makes up most rows is one text of the sample; the others still train the scorer."""
    data = clean_and_junk(300)
    rows = [(i, t) for i, t, _ in data] + [(1000 + i, data[1][1]) for i in range(3000)]
    got = {r.doc_id: r.kept for r in quality_classifier.classify(spark.createDataFrame(rows, "doc_id long, text string"), sample=150).collect()}
    assert np.mean([got[i] == bool(y) for i, _, y in data]) > 0.95


def brute_mix(data):
    """(id, source, size) to copies, by targets found by halving and thresholds found by sorting."""
    sources = sorted({s for _, s, _ in data}, key=lambda s: (s is None, s))
    size = {s: sum(n for _, x, n in data if x == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    low, high = 0.0, 1e12
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * size[s], level * weight[s]) for s in sources) < 1.5 * sum(size.values()) else (low, level)
    out = {}
    for s in sources:
        target = min(2 * size[s], low * weight[s])
        whole = int(target // size[s]) if size[s] else 0
        left, taken = math.floor(target - whole * size[s] + 1e-6), set()
        sums = Counter()
        for i, x, n in data:
            if x == s:
                sums[hashlib.md5(str(i).encode()).hexdigest()[:8]] += n
        for h in sorted(sums):
            if sums[h] > left:
                if 2 * left > sums[h]:
                    taken.add(h)
                break
            taken.add(h)
            left -= sums[h]
        for i, x, n in data:
            if x == s:
                out[i] = whole + (whole < 2 and hashlib.md5(str(i).encode()).hexdigest()[:8] in taken)
    return out


def test_pipeline_against_brute_force(spark, tmp_path):
    """All five stages on rows with nulls, blanks and repeats, each against a version of its own on what the last one kept."""
    import base64

    import corpus_pipeline
    import tiktoken

    data = [(i, t, "en", f"s{i % 4}", len(t)) for i, t, _ in clean_and_junk(60)]
    shared = "the shared line that is the same in many documents, and is long."
    data = [(i, f"{t}\n{shared}" if i % 2 else t, a, b, c) for i, t, a, b, c in data]
    data += [(200 + i, data[1][1], "en", "s1", 1) for i in range(3)] + [(70, None, None, None, None), (71, "", "en", None, 0), (None, data[2][1] + " the end of it.", "en", None, 5), (7, data[7][1], "en", "s3", 1)]
    spark.createDataFrame(data, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE_FILE, "rb"))}
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.select(*corpus_pipeline.COLUMNS).collect()]
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = [tuple(r) for r in docs.collect()]
        if name == "quality_classifier":
            kept = {(r.doc_id, r.text) for r in quality_classifier.classify(spark.createDataFrame(before, SCHEMA)).where("kept").collect()}
            assert sorted(map(repr, after)) == sorted(repr(r) for r in before if (r[0], r[1]) in kept) and all(r[1] and r[1].strip() for r in after)
        if name == "line_dedup":
            assert sorted(map(repr, [r[:2] for r in after])) == sorted(repr((i, t)) for i, _, _, t in brute_lines([r[:2] for r in before]))
            assert all(r[4] == len(r[1]) for r in after) and len(after) == len(before)
        if name == "simhash_near_dedup":
            fps = [brute_fingerprint(r[1]) for r in before]
            root = united(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3])
            best = {}
            for r, g in zip(before, root):
                best[g] = min(best.get(g, (True, 0)), (r[0] is None, r[0] or 0))
            assert sorted((r[0] is None, r[0] or 0) for r in after) == sorted(best.values())
        if name == "source_mixing":
            copies = brute_mix([(r[0] if r[0] is not None else "", r[3], len(words(r[1]))) for r in before])
            want = Counter({r: copies[r[0] if r[0] is not None else ""] for r in before})
            assert Counter(after) == +want
        if name == "byte_bpe":
            want = []
            for r in before:
                ids = theirs.encode_ordinary(r[1])
                want.append((r[0], r[3], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r[1].encode()).hexdigest()))
            assert sorted(map(repr, after)) == sorted(map(repr, want))
    assert sorted(map(repr, map(tuple, docs.collect()))) == sorted(map(repr, map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())))


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
