"""Secret scans: three fixed patterns and a randomness test battery.

Beside the patterns, tokens that look encoded (hex, base32, base64) are tested for randomness over the alphabet of
their encoding: a chi-squared test of uniformity, a runs test about the middle of the alphabet and a test of serial
correlation, joined by Fisher's method, and with them a test of the bytes that the token decodes to: the top bit of random
bytes is set in half of them, that of encoded text hardly ever; and a chi-squared test of the classes of characters, which
names made of words fail. A real key passes; a readable name and encoded prose do not.

How small a p-value still counts as random is set for each encoding and band of lengths from all tokens of the corpus: with
the share of random tokens taken from the upper half of the p-values (which are uniform for random tokens), the cut is the
lowest at which no more than ``FALSE_SHARE`` of the accepted tokens are expected not to be random, beyond what the noise of
so many counts explains. So a few tokens alone never move the cut, and a group in which other tokens pass the battery
loses random ones rather than the control.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendframe.llm.common import let, merged, stored, unused

KINDS = ("assign", "access", "hex", "random")
ASSIGN = "(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
#: What may be an encoded key: a run of its characters of at least 20, not part of a longer run.
CANDIDATE = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
#: Alphabets in code order, with what a token of the encoding looks like and its least length.
ENCODINGS = (
    ("hex", "0123456789abcdef", "^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", 24),
    ("HEX", "0123456789ABCDEF", "^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", 24),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+$", 26),
    (
        "base64",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
        "^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9+/_-]+$",
        20,
    ),
)
P_BINS = 100
FALSE_SHARE = 0.05
BANDS = (32, 48, 80, 160)
#: The lowest cut, which loses one random token in a hundred, and the standard errors that a count may be off.
PRIOR_CUT, NOISE = 0.01, 1.64
#: Where the top bits of decoded bytes are: for each encoding the characters of a period, and the bit of each that holds one.
TOP_BITS = ((2, {0: 3}), (2, {0: 3}), (8, {0: 4, 1: 1, 3: 3, 4: 0, 6: 2}), (4, {0: 5, 1: 3, 2: 1}))


def running(values: Column) -> Column:
    """Running totals of a non-empty int array, in stretches of 64 whose offsets are summed apart."""
    add = lambda a, b: a + b
    stretches = let(
        values,
        lambda v: F.transform(
            F.sequence(F.lit(0), ((F.size(v) - 1) / 64).cast("int")), lambda k: F.slice(v, k * 64 + 1, F.lit(64))
        ),
    )
    return let(
        stretches,
        lambda all_: let(
            F.transform(all_, lambda s: F.aggregate(s, F.lit(0), add)),
            lambda sums: F.flatten(
                F.transform(
                    all_,
                    lambda s, k: let(
                        F.aggregate(F.slice(sums, F.lit(1), k), F.lit(0), add),
                        lambda base: F.transform(s, lambda x, i: F.aggregate(F.slice(s, F.lit(1), i + 1), base, add)),
                    ),
                )
            ),
        ),
    )


def matches(text: Column, pattern: str, kind: int, least: int, group: int = 0) -> Column:
    """array<struct<start,kind,end,token>> of the leftmost non-overlapping matches, in code points.

    ``least``: the least length of ``group``; shorter matches are dropped after matching.
    """
    empty = F.array().cast("array<struct<start:int,kind:int,end:int,token:string>>")

    def found(all_matches: Column) -> Column:
        pieces = F.split(text, pattern, -1)
        steps = let(
            F.struct(pieces.alias("p"), all_matches.alias("m")),
            lambda x: F.transform(x["p"], lambda piece, i: F.length(piece) + F.coalesce(F.length(F.get(x["m"], i - 1)), F.lit(0))),
        )
        tested = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else all_matches
        return let(
            F.struct(running(steps).alias("at"), all_matches.alias("m"), tested.alias("g")),
            lambda x: F.transform(
                F.filter(
                    F.transform(x["m"], lambda m, i: F.struct(m.alias("m"), F.get(x["at"], i).alias("at"), F.length(F.get(x["g"], i)).alias("n"))),
                    lambda y: y["n"] >= least,
                ),
                lambda y: F.struct(
                    y["at"].alias("start"), F.lit(kind).alias("kind"), (y["at"] + F.length(y["m"])).alias("end"), y["m"].alias("token")
                ),
            ),
        )

    # texts without a match of the length asked for, most of them, are scanned once
    return F.when(~text.rlike(pattern), empty).otherwise(let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found))


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, by a polynomial good to 1e-7."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    tail = poly * F.exp(-x * x) / 2
    return F.when(z >= 0, tail).otherwise(1 - tail)


def randomness(token: Column, alphabet: str) -> Column:
    """p-value of the battery for one token over an alphabet; small: not random."""
    k = len(alphabet)
    clean = F.translate(token, "-_", "+/") if k == 64 else token
    codes = F.transform(F.split(clean, ""), lambda c: F.instr(F.lit(alphabet), c) - 1)

    def battery(x: Column) -> Column:
        n = F.size(x).cast("double")
        ordered = F.sort_array(x)
        pairs = let(
            ordered,
            lambda a: F.aggregate(
                F.transform(a, lambda v, i: F.struct(v.alias("v"), F.get(a, i - 1).alias("u"))),
                F.struct(F.lit(0).alias("run"), F.lit(0).alias("squares")),
                # a run of c equal codes adds 1 + 3 + 5 + ... = c * c
                lambda s, y: let(
                    F.when(y["u"] == y["v"], s["run"] + 1).otherwise(F.lit(1)),
                    lambda run: F.struct(run.alias("run"), (s["squares"] + 2 * run - 1).alias("squares")),
                ),
                lambda s: s["squares"].cast("double"),
            ),
        )
        chi = pairs * k / n - n
        z_chi = (chi - (k - 1)) / F.sqrt(2.0 * (k - 1) * (1 - 1 / n))
        total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
        high = F.transform(x, lambda v: (v >= k // 2).cast("int"))
        n1 = total(F.transform(high, lambda h: h.cast("double")))
        runs = let(high, lambda h: 1 + total(F.transform(h, lambda v, i: (F.coalesce(F.get(h, i - 1), v) != v).cast("double"))))
        expect = 2 * n1 * (n - n1) / n + 1
        spread = (expect - 1) * (expect - 2) / (n - 1)
        z_runs = F.when(spread > 0, (runs - expect) / F.sqrt(spread)).otherwise(F.lit(9.0))
        mean = total(F.transform(x, lambda v: v.cast("double"))) / n
        return let(
            F.struct(x.alias("x"), mean.alias("mean"), n.alias("n"), z_chi.alias("z_chi"), z_runs.alias("z_runs")),
            lambda s: let(
                F.struct(
                    total(F.transform(s["x"], lambda v: (v - s["mean"]) * (v - s["mean"]))).alias("all"),
                    total(
                        F.transform(
                            s["x"], lambda v, i: (v - s["mean"]) * F.coalesce(F.get(s["x"], i + 1) - s["mean"], F.lit(0.0))
                        )
                    ).alias("next"),
                ),
                lambda c: let(
                    F.when(c["all"] > 0, (c["next"] / c["all"] + 1 / s["n"]) * F.sqrt(s["n"])).otherwise(F.lit(9.0)),
                    lambda z_serial: _fisher(
                        [_upper_tail(s["z_chi"]), 2 * _upper_tail(F.abs(s["z_runs"])), 2 * _upper_tail(F.abs(z_serial))]
                    ),
                ),
            ),
        )

    return let(codes, battery)


def decoded(token: Column, alphabet: str, code: int) -> Column:
    """Two-sided p-value of the number of decoded bytes whose top bit is set, one half of them in random bytes."""
    clean = F.translate(token, "-_", "+/") if len(alphabet) == 64 else token
    period, places = TOP_BITS[code]

    def top(c: Column, i: Column) -> Column:
        value, out = F.instr(F.lit(alphabet), c) - 1, F.lit(0)
        for at, bit in places.items():
            out = F.when(i % period == at, 1 - 2 * (F.floor(value / (1 << bit)) % 2)).otherwise(out)
        return out

    # clear bits count 1, set ones -1
    balance = F.aggregate(F.transform(F.split(clean, ""), top), F.lit(0.0), lambda a, v: a + v)
    n = sum((F.ceil((F.length(token) - at) / period) for at in places), F.lit(0))
    return 2 * _upper_tail(F.abs(balance) / F.sqrt(n))


def classes(token: Column, alphabet: str) -> Column:
    """p-value of the counts of upper-case, lower-case and other characters against their shares of the alphabet."""
    n = F.length(token)
    counts, held = [], F.lit(0)
    for found, kind in (("[A-Z]", str.isupper), ("[a-z]", str.islower)):
        share = sum(map(kind, alphabet)) / len(alphabet)
        if share:
            counts.append((n - F.length(F.regexp_replace(token, found, "")), share))
            held = held + counts[-1][0]
    counts.append((n - held, 1 - sum(share for _, share in counts)))
    x = sum(((c - n * share) * (c - n * share) / (n * share) for c, share in counts), F.lit(0.0))
    # chi-squared with two degrees of freedom, or one
    return F.exp(-x / 2) if len(counts) == 3 else 2 * _upper_tail(F.sqrt(x))


def _fisher(p_values: list[Column]) -> Column:
    """Combined p-value of three tests: the tail of chi-squared with six degrees of freedom."""
    half = sum((-F.log(F.greatest(p, F.lit(1e-15))) for p in p_values), F.lit(0.0))
    return let(half, lambda h: F.exp(-h) * (1 + h + h * h / 2))


def band(length: Column) -> Column:
    out = F.lit(0)
    for edge in BANDS:
        out = out + (length >= edge).cast("int")
    return out


def candidates(text: Column) -> Column:
    """array<struct<start,kind,end,token,code,band,p>>: what the battery was run on."""
    found = matches(text, CANDIDATE, KINDS.index("random"), 20)

    def encoding(token: Column) -> Column:
        out = F.lit(-1)
        for code, (_, _, shape, least) in reversed(list(enumerate(ENCODINGS))):
            out = F.when(token.rlike(shape) & (F.length(token) >= least), code).otherwise(out)
        return out

    def tested(row: Column) -> Column:
        p = F.lit(None).cast("double")
        for code, (_, alphabet, _, _) in enumerate(ENCODINGS):
            token = row["s"]["token"]
            both = _fisher([randomness(token, alphabet), decoded(token, alphabet, code), classes(token, alphabet)])
            p = F.when(row["code"] == code, both).otherwise(p)
        s = row["s"]
        return F.struct(
            s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["token"].alias("token"),
            row["code"].alias("code"), band(F.length(s["token"])).alias("band"), p.alias("p"),
        )

    coded = F.transform(found, lambda s: F.struct(s.alias("s"), encoding(s["token"]).alias("code")))
    return F.transform(F.filter(coded, lambda row: row["code"] >= 0), tested)


def estimates(counts: list[int]) -> list[tuple[int, float, float]]:
    """counts by p bin: for each cut up to one half, the tokens accepted, those expected not to be random, and the noise of that."""
    random = 2 * sum(counts[P_BINS // 2 :])
    out = []
    for at in range(P_BINS // 2 + 1):
        accepted = sum(counts[at:])
        out.append((accepted, accepted - random * (1 - at / P_BINS), math.sqrt(accepted + 2 * random)))
    return out


def cuts(bins: list[tuple[int, int, int, int]]) -> dict[tuple[int, int], float]:
    """bins: (code, band, p bin, tokens), at most encodings x bands x bins of them. The least p accepted of each group."""
    groups: dict[tuple[int, int], list[int]] = {}
    for code, length, at, n in bins:
        groups.setdefault((code, length), [0] * P_BINS)[at] += n
    out = {}
    for key, counts in groups.items():
        held = (at for at, (n, wrong, noise) in enumerate(estimates(counts)) if at / P_BINS >= PRIOR_CUT and wrong <= FALSE_SHARE * n + NOISE * noise)
        out[key] = next(held, P_BINS // 2) / P_BINS
    return out


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every column of ``docs`` but the text, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256`` and ``spans``.

    ``spans``: kind:start:end of all secrets by start, then kind, joined by commas; code points, end exclusive. A
    random token within a pattern's span is not given again. Input columns of these names are replaced.

    Defined results: a NULL text counts as empty and has no spans. Texts of any length are read whole. Rows are scanned by themselves; repeated rows repeat
    their results and count in the choice of the cuts. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    fixed, random = unused(docs, "base", "random")
    base = F.concat(
        matches(text, ASSIGN, 0, 8, 2), matches(text, ACCESS, 1, 16),
        F.when(text.rlike(HEX[:-1] + "{32}"), matches(text, HEX[:-1] + "{32,}", 2, 32)).otherwise(
            F.array().cast("array<struct<start:int,kind:int,end:int,token:string>>")
        ),
    )
    plain = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    scanned = stored(
        docs.select(
            *[F.col(f"`{c}`") for c in docs.columns if c != text_col],
            F.sort_array(plain).alias(fixed), candidates(text).alias(random),
        ),
        "secret-spans",
    )
    histogram = (
        scanned.select(F.inline(random))
        .groupBy("code", "band", F.least(F.floor(F.col("p") * P_BINS), F.lit(P_BINS - 1)).cast("int").alias("at"))
        .count().collect()
    )
    limit = F.lit(2.0)
    least = cuts([tuple(r) for r in histogram])

    def accepted(row: Column) -> Column:
        out = limit
        for (code, length), cut in sorted(least.items()):
            out = F.when((row["code"] == code) & (row["band"] == length), F.lit(cut)).otherwise(out)
        return row["p"] >= out

    base = F.col(fixed)
    extra = F.transform(
        F.filter(
            F.col(random),
            lambda r: accepted(r) & ~F.exists(base, lambda b: (b["start"] <= r["start"]) & (b["end"] >= r["end"])),
        ),
        lambda r: F.struct(r["start"].alias("start"), r["kind"].alias("kind"), r["end"].alias("end")),
    )
    name = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name[s["kind"]], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    return merged(
        scanned,
        {
            "n_assign": count(0), "n_access": count(1), "n_hex": count(2),
            "base_sha256": F.sha2(joined(base).cast("binary"), 256),
            "spans": joined(F.sort_array(F.concat(base, extra))),
        },
    ).drop(fixed, random)
