"""Secret scans, in DataFrame operations only.

Base: three regular expressions. Beside them, long tokens go through a battery of randomness tests over the
alphabet of the encoding that they seem to use, its characters in order of how common they are in writing:
chi-squared uniformity, runs above and below the alphabet's middle, and serial correlation. Each test is read
two ways.

- Against randomness: a token that any of the three calls not random is left alone.
- Against writing: under a model of writing over the same alphabet (fixed shares of letters, capitals, digits and
  signs, characters drawn one by one) each statistic has a known mean and deviation. How far towards randomness a
  token lies gives three p-values, by the normal distribution; they are combined by the Cauchy combination, which
  holds for small p-values however the tests depend on each other.

The combined p-values are what the Benjamini-Hochberg procedure controls, within classes of length: a long token
has more power, and short ones do not share their errors with it. Tokens of one alphabet are compared with writing
over that alphabet alone, so having chosen an alphabet by the token's characters gives no evidence by itself.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Patterns and the fewest characters that count (fixed values).
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # 18 characters and more: a shorter run cannot hold a longer match
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"  # whole runs only, as a greedy match takes them
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")

#: Shares of letters in ordinary writing, in order (fixed values).
LETTERS = dict(zip("etaoinshrdlcumwfgypbvkjxqz", (0.127, 0.091, 0.082, 0.075, 0.070, 0.067, 0.063, 0.061, 0.060, 0.043, 0.040, 0.028, 0.028, 0.024, 0.024, 0.022, 0.020, 0.020, 0.019, 0.015, 0.010, 0.008, 0.0015, 0.0015, 0.001, 0.001), strict=True))
DIGITS, SIGNS = "0123456789", "/_-+"
#: Weights of small letters, capitals, digits and signs in writing, where an alphabet has them (fixed values).
WEIGHTS = (0.80, 0.10, 0.08, 0.02)

#: Encodings by what a token holds, the narrowest first: pattern and characters.
ENCODINGS = [
    (r"^[0-9]+$", DIGITS),
    (r"^[0-9a-f]+$", "abcdef" + DIGITS),
    (r"^[0-9A-F]+$", "ABCDEF" + DIGITS),
    (r"^[a-z]+$", "".join(LETTERS)),
    (r"^[A-Z]+$", "".join(LETTERS).upper()),
    (r"^[A-Z2-7]+$", "".join(LETTERS).upper() + "234567"),
    (r"^[a-z0-9]+$", "".join(LETTERS) + DIGITS),
    (r"^[A-Z0-9]+$", "".join(LETTERS).upper() + DIGITS),
    (r"^[A-Za-z]+$", "".join(LETTERS) + "".join(LETTERS).upper()),
    (r"^[A-Za-z0-9]+$", "".join(LETTERS) + "".join(LETTERS).upper() + DIGITS),
    (r"^[A-Za-z0-9+/]+$", "".join(LETTERS) + "".join(LETTERS).upper() + DIGITS + "/+"),
    (r"^", "".join(LETTERS) + "".join(LETTERS).upper() + DIGITS + SIGNS),
]
BINS = 80  # p-values below e ** -BINS count as that
BLOCK = 256  # matches that one fold adds up

ENTRY = "struct<start:int,end:int,kind:int,value:string>"


def writing(alphabet: str) -> dict[str, float]:
    """The model of writing over an alphabet, as what the three tests need, with the alphabet in order of commonness."""
    groups = [[c for c in alphabet if c.islower()], [c for c in alphabet if c.isupper()], [c for c in alphabet if c.isdigit()], [c for c in alphabet if not c.isalnum()]]
    share = {}
    for weight, group in zip(WEIGHTS, groups, strict=True):
        own = [LETTERS.get(c.lower(), 1.0) for c in group]
        share |= {c: weight * x / sum(own) for c, x in zip(group, own, strict=True)}
    total = sum(share.values())
    ordered = sorted(share, key=lambda c: (-share[c], c))
    p = [share[c] / total for c in ordered]
    k, middle = len(p), (len(p) - 1) / 2
    above = sum(x for i, x in enumerate(p) if i > middle)
    return {
        "k": float(k), "ic": sum(x**2 for x in p), "cubes": sum(x**3 for x in p), "both": above * (1 - above),
        "m1": sum(x * (i - middle) for i, x in enumerate(p)), "m2": sum(x * (i - middle) ** 2 for i, x in enumerate(p)), "alphabet": "".join(ordered)}


MODELS = [writing(a) for _, a in ENCODINGS]


def running(values: Column, add) -> Column:
    """What add makes, from 0 on, of all values before each and of itself: blocks are added up first, so that a long array
    takes little more than linear time. The first value has 0 before it."""
    count = F.ceil(F.size(values) / BLOCK).cast("int")
    blocks = F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice(values, b * BLOCK + 1, BLOCK))).otherwise(F.array().cast("array<array<int>>"))

    def before(own: Column, start: Column) -> Column:
        return F.aggregate(
            own, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")),
            lambda a, x: F.struct(add(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])

    def sums(parts: Column) -> Column:
        totals = before(F.transform(parts, lambda p: F.aggregate(p, F.lit(0), add)), F.lit(0))
        return F.flatten(F.zip_with(parts, totals, before))

    return let(blocks, sums)


def spans(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0) -> Column:
    """Leftmost non-overlapping matches as ``struct<start, end, kind, value>`` in code points, end exclusive.

    The pieces between matches give the places: a match starts after all pieces and matches before it.
    """
    k = KINDS.index(kind)

    def placed(found: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(found)), lambda g: F.length(g))
        both = F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("gap"), F.length(m).alias("n"), m.alias("m")))
        value = (lambda m: F.regexp_extract(m, pattern, group)) if group else (lambda m: m)

        def entries(b: Column) -> Column:
            at = running(F.transform(b, lambda x: x["gap"] + x["n"]), lambda x, y: x + y)
            return F.zip_with(at, b, lambda s, x: F.struct((s + x["gap"]).alias("start"), (s + x["gap"] + x["n"]).alias("end"), F.lit(k).alias("kind"), value(x["m"]).alias("value")))

        return let(both, entries)

    none = F.array().cast(f"array<{ENTRY}>")
    out = F.when(F.rlike(text, F.lit(pattern)), let(F.regexp_extract_all(text, F.lit(pattern), 0), placed)).otherwise(none)
    return F.filter(out, lambda s: F.length(s["value"]) >= least) if least else out


def _upper_tail(z: Column) -> Column:
    """P(N(0,1) > z), by the rational approximation 26.2.17 of Abramowitz and Stegun, for z >= 0 (and 1 minus it below)."""
    poly = lambda t: t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = let(F.lit(1.0) / (1 + F.abs(z) * 0.2316419), poly) * F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return let(tail, lambda x: F.when(z >= 0, x).otherwise(1 - x))


def battery(token: Column) -> Column:
    """``struct<n, uniform, runs, serial, p>`` of one token: its length without padding, the p-values of the three tests
    against randomness, and their combined p-value against writing."""
    return let(F.regexp_replace(token, "=+$", ""), lambda body: let(_model(body), lambda m: let(_statistics(body, m), lambda s: _p_values(s, m))))


def _model(body: Column) -> Column:
    """The model of writing over the narrowest alphabet that has all of a token's characters."""
    of = lambda m: F.struct(*(F.lit(v).alias(c) for c, v in m.items()))
    return reduce(lambda rest, e: F.when(F.rlike(body, F.lit(e[0][0])), of(e[1])).otherwise(rest), list(zip(ENCODINGS, MODELS, strict=True))[-2::-1], of(MODELS[-1]))


def _statistics(body: Column, m: Column) -> Column:
    """Coincidences (the pairs of equal characters), changes across the middle, and products of neighbours' distances from it."""
    n = F.length(body).cast("double")
    count = lambda i: (F.length(body) - F.length(F.replace(body, F.substr(m["alphabet"], i, F.lit(1)), F.lit("")))).cast("double")
    pairs = F.aggregate(F.transform(F.sequence(F.lit(1), m["k"].cast("int")), count), F.lit(0.0), lambda a, c: a + c * (c - 1))
    middle = (m["k"] + 1) / 2
    ranks = F.transform(F.slice(F.split(body, ""), 1, F.length(body)), lambda c: F.position(c, m["alphabet"]) - middle)
    walk = F.aggregate(
        ranks,
        F.struct(F.lit(None).cast("double").alias("last"), F.lit(0.0).alias("changes"), F.lit(0.0).alias("serial")),
        lambda a, x: F.struct(
            x.alias("last"),
            (a["changes"] + F.when(a["last"].isNotNull() & ((x > 0) != (a["last"] > 0)), 1.0).otherwise(0.0)).alias("changes"),
            (a["serial"] + F.coalesce(x * a["last"], F.lit(0.0))).alias("serial")))
    return F.struct(n.alias("n"), pairs.alias("pairs"), walk["changes"].alias("changes"), walk["serial"].alias("serial"))


def _moments(n: Column, ic: Column, cubes: Column, both: Column, m1: Column, m2: Column) -> list[tuple[Column, Column]]:
    """Mean and variance of the share of coincidences, of changes and of serial products, for n characters drawn one by one."""
    pairs = n * (n - 1)
    return [
        (ic, (ic * (1 - ic) + 2 * (n - 2) * (cubes - ic * ic)) * 2 / pairs),
        ((n - 1) * 2 * both, (n - 1) * 2 * both * (1 - 2 * both) + 2 * (n - 2) * (both - 4 * both * both)),
        ((n - 1) * m1 * m1, (n - 1) * (m2 * m2 - m1 * m1 * m1 * m1) + 2 * (n - 2) * m1 * m1 * (m2 - m1 * m1)),
    ]


def _p_values(s: Column, m: Column) -> Column:
    n, k = s["n"], m["k"]
    seen = [s["pairs"] / (n * (n - 1)), s["changes"], s["serial"]]
    low = F.floor(k / 2)  # random characters: so many of k stand above the middle
    even = _moments(n, 1 / k, 1 / (k * k), low * (k - low) / (k * k), F.lit(0.0), (k * k - 1) / 12)
    z = lambda moments: [(x - mean) / F.sqrt(F.greatest(var, F.lit(1e-12))) for x, (mean, var) in zip(seen, moments, strict=True)]
    random = z(even)
    coincidences, changes, serial = z(_moments(n, m["ic"], m["cubes"], m["both"], m["m1"], m["m2"]))
    # random tokens have fewer coincidences, more changes and smaller products than writing
    tails = F.transform(F.array(random[0], F.abs(random[1]), F.abs(random[2]), -coincidences, changes, -serial), _upper_tail)

    def combined(p: Column) -> Column:
        # tan((1/2 - p) pi) is 1 / (p pi) for small p
        heavy = lambda x: F.when(x < 1e-6, 1 / (F.greatest(x, F.lit(math.exp(-BINS))) * math.pi)).otherwise(F.tan((0.5 - F.least(x, F.lit(1 - 1e-6))) * math.pi))
        mean = F.aggregate(F.transform(F.slice(p, 4, 3), heavy), F.lit(0.0), lambda a, x: a + x / 3)
        return F.struct(
            n.alias("n"), p[0].alias("uniform"), (2 * p[1]).alias("runs"), (2 * p[2]).alias("serial"),
            let(mean, lambda x: F.when(x > 1e5, 1 / (x * math.pi)).otherwise(0.5 - F.atan(x) / math.pi)).alias("p"))

    return let(tails, combined)


def length_class(n: Column) -> Column:
    """0 to 6 by the binary logarithm of the length."""
    return F.least(F.lit(6), F.greatest(F.lit(0), F.floor(F.log2(n)) - 4)).cast("int")


def p_bin(p: Column) -> Column:
    """-ln p rounded down, from 0 to BINS."""
    return F.least(F.lit(BINS), F.floor(-F.log(F.greatest(p, F.lit(math.exp(-BINS - 1)))))).cast("int")


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Long tokens of all rows with their tests: ``token, t``."""
    found = docs.filter(F.rlike(F.col(text), F.lit(CANDIDATE))).select(F.explode(F.regexp_extract_all(F.col(text), F.lit(CANDIDATE), 0)).alias("token"))
    return found.select("token", battery(F.col("token")).alias("t"))


def significant(counts: list[tuple[int, int, int]], rate: float) -> dict[int, int]:
    """The bin of p-values from which tokens of each length class are taken, from counts by class and bin.

    Of a class's m candidates the k of smallest p are taken for the largest k whose largest p is at most k rate / m.
    A bin's p-values count as its largest.
    """
    limits = {}
    for c in {r[0] for r in counts}:
        own = sorted(((b, n) for k, b, n in counts if k == c), reverse=True)
        m, k = sum(n for _, n in own), 0
        for b, n in own:
            k += n
            if math.exp(-b) <= k * rate / m:
                limits[c] = b
    return limits


def p_limits(docs: DataFrame, text: str = "text", rate: float = 0.01) -> dict[int, int]:
    """What significant gives over all rows of docs. The counts by class and bin are at most 7 by BINS + 1 rows."""
    counts = candidates(docs, text).groupBy(length_class(F.col("t.n")).alias("c"), p_bin(F.col("t.p")).alias("b")).count().collect()
    return significant([(r["c"], r["b"], r["count"]) for r in counts], rate)


def scan_secrets(docs: DataFrame, text: str = "text", rate: float = 0.01, alpha: float = 0.001) -> DataFrame:
    """Every row of docs with ``secret_spans array<struct<start, end, kind, value>>``, by start, then kind.

    kind is an index into KINDS; places are in code points, end exclusive. ``rate`` bounds the share of false
    discoveries among random tokens, ``alpha`` is the level at which one of the three tests calls a token
    not random. A random token within a base span is not listed again. A null or empty text has no spans, an empty
    table gives no rows, rows that repeat get equal results. A text dense in tokens takes little more than linear
    time; a long one is worked on whole. A column of docs named ``secret_spans`` is replaced, others stay.
    """
    kept = [c for c in docs.columns if c != "secret_spans"]
    limits = p_limits(docs, text, rate)
    body = F.coalesce(F.col(text), F.lit(""))
    base = F.concat(spans(body, ASSIGN, "assign", 2, 12), spans(body, ACCESS, "access"), spans(body, HEX, "hex"))

    def strong(t: Column) -> Column:
        least = F.lit(BINS + 1)
        for c, b in sorted(limits.items()):
            least = F.when(length_class(t["n"]) == c, F.lit(b)).otherwise(least)
        return (t["uniform"] >= alpha) & (t["runs"] >= alpha) & (t["serial"] >= alpha) & (p_bin(t["p"]) >= least)

    random = KINDS.index("random")
    listed = docs.select(F.struct(*docs.columns).alias("_row"), F.array_sort(F.concat(base, spans(body, CANDIDATE, "random"))).alias("_spans"))

    def chosen(found: Column) -> Column:
        """Base spans, and of the long tokens those that no base span before them reaches to the end of."""
        reach = running(F.transform(found, lambda s: F.when(s["kind"] == random, 0).otherwise(s["end"])), lambda x, y: F.greatest(x, y))
        new = lambda x: (x["reach"] < x["s"]["end"]) & let(battery(x["s"]["value"]), strong) if limits else F.lit(False)
        both = F.zip_with(found, reach, lambda s, r: F.struct(s.alias("s"), r.alias("reach")))
        return F.transform(F.filter(both, lambda x: F.when(x["s"]["kind"] == random, new(x)).otherwise(True)), lambda x: x["s"])

    return listed.select(*(F.col(f"_row.`{c}`") for c in kept), F.when(F.size("_spans") > 0, let(F.col("_spans"), chosen)).otherwise(F.col("_spans")).alias("secret_spans"))


def redact(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """The text with every listed span, overlapping ones as one, replaced by a mark; spans are in order of their start."""
    before = running(F.transform(found, lambda s: s["end"]), lambda x, y: F.greatest(x, y))
    apart = F.filter(F.zip_with(found, before, lambda s, b: F.struct(b.alias("from"), s["start"].alias("to"))), lambda p: p["to"] >= p["from"])
    kept = F.array_join(F.transform(apart, lambda p: F.substr(text, p["from"] + 1, p["to"] - p["from"])), mark)
    rest = F.substr(text, F.array_max(F.transform(found, lambda s: s["end"])) + 1)
    return F.when(F.size(found) > 0, F.concat(kept, F.lit(mark), rest)).otherwise(text)


def listing(found: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
