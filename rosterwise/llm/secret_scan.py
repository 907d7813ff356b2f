"""Secrets: fixed forms, and further tokens that a battery of randomness tests can't tell from noise.

DataFrame functions only. The fixed forms (assignments, access keys, hex runs) give the base spans, which
always stay. Every other long token of letters, digits and joints is a candidate if it has an encoding:
the smallest alphabet that it fits, with digits, and in both cases where the alphabet has both. Three
tests look at its symbols: chi-squared for the uniformity of the alphabet, runs above and below the
middle of the alphabet, and serial correlation of neighbours; Fisher's sum makes one p-value, high
for noise. Each candidate brings a decoy: as many symbols of the same alphabet, read from the prose
beside it. A stratum is an encoding and a band of lengths. The share of decoys of a stratum (and of
shorter ones: what tells short prose tells long) that come as far as a p-value estimates how many
candidates of its own would be there by chance; a stratum's bar is the lowest p-value, never under
ALPHA, at which that is at most FALSE of the candidates kept. So short tokens need much evidence
in the corpus and long ones little.

Cases: a null text is an empty one and has no spans; base spans of different kinds may overlap, added
ones touch no base span; repeated rows get equal spans; without decoys nothing is added; only
doc_id and text are read, so other columns' names can't clash; long texts and tokens take linear time.
"""

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterwise.session import cut_lineage

from .spans import free_of, let, matches

# The forms, written so that a run of characters is entered once and never given back;
# they match what the plain forms match.
_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?"""
BASE = {
    "assign": _ASSIGN + r"[A-Za-z0-9+/_.=-]++",
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
}
HINTS = {"assign": _ASSIGN, "access": "AKIA[A-Z0-9]{16}", "hex": "[0-9a-f]{24}"}
#: Fewest characters of an assigned value.
VALUE_CHARS = 6

#: Encodings from the smallest alphabet up: name, alphabet, what a token must fit.
_UP, _LOW, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_CASES = "(?=.*[A-Z])(?=.*[a-z])"
ENCODINGS = [
    ("hex16", _DIGITS + "abcdef", "(?=.*[a-fA-F])(?:[0-9a-f]+|[0-9A-F]+)"),
    ("base32", _UP + "234567", "(?=.*[A-Z])[A-Z2-7]+"),
    ("base36", _DIGITS + _LOW, "(?=.*[a-z])[0-9a-z]+"),
    ("base62", _DIGITS + _UP + _LOW, _CASES + "[0-9A-Za-z]+"),
    ("base64", _UP + _LOW + _DIGITS + "+/", _CASES + "[0-9A-Za-z+/]+"),
]
KINDS = [*BASE, *[name for name, _, _ in ENCODINGS]]
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+"
TOKEN_HINT = "[A-Za-z0-9+/_-]{20}"
#: Least lengths of the bands.
BANDS = [20, 32, 48, 96]
#: Bins per power of ten of the p-value, and how many there are.
FINE, BINS = 4, 80
#: Lowest p-value of a kept token, and share of false ones among those kept.
ALPHA, FALSE = 0.001, 0.1
#: Characters on either side that a decoy is read from, per symbol of the token, and at most.
PROSE, PROSE_MAX = 8, 4096


def _tail(z: Column) -> Column:
    """Chance that a standard normal value is above ``z`` (logistic approximation, error below 0.0002)."""
    return 1 / (1 + F.exp(z * (1.5976 + 0.070565992 * z * z)))


def _least(p: Column) -> Column:
    return F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-300))


def _uniformity(symbols, alphabet, n, k):
    """p-value of chi-squared over the alphabet, by its exact mean and variance under uniformity."""
    squares = F.aggregate(F.split(alphabet, ""), F.lit(0.0), lambda a, s: a + F.pow(
        n - F.char_length(F.replace(symbols, s, F.lit(""))), F.lit(2.0)
    ))
    return _tail((squares * k / n - n - (k - 1)) / F.sqrt(2.0 * (k - 1) * (n - 1) / n))


def _runs(high, n):
    """p-value of the number of runs of 0 and 1 (Wald and Wolfowitz)."""
    ones = F.char_length(F.replace(high, F.lit("0"), F.lit(""))).cast("double")
    runs = F.char_length(F.regexp_replace(F.regexp_replace(high, "0+", "0"), "1+", "1"))
    both = 2.0 * ones * (n - ones)
    spread = F.sqrt(F.greatest(both * (both - n) / (n * n * (n - 1)), F.lit(1e-9)))
    return F.when((ones == 0) | (ones == n), F.lit(0.0)).otherwise(2 * _tail(F.abs((runs - both / n - 1) / spread)))


def _serial(places, n):
    """p-value of the circular correlation of neighbours."""
    total = F.aggregate(places, F.lit(0.0), lambda a, x: a + x)
    squares = F.aggregate(places, F.lit(0.0), lambda a, x: a + x * x)
    turned = F.concat(F.slice(places, F.lit(2), F.size(places) - 1), F.slice(places, 1, 1))
    products = F.aggregate(F.zip_with(places, turned, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    spread = n * squares - total * total
    r = (n * products - total * total) / F.greatest(spread, F.lit(1e-9))
    z = (r + 1 / (n - 1)) * (n - 1) * F.sqrt(n - 2) / n
    return F.when(spread == 0, F.lit(0.0)).otherwise(2 * _tail(F.abs(z)))


def randomness(symbols: Column, alphabet: Column) -> Column:
    """Combined p-value of the three tests that ``symbols`` (20 and more) are noise over ``alphabet``."""

    def tested(s):
        n, k = F.char_length(s).cast("double"), F.char_length(alphabet).cast("double")
        chars = F.filter(F.split(s, ""), lambda c: c != "")
        places = F.transform(chars, lambda c: (F.instr(alphabet, c) - 1).cast("double"))
        middle = F.floor(k / 2)
        return let(places, lambda p: let(
            F.array_join(F.transform(p, lambda x: F.when(x < middle, "0").otherwise("1")), ""),
            lambda h: _fisher(_uniformity(s, alphabet, n, k), _runs(h, n), _serial(p, n)),
        ))

    return let(symbols, tested)


def _fisher(*tests):
    x = -sum((F.log(_least(p)) for p in tests), F.lit(0.0))
    return let(x, lambda v: F.exp(-v) * (1 + v + v * v / 2))


def _bin(p):
    return F.least(F.floor(-FINE * F.log10(_least(p))), F.lit(BINS)).cast("int")


def _by_encoding(number: Column, values) -> Column:
    """``values[number]``, each a column."""
    out = F.lit(None)
    for i, value in reversed(list(enumerate(values))):
        out = F.when(number == i, value).otherwise(out)
    return out


def _symbols(number: Column, text: Column) -> Column:
    """``text`` read in the alphabet of an encoding: folded to its case, all else left out."""
    folded = [F.lower(text), F.upper(text), F.lower(text), text, F.translate(text, "-_", "+/")]
    return _by_encoding(number, [
        F.regexp_replace(plain, f"[^{alphabet}]", "") for plain, (_, alphabet, _) in zip(folded, ENCODINGS)
    ])


def _judged(match: Column) -> Column:
    """Struct of a token match: start, kind, end, encoding, band, bin, decoy (the bin of its decoy, or null)."""
    hit = match["hit"]
    joined = F.translate(hit, "-_", "+/")
    number = F.lit(None).cast("int")
    for i, (_, _, form) in reversed(list(enumerate(ENCODINGS))):
        number = F.when(joined.rlike(f"^(?=.*[0-9]){form}$"), F.lit(i)).otherwise(number)

    def described(e):
        alphabet = _by_encoding(e, [F.lit(a) for _, a, _ in ENCODINGS])
        n = F.char_length(hit)
        wide = F.least(n * PROSE, F.lit(PROSE_MAX))
        prose = F.left(_symbols(e, F.concat(F.right(match["before"], wide), F.left(match["after"], wide))), n)
        band = sum((F.when(n >= b, 1).otherwise(0) for b in BANDS), F.lit(-1))
        decoy = let(prose, lambda p: F.when(F.char_length(p) == n, _bin(randomness(p, alphabet))))
        return F.struct(
            match["start"].alias("start"), (e + len(BASE)).alias("kind"), match["end"].alias("end"), e.alias("encoding"),
            band.alias("band"), F.when(e.isNotNull(), _bin(randomness(_symbols(e, hit), alphabet))).alias("bin"),
            F.when(e.isNotNull(), decoy).alias("decoy"),
        )

    return let(number, described)


def _valid(kind):
    def long_enough(match):
        return F.char_length(F.regexp_replace(match["hit"], f"^(?:{_ASSIGN})", "")) >= VALUE_CHARS

    return long_enough if kind == "assign" else lambda match: F.lit(True)


def _as_span(number):
    return lambda match: F.struct(match["start"].alias("start"), F.lit(number).alias("kind"), match["end"].alias("end"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base (structs of start, kind, end, sorted) and loose (the candidates, judged) of each text."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for number, (kind, pattern) in enumerate(BASE.items()):
        rows = matches(rows, "found", "text", pattern, HINTS[kind], 0, 0)
        rows = rows.withColumn(kind, F.transform(F.filter("found", _valid(kind)), _as_span(number))).drop("found")
    rows = matches(rows, "found", "text", TOKEN, TOKEN_HINT, PROSE_MAX, PROSE_MAX)
    rows = rows.withColumn("base", F.array_sort(F.concat(*BASE)))
    encoded = F.filter("found", lambda m: F.translate(m["hit"], "-_", "+/").rlike(_ENCODED))
    loose = let(free_of(encoded, F.col("base")), lambda free: F.transform(free, _judged))
    return rows.select("doc_id", "base", loose.alias("loose"))


_ENCODED = "^(?=.*[0-9])(?:" + "|".join(form for _, _, form in ENCODINGS) + ")$"


def bars(counts) -> dict:
    """{(encoding, band): greatest bin that is kept} from (encoding, band, bin, decoy bin or null, count)."""
    hits, decoys = defaultdict(lambda: [0] * (BINS + 1)), defaultdict(lambda: [0] * (BINS + 1))
    for encoding, band, at, decoy, n in counts:
        hits[encoding, band][at] += n
        if decoy is not None:
            for longer in range(band, len(BANDS)):
                decoys[encoding, longer][decoy] += n
    found = {}
    for stratum, own in sorted(hits.items()):
        other, kept, passed = decoys[stratum], 0, 0
        for at in range(round(-FINE * math.log10(ALPHA))):
            kept, passed = kept + own[at], passed + other[at]
            chance = (passed + 1) / (sum(other) + 1)
            if own[at] and chance * sum(own) <= FALSE * kept:
                found[stratum] = at
    return found


def learn(found: DataFrame) -> dict:
    """``bars`` of all candidates of the corpus; their counts by stratum and bins are a closed set."""
    names = ["encoding", "band", "bin", "decoy"]
    each = found.select(F.explode("loose").alias("s")).groupBy(*[F.col(f"s.{n}").alias(n) for n in names]).count()
    return bars([(r["encoding"], r["band"], r["bin"], r["decoy"], r["count"]) for r in each.collect()])


def secret_spans(kept: dict) -> Column:
    """All spans (start, kind, end) of a row of ``scan``, sorted: the base ones and the candidates under their bar."""

    def good(s):
        bar = F.lit(-1)
        for (encoding, band), top in kept.items():
            bar = F.when((s["encoding"] == encoding) & (s["band"] == band), F.lit(top)).otherwise(bar)
        return s["bin"] <= bar

    added = F.transform(F.filter("loose", good), lambda s: F.struct(s["start"], s["kind"], s["end"]))
    return F.array_sort(F.concat("base", added))


def _listed(spans):
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind[s["kind"]], s["start"], s["end"])), ",")


def _of_kind(number):
    return lambda span: span["kind"] == number


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base spans by kind, digest of the base spans, all spans."""
    found = cut_lineage(scan(docs))
    counts = [F.size(F.filter("base", _of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    spans = secret_spans(learn(found))
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(spans).alias("spans"))
