"""Personal data by weak supervision: labelers vote on spans, EM weighs them, a classifier decides.

DataFrame functions only. Strict patterns with checks (ranges, Luhn, digit counts) give the base spans,
which always stay. Looser patterns give further candidates: masked addresses, local phone numbers,
shorter card numbers, long IP addresses. On every candidate three labelers vote: the strict pattern,
a gazetteer (top-level domains, calling codes, issuer digits) and the words before it. The votes of
the whole corpus, counted by pattern (a few dozen rows), let expectation-maximisation estimate each
labeler's reliability; the resulting probabilities are the soft labels of a naive Bayes classifier
over the span's form and surroundings, which decides on the candidates.

Positions come from the gaps between matches: split and extract_all see the same matches, and sums of
their lengths, in blocks, give code points and bytes in time linear in the text.

Cases: a null text is an empty one and has no spans; spans of different kinds may overlap; repeated rows
get equal spans; without candidates nothing is learned or added.
"""

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterwise.session import cut_lineage

from .spans import free_of, matches, running_max
from .tables import packed, unpacked

KINDS = ("email", "ip", "card", "phone")
_NAME, _HOST = "A-Za-z0-9._%+-", "A-Za-z0-9-"

# The strict patterns, written so that a run of characters is entered once (at its start
# or where the last match ended) and never given back; they match what the plain forms match.
STRICT = {
    "email": rf"(?:(?<![{_NAME}])|\G)[{_NAME}]++@[{_HOST}]++(?:\.[{_HOST}]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for the pattern to be tried.
HINTS = {
    "email": r"@[A-Za-z0-9-]+\.[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]",
    "card": r"(?:[0-9][\x20-]?){15}[0-9]",
    "phone": r"\+[0-9]",
}
LOOSE = {
    "email": rf"(?<![{_NAME}])[{_NAME}]++ ?[(\[]at[)\]] ?[{_HOST}]++(?: ?(?:\.|[(\[]dot[)\]]) ?[{_HOST}]++)++",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z-])(?:[0-9]{13,15}|3[47][0-9]{2}[\x20-][0-9]{6}[\x20-][0-9]{5})(?![0-9A-Za-z-])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,5}\)\x20?|0[0-9]{2,4}[\x20./-])[0-9]{3,4}[\x20.-][0-9]{4}(?![0-9A-Za-z-])",
}
LOOSE_HINTS = {
    "email": r"[(\[]at[)\]]", "ip": r"(?:[0-9A-Fa-f]{1,4}:){7}", "card": r"[0-9]{13}|3[47][0-9]{2}[\x20-][0-9]{6}[\x20-]",
    "phone": r"[0-9]{3,4}[\x20.-][0-9]{4}",
}
#: Gazetteers: what a real one of the kind tends to hold.
GAZETTEER = {
    "email": r"(?i)(?:com|org|net|edu|gov|info|io|eu|de|fr|es|uk|at|ch|it|nl)[)\]]?$",
    "ip": r"(?i)^(?:(?!0|127|255)[0-9]+\.|20|fd|fe80)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5)|35)",
    "phone": r"^(?:\+(?:1|33|34|39|41|43|44|49)[^0-9]|\(0?[1-9][0-9]{1,4}\)|0)",
}
CUES = {
    "email": r"(?i)(?:e-?mail|contact|write to|kontakt|correo|courriel|adresse)[^\n]{0,12}$",
    "ip": r"(?i)(?:\bip\b|address|host|server|adresse|direcci.n)[^\n]{0,12}$",
    "card": r"(?i)(?:card|visa|master|amex|credit|karte|carte|tarjeta)[^\n]{0,12}$",
    "phone": r"(?i)(?:phone|call|tel|mobile|fax|telefon|llam|appel)[^\n]{0,12}$",
}
#: Characters before a span that the cues look at.
CONTEXT = 32


def _digits(hit):
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits):
    places = F.transform(F.split(F.reverse(digits), ""), lambda d: F.coalesce(d.try_cast("int"), F.lit(0)))
    doubled = F.transform(places, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind, hit):
    digits = _digits(hit)
    count = F.char_length(digits)
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda part: F.regexp_replace(part, "^0+", "").rlike(r"^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return count.between(16, 19) & _luhn(digits)
    if kind == "phone":
        return count.between(8, 15)
    return F.lit(True)


def _valid_loose(kind, hit):
    return _luhn(_digits(hit)) if kind == "card" else F.lit(True)


def _holds(valid, kind):
    return lambda match: valid(kind, match["hit"])


def _side(char):
    """Class of a neighbouring character: 0 none, 1 white space, 2 letter or digit, 3 other."""
    return F.when(char == "", 0).when(char.rlike(r"\s"), 1).when(char.rlike(r"[\p{L}\p{N}]"), 2).otherwise(3)


def _described(kind, number, strict):
    def describe(m):
        hit = m["hit"]
        flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
        return F.struct(
            F.lit(number).alias("kind"), *[m[c].alias(c) for c in ("start", "end", "low", "high")],
            F.lit(int(strict)).alias("regex"), flag(hit.rlike(GAZETTEER[kind])).alias("gazetteer"),
            flag(m["before"].rlike(CUES[kind])).alias("context"),
            F.least(F.floor(F.char_length(hit) / 4), F.lit(7)).cast("int").alias("length"),
            F.least(F.floor(F.char_length(_digits(hit)) / 4), F.lit(4)).cast("int").alias("digits"),
            F.when(hit.rlike(r"\s"), 1).when(hit.contains("-"), 2).when(hit.contains("."), 3).otherwise(0).alias("joint"),
            _side(F.right(m["before"], F.lit(1))).alias("left"), _side(m["after"]).alias("right"),
        )

    return describe


#: Votes of the labelers, and features of the classifier, in the structs of ``scan``.
VOTES = ("regex", "gazetteer", "context")
FEATURES = ("length", "digits", "joint", "left", "right", "context")


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_base`` and ``_loose``, the spans by kind and start; _loose touches no base span."""
    rows = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    for number, kind in enumerate(KINDS):
        for name, patterns, hints, valid in (("strict", STRICT, HINTS, _valid), ("loose", LOOSE, LOOSE_HINTS, _valid_loose)):
            rows = matches(rows, "_found", "_text", patterns[kind], hints[kind], CONTEXT, 1)
            good = F.filter("_found", _holds(valid, kind))
            rows = rows.withColumn(f"_{name}_{kind}", F.transform(good, _described(kind, number, name == "strict"))).drop("_found")
    base = F.concat(*[F.col(f"_strict_{k}") for k in KINDS])
    loose = F.concat(*[F.col(f"_loose_{k}") for k in KINDS])
    rows = rows.withColumn("_base", base)
    return rows.withColumn("_loose", free_of(loose, F.col("_base"))).select(*docs.columns, "_base", "_loose")


def reliabilities(patterns, rounds=50):
    """EM over (kind, votes, count): probabilities of (kind, votes), and per labeler (hit rate, false rate).

    Two hidden classes; labelers are independent given the class; each kind has its own share.
    """
    shares = defaultdict(lambda: 0.5)
    rates = [(0.8, 0.2)] * len(VOTES)
    posterior = {}
    for _ in range(rounds):
        sums = [[1.0, 2.0, 1.0, 2.0] for _ in VOTES]  # votes and weights in either class, one pseudo-count
        per_kind = defaultdict(lambda: [1.0, 2.0])
        for kind, votes, n in patterns:
            yes, no = shares[kind], 1 - shares[kind]
            for vote, (hit, false) in zip(votes, rates):
                yes *= hit if vote else 1 - hit
                no *= false if vote else 1 - false
            p = posterior[kind, votes] = yes / (yes + no)
            per_kind[kind][0] += p * n
            per_kind[kind][1] += n
            for s, vote in zip(sums, votes):
                s[0] += p * n * vote
                s[1] += p * n
                s[2] += (1 - p) * n * vote
                s[3] += (1 - p) * n
        shares.update({k: a / b for k, (a, b) in per_kind.items()})
        rates = [(a / b, c / d) for a, b, c, d in sums]
    return posterior, rates


def learn(spans: DataFrame) -> dict:
    """Log odds {(feature, value) and ("kind", kind)} from the described candidates ``spans`` (column s).

    Counts by votes and features come back: both are small closed sets, whatever the corpus.
    """
    names = list(dict.fromkeys(["kind", *VOTES, *FEATURES]))
    rows = spans.groupBy(*[F.col(f"s.{n}").alias(n) for n in names]).count().collect()
    votes = defaultdict(int)
    for r in rows:
        votes[r["kind"], tuple(r[v] for v in VOTES)] += r["count"]
    posterior, _ = reliabilities([(k, v, n) for (k, v), n in sorted(votes.items())])
    totals, sums = [1.0, 1.0], defaultdict(lambda: [0.5, 0.5])
    for r in rows:
        p = posterior[r["kind"], tuple(r[v] for v in VOTES)]
        for side, share in enumerate((p, 1 - p)):
            totals[side] += share * r["count"]
            for name in ("kind", *FEATURES):
                sums[name, r[name]][side] += share * r["count"]
    prior = math.log(totals[0] / totals[1])
    odds = {key: math.log(yes / totals[0]) - math.log(no / totals[1]) for key, (yes, no) in sums.items()}
    return {"prior": prior, **odds}


def decide(model: dict):
    """Condition on a described span: is its log odds above 0?"""

    def positive(s):
        score = F.lit(model["prior"])
        for name in ("kind", *FEATURES):
            part = F.lit(0.0)
            for (_, value), odds in sorted((k, v) for k, v in model.items() if k[0] == name and isinstance(k, tuple)):
                part = F.when(s[name] == value, F.lit(odds)).otherwise(part)
            score = score + part
        return score > 0

    return positive


def _spans(model):
    kept = F.filter("_loose", decide(model))
    return F.array_sort(F.concat("_base", kept))  # by kind, start, end


def _model(found):
    return learn(found.select(F.explode(F.concat("_base", "_loose")).alias("s")))


def _listed(spans):
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind[s["kind"]], s["start"], s["end"])), ",")


def _of_kind(number):
    return lambda span: span["kind"] == number


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base spans by kind, digest of the base spans, all spans."""
    found = cut_lineage(scan(docs.select("doc_id", "text")).drop("text"))
    base = F.array_sort("_base")
    counts = [F.size(F.filter("_base", _of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select(
        "doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(_spans(_model(found))).alias("spans")
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with [EMAIL], [IP], [CARD] or [PHONE] in place of each span; overlapping ones become one.

    n_chars, if there is one, counts the new text; texts without spans stay as they are.
    """
    found = cut_lineage(scan(docs.select("doc_id", "text")).select("_base", "_loose"))
    model = _model(found)
    by_place = lambda s: F.struct(s["low"].alias("low"), s["high"].alias("high"), s["kind"].alias("kind"))
    names = ["doc_id", "text"]
    rows = scan(packed(docs, names)).withColumn("_spans", F.array_sort(F.transform(_spans(model), by_place)))
    some = F.size("_spans") > 0
    # A span that starts before an earlier one ends belongs to it.
    ends = F.transform("_spans", lambda s: s["high"])
    rows = rows.withColumn("_reach", running_max(ends))
    rows = rows.withColumn("_first", F.filter("_spans", lambda s, i: s["low"] >= F.col("_reach")[i]))
    rows = rows.withColumn("_go", F.filter("_reach", lambda r, i: F.col("_spans")[i]["low"] >= r))
    label = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    raw, all_ends = F.col("text").cast("binary"), F.array_max(ends)
    # Pieces of bytes are cut at their offsets, so the whole is linear in the text.
    pieces = F.transform("_first", lambda s, i: F.concat(
        F.substring(raw, F.col("_go")[i] + 1, s["low"] - F.col("_go")[i]).cast("string"), label[s["kind"]]
    ))
    tail = F.substring(raw, all_ends + 1, F.octet_length("text")).cast("string")
    changed = {"text": F.when(some, F.concat(F.array_join(pieces, ""), tail)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        rows = rows.withColumn("_new", changed["text"])
        size = F.char_length("_new").cast(docs.schema["n_chars"].dataType)
        changed = {"text": F.col("_new"), "n_chars": F.when(some, size).otherwise(F.col("row").getField("n_chars"))}
    return unpacked(rows, docs, names, **changed)
