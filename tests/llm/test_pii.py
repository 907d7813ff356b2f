import hashlib
import random
import re

from pyspark.sql import functions as F

from rosterwise.llm import pii
from rosterwise.llm.spans import free_of

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    values = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in values) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def sample():
    random.seed(4)
    parts = [
        "a", "b.", "@", "x", "1", "22", "255", "256", "00", ".", " ", "-", "+", "(", ")", "4111 1111 1111 1111", "4111111111111111",
        "+1 (702) 555-0742", "é", "😀", "\n", "a@b.c", "_", "%", "1.2.3.4", "user (at) mail (dot) com", "(702) 555-0742", "tel: ",
        "378282246310005",
    ]
    texts = ["".join(random.choices(parts, k=random.randint(0, 40))) for _ in range(800)]
    return [*texts, None, "", "a" * 3000, "a.b@c" * 2000, "1.2.3.4 " * 600, "x@y.zz " * 700, texts[0], texts[0]]


def test_base_spans_and_redaction(spark):
    texts = sample()
    rows = [(i, t, "en", "s", len(t or ""), 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kind int").repartition(4)
    spans = {}
    for r in pii.personal_data(docs).collect():
        base = plain_spans(texts[r.doc_id] or "")
        listed = ",".join("%s:%d:%d" % s for s in base)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in PLAIN]
        spans[r.doc_id] = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)]
        assert set(base) <= set(spans[r.doc_id])
        order = list(PLAIN)
        assert spans[r.doc_id] == sorted(spans[r.doc_id], key=lambda s: (order.index(s[0]), s[1]))
    redacted = pii.redact(docs)
    assert redacted.columns == docs.columns
    for r in redacted.collect():
        text, at, out = texts[r.doc_id], 0, []
        if not spans[r.doc_id]:
            assert (r.text, r.n_chars) == (text, len(text or ""))
            continue
        sized = sorted((a, b, list(PLAIN).index(k), k) for k, a, b in spans[r.doc_id])
        for a, b, _, kind in sized:
            if a >= at:
                out.append(text[at:a] + f"[{kind.upper()}]")
            at = max(at, b)
        out.append(text[at:])
        assert (r.text, r.n_chars) == ("".join(out), len("".join(out)))


def test_labelers_are_weighed():
    patterns = [(0, (1, 1, 1), 80), (0, (1, 1, 0), 20), (0, (0, 0, 0), 90), (0, (0, 1, 0), 10), (0, (1, 0, 0), 5)]
    posterior, rates = pii.reliabilities(patterns)
    assert posterior[0, (1, 1, 1)] > 0.95 and posterior[0, (0, 0, 0)] < 0.05
    assert all(hit > false for hit, false in rates)


def test_rows_without_text_or_id(odd_docs, no_docs):
    assert pii.personal_data(odd_docs).count() == odd_docs.count()
    assert pii.redact(no_docs).count() == 0 and pii.personal_data(no_docs).count() == 0


def test_spans_free_of_others(spark):
    random.seed(8)
    kind = "array<struct<kind:int,start:int,end:int>>"
    draw = lambda n: [(k, a, a + random.randint(1, 6)) for k, a in ((random.randint(0, 3), random.randint(0, 400)) for _ in range(n))]
    rows = [(i, draw(random.choice([0, 1, 30, 300])), draw(random.choice([0, 1, 40]))) for i in range(60)]
    df = spark.createDataFrame(rows, f"i int, loose {kind}, taken {kind}")
    for r in df.select("i", free_of(F.col("loose"), F.col("taken")).alias("free")).collect():
        _, loose, taken = rows[r.i]
        assert [tuple(s) for s in r.free] == [s for s in loose if not any(s[1] < t[2] and t[1] < s[2] for t in taken)]
