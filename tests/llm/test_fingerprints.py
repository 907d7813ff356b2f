import hashlib
import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from rosterwise.llm import fingerprints as f
from rosterwise.llm import near_dedup as n
from rosterwise.llm.components import components
from rosterwise.llm.tables import PACKED, all_votes, bounds_below, bounds_of, place, with_next


def terms(text, k=3):
    words = re.findall(r"[^\x20\t-\r]+", text)
    return [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)]


def simhash(items, weight):
    votes, total = [0] * 64, 0
    for x in items:
        h = xxhash.xxh64_intdigest(x.encode(), 42)
        total += weight(x)
        for i in range(64):
            votes[i] += weight(x) * (h >> i & 1)
    return sum(1 << i for i in range(64) if 2 * votes[i] > total)


def alike(a, b):
    return (64 - bin(a ^ b).count("1")) / 64


def test_fingerprints_of_texts_and_edits(odd_docs):
    rows = [(r.doc_id, r.text or "") for r in odd_docs.collect() if r.doc_id is not None]
    rows.sort(key=lambda r: (-r[0], r[1]))
    got = f.document_fingerprints(odd_docs.filter("doc_id is not null")).collect()
    want, codes = Counter(), [simhash(terms(t), len) for _, t in rows]
    for at, (doc_id, text) in enumerate(rows):
        follow = (at + 1) % len(rows)
        third = len(text) // 3
        edited = text[: len(text) - third] + rows[follow][1][:third]
        other = simhash(terms(edited), len)
        near = sum(bin(codes[at] ^ c).count("1") <= 3 for c in codes) - 1
        want[
            doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), f"{codes[at]:016x}", f"{other:016x}",
            alike(codes[at], other), alike(codes[at], codes[follow]), near if doc_id % 50 == 0 else None,
        ] += 1
    assert Counter(tuple(r) for r in got) == want


def test_rows_without_id_and_empty_tables(odd_docs, no_docs):
    got = f.document_fingerprints(odd_docs)
    assert got.count() == odd_docs.count()
    assert f.document_fingerprints(no_docs).count() == 0
    assert n.document_components(no_docs).count() == 0 and n.keep_one(no_docs).columns == no_docs.columns


def test_block_tables_find_all_within_the_radius(spark):
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    flips = [np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False))) for _ in range(400)]
    codes = np.unique(np.concatenate([codes, codes[rng.integers(0, 40, 400)] ^ np.array(flips), [np.uint64(0)]]))
    signed = [int(x) for x in codes.view(np.int64)]
    table = spark.createDataFrame([(x,) for x in signed], "code long")
    found = f.near_fingerprints(table.selectExpr("code AS query"), table).collect()
    want = {
        (a, b, int(np.bitwise_count(x ^ y))) for a, x in zip(signed, codes) for b, y in zip(signed, codes) if np.bitwise_count(x ^ y) <= 3
    }
    assert len(found) == len(want) and {tuple(r) for r in found} == want
    # The same links hold the same codes together, also when every list is split into tiny blocks.
    roots = {}
    for block in (1024, 8):
        old, n.BLOCK = n.BLOCK, block
        try:
            roots[block] = {r.node: r.root for r in components(n.near_links(table)).collect()}
        finally:
            n.BLOCK = old
    parent = {x: x for x in signed}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, _ in want:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    linked = {x for a, b, _ in want if a != b for x in (a, b)}
    assert roots[1024] == roots[8] == {x: top(x) for x in linked}


def test_near_duplicates(odd_docs):
    def code(text):
        lowered = (text or "").translate({i: i + 32 for i in range(65, 91)})
        items = [x for x in terms(lowered) if x]
        return simhash(items, lambda _: 1)

    rows = [(r.doc_id, code(r.text)) for r in odd_docs.collect()]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= 3:
                a, b = top(i), top(j)
                group[max(a, b)] = min(a, b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(i)] = min(doc_id, least.get(top(i), doc_id))
    want = Counter((d, f"{c:016x}", least.get(top(i))) for i, (d, c) in enumerate(rows))
    assert Counter(tuple(r) for r in n.document_components(odd_docs).collect()) == want
    kept = n.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(least.get(i) for i in {top(i) for i in range(len(rows))})


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(0, 300) if i % 50 != 49] + [(1000, x) for x in range(1001, 1200)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = {x: x // 50 * 50 for i in range(300) if i % 50 != 49 for x in (i, i + 1)} | {x: 1000 for x in range(1000, 1200)}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_next_rows_of_ids_far_apart(spark):
    ends = [-(1 << 63), (1 << 63) - 1, 0, -1]
    far = [s * 10**12 + i for s in (1, 2, 3) for i in range(400)] + ends
    rows = [(i, f"t{i}") for i in far] + [(7, f"{i:05d}") for i in range(1500)] + [(7, "x" * 70 + c) for c in "ba"]
    table = spark.createDataFrame(rows, "id long, t string").repartition(4)
    rows.sort(key=lambda r: (-r[0], r[1]))
    want = {r: rows[(i + 1) % len(rows)] for i, r in enumerate(rows)}
    got = with_next(table, "id", "t").collect()
    assert len(got) == len(rows) and {(r.id, r.t): tuple(r.next) for r in got} == want
    # No range holds much more than its share, clusters and the id of most rows included.
    at = place(table["id"], table["t"])
    bounds = bounds_of(table.select(at), 30)
    sizes = table.groupBy(bounds_below(at, bounds).alias("range")).count().collect()
    assert len(sizes) > 20 and max(r["count"] for r in sizes) < 4 * len(rows) / 30


def test_next_rows_without_id_form_one_ring(spark):
    rows = [(None, f"t{i}") for i in range(50)] + [(None, None), (3, "a"), (3, None)]
    got = with_next(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect()
    following = {(r.id, r.t): tuple(r.next) for r in got}
    seen, here = [], (3, None)
    for _ in rows:
        seen.append(here)
        here = following[here]
    assert here == (3, None) and seen[1] == (3, "a") and set(seen) == set(rows)


def test_votes_of_any_weight(spark):
    """Equal rows whose weights half a long can't hold, and light keys beside them."""
    rows = [(None, 5, 1 << 30)] * 3 + [("a", -1, PACKED - 1)] * 2 + [("a", 3, PACKED - 1)] + [("b", 6, 2), ("b", 3, 1), ("c", 0, 0)]
    df = spark.createDataFrame(rows, "k string, bits long, weight long")
    got = {r.k: (r.fingerprint, r.n) for r in all_votes(df, ["k"], "bits", "weight", [F.count("*").alias("n")]).collect()}
    assert got == {None: (5, 3), "a": (-1, 3), "b": (6, 2), "c": (0, 1)}
