import numpy as np

from rosterwise.llm import preferences, topk_search


def test_longest_common_prefix_and_masks(spark):
    turns = [
        (1, True, 0, "system", "be kind"), (1, True, 1, "user", "hi"), (1, True, 2, "assistant", "hello"), (1, True, 3, "user", None),
        (1, True, 4, "assistant", "bye <|end|>"), (1, False, 0, "system", "be kind"), (1, False, 1, "user", "hi"),
        (1, False, 2, "assistant", "go away"), (1, False, 2, "assistant", "go away"), (1, False, None, "user", "lost"),
        (2, True, 0, "user", "same"), (2, False, 0, "user", "same"), (3, True, 0, None, "only one side"),
    ]
    df = spark.createDataFrame(turns, "pair_id long, is_chosen boolean, turn long, role string, text string")
    got = {r.pair_id: r for r in preferences.preference_pairs(df).collect()}
    one = got[1]
    assert one.prompt == "<|system|>\nbe kind<|end|>\n<|user|>\nhi<|end|>\n" and one.n_prompt_turns == 2
    assert one.chosen == "<|assistant|>\nhello<|end|>\n<|user|>\n<|end|>\n<|assistant|>\nbye < |end|><|end|>\n"
    assert [one.chosen[s.start : s.end] for s in one.chosen_spans] == ["hello<|end|>", "bye < |end|><|end|>"]
    assert [one.rejected[s.start : s.end] for s in one.rejected_spans] == ["go away<|end|>"]
    assert (got[2].prompt, got[2].chosen, got[2].rejected) == ("<|user|>\nsame<|end|>\n", "", "")
    assert (got[3].prompt, got[3].chosen, got[3].rejected) == ("", "<|unknown|>\nonly one side<|end|>\n", "")
    assert preferences.preference_pairs(df.limit(0)).count() == 0


def test_crossed_pairs(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c}.{t}", 1) for c, n in ((1, 4), (5, 2), (9, 3)) for t in range(n)]
    df = spark.createDataFrame([*rows, (None, 0, "user", "x", 1), (5, None, "user", "x", 1)], "conv_id long, turn long, role string, text string, pair_id int")
    got = {}
    for r in preferences.crossed(df).collect():
        got.setdefault((r.pair_id, r.is_chosen), []).append(r.text)
    assert sorted(got[9, False]) == ["9.0", "9.1"] and sorted(got[5, False]) == ["1.1", "1.2", "1.3", "5.0"]
    assert sorted(got[1, False]) == ["1.0", "1.1", "9.2"] and sorted(got[1, True]) == ["1.0", "1.1", "1.2", "1.3"]
    assert preferences.preference_documents(df).count() == 3
    assert preferences.preference_documents(df.limit(0)).count() == 0


def brute(rows, k):
    vectors = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in sorted({(i, tuple(v)) for i, v in vectors if i % 50 == 0}):
        scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in vectors if j != i)[:k]
        out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scored, 1)]
    return out


def test_exact_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 16)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 340)] + [(350, [0.0] * 16), (360, [-1.0] * 16), (400, [1.0] * 3), (450, [])]
    rows += [(500, None), (501, [None] * 16), (502, [float("nan")] * 16), (503, [float("inf")] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute(rows, 5)
    assert sorted(map(tuple, topk_search.nearest(df).collect())) == want
    ints = topk_search.integer_vectors(df)
    small = topk_search.top_k(ints.filter("vec_id % 50 = 0"), ints, shard=40, block=3)
    assert sorted(map(tuple, small.collect())) == want
    assert topk_search.nearest(df.limit(0)).count() == 0
    few = df.filter("vec_id in (0, 50, 3)")
    assert sorted(map(tuple, topk_search.nearest(few).collect())) == brute([r for r in rows if r[0] in (0, 50, 3)], 5)


def test_pruning_keeps_ties():
    rng = np.random.default_rng(3)
    rows = rng.integers(-3, 4, (8, 400))
    ids = np.arange(400)
    for own in range(0, 400, 50):
        query = rows[:, own]
        best, scores = topk_search.max_score(query, own, ids, rows, rows.min(1), rows.max(1), 5)
        plain = query @ rows
        want = sorted((-plain[i], i) for i in ids if i != own)[:5]
        assert list(zip((-scores).tolist(), best.tolist())) == [(int(a), int(b)) for a, b in want]
