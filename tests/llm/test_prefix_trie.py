import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from rosterwise.llm import prefix_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, k1 string, length int"


def rebuilt(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    for own in turns.values():
        own.sort()
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = [t[2:] for t in turns.get(c - c % 20, [])[:h] + own[h:]]
    return out


def brute(rows):
    whole, nodes = rebuilt(rows), defaultdict(list)
    for c, path in whole.items():
        for d in range(len(path) + 1):
            nodes[tuple(path[:d])].append(c)
    sums = {}
    children = defaultdict(int)
    for path in sorted(nodes, key=len, reverse=True):
        leaves, saved = sums.get(path, (0, 0))
        leaves += children[path] == 0
        saved += (len(nodes[path]) - 1) * len((path[-1][1] if path else "").split())
        sums[path] = (leaves, saved)
        if path:
            a, b = sums.get(path[:-1], (0, 0))
            sums[path[:-1]] = (a + leaves, b + saved)
            children[path[:-1]] += 1
    out = []
    for path, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(whole[c]) == len(path))
        out.append((
            min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), children[path], *sums[path],
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def got(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(5)
    return sorted(map(tuple, trie.rebuilt_trie(df, **options).collect()), key=str)


def sample():
    random.seed(2)
    said = [None, "", "yes", "no no", "tell me  more\nplease", "é 漢字"]
    rows = []
    for c in range(300):
        for t in range(random.randint(1, 6)):
            rows.append((c, t, random.choice(["user", "assistant"]), random.choice(said)))
    for c in range(300, 420):  # one conversation many times
        rows += [(c, t, "user", f"copy {t}") for t in range(5)]
    rows += [(500, t, "user", f"long {t}") for t in range(90)] + [(502, t, "user", f"long {t}") for t in range(80)]
    rows += [(c, None, None, None) for c in (601, 602, 603, 607)] + [(650, 1, "user", "twice")] * 3 + [(650, 1, None, "twice")]
    return rows + [(700, None, "user", "b"), (700, None, "user", "a"), (700, 0, "user", "c"), (None, 0, "user", "lost"), (None, None, None, None)]


@pytest.mark.parametrize("limit, chunk, piece", [(1 << 16, 1 << 16, 4096), (8, 7, 3), (60, 16, 2)])
def test_against_brute_force(spark, monkeypatch, limit, chunk, piece):
    monkeypatch.setattr(trie, "CHUNK", chunk)
    monkeypatch.setattr(trie, "PIECE", piece)
    rows = sample()
    assert got(spark, rows, limit=limit) == brute(rows)


def test_few_conversations_and_none(spark):
    for rows in ([(21, 0, "user", "a b")], [(23, 0, "user", "x")], [(7, 0, None, None), (7, 0, None, None)], [(0, 0, "u", "a b"), (1, 0, "u", "a b"), (1, 1, "u", "c")]):
        assert got(spark, rows) == brute(rows)
    assert got(spark, [(None, 0, "user", "lost")]) == []
    assert trie.rebuilt_trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_double_array_holds_exactly_its_sequences(monkeypatch):
    random.seed(6)
    for tries in (1, 512):
        monkeypatch.setattr(trie, "TRIES", tries)
        sequences = [[random.randint(1, 40) for _ in range(random.randint(0, 6))] for _ in range(400)]
        array = trie.DoubleArray(sequences)
        prefixes = {tuple(s[:d]) for s in sequences for d in range(1, len(s) + 1)}
        states = {}
        for s in sequences:
            for d, state in enumerate(array.walk(s), 1):
                assert states.setdefault(tuple(s[:d]), state) == state
        assert set(states) == prefixes and len(set(states.values())) == len(prefixes)
        for _ in range(500):
            s = [random.randint(1, 45) for _ in range(6)]
            longest = max((d for d in range(7) if d == 0 or tuple(s[:d]) in prefixes))
            assert len(list(array.walk(s))) == longest
        assert (array.check >= 0).sum() == len(prefixes) + 1
