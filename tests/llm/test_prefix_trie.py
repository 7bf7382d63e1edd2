"""The prefix trie against a direct build, and its defined cases."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np

from curul.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, owner string"


def built(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:3])] for c, ts in turns.items()}
    whole = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = own.get(c - c % 5, [])[:h] + ts[h:]
    members, nodes = defaultdict(list), []
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    below = defaultdict(lambda: [0, 0])
    children = defaultdict(int)
    for key in members:
        if key:
            children[key[:-1]] += 1
    for key, convs in members.items():
        saved = (len(convs) - 1) * len(key[-1][1].encode()) if key else 0
        for d in range(len(key) + 1):
            below[key[:d]][0] += key not in children
            below[key[:d]][1] += saved
    for key, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(whole[c]) == len(key))
        parent = min(members[key[:-1]]) if key else None
        nodes.append((min(convs), len(key), parent, len(convs), children[key], *below[key], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(nodes, key=lambda n: (n[1], n[0]))


def got(spark, rows):
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(table).collect()), key=lambda n: (n[1], n[0]))


def test_random_conversations(spark):
    draws = np.random.default_rng(1)
    rows = []
    for c in range(0, 140):
        if c % 11:  # some base conversations are absent
            rows += [(c, t, ["user", "bot", None][draws.integers(3)], ["é", "b", "", None][draws.integers(4)]) for t in range(draws.integers(1, 14))]
    rows += [(c, t, "user", f"same {t}") for c in range(200, 260, 5) for t in range(4)]  # copies: one leaf, many ends
    rows += [(10_000_000_019, None, "user", "first"), (10_000_000_019, -3, "bot", "second"), (None, 1, "user", "nobody's")]
    draws.shuffle(rows)
    rows = [(None if c is None else int(c), None if t is None else int(t), r, x) for c, t, r, x in rows]
    assert got(spark, rows) == built(rows)


def test_a_chain_and_a_fan(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BUCKET", 7)
    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", 1)
    rows = [(5, t, "user", f"t{t % 3}") for t in range(120)] + [(c, 0, "user", f"only {c}") for c in range(300, 420)]
    rows += [(5000 + 5 * c, t, "user", f"t{t % 3}") for c in range(3) for t in range(60 + 10 * c)]
    assert got(spark, rows) == built(rows)


def test_repeated_rows_ties_and_no_rows(spark):
    rows = [(1, 0, "b", "x"), (1, 0, "a", "x"), (1, 0, "a", "x"), (1, 1, "a", "y" * 100_000)]
    assert got(spark, rows) == built(rows)
    assert got(spark, []) == [] and got(spark, [(None, 1, "a", "b")]) == []


def test_absent_base_can_leave_no_turns(spark):
    short = [c for c in range(1, 400) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2][:3]
    rows = [(c, t, "user", "hello") for c in short for t in range(2)]
    (root,) = got(spark, rows)
    assert [root] == built(rows) and root[:6] == (min(short), 0, None, 3, 0, 1)
