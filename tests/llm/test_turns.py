"""The trie of conversations against one of dictionaries."""

import hashlib
import math
import random
import re
import zlib

import pytest

from tickerloom.llm import turns


def by_definition(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(role, text) for _, _, role, _, text in sorted(t)] for c, t in own.items()}
    rebuilt = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + t[h:]  # as SQL takes remainders
    nodes = {}
    for c, t in rebuilt.items():
        for d in range(len(t) + 1):
            nodes.setdefault(tuple(t[:d]), []).append(c)
    out = []
    for key, members in nodes.items():
        under = [k for k in nodes if k[: len(key)] == key]
        ends = ",".join(map(str, sorted(c for c in members if len(rebuilt[c]) == len(key))))
        childless = [k for k in under if not any(len(o) == len(k) + 1 and o[:-1] == k for o in under)]
        saved = sum((len(nodes[k]) - 1) * len(re.findall("[^\x20\x09-\x0d]+", k[-1][1])) for k in under if k)
        children = sum(len(k) == len(key) + 1 for k in under)
        parent = min(nodes[key[:-1]]) if key else None
        out.append((min(members), len(key), parent, len(members), children, len(childless), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


def random_rows(seed, n, kinds=3, longest=6):
    r = random.Random(seed)
    texts = ["", "one", "two words", "three\tof them", None, "é à"]
    rows = []
    for c in range(n):
        if r.random() < 0.1:
            continue
        chain = [r.randrange(kinds) for _ in range(r.randint(1, longest))]
        rows += [(c, i, ["user", "assistant", None][i % 3], texts[k]) for i, k in enumerate(chain)]
    return rows


def run(spark, rows, **sizes):
    table = spark.createDataFrame([(*row, 1, "x") for row in rows], "conv_id long, turn long, role string, text string, digest int, words string")
    return sorted(map(str, map(tuple, turns.prefix_trie(table, **sizes).collect())))


@pytest.mark.parametrize("sizes", [{}, {"block_turns": 1, "piece_ids": 1}, {"block_turns": 9, "piece_ids": 2}])
def test_trie_by_definition(spark, sizes):
    rows = random_rows(1, 160)
    rows += [(400 + i, j, "user", f"hot {j}") for i in range(30) for j in range(3)]  # a group of copies
    rows += [(700, j, "user", f"deep {j % 5}") for j in range(150)] + [(701, j, "user", f"deep {j % 5}") for j in range(149)]
    rows += [(None, 0, "user", "nobody"), (800, None, "user", "first"), (800, 1, None, None), (800, 1, "b", "tie"), (800, 1, "b", "tie"), (-7, 0, "user", "below zero")]
    random.Random(2).shuffle(rows)
    assert run(spark, rows, **sizes) == by_definition(rows)


def test_many_partitions(spark):
    rows = random_rows(3, 400, kinds=5, longest=4)
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert run(spark, rows, block_turns=20) == by_definition(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_turnless_conversations_and_empty_table(spark):
    rows = [(c, 0, "user", "only turn") for c in range(21, 40)]  # base 20 is absent: those that drop their first turn have none
    assert run(spark, rows) == by_definition(rows)
    assert run(spark, []) == []


def test_middle_first():
    assert list(turns.middle_first(7)) == [3, 1, 0, 2, 5, 4, 6]
    tree = turns.Tree()
    for i in turns.middle_first(1023):
        tree.insert([i, 1], [1, 1])
    depth, at = 0, tree.child[0]
    while at >= 0:
        depth, at = depth + 1, tree.low[at]
    assert depth == 10
