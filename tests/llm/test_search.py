"""Ranked search against scores added up for every document."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tickerloom.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def by_definition(docs, items, k=50):
    bags = [(d, terms(t)) for d, t in docs]
    bags = [(d, b) for d, b in bags if b]
    n_docs, n_terms = len(bags), sum(len(b) for _, b in bags)
    df = {}
    for _, bag in bags:
        for term in set(bag):
            df[term] = df.get(term, 0) + 1
    wanted = {}
    for item, text in items:
        if item is not None:
            wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, words in wanted.items():
        scored = []
        for d, bag in bags:
            m = 50 + 50 * len(bag) * n_docs // n_terms
            score = sum(
                math.floor(1000 * math.log((2.0 * n_docs + 2) / (2.0 * df[w] + 1))) * (1_000_000_000 * bag.count(w) // (1000 * bag.count(w) + 20 * m))
                for w in words.intersection(bag)
            )
            if score > 0:
                scored.append((-score, d is None, d or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(map(str, out))


def skewed(r, n, words):
    return " ".join(words[min(int(r.paretovariate(0.7)) - 1, len(words) - 1)] for _ in range(n))


@pytest.fixture(scope="module")
def words():
    r = random.Random(5)
    return sorted({"".join(r.choice("abcdeé9") for _ in range(r.randint(1, 6))) for _ in range(400)})


def run(spark, docs, rows, items):
    table = spark.createDataFrame([(i, t, 7, "x") for i, t in items], "item_id long, text string, term int, items string")
    return sorted(map(str, map(tuple, search.search(search.build_index(docs(rows)), table).collect())))


def test_search_by_definition(spark, docs, words, monkeypatch):
    monkeypatch.setattr(search, "SHARD_DOCS", 700)
    r = random.Random(6)
    rows = [(i * 7 % 2003, skewed(r, r.randint(1, 60), words)) for i in range(2003)]
    rows += [(5000 + i, rows[3][1]) for i in range(80)]  # more copies than places in the ranking
    rows += [(None, rows[3][1]), (None, None), (6000, None), (6001, ""), (6002, "--- ..."), (6003, "a" * 300 + " b" * 700), (6004, "ab " * 40_000)]
    items = [(i, skewed(r, 25, words)) for i in range(12)] + [(20, rows[3][1]), (20, "extra a b"), (21, None), (22, "nowhere-seen"), (None, "a b"), (23, "A B Aé")]
    assert run(spark, docs, rows, items) == by_definition(rows, items)


def test_items_in_several_blocks(spark, docs, words, monkeypatch):
    monkeypatch.setattr(search, "ITEM_TERMS", 40)
    r = random.Random(8)
    rows = [(i, skewed(r, 20, words)) for i in range(300)]
    items = [(i, skewed(r, 20, words)) for i in range(9)]
    assert run(spark, docs, rows, items) == by_definition(rows, items)


def test_blocks_are_left_unread(spark, docs, words):
    r = random.Random(9)
    rows = [(i, skewed(r, 30, words)) for i in range(20_000)]
    index = search.build_index(docs(rows).repartition(1))
    lists, df = index.lists.toArrow(), {}
    for term, n in zip(lists["term"].to_pylist(), lists["n"].to_pylist()):
        df[term] = df.get(term, 0) + n
    often = sorted(df, key=df.get)
    item = " ".join([*often[-8:-4], *[t for t in often if 600 < df[t] < 2500][:4]])
    wanted = set(terms(item))
    weight = [None if t == "" else math.floor(1000 * math.log((2.0 * index.n_docs + 2) / (2.0 * df[t] + 1))) for t in lists["term"].to_pylist()]
    table = lists.append_column("weight", pa.array(weight, pa.int64()))
    table = table.append_column("items", pa.array([None if t == "" else [1] for t in lists["term"].to_pylist()], pa.list_(pa.int64())))
    table = table.filter(pa.array([t == "" or t in wanted for t in lists["term"].to_pylist()]))
    found = []
    for shard in set(table["shard"].to_pylist()):
        own = search.Shard(table.filter(pa.array([s == shard for s in table["shard"].to_pylist()])))
        numbers, scores = own.best(np.arange(len(own.items)), 50)
        found += list(zip(scores.tolist(), own.ids[numbers].tolist()))
        assert own.read < 0.8 * own.n.sum()
    want = by_definition(rows, [(1, item)])
    found = sorted(found, key=lambda x: (-x[0], x[1]))[:50]
    assert sorted(str((1, r, d, s)) for r, (s, d) in enumerate(found, 1)) == want


def test_empty_tables(spark, docs):
    assert run(spark, docs, [], [(1, "a b")]) == []
    assert run(spark, docs, [(1, None), (2, "  ")], [(1, "a b")]) == []
    assert run(spark, docs, [(1, "a b")], []) == []
