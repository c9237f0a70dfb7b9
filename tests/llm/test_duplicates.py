import hashlib
import random
import re

import numpy as np
import pytest

from tickerloom.llm import exact, near


def test_exact_groups(docs, prose):
    rows = [(i, prose(i % 7, 20)) for i in range(30)] + [(50, None), (51, ""), (52, " \t\n"), (53, " "), (60, prose(1, 20).replace(" ", "\n\t")), (60, prose(1, 20)), (None, prose(2, 20)), (None, "alone")]
    norm = [(i, re.sub(r"[ \t-\r]+", " ", t or "")) for i, t in rows]
    want = []
    for i, t in norm:
        ids = [j for j, u in norm if u == t]
        keep = min((j for j in ids if j is not None), default=None)
        want.append((i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    got = exact.exact_groups(docs(rows))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    kept = exact.without_copies(docs(rows))
    assert kept.columns == docs([]).columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, i) for i in (*range(7), 50, 52)] + [(True, 0)]


def test_exact_rounds_keep_one_place_for_a_digest(spark, docs, prose):
    keys = exact.digests(docs([(i, prose(i % 50, 5)) for i in range(400)])).repartition(13)
    runs = exact.merge_tree(keys, fan=2).collect()
    assert len(runs) == 50 and sum(r.group_size for r in runs) == 400
    assert sorted(r.keep_id for r in runs) == list(range(50))


def test_empty_tables(docs):
    assert exact.exact_groups(docs([])).collect() == []
    assert exact.without_copies(docs([])).collect() == []
    assert near.near_groups(docs([])).collect() == []


def sets_of(rows, k):
    out = []
    for _, t in rows:
        words = [w for w in re.split(r"[ \t-\r]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) if w]
        out.append({tuple(words[a : a + k]) for a in range(max(1, len(words) - k + 1))} if words else set())
    return out


def brute(rows, k, same):
    sets, root = sets_of(rows, k), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if rows[a][0] is not None and rows[b][0] is not None and both and 100 * both >= same * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    out = []
    for a, (i, _) in enumerate(rows):
        least = min((rows[b][0] for b in range(len(rows)) if find(b) == find(a) and rows[b][0] is not None), default=None)
        out.append((i, len(sets[a]), least, i == least))
    return sorted(out, key=str)


@pytest.mark.parametrize(("k", "same"), [(3, 85), (5, 80)])
def test_near_groups_against_all_pairs(docs, prose, k, same):
    r, rows = random.Random(k), []
    for g in range(12):
        base = prose(g, 120).split()
        for c in range(12):
            words = list(base)
            for _ in range(r.randint(0, 5) if c else 0):
                words[r.randrange(len(words))] = r.choice(["uno", "DUE", "tre"])
            rows.append((1000 - 20 * g - c, " ".join(words)))
    drift = prose(77, 150).split()  # each is like its neighbour, the ends are not alike
    for c in range(10):
        drift[c * 4] = f"x{c}"
        rows.append((2000 + c, " ".join(drift)))
    rows += [(1, None), (2, ""), (3, "  "), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one  two"), (None, "one"), (None, None), (1000, prose(500, 30)), (9, prose(0, 120)), (9, prose(0, 120))]
    got = near.near_groups(docs(rows), k, same).drop("mark")
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, k, same)


def test_groups_whose_hubs_fail_are_settled_by_blocks(docs, monkeypatch, prose):
    """Pairs of copies are alike, but no copy is like the hubs of its place."""
    monkeypatch.setattr(near, "BLOCK_OF", 3)
    r, rows = random.Random(2), []
    base = prose(5, 100).split()
    for c in range(16):
        words = list(base)
        for _ in range(4):
            words[r.randrange(len(words))] = f"w{c}"
        rows += [(10 * c, " ".join(words)), (10 * c + 1, " ".join([*words[:-1], "end"]))]
    got = near.near_groups(docs(rows), 3, 85, rows=2).drop("mark")
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 3, 85)


def test_one_row_of_each_group_stays(docs, prose):
    rows = [(7, prose(1, 60)), (3, prose(1, 60) + " end"), (3, prose(2, 60)), (4, None), (None, prose(1, 60))]
    kept = near.one_of_each_group(docs(rows)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in kept if r.text) == sorted([(3, prose(1, 60) + " end"), (3, prose(2, 60)), (0, prose(1, 60))])
    assert len(kept) == 4


def test_signatures_estimate_likeness():
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 63, 400).astype(np.uint64)
    b = np.concatenate([a[:320], r.integers(0, 1 << 63, 80).astype(np.uint64)])
    signature = near.super_min_hash(np.concatenate([a, b, a[:1]]), np.array([0, 400, 800, 801]), 256)
    assert abs((signature[0] == signature[1]).mean() - 320 / 480) < 0.12
    assert sorted(signature[2] >> 48) == list(range(256))  # one element offers each round to one register
    assert (signature[:2] >> 48).max() < 20


def test_large_sets_are_ranked_in_pieces(monkeypatch):
    r = np.random.default_rng(4)
    elements, sizes = r.integers(0, 1 << 63, 700).astype(np.uint64), np.array([1, 500, 3, 196])
    whole = near.signatures(elements, sizes, 64)
    monkeypatch.setattr(near, "PIECE", 50)
    assert (near.signatures(elements, sizes, 64) == whole).all()


def test_bands_miss_little():
    for same in (80, 85, 95):
        assert (1 - (same / 100) ** near.ROWS) ** near.bands_for(same) <= near.MISSED
