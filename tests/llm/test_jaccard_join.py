import random

import numpy as np
import pyarrow as pa
import pytest

from sheaf.llm import jaccard_join as J
from sheaf.llm.common import utf8
from sheaf.llm.components import components


def brute(rows):
    sets = {i: J.shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[:a]:
            if J.linked(sets[i], sets[j]):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def variants(seed):
    rng, rows = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(12)]
    for _ in range(40):
        words = [rng.choice(vocabulary) + rng.choice("abcdefgh") for _ in range(rng.choice([1, 2, 4, 5, 6, 7, 9, 12, 20, 45, 90, 300]))]
        for _ in range(rng.choice([1, 2, 3, 5])):
            v = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                k, op = rng.randrange(len(v)) if v else 0, rng.random()
                if op < 0.4 and v:
                    v[k] = rng.choice(vocabulary)
                elif op < 0.7 and v:
                    del v[k]
                else:
                    v.insert(k, rng.choice(vocabulary))
            rows.append((len(rows) * 7 % 1009, " ".join(v)))
    return rows


@pytest.mark.parametrize("slack", [1.0, 0.0])
def test_no_link_is_lost(spark, slack):
    """Without slack many sets have too few segments with a shingle, so the second pass works as well."""
    rows = variants(int(slack)) + [(2000, ""), (2001, None)]
    got = J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), slack=slack).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows)


def test_documents(docs, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_duplicates(docs).collect()}
    assert got == brute(texts.items())


def all_links(rows):
    first = {}
    for i, t in sorted((i, t) for i, t in rows if i is not None and (t or "").split()):
        first.setdefault(" ".join(t.lower().split()), i)
    sets = {i: J.shingles(t) for t, i in first.items()}
    return sorted((a, b) for b in sets for a in sets if a < b and J.linked(sets[a], sets[b]))


@pytest.mark.parametrize("slack", [1.0, 0.0])
def test_every_link_is_returned_once(spark, slack):
    """Also those inside a component: a group of near copies, all similar to each other, among other texts."""
    text = " ".join(f"c{i}" for i in range(400))
    near = [(3000 + i, text.replace(f"c{20 * i} ", f"d{i} ")) for i in range(15)] + [(4000, text)]
    rows = variants(int(slack) + 7) + near + [(2000, ""), (2001, None)]
    got = sorted((r.a, r.b) for r in J.similar_pairs(spark.createDataFrame(rows, "doc_id long, text string"), slack=slack).collect())
    want = all_links(rows)
    assert got == want and len([x for x in want if x[0] >= 3000]) == 120


def test_links_of_documents(docs, texts, odd, empty):
    assert sorted((r.a, r.b) for r in J.similar_pairs(docs).collect()) == all_links(texts.items())
    assert J.similar_pairs(odd).count() == J.similar_pairs(empty).count() == 0


def test_odd_texts(odd):
    rows = J.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[9][0].component_id == by[10][0].component_id == 8  # case folds, equal words
    assert by[4][0].component_id == by[4][1].component_id == 4  # a repeated row
    assert all(by[i][0].n_shingles == 0 and by[i][0].component_id == i for i in (0, 1, 2))
    assert by[3][0].n_shingles == 1 and all(r.component_id is None for r in by[None])


def test_empty_table_and_dedup(odd, empty):
    assert J.near_duplicates(empty).count() == 0
    kept = J.dedup(odd)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == odd.columns and sorted(x for x in ids if x is not None) == [i for i in range(15) if i not in (9, 10)] and ids.count(None) == 2


def test_dedup_of_a_key_with_several_texts(spark):
    """Texts of one key that are not similar: none goes but for a near copy of a smaller key."""
    one, two, three = (" ".join(f"{x}{i}" for i in range(100)) for x in "abc")
    rows = [(1, one), (5, one + " more"), (5, two), (7, three), (7, one + " else"), (7, three), (8, two + " more"), (9, None), (9, three + " end"), (None, two)]
    got = J.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.columns == ["doc_id", "text"]
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame([(1, one), (5, two), (7, three), (9, None), (None, two)], "doc_id long, text string").collect()))


def test_signatures_meet_for_every_similar_pair():
    """Pigeonhole: the units that a set lacks for its evidence never hide a partner."""
    rng = np.random.default_rng(0)
    for _ in range(60):
        n = int(rng.integers(2, 200))
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = a.copy()
        changes = int(rng.integers(0, max(1, n // 9) + 1))
        b[rng.choice(n, changes, replace=False)] = rng.integers(0, 2**63, changes).astype(np.uint64)
        x, y = set(a.tolist()), set(b.tolist())
        if 100 * len(x & y) < 80 * len(x | y):
            continue
        g = np.array([*x, *y], dtype=np.uint64)
        rows = np.repeat([0, 1], [len(x), len(y)])
        row, sig, tag, stat = J.signatures(rows, g, np.array([len(x), len(y)]), slack=1.0)
        assert set(sig[row == 0].tolist()) & set(sig[row == 1].tolist())
        assert (stat[:, 3] >= stat[:, 2]).mean() > 0.5


def test_shingles_and_hashes_agree(texts):
    some = [*texts.values()][:50] + ["", None, "a b", "A B", "a  b\tc\nd e f"]
    rows, g = J.shingle_hashes(*utf8(pa.array(some)))
    for i, t in enumerate(some):
        assert len(J.shingles(t)) == (rows == i).sum() == len(set(g[rows == i].tolist()))


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            p, q = find(a), find(b)
            parent[max(p, q)] = min(p, q)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(5)
    sets, sizes = [], []
    for _ in range(40):
        a = rng.integers(0, 2**63, int(rng.integers(1, 400))).astype(np.uint64)
        b = a.copy()
        b[rng.choice(len(a), len(a) // 10, replace=False)] = rng.integers(0, 2**63, len(a) // 10).astype(np.uint64)
        sets += [a, b]
        sizes += [len(a), len(b)]
    rows = np.repeat(np.arange(len(sets)), sizes)
    sketch = np.frombuffer(b"".join(J.sketches(rows, np.concatenate(sets), len(sets))), dtype=np.uint64).reshape(len(sets), -1)
    key, n = np.arange(len(sets)), np.array(sizes)
    # All under one signature, each in its own component, once as a set that looks and once as one that is looked for.
    twice = lambda x: np.concatenate([x, x])
    probe = np.repeat([True, False], len(sets))
    r, s = J.close_pairs(np.zeros(2 * len(sets), np.int64), twice(key), twice(key), twice(n), np.concatenate([sketch, sketch]), probe, 80)
    found = {(min(x), max(x)) for x in zip(r.tolist(), s.tolist())}
    links = {(i, j) for j in range(len(sets)) for i in range(j) if J.linked(set(sets[i].tolist()), set(sets[j].tolist()))}
    assert links <= found and len(links) > 20 and len(found) < len(sets) * 6


def test_pairs_of_one_component_or_of_other_sizes_are_not_formed():
    none = np.zeros((4, 16), np.uint64)
    key, n, probe = np.arange(4), np.array([10, 10, 10, 4]), np.array([True, True, False, False])
    assert J.close_pairs(np.zeros(4, np.int64), key, np.array([7, 7, 7, 7]), n, none, probe, 80)[0].size == 0
    r, s = J.close_pairs(np.zeros(4, np.int64), key, np.array([7, 8, 7, 7]), n, none, probe, 80)
    assert list(zip(r, s)) == [(1, 2)]
