import re
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa

from sheaf.llm import quality_rules as Q
from sheaf.llm import queries
from sheaf.llm.common import utf8

W = re.compile(r"[^\x20\x09-\x0D]+")


def base(t):
    t = t or ""
    w = W.findall(t)
    tri = list(zip(w, w[1:], w[2:]))
    times, marked = Counter(tri), set()
    for i, x in enumerate(tri):
        if times[x] > 1:
            marked |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if W.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(marked) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(marked), failed


def test_base_counts(spark, sf, docs, odd, empty):
    f = Q.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    for df in (docs, odd):
        want = sorted((str(r.doc_id), *base(r.text)) for r in df.collect())
        got = Q.judge(df, f).collect()
        assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
        assert not any(r.kept and r.base_failed for r in got)
    assert Q.judge(empty, f).count() == 0


def test_good_documents_stay_and_bad_ones_go(spark, sf):
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.op6_quality_rules(spark, sf).collect() if r.doc_id in good and not r.base_failed]
    assert np.mean([r.kept for r in rows if good[r.doc_id] == 1]) >= 0.95
    assert np.mean([r.kept for r in rows if good[r.doc_id] == 0]) <= 0.2


def test_viterbi_finds_the_best_sequence():
    rng = np.random.default_rng(0)
    rows = np.repeat([0, 1, 3], [1, 5, 7])
    emit, move = rng.normal(size=(13, 2)), rng.normal(size=(2, 2))
    got = Q.viterbi(emit, rows, move)
    for r in (0, 1, 3):
        e = emit[rows == r]
        score = lambda y: sum(e[i, s] for i, s in enumerate(y)) + sum(move[a, b] for a, b in zip(y, y[1:]))
        assert tuple(got[rows == r]) == max(product((0, 1), repeat=len(e)), key=score)


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(1)
    rows, x, y = np.repeat([0, 1], [3, 4]), rng.normal(size=(7, Q.FEATURES)), rng.integers(0, 2, 7)
    f = Q.Field(rng.normal(size=(Q.FEATURES, 2)), rng.normal(size=(2, 2)))

    def likelihood(g):
        total = 0
        for r in (0, 1):
            e, z = x[rows == r] @ g.emit, y[rows == r]
            score = lambda s: sum(e[i, k] for i, k in enumerate(s)) + sum(g.move[a, b] for a, b in zip(s, s[1:]))  # noqa: E731, B023
            total += score(z) - np.log(sum(np.exp(score(s)) for s in product((0, 1), repeat=len(e))))
        return total / len(y)

    emit, move = Q._gradient(x, y, rows, f)
    for part, grad, at in ((f.emit, emit, (4, 1)), (f.move, move, (0, 1))):
        before = likelihood(f)
        part[at] += 1e-5
        assert abs((likelihood(f) - before) / 1e-5 - grad[at]) < 1e-3
        part[at] -= 1e-5


def test_no_labels(empty, odd, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert Q.judge(odd, Q.fit(odd, none)).count() == odd.count()


def test_lines_without_words():
    m = Q.measure(*utf8(pa.array(["\n\n", "a\n\n b \n", None])))
    assert m["line_row"].tolist() == [1, 1] and m["counts"]["n_words"].tolist() == [0, 2, 0]
