import math
import tracemalloc
import zlib
from collections import Counter, defaultdict
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sheaf.llm import quality_lm as Q
from sheaf.llm.common import utf8


def windows(t):
    s = [0, 0, 0] + [ord(c) + 1 for c in t or ""] + [0]
    return [tuple(s[i : i + 4]) for i in range(len(s) - 3)] if t else []


class Plain:
    """Interpolated modified Kneser-Ney over dictionaries."""

    def __init__(self, texts):
        self.count = {4: Counter(g for t in texts for g in windows(t))}
        for k in (3, 2, 1):
            self.count[k] = Counter(g[1:] for g in self.count[k + 1])
        self.off, self.sums = {}, {}
        for k, c in self.count.items():
            n1, n2, n3, n4 = (sum(v == i for v in c.values()) for i in (1, 2, 3, 4))
            self.off[k] = [0.5] * 3
            if n1 and n2 and n3:
                y = n1 / (n1 + 2 * n2)
                self.off[k] = [min(max(d, 0.05), m) for d, m in zip((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3), (0.95, 1.95, 2.95))]
            self.sums[k] = defaultdict(lambda: [0, 0.0])
            for g, n in c.items():
                self.sums[k][g[:-1]][0] += n
                self.sums[k][g[:-1]][1] += self.off[k][min(n, 3) - 1]

    def p(self, g):
        if not g:
            return 1 / (0x110000 + 1)
        k, below = len(g), self.p(g[1:])
        if g[:-1] not in self.sums[k]:
            return below
        total, left = self.sums[k][g[:-1]]
        n = self.count[k].get(g, 0)
        return (n - self.off[k][min(n, 3) - 1] if n else 0) / total + left / total * below


@pytest.mark.parametrize("slice_, dense", [(Q.SLICE, Q.DENSE), (16, 10)])
def test_grams_are_those_of_each_text(monkeypatch, slice_, dense):
    monkeypatch.setattr(Q, "SLICE", slice_)
    monkeypatch.setattr(Q, "DENSE", dense)
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("ab é日本🙂\x00\n"), rng.choice([0, 1, 2, 3, 5, 40]))) for _ in range(60)] + [None, "x" * 200]
    got = defaultdict(list)
    for s, at, row in Q.sequences(*utf8(pa.array(texts))):
        names, number = Q.numbered(s, at)
        symbols = np.frombuffer(b"".join(x.ljust(16, b"\0") for x in names.tolist()), ">u4").reshape(-1, 4)
        assert len(set(names.tolist())) == len(names)
        for k, r in zip(number, row):
            got[r].append(tuple(symbols[k].tolist()))
    assert all(got[i] == windows(t) for i, t in enumerate(texts))


def test_log_probabilities_match_the_formula_and_sum_to_one(spark):
    texts = ["the cat sat on the mat", "a cat and a hat, that cat", "日本の猫", "x"] * 2
    plain = Plain(texts)
    known = sorted({s for g in plain.count[4] for s in g})
    asked = set(plain.count[4]) | {g for t in ("the hat sat", "猫の日", "zq") for g in windows(t)} | {(9, 9, 9, 9)} | {(117, 105, 102, s) for s in known}
    name = lambda g: b"".join(s.to_bytes(4, "big") for s in g)
    seen = spark.createDataFrame([(bytearray(name(g)), plain.count[4].get(g, 0)) for g in asked], "gram binary, n long")
    got = {bytes(r.gram): r.lp for r in Q.log_probabilities(seen).collect()}
    assert len(got) == len(asked) and all(math.isclose(got[name(g)], math.log(plain.p(g)), rel_tol=1e-9) for g in asked)
    unseen = (Q.SYMBOLS - len(known)) * plain.p((117, 105, 102, 0xFFFF))
    assert math.isclose(sum(math.exp(got[name((117, 105, 102, s))]) for s in known) + unseen, 1)


def brute(rows, labels, tail=0.01, spread=2.0, least=100, short=200):
    good = {i for i in {x[0] for x in labels} if i is not None and all(q == 1 and not t for j, q, t in labels if j == i)}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    plain = Plain([t for i, t, _ in rows if i in good and not held(i)])
    logs, out = {}, []
    for i, t, lang in rows:
        w = windows(t)
        for g in set(w) - logs.keys():
            logs[g] = math.log(plain.p(g))
        out.append((i, lang, max(0, len(w) - 1), -sum(logs[g] for g in w) / len(w) if w else None))
    known = defaultdict(list)
    for i, lang, chars, nll in out:
        if i in good and held(i) and chars >= short:
            known[lang].append(nll)
            known["all of them"].append(nll)

    def quantile(lang):
        own = lang is not None and len(known[lang]) >= least
        x = sorted(known[lang if own else "all of them"])
        if not x:
            return None
        q = [x[max(0, math.ceil(p * len(x)) - 1)] for p in (tail, 0.5, 1 - tail)]
        reach = 1 if own or len(x) == 1 else max(1, NormalDist().inv_cdf(1 - tail) / NormalDist().inv_cdf(len(x) / (len(x) + 1)))
        return [q[1] + (y - q[1]) * reach for y in q]

    for i, lang, chars, nll in out:
        q = quantile(lang)
        wide = spread * max(1, math.sqrt(400 / max(chars, 1)))
        low, high = (q[1] - wide * (q[1] - q[0]), q[1] + wide * (q[2] - q[1])) if q else (None, None)
        yield i, lang, chars, nll, low, high, nll is not None and (q is None or low <= nll <= high)


def close(a, b):
    return a == b or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9))


@pytest.mark.parametrize("options", [{}, {"least": 3, "short": 50, "tail": 0.2, "spread": 1.0, "chunk_bytes": 20_000}])
def test_every_column_matches_brute_force(spark, sf, docs, options):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    some = {k: v for k, v in options.items() if k != "chunk_bytes"}
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    want = {x[0]: x for x in brute(rows, [(r.doc_id, r.quality, r.toxic) for r in labels.collect()], **some)}
    got = Q.classify(docs, labels, **options).collect()
    assert len(got) == len(want)
    log = lambda x: None if x is None else math.log(x)
    for r in got:
        _, lang, chars, nll, low, high, kept = want[r.doc_id]
        assert (r.lang, r.chars, r.kept) == (lang, chars, kept)
        assert close(log(r.perplexity), nll) and close(log(r.low), low) and close(log(r.high), high)
    assert (len({r.low for r in got if r.chars >= 400}) == 1) == (not options)  # with few documents all languages share one bound


def test_verdicts(spark, sf, docs, odd, empty):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = {r.doc_id: r.kept for r in Q.classify(docs, labels).collect()}
    clean = [r.doc_id for r in labels.collect() if r.quality == 1 and r.toxic == 0]
    assert np.mean([kept[i] for i in clean]) >= 0.95
    bad = [r.doc_id for r in labels.collect() if r.quality == 0]
    assert np.mean([kept[i] for i in bad]) <= 0.4
    none = labels.where("false")
    for df, n in ((odd, odd.count()), (empty, 0)):
        rows = Q.classify(df, none).collect()
        assert len(rows) == n and all(r.kept == bool(r.chars) for r in rows)
    odd_labels = spark.createDataFrame([(3, 1, None), (3, None, 0), (None, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    wide = odd.withColumn("chunk", F.lit(1)).withColumn("place", F.lit("p")).withColumn("blob", F.array(F.lit(1.5))).withColumn("c0", F.lit(None).cast("string"))
    said = sorted((str(r.doc_id), r.chars) for r in Q.classify(wide, odd_labels).collect() if r.kept)
    left = Q.keep(wide, odd_labels)
    assert left.columns == wide.columns and sorted((str(r.doc_id), len(r.text)) for r in left.collect()) == said
    assert Q.keep(empty, odd_labels).columns == empty.columns and Q.keep(empty, odd_labels).count() == 0


def test_texts_of_other_scripts_are_told_apart(spark):
    prose, rare = "日本語の文章です。今日は天気がいい。" * 20, "鑫龘靐齉爩麤灪龗厵飝籱爨癵籲" * 20
    rows = [(i, prose[i % 7 :], "ja") for i in range(40)] + [(100, prose[5:90], "ja"), (101, rare[5:90], "ja")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in Q.classify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels, least=3).collect()}
    assert got[100].perplexity * 100 < got[101].perplexity and not got[101].kept


def test_memory_beside_the_heap_is_a_few_times_a_chunk():
    """A chunk of 8 MB, as a worker's two functions get it: their arrays stay under 6 times its size, and what they find is right."""
    rng = np.random.default_rng(0)
    words = ["".join(x) for x in rng.choice(list("etaoinshrdluéü"), (5000, 6))]
    texts = [" ".join(words[i] for i in rng.integers(0, 5000, 450)) for _ in range(24)] * 100
    rows = pa.RecordBatch.from_pydict({"text": texts})
    size = sum(len(t.encode()) for t in texts)
    assert 7 << 20 < size < 9 << 20

    class Chunks:
        fields = {}

        def gather(self, more, function, schema):
            return function

    class Nothing:
        def select(self, *columns):
            return self

    def peak(function, *args):
        tracemalloc.start()
        try:
            return function(*args), tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    flags = pa.table({"chunk": pa.array([0] * 2, pa.int64()), "place": pa.array([0, 2399], pa.int32())})
    asked, most = peak(Q._questions(Chunks(), Nothing(), "text"), 0, rows, flags)
    assert most < 6 * size
    count = Counter(np.array(g, ">u4").tobytes() for i in (0, 2399) for g in windows(texts[i]))
    grams = asked.column("gram").to_pylist()
    assert len(set(grams)) == len(grams) and {g: n for g, n in zip(grams, asked.column("n").to_pylist()) if n} == count
    assert set(grams) == {np.array(g, ">u4").tobytes() for g in set().union(*(windows(t) for t in texts[:24]))}

    answers = pa.table({"chunk": asked.column("chunk"), "gram": asked.column("gram"), "lp": pa.array(np.full(len(grams), -2.0))})
    scored, most = peak(Q._scores(Chunks(), Nothing(), "text", {}), 0, rows, answers)
    assert most < 6 * size
    assert scored.column("chars").to_pylist() == [len(t) for t in texts] and set(scored.column("nll").to_pylist()) == {2.0}
