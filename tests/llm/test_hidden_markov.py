import math
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa

from sheaf.llm import hidden_markov as H
from sheaf.llm import queries
from sheaf.llm.common import utf8, word_hashes

W = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(t):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in W.findall(t or "")] + ["\n"]


def brute(rows):
    train = [k is None or zlib.crc32(str(k).encode()) % 5 != 1 for k, _ in rows]
    c = Counter(w for (_, t), ok in zip(rows, train) if ok for w in tokens(t))
    n, v = sum(c.values()), len(c)
    out = []
    for (k, t), ok in zip(rows, train):
        w = tokens(t)
        out.append((str(k), not ok, len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 4)))
    return sorted(out)


def test_base_figures(spark, sf, texts, odd, empty):
    got = queries.op10_hidden_markov(spark, sf).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == brute(list(texts.items()))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) >= sum(r.base_score for r in held)  # the states help on texts they were not trained on
    rows = H.score(odd).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert all(r.score < 0 and math.isfinite(r.score) for r in rows)
    assert H.score(empty).count() == 0


def small(seed=0, states=3):
    rng = np.random.default_rng(seed)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    emit = np.zeros((H.SYMBOLS, states))
    emit[:5] = rng.random((5, states)) + 0.1
    return H.HMM(norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(emit, 0), np.zeros(1), np.zeros(1), 1, 1, 1)


def paths(h, seq):
    """Probability of each path of states."""
    for path in product(range(len(h.first)), repeat=len(seq)):
        p = h.first[path[0]] * h.emit[seq[0], path[0]]
        for (a, b), s in zip(zip(path, path[1:]), seq[1:]):
            p *= h.move[a, b] * h.emit[s, b]
        yield path, p


def test_forward_is_the_sum_over_all_paths(monkeypatch):
    monkeypatch.setattr(H, "SEGMENT", 2)
    h, length = small(), np.array([4, 1, 5, 2, 7])
    seq = np.random.default_rng(1).integers(0, 5, length.sum())
    got, at = H.forward(h, seq, length), 0
    for n, x in zip(length, got):
        assert math.isclose(x, math.log(sum(p for _, p in paths(h, seq[at : at + n]))), rel_tol=1e-9)
        at += n


def test_expected_counts_are_those_of_all_paths(monkeypatch):
    monkeypatch.setattr(H, "SEGMENT", 4)
    monkeypatch.setattr(H, "BLOCK", 6)
    h, length = small(2), np.array([4, 3, 6, 9])
    seq = np.random.default_rng(3).integers(0, 5, length.sum())
    first, move, emit = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    at = 0
    for n in (4, 3, 6, 9):  # some texts fall into segments, but count as a whole
        part = seq[at : at + n]
        total = sum(p for _, p in paths(h, part))
        for path, p in paths(h, part):
            first[path[0]] += p / total
            for a, b in zip(path, path[1:]):
                move[a, b] += p / total
            for s, k in zip(part, path):
                emit[s, k] += p / total
        at += n
    got = H.expected(h, seq, length)
    assert np.allclose(got[0], first) and np.allclose(got[1], move) and np.allclose(got[2][:5], emit)


def test_training_raises_the_likelihood_and_one_state_is_the_base(docs):
    base = {r.doc_id: r for r in H.score(docs, states=1, rounds=1).collect()}
    assert all(math.isclose(r.score, r.base_score, rel_tol=1e-6) for r in base.values())
    total = lambda rounds: sum(r.score for r in H.score(docs, rounds=rounds).collect() if not r.held_out)
    assert total(6) > total(2)


def test_every_word_has_its_own_emissions_over_whole_texts(spark):
    """Plain Baum-Welch over a dictionary of words, on texts longer than a segment and words that share 16 bits of their hash."""
    rng = np.random.default_rng(5)
    names = [f"w{i}" for i in range(2000)]
    texts = [" ".join(rng.choice(names[1000 * (i % 2) : 1000 * (i % 2) + 1000], 3 * H.SEGMENT)) for i in range(12)] + ["w1 new w1500", ""]
    keys = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 != 1][:12] + [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    train = [tokens(t) for t in texts[:12]]
    count = Counter(w for t in train for w in t)
    vocab = sorted(set(count) - {"\n"})
    raw, off = utf8(pa.array(vocab))
    h = word_hashes(raw, off[:-1], off[1:])
    assert len(set((h % np.uint64(1 << 16)).tolist())) < len(vocab)

    k, seed = 2, np.random.default_rng(3)
    noise = np.stack([H.mix(h + np.uint64(0x9E3779B97F4A7C15 * (4 + j) % (1 << 64))) for j in range(k)], axis=1) / 2.0**64 + 0.5
    ends = (0.5 + np.array([[12], [0]])) / k * seed.uniform(0.5, 1.5, (2, k))
    weight = np.concatenate([(np.array([[count[w]] for w in vocab]) + 0.5) / k * noise, ends])
    move = np.eye(k) + seed.uniform(0.5, 1.0, (k, k))
    emit, move, first = weight / weight.sum(axis=0), move / move.sum(axis=1, keepdims=True), np.full(k, 1 / k)
    number = {w: i for i, w in enumerate([*vocab, "\n"])}
    for _ in range(2):
        f, m, e = np.full(k, 0.5), np.full((k, k), 0.5), np.full(emit.shape, 0.5 / k)
        for t in train:
            s = [number[w] for w in t]
            a, b = [first * emit[s[0]]], [np.ones(k)]
            for x in s[1:]:
                a.append((a[-1] / a[-1].sum()) @ move * emit[x])
            for x in s[:0:-1]:
                back = move @ (emit[x] * b[-1])
                b.append(back / back.sum())
            post = np.array(a) * np.array(b[::-1])
            post /= post.sum(axis=1, keepdims=True)
            f += post[0]
            for i, x in enumerate(s):
                e[x] += post[i]
                if i:
                    step = a[i - 1][:, None] * move * emit[x] * b[::-1][i]
                    m += step / step.sum()
        first, move, emit = f / f.sum(), m / m.sum(axis=1, keepdims=True), e / e.sum(axis=0)
    want = {}
    for key, t in zip(keys, texts):
        v, total = first, 0.0
        for i, w in enumerate(tokens(t)):
            v = (v @ move if i else v) * emit[number.get(w, len(vocab) + 1)]
            total += math.log10(v.sum())
            v = v / v.sum()
        want[key] = total
    docs = spark.createDataFrame(list(zip(keys, texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in H.score(docs, rounds=2, states=k).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-5) for i in want)
