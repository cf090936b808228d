import numpy as np

from sheaf.llm import language_id as L
from sheaf.llm import queries


def test_held_out_accuracy(spark, docs, sf):
    said = {r.doc_id: r for r in queries.op1_language_id(spark, sf).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect() if len(r.text.split()) >= 5}
    held = [i for i in truth if said[i].held_out]
    assert len(held) > 20 and np.mean([said[i].lang_pred == truth[i] for i in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in said.values())


def test_odd_texts(odd, empty, docs):
    m = L.fit(docs)
    got = {}
    for r in L.identify(odd, m).collect():
        got.setdefault(r.doc_id, r)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and not got[i].ambiguous for i in (0, 1, 2, 7))
    assert all(got[i].lang_pred in m.languages for i in (3, 6, 11, 12))
    assert L.identify(empty, m).count() == 0 and L.identify(odd, m).count() == odd.count()


def test_without_labels_all_is_undetermined(odd, empty):
    m = L.fit(empty)
    assert m.languages == [] and {r.lang_pred for r in L.identify(odd, m).collect()} == {"und"}


def test_codes_and_loss_weighted_decoding():
    assert L.codebook(4).shape == (4, 7) and L.codebook(1).shape == (1, 1)
    wide = L.codebook(12)
    apart = [(wide[i] != wide[j]).sum() for i in range(12) for j in range(i)]
    assert wide.shape[0] == 12 and min(apart) >= 10
    m = L.Coded(list("abcd"), L.codebook(4), np.zeros((1, 7)), np.zeros(7), np.ones(7))
    margins = 4.0 * m.codes + 0
    margins[2, 0] *= -1  # one wrong bit is corrected
    best, score, lead = L.decode(m, margins)
    assert best.tolist() == [0, 1, 2, 3] and (score > 0.5).all() and (lead > 0).all()
    undecided = L.decode(m, np.zeros((1, 7)))
    assert undecided[0][0] == 0 and undecided[2][0] == 0  # a tie goes to the first and has no lead


def test_features_are_unit_vectors_over_whole_texts():
    from sheaf.llm.common import utf8
    import pyarrow as pa

    x = L.features(*utf8(pa.array(["abc def", "", None, "ABC  def", "é" * 10])))
    assert np.allclose((x * x).sum(axis=1), [1, 0, 0, 1, 1], atol=1e-5) and np.allclose(x[0], x[3])
