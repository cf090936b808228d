import hashlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from sheaf.llm import queries
from sheaf.llm import sentence_pieces as S

PATH = queries.tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    with open(PATH, "rb") as f:
        return S.Pieces(f.read())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(alphabet="abcdeité ▁\n\t", max_size=30), st.text(max_size=20)), max_size=4))
def test_same_ids_and_text_as_the_library(pieces, library, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    for t, raw in zip(texts, pieces.encode_batch(texts)):
        ids = np.frombuffer(raw, "<u4").tolist()
        assert ids == library.encode(t)
        assert pieces.decode(np.array([1, *ids, 2])).decode("utf-8", "replace") == library.decode([1, *ids, 2])
    pieces.check()


def test_matrix_and_heap_agree(pieces, texts):
    words = sorted({"▁" + w for t in texts.values() for w in t.split() if len(w) < 31})[:2000]
    for w, got in zip(words, pieces.learn(words)):
        assert got == np.array(pieces.merge(w), dtype="<u4").tobytes()


def test_a_difference_is_an_error(pieces):
    pieces.fresh.append((["▁word"], [b"\0\0\0\0"]))
    with pytest.raises(AssertionError):
        pieces.check()
    pieces.fresh.clear()


def test_forgetting_changes_nothing(library, texts):
    with open(PATH, "rb") as f:
        small = S.Pieces(f.read(), remembered=50)
    some = list(texts.values())[:40]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for t in some for x in small.encode_batch([t])] == library.encode(some)


def test_query(spark, sf, odd, empty, texts, library):
    for r in queries.op4_sentence_pieces(spark, sf).collect():
        ids = library.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()
        )
    rows = S.encode_decode(odd, PATH, whole_every=1).collect()
    assert len(rows) == odd.count() and all(r.n_tokens == 2 and r.decoded == "" for r in rows if r.doc_id in (0, 1))
    assert S.encode_decode(empty, PATH).count() == 0
