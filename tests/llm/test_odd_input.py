"""What all operators have in common: clashing names, repeated rows, and a text that crosses every slice."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sheaf.llm import common, exact_dedup, hidden_markov, jaccard_join, language_id, packing, quality_lm, quality_rules, sentence_pieces, sharding, token_counts
from sheaf.llm.queries import tokenizer_path

BPE, PIECE = "byte_bpe_50k.json", "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def long(spark):
    """Two equal texts of 1.2 MB, a third that differs in its last word, and one word of 200 KB."""
    rng = np.random.default_rng(0)
    letters = np.array(list("abcdefghij"))
    words = ["".join(x) for x in rng.choice(letters, (20_000, 6))]
    body = " ".join(words[i] + ("\n" if i % 11 == 0 else "") for i in rng.integers(0, 20_000, 180_000))
    assert len(body) > 1_200_000
    texts = [body, body, body + " end", "z" * 50_000, None]
    return spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(2).cache(), texts


def test_very_long_texts(spark, long):
    docs, texts = long
    labels = spark.createDataFrame([(0, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    n_words = [len((t or "").split()) for t in texts]

    said = language_id.identify(docs, language_id.fit(docs)).collect()
    assert sorted((r.doc_id, r.lang_pred) for r in said) == [(0, "en"), (1, "en"), (2, "en"), (3, "en"), (4, "und")]

    w = texts[0].split()
    near = {r.doc_id: r for r in jaccard_join.near_duplicates(docs).collect()}
    assert [near[i].component_id for i in range(5)] == [0, 0, 0, 3, 4] and near[0].n_shingles == len({tuple(w[i : i + 5]) for i in range(len(w) - 4)})

    scored = {r.doc_id: r for r in quality_lm.classify(docs, labels).collect()}
    assert [scored[i].chars for i in range(5)] == [len(t or "") for t in texts] and scored[0].perplexity == scored[1].perplexity < scored[3].perplexity

    ids = Tokenizer.from_file(tokenizer_path(BPE)).encode(texts[0], add_special_tokens=False).ids
    packed = packing.pack_documents(docs, tokenizer_path(BPE)).where("doc_id < 2").orderBy("doc_id", "start").collect()
    raw = np.array([*ids, 0], dtype="<u4").tobytes()
    for k in (0, 1):
        assert [(r.length, r.ids_crc32) for r in packed if r.doc_id == k] == [(len(x) // 4, zlib.crc32(x)) for x in (raw[i : i + 4096] for i in range(0, len(raw), 4096))]
    assert {r.doc_id: r.n_tokens for r in token_counts.count_documents(docs, tokenizer_path(BPE), 50256).collect()}[1] == len(ids)

    ruled = {r.doc_id: r for r in quality_rules.judge(docs, quality_rules.fit(docs, labels)).collect()}
    assert [ruled[i].n_words for i in range(5)] == n_words and ruled[2].word_chars == len(re.sub(r"\s", "", texts[2]))

    dealt = sharding.shuffle_into_shards(docs, 2).select("record.doc_id", F.length("record.text").alias("n")).collect()
    assert sorted((r.doc_id, r.n or 0) for r in dealt) == [(i, len(t or "")) for i, t in enumerate(texts)]

    equal = {r.doc_id: r for r in exact_dedup.exact_groups(docs).collect()}
    assert [equal[i].keep_id for i in range(5)] == [0, 0, 2, 3, 4]
    assert equal[3].text_sha256 == hashlib.sha256(texts[3].encode()).hexdigest()

    likely = {r.doc_id: r for r in hidden_markov.score(docs, rounds=1).collect()}
    assert [likely[i].n_tokens for i in range(5)] == [n + 1 for n in n_words] and np.isfinite([r.score for r in likely.values()]).all()


def test_long_text_of_sentence_pieces(spark):
    import sentencepiece

    text = " ".join(f"word{i % 977} and  more" for i in range(60_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECE))
    want = model.encode(text, add_bos=True, add_eos=True)
    got = sentence_pieces.encode_decode(docs, tokenizer_path(PIECE)).first()
    assert got.n_tokens == len(want) and bytes(got.ids) == np.array(want, dtype="<u4").tobytes() and got.decoded == model.decode(want)


def test_keys_named_like_columns_of_the_result(spark, docs):
    def named(name):
        return docs.limit(20).select(F.col("doc_id").alias(name), "text", "lang")

    ids = sorted(r.doc_id for r in docs.limit(20).select("doc_id").collect())
    held = lambda df, c: sorted({r[c] for r in df.select(c).collect()})
    for name in ("length", "start"):
        assert held(packing.pack_documents(named(name), tokenizer_path(BPE), key=name), f"{name}_key") == ids
    for name in ("file", "ordinal", "tokens"):
        assert held(token_counts.count_documents(named(name), tokenizer_path(BPE), 50256, key=name), f"{name}_key") == ids
    model = language_id.fit(named("score"), key="score")
    assert held(language_id.identify(named("score"), model, key="score"), "score_key") == ids
    assert held(hidden_markov.score(named("n_known"), key="n_known", rounds=1), "n_known_key") == ids
    labels = spark.createDataFrame([], "kept long, quality int, toxic int")
    assert held(quality_lm.classify(named("kept"), labels, key="kept"), "kept_key") == ids
    assert held(quality_rules.judge(named("kept"), quality_rules.fit(named("kept"), labels, key="kept"), key="kept"), "kept_key") == ids


def test_samples_are_bounded_where_keys_repeat(spark, monkeypatch):
    """3000 rows of one id are one row of a sample."""
    docs = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("line one\nline two "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    seen = []
    monkeypatch.setattr(language_id, "_fit", lambda rows, y, languages: seen.append(len(y)))
    language_id.fit(docs, per_language=400)
    monkeypatch.setattr(quality_rules, "train", lambda x, y, rows: seen.append(len(x)))
    labels = spark.createDataFrame([(7, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    quality_rules.fit(docs, labels, per_class=400)
    assert seen == [1, 2]


def test_maps_are_shuffled_whole(spark):
    kind = "doc_id long, text string, m map<string,int>, deep array<struct<a:map<int,string>>>"
    rows = [(i, f"t{i}", {"a": i, "b": None} if i % 3 else None, [({i: "x"},), None, (None,)] if i % 2 else []) for i in range(50)]
    out = sharding.shuffle_into_shards(spark.createDataFrame(rows, kind), 3, bucket_bytes=200)
    assert out.schema["record"].dataType.simpleString() == f"struct<{kind.replace(' long', ':bigint').replace('text string', 'text:string').replace('m map', 'm:map').replace('deep array', 'deep:array').replace(', ', ',')}>"
    back = sorted(out.select("record.*").collect(), key=lambda r: r.doc_id)
    assert [(r.doc_id, r.text, r.m, [x and (x.a,) for x in r.deep]) for r in back] == rows


def test_tables_in_the_shared_folder_go_when_an_operator_ends(spark, docs):
    folder = common.shared_dir(spark).removeprefix("file://")
    import os

    before = set(os.listdir(folder))
    out = quality_lm.classify(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert {x.split("-")[1] for x in set(os.listdir(folder)) - before} <= {"perplexity", "bounds"} and out.count() == 200
