import re
from pathlib import Path

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline as P
from sheaf.llm import common
from sheaf.llm import jaccard_join as J
from sheaf.llm.common import cut
from sheaf.llm.queries import tokenizer_path


def test_stages_one_after_the_other(spark, sf, docs):
    good = {r.doc_id: r.quality == 1 and not r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    now, before = docs, None
    for name, stage in P.STAGES[:-1]:
        before, now = now, cut(stage(spark, now, sf), name)
        assert now.columns == docs.columns
        had, has = ({r.doc_id: r for r in x.collect()} for x in (before, now))
        assert set(has) <= set(had) and all(has[i] == had[i] for i in has)
        gone = [i for i in had if i not in has]
        if name == "quality_classifier":
            assert np.mean([i in has for i in had if good.get(i)]) >= 0.95 and gone
        elif name == "language_id":
            assert np.mean([i in has for i in had if good.get(i)]) >= 0.97
        elif name == "exact_dedup":
            texts = [" ".join(r.text.split()) for r in has.values()]
            assert len(set(texts)) == len(texts) and {" ".join(r.text.split()) for r in had.values()} == set(texts)
        else:
            sets = {i: J.shingles(r.text) for i, r in had.items()}
            left = sorted(has)
            assert not any(J.linked(sets[a], sets[b]) for k, a in enumerate(left) for b in left[:k])
            assert all(any(J.linked(sets[i], sets[j]) for j in had if j != i) for i in gone)
    tokens = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    tokens.encode_special_tokens = True
    packed = P.STAGES[-1][1](spark, now, sf).collect()
    assert sum(r.length for r in packed) == sum(len(tokens.encode(r.text, add_special_tokens=False).ids) + 1 for r in now.collect())
    assert sorted((r.doc_id, r.start) for r in P.run(spark, sf).collect()) == sorted((r.doc_id, r.start) for r in packed)


def test_odd_tables(spark, odd, empty, tmp_path):
    """Null and empty texts, rows without a key and rows that repeat, through every stage and through run."""
    for df, name in ((odd, "odd"), (empty, "empty")):
        folder = str(tmp_path / name)
        df.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(3, 1, 0), (None, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        now = spark.read.parquet(f"{folder}/documents.parquet")
        for stage, f in P.STAGES:
            before, now = now, cut(f(spark, now, folder), stage)
            had, has = (sorted(map(str, x.collect())) for x in (before, now))
            if stage == "quality_classifier":  # no trusted document sets bounds: only rows without a character go
                assert has == sorted(str(r) for r in before.collect() if r.text)
            elif stage == "language_id":
                assert set(has) <= set(had) and all(any(c.isalpha() for c in r.text) for r in now.collect())
            elif stage == "exact_dedup":
                texts = [" ".join(r.text.split()) for r in now.collect()]
                assert len(texts) == len(set(texts)) and set(texts) == {" ".join(r.text.split()) for r in before.collect()}
            elif stage == "ngram_jaccard_join":
                sets = [J.shingles(r.text) for r in now.collect() if r.doc_id is not None]
                assert set(has) <= set(had) and not any(J.linked(a, b) for i, a in enumerate(sets) for b in sets[:i])
            else:
                assert sorted(str(r.doc_id) for r in now.where("start = 0").collect()) == sorted(str(r.doc_id) for r in before.collect())
            if name == "empty":
                assert not has
        assert sorted(map(str, P.run(spark, folder).drop("sequence_id", "offset").collect())) == sorted(map(str, now.drop("sequence_id", "offset").collect()))


def test_heaps_are_emptied_before_a_stage(spark, sf, docs):
    def collections():
        beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
        return sum(b.getCollectionCount() for b in beans if "Young" not in b.getName() and "Scavenge" not in b.getName() and b.getName() != "Copy")

    seen = []
    stage = P._stage(lambda spark, docs, sf_dir: seen.append(collections()) or docs)
    before = collections()
    assert stage(spark, docs, sf).columns == docs.columns
    assert seen[0] > before


def test_a_stage_lets_the_driver_give_memory_back(spark, sf, docs, monkeypatch):
    """Between the tables of a stage, what its JVM has freed goes to the system."""
    monkeypatch.setattr(common, "EVERY", 0.0)
    jvm = spark._jvm
    pid = jvm.java.lang.ProcessHandle.current().pid()
    native = lambda: int(re.search(r"RssAnon:\s+(\d+)", Path(f"/proc/{pid}/status").read_text())[1]) / 1024
    seen = {}

    def stage(spark, docs, sf_dir):
        out = cut(docs.limit(3), "one")
        held, block = [jvm.java.util.zip.Deflater() for _ in range(300)], spark.sparkContext._gateway.new_array(jvm.byte, 1 << 16)
        for x in held:
            x.setInput(block)
            x.deflate(block)
        for x in held[:-1]:
            x.end()  # the last one's memory lies above theirs, so that glibc keeps it
        seen["full"] = native()
        out = cut(out, "two")
        seen["left"] = native()
        held[-1].end()
        return out

    assert P._stage(stage)(spark, docs, sf).count() == 3
    assert seen["full"] - seen["left"] > 30
