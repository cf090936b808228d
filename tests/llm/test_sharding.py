import zlib

from sheaf.llm import queries, sharding


def test_every_row_once_and_shards_even(docs, odd):
    for df, n in ((docs, 200), (odd, odd.count())):
        rows = sharding.shuffle_into_shards(df, shards=7, bucket_bytes=50_000).select("record.doc_id", "record.text", "shard", "slot").collect()
        assert sorted((str(r.doc_id), str(r.text)) for r in rows) == sorted((str(r.doc_id), str(r.text)) for r in df.collect())
        by = {}
        for r in rows:
            by.setdefault(r.shard, []).append(r.slot)
        sizes = [len(by.get(s, [])) for s in range(7)]
        assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
        assert all(sorted(x) == list(range(len(x))) for x in by.values())


def test_same_seed_same_order_other_seed_other_order(docs):
    place = lambda seed: {r.doc_id: (r.shard, r.slot) for r in sharding.shuffle_into_shards(docs, 5, seed, bucket_bytes=100_000).select("record.doc_id", "shard", "slot").collect()}
    a, b, c = place(1), place(1), place(2)
    assert a == b and a != c
    ids = [k for k, _ in sorted(a.items(), key=lambda x: x[1])]
    rises = sum(x < y for x, y in zip(ids, ids[1:]))
    assert 70 < rises < 130  # neither sorted by id nor by anything that follows it


def test_empty_table(empty):
    out = sharding.shuffle_into_shards(empty)
    assert out.count() == 0 and out.columns == ["record", "shard", "slot"]


def test_written_shards_keep_their_order(spark, docs, tmp_path):
    dealt = sharding.shuffle_into_shards(docs, 3)
    sharding.write_shards(dealt, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 200
    want = {(r.shard, r.slot): r.id for r in dealt.selectExpr("shard", "slot", "record.doc_id as id").collect()}
    assert all(want[r["__shard"], r["__slot"]] == r.doc_id for r in back.collect())


def test_query_digests(spark, sf, texts):
    rows = queries.op7_shuffled_shards(spark, sf).collect()
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
    assert {r.shard for r in rows} == set(range(40))
