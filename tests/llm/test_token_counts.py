import numpy as np
import pyarrow.fs as pafs
import pytest
from tokenizers import Tokenizer

from sheaf.llm import queries
from sheaf.llm import token_counts as T

PATH = queries.tokenizer_path("byte_bpe_50k.json")


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 20])
def test_scan_matches_a_plain_loop(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    files, want = [], []
    for k, n in enumerate((0, 1, 5, 300, 1000)):
        ids = rng.integers(0, 6, n).astype("<u2")
        if k == 1:
            ids[:] = 5
        path = tmp_path / f"{k}.bin"
        path.write_bytes(ids.tobytes())
        files.append((f"file://{path}", n))
        start = ordinal = 0
        for i, x in enumerate([*ids.tolist(), None]):
            if x == 5 or (x is None and i > start):
                want.append((f"file://{path}", ordinal, start, i - start))
                start, ordinal = i + 1, ordinal + 1
    got = T.scan_flat(spark.createDataFrame(files, "file string, tokens long"), end_id=5, block=block).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_query(spark, sf, texts):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    got = {r.doc_id: r.n_tokens for r in queries.op8_token_counts(spark, sf).collect()}
    assert got == {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in texts.items()}


def test_odd_texts_and_wide_ids(odd, empty):
    narrow = sorted(map(str, T.count_documents(odd, PATH, 50256, block=16).collect()))
    wide = sorted(map(str, T.count_documents(odd, PATH, 50256, width=4).collect()))
    assert narrow == wide and len(narrow) == odd.count()
    assert T.count_documents(empty, PATH, 50256).count() == 0


def test_listed_files_hold_all_tokens(docs):
    listed = T.write_flat(docs, PATH, 50256)
    for r in listed.where("ordinal = -1").collect():
        fs, path = pafs.FileSystem.from_uri(r.file)
        assert fs.get_file_info(path).size == 2 * r.tokens
