import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from sheaf.llm import exact_dedup


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def brute(rows):
    groups = defaultdict(list)
    for k, t in rows:
        groups[norm(t)].append(k)
    out = []
    for k, t in rows:
        ids = [x for x in groups[norm(t)] if x is not None]
        keep = min(ids) if ids else None
        out.append((k, keep, len(groups[norm(t)]), k == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_groups_match_brute_force(docs, odd, empty):
    for df in (docs, odd):
        got = sorted((tuple(r) for r in exact_dedup.exact_groups(df).collect()), key=str)
        assert got == brute(rows_of(df))
    assert exact_dedup.exact_groups(empty).count() == 0


def test_texts_with_one_digest_are_compared_in_full(docs):
    short = lambda t: F.substring(F.sha2(t.cast("binary"), 256), 1, 1)
    got = sorted((tuple(r)[:4] for r in exact_dedup.exact_groups(docs, digest_of=short).collect()), key=str)
    assert got == sorted((x[:4] for x in brute(rows_of(docs))), key=str)


def test_dedup_leaves_one_row_of_each_text(odd, empty):
    kept = exact_dedup.dedup(odd)
    assert kept.columns == odd.columns
    left = [norm(r.text) for r in kept.collect()]
    assert sorted(left) == sorted({norm(t) for _, t in rows_of(odd)})
    assert exact_dedup.dedup(empty).count() == 0
