"""Exact dedup by skew-safe combining.

Rows are equal when their normalised texts (white-space runs as one space, null
as empty) are identical. Three stages, each of which compares whole texts, not
only digests:

1. local: the map side of the first aggregation merges equal texts of a task;
2. salted: groups (digest, salt, text) merge over all tasks, so that a text held
   by a third of all rows reaches many reducers, one row per task at most;
3. global: the salt winners of a text merge, at most `salts` rows each.

A text crosses the network once per stage, whatever the size of its group.
Rows then learn their group by digest. Should two texts share a digest, the rows
of just those digests join by digest and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.chunked import chosen, lay
from sheaf.llm.common import SPACE_CLASS, cut, tidy

#: Names no input column may clash with: everything internal is prefixed.
P = "__xd_"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE_CLASS, " ")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def exact_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", salts: int = 16, digest_of=digest) -> DataFrame:
    """One row per row of `docs`: key, keep_id, group_size, kept, text_sha256.

    Null texts and empty ones are one group. Of equal texts the smallest key
    stays; a null key stays only where the group has no other. Repeated rows
    (same key, same text) all carry kept = true if theirs is the winning key;
    `dedup` leaves one of them. Empty tables give no rows; further columns of
    `docs` are not read, whatever their names.
    """
    rows = docs.select(F.col(key).alias(f"{P}key"), normalised(F.col(text)).alias(f"{P}text")).withColumn(f"{P}digest", digest_of(F.col(f"{P}text")))
    salted = (
        rows.withColumn(f"{P}salt", F.pmod(F.xxhash64(f"{P}key"), F.lit(salts)))
        .groupBy(f"{P}digest", f"{P}salt", f"{P}text")
        .agg(F.min(f"{P}key").alias(f"{P}keep"), F.count(F.lit(1)).alias(f"{P}n"))
    )
    groups = salted.groupBy(f"{P}digest", f"{P}text").agg(F.min(f"{P}keep").alias(f"{P}keep"), F.sum(f"{P}n").alias(f"{P}n"))
    # One row per digest, without the text: its only text's group, or a mark that texts must be compared again.
    by_digest = cut(
        groups.groupBy(f"{P}digest").agg(
            F.min(f"{P}keep").alias(f"{P}keep"), F.max(f"{P}n").alias(f"{P}n"), F.count(F.lit(1)).alias(f"{P}texts")
        ),
        "digests",
    )
    clash = by_digest.where(F.col(f"{P}texts") > 1).select(f"{P}digest")
    narrow = rows.select(f"{P}key", f"{P}digest")
    if clash.isEmpty():
        return _columns(narrow.join(by_digest, f"{P}digest"), key)
    exact = rows.join(groups.join(clash, f"{P}digest", "left_semi"), [f"{P}digest", f"{P}text"])
    return _columns(narrow.join(by_digest.where(F.col(f"{P}texts") == 1), f"{P}digest"), key).unionByName(_columns(exact, key))


def _columns(found: DataFrame, key: str) -> DataFrame:
    return found.select(
        F.col(f"{P}key").alias(key),
        F.col(f"{P}keep").alias("keep_id"),
        F.col(f"{P}n").alias("group_size"),
        F.col(f"{P}key").eqNullSafe(F.col(f"{P}keep")).alias("kept"),
        F.col(f"{P}digest").alias("text_sha256"),
    )


@tidy
def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", salts: int = 16) -> DataFrame:
    """The rows of `docs` that stay, with all their columns.

    A row is named by its key and the digest of its text; of rows that repeat
    both, one stays. Rows without a key never win against one that has a key, and
    count as one. Whole rows lie in chunks; only names are joined.
    """
    named = docs.withColumn(f"{P}name", F.struct(F.col(key).alias("key"), digest(normalised(F.col(text))).alias("digest")))
    chunks = lay(named, f"{P}name", text)
    stay = exact_groups(docs, text, key, salts).where("kept").select(F.col(key).alias("k"), F.col("text_sha256").alias("d")).distinct()
    names = chunks.names.groupBy("key").agg(F.min(F.struct("chunk", "place")).alias("at"))
    which = names.join(stay, F.col("key.key").eqNullSafe(F.col("k")) & (F.col("key.digest") == F.col("d")), "left_semi").select("at.*")
    return chosen(chunks, which).drop(f"{P}name")
