"""Exact n-gram Jaccard join by universe partition and pigeonhole.

A text's set holds its distinct word shingles. Sets with sizes n and s have a
Jaccard similarity of p percent at least if and only if their symmetric
difference is at most H = (100 - p)(n + s) / (100 + p).

1. Sizes fall into bands. A band cuts the universe of shingles, by hash, into m
   segments, so each set into m subsets. Sets that differ in at most H shingles
   agree on some segment out of any H + 1.
2. Every set is indexed by its non-empty subsets in its own band, and in those
   lower bands where a similar smaller set may be. In a band's first segments the
   subsets with one shingle deleted are indexed too; sets that differ there by
   one shingle then meet, so such a segment counts twice in the pigeonhole.
3. Signatures meet. One that no other set has costs nothing. Each set, as the
   larger of a pair, needs units of evidence H + 1 in number: it takes the free
   ones, then the cheapest (by how many sets share them) until it has enough.
   Most sets have enough free ones and look for no partner. So passages and
   lines that many texts share cost little.
4. Rarely a set has too few non-empty segments. Then the sets of its band whose
   same segments are empty are looked up as well, in a second pass.
5. Candidates are verified on their words. First each looks only at one partner
   per signature, the most central; links found make components; then those pairs of a signature
   that are in different components are verified, unless sizes or parity sketches
   of the sets show that they differ too much. Large groups of near copies
   are thus joined by a number of pairs in proportion to their size, and no link
   between components is lost.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm.chunked import Chunks, chosen, lay
from sheaf.llm.common import _LOWER, cut, hashed_words, lean, lean_group, lean_groups, mix, pulled, ship, signed, slices, tidy, utf8
from sheaf.llm.components import components

WORDS = 5
PERCENT = 80


# --- sets ----------------------------------------------------------------------


def shingle_hashes(raw: np.ndarray, off: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text: row and 64-bit hash, rows in order. Texts of 1 to k - 1 words have one, of all their words."""
    n = len(off) - 1
    h, row = hashed_words(raw, off)
    count = np.bincount(row, minlength=n)
    m = max(0, len(h) - k + 1)
    same = row[:m] == row[k - 1 : k - 1 + m]
    g = np.zeros(m, dtype=np.uint64)
    factor = 1
    for i in range(k):
        factor = factor * 0x9E3779B97F4A7C15 % (1 << 64)
        g += h[i : i + m] * np.uint64(factor)
    rows, g = row[:m][same], mix(g[same])
    first = np.cumsum(count) - count
    few = np.flatnonzero((count > 0) & (count < k))
    short = np.zeros(len(few), dtype=np.uint64)
    for j, i in enumerate(few):
        for x in h[first[i] : first[i] + count[i]].tolist():
            short[j] = np.uint64((int(short[j]) * 0xD1342543DE82EF95 + x + 1) % (1 << 64))
    rows, g = np.concatenate([rows, few]), np.concatenate([g, mix(short)])
    both = mix(g + rows.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    order = np.argsort(both)
    new = np.ones(len(both), dtype=bool)
    new[1:] = both[order][1:] != both[order][:-1]
    pick = np.sort(order[new])
    pick = pick[np.argsort(rows[pick], kind="stable")]
    return rows[pick], g[pick]


SKETCH_BITS = 1024


def sketches(rows: np.ndarray, g: np.ndarray, n: int) -> list[bytes]:
    """Parity of the number of shingles in each of SKETCH_BITS cells, a set a row. Two sets differ in as many shingles as sketches differ in bits, at least."""
    cell = rows * SKETCH_BITS + (mix(g + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(54)).astype(np.int64)
    odd = (np.bincount(cell, minlength=n * SKETCH_BITS) & 1).astype(np.uint8).reshape(n, SKETCH_BITS)
    return [x.tobytes() for x in np.packbits(odd, axis=1)]


def shingles(text: str, k: int = WORDS) -> set[tuple[bytes, ...]]:
    """The set itself, on words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def linked(a: set, b: set, percent: int = PERCENT) -> bool:
    inter = len(a & b)
    return 100 * inter >= percent * (len(a) + len(b) - inter) and bool(a and b)


def _name(words_: list[bytes]) -> bytes:
    """128 bits that name a sequence of words."""
    return hashlib.blake2b(b" ".join(words_), digest_size=16).digest()


def keys(chunks: Chunks, k: int = WORDS) -> DataFrame:
    """chunk, place, id, hi, lo, n_shingles, sketch of every row. hi and lo: 128 bits that name the lower-cased word sequence; null without words."""

    def run(name, rows: pa.RecordBatch) -> pa.Table:
        out, at = [], 0
        for b in slices([rows], "c1", 1 << 20):
            raw, off = utf8(pulled(b, "c1"))
            row, g = shingle_hashes(raw, off, k)
            n = np.bincount(row, minlength=b.num_rows)
            low = _LOWER[raw].tobytes()
            names = [_name(low[off[i] : off[i + 1]].split()) for i in range(b.num_rows)]
            pair = np.frombuffer(b"".join(names), dtype="<i8").reshape(-1, 2)
            none = n == 0
            places = pa.array(np.arange(at, at + b.num_rows, dtype=np.int32))
            at += b.num_rows
            out.append(pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, name)), places, pulled(b, "c0"), pa.array(pair[:, 0].copy(), mask=none), pa.array(pair[:, 1].copy(), mask=none), pa.array(n), pa.array(sketches(row, g, b.num_rows), pa.binary())], names=columns))
        return pa.Table.from_batches(out)

    columns = ["chunk", "place", "id", "hi", "lo", "n_shingles", "sketch"]
    return chunks.each(run, f"chunk long, place int, id {chunks.fields['c0'].dataType.simpleString()}, hi long, lo long, n_shingles long, sketch binary")


# --- bands and their segments ----------------------------------------------------


def most_apart(total: int, percent: int = PERCENT) -> int:
    """The largest symmetric difference of similar sets with `total` shingles together."""
    return (100 - percent) * total // (100 + percent)


@lru_cache(maxsize=None)
def band(j: int, percent: int, slack: float) -> tuple[int, int, int, int]:
    """Smallest and largest size in band j, its number of segments, and of those with deletions.

    The cost of a segment is one signature a set, that of deletions one a shingle;
    so few segments have them. Empty segments cost nothing but are no evidence:
    in bands of small sets segments are many. In others there are as many as give
    a set somewhat more units than it needs, to leave the costliest out.
    """
    low = 1
    for _ in range(j):
        low = max(low + 1, low * 8 // 5)
    high = max(low + 1, low * 8 // 5) - 1
    above = high * 100 // percent
    d = 1 + most_apart(2 * high, percent) // 32
    if high <= 40 and slack:
        return low, high, 8 * high, d
    m = 1
    while any(m * (1 - (1 - 1 / m) ** n) < (1 + 0.08 * slack) * (most_apart(n + min(n, high), percent) + 1) + 2 * slack for n in (low, high, above)) and m < 4 * above:
        m += 1 + m // 64
    return low, high, m, d


def band_of(n: np.ndarray) -> np.ndarray:
    lows = [1]
    while lows[-1] <= (int(n.max()) if len(n) else 1):
        lows.append(max(lows[-1] + 1, lows[-1] * 8 // 5))
    return np.searchsorted(np.array(lows), n, "right") - 1


def tag_of(below, seg, kind):
    """How many bands below the set's own, the segment (from 1, or 0 where no deletions are indexed), and the kind, in one number."""
    return (below << 40) | (seg << 2) | kind


def evidence_of(below, need, units):
    """The same for a row that tells how many units of evidence a set needs and has: a negative number."""
    return -1 - (below | (need << 2) | (units << 32))


#: Kinds of a signature: the whole subset, one with a shingle deleted, an empty subset asked for, a unit count.
WHOLE, DELETED, EMPTY = 0, 1, 2


def signatures(rows: np.ndarray, g: np.ndarray, n: np.ndarray, percent: int = PERCENT, slack: float = 1.0):
    """For sets given by row and shingle: arrays (row, signature, tag) and (row, bands below, need, units).

    Row r appears in its own band, and in each lower band that may hold a similar smaller set.
    """
    out_row, out_sig, out_tag, stat = [], [], [], []
    own = band_of(np.maximum(n, 1))
    sizes = n
    for j in np.unique(own[sizes > 0]) if len(n) else []:
        for t in range(int(j), -1, -1):
            low, high, m, d = band(t, percent, slack)
            here = np.flatnonzero((own == j) & (sizes > 0) & ((t == j) | (100 * high >= percent * sizes)))
            if not len(here):
                break
            place = np.full(len(n), -1)
            place[here] = np.arange(len(here))
            use = place[rows] >= 0
            r, x = place[rows[use]], mix(g[use] ^ np.uint64(0xA0761D6478BD642F * (t + 1) % (1 << 64)))
            seg = ((x >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            value = mix(x + np.uint64(0x8EBC6AF09C88C6E3))
            cell = r * m + seg
            total = np.zeros(len(here) * m, dtype=np.uint64)
            np.add.at(total, cell, value)
            size = np.bincount(cell, minlength=len(here) * m)
            salt = mix(np.arange(m, dtype=np.uint64) + np.uint64(t << 32))
            full = np.flatnonzero(size)
            at, where = full // m, full % m
            out_row.append(here[at])
            out_sig.append(mix(total[full] + salt[where]))
            out_tag.append(tag_of(j - t, np.where(where < d, where + 1, 0), WHOLE))
            # One shingle deleted, in the first d segments, where at least one is left.
            drop = np.flatnonzero((seg < d) & (size[cell] >= 2))
            out_row.append(here[r[drop]])
            out_sig.append(mix(total[cell[drop]] - value[drop] + salt[seg[drop]]))
            out_tag.append(tag_of(j - t, seg[drop] + 1, DELETED))
            filled = size.reshape(len(here), m)
            units = (filled > 0).sum(axis=1) + (filled[:, :d] >= 2).sum(axis=1)
            # The partner is the smaller of the pair: no larger than the set, nor than its band.
            need = (100 - percent) * (sizes[here] + np.minimum(sizes[here], high)) // (100 + percent) + 1
            short = units < need
            for q in np.flatnonzero(short):
                gone = np.flatnonzero(filled[q] == 0)
                out_row.append(np.full(len(gone), here[q]))
                out_sig.append(mix(salt[gone] + np.uint64(0x51ED270B)))
                out_tag.append(np.full(len(gone), tag_of(j - t, 0, EMPTY)))
            stat.append(np.stack([here, np.full(len(here), j - t), need, units], axis=1))
    cat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
    return cat(out_row, np.int64), cat(out_sig, np.uint64), cat(out_tag, np.int64), np.concatenate(stat) if stat else np.zeros((0, 4), np.int64)


def _entries(docs: DataFrame, text: str, k: int, percent: int, slack: float, asked: list[int] | None = None) -> DataFrame:
    """key, tag, sig of every set (once per task). Rows with a negative tag hold its evidence, under a signature of their own.

    With `asked`, only the empty subsets with these signatures are listed, for
    sets in their own band. The signature stands last: rows of a set then differ
    in little else, and the shuffle compresses them to about half.
    """
    ship(docs.sparkSession)
    wanted = None if asked is None else docs.sparkSession.sparkContext.broadcast(np.array(sorted(asked), dtype=np.int64))

    def run(batches):
        met: set[int] = set()
        for b in slices(batches, "__text", 1 << 20):
            raw, off = utf8(pulled(b, "__text"))
            rows, g = shingle_hashes(raw, off, k)
            n = np.bincount(rows, minlength=b.num_rows)
            low = _LOWER[raw].tobytes()
            key = np.zeros(b.num_rows, dtype=np.int64)
            for i in np.flatnonzero(n):
                key[i] = k_ = int.from_bytes(_name(low[off[i] : off[i + 1]].split())[8:], "little", signed=True)
                n[i] = 0 if k_ in met else n[i]
                met.add(k_)
            live = n[rows] > 0
            rows, g = rows[live], g[live]
            if wanted is not None:
                yield _batch(*_empties(rows, g, n, key, wanted.value, percent, slack))
                continue
            row, sig, tag, stat = signatures(rows, g, n, percent, slack)
            who = key[stat[:, 0]]
            alone = mix(who.view(np.uint64) + stat[:, 1].astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
            both = np.concatenate([row, stat[:, 0]])
            order = np.argsort(both, kind="stable")
            yield _batch(*(x[order] for x in (np.concatenate([key[row], who]), signed(np.concatenate([sig, alone])), np.concatenate([tag, evidence_of(stat[:, 1], stat[:, 2], stat[:, 3])]))))

    return docs.select(F.col(text).cast("string").alias("__text")).mapInArrow(lean(run), "key long, tag long, sig long")


def _batch(key, sig, tag):
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(tag), pa.array(sig)], names=["key", "tag", "sig"])


def _empties(rows, g, n, key, wanted, percent, slack):
    own = band_of(np.maximum(n, 1))
    out_key, out_sig, out_tag = [], [], []
    for j in np.unique(own[n > 0]) if len(n) else []:
        _, _, m, _ = band(int(j), percent, slack)
        salt = mix(np.arange(m, dtype=np.uint64) + np.uint64(int(j) << 32))
        sig = signed(mix(salt + np.uint64(0x51ED270B)))
        ask = np.flatnonzero(np.isin(sig, wanted))
        if not len(ask):
            continue
        here = np.flatnonzero((own == j) & (n > 0))
        place = np.full(len(n), -1)
        place[here] = np.arange(len(here))
        use = place[rows] >= 0
        x = mix(g[use] ^ np.uint64(0xA0761D6478BD642F * (int(j) + 1) % (1 << 64)))
        seg = ((x >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        filled = np.zeros((len(here), m), dtype=bool)
        filled[place[rows[use]], seg] = True
        r, c = np.nonzero(~filled[:, ask])
        out_key.append(key[here[r]])
        out_sig.append(sig[ask[c]])
        out_tag.append(np.full(len(r), tag_of(0, 0, EMPTY)))
    cat = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
    return cat(out_key), cat(out_sig), cat(out_tag)


# --- the join --------------------------------------------------------------------


def _probes(met: DataFrame, stats: DataFrame) -> DataFrame:
    """key, sig, pivot, other: the signatures by which a set looks for partners, cheapest first, until its evidence suffices."""
    rows = met.select("*", F.expr("tag & 3L").alias("kind"), F.expr("(tag >> 2) & ((1L << 38) - 1)").alias("seg"), F.expr("tag >> 40").alias("below")).withColumn("own", F.expr("if(seg = 0, sig, 0)"))
    unit = ["key", "below", "seg", "own"]
    cost = lambda k: F.sum(F.when(F.col("kind") == k, F.col("sets") - 1).otherwise(0))
    segments = rows.groupBy(*unit).agg(cost(WHOLE).alias("c0"), cost(DELETED).alias("c1"))
    # The first unit of a segment is its whole subset; the second, where deletions are indexed, costs that and the deletions.
    # Costs of zero are units that cost nothing and are counted, not listed.
    units = segments.select(*unit, F.expr("stack(2, 0L, if(c0 > 0, c0, 0), 1L, if(c1 > 0, c0 + c1, 0)) as (kind, cost)")).where("cost > 0")
    by_set = Window.partitionBy("key", "below")
    chosen = (
        units.withColumn("rank", F.row_number().over(by_set.orderBy("cost", "kind", "seg", "own")))
        .withColumn("costed", F.count(F.lit(1)).over(by_set))
        .join(stats, ["key", "below"])
        .where(F.col("rank") <= F.col("need") - (F.col("units") - F.col("costed")))
        .select(*unit, "kind")
    )
    return rows.join(chosen, [*unit, "kind"]).select("key", "sig", "pivot", "other").distinct()


def _stars(probes: DataFrame, shared: DataFrame) -> DataFrame:
    """a, b: each set that looks for partners, with the most central set of each signature it looks at.

    Central is the set whose signatures are shared most: of a text and its near
    copies, that is the text, to which all are closer than to each other. So most
    groups become one component here, by pairs in proportion to their size.
    """
    whole = shared.where("tag >> 40 = 0 and (tag & 3) = 0").select("sig", "key", "sets")
    score = whole.groupBy("key").agg(F.sum("sets").alias("score"))
    looked = whole.select("sig", "key").join(probes.select("sig").distinct(), "sig", "left_semi")
    central = looked.join(score, "key").groupBy("sig").agg(F.max(F.struct("score", "key")).alias("top")).select("sig", F.col("top.key").alias("centre"))
    partner = F.expr("case when centre is not null and key <> centre then centre when key = pivot then other else pivot end")
    return probes.join(central, "sig", "left").select("key", partner.alias("partner")).select(F.least("key", "partner").alias("a"), F.greatest("key", "partner").alias("b"))


def _verified(pairs: DataFrame, classes: DataFrame, chunks: Chunks, k: int, percent: int) -> DataFrame:
    """a, b: representatives of the classes of candidate keys whose texts are similar.

    A class is verified by the text of one row, named by its chunk and place. A
    text is sent once for each block of pairs of which it is the first.
    """
    side = lambda c: classes.select(F.col("lo").alias(c), *[F.col(x).alias(f"{c}_{y}") for x, y in (("id", "id"), ("at", "at"), ("n_shingles", "n"))])
    close = pairs.join(side("a"), "a").join(side("b"), "b").where(f"a_id <> b_id and 100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n)")
    close = cut(close.select(*[F.expr(f"if(a_id < b_id, {x}_{c}, {y}_{c})").alias(f"{x}_{c}") for x, y in ("ab", "ba") for c in ("id", "at")]).distinct(), "candidates")
    needed = close.select(F.explode(F.array("a_at", "b_at")).alias("at")).distinct().select("at.*")
    texts = cut(chosen(chunks, needed, named=True).toDF("chunk", "place", "id", "text").select(F.struct("chunk", "place").alias("at"), "text"), "texts")
    # Blocks of some 64 pairs with one first text, however many pairs that has.
    counts = close.groupBy("a_at").agg(F.count(F.lit(1)).alias("c"))
    blocks = close.join(counts, "a_at").withColumn("block", F.expr("pmod(xxhash64(b_at), cast(ceil(c / 64.0) as bigint))"))
    seconds = blocks.join(texts.toDF("b_at", "b_text"), "b_at").select("a_at", "block", "a_id", "b_id", "b_text")
    firsts = blocks.select("a_at", "block").distinct().toDF("f_at", "f_block").join(texts.toDF("f_at", "a_text"), "f_at")

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        first = shingles(left.column("a_text")[0].as_py(), k)
        ok = [linked(first, shingles(t.as_py(), k), percent) for t in right.column("b_text")]
        found = right.select(["a_id", "b_id"]).filter(pa.array(ok, pa.bool_()))
        return found.rename_columns(["a", "b"])

    kind = close.schema["a_id"].dataType.simpleString()
    grouped = firsts.groupBy("f_at", "f_block").cogroup(seconds.groupBy("a_at", "block"))
    return cut(grouped.applyInArrow(lean_groups(check), f"a {kind}, b {kind}").distinct(), "links")


def close_pairs(sig, key, component, n, sketch, probe, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one signature in different components that sizes and sketches leave possible: the set that looks, and a smaller or equal one.

    Arrays are sorted by signature. Memory goes with the rows: all pairs of a
    signature are formed for a block of those that look at a time.
    """
    edge = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1], [True]])) if len(sig) else np.zeros(1, int)
    left, right = [], []
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
        if hi - lo < 2:
            continue
        r_all, s = lo + np.flatnonzero(probe[lo:hi]), lo + np.flatnonzero(~probe[lo:hi])
        if not len(s) or (component[lo:hi] == component[lo]).all():
            continue
        step = max(1, (1 << 16) // len(s))
        for at in range(0, len(r_all), step):
            r = r_all[at : at + step]
            a, b = n[r][:, None], n[s][None]
            ok = (component[r][:, None] != component[s][None]) & (b <= a) & (100 * b >= percent * a) & (key[r][:, None] != key[s][None])
            i, j = np.nonzero(ok)
            i, j = r[i], s[j]
            apart = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype=np.int64)
            near = apart <= (100 - percent) * (n[i] + n[j]) // (100 + percent)
            left.append(key[i[near]])
            right.append(key[j[near]])
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return cat(left), cat(right)


def _across(probes: DataFrame, indexed: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """r, s: candidates in different components. Only signatures whose sets lie in several components are met again."""
    both = indexed.withColumn("probe", F.lit(False)).unionByName(probes.withColumn("probe", F.lit(True))).join(label, "key")
    # Keys whose 64 bits name several classes have no component; they differ from all.
    named = both.withColumn("component", F.coalesce(F.col("component").cast("string"), F.concat(F.lit("key "), F.col("key").cast("string")))).withColumn("component", F.xxhash64("component"))
    mixed = named.groupBy("sig").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("sig")
    rows = cut(named.select("sig", "key", "component", "n", "sketch", "probe").join(mixed, "sig", "left_semi"), "mixed")
    buckets = max(1, rows.count() // 50_000)

    def pairs(table: pa.Table) -> pa.Table:
        t = table.sort_by("sig")
        col = lambda c: t.column(c).to_numpy()
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), dtype=np.uint64).reshape(len(t), -1)
        r, s = close_pairs(col("sig"), col("key"), col("component"), col("n"), sketch, t.column("probe").to_numpy(zero_copy_only=False).astype(bool), percent)
        u = np.unique(np.stack([r, s], axis=1), axis=0) if len(r) else np.zeros((0, 2), np.int64)
        return pa.table({"r": u[:, 0].copy(), "s": u[:, 1].copy()})

    return rows.withColumn("bucket", F.pmod("sig", F.lit(buckets))).groupBy("bucket").applyInArrow(lean_group(pairs), "r long, s long")


@dataclass
class _Met:
    """What the signatures of a table's classes tell: rows and classes, who looks where, and the pairs met first."""

    chunks: Chunks
    rows: DataFrame
    classes: DataFrame
    met: DataFrame
    shared: DataFrame
    probes: DataFrame
    first: DataFrame


def _meet(docs: DataFrame, text: str, key: str, k: int, percent: int, slack: float) -> _Met:
    chunks = lay(docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")), "key", "text")
    rows = cut(keys(chunks, k), "keys")
    # Of a class, the smallest key names it and one row of that key lends its text.
    best = F.min(F.struct(F.col("id").isNull(), "id", "chunk", "place")).alias("best")
    classes = rows.where("n_shingles > 0").groupBy("hi", "lo").agg(best, F.max("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    classes = cut(classes.select("hi", "lo", "best.id", F.struct("best.chunk", "best.place").alias("at"), "n_shingles", "sketch"), "classes")

    entries = _entries(docs, text, k, percent, slack)
    meeting = Window.partitionBy("sig")
    # One pass over the signatures: those of a single set go; evidence and empty subsets are kept.
    met = cut(
        entries.withColumn("pivot", F.min("key").over(meeting))
        .withColumn("other", F.max("key").over(meeting))
        .withColumn("sets", F.count(F.lit(1)).over(meeting))
        .where("tag < 0 or pivot <> other or (tag & 3) = 2"),
        "met",
    )
    told = F.expr("-1 - tag")
    stats = met.where("tag < 0").select("key", told.bitwiseAND(F.lit(3)).alias("below"), F.expr("((-1 - tag) >> 2) & ((1L << 30) - 1)").alias("need"), F.expr("(-1 - tag) >> 32").alias("units")).distinct()
    shared = met.where("tag >= 0 and (tag & 3) <> 2")
    probes = cut(_probes(shared, stats), "probes")
    twins = classes.groupBy("lo").count().where("count > 1").select(F.col("lo").alias("a"), F.col("lo").alias("b"))

    first = cut(_stars(probes, shared).unionByName(twins).distinct(), "stars")
    return _Met(chunks, rows, classes, met, shared, probes, first)


def _rest(x: _Met, found: DataFrame, docs: DataFrame, text: str, k: int, percent: int, slack: float) -> DataFrame:
    """a, b: the candidates in different components that were not met first. found: lo, component; classes that are not in it stand alone."""
    # What remains: pairs of a signature in different components, the larger set of which looks for the smaller.
    label = (
        x.classes.groupBy("lo").agg(F.min("id").alias("own"), F.max("n_shingles").alias("n"), F.count(F.lit(1)).alias("c"), F.first("sketch").alias("sketch"))
        .join(found.groupBy("lo").agg(F.min("component").alias("component")), "lo", "left")
        .select(F.col("lo").alias("key"), "n", F.when(F.col("c") == 1, F.coalesce("component", "own")).alias("component"), "sketch")
    )
    side = lambda y, c: y.join(label, "key").select("sig", F.col("key").alias(c), F.col("n").alias(f"{c}_n"), F.col("component").alias(f"{c}_c"))
    size = f"s_n <= r_n and 100 * s_n >= {percent} * r_n"
    rest = _across(x.probes.select("sig", "key"), x.shared.where("tag >> 40 = 0").select("sig", "key").distinct(), label, percent)

    short = x.met.where("tag >= 0 and (tag & 3) = 2").select("key", "sig").distinct()
    asked = [y[0] for y in short.select("sig").distinct().collect()]  # as many as a band has segments, at most
    if asked:
        gone = _entries(docs, text, k, percent, slack, asked).select("key", "sig").distinct()
        rest = rest.unionByName(side(short, "r").join(side(gone, "s"), "sig").where(f"coalesce(r_c <> s_c, true) and r <> s and {size}").select("r", "s"))
    return rest.select(F.least("r", "s").alias("a"), F.greatest("r", "s").alias("b")).distinct().join(x.first, ["a", "b"], "left_anti")


@tidy
def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = WORDS, percent: int = PERCENT, slack: float = 1.0) -> DataFrame:
    """One row per row: key, n_shingles, component_id, class_id.

    Texts of the same words are one class, named by its smallest key. Classes
    whose sets are similar are linked; component_id is the smallest key that links
    reach. Texts without words (null, empty, blank) have no set and stand alone.
    Shorter texts than `k` words have one shingle, of all their words. Rows
    without a key share in the component of their words, if a row with a key has
    them (else null), but link nothing. Repeated rows give repeated rows. Other
    columns are not read; an empty table gives no rows.
    """
    x = _meet(docs, text, key, k, percent, slack)
    rows, classes = x.rows, x.classes
    links = _verified(x.first, classes, x.chunks, k, percent)
    found = components(links).join(classes.select(F.col("id").alias("node"), "lo"), "node").select("lo", "component")
    again = _rest(x, found, docs, text, k, percent, slack)
    more = _verified(again, classes, x.chunks, k, percent)
    if not more.isEmpty():
        links = links.unionByName(more)
    whole = components(links)
    named = classes.join(whole, F.col("id") == F.col("node"), "left").select("hi", "lo", F.col("id").alias("class_id"), F.coalesce("component", "id").alias("component_id"))
    out = rows.select("id", "hi", "lo", "n_shingles").join(named, ["hi", "lo"], "left")
    return out.select(
        F.col("id").alias(key), "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), F.coalesce("class_id", "id").alias("class_id")
    )


@tidy
def similar_pairs(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = WORDS, percent: int = PERCENT, slack: float = 1.0) -> DataFrame:
    """a, b: every two classes whose sets are similar, by their smallest keys, a < b; each pair once.

    near_duplicates stops at links that hold a component together; here pairs
    inside a component are verified too, so the output of a group of near copies,
    and the work on it, grow with the pairs that are similar. Copies are one class
    and need no link. Classes, nulls and rows without a key are as in near_duplicates.
    """
    x = _meet(docs, text, key, k, percent, slack)
    alone = x.classes.select("lo", F.col("id").alias("component")).limit(0)
    both = x.first.unionByName(_rest(x, alone, docs, text, k, percent, slack))
    return _verified(both, x.classes, x.chunks, k, percent)


@tidy
def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """The rows of `docs` whose key is the smallest of its component; of rows that repeat such a key one stays. Rows without a key all stay.

    Where a key repeats with different texts, a row is named by its key and its
    text, so that the texts of one key are as far from each other as any.
    """
    if not docs.select(F.col(key).alias("__k"), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("__h")).where("__k is not null").groupBy("__k").agg(F.min("__h").alias("x"), F.max("__h").alias("y")).where("x <> y").isEmpty():
        name = F.struct(F.col(key).alias("key"), F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")), 256).alias("text"))
        return dedup(docs.withColumn("__nd_name", F.when(F.col(key).isNotNull(), name)), text, "__nd_name", **options).drop("__nd_name")
    found = near_duplicates(docs, text, key, **options).select(F.col(key).alias("k"), "component_id")
    stay = cut(found.where("k = component_id").select("k").distinct(), "verdicts")
    chunks = lay(docs, key, text)
    names = chunks.names
    one = names.where("key is not null").groupBy("key").agg(F.min(F.struct("chunk", "place")).alias("at"))
    which = one.join(stay, F.col("key") == F.col("k"), "left_semi").select("at.*").unionByName(names.where("key is null").select("chunk", "place"))
    return chosen(chunks, which)
