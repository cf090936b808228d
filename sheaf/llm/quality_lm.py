"""Quality classifier: an interpolated modified Kneser-Ney model of characters, trained on trusted text.

A character is its code point, whatever its script, and 0 stands for both ends of
a text; nothing is folded, so different texts differ in their n-grams. An n-gram
is named by its symbols, four bytes each. Texts are laid out in chunks. Each chunk
sends its distinct 4-grams with their counts in trusted texts, once; they are summed
by n-gram, and joins of n-grams with the sums of their contexts, order by order,
give the log probability of every 4-gram that any text holds. Joined to the chunks'
questions these go back, and every whole document gets its perplexity per
character. A document stays if that lies within bounds that quantiles of trusted
documents of its language set, which the model was not trained on.

Nothing that grows with the corpus is collected or broadcast, and the plan is the
same at every size.
"""

from __future__ import annotations

from functools import reduce
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.chunked import Chunks, chosen, lay
from sheaf.llm.common import cut, fold, key_name, pulled, slices, tidy, utf8

ORDER = 4
SYMBOLS = 0x110000 + 1  # code points and the end mark
SLICE = 1 << 18  # bytes of text that are numbered at a time: the arrays for it are some 100 times as large, and stand beside the executor's heap
HELD = 1 << 17  # n-grams of slices that wait to be summed, beside as many as are distinct so far
DENSE = 1 << 25  # codes below this are numbered by a map of bits, others by sorting


def code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code point of each character and the byte where it starts. Bytes that are no UTF-8 count with the character before them."""
    if not (raw & 0x80).any():
        return raw.astype(np.int32), np.arange(len(raw))
    start = np.flatnonzero(raw & 0xC0 != 0x80)
    head = raw[start]
    point = head.astype(np.int32)
    wide = np.flatnonzero(head >= 0xC0)
    padded = np.concatenate([raw, np.zeros(3, np.uint8)])
    for length, low, high, mask in ((2, 0xC0, 0xE0, 31), (3, 0xE0, 0xF0, 15), (4, 0xF0, 0x100, 7)):
        which = wide[(head[wide] >= low) & (head[wide] < high)]
        p = head[which].astype(np.int32) & mask
        for i in range(1, length):
            p = (p << 6) | (padded[start[which] + i] & 63)
        point[which] = p
    return point, start


def sequences(raw: np.ndarray, off: np.ndarray):
    """(symbols, first places of the n-grams, their rows), piece by piece; a symbol is a code point plus one.

    Each text has three end marks before its characters and one behind; a text
    without a character has no n-gram. Texts beyond SLICE are cut between
    characters, and the last three symbols are carried over.
    """
    size = np.diff(off)
    small = np.flatnonzero((size > 0) & (size <= SLICE))
    if len(small):
        inside = np.concatenate([raw[off[i] : off[i + 1]] for i in small]) if len(small) < len(size) else raw
        ends = np.cumsum(size[small])
        point, start = code_points(inside)
        count = np.bincount(np.searchsorted(ends, start, "right"), minlength=len(small))
        held = np.flatnonzero(count)
        n = count[held]
        s = np.zeros(len(point) + ORDER * len(held), dtype=np.int32)
        s[np.arange(len(point)) + np.repeat(np.arange(len(held)) * ORDER, n) + ORDER - 1] = point + 1
        at = np.arange(len(point) + len(held), dtype=np.int32) + np.repeat(np.arange(len(held), dtype=np.int32) * (ORDER - 1), n + 1)
        yield s, at, np.repeat(small[held].astype(np.int32), n + 1)
    for i in np.flatnonzero(size > SLICE):
        before, at, end = np.zeros(ORDER - 1, np.int32), int(off[i]), int(off[i + 1])
        any_symbol = False
        while at < end:
            to = min(at + SLICE, end)
            while to < end and raw[to] & 0xC0 == 0x80:
                to += 1
            s = np.concatenate([before, code_points(raw[at:to])[0] + 1])
            any_symbol |= len(s) >= ORDER
            s = np.concatenate([s, np.zeros(1, np.int32)]) if to == end and any_symbol else s
            m = max(0, len(s) - ORDER + 1)
            yield s, np.arange(m, dtype=np.int32), np.full(m, i, np.int32)
            before, at = s[-(ORDER - 1) :], to


def _ranked(code: np.ndarray, bound: int) -> tuple[np.ndarray, int]:
    """Numbers of the distinct codes, and how many there are. A code's number is how many codes below it were met, counted in words of 64 bits."""
    if bound > DENSE:
        u, inverse = np.unique(code, return_inverse=True)
        return inverse, len(u)
    met = np.zeros(-(-bound // 64) * 64, dtype=bool)
    met[code] = True
    word = np.packbits(met, bitorder="little").view("<u8")
    before = np.concatenate([[0], np.cumsum(np.bitwise_count(word), dtype=np.int64)])
    at = code >> 6
    low = word.take(at) & ((np.uint64(1) << (code & 63).astype(np.uint64)) - np.uint64(1))
    return before.take(at) + np.bitwise_count(low), int(before[-1])


def numbered(s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams at these places, as names of ORDER big-endian numbers, and each place's number among them."""
    if not len(at):
        return np.zeros(0, f"S{4 * ORDER}"), np.zeros(0, np.int64)
    letter, base = _ranked(s.astype(np.int64), int(s.max()) + 1)
    code, bound = letter, base
    for k in range(1, ORDER):
        if bound * base > DENSE:
            code, bound = _ranked(code, bound)
        code = code[:-1] * base + letter[k:]
        bound *= base
    number, n = _ranked(code.take(at), bound)
    where = np.empty(n, dtype=np.int64)
    where[number] = at
    return np.ascontiguousarray(s[where[:, None] + np.arange(ORDER)].astype(">u4")).view(f"S{4 * ORDER}").ravel(), number


def _names(grams: np.ndarray) -> pa.Array:
    """S16 names as a binary column; their zeros count."""
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * ORDER), len(grams), [None, pa.py_buffer(np.ascontiguousarray(grams))]).cast(pa.binary())


def _unnamed(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(column.cast(pa.binary(4 * ORDER)).combine_chunks().buffers()[1], f"S{4 * ORDER}")[: len(column)] if len(column) else np.zeros(0, f"S{4 * ORDER}")


def _sum_up(grams: list[np.ndarray], counts: list[np.ndarray]) -> None:
    """Distinct n-grams and their total counts, in place of all lists of them."""
    u, inverse = np.unique(np.concatenate(grams), return_inverse=True)
    grams[:], counts[:] = [u], [np.bincount(inverse, weights=np.concatenate(counts), minlength=len(u))]


def _questions(chunks: Chunks, flags: DataFrame, text: str) -> DataFrame:
    """chunk, gram, n: the distinct n-grams of each chunk, and how often its flagged rows hold them."""

    def ask(name, rows: pa.RecordBatch, right: pa.Table) -> pa.Table:
        flag = np.zeros(rows.num_rows)
        flag[right.column("place").to_numpy()] = 1
        grams, counts, at = [np.zeros(0, f"S{4 * ORDER}")], [np.zeros(0)], 0
        for b in slices([rows], text, SLICE):
            own = flag[at : at + b.num_rows]
            at += b.num_rows
            for s, place, row in sequences(*utf8(pulled(b, text))):
                g, number = numbered(s, place)
                grams.append(g)
                counts.append(np.bincount(number, weights=own[row], minlength=len(g)))
                if sum(map(len, grams[1:])) > HELD + len(grams[0]):
                    _sum_up(grams, counts)
        _sum_up(grams, counts)
        return pa.table({"chunk": pa.array(np.full(len(grams[0]), name)), "gram": _names(grams[0]), "n": pa.array(counts[0].astype(np.int64))})

    return chunks.gather(flags.select("chunk", "place"), ask, "chunk long, gram binary, n long")


def _part(gram: str, first: int, symbols: int):
    return F.expr(f"substring({gram}, {4 * first + 1}, {4 * symbols})")


def _discounts(counted: dict[int, DataFrame]) -> dict[int, list[float]]:
    """Of each order, what is taken off counts of one, of two, and of three and more."""
    low = [t.where("n <= 4").groupBy(F.lit(k).alias("k"), "n").agg(F.count(F.lit(1)).alias("c")) for k, t in counted.items()]
    n = {(r["k"], r["n"]): r["c"] for r in reduce(DataFrame.unionByName, low).collect()}
    out = {}
    for k in counted:
        n1, n2, n3, n4 = (n.get((k, i), 0) for i in (1, 2, 3, 4))
        if not (n1 and n2 and n3):
            out[k] = [0.5, 0.5, 0.5]  # too little text for estimates
            continue
        y = n1 / (n1 + 2 * n2)
        out[k] = [min(max(d, 0.05), most) for d, most in ((1 - 2 * y * n2 / n1, 0.95), (2 - 3 * y * n3 / n2, 1.95), (3 - 4 * y * n4 / n3, 2.95))]
    return out


def log_probabilities(seen: DataFrame) -> DataFrame:
    """gram, lp: natural log probability of the last symbol of each gram after the others, by interpolated modified Kneser-Ney.

    seen: gram (each once), n (its count in the training text; 0 if only other
    texts hold it). Below the highest order an n-gram counts once for each symbol
    seen before it. With no count at all, all symbols are equally likely.
    """
    counted = {ORDER: seen.where("n > 0")}
    for k in range(ORDER - 1, 0, -1):
        longer = counted[k + 1]
        counted[k] = cut(longer.groupBy(_part("gram", 1, k).alias("gram")).agg(F.count(F.lit(1)).alias("n")), f"order{k}")
    asked = {ORDER: seen.select("gram")}
    for k in range(ORDER - 1, 0, -1):
        asked[k] = asked[k + 1].select(_part("gram", 1, k).alias("gram")).distinct()
    below, held = None, _discounts(counted)
    for k in range(1, ORDER + 1):
        d = held[k]
        off = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        shares = counted[k].select("gram", (F.col("n") - off).alias("share"))
        sums = counted[k].groupBy(_part("gram", 0, k - 1).alias("ctx")).agg(F.sum("n").alias("total"), F.sum(off).alias("left"))
        found = asked[k].join(shares, "gram", "left").withColumn("ctx", _part("gram", 0, k - 1)).join(sums, "ctx", "left")
        if below is None:
            found = found.withColumn("p", F.lit(1.0 / SYMBOLS))
        else:
            found = found.withColumn("rest", _part("gram", 1, k - 1)).join(below.withColumnRenamed("gram", "rest"), "rest")
        p = F.coalesce(F.col("share") / F.col("total"), F.lit(0.0)) + F.coalesce(F.col("left") / F.col("total"), F.lit(1.0)) * F.col("p")
        below = found.select("gram", p.alias("p"))
    return below.select("gram", F.log("p").alias("lp"))


def _scores(chunks: Chunks, answers: DataFrame, text: str, also: dict[str, str]) -> DataFrame:
    """chunk, place, the columns `also` (name in the result: name in the chunk), chars, nll (natural, per symbol, the end's included; null without a character)."""

    def score(name, rows: pa.RecordBatch, right: pa.Table) -> pa.Table:
        known = _unnamed(right.column("gram"))
        order = np.argsort(known)
        known, lp = known[order], right.column("lp").to_numpy()[order]
        total, count, at = np.zeros(rows.num_rows), np.zeros(rows.num_rows, np.int64), 0
        for b in slices([rows], text, SLICE):
            to = at + b.num_rows
            for s, place, row in sequences(*utf8(pulled(b, text))):
                g, number = numbered(s, place)
                value = lp[np.searchsorted(known, g)] if len(g) else np.zeros(0)
                total[at:to] -= np.bincount(row, weights=value[number], minlength=b.num_rows)
                count[at:to] += np.bincount(row, minlength=b.num_rows)
            at = to
        kept = {n: pulled(rows, c) for n, c in also.items()}
        nll = pa.array(total / np.maximum(count, 1), mask=count == 0)
        return pa.table({"chunk": pa.array(np.full(len(count), name)), "place": pa.array(np.arange(len(count), dtype=np.int32)), **kept, "chars": pa.array(np.maximum(count - 1, 0)), "nll": nll})

    kinds = ", ".join(f"`{n}` {chunks.fields[c].dataType.simpleString()}" for n, c in also.items())
    return chunks.gather(answers.select("chunk", "gram", "lp"), score, f"chunk long, place int, {kinds}, chars long, nll double")


def _judged(chunks: Chunks, labels: DataFrame, text: str, key: str, lang: str, tail: float, spread: float, least: int, short: int, folds: int) -> DataFrame:
    """chunk, place, key, lang, chars, nll, low, high, kept (bounds in nll)."""
    good = labels.groupBy(F.col(key).alias("id")).agg(F.min(F.coalesce((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0), F.lit(False))).alias("ok")).where("ok and id is not null").select("id")
    trusted = cut(chunks.names.join(good, F.col("key") == F.col("id"), "left_semi").select("chunk", "place", (fold("key", folds) == 0).alias("held")), "trusted")
    questions = cut(_questions(chunks, trusted.where("not held"), text), "questions")
    seen = cut(questions.groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    answers = questions.select("chunk", "gram").join(log_probabilities(seen), "gram")
    scored = cut(_scores(chunks, answers, text, {"key": f"c{chunks.columns.index(key)}", "lang": f"c{chunks.columns.index(lang)}"}), "perplexity")
    known = scored.where(F.col("nll").isNotNull() & (F.col("chars") >= short)).join(trusted.where("held"), ["chunk", "place"], "left_semi")
    at = F.percentile_approx("nll", F.array(F.lit(tail), F.lit(0.5), F.lit(1 - tail)), 10000).alias("q")
    each = cut(known.where("lang is not null").groupBy("lang").agg(at, F.count(F.lit(1)).alias("c")).where(F.col("c") >= least).drop("c"), "bounds")
    # Fewer documents than `least` in all: their outermost lie inside the quantiles, by the share that a normal sample's would.
    q_all, n = known.agg(at, F.count(F.lit(1))).first()
    whole = [None] * 3
    if n:
        reach = NormalDist().inv_cdf(1 - tail) / NormalDist().inv_cdf(n / (n + 1)) if n > 1 else 1.0
        whole = [q_all[1] + (x - q_all[1]) * max(1.0, reach) for x in q_all]
    q = F.coalesce("q", F.array(*[F.lit(x).cast("double") for x in whole]))
    wide = F.lit(spread) * F.greatest(F.lit(1.0), F.sqrt(F.lit(400.0) / F.greatest(F.col("chars"), F.lit(1))))
    bound = scored.join(each, "lang", "left").select(*scored.columns, (q[1] - wide * (q[1] - q[0])).alias("low"), (q[1] + wide * (q[2] - q[1])).alias("high"))
    return bound.withColumn("kept", F.col("nll").isNotNull() & F.coalesce((F.col("nll") >= F.col("low")) & (F.col("nll") <= F.col("high")), F.lit(True)))


@tidy
def classify(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang",
    tail: float = 0.01, spread: float = 2.0, least: int = 100, short: int = 200, folds: int = 5, chunk_bytes: int = 8 << 20,
) -> DataFrame:
    """One row per row: key, lang, chars, perplexity, low, high, kept.

    Trusted are documents of label quality 1 that are not toxic. The model is
    trained on those whose id is not in fold 0 of `folds` (by crc32); the others,
    of `short` characters at least, set the bounds. Bounds of a language lie
    `spread` times as far from its median as its `tail` and 1 - `tail` quantiles,
    in log perplexity; they widen for texts under 400 characters with the square
    root of their length, whose figures scatter. Languages with fewer than `least`
    such documents, null among them, take the bounds of all; where those are few, the
    bounds are set further apart, as far as a normal sample's outermost lie inside
    the quantiles. A figure equal to a
    bound keeps. Null and empty texts have no perplexity and go. Where no trusted
    document sets bounds nothing else is rejected. Repeated rows give repeated
    rows; repeated or contradictory labels count as untrusted if any is; rows
    without a key are untrusted; other columns are not read. Long texts are read
    in pieces: a task holds a few times the bytes of its longest text. An empty
    table gives no rows.
    """
    chunks = lay(docs.select(F.col(key), F.col(lang), F.col(text).cast("string").alias(text)), key, text, chunk_bytes)
    out = _judged(chunks, labels, f"c{chunks.columns.index(text)}", key, lang, tail, spread, least, short, folds)
    taken = "chars", "perplexity", "low", "high", "kept"
    return out.select(F.col("key").alias(key_name(key, *taken)), F.col("lang").alias(key_name(lang, *taken)), "chars", F.exp("nll").alias("perplexity"), F.exp("low").alias("low"), F.exp("high").alias("high"), "kept")


@tidy
def keep(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang",
    tail: float = 0.01, spread: float = 2.0, least: int = 100, short: int = 200, folds: int = 5, chunk_bytes: int = 8 << 20,
) -> DataFrame:
    """The rows of `docs` that `classify` keeps, with all their columns."""
    chunks = lay(docs, key, text, chunk_bytes)
    out = _judged(chunks, labels, f"c{chunks.columns.index(text)}", key, lang, tail, spread, least, short, folds)
    return chosen(chunks, out.where("kept"))
