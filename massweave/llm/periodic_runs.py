"""Periodic runs of words: multi-scale minimizers as seeds, exact extension, lag scans for short periods.

A run is a stretch of words with smallest period q, of at least max(LEAST, 3 q) words, that can't be
extended keeping that period.

Periods below FIRST are found by comparing the words with themselves at each lag. Longer ones are
found by scale: scale s holds the periods from s to 2 s - 1. Grams of s / 4 words get a hash, and in each
window of s / 2 grams the least are selected. What lies in a run repeats at the period's distance, windows
and their minima too, so two selected equal grams stand a period apart; such pairs, s to 2 s - 1 words apart,
are the seeds. A seed is kept if s words behind or before it repeat too, which a run of three periods
implies, and then extended word by word in both directions, so hashes never decide a run.

A gram that lies in a run of a period of at most an eighth of the scale, found before, isn't selected:
a run of a longer period has others in each period (else the shorter period would be its own), and so
equal selected grams are at least an eighth of the scale apart, which bounds the pairs: sixteen for each
selected gram, whatever the text. All texts of a batch are searched together, a number of its own behind each.

Defined results: a null or empty text has no words and no runs; rows keep their ``doc_id``, repeated or null;
a text of any length is searched whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massweave.llm.arrow import by_bytes, table
from massweave.llm.common import WORD, small_batches, text_of
from massweave.llm.words import numbering, raw_text, word_ids, words_between

#: Least words of a run, and periods that fit into it.
LEAST, TIMES = 24, 3
#: The first scale; shorter periods are scanned lag by lag.
FIRST = 32
#: Bytes of text that are searched together; a longer text is searched on its own.
TOGETHER = 2_000_000
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def doubled(grams: np.ndarray, width: int) -> np.ndarray:
    """Hashes of grams of twice ``width``; those that would reach beyond the end are left out."""
    return mixed(grams[:-width] * np.uint64(0x9E3779B97F4A7C15) + grams[width:])


def sliding(x: np.ndarray, width: int, least: bool, fill: np.uint64) -> np.ndarray:
    """The least (or greatest) of each ``width`` neighbours, from block-wise running ones of either side."""
    of, n = (np.minimum if least else np.maximum), len(x) - width + 1
    blocks = np.concatenate([x, np.full(-len(x) % width, fill, x.dtype)]).reshape(-1, width)
    ahead = of.accumulate(blocks, axis=1).reshape(-1)
    behind = of.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return of(behind[:n], ahead[width - 1 : width - 1 + n])


def primitive(words: np.ndarray, start: int, end: int, period: int) -> bool:
    """Whether no divisor of the period is a period of the stretch, which is three periods long at least."""
    rest, p = period, 2
    while rest > 1:
        if p * p > rest:
            p = rest
        if rest % p == 0:
            while rest % p == 0:
                rest //= p
            d = period // p
            if np.array_equal(words[start : end - d], words[start + d : end]):
                return False
        p += 1
    return True


def short_runs(words: np.ndarray, most: int) -> list[tuple[int, int, int]]:
    """Stretches (start, end, period) of three periods or more, with periods up to ``most``, by lag."""
    found = []
    for q in range(1, min(most, len(words) // TIMES) + 1):
        breaks = np.flatnonzero(words[q:] != words[:-q])
        starts = np.concatenate([[0], breaks + 1])
        ends = np.concatenate([breaks, [len(words) - q]])
        for k in np.flatnonzero(ends - starts >= (TIMES - 1) * q).tolist():
            a, b = int(starts[k]), int(ends[k]) + q
            if primitive(words, a, b, q):
                found.append((a, b, q))
    return found


def reach(words: np.ndarray, i: int, j: int, step: int) -> int:
    """How many words from ``i`` and ``j`` on, ahead (1) or back (-1), are equal."""
    done, size = 0, 64
    room = len(words) - j if step > 0 else i + 1
    while done < room:
        n = min(size, room - done)
        if step > 0:
            same = words[i + done : i + done + n] == words[j + done : j + done + n]
        else:
            same = words[i - done - n + 1 : i - done + 1][::-1] == words[j - done - n + 1 : j - done + 1][::-1]
        if not same.all():
            return done + int(np.argmin(same))
        done, size = done + n, min(2 * size, 1 << 16)
    return done


def seeds(grams: np.ndarray, wide: np.ndarray, scale: int, covered: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Places and lags at which equal selected grams of a scale stand apart by it or more, up to twice as far.

    ``grams``: hashes of a quarter of the scale, ``wide``: of the whole; ``covered``: the runs found so far.
    """
    quarter, values = scale // 4, grams.copy()
    for a, b, q in covered:
        if q <= quarter // 2 and b - quarter - q >= a:
            values[a : b - quarter - q + 1] = NONE
    half = scale // 2
    none = np.zeros(0, np.int64)
    if len(values) < half:
        return none, none
    least = sliding(values, half, True, NONE)
    edge = np.zeros(half - 1, np.uint64)
    best = sliding(np.concatenate([edge, least, edge]), half, False, np.uint64(0))
    chosen = np.flatnonzero((values == best) & (values != NONE))
    chosen = chosen[np.argsort(values[chosen], kind="stable")]
    at, value = chosen, values[chosen]
    places, lags = [none], [none]
    for j in range(1, len(at)):
        same = value[j:] == value[:-j]
        if not same.any():
            break
        lag = at[j:] - at[:-j]
        hit = np.flatnonzero(same & (lag >= scale) & (lag < 2 * scale))
        places.append(at[:-j][hit])
        lags.append(lag[hit])
        if not (same & (lag < 2 * scale)).any():
            break
    m, q = np.concatenate(places), np.concatenate(lags)
    n = len(wide)
    ahead = (m + q < n) & (wide[np.minimum(m, n - 1)] == wide[np.minimum(m + q, n - 1)])
    back = (m >= scale) & (m + q - scale < n) & (wide[np.clip(m - scale, 0, n - 1)] == wide[np.clip(m + q - scale, 0, n - 1)])
    order = np.flatnonzero(ahead | back)
    order = order[np.lexsort((m[order], q[order]))]
    return m[order], q[order]


def all_runs(words: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """All runs (start, end, period); ``longest``: words of the longest text among ``words``."""
    found = short_runs(words, min(FIRST - 1, longest // TIMES))
    scale = FIRST
    if TIMES * scale <= longest:
        grams, width = mixed(words.astype(np.uint64) + np.uint64(1)), 1
        while width < scale // 4:
            grams, width = doubled(grams, width), 2 * width
    while TIMES * scale <= longest:
        twice = doubled(grams, width)
        wide = doubled(twice, 2 * width)
        known, new = (0, -1), []
        for m, q in zip(*(x.tolist() for x in seeds(grams, wide, scale, found))):
            if known[0] == q and m < known[1]:
                continue
            a = m - reach(words, m - 1, m + q - 1, -1)
            ahead = reach(words, m, m + q, 1)
            known = (q, m + ahead)
            b = m + q + ahead
            if b - a >= TIMES * q and primitive(words, a, b, q):
                new.append((a, b, q))
        found += new
        grams, width, scale = twice, 2 * width, 2 * scale
    return sorted((a, q, b) for a, b, q in found if b - a >= LEAST)


def runs_of(texts: list[bytes]) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """For each text the number of its words and its runs (start, length, period), sorted."""
    ids = numbering()
    each = [word_ids(t, ids) for t in texts]
    ends = np.cumsum([len(e) + 1 for e in each])
    words = np.concatenate([part for k, e in enumerate(each) for part in (e, np.array([len(ids) + k]))])
    found = all_runs(words, max(map(len, each)))
    at, begin = 0, 0
    for e, end in zip(each, ends.tolist()):
        own = []
        while at < len(found) and found[at][0] < end:
            a, q, b = found[at]
            own.append((a - begin, b - a, q))
            at += 1
        yield len(e), own
        begin = end


def collapsed(raw: bytes, n: int, runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run contains after its first period, joined by one space."""
    if not runs:
        return b" ".join(raw.split()) if len(raw) < TOGETHER else words_between(raw, [(0, n)])
    gone = np.zeros(n + 1, np.int32)
    for a, length, q in runs:
        gone[a + q] += 1
        gone[a + length] -= 1
    kept = np.concatenate([[False], np.cumsum(gone[:n]) == 0, [False]])
    edges = np.flatnonzero(kept[1:] != kept[:-1]).tolist()
    return words_between(raw, list(zip(edges[::2], edges[1::2])))


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for each row: ``runs`` (start, length, period) by start, then period; ``collapsed``: the text
    without the words that a run contains after its first period."""
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def search(batches):
        for batch, texts in by_bytes(batches, most=TOGETHER):
            schema = pa.schema([batch.schema.field("doc_id"), ("n_words", pa.int64()), ("runs", pa.list_(run)), ("collapsed", pa.string())])
            raws = [raw_text(t) for t in texts]
            found = list(runs_of(raws))
            yield table(
                schema, doc_id=batch.column("doc_id"), n_words=[n for n, _ in found],
                runs=[[{"start": a, "length": length, "period": q} for a, length, q in runs] for _, runs in found],
                collapsed=pa.array([collapsed(raw, n, runs) for raw, (n, runs) in zip(raws, found)], pa.binary()).cast(pa.string()),
            )

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(rows).mapInArrow(search, f"doc_id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def run_digest(docs: DataFrame) -> DataFrame:
    """The number of runs, the one of greatest length over period (ties: smallest start, then period) and digests, for each row."""

    def better(best: Column, r: Column) -> Column:
        # Runs come by start, then period: only a greater exponent replaces the first.
        return F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)

    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    found = periodic_runs(docs).withColumn("best", F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: of the texts whose doc_id's CRC-32 h is divisible by ten, the words from the a-th on repeat with period p.

    g = floor(h / 10), a = g mod n, p = 1 + floor((n - a) / (3 + g mod 8)); a null doc_id plants nothing.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all(text_of(), F.lit(WORD), F.lit(0))
    sizes = F.expr(
        "transform(array(words), w -> named_struct('w', w, 'n', size(w), 'a', pmod(g, size(w)), 'p', 1 + (size(w) - pmod(g, size(w))) div (3 + g % 8)))[0]"
    )
    planted = F.expr("array_join(transform(sequence(0, s.n - 1), i -> s.w[cast(if(i < s.a, i, s.a + (i - s.a) % s.p) as int)]), ' ')")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = rows.withColumns({"h": h, "words": F.when(h % 10 == 0, words)})
    rows = rows.withColumn("g", F.floor(F.col("h") / 10)).withColumn("s", F.when(F.size("words") > 0, sizes))
    return rows.select("doc_id", F.when(F.col("s").isNotNull(), planted).otherwise(F.col("text")).alias("text"))
