"""Periodic stretches of words in documents: multi-scale minimizers seed them, comparison of words decides."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latchkey.llm.common import small_batches, text_column

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LEAST, TIMES = 24, 3
#: Periods up to this are looked for by comparing words at each distance.
SHORT = 24

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (minimum or maximum) of each window of ``width``, by windows that double."""
    size = 1
    while 2 * size <= width:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def minimizers(hashes: np.ndarray, width: int) -> np.ndarray:
    """Places that are the least of some window of ``width``; which of a window's places are, depends on
    the window's content alone."""
    if len(hashes) < width:
        return np.zeros(0, np.int64)
    least = _sliding(hashes, width, np.minimum)
    none = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(_sliding(np.concatenate([none, least, none]), width, np.maximum) == hashes)


def _same_back(x: np.ndarray, m: int, q: int) -> int:
    """How many words before place m agree with those q later."""
    n, step = 0, 64
    while n < m:
        step = min(step, m - n)
        bad = np.flatnonzero(x[m - n - step : m - n] != x[m + q - n - step : m + q - n])
        if len(bad):
            return n + step - 1 - int(bad[-1])
        n, step = n + step, step * 2
    return n


def _same_on(x: np.ndarray, m: int, q: int) -> int:
    """How many words from place m on agree with those q later."""
    n, step = 0, 64
    while m + q + n < len(x):
        step = min(step, len(x) - m - q - n)
        bad = np.flatnonzero(x[m + n : m + n + step] != x[m + q + n : m + q + n + step])
        if len(bad):
            return n + int(bad[0])
        n, step = n + step, step * 2
    return n


def _primes(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + [n] if n > 1 else out


def _is_least(x: np.ndarray, start: int, length: int, period: int) -> bool:
    """No part of the period is a period. A stretch of three periods has no smaller one that doesn't divide it."""
    s = x[start : start + length]
    return not any((s[: -period // r] == s[period // r :]).all() for r in _primes(period))


def runs_of(x: np.ndarray, longest: list[int], ends: list[int], least: int = LEAST, times: int = TIMES, short: int = SHORT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs in the numbers ``x``: texts one after another, longest first, of
    ``longest`` words, each closed by a number of its own at its ``ends`` - 1.

    A run of period q holds 3 q words, so for grams of k words and windows of w grams with
    q <= k and w <= 2 q - k + 1 some window and the one q later lie inside it and have the same least
    gram, at places q apart. As k is no less than q, no other equal gram stands between these. A scale takes the
    periods from b + 1 to 1.5 b, with k = 1.5 b; equal neighbours among its minimizers are seeds, which
    exact comparison extends to both sides. Scales look at texts of three periods only."""
    found: set[tuple[int, int, int]] = set()
    for q in range(1, min(short, len(x) - 1) + 1):
        bad = np.concatenate([[-1], np.flatnonzero(x[q:] != x[:-q]), [len(x) - q]])
        gap = np.diff(bad) - 1
        for i in np.flatnonzero(gap >= max(least, times * q) - q):
            found.add((int(bad[i]) + 1, int(gap[i]) + q, q))
    b = short
    if longest and longest[0] >= 3 * (b + 1):
        odd = 0x9E3779B97F4A7C15
        n = ends[sum(m >= 3 * (b + 1) for m in longest) - 1]
        power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, odd, np.uint64)]))
        inverse = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, pow(odd, -1, 1 << 64), np.uint64)]))
        total = np.concatenate([[np.uint64(0)], np.add.accumulate(_mixed(x[:n].astype(np.uint64)) * power[:n])])
    while longest and longest[0] >= 3 * (b + 1):
        most = b + b // 2
        n = ends[sum(m >= 3 * (b + 1) for m in longest) - 1]
        grams = _mixed((total[most : n + 1] - total[: n + 1 - most]) * inverse[: n + 1 - most])
        at = minimizers(grams, 2 * (b + 1) - most + 1)
        at = at[np.argsort(grams[at], kind="stable")]
        gap = np.diff(at)
        seed = np.flatnonzero((grams[at[1:]] == grams[at[:-1]]) & (gap > b) & (gap <= most))
        last, over = 0, 0
        for q, m in sorted(zip(gap[seed].tolist(), at[seed].tolist(), strict=True)):
            if q == last and m < over:
                continue
            back, on = _same_back(x, m, q), _same_on(x, m, q)
            last, over = q, m + on
            if back + on + q >= max(least, times * q):
                found.add((m - back, back + on + q, q))
        b = most
    return [r for r in found if _is_least(x, *r)]


def _scan(batches):
    for batch in batches:
        ids: dict[str, int] = {}
        words = [WORD.findall(t) for t in batch.column(1).to_pylist()]
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        longest = [len(words[i]) for i in order]
        ends = np.cumsum([n + 1 for n in longest]).tolist()
        x = np.empty(ends[-1] if ends else 0, np.int64)
        for place, (i, end) in enumerate(zip(order, ends, strict=True)):
            x[end - 1 - len(words[i]) : end - 1] = [ids.setdefault(w, len(ids)) for w in words[i]]
            x[end - 1] = -1 - place
        per: list[list[tuple[int, int, int]]] = [[] for _ in words]
        found = runs_of(x, longest, ends)
        place = np.searchsorted(ends, [r[0] for r in found], side="right").tolist()
        for (start, length, period), p in zip(found, place, strict=True):
            per[order[p]].append((start - (ends[p] - 1 - longest[p]), length, period))
        best, kept = [], []
        for runs, w in zip(per, words, strict=True):
            runs.sort(key=lambda r: (r[0], r[2]))
            top = None
            for r in runs:
                if top is None or r[1] * top[2] > top[1] * r[2]:
                    top = r
            best.append(top)
            if runs:
                change = np.zeros(len(w) + 1, np.int64)
                for start, length, period in runs:
                    change[start + period] += 1
                    change[start + length] -= 1
                w = [v for v, c in zip(w, np.cumsum(change).tolist(), strict=False) if not c]  # one count more than words
            kept.append(" ".join(w))
        named = lambda r: r and dict(zip(("start", "length", "period"), r, strict=True))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(map(len, words), pa.int64()), pa.array([[named(r) for r in runs] for runs in per], pa.list_(RUN)), pa.array([named(r) for r in best], RUN), pa.array(kept, pa.string())],
            ["id", "n_words", "runs", "densest", "collapsed"],
        )


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, n_words, runs (array of start, length, period, by start and period),
    densest (the run of most periods; of equal ones the first) and collapsed (the text's words, joined by one
    space, without those that a run holds after its first period).

    A run is a stretch of words with smallest period q that holds at least 24 words and three periods and
    that no neighbouring word extends. Null counts as the empty text: no words, no runs, an empty
    ``collapsed``. Repeated rows and null ids are scanned each; an empty table gives an empty result; other
    columns are not looked at. Texts are scanned whole, in batches of bounded bytes, without a shuffle.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    run = "struct<start: bigint, length: bigint, period: bigint>"
    out = docs.select(F.col(id_col).alias("id"), text_column(text_col).alias("text")).mapInArrow(_scan, f"id {kind}, n_words bigint, runs array<{run}>, densest {run}, collapsed string")
    return out.withColumnRenamed("id", id_col)


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the words of every tenth document, by crc32 of its id, made periodic from some word on."""
    words = F.regexp_extract_all(text_column(), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    h = F.crc32(F.col("doc_id").cast("string"))
    d = docs.select("doc_id", text_column().alias("text"), h.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, words))
    d = d.withColumns({"n": F.size("w"), "g": F.floor(F.col("h") / 10)}).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    d = d.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    tail = F.transform(F.sequence(F.col("a"), F.col("n") - 1), lambda i: F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    made = F.array_join(F.concat(F.slice("w", 1, F.col("a").cast("int")), tail), " ")
    return d.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The columns of the query from those of ``periodic_runs``."""
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    d = F.col("densest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), d["start"].alias("start"), d["length"].alias("length"), d["period"].alias("period"), F.expr("1000 * densest.length div densest.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
