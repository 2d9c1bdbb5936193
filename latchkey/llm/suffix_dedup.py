"""Removal of long repeated strings with a logarithmic family of suffix arrays."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from latchkey.llm.common import delete_folder, free_shuffles, new_folder, small_batches, text_column

#: Bytes of text that a task takes together, and window starts that are worked on at once.
CHUNK, SLICE = 16 << 20, 1 << 20
#: Bytes of text for each bucket of suffixes, and buckets for each task.
PER_BUCKET, PER_TASK = 4 << 20, 4
TABLE = np.random.RandomState(7).randint(0, 1 << 62, 256).astype(np.uint64) * np.uint64(4) + np.uint64(1)
HIGH, LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)
MIX, STEP = np.uint64(0x9E3779B97F4A7C15), 0xBF58476D1CE4E5B9


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all strings of ``width`` bytes, by doubling."""
    n = len(data) - width + 1
    now, size, factor, out, done = TABLE[data], 1, STEP, None, 0
    while width:
        if width & 1:
            part = now[done : done + n]
            out = part.copy() if out is None else out * np.uint64(factor) + part
            done += size
        width >>= 1
        if width:
            now = now[: len(now) - size] * np.uint64(factor) + now[size:]
            factor, size = factor * factor % (1 << 64), 2 * size
    out ^= out >> np.uint64(29)
    out *= MIX
    return out ^ (out >> np.uint64(32))


def gram_of(length: int) -> int:
    """Bytes from an anchor on that each string of ``length`` bytes with this anchor holds."""
    return max(1, 2 * length // 5)


def runs(data: np.ndarray, ends: np.ndarray, length: int):
    """(first window, bytes, anchor) of each run of windows of ``length`` bytes that share their anchor.

    The anchor of a window is the place in it where the string of ``gram_of(length)`` bytes has the least
    hash (the leftmost of equals), so equal windows have equal anchors wherever they stand. Windows never
    cross the end of a text.
    """
    gram = gram_of(length)
    reach = length - gram + 1
    for lo in range(0, len(data) - length + 1, SLICE):
        part = data[lo : lo + SLICE + length - 1]
        h = rolling(part, gram)
        least = (h & HIGH) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while 2 * span <= reach:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if reach > span:
            least = np.minimum(least[: span - reach], least[reach - span :])
        anchor = (least & LOW).astype(np.int64)
        inside = np.ones(len(anchor), bool)
        near = ends[np.searchsorted(ends, lo, "right") : np.searchsorted(ends, lo + len(anchor) + length)]
        crossing = (near[:, None] - np.arange(1, length)[None, :]).ravel() - lo
        inside[crossing[(crossing >= 0) & (crossing < len(inside))]] = False
        starts = np.flatnonzero(inside)
        if len(starts):
            a = anchor[starts]
            new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (starts[1:] != starts[:-1] + 1)])
            last = np.r_[new[1:], len(starts)] - 1
            yield starts[new] + lo, starts[last] - starts[new] + length, a[new] + lo


def prefixes(data: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
    """The first ``size`` bytes of the suffixes at ``at``, as big-endian words: in order of the words the
    suffixes are in order of their bytes. Beyond the end of the data there are zeros."""
    padded = np.concatenate([data, np.zeros(size + 8, np.uint8)])
    words = np.ndarray(len(padded) - 7, ">u8", padded, strides=(1,))
    out = [words[at + k].astype(np.uint64) for k in range(0, size, 8)]
    if size % 8:
        out[-1] &= ~np.uint64(0) << np.uint64(64 - 8 * (size % 8))
    return out


def mixed(words: list[np.ndarray]) -> np.ndarray:
    """A hash of suffixes' first bytes, which deals them out to buckets."""
    h = np.zeros(len(words[0]), np.uint64)
    for w in words:
        h = (h ^ w) * MIX
        h ^= h >> np.uint64(29)
    return h


def _packed(words: list[np.ndarray], size: int) -> bytes:
    """Words as compressed planes of four bytes."""
    planes = [(w >> np.uint64(s)).astype("<u4").tobytes() for w in words for s in (32, 0)]
    return pa.compress(b"".join(planes[: -(-size // 4)]), "zstd", asbytes=True) if len(words[0]) else b""


def _unpacked(packed: bytes, n: int, size: int) -> list[np.ndarray]:
    planes = -(-size // 4)
    flat = np.frombuffer(pa.decompress(packed, 4 * n * planes, "zstd", asbytes=True), "<u4").reshape(planes, n).astype(np.uint64)
    return [(flat[k] << np.uint64(32)) | (flat[k + 1] if k + 1 < planes else np.uint64(0)) for k in range(0, planes, 2)]


def _groups(words: list[np.ndarray]) -> np.ndarray:
    """Where in a sorted array another suffix starts: the longest common prefix with the one before is too short."""
    n = len(words[0])
    return np.flatnonzero(np.r_[[True] * min(n, 1), np.logical_or.reduce([w[1:] != w[:-1] for w in words])]) if n else np.zeros(0, np.int64)


def _chunks(batches, text_at: int):
    """Lists of rows of about CHUNK bytes of text."""
    rows, held = [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            row = [c[i].as_py() for c in batch.columns]
            row[text_at] = row[text_at].encode("utf-8", "surrogatepass")
            rows.append(row)
            held += len(row[text_at])
            if held >= CHUNK:
                yield rows
                rows, held = [], 0
    if rows:
        yield rows


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(np.array([len(t) for t in texts], np.int64))


ARRAYS = "kind int, merge boolean, bucket int, n int, starts binary, docs binary, told binary"
ARROW = pa.schema([("kind", pa.int32()), ("merge", pa.bool_()), ("bucket", pa.int32()), ("n", pa.int32()), ("starts", pa.binary()), ("docs", pa.binary()), ("told", pa.binary())])
ENTRY, HIT = 0, 1


def _hit(bucket: int, h: np.ndarray, d: np.ndarray) -> dict:
    """Documents whose suffix is repeated; of the suffix a hash is enough, since what it finds is compared again."""
    return {"kind": HIT, "merge": True, "bucket": bucket, "n": len(d), "starts": h.astype("<u8").tobytes(), "docs": d.astype("<i8").tobytes(), "told": b""}


def _entries(bucket: int, words: list[np.ndarray], size: int, d: np.ndarray, told: np.ndarray) -> dict:
    docs = pa.compress(d.astype("<i8").tobytes(), "zstd", asbytes=True) if len(d) else b""
    return {"kind": ENTRY, "merge": True, "bucket": bucket, "n": len(d), "starts": _packed(words, size), "docs": docs, "told": told.astype(np.uint8).tobytes()}


def _by_bucket(h: np.ndarray, buckets: int):
    """(bucket, places) of the buckets that occur, places in order."""
    bucket = ((h >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    there, first = np.unique(bucket[order], return_index=True)
    yield from zip(there.tolist(), np.split(order, first[1:]), strict=False)


def _array_of(length: int, buckets: int):
    """A batch's part of the suffix array: the suffixes at anchors in lexicographic order of their first
    bytes, by bucket, each with the first of its documents in the task. Suffixes that the task holds in
    several documents are hits at once, so a string that is everywhere is one entry for each task."""
    size = gram_of(length)

    def run(batches):
        for number, rows in enumerate(_chunks(batches, 1)):
            data, ends = _joined([r[1] for r in rows])
            ids = np.array([r[0] for r in rows], np.int64)
            at = np.unique(np.concatenate([np.zeros(0, np.int64), *(x[2] for x in runs(data, ends, length))]))
            if not len(at):
                continue
            words, d = prefixes(data, at, size), ids[np.searchsorted(ends, at, "right")]
            order = np.lexsort((d, *words[::-1]))
            words, d = [w[order] for w in words], d[order]
            own = np.zeros(len(d), bool)
            own[_groups([*words, d])] = True
            words, d = [w[own] for w in words], d[own]
            new = _groups(words)
            many = np.diff(np.r_[new, len(d)])
            shared = np.repeat(many > 1, many)
            h = mixed(words)
            out = [_hit(number % buckets, h[shared], d[shared])] if shared.any() else []
            words, d, h, several = [w[new] for w in words], d[new], h[new], many > 1
            for b, place in _by_bucket(h, buckets):
                out.append(_entries(b, [w[place] for w in words], size, d[place], several[place]))
            yield pa.RecordBatch.from_pylist(out, schema=ARROW)

    return run


def _merge_scan(length: int, keep: bool):
    """Merges a bucket's arrays into one in lexicographic order and scans it: neighbours whose common prefix
    is long enough are one suffix, and one that several documents have is reported."""
    size = gram_of(length)

    def run(table: pa.Table) -> pa.Table:
        bucket, out, parts = table.column("bucket")[0].as_py(), [], []
        for r in table.to_pylist():
            if r["kind"] == HIT:
                out.append({c: r[c] for c in ARROW.names})
            elif r["n"]:
                docs = np.frombuffer(pa.decompress(r["docs"], 8 * r["n"], "zstd", asbytes=True), "<i8")
                flags = [np.full(r["n"], x) for x in (not r["level"], r["merge"])]
                parts.append([*_unpacked(r["starts"], r["n"], size), docs, np.frombuffer(r["told"], np.uint8).astype(bool), *flags])
        if parts:
            *words, d, told, fresh, kept = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.lexsort((d, *words[::-1]))
            words, d, told, fresh, kept = [w[order] for w in words], d[order], told[order], fresh[order], kept[order]
            new = _groups(words)
            many = np.diff(np.r_[new, len(d)])
            differ = np.minimum.reduceat(d, new) < np.maximum.reduceat(d, new)
            repeated = differ & np.logical_or.reduceat(fresh, new) | np.logical_or.reduceat(told, new)
            hit = np.repeat(repeated, many) & ~told
            if hit.any():
                out.append(_hit(bucket, mixed([w[hit] for w in words]), d[hit]))
            if keep and kept.any():
                # Of a suffix the earliest document that this merge writes stays.
                words, d, flag = [w[kept] for w in words], d[kept], (np.repeat(repeated, many) | told)[kept]
                first = _groups(words)
                out.append(_entries(bucket, [w[first] for w in words], size, d[first], flag[first]))
        return pa.Table.from_pylist(out, schema=ARROW)

    return run


def _partitions(spark, buckets: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-buckets // PER_TASK), 20_000))


class SuffixArrays:
    """A family of suffix arrays whose sizes are different powers of two.

    ``add`` takes a batch of (doc_id, text), gives it a suffix array, scans that against all arrays in
    one merge by bucket, and merges it with the arrays of its size, as a binary counter carries. Only
    suffixes at anchors are kept, at least one in each string of ``length`` bytes, in lexicographic order
    of the bytes that every string with that anchor holds; a bucket has what a hash of these deals it.
    Each batch reads all levels once, so a corpus at hand goes in few batches; one that grows adds a
    batch for each delivery, and each suffix is rewritten once for each doubling.
    """

    def __init__(self, spark, length: int, buckets: int) -> None:
        self.spark, self.length, self.buckets = spark, length, buckets
        self.levels: list[tuple[str, int]] = []
        self.hits: list[str] = []

    def add(self, batch: DataFrame, keep: bool = True) -> None:
        size, merged = 1, []
        for at, n in reversed(self.levels):
            if n != size:
                break
            merged.append(at)
            size += n
        to = self._merged(batch, merged, keep)
        free_shuffles(self.spark)
        self.hits.append(to)
        if keep:
            for at in merged:
                delete_folder(self.spark, f"{at}/kind={ENTRY}")
            self.levels = [x for x in self.levels if x[0] not in merged] + [(to, size)]

    def _merged(self, batch: DataFrame, merged: list[str], keep: bool) -> str:
        rows = batch.mapInArrow(_array_of(self.length, self.buckets), ARRAYS).withColumn("level", F.lit(False))
        for at, _ in self.levels:
            level = self.spark.read.schema(ARRAYS).parquet(at).where(F.col("kind") == ENTRY)
            rows = rows.unionByName(level.select(F.lit(ENTRY).alias("kind"), F.lit(at in merged).alias("merge"), "bucket", "n", "starts", "docs", "told", F.lit(True).alias("level")))
        to = new_folder(self.spark, "suffixes")
        rows.repartition(_partitions(self.spark, self.buckets), "bucket").groupBy("bucket").applyInArrow(_merge_scan(self.length, keep), ARRAYS).write.partitionBy("kind").parquet(to)
        return to

    def forget(self) -> None:
        """Drops the arrays but not what they have found."""
        for at, _ in self.levels:
            delete_folder(self.spark, f"{at}/kind={ENTRY}")
        self.levels = []

    def repeated(self) -> DataFrame:
        """(doc_id, hash): the document has an anchored suffix with that start, and so has another."""

        def run(batches):
            for batch in batches:
                for h, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(d, "<i8")), pa.array(np.frombuffer(h, "<i8"))], ["doc_id", "hash"])

        rows = self.spark.createDataFrame([], ARRAYS)
        for at in self.hits:
            rows = rows.unionByName(self.spark.read.schema(ARRAYS).parquet(at).where(F.col("kind") == HIT), allowMissingColumns=True)
        return rows.select("starts", "docs").mapInArrow(run, "doc_id long, hash long")

    def close(self) -> None:
        for at in {*self.hits, *(x for x, _ in self.levels)}:
            delete_folder(self.spark, at)


SPANS = "doc_id long, key int, begin int, until int"
STRINGS = "bucket int, doc_ids binary, keys binary, starts binary, sizes binary, strings binary, raw long"


def _strings_of(length: int, buckets: int):
    """Runs of windows whose anchor is repeated, by bucket of the anchor's hash. Of equal runs in a
    task, those of the smallest document go out; the others are covered, which a row without strings says."""

    def run(batches):
        names = ["bucket", "doc_ids", "keys", "starts", "sizes", "strings", "raw"]

        def row(bucket, ids, keys, starts, sizes, strings):
            values = [np.array(x, kind).tobytes() for x, kind in ((ids, "<i8"), (keys, "<i4"), (starts, "<i4"), (sizes, "<i4"))]
            return dict(zip(names, [bucket, *values, pa.compress(strings, "zstd", asbytes=True) if strings else b"", len(strings)], strict=True))

        schema = pa.schema([("bucket", pa.int32()), *((n, pa.binary()) for n in names[1:6]), ("raw", pa.int64())])
        for number, rows in enumerate(_chunks(batches, 2)):
            data, ends = _joined([r[2] for r in rows])
            first, whole = ends - np.array([len(r[2]) for r in rows]), data.tobytes()
            wanted = [np.sort(np.array(r[3], np.int64)).view(np.int64) for r in rows]
            ranks = np.argsort(np.array([r[0] for r in rows], np.int64), kind="stable")
            place = np.empty(len(rows), np.int64)
            place[ranks] = np.arange(len(rows))
            picked = []
            for start, size, anchor in runs(data, ends, length):
                text = np.searchsorted(ends, start, "right")
                h = mixed(prefixes(data[: anchor[-1] + length], anchor, gram_of(length)))
                signed = h.view(np.int64)
                keep = np.zeros(len(h), bool)
                for t in np.unique(text):
                    lo, hi = np.searchsorted(text, [t, t + 1])
                    w = wanted[t]
                    keep[lo:hi] = w[np.minimum(np.searchsorted(w, signed[lo:hi]), len(w) - 1)] == signed[lo:hi]
                picked.append((start[keep], size[keep], h[keep], text[keep]))
            if not picked:
                continue
            start, size, h, text = (np.concatenate([p[i] for p in picked]) for i in range(4))
            order = np.argsort(place[text], kind="stable")
            owner: dict[bytes, int] = {}
            sent = np.zeros(len(start), bool)
            for i in order.tolist():
                s = whole[start[i] : start[i] + size[i]]
                doc = rows[text[i]][0]
                sent[i] = owner.setdefault(s, doc) == doc
            out = []
            ids, keys = np.array([r[0] for r in rows], np.int64)[text], np.array([r[1] for r in rows], np.int64)[text]
            if not sent.all():
                rest = ~sent
                out.append(row(number % buckets, ids[rest], keys[rest], (start - first[text])[rest], size[rest], b""))
            todo = np.flatnonzero(sent)
            for b, place in _by_bucket(h[todo], buckets):
                at = todo[place]
                strings = b"".join(whole[start[i] : start[i] + size[i]] for i in at.tolist())
                out.append(row(b, ids[at], keys[at], (start - first[text])[at], size[at], strings))
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def suffix_ranks(data: np.ndarray, left: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where ``length`` bytes are left of their string, and the ranks of these bytes in lexicographic
    order, equal for equal bytes alone: a suffix array up to ``length`` bytes by prefix doubling, from
    ranks of eight bytes (of one if ``length`` is less). ``left`` says how many bytes of its string each place has."""

    def ranked(places: np.ndarray, keys: np.ndarray) -> np.ndarray:
        order = np.argsort(keys)
        s = keys[order]
        out = np.zeros(len(data), np.uint32)
        out[places[order]] = np.cumsum(np.r_[np.zeros(min(1, len(s)), np.uint32), (s[1:] != s[:-1]).astype(np.uint32)], dtype=np.uint32)
        return out

    size = 8 if length >= 8 else 1
    places = np.flatnonzero(left >= size)
    rank = ranked(places, prefixes(data, places, size)[0])
    while size < length:
        more = min(size, length - size)
        size += more
        places = np.flatnonzero(left >= size)
        rank = ranked(places, (rank[places].astype(np.uint64) << np.uint64(32)) | rank[places + more])
    return places, rank[places]


def _covered(length: int):
    """(doc_id, key, begin, until): parts of documents whose windows also start in a smaller document."""

    def run(table: pa.Table) -> pa.Table:
        columns = {c: table.column(c).to_pylist() for c in table.column_names}
        done = {"doc_id": [], "key": [], "begin": [], "until": []}

        def emit(ids, keys, begin, until):
            for c, v in zip(done, (ids, keys, begin, until), strict=True):
                done[c].append(np.asarray(v, np.int64 if c == "doc_id" else np.int32))

        read = lambda name, kind, i: np.frombuffer(columns[name][i], kind)
        known: dict[bytes, int] = {}
        whose, entries = [], []
        for i, raw in enumerate(columns["raw"]):
            ids, keys, starts, sizes = (read(c, k, i).astype(np.int64) for c, k in (("doc_ids", "<i8"), ("keys", "<i4"), ("starts", "<i4"), ("sizes", "<i4")))
            if not raw:
                emit(ids, keys, starts, starts + sizes)
                continue
            strings, ends = pa.decompress(columns["strings"][i], raw, "zstd", asbytes=True), np.cumsum(sizes).tolist()
            whose += [known.setdefault(strings[e - n : e], len(known)) for e, n in zip(ends, sizes.tolist(), strict=True)]
            entries.append((ids, keys, starts, sizes))
        if entries:
            # Each string once, with the first of its documents; the others are covered by it.
            ids, keys, starts, sizes = (np.concatenate(c) for c in zip(*entries, strict=True))
            whose = np.array(whose, np.int64)
            least = np.full(len(known), np.iinfo(np.int64).max)
            np.minimum.at(least, whose, ids)
            later = ids > least[whose]
            emit(ids[later], keys[later], starts[later], (starts + sizes)[later])
            data = np.frombuffer(b"".join(known), np.uint8)
            lengths = np.fromiter(map(len, known), np.int64, len(known))
            ends = np.cumsum(lengths)
            del known, entries
            left = (np.repeat(ends, lengths) - np.arange(len(data))).astype(np.int32)
            places, rank = suffix_ranks(data, left, length)
            string = np.searchsorted(ends, places, "right")
            order = np.argsort(rank)
            new = np.flatnonzero(np.r_[True, np.diff(rank[order]) != 0])
            first = np.minimum.reduceat(least[string][order], new)
            seen = np.zeros(len(places), bool)
            seen[order] = least[string][order] > np.repeat(first, np.diff(np.r_[new, len(order)]))
            hit = np.flatnonzero(seen)
            if len(hit):
                apart = np.flatnonzero(np.r_[True, (places[hit[1:]] != places[hit[:-1]] + 1) | (string[hit[1:]] != string[hit[:-1]])])
                a, b = hit[apart], hit[np.r_[apart[1:], len(hit)] - 1]
                # Parts of strings, for each place of the string in its first document.
                owners = np.flatnonzero(~later)
                owners = owners[np.argsort(whose[owners], kind="stable")]
                lo, hi = (np.searchsorted(whose[owners], string[a], side) for side in ("left", "right"))
                part = np.repeat(np.arange(len(a)), hi - lo)
                e = owners[np.arange(len(part)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[part]]
                base = (ends - lengths)[string[a]][part]
                emit(ids[e], keys[e], starts[e] + places[a][part] - base, starts[e] + places[b][part] - base + length)
        return pa.table({c: np.concatenate(v) if v else np.zeros(0, np.int64 if c == "doc_id" else np.int32) for c, v in done.items()})

    return run


CUT = StructType([StructField("n_removed", LongType()), StructField("n_spans", LongType()), StructField("kept_sha256", StringType())])


@F.pandas_udf(CUT)
def _cut(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
    """What is left of texts without their spans (begin in the upper half, end in the lower, in order);
    rows without spans, which come as null texts, give nulls."""
    out = []
    for t, found in zip(text, spans, strict=True):
        if t is None:
            out.append((None, None, None))
            continue
        data, kept, at, removed, n, until = t.encode("utf-8", "surrogatepass"), hashlib.sha256(), 0, 0, 0, -1
        for s in found.tolist():
            begin, end = s >> 32, s & 0xFFFFFFFF
            if begin > until:
                kept.update(data[at:begin])
                n += 1
                removed += end - begin
            elif end > until:
                removed += end - until
            at = until = max(until, end)
        kept.update(data[at:])
        out.append((removed, n, kept.hexdigest()))
    return pd.DataFrame(out, columns=["n_removed", "n_spans", "kept_sha256"])


def repeated_spans(docs: DataFrame, length: int = 50, batches: int = 4, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows has doc_id, key, text; spans has doc_id, key, begin, until in bytes.

    First the documents go into the suffix arrays in ``batches`` ranges of doc_id, each range pushed
    down to the scan. That leaves the anchors that several documents have. Only the strings of windows at
    such anchors are then compared, bucket by bucket, all their suffixes by all their first ``length`` bytes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_column(text_col).alias("text"))
    known = rows.where("doc_id is not null")
    cuts = ", ".join(str(i / batches) for i in range(1, batches))
    facts = known.agg(F.sum(F.octet_length("text")).alias("bytes"), F.expr(f"approx_percentile(doc_id, array({cuts}), 1000)").alias("cuts") if batches > 1 else F.lit(None).alias("cuts")).head()
    buckets = max(8, (facts.bytes or 0) // PER_BUCKET)
    arrays, low = SuffixArrays(spark, length, buckets), None
    edges = [*dict.fromkeys(facts.cuts or []), None]
    for i, high in enumerate(edges):
        part = known
        if low is not None:
            part = part.where(F.col("doc_id") > low)
        if high is not None:
            part = part.where(F.col("doc_id") <= high)
        arrays.add(part, keep=i + 1 < len(edges))
        low = high
    arrays.forget()
    # Rows that share a doc_id are told apart by 32 bits of their texts' hash.
    keyed = rows.select("doc_id", F.hash("text").alias("key"), "text")
    at = _write_spans(keyed, arrays.repeated(), length, buckets)
    arrays.close()
    free_shuffles(spark)
    return keyed, spark.read.schema(SPANS).parquet(at)


def _write_spans(keyed: DataFrame, repeated: DataFrame, length: int, buckets: int) -> str:
    spark = keyed.sparkSession
    wanted = repeated.groupBy("doc_id").agg(F.collect_set("hash").alias("hashes"))
    strings = keyed.join(wanted, "doc_id").select("doc_id", "key", "text", "hashes").mapInArrow(_strings_of(length, buckets), STRINGS)
    at = new_folder(spark, "spans")
    strings.repartition(_partitions(spark, buckets), "bucket").groupBy("bucket").applyInArrow(_covered(length), SPANS).write.parquet(at)
    return at


def remove_repeats(docs: DataFrame, length: int = 50, batches: int = 4) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte is removed if a string of ``length`` bytes that covers it also starts in a document with a
    smaller doc_id, judged on the input. Null texts are empty; a row with a null doc_id is neither
    smaller nor larger than any and keeps its text; rows with one doc_id are not compared with each
    other, and each is judged against smaller ones. An empty table gives an empty result.
    """
    rows, spans = repeated_spans(docs, length, batches)
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("key", "begin", "until")).alias("spans"))
    own = F.array_sort(F.transform(F.filter("spans", lambda s: s["key"] == F.col("key")), lambda s: F.shiftleft(s["begin"].cast("long"), 32).bitwiseOR(s["until"].cast("long"))))
    j = rows.join(spans, "doc_id", "left").withColumn("own", own)
    j = j.withColumn("left", _cut(F.when(F.size("own") > 0, F.col("text")), "own"))
    return j.select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.coalesce("left.n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("left.n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("left.kept_sha256", F.sha2("text", 256)).alias("kept_sha256"),
    )
