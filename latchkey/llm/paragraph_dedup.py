"""Repeated passages: paragraph MinHash banding, exact Jaccard, components."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latchkey.llm import simhash
from latchkey.llm.common import connected_components, free_shuffles, small_batches, staged, text_column, tidy

SEED = 42


def shingles(text: str, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a paragraph's lower-cased word shingles; fewer words: all of them as one."""
    import xxhash

    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    s = [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False))
    return np.unique(np.array([xxhash.xxh64_intdigest(x, SEED) for x in s], np.uint64))


def bands_for(similarity: float, recall: float, rows: int) -> int:
    """The least number of bands of ``rows`` values each by which a pair at ``similarity`` meets with
    probability ``recall`` or more."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))


def _shingle_numbers(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the lower-cased word shingles of all ``texts`` one after another, and where each
    text's begin; a text of fewer words gives one. Words are hashed once, shingles from their words' hashes."""
    import xxhash

    split = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    n = np.array([len(w) for w in split], np.int64)
    # Zeros after each text's words, so that a shingle of a short text has as many numbers as any other.
    width = np.maximum(n, 1) + words - 1
    begin = np.cumsum(width) - width
    h = np.zeros(int(width.sum()), np.uint64)
    place = np.arange(int(n.sum())) + np.repeat(begin - (np.cumsum(n) - n), n)
    h[place] = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for w in split for x in w), np.uint64, len(place))
    grams = np.zeros(len(h) - words + 1, np.uint64)
    for k in range(words):
        grams *= np.uint64(0x9E3779B97F4A7C15)
        grams += h[k : k + len(grams)]
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    many = np.maximum(n - words + 1, 1)
    starts = np.cumsum(many) - many
    return (grams >> np.uint64(32)).astype(np.uint32)[np.arange(int(many.sum())) + np.repeat(begin - starts, many)], starts


def band_keys(texts: list[str], words: int, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each text and band."""
    random = np.random.RandomState(SEED)
    odd = (random.randint(0, 1 << 31, bands * rows).astype(np.uint32) << np.uint32(1)) | np.uint32(1)
    flip = random.randint(0, 1 << 32, bands * rows, dtype=np.uint64).astype(np.uint32)
    if not texts:
        return np.zeros((0, bands), np.uint64)
    h, starts = _shingle_numbers(texts, words)
    out = np.tile(np.arange(bands, dtype=np.uint64) + np.uint64(1), (len(texts), 1))
    for j in range(bands * rows):
        x = h ^ flip[j]
        x *= odd[j]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        key = (out[:, j // rows] ^ np.minimum.reduceat(x, starts)) * np.uint64(0x9E3779B97F4A7C15)
        out[:, j // rows] = key ^ (key >> np.uint64(31))
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def _verified(words: int, similarity: float):
    def run(batches):
        for batch in batches:
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            known: dict[str, np.ndarray] = {}
            of = lambda t: known[t] if t in known else known.setdefault(t, shingles(t, words))  # noqa: E731, B023
            keep = pa.array([jaccard(of(s), of(t)) >= similarity - 1e-12 for s, t in zip(x, y, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(keep)

    return run


def _to_head(words: int, similarity: float):
    """Members of one part of a bucket with their similarity to the bucket's head."""

    def run(members: pa.Table, head: pa.Table) -> pa.Table:
        name, own = head.column("id")[0].as_py(), shingles(head.column("text")[0].as_py(), words)
        near = [1.0 if i == name else jaccard(own, shingles(t, words)) for i, t in zip(members.column("id").to_pylist(), members.column("text").to_pylist(), strict=True)]
        out = members.select(["key", "id", "text"])
        return out.append_column("head", pa.array([name] * len(near), pa.string())).append_column("near", pa.array(near, pa.float64()))

    return run


def _across(words: int, similarity: float):
    """Links that tie together what is similar enough in two blocks of a bucket, or in one. Pairs that
    the head ties already, or whose similarities to it are too far apart, are passed over."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, texts, near, salt = (table.column(c).to_pylist() for c in ("id", "text", "near", "salt"))
        two = table.column("low")[0].as_py() != table.column("high")[0].as_py()
        sets = [shingles(t, words) for t in texts]
        size, near, salt = np.array([len(x) for x in sets]), np.array(near), np.array(salt)
        tied = near >= similarity - 1e-12
        label, a, b = np.where(tied, -1, np.arange(len(ids))), [], []
        for i in range(1, len(ids)):
            may = (label[:i] != label[i]) & (np.abs(near[:i] - near[i]) <= 1 - similarity + 1e-9)
            may &= np.minimum(size[:i], size[i]) >= (similarity - 1e-9) * np.maximum(size[:i], size[i])
            if two:
                may &= salt[:i] != salt[i]
            for j in np.flatnonzero(may):
                if label[j] != label[i] and jaccard(sets[i], sets[j]) >= similarity - 1e-12:
                    a.append(ids[j])
                    b.append(ids[i])
                    label[label == label[j]] = label[i]
        return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string())})

    return run


def block_pairs(left: DataFrame, block: int) -> DataFrame:
    """Rows of (key, id, ...) once for each pair of blocks (low, high) of their key that they belong to,
    with the block (salt) they are in; a block has about ``block`` rows, so no pair of blocks has more than
    about twice as many, however many rows a key has, and each two rows of a key meet."""
    many = left.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"))
    salted = left.join(many, "key").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = salted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.withColumns({"low": F.least("salt", "other"), "high": F.greatest("salt", "other")}).drop("other", "blocks")


def crowded_links(full: DataFrame, words: int, similarity: float, block: int) -> DataFrame:
    """Links (a, b) that tie together what is similar enough in each bucket of ``full`` (key, n, id, text);
    n is how many members a bucket has.

    First all members are compared with the bucket's head (its smallest id), in parts of about ``block``
    rows. What is similar to the head is one component. As Jaccard distance is a metric, the others can be
    similar to one of these only if they are within twice the distance of the head. What the head does not
    settle is compared in pairs of blocks; no task holds more than two blocks and no pair is left out."""
    parts = F.ceil(F.col("n") / F.lit(block)).cast("int")
    salted = full.withColumn("salt", F.pmod(F.xxhash64("id"), parts).cast("int")).select("key", "salt", "id", "text")
    heads = full.groupBy("key").agg(F.max("n").alias("n"), F.min(F.struct("id", "text")).alias("head"))
    heads = heads.select(F.col("key").alias("bucket"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "head.id", "head.text")
    measured = salted.groupBy("key", "salt").cogroup(heads.groupBy("bucket", "part")).applyInArrow(_guarded(_to_head(words, similarity)), "key long, id string, text string, head string, near double")
    measured = staged(measured, "measured")
    tied = F.col("near") >= similarity - 1e-12
    fringe = measured.where(~tied & (F.col("near") >= 2 * similarity - 1 - 1e-9)).select("key").distinct()
    left = measured.where(~tied).unionByName(measured.where(tied).join(fringe, "key", "left_semi")).drop("head")
    rest = block_pairs(left, block).groupBy("key", "low", "high").applyInArrow(_across(words, similarity), "a string, b string")
    return measured.where(tied & (F.col("id") != F.col("head"))).select(F.col("head").alias("a"), F.col("id").alias("b")).unionByName(rest)


def _guarded(f):
    """``f`` for groups that have rows on both sides; parts without members give none."""

    def run(members: pa.Table, head: pa.Table) -> pa.Table:
        if members.num_rows and head.num_rows:
            return f(members, head)
        return pa.table({"key": pa.array([], pa.int64()), "id": pa.array([], pa.string()), "text": pa.array([], pa.string()), "head": pa.array([], pa.string()), "near": pa.array([], pa.float64())})

    return run


def similar_links(texts: DataFrame, words: int, similarity: float, recall: float, rows: int, short: int, block: int = 512, repeated: bool = False, groups: DataFrame | None = None) -> DataFrame:
    """Links (a, b) between ids of ``texts`` (id in hex, text) that tie together all that is similar
    enough; a pair at ``similarity`` meets with probability ``recall``. ``repeated`` if ids aren't distinct.
    What shares a key in ``groups`` (id in hex, key) meets too, whatever its bands, and is checked the same way."""
    bands = bands_for(similarity, recall, rows)

    def signed(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                keys = band_keys(part.column(1).to_pylist(), words, bands, rows).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([x for x in part.column(0).to_pylist() for _ in range(bands)], pa.string()), pa.array(keys.ravel())], ["id", "key"])

    index = texts.select("id", "text").mapInArrow(tidy(signed), "id string, key long")
    # A key's members are counted, then only keys with several go on.
    small = index.select("key", F.unhex("id").alias("id"))
    small = small.distinct() if repeated else small
    if groups is not None:
        small = small.unionByName(groups.select("key", F.unhex("id").alias("id")))
    listed = staged(small.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1"), "buckets")
    free_shuffles(texts.sparkSession)
    one = listed.where(F.col("n") <= short)
    pairs = one.select("key", F.col("id").alias("a")).join(one.select("key", F.col("id").alias("b")), "key").where("a < b").select("a", "b").distinct()
    text = texts.select(F.unhex("id").alias("id"), "text")
    used = text.join(listed.select("id").distinct(), "id", "left_semi")
    used = staged(used.groupBy("id").agg(F.min("text").alias("text")) if repeated else used, "candidates")
    sides = pairs.join(used.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(used.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
    links = sides.select(F.lower(F.hex("a")).alias("a"), F.lower(F.hex("b")).alias("b"), "x", "y").mapInArrow(tidy(_verified(words, similarity)), "a string, b string")
    full = listed.where(F.col("n") > short).join(used, "id").select("key", "n", F.lower(F.hex("id")).alias("id"), "text")
    return links.unionByName(crowded_links(full, words, similarity, block))


def similar_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8, recall: float = 0.99, rows: int = 4, short: int = 8, block: int = 128) -> DataFrame:
    """(doc_id, component_id) of each row: whole texts whose sets of ``words``-word shingles have a Jaccard
    similarity of ``similarity`` or more are linked; component_id is the smallest doc_id that links reach,
    null if there is none. Candidates are all texts that SimHash ties together (see simhash.candidate_groups).
    As similar texts may differ in more than its three bits, bands of MinHash add what it leaves: a pair at the
    threshold meets there with probability ``recall``. Each candidate is checked exactly. Texts without words
    (null and empty ones too) are equal."""
    small_batches(docs.sparkSession)
    has_words = text_column().rlike(r"[^\x20\x09-\x0D]")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(has_words, F.substring(F.sha2(text_column(), 256), 1, 32)).otherwise("").alias("id"), text_column().alias("text"))
    places = staged(keyed.select("doc_id", "id"), "places")
    texts = keyed.where("id <> ''").select("id", "text")
    groups = simhash.candidate_groups(texts)
    parts = connected_components(similar_links(texts, words, similarity, recall, rows, short, block, repeated=True, groups=groups))
    known = places.join(parts, places["id"] == parts["node"], "left").select("doc_id", F.coalesce("component", "id").alias("part"))
    first = known.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    return known.join(first, "part").select("doc_id", "component_id")


def passage_units(texts: list[str], unit: int, run: int) -> dict[str, np.ndarray]:
    """Stretches of ``unit`` lower-cased words of whole texts, line ends ignored, chosen by winnowing: of any
    ``run - unit + 1`` next to each other the one with the least hash (the last of equals). So each run
    of ``run`` words holds a chosen stretch, the same wherever the run occurs and however it is wrapped.

    For each: ``text``, number of its first word in the text (``at``), line (``paragraph``) and number in it
    (``first_word``), the line of the last word (``last``), words of the first line (``width``), 64-bit hash (``unit``)."""
    import xxhash

    # One row for each line of the texts that are long enough: its text, its number, its words.
    w, of, number, width = [], [], [], []
    for k, t in enumerate(texts):
        lines = [x.split() for x in t.encode("utf-8", "surrogatepass").lower().split(b"\n")]
        if sum(map(len, lines)) >= run:
            of += [k] * len(lines)
            number += range(len(lines))
            for x in lines:
                width.append(len(x))
                w += x
    of, number, width = (np.array(x, np.int64) for x in (of, number, width))
    if not w:
        return dict.fromkeys(("text", "at", "paragraph", "first_word", "last", "width", "unit"), np.zeros(0, np.int64))
    ends = np.cumsum(width)
    texts_end = np.zeros(len(texts), np.int64)
    np.maximum.at(texts_end, of, ends)
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    n, span = len(h) - unit + 1, run - unit + 1
    grams = np.zeros(n, np.uint64)
    for k in range(unit):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    grams ^= grams >> np.uint64(29)
    # The low bits say which of equals comes last; places are told apart modulo 2**20.
    low = np.uint64((1 << 20) - 1)
    least, size = (grams & ~low) | (low - (np.arange(n, dtype=np.uint64) & low)), 1
    while size < span:
        step = min(size, span - size)
        least, size = np.minimum(least[:-step], least[step:]), size + step
    start = np.arange(len(least))
    chosen = start + ((low - (least & low)).astype(np.int64) - start) % (1 << 20)
    chosen = np.unique(chosen[start + run <= texts_end[of[np.searchsorted(ends, start, "right")]]])
    line, last = np.searchsorted(ends, chosen, "right"), np.searchsorted(ends, chosen + unit - 1, "right")
    text = of[line]
    words_before = np.zeros(len(texts), np.int64)
    words_before[of[::-1]] = (ends - width)[::-1]
    digest = np.array([xxhash.xxh64_intdigest(b" ".join(w[c : c + unit]), SEED) for c in chosen.tolist()], np.uint64).view(np.int64)
    return {"text": text, "at": chosen - words_before[text], "paragraph": number[line], "first_word": chosen - (ends - width)[line], "last": number[last], "width": width[line], "unit": digest}


def _several(doc: str = "doc_id"):
    """Whether the rows of a group are of several documents; rows without an id count as one."""
    ids = F.count(doc)
    return (F.coalesce(F.min(doc) < F.max(doc), F.lit(False)) | ((ids > 0) & (ids < F.count(F.lit(1))))).alias("across")


def repeated_passages(docs: DataFrame, gone: DataFrame, unit: int, run: int, long: int, often_from: int = 5_000) -> DataFrame:
    """(doc_id, paragraph, first_word, n_words, unit, cluster_size, across, removed): stretches of whole texts
    (doc_id, text) that repeat and touch no line in ``gone`` (doc_id, paragraph). One of the places at least
    is in a line of over ``long`` words or goes over a line end: other lines are compared whole. A stretch
    begins at ``first_word`` of its line and may go on in the lines after it. The first occurrence stays;
    one that overlaps it is left alone."""
    kinds = {"doc_id": pa.int64(), "paragraph": pa.int32(), "last": pa.int32(), "first_word": pa.int32(), "at": pa.int32(), "unit": pa.int64(), "long": pa.bool_()}

    def cut(batches):
        for batch in batches:
            u = passage_units(batch.column(1).to_pylist(), unit, run)
            u["long"] = (u["width"] > long) | (u["last"] > u["paragraph"])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(u["text"])), *(pa.array(u[k]).cast(kinds[k]) for k in list(kinds)[1:])], list(kinds))

    units = docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, paragraph int, last int, first_word int, at int, unit long, long boolean")
    units = staged(units, "units")
    out = gone.groupBy(F.col("doc_id").alias("gone_id")).agg(F.collect_set("paragraph").alias("gone"))
    touched = F.exists("gone", lambda g: (g >= F.col("paragraph")) & (g <= F.col("last")))
    units = units.join(out, F.col("doc_id").eqNullSafe(F.col("gone_id")), "left").where(F.col("gone").isNull() | ~touched).drop("gone", "gone_id", "last")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "at")
    first = units.groupBy("unit").agg(F.count(F.lit(1)).alias("cluster_size"), F.min(place).alias("first"), F.max("long").alias("some"), _several()).where("cluster_size > 1 and some").drop("some")
    same = F.col("first.doc_id").eqNullSafe(F.col("doc_id"))
    # Units with very many places are few, by the bound on their number, and are sent to the others' tasks.
    first = staged(first, "first")
    often = F.broadcast(first.where(F.col("cluster_size") > often_from))
    rest = units.join(often.select("unit"), "unit", "left_anti").join(first.where(F.col("cluster_size") <= often_from), "unit")
    found = units.join(often, "unit").unionByName(rest).withColumn("removed", ~(same & (F.abs(F.col("first.at") - F.col("at")) < unit)))
    found = found.where(F.col("removed") | (F.col("first.at") == F.col("at")))
    return found.select("doc_id", "paragraph", "first_word", F.lit(unit).alias("n_words"), "unit", "cluster_size", "across", "removed")


def repeated_paragraphs(docs: DataFrame, words: int = 5, similarity: float = 0.8, least_words: int = 20, recall: float = 0.999, rows: int = 4, short: int = 64, unit: int = 25, run: int = 50, long: int = 60, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, paragraph, cluster_id, cluster_size, across, removed, first_word, n_words): a row for each paragraph
    that repeats, and for each stretch of what stays; ``across`` if it is in several documents, else it only
    repeats inside one.

    A paragraph is a line of the text, numbered from 0; those of under ``least_words`` words are too
    short to be passages and are left alone. Paragraphs that are equal, or whose sets of ``words``-word
    shingles have a Jaccard similarity of ``similarity`` or more, are linked; a cluster is a component
    of such links, named by the paragraph digest that is least among its members. The first occurrence
    (smallest doc_id, then paragraph) stays, all others are removed. The number of bands is tuned so
    that a pair at the threshold meets with probability ``recall``.

    Whole texts are also compared by stretches of ``unit`` words, line ends ignored, so that each run of ``run``
    words that is shared or repeats, touches no removed line, and lies over a line end or in a line of over
    ``long`` words in one place at least, holds a stretch that is found (see passage_units). These rows
    have first_word (from 0) and n_words, and may go on in the next lines; whole lines have null there.

    Equal paragraphs are collapsed first, so copies make no pairs. Buckets of up to ``short`` distinct
    paragraphs give pairs that are verified with exact shingle sets; fuller buckets give links that tie
    the same together, verified the same way, in blocks (see crowded_links). Null texts are empty; rows with a null doc_id count last;
    repeated rows repeat their paragraphs; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    lines = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.posexplode(F.split(text_column(text_col), "\n")).alias("paragraph", "text"))
    blank, word = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
    if least_words > 0:
        lines = lines.where(F.col("text").rlike(f"^{blank}*+(?:{word}++{blank}++){{{least_words - 1}}}{word}"))
    keyed = lines.select("doc_id", "paragraph", F.substring(F.sha2("text", 256), 1, 32).alias("id"), "text")
    places = staged(keyed.select("doc_id", "paragraph", "id"), "places")
    distinct = staged(keyed.groupBy("id").agg(F.min("text").alias("text")), "paragraphs")
    free_shuffles(docs.sparkSession)

    parts = connected_components(similar_links(distinct, words, similarity, recall, rows, short))
    cluster = places.join(parts, places["id"] == parts["node"], "left").select("doc_id", "paragraph", F.coalesce("component", "id").alias("cluster_id"))
    first = cluster.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("cluster_size"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "paragraph")).alias("first"), _several()
    )
    stays = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.paragraph") == F.col("paragraph"))
    whole = staged(
        cluster.join(first.where("cluster_size > 1"), "cluster_id")
        .select("doc_id", F.col("paragraph").cast("int").alias("paragraph"), "cluster_id", "cluster_size", "across", (~stays).alias("removed")), "whole"
    )
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_column(text_col).alias("text"))
    part = repeated_passages(texts, whole.where("removed"), unit, run, long).withColumn("cluster_id", F.lower(F.hex("unit")))
    whole = whole.withColumns({"first_word": F.lit(None).cast("int"), "n_words": F.lit(None).cast("int")})
    return whole.unionByName(part.drop("unit"))


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _without_words(line: str, gone: set[int]) -> str:
    """``line`` without the words of the given numbers, and the blanks after them."""
    spans = [m.span() for m in WORD.finditer(line)]
    ends = [s for s, _ in spans[1:]] + [len(line)]
    return line[: spans[0][0]] + "".join(line[s:e] for k, ((s, _), e) in enumerate(zip(spans, ends, strict=True)) if k not in gone)


def _without_passages(texts: DataFrame, parts: DataFrame) -> DataFrame:
    """(doc_id, text) with the stretches of ``parts`` cut out; lines stay, if without words."""
    cuts = parts.groupBy(F.col("doc_id").alias("cut_id")).agg(F.collect_set(F.struct("paragraph", "first_word", "n_words")).alias("cuts"))

    @F.udf("string")
    def cut(text, cuts):
        lines = text.split("\n")
        n = [sum(1 for _ in WORD.finditer(t)) for t in lines]
        before = [0]
        for k in n:
            before.append(before[-1] + k)
        gone = {before[p] + i + k for p, i, many in cuts for k in range(many)}
        out = []
        for t, k, b in zip(lines, n, before, strict=False):
            own = {x for x in range(k) if b + x in gone}
            out.append(_without_words(t, own) if own else t)
        return "\n".join(out)

    whole = texts.join(cuts, F.col("doc_id").eqNullSafe(F.col("cut_id")), "left")
    return whole.select("doc_id", F.when(F.col("cuts").isNull(), F.col("text")).otherwise(cut(F.coalesce("text", F.lit("")), F.coalesce("cuts", F.array().cast("array<struct<paragraph:int,first_word:int,n_words:int>>")))).alias("text"))


def without_repeats(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """doc_id and text of ``docs`` without the removed paragraphs and stretches of ``repeated``."""
    docs = _without_passages(docs.select("doc_id", "text"), repeated.where("removed and first_word is not null"))
    gone = repeated.where("removed and first_word is null").groupBy(F.col("doc_id").alias("gone_id")).agg(F.collect_set("paragraph").alias("gone"))
    lines = F.split(text_column("text"), "\n")
    kept = F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~F.array_contains("gone", s["i"]))
    whole = docs.select("doc_id", "text").join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")), "left")
    return whole.select("doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda s: s["x"]), "\n")).alias("text"))
