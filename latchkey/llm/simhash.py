"""Near-duplicates by SimHash: 64-bit fingerprints, linked through an inverted index of their bytes."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latchkey.llm.common import connected_components, join_hot, small_batches, staged, text_column, tidy

SEED = 42
#: Words that are hashed at once, for texts of any length.
SLICE = 1 << 20
#: Sets of four byte positions such that any five of eight positions hold one of them whole.
BLOCKS = [c for c in combinations(range(8), 4) if c[0] ^ c[1] ^ c[2] ^ c[3] == 0]


def fingerprint(text: str, words: int = 3) -> int:
    """SimHash of a text's word shingles, as a signed 64-bit number; 0 without words."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    ones, n = np.zeros(64, np.int64), 0
    for i in range(0, max(1, len(w) - words + 1), SLICE):
        part = w[i : i + SLICE + words - 1]
        shingles = [b" ".join(part)] if len(w) < words else map(b" ".join, zip(*(part[k:] for k in range(words)), strict=False))
        h = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
        n += len(h)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text", id_type: str = "long") -> DataFrame:
    """(doc_id, fp) of every row over its whole text; a null text is empty."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                fps = pa.array([fingerprint(t, words) for t in part.column(1).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), fps], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast(id_type).alias("doc_id"), text_column(text_col).alias("text")).mapInArrow(tidy(run), f"doc_id {id_type}, fp long")


def _byte(fp, i: int):
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255))


def _forest(distance: int):
    """Links that tie together what is within ``distance`` bits in one posting list: as many as the
    list is long at most, found block by block."""

    def run(table: pa.Table) -> pa.Table:
        f = np.unique(table.column("fp").to_numpy().astype(np.int64)).view(np.uint64)
        label, a, b = np.arange(len(f)), [], []
        for i in range(0, len(f), 256):
            near = np.bitwise_count(f[i : i + 256, None] ^ f[None, :]) <= distance
            for k, row in enumerate(near):
                own = label[i + k]
                for other in np.unique(label[row]):
                    if other != own:
                        a.append(f[i + k])
                        b.append(f[np.flatnonzero(row & (label == other))[0]])
                        label[label == other] = own
        as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        return pa.table({"a": as_long(a), "b": as_long(b)})

    return run


def _masked(distance: int):
    """For posting lists of any length: a row for each choice of ``distance`` of the bits outside the
    shared bytes, with those bits cleared. Two members are near exactly if they share such a row."""

    def run(batches):
        for batch in batches:
            keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for key, f in zip(keys, fps, strict=True):
                free = [8 * i + j for i in range(8) if i not in BLOCKS[key >> 32] for j in range(8)]
                masks = np.array([sum(1 << x for x in c) for c in combinations(free, distance)], np.uint64)
                left = (f & ~masks).view(np.int64)
                arrays = [pa.array(np.full(len(masks), key)), pa.array(masks.view(np.int64)), pa.array(left), pa.array(np.full(len(masks), f).view(np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, ["key", "mask", "left", "fp"])

    return run


def near_links(prints: DataFrame, distance: int = 3, short: int = 256, long: int = 16_384) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that are within ``distance`` <= 3 bits.
    Their components are those of all such links.

    Three differing bits touch three bytes at most, so near fingerprints agree in five of their eight
    positional bytes. An inverted index lists fingerprints by the bytes at four positions; the 14 sets
    of positions are such that any five agreeing positions hold one set whole, so every near pair meets
    in a list, and lists stay short (32 bits each). For the pairs of a list the agreeing positional
    bytes are tallied, pairs with five or more are retained, and their bits compared. Lists of over
    ``short`` members give a spanning forest instead of pairs, in blocks inside one task; lists of over
    ``long`` members are linked by shared masked values, with rows in proportion to their length.
    """
    if not 0 <= distance <= 3:
        raise ValueError("the position sets hold links of three bits at most")
    fp = F.col("fp")
    keys = [F.lit(n << 32).bitwiseOR(sum((F.shiftleft(_byte(fp, i), 8 * k) for k, i in enumerate(b)), F.lit(0).cast("long"))) for n, b in enumerate(BLOCKS)]
    index = prints.select("fp", F.explode(F.array(*keys)).alias("key"))
    several = index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    lists = staged(index.join(several, "key"), "postings")
    one = lists.where(F.col("n") <= short)
    other = one.select("key", F.col("fp").alias("b"))
    tally = sum((F.when(_byte(F.col("a"), i) == _byte(F.col("b"), i), 1).otherwise(0) for i in range(8)), F.lit(0))
    pairs = (
        one.select("key", F.col("fp").alias("a"))
        .join(other, "key")
        .where("a < b")
        .where(tally >= 8 - distance)
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
        .select("a", "b")
    )
    forest = lists.where((F.col("n") > short) & (F.col("n") <= long)).select("key", "fp").groupBy("key").applyInArrow(_forest(distance), "a long, b long")
    same = Window.partitionBy("key", "mask", "left")
    masked = lists.where(F.col("n") > long).select("key", "fp").mapInArrow(_masked(distance), "key long, mask long, left long, fp long")
    masked = masked.select(F.col("fp").alias("a"), F.min("fp").over(same).alias("b")).where("a <> b")
    return pairs.unionByName(forest).unionByName(masked).distinct()


def components_of(prints: DataFrame, distance: int = 3, short: int = 256, long: int = 16_384) -> DataFrame:
    """Adds component_id to (doc_id, fp): the smallest doc_id that links of at most ``distance`` bits reach."""
    nodes = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    parts = connected_components(near_links(nodes.select("fp"), distance, short, long)).withColumnRenamed("node", "fp")
    linked = parts.join(nodes, "fp")
    least = linked.groupBy("component").agg(F.min("first").alias("least"))
    linked = linked.join(least, "component").select("fp", "least", F.lit(True).alias("linked"))
    known = nodes.join(linked, "fp", "left").select("fp", F.when(F.col("linked"), F.col("least")).otherwise(F.col("first")).alias("component_id"))
    return join_hot(prints, staged(known, "components"), "fp").select("doc_id", "fp", "component_id")


def candidate_groups(texts: DataFrame, words: int = 3, distance: int = 3, short: int = 256, long: int = 16_384) -> DataFrame:
    """(id, key) of each distinct id of ``texts`` (id, text): texts have one key exactly if links of at most
    ``distance`` differing bits of their fingerprints tie them together."""
    prints = staged(fingerprints(texts, words, "id", "text", "string").distinct(), "fingerprints")
    parts = connected_components(near_links(prints.select("fp").distinct(), distance, short, long)).withColumnRenamed("node", "fp")
    return prints.join(parts, "fp", "left").select(F.col("doc_id").alias("id"), F.coalesce("component", "fp").alias("key"))


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 3, short: int = 256, long: int = 16_384) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that links of at most ``distance`` differing bits reach. Rows
    with equal fingerprints are one node, so copies make no pairs. Components run over fingerprints, so rows
    with a null doc_id link others and get the component's smallest doc_id, null if there is none. Texts
    without words (null and empty ones too) have fingerprint 0. Repeated rows come back repeated; an empty
    table gives an empty result.
    """
    small_batches(docs.sparkSession)
    prints = staged(fingerprints(docs, words), "fingerprints")
    return components_of(prints, distance, short, long).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
