"""Token ids in a byte-aligned binary format: frequency-ranked ids, control bytes apart from data bytes."""

from __future__ import annotations

import functools
import json
import re
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latchkey.llm.common import delete_folder, free_shuffles, new_folder, small_batches, staged, text_column, tidy

#: Pieces of words that a worker remembers the ids of; beyond that the half used last stays.
REMEMBERED = 400_000
#: Bytes of text whose distinct words are looked up together.
TOGETHER = 8 << 20
#: Ids in a block of the file format.
BLOCK = 1 << 20


#: Letters that are neither changed by NFC nor lower-cased by their context.
SIMPLE = re.compile(r"[\x21-\x7e\u00bf-\u00ff]+")
#: The pre-tokenizer's pattern, and the same for simple characters in lower case.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
#: How byte-level models write bytes: as printable characters, others from 256 on.
_PRINTED = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
WRITTEN = {b: chr(b) if b in _PRINTED else chr(256 + sum(x not in _PRINTED for x in range(b))) for b in range(256)}


class WordEncoder:
    """Encodes texts with a tokenizers file, each distinct word of a batch once and each piece when it is new.

    The tokenizer drops white space and never joins what white space parts, so the ids of a text are
    those of its words in turn. A word of simple characters goes
    to the library's model piece by piece, the pieces cut as the file's pre-tokenizer says; any other
    word goes to the library whole. Tests compare both with the library on whole texts; a file with
    another normalizer or pre-tokenizer than these pieces fit has all words encoded whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.known, self.older = self.tokenizer.model, {}, {}
        self.width = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        with open(path) as f:
            head = json.load(f)
        split = [x.get("pattern", {}).get("Regex") for x in (head.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        steps = [x["type"] for x in (head.get("normalizer") or {}).get("normalizers", [])]
        self.piecewise = split == [PATTERN, None] and steps == ["NFC", "Replace", "Lowercase"]

    def _packed(self, ids: list[int]) -> bytes:
        out = array("H" if self.width == "<u2" else "I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _remembered(self, part: str, make) -> bytes:
        ids = self.known.get(part)
        if ids is None:
            ids = self.older.get(part)
            ids = self.known[part] = make(part) if ids is None else ids
        return ids

    def _whole(self, word: str) -> bytes:
        return self._packed(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def _made(self, piece: str) -> bytes:
        written = piece if piece.isascii() else "".join(map(WRITTEN.__getitem__, piece.encode()))
        return self._packed([t.id for t in self.model.tokenize(written)])

    def _piece(self, piece: str) -> bytes:
        """A piece in lower case, which as a word of its own has the same ids."""
        return self.known.get(piece) or self._remembered(piece, self._made)

    def _word(self, word: str) -> bytes:
        # Most words are letters alone, or letters and one sign.
        if self.piecewise and word.isascii():
            low = word.lower()
            if low.isalpha():
                return self._piece(low)
            if low[:-1].isalpha() and SIMPLE.fullmatch(low[-1]):
                return self._piece(low[:-1]) + self._piece(low[-1])
        if not self.piecewise or "<|" in word or not SIMPLE.fullmatch(word):
            return self._remembered(word, self._whole)
        low = word.lower()
        pieces = PIECE.findall(low)
        return self._piece(low) if len(pieces) == 1 else b"".join(map(self._piece, pieces))

    def batch(self, texts: pa.Array, tail: bytes = b"") -> pa.Array:
        """Of each text the little-endian ids, of two bytes each if the vocabulary allows it, else of four,
        with ``tail`` behind them."""
        if len(self.known) > REMEMBERED // 2:
            self.older, self.known = self.known, {}
        # White space beyond ASCII stays inside words, which go to the library whole.
        lists = pc.ascii_split_whitespace(texts)
        words, ends = lists.flatten().dictionary_encode(), np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)
        ids = [self._word(w) if w else b"" for w in words.dictionary.to_numpy(zero_copy_only=False).tolist()]
        places = np.insert(words.indices.to_numpy(zero_copy_only=False), ends, len(ids))
        del lists, words
        flat = pa.array([*ids, tail], pa.large_binary()).take(pa.array(places))
        # A text's ids are those of its words and the tail next to each other.
        last = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)])
        at = np.frombuffer(flat.buffers()[1], np.int64)[last] if len(flat) else np.zeros(1, np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(at), flat.buffers()[2]]).cast(pa.binary())

    def __call__(self, text: str) -> bytes:
        return self.batch(pa.array([text], pa.string()))[0].as_py()


@functools.lru_cache(maxsize=1)
def worker_encoder(path: str) -> WordEncoder:
    """The encoder that the tasks of a worker share, with the pieces that it remembers."""
    return WordEncoder(path)


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2) -> DataFrame:
    """(doc_id, ids, width): little-endian ids of ``width`` bytes each, with the end id last."""

    def run(batches):
        encoder = worker_encoder(path)
        tail, width = b"" if end_id is None else np.asarray([end_id], dtype=encoder.width).tobytes(), int(encoder.width[2])

        def encoded(held):
            # What the batch before has left is as much as this one needs.
            pa.default_memory_pool().release_unused()
            ids = encoder.batch(pa.concat_arrays([b.column(1) for b in held]), tail)
            docs = pa.concat_arrays([b.column(0) for b in held])
            return pa.RecordBatch.from_arrays([docs, ids, pa.array(np.full(len(ids), width, np.int32))], ["doc_id", "ids", "width"])

        held = []
        for batch in batches:
            if held and sum(b.nbytes for b in held) + batch.nbytes > TOGETHER:
                yield encoded(held)
                held = []
            held.append(batch)
        if held:
            yield encoded(held)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_column(text_col).alias("text"))
    return picked.mapInArrow(tidy(run), "doc_id long, ids binary, width int")


def id_counts(encoded: DataFrame, most: int = 1 << 22) -> np.ndarray:
    """How often each id occurs. Each task sums its ids; the driver gets one count for each id of the
    vocabulary, whatever the number of documents."""

    def run(batches):
        counts = np.zeros(0, np.int64)
        for batch in batches:
            texts, widths = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), np.int64)
            # All documents of a batch at once, as each count is as long as the vocabulary.
            for width in np.unique(widths).tolist():
                ids = b"".join(texts[k] for k in np.flatnonzero(widths == width).tolist())
                add = np.bincount(np.frombuffer(ids, f"<u{width}")) if ids else counts[:0]
                if len(add) > most:
                    raise ValueError("an id is beyond the largest vocabulary")
                if len(add) > len(counts):
                    add[: len(counts)] += counts
                    counts = add
                else:
                    counts[: len(add)] += add
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int64)), pa.array(counts[there])], ["id", "n"])

    rows = encoded.select("ids", "width").mapInArrow(tidy(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(1 + max((r.id for r in rows), default=-1), np.int64)
    for r in rows:
        counts[r.id] = r.n
    return counts


def by_frequency(counts: np.ndarray) -> np.ndarray:
    """Ids from the most to the least frequent, ties by id: the table that turns ranks into ids."""
    return np.lexsort((np.arange(len(counts)), -counts)).astype(np.uint32)


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data): two control bits for each number tell its bytes less one, four to a control byte."""
    r = np.ascontiguousarray(ranks, dtype="<u4")
    extra = ((r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)).astype(np.uint8)
    codes = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    codes[: len(r)] = extra
    four = codes.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    keep = np.arange(4, dtype=np.uint8)[None, :] <= extra[:, None]
    return control.astype(np.uint8).tobytes(), r.view(np.uint8).reshape(-1, 4)[keep].tobytes()


#: Bytes of each of the four numbers that a control byte speaks of.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def unpack(control: bytes, data: bytes, n: int, table: np.ndarray) -> np.ndarray:
    """The ids of a block: lengths by table lookup of control bytes, ids by table lookup of ranks."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n].astype(np.int64)
    start, raw = np.cumsum(size) - size, np.frombuffer(data + b"\0\0\0", np.uint8)
    ranks = raw[start].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(size > k)
        ranks[longer] |= raw[start[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return table[ranks]


SHARD = "shard int, block int, doc_ids binary, sizes binary, control binary, data binary"


def write_shards(encoded: DataFrame, table: np.ndarray, to: str, partitions: int) -> None:
    """Writes the file format to a folder: shards in ascending order of doc_id, each of blocks in
    order. A block has its documents' ids and sizes (as int64) and the packed ranks. The table of
    ids by rank lies beside them. Documents with the same id keep together, in order of their ids' bytes."""
    spark = encoded.sparkSession
    rank = np.zeros(len(table), np.uint32)
    rank[table] = np.arange(len(table), dtype=np.uint32)

    def run(batches):
        from pyspark import TaskContext

        shard, block, docs, parts, held = TaskContext.get().partitionId(), 0, [], [], 0

        def row():
            ids = rank[np.concatenate(parts)] if held else np.zeros(0, np.uint32)
            values = [shard, block, np.asarray(docs, "<i8").tobytes(), np.asarray([len(p) for p in parts], "<i8").tobytes(), *pack(ids)]
            return pa.RecordBatch.from_pylist([dict(zip(("shard", "block", "doc_ids", "sizes", "control", "data"), values, strict=True))], schema=schema)

        schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), *((k, pa.binary()) for k in ("doc_ids", "sizes", "control", "data"))])
        for batch in batches:
            for i in range(batch.num_rows):
                docs.append(-(1 << 63) if (d := batch.column(0)[i].as_py()) is None else d)
                parts.append(np.frombuffer(batch.column(1)[i].as_py(), f"<u{batch.column(2)[i].as_py()}"))
                held += len(parts[-1])
                if held >= BLOCK or len(docs) >= 10_000:
                    yield row()
                    block, docs, parts, held = block + 1, [], [], 0
        if docs:
            yield row()

    ordered = encoded.repartitionByRange(partitions, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    ordered.mapInArrow(tidy(run), SHARD).write.parquet(f"{to}/shards", compression="none")
    spark.createDataFrame(pa.table({"ids": pa.array([table.astype("<u4").tobytes()], pa.binary())})).coalesce(1).write.parquet(f"{to}/table")


def read_shards(spark, at: str) -> DataFrame:
    """(shard, block, place, doc_id, ids): what write_shards wrote, ids as little-endian unsigned 32-bit integers."""
    return _read(spark, at, {"ids": (pa.binary(), lambda ids: ids.tobytes())})


def _read(spark, at: str, columns: dict) -> DataFrame:
    """(shard, block, place, doc_id) of each document at ``at``, and what ``columns`` make of its ids: by name
    an Arrow type and a function. One Python function does it all, so that a task needs one worker."""
    table = np.frombuffer(spark.read.parquet(f"{at}/table").head().ids, "<u4")
    kinds = {"shard": pa.int32(), "block": pa.int32(), "place": pa.int32(), "doc_id": pa.int64(), **{k: t for k, (t, _) in columns.items()}}
    names = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                sizes, docs = np.frombuffer(r["sizes"], "<i8"), np.frombuffer(r["doc_ids"], "<i8")
                ids = unpack(r["control"], r["data"], int(sizes.sum()), table).astype("<u4")
                ends, n = np.cumsum(sizes), len(docs)
                made = {k: [f(ids[e - s : e]) for s, e in zip(sizes, ends, strict=True)] for k, (_, f) in columns.items()}
                known = {"shard": [r["shard"]] * n, "block": [r["block"]] * n, "place": range(n), "doc_id": [None if d == -(1 << 63) else int(d) for d in docs]}
                yield pa.RecordBatch.from_arrays([pa.array(x, kinds[k]) for k, x in (known | made).items()], list(kinds))

    return spark.read.parquet(f"{at}/shards").mapInArrow(tidy(run), ", ".join(f"{k} {names[t]}" for k, t in kinds.items()))


def token_digest(spark, at: str) -> DataFrame:
    """Per document of the files at ``at``: doc_id, start, n_tokens, ids_crc32.

    Starts inside a block come with the block; the blocks' own starts are sums over one small row for
    each block (of some million ids), so no task orders documents of the whole corpus."""
    docs = staged(_read(spark, at, {"n_tokens": (pa.int64(), len), "ids_crc32": (pa.int64(), zlib.crc32)}), "digests")
    blocks = docs.groupBy("shard", "block").agg(F.sum("n_tokens").alias("n"))
    shards = blocks.groupBy("shard").agg(F.sum("n").alias("n"))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(before().orderBy("shard")), F.lit(0)).alias("of_shard"))
    blocks = blocks.select("shard", "block", F.coalesce(F.sum("n").over(before("shard").orderBy("block")), F.lit(0)).alias("of_block"))
    inside = F.coalesce(F.sum("n_tokens").over(before("shard", "block").orderBy("place")), F.lit(0))
    return (
        docs.withColumn("inside", inside)
        .join(blocks, ["shard", "block"])
        .join(shards, "shard")
        .select("doc_id", (F.col("of_shard") + F.col("of_block") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
    )


def tokenize(docs: DataFrame, path: str, end_id: int | None = 2, to: str | None = None, shard_mb: int = 16) -> DataFrame:
    """Encodes ``docs`` (doc_id, text), writes the binary format to ``to`` (a new folder by default),
    reads it back and returns doc_id, start, n_tokens, ids_crc32 of each document.

    Null texts are empty and have the end id alone; rows with one doc_id each have their own ids; a
    null doc_id comes first. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    to = to or new_folder(spark, "tokens")
    raw = new_folder(spark, "ids")
    encode_texts(docs, path, end_id=end_id).write.parquet(raw, compression="zstd")
    encoded = spark.read.schema("doc_id long, ids binary, width int").parquet(raw)
    counts = id_counts(encoded)
    partitions = max(1, int(counts.sum() * 2 >> 20) // shard_mb + 1, spark.sparkContext.defaultParallelism)
    write_shards(encoded, by_frequency(counts), to, partitions)
    delete_folder(spark, raw)
    free_shuffles(spark)
    return token_digest(spark, to)
