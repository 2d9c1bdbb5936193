"""Sparse and dense search, fusion and reranking, for whole tables of queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from latchkey.functions import policy as P
from latchkey.functions import text as T
from latchkey.sources.scratch import staged

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Chunks of a block of postings, strongest terms by which blocks are probed, blocks probed, slack of bounds.
BLOCK, LEADS, PROBES, SLACK = 128, 3, 8, 1e-5


def postings(chunks: DataFrame) -> DataFrame:
    """(term, chunk_id, doc_id, dl, tf); a chunk without tokens has one, ``__empty__``. Tokens are sorted and counted
    inside their row: no shuffle, and a chunk's postings stay next to each other."""
    tokens = T.tokenize(F.col("text"))
    tokens = F.when(F.size(tokens) > 0, tokens).otherwise(F.array(F.lit("__empty__")))
    # An array of one is exploded so that what it holds is made once, and not again for each element that looks at it.
    once = lambda c: F.explode(F.array(c))
    t = chunks.select("chunk_id", "doc_id", once(F.sort_array(tokens)).alias("s"))
    last = F.filter(F.sequence(F.lit(1), F.size("s")), lambda i: (i == F.size("s")) | (F.get("s", i - 1) != F.get("s", i)))
    t = t.select("chunk_id", "doc_id", "s", once(last).alias("last")).select("chunk_id", "doc_id", F.size("s").alias("dl"), "s", "last", F.posexplode("last").alias("place", "end"))
    tf = F.col("end") - F.coalesce(F.get("last", F.col("place") - 1), F.lit(0))
    return t.select(F.get("s", F.col("end") - 1).alias("term"), "chunk_id", "doc_id", "dl", tf.cast("long").alias("tf"))


def corpus_size(postings: DataFrame) -> DataFrame:
    """One row: n chunks, and their mean length."""
    per = postings.groupBy("chunk_id").agg(F.first("dl").alias("dl"))
    return per.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def bm25_idf(postings: DataFrame, counted: DataFrame | None = None, size: DataFrame | None = None) -> DataFrame:
    """(term, df, idf) over the whole corpus; a negative idf becomes a quarter of the mean idf. ``counted`` (term, df) and
    ``size`` are counted from ``postings`` where they aren't given."""
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")) if counted is None else counted.select("term", "df")
    df = df.crossJoin(F.broadcast(corpus_size(postings) if size is None else size))
    raw = df.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    low = raw.agg((EPSILON * F.avg("raw")).alias("low"))
    return raw.crossJoin(F.broadcast(low)).select("term", "df", F.when(F.col("raw") < 0, F.col("low")).otherwise(F.col("raw")).alias("idf"))


def query_terms(queries: DataFrame, by: tuple[str, ...] = ("query_id", "user_id"), text: str = "query") -> DataFrame:
    """(*by, term, qtf)."""
    return queries.select(*by, F.explode(T.tokenize(F.col(text))).alias("term")).groupBy(*by, "term").agg(F.count(F.lit(1)).alias("qtf"))


def top(scored: DataFrame, k: int, by: tuple[str, ...], score: str = "score") -> DataFrame:
    """The best ``k`` per key, ranked from 1; equals by chunk_id."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def bm25_parts(postings: DataFrame, idf: DataFrame, size: DataFrame) -> DataFrame:
    """(term, chunk_id, doc_id, part): what a term that is asked once adds to a chunk's BM25."""
    hit = postings.join(idf, "term").crossJoin(F.broadcast(size))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hit.select("term", "chunk_id", "doc_id", part.alias("part"))


def impact_blocks(parts: DataFrame, doc_sets: DataFrame, size: DataFrame, block: int = BLOCK) -> DataFrame:
    """(term, block, top, entries): postings (term, chunk_id, doc_id, part) in blocks, with each block's largest part.

    Chunks are dealt out to blocks of about ``block`` by a hash of their id, the same for all terms. So a
    frequent term is spread over many keys, and all that a chunk scores is found in one block. Entries carry
    the number of their document's set of roles (null: no roles)."""
    p = parts.join(doc_sets, "doc_id", "left").crossJoin(F.broadcast(size.select("n")))
    p = p.withColumn("block", F.pmod(F.xxhash64("chunk_id"), F.ceil(F.greatest(F.col("n"), F.lit(1)) / block)))
    return p.groupBy("term", "block").agg(F.max("part").alias("top"), F.collect_list(F.struct("chunk_id", "doc_id", "doc_set", "part")).alias("entries"))


def term_tops(blocks: DataFrame) -> DataFrame:
    """(term, most): the largest part of each term."""
    return blocks.groupBy("term").agg(F.max("top").alias("most"))


def _bounded(terms: DataFrame, tops: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Terms with the most that they, and all that can add less, can add to a score (``upto``), and their
    place from the one that can add most (``lead``)."""
    t = terms.join(tops, "term").withColumn("bound", F.greatest(F.col("w") * F.col("most"), F.lit(0.0)))
    q = Window.partitionBy(*by)
    up = q.orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return t.withColumns({"upto": F.sum("bound").over(up), "lead": F.row_number().over(q.orderBy(F.col("bound").desc(), F.col("term").desc()))})


def _scored(pairs: DataFrame, terms: DataFrame, blocks: DataFrame, reach: DataFrame, by: tuple[str, ...], positive: bool) -> DataFrame:
    """(*by, chunk_id, doc_id, score) of all readable chunks in the blocks ``pairs`` (*by, block)."""
    asked = pairs.select(*by, "block").join(terms.select(*by, "user_set", "term", "w"), list(by))
    hit = asked.join(blocks.select("term", "block", "entries"), ["term", "block"]).select(*by, "user_set", "w", F.explode("entries").alias("e")).select(*by, "user_set", "w", "e.*")
    hit = hit.join(reach, ["user_set", "doc_set"], "left_semi")
    scored = hit.groupBy(*by, "chunk_id", "doc_id").agg(F.round(F.sum(F.col("w") * F.col("part")), 6).alias("score"))
    return scored.where("score > 0") if positive else scored


def wanted_blocks(terms: DataFrame, blocks: DataFrame, tops: DataFrame, reach: DataFrame, k: int, by: tuple[str, ...], positive: bool = False, leads: int = LEADS, probes: int = PROBES) -> DataFrame:
    """(*by, block): the blocks that may hold one of the best ``k`` chunks that the user may read.

    The ``probes`` blocks that promise most by a query's ``leads`` strongest terms are scored first; the
    ``k``-th score there is a threshold. Terms that even together stay below it need not be looked up: a chunk with
    no other term can't be among the best. Of the other terms' blocks those stay whose bound reaches it. Only the
    heads of blocks are looked at here, but for those probed."""
    heads = blocks.select("term", "block", "top")
    t = _bounded(terms, tops, by)
    gain = F.sum(F.greatest(F.col("w") * F.col("top"), F.lit(0.0))).alias("gain")
    promise = t.where(F.col("lead") <= leads).join(heads, "term").groupBy(*by, "block").agg(gain)
    best = promise.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("gain").desc(), "block"))).where(F.col("place") <= probes)
    seen = top(_scored(best, terms, blocks, reach, by, positive), k, by)
    least = seen.groupBy(*by).agg(F.count(F.lit(1)).alias("found"), F.min("score").alias("least")).where(F.col("found") == k).drop("found")
    # Scores are rounded to six places; the slack is above that.
    weak = F.coalesce(F.col("upto") < F.col("least") - SLACK, F.lit(False))
    t = t.join(least, list(by), "left").withColumn("weak", weak)
    t = t.withColumn("loose", F.coalesce(F.max(F.when(F.col("weak"), F.col("upto"))).over(Window.partitionBy(*by)), F.lit(0.0)))
    bounds = t.where(~F.col("weak")).join(heads, "term").groupBy(*by, "block", "least", "loose").agg(gain)
    return bounds.where(F.col("least").isNull() | (F.col("gain") + F.col("loose") >= F.col("least") - SLACK)).select(*by, "block")


def block_topk(terms: DataFrame, blocks: DataFrame, tops: DataFrame, reach: DataFrame, k: int, by: tuple[str, ...], positive: bool = False) -> DataFrame:
    """(*by, chunk_id, doc_id, score, rank): the best ``k`` chunks that the user may read, by sums of w * part.

    ``terms`` is (*by, user_set, term, w) with w >= 0. Access is a semi-join of numbers of role sets, below the top-k,
    which would otherwise be cut before it; no pair of user and document is made. See wanted_blocks."""
    # A few rows for each query, which are used several times.
    terms = staged(terms.select(*by, "user_set", "term", "w"), "asked-terms")
    # Blocks of other terms are left behind in the scan.
    blocks = blocks.join(terms.select("term").distinct(), "term", "left_semi")
    wanted = wanted_blocks(terms, blocks, tops, reach, k, by, positive)
    return top(_scored(wanted, terms, blocks, reach, by, positive), k, by)


def tfidf(postings: DataFrame, min_df: int = 1) -> DataFrame:
    """(term, chunk_id, doc_id, weight) with unit length per chunk, in sparse long form."""
    n = corpus_size(postings).select("n")
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
    raw = postings.join(df, "term").crossJoin(F.broadcast(n)).withColumn("w", (1 + F.log("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("chunk_id")))
    return raw.select("term", "chunk_id", "doc_id", (F.col("w") / F.greatest(length, F.lit(1e-9))).alias("weight"))


def term_idf(postings: DataFrame, size: DataFrame | None = None) -> DataFrame:
    """(term, df, idf): ln((1 + N) / (1 + df)) + 1; ``size`` is counted from ``postings`` where it isn't given."""
    n = (corpus_size(postings) if size is None else size).select("n")
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def query_weights(terms: DataFrame, idf: DataFrame, by: tuple[str, ...] = ("query_id", "user_id")) -> DataFrame:
    """``terms`` (*by, term, qtf, ...) of the corpus with w, their place in the query's unit vector."""
    q = terms.join(idf.select("term", "idf"), "term").withColumn("raw", (1 + F.log("qtf")) * F.col("idf"))
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(*by)))
    return q.withColumn("w", F.col("raw") / F.greatest(length, F.lit(1e-9))).drop("raw", "idf")


def cosines(terms: DataFrame, vectors: DataFrame, idf: DataFrame, by: tuple[str, ...] = ("query_id", "user_id")) -> DataFrame:
    """(*by, chunk_id, doc_id, score): cosine of unit vectors in sparse form with all chunks that share a term."""
    hit = query_weights(terms, idf, by).select(*by, "term", "w").join(vectors, "term")
    return hit.groupBy(*by, "chunk_id", "doc_id").agg(F.round(F.sum(F.col("w") * F.col("weight")), 6).alias("score"))


def chunk_lengths(postings: DataFrame, idf: DataFrame, often: int = 100_000) -> DataFrame:
    """(chunk_id, doc_id, dl, norm): every chunk with the length of its vector of tf-idf weights.

    Terms with over an ``often``-th of all postings, of which there are fewer than ``often``, go by broadcast, so their
    postings are summed where they lie; the others, with few postings each, are joined by term."""
    total = idf.agg(F.sum("df").alias("total"))
    t = idf.crossJoin(F.broadcast(total)).select("term", "idf", (F.col("df") * often > F.col("total")).alias("often"))
    many = F.broadcast(t.where("often").select("term", "idf"))
    square = ((1 + F.log("tf")) * F.col("idf")).alias("w")
    p = postings.select("term", "chunk_id", "doc_id", "dl", "tf")
    rest = p.join(many.select("term"), "term", "left_anti").join(t.where("not often"), "term")
    cols = ("chunk_id", "doc_id", "dl", square)
    w = p.join(many, "term").select(*cols).unionByName(rest.select(*cols))
    return w.groupBy("chunk_id", "doc_id", "dl").agg(F.greatest(F.sqrt(F.sum(F.col("w") * F.col("w"))), F.lit(1e-9)).alias("norm"))


def asked_chunks(postings: DataFrame, terms: DataFrame, lengths: DataFrame, doc_sets: DataFrame, idf: DataFrame, term_idf: DataFrame, size: DataFrame) -> DataFrame:
    """(chunk_id, doc_id, doc_set, entries): chunks that someone can read and that have one of ``terms`` (term); an entry is
    a term with what it adds to the chunk's BM25 (``sparse``) and its weight in the chunk's unit vector (``dense``).
    Postings of other terms are left behind in the scan."""
    asked = staged(terms.distinct().join(idf.select("term", "idf"), "term").join(term_idf.select("term", F.col("idf").alias("rarity")), "term"), "asked-idf")
    there = lengths.join(doc_sets, "doc_id").crossJoin(F.broadcast(size.select("avgdl")))
    hit = postings.select("term", "chunk_id", "tf").join(asked, "term").join(there, "chunk_id")
    sparse = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    dense = (1 + F.log("tf")) * F.col("rarity") / F.col("norm")
    return hit.groupBy("chunk_id", "doc_id", "doc_set").agg(F.collect_list(F.struct("term", sparse.alias("sparse"), dense.alias("dense"))).alias("entries"))


def dealt(chunks: DataFrame, n: int, each: int = 4_000) -> DataFrame:
    """``chunks`` dealt out by chunk_id, about ``each`` of ``n`` to a part, so that what is summed or told apart by chunk
    later stays where it is."""
    return chunks.repartition(max(8, n // each + 1), "chunk_id")


def _asks(terms: DataFrame, reach: DataFrame | None, by: tuple[str, ...]) -> DataFrame:
    """(*by, terms, doc_sets): a row for each sub-query, with what its user may read, null for everything."""
    rows = terms.groupBy(*by, "user_set").agg(F.collect_list(F.struct("term", "qtf", "w")).alias("terms"))
    if reach is None:
        return rows.withColumn("doc_sets", F.lit(None).cast("array<long>"))
    return rows.join(reach.groupBy("user_set").agg(F.collect_list("doc_set").alias("doc_sets")), "user_set")


def _scores(by: tuple[str, ...], schema: pa.Schema, many: int = 512):
    """Scores of pairs of a part of the chunks and a block of sub-queries, as products of matrices for ``many`` chunks at a
    time; pairs that share no term, that may not be read or are below both bounds of the sub-query are left behind."""

    def flat(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
        """The row of each element of a column of lists, and the elements."""
        lists = column.combine_chunks()
        lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks)
        return np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)), lists.flatten()

    def run(chunks: pa.Table, asks: pa.Table) -> pa.Table:
        if not chunks.num_rows or not asks.num_rows:
            return schema.empty_table()
        number = lambda x, c: x.field(c).to_numpy(zero_copy_only=False).astype(np.float64)
        ask, t = flat(asks.column("terms"))
        words = t.field("term").unique()
        at = pc.index_in(t.field("term"), words).to_numpy(zero_copy_only=False)
        qtf, w, asked = (np.zeros((len(words), asks.num_rows)) for _ in range(3))
        np.add.at(qtf, (at, ask), number(t, "qtf"))
        np.add.at(w, (at, ask), number(t, "w"))
        asked[at, ask] = 1
        sets, of = np.unique(chunks.column("doc_set").to_numpy(), return_inverse=True)
        may = np.stack([np.full(len(sets), True) if x is None else np.isin(sets, x) for x in asks.column("doc_sets").to_pylist()], axis=1)
        least = [asks.column(c).to_pandas().to_numpy(np.float64, na_value=-np.inf) for c in ("least_s", "least_d")]
        row, e = flat(chunks.column("entries"))
        place = pc.fill_null(pc.index_in(e.field("term"), words), -1).to_numpy(zero_copy_only=False)
        there = place >= 0
        row, place, sparse, dense = row[there], place[there], number(e, "sparse")[there], number(e, "dense")[there]
        found = []
        for i in range(0, chunks.num_rows, many):
            n = min(many, chunks.num_rows - i)
            here = slice(*np.searchsorted(row, (i, i + n)))
            # Terms that none of these chunks has aren't multiplied.
            used, col = np.unique(place[here], return_inverse=True)
            spread = lambda x, m: np.bincount((row[here] - i) * len(used) + col, x, n * len(used)).reshape(n, len(used)) @ m[used]
            s, d = spread(sparse[here], qtf), spread(dense[here], w)
            meet = d != 0 if (dense[here] > 0).all() and (w[at, ask] > 0).all() else spread(np.ones(len(col)), asked) > 0
            a, q = np.nonzero(meet & may[of[i : i + n]] & ((s > 0) & (s >= least[0] - SLACK) | (d >= least[1] - SLACK)))
            found.append((a + i, q, s[a, q], d[a, q]))
        a, q, s, d = (pa.array(np.concatenate(x)) for x in zip(*found, strict=True))
        cols = [asks.column(c).take(q) for c in by] + [chunks.column(c).take(a) for c in ("chunk_id", "doc_id")]
        return pa.table([*(c.cast(f.type) for c, f in zip(cols, schema)), s, d], schema=schema)

    return run


def pair_scores(chunks: DataFrame, n: int, asks: DataFrame, by: tuple[str, ...], each: int = 4_000, block: int = 512) -> DataFrame:
    """(*by, chunk_id, doc_id, s, d): BM25 and cosine of pairs of ``asks`` (*by, terms, doc_sets, least_s, least_d) and
    ``chunks`` as of asked_chunks that share a term, may be read and reach a bound of the ask (null: none).

    Chunks are dealt out to parts of about ``each`` and asks to blocks of ``block``; each pair of these is products of
    matrices. So no pair of ask and chunk is a row before its score is known, and no task holds more than a part, a
    block and the scores of 512 chunks."""
    m = asks.count() // block + 1
    parts = max(8, n // each + 1)
    c = chunks.select("chunk_id", "doc_id", "doc_set", "entries", F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("block"))
    q = asks.select(*by, "terms", "doc_sets", "least_s", "least_d", F.pmod(F.xxhash64(*by), F.lit(m)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    c, q = (x.withColumns({"part": F.col("part").cast("int"), "block": F.col("block").cast("int")}) for x in (c, q))
    out = asks.select(*by).schema.add("chunk_id", chunks.schema["chunk_id"].dataType).add("doc_id", chunks.schema["doc_id"].dataType).add("s", "double").add("d", "double")
    pairs = c.groupBy("part", "block").cogroup(q.groupBy("part", "block")).applyInArrow(_scores(by, to_arrow_schema(out)), out)
    return pairs.withColumns({x: F.round(x, 6) for x in ("s", "d")})


def _unbounded(asks: DataFrame) -> DataFrame:
    return asks.withColumns({c: F.lit(None).cast("double") for c in ("least_s", "least_d")})


def chunk_topk(terms: DataFrame, chunks: DataFrame, n: int, reach: DataFrame, k: int, by: tuple[str, ...], share: int = 64) -> DataFrame:
    """(*by, kind, chunk_id, doc_id, score, rank): the best ``k`` chunks that the user may read by BM25 (kind ``sparse``,
    above zero) and by cosine (``dense``), of ``terms`` (*by, user_set, term, qtf, w) and ``chunks`` as of asked_chunks, of
    which there are ``n`` at most.

    Both scores of a chunk are summed in the part that holds it, for all queries at once, so pairs of query and chunk are
    not shuffled. One in ``share`` chunks is scored first: the ``k``-th score there is a bound that the best of all
    reach too, so nearly all pairs are dropped where they are made, and the ranking sorts what is left."""
    asks = staged(_asks(terms, reach, by), "asks")

    def kinds(pairs: DataFrame) -> DataFrame:
        both = F.array(F.struct(F.lit("sparse").alias("kind"), F.col("s").alias("score")), F.struct(F.lit("dense").alias("kind"), F.col("d").alias("score")))
        return pairs.select(*by, "chunk_id", "doc_id", F.explode(both).alias("x")).select(*by, "chunk_id", "doc_id", "x.*").where("kind = 'dense' or score > 0")

    some = chunks.where(F.pmod(F.xxhash64("chunk_id"), F.lit(share)) == 0)
    first = top(kinds(pair_scores(some, n // share, _unbounded(asks), by)), k, (*by, "kind"))
    full = lambda kind: F.when(F.count(F.when(F.col("kind") == kind, 1)) == k, F.min(F.when(F.col("kind") == kind, F.col("score"))))
    least = first.groupBy(*by).agg(full("sparse").alias("least_s"), full("dense").alias("least_d"))
    return top(kinds(pair_scores(chunks, n, staged(asks.join(least, list(by), "left"), "bounds"), by)), k, (*by, "kind"))


def chunk_candidates(terms: DataFrame, chunks: DataFrame, n: int, reach: DataFrame, k: int, by: tuple[str, ...] = ("query_id", "user_id"), share: int = 64) -> DataFrame:
    """(*by, chunk_id, doc_id, score): chunks by cosine, whoever may read them, that may be among the best ``k`` once access
    is looked at; ``terms``, ``chunks`` and ``n`` as in chunk_topk.

    Of one in ``share`` chunks those that the user may read are ranked first: the ``k``-th score there is a bound that the
    best of all readable chunks reach. Pairs are scored in the part that holds the chunk and dropped below the bound there."""
    some = chunks.where(F.pmod(F.xxhash64("chunk_id"), F.lit(share)) == 0)
    scored = lambda c, n, asks: pair_scores(c, n, asks, by).select(*by, "chunk_id", "doc_id", F.col("d").alias("score"))
    first = top(scored(some, n // share, _unbounded(staged(_asks(terms, reach, by), "asks"))), k, by)
    least = first.groupBy(*by).agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("least_d"))
    # By cosine alone: no sum of BM25 reaches its bound.
    asks = _asks(terms, None, by).join(least, list(by), "left").withColumn("least_s", F.lit(float("inf")))
    return scored(chunks, n, staged(asks, "bounds"))


def rrf(rankings: DataFrame, by: tuple[str, ...] = ("query_id", "user_id"), k: int = P.RRF_K) -> DataFrame:
    """(*by, chunk_id, doc_id, score, rank): reciprocal rank fusion of (*by, chunk_id, doc_id, rank, weight)."""
    if k < 0:
        raise ValueError("k must not be negative")
    fused = rankings.groupBy(*by, "chunk_id", "doc_id").agg(F.round(F.sum(F.col("weight") / (k + F.col("rank"))), 9).alias("score"))
    return top(fused, 1 << 30, by)


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.greatest(F.sqrt(F.aggregate(F.transform(v, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x)), F.lit(1e-9))
    return dot / (norm(a) * norm(b))


def _block_best(k: int, keys: bool, many: int = 256):
    """Pairs of a block of vectors and a block of queries that may be among a query's best ``k``: all that are
    within rounding of the block's ``k``-th. With ``keys`` only pairs that agree in one of their keys count. ``many``
    queries at a time meet the block."""

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        kind = lambda t, c: t.schema.field(c).type if pa.types.is_floating(t.schema.field(c).type.value_type) else pa.list_(pa.float64())
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("q", kind(queries, "q")), ("embedding", kind(vectors, "embedding"))])
        if not vectors.num_rows or not queries.num_rows:
            return schema.empty_table()
        unit = lambda x: x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)
        read = lambda t, c, d: np.array(t.column(c).to_pylist(), d)
        v, q = unit(read(vectors, "embedding", np.float64)), unit(read(queries, "q", np.float64))
        ids, asked = vectors.column("vec_id").to_numpy(), queries.column("query_id").to_numpy()
        of, at = (read(t, "keys", np.int64) for t in (vectors, queries)) if keys else (None, None)
        found = []
        for i in range(0, len(q), many):
            score = q[i : i + many] @ v.T
            if keys:
                met = np.zeros(score.shape, bool)
                for j in range(of.shape[1]):
                    met |= at[i : i + many, j, None] == of[None, :, j]
                score[~met] = -2.0
            score[asked[i : i + many, None] == ids[None, :]] = -2.0
            least = np.partition(score, -min(k, len(ids)), axis=1)[:, -min(k, len(ids))]
            a, b = np.nonzero((score >= least[:, None] - 2e-6) & (score > -2.0))
            found.append((a + i, b))
        a, b = (pa.array(np.concatenate(x)) for x in zip(*found, strict=True))
        cols = (queries.column("query_id").take(a), vectors.column("vec_id").take(b), queries.column("q").take(a), vectors.column("embedding").take(b))
        return pa.table([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int, block: int = 16_384, asked: int = 65_536, keys: bool = False) -> DataFrame:
    """(query_id, vec_id, score, rank): exact search of all ``vectors`` for the query vectors; with ``keys`` both have a
    column ``keys`` (array<int>), and only pairs that agree in one of these places are candidates.

    Both sides are dealt out to blocks of about ``block`` vectors and ``asked`` queries; each pair of blocks is
    products of matrices, which pass on their best ``k`` for each query. Nothing is broadcast, no pair is shuffled but
    these, and no task holds more than two blocks and the scores of 256 queries, whatever the sizes."""
    rows = vectors.count()
    n = max(rows // block + 1, min(rows // 1_024, 8))
    m = queries.count() // asked + 1
    more = ("keys",) if keys else ()
    v = vectors.select("vec_id", "embedding", *more, F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias("vb"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("qb"))
    q = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), *more, F.pmod(F.xxhash64("vec_id"), F.lit(m)).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("vb"))
    v, q = (d.withColumns({"vb": F.col("vb").cast("int"), "qb": F.col("qb").cast("int")}) for d in (v, q))
    kind = lambda d, c: t if (t := d.schema[c].dataType.simpleString()) in ("array<float>", "array<double>") else "array<double>"
    pairs = v.groupBy("vb", "qb").cogroup(q.groupBy("vb", "qb")).applyInArrow(_block_best(k, keys), f"query_id long, vec_id long, q {kind(q, 'q')}, embedding {kind(v, 'embedding')}")
    scored = pairs.select("query_id", "vec_id", F.round(cosine(F.col("q"), F.col("embedding")), 6).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def is_identifier(token: Column) -> Column:
    """Looks like an identifier: four characters or more, with a digit and a letter, not a bare year."""
    return (F.length(token) >= 4) & token.rlike("[0-9]") & token.rlike("[a-z]") & ~token.rlike("^(19|20)[0-9]{2}$")


def rerank(candidates: DataFrame, queries: DataFrame, chunks: DataFrame, idf: DataFrame, size: DataFrame, k: int = P.RERANK_K, extra: tuple[str, ...] = ()) -> DataFrame:
    """Candidates (query_id, user_id, *extra, chunk_id, doc_id) with overlap, phrase, heading, coverage and
    an absolute score; the best ``k`` per query, ranked. Only candidates meet texts."""
    by = ("query_id", "user_id", *extra)
    terms = F.filter(T.tokenize(F.col("query")), lambda t: ~t.isin(*P.RERANK_STOPWORDS))
    q = queries.select("query_id", F.lower("query").alias("ql"), terms.alias("terms"), F.array_distinct(terms).alias("distinct_terms"))
    weights = q.select("query_id", F.explode("distinct_terms").alias("term")).join(idf.select("term", "idf"), "term", "left").crossJoin(F.broadcast(size.select("n")))
    weights = weights.select("query_id", "term", F.coalesce("idf", F.log(1.0 + F.col("n")) + 1).alias("w"))
    c = candidates.select(*by, "chunk_id", "doc_id").join(chunks.select("chunk_id", "heading", "text"), "chunk_id").join(q, "query_id")
    c = c.withColumns({"tokens": T.tokenize(F.col("text")), "tl": F.lower("text")})
    counts = c.select("query_id", "chunk_id", *extra, F.explode("tokens").alias("term")).groupBy("query_id", *extra, "chunk_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    keys = ["query_id", *extra, "chunk_id"]
    terms_of = candidates.select(*keys).distinct().join(weights, "query_id").join(counts, [*keys, "term"], "left")
    part = terms_of.groupBy(*keys).agg(
        F.coalesce(F.sum(F.col("w") * F.col("tf") / (F.col("tf") + 0.35)), F.lit(0.0)).alias("matched"), F.sum("w").alias("total"), F.count("tf").alias("hits"), F.count(F.lit(1)).alias("of")
    )
    pairs = F.transform(F.sequence(F.lit(1), F.size("terms") - 1), lambda i: F.struct(F.element_at("terms", i).alias("a"), F.element_at("terms", i + 1).alias("b")))
    bigrams = F.when(F.size("terms") > 1, F.filter(pairs, lambda p: F.length(p["a"]) + F.length(p["b"]) > 6)).otherwise(F.filter(F.array(F.struct(F.lit("").alias("a"), F.lit("").alias("b"))), lambda p: F.lit(False)))
    c = c.withColumn("bigrams", F.transform(bigrams, lambda p: F.concat(p["a"], F.lit(" "), p["b"])))
    share = F.when(F.size("bigrams") > 0, F.size(F.filter("bigrams", lambda g: F.contains(F.col("tl"), g))) / F.size("bigrams")).otherwise(0.0)
    named = F.size(F.filter("terms", lambda t: is_identifier(t) & F.contains(F.col("tl"), t))) > 0
    phrase = F.when((F.length("ql") > 12) & F.contains(F.col("tl"), F.col("ql")), 1.0).otherwise(F.least(F.lit(1.0), share + F.when(named, 0.6).otherwise(0.0)))
    heading = F.when(F.col("heading").isNotNull(), F.size(F.array_intersect(F.array_distinct(T.tokenize(F.col("heading"))), F.col("distinct_terms"))) / F.greatest(F.size("distinct_terms"), F.lit(1))).otherwise(0.0)
    penalty = 1.0 / (1.0 + F.greatest(F.lit(0.0), (F.greatest(F.size("tokens"), F.lit(1)) - 220) / 900.0))
    c = c.withColumns({"phrase": phrase, "heading_share": heading, "penalty": penalty}).join(part, keys, "left")
    c = c.withColumns({"overlap": F.coalesce(F.col("matched") / F.col("total"), F.lit(0.0)), "coverage": F.coalesce(F.col("hits") / F.col("of"), F.lit(0.0))})
    score = F.when(F.size("terms") == 0, 0.0).otherwise((0.40 * F.col("overlap") + 0.18 * F.col("phrase") + 0.10 * F.col("heading_share") + 0.32 * F.col("coverage")) * F.col("penalty"))
    c = c.select(*by, "chunk_id", "doc_id", *(F.round(x, 4).alias(n) for x, n in (("overlap", "overlap"), ("phrase", "phrase"), ("heading_share", "heading_score"), ("coverage", "coverage"))), F.round(F.least(F.lit(1.0), score), 6).alias("score"))
    return top(c, k, by)
