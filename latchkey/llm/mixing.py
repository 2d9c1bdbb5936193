"""Mixing overlapping sources to target weights by min-cost flow."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latchkey.llm.common import staged

WORD = r"[^\x20\x09-\x0D]+"
#: Membership patterns of several sources that the flow sees as they are.
PATTERNS = 2_000


def word_count(text):
    """Number of words of a text column; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: dict, weights: dict, total: float | None = None, repeat: int = 3) -> dict:
    """Share ``total`` (all sizes by default) among sources by weight, each at most ``repeat`` times
    its size; what is above is shared again by weight until none is above."""
    left, weight = (sum(sizes.values()) if total is None else total), sum(weights.values())
    level, out = 0.0, {}
    order = sorted(sizes, key=lambda s: (repeat * sizes[s] / weights[s], weights[s], repeat * sizes[s]))
    for s in order:
        level = left / weight
        if level * weights[s] < repeat * sizes[s]:
            break
        out[s] = float(repeat * sizes[s])
        left, weight = left - repeat * sizes[s], weight - weights[s]
    return {s: out.get(s, level * weights[s]) for s in sizes}


def min_cost_flow(supply: dict, quota: dict, repeat: int = 3) -> dict:
    """{(pattern, source): words}: as much of each source's quota as its patterns can give.

    A pattern is a tuple of sources; ``supply`` has its words, each usable ``repeat`` times at a cost
    of 0 for the first use, 1 for the second and so on, so the cost of repetition is convex. Paths of
    least cost are filled one after another (Dijkstra with potentials).
    """
    graph: list[list[list]] = []

    def node() -> int:
        graph.append([])
        return len(graph) - 1

    def edge(a: int, b: int, room: int, cost: int) -> None:
        graph[a].append([b, room, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])

    start, end = node(), node()
    sources, patterns = {s: node() for s in sorted(quota, key=str)}, {p: node() for p in sorted(supply, key=str)}
    for p, n in patterns.items():
        for use in range(repeat):
            edge(start, n, supply[p], use)
        for s in p:
            edge(n, sources[s], repeat * supply[p], 0)
    for s, n in sources.items():
        edge(n, end, quota[s], 0)
    potential = [0] * len(graph)
    while True:
        far, via = [float("inf")] * len(graph), [None] * len(graph)
        far[start], heap = 0, [(0, start)]
        while heap:
            cost, a = heapq.heappop(heap)
            if cost > far[a]:
                continue
            for i, (b, room, c, _) in enumerate(graph[a]):
                if room > 0 and (now := cost + c + potential[a] - potential[b]) < far[b]:
                    far[b], via[b] = now, (a, i)
                    heapq.heappush(heap, (now, b))
        if via[end] is None:
            break
        potential = [p + f if f < float("inf") else p for p, f in zip(potential, far, strict=True)]
        path, at = [], end
        while at != start:
            path.append(via[at])
            at = via[at][0]
        push = min(graph[a][i][1] for a, i in path)
        for a, i in path:
            graph[a][i][1] -= push
            graph[graph[a][i][0]][graph[a][i][3]][1] += push
    back = {n: s for s, n in sources.items()}
    return {(p, back[e[0]]): repeat * supply[p] - e[1] for p, n in patterns.items() for e in graph[n] if e[0] in back}


def mix(docs: DataFrame, members, size, id_col: str = "doc_id", weights=None, repeat: int = 3, seed: int = 42, patterns: int = PATTERNS) -> tuple[DataFrame, DataFrame]:
    """Select documents so that each source's words come to its target.

    ``members`` is a column with the array of sources of a document, ``size`` its words. ``weights``
    maps the sorted list of sources (null last) to their weights; by default 1, 2, 3 repeating.
    Returns (selection, quotas): selection has doc_id, size, members, source, copies, one row for each
    document and source that it is taken for, and one with source null and copies 0 for a document
    that is not taken; quotas has source, source_size, target. A document in several sources counts
    in the size of each.

    The driver sees one sum for each source and for the ``patterns`` largest membership patterns of several
    sources, never documents. A document of any other pattern is offered to one of its sources, chosen by
    its seeded order, so no number of patterns is too large and no document is left out. Each pattern's flow to its
    sources is laid on the line of its documents in seeded order, repeated ``repeat`` times; a document
    is taken where its middle falls, so a source misses its quota by half a document at most for each
    stretch. Positions on that line are sums over 4096 seeded buckets and sums inside a bucket, so
    no task orders a whole source. Ties in the order go by id. Documents without words are taken with
    no words. An empty table gives empty results.
    """
    spark = docs.sparkSession
    d = docs.select(
        F.col(id_col).alias("doc_id"),
        F.array_sort(F.array_distinct(members)).alias("members"),
        size.cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("order"),
    )
    d = d.withColumn("bucket", F.conv(F.substring("order", 1, 3), 16, 10).cast("int"))
    d = staged(d.withColumnsRenamed({"members": "all"}), "mixing")
    sums = d.groupBy("all").agg(F.sum("size").alias("words"))
    large = staged(sums.where(F.size("all") > 1).orderBy(F.col("words").desc(), F.array_join("all", "\0", "\1")).limit(patterns).select("all", F.lit(True).alias("large")), "patterns")
    one = F.array(F.element_at("all", (F.conv(F.substring("order", 4, 8), 16, 10).cast("long") % F.greatest(F.size("all"), F.lit(1)) + 1).cast("int")))
    d = d.join(F.broadcast(large), "all", "left").withColumn("members", F.when(F.col("large") | (F.size("all") < 2), F.col("all")).otherwise(one)).drop("large")
    supply = {tuple(r.members): r.words for r in d.groupBy("members").agg(F.sum("size").alias("words")).collect()}
    sizes: dict = {r.source: r.words for r in d.select("size", F.explode("all").alias("source")).groupBy("source").agg(F.sum("size").alias("words")).collect()}
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    given = dict(zip(names, weights(names) if weights else [1 + i % 3 for i in range(len(names))], strict=True))
    quota = targets(sizes, given, sum(supply.values()), repeat)
    flow = min_cost_flow(supply, {s: int(q + 0.5) for s, q in quota.items()}, repeat)
    stretches, at = [], {}
    for (p, s), n in sorted(flow.items(), key=lambda x: (str(x[0][0]), x[0][1] is None, str(x[0][1]))):
        if n:
            stretches.append((list(p), supply[p], s, at.get(p, 0), at.get(p, 0) + n))
            at[p] = at.get(p, 0) + n
    # As Arrow tables, which need no Python workers of their own.
    kinds = {"members": pa.list_(pa.string()), "words": pa.int64(), "source": pa.string(), "begin": pa.int64(), "until": pa.int64()}
    plan = spark.createDataFrame(pa.table({k: pa.array([x[i] for x in stretches], t) for i, (k, t) in enumerate(kinds.items())}))
    shares = [sizes[s] for s in names], [float(quota[s]) for s in names]
    quotas = spark.createDataFrame(pa.table({"source": pa.array(names, pa.string()), "source_size": pa.array(shares[0], pa.int64()), "target": pa.array(shares[1], pa.float64())}))
    buckets = d.groupBy("members", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("members").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select("members", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("members", "bucket").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = d.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(buckets, ["members", "bucket"])
    # Twice the middle of the document, to stay with whole numbers.
    placed = placed.select("doc_id", "all", "members", "size", (2 * (F.col("first") + F.col("inside")) + F.col("size")).alias("mid"))
    hits = F.size(
        F.filter(
            F.sequence(F.lit(0), F.lit(repeat - 1)),
            lambda use: (F.col("mid") + 2 * use * F.col("words") >= 2 * F.col("begin")) & (F.col("mid") + 2 * use * F.col("words") < 2 * F.col("until")),
        )
    )
    taken = placed.join(F.broadcast(plan), "members", "left").withColumn("copies", F.when(F.col("words").isNull(), 0).otherwise(hits))
    some = F.max("copies").over(Window.partitionBy("members", "doc_id", "mid"))
    if all(len(p) == 1 for p in supply):
        selection = taken.withColumn("source", F.when(F.col("copies") > 0, F.col("source")))
    else:
        number = F.row_number().over(Window.partitionBy("members", "doc_id", "mid").orderBy("source"))
        selection = taken.withColumns({"some": some, "number": number}).where("copies > 0 or (some = 0 and number = 1)")
        selection = selection.withColumn("source", F.when(F.col("copies") > 0, F.col("source")))
    return selection.select("doc_id", "size", F.col("all").alias("members"), "source", "copies"), quotas


def mix_single(docs: DataFrame, seed: int = 42, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix where each document has one source: doc_id, size, source_size, target, taken."""
    selection, quotas = mix(docs, F.array(F.col(source_col)), word_count(F.col(text_col)), seed=seed)
    own = selection.withColumn("own", F.col("members")[0])
    quotas = quotas.withColumnRenamed("source", "name")
    return own.join(F.broadcast(quotas), F.col("own").eqNullSafe(F.col("name"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken")
    )


ORACLE = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
                  md5('42:' || coalesce(doc_id::varchar, '')) as o from documents),
s as (select source, sum(size)::bigint as n, 1 + (row_number() over (order by source nulls last) - 1) % 3 as w from d group by source),
k as (select *, row_number() over (order by 3 * n / w, w, 3 * n) as r from s),
l as (select *, ((sum(n) over ())::bigint - coalesce(sum(3 * n) over (order by r rows between unbounded preceding and 1 preceding), 0)::bigint)
             / ((sum(w) over ())::bigint - coalesce(sum(w) over (order by r rows between unbounded preceding and 1 preceding), 0)::bigint) as level from k),
c as (select *, coalesce(min(case when level * w < 3 * n then r end) over (), 1 + max(r) over ()) as stop from l),
t as (select source, n, case when r < stop then (3 * n)::double else max(case when r = stop then level end) over () * w end as target from c),
p as (select d.*, n, target, floor(target + 0.5)::bigint as f,
             2 * coalesce(sum(size) over (partition by d.source order by o, doc_id rows between unbounded preceding and 1 preceding), 0)::bigint + size as mid
      from d join t on d.source is not distinct from t.source)
select doc_id, size, n as source_size, target,
       size * ((mid < 2 * f)::int + (mid + 2 * n < 2 * f)::int + (mid + 4 * n < 2 * f)::int)::bigint as taken from p
"""
