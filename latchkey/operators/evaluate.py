"""Retrieval, citation and governance metrics, resampling and comparison of systems."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from latchkey.sources.scratch import staged


def labels_check(items: DataFrame, gold: DataFrame, forbidden: DataFrame, scope: DataFrame, known: DataFrame, types: tuple[str, ...] | None = None) -> DataFrame:
    """(query_id, problem): what is wrong with labelled items; ``types`` are the query types that there are."""
    twice = items.groupBy("query_id").count().where("count > 1").select("query_id", F.lit("duplicate id").alias("problem"))
    per = items.join(gold.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left")
    bad = per.select("query_id", F.when(F.col("should_abstain") & (F.col("n") > 0), "abstains with gold").when(~F.col("should_abstain") & F.col("n").isNull(), "answerable without gold").alias("problem")).where("problem is not null")
    user = items.select("query_id", "user_id")
    unread = gold.join(user, "query_id").join(scope, ["user_id", "doc_id"], "left_anti").select("query_id", F.lit("gold not readable").alias("problem"))
    open_ = forbidden.join(user, "query_id").join(scope, ["user_id", "doc_id"], "left_semi").select("query_id", F.lit("forbidden is readable").alias("problem"))
    lost = gold.join(known, "doc_id", "left_anti").select("query_id", F.lit("gold does not exist").alias("problem"))
    odd = items.where(~F.col("query_type").isin(*types)) if types else items.where(F.lit(False))
    odd = odd.select("query_id", F.lit("unknown query type").alias("problem"))
    return odd.unionByName(twice).unionByName(bad).unionByName(unread).unionByName(open_).unionByName(lost).distinct()


def retrieval_metrics(items: DataFrame, ranked: DataFrame, gold: DataFrame, k: int, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(*by, recall, mrr, ndcg) of ranked (*by, doc_id, rank) against gold (query_id, doc_id); a gold document counts
    at its best rank; null without gold."""
    best = ranked.groupBy(*by, "doc_id").agg(F.min("rank").alias("rank")).join(gold, ["query_id", "doc_id"], "left_semi")
    per = best.groupBy(*by).agg(F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).alias("hits"), (1.0 / F.min("rank")).alias("mrr"), F.sum(F.when(F.col("rank") <= k, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"))
    n = gold.groupBy("query_id").agg(F.count(F.lit(1)).alias("gold"))
    j = items.join(n, "query_id", "left").join(per, list(by), "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("gold", F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1.0))
    none = F.col("gold").isNull()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return j.select(
        *by, F.when(none, None).otherwise(F.round(zero("hits") / F.col("gold"), 6)).alias("recall"), F.when(none, None).otherwise(F.round(zero("mrr"), 6)).alias("mrr"), F.when(none, None).otherwise(F.round(zero("dcg") / ideal, 6)).alias("ndcg")
    )


def citation_scores(items: DataFrame, cited: DataFrame, gold: DataFrame, pack: DataFrame, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """(*by, citation_precision, citation_coverage, groundedness): of the citations those that are gold, of gold those
    cited, of the citations those in the pack; null where there is nothing to divide by."""
    c = cited.select(*by, "doc_id", "chunk_id").distinct()
    is_gold, served = gold.withColumn("good", F.lit(1)), pack.select(*by, "chunk_id").distinct().withColumn("served", F.lit(1))
    per = c.join(is_gold, ["query_id", "doc_id"], "left").join(served, [*by, "chunk_id"], "left").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("hits"), F.countDistinct(F.when(F.col("good") == 1, F.col("doc_id"))).alias("found"), F.sum(F.coalesce("served", F.lit(0))).alias("grounded"))
    n = gold.groupBy("query_id").agg(F.count(F.lit(1)).alias("gold"))
    j = items.join(per, list(by), "left").join(n, "query_id", "left")
    return j.select(*by, F.when(F.col("gold").isNotNull(), F.round(F.col("hits") / F.col("n"), 6)).alias("citation_precision"), F.round(F.coalesce("found", F.lit(0)) / F.col("gold"), 6).alias("citation_coverage"), F.round(F.col("grounded") / F.col("n"), 6).alias("groundedness"))


def acl_violations(surfaced: DataFrame, forbidden: DataFrame, scope: DataFrame) -> DataFrame:
    """(query_id, doc_id) that surfaced though forbidden or out of the user's scope; must be empty."""
    a = surfaced.join(forbidden, ["query_id", "doc_id"], "left_semi").select("query_id", "doc_id")
    return a.unionByName(surfaced.join(scope, ["user_id", "doc_id"], "left_anti").select("query_id", "doc_id")).distinct()


def aggregate(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Means that skip nulls with how many they are of, rates and totals."""
    means = ("recall", "mrr", "ndcg", "citation_precision", "citation_coverage", "groundedness")
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("items"),
        *(F.round(F.avg(m), 4).alias(m) for m in means),
        *(F.count(m).alias(f"{m}_n") for m in means),
        F.round(F.avg(F.col("abstained").cast("double")), 4).alias("abstention_rate"),
        F.round(F.avg(F.col("abstention_appropriate").cast("double")), 4).alias("abstention_appropriateness"),
        F.round(F.avg(F.col("freshness_compliant").cast("double")), 4).alias("freshness_compliance"),
        F.sum("violations").alias("violations"),
        F.round(F.avg("cost"), 8).alias("mean_cost"),
    )


def exact_quantile(rows: DataFrame, by: str, column: str, q: float, bins: int = 1024, rounds: int = 2) -> DataFrame:
    """(by, value): the exact quantile of each group, between neighbours by their distance. Null values are passed over,
    null is a group like any other, and a group without values has no row.

    Each round counts the values of ``bins`` equal ranges between the least and the greatest, which combines before
    the shuffle, and keeps the ranges that hold the two ranks. Only what is left there is counted by value at the end,
    so no group is ever sorted or held whole, however large it is."""
    v = rows.select(F.col(by).alias("group"), F.col(column).cast("double").alias("v")).where("v is not null")
    ends = v.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    at, share = q * (F.col("n") - 1), q * (F.col("n") - 1) - F.floor(q * (F.col("n") - 1))
    ranks = F.array(F.struct(F.floor(at).alias("rank"), (1 - share).alias("weight")), F.struct(F.ceil(at).alias("rank"), share.alias("weight")))
    wanted = ends.select("group", F.explode(ranks).alias("r"), "lo", "hi", F.lit(0).cast("long").alias("before")).select("group", "r.*", "lo", "hi", "before").where("weight > 0")
    key = ["lo", "hi", "before"]

    def inside(wanted: DataFrame) -> DataFrame:
        spans = wanted.select(F.col("group").alias("of"), *key).distinct()
        return v.join(spans, F.col("group").eqNullSafe(F.col("of"))).where("v >= lo and v <= hi").drop("of")

    def holding(counts: DataFrame, order: str, wanted: DataFrame) -> DataFrame:
        """The rows of counts (group, *key, order, n, ...) that hold a rank, with it and the rows before them."""
        up = Window.partitionBy("group", *key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        c = counts.withColumn("first", F.col("before") + F.sum("n").over(up) - F.col("n")).withColumnRenamed("group", "of").drop("lo", "hi").withColumnRenamed("before", "start")
        j = wanted.drop("lo", "hi").join(c, F.col("group").eqNullSafe(F.col("of")) & (F.col("before") == F.col("start")))
        return j.where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n")))

    for _ in range(rounds):
        wanted = staged(wanted, "ranks")
        # Halves, since the distance of two numbers can be too large for one.
        place = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * bins), F.lit(bins - 1))
        binned = inside(wanted).withColumn("bin", F.when(F.col("hi") > F.col("lo"), place).otherwise(0))
        counts = binned.groupBy("group", *key, "bin").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        wanted = holding(counts, "bin", wanted).select("group", "rank", "weight", F.col("least").alias("lo"), F.col("most").alias("hi"), F.col("first").alias("before"))
    wanted = staged(wanted, "ranks")
    counts = inside(wanted).groupBy("group", *key, "v").agg(F.count(F.lit(1)).alias("n"))
    return holding(counts, "v", wanted).groupBy(F.col("group").alias(by)).agg(F.sum(F.col("v") * F.col("weight")).alias("value"))


def bootstrap(values: DataFrame, rounds: int, seed: int = 1729, column: str = "value") -> DataFrame:
    """(round, mean): means of resamples. Each row draws how often it is in a resample, so resampling is
    one pass over rows by rounds with partial sums and needs no join."""
    u = (F.pmod(F.xxhash64("id", "round", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    times = sum((F.when(u > c, 1).otherwise(0) for c in _poisson()), F.lit(0))
    r = values.select("id", F.col(column).alias("v"), F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round")).withColumn("times", times)
    return r.groupBy("round").agg((F.sum(F.col("times") * F.col("v")) / F.sum("times")).alias("mean"))


def _poisson() -> list[float]:
    """Cumulative probabilities of a Poisson count of mean one."""
    out, p, total = [], 2.718281828459045**-1, 0.0
    for k in range(1, 10):
        total += p
        out.append(total)
        p /= k
    return out


def interval(means: DataFrame) -> DataFrame:
    return means.agg(F.round(F.percentile("mean", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("mean", F.lit(0.975)), 6).alias("high"))


def paired(a: DataFrame, b: DataFrame, rounds: int, seed: int = 1729) -> DataFrame:
    """One row: mean difference of a over b on the same ids, share of resamples at or below zero, stars."""
    d = a.select("id", F.col("value").alias("x")).join(b.select("id", F.col("value").alias("y")), "id").select("id", (F.col("x") - F.col("y")).alias("value"))
    p = bootstrap(d, rounds, seed).agg(F.avg((F.col("mean") <= 0).cast("double")).alias("p"))
    stars = F.when(F.col("p") < 0.001, "***").when(F.col("p") < 0.01, "**").when(F.col("p") < 0.05, "*").otherwise("ns")
    return d.agg(F.round(F.avg("value"), 6).alias("difference"), F.count(F.lit(1)).alias("n")).crossJoin(p).withColumn("stars", stars)


def compare(rows: DataFrame, ours: str, other: str, metric: str = "ndcg") -> DataFrame:
    """(query_id, route_a, route_b, delta, outcome) of two systems."""
    side = lambda s, n: rows.where(F.col("system") == s).select("query_id", F.col("route").alias(f"route_{n}"), F.coalesce(metric, F.lit(0.0)).alias(n))
    j = side(ours, "a").join(side(other, "b"), "query_id").withColumn("delta", F.round(F.col("a") - F.col("b"), 6))
    return j.select("query_id", "route_a", "route_b", "delta", F.when(F.col("delta") > 0, ours).when(F.col("delta") < 0, other).otherwise("TIE").alias("outcome"))


def stratified_split(rows: DataFrame, label: str, share: float = 0.8, seed: int = 1729) -> DataFrame:
    """Adds ``train``: of each class the share that comes first in a seeded order of ids.

    The order is that of md5, in 4,096 buckets by its first digits. Counts of buckets say how many rows
    come before each, so only a bucket is ever sorted, however large a class is."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))
    r = rows.withColumn("order", order).withColumn("bucket", F.substring("order", 1, 3))
    n = r.groupBy(label, "bucket").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy(label)
    n = n.select(F.col(label).alias("class"), F.col("bucket").alias("part"), (F.sum("n").over(by.orderBy("bucket")) - F.col("n")).alias("before"), F.floor(share * F.sum("n").over(by)).alias("most"))
    inside = F.row_number().over(Window.partitionBy(label, "bucket").orderBy("order", "id"))
    j = r.join(n, F.col(label).eqNullSafe(F.col("class")) & (F.col("bucket") == F.col("part")))
    return j.withColumn("train", F.col("before") + inside <= F.col("most")).select(*rows.columns, "train")


def classification_report(rows: DataFrame) -> DataFrame:
    """(class, accuracy, precision, recall, f1, support) of rows (label, predicted); accuracy is that of all rows."""
    n = rows.groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("n"))
    by = lambda c: n.groupBy(F.col(c).alias("class"))
    t = by("label").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hits")).join(by("predicted").agg(F.sum("n").alias("said")), "class", "left")
    p, r = F.coalesce(F.col("hits") / F.col("said"), F.lit(0.0)), F.col("hits") / F.col("support")
    t = t.crossJoin(F.broadcast(n.agg(F.round(F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("accuracy"))))
    return t.select("class", "accuracy", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"), "support")


def gold_route(per_route: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, gold_route): R0 if it should abstain, else the first route whose evidence has gold, else the expected one."""
    hit = per_route.groupBy("query_id").agg(F.min("route").alias("hit"))
    return items.join(hit, "query_id", "left").select("query_id", F.when(F.col("should_abstain"), "R0").otherwise(F.coalesce("hit", "expected_route")).alias("gold_route"))


def is_appropriate(should: Column, did: Column) -> Column:
    return should == did
