"""Access control and freshness as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scope(user_roles: DataFrame, doc_roles: DataFrame, user_block: int = 1_024, doc_block: int = 4_096) -> DataFrame:
    """(user_id, doc_id): what each user may read.

    Users and documents with the same set of roles are one row each while sets are matched, so the join by role sees sets
    and not pairs of users and documents. Users and documents of a set are then dealt out to lists of about
    ``user_block`` and ``doc_block``; pairs of lists are spread evenly and fan out where they lie. So work is spread
    however few sets there are, no task holds more than two lists at a time, and no pair of user and document is shuffled."""
    users, docs = sets_of_roles(user_roles, "user_id"), sets_of_roles(doc_roles, "doc_id")
    sets = lambda df, name: df.select(F.col("roles").alias(name)).distinct().select(name, F.explode(name).alias("role"))
    match = sets(users, "user_set").join(sets(docs, "doc_set"), "role").select("user_set", "doc_set").distinct()

    def lists(df: DataFrame, key: str, name: str, block: int) -> DataFrame:
        n = df.groupBy("roles").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
        dealt = df.join(n, "roles").withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks")))
        return dealt.groupBy(F.col("roles").alias(name), "block").agg(F.collect_list(key).alias(f"{key}s")).drop("block")

    pairs = match.join(lists(users, "user_id", "user_set", user_block), "user_set").join(lists(docs, "doc_id", "doc_set", doc_block), "doc_set").select("user_ids", "doc_ids")
    parts = users.count() * docs.count() // (user_block * doc_block) + 1
    return pairs.repartition(min(parts, 20_000)).select(F.explode("user_ids").alias("user_id"), "doc_ids").select("user_id", F.explode("doc_ids").alias("doc_id"))


def sets_of_roles(roles: DataFrame, key: str) -> DataFrame:
    """(key, roles): the sorted set of roles of each user or document."""
    return roles.groupBy(key).agg(F.array_sort(F.collect_set(F.lower(F.trim("role")))).alias("roles"))


def numbered_sets(sets: DataFrame, name: str) -> DataFrame:
    """(roles, name): each set of roles once, with a number. Numbers hold for one evaluation only, so the result
    is to be written before it is used."""
    return sets.select("roles").distinct().withColumn(name, F.monotonically_increasing_id())


def reach(user_sets: DataFrame, doc_sets: DataFrame) -> DataFrame:
    """(user_set, doc_set): which numbered sets of roles of documents a numbered set of users' roles reads. Its size
    goes with the policies that there are, not with users or documents."""
    u, d = (s.select(n, F.explode("roles").alias("role")) for s, n in ((user_sets, "user_set"), (doc_sets, "doc_set")))
    return u.join(d, "role").select("user_set", "doc_set").distinct()


def scope_among(pairs: DataFrame, users: DataFrame, docs: DataFrame, reach: DataFrame) -> DataFrame:
    """(user_id, doc_id): those of ``pairs`` that the user may read, by numbers of sets: ``users`` (user_id,
    user_set), ``docs`` (doc_id, doc_set). Users and documents without roles have no set and reach nothing."""
    return readable(pairs.select("user_id", "doc_id").distinct(), users, docs, reach)


def readable(candidates: DataFrame, users: DataFrame, docs: DataFrame, reach: DataFrame) -> DataFrame:
    """Candidates (user_id, doc_id, ...) that the user may read, by numbers of sets as in scope_among."""
    c = candidates.join(users, "user_id").join(docs, "doc_id").join(reach, ["user_set", "doc_set"], "left_semi")
    return c.select(candidates.columns)


def scope_summary(users: DataFrame, user_roles: DataFrame, docs: DataFrame, doc_roles: DataFrame, per_doc: DataFrame) -> DataFrame:
    """Per user: allowed and withheld documents and chunks, and the types of withheld documents.

    ``per_doc`` has doc_id and chunks. Everything is summed per set of roles before users join, so no
    pair of user and document is made.
    """
    of = lambda df, key: df.groupBy(key).agg(F.array_sort(F.collect_set(F.lower(F.trim("role")))).alias("roles"))
    u = users.join(of(user_roles, "user_id"), "user_id", "left").withColumn("roles", F.coalesce("roles", F.array().cast("array<string>")))
    d = docs.select("doc_id", "doc_type").join(of(doc_roles, "doc_id"), "doc_id", "left").join(per_doc, "doc_id", "left").withColumn("roles", F.coalesce("roles", F.array().cast("array<string>")))
    groups = d.groupBy(F.col("roles").alias("doc_set"), "doc_type").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.coalesce("chunks", F.lit(0))).alias("chunks"))
    # Sets of roles of users meet those of documents by role; nothing is broadcast and no set meets one that it shares no role with.
    role = lambda df, c: df.select(c, F.explode(c).alias("role"))
    reach = role(u.select("roles").distinct(), "roles").join(role(groups.select("doc_set").distinct(), "doc_set"), "role").select("roles", "doc_set").distinct()
    mine = reach.join(groups, "doc_set").groupBy("roles", "doc_type").agg(F.sum("docs").alias("docs"), F.sum("chunks").alias("chunks"))
    types = groups.groupBy("doc_type").agg(F.sum("docs").alias("all_docs"), F.sum("chunks").alias("all_chunks"))
    # One row for each set of users' roles and document type, of which there are a handful.
    per = u.select("roles").distinct().crossJoin(types).join(mine, ["roles", "doc_type"], "left").na.fill(0, ["docs", "chunks"])
    sets = per.groupBy("roles").agg(
        F.sum("chunks").alias("allowed_chunks"),
        F.sum("docs").alias("allowed_docs"),
        F.sum("all_chunks").alias("total_chunks"),
        F.sum(F.col("all_chunks") - F.col("chunks")).alias("withheld"),
        F.array_sort(F.collect_set(F.when(F.col("all_docs") > F.col("docs"), F.col("doc_type")))).alias("withheld_types"),
    )
    part = F.when(F.col("total_chunks") > 0, F.col("withheld") / F.col("total_chunks")).otherwise(0.0)
    return u.join(sets, "roles").select("user_id", "allowed_chunks", "allowed_docs", "total_chunks", "withheld", F.array_join("withheld_types", ",").alias("withheld_types"), F.round(part, 6).alias("restricted_fraction"))


def allowed(candidates: DataFrame, scope: DataFrame) -> DataFrame:
    """Candidates (user_id, doc_id, ...) that the user may read."""
    return candidates.join(scope, ["user_id", "doc_id"], "left_semi")


def assert_allowed(candidates: DataFrame, scope: DataFrame, stage: str) -> DataFrame:
    """The candidates; a candidate that its user may not read fails the job."""
    marked = candidates.join(scope.withColumn("may", F.lit(True)), ["user_id", "doc_id"], "left")
    ok = F.when(F.col("may"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"{stage}: not readable by its user: "), F.col("doc_id").cast("string"))).cast("boolean"))
    return marked.where(ok).drop("may")


def freshness(today: Column) -> Column:
    """0.55 for a superseded document, and again for one that is not in force yet."""
    return F.when(F.col("superseded_by").isNotNull(), 0.55).otherwise(1.0) * F.when(F.col("effective_date") > today, 0.55).otherwise(1.0)


def authority() -> Column:
    return 0.9 + 0.05 * (F.col("authority_score") - 1)


def adjusted(score: Column, today: Column) -> Column:
    return F.least(F.lit(1.0), score * freshness(today) * authority())


def is_current(today: Column) -> Column:
    return F.col("superseded_by").isNull() & (F.col("effective_date") <= today)


def preference(today: Column) -> Column:
    """Orders documents of a family: in force and not superseded first, then the latest, then authority."""
    return F.struct(F.col("superseded_by").isNull().alias("live"), (F.col("effective_date") <= today).alias("started"), "effective_date", "authority_score")


def warning(today: Column) -> Column:
    """What to say about a document that is not current; null if it is."""
    old = F.concat(F.lit("'"), "title", F.lit("' v"), "version", F.lit(" has been superseded by "), F.col("superseded_by").cast("string"))
    early = F.concat(F.lit("'"), "title", F.lit("' v"), "version", F.lit(" takes effect "), F.col("effective_date").cast("string"))
    return F.when(F.col("superseded_by").isNotNull(), old).when(F.col("effective_date") > today, early)
