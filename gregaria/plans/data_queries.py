"""Queries over the message, person, forum and place tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gregaria.operators.hierarchy import descendants, preorder, resolve_forest
from gregaria.operators.packed import unpack_fields
from gregaria.operators.references import broken_references, given, parent_intervals
from gregaria.operators.skew import per_key, skew_join
from gregaria.sources.scratch import Scratch
from gregaria.sources.tables import read_table

HEAVY_SHARE = 1 / 40
HOT_SHARE = 1 / 64
CORE_ROWS = 5_000  # links that one task may end with: few enough for every size of the data to go through distributed rounds


def records(rows: DataFrame, *columns: str) -> DataFrame:
    """One row an id with its first arrival; rows of a record agree in all else."""
    return rows.where("id is not null").groupBy("id").agg(F.min("loaded_at").alias("loaded_at"), *(F.min(c).alias(c) for c in columns))


# -- 1: references ---------------------------------------------------------


def reference_faults(spark: SparkSession, sf: str) -> DataFrame:
    """``table_name, field_name, record_id, period, fault`` of every broken reference."""
    message, person, forum, place, tombstone = (read_table(spark, sf, t) for t in ("message", "person", "forum", "place", "tombstone"))
    arrivals = lambda df: df.select(F.col("id").alias("key"), F.col("loaded_at").alias("arrived"))
    parents = parent_intervals(
        {
            "person": arrivals(person),
            "post": arrivals(message.where("ispost")),
            "forum": arrivals(forum),
            "place": place.select(F.col("id").alias("key"), F.lit(None).cast("timestamp_ntz").alias("arrived")),
        },
        tombstone.select("kind", F.col("record_id").alias("key"), "removed_at"),
    )
    named = lambda table, field, kind: F.struct(
        F.lit(table).alias("table_name"), F.lit(field).alias("field_name"), F.lit(kind).alias("kind"), F.col(field).alias("key")
    )
    carried = [F.col("id").alias("record_id"), F.col("loaded_at").alias("seen_at"), F.coalesce(F.date_format("creationdate", "yyyy-MM"), F.lit("none")).alias("period")]
    from_message = records(message, "creationdate", "creator", "replyofpost", "forumid").select(
        *carried, F.inline(F.array(named("message", "creator", "person"), named("message", "replyofpost", "post"), named("message", "forumid", "forum")))
    )
    from_person = records(person, "creationdate", "place").select(*carried, F.inline(F.array(named("person", "place", "place"))))
    return broken_references(from_message.unionByName(from_person), parents).select("table_name", "field_name", "record_id", "period", "fault")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return reference_faults(spark, sf).drop("fault")


def p1_report(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of broken references by table, field, month and fault."""
    return reference_faults(spark, sf).groupBy("table_name", "field_name", "period", "fault").agg(F.count(F.lit(1)).alias("n_records"))


# -- 2: heavy keys ---------------------------------------------------------


def key_results(spark: SparkSession, sf: str) -> DataFrame:
    """Per creator and per moderator: number of records, first and last date, and whether the key is heavy."""
    parts = []
    for table, field in (("message", "creator"), ("forum", "moderator")):
        rows = records(read_table(spark, sf, table), field, "creationdate")
        rows = rows.select(F.when(given(F.col(field)), F.col(field)).alias("key_id"), "creationdate")
        results = per_key(
            rows, "key_id", [F.count(F.lit(1)).alias("n_records"), F.min("creationdate").alias("first_date"), F.max("creationdate").alias("last_date")], HEAVY_SHARE
        )
        parts.append(results.select(F.lit(table).alias("table_name"), F.lit(field).alias("field_name"), "*"))
    return parts[0].unionByName(parts[1])


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return key_results(spark, sf).where("is_heavy").select("table_name", "field_name", "key_id")


def p2_keys(spark: SparkSession, sf: str) -> DataFrame:
    return key_results(spark, sf)


def p2_named(spark: SparkSession, sf: str) -> DataFrame:
    """Every message record with the names of its creator, null where there is no such person."""
    rows = records(read_table(spark, sf, "message"), "creator").select(F.col("id").alias("message_id"), F.when(given(F.col("creator")), F.col("creator")).alias("creator"))
    names = records(read_table(spark, sf, "person"), "firstname", "lastname").select(F.col("id").alias("creator"), "firstname", "lastname")
    return skew_join(rows, names, "creator", HEAVY_SHARE).select("message_id", "creator", "firstname", "lastname")


# -- 4: packed fields ------------------------------------------------------


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    people = records(read_table(spark, sf, "person"), "email", "language")
    return unpack_fields(people.withColumnRenamed("id", "person_id"), "person_id", ["email", "language"])


# -- 5: hierarchies --------------------------------------------------------


def tree_links(spark: SparkSession, sf: str) -> DataFrame:
    """``tree, node, parent`` of every record that names a parent; parent is null where that record does not exist."""
    rows = read_table(spark, sf, "message")
    by_comment = given(F.col("replyofcomment"))
    messages = (
        records(rows, "replyofpost", "replyofcomment")
        .where(by_comment | given(F.col("replyofpost")))
        .select(F.col("id").alias("node"), F.when(by_comment, F.col("replyofcomment")).otherwise(F.col("replyofpost")).alias("wanted"), (~by_comment).alias("wants_post"))
    )
    there = rows.where("id is not null and ispost is not null").select(F.col("id").alias("wanted"), F.col("ispost").alias("wants_post")).distinct()
    messages = skew_join(messages, there.withColumn("parent", F.col("wanted")), ["wanted", "wants_post"], HOT_SHARE).select(F.lit("message").alias("tree"), "node", "parent")
    place = read_table(spark, sf, "place")
    places = place.where(given(F.col("ispartof"))).groupBy(F.col("id").alias("node")).agg(F.min("ispartof").alias("wanted"))
    known = place.select(F.col("id").alias("wanted")).distinct().withColumn("parent", F.col("wanted"))
    places = places.join(known, "wanted", "left").select(F.lit("place").alias("tree"), "node", "parent")
    return messages.unionByName(places)


def resolved_trees(spark: SparkSession, sf: str, with_path: bool = False, **limits: int) -> DataFrame:
    links = Scratch(spark, "links").write(tree_links(spark, sf), "links")  # read twice: roots and forest
    forest = resolve_forest(links.where("parent is not null"), with_path, **limits)
    path = [F.array("node").alias("path")] if with_path else []
    alone = links.where("parent is null").select("tree", "node", F.col("node").alias("root"), F.lit(0).alias("depth"), *path)
    return forest.nodes.unionByName(alone)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return resolved_trees(spark, sf, core_rows=CORE_ROWS).select(F.col("tree").alias("tree_name"), F.col("node").alias("node_id"), F.col("root").alias("root_id"), F.col("depth").cast("bigint").alias("depth"))


def p5_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """As ``p5_found``, with the rounds of the contraction distributed down to the last thousand links."""
    return resolved_trees(spark, sf, core_rows=1000).select(F.col("tree").alias("tree_name"), F.col("node").alias("node_id"), F.col("root").alias("root_id"), F.col("depth").cast("bigint").alias("depth"))


def p5_paths(spark: SparkSession, sf: str) -> DataFrame:
    """The path from the root of every node of ``p5_found``, ids joined by slashes; null on and below circles."""
    return resolved_trees(spark, sf, with_path=True).select(
        F.col("tree").alias("tree_name"), F.col("node").alias("node_id"), F.array_join(F.col("path").cast("array<string>"), "/").alias("path")
    )


def p5_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of a node and a proper descendant, with their distance."""
    return descendants(resolved_trees(spark, sf, with_path=True)).select(
        F.col("tree").alias("tree_name"), F.col("ancestor").alias("node_id"), F.col("node").alias("descendant_id"), F.col("distance").cast("bigint").alias("distance")
    )


def p5_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """The descendants of every node, roots too, as one interval a node: they are the nodes of its tree that are entered between ``enter`` and ``leave``."""
    nodes = preorder(tree_links(spark, sf)).nodes
    return nodes.select(
        F.col("tree").alias("tree_name"), F.col("node").alias("node_id"), F.col("root").alias("root_id"), F.col("enter").cast("bigint").alias("enter"), F.col("leave").cast("bigint").alias("leave")
    )


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p2_found, p2_keys, p2_named, p4_found, p5_found, p5_rounds, p5_paths, p5_descendants, p5_intervals)}
