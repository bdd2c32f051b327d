"""A social graph mapped from relational order tables, one rule a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gregaria.functions.values import ms_of_timestamp
from gregaria.graph import Graph
from gregaria.schema import BASE
from gregaria.sources.scratch import Scratch
from gregaria.sources.tables import read_table

COMMENT_BASE = 10_000_000
COUNTRY_BASE = 1000
FIRST_MS = 1_262_304_000_000  # 2010-01-01


def _shaped(df: DataFrame, name: str) -> DataFrame:
    """In the schema's columns and types; columns that the source lacks are null."""
    columns = []
    for part in BASE[name].split(", "):
        column, kind = part.split(" ", 1)
        columns.append((F.col(column) if column in df.columns else F.lit(None)).cast(kind).alias(column))
    return df.select(*columns)


def numbered(values: DataFrame, column: str, name: str, scratch: Scratch) -> DataFrame:
    """Distinct values with their number in order, from 0: numbered within ranges, which then are shifted by the sizes of those before."""
    ranges = values.repartitionByRange(column).withColumn("_range", F.spark_partition_id())
    ranges = scratch.write(ranges, f"ranges_{name}")
    sizes = sorted(ranges.groupBy("_range").count().collect())  # a row a partition
    before = {r: sum(n for _, n in sizes[:i]) for i, (r, n) in enumerate(sizes)}
    shift = F.create_map(*(F.lit(x).cast("bigint") for pair in before.items() for x in pair)) if before else F.lit(None).cast("map<bigint,bigint>")
    within = F.row_number().over(W.partitionBy("_range").orderBy(column)) - 1
    return ranges.select(column, (within + shift[F.col("_range").cast("bigint")]).alias(name))


def load_mapped(spark: SparkSession, directory: str) -> Graph:
    """The graph of ``customer, supplier, part, orders, lineitem, nation, region, events`` below ``directory``."""
    region, nation, customer, supplier, part, orders, lineitem, events = (
        read_table(spark, directory, t) for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
    )
    person = customer.selectExpr(
        "c_custkey as id", "c_mktsegment as first_name", "c_name as last_name", "if(c_custkey % 2 = 0, 'male', 'female') as gender",
        "date_add(DATE'1980-01-01', cast(c_custkey * 37 % 7300 as int)) as birthday", f"{FIRST_MS} + c_custkey * 60000 as creation_ms",
        "concat('10.0.', c_custkey % 256, '.1') as location_ip", "if(c_custkey % 3 = 0, 'Firefox', 'Chrome') as browser_used", "c_nationkey as city_id",
        "array('en', concat('l', c_custkey % 7)) as languages", "array(concat('c', c_custkey, '@mail.example')) as emails",
    )
    place = nation.selectExpr("n_nationkey as id", "n_name as name", "'city' as type", f"{COUNTRY_BASE} + n_regionkey as part_of").unionByName(
        region.selectExpr(f"{COUNTRY_BASE} + r_regionkey as id", "r_name as name", "'country' as type", "cast(null as int) as part_of")
    )
    org = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).selectExpr(
        "s_suppkey as id", "if(s_suppkey % 2 = 0, 'company', 'university') as type", "s_name as name", f"{COUNTRY_BASE} + n_regionkey as place_id"
    )
    scratch = Scratch(spark, "mapping")
    names = part.select("p_name").where("p_name is not null").distinct()
    named = scratch.write(numbered(names, "p_name", "tag_id", scratch).withColumn("noun", F.split_part("p_name", F.lit(" "), F.lit(2))), "named")
    nouns = named.select("noun").distinct()
    chain = nouns.selectExpr("noun as name", "concat('Len', length(noun)) as parent").unionByName(nouns.selectExpr("concat('Len', length(noun)) as name", "'Product' as parent").distinct())
    chain = chain.unionByName(nouns.selectExpr("'Product' as name", "cast(null as string) as parent").distinct())
    classes = chain.join(numbered(chain.select("name").distinct(), "name", "id", scratch), "name").select("name", "parent", "id")
    tagclass = classes.join(classes.select(F.col("name").alias("parent"), F.col("id").alias("parent_id")), "parent", "left").select("id", "name", "parent_id")
    tag = named.join(classes.select(F.col("name").alias("noun"), F.col("id").alias("class_id")), "noun").selectExpr("tag_id as id", "p_name as name", "class_id")
    forum = supplier.selectExpr("s_suppkey as id", "s_name as title", f"{FIRST_MS} + s_suppkey * 60000 as creation_ms", "s_suppkey as moderator_id")

    customers = customer.select(F.col("c_custkey").alias("l_partkey"))
    by_person = lineitem.join(customers, "l_partkey", "left_semi").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")
    by_person = scratch.write(by_person, "by_person")  # six tables are made of it
    shipped = ms_of_timestamp("l_shipdate")
    forums = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_suppkey").alias("forum_id"))
    post = orders.join(forums, "o_orderkey", "left").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("creator_id"), ms_of_timestamp("o_orderdate").alias("creation_ms"),
        F.coalesce("forum_id", F.lit(0)).alias("forum_id"), F.expr(f"{COUNTRY_BASE} + o_orderkey % 5").alias("country_id"),
        F.expr("if(o_orderkey % 10 = 0, '', o_orderpriority)").alias("content"), F.expr("if(o_orderkey % 10 = 0, concat('photo', o_orderkey, '.jpg'), null)").alias("image_file"),
    )
    tagged = part.join(named, "p_name").select(F.col("p_partkey").alias("l_partkey"), "tag_id")
    post_tag = lineitem.join(tagged, "l_partkey").select(F.col("l_orderkey").alias("post_id"), "tag_id").distinct()
    first_lines = by_person.where("l_linenumber = 1")
    writers = first_lines.groupBy(F.col("l_orderkey").alias("event_id")).agg(F.min("l_partkey").alias("writer"))
    comment = events.join(writers, "event_id", "left").select(
        F.expr(f"{COMMENT_BASE} + event_id").alias("id"), F.coalesce("writer", "user_id").alias("creator_id"), ms_of_timestamp("ts").alias("creation_ms"),
        F.expr(f"{COUNTRY_BASE} + event_id % 5").alias("country_id"), F.expr("if(event_id % 3 <> 2, event_id - event_id % 3, null)").alias("reply_of_post"),
        F.expr(f"if(event_id % 3 = 2, {COMMENT_BASE} + event_id div 2, null)").alias("reply_of_comment"), F.expr("concat(event_type, ' ', props)").alias("content"),
    )
    met = first_lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).where("o_custkey <> l_partkey")
    pairs = met.groupBy(F.least("o_custkey", "l_partkey").alias("a"), F.greatest("o_custkey", "l_partkey").alias("b")).agg(F.min(shipped).alias("creation_ms"))
    knows = pairs.selectExpr("a as p1", "b as p2", "creation_ms").unionByName(pairs.selectExpr("b as p1", "a as p2", "creation_ms"))
    liked = by_person.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate >= o_orderdate")
    likes = liked.groupBy(F.col("l_partkey").alias("person_id"), F.col("l_orderkey").alias("message_id")).agg(F.min(shipped).alias("creation_ms")).withColumn("is_post", F.lit(True))
    member = by_person.groupBy(F.col("l_suppkey").alias("forum_id"), F.col("l_partkey").alias("person_id")).agg(F.min(shipped).alias("join_ms"))
    years = lambda line, year: by_person.where(f"l_linenumber = {line}").groupBy(F.col("l_partkey").alias("person_id"), F.col("l_suppkey").alias("org_id")).agg(F.min(F.year("l_shipdate")).alias(year))
    interest = customer.select(F.col("c_custkey").alias("person_id"), F.explode(F.array_distinct(F.expr("array(c_custkey % 64, (c_custkey * 7 + 3) % 64, (c_custkey * 13 + 5) % 64)"))).alias("tag_id"))
    tables = {
        "person": person, "place": place, "org": org, "tag": tag, "tagclass": tagclass, "forum": forum, "post": post, "comment": comment, "knows": knows,
        "likes": likes, "forum_member": member, "person_interest": interest.join(tag.select(F.col("id").alias("tag_id")), "tag_id", "left_semi"),
        "post_tag": post_tag, "study_at": years(3, "class_year"), "work_at": years(2, "work_from"),
        "comment_tag": events.selectExpr(f"{COMMENT_BASE} + event_id as comment_id", "event_id * 7 % 64 as tag_id").join(tag.select(F.col("id").alias("tag_id")), "tag_id", "left_semi"),
        "forum_tag": supplier.selectExpr("s_suppkey as forum_id", "s_suppkey * 3 % 64 as tag_id").join(tag.select(F.col("id").alias("tag_id")), "tag_id", "left_semi"),
    }
    return Graph(spark, {name: _shaped(df, name) for name, df in tables.items()}, _held=[scratch])
