"""Reads for all persons at once.

The reads of ``complex_reads`` serve one person each. Where the answer is
wanted for everybody these compute it in one plan: the person is a column that
is carried along, and the limit holds within each person. Rows that can't be
among anybody's first are cut before the wide join: of every author only the
latest ``limit`` messages can be among a reader's latest ``limit``, and lists go
from hop to hop, so their number follows the friendships, not the pairs of
friends of friends. Persons with a large share of the friendships, and messages
with one of the likes or replies, meet their rows by broadcast or over salts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gregaria.graph import HOT_SHARE, Graph
from gregaria.operators.relational import arg_max
from gregaria.operators.skew import copied_to_salts, heavy_candidates, salted, skew_join
from gregaria.sources.scratch import Scratch

SALTS = 32
asc, desc = (lambda c: F.col(c).asc()), (lambda c: F.col(c).desc())


def first_of_each(rows: DataFrame, key: str, order: Sequence[Column], limit: int) -> DataFrame:
    """The first ``limit`` rows of each key with ``rank``; a group limit runs before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order)).cast("bigint")).where(F.col("rank") <= limit)


def near(g: Graph) -> DataFrame:
    """``reader, id``: everyone with the persons one step away, but themselves."""
    return g.knows.where("p1 <> p2").select(F.col("p1").alias("reader"), F.col("p2").alias("id")).distinct()


def _two_steps(one: DataFrame, friends: DataFrame) -> DataFrame:
    """The rows of ``friends`` (``reader, id`` and more), of those one step away, for the reader; the reader is left out.

    Pairs by way of somebody with a large share of the friendships are made over
    salts: the readers are dealt out to them, the friends copied to each.
    """
    to, onward = one.select("reader", F.col("id").alias("p1")), friends.withColumnRenamed("reader", "p1")
    hubs = heavy_candidates(to, "p1", HOT_SHARE).select("p1")
    return salted(to, hubs, "p1", F.col("reader"), SALTS).join(copied_to_salts(onward, hubs, "p1", SALTS), ["p1", "salt"]).where("reader <> id").select(friends.columns)


def circles(g: Graph, hops: int) -> DataFrame:
    """``reader, id``: everyone with the persons within one or two steps, without themselves."""
    one = near(g)
    return one if hops == 1 else one.unionByName(_two_steps(one, one)).distinct()


def _latest() -> list[Column]:
    return [desc("creation_ms"), asc("message_id")]


def _listed(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """``key`` and its first ``limit`` messages as one list."""
    first = first_of_each(rows, key, _latest(), limit)
    return first.groupBy(key).agg(F.collect_list(F.struct("person_id", "message_id", "is_post", "creation_ms")).alias("messages"))


def _passed_on(friends: DataFrame, lists: DataFrame) -> DataFrame:
    """The messages listed under each friend, a row each, for the reader; one's own are left out."""
    rows = skew_join(friends, lists, "id", HOT_SHARE).where("messages is not null")
    return rows.select("reader", F.inline("messages")).where("reader <> person_id")


def latest_messages(g: Graph, hops: int, before_ms: int, limit: int) -> DataFrame:
    """Everyone's latest messages by others within ``hops`` steps, before a time (``ic2`` and ``ic9`` for all).

    A friend passes on twice the limit, of each author no more than the limit:
    if those of the reader are left out, enough are left.
    """
    messages = g.message.where(F.col("creation_ms") < before_ms).select(F.col("creator_id").alias("id"), F.col("creator_id").alias("person_id"), F.col("id").alias("message_id"), "is_post", "creation_ms")
    own, friends = _listed(messages.where("id is not null"), "id", limit), near(g)
    found = _passed_on(friends, own)
    if hops > 1:
        handed = _listed(found.withColumnRenamed("reader", "id"), "id", 2 * limit)
        found = found.unionByName(_passed_on(friends, handed)).distinct()
    return first_of_each(found.drop("is_post"), "reader", _latest(), limit)


def _by_forum() -> list[Column]:
    return [F.col("forum_id").asc_nulls_last()]


def _lowest_forums(passed: DataFrame, hubs: DataFrame, limit: int, keep: int) -> DataFrame:
    """``reader, bound, listed``: the first ``keep`` forums of what is ``passed`` (``reader, id, forums``) to each reader.

    ``listed`` has each forum with the one ``id`` that it came by, null if by
    several; ``bound`` is the forum at ``limit``. Lists travel whole, and are
    taken apart behind the shuffle; those for ``hubs`` before it, where each
    task keeps no more than the first.
    """

    def merged(part: DataFrame) -> DataFrame:
        each = part.select("reader", "id", F.explode("forums").alias("forum_id"))
        known = each.groupBy("reader", "forum_id").agg(F.min("id").alias("least"), F.max("id").alias("most"))
        first = first_of_each(known.selectExpr("reader", "forum_id", "if(least = most, least, null) as only"), "reader", _by_forum(), keep)
        return first.groupBy("reader").agg(F.max(F.when(F.col("rank") == limit, F.col("forum_id"))).alias("bound"), F.collect_list(F.struct("forum_id", "only")).alias("listed"))

    hubs = F.broadcast(hubs)
    return merged(passed.join(hubs, "reader", "left_anti").repartition("reader")).unionByName(merged(passed.join(hubs, "reader", "left_semi")))


def new_forums(g: Graph, min_ms: int, limit: int) -> DataFrame:
    """Everyone's forums by the posts of members within two steps who joined after a time (``ic5`` for all).

    Pairs are made with members who posted only. Forums without their posts come
    last and by id, so of these the first ``limit`` of everyone are enough, and
    lists of them go from hop to hop: a member passes on ``limit``, a friend
    twice as many, of which no more than the reader's own can be left out.
    """
    scratch = Scratch(g.spark, "forums")
    g._held.append(scratch)
    one = scratch.write(near(g), "near")
    joined = g.member_posts.where((F.col("join_ms") > min_ms) & F.col("person_id").isNotNull()).groupBy(F.col("person_id").alias("id"), "forum_id").agg(F.sum("posts").alias("posts"))
    joined = scratch.write(joined, "joined")
    scratch.settle()
    hubs = heavy_candidates(one, "reader", HOT_SHARE).select("reader")

    own = first_of_each(joined.select("id", "forum_id"), "id", _by_forum(), limit).groupBy("id").agg(F.collect_list(F.struct("forum_id")).alias("forums"))
    passed = skew_join(one, own.select("id", F.col("forums.forum_id").alias("forums")), "id", HOT_SHARE).where("forums is not null")
    lists = scratch.write(_lowest_forums(passed, hubs, limit, 2 * limit), "lists")
    scratch.settle()
    asked = skew_join(one, lists.select("reader", "bound"), "reader", HOT_SHARE)
    handed = skew_join(asked, lists.select(F.col("reader").alias("id"), "listed"), "id", HOT_SHARE).where("listed is not null")
    of_others = "filter(listed, x -> (x.only is null or x.only <> reader) and (bound is null or x.forum_id <= bound)).forum_id as forums"
    handed = handed.unionByName(lists.withColumn("id", F.lit(None).cast("bigint"))).selectExpr("reader", "cast(null as bigint) as id", of_others)
    without = scratch.write(_lowest_forums(handed, hubs, limit, limit).select("reader", F.col("listed.forum_id").alias("forums")), "without")
    scratch.settle()

    wrote = joined.where("posts > 0").groupBy("id").agg(F.collect_list(F.struct("forum_id", "posts")).alias("wrote"))
    authors = skew_join(one, wrote, "id", HOT_SHARE).where("wrote is not null")
    posts = authors.unionByName(_two_steps(one, authors)).select("reader", "id", F.inline("wrote")).distinct()
    order = [desc("post_count"), *_by_forum()]
    counts = first_of_each(posts.groupBy("reader", "forum_id").agg(F.sum("posts").alias("post_count")), "reader", order, limit).drop("rank")
    rows = counts.unionByName(without.select("reader", F.explode("forums").alias("forum_id"), F.lit(0).cast("bigint").alias("post_count")))
    return first_of_each(rows.repartition("reader").groupBy("reader", "forum_id").agg(F.sum("post_count").alias("post_count")), "reader", order, limit)


def latest_likers(g: Graph, limit: int) -> DataFrame:
    """Everyone's latest likers with each one's latest like (``ic7`` for all)."""
    sent = g.message_home.select(F.col("id").alias("message_id"), "is_post", F.col("creator_id").alias("reader")).dropDuplicates(["message_id", "is_post"])
    likes = g.likes.select("person_id", "message_id", "is_post", F.col("creation_ms").alias("like_ms"))
    liked = skew_join(likes, sent, ["message_id", "is_post"], HOT_SHARE).where("reader is not null")
    latest = arg_max(liked, ["reader", "person_id"], [desc("like_ms"), asc("message_id")])
    return first_of_each(latest, "reader", [desc("like_ms"), asc("person_id")], limit).select("reader", "person_id", "message_id", "like_ms", "rank")


def latest_replies(g: Graph, limit: int) -> DataFrame:
    """Everyone's latest direct replies (``ic8`` for all)."""
    answered = g.message_home.select(F.col("id").alias("parent_id"), F.col("is_post").alias("parent_is_post"), F.col("creator_id").alias("reader")).dropDuplicates(["parent_id", "parent_is_post"])
    replies = g.replies.select(F.col("creator_id").alias("person_id"), F.col("creation_ms").alias("comment_ms"), F.col("id").alias("comment_id"), "parent_id", "parent_is_post")
    rows = skew_join(replies, answered, ["parent_id", "parent_is_post"], HOT_SHARE).where("reader is not null").drop("parent_id", "parent_is_post")
    return first_of_each(rows, "reader", [desc("comment_ms"), asc("comment_id")], limit)
