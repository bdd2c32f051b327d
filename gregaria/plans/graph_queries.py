"""Every graph operator, read and update as a query over the mapped graph of a data directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gregaria.graph import Graph
from gregaria.operators import relational, traversal
from gregaria.plans import batch_reads as b
from gregaria.plans import complex_reads as c
from gregaria.plans import short_reads as s
from gregaria.plans.updates import REQUESTS, apply_updates
from gregaria.schema import BASE
from gregaria.sources import snapshot
from gregaria.sources.csv_graph import load_csv, write_csv
from gregaria.sources.mapped import load_mapped
from gregaria.sources.scratch import Scratch

PERSON = 1
FAR_PERSON = 73
_MAPPED: dict[tuple[str, str], tuple[Graph, Scratch]] = {}
_UNSTORED: dict[tuple[str, str], Graph] = {}
_DELIMITED: dict[tuple[str, str], tuple[Graph, Scratch]] = {}
_UPDATED: dict[tuple[str, str], tuple[Graph, Scratch]] = {}


def mapped(spark: SparkSession, directory: str) -> Graph:
    """The mapped graph, stored once a session in the shared folder, clustered for point reads."""
    key = (spark.sparkContext.applicationId, directory)
    if key not in _MAPPED:
        scratch = Scratch(spark, "mapped")
        _MAPPED[key] = snapshot.open_or_build(spark, scratch.root, lambda: load_mapped(spark, directory)), scratch
    return _MAPPED[key][0]


def unstored(spark: SparkSession, directory: str) -> Graph:
    """The mapped graph for a query that reads a few of its tables once: stored if the session has it so, else only its plans."""
    key = (spark.sparkContext.applicationId, directory)
    if key in _MAPPED:
        return _MAPPED[key][0]
    if key not in _UNSTORED:
        _UNSTORED[key] = load_mapped(spark, directory)
    return _UNSTORED[key]


def delimited(spark: SparkSession, directory: str) -> Graph:
    """The mapped graph, written as delimited files once a session and loaded from them."""
    key = (spark.sparkContext.applicationId, directory)
    if key not in _DELIMITED:
        scratch = Scratch(spark, "delimited")
        write_csv(mapped(spark, directory), scratch.root)
        _DELIMITED[key] = load_csv(spark, scratch.root), scratch
    return _DELIMITED[key][0]


def _ms(day: str) -> int:
    import datetime

    return int(datetime.datetime.fromisoformat(day).replace(tzinfo=datetime.UTC).timestamp() * 1000)


def flat(df: DataFrame) -> DataFrame:
    """Arrays as text, joined by bars."""
    return df.select(*(F.array_join(F.col(f.name).cast("array<string>"), "|").alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f.name) for f in df.schema))


def _requests(spark: SparkSession, rows: DataFrame, kind: str) -> DataFrame:
    """``rows`` in the columns of a request; lacking ones are null."""
    empty = spark.createDataFrame([], REQUESTS[kind])
    return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema))


NEW = 1_000_000
NOW_MS = 1_800_000_000_000


def _iu1(spark: SparkSession, g: Graph) -> DataFrame:
    """New persons after every known one, and every known one again, which does nothing."""
    again = g.person.selectExpr("id as person_id", "'again' as first_name", "last_name", "gender", "creation_ms", "city_id", "languages", "array(id % 64, 999999) as tag_ids")
    new = g.person.selectExpr(f"id + {NEW} as person_id", "'new' as first_name", "last_name", "gender", "creation_ms", "city_id + id % 2 * 500 as city_id", "array('z', 'a') as languages", "array(id % 64, 999999) as tag_ids")
    after = apply_updates(g, {"iu1": _requests(spark, new.unionByName(again), "iu1")})
    interests = after.person_interest.groupBy(F.col("person_id").alias("id")).agg(F.count(F.lit(1)).alias("n_interests"))
    return flat(after.person.select("id", "first_name", "last_name", "city_id", "languages").join(interests, "id", "left").fillna(0, ["n_interests"]))


def _iu2(spark: SparkSession, g: Graph) -> DataFrame:
    rows = g.person.selectExpr("id as person_id", "id * 3 as post_id", f"{NOW_MS} + id as creation_ms")
    return apply_updates(g, {"iu2": _requests(spark, rows, "iu2")}).likes


def _iu3(spark: SparkSession, g: Graph) -> DataFrame:
    rows = g.person.selectExpr("id as person_id", "10000000 + id * 20 as comment_id", f"{NOW_MS} + id as creation_ms")
    return apply_updates(g, {"iu3": _requests(spark, rows, "iu3")}).likes


def _iu4(spark: SparkSession, g: Graph) -> DataFrame:
    rows = g.forum.selectExpr(f"id + {NEW} * (id % 2) as forum_id", "'new' as title", "creation_ms", "moderator_id * 17 as person_id")
    return apply_updates(g, {"iu4": _requests(spark, rows, "iu4")}).forum


def _iu5(spark: SparkSession, g: Graph) -> DataFrame:
    rows = g.person.selectExpr("id as person_id", "id % 13 as forum_id", f"{NOW_MS} + id as creation_ms")
    return apply_updates(g, {"iu5": _requests(spark, rows, "iu5")}).member_posts


def _iu6(spark: SparkSession, g: Graph) -> DataFrame:
    rows = g.post.selectExpr(f"id + {NEW} * 20 as post_id", "content", f"{NOW_MS} as creation_ms", "creator_id as person_id", "forum_id", "country_id")
    return apply_updates(g, {"iu6": _requests(spark, rows, "iu6")}).member_posts


def _iu7(spark: SparkSession, g: Graph) -> DataFrame:
    """Every comment once more, below the post or the copy of the comment that it answers."""
    rows = g.comment.selectExpr(
        f"id + {NEW} * 20 as comment_id", "content", f"{NOW_MS} as creation_ms", "creator_id as person_id", "country_id", "reply_of_post as post_id", f"reply_of_comment + {NEW} * 20 as reply_comment_id"
    )
    return apply_updates(g, {"iu7": _requests(spark, rows, "iu7")}).friends


def _iu8(spark: SparkSession, g: Graph) -> DataFrame:
    rows = g.person.selectExpr("id as person_id", "id + 1 as person2_id", f"{NOW_MS} + id as creation_ms")
    return apply_updates(g, {"iu8": _requests(spark, rows, "iu8")}).friends


def _full_batch(spark: SparkSession, g: Graph) -> Graph:
    """One batch of all kinds with tags, schools and firms: for each person, forum, post and comment a further one that refers to the others.

    A further comment answers what its pattern answers, or the further one of it.
    """
    tags = lambda key: f"array({key} % 64, {key} * 5 % 64, 999999) as tag_ids"
    jobs = lambda n, year: f"array(named_struct('org_id', id % {n}, 'year', cast({year} + id % 5 as int)), named_struct('org_id', 99999999, 'year', 1))"
    rows = {
        "iu1": g.person.selectExpr(f"id + {NEW} as person_id", "first_name", "last_name", "gender", "birthday", "creation_ms", "location_ip", "browser_used", "city_id", "languages", "emails", tags("id"), f"{jobs(7, 2000)} as study_at", f"{jobs(11, 1990)} as work_at"),
        "iu2": g.post.selectExpr(f"creator_id + {NEW} as person_id", f"id + {20 * NEW} as post_id", "creation_ms"),
        "iu3": g.comment.selectExpr(f"creator_id + {NEW} as person_id", "id as comment_id", "creation_ms"),
        "iu4": g.forum.selectExpr(f"id + {NEW} as forum_id", "title", "creation_ms", f"moderator_id + {NEW} as person_id", tags("id")),
        "iu5": g.forum_member.selectExpr(f"person_id + {NEW} as person_id", f"forum_id + {NEW} as forum_id", "join_ms as creation_ms"),
        "iu6": g.post.selectExpr(f"id + {20 * NEW} as post_id", "image_file", "creation_ms", "content", f"creator_id + {NEW} as person_id", f"forum_id + {NEW} as forum_id", "country_id", tags("id")),
        "iu7": g.comment.selectExpr(f"id + {20 * NEW} as comment_id", "creation_ms", "content", f"creator_id + {NEW} as person_id", "country_id", f"reply_of_post + {20 * NEW} as post_id", f"reply_of_comment + {20 * NEW} as reply_comment_id", tags("id")),
        "iu8": g.knows.where("p1 < p2").selectExpr(f"p1 + {NEW} as person_id", f"p2 + {NEW} as person2_id", "creation_ms"),
    }
    return apply_updates(g, {kind: _requests(spark, requests, kind) for kind, requests in rows.items()})


def updated(spark: SparkSession, directory: str) -> Graph:
    """The mapped graph after ``_full_batch``, stored as a further version of its own once a session."""
    key = (spark.sparkContext.applicationId, directory)
    if key not in _UPDATED:
        scratch = Scratch(spark, "updated")
        batch = _full_batch(spark, snapshot.open_or_build(spark, scratch.root, lambda: mapped(spark, directory)))
        _UPDATED[key] = snapshot.append(batch, scratch.root), scratch
        batch.release()
    return _UPDATED[key][0]


def _closure(spark: SparkSession, g: Graph) -> DataFrame:
    return c.tags_below(g, "Len4").join(g.tag.select(F.col("id").alias("tag_id"), "name"), "tag_id")


def _levels(g: Graph) -> DataFrame:
    return traversal.bfs_levels(g.knows, PERSON, 3)


PLANS: dict[str, Callable[[SparkSession, Graph], DataFrame]] = {
    "ic1": lambda x, g: flat(c.ic1(g, PERSON, "BUILDING")),
    "ic2": lambda x, g: c.ic2(g, PERSON, _ms("2000-01-01")),
    "ic3": lambda x, g: c.ic3(g, PERSON, "AFRICA", "AMERICA", _ms("1995-01-01"), 3000),
    "ic4": lambda x, g: c.ic4(g, PERSON, _ms("1996-06-01"), 214),
    "ic5": lambda x, g: c.ic5(g, PERSON, _ms("1998-01-01")),
    "ic6": lambda x, g: c.ic6(g, PERSON, "blue ring"),
    "ic7": lambda x, g: c.ic7(g, PERSON),
    "ic8": lambda x, g: c.ic8(g, PERSON),
    "ic9": lambda x, g: c.ic9(g, PERSON, _ms("2000-01-01")),
    "ic10": lambda x, g: c.ic10(g, PERSON, 5),
    "ic11": lambda x, g: c.ic11(g, PERSON, "AMERICA", 1999),
    "ic12": lambda x, g: flat(c.ic12(g, PERSON, "Len4")),
    "ic13": lambda x, g: c.ic13(g, PERSON, FAR_PERSON),
    "ic14": lambda x, g: flat(c.ic14(g, PERSON, FAR_PERSON)),
    "is1": lambda x, g: s.is1(g, PERSON),
    "is2": lambda x, g: s.is2(g, PERSON),
    "is3": lambda x, g: s.is3(g, PERSON),
    "is4": lambda x, g: s.is4(g, 10),
    "is5": lambda x, g: s.is5(g, 10_000_017),
    "is6": lambda x, g: s.is6(g, 10_000_017),
    "is7": lambda x, g: s.is7(g, 3),
    "iu1": _iu1, "iu2": _iu2, "iu3": _iu3, "iu4": _iu4, "iu5": _iu5, "iu6": _iu6, "iu7": _iu7, "iu8": _iu8,
    "multihop_1": lambda x, g: traversal.multihop(g.knows, PERSON, 1),
    "multihop_2": lambda x, g: traversal.multihop(g.knows, PERSON, 2),
    "ring_2": lambda x, g: traversal.ring(g.knows, PERSON, 2),
    "bfs_levels_3": lambda x, g: _levels(g),
    "tagclass_closure": _closure,
    "reply_root": lambda x, g: g.message_root,
    "shortest_path": lambda x, g: x.createDataFrame([(PERSON, p, traversal.shortest_path(g.knows, PERSON, p)) for p in (PERSON, 2, FAR_PERSON, -5)], "p1 bigint, p2 bigint, length int"),
    "all_shortest_paths": lambda x, g: flat(traversal.all_shortest_paths(g.friends, PERSON, FAR_PERSON)),
    "member_posts": lambda x, g: g.member_posts,
    "knows_weight": lambda x, g: g.friends,
    "topk": lambda x, g: relational.with_rank(g.post.select("id", "creation_ms"), [F.col("creation_ms").desc(), F.col("id").asc()], 50),
    "semi_join": lambda x, g: relational.semi(g.post.select("id", F.col("creator_id").alias("person_id")), g.person_interest.where("tag_id = 10"), "person_id"),
    "semi_join_whole": lambda x, g: relational.semi(g.post.select("id", F.col("creator_id").alias("person_id")), g.person_interest, "person_id"),
    "anti_join": lambda x, g: relational.anti(g.person.select("id"), g.post.select(F.col("creator_id").alias("id")), "id"),
    "anti_join_untagged": lambda x, g: relational.anti(g.post.select("id"), g.post_tag.select(F.col("post_id").alias("id")), "id"),
    "mark_join": lambda x, g: relational.mark(g.person.select("id"), g.work_at.select(F.col("person_id").alias("id")), "id", "works"),
    "argmax_per_group": lambda x, g: relational.arg_max(g.likes.select("person_id", "message_id", "creation_ms"), ["person_id"], [F.col("creation_ms").desc(), F.col("message_id").asc()]),
    "union_message": lambda x, g: g.message.select("id", "is_post", "creator_id", "creation_ms"),
    "cond_count": lambda x, g: g.message.groupBy("creator_id").agg(relational.count_if(F.col("country_id") == 1000).alias("x_count"), relational.count_if(F.col("country_id") == 1001).alias("y_count")).where("x_count > 0 and y_count > 0"),
    "collect_sorted": lambda x, g: flat(relational.sorted_lists(g.work_at, "person_id", ["org_id", "work_from"], {"orgs": "org_id", "years": "work_from"})),
    "all_ic2": lambda x, g: b.latest_messages(g, 1, _ms("2000-01-01"), 20),
    "all_ic5": lambda x, g: b.new_forums(g, _ms("1998-01-01"), 20),
    "all_ic7": lambda x, g: b.latest_likers(g, 20),
    "all_ic8": lambda x, g: b.latest_replies(g, 20),
    "all_ic9": lambda x, g: b.latest_messages(g, 2, _ms("2000-01-01"), 20),
    "person_table": lambda x, g: flat(g.person), "place_table": lambda x, g: g.place, "org_table": lambda x, g: g.org, "tag_table": lambda x, g: g.tag,
    "tagclass_table": lambda x, g: g.tagclass, "forum_table": lambda x, g: g.forum, "post_table": lambda x, g: g.post, "comment_table": lambda x, g: g.comment,
    "knows_table": lambda x, g: g.knows, "likes_table": lambda x, g: g.likes, "forum_member_table": lambda x, g: g.forum_member, "post_tag_table": lambda x, g: g.post_tag,
    "comment_tag_table": lambda x, g: g.comment_tag, "forum_tag_table": lambda x, g: g.forum_tag,
    "person_interest_table": lambda x, g: g.person_interest, "study_at_table": lambda x, g: g.study_at, "work_at_table": lambda x, g: g.work_at,
}


def _query(plan: Callable[[SparkSession, Graph], DataFrame], graph: Callable[[SparkSession, str], Graph] = mapped) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, directory: plan(spark, graph(spark, directory))


def _loaded(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, directory: flat(delimited(spark, directory).tables[name])


def _after(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, directory: flat(updated(spark, directory).tables[name])


#: Tables after an update of each kind, by the kinds that change them.
AFTER = {
    "iu1_person": "person", "iu1_interest": "person_interest", "iu1_study": "study_at", "iu1_work": "work_at", "iu2_iu3_likes": "likes", "iu4_forum": "forum", "iu4_tags": "forum_tag",
    "iu5_members": "forum_member", "iu6_posts": "post", "iu6_tags": "post_tag", "iu5_iu6_member_posts": "member_posts", "iu7_comments": "comment", "iu7_tags": "comment_tag",
    "iu6_iu7_roots": "message_root", "iu6_iu7_homes": "message_home", "iu7_replies": "replies", "iu8_knows": "knows", "iu7_iu8_friends": "friends",
}
#: Queries that read few tables, each once, and for which the disk of a stored graph is wanted.
UNSTORED = {"all_ic5"}
QUERIES = (
    {name: _query(plan, unstored if name in UNSTORED else mapped) for name, plan in PLANS.items()} | {f"csv_{name}": _loaded(name) for name in BASE} | {name: _after(table) for name, table in AFTER.items()}
)
