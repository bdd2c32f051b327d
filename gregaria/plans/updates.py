"""The eight insert-only updates, applied as a batch.

``apply_updates`` takes a table of requests for each kind and returns a new
graph; the old one stays as it is. Within a batch the kinds are applied in the
order of their dependence, and comments that answer comments of the same batch
in any depth. Requests whose referents are missing, and repeated ids, do
nothing. Friendships, memberships and likes are upserts: the latest time wins,
within a batch and against what is stored; at equal times what is stored stays.

Accepted rows are written once and gathered in ``Graph.changes``. Where the
graph holds its derived tables (posts of a member, weight of a friendship, thread
roots, places of messages, replies) they are changed by what the batch adds to
them; rows of the stored tables are read by the keys that the batch touches.
Else they are derived from the base as always.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gregaria.functions.values import reply_weight
from gregaria.graph import HOT_SHARE, Graph, direct_replies, member_posts
from gregaria.operators import relational
from gregaria.operators.hierarchy import resolve_forest
from gregaria.operators.relational import Few, anti, arg_max, semi
from gregaria.operators.skew import skew_join
from gregaria.schema import BASE, CLUSTER, DERIVED, REPLACED
from gregaria.sources.scratch import Scratch

_JOBS = "array<struct<org_id:bigint,year:int>>"
REQUESTS = {
    "iu1": "person_id bigint, first_name string, last_name string, gender string, birthday date, creation_ms bigint, location_ip string, browser_used string, city_id bigint, languages array<string>, emails array<string>, tag_ids array<bigint>, "
    f"study_at {_JOBS}, work_at {_JOBS}",
    "iu2": "person_id bigint, post_id bigint, creation_ms bigint",
    "iu3": "person_id bigint, comment_id bigint, creation_ms bigint",
    "iu4": "forum_id bigint, title string, creation_ms bigint, person_id bigint, tag_ids array<bigint>",
    "iu5": "person_id bigint, forum_id bigint, creation_ms bigint",
    "iu6": "post_id bigint, image_file string, creation_ms bigint, location_ip string, browser_used string, language string, content string, person_id bigint, forum_id bigint, country_id bigint, tag_ids array<bigint>",
    "iu7": "comment_id bigint, creation_ms bigint, location_ip string, browser_used string, content string, person_id bigint, country_id bigint, post_id bigint, reply_comment_id bigint, tag_ids array<bigint>",
    "iu8": "person_id bigint, person2_id bigint, creation_ms bigint",
}


def _ids(table: DataFrame, name: str) -> DataFrame:
    return table.select(F.col("id").alias(name))


def _fresh(requests: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """Requests for new ids, the earliest of each id."""
    order = [F.col("creation_ms").asc_nulls_last(), *(F.col(c) for c in requests.columns if c not in (key, "creation_ms"))]
    return arg_max(anti(requests.where(F.col(key).isNotNull()), _ids(table, key), key), [key], order)


def _kept(g: Graph, rows: DataFrame) -> DataFrame:
    """Accepted requests as a written table: several tables are made of them, and reads of those need not accept them again."""
    scratch = Scratch(rows.sparkSession, "accepted")
    g._held.append(scratch)
    return scratch.write(rows, "rows")


def _few(g: Graph, rows: DataFrame) -> Few:
    """Rows of keys and numbers, as literals if there are few, else as a written table."""
    few = Few.of(rows)
    return few if few.table is not None else Few(_kept(g, rows), None)


def _with(g: Graph, name: str, table: DataFrame, changes: DataFrame) -> Graph:
    """``g`` with another table; base tables replace what would be derived from them, but for derived tables that are held."""
    return Graph(g.spark, g.tables | {name: table}, g.changes | {name: changes}, g.origin, g._held)


def _shaped(name: str, rows: DataFrame) -> DataFrame:
    kinds = [part.split(" ", 1) for part in (BASE | DERIVED)[name].split(", ")]
    return rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds))


def _append(g: Graph, name: str, rows: DataFrame) -> Graph:
    if name not in g.tables:
        return g
    shaped = _shaped(name, rows)
    return _with(g, name, g.tables[name].unionByName(shaped), g.changes[name].unionByName(shaped) if name in g.changes else shaped)


def _replace(g: Graph, name: str, few: Few) -> Graph:
    """The rows of ``few``, at most one a key, in place of those of the same keys."""
    keys = REPLACED[name]
    shaped = _shaped(name, few.rows)
    touched = shaped.select(*keys)
    touched = touched if few.table is None else F.broadcast(touched)
    without = lambda table: table.join(touched, keys, "left_anti").unionByName(shaped)
    return _with(g, name, without(g.tables[name]), without(g.changes[name]) if name in g.changes else shaped)


def _stored(g: Graph, name: str, few: Few) -> DataFrame:
    """The rows of a table with the keys of ``few``."""
    on = REPLACED[name]
    first = CLUSTER[name] if CLUSTER[name] in on else on[0]
    keys = few.rows.select(*on).distinct()
    return semi(few.semi(g.tables[name], first, first), keys if few.table is None else F.broadcast(keys), on)


def _upsert(g: Graph, name: str, rows: DataFrame, at: str) -> tuple[Graph, Few]:
    """The graph with ``rows`` that are newer than those of the same key, of several in the batch the latest, and those rows."""
    keys = REPLACED[name]
    columns = [part.split(" ", 1)[0] for part in BASE[name].split(", ")]
    latest = _few(g, arg_max(rows.select(*columns), keys, [F.col(at).desc()]))
    known = _stored(g, name, latest).groupBy(*keys).agg(F.max(at).alias("_known"))
    newer = _few(g, latest.rows.join(known, keys, "left").where(f"_known is null or {at} > _known").drop("_known"))
    return _replace(g, name, newer), newer


def _tagged(g: Graph, name: str, owner: str, rows: DataFrame) -> Graph:
    """The tags of new rows that exist, each once; none for a null list."""
    links = rows.select(owner, F.explode(F.array_distinct("tag_ids")).alias("tag_id"))
    return _append(g, name, semi(links, _ids(g.tag, "tag_id"), "tag_id"))


def add_persons(g: Graph, requests: DataFrame) -> Graph:
    rows = _kept(g, _fresh(requests, "person_id", g.person))
    cities = _ids(g.place, "city_id").distinct().withColumn("known_city", F.col("city_id"))
    new = rows.join(cities, "city_id", "left").select("*", F.col("person_id").alias("id")).withColumns({"languages": F.array_sort("languages"), "city_id": F.col("known_city")})
    out = _tagged(_append(g, "person", new), "person_interest", "person_id", rows)
    for name, year in (("study_at", "class_year"), ("work_at", "work_from")):
        jobs = rows.select("person_id", F.inline(name)).withColumnRenamed("year", year)
        out = _append(out, name, arg_max(semi(jobs, _ids(g.org, "org_id"), "org_id"), ["person_id", "org_id"], [F.col(year).desc()]))
    return out


def _likes(g: Graph, requests: DataFrame, key: str, messages: DataFrame, is_post: bool) -> Graph:
    rows = semi(semi(requests, _ids(g.person, "person_id"), "person_id"), _ids(messages, key), key)
    rows = rows.select("person_id", F.col(key).alias("message_id"), F.lit(is_post).alias("is_post"), "creation_ms")
    return _upsert(g, "likes", rows, "creation_ms")[0]


def like_posts(g: Graph, requests: DataFrame) -> Graph:
    return _likes(g, requests, "post_id", g.post, True)


def like_comments(g: Graph, requests: DataFrame) -> Graph:
    return _likes(g, requests, "comment_id", g.comment, False)


def add_forums(g: Graph, requests: DataFrame) -> Graph:
    rows = _kept(g, semi(_fresh(requests, "forum_id", g.forum), _ids(g.person, "person_id"), "person_id"))
    new = rows.select(F.col("forum_id").alias("id"), "title", "creation_ms", F.col("person_id").alias("moderator_id"))
    return _tagged(_append(g, "forum", new), "forum_tag", "forum_id", rows)


def add_members(g: Graph, requests: DataFrame) -> Graph:
    rows = semi(semi(requests, _ids(g.person, "person_id"), "person_id"), _ids(g.forum, "forum_id"), "forum_id")
    out, newer = _upsert(g, "forum_member", rows.withColumnRenamed("creation_ms", "join_ms"), "join_ms")
    if "member_posts" not in g.tables:
        return out
    return _replace(out, "member_posts", _few(g, member_posts(newer.rows, newer.semi(g.post, "creator_id", "person_id"))))


def add_posts(g: Graph, requests: DataFrame) -> Graph:
    rows = semi(semi(_fresh(requests, "post_id", g.post), _ids(g.person, "person_id"), "person_id"), _ids(g.forum, "forum_id"), "forum_id")
    rows = _kept(g, semi(rows, _ids(g.place, "country_id"), "country_id"))
    new = rows.withColumnsRenamed({"post_id": "id", "person_id": "creator_id"})
    out = _tagged(_append(g, "post", new), "post_tag", "post_id", rows)
    out = _append(out, "message_home", new.select("id", F.lit(True).alias("is_post"), "creator_id"))
    out = _append(out, "message_root", new.select(F.col("id").alias("message_id"), F.lit(True).alias("is_post"), F.col("id").alias("post_id")))
    if "member_posts" not in g.tables:
        return out
    more = _few(g, rows.groupBy("forum_id", "person_id").agg(F.count(F.lit(1)).alias("more")))
    raised = _stored(g, "member_posts", more).join(more.rows, ["forum_id", "person_id"]).withColumn("posts", F.col("posts") + F.col("more"))
    return _replace(out, "member_posts", _few(g, raised.drop("more")))


def add_comments(g: Graph, requests: DataFrame) -> Graph:
    rows = semi(semi(_fresh(requests, "comment_id", g.comment), _ids(g.person, "person_id"), "person_id"), _ids(g.place, "country_id"), "country_id")
    posts = _ids(g.post, "post_id").distinct().withColumn("known_post", F.col("post_id"))
    comments = _ids(g.comment, "reply_comment_id").distinct().withColumn("known_comment", F.col("reply_comment_id"))
    rows = rows.join(posts, "post_id", "left").join(comments, "reply_comment_id", "left")
    batch = rows.select(F.col("comment_id").alias("reply_comment_id"), F.lit(True).alias("in_batch"))
    rows = rows.join(batch, "reply_comment_id", "left")
    anchored = F.col("known_post").isNotNull() | F.col("known_comment").isNotNull()
    links = rows.where(~anchored & F.col("in_batch")).select(F.lit("batch").alias("tree"), F.col("comment_id").alias("node"), F.col("reply_comment_id").alias("parent"))
    forest = resolve_forest(links)
    g._held.append(forest.scratch)
    tops = rows.where(anchored).select("comment_id")
    below = semi(forest.nodes.select(F.col("node").alias("comment_id"), F.col("root")), tops.withColumnRenamed("comment_id", "root"), "root").select("comment_id")
    rows = semi(rows, tops.unionByName(below), "comment_id")
    # a parent from this batch counts only if it is accepted itself
    kept = rows.select(F.col("comment_id").alias("reply_comment_id"), F.lit(True).alias("kept"))
    rows = rows.join(kept, "reply_comment_id", "left")
    rows = _kept(g, rows)
    new = rows.select(
        F.col("comment_id").alias("id"), "creation_ms", "location_ip", "browser_used", "content", F.col("person_id").alias("creator_id"), "country_id",
        F.col("known_post").alias("reply_of_post"), F.coalesce("known_comment", F.when(F.col("kept"), F.col("reply_comment_id"))).alias("reply_of_comment"),
    )
    out = _tagged(_append(g, "comment", new), "comment_tag", "comment_id", rows)
    replies = direct_replies(new)
    out = _append(_append(out, "replies", replies), "message_home", new.select("id", F.lit(False).alias("is_post"), "creator_id"))
    if "message_root" in g.tables:
        # comments that answer both a stored message and one of the batch are rare; without any the links are those resolved above
        n_rows, n_mixed = rows.agg(F.count(F.lit(1)), F.count_if(anchored & F.col("kept"))).first()
        out = _append(out, "message_root", _new_roots(g, new, None if n_mixed else forest.nodes, n_rows))
    if "friends" in g.tables:
        ends = F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("p1"), F.col("b").alias("p2")))).otherwise(
            F.array(F.struct(F.col("a").alias("p1"), F.col("b").alias("p2")), F.struct(F.col("b").alias("p1"), F.col("a").alias("p2")))
        )
        more = _few(g, _weights(out, replies).select(F.inline(ends), F.col("weight").alias("more")))
        raised = _stored(g, "friends", more).join(more.rows, ["p1", "p2"]).withColumn("weight", F.col("weight") + F.col("more"))
        out = _replace(out, "friends", _few(g, raised.drop("more")))
    return out


def _new_roots(g: Graph, new: DataFrame, nodes: DataFrame | None, n_new: int) -> DataFrame:
    """``message_id, is_post, post_id`` of new comments: those that answer each other are led to one that answers what is stored, and so to its post."""
    inside = semi(new.select(F.col("id").alias("node"), F.col("reply_of_comment").alias("parent")), new.select(F.col("id").alias("parent")), "parent")
    if nodes is None:
        forest = resolve_forest(inside.withColumn("tree", F.lit("batch")))
        g._held.append(forest.scratch)
        nodes = forest.nodes
    tops = new.select(F.col("id").alias("root"), "reply_of_comment", "reply_of_post").join(inside.select(F.col("node").alias("root")), "root", "left_anti")
    answered = tops.where("reply_of_comment is not null").select(F.col("reply_of_comment").alias("message_id")).distinct()
    answered = F.broadcast(answered) if n_new <= relational.FEW_ROWS else answered
    roots = semi(g.message_root.where("not is_post"), answered, "message_id").select(F.col("message_id").alias("reply_of_comment"), "post_id")
    posts = tops.join(roots, "reply_of_comment", "left").select("root", F.when(F.col("reply_of_comment").isNull(), F.col("reply_of_post")).otherwise(F.col("post_id")).alias("post_id"))
    members = nodes.where("depth > 0").select(F.col("node").alias("message_id"), "root").unionByName(tops.select(F.col("root").alias("message_id"), "root"))
    return members.join(posts, "root").where("post_id is not null").select("message_id", F.lit(False).alias("is_post"), "post_id")


def _weights(g: Graph, replies: DataFrame) -> DataFrame:
    """``a, b, weight`` of direct replies, by whom they join."""
    answered = Few.of(replies.select("parent_id").distinct())
    homes = answered.semi(g.message_home, "id", "parent_id").select(F.col("id").alias("parent_id"), F.col("is_post").alias("parent_is_post"), F.col("creator_id").alias("author"))
    homes = homes.dropDuplicates(["parent_id", "parent_is_post"])
    rows = skew_join(replies, homes, ["parent_id", "parent_is_post"], HOT_SHARE) if answered.table is None else replies.join(homes, ["parent_id", "parent_is_post"])
    pair = [F.least("creator_id", "author").alias("a"), F.greatest("creator_id", "author").alias("b")]
    return rows.where("creator_id is not null and author is not null").groupBy(*pair).agg(F.sum(reply_weight(F.col("parent_is_post"))).alias("weight"))


def add_friendships(g: Graph, requests: DataFrame) -> Graph:
    rows = semi(semi(requests, _ids(g.person, "person_id"), "person_id"), _ids(g.person, "person2_id"), "person2_id").where("person_id <> person2_id")
    ways = lambda a, b: rows.select(F.col(a).alias("p1"), F.col(b).alias("p2"), "creation_ms")
    out, newer = _upsert(g, "knows", ways("person_id", "person2_id").unionByName(ways("person2_id", "person_id")), "creation_ms")
    if "friends" not in g.tables:
        return out
    known = _stored(g, "friends", newer).select("p1", "p2", "weight")
    rated = _few(g, newer.rows.join(known, ["p1", "p2"], "left")).rows
    pairs = rated.where("weight is null").select(F.least("p1", "p2").alias("a"), F.greatest("p1", "p2").alias("b")).distinct()
    people = Few.of(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct())
    weights = semi(_weights(g, direct_replies(people.semi(g.comment, "creator_id"))), pairs, ["a", "b"]).withColumnRenamed("weight", "found")
    rated = rated.withColumns({"a": F.least("p1", "p2"), "b": F.greatest("p1", "p2")}).join(weights, ["a", "b"], "left")
    return _replace(out, "friends", _few(g, rated.withColumn("weight", F.coalesce("weight", "found", F.lit(0.0))).drop("a", "b", "found")))


STEPS = {
    "iu1": add_persons, "iu4": add_forums, "iu8": add_friendships, "iu5": add_members, "iu6": add_posts, "iu7": add_comments, "iu2": like_posts, "iu3": like_comments,
}


def apply_updates(graph: Graph, requests: Mapping[str, DataFrame]) -> Graph:
    """The graph after all requests; kinds that are not given change nothing."""
    unknown = set(requests) - set(STEPS)
    if unknown:
        raise ValueError(f"no such update: {sorted(unknown)}")
    for name, step in STEPS.items():
        if name in requests:
            graph = step(graph, requests[name])
    return graph


def wide_schema() -> str:
    """One row type for all kinds: ``op`` and every request column."""
    columns: dict[str, str] = {"op": "string"}
    for spec in REQUESTS.values():
        depth, part = 0, ""
        for sign in spec + ", ":
            depth += (sign == "<") - (sign == ">")
            if sign == "," and not depth:
                name, kind = part.strip().split(" ", 1)
                columns.setdefault(name, kind)
                part = ""
            else:
                part += sign
    return ", ".join(f"{name} {kind}" for name, kind in columns.items())


def split_updates(rows: DataFrame) -> dict[str, DataFrame]:
    """Requests by kind from rows of ``wide_schema``."""
    return {op: rows.where(F.col("op") == op).select(*_columns(spec)) for op, spec in REQUESTS.items()}


def _columns(spec: str) -> list[Column]:
    depth, names, part = 0, [], ""
    for sign in spec + ",":
        depth += (sign == "<") - (sign == ">")
        if sign == "," and not depth:
            names.append(F.col(part.strip().split(" ", 1)[0]))
            part = ""
        else:
            part += sign
    return names
