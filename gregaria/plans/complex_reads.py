"""The fourteen complex reads.

Each takes a graph and returns a table in a stated total order; with a limit
the order is also the column ``rank``. An unknown person, tag or place gives no
rows. Only keys and what orders them are carried to the top rows; names and
contents are looked up after. Frontiers and intermediate keys go through ``Few``:
while they are short they filter the scans of the large tables, which then need
no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gregaria.functions.values import DAY_MS, born_around, minutes_between, ms_of_date, shown_content
from gregaria.graph import Graph
from gregaria.operators.relational import Few, arg_max, count_if, first_few, in_order, mark, semi, sorted_lists, top_k, with_rank
from gregaria.operators.traversal import all_shortest_paths, bfs_levels, descend, first_step, multihop, ring, shortest_path

asc, desc = (lambda c: F.col(c).asc()), (lambda c: F.col(c).desc())


def _named(g: Graph, few: Few, key: str = "person_id") -> DataFrame:
    """``few`` with the names of the persons in the column ``key``."""
    return few.rows.join(few.semi(g.person, "id", key).select(F.col("id").alias(key), "first_name", "last_name"), key)


def _rank(limit: int | None) -> list[str]:
    return ["rank"] if limit is not None else []


def ic1(g: Graph, person_id: int, first_name: str, limit: int | None = 20) -> DataFrame:
    """Persons of a first name within three steps, by distance, last name and id, with their places, schools and firms."""
    near = Few.of(bfs_levels(g.knows, person_id, 3))
    order = [asc("distance"), asc("friend_last_name"), asc("friend_id")]
    rows = near.rows.join(near.semi(g.person.where(F.col("first_name") == first_name), "id"), "id").select(
        F.col("id").alias("friend_id"), F.col("last_name").alias("friend_last_name"), F.col("level").alias("distance"), ms_of_date(F.col("birthday")).alias("birthday_ms"),
        "creation_ms", "gender", "browser_used", "location_ip", "emails", "languages", "city_id",
    )
    top = first_few(rows, order, limit)
    place = g.place.select(F.col("id").alias("place_id"), F.col("name").alias("place_name"))
    orgs = g.org.select(F.col("id").alias("org_id"), F.col("name").alias("org_name"), "place_id").join(place, "place_id", "left")

    def held(table: DataFrame, year: str, prefix: str) -> DataFrame:
        mine = top.semi(table.withColumnRenamed("person_id", "friend_id"), "friend_id", "friend_id").join(orgs, "org_id")
        return sorted_lists(mine, "friend_id", ["org_id", year], {f"{prefix}_name": "org_name", f"{prefix}_year": year, f"{prefix}_city": "place_name"})

    out = top.rows.join(g.place.select(F.col("id").alias("city_id"), F.col("name").alias("city_name")), "city_id", "left").drop("city_id")
    out = out.join(held(g.study_at, "class_year", "uni"), "friend_id", "left").join(held(g.work_at, "work_from", "company"), "friend_id", "left")
    empty = {f"{p}_{c}": F.coalesce(f"{p}_{c}", F.array().cast("array<int>" if c == "year" else "array<string>")) for p in ("uni", "company") for c in ("name", "year", "city")}
    return in_order(out.withColumns(empty), order, limit)


def _with_content(g: Graph, top: Few, creator: str, *columns: str) -> DataFrame:
    """``top`` with the shown content of its messages, found under their creators, by whom messages are clustered."""
    found = top.semi(top.semi(g.message, "creator_id", creator), "id", "message_id")
    content = found.select(F.col("id").alias("message_id"), "is_post", F.col("creator_id").alias(creator), shown_content(F.col("content"), F.col("image_file")).alias("content"))
    return top.rows.join(content, ["message_id", "is_post", creator])


def _latest_messages(g: Graph, people: Few, when, limit: int | None) -> DataFrame:
    messages = people.semi(g.message.where(when), "creator_id")
    rows = messages.select(F.col("creator_id").alias("person_id"), F.col("id").alias("message_id"), "is_post", "creation_ms")
    order = [desc("creation_ms"), asc("message_id")]
    top = first_few(rows, [*order, desc("is_post")], limit)
    out = _with_content(g, top, "person_id").join(top.semi(g.person, "id", "person_id").select(F.col("id").alias("person_id"), "first_name", "last_name"), "person_id")
    return in_order(out.select("person_id", "message_id", "content", "creation_ms", *_rank(limit), "first_name", "last_name"), order, limit)


def ic2(g: Graph, person_id: int, max_ms: int, limit: int | None = 20) -> DataFrame:
    """Latest messages of friends up to and including a time."""
    return _latest_messages(g, Few.of(first_step(g.knows, person_id)), F.col("creation_ms") <= max_ms, limit)


def ic3(g: Graph, person_id: int, country_x: str, country_y: str, start_ms: int, days: int, limit: int | None = 20) -> DataFrame:
    """Persons within two steps, living in neither of two countries, with messages from both in a span of days."""
    ids = dict(g.place.where((F.col("type") == "country") & F.col("name").isin(country_x, country_y)).groupBy("name").agg(F.max("id")).collect())
    x, y = ids.get(country_x, -1), ids.get(country_y, -1)  # an unknown country is in no message, so no count is above 0
    span = g.message.where((F.col("creation_ms") >= start_ms) & (F.col("creation_ms") < start_ms + days * DAY_MS))
    near = Few.of(multihop(g.knows, person_id, 2)).semi(g.person, "id")
    homes = near.join(g.place.select(F.col("id").alias("city_id"), "part_of"), "city_id")
    people = Few.of(homes.where(F.col("part_of").isNull() | ~F.col("part_of").isin(x, y)).select("id"))
    sent = people.semi(span.where(F.col("country_id").isin(x, y)), "creator_id").select(F.col("creator_id").alias("id"), "country_id")
    counts = sent.groupBy("id").agg(
        count_if(F.col("country_id") == x).cast("int").alias("x_count"), count_if(F.col("country_id") == y).cast("int").alias("y_count")
    ).where("x_count > 0 and y_count > 0")
    rows = counts.select(F.col("id").alias("person_id"), "x_count", "y_count", (F.col("x_count") + F.col("y_count")).alias("count"))
    order = [desc("x_count"), asc("person_id")]
    return in_order(_named(g, first_few(rows, order, limit)), order, limit)


def ic4(g: Graph, person_id: int, start_ms: int, days: int, limit: int | None = 20) -> DataFrame:
    """Tags that friends' posts carry in a span of days and carried never before."""
    posts = g.post.where(F.col("creation_ms") < start_ms + days * DAY_MS)
    mine = Few.of(Few.of(first_step(g.knows, person_id)).semi(posts, "creator_id").select(F.col("id").alias("post_id"), "creation_ms"))
    counts = mine.rows.join(g.post_tag, "post_id").groupBy("tag_id").agg(F.count(F.lit(1)).cast("int").alias("post_count"), F.min("creation_ms").alias("first_ms")).where(F.col("first_ms") >= start_ms)
    rows = counts.join(g.tag.select(F.col("id").alias("tag_id"), F.col("name").alias("tag_name")), "tag_id").select("tag_name", "post_count")
    return with_rank(rows, [desc("post_count"), asc("tag_name")], limit)


def ic5(g: Graph, person_id: int, min_ms: int, limit: int | None = 20) -> DataFrame:
    """Forums that persons within two steps joined after a time, by the posts of those members there."""
    joined = Few.of(multihop(g.knows, person_id, 2)).semi(g.member_posts.where(F.col("join_ms") > min_ms), "person_id")
    rows = joined.groupBy("forum_id").agg(F.sum("posts").cast("int").alias("post_count"))
    order = [desc("post_count"), asc("forum_id")]
    top = first_few(rows, order, limit)
    titles = top.semi(g.forum, "id", "forum_id").select(F.col("id").alias("forum_id"), F.col("title").alias("forum_title"))
    return in_order(top.rows.join(titles, "forum_id"), order, limit)


def ic6(g: Graph, person_id: int, tag_name: str, limit: int | None = 20) -> DataFrame:
    """Tags that occur together with a tag on posts of persons within two steps."""
    wanted = Few.of(g.tag.where(F.col("name") == tag_name).agg(F.max("id").alias("tag_id")))
    posts = Few.of(Few.of(multihop(g.knows, person_id, 2)).semi(g.post, "creator_id").select(F.col("id").alias("post_id")))
    tagged = Few.of(posts.semi(wanted.semi(g.post_tag, "tag_id", "tag_id"), "post_id", "post_id").select("post_id"))
    others = tagged.semi(g.post_tag, "post_id", "post_id").join(wanted.rows, "tag_id", "left_anti")
    counts = others.groupBy("tag_id").agg(F.count(F.lit(1)).cast("int").alias("post_count"))
    rows = counts.join(g.tag.select(F.col("id").alias("tag_id"), F.col("name").alias("tag_name")), "tag_id").select("tag_name", "post_count")
    return with_rank(rows, [desc("post_count"), asc("tag_name")], limit)


def ic7(g: Graph, person_id: int, limit: int | None = 20) -> DataFrame:
    """The latest like of each person who liked this person's messages; the lowest message id among likes of one time."""
    mine = Few.of(g.message.where(F.col("creator_id") == person_id).select(F.col("id").alias("message_id"), "is_post", F.col("creation_ms").alias("sent_ms"), "creator_id"))
    likes = mine.semi(g.likes, "message_id", "message_id").select("person_id", "message_id", "is_post", F.col("creation_ms").alias("like_ms"))
    latest = arg_max(likes.join(mine.rows, ["message_id", "is_post"]), ["person_id"], [desc("like_ms"), asc("message_id")])
    order = [desc("like_ms"), asc("person_id")]
    top = first_few(latest, order, limit)
    marked = mark(_with_content(g, top, "creator_id"), first_step(g.knows, person_id).withColumnRenamed("id", "person_id"), "person_id", "is_friend")
    rows = marked.join(top.semi(g.person, "id", "person_id").select(F.col("id").alias("person_id"), "first_name", "last_name"), "person_id")
    out = rows.select(
        "person_id", "first_name", "last_name", "like_ms", "message_id", "content", minutes_between(F.col("sent_ms"), F.col("like_ms")).alias("minutes_latency"),
        (~F.col("is_friend")).alias("is_new"), *_rank(limit),
    )
    return in_order(out, order, limit)


def ic8(g: Graph, person_id: int, limit: int | None = 20) -> DataFrame:
    """Latest direct replies to a person's messages."""
    mine = Few.of(g.message.where(F.col("creator_id") == person_id).select(F.col("id").alias("parent_id"), F.col("is_post").alias("parent_is_post")))
    replies = mine.semi(g.replies, "parent_id", "parent_id").join(mine.rows, ["parent_id", "parent_is_post"], "left_semi")
    order = [desc("comment_ms"), asc("comment_id")]
    top = first_few(replies.select(F.col("creator_id").alias("person_id"), F.col("creation_ms").alias("comment_ms"), F.col("id").alias("comment_id")), order, limit)
    content = top.semi(top.semi(g.comment, "creator_id", "person_id"), "id", "comment_id").select(F.col("id").alias("comment_id"), "content")
    return in_order(_named(g, top).join(content, "comment_id").select("person_id", "comment_ms", "comment_id", "content", *_rank(limit), "first_name", "last_name"), order, limit)


def ic9(g: Graph, person_id: int, max_ms: int, limit: int | None = 20) -> DataFrame:
    """Latest messages of persons within two steps, before a time."""
    return _latest_messages(g, Few.of(multihop(g.knows, person_id, 2)), F.col("creation_ms") < max_ms, limit)


def ic10(g: Graph, person_id: int, month: int, limit: int | None = 10) -> DataFrame:
    """Persons exactly two steps away, born around a month's end, by posts of shared interest less other posts."""
    born = Few.of(ring(g.knows, person_id, 2)).semi(g.person.where(born_around(F.col("birthday"), month)), "id")
    people = Few.of(born.select("id", "first_name", "last_name", "gender", "city_id"))
    tags = Few.of(g.person_interest.where(F.col("person_id") == person_id).select("tag_id"))
    posts = Few.of(people.semi(g.post, "creator_id").select(F.col("id").alias("post_id"), F.col("creator_id").alias("id")))
    shared = Few.of(posts.semi(tags.semi(g.post_tag, "tag_id", "tag_id"), "post_id", "post_id").select("post_id").distinct())
    scores = mark(posts.rows, shared.rows, "post_id", "shared").groupBy("id").agg(F.sum(F.when(F.col("shared"), 1).otherwise(-1)).cast("int").alias("score"))
    rows = people.rows.join(scores, "id", "left").select(
        F.col("id").alias("person_id"), "first_name", "last_name", F.coalesce("score", F.lit(0)).alias("common_interest_score"), "gender", "city_id"
    )
    order = [desc("common_interest_score"), asc("person_id")]
    cities = g.place.select(F.col("id").alias("city_id"), F.col("name").alias("city_name"))
    return in_order(with_rank(rows, order, limit).join(cities, "city_id", "left").drop("city_id"), order, limit)


def ic11(g: Graph, person_id: int, country: str, before_year: int, limit: int | None = 10) -> DataFrame:
    """Persons within two steps who began work in a country before a year."""
    where = g.place.where((F.col("name") == country) & (F.col("type") == "country")).agg(F.max("id").alias("place_id"))
    orgs = semi(g.org.select(F.col("id").alias("org_id"), F.col("name").alias("organization_name"), "place_id"), where, "place_id").drop("place_id")
    jobs = Few.of(multihop(g.knows, person_id, 2)).semi(g.work_at.where(F.col("work_from") < before_year), "person_id")
    rows = jobs.join(orgs, "org_id").select("person_id", "organization_name", "work_from").distinct()
    order = [asc("work_from"), asc("person_id"), desc("organization_name")]
    return in_order(_named(g, first_few(rows, order, limit)), order, limit)


def tags_below(g: Graph, class_name: str) -> DataFrame:
    """``tag_id`` of the tags in a class or any class below it."""
    root = g.tagclass.where(F.col("name") == class_name).agg(F.max("id").alias("id")).where("id is not null")
    classes = descend(g.tagclass.select(F.col("parent_id").alias("parent"), "id"), root)
    return semi(g.tag.select(F.col("id").alias("tag_id"), F.col("class_id").alias("id")), classes, "id").select("tag_id")


def ic12(g: Graph, person_id: int, class_name: str, limit: int | None = 20) -> DataFrame:
    """Friends by their comments directly on posts with a tag of a class, with those tags."""
    tags = tags_below(g, class_name)
    comments = Few.of(first_step(g.knows, person_id)).semi(g.comment.where("reply_of_post is not null"), "creator_id")
    mine = Few.of(comments.select(F.col("id").alias("comment_id"), F.col("creator_id").alias("id"), F.col("reply_of_post").alias("post_id")))
    tagged = mine.semi(Few.of(tags).semi(g.post_tag, "tag_id", "tag_id"), "post_id", "post_id")
    hits = mine.rows.join(tagged, "post_id").join(g.tag.select(F.col("id").alias("tag_id"), F.col("name").alias("tag_name")), "tag_id")
    counts = hits.groupBy("id").agg(F.array_sort(F.collect_set("tag_name")).alias("tag_names"), F.count_distinct("comment_id").cast("int").alias("reply_count"))
    order = [desc("reply_count"), asc("person_id")]
    return in_order(_named(g, first_few(counts.withColumnRenamed("id", "person_id"), order, limit)), order, limit)


def _both_known(g: Graph, a: int, b: int) -> bool:
    return g.person.where(F.col("id").isin(a, b)).select("id").distinct().count() == len({a, b})


def ic13(g: Graph, person1: int, person2: int, max_hops: int | None = None) -> DataFrame:
    """The number of steps between two persons: 0 for one and the same, -1 if there is no way or either is unknown."""
    length = shortest_path(g.knows, person1, person2, max_hops) if _both_known(g, person1, person2) else -1
    return g.spark.createDataFrame([(length,)], "shortest_path_length int")


def ic14(g: Graph, person1: int, person2: int) -> DataFrame:
    """All shortest ways between two persons by weight, heaviest first, then by their ids."""
    if not _both_known(g, person1, person2):
        return g.spark.createDataFrame([], "person_ids_in_path array<bigint>, path_weight double")
    paths = all_shortest_paths(g.friends, person1, person2).select(F.col("path").alias("person_ids_in_path"), F.col("weight").alias("path_weight"))
    return top_k(paths, [desc("path_weight"), asc("person_ids_in_path")], None)
