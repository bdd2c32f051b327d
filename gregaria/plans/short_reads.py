"""The seven short reads. Unknown ids give no rows; an id that is both a post and a comment means the post."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gregaria.functions.values import ms_of_date, shown_content
from gregaria.graph import Graph
from gregaria.operators.relational import Few, first_few, in_order, mark, top_k


def _names(g: Graph, few: Few, key: str, prefix: str = "") -> DataFrame:
    """Names of the persons in the column ``key`` of ``few``."""
    rows = few.semi(g.person, "id", key)
    return rows.select(F.col("id").alias(key), F.col("first_name").alias(f"{prefix}first_name"), F.col("last_name").alias(f"{prefix}last_name"))


def _home(g: Graph, message_id: int) -> tuple[bool, int] | None:
    """Whether a message is a post, and its creator; of a post and a comment of one id the post."""
    found = g.message_home.where(F.col("id") == message_id).select("is_post", "creator_id").collect()
    return max(((r.is_post, r.creator_id) for r in found), key=lambda home: home[0], default=None)


def _message(g: Graph, message_id: int | None, home: tuple[bool, int] | None) -> DataFrame:
    """The row of a message, looked up under its creator, by whom messages are clustered."""
    if home is None:
        return g.message.where(F.lit(False))
    is_post, creator = home
    by_creator = F.col("creator_id").isNull() if creator is None else F.col("creator_id") == creator
    return g.message.where((F.col("is_post") == is_post) & by_creator & (F.col("id") == message_id)).limit(1)


def is1(g: Graph, person_id: int) -> DataFrame:
    """A person's profile."""
    return g.person.where(F.col("id") == person_id).select(
        "first_name", "last_name", ms_of_date(F.col("birthday")).alias("birthday_ms"), "location_ip", "browser_used", "city_id", "gender", "creation_ms"
    )


def is2(g: Graph, person_id: int, limit: int | None = 10) -> DataFrame:
    """A person's latest messages with the post at the top of each one's thread and its author."""
    mine = g.message.where(F.col("creator_id") == person_id).select(
        F.col("id").alias("message_id"), "is_post", shown_content(F.col("content"), F.col("image_file")).alias("content"), "creation_ms"
    )
    order = [F.col("creation_ms").desc(), F.col("message_id").desc()]
    top = first_few(mine, order, limit)
    roots = Few.of(top.semi(g.message_root, "message_id", "message_id").withColumnRenamed("post_id", "original_post_id"))
    homes = Few.of(roots.semi(g.message_home, "id", "original_post_id").where("is_post").select(F.col("id").alias("original_post_id"), F.col("creator_id").alias("original_post_author_id")))
    out = top.rows.join(roots.rows, ["message_id", "is_post"], "left").join(homes.rows, "original_post_id", "left")
    out = out.join(_names(g, homes, "original_post_author_id", "original_post_author_"), "original_post_author_id", "left")
    return in_order(out.drop("is_post"), order, limit)


def is3(g: Graph, person_id: int) -> DataFrame:
    """All friends with the time of the friendship, latest first."""
    rows = Few.of(g.knows.where(F.col("p1") == person_id).select(F.col("p2").alias("person_id"), F.col("creation_ms").alias("friendship_ms")))
    return top_k(rows.rows.join(_names(g, rows, "person_id"), "person_id"), [F.col("friendship_ms").desc(), F.col("person_id").asc()], None)


def is4(g: Graph, message_id: int) -> DataFrame:
    """A message's time and content."""
    return _message(g, message_id, _home(g, message_id)).select("creation_ms", shown_content(F.col("content"), F.col("image_file")).alias("content"))


def is5(g: Graph, message_id: int) -> DataFrame:
    """A message's author."""
    _, creator = _home(g, message_id) or (True, None)
    return g.person.where(F.col("id") == F.lit(creator).cast("bigint")).select(F.col("id").alias("person_id"), "first_name", "last_name")


def is6(g: Graph, message_id: int) -> DataFrame:
    """The forum of a message's thread and its moderator."""
    roots = g.message_root.where(F.col("message_id") == message_id).select("is_post", "post_id").collect()
    post_id = max(((r.is_post, r.post_id) for r in roots), default=(True, None))[1]
    post = _message(g, post_id, None if post_id is None else _home(g, post_id))
    forums = Few.of(post.where("is_post").select("forum_id"))
    forum = Few.of(forums.semi(g.forum, "id", "forum_id").select(F.col("id").alias("forum_id"), F.col("title").alias("forum_title"), "moderator_id"))
    return forum.rows.join(_names(g, forum, "moderator_id", "moderator_"), "moderator_id", "left").select(
        "forum_id", "forum_title", "moderator_id", "moderator_first_name", "moderator_last_name"
    )


def is7(g: Graph, message_id: int) -> DataFrame:
    """Direct replies, latest first, and whether their author knows the message's author; nobody knows themselves."""
    is_post, creator = _home(g, message_id) or (True, None)
    author = F.lit(creator).cast("bigint")
    replies = Few.of(
        g.replies.where((F.col("parent_id") == message_id) & (F.col("parent_is_post") == is_post)).select(
            F.col("id").alias("comment_id"), "creation_ms", F.col("creator_id").alias("reply_author_id")
        )
    )
    contents = replies.semi(replies.semi(g.comment, "creator_id", "reply_author_id"), "id", "comment_id").select(F.col("id").alias("comment_id"), "content")
    friends = g.knows.where((F.col("p1") == author) & (F.col("p2") != author)).select(F.col("p2").alias("reply_author_id"))
    rows = mark(replies.rows.join(contents, "comment_id"), friends, "reply_author_id", "knows").join(_names(g, replies, "reply_author_id", "reply_author_"), "reply_author_id")
    order = [F.col("creation_ms").desc(), F.col("reply_author_id").asc(), F.col("comment_id").asc()]
    return top_k(rows.select("comment_id", "content", "creation_ms", "reply_author_id", "reply_author_first_name", "reply_author_last_name", "knows"), order, None)
