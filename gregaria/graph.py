"""The graph as a set of immutable tables, with its derived ones."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gregaria.functions.values import reply_weight
from gregaria.operators.hierarchy import resolve_forest
from gregaria.operators.skew import skew_join
from gregaria.schema import BASE, DERIVED
from gregaria.sources.scratch import Scratch

HOT_SHARE = 1 / 64


def member_posts(members: DataFrame, posts: DataFrame) -> DataFrame:
    """Memberships with the number of posts of that person in that forum, at any date; 0 if none."""
    written = posts.groupBy("forum_id", F.col("creator_id").alias("person_id")).agg(F.count(F.lit(1)).alias("posts"))
    return members.join(written, ["forum_id", "person_id"], "left").fillna(0, ["posts"])


def reply_weights(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """``a, b, weight`` for pairs with direct replies either way: 1.0 for one to a post, 0.5 to a comment."""
    answered = lambda rows, parents, key: skew_join(
        rows.select(key, "creator_id"), parents.select(F.col("id").alias(key), F.col("creator_id").alias("author")).dropDuplicates([key]), key, HOT_SHARE
    ).where("author is not null")
    to_posts = answered(comments.where("reply_of_post is not null"), posts, "reply_of_post").select("creator_id", "author", reply_weight(F.lit(True)).alias("weight"))
    to_comments = answered(comments.where("reply_of_post is null and reply_of_comment is not null"), comments, "reply_of_comment").select("creator_id", "author", reply_weight(F.lit(False)).alias("weight"))
    return to_posts.unionByName(to_comments).groupBy(F.least("creator_id", "author").alias("a"), F.greatest("creator_id", "author").alias("b")).agg(F.sum("weight").alias("weight"))


def friends(knows: DataFrame, posts: DataFrame, comments: DataFrame) -> DataFrame:
    """Friendships in both directions with their reply weight, 0 without replies."""
    pairs = knows.withColumns({"a": F.least("p1", "p2"), "b": F.greatest("p1", "p2")})
    return pairs.join(reply_weights(posts, comments), ["a", "b"], "left").fillna(0.0, ["weight"]).select("p1", "p2", "creation_ms", "weight")


def direct_replies(comments: DataFrame) -> DataFrame:
    parent = F.coalesce("reply_of_post", "reply_of_comment")
    return comments.where(parent.isNotNull()).select(
        parent.alias("parent_id"), F.col("reply_of_post").isNotNull().alias("parent_is_post"), "id", "creator_id", "creation_ms"
    )


@dataclass
class Graph:
    """``tables`` holds at least those of ``schema.BASE``; derived ones are taken from it or computed when first asked for.

    ``changes`` are the rows by which a graph differs from the stored version
    ``origin`` (folder, number) that it was made of.
    """

    spark: SparkSession
    tables: dict[str, DataFrame]
    changes: dict[str, DataFrame] = field(default_factory=dict)
    origin: tuple[str, int] | None = None
    _held: list[Scratch] = field(default_factory=list)

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None

    def with_tables(self, **tables: DataFrame) -> Graph:
        """A graph with some base tables replaced; nothing derived is carried over."""
        return Graph(self.spark, {k: v for k, v in self.tables.items() if k in BASE} | tables)

    def release(self) -> None:
        """Removes the written tables that this graph's own tables read; it can't be used after."""
        while self._held:
            self._held.pop().drop()

    @cached_property
    def message(self) -> DataFrame:
        """Posts and comments. If an id is both, both are there; point reads prefer the post."""
        none = lambda kind: F.lit(None).cast(kind)
        posts = self.post.select("*", F.lit(True).alias("is_post"), none("bigint").alias("reply_of_post"), none("bigint").alias("reply_of_comment"))
        comments = self.comment.select("*", F.lit(False).alias("is_post"), none("bigint").alias("forum_id"), none("string").alias("image_file"), none("string").alias("language"))
        return posts.unionByName(comments)

    @cached_property
    def friends(self) -> DataFrame:
        return self.tables.get("friends") or friends(self.knows, self.post, self.comment)

    @cached_property
    def member_posts(self) -> DataFrame:
        return self.tables.get("member_posts") or member_posts(self.forum_member, self.post)

    @cached_property
    def message_root(self) -> DataFrame:
        """``message_id, is_post, post_id``: the post at the top of every message's thread; none where the thread has no post."""
        if "message_root" in self.tables:
            return self.tables["message_root"]
        # posts and comments may share ids, so posts stand in the forest under their complement
        links = self.comment.select(
            F.lit("message").alias("tree"), F.col("id").alias("node"),
            F.coalesce("reply_of_comment", F.expr("-1 - reply_of_post")).alias("parent"),
        ).where("parent is not null")
        forest = resolve_forest(links)
        self._held.append(forest.scratch)
        comments = forest.nodes.where("depth > 0 and root < 0").select(F.col("node").alias("message_id"), F.expr("-1 - root").alias("post_id"))
        known = self.post.select(F.col("id").alias("post_id"))
        return (
            comments.join(known, "post_id", "left_semi")
            .select("message_id", F.lit(False).alias("is_post"), "post_id")
            .unionByName(self.post.select(F.col("id").alias("message_id"), F.lit(True).alias("is_post"), F.col("id").alias("post_id")))
        )

    @cached_property
    def message_home(self) -> DataFrame:
        """``id, is_post, creator_id`` of every message: finds, for an id, the place in the tables clustered by creator."""
        return self.tables.get("message_home") or self.message.select("id", "is_post", "creator_id")

    @cached_property
    def replies(self) -> DataFrame:
        """Direct replies by what they answer; a comment that names both a post and a comment answers the post."""
        return self.tables.get("replies") or direct_replies(self.comment)

    def derived(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in DERIVED}
