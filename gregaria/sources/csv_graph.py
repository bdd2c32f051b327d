"""Graphs from and to delimited files: ``|`` between fields, ``;`` inside lists, one header line, no quoting."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gregaria.functions.values import parse_list, parse_ms
from gregaria.graph import Graph
from gregaria.schema import BASE


@dataclass(frozen=True)
class Layout:
    """A file below the data directory, the columns of its header, and how the table is made of them."""

    path: str
    header: tuple[str, ...]
    columns: dict[str, str]  # column of the table: column of the file
    optional: tuple[str, ...] = ()  # trailing columns that the file may lack


# File names and headers of the input format.
LAYOUTS = {
    "person": Layout(
        "dynamic/person_0_0.csv",
        ("id", "firstName", "lastName", "gender", "birthday", "creationDate", "locationIP", "browserUsed", "place", "language", "email"),
        {"id": "id", "first_name": "firstName", "last_name": "lastName", "gender": "gender", "birthday": "birthday", "creation_ms": "creationDate", "location_ip": "locationIP", "browser_used": "browserUsed", "city_id": "place", "languages": "language", "emails": "email"},
    ),
    "place": Layout("static/place_0_0.csv", ("id", "name", "url", "type", "isPartOf"), {"id": "id", "name": "name", "url": "url", "type": "type", "part_of": "isPartOf"}, ("isPartOf",)),
    "org": Layout("static/organisation_0_0.csv", ("id", "type", "name", "url", "place"), {"id": "id", "type": "type", "name": "name", "url": "url", "place_id": "place"}),
    "post": Layout(
        "dynamic/post_0_0.csv",
        ("id", "imageFile", "creationDate", "locationIP", "browserUsed", "language", "content", "length", "creator", "Forum.id", "place"),
        {"id": "id", "image_file": "imageFile", "creation_ms": "creationDate", "location_ip": "locationIP", "browser_used": "browserUsed", "language": "language", "content": "content", "creator_id": "creator", "forum_id": "Forum.id", "country_id": "place"},
    ),
    "comment": Layout(
        "dynamic/comment_0_0.csv",
        ("id", "creationDate", "locationIP", "browserUsed", "content", "length", "creator", "place", "replyOfPost", "replyOfComment"),
        {"id": "id", "creation_ms": "creationDate", "location_ip": "locationIP", "browser_used": "browserUsed", "content": "content", "creator_id": "creator", "country_id": "place", "reply_of_post": "replyOfPost", "reply_of_comment": "replyOfComment"},
        ("replyOfComment",),
    ),
    "tag": Layout("static/tag_0_0.csv", ("id", "name", "url", "hasType"), {"id": "id", "name": "name", "url": "url", "class_id": "hasType"}),
    "tagclass": Layout("static/tagclass_0_0.csv", ("id", "name", "url", "isSubclassOf"), {"id": "id", "name": "name", "url": "url", "parent_id": "isSubclassOf"}, ("isSubclassOf",)),
    "forum": Layout("dynamic/forum_0_0.csv", ("id", "title", "creationDate", "moderator"), {"id": "id", "title": "title", "creation_ms": "creationDate", "moderator_id": "moderator"}),
}
# Relation files, whose columns go by position.
RELATIONS = {
    "person_interest": [("dynamic/person_hasInterest_tag_0_0.csv", None)],
    "knows": [("dynamic/person_knows_person_0_0.csv", None)],
    "likes": [("dynamic/person_likes_post_0_0.csv", True), ("dynamic/person_likes_comment_0_0.csv", False)],
    "study_at": [("dynamic/person_studyAt_organisation_0_0.csv", None)],
    "work_at": [("dynamic/person_workAt_organisation_0_0.csv", None)],
    "post_tag": [("dynamic/post_hasTag_tag_0_0.csv", None)],
    "comment_tag": [("dynamic/comment_hasTag_tag_0_0.csv", None)],
    "forum_tag": [("dynamic/forum_hasTag_tag_0_0.csv", None)],
    "forum_member": [("dynamic/forum_hasMember_person_0_0.csv", None)],
}


class HeaderError(ValueError):
    """A file's header isn't the one of its kind."""


def _header(spark: SparkSession, path: str) -> list[str]:
    first = spark.read.text(path).first()
    if first is None:
        raise HeaderError(f"{path}: no header line")
    return first[0].split("|")


def _rows(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.csv(path, sep="|", header=True, schema=schema, quote="", escape="", enforceSchema=True, emptyValue="", nullValue=None)


def _typed(value: F.Column, kind: str, column: str) -> F.Column:
    if column.endswith("_ms"):
        return parse_ms(value)
    if kind == "array<string>":
        return F.array_sort(parse_list(value)) if column == "languages" else parse_list(value)
    return F.nullif(value, F.lit("")).cast(kind) if kind != "string" else F.coalesce(value, F.lit(""))


def _kinds(name: str) -> list[tuple[str, str]]:
    return [tuple(part.split(" ", 1)) for part in BASE[name].split(", ")]


def read_vertices(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A vertex table; the header must be the one of its kind, without some trailing optional columns at most."""
    layout = LAYOUTS[name]
    path = f"{directory}/{layout.path}"
    found = _header(spark, path)
    least = len(layout.header) - len(layout.optional)
    if found != list(layout.header[: len(found)]) or len(found) < least:
        raise HeaderError(f"{path}: columns {found}, expected {list(layout.header)}")
    # a row may lack trailing optional fields even where the header has them
    rows = _rows(spark, path, list(layout.header))
    return rows.select(*(_typed(F.col(f"`{layout.columns[c]}`"), kind, c).alias(c) for c, kind in _kinds(name)))


def read_relation(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """A relation table; friendships, stored once a pair, come in both directions."""
    kinds = [(c, kind) for c, kind in _kinds(name) if c != "is_post"]
    out = None
    for file, is_post in RELATIONS[name]:
        rows = _rows(spark, f"{directory}/{file}", [c for c, _ in kinds]).select(*(_typed(F.col(c), kind, c).alias(c) for c, kind in kinds))
        if is_post is not None:
            rows = rows.withColumn("is_post", F.lit(is_post)).select(*(c for c, _ in _kinds(name)))
        out = rows if out is None else out.unionByName(rows)
    if name == "knows":
        out = out.unionByName(out.select(F.col("p2").alias("p1"), F.col("p1").alias("p2"), "creation_ms"))
    return out


def load_csv(spark: SparkSession, directory: str) -> Graph:
    """The graph of all files below ``directory``; a missing file or a wrong header is an error."""
    tables = {name: read_vertices(spark, directory, name) for name in LAYOUTS}
    return Graph(spark, tables | {name: read_relation(spark, directory, name) for name in RELATIONS})


def _as_text(value: F.Column, kind: str, column: str) -> F.Column:
    if column.endswith("_ms"):
        return F.date_format(F.timestamp_millis(value), "yyyy-MM-dd'T'HH:mm:ss.SSSxx")
    return F.array_join(value, ";") if kind == "array<string>" else value.cast("string")


def write_csv(graph: Graph, directory: str) -> None:
    """The files that ``load_csv`` reads, each as a folder of parts; times to the millisecond, friendships once a pair, columns that no table holds empty.

    Values must hold neither the separators nor line ends, as the format has no quoting.
    """

    def write(rows: DataFrame, path: str) -> None:
        rows = rows.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in rows.columns))
        rows.write.csv(f"{directory}/{path}", sep="|", header=True, quote="", escape="", emptyValue="", mode="overwrite")

    for name, layout in LAYOUTS.items():
        texts = {layout.columns[c]: _as_text(F.col(c), kind, c) for c, kind in _kinds(name)}
        write(graph.tables[name].select(*(texts.get(c, F.lit(None).cast("string")).alias(c) for c in layout.header)), layout.path)
    for name, files in RELATIONS.items():
        for file, is_post in files:
            rows = graph.tables[name]
            rows = rows.where("p1 < p2") if name == "knows" else rows if is_post is None else rows.where(F.col("is_post") == is_post)
            write(rows.select(*(_as_text(F.col(c), kind, c).alias(c) for c, kind in _kinds(name) if c != "is_post")), file)
