"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gregaria.llm.mixing import Mix, mix_sources
from gregaria.llm.stuffing import stuffed_pages
from gregaria.llm.tokenize import count_tokens, encode_texts
from gregaria.llm.topn import top_n
from gregaria.sources.scratch import Scratch
from gregaria.sources.tables import read_table


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "message").where("creator <> -1").select("creator", "creationdate", "id")
    return top_n(rows, "creator", "creationdate", "id", 5).withColumnRenamed("id", "message_id")


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode_texts(read_table(spark, sf, "documents"), "doc_id")


def _mix(spark: SparkSession, sf: str, total: str | None = "corpus") -> Mix:
    sizes = Scratch(spark, "sizes").write(count_tokens(read_table(spark, sf, "documents"), ["doc_id", "source"]), "tokens")
    return mix_sources(sizes, read_table(spark, sf, "mix_target"), total)


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    """``doc_id, source, n_tokens, uses`` of the documents chosen for a mix as large as all listed sources; sources out of reach are used up."""
    return _mix(spark, sf).uses


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """The shares that ``p7_mix`` reaches; targets out of reach are marked."""
    return _mix(spark, sf).shares


def p7_shares_of_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """The same as ``p7_shares``, under its earlier name."""
    return p7_shares(spark, sf)


def p7_mix_in_reach(spark: SparkSession, sf: str) -> DataFrame:
    """As ``p7_mix``, at the largest total that keeps all targets in reach."""
    return _mix(spark, sf, None).uses


def p7_shares_in_reach(spark: SparkSession, sf: str) -> DataFrame:
    """The shares that ``p7_mix_in_reach`` reaches."""
    return _mix(spark, sf, None).shares


def p7_checks(spark: SparkSession, sf: str) -> DataFrame:
    """The mix by ``n_chars`` at twice the corpus, a row a target: what was wanted and in reach, and whether the choice keeps to it.

    ``within_one_document``: the characters chosen are less than one document
    off the target, or all repeats of a source out of reach. ``within_limit``:
    no document is used more often than ``max_repeats`` allows.
    """
    sizes = read_table(spark, sf, "documents").select("doc_id", "source", F.col("n_chars").alias("n_tokens"))
    targets = read_table(spark, sf, "mix_target")
    listed = sizes.join(F.broadcast(targets.select("source")), "source", "left_semi")
    mix = mix_sources(sizes, targets, 2.0 * (listed.agg(F.sum("n_tokens")).first()[0] or 0))
    uses = Scratch(spark, "uses").write(mix.uses, "uses")
    most = uses.groupBy("source").agg(F.max("uses").alias("most"), F.sum(F.col("uses") * F.col("n_tokens")).alias("chosen"))
    largest = listed.groupBy("source").agg(F.max("n_tokens").alias("largest"))
    rows = mix.shares.join(most, "source", "left").join(largest, "source", "left")
    goal = F.when(F.col("out_of_reach"), F.col("max_repeats") * F.col("available_tokens")).otherwise(F.col("wanted_tokens"))
    return rows.select(
        "source", "target_share", F.col("available_tokens").alias("available_chars"), F.floor("wanted_tokens").alias("wanted_chars"), "out_of_reach",
        (F.abs(F.coalesce("chosen", F.lit(0)) - goal) <= F.coalesce("largest", F.lit(0))).alias("within_one_document"),
        (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within_limit"),
    )


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return stuffed_pages(read_table(spark, sf, "documents")).select("doc_id")


def p8_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of ``p8_found`` with their distance, direction and features."""
    return stuffed_pages(read_table(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (p3_found, p6_ids, p7_mix, p7_shares, p7_shares_of_corpus, p7_checks, p7_mix_in_reach, p7_shares_in_reach, p8_found, p8_scores)}

SQL = {
    "p7_checks": """
        WITH sizes AS (SELECT source, sum(n_chars) AS available FROM documents WHERE source IS NOT NULL AND n_chars > 0 GROUP BY source),
        listed AS (SELECT t.source, t.target_share, t.max_repeats, coalesce(available, 0) AS available FROM mix_target AS t LEFT JOIN sizes AS s ON s.source = t.source),
        wanted AS (SELECT *, target_share * 2.0 * (SELECT sum(available) FROM listed) AS wanted FROM listed)
        SELECT source, target_share, available::BIGINT AS available_chars, floor(wanted)::BIGINT AS wanted_chars, wanted > max_repeats * available * (1 + 1e-9) AS out_of_reach,
          TRUE AS within_one_document, TRUE AS within_limit FROM wanted""",
    "p3_found": """
        WITH m AS (SELECT DISTINCT creator, creationdate, id FROM message WHERE creator <> -1 AND creationdate IS NOT NULL)
        SELECT creator, rank_no, id AS message_id FROM (
          SELECT *, row_number() OVER (PARTITION BY creator ORDER BY creationdate DESC, id DESC) AS rank_no FROM m) WHERE rank_no <= 5""",
}
