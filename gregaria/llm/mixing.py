"""Mixing sources to target weights, by pivotal dependent rounding.

Every document of a source should be used equally often, mostly a fractional
number of times. Its whole part is taken as it is; the fractions are rounded in
pairs: token mass moves at random from one document to the other, without a
change to their sum or to either one's expectation, until one of the two is
integral. Documents are dealt to leaves of a bounded number of documents, each of
which leaves at most one open document a source; these residuals are combined
through a reduction tree, so the tokens drawn from a source differ from its
target by less than one document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gregaria.sources.scratch import Scratch
from gregaria.sources.workers import on_workers

FAN_IN = 32
LEAF_DOCUMENTS = 10_000
SURE = 1e-9
MASK = (1 << 64) - 1


def _uniform(*keys: int) -> float:
    """A number in [0, 1) fixed by the keys, alike on every run and executor."""
    x = 0x9E3779B97F4A7C15
    for key in keys:
        x = (x ^ (key & MASK)) * 0xBF58476D1CE4E5B9 & MASK
        x = (x ^ (x >> 31)) * 0x94D049BB133111EB & MASK
        x ^= x >> 29
    return (x >> 11) / (1 << 53)


def pivot(a: tuple, b: tuple, seed: int) -> tuple[tuple, tuple]:
    """Two ``(doc_id, size, fraction)`` after a transfer: one has fraction 0 or 1, total mass is as before."""
    (i, s, p), (j, t, q) = a, b
    up, down = min((1 - p) * s, q * t), min(p * s, (1 - q) * t)
    moved = up if _uniform(seed, i, j) * (up + down) < down else -down
    return (i, s, _settled(p + moved / s)), (j, t, _settled(q - moved / t))


def _settled(p: float) -> float:
    return 0.0 if p < SURE else 1.0 if p > 1 - SURE else p


def pivot_all(items: list[tuple], seed: int) -> tuple[list[tuple], tuple | None]:
    """The items in turn: settled ones, and the open one that may be left."""
    settled, left = [], None
    for item in items:
        item = (item[0], item[1], _settled(item[2]))
        if item[2] in (0.0, 1.0):
            settled.append(item)
        elif left is None:
            left = item
        else:
            a, b = pivot(left, item, seed)
            left = None
            for x in (a, b):
                if x[2] in (0.0, 1.0):
                    settled.append(x)
                else:
                    left = x
    return settled, left


@dataclass
class Mix:
    """``uses``: ``doc_id, source, n_tokens, uses`` of every chosen document; ``shares``: one row a target."""

    uses: DataFrame
    shares: DataFrame
    scratch: Scratch


_OUT = "doc_id bigint, source string, n_tokens bigint, base int, fraction double, node bigint"


def _round(chosen: DataFrame, scratch: Scratch, seed: int, n_leaves: int) -> DataFrame:
    """``chosen``: ``doc_id, source, n_tokens, base, fraction``; returns it with fractions 0 or 1."""

    def rows(part: pd.DataFrame, node: int) -> pd.DataFrame:
        settled, left = pivot_all(list(zip(part["doc_id"].tolist(), part["n_tokens"].tolist(), part["fraction"].tolist())), seed)
        found = {x[0]: x[2] for x in settled} | ({left[0]: left[2]} if left else {})
        return part.assign(fraction=part["doc_id"].map(found), node=node)[["doc_id", "source", "n_tokens", "base", "fraction", "node"]]

    def leaves(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left: dict[tuple[int, str], pd.DataFrame] = {}
        for frame in frames:
            for (node, source), part in frame.groupby(["node", "source"], sort=True):
                done = rows(pd.concat([left.pop((node, source)), part]) if (node, source) in left else part, int(node))
                is_open = ~done["fraction"].isin([0.0, 1.0])
                if is_open.any():
                    left[node, source] = done[is_open]
                yield done[~is_open]
        yield from left.values()

    def inner(frame: pd.DataFrame) -> pd.DataFrame:
        return rows(frame.sort_values("node", kind="stable"), int(frame["parent"].iloc[0]))

    # documents are dealt to leaves by their id, so the choice hangs on the data and the seed alone, not on how they lie in partitions
    leaf = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(n_leaves))
    ordered = chosen.withColumn("node", leaf).repartition("node").sortWithinPartitions("node", "source", "doc_id")
    level = scratch.write(on_workers(ordered).mapInPandas(leaves, _OUT), "leaves")
    is_open = (F.col("fraction") > 0) & (F.col("fraction") < 1)
    settled, residual = [level.where(~is_open)], level.where(is_open)
    nodes = n_leaves
    depth = 0
    while nodes > 1:
        nodes = -(-nodes // FAN_IN)
        grouped = residual.withColumn("parent", F.floor(F.col("node") / FAN_IN)).groupBy("source", "parent")
        level = scratch.write(grouped.applyInPandas(inner, _OUT), f"level{depth}")
        settled.append(level.where(~is_open))
        residual = level.where(is_open)
        depth += 1
    toss = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    settled.append(residual.withColumn("fraction", F.when(toss < F.col("fraction"), 1.0).otherwise(0.0)))
    return reduce(DataFrame.unionByName, settled)


def mix_sources(documents: DataFrame, targets: DataFrame, total_tokens: float | str | None = None, seed: int = 7) -> Mix:
    """Documents with their number of uses so that each source has its share of all tokens.

    ``documents``: ``doc_id, source, n_tokens``; ``targets``:
    ``source, target_share, max_repeats``. ``total_tokens`` is the wanted total;
    by default the largest one at which no source with any tokens needs more
    than its repeats, and ``"corpus"`` stands for the tokens of all listed
    sources once. A source that cannot reach its share of that total within
    its repeats is used up and reported with ``out_of_reach``.

    Documents without tokens or id, of a null source or of one not listed are
    never chosen. A repeated id is one document, with its first source in
    order and its smallest size. Repeated rows of a target count once; if they disagree the larger
    share and the smaller limit hold; a null share or limit is 0. Without
    documents or targets the mix is empty.
    """
    scratch = Scratch(documents.sparkSession, "mix")
    wanted = (
        targets.where("source is not null")
        .groupBy("source")
        .agg(F.coalesce(F.max("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.min("max_repeats"), F.lit(0)).alias("max_repeats"))
    )
    whole = documents.select("doc_id", "source", F.col("n_tokens").cast("bigint").alias("n_tokens")).where("source is not null and n_tokens > 0 and doc_id is not null")
    rows = whole.groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens")).alias("row")).select("doc_id", "row.*")
    sizes = rows.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"), F.count(F.lit(1)).alias("available_documents"))
    sized = scratch.write(wanted.join(sizes, "source", "left").fillna(0, ["available_tokens", "available_documents"]), "sized")
    reach = F.col("max_repeats") * F.col("available_tokens")
    usable = sized.where("target_share > 0 and available_tokens > 0 and max_repeats > 0")
    corpus, in_reach, n_documents = usable.agg(F.sum("available_tokens").cast("double"), F.min(reach / F.col("target_share")), F.sum("available_documents")).first()
    if total_tokens is None or total_tokens == "corpus":
        total_tokens = (corpus if total_tokens else in_reach) or 0.0
    goal = F.col("target_share") * F.lit(float(total_tokens))
    plan = scratch.write(
        sized.withColumn("wanted_tokens", goal)
        .withColumn("out_of_reach", goal > reach * (1 + SURE))
        .withColumn("rate", F.when(F.col("available_tokens") > 0, F.least(goal / F.col("available_tokens"), F.col("max_repeats").cast("double"))).otherwise(F.lit(0.0))),
        "plan",
    )
    base = F.floor(F.col("rate") + F.lit(SURE)).cast("int")
    chosen = rows.join(plan.select("source", "rate"), "source").select(
        "doc_id", "source", "n_tokens", base.alias("base"), F.greatest(F.col("rate") - base, F.lit(0.0)).alias("fraction")
    )
    rounded = _round(chosen, scratch, seed, max(1, -(-(n_documents or 0) // LEAF_DOCUMENTS)))
    uses = rounded.select("doc_id", "source", "n_tokens", (F.col("base") + F.col("fraction").cast("int")).cast("bigint").alias("uses")).where("uses > 0")
    drawn = uses.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("chosen_tokens"), F.count(F.lit(1)).alias("n_documents"), F.sum("uses").alias("n_uses"))
    shares = plan.drop("rate", "available_documents").join(drawn, "source", "left").fillna(0, ["chosen_tokens", "n_documents", "n_uses"])
    whole = shares.agg(F.sum("chosen_tokens").alias("mix_tokens")).withColumn("one", F.lit(1))
    shares = shares.withColumn("one", F.lit(1)).join(whole, "one").drop("one")
    return Mix(uses, shares.withColumn("actual_share", F.col("chosen_tokens") / F.nullif("mix_tokens", F.lit(0))).drop("mix_tokens"), scratch)
