"""Physical plans of the reads: no whole table in one task, no shuffle of messages for one person."""

import re
from pathlib import Path

import pytest

from gregaria.operators import relational
from gregaria.operators.relational import Few
from gregaria.plans import graph_queries

DATA = "/root/testdata/sf0.001"
BIG = ("post", "comment", "likes", "replies", "message_root", "member_posts", "knows")


@pytest.fixture
def narrow(spark):
    """Broadcasts only of what is hinted or tiny, so that plans are those of large tables."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "20kB", "spark.sql.maxMetadataStringLength": "4000"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def tree(df):
    """Lines of the final plan as pairs of depth and operator."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    text = text.split("== Initial Plan ==")[0]
    return [(re.match(r"[\s:+\-*()\d]*", line).end(), re.sub(r"^[\s:+\-*()\d]*", "", line)) for line in text.splitlines() if line.strip()]


def ancestors(lines, at):
    depth = lines[at][0]
    for d, name in reversed(lines[:at]):
        if d < depth:
            depth = d
            yield name


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
@pytest.mark.parametrize("name", [f"ic{i}" for i in range(1, 13)] + ["is2", "is3", "is4", "is5", "is6", "is7"])
def test_no_whole_table_is_moved(narrow, name):
    df = graph_queries.QUERIES[name](narrow, DATA)
    lines = tree(df)
    assert not [n for _, n in lines if n.startswith("Coalesce 1")]
    seen = 0
    for at, (_, scan) in enumerate(lines):
        seen += scan.startswith("FileScan parquet") and "file:/" in scan
        if not scan.startswith("FileScan parquet") or not any(re.search(rf"/{t}[\],]", scan) for t in BIG):
            continue
        if re.search(r"PushedFilters: \[[^\]]*(EqualTo|In)\(", scan):
            continue
        for above in ancestors(lines, at):
            assert not above.startswith("Exchange hashpartitioning"), (above, scan)
            if "Join" in above or "Aggregate" in above:
                break
    assert seen


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
@pytest.mark.parametrize(("name", "key"), [("is4", "id"), ("is5", "id"), ("is7", "creator_id")])
def test_point_reads_push_their_key(narrow, name, key):
    scans = [n for _, n in tree(graph_queries.QUERIES[name](narrow, DATA)) if n.startswith("FileScan")]
    assert any(re.search(rf"PushedFilters: \[[^\]]*(EqualTo|In)\({key},", s) for s in scans)


def test_few_beyond_their_bounds(spark, rows, monkeypatch):
    """Lists of any length give the same rows, as literals, by broadcast and by a join."""
    keys = spark.createDataFrame([(i % 50,) for i in range(200)] + [(None,)], "k bigint")
    table = spark.createDataFrame([(i if i else None, str(i)) for i in range(80)], "id bigint, v string")
    expected = [(i, str(i)) for i in range(1, 50)]
    for literals, bound in ((1000, 100_000), (5, 100_000), (5, 5)):
        monkeypatch.setattr(relational, "FEW_LITERALS", literals)
        few = Few.of(keys, bound)
        assert (few.table is None) == (bound == 5)
        assert sorted(tuple(r) for r in few.semi(table, "id", "k").collect()) == expected
    assert Few.of(keys.limit(0)).semi(table, "id", "k").count() == 0


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")
@pytest.mark.parametrize("name", [f"ic{i}" for i in range(1, 15)] + [f"is{i}" for i in range(2, 8)])
def test_reads_with_long_frontiers(spark, name, monkeypatch):
    """Without any literals reads take their other path, with the same result."""
    expected = [tuple(r) for r in graph_queries.QUERIES[name](spark, DATA).collect()]
    monkeypatch.setattr(relational, "FEW_ROWS", 0)
    assert [tuple(r) for r in graph_queries.QUERIES[name](spark, DATA).collect()] == expected
