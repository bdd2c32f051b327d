import datetime
import random

import pytest

from gregaria.operators.references import broken_references, parent_intervals


def at(day):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day)


def tables(spark, parents, removals, references):
    people = spark.createDataFrame([(k, at(d)) for k, d in parents], "key bigint, arrived timestamp_ntz")
    gone = spark.createDataFrame([("person", k, at(d)) for k, d in removals], "kind string, key bigint, removed_at timestamp_ntz")
    refs = spark.createDataFrame([("person", k, i, at(d), i) for i, (k, d) in enumerate(references)], "kind string, key bigint, record_id bigint, seen_at timestamp_ntz, salt bigint")
    return parent_intervals({"person": people}, gone), refs


def brute(parents, removals, references):
    out = {}
    for i, (key, day) in enumerate(references):
        arrivals = [d for k, d in parents if k == key]
        gone = [d for k, d in removals if k == key]
        if key is None or key == -1:
            continue
        if not arrivals:
            out[i] = "missing"
        elif gone and max(gone) >= max(arrivals):
            out[i] = "deleted"
        elif min(arrivals) > day:
            out[i] = "late"
    return out


@pytest.mark.parametrize("share", [1 / 64, 0.9])
def test_faults_as_by_brute_force(spark, share):
    r = random.Random(4)
    parents = [(r.randrange(60), r.randrange(50)) for _ in range(80)]
    removals = [(r.randrange(80), r.randrange(60)) for _ in range(25)] + [(None, 3)]
    references = [(r.choice([5] * 40 + [None, -1, 0, *range(80)]), r.randrange(50)) for _ in range(900)]
    intervals, refs = tables(spark, parents, removals, references)
    out = broken_references(refs, intervals, hot_share=share)
    assert out.columns == ["kind", "key", "record_id", "seen_at", "salt", "fault"]
    found = {r.record_id: r.fault for r in out.collect()}
    assert found == brute(parents, removals, references)
    assert out.count() == len(found)


def test_a_removal_before_a_new_delivery_does_not_count(spark, rows):
    intervals, refs = tables(spark, [(1, 0), (1, 9), (2, 0)], [(1, 5), (2, 0)], [(1, 3), (2, 3)])
    assert [(r.record_id, r.fault) for r in broken_references(refs, intervals).collect()] == [(1, "deleted")]


def test_empty(spark):
    intervals, refs = tables(spark, [], [], [(1, 3), (1, 3), (None, 1)])
    assert [r.fault for r in broken_references(refs, intervals).collect()] == ["missing", "missing"]
    assert broken_references(refs.limit(0), intervals).count() == 0


def test_merge_not_hash(spark):
    intervals, refs = tables(spark, [(1, 0)], [], [(1, 3)])
    assert "SortMergeJoin" in broken_references(refs, intervals)._jdf.queryExecution().toString()
