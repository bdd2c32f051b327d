import random

import pytest

from gregaria.llm import mixing, queries
from gregaria.llm.mixing import mix_sources, pivot, pivot_all


def documents(spark, seed=1):
    r = random.Random(seed)
    sources = ["big"] * 600 + ["mid"] * 250 + ["small"] * 30 + ["unlisted"] * 40 + [None] * 10
    rows = [(i, s, r.choice([0, 3, 40, 200, 1000]), "x") for i, s in enumerate(sources)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint, uses string").repartition(50), rows


TARGETS = [("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 4)]


def targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def test_shares_and_limits(spark):
    df, rows = documents(spark)
    mix = mix_sources(df, targets(spark, TARGETS))
    uses = {r.doc_id: r for r in mix.uses.collect()}
    assert mix.uses.count() == len(uses)
    limit = {s: m for s, _, m in TARGETS}
    by = {i: (s, n) for i, s, n, _ in rows}
    assert all(1 <= r.uses <= limit[r.source] and by[i] == (r.source, r.n_tokens) and r.n_tokens > 0 for i, r in uses.items())
    for r in mix.shares.collect():
        chosen = sum(u.n_tokens * u.uses for u in uses.values() if u.source == r.source)
        assert r.chosen_tokens == chosen and abs(chosen - r.wanted_tokens) < 1000 and not r.out_of_reach
        assert abs(r.actual_share - r.target_share) < 0.02
        copies = [u.uses for u in uses.values() if u.source == r.source]
        assert max(copies) - min(copies) <= 1


def test_out_of_reach_is_reported(spark):
    df, rows = documents(spark)
    mix = mix_sources(df, targets(spark, [*TARGETS, ("absent", 0.0, 3), ("gone", 0.1, 3)]), total_tokens="corpus")
    shares = {r.source: r for r in mix.shares.collect()}
    assert shares["small"].out_of_reach and shares["gone"].out_of_reach and not shares["absent"].out_of_reach
    assert shares["small"].chosen_tokens == 4 * sum(n for _, s, n, _ in rows if s == "small")
    assert shares["gone"].chosen_tokens == 0


def test_same_choice_each_time(spark):
    df, _ = documents(spark)
    choice = lambda seed: {r.doc_id: r.uses for r in mix_sources(df, targets(spark, TARGETS), seed=seed).uses.collect()}
    assert choice(3) == choice(3) and choice(3) != choice(4)


def test_same_choice_however_rows_lie(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF_DOCUMENTS", 20)
    df, rows = documents(spark)
    choices = []
    for parts, shuffled in ((1, "2"), (7, "5")):
        spark.conf.set("spark.sql.shuffle.partitions", shuffled)
        mix = mix_sources(df.repartition(parts), targets(spark, TARGETS))
        choices.append({r.doc_id: r.uses for r in mix.uses.collect()})
        assert all(abs(r.chosen_tokens - r.wanted_tokens) < 1000 for r in mix.shares.collect())
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert choices[0] == choices[1]


def test_a_repeated_id_is_one_document(spark):
    df, rows = documents(spark)
    twice = mix_sources(df.unionByName(df), targets(spark, TARGETS)).uses
    once = mix_sources(df, targets(spark, TARGETS)).uses
    assert twice.groupBy("doc_id").count().where("count > 1").count() == 0
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))


def test_every_document_has_its_expected_uses():
    counts = dict.fromkeys(range(20), 0)
    for seed in range(60):
        chosen, left = pivot_all([(i, 10 + 30 * (i % 2), 0.4) for i in range(20)], seed)
        for i, _, p in chosen + ([left] if left else []):
            counts[i] += p
    assert all(0.12 < c / 60 < 0.7 for c in counts.values()) and abs(sum(counts.values()) / 60 - 8) < 1.5


@pytest.mark.parametrize("seed", range(30))
def test_pivot_keeps_mass(seed):
    r = random.Random(seed)
    a, b = (1, r.randint(1, 99), r.random()), (2, r.randint(1, 99), r.random())
    x, y = pivot(a, b, seed)
    assert abs(a[1] * a[2] + b[1] * b[2] - x[1] * x[2] - y[1] * y[2]) < 1e-6
    assert x[2] in (0, 1) or y[2] in (0, 1)
    assert all(0 <= p[2] <= 1 for p in (x, y))


def test_empty_null_and_repeated_targets(spark):
    df, _ = documents(spark)
    repeated = targets(spark, [*TARGETS, *TARGETS, (None, 0.5, 1), ("unlisted", None, None)])
    mix = mix_sources(df, repeated)
    assert {r.source for r in mix.uses.collect()} == {"big", "mid", "small"}
    assert mix_sources(df.limit(0), repeated).uses.count() == 0
    assert mix_sources(df, repeated.limit(0)).uses.count() == 0
    assert {r.source for r in mix_sources(df.limit(0), repeated).shares.where("out_of_reach").collect()} == set()


def test_a_tiny_source_does_not_shrink_the_registered_mix(spark, tmp_path):
    texts = [(i, "the reader opens the file and checks it " * (5 + i % 7), "big") for i in range(60)] + [(99, "a small page", "tiny")]
    spark.createDataFrame(texts, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    targets(spark, [("big", 0.92, 1), ("tiny", 0.08, 3)]).write.parquet(f"{tmp_path}/mix_target.parquet")
    uses = queries.p7_mix(spark, str(tmp_path)).collect()
    shares = {r.source: r for r in queries.p7_shares(spark, str(tmp_path)).collect()}
    assert shares["tiny"].out_of_reach and not shares["big"].out_of_reach
    assert [r.uses for r in uses if r.source == "tiny"] == [3]
    assert sum(r.n_tokens * r.uses for r in uses) > 0.9 * sum(r.available_tokens for r in shares.values())
    assert not any(r.out_of_reach for r in queries.p7_shares_in_reach(spark, str(tmp_path)).collect())
