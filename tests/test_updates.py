import json

import pytest
from pyspark.sql import functions as F

import micro
from gregaria.graph import Graph
from gregaria.operators import relational
from gregaria.plans import short_reads as s
from gregaria.plans.updates import REQUESTS, apply_updates, split_updates, wide_schema
from gregaria.schema import BASE, DERIVED
from gregaria.sources import snapshot
from gregaria.sources.csv_graph import load_csv
from gregaria.streaming.updates import apply_batch, stream_updates

NOW = micro.ms(100)


@pytest.fixture(scope="module")
def g(spark, tmp_path_factory):
    data, store = tmp_path_factory.mktemp("csv"), tmp_path_factory.mktemp("store")
    return snapshot.save(load_csv(spark, micro.write(data)), f"file://{store}/graph")


def request(spark, kind, *rows):
    """Requests from dicts; columns left out are null."""
    return spark.createDataFrame([json.dumps(r) for r in rows], "string").select(F.from_json("value", REQUESTS[kind]).alias("r")).select("r.*")


def person(i, **more):
    return {"person_id": i, "first_name": "New", "last_name": "P", "creation_ms": NOW, "city_id": 1, "languages": ["z", "a"], "tag_ids": [51, 51, 999], "work_at": [{"org_id": 31, "year": 2020}, {"org_id": 99, "year": 1}]} | more


def test_persons(spark, g):
    out = apply_updates(g, {"iu1": request(spark, "iu1", person(1), person(70), person(70, first_name="Late", creation_ms=NOW + 1), person(71, city_id=404, tag_ids=None, work_at=None))})
    assert out.person.count() == 11 and g.person.count() == 9
    new = out.person.where("id = 70").first()
    assert (new.first_name, new.languages, new.city_id) == ("New", ["a", "z"], 1)
    assert out.person.where("id = 71").first().city_id is None
    assert [r.tag_id for r in out.person_interest.where("person_id = 70").collect()] == [51]
    assert [(r.org_id, r.work_from) for r in out.work_at.where("person_id = 70").collect()] == [(31, 2020)]


def test_likes_members_friendships_are_upserts(spark, g):
    out = apply_updates(
        g,
        {
            "iu2": request(spark, "iu2", {"person_id": 2, "post_id": 105, "creation_ms": NOW}, {"person_id": 2, "post_id": 105, "creation_ms": NOW + 5}, {"person_id": 2, "post_id": 999, "creation_ms": NOW}),
            "iu3": request(spark, "iu3", {"person_id": 9, "comment_id": 201, "creation_ms": NOW}, {"person_id": 99, "comment_id": 201, "creation_ms": NOW}),
            "iu5": request(spark, "iu5", {"person_id": 4, "forum_id": 62, "creation_ms": NOW}, {"person_id": 1, "forum_id": 61, "creation_ms": NOW}),
            "iu8": request(spark, "iu8", {"person_id": 8, "person2_id": 1, "creation_ms": NOW}, {"person_id": 8, "person2_id": 99, "creation_ms": NOW}),
        },
    )
    likes = {(r.person_id, r.message_id): r.creation_ms for r in out.likes.collect()}
    assert likes[2, 105] == NOW + 5 and likes[9, 201] == NOW and len(likes) == out.likes.count() == 6
    assert {(r.forum_id, r.person_id): (r.join_ms, r.posts) for r in out.member_posts.where("forum_id = 62 or person_id = 1").collect()} == {(62, 4): (NOW, 1), (62, 2): (micro.ms(3), 0), (61, 1): (NOW, 1)}
    assert {(r.p1, r.p2, r.weight) for r in out.friends.where("p1 = 8 or p2 = 8").collect()} == {(1, 8, 1.0), (8, 1, 1.0)}  # 205 answered a post of 1


def comment(i, **more):
    return {"comment_id": i, "creation_ms": NOW, "content": "new", "person_id": 2, "country_id": 11, "tag_ids": [51]} | more


def test_posts_and_chains_of_comments_in_one_batch(spark, g):
    out = apply_updates(
        g,
        {
            "iu1": request(spark, "iu1", person(70)),
            "iu4": request(spark, "iu4", {"forum_id": 600, "title": "F", "creation_ms": NOW, "person_id": 70, "tag_ids": [51]}, {"forum_id": 601, "title": "F", "creation_ms": NOW, "person_id": 99}),
            "iu6": request(spark, "iu6", {"post_id": 700, "person_id": 70, "forum_id": 600, "country_id": 11, "content": "x", "creation_ms": NOW, "tag_ids": [52]}, {"post_id": 701, "person_id": 70, "forum_id": 601, "country_id": 11, "creation_ms": NOW}, {"post_id": 702, "person_id": 2, "forum_id": 61, "country_id": 11, "creation_ms": 1}),
            "iu7": request(spark, "iu7", comment(803, reply_comment_id=802), comment(802, reply_comment_id=801), comment(801, post_id=700), comment(810, reply_comment_id=811), comment(811, reply_comment_id=810), comment(812, reply_comment_id=999), comment(813, person_id=1, reply_comment_id=202)),
        },
    )
    assert {r.id for r in out.comment.where("id > 300").collect()} == {801, 802, 803, 813}
    assert {r.id for r in out.post.where("id >= 700").collect()} == {700, 702}
    assert {r.message_id: r.post_id for r in out.message_root.where("message_id > 800").collect()} == {801: 700, 802: 700, 803: 700, 813: 101}
    assert out.member_posts.where("forum_id = 61 and person_id = 2").first().posts == 3
    assert out.friends.where("p1 = 1 and p2 = 2").first().weight == 2.0
    assert [r.forum_id for r in s.is6(out, 803).collect()] == [600]
    assert out.comment_tag.where("comment_id > 800").count() == 4 and out.forum_tag.where("forum_id = 600").count() == 1


def test_nothing_changes_on_replay_and_unknown_kind(spark, g):
    batch = {"iu1": request(spark, "iu1", person(70)), "iu7": request(spark, "iu7", comment(801, post_id=101))}
    once = apply_updates(g, batch)
    twice = apply_updates(once, batch)
    for name in ("person", "person_interest", "comment", "comment_tag"):
        assert sorted(map(str, once.tables[name].collect())) == sorted(map(str, twice.tables[name].collect()))
    assert apply_updates(g, {}) is g
    with pytest.raises(ValueError):
        apply_updates(g, {"iu9": batch["iu1"]})


def test_empty_batch_of_every_kind(spark, g):
    out = apply_updates(g, {k: spark.createDataFrame([], v) for k, v in REQUESTS.items()})
    assert {n: t.count() for n, t in out.tables.items()} == {n: g.tables[n].count() for n in out.tables}


def test_stream(spark, g, tmp_path):
    root, source = f"file://{tmp_path}/graph", tmp_path / "in"
    snapshot.save(g, root)
    source.mkdir()
    (source / "1.json").write_text("\n".join(json.dumps(r) for r in ({"op": "iu7"} | comment(801, post_id=101, creation_ms=1), {"op": "iu1"} | person(70))))
    start = lambda: stream_updates(spark, str(source), root, f"file://{tmp_path}/check", available_now="true").awaitTermination(120)
    assert start()
    (source / "2.json").write_text(json.dumps({"op": "iu8", "person_id": 70, "person2_id": 1, "creation_ms": 5}))
    assert start()
    now = snapshot.open_version(spark, root)
    assert now.person.count() == 10 and now.comment.where("id = 801").count() == 1 and now.knows.where("p1 = 70 and p2 = 1").count() == 1
    assert len(snapshot.versions(spark, root)) == 2


def test_a_batch_delivered_again_changes_nothing(spark, g, tmp_path):
    root = f"file://{tmp_path}/graph"
    snapshot.save(g, root)
    rows = spark.createDataFrame([json.dumps({"op": "iu8", "person_id": 8, "person2_id": 1, "creation_ms": 5})], "string").select(F.from_json("value", wide_schema()).alias("r")).select("r.*")
    assert split_updates(rows)["iu8"].count() == 1
    apply_batch(rows, 0, root)
    apply_batch(rows.limit(0), 1, root)
    apply_batch(rows, 0, root)
    assert snapshot.versions(spark, root) == [1, 2]


def batch_of_all(spark, n=0):
    """Requests of every kind that touch each other and what is stored; ``n`` sets apart the new ids of batches."""
    k = 1000 * n
    return {
        "iu1": request(spark, "iu1", person(70 + k)),
        "iu2": request(spark, "iu2", {"person_id": 70 + k, "post_id": 101, "creation_ms": NOW}, {"person_id": 2, "post_id": 105, "creation_ms": NOW - 10**12}),
        "iu3": request(spark, "iu3", {"person_id": 9, "comment_id": 201, "creation_ms": NOW + n}),
        "iu4": request(spark, "iu4", {"forum_id": 600 + k, "title": "F", "creation_ms": NOW, "person_id": 2, "tag_ids": [51]}),
        "iu5": request(spark, "iu5", {"person_id": 2, "forum_id": 600 + k, "creation_ms": NOW}, {"person_id": 4, "forum_id": 61, "creation_ms": NOW}, {"person_id": 2, "forum_id": 61, "creation_ms": 5}, {"person_id": 3, "forum_id": 61, "creation_ms": NOW + n}),
        "iu6": request(spark, "iu6", *({"post_id": i + k, "person_id": 2, "forum_id": f, "country_id": 11, "content": "x", "creation_ms": NOW, "tag_ids": [52]} for i, f in ((700, 600 + k), (701, 61)))),
        "iu7": request(
            spark, "iu7", comment(801 + k, post_id=700 + k), comment(802 + k, person_id=1, reply_comment_id=801 + k), comment(803 + k, person_id=8, post_id=105), comment(804 + k, person_id=4, reply_comment_id=203),
            comment(805 + k, person_id=3, reply_comment_id=204, post_id=101), comment(806 + k, person_id=2, post_id=101, reply_comment_id=807 + k), comment(807 + k, person_id=2, post_id=101, reply_comment_id=806 + k),
        ),
        "iu8": request(spark, "iu8", {"person_id": 8, "person2_id": 1, "creation_ms": NOW}, {"person_id": 2, "person2_id": 1, "creation_ms": 5}, {"person_id": 70 + k, "person2_id": 2, "creation_ms": NOW}, {"person_id": 3, "person2_id": 4, "creation_ms": NOW + n}),
    }


def contents(g):
    return {name: sorted(str(tuple(r)) for r in getattr(g, name).collect()) for name in [*BASE, *DERIVED]}


@pytest.mark.parametrize("few", [100_000, 0])
def test_changes_as_derived_anew(spark, g, few, monkeypatch, tmp_path):
    """Derived tables changed by increments are those derived from the base, over batches, stored versions and folds."""
    monkeypatch.setattr(relational, "FEW_ROWS", few)
    root = f"file://{tmp_path}/graph"
    snapshot.save(g, root)
    plain = Graph(spark, {name: g.tables[name] for name in BASE})
    for n in range(2):
        plain = apply_updates(plain, batch_of_all(spark, n))
        changed = apply_updates(snapshot.open_version(spark, root), batch_of_all(spark, n))
        stored = snapshot.append(changed, root)
    assert contents(stored) == contents(plain)
    with pytest.raises(snapshot.ConcurrentWrite):
        snapshot.append(changed, root)
    folded = snapshot.fold(spark, root, max_changes=0)
    assert folded.origin[1] == 4 and contents(folded) == contents(plain)
    snapshot.compact(spark, root)
    assert snapshot.versions(spark, root) == [4] and contents(snapshot.open_version(spark, root)) == contents(plain)


def test_older_upserts_change_nothing(spark, g, tmp_path):
    root = f"file://{tmp_path}/graph"
    snapshot.save(g, root)
    late = lambda ms: {"iu8": request(spark, "iu8", {"person_id": 8, "person2_id": 1, "creation_ms": ms}), "iu2": request(spark, "iu2", {"person_id": 8, "post_id": 101, "creation_ms": ms})}
    for ms, expected in ((50, 50), (40, 50), (60, 60), (60, 60)):
        now = snapshot.append(apply_updates(snapshot.open_version(spark, root), late(ms)), root)
        assert {r.creation_ms for r in now.knows.where("p1 in (1, 8) and p2 in (1, 8)").collect()} == {expected}
        assert [r.creation_ms for r in now.likes.where("person_id = 8 and message_id = 101").collect()] == [expected]


def test_a_batch_writes_no_more_than_it_changes(spark, g, tmp_path):
    root = f"file://{tmp_path}/graph"
    copies = g.post.select(*(F.expr("explode(sequence(1000000, 1100000))").alias("id") if c == "id" else F.col(c) for c in g.post.columns)).withColumn("id", F.col("id").cast("bigint"))
    many = g.with_tables(post=g.post.unionByName(copies.where("creator_id = 3")))
    snapshot.save(many, root)
    size = lambda: sum(p.stat().st_size for p in tmp_path.rglob("*.parquet"))
    before = size()
    rows = spark.createDataFrame([json.dumps({"op": "iu6", "post_id": 5, "person_id": 2, "forum_id": 61, "country_id": 11, "content": "x", "creation_ms": NOW})], "string").select(F.from_json("value", wide_schema()).alias("r")).select("r.*")
    apply_batch(rows, 0, root, keep=9)
    assert size() - before < before / 20
    assert snapshot.open_version(spark, root).post.where("id = 5").count() == 1


def test_a_writer_that_fails_leaves_nothing(spark, g, tmp_path):
    root = f"file://{tmp_path}/graph"
    snapshot.save(g, root)
    bad = Graph(spark, g.tables, {"post": g.post.withColumn("content", F.raise_error(F.lit("no")))}, snapshot.open_version(spark, root).origin)
    folders = len(list((tmp_path / "graph/data").iterdir()))
    with pytest.raises(Exception, match="no"):
        snapshot.append(bad, root)
    assert snapshot.versions(spark, root) == [1] and len(list((tmp_path / "graph/data").iterdir())) == folders
