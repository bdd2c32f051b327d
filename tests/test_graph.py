import pytest
from pyspark.sql import functions as F

import micro
from gregaria.operators import traversal
from gregaria.plans import complex_reads as c
from gregaria.plans import short_reads as s
from gregaria.sources import snapshot
from gregaria.sources.csv_graph import HeaderError, load_csv

ms = micro.ms


@pytest.fixture(scope="module")
def g(spark, tmp_path_factory):
    data, store = tmp_path_factory.mktemp("csv"), tmp_path_factory.mktemp("store")
    return snapshot.save(load_csv(spark, micro.write(data)), f"file://{store}/graph")


def get(df, *columns):
    return [tuple(r[k] for k in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()]


def test_loaded_values(g):
    ann = g.person.where("id = 1").first()
    assert (ann.languages, ann.emails, str(ann.birthday), ann.creation_ms) == (["en", "fr"], ["a@x", "b@x"], "1980-01-01", ms(0))
    assert g.person.where("id = 2").first().languages == []
    assert g.place.where("id = 21").first().part_of is None
    first, reply = (g.comment.where(f"id = {i}").first() for i in (201, 202))
    assert (first.reply_of_post, first.reply_of_comment, reply.reply_of_post, reply.reply_of_comment) == (101, None, None, 201)
    assert g.knows.count() == 14 and g.likes.count() == 5


def test_wrong_header_is_an_error(spark, tmp_path):
    micro.write(tmp_path)
    (tmp_path / "static/tag_0_0.csv").write_text("id|title|url|hasType\n1|a|u|2\n")
    with pytest.raises(HeaderError):
        load_csv(spark, str(tmp_path))
    (tmp_path / "static/tag_0_0.csv").write_text("")
    with pytest.raises(HeaderError):
        load_csv(spark, str(tmp_path))


def test_derived(g):
    weights = {(r.p1, r.p2): r.weight for r in g.friends.collect()}
    assert weights[1, 2] == weights[2, 1] == 1.5  # 201 answers a post of 2, 202 a comment of 1
    assert (weights[2, 4], weights[1, 3], weights[6, 7]) == (0.5, 1.0, 0.0)
    assert {(r.forum_id, r.person_id): r.posts for r in g.member_posts.collect()} == {(61, 2): 2, (61, 3): 1, (62, 4): 1, (62, 2): 0}
    assert {r.message_id: r.post_id for r in g.message_root.where("not is_post").collect()} == {201: 101, 202: 101, 203: 101, 204: 105, 205: 105}


def test_traversal(g):
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(traversal.multihop(g.knows, 1, 1)) == [2, 3, 9]
    assert ids(traversal.multihop(g.knows, 1, 2)) == [2, 3, 4, 9]
    assert ids(traversal.ring(g.knows, 1, 2)) == [4]
    assert {r.id: r.level for r in traversal.bfs_levels(g.knows, 1, 3).collect()} == {2: 1, 3: 1, 9: 1, 4: 2, 5: 3}
    children = g.spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "parent bigint, id bigint")
    roots = g.spark.createDataFrame([(1,)], "id bigint")
    assert ids(traversal.descend(children, roots)) == [1, 2, 3, 4]
    assert ids(traversal.descend(children, roots, 1)) == [1, 2]


def test_paths(g):
    for a, b, length in ((1, 5, 3), (5, 1, 3), (1, 2, 1), (1, 1, 0), (1, 6, -1), (1, 8, -1), (1, 99, -1)):
        assert traversal.shortest_path(g.knows, a, b) == length
    assert traversal.shortest_path(g.knows, 1, 5, max_hops=2) == -1
    paths = get(c.ic14(g, 1, 5), "person_ids_in_path", "path_weight")
    assert paths == [([1, 2, 4, 5], 2.0), ([1, 3, 4, 5], 1.0)]
    assert get(c.ic14(g, 5, 1), "person_ids_in_path") == [[5, 4, 2, 1], [5, 4, 3, 1]]
    assert get(c.ic14(g, 1, 1), "person_ids_in_path", "path_weight") == [([1], 0.0)]
    assert c.ic14(g, 1, 6).count() == 0 and c.ic14(g, 1, 99).count() == 0
    assert c.ic13(g, 1, 5).first()[0] == 3 and c.ic13(g, 99, 99).first()[0] == -1


def test_ic1(g):
    out = c.ic1(g, 1, "Bob")
    assert get(out, "friend_id", "distance", "rank") == [(2, 1, 1), (9, 1, 2), (5, 3, 3)]
    five, two = (out.where(f"friend_id = {i}").first() for i in (5, 2))
    assert (five.uni_name, five.uni_year, five.uni_city, five.company_name) == (["Uni"], [2001], ["Ce"], ["Firm"])
    assert (two.uni_name, two.company_name, two.company_year, two.company_city) == ([], ["Firm", "Best"], [2005, 2005], ["Yland", "Yland"])
    assert c.ic1(g, 99, "Bob").count() == 0


def test_ic2_takes_the_bound_and_ic9_does_not(g):
    assert get(c.ic2(g, 1, ms(2)), "message_id") == [102, 103, 101]
    assert get(c.ic9(g, 1, ms(2)), "message_id") == [101]
    assert get(c.ic2(g, 1, ms(2)), "content") == ["pic.jpg", "third", "hello"]
    assert get(c.ic2(g, 1, ms(9), limit=2), "message_id") == [204, 202]
    assert c.ic2(g, 1, ms(9), limit=0).count() == 0
    assert c.ic2(g, 1, ms(9), limit=None).count() == 5
    assert {r.message_id for r in c.ic9(g, 1, ms(9), None).collect()} >= {r.message_id for r in c.ic2(g, 1, ms(9) - 1, None).collect()}


def test_ic3(g):
    # 2 lives in Xland; 4 too: with X and Y as other countries they count
    assert get(c.ic3(g, 1, "Zland", "Yland", ms(0), 30), "person_id", "x_count", "y_count", "count") == [(4, 1, 1, 2)]
    assert c.ic3(g, 1, "Xland", "Yland", ms(0), 30).count() == 0
    assert c.ic3(g, 1, "Zland", "Yland", ms(0), 4).count() == 0
    assert c.ic3(g, 1, "Zland", "Nowhere", ms(0), 30).count() == 0


def test_ic4_to_ic6(g):
    assert get(c.ic4(g, 1, ms(2), 1), "tag_name", "post_count") == [("misc", 1), ("rock", 1)]
    assert get(c.ic5(g, 1, ms(1)), "forum_id", "post_count") == [(61, 1), (62, 1)]
    assert get(c.ic6(g, 1, "jazz"), "tag_name", "post_count") == [("paint", 1), ("rock", 1)]
    assert c.ic6(g, 1, "none").count() == 0


def test_ic7_takes_the_latest_like_and_ic8(g):
    out = get(c.ic7(g, 1), "person_id", "message_id", "minutes_latency", "is_new")
    assert out == [(2, 201, 4 * 1440, False), (8, 105, 25 * 60, True), (3, 201, -1440, False)]
    assert get(c.ic8(g, 1), "comment_id", "person_id") == [(204, 3), (205, 8), (202, 2)]
    assert c.ic8(g, 99).count() == 0


def test_ic10(g):
    assert get(c.ic10(g, 1, 6), "person_id") == [4]  # born on the 21st: at either end
    assert get(c.ic10(g, 1, 7), "person_id") == []
    assert get(c.ic10(g, 1, 5), "person_id", "common_interest_score", "city_name") == [(4, -1, "Ce")]
    assert get(c.ic10(g, 4, 12), "person_id") == [1]  # January follows December
    assert get(c.ic10(g, 2, 4), "person_id", "common_interest_score") == [(9, 0), (3, -1)]
    assert get(c.ic10(g, 2, 5), "person_id", "common_interest_score") == [(3, -1)]


def test_ic11_and_ic12(g):
    assert get(c.ic11(g, 1, "Yland", 2006), "person_id", "organization_name", "work_from") == [(4, "Firm", 2004), (2, "Firm", 2005), (2, "Best", 2005)]
    assert c.ic11(g, 1, "Yland", 2004).count() == 0
    assert get(c.ic12(g, 2, "Thing"), "person_id", "tag_names", "reply_count") == [(1, ["jazz", "paint"], 1)]
    assert get(c.ic12(g, 2, "Music"), "tag_names") == [["jazz"]]
    assert c.ic12(g, 2, "None").count() == 0


def test_short_reads(g):
    assert get(s.is1(g, 1), "first_name", "birthday_ms", "city_id") == [("Ann", 315_532_800_000, 1)]
    assert get(s.is2(g, 4), "message_id", "original_post_id", "original_post_author_id") == [(203, 101, 2), (104, 104, 4)]
    assert get(s.is3(g, 1), "person_id") == [9, 2, 3]
    assert get(s.is4(g, 102), "content") == ["pic.jpg"] and get(s.is4(g, 201), "content") == ["c1"]
    assert get(s.is5(g, 203), "person_id") == [4]
    assert get(s.is6(g, 203), "forum_id", "moderator_id") == [(61, 2)]
    assert get(s.is7(g, 105), "comment_id", "knows") == [(204, True), (205, False)]
    assert get(s.is7(g, 201), "comment_id", "knows") == [(202, True)]
    assert all(f(g, 999).count() == 0 for f in (s.is1, s.is2, s.is3, s.is4, s.is5, s.is6, s.is7))


def test_plans(g):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(p1)" in plan(traversal.first_step(g.knows, 1))
    assert "TakeOrderedAndProject" in plan(c.ic2(g, 1, ms(9)))
    assert "CartesianProduct" not in plan(c.ic3(g, 1, "Xland", "Yland", ms(0), 3)) and "NestedLoop" not in plan(c.ic3(g, 1, "Xland", "Yland", ms(0), 3))


def test_post_wins_over_a_comment_of_its_id(g):
    both = g.with_tables(comment=g.comment.unionByName(g.comment.where("id = 205").withColumn("id", F.lit(101).cast("bigint"))))
    assert get(s.is4(both, 101), "content") == ["hello"] and get(s.is6(both, 101), "forum_id") == [61]


def test_snapshot_versions(g, spark, tmp_path):
    root = f"file://{tmp_path}/g"
    with pytest.raises(FileNotFoundError):
        snapshot.open_version(spark, root)
    snapshot.open_or_build(spark, root, lambda: g)
    snapshot.open_or_build(spark, root, lambda: pytest.fail("built again"))
    snapshot.save(g, root)
    (tmp_path / "g/v3").mkdir()  # a writer died here
    assert snapshot.versions(spark, root) == [1, 2]
    assert snapshot.open_version(spark, root).person.count() == 9
    snapshot.compact(spark, root)
    assert snapshot.versions(spark, root) == [2]
