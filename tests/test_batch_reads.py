"""Reads for everybody against brute force, on graphs where one person holds much of what there is."""

import random

import pytest

from gregaria.graph import Graph
from gregaria.plans import batch_reads as b
from gregaria.schema import BASE


@pytest.fixture(scope="module", params=[1, 2])
def world(request, spark):
    r = random.Random(request.param)
    pairs = {(0, i) for i in range(1, 30)} | {tuple(sorted(r.sample(range(40), 2))) for _ in range(30)} | {(5, 5)}
    knows = [(a, c, 0) for p in pairs for a, c in {p, p[::-1]}]
    author = lambda: r.choice([0] * 6 + [None] + list(range(40)))
    posts = [(i, author(), r.randrange(60)) for i in range(150)]
    comments = [(i, author(), r.randrange(60), r.choice([7] * 5 + [None, *range(160)]), r.choice([None, *range(120, 200)])) for i in range(120, 220)]
    likes = [(p, m, s, r.randrange(90)) for p, m, s in {(r.randrange(40), r.choice([7] * 9 + list(range(230))), r.random() < 0.7) for _ in range(300)}]
    def table(rows, columns, name):
        held = {c.split(" ")[0] for c in columns.split(", ")}
        kinds = [c.split(" ", 1) for c in BASE[name].split(", ")]
        return spark.createDataFrame(rows, columns).selectExpr(*(c if c in held else f"cast(null as {kind}) as {c}" for c, kind in kinds))

    tables = {name: spark.createDataFrame([], spec) for name, spec in BASE.items()} | {
        "knows": table(knows, "p1 bigint, p2 bigint, creation_ms bigint", "knows"),
        "post": table(posts, "id bigint, creator_id bigint, creation_ms bigint", "post"),
        "comment": table(comments, "id bigint, creator_id bigint, creation_ms bigint, reply_of_post bigint, reply_of_comment bigint", "comment"),
        "likes": table(likes, "person_id bigint, message_id bigint, is_post boolean, creation_ms bigint", "likes"),
    }
    return Graph(spark, tables), pairs, posts, comments, likes


def circle(pairs, reader, hops):
    step = lambda people: {c for a, c in pairs if a in people} | {a for a, c in pairs if c in people}
    one = step({reader}) - {reader}
    return one if hops == 1 else (one | step(one)) - {reader}


@pytest.mark.parametrize("hops", [1, 2])
@pytest.mark.parametrize("limit", [1, 4])
def test_latest_messages(world, hops, limit):
    g, pairs, posts, comments, _ = world
    messages = [(i, c, t) for i, c, t, *_ in posts + comments if c is not None and t < 50]
    expected = set()
    for reader in range(40):
        near = circle(pairs, reader, hops)
        mine = sorted(((t, i, c) for i, c, t in messages if c in near), key=lambda m: (-m[0], m[1]))[:limit]
        expected |= {(reader, rank, t, i) for rank, (t, i, _) in enumerate(mine, 1)}
    found = [(x.reader, x["rank"], x.creation_ms, x.message_id) for x in b.latest_messages(g, hops, 50, limit).collect()]
    assert sorted(found) == sorted(expected)


@pytest.mark.parametrize("hops", [1, 2])
def test_circles(world, hops):
    g, pairs, *_ = world
    found = [tuple(x) for x in b.circles(g, hops).select("reader", "id").collect()]
    assert sorted(found) == sorted((reader, i) for reader in range(40) for i in circle(pairs, reader, hops))


@pytest.mark.parametrize(("limit", "wrote"), [(1, 0.1), (3, 0.2), (50, 0.9)])
def test_new_forums(world, limit, wrote):
    g, pairs, *_ = world
    r = random.Random(limit)
    members = {(r.choice([*range(60), None]), p): (r.randrange(10), r.randrange(1, 4) * (r.random() < wrote)) for p in range(40) for _ in range(p % 9)}
    tables = {**g.tables, "member_posts": g.spark.createDataFrame([(f, p, *x) for (f, p), x in members.items()], "forum_id bigint, person_id bigint, join_ms bigint, posts bigint")}
    expected = set()
    for reader in range(40):
        far, counts = circle(pairs, reader, 2), {}
        for (forum, p), (t, posts) in members.items():
            if p in far and t > 2:
                counts[forum] = counts.get(forum, 0) + posts
        first = sorted(counts.items(), key=lambda x: (-x[1], x[0] is None, x[0] or 0))[:limit]
        expected |= {(reader, forum, n, rank) for rank, (forum, n) in enumerate(first, 1)}
    found = [tuple(x) for x in b.new_forums(Graph(g.spark, tables), 2, limit).select("reader", "forum_id", "post_count", "rank").collect()]
    assert len(found) == len(expected) and set(found) == expected


def test_new_forums_makes_no_pairs_with_members_who_wrote_nothing(spark):
    r, people = random.Random(3), 200
    pairs = {tuple(sorted(r.sample(range(people), 2))) for _ in range(people * 8)}
    knows = spark.createDataFrame([(a, c, 0) for p in pairs for a, c in (p, p[::-1])], BASE["knows"])
    members = spark.createDataFrame([(r.randrange(2000), p, 1, 0) for p in range(people) for _ in range(20)], "forum_id bigint, person_id bigint, join_ms bigint, posts bigint").dropDuplicates(["forum_id", "person_id"])
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return sum(stage.shuffleWriteRecords() for stage in (stages.apply(i) for stages in [store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)] for i in range(stages.size())))

    before = shuffled()
    rows = b.new_forums(Graph(spark, {name: spark.createDataFrame([], spec) for name, spec in BASE.items()} | {"knows": knows, "member_posts": members}), 0, 2).count()
    assert rows == 2 * people
    assert shuffled() - before < 60_000  # 339,397 when all pairs met the forums of their members


def test_likers_and_replies(world):
    g, _, posts, comments, likes = world
    home = {(i, True): c for i, c, _ in posts} | {(i, False): c for i, c, *_ in comments}
    latest = {}
    for person, message, is_post, t in likes:
        reader = home.get((message, is_post))
        if reader is not None:
            latest[reader, person] = min(latest.get((reader, person), (1, 0)), (-t, message))
    expected = set()
    for reader in range(40):
        own = sorted((t, p, m) for (who, p), (t, m) in latest.items() if who == reader)[:3]
        expected |= {(reader, p, m, -t, rank) for rank, (t, p, m) in enumerate(own, 1)}
    assert {tuple(x) for x in b.latest_likers(g, 3).select("reader", "person_id", "message_id", "like_ms", "rank").collect()} == expected
    replies = [(home.get((post, True) if post is not None else (comment, False)), -t, i) for i, c, t, post, comment in comments if post is not None or comment is not None]
    expected = {(reader, i, rank) for reader in range(40) for rank, (_, _, i) in enumerate(sorted(x for x in replies if x[0] == reader)[:3], 1)}
    assert {(x.reader, x.comment_id, x["rank"]) for x in b.latest_replies(g, 3).collect()} == expected
