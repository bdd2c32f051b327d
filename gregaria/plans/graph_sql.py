"""The queries of ``graph_queries`` in SQL over the same relational tables, for comparison."""

from gregaria.schema import BASE

GRAPH = """
WITH RECURSIVE
g_person AS (SELECT c_custkey AS id, c_mktsegment AS first_name, c_name AS last_name, CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS gender,
  (DATE '1980-01-01' + (c_custkey * 37 % 7300)::INTEGER)::DATE AS birthday, 1262304000000 + c_custkey * 60000 AS creation_ms, concat('10.0.', c_custkey % 256, '.1') AS location_ip,
  CASE WHEN c_custkey % 3 = 0 THEN 'Firefox' ELSE 'Chrome' END AS browser_used, c_nationkey::BIGINT AS city_id, concat('en|l', c_custkey % 7) AS languages,
  concat('c', c_custkey, '@mail.example') AS emails FROM customer),
g_place AS (SELECT n_nationkey::BIGINT AS id, n_name AS name, NULL::VARCHAR AS url, 'city' AS type, (1000 + n_regionkey)::BIGINT AS part_of FROM nation
  UNION ALL SELECT 1000 + r_regionkey, r_name, NULL, 'country', NULL FROM region),
g_org AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'company' ELSE 'university' END AS type, s_name AS name, NULL::VARCHAR AS url, (1000 + n_regionkey)::BIGINT AS place_id
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
named AS (SELECT p_name, dense_rank() OVER (ORDER BY p_name) - 1 AS tag_id, split_part(p_name, ' ', 2) AS noun FROM (SELECT DISTINCT p_name FROM part WHERE p_name IS NOT NULL)),
chain AS (SELECT DISTINCT noun AS name, concat('Len', length(noun)) AS parent FROM named UNION SELECT DISTINCT concat('Len', length(noun)), 'Product' FROM named UNION SELECT DISTINCT 'Product', NULL FROM named),
classes AS (SELECT name, parent, dense_rank() OVER (ORDER BY name) - 1 AS id FROM chain),
g_tagclass AS (SELECT a.id, a.name, NULL::VARCHAR AS url, b.id AS parent_id FROM classes AS a LEFT JOIN classes AS b ON b.name = a.parent),
g_tag AS (SELECT tag_id AS id, p_name AS name, NULL::VARCHAR AS url, classes.id AS class_id FROM named JOIN classes ON classes.name = noun),
g_forum AS (SELECT s_suppkey AS id, s_name AS title, 1262304000000 + s_suppkey * 60000 AS creation_ms, s_suppkey AS moderator_id FROM supplier),
forums AS (SELECT l_orderkey, min(l_suppkey) AS forum_id FROM lineitem GROUP BY 1),
g_post AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 = 0 THEN concat('photo', o_orderkey, '.jpg') END AS image_file, (epoch_us(o_orderdate) // 1000) AS creation_ms, NULL::VARCHAR AS location_ip,
  NULL::VARCHAR AS browser_used, NULL::VARCHAR AS language, CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE o_orderpriority END AS content, o_custkey AS creator_id,
  coalesce(forum_id, 0) AS forum_id, 1000 + o_orderkey % 5 AS country_id FROM orders LEFT JOIN forums ON l_orderkey = o_orderkey),
g_post_tag AS (SELECT DISTINCT l_orderkey AS post_id, tag_id FROM lineitem JOIN part ON p_partkey = l_partkey JOIN named USING (p_name)),
own AS (SELECT lineitem.* FROM lineitem WHERE l_partkey IN (SELECT c_custkey FROM customer)),
writers AS (SELECT l_orderkey AS event_id, min(l_partkey) AS writer FROM own WHERE l_linenumber = 1 GROUP BY 1),
g_comment AS (SELECT 10000000 + event_id AS id, (epoch_us(ts) // 1000) AS creation_ms, NULL::VARCHAR AS location_ip, NULL::VARCHAR AS browser_used, concat(event_type, ' ', props) AS content,
  coalesce(writer, user_id) AS creator_id, 1000 + event_id % 5 AS country_id, CASE WHEN event_id % 3 <> 2 THEN event_id - event_id % 3 END AS reply_of_post,
  CASE WHEN event_id % 3 = 2 THEN 10000000 + event_id // 2 END AS reply_of_comment FROM events LEFT JOIN writers USING (event_id)),
g_message AS (SELECT id, creator_id, creation_ms, country_id, TRUE AS is_post, coalesce(nullif(content, ''), image_file) AS content FROM g_post
  UNION ALL SELECT id, creator_id, creation_ms, country_id, FALSE, content FROM g_comment),
pairs AS (SELECT least(o_custkey, l_partkey) AS a, greatest(o_custkey, l_partkey) AS b, min((epoch_us(l_shipdate) // 1000)) AS creation_ms
  FROM own JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1 AND o_custkey <> l_partkey GROUP BY 1, 2),
g_knows AS (SELECT a AS p1, b AS p2, creation_ms FROM pairs UNION ALL SELECT b, a, creation_ms FROM pairs),
g_likes AS (SELECT l_partkey AS person_id, l_orderkey AS message_id, TRUE AS is_post, min((epoch_us(l_shipdate) // 1000)) AS creation_ms
  FROM own JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate GROUP BY 1, 2),
g_member AS (SELECT l_suppkey AS forum_id, l_partkey AS person_id, min((epoch_us(l_shipdate) // 1000)) AS join_ms FROM own GROUP BY 1, 2),
g_work AS (SELECT l_partkey AS person_id, l_suppkey AS org_id, min(year(l_shipdate))::INTEGER AS work_from FROM own WHERE l_linenumber = 2 GROUP BY 1, 2),
g_study AS (SELECT l_partkey AS person_id, l_suppkey AS org_id, min(year(l_shipdate))::INTEGER AS class_year FROM own WHERE l_linenumber = 3 GROUP BY 1, 2),
g_interest AS (SELECT DISTINCT person_id, tag_id FROM (SELECT c_custkey AS person_id, unnest([c_custkey % 64, (c_custkey * 7 + 3) % 64, (c_custkey * 13 + 5) % 64]) AS tag_id FROM customer)
  WHERE tag_id IN (SELECT id FROM g_tag)),
g_comment_tag AS (SELECT 10000000 + event_id AS comment_id, event_id * 7 % 64 AS tag_id FROM events WHERE event_id * 7 % 64 IN (SELECT id FROM g_tag)),
g_forum_tag AS (SELECT s_suppkey AS forum_id, s_suppkey * 3 % 64 AS tag_id FROM supplier WHERE s_suppkey * 3 % 64 IN (SELECT id FROM g_tag)),
"""
# posts, comments, friendships and memberships by name, so that the same text serves before and after an update
POSTS = "SELECT forum_id, creator_id AS person_id, count(*) AS posts FROM {post} GROUP BY 1, 2"
WEIGHTS = """SELECT least(creator_id, author) AS a, greatest(creator_id, author) AS b, sum(weight) AS weight FROM (
  SELECT c.creator_id, p.creator_id AS author, 1.0::DOUBLE AS weight FROM {comment} AS c JOIN g_post AS p ON p.id = c.reply_of_post
  UNION ALL SELECT c.creator_id, p.creator_id, 0.5 FROM {comment} AS c JOIN {comment} AS p ON p.id = c.reply_of_comment WHERE c.reply_of_post IS NULL) GROUP BY 1, 2"""


def _members(member: str, post: str) -> str:
    return f"SELECT m.forum_id, m.person_id, m.join_ms, coalesce(posts, 0) AS posts FROM {member} AS m LEFT JOIN ({POSTS.format(post=post)}) AS w ON w.forum_id = m.forum_id AND w.person_id = m.person_id"


def _friends(knows: str, comment: str) -> str:
    return f"SELECT p1, p2, creation_ms, coalesce(weight, 0) AS weight FROM {knows} LEFT JOIN ({WEIGHTS.format(comment=comment)}) AS w ON a = least(p1, p2) AND b = greatest(p1, p2)"


HOPS = """
h1 AS (SELECT DISTINCT p2 AS id FROM g_knows WHERE p1 = 1 AND p2 <> 1),
h2 AS (SELECT DISTINCT p2 AS id FROM g_knows WHERE p1 IN (SELECT id FROM h1) AND p2 <> 1),
h3 AS (SELECT DISTINCT p2 AS id FROM g_knows WHERE p1 IN (SELECT id FROM h2) AND p2 <> 1),
fof AS (SELECT id FROM h1 UNION SELECT id FROM h2),
levels AS (SELECT id, min(level)::INTEGER AS level FROM (SELECT id, 1 AS level FROM h1 UNION ALL SELECT id, 2 FROM h2 UNION ALL SELECT id, 3 FROM h3) GROUP BY id),
g_member_posts AS (""" + _members("g_member", "g_post") + """),
g_friends AS (""" + _friends("g_knows", "g_comment") + """),
below AS (SELECT id FROM g_tagclass WHERE name = 'Len4' UNION ALL SELECT t.id FROM below JOIN g_tagclass AS t ON t.parent_id = below.id),
class_tags AS (SELECT t.id AS tag_id, t.name FROM g_tag AS t WHERE class_id IN (SELECT id FROM below)),
up AS (SELECT id AS message_id, coalesce(reply_of_comment, -1 - reply_of_post) AS parent FROM g_comment),
walk AS (SELECT message_id, parent FROM up UNION ALL SELECT w.message_id, u.parent FROM walk AS w JOIN up AS u ON u.message_id = w.parent WHERE w.parent >= 0),
root AS (SELECT message_id, FALSE AS is_post, -1 - parent AS post_id FROM walk WHERE parent < 0 AND -1 - parent IN (SELECT id FROM g_post)
  UNION ALL SELECT id, TRUE, id FROM g_post),
reach AS (SELECT 1 AS node, 0 AS depth UNION SELECT k.p2, r.depth + 1 FROM reach AS r JOIN g_knows AS k ON k.p1 = r.node WHERE r.depth < 4),
dist AS (SELECT node, min(depth) AS depth FROM reach GROUP BY node),
ways AS (SELECT 1::BIGINT AS node, '1' AS path, 0.0::DOUBLE AS weight, 0 AS depth
  UNION ALL SELECT f.p2, w.path || '|' || f.p2, w.weight + f.weight, w.depth + 1 FROM ways AS w JOIN g_friends AS f ON f.p1 = w.node JOIN dist AS d ON d.node = f.p2 AND d.depth = w.depth + 1),
"""


def _q(body: str, rest: str = "", with_hops: bool = True) -> str:
    prefix = GRAPH + (HOPS if with_hops else "") + rest
    return prefix.rstrip().rstrip(",") + "\n" + body


def _top(body: str, order: str, limit: int = 20) -> str:
    """``body`` as the table t, its first rows with their rank."""
    return _q(f"SELECT *, row_number() OVER (ORDER BY {order}) AS rank FROM ({body}) ORDER BY rank LIMIT {limit}")


NAMES = "JOIN g_person AS p ON p.id = {key}"
MESSAGES = "SELECT m.creator_id AS person_id, first_name, last_name, m.id AS message_id, content, m.creation_ms FROM g_message AS m JOIN g_person AS p ON p.id = m.creator_id WHERE m.creator_id IN (SELECT id FROM {people}) AND m.creation_ms {bound}"
MS_2000, MS_1995, MS_1998, MS_199606 = 946684800000, 788918400000, 883612800000, 833587200000
DAY, NEW, NOW = 86400000, 1_000_000, 1_800_000_000_000
IS7 = """SELECT c.id AS comment_id, c.content, c.creation_ms, c.creator_id AS reply_author_id, a.first_name AS reply_author_first_name, a.last_name AS reply_author_last_name,
  EXISTS (SELECT 1 FROM g_knows WHERE p1 = m.creator_id AND p2 = c.creator_id AND p1 <> p2) AS knows
  FROM g_comment AS c JOIN g_post AS m ON m.id = c.reply_of_post JOIN g_person AS a ON a.id = c.creator_id WHERE m.id = 3"""


def _held(table: str, year: str, prefix: str) -> str:
    lists = ", ".join(f"string_agg({c}, '|' ORDER BY org_id, {year}) AS {prefix}_{n}" for n, c in (("name", "o.name"), ("year", f"{year}::VARCHAR"), ("city", "pl.name")))
    return f"(SELECT person_id, {lists} FROM {table} JOIN g_org AS o ON o.id = org_id JOIN g_place AS pl ON pl.id = o.place_id GROUP BY 1)"


IC1 = f"""SELECT l.id AS friend_id, last_name AS friend_last_name, level AS distance, (birthday - DATE '1970-01-01')::BIGINT * {DAY} AS birthday_ms, creation_ms, gender, browser_used, location_ip,
  emails, languages, c.name AS city_name, {', '.join(f"coalesce({a}.{p}_{n}, '') AS {p}_{n}" for a, p in (('s', 'uni'), ('w', 'company')) for n in ('name', 'year', 'city'))}
  FROM levels AS l JOIN g_person AS p ON p.id = l.id LEFT JOIN g_place AS c ON c.id = p.city_id LEFT JOIN {_held('g_study', 'class_year', 'uni')} AS s ON s.person_id = l.id
  LEFT JOIN {_held('g_work', 'work_from', 'company')} AS w ON w.person_id = l.id WHERE first_name = 'BUILDING'"""

CIRCLES = """
near AS (SELECT DISTINCT p1 AS reader, p2 AS id FROM g_knows WHERE p1 <> p2),
far AS (SELECT reader, id FROM near UNION SELECT a.reader, b.id FROM near AS a JOIN near AS b ON b.reader = a.id WHERE a.reader <> b.id),
"""


def _each(body: str, order: str, limit: int = 20) -> str:
    """``body`` as the table t, the first rows of each reader with their rank."""
    return _q(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY reader ORDER BY {order}) AS rank FROM ({body})) WHERE rank <= {limit}", CIRCLES)


def _all_messages(circle: str) -> str:
    body = f"SELECT reader, c.id AS person_id, m.id AS message_id, m.creation_ms FROM {circle} AS c JOIN g_message AS m ON m.creator_id = c.id WHERE m.creation_ms < {MS_2000}"
    return _each(body, "creation_ms DESC, message_id")


SQL = {
    "all_ic2": _all_messages("near"),
    "all_ic9": _all_messages("far"),
    "all_ic5": _each(f"SELECT reader, forum_id, sum(posts)::BIGINT AS post_count FROM far AS c JOIN g_member_posts AS m ON m.person_id = c.id WHERE join_ms > {MS_1998} GROUP BY 1, 2", "post_count DESC, forum_id"),
    "all_ic7": _each(
        """SELECT reader, person_id, message_id, like_ms FROM (SELECT m.creator_id AS reader, person_id, message_id, k.creation_ms AS like_ms,
          row_number() OVER (PARTITION BY m.creator_id, person_id ORDER BY k.creation_ms DESC, message_id) AS turn FROM g_likes AS k JOIN g_message AS m ON m.id = k.message_id AND m.is_post = k.is_post) WHERE turn = 1""",
        "like_ms DESC, person_id",
    ),
    "all_ic8": _each(
        """SELECT p.creator_id AS reader, c.creator_id AS person_id, c.creation_ms AS comment_ms, c.id AS comment_id FROM g_comment AS c JOIN g_post AS p ON p.id = c.reply_of_post
          UNION ALL SELECT p.creator_id, c.creator_id, c.creation_ms, c.id FROM g_comment AS c JOIN g_comment AS p ON p.id = c.reply_of_comment WHERE c.reply_of_post IS NULL""",
        "comment_ms DESC, comment_id",
    ),
    "ic1": _top(IC1, "distance, friend_last_name, friend_id"),
    "ic2": _top(MESSAGES.format(people="h1", bound=f"<= {MS_2000}"), "creation_ms DESC, message_id"),
    "ic3": _top(
        f"""SELECT p.id AS person_id, first_name, last_name, x_count::INTEGER AS x_count, y_count::INTEGER AS y_count, (x_count + y_count)::INTEGER AS count FROM (
          SELECT creator_id, count(*) FILTER (country_id = 1000) AS x_count, count(*) FILTER (country_id = 1001) AS y_count FROM g_message
          WHERE creation_ms >= {MS_1995} AND creation_ms < {MS_1995 + 3000 * DAY} GROUP BY 1) AS m JOIN g_person AS p ON p.id = creator_id JOIN g_place AS c ON c.id = p.city_id
          WHERE x_count > 0 AND y_count > 0 AND p.id IN (SELECT id FROM fof) AND c.part_of NOT IN (1000, 1001)""",
        "x_count DESC, person_id",
    ),
    "ic4": _top(
        f"""SELECT t.name AS tag_name, count(*)::INTEGER AS post_count FROM g_post AS p JOIN g_post_tag AS pt ON pt.post_id = p.id JOIN g_tag AS t ON t.id = pt.tag_id
          WHERE p.creator_id IN (SELECT id FROM h1) AND creation_ms < {MS_199606 + 214 * DAY} GROUP BY t.id, t.name HAVING min(creation_ms) >= {MS_199606}""",
        "post_count DESC, tag_name",
    ),
    "ic5": _top(
        f"""SELECT m.forum_id, title AS forum_title, sum(posts)::INTEGER AS post_count FROM g_member_posts AS m JOIN g_forum AS f ON f.id = m.forum_id
          WHERE join_ms > {MS_1998} AND person_id IN (SELECT id FROM fof) GROUP BY 1, 2""",
        "post_count DESC, forum_id",
    ),
    "ic6": _top(
        """SELECT t.name AS tag_name, count(*)::INTEGER AS post_count FROM g_post AS p JOIN g_post_tag AS a ON a.post_id = p.id JOIN g_post_tag AS b ON b.post_id = p.id AND b.tag_id <> a.tag_id
          JOIN g_tag AS t ON t.id = b.tag_id WHERE a.tag_id = (SELECT id FROM g_tag WHERE name = 'blue ring') AND p.creator_id IN (SELECT id FROM fof) GROUP BY 1""",
        "post_count DESC, tag_name",
    ),
    "ic7": _top(
        """SELECT l.person_id, first_name, last_name, like_ms, l.message_id, content, ((like_ms - sent_ms) // 60000)::INTEGER AS minutes_latency, l.person_id NOT IN (SELECT id FROM h1) AS is_new FROM (
          SELECT person_id, message_id, k.creation_ms AS like_ms, m.creation_ms AS sent_ms, content, row_number() OVER (PARTITION BY person_id ORDER BY k.creation_ms DESC, message_id) AS turn
          FROM g_likes AS k JOIN g_message AS m ON m.id = k.message_id AND m.is_post = k.is_post WHERE m.creator_id = 1) AS l JOIN g_person AS p ON p.id = l.person_id WHERE turn = 1""",
        "like_ms DESC, person_id",
    ),
    "ic8": _top(
        """SELECT c.creator_id AS person_id, first_name, last_name, c.creation_ms AS comment_ms, c.id AS comment_id, c.content FROM g_comment AS c JOIN g_person AS p ON p.id = c.creator_id
          WHERE reply_of_post IN (SELECT id FROM g_post WHERE creator_id = 1) OR reply_of_comment IN (SELECT id FROM g_comment WHERE creator_id = 1)""",
        "comment_ms DESC, comment_id",
    ),
    "ic9": _top(MESSAGES.format(people="fof", bound=f"< {MS_2000}"), "creation_ms DESC, message_id"),
    "ic10": _top(
        """SELECT p.id AS person_id, first_name, last_name, coalesce(score, 0)::INTEGER AS common_interest_score, gender, c.name AS city_name FROM g_person AS p JOIN g_place AS c ON c.id = p.city_id
          LEFT JOIN (SELECT creator_id, sum(CASE WHEN id IN (SELECT post_id FROM g_post_tag WHERE tag_id IN (SELECT tag_id FROM g_interest WHERE person_id = 1)) THEN 1 ELSE -1 END) AS score FROM g_post GROUP BY 1) AS s
          ON s.creator_id = p.id WHERE p.id IN (SELECT id FROM levels WHERE level = 2) AND ((month(birthday) = 5 AND day(birthday) >= 21) OR (month(birthday) = 6 AND day(birthday) < 22))""",
        "common_interest_score DESC, person_id", 10,
    ),
    "ic11": _top(
        """SELECT DISTINCT w.person_id, first_name, last_name, o.name AS organization_name, work_from FROM g_work AS w JOIN g_org AS o ON o.id = w.org_id JOIN g_person AS p ON p.id = w.person_id
          WHERE o.place_id = 1001 AND work_from < 1999 AND w.person_id IN (SELECT id FROM fof)""",
        "work_from, person_id, organization_name DESC", 10,
    ),
    "ic12": _top(
        """SELECT c.creator_id AS person_id, first_name, last_name, array_to_string(list_sort(list_distinct(list(ct.name))), '|') AS tag_names, count(DISTINCT c.id)::INTEGER AS reply_count
          FROM g_comment AS c JOIN g_post_tag AS pt ON pt.post_id = c.reply_of_post JOIN class_tags AS ct ON ct.tag_id = pt.tag_id JOIN g_person AS p ON p.id = c.creator_id
          WHERE c.creator_id IN (SELECT id FROM h1) GROUP BY 1, 2, 3""",
        "reply_count DESC, person_id",
    ),
    "ic13": _q("SELECT coalesce((SELECT depth FROM dist WHERE node = 73), -1)::INTEGER AS shortest_path_length"),
    "ic14": _q("SELECT path AS person_ids_in_path, weight AS path_weight FROM ways WHERE node = 73"),
    "is1": _q(f"SELECT first_name, last_name, (birthday - DATE '1970-01-01')::BIGINT * {DAY} AS birthday_ms, location_ip, browser_used, city_id, gender, creation_ms FROM g_person WHERE id = 1"),
    "is2": _top(
        """SELECT m.id AS message_id, m.content, m.creation_ms, r.post_id AS original_post_id, o.creator_id AS original_post_author_id, a.first_name AS original_post_author_first_name,
          a.last_name AS original_post_author_last_name FROM g_message AS m LEFT JOIN root AS r ON r.message_id = m.id AND r.is_post = m.is_post LEFT JOIN g_post AS o ON o.id = r.post_id
          LEFT JOIN g_person AS a ON a.id = o.creator_id WHERE m.creator_id = 1""",
        "creation_ms DESC, message_id DESC", 10,
    ),
    "is3": _q("SELECT p2 AS person_id, k.creation_ms AS friendship_ms, first_name, last_name FROM g_knows AS k JOIN g_person AS p ON p.id = p2 WHERE p1 = 1"),
    "is4": _q("SELECT creation_ms, content FROM g_message WHERE id = 10"),
    "is5": _q("SELECT p.id AS person_id, first_name, last_name FROM g_message AS m JOIN g_person AS p ON p.id = m.creator_id WHERE m.id = 10000017"),
    "is6": _q(
        """SELECT f.id AS forum_id, title AS forum_title, moderator_id, first_name AS moderator_first_name, last_name AS moderator_last_name FROM root AS r JOIN g_post AS o ON o.id = r.post_id
        JOIN g_forum AS f ON f.id = o.forum_id LEFT JOIN g_person AS p ON p.id = moderator_id WHERE r.message_id = 10000017"""
    ),
    "is7": _q(IS7),
    "iu1": _q(
        f"""SELECT id, first_name, last_name, city_id, languages, (SELECT count(*) FROM g_interest AS i WHERE i.person_id = p.id) AS n_interests FROM g_person AS p UNION ALL
        SELECT id + {NEW}, 'new', last_name, c.place AS city_id, 'a|z', (id % 64 IN (SELECT id FROM g_tag))::BIGINT
        FROM g_person LEFT JOIN (SELECT id AS place FROM g_place) AS c ON c.place = city_id + id % 2 * 500"""
    ),
    "iu2": _q(
        "SELECT * FROM g_likes WHERE (person_id, message_id) NOT IN (SELECT (person_id, message_id) FROM fresh) UNION ALL SELECT * FROM fresh",
        f"fresh AS (SELECT id AS person_id, id * 3 AS message_id, TRUE AS is_post, {NOW} + id AS creation_ms FROM g_person WHERE id * 3 IN (SELECT id FROM g_post)),",
    ),
    "iu3": _q(f"SELECT * FROM g_likes UNION ALL SELECT id, 10000000 + id * 20, FALSE, {NOW} + id FROM g_person WHERE 10000000 + id * 20 IN (SELECT id FROM g_comment)"),
    "iu4": _q(f"SELECT * FROM g_forum UNION ALL SELECT id + {NEW}, 'new', creation_ms, moderator_id * 17 FROM g_forum WHERE id % 2 = 1 AND moderator_id * 17 IN (SELECT id FROM g_person)"),
    "iu5": _q(
        _members("members", "g_post"),
        f"""fresh AS (SELECT id % 13 AS forum_id, id AS person_id, {NOW} + id AS join_ms FROM g_person WHERE id % 13 IN (SELECT id FROM g_forum)),
        members AS (SELECT m.* FROM g_member AS m ANTI JOIN fresh AS f ON f.forum_id = m.forum_id AND f.person_id = m.person_id UNION ALL SELECT * FROM fresh),""",
    ),
    "iu6": _q(_members("g_member", "posts"), f"posts AS (SELECT id, forum_id, creator_id FROM g_post UNION ALL SELECT id + {NEW} * 20, forum_id, creator_id FROM g_post WHERE forum_id IN (SELECT id FROM g_forum)),"),
    "iu7": _q(
        _friends("g_knows", "comments"),
        f"""fresh AS (SELECT w.message_id AS id FROM walk AS w WHERE parent < 0 AND -1 - parent IN (SELECT id FROM g_post)),
        comments AS (SELECT id, creator_id, reply_of_post, reply_of_comment FROM g_comment UNION ALL
          SELECT id + {NEW} * 20, creator_id, reply_of_post, reply_of_comment + {NEW} * 20 FROM g_comment WHERE id IN (SELECT id FROM fresh)),""",
    ),
    "iu8": _q(
        _friends("knows", "g_comment"),
        f"""fresh AS (SELECT id AS a, id + 1 AS b, {NOW} + id AS creation_ms FROM g_person WHERE id + 1 IN (SELECT id FROM g_person)),
        both_ways AS (SELECT a AS p1, b AS p2, creation_ms FROM fresh UNION ALL SELECT b, a, creation_ms FROM fresh),
        knows AS (SELECT k.* FROM g_knows AS k ANTI JOIN both_ways AS f ON f.p1 = k.p1 AND f.p2 = k.p2 UNION ALL SELECT * FROM both_ways),""",
    ),
    "multihop_1": _q("SELECT id FROM h1"),
    "multihop_2": _q("SELECT id FROM fof"),
    "ring_2": _q("SELECT id FROM levels WHERE level = 2"),
    "bfs_levels_3": _q("SELECT * FROM levels"),
    "tagclass_closure": _q("SELECT * FROM class_tags"),
    "reply_root": _q("SELECT * FROM root"),
    "shortest_path": _q("SELECT 1::BIGINT AS p1, p::BIGINT AS p2, coalesce((SELECT depth FROM dist WHERE node = p), -1)::INTEGER AS length FROM (VALUES (1), (2), (73), (-5)) AS v(p)"),
    "all_shortest_paths": _q("SELECT path, weight FROM ways WHERE node = 73"),
    "member_posts": _q("SELECT * FROM g_member_posts"),
    "knows_weight": _q("SELECT * FROM g_friends"),
    "topk": _q("SELECT id, creation_ms, row_number() OVER (ORDER BY creation_ms DESC, id) AS rank FROM g_post ORDER BY rank LIMIT 50"),
    "semi_join": _q("SELECT id, creator_id AS person_id FROM g_post WHERE creator_id IN (SELECT person_id FROM g_interest WHERE tag_id = 10)"),
    "semi_join_whole": _q("SELECT id, creator_id AS person_id FROM g_post WHERE creator_id IN (SELECT person_id FROM g_interest)"),
    "anti_join": _q("SELECT id FROM g_person WHERE id NOT IN (SELECT creator_id FROM g_post)"),
    "mark_join": _q("SELECT id, id IN (SELECT person_id FROM g_work) AS works FROM g_person"),
    "argmax_per_group": _q("SELECT person_id, message_id, creation_ms FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY creation_ms DESC, message_id) AS turn FROM g_likes) WHERE turn = 1"),
    "union_message": _q("SELECT id, is_post, creator_id, creation_ms FROM g_message"),
    "cond_count": _q("SELECT * FROM (SELECT creator_id, count(*) FILTER (country_id = 1000) AS x_count, count(*) FILTER (country_id = 1001) AS y_count FROM g_message GROUP BY 1) WHERE x_count > 0 AND y_count > 0"),
    "collect_sorted": _q("SELECT person_id, string_agg(org_id::VARCHAR, '|' ORDER BY org_id, work_from) AS orgs, string_agg(work_from::VARCHAR, '|' ORDER BY org_id, work_from) AS years FROM g_work GROUP BY 1"),
    "anti_join_untagged": _q("SELECT id FROM g_post WHERE id NOT IN (SELECT post_id FROM g_post_tag)"),
}

TABLES = {
    "person": "g_person", "place": "g_place", "org": "g_org", "tag": "g_tag", "tagclass": "g_tagclass", "forum": "g_forum", "post": "g_post", "comment": "g_comment",
    "knows": "g_knows", "likes": "g_likes", "forum_member": "g_member", "post_tag": "g_post_tag", "comment_tag": "g_comment_tag", "forum_tag": "g_forum_tag",
    "person_interest": "g_interest", "study_at": "g_study", "work_at": "g_work",
}
SQL |= {f"{name}_table": _q(f"SELECT * FROM {cte}", with_hops=False) for name, cte in TABLES.items()}

# Delimited files know no null text: what is null in a table comes back empty.
TEXTS = {
    name: [part.split(" ")[0] for part in spec.split(", ") if part.endswith(" string")] for name, spec in BASE.items()
}
SQL |= {
    f"csv_{name}": _q("SELECT * " + (f"REPLACE ({', '.join(f'coalesce({c}, {chr(39) * 2}) AS {c}' for c in TEXTS[name])}) " if TEXTS[name] else "") + f"FROM {cte}", with_hops=False)
    for name, cte in TABLES.items()
}

# The graph after one batch that adds to every person, forum, post and comment a further one, with ids moved by NEW or 20 * NEW.
MORE = 20 * NEW
FURTHER = f"""
f_tags AS (SELECT id AS tag_id FROM g_tag),
accepted AS (SELECT DISTINCT w.message_id AS id FROM walk AS w WHERE parent < 0 AND -1 - parent IN (SELECT id FROM g_post WHERE forum_id IN (SELECT id FROM g_forum))),
u_post AS (SELECT * FROM g_post UNION ALL SELECT id + {MORE}, image_file, creation_ms, NULL, NULL, NULL, content, creator_id + {NEW}, forum_id + {NEW}, country_id FROM g_post WHERE forum_id IN (SELECT id FROM g_forum)),
u_comment AS (SELECT * FROM g_comment UNION ALL SELECT id + {MORE}, creation_ms, NULL, NULL, content, creator_id + {NEW}, country_id, reply_of_post + {MORE}, reply_of_comment + {MORE}
  FROM g_comment WHERE id IN (SELECT id FROM accepted)),
u_knows AS (SELECT * FROM g_knows UNION ALL SELECT p1 + {NEW}, p2 + {NEW}, creation_ms FROM g_knows),
u_member AS (SELECT * FROM g_member UNION ALL SELECT forum_id + {NEW}, person_id + {NEW}, join_ms FROM g_member WHERE forum_id IN (SELECT id FROM g_forum)),
u_reply AS (SELECT coalesce(reply_of_post, reply_of_comment) AS parent_id, reply_of_post IS NOT NULL AS parent_is_post, id, creator_id, creation_ms FROM u_comment WHERE coalesce(reply_of_post, reply_of_comment) IS NOT NULL),
u_home AS (SELECT id, TRUE AS is_post, creator_id FROM u_post UNION ALL SELECT id, FALSE, creator_id FROM u_comment),
u_weight AS (SELECT least(r.creator_id, h.creator_id) AS a, greatest(r.creator_id, h.creator_id) AS b, sum(CASE WHEN parent_is_post THEN 1.0 ELSE 0.5 END)::DOUBLE AS weight
  FROM u_reply AS r JOIN u_home AS h ON h.id = r.parent_id AND h.is_post = r.parent_is_post GROUP BY 1, 2),
"""
TAGS_OF = "SELECT DISTINCT {owner} AS {name}, tag_id FROM (SELECT id, unnest([id % 64, id * 5 % 64]) AS tag_id FROM {table}) WHERE tag_id IN (SELECT tag_id FROM f_tags){only}"


def _u(body: str) -> str:
    return _q(body, FURTHER)


SQL |= {
    "iu1_person": _u(f"SELECT * FROM g_person UNION ALL SELECT * REPLACE (id + {NEW} AS id) FROM g_person"),
    "iu1_interest": _u("SELECT * FROM g_interest UNION ALL " + TAGS_OF.format(owner=f"id + {NEW}", name="person_id", table="g_person", only="")),
    "iu1_study": _u(f"SELECT * FROM g_study UNION ALL SELECT id + {NEW}, id % 7, (2000 + id % 5)::INTEGER FROM g_person WHERE id % 7 IN (SELECT id FROM g_org)"),
    "iu1_work": _u(f"SELECT * FROM g_work UNION ALL SELECT id + {NEW}, id % 11, (1990 + id % 5)::INTEGER FROM g_person WHERE id % 11 IN (SELECT id FROM g_org)"),
    "iu2_iu3_likes": _u(
        f"""SELECT * FROM g_likes UNION ALL SELECT creator_id + {NEW}, id + {MORE}, TRUE, creation_ms FROM g_post WHERE forum_id IN (SELECT id FROM g_forum)
        UNION ALL SELECT creator_id + {NEW}, id, FALSE, creation_ms FROM g_comment"""
    ),
    "iu4_forum": _u(f"SELECT * FROM g_forum UNION ALL SELECT id + {NEW}, title, creation_ms, moderator_id + {NEW} FROM g_forum WHERE moderator_id IN (SELECT id FROM g_person)"),
    "iu4_tags": _u("SELECT * FROM g_forum_tag UNION ALL " + TAGS_OF.format(owner=f"id + {NEW}", name="forum_id", table="g_forum", only="")),
    "iu5_members": _u("SELECT * FROM u_member"),
    "iu6_posts": _u("SELECT * FROM u_post"),
    "iu6_tags": _u("SELECT * FROM g_post_tag UNION ALL " + TAGS_OF.format(owner=f"id + {MORE}", name="post_id", table="g_post", only=" AND id IN (SELECT id FROM g_post WHERE forum_id IN (SELECT id FROM g_forum))")),
    "iu5_iu6_member_posts": _u(_members("u_member", "u_post")),
    "iu7_comments": _u("SELECT * FROM u_comment"),
    "iu7_tags": _u("SELECT * FROM g_comment_tag UNION ALL " + TAGS_OF.format(owner=f"id + {MORE}", name="comment_id", table="g_comment", only=" AND id IN (SELECT id FROM accepted)")),
    "iu6_iu7_roots": _u(f"SELECT * FROM root UNION ALL SELECT message_id + {MORE}, is_post, post_id + {MORE} FROM root WHERE post_id IN (SELECT id FROM g_post WHERE forum_id IN (SELECT id FROM g_forum))"),
    "iu6_iu7_homes": _u("SELECT * FROM u_home"),
    "iu7_replies": _u("SELECT * FROM u_reply"),
    "iu8_knows": _u("SELECT * FROM u_knows"),
    "iu7_iu8_friends": _u("SELECT p1, p2, creation_ms, coalesce(weight, 0) AS weight FROM u_knows LEFT JOIN u_weight ON a = least(p1, p2) AND b = greatest(p1, p2)"),
}
