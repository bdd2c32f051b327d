"""The queries of ``data_queries`` in SQL, for comparison on whole tables."""

FAULTS = """
WITH m AS (SELECT id, min(loaded_at) AS first_at, any_value(creationdate) AS creationdate, any_value(creator) AS creator,
                  any_value(replyofpost) AS replyofpost, any_value(forumid) AS forumid FROM message GROUP BY id),
p AS (SELECT id, min(loaded_at) AS first_at, any_value(creationdate) AS creationdate, any_value(place) AS place FROM person GROUP BY id),
gone AS (SELECT kind, record_id, max(removed_at) AS removed_at FROM tombstone GROUP BY ALL),
target AS (
  SELECT 'person' AS kind, id, min(loaded_at) AS first_at, max(loaded_at) AS last_at FROM person GROUP BY id
  UNION ALL SELECT 'post', id, min(loaded_at), max(loaded_at) FROM message WHERE ispost GROUP BY id
  UNION ALL SELECT 'forum', id, min(loaded_at), max(loaded_at) FROM forum GROUP BY id
  UNION ALL SELECT DISTINCT 'place', id, NULL::TIMESTAMP, NULL::TIMESTAMP FROM place),
ref AS (
  SELECT 'message' AS table_name, 'creator' AS field_name, 'person' AS kind, creator AS key, id, first_at, creationdate FROM m
  UNION ALL SELECT 'message', 'replyofpost', 'post', replyofpost, id, first_at, creationdate FROM m
  UNION ALL SELECT 'message', 'forumid', 'forum', forumid, id, first_at, creationdate FROM m
  UNION ALL SELECT 'person', 'place', 'place', place, id, first_at, creationdate FROM p),
faults AS (
  SELECT table_name, field_name, ref.id AS record_id, coalesce(strftime(creationdate, '%Y-%m'), 'none') AS period,
    CASE WHEN target.id IS NULL THEN 'missing'
         WHEN gone.removed_at IS NOT NULL AND (target.last_at IS NULL OR gone.removed_at >= target.last_at) THEN 'deleted'
         WHEN target.first_at > ref.first_at THEN 'late' END AS fault
  FROM ref LEFT JOIN target ON target.kind = ref.kind AND target.id = ref.key
  LEFT JOIN gone ON gone.kind = ref.kind AND gone.record_id = ref.key
  WHERE ref.key IS NOT NULL AND ref.key <> -1)
"""

KEYS = """
WITH m AS (SELECT id, any_value(creator) AS k, any_value(creationdate) AS d FROM message GROUP BY id),
f AS (SELECT id, any_value(moderator) AS k, any_value(creationdate) AS d FROM forum GROUP BY id),
keys AS (
  SELECT 'message' AS table_name, 'creator' AS field_name, k AS key_id, count(*) AS n_records, min(d) AS first_date, max(d) AS last_date,
         count(*) * 40 >= (SELECT count(*) FROM m WHERE k IS NOT NULL AND k <> -1) AS is_heavy
  FROM m WHERE k IS NOT NULL AND k <> -1 GROUP BY k
  UNION ALL
  SELECT 'forum', 'moderator', k, count(*), min(d), max(d), count(*) * 40 >= (SELECT count(*) FROM f WHERE k IS NOT NULL AND k <> -1)
  FROM f WHERE k IS NOT NULL AND k <> -1 GROUP BY k)
"""

TREES = """
WITH RECURSIVE m AS (SELECT id, any_value(ispost) AS ispost, any_value(replyofpost) AS rp, any_value(replyofcomment) AS rc FROM message GROUP BY id),
link AS (
  SELECT 'message' AS tree, m.id AS node, t.id AS parent FROM m
  LEFT JOIN m AS t ON CASE WHEN m.rc IS NOT NULL AND m.rc <> -1 THEN t.id = m.rc AND NOT t.ispost ELSE t.id = m.rp AND t.ispost END
  WHERE (m.rc IS NOT NULL AND m.rc <> -1) OR (m.rp IS NOT NULL AND m.rp <> -1)
  UNION ALL
  SELECT 'place', a.id, b.id FROM place AS a LEFT JOIN place AS b ON b.id = a.ispartof WHERE a.ispartof IS NOT NULL AND a.ispartof <> -1),
walk(tree, node, root, depth, path) AS (
  SELECT tree, node, node, 0, node::VARCHAR FROM link WHERE parent IS NULL
  UNION ALL
  SELECT DISTINCT a.tree, a.parent, a.parent, 0, a.parent::VARCHAR FROM link AS a
  WHERE a.parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM link AS b WHERE b.tree = a.tree AND b.node = a.parent)
  UNION ALL
  SELECT l.tree, l.node, w.root, w.depth + 1, w.path || '/' || l.node FROM walk AS w JOIN link AS l ON l.tree = w.tree AND l.parent = w.node)
"""

# Values of packed fields: quoted ones, runs of signs of values and of quoted parts, and what lies between, in turn.
PACKED = r"""
WITH fields AS (
  SELECT id AS person_id, f.name AS field_name, trim(f.value, ' ' || chr(9) || chr(10) || chr(13)) AS v
  FROM (SELECT id, any_value(email) AS email, any_value(language) AS language FROM person WHERE id IS NOT NULL GROUP BY id),
  LATERAL (VALUES ('email', email), ('language', language)) AS f(name, value)),
bare AS (
  SELECT person_id, field_name, CASE WHEN regexp_matches(regexp_replace(v, '"(?:[^"]|"")*"|''(?:[^'']|'''')*[()|](?:[^'']|'''')*''', 'q', 'g'), '^(\[[^\[\]]*\]|\([^()]*\)|\{[^{}]*\}|<[^<>]*>)$') THEN v[2:-2] ELSE v END AS v FROM fields),
tokens AS (
  SELECT person_id, field_name,
    regexp_extract_all(v, '''(?:[^'']|'''')*''(?:@[\p{L}\p{N}._+''@-]+)?|(?:"(?:[^"]|"")*"|[\p{L}\p{N}._+''@-])+|[^\p{L}\p{N}._+''@"-]+|"') AS found FROM bare),
parts AS (SELECT person_id, field_name, unnest(found) AS part, generate_subscripts(found, 1) AS i FROM tokens),
placed AS (
  SELECT *, regexp_matches(part, '^[\p{L}\p{N}._+''@-]|^"(?s:.*)"') AS is_value,
    sum(CASE WHEN regexp_matches(part, '^[\p{L}\p{N}._+''@-]|^"(?s:.*)"') THEN 0 ELSE greatest(1, length(regexp_replace(part, '\s', '', 'g'))) END)
      OVER (PARTITION BY person_id, field_name ORDER BY i) AS before
  FROM parts)
"""

SQL = {
    "p4_found": PACKED + r"""
        SELECT person_id, field_name, (before + 1)::BIGINT AS pos,
          CASE WHEN regexp_full_match(part, '"(?:[^"]|"")*"') THEN replace(part[2:-2], '""', '"')
               WHEN regexp_full_match(part, '''(?:[^'']|'''')*''') THEN replace(part[2:-2], '''''', '''') ELSE part END AS item
        FROM placed WHERE is_value AND item <> ''""",
    "p1_found": FAULTS + "SELECT table_name, field_name, record_id, period FROM faults WHERE fault IS NOT NULL",
    "p1_report": FAULTS + "SELECT table_name, field_name, period, fault, count(*) AS n_records FROM faults WHERE fault IS NOT NULL GROUP BY ALL",
    "p2_found": KEYS + "SELECT table_name, field_name, key_id FROM keys WHERE is_heavy",
    "p2_keys": KEYS + "SELECT * FROM keys",
    "p2_named": """
        WITH m AS (SELECT id, any_value(creator) AS c FROM message GROUP BY id),
        p AS (SELECT id, any_value(firstname) AS firstname, any_value(lastname) AS lastname FROM person GROUP BY id)
        SELECT m.id AS message_id, nullif(c, -1) AS creator, firstname, lastname FROM m LEFT JOIN p ON p.id = m.c AND c <> -1""",
    "p5_found": TREES + """
        SELECT l.tree AS tree_name, l.node AS node_id, coalesce(w.root, -1) AS root_id, coalesce(w.depth, -1)::BIGINT AS depth
        FROM link AS l LEFT JOIN walk AS w ON w.tree = l.tree AND w.node = l.node""",
    "p5_paths": TREES + """
        SELECT l.tree AS tree_name, l.node AS node_id, w.path AS path FROM link AS l LEFT JOIN walk AS w ON w.tree = l.tree AND w.node = l.node""",
    "p5_descendants": TREES + """
        SELECT tree AS tree_name, split_part(path, '/', i::INT)::BIGINT AS node_id, node AS descendant_id, (depth + 1 - i)::BIGINT AS distance
        FROM (SELECT tree, node, depth, path, unnest(range(1, depth + 1)) AS i FROM walk)""",
}
SQL["p5_intervals"] = TREES + """,
below AS (SELECT tree, root, split_part(path, '/', i::INT)::BIGINT AS node, count(*) AS n FROM (SELECT tree, root, path, unnest(range(1, depth + 1)) AS i FROM walk) GROUP BY ALL),
ordered AS (SELECT *, row_number() OVER (PARTITION BY tree, root ORDER BY string_split(path, '/')::BIGINT[]) - 1 AS k FROM walk WHERE root IN (SELECT parent FROM link) OR depth > 0)
SELECT o.tree AS tree_name, o.node AS node_id, o.root AS root_id, (2 * k - depth)::BIGINT AS enter, (2 * k - depth + 2 * coalesce(n, 0) + 1)::BIGINT AS leave
FROM ordered AS o LEFT JOIN below AS b ON b.tree = o.tree AND b.root = o.root AND b.node = o.node"""
SQL["p5_rounds"] = SQL["p5_found"]
