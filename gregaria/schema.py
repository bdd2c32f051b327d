"""Tables of the property graph.

One table for each vertex kind, keyed by its external id, and one for each
logical relation; reverse directions need no table of their own. Times are
epoch milliseconds, birthdays dates; null is "no reference".
"""

from __future__ import annotations

VERTICES = {
    "person": "id bigint, first_name string, last_name string, gender string, birthday date, creation_ms bigint, location_ip string, browser_used string, city_id bigint, languages array<string>, emails array<string>",
    "place": "id bigint, name string, url string, type string, part_of bigint",
    "org": "id bigint, type string, name string, url string, place_id bigint",
    "tag": "id bigint, name string, url string, class_id bigint",
    "tagclass": "id bigint, name string, url string, parent_id bigint",
    "forum": "id bigint, title string, creation_ms bigint, moderator_id bigint",
    "post": "id bigint, image_file string, creation_ms bigint, location_ip string, browser_used string, language string, content string, creator_id bigint, forum_id bigint, country_id bigint",
    "comment": "id bigint, creation_ms bigint, location_ip string, browser_used string, content string, creator_id bigint, country_id bigint, reply_of_post bigint, reply_of_comment bigint",
}
EDGES = {
    "knows": "p1 bigint, p2 bigint, creation_ms bigint",
    "likes": "person_id bigint, message_id bigint, is_post boolean, creation_ms bigint",
    "forum_member": "forum_id bigint, person_id bigint, join_ms bigint",
    "person_interest": "person_id bigint, tag_id bigint",
    "post_tag": "post_id bigint, tag_id bigint",
    "comment_tag": "comment_id bigint, tag_id bigint",
    "forum_tag": "forum_id bigint, tag_id bigint",
    "study_at": "person_id bigint, org_id bigint, class_year int",
    "work_at": "person_id bigint, org_id bigint, work_from int",
}
BASE = VERTICES | EDGES
#: Kept with the base tables in a snapshot and changed with them: weights and counters, and short tables clustered for reads by other keys.
DERIVED = {
    "friends": "p1 bigint, p2 bigint, creation_ms bigint, weight double",
    "member_posts": "forum_id bigint, person_id bigint, join_ms bigint, posts bigint",
    "message_root": "message_id bigint, is_post boolean, post_id bigint",
    "message_home": "id bigint, is_post boolean, creator_id bigint",
    "replies": "parent_id bigint, parent_is_post boolean, id bigint, creator_id bigint, creation_ms bigint",
}
#: Keys of the tables whose rows may be replaced; all others only grow.
REPLACED = {"likes": ["person_id", "message_id", "is_post"], "forum_member": ["forum_id", "person_id"], "knows": ["p1", "p2"], "friends": ["p1", "p2"], "member_posts": ["forum_id", "person_id"]}
#: The column by which a snapshot clusters each large table, so that point reads skip most row groups.
CLUSTER = {
    "post": "creator_id", "comment": "creator_id", "knows": "p1", "friends": "p1", "likes": "message_id", "forum_member": "person_id",
    "member_posts": "person_id", "post_tag": "tag_id", "comment_tag": "comment_id", "person": "id", "work_at": "org_id", "study_at": "person_id",
    "message_root": "message_id", "person_interest": "person_id", "message_home": "id", "replies": "parent_id",
}
