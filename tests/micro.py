"""A graph of nine persons as delimited files, with the cases of ties, bounds and missing ways.

Friendships: 1-2, 1-3, 2-4, 3-4, 4-5, 6-7; 8 has no friend, 9 only 1.
"""

from pathlib import Path


def ms(day, hour=0):
    return 1_577_836_800_000 + day * 86_400_000 + hour * 3_600_000  # 2020-01-01


def text(day, hour=0):
    import datetime

    return (datetime.datetime(2020, 1, 1) + datetime.timedelta(days=day, hours=hour)).strftime("%Y-%m-%dT%H:%M:%S.000+0000")


def write(root: Path) -> str:
    def file(name, header, lines):
        path = root / f"{name}_0_0.csv"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("\n".join(["|".join(header), *("|".join(map(str, line)) for line in lines)]) + "\n")

    births = {1: "1980-01-01", 2: "1981-05-05", 3: "1982-05-21", 4: "1983-06-21", 5: "1984-06-22", 6: "1985-12-21", 7: "1986-01-21", 8: "1960-03-01", 9: "1983-05-20"}
    first = {1: "Ann", 2: "Bob", 3: "Cy", 4: "Dee", 5: "Bob", 6: "Fay", 7: "Gus", 8: "Bob", 9: "Bob"}
    file(
        "dynamic/person", ["id", "firstName", "lastName", "gender", "birthday", "creationDate", "locationIP", "browserUsed", "place", "language", "email"],
        [(i, first[i], f"L{i}", "f", births[i], text(0), "192.0.2.1", "B", 1 if i != 3 else 2, "fr;en" if i == 1 else "", "a@x;b@x" if i == 1 else "") for i in range(1, 10)],
    )
    file("static/place", ["id", "name", "url", "type", "isPartOf"], [(1, "Ce", "u", "city", 11), (2, "De", "u", "city", 12), (11, "Xland", "u", "country", 21), (12, "Yland", "u", "country", 21), (13, "Zland", "u", "country", 21), (21, "Cont", "u", "continent")])
    file("static/organisation", ["id", "type", "name", "url", "place"], [(31, "company", "Firm", "u", 12), (32, "university", "Uni", "u", 1), (33, "company", "Best", "u", 12)])
    file("static/tagclass", ["id", "name", "url", "isSubclassOf"], [(41, "Thing", "u"), (42, "Art", "u", 41), (43, "Music", "u", 42)])
    file("static/tag", ["id", "name", "url", "hasType"], [(51, "jazz", "u", 43), (52, "paint", "u", 42), (53, "rock", "u", 43), (54, "misc", "u", 41)])
    file("dynamic/forum", ["id", "title", "creationDate", "moderator"], [(61, "Wall", text(0), 2), (62, "Group", text(0), 3)])
    file(
        "dynamic/post", ["id", "imageFile", "creationDate", "locationIP", "browserUsed", "language", "content", "length", "creator", "Forum.id", "place"],
        [(101, "", text(1), "ip", "B", "en", "hello", 5, 2, 61, 11), (102, "pic.jpg", text(2), "ip", "B", "", "", 0, 2, 61, 12), (103, "", text(2), "ip", "B", "en", "third", 5, 3, 61, 11), (104, "", text(4), "ip", "B", "en", "fourth", 6, 4, 62, 13), (105, "", text(5), "ip", "B", "en", "own", 3, 1, 61, 11)],
    )
    file(
        "dynamic/comment", ["id", "creationDate", "locationIP", "browserUsed", "content", "length", "creator", "place", "replyOfPost", "replyOfComment"],
        [(201, text(3), "ip", "B", "c1", 2, 1, 12, 101, ""), (202, text(4), "ip", "B", "c2", 2, 2, 11, "", 201), (203, text(5), "ip", "B", "c3", 2, 4, 12, "", 202), (204, text(5), "ip", "B", "c4", 2, 3, 13, 105, ""), (205, text(5), "ip", "B", "c5", 2, 8, 11, 105, "")],
    )
    file("dynamic/person_knows_person", ["a", "b", "d"], [(1, 2, text(1)), (1, 3, text(1)), (2, 4, text(1)), (3, 4, text(1)), (4, 5, text(1)), (6, 7, text(1)), (9, 1, text(2))])
    file("dynamic/person_hasInterest_tag", ["a", "b"], [(1, 51), (1, 52)])
    file("dynamic/person_likes_post", ["a", "b", "d"], [(2, 105, text(6)), (8, 105, text(6, 1))])
    file("dynamic/person_likes_comment", ["a", "b", "d"], [(2, 201, text(7)), (3, 201, text(2)), (8, 201, text(6, 1))])
    file("dynamic/person_studyAt_organisation", ["a", "b", "y"], [(5, 32, 2001)])
    file("dynamic/person_workAt_organisation", ["a", "b", "y"], [(2, 31, 2005), (2, 33, 2005), (4, 31, 2004), (5, 31, 2000)])
    file("dynamic/post_hasTag_tag", ["a", "b"], [(101, 51), (101, 52), (102, 54), (103, 51), (103, 53), (104, 53)])
    file("dynamic/comment_hasTag_tag", ["a", "b"], [(201, 51)])
    file("dynamic/forum_hasTag_tag", ["a", "b"], [(61, 51)])
    file("dynamic/forum_hasMember_person", ["a", "b", "d"], [(61, 2, text(1)), (61, 3, text(2)), (62, 4, text(3)), (62, 2, text(3))])
    return str(root)
