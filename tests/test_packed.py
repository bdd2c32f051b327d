import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gregaria.operators.packed import split_packed, unpack_fields


def plain(sign):
    return sign.isalnum() or sign in "._+-'@"


def brute(field):
    """Sign by sign, for fields without double quotes, brackets and quoting apostrophes."""
    values, value, at, field = [], "", 0, field.strip()
    while at < len(field):
        if plain(field[at]):
            value += field[at]
            at += 1
            continue
        values.append(value)
        value = ""
        end = at
        while end < len(field) and field[end].isspace():
            end += 1
        if end < len(field) and not plain(field[end]):
            end += 1
            while end < len(field) and field[end].isspace():
                end += 1
        at = end
    values.append(value)
    return [(i, v) for i, v in enumerate(values, 1) if v]


@pytest.mark.parametrize(
    ("field", "items"),
    [
        (None, []), ("", []), ("  ", []), (",", []), ("[]", []), ('""', []),
        ("a", [(1, "a")]), ("a;b", [(1, "a"), (2, "b")]), ("a; ;b", [(1, "a"), (3, "b")]), ("; a", [(2, "a")]), ("a;", [(1, "a")]),
        (" a  ", [(1, "a")]), (" / a / ", [(2, "a")]), ("[ a; b ]", [(1, "a"), (2, "b")]), ("a  b", [(1, "a"), (2, "b")]), ("a,\nb c", [(1, "a"), (2, "b"), (3, "c")]), ("a\0b", [(1, "a"), (2, "b")]), ("a；；b", [(1, "a"), (3, "b")]),
        ("[a;b]", [(1, "a"), (2, "b")]), ("{'a','b'}", [(1, "a"), (2, "b")]), (" (a;b)  ", [(1, "a"), (2, "b")]), ("((a))", [(1, "a")]), ("(a);(b)", [(2, "a"), (5, "b")]),
        ('"x, y";z', [(1, "x, y"), (2, "z")]), ('"say ""hi"" now"', [(1, 'say "hi" now')]), ("'it''s; so'", [(1, "it's; so")]), ("'a \"b\" c'", [(1, 'a "b" c')]),
        ('"x, y"@m.test;b', [(1, '"x, y"@m.test'), (2, "b")]), ("'\"x y\"@m.test','b'", [(1, '"x y"@m.test'), (2, "b")]),
        ("o'brien@m.test", [(1, "o'brien@m.test")]), ("\"o'brien@m.test\",'b'", [(1, "o'brien@m.test"), (2, "b")]), ("[o'a@x,b,\"o'c@z\"]", [(1, "o'a@x"), (2, "b"), (3, "o'c@z")]),
        ('"open;b', [(2, "open"), (3, "b")]), ("'open;b", [(1, "'open"), (2, "b")]), ('"(a]";b', [(1, "(a]"), (2, "b")]), ("a;a;A", [(1, "a"), (2, "a"), (3, "A")]),
    ],
)
def test_cases(field, items):
    assert split_packed(field) == items


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab1.@ ,;/\n|é中", max_size=14))
def test_unquoted_fields_as_by_brute_force(field):
    assert split_packed(field) == brute(field)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab, ;'|(", min_size=1, max_size=6), min_size=1, max_size=5))
def test_quoted_values_come_back(values):
    packed = ";".join('"' + v.replace('"', '""') + '"' for v in values)
    assert split_packed(packed) == list(enumerate(values, 1))


def test_very_long_field():
    assert len(split_packed(";".join(itertools.repeat("v", 200_000)))) == 200_000


def test_table(spark, rows):
    df = spark.createDataFrame([(1, "a;b", None, "x"), (1, "a;b", None, "x"), (None, "c", "", "x"), (2, None, None, None)], "id bigint, f string, g string, pos string")
    out = unpack_fields(df, "id", ["f", "g"])
    assert out.columns == ["id", "field_name", "pos", "item"]
    assert rows(out) == sorted([(1, "f", 1, "a"), (1, "f", 2, "b")] * 2 + [(None, "f", 1, "c")], key=repr)
    assert unpack_fields(df.limit(0), "id", ["f"]).count() == 0
