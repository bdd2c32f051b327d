from pyspark.sql import functions as F

from gregaria.functions import values as v


def one(spark, column, **inputs):
    names = ", ".join(f"{k} {kind}" for k, (kind, _) in inputs.items())
    return spark.createDataFrame([tuple(x for _, x in inputs.values())], names).select(column).first()[0]


def test_times(spark):
    import datetime

    at = datetime.datetime(1969, 12, 31, 23, 59, 59, 999_999)
    assert one(spark, v.ms_of_timestamp("t"), t=("timestamp_ntz", at)) == 0
    assert one(spark, v.ms_of_timestamp("t"), t=("timestamp_ntz", datetime.datetime(2020, 1, 1))) == 1_577_836_800_000
    assert one(spark, v.ms_of_date(F.col("d")), d=("date", datetime.date(1969, 12, 31))) == -v.DAY_MS
    for text, ms in (("2020-01-01T00:00:00.250+0000", 1_577_836_800_250), ("2020-01-01T02:00:00.000+0200", 1_577_836_800_000), ("yesterday", None), ("", None), (None, None)):
        assert one(spark, v.parse_ms(F.col("t")), t=("string", text)) == ms


def test_times_do_not_depend_on_the_session_zone(spark):
    import datetime

    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert one(spark, v.ms_of_timestamp("t"), t=("timestamp_ntz", datetime.datetime(2020, 1, 1))) == 1_577_836_800_000
        assert one(spark, v.parse_ms(F.col("t")), t=("string", "2020-01-01T00:00:00.000+0000")) == 1_577_836_800_000
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_lists_contents_and_minutes(spark):
    for text, items in (("a;b", ["a", "b"]), ("a;", ["a"]), ("a;;b", ["a", "", "b"]), ("", []), (None, [])):
        assert one(spark, v.parse_list(F.col("t")), t=("string", text)) == items
    for content, image, shown in (("x", "i", "x"), ("", "i", "i"), (None, "i", "i"), (None, None, None)):
        assert one(spark, v.shown_content(F.col("c"), F.col("i")), c=("string", content), i=("string", image)) == shown
    for later, minutes in ((59_999, 0), (60_000, 1), (-1, -1)):
        assert one(spark, v.minutes_between(F.lit(0), F.col("l")), l=("bigint", later)) == minutes


def test_births(spark):
    import datetime

    cases = (("2000-05-21", 5, True), ("2000-05-20", 5, False), ("2000-06-21", 5, True), ("2000-06-22", 5, False), ("2000-01-21", 12, True), ("2000-12-21", 12, True), ("2000-12-20", 12, False))
    for day, month, born in cases:
        assert one(spark, v.born_around(F.col("d"), month), d=("date", datetime.date.fromisoformat(day))) is born
    assert (v.next_month(12), v.next_month(1)) == (1, 2)
