import datetime as dt

from pyspark.sql import functions as F

from rillset.functions import scalar, vectorized


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_text(spark):
    s = F.lit("\t  ab \n")
    assert one(spark, scalar.strip(s), scalar.lstrip(s), scalar.rstrip(s)) == ("ab", "ab \n", "\t  ab")
    text = F.lit("hello")
    assert one(spark, scalar.substring(text, F.lit(-2), F.lit(3)), scalar.substring(text, F.lit(4)), scalar.substring(text, F.lit(9), F.lit(2))) == ("hel", "lo", "")


def test_numbers(spark):
    assert one(spark, scalar.safe_mod(F.lit(-7), F.lit(3)), scalar.safe_mod(F.lit(1), F.lit(0)), scalar.safe_div(F.lit(1.0), F.lit(0.0))) == (-1, None, None)
    scalar.register(spark)
    assert tuple(spark.sql("SELECT int_div(-7, 2), int_div(1, 0), starts_with('abc', 'ab'), sub_text('abc', 0, 2)").first()) == (-3, None, True, "ab")


def test_dates(spark):
    d, t = F.lit(dt.date(2024, 2, 29)), F.lit("2024-02-29 13:45:10").cast("timestamp_ntz")
    assert one(spark, scalar.extract("DOW", d), scalar.extract("DOY", d), scalar.extract("HOUR", t)) == (4, 60, 13)
    assert one(spark, scalar.extract("DOW", F.lit(dt.date(2024, 3, 3)))) == (7,)
    assert one(spark, *[scalar.date_trunc(u, d, True) for u in ("YEAR", "QUARTER", "MONTH", "WEEK", "DAY")]) == (dt.date(2024, 1, 1), dt.date(2024, 1, 1), dt.date(2024, 2, 1), dt.date(2024, 2, 26), dt.date(2024, 2, 29))
    a, b = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), F.lit("2024-03-30 23:00:00").cast("timestamp_ntz")
    assert one(spark, *[scalar.date_diff(u, a, b) for u in ("DAY", "WEEK", "MONTH", "YEAR", "HOUR")]) == (59, 8, 1, 0, 1439)
    assert one(spark, scalar.date_diff("DAY", b, a)) == (-59,)


def test_batch_expressions(spark):
    df = spark.createDataFrame([(1, 2, "a"), (None, 0, "B")], "x INT, y INT, s STRING")
    out = vectorized.project_batch(df, *[vectorized.call(n, F.col("x"), F.col("y")).alias(n) for n in ("add", "multiply", "divide", "gt", "not_equal")], vectorized.call("upper", F.col("s")).alias("u"))
    assert [tuple(r) for r in out.collect()] == [(3, 2, 0.5, False, True, "A"), (None, None, None, None, None, "B")]
    assert vectorized.filter_batch(df, vectorized.call("equal", F.col("x"), vectorized.literal(1))).count() == 1
