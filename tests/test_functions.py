"""Column helpers: the Oracle semantics the reports depend on."""

import datetime as dt

from pyspark.sql import functions as F

from supplyscope.functions import oracle as O


def one(spark, expr, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_concat_null_parts_read_as_empty(spark):
    rows = [("a", "b", "c"), ("a", None, "c"), (None, None, None)]
    got = one(spark, O.oracle_concat("x", F.lit("/"), "y", F.lit("-"), "z"), rows, "x string, y string, z string")
    assert got == ["a/b-c", "a/-c", "/-"]
    # every part NULL: Oracle's empty text is NULL
    assert one(spark, O.oracle_concat("x", "y"), rows, "x string, y string, z string") == ["ab", "a", None]


def test_category_path_keeps_its_dots(spark):
    rows = [(None, None, None, None, None)]
    e = O.oracle_concat("a", F.lit("."), "b", F.lit("."), "c", F.lit("."), "d", F.lit("."), "e")
    assert one(spark, e, rows, "a string, b string, c string, d string, e string") == ["...."]


def test_strip_controls_tab_to_space_lf_cr_removed(spark):
    rows = [("a\tb\nc\rd",), (None,)]
    assert one(spark, O.strip_controls("s"), rows, "s string") == ["a bcd", None]


def test_digits_guard(spark):
    rows = [("007",), (" 12 ",), ("A12",), ("",), ("  ",), (None,), ("1 2",), ("123\n",), ("9" * 20,)]
    assert one(spark, O.digits_to_number("s"), rows, "s string") == [7, 12, None, None, None, None, None, None, 10 ** 20 - 1]


def test_safe_number_rejects_letters(spark):
    rows = [("30",), (" -1.5 ",), (".5",), ("1e3",), ("30d",), ("5F",), ("NaN",), ("Infinity",), ("",), (None,), ("7\n",)]
    assert one(spark, O.safe_number("s"), rows, "s string") == [30, -1.5, 0.5, 1000, None, None, None, None, None, None, None]


def test_decode_number_tax_id_types(spark):
    from supplyscope.operators.rules import tax_id
    rows = [(k, "12345678", "0001", "99") for k in ["2", "02", "1", "3", "9", "zz", None]]
    got = one(spark, tax_id(F.col("k"), F.col("a"), F.col("b"), F.col("c")), rows,
              "k string, a string, b string, c string")
    assert got == ["12345678/0001-99", "12345678/0001-99", "12345678-99", "12345678000199", None, None, None]


def test_tax_id_null_parts(spark):
    from supplyscope.operators.rules import tax_id
    rows = [("2", "123", None, "9"), ("3", None, None, None)]
    got = one(spark, tax_id(F.col("k"), F.col("a"), F.col("b"), F.col("c")), rows,
              "k string, a string, b string, c string")
    assert got == ["123/-9", None]


def test_substr_short_name_is_null(spark):
    rows = [("ABCompany",), ("XY",), ("ABC",), (None,)]
    assert one(spark, O.substr_from("s", 4), rows, "s string") == ["ompany", None, None, None]


def test_day_range_keeps_last_fraction_and_drops_next_midnight(spark):
    rows = [(dt.datetime(1997, 12, 31, 23, 59, 59),), (dt.datetime(1997, 12, 31, 23, 59, 59, 500000),),
            (dt.datetime(1998, 1, 1, 0, 0, 0),), (dt.datetime(1996, 1, 1, 0, 0, 0),),
            (dt.datetime(1995, 12, 31, 23, 59, 59),)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz")
    got = [r[0] for r in df.select(O.day_range("ts", "01/01/1996", "31/12/1997")).collect()]
    assert got == [True, True, False, True, False]


def test_day_range_pushes_to_parquet(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    plan = df.where(O.day_range("o_orderdate", "01/01/1996", "31/12/1996"))._jdf.queryExecution() \
        .executedPlan().toString()
    assert "PushedFilters" in plan and "o_orderdate" in plan.split("PushedFilters")[1][:300]


def test_to_char_and_parameter_parsing(spark):
    rows = [(dt.datetime(1997, 3, 4, 5, 6, 7),)]
    assert one(spark, O.to_char("ts"), rows, "ts timestamp_ntz") == ["04/03/1997 05:06:07"]
    assert O.parse_report_date("04/03/1997") == dt.date(1997, 3, 4)


def test_safe_number_malformed_is_null(spark):
    rows = [("12",), ("abc",), (None,), (" 7 ",)]
    assert one(spark, O.safe_number("s"), rows, "s string") == [12.0, None, None, 7.0]


def test_effective_date_modes(spark):
    rows = [(dt.date(1996, 1, 1), dt.date(1996, 6, 1)),    # ends on as_of: closed yes, end-only no
            (dt.date(1996, 7, 1), dt.date(1997, 1, 1)),    # starts later: closed no, end-only yes
            (dt.date(1995, 1, 1), None),                   # NULL end fails both
            (dt.date(1996, 6, 1), dt.date(1996, 6, 2))]
    schema = "s date, e date"
    as_of = dt.date(1996, 6, 1)
    assert one(spark, O.valid_on("s", "e", as_of), rows, schema) == [True, False, None, True]
    assert one(spark, O.ends_after("e", as_of), rows, schema) == [False, True, None, True]


def test_code_text_number_vs_text(spark):
    rows = [(1,), (None,)]
    assert one(spark, O.code_text("n"), rows, "n long") == ["1", None]


def test_day_range_independent_of_session_time_zone(spark):
    rows = [(dt.datetime(1996, 1, 1, 0, 0, 0),), (dt.datetime(1995, 12, 31, 23, 0, 0),)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        for tz in ["UTC", "America/Sao_Paulo", "Asia/Tokyo"]:
            spark.conf.set("spark.sql.session.timeZone", tz)
            got = [r[0] for r in df.select(O.day_range("ts", "01/01/1996", "31/12/1996")).collect()]
            assert got == [True, False], tz
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_code_number_matches_like_oracle(spark):
    codes = spark.createDataFrame([("01", "a"), (" 2", "b"), ("1.0", "c"), ("X1", "d"), (None, "e")],
                                  "lookup_code string, meaning string")
    ids = spark.createDataFrame([(1,), (2,), (3,)], "routing long")
    got = ids.join(codes, ids.routing == O.code_number(codes.lookup_code), "left").select("routing", "meaning")
    assert sorted((r[0], r[1]) for r in got.collect()) == [(1, "a"), (1, "c"), (2, "b"), (3, None)]


def test_safe_number_decimal_comma(spark):
    rows = [("3,5",), ("1.234,5",), ("12",), ("abc",)]
    assert one(spark, O.safe_number("s", decimal_comma=True), rows, "s string") == [3.5, 1234.5, 12.0, None]
    assert one(spark, O.safe_number("s"), rows, "s string")[2:] == [12.0, None]
