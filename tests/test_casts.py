import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewright.functions import casts, formats
from tidewright.specs import ColumnSpec, TableDef


def cast_values(spark, values, spec):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    out = df.select("i", casts.cast_text(F.col("v"), spec).cast("string").alias("v"))
    return [r.v for r in out.orderBy("i").collect()]


@pytest.mark.parametrize(
    ("spec", "given_text", "expected"),
    [
        (ColumnSpec("q", "INTEGER"), ["12", " 7 ", "abc", "12.5", "", None, "$3", "9999999999"],
         ["12", "7", None, None, None, None, "3", None]),
        (ColumnSpec("q", "INTEGER", bits=64), ["9999999999"], ["9999999999"]),
        (ColumnSpec("w", "DOUBLE"), ["1.5E3", "notnum", "-.5"], ["1500.0", None, "-0.5"]),
        (ColumnSpec("b", "BOOLEAN"), ["True", "FALSE", "xyz", " y "], ["true", "false", None, "true"]),
        (ColumnSpec("d", "DECIMAL", precision=18, scale=2),
         ["$100.00", "$-42.50", "$0", "$1,234.56", " $5", "  "],
         ["100.00", "-42.50", "0.00", None, "5.00", None]),
        (ColumnSpec("d", "DECIMAL", precision=5, scale=2), ["999.99", "1000.00"], ["999.99", None]),
        (ColumnSpec("d", "DECIMAL", precision=38, scale=0), ["9" * 38, "9" * 39], ["9" * 38, None]),
        (ColumnSpec("d", "DECIMAL", precision=10, scale=4),
         ["12.34565", "0.00005", "123456.99999"], ["12.3457", "0.0001", "123457.0000"]),
        (ColumnSpec("d", "DATE", format="YYYYMMDD"),
         ["20240229", "2026063", "202606031", "20241301"], ["2024-02-29", None, None, None]),
        (ColumnSpec("d", "DATE", format="MM/DD/YYYY"),
         ["02/29/2024", "13/45/2024", "6/3/2026", "06/3/2026"], ["2024-02-29", None, None, None]),
        (ColumnSpec("d", "DATETIME", format="MM/DD/YYYY HH:MM:SS"),
         ["01/02/2024 03:04:05", "99/99/9999 99:99:99"], ["2024-01-02 03:04:05", None]),
        (ColumnSpec("d", "DATE"), ["2024-01-02", "2024-13-40", "garbage", "10:30"],
         ["2024-01-02", None, None, None]),
        (ColumnSpec("d", "DATE", format="M/D/YYYY"), ["7/4/2024", "07/04/2024"],
         ["2024-07-04", "2024-07-04"]),
        (ColumnSpec("d", "DATETIME", format="M/D/YYYY h:mm A"),
         ["7/4/2024 3:04 Pm", "3/9/2024 12:00 AM"], ["2024-07-04 15:04:00", "2024-03-09 00:00:00"]),
        (ColumnSpec("d", "DATETIME", format="YYYY-MM-DD HH:MM:SS.SSS"),
         ["2024-01-01 00:00:00.123", "2024-01-01 00:00:00.999999"],
         ["2024-01-01 00:00:00.123", None]),
        (ColumnSpec("d", "DATETIME", format="YYYY-MM-DD HH:MM:SS.SSSSSS"),
         ["2024-01-01 00:00:00.123456"], ["2024-01-01 00:00:00.123456"]),
    ],
)
def test_text_casts(spark, spec, given_text, expected):
    assert cast_values(spark, given_text, spec) == expected


def test_unknown_format_is_an_error():
    with pytest.raises(ValueError, match="registry"):
        casts.to_timestamp(F.col("x") if False else None, "DD/MM/YYYY")


def test_java_patterns():
    assert formats.java_pattern("YYYY-MM-DDTHH:MM:SS") == "yyyy-MM-dd'T'HH:mm:ss"
    assert formats.java_pattern("MM/DD/YYYY hh:mm:ss A") == "MM/dd/yyyy hh:mm:ss a"
    assert formats.java_pattern("YYYY-MM-DD HH:MM:SS.SSSSSS") == "yyyy-MM-dd HH:mm:ss.SSSSSS"
    assert formats.java_pattern("M/d/yyyy, h:mm a") == "M/d/yyyy, h:mm a"
    assert formats.strftime_of("MM/DD/YYYY HH:MM:SS") == "%m/%d/%Y %H:%M:%S"
    assert formats.strftime_of("YYYY-MM-DDTHH:MM:SS") == "%Y-%m-%dT%H:%M:%S"


def test_every_registry_format_reads_what_it_writes(spark):
    stamp = spark.range(1).select(F.lit("2024-03-09 15:04:05").cast("timestamp_ntz").alias("t"))
    for fmt in formats.DATE_FORMATS + formats.DATETIME_FORMATS:
        pattern = formats.java_pattern(fmt)
        text = stamp.select(F.date_format("t", pattern).alias("x"))
        back = text.select(F.date_format(casts.parse_with(F.col("x"), fmt), pattern) == F.col("x"))
        assert back.first()[0] is True, fmt


def test_epoch_and_serial(spark):
    df = spark.createDataFrame(
        [("1704067200123",), ("1.704067200123E12",), ("99999999999999999999",), ("2024-01-01 05:00:00",)],
        "v string",
    )
    found = [r[0] for r in df.select(casts.from_epoch_ms(F.col("v"))).collect()]
    day = dt.datetime(2024, 1, 1)
    assert found == [day, day, None, dt.datetime(2024, 1, 1, 5)]
    serial = spark.createDataFrame([("45141", "45141.5"), ("x", "x")], "d string, t string")
    found = serial.select(
        casts.from_serial_date(F.col("d")), casts.from_serial_datetime(F.col("t"))
    ).collect()
    assert tuple(found[0]) == (dt.date(2023, 8, 3), dt.datetime(2023, 8, 3, 12))
    assert tuple(found[1]) == (None, None)


def test_flexible_order(spark):
    df = spark.createDataFrame([("01/02/2024",), ("2024-01-02",), ("10:30",)], "v string")
    out = df.select(casts.flexible_timestamp(F.col("v"), "YYYY-MM-DD", ["MM/DD/YYYY"])).collect()
    assert [r[0] and r[0].date().isoformat() for r in out] == ["2024-01-02", "2024-01-02", None]


def test_casts_do_not_depend_on_ansi(spark):
    spec = TableDef("t", (ColumnSpec("a", "INTEGER"), ColumnSpec("b", "DATE", format="YYYYMMDD")))
    df = spark.createDataFrame([("x", "99999999"), ("3", "20240101")], "a string, b string")
    found = {}
    before = spark.conf.get("spark.sql.ansi.enabled")
    try:
        for ansi in ("true", "false"):
            spark.conf.set("spark.sql.ansi.enabled", ansi)
            found[ansi] = [tuple(r) for r in casts.cast_table(df, spec).collect()]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
    assert found["true"] == found["false"] == [(None, None), (3, dt.date(2024, 1, 1))]


@settings(max_examples=3, deadline=None)
@given(st.lists(st.decimals(-10**6, 10**6, places=2, allow_nan=False), min_size=5, max_size=30))
def test_rendered_decimals_come_back(spark, values):
    spec = ColumnSpec("d", "DECIMAL", precision=12, scale=2)
    texts = [f" ${v:.2f} " for v in values]
    found = cast_values(spark, texts, spec)
    assert [float(x) for x in found] == [float(v) for v in values]


def test_format_suggestion(spark):
    df = spark.createDataFrame([("01/02/2024",), ("11/30/2024",), ("junk",)], "d string")
    row = casts.suggest_format(df, ["d"]).first()
    assert (row["format"], row["share"]) == ("MM/DD/YYYY", 0.666667)
