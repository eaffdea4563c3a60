from datetime import date, datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from harborbook.functions import (
    JsonField,
    capped,
    days_between,
    decimal_field,
    first_part,
    fraction_of,
    guarded_number,
    json_fields,
    json_text,
    nz,
    text_like_zero,
    yyyymm,
    zip5,
)
from harborbook.functions.jsonfields import checked_json, json_problems


def values(spark, kind, items, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
    return [r[0] for r in df.select(column, "i").orderBy("i").collect()]


def test_zip5(spark):
    items = ["123", "12345", "12345-6789", None]
    assert values(spark, "string", items, zip5("v")) == ["00123", "12345", "-6789", None]


def test_accident_zip(spark):
    zip_code = F.when(text_like_zero("v"), F.lit("n.a.")).otherwise(zip5("v"))
    assert values(spark, "string", ["0", "", "123", "x", None], zip_code) == ["n.a.", "n.a.", "00123", "0000x", None]


def test_period_and_days(spark):
    assert values(spark, "date", [date(2024, 6, 30), None], yyyymm("v")) == [202406, None]
    late = datetime(2024, 1, 1, 23)
    assert values(spark, "timestamp", [late], days_between("v", F.lit(datetime(2024, 1, 2, 1)))) == [1]


def test_cap_keeps_null(spark):
    assert values(spark, "int", [51, 50, None], capped("v", 50)) == [50, 50, None]
    assert values(spark, "int", [None, 3], nz("v")) == [0, 3]


def test_fraction_of_year(spark):
    assert values(spark, "int", [366, 365, -10], fraction_of(F.col("v"))) == [D("1.002740"), D("1.000000"), D("-0.027397")]


def test_guarded_number(spark):
    items = ["1000", "10.5", "1.2.3", "abc", "", None]
    assert values(spark, "string", items, guarded_number("v")) == [1000, 11, None, None, None, None]


def test_decimal_field(spark):
    items = ["0.08|table7", "", None, "12.5", "n/a"]
    split = decimal_field("v", "decimal(10,4)", "0.5", split=True)
    assert values(spark, "string", items, split) == [D("0.0800"), D("0.5000"), D("0.5000"), D("12.5000"), D("0.5000")]
    assert values(spark, "string", ["12.5"], decimal_field("v", "decimal(18,0)")) == [13]
    assert values(spark, "string", ["a|b"], first_part("v")) == ["a"]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        values(spark, "string", ["n/a"], decimal_field("v", "decimal(10,4)", strict=True))


DOCS = [
    '{"a": {"f1 <- x": "5", "basePremium (f1)": 12.50}, "lob specific": {"n": "7"}, "location.cost": "9"}',
    '{"a": {}}',
    '{"a": {"f1 <- x": ""}}',
    "{bad",
    "",
    None,
    '{"a": 5}',
    "[1]",
]


def test_json_text_missing_and_invalid(spark):
    assert values(spark, "string", DOCS, json_text("v", "a", "f1 <- x")) == ["5", "", "", None, None, None, "", ""]
    null = json_text("v", "a", "f1 <- x", missing="null")
    assert values(spark, "string", DOCS, null) == ["5", None, "", None, None, None, None, None]
    with pytest.raises(ValueError):
        json_text("v", "a", missing="other")


def test_json_fields_equal_path_calls(spark):
    fields = [
        JsonField("x", "v", ("a", "f1 <- x"), "decimal(18,0)", "3"),
        JsonField("base", "v", ("a", "basePremium (f1)")),
        JsonField("n", "v", ("lob specific", "n")),
        JsonField("cost", "v", ("location.cost",)),
    ]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(DOCS)], "i int, v string")
    got = json_fields(df, fields).orderBy("i").collect()
    paths = [decimal_field(json_text("v", *f.path, missing="null"), f.dtype, f.default).alias(f.name) for f in fields]
    want = df.select("i", "v", *paths).orderBy("i").collect()
    assert got == want
    assert (got[0]["x"], got[0]["base"], got[0]["n"], got[0]["cost"]) == (5, 13, 7, 9)
    assert [r["x"] for r in got[1:]] == [3] * 7


def test_duplicate_key_takes_last(spark):
    df = spark.createDataFrame([('{"a": "1", "a": "2"}',)], "v string")
    assert json_fields(df, [JsonField("x", "v", ("a",))]).first()["x"] == 2
    assert df.select(json_text("v", "a")).first()[0] == "1"


SUB = '{"limits": {"A": "7", "B": "x"}}'
NESTED = [
    '{"c": {"s": %s}}' % SUB,
    '{"c": {"s": "%s"}}' % SUB.replace('"', '\\"'),
    '{"c": {"s": "{oops"}}',
    '{"c": {"s": ""}}',
    '{"c": {}}',
    "{bad",
    "",
    None,
]
INNER = [JsonField("a", "v", ("c", "s", "limits", "A"), inner=2), JsonField("b", "v", ("c", "s", "limits", "B"), inner=2)]


def test_sub_documents_as_objects_and_texts(spark):
    df = spark.createDataFrame(list(enumerate(NESTED)), "i int, v string")
    got = json_fields(df, INNER).orderBy("i").collect()
    assert [(r["a"], r["b"]) for r in got] == [(7, None), (7, None)] + [(None, None)] * 6
    with pytest.raises(ValueError, match="sub-document"):
        JsonField("a", "v", ("c",), inner=1)
    with pytest.raises(ValueError, match="read as"):
        json_fields(df, [*INNER, JsonField("whole", "v", ("c", "s", "limits", "A"))])


def test_problems_name_the_row(spark):
    df = spark.createDataFrame(list(enumerate(NESTED)), "i int, v string")
    got = {(r["i"], r["source"], r["field"], r["problem"], r["found"]) for r in json_problems(df, INNER, ["i"]).collect()}
    assert got == {
        (0, "v", "b", "number", "x"),
        (1, "v", "b", "number", "x"),
        (2, "v", "a", "sub-document", "{oops"),
        (5, "v", None, "document", "{bad"),
    }
    assert json_problems(df.limit(0), INNER, ["i"]).count() == 0


@pytest.mark.parametrize("row, message", [(0, "b is no number: x, i 0"), (2, "a lies in no JSON, i 2"), (5, "v is no JSON, i 5")])
def test_strict_fields_stop_at_the_row(spark, row, message):
    df = spark.createDataFrame([(row, NESTED[row])], "i int, v string")
    with pytest.raises(Exception, match=message):
        json_fields(checked_json(df, ["v"], "i"), INNER, strict=True, row="i").collect()


def test_strict_fields_let_good_rows_pass(spark):
    good = [JsonField("a", "v", ("c", "s", "limits", "A"), inner=2)]
    rows = [(i, NESTED[i]) for i in (0, 1, 3, 4, 6, 7)]
    df = spark.createDataFrame(rows, "i int, v string")
    got = json_fields(checked_json(df, ["v"], "i"), good, strict=True, row="i").orderBy("i").collect()
    assert [r["a"] for r in got] == [7, 7, None, None, None, None]
    with pytest.raises(ValueError, match="tells the rows apart"):
        json_fields(df, good, strict=True)
