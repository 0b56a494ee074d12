import pytest
from pyspark.sql import functions as F

from leafmill.functions import text as X
from leafmill.ship import ship_code


def one(spark, f, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("f", "value", "expected"),
    [
        (X.collapse_space, " a 　b\t\n c ", "a b c"),
        (X.clean_inline, " a \t b \n  c ", "a b\nc"),
        (X.html_escape, "<a & 'b' \"c\">", "&lt;a &amp; &#x27;b&#x27; &quot;c&quot;&gt;"),
        (X.markdown_to_text, "<!-- x\ny --># T ![alt](s) <b>b</b>\n\n\n\n*i*", "T alt b\n\ni"),
        (X.split_table_row, "| a | b \\| c |  |", ["a", "b | c", ""]),
        (X.split_table_row, "||a|b||", ["a", "b"]),
        (X.is_table_separator, "| --- | :---: |", True),
        (X.is_table_separator, "| --- |", False),
        (X.escape_table_cell, "a | b\nc", "a \\| b c"),
        (X.escape_field, "a | b|c", "a \\| b|c"),
        (X.safe_url, " https://x/y z ", "https://x/y z"),
        (X.safe_url, "java\tscript:alert(1)", ""),
        (X.safe_url, "relative/p?q", "relative/p?q"),
        (X.safe_id, "a b/ü.c", "a_b__.c"),
        (X.encode_key, "a/b?>~", "YS9iPz5-"),
        (X.percent_encode, "a b/ü+", "a%20b/%C3%BC%2B"),
        (X.suffix_of, "a/B.DocX", ".docx"),
        (X.base_name, "a/b.c", "b.c"),
        (X.marker_attributes, 'id="t-1" format="rag"', {"id": "t-1", "format": "rag"}),
    ],
)
def test_functions(spark, f, value, expected):
    assert one(spark, f, value) == expected


@pytest.mark.parametrize("key", ["", "/abs", "a/../b"])
def test_keys_that_climb_are_refused(spark, key):
    assert one(spark, lambda x: X.decode_key(X.encode_key(x)), key) is None


def test_key_round_trip(spark):
    assert one(spark, lambda x: X.decode_key(X.encode_key(x)), "a/ü b/c.png") == "a/ü b/c.png"


def test_effective_text_folds_compatibility_forms(spark):
    ship_code(spark)
    assert one(spark, X.effective_text, "# Straße ![x](y) <b>ﬁ</b> Ａ　|-") == "strassefia"


def test_fields_without_names_are_left_out(spark):
    got = one(spark, X.split_fields, "a：1 | ：x | plain | b c： d：e")
    assert [(f.name, f.value) for f in got] == [("a", "1"), ("b c", "d：e")]


def test_image_reference(spark):
    rows = spark.createDataFrame([("a[b]", "x.png"), ("alt", "javascript:x")], "alt string, src string")
    assert [r.y for r in rows.select(X.image_reference(F.col("alt"), F.col("src")).alias("y")).collect()] == ["![a\\[b\\]](x.png)", "alt"]
