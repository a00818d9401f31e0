import hashlib
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from footfall.functions import text as tx


def apply(spark, values, build, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    rows = df.select("i", build(F.col("x")).alias("y")).orderBy("i").collect()
    return [r["y"] for r in rows]


def test_strip_and_normalise_follow_unicode_white_space(spark):
    spaces = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())
    assert len(spaces) == 29
    values = [f"{s}A{s}{s}b{s}" for s in spaces] + ["", "  ", "plain"]
    assert apply(spark, values, tx.strip) == [v.strip() for v in values]
    assert apply(spark, values, tx.normalise) == [re.sub(r"\s+", " ", v.strip().lower()) for v in values]


def test_hash_of_missing_parts(spark):
    df = spark.createDataFrame([(None, "Good  Book"), ("T", None), (None, None)], "title string, text string")
    got = [r[0] for r in df.select(tx.review_hash(F.col("title"), F.col("text"))).collect()]
    want = [hashlib.sha1(t.encode()).hexdigest()[:16] for t in (". good book", "t.", ".")]
    assert got == want


def test_clean_query(spark):
    cases = {
        None: "general book recommendation",
        " \n\t ": "general book recommendation",
        "first line\nsecond": "first line",
        "one two": "one",
        "one\x1ctwo": "one",
        '"quoted"': "quoted",
        "'single'": "single",
        "\"'both'\"": "both",
        "Query: a calm story": "a calm story",
        "SEARCH QUERY:x": "x",
        "Output:   y  ": "y",
        "query: output: z": "output: z",
        "Query:": "general book recommendation",
        "my query: stays": "my query: stays",
        '""': "general book recommendation",
    }
    assert apply(spark, list(cases), lambda c: tx.clean_query(c, "general book recommendation")) == list(cases.values())


def test_fallback_flag_ignores_case_and_spacing(spark):
    values = ["General  Book\tRecommendation ", "general book", ""]
    assert apply(spark, values, lambda c: tx.is_fallback(c, "general book recommendation")) == [True, False, False]


def test_single_line_and_truncate(spark):
    assert apply(spark, [" a\r\nb ", None], tx.single_line) == ["a  b", ""]
    assert apply(spark, ["😀😀😀", None], lambda c: tx.truncate(c, 2)) == ["😀😀", ""]


def test_template_values_may_contain_braces(spark):
    df = spark.createDataFrame([("{reviews}", "{meta}")], "m string, r string")
    filled = df.select(tx.fill_template("a {meta} b {{x}} {reviews}", meta=F.col("m"), reviews=F.col("r"))).first()[0]
    assert filled == "a {reviews} b {x} {meta}"


def test_meta_block(spark):
    df = spark.createDataFrame(
        [("Ann", "ab", 4.5, None), (None, "long enough", None, 3)],
        "author string, details string, average_rating double, rating_number int",
    )
    got = [r[0] for r in df.select(tx.meta_block(df.columns)).collect()]
    assert got == ["Author: Ann\nAvgRating: 4.5 (? ratings)", "Details: long enough"]


def test_review_pieces_and_pool_text(spark):
    df = spark.createDataFrame(
        [(["t1", "", None], ["x1", " ", None, "x4"]), ([], []), (None, None), (["only"], [""])],
        "titles array<string>, texts array<string>",
    )
    got = [r[0] for r in df.select(tx.pool_text(F.col("titles"), F.col("texts"), 5, 500)).collect()]
    assert got == [
        "Review title: t1\nReview text: x1\n\nReview text: x4", "", "", "Review title: only",
    ]


def test_item_text_falls_back(spark):
    assert apply(spark, ["card", "", None], lambda c: tx.item_text("Do.", c, "book")) == [
        "Do.\n\ncard", "general book recommendation", "general book recommendation",
    ]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8", exclude_characters="\x00"), max_size=30), min_size=1, max_size=20))
def test_strip_matches_python(spark, values):
    assert apply(spark, values, tx.strip) == [v.strip() for v in values]


def test_as_list(spark):
    assert apply(spark, ["a", "  ", None], lambda c: tx.as_list(c, False)) == [["a"], [], []]
    assert apply(spark, [["a", None], None], lambda c: tx.as_list(c, True), "array<string>") == [["a", None], []]
