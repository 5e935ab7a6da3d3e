import json
import re

from hypothesis import HealthCheck, example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import default_tags, merge_tags, message, request_body, tag_filter
from millrace.operators import name_audit

cases = settings(
    max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
TAGS = "map<string,string>"


def plain_camel(name):
    """ASCII letters and digits only: upper case after any other sign, else lower case."""
    out, inside = [], False
    for sign in name:
        kept = sign.isascii() and sign.isalnum()
        if kept:
            out.append(sign.lower() if inside else sign.upper())
        inside = kept
    return "".join(out)


@cases
@example(["abc\n", "abc\r\n", "abc ", "abc\n\n", "\n", "", "-", "a b", "a-b", "A  b", "aB"])
@given(st.lists(st.text(alphabet="abzABZ019-_ .\n\r\t  İéßœ", max_size=8), min_size=1))
def test_names_like_plain_python(spark, rows, names):
    audit = name_audit(spark.createDataFrame([(n,) for n in names], "given string"), "given")
    distinct = set(names)
    camels = [plain_camel(n) for n in distinct]
    assert rows(audit) == sorted(
        (
            (n, bool(re.match(r"^[a-z0-9-]+$", n)), plain_camel(n), camels.count(plain_camel(n)))
            for n in distinct
        ),
        key=repr,
    )


def test_hot_camel_form(spark):
    """A third of the names share one form; another third of the rows is one name."""
    names = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.rpad(F.lit("a"), F.floor(F.col("id") / 3) + 1, F.lit("-")))
        .when(F.col("id") % 3 == 1, "copied")
        .otherwise(F.concat(F.lit("n"), "id"))
        .alias("name")
    )
    audit = name_audit(names, "name")
    assert audit.filter("camel = 'A' and same_camel = 10000").count() == 10_000
    assert audit.count() == 20_001
    plan = audit._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_null_is_no_name(spark, rows):
    assert rows(name_audit(spark.createDataFrame([(None,), ("a",)], "n string"), "n")) == [
        ("a", True, "A", 1)
    ]


maps = st.dictionaries(st.sampled_from("abc"), st.sampled_from(["x", "y", None]), max_size=3)


@cases
@given(st.lists(st.tuples(maps, maps), min_size=1, max_size=10))
def test_merge_like_dictionaries(spark, rows, pairs):
    df = spark.createDataFrame(pairs, f"d {TAGS}, u {TAGS}")
    merged = [row.merged for row in df.select(merge_tags("d", "u").alias("merged")).collect()]
    assert sorted(map(repr, map(sorted, (m.items() for m in merged)))) == sorted(
        repr(sorted({**d, **u}.items())) for d, u in pairs
    )


def test_merge_with_defaults(spark):
    df = spark.createDataFrame(
        [("app", {"tool": "mine", "env": "dev"}), ("other", None)], f"name string, tags {TAGS}"
    )
    merged = df.select("name", merge_tags(default_tags("name"), "tags").alias("all"))
    assert {row.name: row["all"] for row in merged.select("name", "all").collect()} == {
        "app": {"application": "app", "tool": "mine", "env": "dev"},
        "other": {"application": "other", "tool": "millrace"},
    }


def test_tag_filter(spark, rows):
    df = spark.createDataFrame(
        [
            (1, {"application": "a"}),
            (2, {"application": "b"}),
            (3, {"env": "a"}),
            (4, {}),
            (5, None),
        ],
        f"id int, tags {TAGS}",
    )
    assert rows(tag_filter(df, "application", "a"), "id") == [(1,)]


def test_body_with_any_parameters(spark):
    text = 'say "hé"\n\t  \\ \U0001f600 \x01 </a>'
    df = spark.createDataFrame([("user", text)], "role string, content string")
    messages = F.concat_ws(
        ",", message("role", "content"), message(F.lit("assistant"), F.lit(None).cast("string"))
    )
    parameters = {"max_new_tokens": 1, "stop": ["\n", "é"], "nested": {"x": None, "y": 0.5}}
    (row,) = df.select(request_body(messages, parameters, stream=True).alias("body")).collect()
    assert json.loads(row.body) == {
        "messages": [
            {"role": "user", "content": text},
            {"role": "assistant", "content": None},
        ],
        "parameters": parameters,
        "stream": True,
    }
    (row,) = df.select(request_body(messages, {}).alias("body")).collect()
    assert json.loads(row.body)["parameters"] == {}
    assert json.loads(row.body)["stream"] is False
