"""Micro goldens of cleaning, extraction, similarity and merging."""

import pytest
from pyspark.sql import functions as F

from loomlog.functions import prompts, similarity, text


def values(spark, columns, **literals):
    df = spark.createDataFrame([tuple(literals.values())], ", ".join(f"{k} string" for k in literals))
    return df.select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


@pytest.mark.parametrize(
    ("line", "expected"),
    [
        ("2024-01-01 10:00:00 INFO User 12345 logged in from 192.168.1.1", "INFO User <NUM> logged in from <NUM>.<NUM>"),
        ("2024-01-01 10:05:00 ERROR Failed to connect to database on port 5432", "ERROR Failed to connect to database on port <NUM>"),
        ("2024-01-01 10:10:00 DEBUG Reading file /var/log/app.log", "DEBUG Reading file <PATH>"),
        ("  \t ", ""),
        (None, ""),
    ],
)
def test_clean(spark, line, expected):
    assert values(spark, [text.clean(F.col("x"), remove_timestamps=True)], x=line)[0] == expected


@pytest.mark.parametrize(
    ("line", "expected"),
    [
        ("2024-01-01 10:00:00 ERROR Failed to connect to database server1 on port 5432", "<*> ERROR Failed to connect to database server<*> on port <*>"),
        ("Connection to 192.168.1.1:8080 established", "Connection to <*>:<*> established"),
        ("2024-01-01 10:10:00 DEBUG Reading file /var/log/app.log", "<*> DEBUG Reading file <*>"),
        ("mail from user1@example.com to bob@example.com", "mail from user<*>@example.com to <*>"),
        ("WARNING High memory usage: 85%", "WARNING High memory usage: <*>%"),
    ],
)
def test_heuristic_template(spark, line, expected):
    assert values(spark, [text.heuristic_template(F.col("x"))], x=line)[0] == expected


@pytest.mark.parametrize(("line", "valid"), [("", False), (None, False), ("short", False), ("----------- ___", False), ("a line of words", True), ("  tiny     ", False)])
def test_valid(spark, line, valid):
    assert values(spark, [text.is_valid(F.col("x"))], x=line)[0] is valid


def test_components(spark):
    got = values(spark, [text.components_of(F.col("x"))], x="2024-01-01 10:00:00 error disk Error full")[0]
    assert (got.timestamp, got.level, got.message) == ("2024-01-01 10:00:00", "ERROR", "disk  full")


@pytest.mark.parametrize(
    ("a", "b", "expected"),
    [("user1", "user2", 0.8), ("server1", "server12", 0.875), ("10.0.0.1", "192.168.1.9", 0.9), ("1234", "-5.6", 0.9), ("a" * 32, "b" * 32, 0.85), ("2024-01-01", "2025-02-03", 0.9), ("abc", "xyz", 0.0), ("x", "x", 1.0)],
)
def test_token_similarity(spark, a, b, expected):
    assert values(spark, [similarity.token_similarity(F.col("a"), F.col("b"))], a=a, b=b)[0] == pytest.approx(expected)


@pytest.mark.parametrize(("p", "q", "expected"), [("User <*> logged in", "User <*> logged out", 0.705), ("a b", "a b", 1.0), ("a b c", "a b", 0.666667), ("", "a", 0.0)])
def test_pattern_similarity(spark, p, q, expected):
    assert values(spark, [similarity.pattern_similarity(F.col("p"), F.col("q"))], p=p, q=q)[0] == pytest.approx(expected, abs=1e-6)


def test_merge_and_variables(spark):
    got = values(spark, [similarity.merge_pad(F.col("p"), F.col("q")), similarity.merge_truncate(F.col("p"), F.col("q")), similarity.should_merge(F.lit("User <*> logged in"), F.lit("User <*> logged out"))], p="a b c", q="a x")
    assert tuple(got) == ("a <*> <*>", "a <*>", False)
    v = values(spark, [similarity.variables(F.col("t"), F.col("p")), similarity.variables(F.col("t"), F.lit("User (.*) <*>")), similarity.variables(F.col("t"), F.lit("none"))], t="User bob on h9", p="User <*> on <*>")
    assert v[0] == {"var_1": "bob", "var_2": "h9"} and v[1] == {} and v[2] == {}
    assert values(spark, [similarity.variables(F.col("t"), F.lit("cost (a+b) <*>$"))], t="cost (a+b) 5$")[0] == {"var_1": "5"}


def test_batch_answer_and_cost(spark):
    df = spark.createDataFrame([("1. User <*> in\n\n# note\n2) Fail <*>\n3.  Third\n10.5 ms elapsed",)], "r string")
    assert [r.template for r in prompts.batch_answer(df, "r", F.lit(9)).orderBy("position").collect()] == ["User <*> in", "Fail <*>", "Third", "5 ms elapsed"]
    got = values(spark, [prompts.cost(F.lit(1500), F.lit("gpt-3.5-turbo")), prompts.cost(F.lit(1500), F.lit("?"))], x="")
    assert got[0] == pytest.approx(0.0015) and got[1] == pytest.approx(0.0675)
