"""Prompts for an external template extractor, its batch answers and its cost, as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.functions.text import heuristic_template, stripped

TASK = "Turn each log line into its template: keep constant words as they stand and write <*> for every part that varies."
RULES = "Keep the order of words.\nAdd and drop nothing.\nUse <*> only for values such as numbers, times, names, paths and addresses."
ENTITIES = "Look for named entities first: times, hosts, users, sessions, paths, links, counts, hashes and status codes are variable."
#: USD for 1,000 tokens in and out.
PRICES = {"gpt-4-turbo-preview": (0.01, 0.03), "gpt-4": (0.03, 0.06), "gpt-3.5-turbo": (0.0005, 0.0015)}


def extraction(log: Column, examples: list[str] = (), entities: bool = False) -> Column:
    parts = [F.lit(TASK)] + ([F.lit(ENTITIES)] if entities else [])
    for i, line in enumerate(examples, 1):
        parts += [F.concat(F.lit(f"Example {i}\nLine: {line}\nTemplate: "), heuristic_template(F.lit(line)))]
    return F.concat_ws("\n", *parts, F.lit(RULES), F.concat(F.lit("Line: "), log), F.lit("Template:"))


def batch(logs: Column) -> Column:
    """One prompt for an array of lines, numbered from 1."""
    numbered = F.transform(logs, lambda line, i: F.concat((i + 1).cast("string"), F.lit(". "), line))
    return F.concat_ws("\n", F.lit(TASK), F.lit(RULES), F.array_join(numbered, "\n"), F.lit("One template on each line, in this order:"))


def merging(p: Column, q: Column) -> Column:
    return F.concat_ws("\n", F.lit("Are these two templates one event?"), F.concat(F.lit("A: "), p), F.concat(F.lit("B: "), q), F.lit("Answer MERGE: <template> or KEEP_SEPARATE: <reason>."))


def validation(log: Column, template: Column) -> Column:
    return F.concat_ws("\n", F.lit("Does the template fit the line?"), F.concat(F.lit("Line: "), log), F.concat(F.lit("Template: "), template), F.lit("Answer VALID or INVALID: <reason>."))


def likeness(a: Column, b: Column) -> Column:
    return F.concat_ws("\n", F.lit("How alike are the events of these lines, from 0 to 1?"), F.concat(F.lit("A: "), a), F.concat(F.lit("B: "), b), F.lit("Answer with a number."))


def batch_answer(df: DataFrame, response: str, expected: Column) -> DataFrame:
    """df with position (from 0) and template: the answer's lines without blank and # lines and numbering, up to `expected`."""
    lines = F.filter(F.transform(F.split(stripped(F.col(response)), "\n"), stripped), lambda s: (s != "") & ~s.startswith("#"))
    plain = F.filter(F.transform(lines, lambda s: F.regexp_replace(s, r"^\d+[\.\)]\s*", "")), lambda s: s != "")
    return df.select(*df.columns, F.posexplode(F.slice(plain, F.lit(1), expected)).alias("position", "template"))


def cost(tokens: Column, model: Column) -> Column:
    """Half of the tokens count as input; a model without a price has that of gpt-4."""
    mean = lambda m: (PRICES[m][0] + PRICES[m][1]) / 2
    rate = F.when(F.lit(False), 0.0)
    for m in PRICES:
        rate = rate.when(model == m, mean(m))
    return tokens / F.lit(1000.0) * rate.otherwise(mean("gpt-4"))
