"""Replies of judges and deciders as columns, and prompts for them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_json(reply: Column, schema: str) -> Column:
    """A reply's JSON, with or without a fence around it; null where it can't be read."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(reply), r"^```[A-Za-z]*\s*", ""), r"\s*```\s*$", "")
    return F.from_json(bare, schema)


def contradiction_reply(reply: Column) -> Column:
    """contradicts, confidence, contradiction_type, description, with defaults for what is missing; unknown types are direct conflicts."""
    from memspark.operators.contradict import known_type

    x = parse_json(reply, "contradicts boolean, confidence double, contradiction_type string, description string")
    return F.struct(
        F.coalesce(x["contradicts"], F.lit(False)).alias("contradicts"), F.coalesce(x["confidence"], F.lit(0.5)).alias("confidence"),
        F.when(x["contradiction_type"].isNull(), "none").otherwise(known_type(x["contradiction_type"])).alias("contradiction_type"), F.coalesce(x["description"], F.lit("")).alias("description"),
    )


def update_reply(reply: Column) -> Column:
    """action, reason, merged_content, confidence of a decider's reply; skip and 0.8 for what is missing."""
    x = parse_json(reply, "action string, reason string, merged_content string, confidence double")
    return F.struct(
        F.coalesce(x["action"], F.lit("skip")).alias("action"), F.coalesce(x["reason"], F.lit("")).alias("reason"),
        x["merged_content"].alias("merged_content"), F.coalesce(x["confidence"], F.lit(0.8)).alias("confidence"),
    )


def reflections_reply(reply: Column) -> Column:
    """content, confidence (0.7 if missing) and supporting_indices of each reflection of a reply; those without content go."""
    x = parse_json(reply, "reflections array<struct<content: string, confidence: double, supporting_indices: array<int>>>")
    items = F.coalesce(x["reflections"], F.array().cast("array<struct<content: string, confidence: double, supporting_indices: array<int>>>"))
    told = F.filter(items, lambda i: F.coalesce(i["content"], F.lit("")) != "")
    none = F.array().cast("array<int>")
    return F.transform(told, lambda i: F.struct(i["content"].alias("content"), F.coalesce(i["confidence"], F.lit(0.7)).alias("confidence"), F.coalesce(i["supporting_indices"], none).alias("supporting_indices")))


def classify(reply: Column, labels: list[str]) -> Column:
    """The label that the reply is, letter case and blanks aside, else the first one."""
    held = F.array(*map(F.lit, labels))
    return F.coalesce(F.get(F.filter(held, lambda x: F.lower(x) == F.lower(F.trim(reply))), F.lit(0)), F.lit(labels[0]))


def prompt(template: str, **values: Column) -> Column:
    """``template`` with each {name} replaced by a column."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out
