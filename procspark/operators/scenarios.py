"""Scenario sets: whether they are sound and grounded in the world, what they lack, and what is left to run."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checks import repeated_keys, repeated_texts

#: Fixed value: how a specification's requirement ids look.
REQUIREMENT = r"\b((?:[A-Z]{3,}-)(?:[0-9]+|[A-Z]+))\b"


def requirement_ids(text: Column) -> Column:
    """Distinct requirement ids of a text, in order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(REQUIREMENT), F.lit(1))))


def version_hash(text: Column) -> Column:
    """A short name of a prompt's text."""
    return F.substring(F.sha2(text, 256), 1, 12)


def problems(scenarios: DataFrame, actors: DataFrame, items: DataFrame, allowed: Mapping[str, Iterable[str]]) -> DataFrame:
    """``(id, problem)`` of each scenario: missing fields, unknown values, references that the world hasn't got, repeats.

    ``scenarios`` has id, opening_message, actor_id, role, item_key, item_state, turn_count, followups and the columns
    that ``allowed`` names; ``actors`` has actor_id and role, ``items`` item_key.  References are looked up in narrow
    joins of their own, without the rows that have none.
    """
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""

    def named(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
        found = F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in tests.items()]))
        return df.select("id", F.explode(found).alias("problem"))

    alone = named(scenarios, {
        **{f"missing {c}": empty(c) for c in ("id", "opening_message", "actor_id", "role")},
        "state without an item": F.col("item_key").isNull() & (F.col("item_state") != "none"),
        "turn count is not 1 and the followups": F.col("turn_count") != 1 + F.coalesce(F.size("followups"), F.lit(0)),
        **{f"unknown {c}": F.col(c).isNotNull() & ~F.col(c).isin(list(values)) for c, values in allowed.items()},
    })
    # Null references, which may be many, would all meet in one task of a join, and find nothing there.
    played = scenarios.where("actor_id is not null").select("id", "actor_id", "role").join(actors.select("actor_id", F.col("role").alias("_role")), "actor_id", "left")
    acted = named(played, {"actor is not in the world": ~empty("actor_id") & F.col("_role").isNull(), "role is not the actor's": F.col("_role") != F.col("role")})
    lost = scenarios.where("item_key is not null").select("id", "item_key").join(items.select("item_key"), "item_key", "left_anti")
    ids = repeated_keys(scenarios.where(~empty("id")), "id").select("id", F.lit("id is not unique").alias("problem"))
    said = repeated_texts(scenarios, "opening_message").select("text")
    again = scenarios.select("id", F.lower(F.trim("opening_message")).alias("text")).join(said, "text", "left_semi")
    return alone.union(acted).union(lost.select("id", F.lit("item does not exist"))).union(ids).union(again.select("id", F.lit("opening message is not unique")))


def unknown_references(scenarios: DataFrame, known: Mapping[str, DataFrame]) -> DataFrame:
    """``(id, problem)`` for references to what isn't there: ``known`` gives, for a column, a table of its values.

    Flows, policies, requirements and damaged cases are such columns.  All of them are looked up in one join.
    A null refers to nothing; an empty text is a reference.
    """
    if not known:
        return scenarios.select("id", F.lit("").alias("problem")).where("false")
    pairs = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in known])
    asked = scenarios.select("id", F.inline(pairs)).where("value is not null")
    there = None
    for c, values in known.items():
        one = values.select(F.lit(c).alias("kind"), F.col(values.columns[0]).cast("string").alias("value"))
        there = one if there is None else there.union(one)
    return asked.join(there, ["kind", "value"], "left_anti").select("id", F.concat("kind", F.lit(" is not known")).alias("problem"))


def misplaced(scenarios: DataFrame, damaged: str = "data_quality_case_id", group: str = "scenario_group", allowed: str = "challenge") -> DataFrame:
    """``(id, problem)`` of scenarios over a damaged record that stand outside the group for such."""
    out = F.col(damaged).isNotNull() & ~F.col(group).eqNullSafe(F.lit(allowed))
    return scenarios.where(out).select("id", F.lit("a damaged record outside its group").alias("problem"))


def pending(scenarios: DataFrame, results: DataFrame) -> DataFrame:
    """Scenarios without a completed result."""
    done = results.where("status = 'completed'").select(F.col("scenario_id").alias("id")).distinct()
    return scenarios.join(done, "id", "left_anti")


def unused(scenarios: DataFrame, column: str, allowed: Iterable[str]) -> DataFrame:
    """Allowed values that no scenario has."""
    table = scenarios.sparkSession.createDataFrame([(x,) for x in allowed], f"{column} string")
    return table.join(scenarios.select(column).distinct(), column, "left_anti")


def bucket_drift(observed: DataFrame, column: str, buckets: Mapping[str, Iterable[str]]) -> DataFrame:
    """Values that aren't in exactly one bucket, or that are declared and never seen: value, times declared, whether seen."""
    pairs = [(name, x) for name, values in buckets.items() for x in values]
    declared = observed.sparkSession.createDataFrame(pairs, f"bucket string, {column} string").groupBy(column).agg(F.count("*").alias("declared"))
    seen = observed.select(column).distinct().withColumn("seen", F.lit(True))
    both = declared.join(seen, column, "full_outer").na.fill(0, ["declared"]).na.fill(False, ["seen"])
    return both.where("declared <> 1 or not seen")


def declared_facts(documents: DataFrame, facts: Mapping[str, str]) -> DataFrame:
    """Facts that documents declare with another value than the sheet has: ``documents(doc, key, claimed)``."""
    table = documents.sparkSession.createDataFrame([(k, str(v)) for k, v in facts.items()], "key string, actual string")
    return documents.join(table, "key", "left").where(~F.col("claimed").eqNullSafe(F.col("actual"))).select("doc", "key", "claimed", "actual")
