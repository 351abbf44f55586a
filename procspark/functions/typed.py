"""Attributes of any type as VARIANT columns, and the maps of texts that analyses use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def kind(value: Column) -> Column:
    """``str``, ``int``, ``float``, ``bool``, ``list``, ``object`` or ``null`` for a VARIANT value."""
    named = lambda said: (
        F.when(said.isNull() | (said == "VOID"), "null").when(said == "BIGINT", "int").when(said == "BOOLEAN", "bool").when(said == "STRING", "str")
        .when(said.startswith("ARRAY"), "list").when(said.startswith("OBJECT"), "object").otherwise("float")
    )
    return let(F.schema_of_variant(value), named)


def read_as(value: Column, sql: str) -> Column:
    """A VARIANT value as an SQL type, null where it isn't one."""
    return F.call_function("try_variant_get", value, F.lit("$"), F.lit(sql))


def text(value: Column) -> Column:
    """A value as text: True and False, numbers with a point if they are fractions, JSON for lists and objects."""
    said = lambda v, of: (
        F.when(of == "bool", F.initcap(read_as(v, "string"))).when(of == "float", read_as(v, "double").cast("string"))
        .when(of.isin("list", "object"), F.to_json(v)).otherwise(read_as(v, "string"))
    )
    return let(value, lambda v: let(kind(v), lambda of: said(v, of)))


def quoted(value: Column) -> Column:
    """A text as JSON; null stays null."""
    return F.when(value.isNotNull(), let(F.to_json(F.array(value)), lambda said: F.substring(said, F.lit(2), F.length(said) - 2)))


def members(props: Column) -> Column:
    """The attributes as a map of VARIANT values."""
    return props.cast("map<string,variant>")


def texts(props: Column, nested: bool = True) -> Column:
    """The attributes as a map of texts; without ``nested`` lists and objects are left out."""
    every = members(props)
    kept = every if nested else F.map_filter(every, lambda _, v: ~kind(v).isin("list", "object"))
    return F.transform_values(kept, lambda _, v: text(v))


def said(props: Column, key: str) -> Column:
    """A scalar attribute as ``texts`` has it, null for lists and objects; most are texts, which are read as they are."""
    if not key or "'" in key or '"' in key:  # Such a key can't stand in a path.
        return F.element_at(texts(props, nested=False), F.lit(key))
    at = lambda sql: F.call_function("try_variant_get", props, F.lit(f"$['{key}']"), F.lit(sql))
    taken = let(at("variant"), lambda v: F.when(~kind(v).isin("list", "object"), text(v)))

    def read(plain: Column) -> Column:
        first = F.substring(plain, 1, 1)
        # 2.0 reads 2 here, as the whole number does.
        number = first.isin(*"-0123456789") & ~plain.contains(":")
        return F.when(first.isin("{", "[") | plain.isin("true", "false", "Infinity", "NaN") | number, taken).otherwise(plain)

    return let(at("string"), read)


def get(props: Column, key: str, kind_: str = "string") -> Column:
    """An attribute as a type, null where it isn't one."""
    quoted = key.replace("'", "\\'")
    return F.call_function("try_variant_get", props, F.lit(f"$['{quoted}']"), F.lit(kind_))


def types(df: DataFrame, props: str = "props") -> DataFrame:
    """``key``, ``type`` and ``mixed`` for each attribute of a VARIANT column; keys with several types are ``str`` and mixed.

    Nulls have no type.  One row for each key and type is shuffled from each task.
    """
    each = df.select(F.explode(members(F.col(props))).alias("key", "v")).select("key", kind(F.col("v")).alias("kind")).where("kind <> 'null'")
    got = each.groupBy("key").agg(F.min("kind").alias("least"), F.max("kind").alias("most"))
    mixed = F.col("least") != F.col("most")
    return got.select("key", F.when(mixed, "str").otherwise(F.col("least")).alias("type"), mixed.alias("mixed"))


#: The SQL type of each kind.
SQL_TYPES = {"int": "bigint", "float": "double", "bool": "boolean", "str": "string", "list": "string", "object": "string"}


def columns(df: DataFrame, props: str = "props", prefix: str = "", keys: DataFrame | None = None) -> DataFrame:
    """The attributes as typed columns beside the others, in order of their names, found in the data.

    Mixed keys, lists and objects are columns of texts.  Names of the keys, which are few, come to the session.
    """
    found = (types(df, props) if keys is None else keys).orderBy("key").collect()
    made = []
    for r in found:
        sql = SQL_TYPES[r.type]
        value = F.element_at(members(F.col(props)), F.lit(r.key))
        value = text(value) if sql == "string" else read_as(value, sql)
        made.append(value.alias(prefix + r.key))
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != props], *made)
