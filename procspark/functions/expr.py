"""Column functions that several operators share."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The duration histogram has 54 buckets, six to a decade of seconds.
BUCKETS = 54
BASE = 10 ** (1 / 6)


def duration_bucket(seconds: Column) -> Column:
    """0 for no or negative time, then one bucket for each sixth of a decade."""
    index = 1 + F.floor(F.log(seconds.cast("double")) / F.log(F.lit(BASE)))
    return F.when(seconds <= 0, F.lit(0)).otherwise(F.least(F.lit(BUCKETS - 1), index)).cast("int")


def bucket_middle(bucket: Column) -> Column:
    """The geometric middle of a bucket, in seconds."""
    return F.when(bucket <= 0, F.lit(0.0)).otherwise(F.pow(F.lit(BASE), bucket - F.lit(0.5)))


def literal_map(values: Mapping[str, object], kind: str) -> Column:
    """A map literal that may be empty."""
    items = [F.lit(x) for pair in values.items() for x in pair]
    return (F.create_map(*items) if items else F.create_map()).cast(f"map<string,{kind}>")


def activity_rank(activity: Column, ranks: Mapping[str, int]) -> Column:
    """The declared rank; undeclared activities have rank 0."""
    return F.coalesce(F.element_at(literal_map(ranks, "bigint"), activity), F.lit(0).cast("bigint"))


def resource_kind(resource: Column) -> Column:
    """batch, human or vendor by the name's prefix, else unknown."""
    name = F.lower(F.coalesce(resource, F.lit("")))
    return (
        F.when(name.startswith("batch"), "batch").when(name.startswith("user"), "human").when(name.startswith("vendor"), "vendor").otherwise("unknown")
    )


def agent_resource_kind(resource: Column) -> Column:
    """Kinds in agent logs, where a prefix before a colon names the kind."""
    return F.when(resource.startswith("agent:"), "agent").when(resource.startswith("tool:"), "tool").otherwise(resource_kind(resource))


def flow_of(attrs: Column, key: str) -> Column:
    """A case attribute as text; missing is empty."""
    return F.coalesce(F.element_at(attrs, F.lit(key)), F.lit(""))


def cents(value: Column) -> Column:
    """Currency to integer cents, half to even."""
    return F.bround(value.cast("double") * 100).cast("bigint")


def sha_prefix(parts: Iterable[Column], length: int) -> Column:
    """Hex digits of the SHA-256 of the parts, joined by NUL."""
    joined = F.concat_ws("\0", *[p.cast("string") for p in parts])
    return F.substring(F.sha2(joined, 256), 1, length)


def sorted_json(attrs: Column) -> Column:
    """A map as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(attrs))))


def share(part: Column, whole: Column) -> Column:
    """A ratio; nothing of nothing is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def json_numbers(text: Column) -> Column:
    """Numbers in a text, thousands separators removed."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![\w.])(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)"), F.lit(1))
    return F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double"))


def duration_text(seconds: float) -> str:
    """A short reading of a duration."""
    for unit, size in (("d", 86400), ("h", 3600), ("m", 60)):
        if seconds >= size:
            return f"{seconds / size:.1f}{unit}"
    return f"{seconds:.0f}s"
