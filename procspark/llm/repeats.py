"""Keys that occur in more than one document, without ever gathering a key's rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Documents without an id come behind all others, with numbers from here on; ids so great count as equal to them.
NULLS = (1 << 63) - (1 << 31)


def document_rows(docs: DataFrame) -> DataFrame:
    """``doc`` (null ids last), ``tag`` (32 bits of the text's hash) and ``text``; both together name a document.

    Null ids, of which there may be many, are told apart by 31 bits of another hash as well.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    unnamed = F.lit(NULLS) + F.xxhash64(text, F.lit(1)).bitwiseAND(F.lit(0x7FFFFFFF))
    doc = F.coalesce(F.col("doc_id").cast("bigint"), unnamed)
    return docs.select(doc.alias("doc"), F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF)).alias("tag"), text.alias("text"))


def place(tags: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Tag and position in one long."""
    return (tags.astype(np.uint64) << np.uint64(32) | positions.astype(np.uint64)).view(np.int64)


def tag_of(col: str) -> Column:
    return F.shiftrightunsigned(F.col(col), 32)


def position_of(col: str) -> Column:
    return F.col(col).bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")


def sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least or greatest of ``width`` values from each position on."""
    pick, size, current = np.minimum if least else np.maximum, 1, values
    while size * 2 <= width:
        current = pick(current[:-size], current[size:])
        size *= 2
    n = len(values) - width + 1
    return pick(current[:n], current[width - size : width - size + n]) if size < width else current


def settle(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a block whose key stands in a smaller document of the same block, and rows that they repeat.

    The former repeat for certain and need no partner from elsewhere, so a frequent key sends on the rows of one
    document of each block only.
    """
    docs = np.minimum(docs, NULLS)
    order = np.lexsort((docs, keys))
    k, d = keys[order], docs[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    group = np.cumsum(new) - 1
    first = d[np.flatnonzero(new)][group] if len(k) else d
    sure, repeated = np.zeros(len(k), bool), np.zeros(len(k), bool)
    sure[order] = d > first
    repeated[order] = (np.bincount(group, d > first) > 0)[group] & (d == first) if len(k) else False
    return sure, repeated


def scatter(keys: np.ndarray, sure: np.ndarray, places: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Keys for the shuffle: settled rows are dealt evenly, as they need no partner."""
    spread = (places.view(np.uint64) ^ docs.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) * np.uint64(0x9E3779B97F4A7C15)
    return np.where(sure, spread.view(np.int64), keys)


class _Stream:
    """Rows ordered by key, group by group, with a state of one group's first document.

    ``later`` passes on rows that aren't of their key's first document, ``shared`` all rows of keys with two documents
    or more, ``mark`` all rows with a column ``again`` that tells the later ones.  Settled rows, and rows that they
    repeat, count as what they are.  ``later`` and ``mark`` need the documents of a key in order; for ``shared`` the
    first is the one that comes first.
    """

    def __init__(self, keys: tuple[str, ...], keep: tuple[str, ...], mode: str):
        self.keys, self.keep, self.mode = keys, keep, mode

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, open_shared, waiting = None, False, []
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            col = lambda name, b=batch: np.asarray(b.column(b.schema.get_field_index(name)))
            keys, doc, sure = [col(k) for k in self.keys], np.minimum(col("doc"), NULLS), col("sure")
            new = np.zeros(n, bool)
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            new[0] = before is None or any(k[0] != b for k, b in zip(keys, before[0], strict=True))
            group = np.cumsum(new) - (1 if new[0] else 0)
            starts = np.flatnonzero(new)
            firsts = doc[starts] if new[0] else np.concatenate([[before[1]], doc[starts]])
            later = doc != firsts[group] if self.mode == "shared" else doc > firsts[group]
            out = batch.select(list(self.keep))
            if self.mode == "mark":
                out, keep = out.append_column("again", pa.array(sure | later)), np.ones(n, bool)
            elif self.mode == "later":
                keep = sure | later
            else:
                hit = np.bincount(group, later, len(firsts)) > 0
                if not new[0]:
                    hit[0] |= open_shared
                    if hit[0]:
                        yield from waiting
                if new[0] or len(firsts) > 1 or hit[0]:
                    waiting = []
                keep = sure | hit[group]
                if "repeated" in batch.schema.names:
                    keep |= col("repeated")
                open_shared = bool(hit[-1])
                last = (group == len(firsts) - 1) & ~keep
                if not open_shared and last.any():
                    waiting = [*waiting, out.filter(pa.array(last))]
            before = ([k[-1] for k in keys], firsts[-1])
            if keep.any():
                yield out.filter(pa.array(keep))


def repeats(
    rows: DataFrame, keys: tuple[str, ...], keep: tuple[str, ...], mode: str = "later", unpack: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Columns ``keep`` of the rows that a mode of ``_Stream`` passes on.

    ``rows`` has the keys, ``doc`` and ``sure``.  One shuffle by the first key and a sort that can spill; a group
    passes through its task as a stream, however large it is.  ``unpack`` makes columns that needn't be shuffled.
    """
    # Which of a shared key's documents is first doesn't matter, and a sort by one number is several times faster.
    ordered = rows.repartition(keys[0]).sortWithinPartitions(*keys, *(() if mode == "shared" else ("doc",)))
    ordered = unpack(ordered) if unpack else ordered
    schema = ordered.select(*keep).schema
    if mode == "mark":
        schema = T.StructType([*schema.fields, T.StructField("again", T.BooleanType())])
    return ordered.mapInArrow(_Stream(keys, keep, mode), schema)
