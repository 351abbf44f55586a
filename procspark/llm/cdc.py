"""Substring dedup by content-defined chunking.

A gear hash rolls over the last 8 bytes; a text is cut where the hash is the least of those around it.  So a cut
depends on the bytes near it only, and an insertion changes the chunks around it and no others.  Windows of neighbouring
chunks are compared by digest, so what repeats stands together in one earlier document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_rows, texts
from .repeats import NULLS, document_rows, place, position_of, repeats, scatter, settle, sliding, tag_of

#: A cut's gear hash is below the ones of so many bytes before and not above those behind: chunks have more bytes, twice as many on average.
RADIUS = 8
#: A longer chunk, which only dull bytes have, is cut anyway.
MOST = 256
#: Bytes that the gear hash rolls over.
REACH = 8
#: Repeats are removed where so many bytes of chunks follow each other in one earlier document too; short common phrases stay.
RUN_BYTES = 96
#: The gear table, one number for each byte, from a fixed generator.
GEAR = np.random.Generator(np.random.PCG64(1)).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(text: bytes) -> np.ndarray:
    """At each byte, the sum of the gear numbers of the last ``REACH`` bytes, shifted by their distance; by doubling."""
    h, step = GEAR[np.frombuffer(text, np.uint8)], 1
    while step < REACH:
        h = h.copy()
        h[step:] += h[:-step].copy() << np.uint32(step)
        step *= 2
    return h


def cuts(text: bytes) -> list[int]:
    """Ends of the chunks of a text; none for an empty one."""
    if not text:
        return []
    n, h = len(text), gear(text)
    around = np.concatenate([np.full(RADIUS, 0xFFFFFFFF, np.uint32), h, np.full(RADIUS, 0xFFFFFFFF, np.uint32)])
    least = sliding(around, RADIUS, True)
    out, last = [], 0
    for end in (np.flatnonzero((h < least[:n]) & (h <= least[RADIUS + 1 :])) + 1).tolist():
        while end - last > MOST:
            last += MOST
            out.append(last)
        out.append(end)
        last = end
    while n - last > MOST:
        last += MOST
        out.append(last)
    if last < n:
        out.append(n)
    return out


def windows(bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last places in ``bounds``, the ends of chunks from 0 on, of the windows that tell all repeats.

    From each chunk on, and up to each chunk, the shortest row of chunks of ``least`` bytes at least.  Every chunk of a
    longer row lies in a window within that row, so comparing windows is comparing all rows.
    """
    last, n = np.searchsorted(bounds, bounds[:-1] + least), len(bounds)
    first = np.searchsorted(bounds, bounds[1:] - least, "right") - 1
    ahead, back = np.flatnonzero(last < n), np.flatnonzero(first >= 0)
    both = np.unique(np.concatenate([ahead * n + last[ahead], first[back] * n + back + 1]))
    return both // n, both % n


def _windows(least: int):
    def make(batch: pa.RecordBatch) -> dict[str, object]:
        docs, tags = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        starts, owners, digests, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [], [np.zeros(0, np.int64)]
        for i, text in enumerate(texts(batch.column(2))):
            bounds = np.array([0, *cuts(text)], np.int64)
            one, other = windows(bounds, least)
            shape = np.diff(bounds).astype("<u2").tobytes()
            a, b = bounds[one], bounds[other]
            for x, y, k, n in zip(a.tolist(), b.tolist(), (one * 2).tolist(), (other * 2).tolist(), strict=True):
                digests.append(hashlib.blake2b(text[x:y] + shape[k:n], digest_size=12).digest())
            starts.append(a)
            sizes.append(b - a)
            owners.append(np.full(len(a), i))
        owner = np.concatenate(owners)
        both = np.frombuffer(b"".join(digests), [("k1", "<i8"), ("k2", "<i4")])
        doc, at = docs[owner], place(tags[owner], np.concatenate(starts))
        sure, _ = settle(both["k1"].copy(), doc)
        # Settled windows need no digest; neighbours among them share a key, which packs well in the shuffle.
        stretch = (at.view(np.uint64) >> np.uint64(8)).view(np.int64)
        # The size fills the other half of the second key, where it takes less room than in a column.
        k2 = np.where(sure, np.int64(0), both["k2"].astype(np.int64)) << 32 | np.concatenate(sizes)
        return {"doc": pa.array(doc), "at": pa.array(at), "k1": pa.array(scatter(both["k1"], sure, stretch, doc)), "k2": pa.array(k2), "sure": pa.array(sure)}

    return make


def merged(spans: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """Maximal runs of (start, end) that touch or overlap, of ``least`` bytes at least."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out if b - a >= least]


def _apply(least: int):
    def apply(batch: pa.RecordBatch) -> dict[str, object]:
        kept, runs = [], []
        for text, starts, ends in zip(texts(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            found = merged(list(zip(starts or [], ends or [], strict=True)), least)
            pieces, last = [], 0
            for a, b in found:
                pieces.append(text[last:a])
                last = b
            kept.append(b"".join([*pieces, text[last:]]))
            runs.append([{"start": a, "end": b} for a, b in found])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        size = pa.array([len(t) for t in texts(batch.column(1))], pa.int64())
        return {"doc": batch.column(0), "n_bytes": size, "removed": pa.array(runs, kind), "kept": pa.array(kept, pa.binary())}

    return apply


def cut_out(rows: DataFrame, spans: DataFrame, least: int) -> DataFrame:
    """Texts of ``rows`` without ``spans(doc, at, size)``: ``doc_id``, ``n_bytes``, ``removed`` and ``kept`` bytes."""
    per_doc = spans.select("doc", tag_of("at").alias("tag"), position_of("at").alias("a"), "size").groupBy("doc", "tag").agg(
        F.collect_set(F.struct("a", "size")).alias("s")
    )
    joined = rows.join(per_doc, ["doc", "tag"], "left").select(
        "doc", "text", F.col("s.a").alias("starts"), F.transform("s", lambda x: x["a"] + x["size"]).alias("ends")
    )
    schema = "doc bigint, n_bytes bigint, removed array<struct<start:bigint,end:bigint>>, kept binary"
    out = map_rows(joined, _apply(least), schema)
    return out.select(F.when(F.col("doc") < NULLS, F.col("doc")).alias("doc_id"), "n_bytes", "removed", "kept")


def dedup_chunks(docs: DataFrame, run_bytes: int = RUN_BYTES) -> DataFrame:
    """Remove rows of chunks that stand in the same order in one document with a smaller id: one row per row of ``docs``.

    ``doc_id``, ``n_bytes``, ``removed`` (rows of chunks of ``run_bytes`` at least, joined where they touch, in bytes of
    the UTF-8 text) and ``kept`` (the other bytes).  Chunks of which each repeats another document, but which don't
    follow each other there, stay.  The smallest id that has a row of chunks keeps it; repeats within one document
    stay.  Null and empty texts have no chunks.  Null ids come behind all others and keep nothing from each other;
    rows with the same id are no repeats of each other.  Other columns aren't read.
    """
    rows = document_rows(docs)
    schema = "doc bigint, at bigint, k1 bigint, k2 bigint, sure boolean"
    found = repeats(map_rows(rows, _windows(run_bytes), schema), ("k1", "k2"), ("doc", "at", "k2"))
    # Written, so that the windows' shuffle files are gone before the texts are dealt.
    found = Scratch(docs.sparkSession).cut(found.select("doc", "at", position_of("k2").alias("size")), "repeats")
    return cut_out(rows, found, run_bytes)


def digest(out: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    size = F.aggregate("removed", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"])
    return out.select(
        "doc_id",
        "n_bytes",
        size.alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
