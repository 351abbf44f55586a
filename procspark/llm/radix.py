"""Repeated byte windows by a depth-limited radix sort of suffixes, most significant digits first.

A suffix matters through its first 50 bytes only.  Three passes deal suffixes out by ever longer digits, and after each
only groups with more than one document go on:

1. the 24 bytes at an anchor.  An anchor is a position whose 24 bytes have the least hash among those that start in
   some 50-byte window; equal windows have their anchors at the same places, so windows can be equal only if their
   anchors' digits are;
2. the whole block of an anchor: all bytes of the windows that it is the anchor of.  Equal blocks repeat whole;
3. for blocks that share an anchor's digit and yet differ, each 50-byte window.

Groups that are equal to the last digit are exactly the repeated windows.  Each pass is one shuffle by the digit; a
group passes through a task as a stream, least document first, and is never gathered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cdc import cut_out
from .common import Scratch, map_rows, texts
from .repeats import document_rows, place, position_of, repeats, scatter, settle, sliding, tag_of

#: Fixed value: bytes in a window.
WINDOW = 50
#: Bytes in the first digit.
GRAM = 24
_REACH = WINDOW - GRAM + 1
_BLOCK = 1 << 19


def rolling(data: np.ndarray, width: int, base: int) -> np.ndarray:
    """A 64-bit polynomial hash of the ``width`` bytes at each position, by doubling."""
    power, size, done, out = np.uint64(base), 1, 0, None
    current = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)
    left = width
    while left:
        if left & 1:
            if out is None:
                out = current
            else:
                out = out[: max(0, len(current) - done)] * power + current[done:]
            done += size
        left >>= 1
        if left:
            current = current[:-size] * power + current[size:]
            power, size = np.uint64(int(power) ** 2 & 0xFFFFFFFFFFFFFFFF), size * 2
    out = out[: max(0, len(data) - width + 1)]
    out = (out ^ out >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ out >> np.uint64(32)


class Anchors:
    """Digits, window minima and anchors of some texts that stand one behind the other."""

    def __init__(self, blobs: list[bytes]):
        sizes = np.array([len(b) for b in blobs], np.int64)
        self.starts = np.cumsum(sizes) - sizes
        self.raw = b"".join(blobs) + bytes(WINDOW)
        self.data = np.frombuffer(self.raw, np.uint8)
        n = len(self.raw) - WINDOW
        self.gram = rolling(self.data, GRAM, 0x9E3779B97F4A7C15)
        self.gram |= np.uint64(1)  # so that 0 can mark windows that cross the end of a text
        self.least = sliding(self.gram[: n + _REACH - 1], _REACH, True)
        edge = np.zeros(n + 1, np.int32)
        np.add.at(edge, np.maximum(self.starts, self.starts + sizes - WINDOW + 1), 1)
        np.add.at(edge, self.starts + sizes, -1)
        self.least[np.cumsum(edge[:n]) > 0] = 0

    def find(self) -> tuple[np.ndarray, np.ndarray]:
        """The text of each anchor, and its position in all texts."""
        padded = np.concatenate([np.zeros(_REACH - 1, np.uint64), self.least])
        highest = sliding(padded, _REACH, False)
        at = np.flatnonzero(highest == self.gram[: len(highest)])
        return np.searchsorted(self.starts, at, "right") - 1, at

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and last window that each anchor belongs to."""
        back = at[:, None] - np.arange(_REACH)[::-1]
        inside = (back >= 0) & (back < len(self.least))
        own = inside & (self.least[np.clip(back, 0, len(self.least) - 1)] == self.gram[at][:, None])
        return at - (_REACH - 1) + own.argmax(axis=1), at - own[:, ::-1].argmax(axis=1)


def _first_pass(batch: pa.RecordBatch) -> dict[str, object]:
    docs, tags = np.asarray(batch.column(0)), np.asarray(batch.column(1))
    found = Anchors(texts(batch.column(2)))
    owner, where = found.find()
    doc, at = docs[owner], place(tags[owner], where - found.starts[owner])
    key = found.gram[where].view(np.int64)
    sure, repeated = settle(key, doc)
    key = scatter(key, sure, at, doc)
    return {"doc": pa.array(doc), "at": pa.array(at), "key": pa.array(key), "sure": pa.array(sure), "repeated": pa.array(repeated)}


def _positions(batch: pa.RecordBatch, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and position of each candidate anchor of a batch with the columns doc, tag, text, positions."""
    lists = batch.column(3)
    counts = np.diff(np.asarray(lists.offsets))
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.asarray(lists.flatten()).astype(np.int64) + starts[owner]


def _second_pass(batch: pa.RecordBatch) -> dict[str, object]:
    docs, tags = np.asarray(batch.column(0)), np.asarray(batch.column(1))
    found = Anchors(texts(batch.column(2)))
    owner, where = _positions(batch, found.starts)
    low, high = found.windows(where)
    ends = high + WINDOW
    raw = found.raw
    digests = [xxhash.xxh3_64_digest(raw[a:b], x) for a, b, x in zip(low.tolist(), ends.tolist(), (where - low).tolist(), strict=True)]
    block = np.frombuffer(b"".join(digests), np.int64)
    gram = found.gram[where].view(np.int64)
    doc, at = docs[owner], place(tags[owner], low - found.starts[owner])
    # Blocks are compared among those with the same first digit, so both hashes must agree.
    sure, _ = settle(block ^ gram, doc)
    return {
        "doc": pa.array(doc), "at": pa.array(at), "extent": pa.array(ends - low << 6 | where - low << 1 | sure),
        "gram": pa.array(scatter(gram, sure, at, doc)), "block": pa.array(block),
    }


def _unpack(rows: DataFrame) -> DataFrame:
    """A block's size, its anchor's place in it, which is below 32, and whether it is settled, from the one long that is shuffled."""
    low = F.col("extent")
    parts = {"size": F.shiftright(low, 6).cast("int"), "lead": F.shiftright(low, 1).bitwiseAND(F.lit(31)).cast("int"), "sure": low.bitwiseAND(F.lit(1)) == 1}
    return rows.withColumns(parts).drop("extent")


def _third_pass(batch: pa.RecordBatch) -> dict[str, object]:
    docs, tags = np.asarray(batch.column(0)), np.asarray(batch.column(1))
    found = Anchors(texts(batch.column(2)))
    owner, where = _positions(batch, found.starts)
    low, high = found.windows(where)
    n = high - low + 1
    first = np.cumsum(n) - n
    start = np.repeat(low - first, n) + np.arange(n.sum())
    owner, digit = np.repeat(owner, n), np.repeat(found.gram[where].view(np.int64), n)
    window = rolling(found.data, WINDOW, 0xC2B2AE3D27D4EB4F)[start].view(np.int64)
    doc, at = docs[owner], place(tags[owner], start - found.starts[owner])
    sure, _ = settle(window ^ digit, doc)
    # 32 bits of the anchor's hash beside 64 of the window's: these rows are most of what the disk must hold at once.
    gram = (digit >> 32).astype(np.int32)
    return {"doc": pa.array(doc), "at": pa.array(at), "window": pa.array(scatter(window, sure, at, doc)), "gram": pa.array(gram), "sure": pa.array(sure)}


def _with_positions(rows: DataFrame, places: DataFrame) -> DataFrame:
    per_doc = places.select("doc", tag_of("at").alias("tag"), position_of("at").alias("p")).groupBy("doc", "tag").agg(
        F.collect_set("p").alias("positions")
    )
    return rows.join(per_doc, ["doc", "tag"]).select("doc", "tag", "text", "positions")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """Remove every byte covered by a 50-byte string that also starts in a document with a smaller id.

    One row per row of ``docs``: ``doc_id``, ``n_bytes``, ``removed`` (maximal runs, in bytes of the UTF-8 text) and
    ``kept`` (the other bytes).  Strings are judged on the input.  Null, empty and short texts have no windows.  Null
    ids come behind all others and remove nothing from each other; rows with the same id remove nothing from each
    other.  Other columns aren't read.
    """
    scratch, rows = Scratch(docs.sparkSession), document_rows(docs)
    schema = "doc bigint, at bigint, key bigint, sure boolean, repeated boolean"
    grams = repeats(map_rows(rows, _first_pass, schema, _BLOCK), ("key",), ("doc", "at"), "shared")
    anchors = scratch.cut(grams, "anchors")

    schema = "doc bigint, at bigint, extent bigint, gram bigint, block bigint"
    blocks = map_rows(_with_positions(rows, anchors), _second_pass, schema, _BLOCK)
    blocks = scratch.cut(repeats(blocks, ("gram", "block"), ("doc", "at", "size", "lead", "gram"), "mark", _unpack), "blocks")
    scratch.drop(anchors)

    # Blocks of first documents that share an anchor's digit with another block, yet have other bytes around it.
    firsts = blocks.where("not again").select("doc", (F.col("at") + F.col("lead")).alias("at"), "gram", F.lit(False).alias("sure"))
    mixed = scratch.cut(repeats(firsts, ("gram",), ("doc", "at"), "shared"), "mixed")
    schema = "doc bigint, at bigint, window bigint, gram int, sure boolean"
    each = map_rows(_with_positions(rows, mixed), _third_pass, schema, _BLOCK)
    # Windows are dealt by their own digit, as many of them may share a common anchor.
    single = scratch.cut(repeats(each, ("window", "gram"), ("doc", "at")).withColumn("size", F.lit(WINDOW)), "windows")
    scratch.drop(mixed)
    return cut_out(rows, blocks.where("again").select("doc", "at", "size").unionByName(single), 1)
