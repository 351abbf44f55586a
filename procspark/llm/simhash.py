"""SimHash near-duplicates, with candidates from Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into four segments of 16 bits.  If two fingerprints differ in three bits at most, one
segment is equal, and of the two halves (24 bits, of which 23 are used) of what is left one differs in one bit at
most.  The perfect binary Golay code [23, 12] decodes such a half to the index of its nearest codeword.  One side
gives that index; the other gives the indices of all 24 words within one bit, among which it must be.  So each pair
meets at a key of 16 exact bits, 12 bits of codeword index and the choice of segment and half; an XOR then verifies it.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import LOWER, Scratch, map_rows, texts
from .components import components

#: Words in a shingle, the hash's seed, the generator polynomial of the Golay code.
SHINGLE = 3
SEED = 42
GENERATOR = 0b101011100011
MAX_BITS = 3

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_BYTE = (np.arange(8, dtype=np.int64) * 256)[None, :]
#: Hashes of a text are counted in blocks of so many.
_BLOCK = 1 << 16


def fingerprint(text: bytes) -> int:
    """SimHash of word shingles, repeats included; no words give zero."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    n, ones = len(words) - SHINGLE + 1, np.zeros(64, np.int64)
    hashes = map(partial(xxhash.xxh64_intdigest, seed=SEED), map(b" ".join, zip(words, words[1:], words[2:], strict=False)))
    for i in range(0, n, _BLOCK):
        h = np.fromiter(hashes, np.uint64, min(_BLOCK, n - i))
        counts = np.bincount((h.view(np.uint8).reshape(-1, 8) + _BYTE).ravel(), minlength=2048)
        ones += (counts.reshape(8, 256) @ _BITS).ravel()
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batch: pa.RecordBatch) -> dict[str, object]:
    fps = np.array([fingerprint(t) for t in texts(batch.column(2))], np.uint64).view(np.int64)
    return {"doc_id": batch.column(0), "h": batch.column(1), "fp": pa.array(fps)}


def _text_hash():
    return F.xxhash64(F.col("text").cast("string"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``h`` (a hash of the text) and ``fp``, the fingerprint as a signed long, for each row."""
    df = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _text_hash().alias("h"), F.col("text").cast("string").alias("text"))
    return map_rows(df, _fingerprints, "doc_id bigint, h bigint, fp bigint")


class Golay:
    """The perfect binary Golay code: nearest codewords by a table of syndromes, made from the generator."""

    def __init__(self):
        n = np.arange(1 << 12, dtype=np.uint32)
        self.low = self._rest(n)
        self.high = self._rest(n[: 1 << 11] << 12)
        flips = np.uint32(1) << np.arange(23, dtype=np.uint32)
        errors = {0} | {int(a | b | c) for a in flips for b in flips for c in flips}
        self.error = np.zeros(1 << 11, np.uint32)
        words = np.array(sorted(errors), np.uint32)
        self.error[self.syndrome(words)] = words
        self.near = np.concatenate([np.zeros(1, np.uint32), flips])

    @staticmethod
    def _rest(words: np.ndarray) -> np.ndarray:
        words = words.copy()
        for bit in range(22, 10, -1):
            words ^= np.where(words >> np.uint32(bit) & np.uint32(1), np.uint32(GENERATOR << (bit - 11)), np.uint32(0))
        return words

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return self.low[words & 0xFFF] ^ self.high[words >> np.uint32(12)]

    def index(self, words: np.ndarray) -> np.ndarray:
        """The 12 data bits of the codeword nearest to each word of 23 bits."""
        return (words ^ self.error[self.syndrome(words)]) >> np.uint32(11)


_golay: Golay | None = None


def golay_keys(fps: np.ndarray, near: bool) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints and the positions of the fingerprints they belong to."""
    global _golay
    code = _golay = _golay or Golay()
    fps, keys, owners = fps.view(np.uint64), [], []
    for segment in range(4):
        shift = np.uint64(16 * segment)
        exact = fps >> shift & np.uint64(0xFFFF)
        below = fps & ((np.uint64(1) << shift) - np.uint64(1))
        rest = below | (fps >> (shift + np.uint64(15)) >> np.uint64(1)) << shift
        for half in range(2):
            word = (rest >> np.uint64(24 * half) & np.uint64(0x7FFFFF)).astype(np.uint32)
            found = np.sort(code.index(word[:, None] ^ (code.near if near else code.near[:1])[None, :]), axis=1)
            fresh = np.ones(found.shape, bool)
            fresh[:, 1:] = found[:, 1:] != found[:, :-1]
            owner, at = np.nonzero(fresh)
            keys.append(found[owner, at].astype(np.int64) | exact[owner].astype(np.int64) << 12 | (segment * 2 + half) << 28)
            owners.append(owner)
    return np.concatenate(keys), np.concatenate(owners)


def _keys(near: bool):
    def make(batch: pa.RecordBatch) -> dict[str, object]:
        fps = np.asarray(batch.column(0))
        keys, owners = golay_keys(fps, near)
        return {"key": pa.array(keys), "fp": pa.array(fps[owners])}

    return make


def near_fingerprints(fps: DataFrame) -> DataFrame:
    """Pairs ``a < b`` of distinct fingerprints ``fp`` that differ in ``MAX_BITS`` bits at most; a pair may repeat.

    Spark sizes both sides as if a fingerprint had one key; it has 8 on one side and about 43 on the other, so neither side is
    broadcast by that size.
    """
    one = map_rows(fps, _keys(False), "key bigint, fp bigint", 1 << 16).select("key", F.col("fp").alias("a"))
    other = map_rows(fps, _keys(True), "key bigint, fp bigint", 1 << 16).select("key", F.col("fp").alias("b"))
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
    return one.join(other.withColumnRenamed("key", "k").hint("merge"), (F.col("key") == F.col("k")) & close).select("a", "b")


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their fingerprints, and the component of each fingerprint."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.cut(fingerprints(docs), "fingerprints")
    distinct = scratch.cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    member = components(near_fingerprints(distinct.select("fp")), scratch)
    least = distinct.join(member.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    roots = least.groupBy("component").agg(F.min("least").alias("component_id"))
    return rows, scratch.cut(least.join(roots.hint("merge"), "component").select("fp", "component", "component_id"), "classes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Near-duplicate classes: ``doc_id``, ``fingerprint`` (hex) and ``component_id`` for each row of ``docs``.

    Texts link when their fingerprints differ in three bits at most; ``component_id`` is the least ``doc_id``
    reachable over links.  Null and empty texts have fingerprint zero and link as any other.  Rows with a null id take
    part in links, and have the component's least id (null if there is none).  Repeated rows stay repeated.  Equal
    fingerprints become one before the join, so large groups of copies cost one key set.  Other columns aren't read.
    """
    rows, known = _classes(docs)
    return rows.join(known.hint("merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class, with all its columns: one with the least id.

    Of several rows with that id the one whose text has the least hash stays, of equal rows one.  In a class without
    ids, the text with the least hash stays, once.
    """
    rows, known = _classes(docs)
    chosen = rows.join(known.hint("merge"), "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # Texts count once each before the least is taken, and only sums go over the network.
    chosen = chosen.groupBy("component", "component_id").agg(F.min(F.coalesce("h", F.lit(0))).alias("least_h"))
    chosen = chosen.select(F.col("component_id").alias("least_id"), "least_h")
    names = {f"c{i}": c for i, c in enumerate(docs.columns)}
    by = {c: n for n, c in names.items()}
    wide = docs.toDF(*names)
    wide = wide.withColumn("h", F.xxhash64(F.col(by["text"]).cast("string")))
    own_id = F.col(by["doc_id"]).cast("bigint")
    spread = lambda c: F.coalesce(c, F.lit(0))
    there = (spread(own_id) == spread(F.col("least_id"))) & (F.col("h") == F.col("least_h")) & own_id.eqNullSafe(F.col("least_id"))
    left = wide.join(chosen.hint("merge"), there, "left_semi").withColumn("id", own_id)
    nth = F.row_number().over(W.partitionBy("id", "h").orderBy(F.lit(0)))
    return left.withColumn("nth", nth).where("nth = 1").drop("nth", "id", "h").toDF(*names.values())
