"""Source divergence audit: which terms set a source apart within its language, and which sources differ most.

A first pass over the texts adds up a count-min sketch of document frequencies, cell by cell, in the shuffle.  Its
estimates are never too small, so a term that it puts below the threshold can't be kept, and a second pass drops such terms
before anything is shuffled.  The others are counted exactly.  Sources are compared by a join over terms that both have; terms
that one or neither has come in by counts, as their probability there is the same for all.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import CHUNK_BYTES, Scratch, bounded, small_batches, texts

#: ASCII letters are lower-cased and other ASCII bytes become spaces; bytes of other letters stay.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: A term is kept in a language where it stands in so many documents.
LEAST_DOCS = 10
#: Ranks of terms that are reported.
TOP = 10
#: The sketch: rows, cells of a row, cells of a block.  A cell is a byte that stays at its greatest value, so the sketch takes
#: 12 MB whatever the corpus; beyond some millions of terms it drops fewer of them, and results are the same.
ROWS, CELLS, BLOCK = 3, 1 << 22, 1 << 14
CEILING = 255
#: A task sends on what it has counted when it has so many entries.
MOST = 200_000


def _columns(docs: DataFrame) -> DataFrame:
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(empty("text"), empty("lang"), empty("source"))


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, list[bytes]]]:
    for whole in batches:
        for batch in bounded(whole, CHUNK_BYTES):
            for text, lang, source in zip(texts(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                yield lang, source, text.translate(TERMS).split()


def cells(lang: str, terms: list[bytes]) -> np.ndarray:
    """The cells of terms, a row of the sketch each."""
    seed = xxhash.xxh32_intdigest(lang.encode())
    h = np.fromiter((xxhash.xxh3_64_intdigest(t, seed) for t in terms), np.uint64, len(terms))
    low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
    return np.stack([(low + np.uint64(r) * high) % np.uint64(CELLS) for r in range(ROWS)]).astype(np.int64)


def _add(sketch: np.ndarray, at: np.ndarray, counts: np.ndarray) -> None:
    for r in range(ROWS):
        cell, back = np.unique(at[r], return_inverse=True)
        sketch[r, cell] = np.minimum(sketch[r, cell] + np.bincount(back, counts).astype(np.int64), CEILING)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of this task's sketch that aren't zero."""
    sketch, counts, n = np.zeros((ROWS, CELLS), np.uint8), defaultdict(Counter), 0

    def put() -> None:
        for lang, found in counts.items():
            _add(sketch, cells(lang, list(found)), np.fromiter(found.values(), np.int64, len(found)))
        counts.clear()

    for i, (lang, _, terms) in enumerate(_each(batches)):
        counts[lang].update(set(terms))
        if i % 64 == 63 and sum(map(len, counts.values())) >= MOST:
            put()
    put()
    yield from _blocks(sketch)


def _blocks(sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
    flat = sketch.reshape(-1, BLOCK)
    there = np.flatnonzero(flat.any(axis=1))
    for i in range(0, len(there), 64):
        some = there[i : i + 64]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([flat[b].tobytes() for b in some], pa.binary())], names=["block", "cells"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the blocks that were dealt to this task, as they stream by; it holds each block once."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, got in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            more = np.frombuffer(got, np.uint8)
            sums[block] = more if block not in sums else np.minimum(sums[block].astype(np.int16) + more, CEILING).astype(np.uint8)
    blocks = sorted(sums)
    for i in range(0, len(blocks), 64):
        some = blocks[i : i + 64]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([sums[b].tobytes() for b in some], pa.binary())], names=["block", "cells"])


def frequency_sketch(docs: DataFrame) -> np.ndarray:
    """Upper bounds of document frequencies up to ``CEILING``, by hash of language and term; 12 MB, whatever the corpus."""
    small_batches(docs.sparkSession)
    shape = "block int, cells binary"
    merged = _columns(docs).mapInArrow(_sketches, shape).repartition("block").mapInArrow(_merged, shape)
    sketch = np.zeros((ROWS * CELLS // BLOCK, BLOCK), np.uint8)
    for r in merged.toLocalIterator():
        sketch[r.block] = np.frombuffer(r.cells, np.uint8)
    return sketch.reshape(ROWS, CELLS)


class _Counting:
    """Occurrences and documents of the terms that the sketch leaves, for each language and source."""

    def __init__(self, sketch, least_docs: int):
        self.sketch, self.least = sketch, least_docs

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = self.sketch.value
        counts, docs = defaultdict(Counter), defaultdict(Counter)
        for i, (lang, source, terms) in enumerate(_each(batches)):
            counts[lang, source].update(terms)
            docs[lang, source].update(set(terms))
            if i % 64 == 63 and sum(map(len, docs.values())) >= MOST:
                yield from self._out(sketch, counts, docs)
        yield from self._out(sketch, counts, docs)

    def _out(self, sketch: np.ndarray, counts: dict, docs: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), found in docs.items():
            terms = list(found)
            at = cells(lang, terms)
            bound = np.minimum.reduce([sketch[r, at[r]] for r in range(ROWS)])
            kept = [terms[k] for k in np.flatnonzero(bound >= self.least)]
            if not kept:
                continue
            own = counts[lang, source]
            whole = pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(kept), pa.string()), pa.array([source] * len(kept), pa.string()), pa.array(kept, pa.binary()).cast(pa.string()),
                    pa.array([own[t] for t in kept], pa.int64()), pa.array([found[t] for t in kept], pa.int64()),
                ],
                names=["lang", "source", "term", "n", "d"],
            )
            yield from bounded(whole, CHUNK_BYTES)
        counts.clear()
        docs.clear()


def term_counts(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``lang, source, term, n, d``: occurrences and documents, exact, of all terms that may stand in so many documents.

    ``least_docs`` is at most ``CEILING``, which cells count up to.
    """
    if least_docs > CEILING:
        raise ValueError(f"the sketch counts up to {CEILING}")
    spark: SparkSession = docs.sparkSession
    sketch = spark.sparkContext.broadcast(frequency_sketch(docs))
    rows = _columns(docs).mapInArrow(_Counting(sketch, least_docs), "lang string, source string, term string, n bigint, d bigint")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def _p(n: str | Column, all_n: str, terms: str) -> Column:
    """1 + floor(10**9 * (n + 2) / (N + 2 V)), in decimals, so that no count is too great."""
    n = F.col(n) if isinstance(n, str) else n
    over = (n.cast("decimal(20,0)") + F.lit(2)) * F.lit(1_000_000_000).cast("decimal(10,0)")
    under = F.col(all_n).cast("decimal(20,0)") + F.col(terms).cast("decimal(20,0)") * F.lit(2)
    return F.lit(1).cast("bigint") + F.call_function("div", over.cast("decimal(38,0)"), under.cast("decimal(38,0)"))


def _f(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``.

    For each language and source, ``pair`` ranks the other sources of the language by their divergence over all kept terms, and
    ``term`` the ``top`` terms that the source has more often than the language as a whole.  Null texts, languages and
    sources are empty ones.  Repeated rows count each.  A source without terms is compared as any other; a language
    without kept terms has pairs of value 0.  Other columns aren't read; an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    groups = scratch.cut(_columns(docs).select("lang", "source").distinct(), "groups")
    counts = scratch.cut(term_counts(docs, least_docs), "counts")
    by_term = W.partitionBy("lang", "term")  # a row for each source, not for each document
    kept = counts.withColumns({"df": F.sum("d").over(by_term), "total": F.sum("n").over(by_term), "nth": F.row_number().over(by_term.orderBy("source"))})
    kept = scratch.cut(kept.where(F.col("df") >= least_docs).drop("d", "df"), "kept")

    first = F.col("nth") == 1
    langs = kept.groupBy("lang").agg(F.count_if(first).alias("v"), F.sum(F.when(first, F.col("total"))).alias("n_lang"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_own"), F.count("*").alias("t"))
    none = F.lit(0).cast("bigint")
    about = groups.join(langs, "lang", "left").join(own, ["lang", "source"], "left").na.fill(0, ["v", "n_lang", "n_own", "t"])
    about = scratch.cut(about.withColumn("zero", F.when(F.col("v") > 0, _p(none, "n_own", "v"))), "groups")
    rated = kept.join(about, ["lang", "source"]).select("lang", "source", "term", "zero", _p("n", "n_own", "v").alias("p"), _p("total", "n_lang", "v").alias("q"))
    rated = scratch.cut(rated, "rated")

    in_group = W.partitionBy("lang", "source")
    best = in_group.orderBy(F.desc("value"), "item")
    more = rated.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f("p", "q").alias("value"))
    terms = more.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    pairs = _pairs(rated, about).withColumn("rank", F.row_number().over(best))
    return pairs.unionByName(terms)


def _pairs(rated: DataFrame, about: DataFrame) -> DataFrame:
    """The divergence of each source from each other one of its language."""
    a, b = about.select(*[F.col(c).alias(f"{c}_a") for c in about.columns]), about.select(*[F.col(c).alias(f"{c}_b") for c in about.columns])
    # A row for each pair of sources, as the result has.
    both = a.join(b, (F.col("lang_a") == F.col("lang_b")) & (F.col("source_a") != F.col("source_b")))
    half = both.where("source_a < source_b")
    base = half.select(F.col("lang_a").alias("lang"), "source_a", "source_b", F.coalesce(F.expr("v_a - t_a - t_b") * _f("zero_a", "zero_b"), F.lit(0)).alias("value"))
    # Terms of a source against a source that hasn't got them: alike for terms of one frequency.
    levels = rated.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    against = both.select("lang_a", "source_a", "source_b", "zero_b").join(levels, (F.col("lang_a") == F.col("lang")) & (F.col("source_a") == F.col("source")))
    least, most = F.least("source_a", "source_b"), F.greatest("source_a", "source_b")
    single = against.select("lang", least.alias("source_a"), most.alias("source_b"), (F.col("m") * _f("p", "zero_b")).alias("value"))
    # Terms that both have: what was put down for them is replaced.
    x, y = rated.drop("q"), rated.select(F.col("lang").alias("l"), F.col("term").alias("w"), F.col("source").alias("source_b"), F.col("p").alias("p_b"), F.col("zero").alias("zero_b"))
    met = x.join(y, (F.col("lang") == F.col("l")) & (F.col("term") == F.col("w")) & (F.col("source") < F.col("source_b")))
    shared = _f("p", "p_b") - _f("p", "zero_b") - _f("zero", "p_b") + _f("zero", "zero_b")
    shared = met.select("lang", F.col("source").alias("source_a"), "source_b", shared.alias("value"))
    sums = base.unionByName(single).unionByName(shared).groupBy("lang", "source_a", "source_b").agg(F.sum("value").alias("value"))
    ends = F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item")))
    return sums.select("lang", "value", F.explode(ends).alias("e")).select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")
