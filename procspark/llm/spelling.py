"""Spelling variants by a symmetric-delete join.

Each word emits a hash of itself and of all its single deletions, made from running sums, so a word costs as many small
rows as it has letters, however long it is.  Words that share a deletion at one place differ in one letter there; a
word that equals a deletion of another lacks one letter of it.  Pairs that meet are verified on the words themselves.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, Scratch, bounded, map_rows, small_batches

#: Letters of a word, as bytes of Latin-1, upper ASCII ones become lower ones; one in so many loses a letter.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
DELETES = 199
#: Words have so many letters and stand so often in the corpus; a form stands so many times as often as its word.
LEAST_LETTERS = 6
LEAST_COUNT = 5
RATIO = 5
#: A task sends on its counts when it has so many words, or bytes of them.
MOST_WORDS, MOST_BYTES = 200_000, 16 << 20
#: Base of the rolling sums, its inverse modulo 2**64, and odd constants that mix length and sum.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX, BY_LENGTH = 0xD6E8FEB86659FD93, 0xA24BAED4963EE407


def _utf8(run: bytes) -> bytes:
    return run if run.isascii() else run.decode("latin-1").encode()


def words_of(doc_id: str, text: str, least_letters: int = LEAST_LETTERS) -> Counter:
    """Words of a text with their counts, as bytes of Latin-1; some runs have lost a letter, by a hash of document and run."""
    begun, out = zlib.crc32(f"{doc_id}:".encode()), Counter()
    # Letters outside Latin-1 are no letters of a word: they become question marks and then spaces.
    for run, n in Counter(text.encode("latin-1", "replace").translate(LETTERS).split(b" ")).items():
        if len(run) < least_letters:
            continue
        h = zlib.crc32(_utf8(run), begun)
        if h % DELETES == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < least_letters:
                continue
        out[run] += n
    return out


def _counts(least_letters: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        size = 0

        def out() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in counts], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for whole in batches:
            for batch in bounded(whole, CHUNK_BYTES):
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    found = words_of(doc, text, least_letters)
                    counts.update(found)
                    size += sum(map(len, found))
                    if len(counts) >= MOST_WORDS or size >= MOST_BYTES:
                        yield from bounded(out(), CHUNK_BYTES)
                        counts, size = Counter(), 0
        if counts:
            yield from bounded(out(), CHUNK_BYTES)

    return count


def vocabulary(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word`` and ``n`` of all words of at least so many letters and occurrences.

    Null texts have no words; a null id counts as an empty text in the hash that deletes letters.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counts = rows.mapInArrow(_counts(least_letters), "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def delete_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of words and of their single deletions: key, place of the deletion (-1: none), whether it is the first that gives
    this key, and the word's number."""
    lengths = np.array([len(w) for w in words], np.int64)
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    starts = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(len(letters)) - starts[owner]
    powers = np.ones(max(1, int(lengths.max(initial=0))), np.uint64)
    powers[1:] = np.cumprod(np.full(len(powers) - 1, BASE, np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(letters * powers[at])])
    begin, end = sums[starts], sums[starts + lengths]
    here = np.arange(len(letters))
    # What stands behind the deleted letter moves one place forward.
    deleted = (sums[here] - begin[owner]) + (end[owner] - sums[here + 1]) * np.uint64(INVERSE)
    before = np.concatenate([np.zeros(1, np.uint64), letters[:-1]]) if len(letters) else letters
    first = (at == 0) | (letters != before)

    def mixed(h: np.ndarray, length: np.ndarray) -> np.ndarray:
        h = (h + length.astype(np.uint64) * np.uint64(BY_LENGTH)) * np.uint64(MIX)
        return (h ^ h >> np.uint64(32)).view(np.int64)

    keys = np.concatenate([mixed(end - begin, lengths), mixed(deleted, lengths[owner] - 1)])
    places = np.concatenate([np.full(len(words), -1), at]).astype(np.int32)
    return keys, places, np.concatenate([np.zeros(len(words), bool), first]), np.concatenate([np.arange(len(words)), owner])


def _keys(batch: pa.RecordBatch) -> dict[str, object]:
    keys, at, first, owner = delete_keys(batch.column(1).to_pylist())
    return {"key": keys, "at": at, "first": first, "id": np.asarray(batch.column(0))[owner]}


def near_words(words: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of the ids of words ``(id, word, n)`` that differ by exactly one letter, each once."""
    keys = map_rows(words.select("id", "word"), _keys, "key bigint, at int, first boolean, id bigint", 1 << 18)
    x, y = keys.select(*[F.col(c).alias(f"{c}_a") for c in keys.columns]), keys.select(*[F.col(c).alias(f"{c}_b") for c in keys.columns])
    replaced = (F.col("at_a") == F.col("at_b")) & (F.col("at_a") >= 0) & (F.col("id_a") < F.col("id_b"))
    lacking = (F.col("at_a") == -1) & F.col("first_b")
    met = x.join(y, (F.col("key_a") == F.col("key_b")) & (replaced | lacking)).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    named = met.join(words.select(F.col("id").alias("a"), F.col("word").alias("word_a")), "a").join(words.select(F.col("id").alias("b"), F.col("word").alias("word_b")), "b")
    return named.where(F.levenshtein("word_a", "word_b", 1) == 1).select("a", "b")


def roots(links: DataFrame, scratch: Scratch) -> DataFrame:
    """``(id, root)`` for each row of ``links(id, form)``: the end of the chain of forms, by pointer jumping.

    Each round doubles the steps taken and is written; one number of a round comes to the driver.
    """
    now = scratch.cut(links.select("id", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("id").alias("root"), F.col("root").alias("beyond"))
        step = now.join(onward, "root", "left").select("id", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved"))
        step = scratch.cut(step, "roots")
        scratch.drop(now)
        now = step
        if not now.where("moved").limit(1).count():
            return now.select("id", "root")


def spelling_variants(
    docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, ratio: int = RATIO
) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root`` for each word of the corpus.

    A word's form is the most frequent word at distance one, of equal ones the least, if it is ``ratio`` times as
    frequent; its root is the end of the chain of forms, or itself.  Null and empty texts have no words, repeated rows
    count again each, other columns aren't read, and an empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    # The numbers stand in a written table, so they don't change if a task runs again.
    words = scratch.cut(vocabulary(docs, least_letters, least_count).withColumn("id", F.monotonically_increasing_id()), "words")
    pairs = near_words(words)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = words.select(F.col("id").alias("b"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    best = F.min(F.struct((-F.col("form_n")).alias("order"), F.col("form"), F.col("b"))).alias("best")
    near = both.join(other, "b").groupBy(F.col("a").alias("id")).agg(F.count("*").alias("n_near"), best)
    joined = words.join(near, "id", "left").withColumn("form_n", -F.col("best.order"))
    fits = F.col("form_n") >= ratio * F.col("n")
    judged = joined.select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(fits, F.col("best.form")).alias("form"),
        F.when(fits, F.col("form_n")).alias("form_n"), F.when(fits, F.col("best.b")).alias("form_id"),
    )
    judged = scratch.cut(judged, "judged")
    ends = roots(judged.where("form_id is not null").select("id", F.col("form_id").alias("form")), scratch)
    ends = ends.join(words.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root").select("id", "root_word")
    return judged.join(ends, "id", "left").select("word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
