"""Benchmark decontamination with one Aho-Corasick automaton.

The benchmark's normalised items are cut into blocks of words, side by side, half as long as a window; every window
holds a whole block.  The blocks, as sequences of word numbers, are the automaton's patterns, so it grows with the
benchmark's text and not with its windows.  A text is normalised once and scanned once; a block found is extended, word
by word, to the windows around it, and places are mapped back to words and to byte offsets of the original text.
"""

from __future__ import annotations

import re
from array import array

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, hash_order, map_rows, texts

WINDOW = 13
#: Benchmark text is sent to tasks in automata of at most so many bytes of text each; one of that size takes some 200 MB.
AUTOMATON_BYTES = 8 << 20
_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_SPANS = "array<struct<start:bigint,end:bigint,byte_start:bigint,byte_end:bigint>>"


class Machine:
    """The automaton over blocks of some items; an item shorter than a window is one block, an empty one has none."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        self.width, block = width, (width + 1) // 2
        self.numbers: dict[bytes, int] = {}
        self.items: list[tuple[str, array]] = []
        places: dict[tuple[int, ...], array] = {}
        for n, (item, text) in enumerate(items):
            words = array("i", (self.numbers.setdefault(w, len(self.numbers) + 1) for w in text.translate(ALNUM).split()))
            self.items.append((item, words))
            size = len(words) if len(words) < width else block
            for p in range(0, len(words) - size + 1, block) if words else ():
                places.setdefault(tuple(words[p : p + size]), array("i")).extend((n, p))
        self.found = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for words, where in places.items():
            self.found.add_word(words, (len(words), where))
        if places:
            self.found.make_automaton()

    def find(self, words: list[bytes]) -> tuple[set[tuple[int, int]], set[str]]:
        """Runs of words that are made of occurring windows, and the items that these windows are from."""
        spans, owners, most = set(), set(), self.width
        text = tuple(self.numbers.get(w, 0) for w in words)
        if not any(text):
            return spans, owners
        for end, (size, where) in self.found.iter(text):
            first = end - size + 1
            for k in range(0, len(where), 2):
                (item, own), p, a, b = self.items[where[k]], where[k + 1], first, end + 1
                if len(own) >= most:
                    # Windows around this block reach so far at most.
                    low, high = max(0, a - p, b - most), min(len(text), a + most, a - p + len(own))
                    shift = p - first
                    while a > low and text[a - 1] == own[a - 1 + shift]:
                        a -= 1
                    while b < high and text[b] == own[b + shift]:
                        b += 1
                    if b - a < most:
                        continue
                spans.add((a, b))
                owners.add(item)
        return spans, owners


class Automaton:
    """A machine from broadcast items, built in each Python worker; a worker keeps one only."""

    _built: tuple[int, int, Machine] | None = None

    def __init__(self, items: Broadcast, width: int, number: int):
        self.items, self.width, self.number = items, width, number

    def get(self) -> Machine:
        key = (self.number, self.width)
        if Automaton._built is None or Automaton._built[:2] != key:
            Automaton._built = None
            Automaton._built = (*key, Machine(self.items.value, self.width))
        return Automaton._built[2]


def _scan(automaton: Automaton):
    def scan(batch: pa.RecordBatch) -> dict[str, object]:
        machine = automaton.get()
        columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        before, owners_before = columns["spans"].to_pylist(), columns["item_ids"].to_pylist()
        n_words, spans, owners = [], [], []
        for text, had, had_items in zip(texts(columns["text"]), before, owners_before, strict=True):
            words = text.translate(ALNUM).split()
            n_words.append(len(words))
            found, who = machine.find(words)
            if found:
                places = [m.span() for m in _WORD.finditer(text)]
                found = [{"start": a, "end": b, "byte_start": places[a][0], "byte_end": places[b - 1][1]} for a, b in sorted(found)]
            spans.append(had + [x for x in found if x not in had] if had else list(found))
            owners.append(sorted({*had_items, *who}))
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "end", "byte_start", "byte_end")]))
        return columns | {
            "n_words": pa.array(n_words, pa.int64()),
            "spans": pa.array(spans, kind),
            "item_ids": pa.array(owners, pa.list_(pa.string())),
        }

    return scan


def _scanned(docs: DataFrame, benchmark: DataFrame, keep: list[str], width: int) -> tuple[DataFrame, dict[str, str]]:
    """Results for each row beside its columns ``keep`` under new names, and the old names."""
    items = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t")).where("i is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    shards = max(1, -(-total // AUTOMATON_BYTES))
    names = {"text" if c == "text" else f"c{i}": c for i, c in enumerate(keep)}
    df = docs.select(
        *(F.col(f"`{c}`").alias(n) for n, c in names.items() if n != "text"),
        F.col("text").cast("string").alias("text"),
        F.lit(0).cast("bigint").alias("n_words"),
        F.from_json(F.lit("[]"), _SPANS).alias("spans"),
        F.array().cast("array<string>").alias("item_ids"),
    )
    for shard in range(shards):
        part = items.where(F.pmod(hash_order("i"), F.lit(shards)) == shard).collect()
        sent = docs.sparkSession.sparkContext.broadcast([(r.i, (r.t or "").encode()) for r in part])
        df = map_rows(df, _scan(Automaton(sent, width, sent._jbroadcast.id())), df.schema)
    covered = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("upto")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["upto"]))).alias("n"),
            F.greatest(a["upto"], s["end"]).alias("upto"),
        ),
    )["n"]
    df = df.withColumn("n_hit", covered)
    return df.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))), names


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """Places of benchmark windows in texts: one row per row of ``docs``.

    Returns ``doc_id``, ``text``, ``n_words``, ``n_hit`` (words inside any place of a window), ``spans`` (runs of such
    places, which may overlap, in words and in bytes of the original), ``item_ids`` (sorted as strings) and ``contaminated`` (at least a twentieth
    of the words is hit).

    Null and empty texts have no words and are clean.  Repeated rows are judged one by one, null ids kept.  Items
    without words or with a null id are passed over; equal items all count.  An empty benchmark hits nothing.  Other
    columns aren't read.

    A benchmark of ``AUTOMATON_BYTES`` of text is one automaton.  A larger one is collected in shards of about that
    size, counted first and broadcast one by one; the texts pass through the automata one after the other within the
    same task, so no worker holds more than one.
    """
    out, _ = _scanned(docs.select(F.col("doc_id").alias("doc_id"), "text"), benchmark, ["doc_id", "text"], width)
    return out.select(F.col("c0").alias("doc_id"), "text", "n_words", "n_hit", "spans", "item_ids", "contaminated")


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns.

    Null and empty texts are clean, repeated rows and null ids are judged one by one; an empty table stays empty.
    """
    out, names = _scanned(docs, benchmark, docs.columns, width)
    return out.where(~F.col("contaminated")).select(*(F.col(n).alias(c) for n, c in names.items()))


def digest(found: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )
