"""Traces of XES files, found by their local name in all splits at once.

A first scan of the splits counts start tags and keeps what stands before a split's first trace and behind its last start tag.  A
row for each split goes to the session, which tells where comments that began earlier end, how traces are numbered and
which pieces belong together.  The second scan parses the traces that stand whole in a split; the pieces of the
others, two for each split at most, are put together from what the first scan kept.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from xml.parsers import expat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir

#: Files are cut into records here: it stands before every end tag and inside no other tag.
END = "</"
_TOKEN = re.compile(r"<!--|<!\[CDATA\[|<\?|<(/?)(?:[^\s<>/:]+:)?trace(?=[\s/>]|\Z)")
_CLOSED_BY = {"<!--": "-->", "<![CDATA[": "]]>", "<?": "?>"}
_TAG_END = re.compile(r"""[^"'>]*(?:"[^"]*"[^"'>]*|'[^']*'[^"'>]*)*>""")
_ENCODING = re.compile(r"""<\?xml[^>]*encoding\s*=\s*["']([^"']+)""")
#: ``json.dumps`` with options makes an encoder for each call.
_json = json.JSONEncoder(ensure_ascii=False).encode
_KINDS = {"string", "date", "int", "float", "boolean", "id"}
UNKNOWN, OUTSIDE, INSIDE = "unknown", "outside", "inside"


class Splitter:
    """Cuts the text of a split, as it comes, into ``head``, whole traces and ``tail``.

    The head ends with the first trace's end tag, if no start tag stands before it.  ``mode`` is what ends a comment,
    CDATA section or instruction that began before this split.
    """

    def __init__(self, first: bool, mode: str = ""):
        self.mode, self.state = mode, OUTSIDE if first else UNKNOWN
        self.parts: list[str] = []
        self.starts, self.closes, self.head, self.problem = 0, False, "", ""

    def feed(self, text: str) -> Iterator[tuple[int, str]]:
        """Numbers and texts of traces that end here and began in this split."""
        at = begun = 0
        while True:
            if self.mode:
                i = text.find(self.mode, at)
                if i < 0:
                    break
                at, self.mode = i + len(self.mode), ""
            found = _TOKEN.search(text, at)
            if not found:
                break
            if found.group() in _CLOSED_BY:
                at, self.mode = found.end(), _CLOSED_BY[found.group()]
                continue
            end = _TAG_END.match(text, found.end())
            if not end:
                self.problem = self.problem or f"a tag doesn't end: {text[found.start() : found.start() + 80]}"
                break
            at = end.end()
            if found.group(1):
                piece = "".join(self.parts) + text[begun:at]
                if self.state == INSIDE:
                    yield self.starts - 1, piece
                elif self.state == UNKNOWN:
                    self.closes, self.head = True, piece
                else:
                    self.problem = self.problem or "a trace ends that didn't begin"
                self.state, self.parts = OUTSIDE, []
            else:
                if self.state == INSIDE:
                    self.problem = self.problem or "a trace begins inside another one"
                self.starts += 1
                if text[at - 2] == "/":
                    yield self.starts - 1, text[found.start() : at]
                    self.state = OUTSIDE
                else:
                    self.state, begun = INSIDE, found.start()
                self.parts = []
        if self.state != OUTSIDE:
            self.parts.append(text[begun:])

    def rest(self) -> str:
        return "".join(self.parts)


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bool, list[str]]]:
    """Texts of splits in order: file, place of the split, row of the batch at which it begins here, whether it is new."""
    now = None
    for batch in batches:
        if not batch.num_rows:
            continue
        files, blocks = np.asarray(batch.column(1)), np.asarray(batch.column(2))
        cuts = np.flatnonzero((files[1:] != files[:-1]) | (blocks[1:] != blocks[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(files)], strict=True):
            key = (int(files[a]), int(blocks[a]))
            new, now = key != now, key
            values = batch.column(0).slice(a, b - a).to_pylist()
            # A record of a later split, and every further one, stands behind the text that files are cut at.
            text = END.join(values) if new and key[1] == 0 else END + END.join(values)
            yield (*key, a, new, batch, text)


def _scan(modes: dict):
    """A row for each split: the counts that number its traces, and its pieces of traces that go beyond it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, about = None, None

        def row() -> pa.RecordBatch:
            open_ = splitter.state == INSIDE
            head = splitter.head if splitter.closes else splitter.rest() if splitter.state == UNKNOWN else ""
            values = (*about, splitter.mode, splitter.starts, splitter.closes, splitter.state, splitter.problem, head, splitter.rest() if open_ else "")
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=_SCAN_NAMES)

        for file, block, at, new, batch, text in _splits(batches):
            if new:
                if splitter:
                    yield row()
                splitter, about = Splitter(block == 0, modes.get((file, block), "")), (batch.column(3)[at].as_py(), file, block)
                if block == 0 and (said := _ENCODING.search(text[:400])) and said.group(1).lower() not in ("utf-8", "us-ascii", "ascii"):
                    splitter.problem = f"the encoding {said.group(1)} isn't read; convert the file to UTF-8"
            for _ in splitter.feed(text):
                pass
        if splitter:
            yield row()

    return scan


_SCAN = "path string, file bigint, block bigint, mode string, starts bigint, closes boolean, state string, problem string, head string, tail string"
_SCAN_NAMES = [c.split(" ")[0] for c in _SCAN.split(", ")]


def _typed(kind: str, text: str) -> object:
    """A value as what it is; what isn't a number stays a text, and so do numbers that JSON hasn't got."""
    if kind == "boolean":
        return text.strip().lower() == "true"
    try:
        if kind == "int":
            return int(text)
        if kind == "float" and math.isfinite(value := float(text)):
            return value
    except ValueError:
        pass
    return text


class _Parser:
    """Attributes of a trace and of its events, as JSON objects; of repeated keys the last one counts.

    Lists are arrays, containers objects.  Attributes of scalar attributes aren't read.
    """

    def __init__(self):
        self.attributes: dict = {}
        self.events: list[dict] = []
        self.stack: list = []

    def begin(self, name: str, attrs: dict) -> None:
        local = name.rpartition(":")[2]
        inside = self.stack[-1] if self.stack else None
        if not self.stack:
            new = self.attributes
        elif local == "event" and len(self.stack) == 1:
            self.events.append(new := {})
        elif inside is None:
            new = None
        elif local in _KINDS:
            new = None
            _put(inside, attrs.get("key"), _typed(local, attrs.get("value", "")))
        elif local in ("list", "container"):
            new = [] if local == "list" else {}
            _put(inside, attrs.get("key"), new)
        else:
            new = inside if local == "values" else None
        self.stack.append(new)

    def end(self, name: str) -> None:
        self.stack.pop()


def _put(inside, key: str | None, value: object) -> None:
    if isinstance(inside, list):
        inside.append(value)
    elif key is not None:
        inside[key] = value


def parse(text: str) -> tuple[str, list[str]]:
    """A trace's attributes and its events' ones, each as a JSON object; text that isn't well-formed is an error that shows it."""
    parser, found = expat.ParserCreate(), _Parser()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler = found.begin, found.end
    try:
        parser.Parse(text, True)
    except expat.ExpatError as e:
        raise ValueError(f"can't read a trace ({e}): {text[:200]}") from e
    return _json(found.attributes), [_json(x) for x in found.events]


_TRACE = "ordinal bigint, attributes string, events array<string>"


def _batch(ordinals: list[int], traces: list[tuple[str, list[str]]]) -> pa.RecordBatch:
    columns = [pa.array(ordinals, pa.int64()), pa.array([t[0] for t in traces], pa.string()), pa.array([t[1] for t in traces], pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(columns, names=["ordinal", "attributes", "events"])


def _whole(starts: dict):
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, first, ordinals, traces, size = None, 0, [], [], 0
        for file, block, _, new, _, text in _splits(batches):
            if new:
                first, mode = starts[file, block]
                splitter = Splitter(block == 0, mode)
            for i, piece in splitter.feed(text):
                ordinals.append(first + i)
                traces.append(parse(piece))
                size += len(piece)
                if size > 1 << 21:
                    yield _batch(ordinals, traces)
                    ordinals, traces, size = [], [], 0
        yield _batch(ordinals, traces)

    return whole


def _pieced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _batch(batch.column(0).to_pylist(), [parse(x) for x in batch.column(1).to_pylist()])


def read(spark: SparkSession, path: str) -> DataFrame:
    """``ordinal`` (a trace's number among all traces, from 0, by file and place), ``attributes`` and ``events`` as JSON objects.

    Elements are found by their local names, whatever their prefix; comments, CDATA sections and instructions hold no traces.  A
    trace without an end, an end without a start, a trace in a trace and an encoding other than UTF-8 are errors.
    Compressed files are a split each.  One row of some hundred bytes for each split comes to the session.
    """
    text = spark.read.text(path, lineSep=END)
    columns = ["value", F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    lean, named = text.select(*columns), text.select(*columns, F.col("_metadata.file_path").alias("path"))
    modes: dict = {}
    while True:
        where = f"{scratch_dir(spark)}/splits"
        named.mapInArrow(_scan(modes), _SCAN).write.parquet(where)
        scanned = spark.read.schema(_SCAN).parquet(where)
        found = scanned.select("path", "file", "block", "mode", "starts", "closes", "state", "problem", (F.col("head") != "").alias("headed")).orderBy("path", "block").collect()
        entered = {}
        for before, r in zip(found, found[1:], strict=False):
            if before.mode and before.path == r.path:
                entered[r.file, r.block] = before.mode
        # A comment that goes on beyond a split is rare: then the splits are scanned again with what is known now.
        if entered == modes:
            break
        modes = entered

    starts, pieces, ordinal, state, last = {}, [], 0, OUTSIDE, None
    for k, r in enumerate(found):
        if r.path != last and state == INSIDE:
            raise ValueError(f"{last} ends within a trace")
        state, last = (OUTSIDE if r.path != last else state), r.path
        problem = r.problem or ("a trace ends that didn't begin" if r.closes and state != INSIDE else "") or ("a trace begins inside another one" if state == INSIDE and r.starts and not r.closes else "")
        if problem:
            raise ValueError(f"{r.path}, from byte {r.block} on: {problem}")
        if state == INSIDE and r.headed:
            pieces.append((r.file, r.block, "head", ordinal - 1, 2 * k))
        starts[r.file, r.block] = (ordinal, modes.get((r.file, r.block), ""))
        ordinal += r.starts
        state = state if r.state == UNKNOWN else r.state
        if r.state == INSIDE:
            pieces.append((r.file, r.block, "tail", ordinal - 1, 2 * k + 1))
    if state == INSIDE:
        raise ValueError(f"{last} ends within a trace")

    whole = lean.mapInArrow(_whole(starts), _TRACE)
    if not pieces:
        return whole
    placed = spark.createDataFrame(pieces, "file bigint, block bigint, part string, ordinal bigint, place bigint")
    parts = scanned.select("file", "block", "head", "tail").join(placed, ["file", "block"])
    parts = parts.select("ordinal", F.struct("place", F.when(F.col("part") == "head", F.col("head")).otherwise(F.col("tail")).alias("x")).alias("p"))
    joined = parts.groupBy("ordinal").agg(F.array_join(F.array_sort(F.collect_list("p"))["x"], "").alias("x"))
    return whole.unionByName(joined.select("ordinal", "x").mapInArrow(_pieced, _TRACE))
