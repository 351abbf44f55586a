"""Token ids in binary shards, in training order.

A keyed Feistel permutation with cycle-walking, over exactly as many numbers as there are sequences, gives every
sequence its slot.  A range of slots is a shard, written as records of one fixed stride: slot s stands in shard
s // records, at (s % records) * stride.  So a reader can start or resume anywhere by arithmetic alone.

A record is: doc_id (int64, the least one for null), sequence number within the document (int32), number of tokens
(int32), ``length`` ids (little-endian, 2 or 4 bytes each, zero-filled), one newline byte.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, Scratch, bounded, small_batches

#: Fixed value: the pattern that splits text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LENGTH = 256
#: Records in a shard, but for the last one: about 9 MB.  Readers take a shard as a whole.
SHARD_RECORDS = 1 << 14
#: Tasks that write shards, at most; each writes a range of them, one after the other.
WRITERS = 20_000
KEY = 0x5EEDF00D
ROUNDS = 6
NULL_ID = -(1 << 63)


class Tokenizer:
    """Ids of a rank file's vocabulary, with an end-of-text id behind the last rank."""

    def __init__(self, ranks: bytes):
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.end = max(table.values()) + 1
        self.dtype = np.dtype("<u2" if self.end < 1 << 16 else "<u4")
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        """Ids of a whole text, without the end id."""
        return np.array(self.encoding.encode_ordinary(text), self.dtype)

    def count(self, text: str) -> int:
        """Number of ids of a whole text, without the end id."""
        return len(self.encoding.encode_ordinary(text))


_tokenizers: dict[int, Tokenizer] = {}


def tokenizer(ranks: bytes) -> Tokenizer:
    key = hash(ranks)
    if key not in _tokenizers:
        _tokenizers[key] = Tokenizer(ranks)
    return _tokenizers[key]


class Feistel:
    """A keyed permutation of 0..n-1: a balanced Feistel network over the next even power of two, walked until inside."""

    def __init__(self, n: int, key: int, rounds: int = ROUNDS):
        self.n = n
        self.half = np.uint64(max(1, ((max(n, 2) - 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = self._mix(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(key))

    @staticmethod
    def _mix(x: np.ndarray) -> np.ndarray:
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(31)

    def _once(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for k in keys:
            left, right = right, left ^ self._mix(right ^ k) & self.mask
        return right << self.half | left

    def _walk(self, x: np.ndarray, keys: np.ndarray) -> np.ndarray:
        # The halves of a result are swapped back, so the same network with the keys reversed is the inverse.
        out = self._once(np.asarray(x, np.uint64), keys)
        while (outside := out >= np.uint64(self.n)).any():
            out[outside] = self._once(out[outside], keys)
        return out.astype(np.int64)

    def slot(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, self.keys)

    def index(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, self.keys[::-1])


class Layout:
    """What a reader has to know; kept beside the shards as JSON."""

    def __init__(self, count: int, length: int, width: int, records: int, key: int):
        self.count, self.length, self.width, self.records, self.key = count, length, width, records, key
        self.stride = 16 + length * width + 1
        self.shards = -(-count // records)

    def json(self) -> str:
        return json.dumps(vars(self), sort_keys=True)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Layout:
        x = json.loads(spark.read.text(f"{path}/layout").first()[0])
        return cls(*(x[k] for k in ("count", "length", "width", "records", "key")))


def sequences(ids: int, length: int) -> int:
    """Sequences of a document: its ids and the end id, cut."""
    return ids // length + 1


class _Counter:
    """Sequences of the rows of one file, for each file that a task reads.  One row for each."""

    def __init__(self, ranks, length: int):
        self.ranks, self.length = ranks, length

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, runs = tokenizer(self.ranks.value), []
        for batch in batches:
            for file, row, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if not runs or runs[-1][0] != file:
                    runs.append([file, row, 0])
                runs[-1][2] += sequences(t.count(text or ""), self.length)
        kinds = (pa.string(), pa.int64(), pa.int64())
        columns = zip(*runs, strict=True) if runs else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "row", "n"])


class _Sequencer:
    """Sequences of documents in the order in which a task reads them: slot, shard and record."""

    def __init__(self, ranks, layout: Layout, starts):
        self.ranks, self.layout, self.starts = ranks, layout, starts

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, lay = tokenizer(self.ranks.value), self.layout
        order, at_file, at = Feistel(lay.count, lay.key), None, 0
        for whole in batches:
            for batch in bounded(whole, CHUNK_BYTES):
                index, records = [], []
                for file, row, doc, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    if file != at_file:
                        # Tasks of both passes read the same parts; a start that isn't known is an error.
                        at_file, at = file, self.starts.value[file, row]
                    ids = t.ids(text or "")
                    n = sequences(len(ids), lay.length)
                    rows = np.zeros((n, lay.length), t.dtype)
                    rows.ravel()[: len(ids)] = ids
                    rows.ravel()[len(ids)] = t.end
                    who = (NULL_ID if doc is None else doc).to_bytes(8, "little", signed=True)
                    for k in range(n):
                        used = min(lay.length, len(ids) + 1 - k * lay.length)
                        records.append(who + k.to_bytes(4, "little") + used.to_bytes(4, "little") + rows[k].tobytes())
                    index.append(np.arange(at, at + n))
                    at += n
                slots = order.slot(np.concatenate(index))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(slots), pa.array(slots // lay.records), pa.array(records, pa.binary())], names=["slot", "shard", "record"]
                )


def _placed(docs: DataFrame) -> DataFrame:
    """Rows with their file and row, which order them the same however they are split."""
    own = [F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")]
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    try:
        return docs.select(*where, *own)
    except AnalysisException:
        # Not a plain read of files; so it is written first.
        return Scratch(docs.sparkSession).cut(docs.select("doc_id", "text"), "documents").select(*where, *own)


def vocabulary(spark: SparkSession, ranks: str) -> bytes:
    """A rank file: by Spark from any store that a path with a scheme names, else from the driver's own files."""
    if "://" in ranks:
        return bytes(spark.read.format("binaryFile").load(ranks).first().content)
    with open(ranks, "rb") as f:
        return f.read()


def materialise(
    docs: DataFrame,
    path: str,
    ranks: str = RANKS,
    length: int = LENGTH,
    records: int = SHARD_RECORDS,
    key: int = KEY,
) -> Layout:
    """Write the sequences of all documents to ``path``: ``shards/shard=K`` folders with one file each, and ``layout``.

    A document is its ids and the end id, cut into sequences of ``length``; so null and empty texts have one sequence
    with the end id alone.  Null ids are kept, repeated rows give repeated sequences with slots of their own, an empty
    table gives a layout without shards.  Other columns aren't read.

    The first pass counts each row's sequences; the driver gets one number for each part of a file that a task reads.
    Sequences are numbered in the order of files and rows, and the permutation of exactly these numbers gives the
    slots.  Any run over the same files gives the same slots, however the files are split.  The second pass makes the
    records, which are dealt once, by ranges of slots.  Texts are tokenized twice, as keeping ids between the passes
    would take more disk than the shards.  Spark's own writer commits the shards, hence tasks of a lost executor are
    simply run again.
    """
    spark = docs.sparkSession
    small_batches(spark)
    content = vocabulary(spark, ranks)
    sent, rows = spark.sparkContext.broadcast(content), _placed(docs)
    runs = rows.mapInArrow(_Counter(sent, length), "file string, row bigint, n bigint").collect()
    starts, total = {}, 0
    for run in sorted(runs):
        starts[run.file, run.row] = total
        total += run.n
    layout = Layout(total, length, tokenizer(content).dtype.itemsize, records, key)
    spark.createDataFrame([(layout.json(),)], "value string").coalesce(1).write.text(f"{path}/layout")
    if not total:
        return layout
    # As many entries as there are tasks that read files, no more than the driver's own list of these parts.
    sequencer = _Sequencer(sent, layout, spark.sparkContext.broadcast(starts))
    made = rows.mapInArrow(sequencer, "slot bigint, shard bigint, record binary")
    writers = min(layout.shards, WRITERS)
    ranged = made.repartitionById(writers, F.floor(F.col("shard") * writers / layout.shards).cast("int"))
    placed = ranged.sortWithinPartitions("shard", "slot").select(F.col("record").cast("string").alias("value"), "shard")
    placed.write.partitionBy("shard").text(f"{path}/shards")
    return layout


def _reader(layout: Layout):
    ids = np.dtype("<u2" if layout.width == 2 else "<u4")
    record = np.dtype([("doc_id", "<i8"), ("seq_no", "<i4"), ("n_tokens", "<i4"), ("ids", ids, (layout.length,)), ("end", "u1")])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = np.frombuffer(content, record)
                for i in range(0, len(found), 8192):
                    part = found[i : i + 8192]
                    at = np.arange(i, i + len(part), dtype=np.int64)
                    used = np.arange(layout.length)[None, :] < part["n_tokens"][:, None]
                    ends = np.concatenate([[0], np.cumsum(part["n_tokens"])]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(part["ids"][used].astype(np.int32)))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(at + shard * layout.records), pa.array(np.full(len(part), shard, np.int64)), pa.array(at * layout.stride),
                            pa.array(part["doc_id"], mask=part["doc_id"] == NULL_ID), pa.array(part["seq_no"].copy()),
                            pa.array(part["n_tokens"].copy()), lists,
                        ],
                        names=_COLUMNS,
                    )

    return rows


_COLUMNS = ["slot", "shard", "offset", "doc_id", "seq_no", "n_tokens", "ids"]
_SCHEMA = "slot bigint, shard bigint, offset bigint, doc_id bigint, seq_no int, n_tokens int, ids array<int>"


def read_shards(spark: SparkSession, path: str, from_slot: int = 0) -> DataFrame:
    """Records of the shards from ``from_slot`` on: where they stand, whose they are, and their ids.

    Null ids come back as null, empty texts as a sequence of the end id.  A layout without shards, and slots behind
    the last one, give no rows.
    """
    small_batches(spark)
    layout = Layout.load(spark, path)
    if from_slot >= layout.count:
        return spark.createDataFrame([], _SCHEMA)
    files = spark.read.format("binaryFile").load(f"{path}/shards").where(F.col("shard") >= from_slot // layout.records)
    out = files.select(F.col("shard").cast("bigint"), "content").mapInArrow(_reader(layout), _SCHEMA)
    return out.where(F.col("slot") >= from_slot)


def digest(records: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    return records.select(
        "slot", "shard", "offset", "doc_id", "seq_no", "n_tokens", F.xxhash64("ids").alias("ids_xxhash64")
    )
