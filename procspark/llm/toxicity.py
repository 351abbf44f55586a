"""Toxicity: a counterfactually regularised linear classifier over hashed words and their beginnings.

Labelled texts that name a group are copied with the group's name swapped for others; the fit penalises every change
that a swap makes to the score, so that the weights of group names can't stand for toxicity.

Features are screened by grouped counts before the fit.  Scores of rows that a fit hasn't seen (cross-fitting over
folds of the training rows) choose the cut, which is then moved to one half.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM, Memo, Scratch, hash_order, map_rows, texts

#: Names of groups; those of one line are swapped for each other.
IDENTITY = (
    "women men girls boys",
    "woman man girl boy",
    "female male nonbinary transgender",
    "gay straight lesbian bisexual queer heterosexual",
    "muslim christian jewish hindu buddhist atheist catholic protestant",
    "muslims christians jews hindus buddhists atheists catholics protestants",
    "black white asian latino hispanic african european arab",
    "immigrant refugee native foreigner",
    "immigrants refugees natives foreigners",
    "old young elderly teenage",
    "deaf blind disabled autistic",
    "frauen männer mädchen jungen",
    "mujeres hombres chicas chicos",
    "femmes hommes filles garçons",
    "muslime christen juden",
    "musulmanes cristianos judíos",
    "musulmans chrétiens juifs",
)
#: Buckets of hashed features.
BUCKETS = 1 << 24
#: Bytes of the word beginnings that are features beside the word; they hold across inflections and compounds.
PREFIXES = (4, 5, 6, 7)
#: The fit takes so many labelled texts at most, in a repeatable pseudo-random order of their ids.
TRAIN_ROWS = 16_000
#: Swapped copies of a labelled text, at most.
SWAPS = 4
#: The fit keeps so many features, those whose shares of toxic texts are the farthest from the overall share.
KEEP = 2048
#: Features of fewer texts aren't kept.
LEAST_TEXTS = 3
STEPS = 150
RATE = 0.06
L2 = 1e-3
#: Weight of the mean square of score changes under swaps.
FAIR = 5.0
#: Fixed value: the contract's folds; fold 0 is held out, the others are left out in turn for the cut.
FOLDS = 5
#: The cut lies where the share of toxic texts caught, less so many times that of clean ones, is greatest.
CLEAN_WEIGHT = 2.0
#: With fewer texts of a class, the cut stays where the fit has it.
LEAST_CLASS = 20


def bucket(word: bytes) -> int:
    return zlib.crc32(word) & (BUCKETS - 1)


def parts(word: bytes) -> tuple[int, ...]:
    """Buckets of a word and of its beginnings."""
    return (bucket(word), *(bucket(b"^" + word[:n]) for n in PREFIXES if len(word) > n))


_groups: dict[bytes, list[bytes]] = {}
for _line in IDENTITY:
    for _term in (_names := [x.encode() for x in _line.split()]):
        _groups[_term] = [x for x in _names if x != _term]


def features(text: bytes, memo: Memo) -> list[int]:
    """Distinct buckets of the text's words and their beginnings."""
    return sorted(set().union(*(memo[w] for w in set(text.translate(ALNUM).split()))))


def swapped(text: bytes) -> list[list[bytes]]:
    """The text's words with its group names swapped, ``SWAPS`` times at most; none if it names no group."""
    words = text.translate(ALNUM).split()
    if not any(w in _groups for w in words):
        return []
    return [[g[k % len(g)] if (g := _groups.get(w)) else w for w in words] for k in range(SWAPS)]


def _train_rows(batch: pa.RecordBatch) -> dict[str, object]:
    memo = Memo(parts)
    x, copies = [], []
    for text in texts(batch.column(1)):
        x.append(features(text, memo))
        copies.append([features(b" ".join(w), memo) for w in swapped(text)])
    ints = pa.list_(pa.int32())
    return {"doc_id": batch.column(0), "label": batch.column(2), "x": pa.array(x, ints), "copies": pa.array(copies, pa.list_(ints))}


class Linear:
    """Weights of features, numbered from 0, and a bias; ``buckets`` holds the features' buckets where they are hashed."""

    def __init__(self, weights: np.ndarray, bias: float, buckets: np.ndarray | None = None):
        self.weights, self.bias, self.buckets = weights, bias, buckets

    def known(self) -> dict[int, float]:
        """Weights by bucket."""
        return dict(zip(self.buckets.tolist(), self.weights.tolist(), strict=True))

    def score(self, x: list[int]) -> float:
        return probability(float(self.weights[x].sum()) + self.bias)


def probability(z: float) -> float:
    return float(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))


class Rows:
    """Feature rows as flat arrays: features, the row of each, and the number of rows."""

    def __init__(self, cols: np.ndarray, sizes: np.ndarray):
        self.cols, self.rows, self.n = cols.astype(np.int64), np.repeat(np.arange(len(sizes)), sizes), len(sizes)

    @classmethod
    def of(cls, lists: list[list[int]]) -> Rows:
        sizes = np.array([len(r) for r in lists], np.int64)
        return cls(np.array([c for r in lists for c in r], np.int64), sizes)

    @classmethod
    def from_arrow(cls, column: pa.ChunkedArray) -> Rows:
        """A column of lists, without a Python object for each number."""
        flat = column.combine_chunks()
        flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
        return cls(np.asarray(flat.flatten()), np.diff(np.asarray(flat.offsets)))

    def only(self, rows: np.ndarray, buckets: np.ndarray) -> Rows:
        """The rows of a mask, with features that are in the sorted ``buckets``, numbered by them."""
        at = np.minimum(np.searchsorted(buckets, self.cols), max(0, len(buckets) - 1))
        there = rows[self.rows] & (buckets[at] == self.cols if len(buckets) else False)
        out = Rows(np.zeros(0), np.zeros(0, np.int64))
        out.cols, out.rows, out.n = at[there], (np.cumsum(rows) - 1)[self.rows[there]], int(rows.sum())
        return out

    def sums(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, weights[self.cols], self.n)

    def back(self, each: np.ndarray, buckets: int) -> np.ndarray:
        return np.bincount(self.cols, each[self.rows], buckets)


def fit(x: Rows, y: np.ndarray, left: Rows, right: Rows, buckets: int, fair: float = FAIR) -> Linear:
    """Full-batch Adam on logistic loss, an L2 term and the mean squared score change over swapped pairs.

    ``left`` and ``right`` are texts before and after a swap, pair by pair.  A text of the rarer class counts for the
    root of the classes' ratio.  Without rows, or with one class only, the weights are zero and the bias is that of
    the class shares.
    """
    y = np.asarray(y, float)
    counts = np.where(y > 0, np.sqrt((len(y) - y.sum()) / max(1.0, y.sum())) or 1.0, 1.0)
    share = ((counts * y).sum() + 1) / (counts.sum() + 2)
    bias, w = float(np.log(share / (1 - share))), np.zeros(buckets)
    if len(y) == 0 or y.min() == y.max():
        return Linear(w, bias)
    counts /= counts.sum()
    m, v, mb, vb = np.zeros(buckets), np.zeros(buckets), 0.0, 0.0
    for t in range(1, STEPS + 1):
        d = counts * (1 / (1 + np.exp(-np.clip(x.sums(w) + bias, -30, 30))) - y)
        g, gb = x.back(d, buckets) + L2 * w, float(d.sum())
        if left.n:
            gap = (left.sums(w) - right.sums(w)) * (2 * fair / left.n)
            g += left.back(gap, buckets) - right.back(gap, buckets)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix = np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w -= RATE * fix * m / (np.sqrt(v) + 1e-8)
        bias -= RATE * fix * mb / (np.sqrt(vb) + 1e-8)
    return Linear(w, float(bias))


def fold():
    """The fold of a row by its id; null ids are in fold 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS, F.lit(0))


def held_out():
    """Whether a row's label must not be learned from; rows without an id are held out."""
    return fold() == 0


def screened(rows: DataFrame, without: int, keep: int = KEEP) -> list[int]:
    """The ``keep`` buckets that tell most, sorted, by counts of rows outside a fold; ``rows`` has bucket, n0.., p0.. by fold.

    The row of the bucket -1 holds the counts of texts.
    """
    n, p = (sum((F.col(f"{c}{f}") for f in range(1, FOLDS) if f != without), F.lit(0)) for c in "np")
    counted = rows.select("bucket", n.alias("n"), p.alias("p"))
    total = counted.where("bucket = -1").first()
    if total is None or not 0 < total.p < total.n:
        return []
    share = total.p / total.n
    spread = F.sqrt(F.col("n") * share * (1 - share) * (1 - F.col("n") / total.n) + 1)
    # Rounded, so that the order of a sum doesn't decide ties.
    far = F.round(F.abs(F.col("p") - F.col("n") * share) / spread, 9)
    told = counted.where(f"bucket >= 0 and n >= {LEAST_TEXTS}").select("bucket", far.alias("far"))
    return sorted(r.bucket for r in told.orderBy(F.desc("far"), "bucket").limit(keep).collect())


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap below the score from which on predictions are best; see ``CLEAN_WEIGHT``."""
    order = np.argsort(-z, kind="stable")
    s, toxic = z[order], y[order] > 0
    gain = np.cumsum(toxic) / max(1, toxic.sum()) - CLEAN_WEIGHT * np.cumsum(~toxic) / max(1, (~toxic).sum())
    gain[:-1][s[:-1] == s[1:]] = -np.inf
    at = int(np.argmax(gain))
    return float((s[at] + s[at + 1]) / 2) if at + 1 < len(s) else float(s[at])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS, fair: float = FAIR) -> Linear:
    """Fit on labelled rows that aren't held out.

    Null labels and ids are passed over; of several labels of an id the largest counts, of several texts of an id
    one chosen by hash.  At most ``rows`` ids are drawn.  Their features are counted by class and fold; the driver gets
    the features that were kept, ``KEEP`` for each fold left out and for all, and the drawn rows with these features.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).where(~held_out())
    drawn = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(hash_order("doc_id"), "doc_id").limit(rows)
    # The drawn ids are at most `rows`, so sending them to all tasks is bounded.
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = text.join(F.broadcast(drawn), "doc_id").select("doc_id", "text", "label")
    seen = map_rows(found, _train_rows, "doc_id bigint, label int, x array<int>, copies array<array<int>>")
    one = seen.groupBy("doc_id").agg(F.min_by(F.struct("label", "x", "copies"), F.xxhash64("x")).alias("r")).select("doc_id", "r.*")
    scratch = Scratch(docs.sparkSession)
    one = scratch.cut(one.withColumn("fold", fold().cast("int")), "training")

    each = one.select(F.explode(F.concat(F.array(F.lit(-1)), "x")).alias("bucket"), (F.col("label") > 0).cast("int").alias("p"), "fold")
    sums = [F.sum(F.when(F.col("fold") == f, v)).alias(f"{c}{f}") for f in range(1, FOLDS) for c, v in (("n", F.lit(1)), ("p", F.col("p")))]
    counts = scratch.cut(each.groupBy("bucket").agg(*sums).na.fill(0), "counts")
    kept = {f: screened(counts, f) for f in range(FOLDS)}
    union = np.unique([b for bs in kept.values() for b in bs]).astype(np.int64)

    def slim(batch: pa.RecordBatch) -> dict[str, object]:
        cut = lambda xs: [b for b in xs if b in chosen]
        chosen, ints = set(union.tolist()), pa.list_(pa.int32())
        x = [cut(r) for r in batch.column(3).to_pylist()]
        copies = [[cut(c) for c in r] for r in batch.column(4).to_pylist()]
        own = {n: batch.column(i) for i, n in enumerate(("doc_id", "label", "fold"))}
        return own | {"x": pa.array(x, ints), "copies": pa.array(copies, pa.list_(ints))}

    narrow = map_rows(one.select("doc_id", "label", "fold", "x", "copies"), slim, "doc_id bigint, label int, fold int, x array<int>, copies array<array<int>>")
    got = narrow.toArrow().sort_by("doc_id")
    scratch.drop(one, counts)
    x, y, of = Rows.from_arrow(got.column("x")), got.column("label").to_numpy() > 0, got.column("fold").to_numpy()
    copies = got.column("copies").to_pylist()
    pairs = [(i, c) for i, cs in enumerate(copies) for c in cs]
    owner = np.array([i for i, _ in pairs], np.int64)
    plain = got.column("x").take(pa.array(owner)) if pairs else got.column("x").slice(0, 0)
    left, right = Rows.of(plain.to_pylist()), Rows.of([c for _, c in pairs])

    def fitted(rows_in: np.ndarray, names: np.ndarray) -> Linear:
        pairs_in = rows_in[owner]
        out = fit(x.only(rows_in, names), y[rows_in], left.only(pairs_in, names), right.only(pairs_in, names), len(names), fair)
        return Linear(out.weights, out.bias, names)

    model = fitted(np.ones(x.n, bool), np.array(kept[0], np.int64))
    if min(y.sum(), (~y).sum()) >= LEAST_CLASS:
        unseen = np.zeros(x.n)
        for f in range(1, FOLDS):
            names = np.array(kept[f], np.int64)
            part = fitted(of != f, names)
            unseen[of == f] = x.only(of == f, names).sums(part.weights) + part.bias
        model.bias -= best_cut(unseen, y)
    return model


def _scorer(model: Linear, text_at: int):
    known, memos = model.known(), []

    def of(word: bytes) -> tuple[int, ...]:
        return tuple(b for b in parts(word) if b in known)

    def score(batch: pa.RecordBatch) -> dict[str, object]:
        memo = memos[0] if memos else memos.append(Memo(of)) or memos[0]
        scores = [probability(sum(known[b] for b in features(t, memo)) + model.bias) for t in texts(batch.column(text_at))]
        return {n: batch.column(i) for i, n in enumerate(batch.schema.names)} | {"score": pa.array(scores, pa.float64())}

    return score


def score(docs: DataFrame, model: Linear) -> tuple[DataFrame, dict[str, str]]:
    """Every row of ``docs`` with ``score``, the probability of label 1 for its whole text.

    Columns of ``docs`` have new names, so that none clashes with the result; the second value maps them to the old
    ones.  Null and empty texts get the score of a text without words.  Only the text is looked at.
    """
    names = {f"c{i}": c for i, c in enumerate(docs.columns)}
    text = next(n for n, c in names.items() if c == "text")
    df = docs.toDF(*names).withColumn(text, F.col(text).cast("string"))
    schema = T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType())])
    return map_rows(df, _scorer(model, [*names].index(text)), schema), names


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score is below one half, with all their columns.

    Null and empty texts are scored as texts without words; null ids and repeated rows are judged one by one.  Without
    usable labels of both classes nothing is known to be toxic, so every row stays.  An empty table stays empty.
    """
    model = train(docs, labels)
    if not model.weights.any():
        return docs
    scored, names = score(docs, model)
    return scored.where(F.col("score") < 0.5).drop("score").toDF(*names.values())


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` for each row of ``docs``.

    Null and empty texts get the score of a text without words.  Empty ``labels`` give every row the score 0.5 and so
    the prediction 1 - see ``fit`` - and an empty table gives no rows.  Repeated rows are scored one by one.
    """
    model = train(docs, labels)
    out, _ = score(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), model)
    out = out.select(F.col("c0").alias("doc_id"), "score")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
