"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every text.  Expectation-maximisation over the counts of vote
patterns estimates how often each labeller votes what for good and for bad texts, and hence each pattern's posterior.
The posteriors of a bounded sample train a linear scorer over hashed words and shape marks, which scores every text.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, Memo, hash_order, map_rows, texts
from .toxicity import Rows

BUCKETS = 1 << 16
#: The scorer is fitted on so many texts at most, drawn by hash.
TRAIN_ROWS = 12_000
EM_STEPS = 100
STEPS, RATE, L2 = 120, 0.05, 1e-4
_UPPER = bytes(range(65, 91))
_MARKS = b"!?#*$%^~|<>{}[]\\@_="
_DIGITS = b"0123456789"


def shape(text: bytes) -> dict[str, float]:
    """Plain measures of a text."""
    words = text.translate(ALNUM).split()
    n, size = len(words), max(1, len(text))
    distinct = set(words)
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = len(text) - len(text.translate(None, bytes(range(65, 91)) + bytes(range(97, 123))))
    return {
        "words": n,
        "distinct": len(distinct) / max(1, n) ** 0.75,
        "repeats": repeats / max(1, n - 1),
        "upper": (len(text) - len(text.translate(None, _UPPER))) / max(1, letters),
        "marks": (len(text) - len(text.translate(None, _MARKS))) / size,
        "digits": (len(text) - len(text.translate(None, _DIGITS))) / size,
        "lines": len(set(lines)) / max(1, len(lines)),
        "stops": (text.count(b". ") + text.count(b", ") + text.count(b".\n") + text.endswith(b".")) / max(1, n),
        "length": sum(map(len, distinct)) / max(1, len(distinct)),
    }


def _between(low: float, high: float) -> Callable[[float], int]:
    return lambda x: 1 if x >= high else -1 if x <= low else 0


def _outside(high: float, low: float) -> Callable[[float], int]:
    return lambda x: -1 if x >= high else 1 if x <= low else 0


#: The labellers: a measure, and what its value votes (1 good, -1 bad, 0 nothing).
LABELLERS: tuple[tuple[str, Callable[[float], int]], ...] = (
    ("words", _between(12, 60)),
    ("distinct", _between(0.7, 1.4)),
    ("repeats", _outside(0.2, 0.05)),
    ("upper", _outside(0.5, 0.2)),
    ("marks", _outside(0.05, 0.01)),
    ("digits", _outside(0.2, 0.05)),
    ("lines", _between(0.5, 0.8)),
    ("stops", _between(0.01, 0.04)),
)


def votes(measures: dict[str, float]) -> str:
    """One character for each labeller: ``+`` good, ``-`` bad, ``.`` nothing."""
    return "".join(".+-"[rule(measures[name])] for name, rule in LABELLERS)


def _vote(batch: pa.RecordBatch) -> dict[str, object]:
    return {"votes": pa.array([votes(shape(t)) for t in texts(batch.column(0))], pa.string())}


def estimate(patterns: dict[str, int], steps: int = EM_STEPS) -> tuple[dict[str, float], np.ndarray, float]:
    """Posterior of good for each pattern, each labeller's vote shares by class, and the share of good texts.

    Starts from the majority of votes.  A pattern without votes keeps the overall share.  Labellers that overlap vote
    together; so each vote counts with a power that falls with its mean agreement with the others beyond chance.
    """
    if not patterns:
        return {}, np.zeros((2, len(LABELLERS), 3)), 0.5
    names = sorted(patterns)
    n = np.array([patterns[p] for p in names], float)
    v = np.array([[".+-".index(c) for c in p] for p in names])
    k = v.shape[1]
    hot = np.stack([(v == c).astype(float) for c in range(3)], axis=2)
    sign = np.where(v == 1, 1.0, np.where(v == 2, -1.0, 0.0))
    mean = (n @ sign) / n.sum()
    centred = sign - mean
    cov = (centred * n[:, None]).T @ centred / n.sum()
    spread = np.sqrt(np.clip(np.diag(cov), 1e-12, None))
    alike = np.clip(np.abs(cov / np.outer(spread, spread)) - np.eye(k), 0, 1)
    power = 1 / (1 + alike.mean(axis=1))
    good = np.clip(0.5 + sign.sum(axis=1) / (2 * k), 0.02, 0.98)
    for _ in range(steps):
        share = float((n * good).sum() / n.sum())
        by = np.stack([((n * w) @ hot.reshape(len(n), -1)).reshape(k, 3) + 0.5 for w in (1 - good, good)])
        by /= by.sum(axis=2, keepdims=True)
        logs = np.log(by[1] / by[0])
        # Not voting says nothing.
        logs[:, 0] = 0
        z = np.log(share / (1 - share)) + (np.take_along_axis(logs[None], v[:, :, None], 2)[:, :, 0] * power).sum(axis=1)
        after = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        after = np.clip(after, 1e-6, 1 - 1e-6)
        if np.abs(after - good).max() < 1e-9:
            break
        good = after
    return dict(zip(names, good.tolist(), strict=True)), by, share


def bucket(word: bytes) -> int:
    return zlib.crc32(word) & (BUCKETS - 1)


def features(text: bytes, measures: dict[str, float], memo: Memo) -> list[int]:
    """Buckets of distinct words and of marks for each measure's rounded value."""
    marks = [f"={name}{min(12, int(4 * np.log1p(8 * value)))}".encode() for name, value in measures.items()]
    return sorted({memo[w] for w in set(text.translate(ALNUM).split())} | {bucket(m) for m in marks})


def _train_rows(batch: pa.RecordBatch) -> dict[str, object]:
    memo = Memo(bucket)
    blobs = texts(batch.column(0))
    measured = [shape(t) for t in blobs]
    return {
        "votes": pa.array([votes(m) for m in measured], pa.string()),
        "x": pa.array([features(t, m, memo) for t, m in zip(blobs, measured, strict=True)], pa.list_(pa.int32())),
        "h": batch.column(1),
    }


def fit(x: Rows, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on posterior labels; each text's features share its unit length."""
    w, b = np.zeros(BUCKETS), 0.0
    if not x.n:
        return w.astype(np.float32), b
    value = 1 / np.sqrt(np.maximum(np.bincount(x.rows, minlength=x.n), 1))
    m, v, mb, vb = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0
    for t in range(1, STEPS + 1):
        d = (1 / (1 + np.exp(-np.clip(x.sums(w) * value + b, -30, 30))) - y) / x.n
        g, gb = x.back(d * value, BUCKETS) + L2 * w, float(d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix = np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w -= RATE * fix * m / (np.sqrt(v) + 1e-8)
        b -= RATE * fix * mb / (np.sqrt(vb) + 1e-8)
    return w.astype(np.float32), float(b)


def _scorer(posterior: dict[str, float], w: np.ndarray, b: float):
    memos: list[Memo] = []

    def score(batch: pa.RecordBatch) -> dict[str, object]:
        memo = memos[0] if memos else memos.append(Memo(bucket)) or memos[0]
        seen, weak, out = [], [], []
        for text in texts(batch.column(1)):
            measures = shape(text)
            v, x = votes(measures), features(text, measures, memo)
            z = float(w[x].sum()) / max(1, len(x)) ** 0.5 + b
            seen.append(v)
            weak.append(posterior.get(v, 0.5))
            out.append(float(1 / (1 + np.exp(-max(-30.0, min(30.0, z))))))
        return {"doc_id": batch.column(0), "votes": pa.array(seen, pa.string()), "posterior": pa.array(weak), "score": pa.array(out)}

    return score


def classify(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Quality of every whole text: ``doc_id``, ``votes``, ``posterior``, ``score`` and ``keep`` (score 0.5 or more).

    No labels are read.  Vote patterns are counted over all rows; there are 3^8 at most, which bounds what comes to
    the driver beside ``train_rows`` feature rows.  Null and empty texts are scored as texts without words.  Null ids
    and repeated rows are scored as they are; an empty table gives no rows.  Other columns aren't read.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = map_rows(rows.select("text"), _vote, "votes string").groupBy("votes").count().collect()
    posterior, _, _ = estimate({r.votes: r["count"] for r in counts})
    total = max(1, sum(r["count"] for r in counts))
    # Hashes below a bound pick about half as many rows again as are wanted; the limit then picks exactly.
    share = min(1.0, 1.5 * train_rows / total)
    h = hash_order("doc_id", F.xxhash64("text"))
    near = rows.select("text", h.alias("h"))
    near = near.where(F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    drawn = map_rows(near, _train_rows, "votes string, x array<int>, h bigint").orderBy("h").limit(train_rows).toArrow()
    y = np.array([posterior.get(v, 0.5) for v in drawn.column("votes").to_pylist()])
    w, b = fit(Rows.from_arrow(drawn.column("x")), y)
    out = map_rows(rows, _scorer(posterior, w, b), "doc_id bigint, votes string, posterior double, score double")
    return out.withColumn("keep", F.col("score") >= 0.5)
