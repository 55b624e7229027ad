"""Quality classifier: naive-Bayes support vectors.

A text's features are indicators of its byte trigrams, of its words and word pairs, and of
the number of pairs of a word with itself, hashed to 2**18 places.  Each is scaled by its class
log-count ratio (naive Bayes, from all labelled training rows), rows are scaled to length one, and
a linear hinge-loss model is fitted by dual coordinate descent on a bounded sample (``SAMPLE_ROWS``,
by hash of doc_id, and of each class at least about ``CLASS_ROWS``, or all it has).  A logistic
curve fitted on a fifth of the sample, its rows weighed back to the classes' shares of all labelled
rows, turns margins into scores.

Only the text is read for a score.  Results for odd input: a null text is an empty one and
has a score too (that of no features); a null doc_id is scored, is never held out and has no
label; a null label is no label and repeated labels count as their largest; without labels
of both classes every score is the share of label 1 (0.5 if there is none); repeated rows
are scored each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gymlake.llm.common import bounded_batches, sized, stored, tidied
from gymlake.llm.words import mix, slices, text_bytes, word_hashes

BITS = 18
PLACES = 1 << BITS
SAMPLE_ROWS = 5_000  # labelled rows that the hinge-loss model is fitted on, about
CLASS_ROWS = 1_000  # of them at least about so many of each class, however rare it is
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 8
KEEP_SCORE = 0.7
# Places of the pairs of one word with itself: at least 1, 2, 4, ... of them.
AGAIN = range(PLACES - 12, PLACES)
_PARTS = 64  # rows that the counts of one task are cut into


# ---- features ---------------------------------------------------------------------------

def features(data: np.ndarray, offs: np.ndarray) -> Iterator[np.ndarray]:
    """Per text, the sorted distinct feature numbers."""
    shift = np.uint64(64 - BITS)
    for i, j in slices(offs):
        part, o = data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        b = part.astype(np.uint32)
        three = ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)
                 if len(b) > 2 else np.zeros(0, np.uint32))
        hashes, first = word_hashes(part, o)
        one = (hashes >> shift).astype(np.uint32)
        two = (mix(hashes[:-1] * np.uint64(3) + hashes[1:]) >> shift).astype(np.uint32)
        again = np.concatenate([[0], np.cumsum(hashes[1:] == hashes[:-1])])
        seen = np.zeros(PLACES, bool)
        for t in range(j - i):
            f0, f1 = first[t], first[t + 1]
            own = [three[o[t]:max(o[t], o[t + 1] - 2)], one[f0:f1], two[f0:max(f0, f1 - 1)]]
            if f1 - f0 > 1 and (n := int(again[f1 - 1] - again[f0])):  # pairs of one word
                own.append(np.arange(min(n.bit_length(), len(AGAIN)), dtype=np.uint32) + AGAIN[0])
            if o[t + 1] - o[t] < 1500:
                yield np.unique(np.concatenate(own))
            else:
                for x in own:
                    seen[x] = True
                found = np.flatnonzero(seen)
                seen[found] = False
                yield found.astype(np.uint32)


# ---- model ------------------------------------------------------------------------------

def log_count_ratios(counts: np.ndarray) -> np.ndarray:
    """counts: (2, PLACES) rows of class 0 and 1 that have a feature."""
    share = (counts + SMOOTHING) / (counts + SMOOTHING).sum(axis=1, keepdims=True)
    return np.log(share[1] / share[0]).astype(np.float32)


def scaled(f: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    x = ratios[f]
    return x / max(float(np.sqrt(np.dot(x, x))), 1e-9)


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray,
                            cost: float = COST, epochs: int = EPOCHS, seed: int = 7) -> np.ndarray:
    """Weights (the last is the bias) of min 1/2 |w|^2 + cost_i * hinge, one dual variable
    after the other.  Classes weigh the same in sum."""
    w = np.zeros(PLACES + 1, np.float64)
    n = len(rows)
    share = np.bincount((y > 0).astype(int), minlength=2)
    top = cost * np.where(y > 0, n / (2 * max(share[1], 1)), n / (2 * max(share[0], 1)))
    square = np.array([float(np.dot(v, v)) + 1.0 for v in values])
    alpha = np.zeros(n)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(n):
            f, v = rows[i], values[i]
            g = y[i] * (float(np.dot(w[f], v)) + w[-1]) - 1.0
            new = min(max(alpha[i] - g / square[i], 0.0), top[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[f] += step * v
                w[-1] += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


def logistic_curve(margin: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a * margin + b))) by Newton steps with Platt's targets; a row
    counts ``weight`` times."""
    weight = np.ones(len(y)) if weight is None else weight
    up, down = int((y > 0).sum()), int((y <= 0).sum())
    goal = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        q, off = weight * np.maximum(p * (1 - p), 1e-9), weight * (p - goal)
        g = np.array([np.dot(margin, off), off.sum()])
        h = np.array([[np.dot(q, margin * margin) + 1e-6, np.dot(q, margin)], [np.dot(q, margin), q.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


# ---- Spark ------------------------------------------------------------------------------

def held_out(modulus: int, rest: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == rest, F.lit(False))


def label_table(labels: DataFrame, column: str) -> DataFrame:
    """doc_id, label: one row per labelled document."""
    return (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
            .where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label")))


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of labelled rows (doc_id, label, chosen, text): class counts of each feature, cut into
    parts, and the features of the chosen rows."""
    counts = np.zeros((2, PLACES), np.int64)
    names = ["part", "doc_id", "label", "body"]
    for batch in batches:
        ids, labels, chosen = (batch.column(k).to_pylist() for k in range(3))
        rows = []
        for doc, label, use, f in zip(ids, labels, chosen, features(*text_bytes(batch.column(3)))):
            counts[label, f] += 1
            if use:
                rows.append((-1, doc, label, f.astype("<u4").tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int32(), pa.binary()))], names)
    if counts.any():
        cut = counts.reshape(2, _PARTS, -1).transpose(1, 0, 2)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(_PARTS), pa.int32()), pa.nulls(_PARTS, pa.int64()), pa.nulls(_PARTS, pa.int32()),
             pa.array([np.ascontiguousarray(c).tobytes() for c in cut], pa.binary())], names)


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(b, np.int64) for b in pdf["body"])
    return pd.DataFrame({"part": [pdf["part"].iloc[0]], "body": [total.tobytes()]})


def class_weights(y: np.ndarray, by_label: dict[int, int]) -> np.ndarray:
    """Weights of mean one that give the classes of a sample their shares of all labelled rows."""
    each = {k: by_label[k] / max(1, int((y == v).sum())) for k, v in ((0, -1.0), (1, 1.0))}
    weight = np.where(y > 0, each[1], each[0])
    return weight / weight.mean()


def _fit(ratios: np.ndarray, by_label: dict[int, int]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        rows = [np.frombuffer(b, "<u4").astype(np.int64) for b in pdf["body"]]
        y = np.where(pdf["label"].to_numpy() == 1, 1.0, -1.0)
        values = [scaled(f, ratios).astype(np.float64) for f in rows]
        aside = np.arange(len(rows)) % 5 == 4
        if len(set(y[aside])) < 2 or len(set(y[~aside])) < 2:
            aside[:] = False
        fit = np.flatnonzero(~aside)
        w = dual_coordinate_descent([rows[i] for i in fit], [values[i] for i in fit], y[fit])
        on = np.flatnonzero(aside) if aside.any() else fit
        margin = np.array([float(np.dot(w[rows[i]], values[i])) + w[-1] for i in on])
        a, b = logistic_curve(margin, y[on], class_weights(y[on], by_label))
        return pd.DataFrame({"body": [(w * a).astype("<f4").tobytes()], "shift": [b]})
    return run


class Model:
    """score(data, offs): label-1 likelihood of each text."""

    def __init__(self, ratios=None, weights=None, shift: float = 0.0, share: float = 0.5):
        self.ratios, self.weights, self.shift, self.share = ratios, weights, shift, share

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(offs) - 1, self.share)
        bias = float(self.weights[-1]) + self.shift
        out = [float(np.dot(self.weights[f], scaled(f, self.ratios))) + bias if len(f) else bias
               for f in features(data, offs)]
        return 1 / (1 + np.exp(-np.clip(np.array(out), -30, 30)))


def train(docs: DataFrame, labels: DataFrame, out: Column, column: str = "quality",
          sample_rows: int = SAMPLE_ROWS, class_rows: int = CLASS_ROWS) -> Model:
    """Fit on the labelled rows of ``docs`` where ``out`` (held out) does not hold."""
    bounded_batches(docs.sparkSession)
    known = stored(label_table(labels, column).where(~out), "labels")
    by_label = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n = sum(by_label.values())
    if len(by_label) < 2:
        return Model(share=float(next(iter(by_label), 0.5)))
    limit = {k: int(min(1.0, max(sample_rows / n, class_rows / of)) * 2**31) for k, of in by_label.items()}
    share = F.when(F.col("label") == 1, F.lit(limit[1])).otherwise(F.lit(limit[0]))
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .join(sized(known, n), "doc_id")
            .select("doc_id", "label", (F.pmod(F.xxhash64("doc_id"), F.lit(2**31)) < share).alias("chosen"), "text"))
    gathered = stored(rows.mapInArrow(tidied(_gather), "part int, doc_id long, label int, body binary"), "features")
    # 64 rows of 64 KB: bounded by the number of feature places
    sums = (gathered.where("part >= 0").select("part", "body").groupBy("part")
            .applyInPandas(_add, "part int, body binary").collect())
    if not sums:
        return Model(share=by_label[1] / n)
    counts = np.zeros((_PARTS, 2, PLACES // _PARTS), np.int64)
    for r in sums:
        counts[r["part"]] = np.frombuffer(r["body"], np.int64).reshape(2, -1)
    ratios = log_count_ratios(counts.transpose(1, 0, 2).reshape(2, PLACES))
    # one task fits the bounded sample
    fitted = (gathered.where("part < 0").select(F.lit(0).alias("all"), "doc_id", "label", "body").groupBy("all")
              .applyInPandas(_fit(ratios, by_label), "body binary, shift double").collect())
    if not fitted:
        return Model(share=by_label[1] / n)
    return Model(ratios, np.frombuffer(fitted[0]["body"], "<f4"), fitted[0]["shift"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of every row (the model is bounded by the number of feature places)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(shared.value.score(*text_bytes(batch.column(1))), pa.float64())], ["doc_id", "score"])
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(tidied(run), "doc_id long, score double"))


def classify(docs: DataFrame, labels: DataFrame, modulus: int = 4, rest: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    out = held_out(modulus, rest)
    return (score(docs, train(docs, labels, out))
            .select("doc_id", out.alias("held_out"), "score", (F.col("score") >= KEEP_SCORE).cast("int").alias("predicted")))


def keep_quality(docs: DataFrame, labels: DataFrame, modulus: int = 4, rest: int = 2) -> DataFrame:
    """The rows of ``docs`` (all columns) that the classifier does not reject."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, held_out(modulus, rest)))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(model.value.score(*text_bytes(batch.column(at))) >= KEEP_SCORE))
    return docs.mapInArrow(tidied(run), docs.schema)
