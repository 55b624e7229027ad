"""Toxicity: a convolutional text classifier trained in numpy.

A word's vector is the sum of three hashed embeddings: of the word, of its first three and
of its first four bytes.  Filters of one, two and three words run over the whole text, each
takes its maximum over the text, and a linear layer with a logistic curve gives the raw
score.  Training uses every labelled row and whole texts: rows are dealt by hash into shards
of about ``SHARD_ROWS``; in each round every shard takes the model through its own rows, and
the next model is the mean over the shards that moved a parameter.  Four fifths of the rows
of each shard move the model, the others choose its thresholds.  A language guess from the
text's own frequent words picks the threshold that was calibrated for it; scores are
stretched so that this threshold becomes 0.7.

Only the text is read for a score.  Results for odd input: a null or empty text is scored as
one without words; a null doc_id is scored, is never held out and has no label; a null label
is no label and repeated labels count as their largest; without labels of both classes every
score is the share of label 1 (0 if there is none); repeated rows are scored each; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gymlake.llm.common import bounded_batches, scratch_path, sized, stored, tidied
from gymlake.llm.quality import held_out, label_table
from gymlake.llm.words import LOWER, mix, prefix_hash, slices, text_bytes, word_spans

PLACES = 1 << 15
SIZE = 12       # of an embedding
FILTERS = 12    # of each width
WIDTHS = (1, 2, 3)
PAD = max(WIDTHS) - 1
SHARD_ROWS = 6_000       # labelled rows of a shard, about
SHARD_BYTES = 32 << 20   # of their texts, about
# Passes over each shard: about so many of its rows in all, within these bounds.
ROW_VISITS, EPOCHS = 48_000, (8, 20)
# Bins of the logit of raw scores, whose edges thresholds are chosen from.
BINS, LOGITS = 1 << 15, 30.0
RATE = 0.08
KEEP_SCORE = 0.7
# Frequent words by which a text's language is guessed.
FREQUENT = {
    "en": "the and of to in is that for it was on are with as be this from",
    "de": "der die und den von zu das mit im für nicht ist auf ein eine dem",
    "fr": "le les des en et un une du au pour dans est sur qui pas par",
    "es": "el los del y las una por con su para lo como más pero sus",
}
LANGUAGES = ("other", *FREQUENT)


# ---- words of texts ---------------------------------------------------------------------

def _frequent_table() -> np.ndarray:
    table = np.zeros(1 << 16, np.uint8)
    for k, words in enumerate(FREQUENT.values(), 1):
        for w in words.split():
            data = LOWER[np.frombuffer(w.encode(), np.uint8)]
            p, down = prefix_hash(data)
            table[int(mix((p[-1:] - p[:1]) * down[:1])[0]) >> 48] = k
    return table


def word_places(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """((words, 3) places of each word, first word of each text, guessed language of each)."""
    low = LOWER[data]
    start, end, first = word_spans(low, offs)
    p, down = prefix_hash(low)
    base, d = p[start], down[start]
    cols = [mix((p[end] - base) * d)]
    for k, n in enumerate((3, 4), 1):
        cols.append(mix(mix((p[np.minimum(start + n, end)] - base) * d) + np.uint64(k)))
    places = np.stack([(c >> np.uint64(64 - 15)).astype(np.int32) for c in cols], axis=1)
    table = _frequent_table()[(cols[0] >> np.uint64(48)).astype(np.int64)]
    votes = np.stack([np.concatenate([[0], np.cumsum(table == k)])[first] for k in range(1, len(LANGUAGES))])
    votes = np.diff(votes, axis=1)
    return places, first, np.where(votes.max(axis=0) > 0, votes.argmax(axis=0) + 1, 0)


# ---- model ------------------------------------------------------------------------------

class Network:
    """Parameters, forward pass and one training step."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.emb = (rng.normal(0, 0.1, (PLACES, SIZE))).astype(np.float32)
        self.conv = [rng.normal(0, 1 / np.sqrt(w * SIZE), (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.out_bias = np.float32(0)
        self.thresholds = np.full(len(LANGUAGES), 0.5)

    def layout(self, places: np.ndarray, first: np.ndarray):
        """Words laid out with ``PAD`` empty ones after each text: (vectors, rows of the
        texts' first words, which rows are words)."""
        n_texts = len(first) - 1
        own = np.repeat(np.arange(n_texts), np.diff(first))
        at = np.arange(len(places)) + PAD * own
        x = np.zeros((len(places) + PAD * n_texts, SIZE), np.float32)
        x[at] = self.emb[places[:, 0]] + self.emb[places[:, 1]] + self.emb[places[:, 2]]
        return x, first[:-1] + PAD * np.arange(n_texts), at

    def pooled(self, x: np.ndarray, begin: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Maxima of each filter over each text, and each width's responses."""
        real = np.zeros(len(x), bool)
        real[at] = True
        pools, all_y = [], []
        for w, kernel, bias in zip(WIDTHS, self.conv, self.bias):
            y = x @ kernel[0]
            for k in range(1, w):
                y[:-k] += x[k:] @ kernel[k]
            y += bias
            np.maximum(y, 0, out=y)
            y[~real] = 0
            all_y.append(y)
            pools.append(np.maximum.reduceat(y, begin, axis=0))
        return np.concatenate(pools, axis=1), all_y

    def raw(self, places: np.ndarray, first: np.ndarray) -> np.ndarray:
        if len(first) < 2:
            return np.zeros(0)
        x, begin, at = self.layout(places, first)
        pool, _ = self.pooled(x, begin, at)
        return 1 / (1 + np.exp(-np.clip((pool @ self.out + self.out_bias).astype(np.float64), -LOGITS, LOGITS)))

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        out = [np.zeros(0)]
        for i, j in slices(offs, 1 << 20):
            places, first, lang = word_places(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
            p, t = self.raw(places, first), self.thresholds[lang]
            out.append(np.where(p < t, KEEP_SCORE * p / t, KEEP_SCORE + (1 - KEEP_SCORE) * (p - t) / (1 - t)))
        return np.clip(np.concatenate(out), 0, 1)

    def step(self, places, first, y, weight, memory) -> None:
        """One Adagrad step on a batch of texts; a maximum passes its gradient to the
        window that holds it."""
        x, begin, at = self.layout(places, first)
        word = np.full(len(x), -1)
        word[at] = np.arange(len(at))
        pool, all_y = self.pooled(x, begin, at)
        p = 1 / (1 + np.exp(-np.clip(pool @ self.out + self.out_bias, -30, 30)))
        g = ((p - y) * weight / len(y)).astype(np.float32)
        g_pool = g[:, None] * self.out[None, :]

        def move(name, param, grad):
            seen = memory.setdefault(name, np.zeros_like(param))
            seen += grad * grad
            param -= RATE * grad / (np.sqrt(seen) + 1e-6)

        ends = np.append(begin[1:], len(x))
        g_emb_rows, g_emb = [], []
        for k, w in enumerate(WIDTHS):
            part, top = g_pool[:, k * FILTERS:(k + 1) * FILTERS], pool[:, k * FILTERS:(k + 1) * FILTERS]
            y_all = all_y[k]
            # the first row of each text whose response is the maximum
            rows = np.empty((len(y), FILTERS), np.int64)
            for t in range(len(y)):
                rows[t] = begin[t] + y_all[begin[t]:ends[t]].argmax(axis=0)
            live = (top > 0) & (part != 0)
            t_i, f_i = np.nonzero(live)
            r, d = rows[t_i, f_i], part[t_i, f_i]
            grad = np.zeros_like(self.conv[k])
            for c in range(w):
                v = x[r + c]
                np.add.at(grad[c].T, f_i, d[:, None] * v)
                own = word[r + c] >= 0
                g_emb_rows.append(word[r + c][own])
                g_emb.append((d[:, None] * self.conv[k][c].T[f_i])[own])
            move(f"conv{k}", self.conv[k], grad)
            move(f"bias{k}", self.bias[k], np.bincount(f_i, d, FILTERS).astype(np.float32))
        out_grad = pool.T @ g
        move("out", self.out, out_grad)
        seen = memory.setdefault("out_bias", np.zeros(1, np.float32))
        seen += g.sum() ** 2
        self.out_bias -= np.float32(RATE * g.sum() / (np.sqrt(seen[0]) + 1e-6))
        if g_emb_rows:
            at_word, grad = np.concatenate(g_emb_rows), np.concatenate(g_emb)
            where, back = np.unique(places[at_word].ravel(), return_inverse=True)
            total = np.zeros((len(where), SIZE), np.float32)
            np.add.at(total, back.reshape(-1), np.repeat(grad, 3, axis=0))
            seen = memory.setdefault("emb", np.zeros_like(self.emb))
            seen[where] += total * total
            self.emb[where] -= RATE * total / (np.sqrt(seen[where]) + 1e-6)


def _texts(places_first: list, chosen: np.ndarray):
    """Words of the chosen texts, one after the other."""
    parts = [places_first[i] for i in chosen]
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    return (np.concatenate(parts) if parts else np.zeros((0, 3), np.int32)), first


def rounds_of(train_rows: int) -> int:
    """Passes over a shard that has so many rows to train on."""
    return int(np.clip(ROW_VISITS // max(1, train_rows), *EPOCHS))


def fit(net: Network, memory: dict, places: list[np.ndarray], y: np.ndarray, weight: np.ndarray, begin: int, passes: int) -> None:
    """Passes ``begin`` to ``begin + passes`` of training over the given rows."""
    rng = np.random.default_rng(11)
    for turn in range(begin + passes):
        order = rng.permutation(len(y))
        for k in range(0, len(order) if turn >= begin else 0, 32):
            b = order[k:k + 32]
            net.step(*_texts(places, b), y[b], weight[b], memory)


def thresholds(bins: pd.DataFrame, share: float) -> np.ndarray:
    """The threshold of each language from the rows that were not trained on: ``bins`` has
    lang, bin, n, up (rows, rows of label 1), low and high (raw scores) of each bin.

    ``share``: label 1 among all labelled rows, to weigh the classes back."""
    up = max(1, bins["up"].sum())
    down = max(1, bins["n"].sum() - bins["up"].sum())

    def cut(own: pd.DataFrame, otherwise: float) -> float:
        own = own.groupby("bin").agg({"n": "sum", "up": "sum", "low": "min", "high": "max"}).sort_index(ascending=False)
        hit = own["up"].to_numpy() * (share / up)
        return _threshold(own["low"].to_numpy(), own["high"].to_numpy(), hit,
                          hit + (own["n"] - own["up"]).to_numpy() * ((1 - share) / down), otherwise)

    whole = cut(bins, 0.5)
    found = np.full(len(LANGUAGES), whole)
    for k, own in bins.groupby("lang"):
        if own["up"].sum() >= 5 and (own["n"] - own["up"]).sum() >= 20:
            found[k] = cut(own, whole)
    return found


def _threshold(low: np.ndarray, high: np.ndarray, hit: np.ndarray, w: np.ndarray, otherwise: float) -> float:
    """The cut with the best F1 between bins (highest first) of weights ``w``, of which ``hit``
    has label 1; in the middle of the gap between raw scores there."""
    f1 = 2 * np.cumsum(hit) / (np.cumsum(w) + hit.sum())
    if not len(f1) or not hit.sum():
        return otherwise
    k = int(f1.argmax())
    below = high[k + 1] if k + 1 < len(high) else 0.0
    return float(np.clip((low[k] + below) / 2, 0.02, 0.98))


# ---- Spark ------------------------------------------------------------------------------

def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offs = text_bytes(batch.column(3))
        bodies, langs = [], []
        for i, j in slices(offs):
            places, first, lang = word_places(data[offs[i]:offs[j]], offs[i:j + 1] - offs[i])
            bodies += [places[a:b].astype("<u2").tobytes() for a, b in zip(first[:-1], first[1:])]
            langs += lang.tolist()
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(langs, pa.int32()), pa.array(bodies, pa.binary())],
            ["shard", "doc_id", "label", "lang", "body"])


_SHARD = "shard int, n long, up long, words binary, lengths binary, label binary, lang binary"


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row for a shard: its texts in order of doc_id; n and up count what is trained on."""
    pdf = pdf.sort_values(["doc_id", "body"])
    y = pdf["label"].to_numpy()
    on = y[~_aside(len(y))]
    return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "n": [len(on)], "up": [int(on.sum())], "words": [b"".join(pdf["body"])],
                         "lengths": [(pdf["body"].str.len().to_numpy() // 6).astype("<i8").tobytes()],
                         "label": [y.astype(np.uint8).tobytes()], "lang": [pdf["lang"].to_numpy().astype(np.uint8).tobytes()]})


def _aside(rows: int) -> np.ndarray:
    """Which rows of a shard are not trained on."""
    return np.arange(rows) % 5 == 4


def _shards(batch: pa.RecordBatch):
    """(words of each text, labels, languages) of each shard."""
    for k in range(batch.num_rows):
        words, lengths, label, lang = (np.frombuffer(batch.column(c)[k].as_buffer(), t)
                                       for c, t in (("words", "<u2"), ("lengths", "<i8"), ("label", np.uint8), ("lang", np.uint8)))
        yield np.split(words.reshape(-1, 3), np.cumsum(lengths)[:-1]), label.astype(np.float64), lang


_PARTS = 128  # rows of embeddings are summed by so many keys, the other parameters by one more


def _flat(net: Network, memory: dict) -> tuple[np.ndarray, np.ndarray]:
    """Parameters with their step sizes: (rows of embeddings, all others), in double precision."""
    names = [f"{kind}{k}" for k in range(len(WIDTHS)) for kind in ("conv", "bias")] + ["out", "out_bias"]
    values = [v for k in range(len(WIDTHS)) for v in (net.conv[k], net.bias[k])] + [net.out, np.atleast_1d(net.out_bias)]
    rest = [np.ravel(v) for v in values] + [np.ravel(memory.get(n, np.zeros(np.shape(v)))) for n, v in zip(names, values)]
    rows = np.concatenate([net.emb, memory.get("emb", np.zeros_like(net.emb))], axis=1)
    return rows.astype(np.float64), np.concatenate(rest).astype(np.float64)


def _unflat(rows: np.ndarray, rest: np.ndarray) -> tuple[Network, dict]:
    """The inverse of ``_flat``."""
    net, memory, at = Network(), {}, 0
    net.emb, memory["emb"] = (np.ascontiguousarray(h, np.float32) for h in (rows[:, :SIZE], rows[:, SIZE:]))

    def take(shape):
        nonlocal at
        at += int(np.prod(shape))
        return rest[at - int(np.prod(shape)):at].reshape(shape).astype(np.float32)

    for k in range(len(WIDTHS)):
        net.conv[k], net.bias[k] = take(net.conv[k].shape), take(net.bias[k].shape)
    net.out, net.out_bias = take(net.out.shape), take((1,))[0]
    for k in range(len(WIDTHS)):
        memory[f"conv{k}"], memory[f"bias{k}"] = take(net.conv[k].shape), take(net.bias[k].shape)
    memory["out"], memory["out_bias"] = take(net.out.shape), take((1,))
    return net, memory


def _round(model, begin: int, passes: int, n: int, up: int):
    """Each task takes the model through its shards, one by one, and gives the sums of what
    came out and by how many shards each row of embeddings was moved."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start_rows, start_rest = model.value
        rows, moved, rest, shards = np.zeros_like(start_rows), np.zeros(PLACES), np.zeros_like(start_rest), 0
        for batch in batches:
            for places, y, _ in _shards(batch):
                on = np.flatnonzero(~_aside(len(y)))
                net, memory = _unflat(start_rows, start_rest)
                weight = np.where(y[on] == 1, n / (2 * max(1, up)), n / (2 * max(1, n - up)))
                fit(net, memory, [places[i] for i in on], y[on], weight, begin, passes)
                new_rows, new_rest = _flat(net, memory)
                change = (new_rows != start_rows).any(axis=1)
                rows[change] += new_rows[change]
                moved += change
                rest += new_rest
                shards += 1
        if shards:
            # what one shard alone gives is in single precision anyway
            width = 4 if shards == 1 else 8
            bodies = [np.column_stack([r, m]) for r, m in zip(np.split(rows, _PARTS), np.split(moved, _PARTS))] + [np.append(rest, shards)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(_PARTS + 1), pa.int32()), pa.array([width] * len(bodies), pa.int32()),
                 pa.array([b.astype(f"<f{width}").tobytes() for b in bodies], pa.binary())], ["part", "width", "body"])
    return run


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(b, f"<f{width}").astype(np.float64) for width, b in zip(pdf["width"], pdf["body"]))
    return pd.DataFrame({"part": pdf["part"].iloc[:1], "body": [total.tobytes()]})


def _measure(model, trained: bool):
    """Raw scores of the rows that were trained on or of the others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, _ = _unflat(*model.value)
        for batch in batches:
            for places, y, lang in _shards(batch):
                on = np.flatnonzero(_aside(len(y)) != trained)
                raw = np.concatenate([np.zeros(0)] + [net.raw(*_texts(places, on[k:k + 256])) for k in range(0, len(on), 256)])
                place = np.clip((np.log(raw / (1 - raw)) / LOGITS + 1) / 2 * BINS, 0, BINS - 1)
                yield pa.RecordBatch.from_arrays([pa.array(lang[on], pa.int32()), pa.array(place.astype(np.int32)), pa.array(y[on].astype(np.int64)),
                                                  pa.array(raw)], ["lang", "bin", "label", "raw"])
    return run


class Constant:
    """The score without labels of both classes."""

    def __init__(self, share: float):
        self.share = share

    def score(self, data, offs):
        return np.full(len(offs) - 1, self.share)


def train(docs: DataFrame, labels: DataFrame, out: Column, column: str = "toxic", shard_rows: int = SHARD_ROWS,
          shard_bytes: int = SHARD_BYTES):
    """Fit on all labelled rows of ``docs`` where ``out`` (held out) does not hold."""
    spark = docs.sparkSession
    bounded_batches(spark)
    known = stored(label_table(labels, column).where(~out), "labels")
    by_label = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(by_label) < 2:
        return Constant(float(next(iter(by_label), 0.0)))
    share = by_label[1] / sum(by_label.values())
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .join(sized(known, sum(by_label.values())), "doc_id"))
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    if not size["n"]:
        return Constant(share)
    dealt = max(-(-size["n"] // shard_rows), -(-size["bytes"] // shard_bytes))
    shard = F.pmod(F.xxhash64(F.lit(1), "doc_id", "text"), F.lit(dealt)).cast("int").alias("shard")
    path = scratch_path(spark, "shards")
    # a shard is one row in a file of its own, so that rounds shuffle models only
    (rows.select(shard, "doc_id", "label", "text").mapInArrow(tidied(_gather), "shard int, doc_id long, label int, lang int, body binary")
     .repartition(dealt, "shard").groupBy("shard").applyInPandas(_pack, _SHARD).write.option("maxRecordsPerFile", 1).parquet(path))
    shards = spark.read.schema(_SHARD).parquet(path)
    known_to_fit = shards.agg(F.count("*").alias("shards"), F.sum("n").alias("n"), F.sum("up").alias("up")).first()
    n, up, made = known_to_fit["n"], known_to_fit["up"], known_to_fit["shards"]
    model, turns = _flat(Network(), {}), rounds_of(n // made)
    # one shard alone needs no mean between its passes
    passes = turns if made == 1 else 1
    for begin in range(0, turns, passes):
        shared = spark.sparkContext.broadcast(model)
        # _PARTS + 1 rows: bounded by the number of parameters
        sums = (shards.mapInArrow(tidied(_round(shared, begin, passes, n, up)), "part int, width int, body binary")
                .groupBy("part").applyInPandas(_add, "part int, body binary").collect())
        body = {r["part"]: np.frombuffer(r["body"]) for r in sums}
        total = np.concatenate([body[k].reshape(-1, 2 * SIZE + 1) for k in range(_PARTS)])
        moved = total[:, -1:]
        model = np.where(moved > 0, total[:, :-1] / np.maximum(moved, 1), model[0]), body[_PARTS][:-1] / body[_PARTS][-1]
        shared.unpersist()
    shared = spark.sparkContext.broadcast(model)
    for trained in (False, True):
        # at most BINS rows of each language
        bins = (shards.mapInArrow(tidied(_measure(shared, trained)), "lang int, bin int, label long, raw double").groupBy("lang", "bin")
                .agg(F.count("*").alias("n"), F.sum("label").alias("up"), F.min("raw").alias("low"), F.max("raw").alias("high")).toPandas())
        if 0 < bins["up"].sum() < bins["n"].sum():
            break
    net, _ = _unflat(*model)
    net.thresholds = thresholds(bins, share)
    return net


def score(docs: DataFrame, labels: DataFrame, modulus: int = 3, rest: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    out = held_out(modulus, rest)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(model.value.score(*text_bytes(batch.column(1))), pa.float64())], ["doc_id", "score"])
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, score double")
            .select("doc_id", out.alias("held_out"), "score", (F.col("score") >= KEEP_SCORE).cast("int").alias("predicted")))
