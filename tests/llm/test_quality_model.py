"""The quality classifier against plain Python, and on a class far rarer than its sample."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gymlake.llm import quality, words
from test_kernels import plain_words


def plain_features(text):
    """Feature numbers of one text, word by word and byte by byte."""
    shift, body, found = 64 - quality.BITS, (text or "").encode(), set()
    for i in range(len(body) - 2):
        three = body[i] << 16 | body[i + 1] << 8 | body[i + 2]
        found.add((three * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - quality.BITS)
    hashes = [int(words.word_hashes(*words.text_bytes(pa.array([w], pa.string())))[0][0]) for w in plain_words(text)]
    found |= {h >> shift for h in hashes}
    again = 0
    for a, b in zip(hashes, hashes[1:]):
        pair = np.array([(a * 3 + b) & 0xFFFFFFFFFFFFFFFF], np.uint64)
        found.add(int(words.mix(pair)[0]) >> shift)
        again += a == b
    return sorted(found | set(list(quality.AGAIN)[:again.bit_length()]))


@given(st.lists(st.one_of(st.none(), st.text(alphabet="abé A.\n", max_size=80)), max_size=6))
@settings(max_examples=100, deadline=None)
def test_features_equal_plain_python(texts):
    texts = texts + ["a a a a a " + "Lorem ipsum, dolor! " * 200]  # a long text takes the other way
    got = [f.tolist() for f in quality.features(*words.text_bytes(pa.array(texts, pa.string())))]
    assert got == [plain_features(t) for t in texts]


def test_log_count_ratios_equal_plain_python():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 40, (2, quality.PLACES))
    total = [int(c.sum()) + quality.PLACES for c in counts]
    got = quality.log_count_ratios(counts)
    for k in rng.integers(0, quality.PLACES, 50):
        want = np.log((int(counts[1, k]) + 1) / total[1] / ((int(counts[0, k]) + 1) / total[0]))
        assert abs(got[k] - want) < 1e-5


def test_dual_coordinate_descent_reaches_the_least_loss():
    rng = np.random.default_rng(9)
    y = np.where(rng.random(120) < 0.3, 1.0, -1.0)
    rows = [np.unique(rng.integers(0, 30, 6)) for _ in y]
    values = [rng.normal(size=len(r)) for r in rows]
    w = quality.dual_coordinate_descent(rows, values, y, epochs=4000)
    cost = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))

    def loss(w):
        margin = np.array([w[r] @ v + w[-1] for r, v in zip(rows, values)])
        return (w @ w) / 2 + (cost * np.maximum(0, 1 - y * margin)).sum()
    used = np.append(np.arange(30), quality.PLACES)
    for size in (1e-1, 1e-2):
        for _ in range(100):
            other = w.copy()
            other[used] += size * rng.normal(size=len(used))
            assert loss(other) > loss(w) - 1e-2


def test_weights_give_classes_their_shares():
    y = np.array([1.0] * 30 + [-1.0] * 10)
    weight = quality.class_weights(y, {0: 5, 1: 995})
    assert abs(weight.mean() - 1) < 1e-12 and abs(weight[y < 0].sum() / weight.sum() - 0.005) < 1e-12
    assert (quality.class_weights(y, {0: 100, 1: 300}) == 1).all()
    margin = np.where(y > 0, 1.0, -0.5) + np.linspace(-1, 1, 40)
    low, high = (quality.logistic_curve(margin, y, quality.class_weights(y, k))[1] for k in ({0: 900, 1: 100}, {0: 100, 1: 900}))
    assert low < high


def test_a_class_far_rarer_than_the_sample_is_learnt(spark):
    # one bad row in 400; a sample of 400 by itself would hold about ten, and of 40 about one
    good, bad = "a calm and even account of the day's work number ", "buy now buy now cheap pills $$$ number "
    docs = spark.range(8000).select(F.col("id").alias("doc_id"), (F.col("id") % 400 == 7).alias("is_bad")).select(
        "doc_id", F.concat(F.when(F.col("is_bad"), bad).otherwise(good), F.col("doc_id").cast("string")).alias("text"), "is_bad")
    labels = docs.select("doc_id", (~F.col("is_bad")).cast("int").alias("quality"))
    model = quality.train(docs, labels, quality.held_out(4, 2), sample_rows=40, class_rows=30)
    assert model.weights is not None
    judged = quality.score(docs, model).join(docs.select("doc_id", "is_bad"), "doc_id").collect()
    assert all(r.score < quality.KEEP_SCORE for r in judged if r.is_bad)
    assert all(r.score >= quality.KEEP_SCORE for r in judged if not r.is_bad)
