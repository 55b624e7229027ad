import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gymlake.llm import centroids, quality_rules, spelling
from gymlake.llm.common import load
from gymlake.llm.queries import op11_centroid_clusters, op12_spelling_variants, op13_quality_rules


@pytest.fixture(params=["edges", "nothing", "small"])
def docs(request):
    return request.getfixturevalue(request.param)


def plain(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def rows(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


# ---- 11 ---------------------------------------------------------------------------------

def brute_nearest(x, c):
    d = ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1)


@pytest.mark.parametrize("span, k, dims", [(3, 40, 4), (1, 7, 3), (500, 40, 64), (2, 1, 5), (0, 5, 2)])
def test_the_walk_finds_the_nearest_centroid_and_the_smaller_number_of_ties(span, k, dims):
    rnd = np.random.default_rng(span + k)
    x = rnd.integers(-span, span + 1, (3000, dims))
    c = rnd.integers(-span, span + 1, (k, dims))
    c[k // 2] = c[0]  # two equal centroids
    got = centroids.CentroidLists(c).nearest(x)
    want = brute_nearest(x, c)
    assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_the_walk_takes_the_largest_integers():
    c = np.array([[centroids.LARGEST] * 64, [-centroids.LARGEST] * 64])
    got = centroids.CentroidLists(c).nearest(c[::-1].copy())
    assert got[0].tolist() == [1, 0] and got[1].tolist() == [0, 0]
    assert centroids.CentroidLists(c[:1]).nearest(c[1:])[1].tolist() == [64 * (2 * centroids.LARGEST) ** 2]


def brute_clusters(data, k, rounds, dims):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in data
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    c = [v for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, m)), j) for j, m in enumerate(c)) for _, v in kept]

    for _ in range(rounds if kept else 0):
        near = assign()
        for j in range(len(c)):
            mine = [v for (_, v), (_, m) in zip(kept, near) if m == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine)]
    near = assign() if kept else []
    inertia = defaultdict(int)
    for d, j in near:
        inertia[j] += d
    return Counter((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest())
                   for (i, _), (d, j) in zip(kept, near))


CLUSTER = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def odd_vectors(n):
    rnd = random.Random(1)
    data = [(i, [rnd.choice([-0.5, 0.0, 0.25, 1.0, rnd.random()]) for _ in range(4)]) for i in range(n)]
    data += data[:5]  # repeated rows
    data += [(None, [0.1] * 4), (None, [0.1] * 4), (-3, [-1.0, 0.0, 0.0, 1e5]), (900, None), (901, [1.0] * 3), (902, []),
             (903, [1.0, None, 1.0, 1.0]), (904, [1.0, math.nan, 1.0, 1.0]), (905, [math.inf, 1.0, 1.0, 1.0])]
    return data


@pytest.mark.parametrize("n, k", [(200, 9), (3, 40)])
def test_clusters_of_odd_vectors_equal_brute_force(spark, n, k):
    data = odd_vectors(n)
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in data], "vec_id long, embedding array<double>, cluster string, v int").repartition(3)
    got = centroids.cluster(df, k=k, rounds=3, dims=4)
    assert rows(got, *CLUSTER) == brute_clusters(data, k, 3, 4)


def test_clusters_of_nothing(spark):
    df = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert centroids.cluster(df).collect() == []


def test_vectors_beyond_64_bits_are_refused(spark):
    df = spark.createDataFrame([(1, [1e300] * 4)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64-bit"):
        centroids.cluster(df, dims=4)


def test_registered_clusters_equal_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    data = [(r["vec_id"], r["embedding"]) for r in load(spark, sf, "embeddings").collect()]
    assert rows(op11_centroid_clusters(spark, sf), *CLUSTER) == brute_clusters(data, 40, 5, 64)


# ---- 12 ---------------------------------------------------------------------------------

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def brute_words(texts, typo=31, least=7):
    n = Counter()
    for doc, text in texts:
        for run in RUN.findall(text):
            run = run.translate(ASCII_LOWER)
            if typo:
                h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
                if h % typo == 0:
                    run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= least:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(n):
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and one_edit(v, w)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 10 * n[w]:
            form[w] = best
    out = Counter()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[(w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w)))] += 1
    return out


VARIANT = ("word", "form", "root", "n", "n_near", "form_n")


def test_spelling_variants_of_texts(docs):
    got = spelling.spelling_variants(docs, typo=31)
    assert rows(got, *VARIANT) == brute_variants(brute_words(plain(docs)))


def test_registered_spelling_variants_equal_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = rows(op12_spelling_variants(spark, sf), *VARIANT)
    assert got == brute_variants(brute_words(plain(load(spark, sf, "documents")))) and len(got) > 100


def dense_words():
    """Words full of near words: few letters, repeated letters, every length around the borders
    at which the number of open parts changes, long words, stars and non-Latin letters."""
    rnd = random.Random(7)
    n = {}
    for length in (7, 8, 12, 13, 14, 24, 25, 60):
        for _ in range(12):
            base = "".join(rnd.choice("ab") for _ in range(length))
            for w in {base, base[:3] + "é" + base[3:], base[:-1], base + "a", "b" + base, base[:5] + base[6:],
                      base[:2] + "*" + base[3:], base[:length // 2] + base[length // 2] + base[length // 2:]}:
                if len(w) >= 7:
                    n[w] = rnd.choice([2, 3, 20, 20, 31, 200, 2000, 30000])
    n["漢" * 9] = 50
    n["漢" * 8] = 5
    n["漢" * 4 + "\U0001f600" + "漢" * 4] = 500
    return n


def test_near_words_forms_and_roots_of_dense_words(spark):
    n = dense_words()
    vocab = spelling.vocabulary(spark.createDataFrame([(w,) for w in n], "word string"), 1)  # only to have the layout
    assert vocab.count() == len(n)
    counted = spark.createDataFrame(list(n.items()), "word string, n long")
    numbered = counted.coalesce(1).orderBy(F.desc("n"), "word").withColumn("id", F.monotonically_increasing_id())
    from gymlake.llm.common import stored
    held = stored(numbered.select("id", "word", "n"), "test-words")
    pairs = spelling.near_pairs(held).collect()
    word = {r["id"]: r["word"] for r in held.collect()}
    got = [frozenset((word[r["x"]], word[r["y"]])) for r in pairs]
    want = {frozenset((a, b)) for a in n for b in n if a < b and one_edit(a, b)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 200
    assert rows(spelling.variants(held), *VARIANT) == brute_variants(n)


def test_a_very_long_run_of_letters(spark):
    long = "ab" * 50_000
    df = spark.createDataFrame([(1, long), (2, long), (3, long + "x"), (4, long + "x")], "doc_id long, text string")
    got = rows(spelling.spelling_variants(df), "n", "n_near")
    assert got == Counter({(2, 1): 2})


# ---- 13 ---------------------------------------------------------------------------------

BLANK = re.compile("[\x20\x09-\x0D]")
WORD = re.compile("[^\x20\x09-\x0D]+")


def brute_rules(text):
    w = WORD.findall(text)
    windows = defaultdict(list)
    for i in range(len(w) - 4):
        windows[tuple(w[i:i + 5])].append(i)
    covered = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            len(w) < 10 or 100 * len(covered) > 20 * len(w))


RULE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_quality_rules_equal_brute_force(docs):
    got = quality_rules.quality_rules(docs).collect()
    assert Counter((r["doc_id"], *[r[c] for c in RULE]) for r in got) == Counter((d, *brute_rules(t)) for d, t in plain(docs))
    assert not any(r["kept"] and r["base_failed"] for r in got)
    current = quality_rules.mask_of(quality_rules.CURRENT)
    assert all(r["kept"] == (r["bits"] & current == 0) for r in got)


def test_registered_quality_rules_keep_clean_documents(spark):
    sf = "/root/testdata/sf0.01"
    judged = op13_quality_rules(spark, sf).join(load(spark, sf, "labels"), "doc_id").collect()
    clean = [r for r in judged if r["quality"] == 1 and not r["base_failed"]]
    junk = [r for r in judged if r["quality"] == 0]
    assert len(clean) > 100 and all(r["kept"] for r in clean)
    assert sum(r["kept"] for r in junk) <= 0.02 * len(junk)


@pytest.mark.parametrize("text", [
    "", " ", "a b c d e a b c d e", "a b c d e f g h", "x " * 30, "a b\nc\n\n \na b\na b \nc", "é" * 3 + " " + "\U0001f600 ü\x85ü\xa0",
    "one two three four five six one two three four five seven two three four five six", "\n\n\n", "<a> | b # & % $ *"])
@pytest.mark.parametrize("part", [1, 7, 1 << 20])
def test_counts_of_a_text_in_parts(text, part):
    got = dict(zip(quality_rules.COUNTS, quality_rules.counts(text.encode(), part)))
    want = brute_rules(text)
    assert tuple(got[c] for c in RULE[:-1]) == want[:-1]
    w = WORD.findall(text)
    assert got["n_echo_words"] == sum(a == b for a, b in zip(w, w[1:]))
    assert got["longest_word"] == max((len(x.encode()) for x in w), default=0) and got["n_chars"] == len(text)


def test_windows_with_colliding_hashes_are_compared_by_words():
    text = b"a b c d e f g h a b c d e"
    assert quality_rules.repeated_words(text, np.zeros(13, np.uint64)) == 10
    assert quality_rules.repeated_words(b"a b c d e f g", np.zeros(7, np.uint64)) == 0


def test_parts_cut_behind_blanks_only():
    text = b"aaaa bb  c\nddddddddd e"
    for most in range(1, 25):
        pieces = list(quality_rules.parts(text, most))
        assert b"".join(pieces) == text and [w for p in pieces for w in p.split()] == text.split()


def test_ablation_equals_counting_rows(edges):
    held = quality_rules.ledger(edges)
    bits = [r["bits"] for r in held.collect()]
    at = {name: 1 << k for k, (name, _) in enumerate(quality_rules.RULES)}
    want = Counter()
    for p in quality_rules.POLICIES:
        mask = quality_rules.mask_of(p)
        for r in p.rules:
            want[(p.version, r, sum(b & mask != 0 for b in bits), sum(b & at[r] != 0 for b in bits),
                  sum(b & mask == at[r] for b in bits))] += 1
    assert rows(quality_rules.ablation(held), "version", "rule", "dropped", "fails", "alone") == want


def test_ablation_of_nothing_has_every_rule(nothing):
    got = quality_rules.ablation(quality_rules.ledger(nothing)).collect()
    assert len(got) == sum(len(p.rules) for p in quality_rules.POLICIES)
    assert {(r["dropped"], r["fails"], r["alone"]) for r in got} == {(0, 0, 0)}


def test_a_new_policy_needs_no_new_reading(edges):
    held = quality_rules.ledger(edges)
    strict = quality_rules.Policy("strict", tuple(name for name, _ in quality_rules.RULES))
    got = quality_rules.judge(held, (strict,)).collect()
    assert all(r["kept_strict"] == (r["bits"] == 0) for r in got)
    with pytest.raises(ValueError, match="unknown"):
        quality_rules.mask_of(quality_rules.Policy("typo", ("few_wrods",)))
