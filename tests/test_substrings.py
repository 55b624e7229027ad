"""Substring search by q-grams against plain Python, with terms of every kind."""

import random
import re

import pytest
from pyspark.sql import functions as F

from gymlake.operators import substrings as ss
from gymlake.sources.keyed import KeyedTable, fresh_path


def like(term, text):
    parts = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in term.lower())
    return text is not None and re.search(parts, text.lower(), re.S) is not None


def random_rows(rnd, n):
    word = lambda k: "".join(rnd.choice("abÄß0# ") for _ in range(rnd.randrange(k)))
    return [(i, rnd.choice([None, word(14)]), rnd.choice([None, "", word(9).upper()])) for i in range(n)]


TERMS = ["a", "ab", "AB", "aba", "abab", "", "%", "_", "__________", "a%b", "a_b", "%%ab%", "ß", "ä0", "zzz", "#", " ", None, "ab", "0%0%0"]


@pytest.fixture(scope="module")
def people(spark):
    rows = random_rows(random.Random(1), 300)
    return rows, spark.createDataFrame(rows, "id int, name string, email string")


def wanted(rows):
    return sorted((t, i) for t in {*TERMS} - {None} for i, a, b in rows if like(t, a) or like(t, b))


def test_terms_find_all_their_rows(spark, people):
    rows, df = people
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    out = ss.search_terms(terms, df, "id", ["name", "email"])
    assert sorted((r.term, r.id) for r in out.collect()) == wanted(rows)
    stored = ss.store_index(ss.gram_index(df, "id", ["name", "email"]), fresh_path(spark, "g"), 8)
    again = ss.search_terms(terms, df, "id", ["name", "email"], stored.read())
    assert sorted((r.term, r.id) for r in again.collect()) == wanted(rows)


def test_terms_are_looked_up_by_their_longest_and_rarest_grams(spark):
    rows = spark.createDataFrame([(i, f"abc{i % 7} xyz{i}") for i in range(50)], "id int, name string")
    terms = spark.createDataFrame([("abc3",), ("yz4",), ("b",), ("nothing",), ("x%c2",), ("%",)], "term string")
    grams = {r.term: r.gram for r in ss.probes(terms, "term", ss.gram_index(rows, "id", ["name"])).collect()}
    assert grams == {"abc3": "bc3", "yz4": "yz4", "b": "b", "x%c2": "c2", "%": ""}  # 'nothing' is in no row


def test_suggestions_need_two_characters(spark, people):
    rows, df = people
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    out = ss.suggest_terms(terms, df, "id", ["name", "email"], [F.col("id")], 3)
    first = {}
    for t, i in wanted(rows):
        if len(t) >= 2 and len(first.setdefault(t, [])) < 3:
            first[t].append(i)
    assert sorted((r.term, r.id) for r in out.collect()) == sorted((t, i) for t, ids in first.items() for i in ids)


def test_a_search_reads_the_buckets_of_its_grams(spark, people):
    _, df = people
    stored = ss.store_index(ss.gram_index(df, "id", ["name", "email"]), fresh_path(spark, "g"), 64)
    grams = ss.term_grams(spark.createDataFrame([("aba",)], "term string"), "term")
    buckets = stored.touched(grams)
    assert len(buckets) == 1
    out = ss.search_terms(spark.createDataFrame([("aba",)], "term string"), df, "id", ["name", "email"], stored.read(buckets))
    assert sorted(r.id for r in out.collect()) == sorted(r[0] for r in people[0] if like("aba", r[1]) or like("aba", r[2]))
    assert isinstance(stored, KeyedTable)


def test_first_hit_of_a_food_list_in_both_directions(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcD_%") for _ in range(rnd.randrange(6)))
    foods = [(i, rnd.choice([word(), word(), None])) for i in range(30)] + [(90, "Rice"), (91, "rice"), (50, "RICE")]
    labels = [word() for _ in range(60)] + [None, None, "", "brown rice bowl", "ric", "nothing like it"]
    out = ss.first_hits(spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "row int, label string"),
                        spark.createDataFrame(foods, "food_id int, food_name string")).collect()
    assert sorted(r.row for r in out) == list(range(len(labels)))
    for r in out:
        low = r.label and r.label.lower() if r.label is not None else None
        hits = [] if low is None else [(i, f) for i, f in foods if f is not None and (f.lower() in low or low in f.lower())]
        assert (r.food_id, r.food_name) == (min(hits) if hits else (None, None)), r


def test_empty_tables(spark):
    rows, terms = spark.createDataFrame([], "id int, name string"), spark.createDataFrame([], "term string")
    one = spark.createDataFrame([("a",)], "term string")
    assert ss.search_terms(one, rows, "id", ["name"]).count() == ss.search_terms(terms, rows, "id", ["name"]).count() == 0
    assert ss.first_hits(one.withColumnRenamed("term", "label"), spark.createDataFrame([], "food_id int, food_name string")).count() == 1
