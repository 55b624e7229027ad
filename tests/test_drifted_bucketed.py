"""Documents that drift in type (VARIANT) and raw tables stored in buckets."""

import json
import re

import pytest
from pyspark.sql import functions as F

from gymlake.functions.variant_docs import from_drifted_json, read_drifted_lines, with_drifted_json
from gymlake.operators import foods as fd
from gymlake.operators import meal_plans as mp
from gymlake.operators import nutrition as nu
from gymlake.plans import q_bucketed, q_nutrition
from gymlake.sources import bucketed
from gymlake.sources.keyed import fresh_path
from gymlake.sources.tables import Tables
from test_plans import plan_text


def _docs(spark, texts, schema):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(texts)], "i int, doc string")
    rows = df.select("i", from_drifted_json("doc", schema).alias("d")).orderBy("i").collect()
    return [r.d.asDict(recursive=True) if r.d is not None else None for r in rows]


def test_a_field_of_another_type_is_null_alone(spark):
    text = json.dumps({"fdcId": "F", "description": 12, "brandOwner": {"a": 1}, "foodNutrients": [
        None, 7, "x", {"nutrient": {"id": "1003"}, "amount": "12.5"}, {"nutrient": {"id": 1004}, "amount": []},
        {"nutrient": 3, "amount": 1}]})
    (got,) = _docs(spark, [text], fd.DETAIL_SCHEMA)
    assert got == {"fdcId": None, "description": "12", "brandOwner": None, "foodCategory": None, "foodNutrients": [
        None, None, None, {"nutrient": {"id": 1003, "name": None}, "amount": 12.5},
        {"nutrient": {"id": 1004, "name": None}, "amount": None}, {"nutrient": None, "amount": 1.0}]}


@pytest.mark.parametrize("text", [None, "", "  ", "nope", '{"description": "cut', "[]", "7", "null",
                                  '{"description": "a", "description": "b"}'])
def test_what_is_no_document_is_null(spark, text):
    assert _docs(spark, [text], fd.DETAIL_SCHEMA) == [None]


def test_scalars(spark):
    schema = "struct<s:string, n:int, x:double, b:boolean, `odd \"name\".[0]`:string>"
    texts = ['{"s": true, "n": "7", "x": "1e3", "b": "true", "odd \\"name\\".[0]": "here"}',
             '{"s": 1.50, "n": 3000000000, "x": "NaN", "b": 2}', '{"s": null, "n": null, "x": "Infinity"}',
             '{"s": "", "n": "", "x": "1 kg"}']
    odd = 'odd "name".[0]'
    assert _docs(spark, texts, schema) == [
        {"s": "true", "n": 7, "x": 1000.0, "b": True, odd: "here"},
        {"s": "1.5", "n": None, "x": None, "b": True, odd: None},
        {"s": None, "n": None, "x": None, "b": None, odd: None},
        {"s": "", "n": None, "x": None, "b": None, odd: None}]


def test_neighbours_of_a_drifted_nutrient_survive(spark):
    text = json.dumps({"description": "soup", "foodNutrients": [
        {"nutrient": {"id": "203"}, "amount": 4}, {"nutrient": {"id": 204}, "amount": "2"},
        {"nutrient": {"id": 205}, "amount": {"g": 9}}]})
    df = spark.createDataFrame([(1, text)], "doc_id int, detail_json string")
    new = fd.flatten_food_nutrients(with_drifted_json(df, "detail_json", fd.DETAIL_SCHEMA)).first()
    assert (new.protein, new.fat, new.carbs, new.calories) == (4, 2, 0, 34)
    assert fd.flatten_food_nutrients(df).first().protein == 0  # one schema for the whole document loses it


def test_fitting_documents_read_alike_both_ways(spark, tables):
    docs = tables.food_docs
    for operator, col, schema, keep in ((fd.flatten_food_nutrients, "detail_json", fd.DETAIL_SCHEMA, ["doc_id"]),
                                        (fd.best_food_match, "search_json", fd.SEARCH_SCHEMA, ["doc_id"]),
                                        (fd.flatten_products, "product_json", fd.PRODUCT_SCHEMA, ["doc_id", "barcode"])):
        text = docs.select(*keep, col)
        plain, drifted = operator(text), operator(with_drifted_json(text, col, schema))
        assert plain.count() > 0 and plain.exceptAll(drifted).isEmpty() and drifted.exceptAll(plain).isEmpty()


def test_plans_keep_their_other_meals(spark):
    plan = {"meal_plan": {"d1": {"lunch": {"name": 5, "ingredients": "rice", "nutrition": {"calories": "high", "protein": "9"}},
                                 "dinner": {"name": "Soup", "ingredients": ["peas", {"x": 1}], "nutrition": [1]}},
                          "d2": 7, "d3": []}, "shopping_list": {"a": 1}}
    df = spark.createDataFrame([(1, 2, json.dumps(plan)), (2, 2, None)], "id int, member_id int, plan_data string")
    docs = with_drifted_json(df, "plan_data", mp.PLAN_SCHEMA)
    got = {(r.day, r.meal, r.meal_name, r.calories, r.protein, r.ingredient) for r in mp.explode_plan(docs).collect()}
    assert got == {("d1", "lunch", "5", None, 9.0, None), ("d1", "dinner", "Soup", None, None, "peas"),
                   ("d1", "dinner", "Soup", None, None, None)}
    assert mp.shopping_list(docs).count() == 0


def test_lines(spark):
    path = fresh_path(spark, "lines")
    spark.createDataFrame([('{"description": "a"}',), ("",), ("broken",), ('{"description": ["b"]}',)], "v string").write.text(path)
    got = [r.doc and r.doc.description for r in read_drifted_lines(spark, path, fd.DETAIL_SCHEMA).collect()]
    assert sorted(got, key=str) == [None, None, "a"]
    assert read_drifted_lines(spark, path, fd.DETAIL_SCHEMA).filter(F.col("doc").isNull()).count() == 1


# ---------------------------------------------------------------- buckets
@pytest.fixture(scope="module")
def stored(spark):
    return bucketed.store_raw(Tables(spark, "/root/testdata/sf0.001"), q_bucketed.LOG_COLUMNS)


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def _below_fact_join(plan: str) -> list[str]:
    """The lines under the join on the order id."""
    lines = plan.splitlines()
    at = next(i for i, ln in enumerate(lines) if "SortMergeJoin [l_orderkey" in ln)
    depth = len(re.match(r"[\s:|+\-]*", lines[at]).group())
    out = []
    for ln in lines[at + 1:]:
        if len(re.match(r"[\s:|+\-]*", ln).group()) <= depth:
            break
        out.append(ln)
    return out


def test_fact_joins_do_not_shuffle(spark, tables, stored, no_broadcast):
    t = bucketed.BucketedTables(spark, "/root/testdata/sf0.001", stored)
    for logs, shuffled in ((t.nutrition_logs, False), (tables.nutrition_logs, True)):
        for report in (nu.daily_nutrition(logs),
                       nu.nutrition_analytics(tables.members, tables.member_coach, logs, "all", q_nutrition.AS_OF)):
            below = _below_fact_join(plan_text(report))
            assert below and any("Exchange" in ln for ln in below) == shuffled, "\n".join(below)


def test_another_session_attaches_the_stored_tables(spark, tables, stored, no_broadcast):
    other = spark.newSession()
    moved = {k: bucketed.BucketedTable(f"again_{k}", v.path, v.key, v.buckets, v.columns) for k, v in stored.items()}
    t = bucketed.BucketedTables(other, "/root/testdata/sf0.001", moved)
    other.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    assert not any("Exchange" in ln for ln in _below_fact_join(plan_text(nu.daily_nutrition(t.nutrition_logs))))
    want = nu.daily_nutrition(tables.nutrition_logs).collect()
    assert sorted(map(str, nu.daily_nutrition(t.nutrition_logs).collect())) == sorted(map(str, want))


def test_null_repeated_and_hot_keys_and_empty_tables(spark):
    rows = [(None, 1), (None, 1), (7, 2)] + [(3, i % 2) for i in range(50)]
    df = spark.createDataFrame(rows, "k bigint, v int")
    got = bucketed.attach(spark, bucketed.store(df, "odd", "k", 4))
    assert sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    empty = bucketed.attach(spark, bucketed.store(df.limit(0), "none", "k", 4))
    assert empty.count() == 0 and empty.columns == ["k", "v"]


def test_bucket_count():
    assert bucketed.bucket_count(0) == 8
    assert bucketed.bucket_count(8 * bucketed.ROWS_PER_BUCKET) == 8
    assert bucketed.bucket_count(8 * bucketed.ROWS_PER_BUCKET + 1) == 16
