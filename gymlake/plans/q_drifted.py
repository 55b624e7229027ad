"""Registered queries: documents whose fields drift in type, read through VARIANT."""

from __future__ import annotations

from pyspark.sql import functions as F

from gymlake.functions.variant_docs import read_drifted_lines, with_drifted_json
from gymlake.operators import foods as fd
from gymlake.operators import meal_plans as mp
from gymlake.plans.catalog import register
from gymlake.sources.keyed import fresh_path


def _text(doc: str, path: str) -> str:
    """A scalar as text; an object or list is NULL."""
    return (f"CASE WHEN json_type({doc}, '{path}') IN ('OBJECT', 'ARRAY') THEN NULL "
            f"ELSE json_extract_string({doc}, '{path}') END")


def _number(doc: str, path: str, kind: str = "DOUBLE") -> str:
    return f"TRY_CAST({_text(doc, path)} AS {kind})"


def _valid(col: str) -> str:
    return f"CASE WHEN json_valid({col}) THEN CAST({col} AS JSON) END"


def _list(doc: str, path: str) -> str:
    """The elements of a list; none where the field is no list."""
    return (f"CASE WHEN json_type({doc}, '{path}') = 'ARRAY' THEN json_extract({doc}, '{path}[*]') "
            "ELSE CAST([] AS JSON[]) END")


def _amount(ids) -> str:
    wanted = ", ".join(str(i) for i in ids)
    return (f"COALESCE(CAST(round_even(COALESCE(list_filter(items, lambda x: x.id IN ({wanted}))[-1].amount, 0.0), 0) "
            "AS BIGINT), 0)")


_DRIFTED_DETAIL = f"""
d AS (SELECT doc_id, {_valid('detail_json')} AS doc FROM drifted_food_docs),
n AS (SELECT doc_id, doc, list_transform({_list('doc', '$.foodNutrients')},
               lambda x: {{'id': {_number('x', '$.nutrient.id', 'INTEGER')}, 'amount': {_number('x', '$.amount')}}}) AS items FROM d),
v AS (SELECT doc_id, {_number('doc', '$.fdcId', 'BIGINT')} AS fdc_id, COALESCE({_text('doc', '$.description')}, '') AS food_name,
             COALESCE({_text('doc', '$.brandOwner')}, '') AS brand, COALESCE({_text('doc', '$.foodCategory')}, '') AS category,
             {', '.join(f'{_amount(ids)} AS {k}' for k, ids in fd.NUTRIENT_IDS.items())} FROM n)"""
_STATED = ("REPLACE (CASE WHEN calories = 0 THEN CAST(round_even(protein * 4 + carbs * 4 + fat * 9, 0) AS BIGINT) "
           "ELSE calories END AS calories)")


@register("drifted_food_nutrients", f"WITH {_DRIFTED_DETAIL}\nSELECT * {_STATED} FROM v",
          ["drifted_food_docs"], "X14 F22")
def _drifted_food_nutrients(t):
    docs = with_drifted_json(t.drifted_food_docs.select("doc_id", "detail_json"), "detail_json", fd.DETAIL_SCHEMA)
    return fd.flatten_food_nutrients(docs)


@register("drifted_food_lines", f"WITH {_DRIFTED_DETAIL}\nSELECT * EXCLUDE (doc_id) {_STATED} FROM v",
          ["drifted_food_docs"], "S5 X14")
def _drifted_food_lines(t):
    # the documents as JSON lines in the shared folder, malformed ones among them
    path = fresh_path(t.spark, "drifted-lines")
    t.drifted_food_docs.select("detail_json").write.text(path)
    return fd.flatten_food_nutrients(read_drifted_lines(t.spark, path, fd.DETAIL_SCHEMA), "doc")


def _nutrient(food: str, name: str) -> str:
    return f"list_filter({food}.items, lambda y: y.id = {fd.SEARCH_NUTRIENT_IDS[name]})[-1].value"


@register("drifted_food_match", f"""
WITH d AS (SELECT doc_id, {_valid('search_json')} AS doc FROM drifted_food_docs),
f AS (SELECT doc_id, list_transform(list_filter({_list('doc', '$.foods')}, lambda x: json_type(x) = 'OBJECT'),
        lambda x: {{'fdc_id': {_number('x', '$.fdcId', 'BIGINT')}, 'food_name': {_text('x', '$.description')},
                    'brand': {_text('x', '$.brandOwner')},
                    'items': list_transform({_list('x', '$.foodNutrients')},
                               lambda y: {{'id': {_number('y', '$.nutrientId', 'INTEGER')}, 'value': {_number('y', '$.value')}}})}})
        AS foods FROM d),
c AS (SELECT doc_id, foods, list_filter(foods, lambda x: COALESCE({_nutrient('x', 'calories')}, 0.0) <> 0
                                                   AND {_nutrient('x', 'protein')} IS NOT NULL) AS complete FROM f),
m AS (SELECT doc_id, COALESCE(complete[1], foods[1]) AS m, len(complete) > 0 AS whole FROM c)
SELECT doc_id, m.fdc_id AS fdc_id, m.food_name AS food_name, m.brand AS brand,
       {', '.join(f"COALESCE({_nutrient('m', k)}, 0.0) AS {k}" for k in ('calories', 'protein', 'carbs', 'fat'))},
       CASE WHEN m IS NULL THEN NULL WHEN whole THEN 'USDA' ELSE 'USDA (partial data)' END AS source
FROM m
""", ["drifted_food_docs"], "X15")
def _drifted_food_match(t):
    docs = with_drifted_json(t.drifted_food_docs.select("doc_id", "search_json"), "search_json", fd.SEARCH_SCHEMA)
    return fd.best_food_match(docs)


def _per_100g(key: str) -> str:
    path = f'$.product.nutriments."{key}"'
    return f"COALESCE({_number('doc', path)}, 0.0)"


@register("drifted_products", f"""
WITH d AS (SELECT doc_id, barcode, {_valid('product_json')} AS doc FROM drifted_food_docs)
SELECT doc_id, barcode, COALESCE({_text('doc', '$.product.product_name')}, 'Unknown') AS name,
       COALESCE({_text('doc', '$.product.brands')}, '') AS brand, {_per_100g('energy-kcal_100g')} AS calories_per_100g,
       {_per_100g('proteins_100g')} AS protein_per_100g, {_per_100g('carbohydrates_100g')} AS carbs_per_100g,
       {_per_100g('fat_100g')} AS fat_per_100g, COALESCE({_text('doc', '$.product.image_url')}, '') AS image_url,
       barcode AS product_barcode, 'OpenFoodFacts' AS source
FROM d WHERE {_number('doc', '$.status', 'INTEGER')} = 1
""", ["drifted_food_docs"], "X16")
def _drifted_products(t):
    docs = with_drifted_json(t.drifted_food_docs.select("doc_id", "barcode", "product_json"), "product_json",
                             fd.PRODUCT_SCHEMA)
    return fd.flatten_products(docs)


def _entries(doc: str) -> str:
    """Keys of an object; none where it is no object."""
    return f"CASE WHEN json_type({doc}) = 'OBJECT' THEN json_keys({doc}) ELSE CAST([] AS VARCHAR[]) END"


_TEXTS = "list_transform({0}, lambda x: CASE WHEN json_type(x) IN ('OBJECT', 'ARRAY') THEN NULL ELSE json_extract_string(x, '$') END)"


@register("drifted_plan_meals", f"""
WITH d AS (SELECT id AS plan_id, member_id, json_extract({_valid('plan_data')}, '$.meal_plan') AS doc FROM drifted_plans),
days AS (SELECT plan_id, member_id, doc, unnest({_entries('doc')}) AS day FROM d),
dm AS (SELECT plan_id, member_id, day, json_extract(doc, '$."' || day || '"') AS meals FROM days),
meals AS (SELECT plan_id, member_id, day, meals, unnest({_entries('meals')}) AS meal FROM dm),
mm AS (SELECT plan_id, member_id, day, meal, json_extract(meals, '$."' || meal || '"') AS m FROM meals),
i AS (SELECT *, {_TEXTS.format(_list('m', '$.ingredients'))} AS ingredients FROM mm)
SELECT plan_id, member_id, day, meal, {_text('m', '$.name')} AS meal_name, {_number('m', '$.nutrition.calories')} AS calories,
       {_number('m', '$.nutrition.protein')} AS protein,
       unnest(CASE WHEN len(ingredients) = 0 THEN [NULL] ELSE ingredients END) AS ingredient
FROM i
""", ["drifted_plans"], "X20 F24")
def _drifted_plan_meals(t):
    return mp.explode_plan(with_drifted_json(t.drifted_plans, "plan_data", mp.PLAN_SCHEMA))


@register("drifted_shopping", f"""
WITH d AS (SELECT id AS plan_id, {_valid('plan_data')} AS doc FROM drifted_plans),
x AS (SELECT DISTINCT plan_id, unnest({_TEXTS.format(_list('doc', '$.shopping_list'))}) AS item FROM d)
SELECT plan_id, item FROM x WHERE item IS NOT NULL
""", ["drifted_plans"], "X20 F24 A25")
def _drifted_shopping(t):
    items = mp.shopping_list(with_drifted_json(t.drifted_plans, "plan_data", mp.PLAN_SCHEMA))
    return items.filter(F.col("item").isNotNull())
