"""Registered queries: food documents, estimates, detections and classifier scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from gymlake.operators import foods as fd
from gymlake.plans.catalog import register
from gymlake.plans.sqltext import q


def _estimate_idx(expr: str) -> str:
    low = f"lower({expr})"
    whens = " ".join(f"WHEN contains({low}, {q(n)}) OR contains({q(n)}, {low}) THEN {i + 1}"
                     for i, (n, *_r) in enumerate(fd.ESTIMATES))
    return f"CASE {whens} END"


def _estimate_value(idx: str, j: int) -> str:
    values = ", ".join(f"{float(e[j])}" for e in fd.ESTIMATES)
    return (f"CAST(CASE WHEN {idx} IS NULL THEN {float(fd.ESTIMATE_DEFAULT[j - 1])} "
            f"ELSE [{values}][{idx}] END AS DOUBLE)")


@register("estimate_nutrition", f"""
WITH n AS (SELECT id, name, {_estimate_idx('name')} AS idx FROM food_items)
SELECT id, name, {_estimate_value('idx', 1)} AS calories, {_estimate_value('idx', 2)} AS protein,
       {_estimate_value('idx', 3)} AS carbs, {_estimate_value('idx', 4)} AS fat,
       CASE WHEN idx IS NULL THEN 'Estimated (default)' ELSE 'Estimated' END AS source
FROM n
""", ["food_items"], "J20")
def _estimate_nutrition(t):
    e = t.food_items.select("id", "name", fd.estimate_nutrition(F.col("name")).alias("e"))  # searched once per row
    return e.select("id", "name", "e.*")


def _fallback_sql(expr: str, j: int) -> str:
    low = f"lower({expr})"
    whens = []
    for words, *vals in fd.FALLBACK_CLASSES:
        cond = " OR ".join(f"contains({low}, {q(w)})" for w in words)
        whens.append(f"WHEN {cond} THEN {float(vals[j])}")
    return f"CAST(CASE {' '.join(whens)} ELSE {float(fd.FALLBACK_DEFAULT[j])} END AS DOUBLE)"


@register("fallback_nutrition", f"""
SELECT id, name, {_fallback_sql('name', 0)} AS calories, {_fallback_sql('name', 1)} AS protein,
       {_fallback_sql('name', 2)} AS carbs, {_fallback_sql('name', 3)} AS fat,
       {_fallback_sql('name', 4)} AS fiber, {_fallback_sql('name', 5)} AS confidence
FROM (SELECT id, name FROM food_items
      UNION ALL
      SELECT id * 10 + 1, name || ' with rice' FROM food_items
      UNION ALL
      SELECT id * 10 + 2, 'grilled ' || category FROM food_items) x
""", ["food_items"], "F23")
def _fallback_nutrition(t):
    fi = t.food_items
    names = (fi.select("id", "name")
             .unionByName(fi.select((F.col("id") * 10 + 1).alias("id"),
                                    F.concat("name", F.lit(" with rice")).alias("name")))
             .unionByName(fi.select((F.col("id") * 10 + 2).alias("id"),
                                    F.concat(F.lit("grilled "), "category").alias("name"))))
    e = fd.fallback_nutrition(F.col("name"))
    return names.select("id", "name", *[e[k].alias(k) for k in
                                        ("calories", "protein", "carbs", "fat", "fiber", "confidence")])


_DETAIL = ('{"fdcId":"BIGINT","description":"VARCHAR","brandOwner":"VARCHAR","foodCategory":"VARCHAR",'
           '"foodNutrients":[{"nutrient":{"id":"INTEGER","name":"VARCHAR"},"amount":"DOUBLE"}]}')


def _nutrient(items: str, ids) -> str:
    idl = ", ".join(str(i) for i in ids)
    return (f"COALESCE(CAST(round_even(COALESCE(list_filter({items}, lambda x: x.nutrient.id IN ({idl}))[-1]"
            f".amount, 0.0), 0) AS BIGINT), 0)")


@register("flatten_food_nutrients", f"""
WITH d AS (SELECT doc_id, from_json(detail_json, '{_DETAIL}') AS doc FROM food_docs),
n AS (
  SELECT doc_id, doc.fdcId AS fdc_id, COALESCE(doc.description, '') AS food_name,
         COALESCE(doc.brandOwner, '') AS brand, COALESCE(doc.foodCategory, '') AS category,
         {', '.join(f"{_nutrient('COALESCE(doc.foodNutrients, [])', ids)} AS {k}"
                    for k, ids in fd.NUTRIENT_IDS.items())}
  FROM d)
SELECT * REPLACE (CASE WHEN calories = 0
                       THEN CAST(round_even(protein * 4 + carbs * 4 + fat * 9, 0) AS BIGINT)
                       ELSE calories END AS calories)
FROM n
""", ["food_docs"], "X14 F22")
def _flatten_food_nutrients(t):
    return fd.flatten_food_nutrients(t.food_docs.select("doc_id", "detail_json"))


_SEARCH = ('{"foods":[{"fdcId":"BIGINT","description":"VARCHAR","brandOwner":"VARCHAR",'
           '"foodCategory":"VARCHAR","foodNutrients":[{"nutrientId":"INTEGER","value":"DOUBLE"}]}]}')


def _sn(food: str, nid: int) -> str:
    return f"list_filter({food}.foodNutrients, lambda y: y.nutrientId = {nid})[-1].value"


@register("best_food_match", f"""
WITH d AS (SELECT doc_id, from_json(search_json, '{_SEARCH}').foods AS foods FROM food_docs),
f AS (SELECT doc_id, foods,
             list_filter(foods, lambda x: COALESCE({_sn('x', 208)}, 0.0) <> 0
                                          AND {_sn('x', 203)} IS NOT NULL) AS complete
      FROM d),
c AS (SELECT doc_id, COALESCE(complete[1], foods[1]) AS m, len(complete) > 0 AS is_complete FROM f)
SELECT doc_id, m.fdcId AS fdc_id, m.description AS food_name, m.brandOwner AS brand,
       COALESCE({_sn('m', 208)}, 0.0) AS calories, COALESCE({_sn('m', 203)}, 0.0) AS protein,
       COALESCE({_sn('m', 205)}, 0.0) AS carbs, COALESCE({_sn('m', 204)}, 0.0) AS fat,
       CASE WHEN m IS NULL THEN NULL WHEN is_complete THEN 'USDA' ELSE 'USDA (partial data)' END AS source
FROM c
""", ["food_docs"], "X15")
def _best_food_match(t):
    return fd.best_food_match(t.food_docs.select("doc_id", "search_json"))


_PRODUCT = ('{"status":"INTEGER","product":{"product_name":"VARCHAR","brands":"VARCHAR",'
            '"image_url":"VARCHAR","nutriments":{"energy-kcal_100g":"DOUBLE","proteins_100g":"DOUBLE",'
            '"carbohydrates_100g":"DOUBLE","fat_100g":"DOUBLE"}}}')


@register("flatten_products", f"""
WITH d AS (SELECT doc_id, barcode, from_json(product_json, '{_PRODUCT}') AS doc FROM food_docs)
SELECT doc_id, barcode, COALESCE(doc.product.product_name, 'Unknown') AS name,
       COALESCE(doc.product.brands, '') AS brand,
       COALESCE(doc.product.nutriments."energy-kcal_100g", 0.0) AS calories_per_100g,
       COALESCE(doc.product.nutriments.proteins_100g, 0.0) AS protein_per_100g,
       COALESCE(doc.product.nutriments.carbohydrates_100g, 0.0) AS carbs_per_100g,
       COALESCE(doc.product.nutriments.fat_100g, 0.0) AS fat_per_100g,
       COALESCE(doc.product.image_url, '') AS image_url, barcode AS product_barcode,
       'OpenFoodFacts' AS source
FROM d WHERE doc.status = 1
""", ["food_docs"], "X16")
def _flatten_products(t):
    return fd.flatten_products(t.food_docs.select("doc_id", "barcode", "product_json"))


_DETS = ('[{"name":"VARCHAR","confidence":"DOUBLE","class_id":"INTEGER","is_food":"BOOLEAN",'
         '"box":{"x1":"DOUBLE","y1":"DOUBLE","x2":"DOUBLE","y2":"DOUBLE"}}]')
_FOOD_IDS = ", ".join(str(i) for i in fd.FOOD_CLASS_IDS)
_KW = "|".join(fd.FOOD_KEYWORDS)


@register("filter_food_detections", f"""
WITH d AS (SELECT id, CASE WHEN json_valid(detections) THEN from_json(detections, '{_DETS}') END AS dets
           FROM detected_meals),
f AS (SELECT id, list_filter(COALESCE(dets, []), lambda x: x.confidence >= {fd.MIN_CONFIDENCE}
              AND (x.class_id IN ({_FOOD_IDS}) OR COALESCE(regexp_matches(lower(x.name), '{_KW}'), false)))
              AS foods FROM d)
SELECT id, CAST(len(foods) AS INTEGER) AS total_food_items,
       array_to_string(list_transform(foods, lambda x: x.name), '|') AS food_names
FROM f
""", ["detected_meals"], "P19 S4")
def _filter_food_detections(t):
    r = fd.filter_food_detections(t.detected_meals.select("id", "detections"))
    return r.select("id", "total_food_items",
                    F.array_join(F.transform("food_detections", lambda d: d["name"]), "|")
                    .alias("food_names"))


@register("softmax_topk", """
WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS l FROM embeddings),
m AS (SELECT vec_id, l, list_max(l) AS mx FROM x),
e AS (SELECT vec_id, list_transform(l, lambda v: exp(v - mx)) AS ex FROM m),
s AS (SELECT vec_id, ex, list_sum(ex) AS tot FROM e),
u AS (SELECT vec_id, unnest(list_transform(ex, lambda v, i: {'p': v / tot, 'i': i - 1})) AS r FROM s),
r AS (SELECT vec_id, CAST(r.i AS INTEGER) AS label_id, r.p AS p,
             CAST(row_number() OVER (PARTITION BY vec_id ORDER BY r.p DESC, r.i) AS INTEGER) AS rank FROM u)
SELECT vec_id, rank, label_id, 'class_' || CAST(label_id AS VARCHAR) AS label, round(p, 6) AS confidence
FROM r WHERE rank <= 3
""", ["embeddings"], "F25")
def _softmax_topk(t):
    top = fd.softmax_topk(t.embeddings.select("vec_id", "embedding"), "embedding", 3)
    # posexplode_outer + explicit filter: a plain posexplode makes Catalyst add a
    # size(top) > 0 pre-filter that evaluates the whole softmax a second time
    return (top.select("vec_id", F.posexplode_outer("top").alias("pos", "t"))
            .filter(F.col("pos").isNotNull())
            .select("vec_id", (F.col("pos") + 1).alias("rank"), F.col("t.label_id").alias("label_id"),
                    F.col("t.label").alias("label"), F.round("t.confidence", 6).alias("confidence")))


@register("resolve_nutrition", f"""
WITH d AS (SELECT CASE WHEN json_valid(detections) THEN from_json(detections, '{_DETS}') END AS dets
           FROM detected_meals),
labels AS (SELECT DISTINCT name FROM (
             SELECT unnest(COALESCE(dets, [])).name AS name FROM d
             UNION ALL SELECT name FROM food_items) z),
cat AS (SELECT lower(name) AS k, min(id) AS food_item_id,
               arg_min(CAST(calories_per_100g AS DOUBLE), id) AS cal,
               arg_min(CAST(protein_per_100g AS DOUBLE), id) AS pro
        FROM food_items GROUP BY lower(name)),
j AS (SELECT l.name, c.food_item_id, c.cal, c.pro, {_estimate_idx('l.name')} AS idx
      FROM labels l LEFT JOIN cat c ON c.k = lower(l.name))
SELECT name, food_item_id, COALESCE(cal, {_estimate_value('idx', 1)}) AS calories,
       COALESCE(pro, {_estimate_value('idx', 2)}) AS protein,
       CASE WHEN food_item_id IS NOT NULL THEN 'database'
            WHEN idx IS NULL THEN 'Estimated (default)' ELSE 'Estimated' END AS method
FROM j
""", ["detected_meals", "food_items"], "X42 J20")
def _resolve_nutrition(t):
    dets = F.coalesce(F.from_json("detections", fd.DETECTIONS_SCHEMA), F.array())
    names = (t.detected_meals.select(F.explode(dets).alias("d")).select(F.col("d.name").alias("name"))
             .unionByName(t.food_items.select("name")).distinct())
    return fd.resolve_nutrition(names, t.food_items)
