"""Food documents, lookups and detections.

Food documents arrive as JSON text (one document per row).  Everything here
is evaluated with array higher-order functions inside the row -- no explode,
no shuffle -- so the cost is linear in the documents and each task streams.
The small fixed tables (estimates, keyword classes) are compiled into CASE
expressions instead of being joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gymlake.functions.nutrition_fx import calories_from_macros

# Estimated nutrition per 100 g, in lookup order (first match wins):
# name, calories, protein, carbs, fat.
ESTIMATES = [
    ("apple", 52, 0.3, 14, 0.2), ("banana", 89, 1.1, 23, 0.3), ("orange", 47, 0.9, 12, 0.1),
    ("bread", 265, 9, 49, 3.2), ("rice", 130, 2.7, 28, 0.3), ("chicken", 165, 31, 0, 3.6),
    ("beef", 250, 26, 0, 15), ("fish", 100, 20, 0, 2.5), ("pasta", 131, 5, 25, 1.1),
    ("pizza", 266, 11, 33, 10), ("salad", 20, 2, 4, 0.2), ("soup", 50, 3, 8, 1),
    ("sandwich", 300, 15, 35, 12), ("cake", 257, 4, 45, 8), ("cookie", 502, 6, 65, 24),
    ("ice cream", 207, 3.5, 24, 11), ("milk", 42, 3.4, 5, 1), ("cheese", 113, 7, 1, 9),
    ("egg", 155, 13, 1.1, 11), ("potato", 77, 2, 17, 0.1),
]
ESTIMATE_DEFAULT = (200, 8, 25, 8)

# Keyword classes of the fallback estimate, in check order:
# keywords, calories, protein, carbs, fat, fiber, confidence.
FALLBACK_CLASSES = [
    (("apple", "banana", "orange", "fruit"), 60, 1, 15, 0, 2, 0.3),
    (("chicken", "beef", "pork", "meat", "steak"), 250, 25, 0, 15, 0, 0.3),
    (("bread", "pasta", "rice", "grain"), 250, 8, 45, 2, 3, 0.3),
    (("vegetable", "broccoli", "carrot", "salad"), 30, 2, 6, 0, 2, 0.3),
]
FALLBACK_DEFAULT = (200, 8, 25, 8, 2, 0.2)

# Nutrient ids of the food database (both id schemes).
NUTRIENT_IDS = {
    "protein": (1003, 203), "fat": (1004, 204), "carbs": (1005, 205), "calories": (208,),
    "sugar": (2000, 269), "fiber": (291,), "sodium": (307,), "vitamin_c": (401,),
    "calcium": (301,), "iron": (303,),
}
SEARCH_NUTRIENT_IDS = {"protein": 203, "fat": 204, "carbs": 205, "calories": 208}

# Detector classes counted as food, keywords, and the confidence floor.
FOOD_CLASS_IDS = (39, 40, 41, 42, 43, 44, 45, 46, 47, 48, 49, 50, 51, 52, 53, 54, 55,
                  60, 68, 69, 70, 71, 72)
FOOD_KEYWORDS = ("food", "meal", "dish", "plate", "bowl", "cup", "glass", "bottle",
                 "fork", "knife", "spoon", "utensil", "table", "kitchen",
                 "fruit", "vegetable", "meat", "bread", "rice", "pasta",
                 "soup", "salad", "dessert", "drink", "beverage")
MIN_CONFIDENCE = 0.25

DETAIL_SCHEMA = ("struct<fdcId:bigint, description:string, brandOwner:string, foodCategory:string, "
                 "foodNutrients:array<struct<nutrient:struct<id:int, name:string>, amount:double>>>")
SEARCH_SCHEMA = ("struct<foods:array<struct<fdcId:bigint, description:string, brandOwner:string, "
                 "foodCategory:string, foodNutrients:array<struct<nutrientId:int, value:double>>>>>")
# only the needed nutriments: documents also hold text values among them
_NUTRIMENTS = ("struct<`energy-kcal_100g`:string, proteins_100g:string, carbohydrates_100g:string, "
               "fat_100g:string>")
_PRODUCT = f"struct<product_name:string, brands:string, image_url:string, code:string, nutriments:{_NUTRIMENTS}>"
PRODUCT_SCHEMA = f"struct<status:int, product:{_PRODUCT}, products:array<{_PRODUCT}>>"
DETECTIONS_SCHEMA = ("array<struct<name:string, confidence:double, class_id:int, is_food:boolean, "
                     "box:struct<x1:double, y1:double, x2:double, y2:double>>>")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------- J20
def estimate_nutrition(name) -> Column:
    """First estimate whose name is contained in the label or contains it
    (case-insensitive), else the default; ``source`` says which."""
    low = F.lower(_c(name))
    idx = None
    for i, (food, *_rest) in enumerate(ESTIMATES):
        cond = low.contains(food) | F.lit(food).contains(low)
        idx = F.when(cond, F.lit(i)) if idx is None else idx.when(cond, F.lit(i))

    # one entry per food and the default last: the search is evaluated once, and its
    # result picks the whole entry
    def entry(values, source):
        return F.struct(*[F.lit(float(v)).alias(k) for k, v in zip(("calories", "protein", "carbs", "fat"), values)],
                        F.lit(source).alias("source"))

    entries = F.array(*[entry(e[1:5], "Estimated") for e in ESTIMATES], entry(ESTIMATE_DEFAULT, "Estimated (default)"))
    return F.element_at(entries, F.coalesce(idx, F.lit(len(ESTIMATES))) + 1)


# ---------------------------------------------------------------- F23
def fallback_nutrition(name) -> Column:
    """keyword class estimate with confidence (0.3 for a class, 0.2 default)."""
    low = F.lower(_c(name))
    fields = ("calories", "protein", "carbs", "fat", "fiber", "confidence")
    out = []
    for j, field in enumerate(fields):
        expr = None
        for words, *vals in FALLBACK_CLASSES:
            cond = None
            for w in words:
                c = low.contains(w)
                cond = c if cond is None else (cond | c)
            expr = F.when(cond, F.lit(float(vals[j]))) if expr is None else expr.when(cond, F.lit(float(vals[j])))
        out.append(expr.otherwise(F.lit(float(FALLBACK_DEFAULT[j]))).alias(field))
    return F.struct(_c(name).alias("name"), *out)


# ---------------------------------------------------------------- X14
def document(df: DataFrame, json_col: str, schema: str) -> Column:
    """The parsed document of a column: JSON text is parsed, a column that a source or
    ``with_drifted_json`` has parsed already is taken as it is."""
    if isinstance(df.schema[json_col].dataType, T.StructType):
        return F.col(json_col)
    return F.from_json(F.col(json_col), schema)


def flatten_food_nutrients(df: DataFrame, json_col: str = "detail_json") -> DataFrame:
    """Food detail document -> one row of integer nutrients (half-even
    rounding; a later entry for the same field wins, across both id schemes);
    calories fall back to 4/4/9 from macros when missing or 0."""
    # The parsed document, its nutrient array and each field's last hit are projected
    # as their own columns: referenced several times, they are computed once per row
    # (inline, every output field would re-parse the JSON and re-filter the array).
    d = df.withColumn("_doc", document(df, json_col, DETAIL_SCHEMA))
    d = d.withColumn("_items", F.coalesce(F.col("_doc.foodNutrients"), F.array()))
    def last_hit(ids):
        return F.try_element_at(F.filter("_items", lambda n: n["nutrient"]["id"].isin(*ids)), F.lit(-1))

    d = d.select("*", *[last_hit(ids).alias(f"_hit_{f}") for f, ids in NUTRIENT_IDS.items()])

    def val(field):
        hit = F.col(f"_hit_{field}")
        v = F.when(hit.isNotNull(), F.coalesce(hit["amount"], F.lit(0.0)))
        return F.coalesce(F.bround(v, 0).cast("long"), F.lit(0).cast("long"))

    base = d.select(*df.columns, F.col("_doc.fdcId").alias("fdc_id"),
                    F.coalesce(F.col("_doc.description"), F.lit("")).alias("food_name"),
                    F.coalesce(F.col("_doc.brandOwner"), F.lit("")).alias("brand"),
                    F.coalesce(F.col("_doc.foodCategory"), F.lit("")).alias("category"),
                    *[val(f).alias(f) for f in NUTRIENT_IDS])
    stated = calories_from_macros("calories", "protein", "carbs", "fat")
    return base.withColumn("calories", F.bround(stated, 0).cast("long")).drop(json_col)


# ---------------------------------------------------------------- X15
def best_food_match(df: DataFrame, json_col: str = "search_json") -> DataFrame:
    """From a search result, the first food with calories and protein, else
    the first food (``source`` marks partial data); no foods -> NULL match."""
    keep = [c for c in df.columns if c != json_col]
    listed = F.coalesce(document(df, json_col, SEARCH_SCHEMA)["foods"], F.array())

    def nutr(food, field):
        hits = F.filter(food["foodNutrients"], lambda n: n["nutrientId"] == SEARCH_NUTRIENT_IDS[field])
        return F.try_element_at(hits, F.lit(-1))["value"]

    # each food's values are looked up once; the list and its complete subset are columns of their own
    fields = ("calories", "protein", "carbs", "fat")
    d = df.select(*keep, F.filter(listed, lambda f: f.isNotNull()).alias("_listed"))  # entries that are no food go
    d = d.select(*keep, F.transform("_listed", lambda f: F.struct(
        f["fdcId"].alias("fdc_id"), f["description"].alias("food_name"), f["brandOwner"].alias("brand"),
        *[nutr(f, k).alias(k) for k in fields])).alias("_foods"))
    d = d.withColumn("_cmp", F.filter("_foods", lambda f: (F.coalesce(f["calories"], F.lit(0.0)) != 0) & f["protein"].isNotNull()))
    chosen = F.coalesce(F.try_element_at("_cmp", F.lit(1)), F.try_element_at("_foods", F.lit(1)))
    out = d.select(*keep, chosen.alias("_f"), (F.size("_cmp") > 0).alias("_complete"))
    return out.select(
        *keep, "_f.fdc_id", "_f.food_name", "_f.brand",
        *[F.coalesce(f"_f.{k}", F.lit(0.0)).alias(k) for k in fields],
        F.when(F.col("_f").isNull(), F.lit(None).cast("string"))
         .when(F.col("_complete"), F.lit("USDA")).otherwise(F.lit("USDA (partial data)")).alias("source"))


# ---------------------------------------------------------------- X16
def flatten_products(df: DataFrame, json_col: str = "product_json",
                     barcode_col: str = "barcode") -> DataFrame:
    """Product document (barcode shape or search shape) -> one row per product
    with per-100 g nutriments (missing -> 0); a barcode miss (status != 1) -> no row."""
    keep = [c for c in df.columns if c != json_col]
    d = df.withColumn("_doc", document(df, json_col, PRODUCT_SCHEMA))  # parsed once per row
    doc = F.col("_doc")
    single = F.when(doc["status"] == 1, F.array(doc["product"].withField("code", F.col(barcode_col))))
    prods = F.coalesce(single, doc["products"], F.array())
    ex = d.select(*keep, F.explode(prods).alias("p"))

    def nm(k):  # a number, or text that holds one; else 0
        return F.coalesce(F.col("p.nutriments")[k].try_cast("double"), F.lit(0.0))

    return ex.select(*keep, F.coalesce("p.product_name", F.lit("Unknown")).alias("name"),
                     F.coalesce("p.brands", F.lit("")).alias("brand"),
                     nm("energy-kcal_100g").alias("calories_per_100g"),
                     nm("proteins_100g").alias("protein_per_100g"),
                     nm("carbohydrates_100g").alias("carbs_per_100g"),
                     nm("fat_100g").alias("fat_per_100g"),
                     F.coalesce("p.image_url", F.lit("")).alias("image_url"),
                     F.coalesce("p.code", F.lit("")).alias("product_barcode"),
                     F.lit("OpenFoodFacts").alias("source"))


# ---------------------------------------------------------------- P19
def filter_food_detections(df: DataFrame, json_col: str = "detections",
                           min_conf: float = MIN_CONFIDENCE) -> DataFrame:
    """Keep detections above the confidence floor whose class id is a food
    class or whose name has a food keyword."""
    dets = F.coalesce(F.from_json(F.col(json_col), DETECTIONS_SCHEMA), F.array())
    kw = lambda d: F.lower(d["name"]).rlike("|".join(FOOD_KEYWORDS))
    is_food = lambda d: d["class_id"].isin(*FOOD_CLASS_IDS) | F.coalesce(kw(d), F.lit(False))
    foods = F.filter(dets, lambda d: (d["confidence"] >= min_conf) & is_food(d))
    keep = [c for c in df.columns if c != json_col]
    # the filtered list is its own column, so the count reuses it
    return (df.select(*keep, foods.alias("food_detections"))
            .withColumn("total_food_items", F.size("food_detections")))


# ---------------------------------------------------------------- F25
def softmax_topk(df: DataFrame, logits: str, k: int = 3, labels=None,
                 out: str = "top") -> DataFrame:
    """softmax over a logits array; adds ``out`` = the top ``k`` (probability
    desc, then index) as array<struct(label_id, label, confidence)>.

    Higher-order functions are interpreted, and an outer expression captured by a
    lambda body is re-evaluated for every element (Catalyst may also inline a
    projected helper column back into the body), so a one-pass softmax is cubic
    in the array length.  Per-row values therefore reach lambdas only as
    arguments -- ``zip_with`` over ``array_repeat`` -- which are evaluated once per
    row.  Ranking uses the unnormalised ``exp(v - max)`` (dividing by the positive
    row sum keeps the order and the ties); only the ``k`` survivors are divided."""
    d = df.withColumn("_x", F.transform(F.col(logits), lambda v: v.cast("double")))
    rep = lambda value, like: F.array_repeat(value, F.size(like))
    d = d.withColumn("_e", F.zip_with("_x", rep(F.array_max("_x"), "_x"), lambda v, m: F.exp(v - m)))
    s = F.aggregate("_e", F.lit(0.0), lambda acc, v: acc + v)
    ranked = F.transform("_e", lambda e, i: F.struct(e.alias("e"), (-i).alias("neg_i")))
    d = d.withColumn("_top", F.slice(F.sort_array(ranked, asc=False), 1, k))
    lab = (lambda i: F.element_at(F.array(*[F.lit(x) for x in labels]), i + 1)) if labels else \
        (lambda i: F.concat(F.lit("class_"), i.cast("string")))
    res = F.zip_with("_top", rep(s, "_top"),
                     lambda t, tot: F.struct((-t["neg_i"]).alias("label_id"),
                                             lab(-t["neg_i"]).alias("label"),
                                             (t["e"] / tot).alias("confidence")))
    return d.withColumn(out, res).drop("_x", "_e", "_top")


def resolve_nutrition(labels: DataFrame, foods: DataFrame, name_col: str = "name") -> DataFrame:
    """Catalogue match on the lower-cased name, else the J20 estimate, with a
    ``method`` column.  The catalogue side is de-duplicated per name first."""
    cat = (foods.select(F.lower("name").alias("_k"), F.col("id").alias("food_item_id"),
                        F.col("calories_per_100g").cast("double").alias("_cal"),
                        F.col("protein_per_100g").cast("double").alias("_pro"))
           .groupBy("_k").agg(F.min_by(F.struct("food_item_id", "_cal", "_pro"), "food_item_id")
                               .alias("_m")))
    j = labels.withColumn("_k", F.lower(name_col)).join(cat, "_k", "left")
    j = j.withColumn("_est", estimate_nutrition(F.col(name_col)))  # searched once per row
    est = F.col("_est")
    return j.select(*[c for c in labels.columns],
                    F.col("_m.food_item_id").alias("food_item_id"),
                    F.coalesce(F.col("_m._cal"), est["calories"]).alias("calories"),
                    F.coalesce(F.col("_m._pro"), est["protein"]).alias("protein"),
                    F.when(F.col("_m").isNotNull(), F.lit("database")).otherwise(est["source"])
                    .alias("method"))
