"""Registered queries: stored summaries that combine (ranges of distinct counts, streaks, running
totals) and deep pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from gymlake.functions.timeutil import lit_date
from gymlake.operators import nutrition as nu
from gymlake.operators import rollups as ru
from gymlake.operators import substrings as ss
from gymlake.operators.filters import RANGE_DAYS
from gymlake.operators.ordering import deep_page
from gymlake.plans.catalog import register
from gymlake.sources.fixtures import NUTRITION_AS_OF, SESSION_AS_OF
from gymlake.sources.keyed import KeyedTable, fresh_path

D, ND = f"DATE '{SESSION_AS_OF}'", f"DATE '{NUTRITION_AS_OF}'"
# Days from here on reach the stored tables as an update, those before as their first load.
LATE_FROM = "2024-01-20"
BETWEEN = ("2023-12-20", "2024-02-10")
NAMED = ("week", "month", "quarter", "year")
MACROS = ["calories", "protein", "carbs", "fat"]


@register("coach_range_counts", f"""
WITH ranges(range, lo, hi) AS (VALUES {", ".join(f"('{n}', {D} - {RANGE_DAYS[n]}, DATE '9999-12-31')" for n in NAMED)},
  ('between', DATE '{BETWEEN[0]}', DATE '{BETWEEN[1]}'))
SELECT s.coach_id, r.range, COUNT(*) AS sessions, COUNT(CASE WHEN lower(status) = 'completed' THEN 1 END) AS completed,
       COUNT(DISTINCT member_id) AS unique_members,
       COUNT(DISTINCT CASE WHEN lower(status) = 'completed' THEN member_id END) AS active_members
FROM sessions s JOIN ranges r ON s.session_date BETWEEN r.lo AND r.hi
GROUP BY s.coach_id, r.range
""", ["sessions"], "A3 A4 A14 P3 P5")
def _coach_range_counts(t):
    late = F.col("session_date") >= lit_date(LATE_FROM)
    table = ru.store_coach_days(t.sessions.where(~late), fresh_path(t.spark, "coach-days"))
    ru.replace_days(table, t.sessions, t.sessions.where(late).select("session_date"))
    return ru.coach_ranges(table.read(), ru.named_ranges(SESSION_AS_OF, NAMED) | {"between": BETWEEN})


@register("merged_streaks", f"""
WITH d AS (SELECT DISTINCT member_id, session_date FROM sessions
           WHERE lower(status) = 'completed' AND session_date <= {D}),
g AS (SELECT member_id, session_date,
             session_date - CAST(row_number() OVER (PARTITION BY member_id ORDER BY session_date) AS INTEGER) AS grp FROM d),
r AS (SELECT member_id, grp, COUNT(*) AS run_len, MAX(session_date) AS run_end FROM g GROUP BY member_id, grp)
SELECT member_id, MAX(run_len) AS longest_streak,
       COALESCE(MAX(CASE WHEN run_end >= {D} - 1 THEN run_len END), 0) AS current_streak,
       CAST(SUM(run_len) AS BIGINT) AS active_days
FROM r GROUP BY member_id
""", ["sessions"], "W1 X27")
def _merged_streaks(t):
    days = ru.completed_days(t.sessions).where(F.col("day") <= lit_date(SESSION_AS_OF))
    late = F.col("day") >= lit_date(LATE_FROM)
    table = KeyedTable.create(ru.active_masks(days.where(~late)), fresh_path(t.spark, "active-days"), "member_id")
    ru.add_days(table, days.where(late))
    return ru.summary_streaks(ru.merge_summaries(ru.mask_summaries(table.read())), SESSION_AS_OF)


@register("member_range_totals", f"""
WITH ranges(range, lo) AS (VALUES {", ".join(f"('{n}', {ND} - {RANGE_DAYS[n]})" for n in NAMED)}, ('all', DATE '0001-01-01')),
day AS (SELECT member_id, log_date, SUM(total_calories) AS c, SUM(total_protein) AS p, SUM(total_carbs) AS h, SUM(total_fat) AS f
        FROM nutrition_logs GROUP BY 1, 2)
SELECT m.id AS member_id, r.range, CAST(COALESCE(SUM(c), 0) AS DECIMAL(18,2)) AS calories,
       CAST(COALESCE(SUM(p), 0) AS DECIMAL(18,2)) AS protein, CAST(COALESCE(SUM(h), 0) AS DECIMAL(18,2)) AS carbs,
       CAST(COALESCE(SUM(f), 0) AS DECIMAL(18,2)) AS fat, COUNT(day.log_date) AS days
FROM members m CROSS JOIN ranges r
LEFT JOIN day ON day.member_id = m.id AND day.log_date BETWEEN r.lo AND {ND}
GROUP BY m.id, r.range
""", ["members", "nutrition_logs"], "A18 A20 X25 P3")
def _member_range_totals(t):
    totals = ru.running_totals(nu.daily_nutrition(t.nutrition_logs), "member_id", "log_date", MACROS)
    as_of = lit_date(NUTRITION_AS_OF)
    ranges = F.array(*[F.struct(F.lit(n).alias("range"), F.date_sub(as_of, RANGE_DAYS[n]).alias("lo")) for n in NAMED],
                     F.struct(F.lit("all").alias("range"), F.lit(None).cast("date").alias("lo")))
    asked = (t.members.select(F.col("id").alias("member_id"), F.explode(ranges).alias("r"))
             .select("member_id", "r.range", "r.lo", as_of.alias("hi")))
    out = ru.range_totals(totals, asked, "member_id", MACROS)
    return out.select("member_id", "range", *[F.col(m).cast("decimal(18,2)").alias(m) for m in MACROS], "days")


@register("coach_session_deep_page", """
SELECT id, coach_id, session_date, session_time, status, row_in_group, total, 12 AS page, total > 120 AS has_more,
       CAST(ceil(total / 10.0) AS INTEGER) AS total_pages
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY coach_id ORDER BY session_date DESC, session_time DESC, id DESC) AS INTEGER)
                  AS row_in_group,
             COUNT(*) OVER (PARTITION BY coach_id) AS total FROM sessions) p
WHERE row_in_group > 110 AND row_in_group <= 120
""", ["sessions"], "O4 X36")
def _coach_session_deep_page(t):
    rows = t.sessions.select("id", "coach_id", "session_date", "session_time", "status")
    return deep_page(rows, "coach_id", [("session_date", False), ("session_time", False), ("id", False)], slices=2,
                     page=12, limit=10)


@register("search_many_terms", """
WITH terms AS (SELECT DISTINCT right(name, 6) AS term FROM coaches
               UNION SELECT DISTINCT right(name, 6) FROM members WHERE membership_type = 'VIP'
               UNION SELECT 'R#%' || right(name, 4) FROM members WHERE membership_type = 'Premium')
SELECT t.term, m.id, m.name, m.email FROM terms t JOIN members m
ON m.name ILIKE '%' || t.term || '%' OR m.email ILIKE '%' || t.term || '%'
""", ["members", "coaches"], "P6 P8")
def _search_many_terms(t):
    return ss.search_terms(_terms(t), t.members.select("id", "name", "email"), "id", ["name", "email"])


def _terms(t):
    return (t.coaches.select(F.expr("right(name, 6)").alias("term"))
            .unionByName(t.members.where("membership_type = 'VIP'").select(F.expr("right(name, 6)").alias("term")))
            .unionByName(t.members.where("membership_type = 'Premium'").select(F.expr("concat('R#%', right(name, 4))").alias("term")))
            .distinct())


@register("suggest_many_terms", """
WITH terms AS (SELECT DISTINCT right(name, 4) AS term FROM members)
SELECT t.term, m.id, m.name, m.email, CAST(row_number() OVER (PARTITION BY t.term ORDER BY m.name, m.id) AS INTEGER) AS rank_in_group
FROM terms t JOIN members m ON m.name ILIKE '%' || t.term || '%' OR m.email ILIKE '%' || t.term || '%'
QUALIFY rank_in_group <= 5
""", ["members"], "O5 P6 W2")
def _suggest_many_terms(t):
    rows = t.members.select("id", "name", "email")
    terms = rows.select(F.expr("right(name, 4)").alias("term")).distinct()
    sizes = sorted(ss.gram_sizes(terms, "term"))
    index = ss.store_index(ss.gram_index(rows, "id", ["name", "email"], sizes), fresh_path(t.spark, "grams")).read()
    return ss.suggest_terms(terms, rows, "id", ["name", "email"], [F.col("name"), F.col("id")], 5, index, sizes)


@register("food_first_hits", """
WITH labels AS (SELECT lower(category) || ' ' || name AS label FROM food_items
                UNION SELECT unnest(string_split(name, ' ')) FROM food_items
                UNION SELECT upper(name) || ' ' || brand FROM food_items),
hits AS (SELECT l.label, min(f.id) AS food_id FROM labels l JOIN food_items f
         ON contains(lower(l.label), lower(f.name)) OR contains(lower(f.name), lower(l.label)) GROUP BY l.label)
SELECT l.label, h.food_id, f.name AS food_name FROM labels l LEFT JOIN hits h ON h.label = l.label
LEFT JOIN food_items f ON f.id = h.food_id
""", ["food_items"], "J20")
def _food_first_hits(t):
    items = t.food_items
    labels = (items.select(F.concat_ws(" ", F.lower("category"), "name").alias("label"))
              .unionByName(items.select(F.explode(F.split("name", " ")).alias("label")))
              .unionByName(items.select(F.concat_ws(" ", F.upper("name"), "brand").alias("label"))).distinct())
    return ss.first_hits(labels, items.select(F.col("id").alias("food_id"), F.col("name").alias("food_name")))
