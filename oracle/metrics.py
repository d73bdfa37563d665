"""Oracle SQL of the metric operators."""

from __future__ import annotations

from oracle.base import AD, KPI, STORE, WEB, ad_sums, dbl, kpi, sums, with_

SQL: dict[str, str] = {}

ASOF = "DATE '2001-07-31'"
WEEK = "date BETWEEN DATE '2001-07-25' AND DATE '2001-07-31'"
PREV = "date BETWEEN DATE '2001-07-18' AND DATE '2001-07-24'"
BLEND = """
a AS (SELECT date, {ads} FROM ad GROUP BY 1),
s AS (SELECT date, {dorders} AS store_orders, {drev} AS store_revenue FROM store),
cal AS (SELECT CAST(d AS DATE) AS date
        FROM generate_series(DATE '{start}', DATE '{end}', INTERVAL 1 DAY) t(d)),
blend AS (SELECT * FROM cal LEFT JOIN a USING (date) LEFT JOIN s USING (date))"""


def blended(start: str, end: str, body: str) -> str:
    head = with_(("ad", "store"), "")
    mid = BLEND.format(ads=ad_sums(), dorders=dbl("orders"), drev=dbl("revenue"),
                       start=start, end=end)
    return head.rstrip() + "," + mid + "\n" + body


SQL["in_period"] = with_("ad", f"""
SELECT date, channel_id, campaign_id, ad_set_id, creative_id, age_group, device, region,
  {", ".join(f"{dbl(m)} AS {m}" for m in AD)} FROM ad WHERE {WEEK}""")
SQL["entity_filter"] = with_("ad_level", f"""
SELECT level, key, {ad_sums()}, count(*) AS rows FROM ad_level
WHERE (level, key) IN (('account', 'all'), ('channel', 'meta_ads'), ('campaign', '3'),
  ('ad_set', '13'), ('creative', '23'), ('age_group', '13|45+')) GROUP BY 1, 2""")
SQL["web_sources_of"] = with_("web_level", f"""
SELECT level, key, {sums(WEB)}, count(*) AS rows FROM web_level GROUP BY 1, 2""")
SQL["segment_key"] = with_("ad", f"""
SELECT ad_set_id || '|' || age_group AS segment, {ad_sums()} FROM ad GROUP BY 1""")
SQL["ad_facts_with_names"] = with_("ad", f"""
SELECT date, channel_id, 'campaign-' || campaign_id AS campaign_name,
  'adset-' || ad_set_id AS ad_set_name, 'creative-' || creative_id AS creative_name, age_group,
  device, region, {", ".join(f"{dbl(m)} AS {m}" for m in AD)} FROM ad""")
SQL["blend_daily"] = blended("2001-06-01", "2001-07-31", "SELECT * FROM blend")
SQL["ad_daily"] = with_("ad_level", f"""
SELECT level AS dimension, CASE WHEN level = 'age_group' THEN age_group ELSE key END AS key, date,
  {ad_sums()} FROM ad_level
GROUP BY level, CASE WHEN level = 'age_group' THEN age_group ELSE key END, date""")
SQL["reach_sum"] = with_("ad", f"""
SELECT campaign_id, channel_id, {ad_sums()}, count(*) AS rows FROM ad GROUP BY ROLLUP(channel_id, campaign_id)""")
SQL["entity_daily"] = with_("ad", f"""
SELECT date, channel_id, campaign_id, ad_set_id, creative_id, age_group, {ad_sums()}
FROM ad GROUP BY ALL""")
SQL["web_daily"] = with_("web", f"SELECT date, source, {sums(WEB)} FROM web GROUP BY 1, 2")
SQL["store_daily"] = with_("store", f"""
SELECT date, orders AS store_orders, {dbl("revenue")} AS store_revenue FROM store""")
SQL["period_totals"] = with_("ad", f"""
SELECT {", ".join(f"{dbl(f'SUM({m}) FILTER ({WEEK})')} AS {m}" for m in AD)} FROM ad""")
SQL["grouped_totals"] = with_("ad", f"""
SELECT campaign_id, {sums(AD)} FROM ad WHERE {WEEK} GROUP BY 1""")
SQL["level_daily"] = with_("ad_level", f"""
SELECT level, key, date, {", ".join(
    f"{dbl(f'SUM({m})')} AS {m}" for m in AD if m != "reach")}, count(*) AS rows
FROM ad_level GROUP BY 1, 2, 3""")

_TOT = f"""
a AS (SELECT level, key, {ad_sums()}, count(DISTINCT date) AS ad_days FROM ad_level
      WHERE date BETWEEN DATE '2001-07-01' AND {ASOF} GROUP BY 1, 2),
w AS (SELECT level, key, {sums(WEB)}, count(DISTINCT date) AS web_days FROM web_level
      WHERE date BETWEEN DATE '2001-07-01' AND {ASOF} GROUP BY 1, 2),
s AS (SELECT 'account' AS level, 'all' AS key, {dbl("SUM(orders)")} AS store_orders,
      {dbl("SUM(revenue)")} AS store_revenue, count(DISTINCT date) AS store_days FROM store
      WHERE date BETWEEN DATE '2001-07-01' AND {ASOF} GROUP BY 1, 2)
SELECT level, key, {", ".join(AD + WEB + STORE)},
  GREATEST(COALESCE(ad_days, 0), COALESCE(web_days, 0), COALESCE(store_days, 0)) AS days
FROM a FULL JOIN w USING (level, key) FULL JOIN s USING (level, key)"""
SQL["entity_totals"] = with_(("ad_level", "web_level", "store"), "").rstrip() + "," + _TOT

SQL["kpis"] = with_(("ad_level", "web_level", "store"), "").rstrip() + "," + _TOT.rsplit(
    "SELECT level, key, impressions", 1)[0] + f"""
SELECT level, key, {", ".join(f"{kpi(m)} AS {m}" for m in KPI)}
FROM a FULL JOIN w USING (level, key) FULL JOIN s USING (level, key)"""
SQL["kpi_series"] = with_("ad", f"""
SELECT date, channel_id, {", ".join(
    f"{kpi(m)} AS {m}" for m in ("ctr", "cpc", "cpm", "cvr", "cpa", "roas", "aov", "frequency"))}
FROM (SELECT date, channel_id, {ad_sums()} FROM ad GROUP BY 1, 2)""")
SQL["change_pct"] = with_("ad", f"""
SELECT campaign_id, p AS previous, c AS current, (c - p) / NULLIF(abs(p), 0) * 100 AS change_pct
FROM (SELECT campaign_id, {dbl(f"SUM(spend) FILTER ({PREV})")} AS p,
  {dbl(f"SUM(spend) FILTER ({WEEK})")} AS c FROM ad GROUP BY 1)""")
SQL["kpi_catalogue"] = with_(("ad", "web", "store"), f"""
, a AS (SELECT date, {ad_sums()} FROM ad GROUP BY 1),
w AS (SELECT date, {sums(WEB)} FROM web GROUP BY 1),
d AS (SELECT * FROM a FULL JOIN w USING (date) FULL JOIN (SELECT date, {dbl("orders")}
  AS store_orders, {dbl("revenue")} AS store_revenue FROM store) USING (date)),
v AS ({" UNION ALL ".join(f"SELECT '{m}' AS metric, count({KPI[m]}) AS days_known FROM d"
                          for m in KPI)}
  {"".join(f" UNION ALL SELECT '{m}', count({m}) FROM d" for m in
           ("impressions", "clicks", "spend", "platform_conversions", "platform_revenue",
            "store_revenue", "store_orders"))}),
c AS (SELECT * FROM (VALUES
 ('ctr','clicks','impressions',1.0,true,'CTR',false), ('cpc','spend','clicks',1.0,false,'CPC',false),
 ('cpm','spend','impressions',1000.0,false,'CPM',false),
 ('cvr','platform_conversions','clicks',1.0,true,'CVR',true),
 ('cpa','spend','platform_conversions',1.0,false,'CPA',true),
 ('roas','platform_revenue','spend',1.0,true,'ROAS',true),
 ('aov','platform_revenue','platform_conversions',1.0,true,'AOV',true),
 ('frequency','impressions','reach',1.0,false,'frequency',false),
 ('bounce_rate','bounces','sessions',1.0,false,'bounce rate',false),
 ('atc_rate','add_to_cart','sessions',1.0,true,'add-to-cart rate',false),
 ('checkout_rate','checkout','add_to_cart',1.0,true,'checkout rate',false),
 ('purchase_rate','purchases','checkout',1.0,true,'purchase rate',false),
 ('web_cvr','purchases','sessions',1.0,true,'site conversion rate',false),
 ('mer','store_revenue','spend',1.0,true,'MER',false),
 ('store_aov','store_revenue','store_orders',1.0,true,'store AOV',false),
 ('impressions',NULL,NULL,NULL,true,'impressions',false), ('clicks',NULL,NULL,NULL,true,'clicks',false),
 ('spend',NULL,NULL,NULL,NULL,'spend',false),
 ('platform_conversions',NULL,NULL,NULL,true,'reported conversions',true),
 ('platform_revenue',NULL,NULL,NULL,true,'reported revenue',true),
 ('store_revenue',NULL,NULL,NULL,true,'store revenue',false),
 ('store_orders',NULL,NULL,NULL,true,'store orders',false))
 AS t(metric, numerator, denominator, scale, higher_is_better, label, needs_tracking))
SELECT metric, numerator, denominator, CAST(scale AS DOUBLE) AS scale, higher_is_better, label,
  needs_tracking, days_known FROM c JOIN v USING (metric)""")
SQL["break_even_roas"] = with_("ad", f"""
SELECT date, channel_id, roas, 100.0 / 55 AS break_even, roas > CAST(100.0 / 55 AS DOUBLE) AS profitable
FROM (SELECT date, channel_id, {kpi("roas")} AS roas FROM (
  SELECT date, channel_id, {ad_sums()} FROM ad GROUP BY 1, 2))""").replace(
    "100.0 / 55 AS break_even", "CAST(100 AS DOUBLE) / 55 AS break_even").replace(
    "CAST(100.0 / 55 AS DOUBLE)", "CAST(100 AS DOUBLE) / 55")


def goal(value: str, target: str, higher: bool) -> str:
    share = f"{value} / NULLIF({target}, 0)" if higher else f"{target} / NULLIF({value}, 0)"
    free = "" if higher else f"WHEN {value} <= 0 THEN 'ahead'"
    return (f"CASE WHEN {value} IS NULL OR {target} IS NULL OR {target} <= 0 THEN NULL {free} "
            f"WHEN {share} >= 1.05 THEN 'ahead' WHEN {share} >= 0.95 THEN 'on_track' "
            f"WHEN {share} IS NOT NULL THEN 'behind' END").replace(
        ">= 1.05", ">= CAST(1.05 AS DOUBLE)").replace(">= 0.95", ">= CAST(0.95 AS DOUBLE)")


SQL["goal_status"] = with_("ad", f"""
SELECT date, channel_id, cpa, {goal("cpa", "CAST(700 AS DOUBLE)", False)} AS cpa_status,
  roas, {goal("roas", "CAST(18 AS DOUBLE)", True)} AS roas_status
FROM (SELECT date, channel_id, {kpi("cpa")} AS cpa, {kpi("roas")} AS roas FROM (
  SELECT date, channel_id, {ad_sums()} FROM ad GROUP BY 1, 2))""")
SQL["prorated_target"] = with_("store", f"""
SELECT date, {dbl("revenue")} AS revenue,
  CAST(60000000 AS DOUBLE) * day(date) / day(last_day(date)) AS due FROM store""")
SQL["account_targets"] = with_("store", """
SELECT date, metric, CAST(CASE metric WHEN 'mer' THEN CAST(100 AS DOUBLE) / 55 WHEN 'roas' THEN 18
  WHEN 'cpa' THEN 700 ELSE CAST(60000000 AS DOUBLE) * 7 / day(last_day(date)) END AS DOUBLE)
  AS target
FROM store, (VALUES ('mer'), ('roas'), ('cpa'), ('store_revenue')) t(metric)""")

_BETTER = {"store_revenue": "true", "spend": "CAST(NULL AS BOOLEAN)", "roas": "true",
           "mer": "true", "cpa": "false"}
_TARGET = {
    "store_revenue": "CAST(60000000 AS DOUBLE) * 7 / 31", "spend": "CAST(NULL AS DOUBLE)",
    "roas": "CAST(18 AS DOUBLE)", "mer": "CAST(100 AS DOUBLE) / 55", "cpa": "CAST(700 AS DOUBLE)"}
SQL["today_kpis"] = with_(("ad", "store"), "").rstrip() + f"""
, t AS (SELECT * FROM (SELECT {WEEK} AS cur, {sums(AD)} FROM ad WHERE {WEEK} OR {PREV} GROUP BY 1)
  JOIN (SELECT {WEEK} AS cur, {dbl("SUM(orders)")} AS store_orders,
    {dbl("SUM(revenue)")} AS store_revenue FROM store WHERE {WEEK} OR {PREV} GROUP BY 1)
  USING (cur)),
v AS ({" UNION ALL ".join(
    f"SELECT '{m}' AS metric, MAX({KPI.get(m, m)}) FILTER (cur) AS value, "
    f"MAX({KPI.get(m, m)}) FILTER (NOT cur) AS previous, {_BETTER[m]} AS higher_is_better, "
    f"{_TARGET[m]} AS goal FROM t" for m in _BETTER)})
SELECT metric, value, previous, (value - previous) / NULLIF(abs(previous), 0) * 100 AS change_pct,
  higher_is_better, CASE WHEN value IS NOT NULL THEN goal END AS target,
  CASE WHEN higher_is_better IS NOT FALSE THEN {goal("value", "goal", True)}
    ELSE {goal("value", "goal", False)} END AS goal_status, true AS reliable FROM v"""
SQL["trend_30d"] = blended("2001-07-02", "2001-07-31", f"""
SELECT date, store_revenue, spend, {kpi("roas")} AS roas, {kpi("mer")} AS mer,
  {kpi("cpa")} AS cpa FROM blend""")
_SERIES = f"""
SELECT dimension, key, date, value, period_value, previous_value,
  (period_value - previous_value) / NULLIF(abs(previous_value), 0) * 100 AS change_pct FROM (
 SELECT k.level AS dimension, k.key, c.date, v.value, t.period_value, t.previous_value
 FROM (SELECT DISTINCT level, key FROM ad_level WHERE level IN ('channel', 'campaign')
       AND date BETWEEN DATE '2001-06-02' AND {ASOF}) k
 CROSS JOIN (SELECT CAST(d AS DATE) AS date FROM
       generate_series(DATE '2001-07-02', {ASOF}, INTERVAL 1 DAY) t(d)) c
 LEFT JOIN (SELECT level, key, date, {kpi("cpa")} AS value FROM (
       SELECT level, key, date, {ad_sums()} FROM ad_level GROUP BY 1, 2, 3)) v
   USING (level, key, date)
 LEFT JOIN (SELECT level, key, MAX({kpi("cpa")}) FILTER (cur) AS period_value,
       MAX({kpi("cpa")}) FILTER (NOT cur) AS previous_value FROM (
       SELECT level, key, date >= DATE '2001-07-02' AS cur, {ad_sums()} FROM ad_level
       WHERE date BETWEEN DATE '2001-06-02' AND {ASOF} GROUP BY 1, 2, 3) GROUP BY 1, 2) t
   USING (level, key))"""
SQL["metric_series"] = with_("ad_level", _SERIES)
