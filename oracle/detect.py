"""Oracle SQL of trust, pacing, detection, scoring and grouping, for every as-of date."""

from __future__ import annotations

from oracle.base import AD, CTES, KPI, STORE, WEB, ad_sums, dbl, kpi, sums, with_

SQL: dict[str, str] = {}
JULY = "DATE '2001-07-01' AND DATE '2001-07-31'"
ALL = AD + WEB + STORE
MIN_SAMPLE = {
    "impressions": 500, "reach": 500, "clicks": 10, "spend": 500, "platform_conversions": 3,
    "sessions": 30, "add_to_cart": 3, "checkout": 2, "store_orders": 3}
BACKED = {"platform_revenue": "platform_conversions", "store_revenue": "store_orders"}
SIDES = {
    "ctr": ("clicks", "impressions"), "cpc": ("spend", "clicks"), "cpm": ("spend", "impressions"),
    "cvr": ("platform_conversions", "clicks"), "cpa": ("spend", "platform_conversions"),
    "roas": ("platform_revenue", "spend"), "aov": ("platform_revenue", "platform_conversions"),
    "frequency": ("impressions", "reach"), "bounce_rate": ("bounces", "sessions"),
    "atc_rate": ("add_to_cart", "sessions"), "checkout_rate": ("checkout", "add_to_cart"),
    "purchase_rate": ("purchases", "checkout"), "mer": ("store_revenue", "spend")}
LOWER_BETTER = ("cpc", "cpm", "cpa", "frequency", "bounce_rate")
TAGS = {"baseline_change": "chg", "goal_breach": "goal", "funnel_drop": "fun",
        "segment_divergence": "seg", "tracking_break": "trk"}
WINDOWS = {"cur": (6, 0), "w4": (13, 7), "w3": (20, 14), "w2": (27, 21), "w1": (34, 28),
           "base": (34, 7)}


def windowed(measures, names=tuple(WINDOWS)) -> str:
    return ", ".join(
        f"{dbl(f'SUM({m}) FILTER (date BETWEEN as_of - {a} AND as_of - {b})')} AS {w}_{m}"
        for w, (a, b) in WINDOWS.items() if w in names for m in measures)


# --- trust ----------------------------------------------------------------------------------
CTES["srcdays"] = (("ad", "web", "store"), """
SELECT channel_id AS source, date, count(*) AS n FROM ad GROUP BY 1, 2
UNION ALL SELECT 'web_analytics', date, count(*) FROM web GROUP BY 1, 2
UNION ALL SELECT 'store_orders', date, count(*) FROM store GROUP BY 1, 2""")
CTES["cov"] = (("srcdays",), """
SELECT source, MIN(date) AS first_date, MAX(date) AS last_date, CAST(SUM(n) AS BIGINT) AS rows,
  count(*) AS days FROM srcdays GROUP BY 1""")
CTES["fresh"] = (("cov",), """
SELECT c.source, c.last_date, date_diff('day', c.last_date, n.newest) AS days_behind,
  (SELECT string_agg(CAST(g.d AS VARCHAR), ',' ORDER BY g.d) FROM (
     SELECT CAST(x AS DATE) AS d FROM generate_series(
       GREATEST(c.first_date, n.newest - 27), c.last_date, INTERVAL 1 DAY) t(x)) g
   WHERE NOT EXISTS (SELECT 1 FROM srcdays s WHERE s.source = c.source AND s.date = g.d)) AS gaps
FROM cov c, (SELECT MAX(last_date) AS newest FROM cov) n""")
SQL["coverage"] = with_("cov", "SELECT * FROM cov")
SQL["dates_by_source"] = with_("srcdays", f"SELECT source, date FROM srcdays WHERE date BETWEEN {JULY}")
SQL["as_of_date"] = with_("cov", """
SELECT CASE WHEN count(*) = 4 THEN MIN(last_date) END AS as_of, '' AS missing_sources FROM cov""")
SQL["ingestion_status"] = with_("cov", """
SELECT source, CASE source WHEN 'google_ads' THEN 'Google Ads' WHEN 'meta_ads' THEN 'Meta Ads'
  WHEN 'web_analytics' THEN 'Web analytics (GA4)' ELSE 'Store orders (Shopify)' END AS label,
  first_date, last_date, rows, days, false AS missing, MIN(last_date) OVER () AS as_of FROM cov""")
SQL["freshness"] = with_("fresh", """
SELECT source, last_date, days_behind, COALESCE(gaps, '') AS missing_dates,
  CASE WHEN days_behind > 0 OR gaps IS NOT NULL THEN 'warning' ELSE 'ok' END AS status FROM fresh""")
SQL["conversions_vs_orders"] = with_(("ad", "store"), f"""
SELECT channel_id, date, {dbl("SUM(platform_conversions)")} AS conversions, any_value(orders) AS orders
FROM ad LEFT JOIN store USING (date) GROUP BY 1, 2""")
CTES["days_asked"] = (("ad", "web", "store"), """
SELECT CAST(d AS DATE) AS as_of FROM (
 SELECT MAX(first) + 35 AS first, MIN(last) AS last FROM (
  SELECT MIN(date) AS first, MAX(date) AS last FROM ad
  UNION ALL SELECT MIN(date), MAX(date) FROM web UNION ALL SELECT MIN(date), MAX(date) FROM store)),
generate_series(first, last, INTERVAL 1 DAY) t(d)""")
CTES["series"] = (("ad", "store", "days_asked"), """
SELECT channel_id, date, c, orders AS o, CAST(c AS DOUBLE) / NULLIF(orders, 0) AS ratio FROM (
  SELECT DISTINCT channel_id FROM ad) CROSS JOIN (SELECT CAST(d AS DATE) AS date FROM
  (SELECT MIN(as_of) - 30 AS first, MAX(as_of) AS last FROM days_asked),
  generate_series(first, last, INTERVAL 1 DAY) t(d))
LEFT JOIN (SELECT channel_id, date, SUM(platform_conversions) AS c FROM ad GROUP BY 1, 2)
  USING (channel_id, date) LEFT JOIN store USING (date)""")
CTES["verdict"] = (("days_asked", "series"), """
SELECT as_of, channel_id, cn / NULLIF(onow, 0) / typical AS ratio_change, typical,
  (cnm - cbm) / NULLIF(abs(cbm), 0) * 100 AS conversions_change_pct,
  (onm - obm) / NULLIF(abs(obm), 0) * 100 AS orders_change_pct FROM (
 SELECT as_of, channel_id,
  CAST(COALESCE(SUM(c) FILTER (date >= as_of - 2), 0) AS DOUBLE) AS cn,
  CAST(SUM(o) FILTER (date >= as_of - 2) AS DOUBLE) AS onow,
  median(ratio) FILTER (date < as_of - 2) AS typical,
  count(ratio) FILTER (date < as_of - 2) AS n,
  CAST(SUM(c) FILTER (date < as_of - 2) AS DOUBLE) / NULLIF(count(c) FILTER (date < as_of - 2), 0)
    AS cbm,
  CAST(SUM(c) FILTER (date >= as_of - 2) AS DOUBLE) / NULLIF(count(c) FILTER (date >= as_of - 2), 0)
    AS cnm,
  CAST(SUM(o) FILTER (date < as_of - 2) AS DOUBLE) / NULLIF(count(o) FILTER (date < as_of - 2), 0)
    AS obm,
  CAST(SUM(o) FILTER (date >= as_of - 2) AS DOUBLE) / NULLIF(count(o) FILTER (date >= as_of - 2), 0)
    AS onm
 FROM days_asked JOIN series ON date BETWEEN as_of - 30 AND as_of GROUP BY 1, 2)
WHERE n >= 14 AND onow >= 3 AND typical > 0""")
CTES["tracking"] = (("verdict",), """
SELECT v.*, CASE WHEN ratio_change <= CAST(0.45 AS DOUBLE) THEN 'broken'
  WHEN ratio_change <= CAST(0.6 AS DOUBLE) THEN 'warning' ELSE 'ok' END AS status,
  CASE WHEN ratio_change <= CAST(0.6 AS DOUBLE) THEN CASE WHEN latest IS NULL THEN v.as_of - 2
    ELSE COALESCE((SELECT MAX(s.date) + 1 FROM series s WHERE s.channel_id = v.channel_id
      AND s.date BETWEEN v.as_of - 27 AND latest - 1
      AND (s.ratio IS NULL OR s.ratio / v.typical > CAST(0.6 AS DOUBLE))), v.as_of - 27) END END
    AS since
FROM verdict v LEFT JOIN (SELECT as_of, v.channel_id, MAX(date) AS latest FROM verdict v
  JOIN series s ON s.channel_id = v.channel_id AND date BETWEEN as_of - 3 AND as_of
  WHERE ratio / typical <= CAST(0.6 AS DOUBLE) GROUP BY 1, 2) l
  ON l.as_of = v.as_of AND l.channel_id = v.channel_id""")
_TRK = """SELECT as_of, channel_id, status, ratio_change, typical, since, conversions_change_pct,
  orders_change_pct FROM tracking"""
SQL["tracking_check_all_dates"] = with_("tracking", _TRK)
SQL["tracking_check"] = with_("tracking", _TRK + " WHERE as_of = DATE '2001-07-31'")
SQL["low_run_since"] = with_("tracking", """
SELECT as_of, channel_id, since FROM tracking WHERE status <> 'ok'""")
SQL["source_trust"] = with_(("fresh", "tracking"), """
SELECT f.source, f.last_date, f.days_behind, COALESCE(gaps, '') AS missing_dates,
  CASE WHEN days_behind > 0 OR gaps IS NOT NULL THEN 'warning' ELSE 'ok' END AS freshness_status,
  t.status AS tracking_status, t.ratio_change, t.since,
  CASE WHEN t.status = 'broken' THEN 'broken' WHEN t.status = 'warning' OR days_behind > 0
    OR gaps IS NOT NULL THEN 'warning' ELSE 'ok' END AS status
FROM fresh f LEFT JOIN tracking t ON t.channel_id = f.source AND t.as_of = DATE '2001-07-31'""")
SQL["unreliable_metrics"] = with_("tracking", """
SELECT DISTINCT as_of, metric FROM tracking, (VALUES ('roas'), ('cpa')) m(metric)
WHERE status = 'broken'""")

# --- pacing ---------------------------------------------------------------------------------
SQL["mtd_spend"] = with_("ad", f"""
SELECT channel_id, {dbl("SUM(spend)")} AS spent FROM ad
WHERE date BETWEEN DATE '2001-07-01' AND DATE '2001-07-20' GROUP BY 1""")
SQL["budget_pacing"] = with_("ad", """
, m AS (SELECT channel_id, CAST(SUM(spend) AS DOUBLE) AS spent,
    CAST(CASE channel_id WHEN 'google_ads' THEN 900000 ELSE 700000 END AS DOUBLE) AS budget,
    SUM(spend) AS exact FROM ad
  WHERE date BETWEEN DATE '2001-07-01' AND DATE '2001-07-20' GROUP BY 1),
l AS (SELECT channel_id, budget, spent FROM m
  UNION ALL SELECT 'all', SUM(budget), CAST(SUM(exact) AS DOUBLE) FROM m)
SELECT channel_id, budget, spent, spent / budget * 100 AS spent_pct,
  budget - spent AS remaining_budget, CAST(20 AS DOUBLE) / 31 * 100 AS month_elapsed_pct,
  spent / 20 * 31 AS projected, spent / 20 AS daily_run_rate,
  CASE WHEN spent / 20 * 31 / budget > CAST(1.1 AS DOUBLE) THEN 'over'
    WHEN spent / 20 * 31 / budget < CAST(0.9 AS DOUBLE) THEN 'under' ELSE 'on_track' END AS status,
  GREATEST(budget - spent, 0) / 11 AS suggested_daily FROM l""")
SQL["budget_plan"] = with_("ad", """
, s AS (SELECT channel_id, strftime(date, '%Y-%m') AS month, CAST(SUM(spend) AS DOUBLE) AS spend
  FROM ad GROUP BY 1, 2)
SELECT channel_id, month, spend, CAST(CASE channel_id
  WHEN 'google_ads' THEN CASE month WHEN '2001-07' THEN 650000 ELSE 600000 END + 250000
  ELSE 400000 + CASE month WHEN '2001-06' THEN 350000 ELSE 300000 END END AS DOUBLE) AS budget
FROM s""")

# --- windows --------------------------------------------------------------------------------
SQL["trailing_window"] = with_("store", """
SELECT date, date - 6 AS window_start, date AS window_end, date - 13 AS previous_start,
  date - 7 AS previous_end, CAST(date_trunc('month', date) AS DATE) AS month_start,
  date AS month_end FROM store""")
SQL["densify_calendar"] = with_(("web", "days_asked"), f"""
, a AS (SELECT MIN(as_of) AS first, MAX(as_of) AS last FROM days_asked),
d AS (SELECT source, date, {dbl("SUM(sessions)")} AS sessions FROM web, a
  WHERE date BETWEEN first AND last GROUP BY 1, 2)
SELECT source, date, CAST(sessions AS BIGINT) AS sessions FROM (SELECT DISTINCT source FROM d)
CROSS JOIN (SELECT CAST(x AS DATE) AS date FROM a, generate_series(first - 6, last,
  INTERVAL 1 DAY) t(x)) LEFT JOIN d USING (source, date)""")


def _typed(names) -> str:
    return ", ".join(
        f"CAST(SUM({m}) FILTER (date BETWEEN as_of - {a} AND as_of - {b}) AS "
        f"{'DOUBLE' if m == 'spend' else 'BIGINT'}) AS {w}_{m}"
        for w, (a, b) in WINDOWS.items() if w in names for m in ("spend", "clicks"))


SQL["baseline_weeks"] = with_(("ad", "days_asked"), f"""
SELECT campaign_id, as_of, {_typed(("w1", "w2", "w3", "w4"))} FROM days_asked JOIN ad
ON date BETWEEN as_of - 34 AND as_of WHERE as_of = DATE '2001-07-31' GROUP BY 1, 2""")
SQL["rolling_windows"] = with_(("ad", "days_asked"), f"""
SELECT campaign_id, as_of, {_typed(tuple(WINDOWS))} FROM days_asked JOIN ad
ON date BETWEEN as_of - 34 AND as_of GROUP BY 1, 2""")

CTES["deepdays"] = (("ad",), """
SELECT level, key, channel_id, camp, adset, date, SUM(impressions) AS impressions,
  SUM(reach) AS reach, SUM(clicks) AS clicks, SUM(spend) AS spend,
  SUM(platform_conversions) AS platform_conversions, SUM(platform_revenue) AS platform_revenue
FROM (SELECT 'campaign' AS level, campaign_id AS key, NULL AS camp, NULL AS adset, ad.* FROM ad
 UNION ALL SELECT 'ad_set', ad_set_id, campaign_id, NULL, ad.* FROM ad
 UNION ALL SELECT 'creative', creative_id, campaign_id, ad_set_id, ad.* FROM ad
 UNION ALL SELECT 'age_group', ad_set_id || '|' || age_group, campaign_id, ad_set_id, ad.* FROM ad)
GROUP BY 1, 2, 3, 4, 5, 6""")
CTES["deepwin"] = (("days_asked", "deepdays"), f"""
SELECT as_of, level, key, channel_id, camp, adset, {windowed(AD)}
FROM days_asked JOIN deepdays ON date BETWEEN as_of - 34 AND as_of GROUP BY 1, 2, 3, 4, 5, 6""")
CTES["segsum"] = (("days_asked", "deepdays"), f"""
SELECT as_of, level, key, channel_id, camp, adset, {", ".join(
    f"SUM({m}) FILTER (date >= as_of - 6) AS x_{m}" for m in AD)}
FROM days_asked JOIN deepdays ON date BETWEEN as_of - 34 AND as_of
WHERE level = 'age_group' GROUP BY 1, 2, 3, 4, 5, 6""")
CTES["segwin"] = (("segsum",), f"""
SELECT as_of, level, key, channel_id, camp, adset, {", ".join(
    f"CAST(x_{m} AS DOUBLE) AS cur_{m}, CAST(CASE WHEN x_{m} IS NOT NULL THEN "
    f"SUM(x_{m}) OVER (PARTITION BY as_of, adset) - x_{m} END AS DOUBLE) AS peer_{m}" for m in AD)}
FROM segsum""")
CTES["topdays"] = (("ad_level", "web_level", "store"), f"""
SELECT level, key, date, {", ".join(f"SUM({m}) AS {m}" for m in ALL)} FROM (
  SELECT level, key, date, {", ".join(AD)}, {", ".join(f"NULL AS {m}" for m in WEB + STORE)}
  FROM ad_level WHERE level IN ('account', 'channel')
  UNION ALL SELECT level, key, date, {", ".join("NULL" for m in AD)}, {", ".join(WEB)}, NULL, NULL
  FROM web_level WHERE level IN ('account', 'channel')
  UNION ALL SELECT 'account', 'all', date, {", ".join("NULL" for m in AD + WEB)}, orders, revenue
  FROM store) GROUP BY 1, 2, 3""")
CTES["topwin"] = (("days_asked", "topdays"), f"""
SELECT as_of, level, key, CASE WHEN level = 'channel' THEN key END AS channel_id,
  CAST(NULL AS VARCHAR) AS camp, CAST(NULL AS VARCHAR) AS adset, {windowed(ALL)}
FROM days_asked JOIN topdays ON date BETWEEN as_of - 34 AND as_of GROUP BY 1, 2, 3""")
SQL["now_vs_baseline"] = with_("deepwin", f"""
SELECT level, key, {", ".join(
    (f"CAST({w}_{m} AS BIGINT)" if m in ("impressions", "reach", "clicks") else f"{w}_{m}")
    + f" AS {w}_{m}" for w in ("cur", "base") for m in AD)}
FROM deepwin WHERE as_of = DATE '2001-07-31' AND level <> 'age_group'
AND cur_impressions IS NOT NULL AND base_impressions IS NOT NULL""")
SQL["segment_vs_peers"] = with_("segwin", f"""
SELECT key, {", ".join(
    (f"CAST({w}_{m} AS BIGINT)" if m in ("impressions", "reach", "clicks") else f"{w}_{m}")
    + f" AS {w}_{m}" for w in ("cur", "peer") for m in AD)}
FROM segwin WHERE as_of = DATE '2001-07-31' AND cur_impressions IS NOT NULL""")


# --- detectors ------------------------------------------------------------------------------
def sample_ok(metric: str) -> str:
    sides = SIDES.get(metric, (metric,))
    tests = [f"COALESCE(cur_{BACKED.get(s, s)}, 0) >= {MIN_SAMPLE[BACKED.get(s, s)]}"
             for s in sides if BACKED.get(s, s) in MIN_SAMPLE]
    return " AND ".join(tests) or "true"


def floor_of(metric: str, floor: float) -> str:
    counts = [BACKED.get(s, s) for s in SIDES.get(metric, (metric,))]
    counts = [c for c in counts if c in MIN_SAMPLE and c != "spend"]
    if not counts:
        return str(float(floor))
    least = ", ".join(f"CASE WHEN cur_{c} > 0 THEN cur_{c} END" for c in counts)
    scarcest = least if len(counts) == 1 else f"LEAST({least})"
    return f"COALESCE(GREATEST(CAST({floor} AS DOUBLE), 200 / sqrt({scarcest})), {floor})"


def value(metric: str, prefix: str, days: int) -> str:
    return kpi(metric, prefix + "_") if metric in KPI else f"{prefix}_{metric} / {days}"


_ENTITY = """level || ':' || CASE WHEN level IN ('account', 'channel') THEN key
  ELSE concat_ws('/', channel_id, camp, CASE WHEN level <> 'age_group' THEN adset END, key) END"""
ROW = f"""as_of, '{{tag}}|' || {_ENTITY} || '|{{metric}}|' || strftime(as_of, '%Y%m%d') AS id,
 '{{detector}}' AS detector, '{{metric}}' AS metric, {_ENTITY} AS entity_id, channel_id,
 level, camp, adset"""
M_COLS = ("spend", "platform_conversions", "store_orders", "clicks", "impressions")


def change(frame: str, metric: str, where: str, detector="baseline_change", floor=15.0,
           against="base", weeks=True, adverse_only=False) -> str:
    ws = [value(metric, w, 7) for w in ("w1", "w2", "w3", "w4")] if weeks else []
    known = " + ".join(f"CAST(({w}) IS NOT NULL AS INTEGER)" for w in ws) or "0"
    beyond = (f"(({known}) < 3 OR current > GREATEST({', '.join(ws)}) * 1.05 "
              f"OR current < LEAST({', '.join(ws)}) / 1.05)").replace(
        "1.05", "CAST(1.05 AS DOUBLE)") if weeks else "true"
    better = "false" if metric in LOWER_BETTER else "true"
    row = ROW.format(tag=TAGS[detector], metric=metric, detector=detector)
    days = 28 if against == "base" else 7
    extra = "AND adverse" if adverse_only else ""
    has = ", ".join(
        f"cur_{m} AS m_{m}" if frame == "topwin" or m in AD else f"CAST(NULL AS DOUBLE) AS m_{m}"
        for m in M_COLS)
    return f"""SELECT {row}, current, baseline, change_pct, adverse, {has} FROM (
 SELECT *, (change_pct < 0) = {better} AS adverse FROM (
 SELECT *, (current - baseline) / NULLIF(abs(baseline), 0) * 100 AS change_pct FROM (
 SELECT *, {value(metric, "cur", 7)} AS current, {value(metric, against, days)} AS baseline
 FROM {frame} WHERE {where} AND {sample_ok(metric)})))
WHERE abs(change_pct) >= {floor_of(metric, floor)} AND {beyond} {extra}"""


def breach(frame: str, metric: str, where: str, target: str, higher: bool) -> str:
    row = ROW.format(tag="goal", metric=metric, detector="goal_breach")
    share = "current / NULLIF(baseline, 0)" if higher else "baseline / NULLIF(current, 0)"
    free = "" if higher else "AND current > 0"
    return f"""SELECT {row}, current, baseline,
 (current - baseline) / NULLIF(abs(baseline), 0) * 100 AS change_pct, true AS adverse,
 {", ".join(f"cur_{m} AS m_{m}" for m in M_COLS)} FROM (
 SELECT *, {value(metric, "cur", 7)} AS current, CAST({target} AS DOUBLE) AS baseline FROM {frame}
 WHERE {where} AND {sample_ok(metric)})
WHERE {share} < CAST(0.95 AS DOUBLE) {free}"""


LEVELS = {
    "channel": ("cpa", "roas", "cpc", "cpm", "ctr", "cvr"),
    "campaign": ("cpa", "roas", "cvr", "cpc"), "ad_set": ("cpa", "roas", "cvr"),
    "creative": ("cpa", "roas", "ctr", "cpc", "frequency")}
PARTS = {
    "chg": [change("topwin" if level == "channel" else "deepwin", m, f"level = '{level}'")
            for level, metrics in LEVELS.items() for m in metrics],
    "acc": [change("topwin", m, "level = 'account'")
            for m in ("mer", "store_revenue", "roas", "cpa")],
    "goal": [
        breach("topwin", "mer", "level = 'account'", "CAST(100 AS DOUBLE) / 55", True),
        breach("topwin", "roas", "level = 'account'", "18", True),
        breach("topwin", "cpa", "level = 'account'", "700", False),
        breach("topwin", "store_revenue", "level = 'account'",
               "CAST(60000000 AS DOUBLE) * 7 / day(last_day(as_of)) / 7", True)],
    "over": [breach("topwin", "spend", "level = 'channel'",
                    "CAST(CASE key WHEN 'google_ads' THEN 900000 ELSE 700000 END AS DOUBLE)"
                    " / day(last_day(as_of))", False)],
    "fun": [change("topwin", m, "true", "funnel_drop", 10.0, adverse_only=True)
            for m in ("bounce_rate", "atc_rate", "checkout_rate", "purchase_rate")],
    "seg": [change("segwin", m, "true", "segment_divergence", 25.0, "peer", False, True)
            for m in ("cpa", "roas")],
    "trk": [f"""SELECT t.as_of, 'trk|channel:' || t.channel_id || '|platform_conversions|'
 || strftime(t.as_of, '%Y%m%d') AS id, 'tracking_break' AS detector,
 'platform_conversions' AS metric, 'channel:' || t.channel_id AS entity_id, t.channel_id,
 'channel' AS level, NULL AS camp, NULL AS adset, ratio_change AS current,
 CAST(1 AS DOUBLE) AS baseline, (ratio_change - 1) * 100 AS change_pct, true AS adverse,
 {", ".join(f"w.cur_{m} AS m_{m}" for m in M_COLS)}
FROM tracking t LEFT JOIN topwin w ON w.level = 'channel' AND w.key = t.channel_id
 AND w.as_of = t.as_of WHERE status <> 'ok'"""],
}
NEEDS = ("topwin", "deepwin", "segwin", "tracking")
SHOWN = """SELECT as_of, id, detector, metric, entity_id, channel_id,
 concat_ws(',', CASE WHEN level <> 'account' THEN 'account:all' END,
  CASE WHEN level NOT IN ('account', 'channel') THEN 'channel:' || channel_id END,
  'campaign:' || channel_id || '/' || camp, 'ad_set:' || channel_id || '/' || camp || '/' || adset)
  AS ancestors,
 current, baseline, change_pct, adverse, m_spend AS spend FROM """


def signals_cte(*parts: str) -> str:
    return "\nUNION ALL\n".join(sql for part in parts for sql in PARTS[part])


for name, parts in {
    "detect_baseline_change": ("chg",), "detect_account_change": ("acc",),
    "detect_goal_breach": ("goal",), "detect_overspend": ("over",),
    "detect_funnel_drop": ("fun",), "detect_segment_divergence": ("seg",),
    "detect_tracking_break": ("trk",), "detect": tuple(PARTS),
}.items():
    SQL[name] = with_(NEEDS, f"{SHOWN} ({signals_cte(*parts)})")
CTES["sig"] = (NEEDS, signals_cte(*PARTS))
SQL["signal_id"] = with_("sig", "SELECT id, as_of, entity_id, detector, metric FROM sig")
SQL["enough_sample"] = with_("topwin", f"""
SELECT as_of, level, key, {", ".join(
    f"{sample_ok(m)} AS {m}" for m in ("cpa", "roas", "ctr", "mer", "atc_rate"))} FROM topwin""")
SQL["noise_floor"] = with_("topwin", f"""
SELECT as_of, level, key, {", ".join(
    f"round({floor_of(m, 15.0)}, 6) AS {m}" for m in ("cpa", "roas", "cpm", "atc_rate"))}
FROM topwin""")
_W = [value("cpa", w, 7) for w in ("w1", "w2", "w3", "w4")]
SQL["stands_out"] = with_("topwin", f"""
SELECT as_of, key, cpa, (({" + ".join(f"CAST(({w}) IS NOT NULL AS INTEGER)" for w in _W)}) < 3
  OR cpa > GREATEST({", ".join(_W)}) * CAST(1.05 AS DOUBLE)
  OR cpa < LEAST({", ".join(_W)}) / CAST(1.05 AS DOUBLE)) AS stands_out
FROM (SELECT *, {value("cpa", "cur", 7)} AS cpa FROM topwin) WHERE level = 'channel'""")

# --- scoring and grouping -------------------------------------------------------------------
TRACKED = "('cvr', 'cpa', 'roas', 'aov', 'platform_conversions', 'platform_revenue')"
SQL["needs_tracking"] = with_("sig", f"""
SELECT metric, metric IN {TRACKED} AS needs_tracking, count(*) AS signals FROM sig GROUP BY 1, 2""")
CTES["scored"] = (("sig",), """
SELECT *, COALESCE(LEAST(abs(change_pct), 100) / 100 * impact, 0) AS score FROM (
 SELECT *, CASE WHEN current IS NULL OR baseline IS NULL OR change_pct IS NULL THEN 0
  WHEN metric IN ('roas', 'mer') THEN abs(current - baseline) * COALESCE(m_spend, 0)
  WHEN metric IN ('cpa', 'aov') THEN abs(current - baseline) * COALESCE(m_platform_conversions, 0)
  WHEN metric = 'store_aov' THEN abs(current - baseline) * COALESCE(m_store_orders, 0)
  WHEN metric = 'cpc' THEN abs(current - baseline) * COALESCE(m_clicks, 0)
  WHEN metric = 'cpm' THEN abs(current - baseline) * COALESCE(m_impressions, 0)
    * CAST(0.001 AS DOUBLE)
  WHEN metric IN ('spend', 'platform_revenue', 'store_revenue') THEN abs(current - baseline) * 7
  ELSE COALESCE(m_spend, 0) END AS impact FROM sig)""")
SQL["rupee_impact"] = with_("scored", "SELECT as_of, id, impact FROM scored")
SQL["score"] = with_("scored", "SELECT as_of, id, score FROM scored")
SQL["festive_overlap"] = with_("store", """
SELECT date, date - 6 <= DATE '2001-05-10' AND DATE '2001-05-01' <= date AS festive FROM store""")


def kept(sale_start: str, sale_end: str) -> str:
    return f"""(detector = 'tracking_break' OR NOT (
  (metric IN {TRACKED} AND EXISTS (SELECT 1 FROM tracking t WHERE t.as_of = s.as_of
    AND t.status = 'broken' AND (s.channel_id IS NULL OR t.channel_id = s.channel_id)))
  OR (s.as_of - 6 <= DATE '{sale_end}' AND DATE '{sale_start}' <= s.as_of)))"""


SQL["suppress"] = with_("sig", f"{SHOWN} sig s WHERE {kept('2001-07-01', '2001-07-04')}")
SQL["rank_signals"] = with_("scored", f"""
SELECT as_of, id, impact, score FROM scored s WHERE {kept('2001-07-01', '2001-07-04')}
AND (detector IN ('tracking_break', 'goal_breach') OR score >= 5000)""")
SQL["lineage"] = with_("ad", """
SELECT DISTINCT channel_id, level, key, level || ':' || path AS entity_id, ancestors FROM (
 SELECT channel_id, 'channel' AS level, channel_id AS key, channel_id AS path, '' AS ancestors
 FROM ad
 UNION ALL SELECT channel_id, 'campaign', campaign_id, channel_id || '/' || campaign_id,
   'channel:' || channel_id FROM ad
 UNION ALL SELECT channel_id, 'ad_set', ad_set_id,
   concat_ws('/', channel_id, campaign_id, ad_set_id),
   'channel:' || channel_id || ',campaign:' || channel_id || '/' || campaign_id FROM ad
 UNION ALL SELECT channel_id, 'creative', creative_id,
   concat_ws('/', channel_id, campaign_id, ad_set_id, creative_id),
   'channel:' || channel_id || ',campaign:' || channel_id || '/' || campaign_id
   || ',ad_set:' || concat_ws('/', channel_id, campaign_id, ad_set_id) FROM ad)""")
CTES["kids"] = (("ad",), """
SELECT 'account:all' AS entity_id, count(DISTINCT channel_id) AS children FROM ad GROUP BY 1
UNION ALL SELECT 'channel:' || channel_id, count(DISTINCT campaign_id) FROM ad GROUP BY 1
UNION ALL SELECT 'campaign:' || channel_id || '/' || campaign_id, count(DISTINCT ad_set_id)
 FROM ad GROUP BY 1
UNION ALL SELECT 'ad_set:' || concat_ws('/', channel_id, campaign_id, ad_set_id),
 count(DISTINCT creative_id) FROM ad GROUP BY 1""")
SQL["child_counts"] = with_("kids", "SELECT * FROM kids")
CTES["ranked"] = (("scored",), f"""
SELECT *, e[len(e)] AS own FROM (SELECT s.*, list_filter([CASE WHEN level <> 'account' THEN
  'account:all' END, CASE WHEN level NOT IN ('account', 'channel') THEN 'channel:' || channel_id
  END, 'campaign:' || channel_id || '/' || camp,
  'ad_set:' || channel_id || '/' || camp || '/' || adset, entity_id], lambda x: x IS NOT NULL) AS e
FROM scored s WHERE {kept('2001-05-01', '2001-05-10')})""")
# Nodes of the hierarchy a move was seen at; one row per (move, node).
CTES["nodes"] = (("ranked", "kids"), """
SELECT as_of, detector, metric, adverse, depth, node, parent, bool_or(own) AS owned,
  bool_or(NOT own) AS inner_, any_value(children) AS children FROM (
 SELECT as_of, detector, metric, adverse, i - 1 AS depth, e[i] AS node,
   CASE WHEN i > 1 THEN e[i - 1] END AS parent, i = len(e) AS own
 FROM (SELECT r.*, unnest(range(1, len(e) + 1)) AS i FROM ranked r
       WHERE detector <> 'segment_divergence'))
LEFT JOIN kids ON kids.entity_id = node GROUP BY 1, 2, 3, 4, 5, 6, 7""")


def across(depth: int) -> str:
    carries = "b.owned"
    if depth < 3:
        carries += (f" OR EXISTS (SELECT 1 FROM across{depth + 1} x WHERE x.as_of = b.as_of "
                    "AND x.detector = b.detector AND x.metric = b.metric "
                    "AND x.adverse = b.adverse AND x.node = b.node)")
    return f"""
SELECT n.as_of, n.detector, n.metric, n.adverse, n.node, n.owned FROM nodes n JOIN nodes b
 ON b.as_of = n.as_of AND b.detector = n.detector AND b.metric = n.metric
 AND b.adverse = n.adverse AND b.parent = n.node AND b.depth = n.depth + 1
WHERE n.depth = {depth} GROUP BY 1, 2, 3, 4, 5, 6
HAVING count(*) FILTER ({carries}) >= 2
 AND count(*) FILTER ({carries}) >= 0.5 * COALESCE(any_value(n.children), count(*))"""


CTES["across3"] = (("nodes",), across(3))
CTES["across2"] = (("across3",), across(2))
CTES["across1"] = (("across2",), across(1))
CTES["across0"] = (("across1",), across(0))
CTES["broad"] = (("across0",), " UNION ALL ".join(
    f"SELECT as_of, detector, metric, adverse, node AS entity_id FROM across{d} WHERE owned"
    for d in range(4)))
SQL["broad_moves"] = with_("broad", "SELECT * FROM broad")
_SAME = "b.as_of = r.as_of AND b.detector = r.detector AND b.metric = r.metric AND b.adverse = r.adverse"
CTES["specific"] = (("broad",), f"""
SELECT * FROM ranked r WHERE detector = 'segment_divergence' OR (
 NOT EXISTS (SELECT 1 FROM broad b WHERE {_SAME} AND list_contains(r.e[1:len(r.e) - 1], b.entity_id))
 AND (NOT EXISTS (SELECT 1 FROM nodes b WHERE {_SAME} AND b.inner_ AND b.node = r.entity_id)
   OR EXISTS (SELECT 1 FROM broad b WHERE {_SAME} AND b.entity_id = r.entity_id)))""")
SQL["most_specific"] = with_("specific", "SELECT as_of, id, impact, score FROM specific")
CTES["opps"] = (("specific",), """
SELECT as_of, entity_id AS opportunity, arg_max(id, (score, id)) AS primary_id,
  CASE WHEN arg_max(adverse, (score, id)) THEN 'issue' ELSE 'win' END AS kind,
  string_agg(id, ',' ORDER BY score DESC, id DESC) AS signal_ids, MAX(impact) AS impact,
  MAX(score) AS score, count(*) AS n FROM specific GROUP BY 1, 2""")
SQL["group_opportunities"] = with_("opps", """
SELECT as_of, opportunity, kind, primary_id, signal_ids, impact, score FROM opps""")
SQL["rank_opportunities"] = with_("opps", """
SELECT as_of, kind, place, opportunity, score FROM (SELECT *, row_number() OVER (
  PARTITION BY as_of, kind ORDER BY score DESC, opportunity) AS place FROM opps) WHERE place <= 3""")
SQL["replay"] = with_("opps", "SELECT as_of, opportunity, kind, signal_ids, impact, score FROM opps")
SQL["refresh_replay"] = SQL["replay"]
# Sessions of sightings; every date of the span is a run.
SQL["replay_status"] = with_(("opps", "days_asked"), """
, gaps AS (SELECT opportunity AS key, as_of, score, date_diff('day', lag(as_of) OVER w, as_of) AS gap,
  lead(as_of) OVER w AS next FROM opps WINDOW w AS (PARTITION BY opportunity ORDER BY as_of)),
numbered AS (SELECT *, count(*) FILTER (gap IS NULL OR gap > 13) OVER (PARTITION BY key
  ORDER BY as_of) AS session FROM gaps)
SELECT key, as_of, MIN(as_of) OVER (PARTITION BY key, session) - 6 AS first_seen_date,
 as_of AS last_seen_date, score, COALESCE(gap > 1, false) AS reopened,
 CASE WHEN as_of < (SELECT MAX(as_of) FROM days_asked) AND (next IS NULL OR next > as_of + 1)
  THEN as_of + 1 END AS resolved_on FROM numbered""")
SQL["analyse"] = with_("opps", """
SELECT as_of, opportunity, kind, signal_ids, impact, score FROM opps
WHERE as_of = DATE '2001-07-31'""")
SQL["analysis_run_log"] = with_("opps", """
SELECT as_of, CAST(SUM(n) AS BIGINT) AS signal_count, count(*) AS opportunity_count,
  'success' AS status FROM opps GROUP BY 1""")
