"""Oracle SQL of explanation, recommendation, experiments and decisions."""

from __future__ import annotations

from oracle.base import AD, CTES, STORE, WEB, ad_sums, dbl, kpi, sums, with_
from oracle import detect  # noqa: F401  (window expressions)

SQL: dict[str, str] = {}

CTES["opp_rows"] = ((), """
SELECT *, CASE level WHEN 'channel' THEN key ELSE CASE n % 2 WHEN 0 THEN 'google_ads'
  ELSE 'meta_ads' END END AS channel_id,
  CASE WHEN level IN ('ad_set', 'creative') THEN CAST(n % 10 AS VARCHAR) END AS campaign_id,
  CASE WHEN level = 'creative' THEN CAST(n % 40 AS VARCHAR) END AS ad_set_id,
  impact / 2 AS score, CASE WHEN k % 11 <> 0 THEN impact * confidence END AS priority,
  window_end - 6 AS window_start, window_end - 6 - CAST(k % 15 AS INTEGER) AS first_seen_date,
  window_end AS last_seen_date, baseline * (1 + change_pct / 100) AS current FROM (
 SELECT c_custkey AS id, c_custkey AS k, c_custkey // 4 AS n, c_name AS entity_name,
  ['channel', 'campaign', 'ad_set', 'creative'][c_custkey % 4 + 1] AS level,
  CASE c_custkey % 4 WHEN 0 THEN ['google_ads', 'meta_ads'][c_custkey // 4 % 2 + 1]
   WHEN 1 THEN CAST(c_custkey // 4 % 10 AS VARCHAR) WHEN 2 THEN CAST(c_custkey // 4 % 40 AS VARCHAR)
   ELSE CAST(c_custkey // 4 % 80 AS VARCHAR) END AS key,
  CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') THEN 'issue' ELSE 'win' END
   AS kind,
  ['open', 'experimenting', 'resolved', 'dismissed'][c_nationkey % 4 + 1] AS status,
  ['cpa', 'roas', 'ctr', 'cpc', 'spend', 'frequency'][c_custkey % 6 + 1] AS primary_metric,
  CAST(abs(CAST(c_acctbal AS DECIMAL(14,2))) AS DOUBLE) * 20 AS impact,
  CAST(c_custkey % 90 + 10 AS DOUBLE) / 100 AS confidence,
  DATE '2001-07-31' - CAST(c_custkey % 60 AS INTEGER) AS window_end,
  CAST(100 + c_custkey % 50 AS DOUBLE) AS baseline,
  CAST(CAST(c_acctbal AS DECIMAL(14,2)) AS DOUBLE) / 100 AS change_pct,
  ['creative_fatigue', 'landing_page_break', 'cpc_spike', 'audience_mismatch', 'tracking_break',
   'budget_overpace', 'channel_opportunity', 'conversion_drop', 'unknown'][c_custkey % 9 + 1]
   AS cause,
  ['ok', 'ok', 'warning', 'broken'][c_custkey % 4 + 1] AS trust, c_custkey % 3 + 1 AS signal_count
 FROM customer)""")
CTES["exp_rows"] = ((), """
SELECT *, CASE WHEN s <> 'P' THEN d END AS started_on, CASE WHEN s <> 'P' THEN d + 7 END AS ends_on,
  CASE WHEN s = 'F' THEN ['worked', 'did_not_work', 'inconclusive'][id % 3 + 1] END AS verdict,
  CASE WHEN s = 'F' THEN baseline END AS before_value,
  CASE WHEN s = 'F' THEN baseline * (CAST(0.8 AS DOUBLE) + CAST(id % 40 AS DOUBLE) / 100) END
   AS after_value,
  CASE WHEN s = 'F' THEN id % 8 END AS sample_days,
  CASE s WHEN 'O' THEN 'running' WHEN 'F' THEN 'completed'
   ELSE ['draft', 'rejected'][id % 2 + 1] END AS status FROM (
 SELECT o_orderkey AS id, o_custkey AS opportunity_id, o_orderstatus AS s,
  CAST(o_orderdate AS DATE) AS d,
  ['pause_creative', 'rotate_creative', 'refine_audience', 'investigate_landing_page',
   'fix_tracking', 'shift_budget', 'adjust_pacing'][o_orderkey % 7 + 1] AS action,
  ['cpa', 'roas', 'ctr', 'cpc', 'spend'][o_orderkey % 5 + 1] AS metric,
  CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS DOUBLE) / 1000 AS baseline FROM orders)""")
CTES["dec_rows"] = ((), """
SELECT *, CASE WHEN kind <> 'dismiss' THEN id END AS experiment_id FROM (
 SELECT o_orderkey AS id, o_custkey AS opportunity_id, CASE WHEN o_orderstatus <> 'P' THEN 'approve'
  WHEN o_orderkey % 2 = 1 THEN 'reject' ELSE 'dismiss' END AS kind,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS reason,
  CAST(o_orderdate AS DATE) AS created_on FROM orders)""")

_SHARE = "CASE WHEN abs(share_pct) < 1000 THEN round(share_pct, 6) ELSE round(share_pct, 0) END"
_R = ("cvr", "aov", "cpc", "roas", "cpm", "ctr")
CTES["camp"] = (("deepwin",), f"""
SELECT as_of, key, {", ".join(f"{kpi(m, w + '_')} AS {w}_{m}_v" for w in ("cur", "base") for m in _R)}
FROM deepwin WHERE level = 'campaign' AND cur_impressions IS NOT NULL
AND base_impressions IS NOT NULL""")


def _term(m: str, sign: int = 1) -> str:
    return f"{sign} * ln(cur_{m}_v / base_{m}_v)"


_OK = " AND ".join(f"cur_{m}_v > 0 AND base_{m}_v > 0" for m in ("roas", "cvr", "aov", "cpc"))
_OK2 = " AND ".join(f"cur_{m}_v > 0 AND base_{m}_v > 0" for m in ("cpc", "cpm", "ctr"))
CTES["drv"] = (("camp",), f"""
SELECT as_of, key, driver, ord, before, after, (after / before - 1) * 100 AS change_pct,
  term / total * 100 AS share_pct FROM (
 SELECT c.*, t.driver, t.ord,
  CASE t.driver WHEN 'cvr' THEN base_cvr_v WHEN 'aov' THEN base_aov_v ELSE base_cpc_v END AS before,
  CASE t.driver WHEN 'cvr' THEN cur_cvr_v WHEN 'aov' THEN cur_aov_v ELSE cur_cpc_v END AS after,
  CASE t.driver WHEN 'cvr' THEN {_term("cvr")} WHEN 'aov' THEN {_term("aov")}
   ELSE {_term("cpc", -1)} END AS term,
  {_term("cvr")} + {_term("aov")} + {_term("cpc", -1)} AS total
 FROM (SELECT * FROM camp WHERE {_OK}) c,
  (VALUES ('cvr', 0), ('aov', 1), ('cpc', 2)) t(driver, ord)) WHERE abs(total) > 1e-12""")
CTES["drv2"] = (("drv",), f"""
SELECT as_of, key, driver, ord, before, after, (after / before - 1) * 100 AS change_pct,
  term / total * 100 AS share_pct FROM (
 SELECT c.*, t.driver, t.ord, CASE t.driver WHEN 'cpm' THEN base_cpm_v ELSE base_ctr_v END AS before,
  CASE t.driver WHEN 'cpm' THEN cur_cpm_v ELSE cur_ctr_v END AS after,
  CASE t.driver WHEN 'cpm' THEN {_term("cpm")} ELSE {_term("ctr", -1)} END AS term,
  {_term("cpm")} + {_term("ctr", -1)} AS total
 FROM (SELECT * FROM camp WHERE {_OK2} AND (as_of, key) IN (SELECT as_of, key FROM drv)) c,
  (VALUES ('cpm', 0), ('ctr', 1)) t(driver, ord)) WHERE abs(total) > 1e-12""")
SQL["decompose"] = with_("drv", f"""
SELECT as_of, key, driver, before, after, round(change_pct, 6) AS change_pct,
  {_SHARE} AS share_pct FROM drv""")
_NODE = """before, after,
 round((after - before) / NULLIF(abs(before), 0) * 100, 6) AS change_pct"""
SQL["evidence_tree"] = with_("drv2", f"""
SELECT as_of, key, 'roas' AS path, CAST(0 AS BIGINT) AS depth, 'roas' AS metric, {_NODE},
 CAST(NULL AS DOUBLE) AS share_pct
FROM (SELECT *, base_roas_v AS before, cur_roas_v AS after FROM camp)
UNION ALL SELECT as_of, key, 'roas/' || driver, 1, driver, {_NODE}, {_SHARE} FROM drv
UNION ALL SELECT as_of, key, 'roas/cpc/' || driver, 2, driver, {_NODE}, {_SHARE}
FROM drv2""")
SQL["dominant_chain"] = with_("drv2", f"""
, b1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY as_of, key
   ORDER BY abs(share_pct) DESC, ord) AS r FROM drv) WHERE r = 1 AND abs(share_pct) >= 60),
b2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY as_of, key
   ORDER BY abs(share_pct) DESC, ord) AS r FROM drv2) WHERE r = 1 AND abs(share_pct) >= 60
   AND (as_of, key) IN (SELECT as_of, key FROM b1 WHERE driver = 'cpc'))
SELECT as_of, key, CAST(0 AS BIGINT) AS place, driver AS metric, {_SHARE} AS share_pct
FROM b1 UNION ALL SELECT as_of, key, 1, driver, {_SHARE} FROM b2""")
SQL["is_protected"] = with_("ad", """
SELECT 'channel:' || channel_id AS entity_id, false AS protected FROM ad GROUP BY 1
UNION ALL SELECT 'campaign:' || channel_id || '/' || campaign_id, campaign_id = '3' FROM ad
 GROUP BY 1, 2
UNION ALL SELECT 'ad_set:' || concat_ws('/', channel_id, campaign_id, ad_set_id),
 campaign_id = '3' FROM ad GROUP BY 1, 2
UNION ALL SELECT 'creative:' || concat_ws('/', channel_id, campaign_id, ad_set_id, creative_id),
 campaign_id = '3' FROM ad GROUP BY 1, 2""")
CTES["acts"] = ((), """
SELECT * FROM (VALUES
 (1, 'pause_creative', 'high', 'creative', 'creative_id', 0.4, 0.9, NULL),
 (2, 'rotate_creative', 'medium', 'creative', 'creative_id', 0.3, 0.7, NULL),
 (3, 'refine_audience', 'medium', 'age_group,ad_set,campaign', 'ad_set_id', 0.2, 0.5, NULL),
 (4, 'investigate_landing_page', 'low', 'account,channel,campaign,source', '', 0.3, 0.8, 'web_cvr'),
 (5, 'fix_tracking', 'low', 'account,channel,source', 'channel', 0.0, 0.0, NULL),
 (6, 'shift_budget', 'medium', 'account,channel,campaign', 'direction', 0.2, 0.6, NULL),
 (7, 'adjust_pacing', 'low', 'account,channel', 'channel', 0.1, 0.4, NULL))
 AS t(ord, action, risk, levels, params, low, high, watch)""")
CTES["allow"] = (("opp_rows", "acts"), """
SELECT o.id, o.cause, a.ord, a.action, a.watch FROM opp_rows o JOIN acts a
ON list_contains(string_split(a.levels, ','), o.level)
WHERE NOT (a.action = 'pause_creative' AND COALESCE(o.campaign_id, o.key) = '3')
 AND (a.params <> 'ad_set_id' OR o.level = 'ad_set' OR o.ad_set_id IS NOT NULL)""")
SQL["allowed_actions"] = with_("allow", """
SELECT o.id, COALESCE(string_agg(a.action, ',' ORDER BY a.ord), '') AS allowed
FROM opp_rows o LEFT JOIN allow a USING (id) GROUP BY 1""")
SQL["action_catalogue"] = with_("allow", """
SELECT action, risk, levels, params, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high,
  acts.watch, (SELECT count(*) FROM allow a WHERE a.action = acts.action) AS possible FROM acts""")
CTES["answers"] = ((), """
SELECT * FROM (VALUES ('creative_fatigue', 'rotate_creative', 1),
 ('creative_fatigue', 'pause_creative', 2), ('creative_fatigue', 'refine_audience', 3),
 ('landing_page_break', 'investigate_landing_page', 1), ('cpc_spike', 'shift_budget', 1),
 ('cpc_spike', 'refine_audience', 2), ('audience_mismatch', 'refine_audience', 1),
 ('tracking_break', 'fix_tracking', 1), ('budget_overpace', 'adjust_pacing', 1),
 ('channel_opportunity', 'shift_budget', 1), ('conversion_drop', 'investigate_landing_page', 1),
 ('conversion_drop', 'refine_audience', 2)) t(cause, action, place)""")
CTES["chosen"] = (("allow", "answers"), """
SELECT o.*, c.action, c.watch FROM opp_rows o LEFT JOIN (
 SELECT id, arg_min(a.action, place) AS action, arg_min(COALESCE(a.watch, ''), place) AS watch
 FROM allow a JOIN answers n ON n.cause = a.cause AND n.action = a.action GROUP BY 1) c USING (id)""")
SQL["params_for"] = with_("chosen", """
SELECT id, level AS target_level, key AS target_key, channel_id AS channel,
 CASE WHEN level = 'creative' THEN key END AS creative_id,
 CASE WHEN level = 'ad_set' THEN key ELSE ad_set_id END AS ad_set_id,
 CASE WHEN level = 'campaign' THEN key ELSE campaign_id END AS campaign_id,
 CASE WHEN action = 'shift_budget' THEN CASE WHEN kind = 'win' THEN 'into' ELSE 'out_of' END END
  AS direction FROM chosen""")
SQL["choose_action"] = with_("chosen", "SELECT id, cause, action FROM chosen")
SQL["confidence"] = with_("opp_rows", """
SELECT id, round_even(CAST(0.1 AS DOUBLE) + (1 - CAST(0.1 AS DOUBLE)) * (
  GREATEST(0, LEAST(1, abs(change_pct) / 50)) * CAST(0.35 AS DOUBLE)
  + GREATEST(0, LEAST(1, CAST(signal_count - 1 AS DOUBLE) / 3)) * CAST(0.2 AS DOUBLE)
  + CAST(0.5 AS DOUBLE) * CAST(0.2 AS DOUBLE)
  + CAST(CASE trust WHEN 'ok' THEN 1 WHEN 'warning' THEN 0.5 ELSE 0.1 END AS DOUBLE)
    * CAST(0.25 AS DOUBLE)), 4) AS confidence FROM opp_rows""")
_BAND = "CASE WHEN {p} >= 100000 THEN 'high' WHEN {p} >= 25000 THEN 'medium' ELSE 'low' END"
SQL["priority"] = with_("opp_rows", f"""
SELECT id, impact * confidence AS priority, {_BAND.format(p="impact * confidence")} AS band
FROM opp_rows""")
SQL["experiment_plan"] = with_("chosen", """
SELECT id AS opportunity_id, action, metric, CASE WHEN same THEN current END AS baseline,
 CASE WHEN NOT same THEN NULL WHEN metric = 'spend' THEN baseline
  WHEN metric IN ('cpa', 'cpc', 'frequency') THEN LEAST(current, baseline)
  ELSE GREATEST(current, baseline) END AS target,
 CAST(7 AS BIGINT) AS duration_days, 'draft' AS status FROM (
 SELECT *, COALESCE(NULLIF(watch, ''), primary_metric) AS metric,
  COALESCE(NULLIF(watch, ''), primary_metric) = primary_metric AS same FROM chosen
 WHERE action IS NOT NULL)""")
SQL["experiment_window"] = with_("exp_rows", """
SELECT id, started_on + 1 AS after_start, started_on + 7 AS after_end,
  started_on - 6 AS before_start, started_on AS before_end FROM exp_rows
WHERE started_on IS NOT NULL""")
_GAIN = """CASE metric WHEN 'spend' THEN NULL WHEN 'cpa' THEN -g WHEN 'cpc' THEN -g ELSE g END"""
_VERDICT = """CASE WHEN days < 5 OR gain IS NULL OR abs(gain) < 5 THEN 'inconclusive'
 WHEN gain > 0 THEN 'worked' ELSE 'did_not_work' END"""
SQL["verdict"] = with_("exp_rows", f"""
SELECT id, round(gain, 6) AS improvement_pct, {_VERDICT} AS verdict FROM (
 SELECT *, {_GAIN} AS gain FROM (
 SELECT *, sample_days AS days, (after_value - before_value) / NULLIF(abs(before_value), 0) * 100
  AS g FROM exp_rows WHERE status = 'completed'))""")
SQL["experiment_progress"] = with_("exp_rows", """
SELECT id, GREATEST(0, LEAST(7, date_diff('day', started_on, DATE '2001-07-31'))) AS day,
  CAST(7 AS BIGINT) AS total, DATE '2001-07-31' >= ends_on AS due FROM exp_rows
WHERE status = 'running'""")
SQL["experiments_today"] = with_("exp_rows", """
SELECT status, place, id, GREATEST(0, LEAST(7, date_diff('day', started_on, DATE '2001-07-31')))
  AS day, CAST(7 AS BIGINT) AS total, DATE '2001-07-31' >= ends_on AS due,
  CAST(NULL AS BIGINT) AS count
FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY id DESC) AS place FROM exp_rows
  WHERE status IN ('running', 'completed')) WHERE place <= 2
UNION ALL SELECT 'awaiting', NULL, NULL, NULL, NULL, NULL, count(*) FROM exp_rows
WHERE status = 'draft'""")
SQL["experiments_with_opportunity"] = with_(("exp_rows", "opp_rows"), """
SELECT e.id, e.opportunity_id, e.status, e.metric, o.level AS entity_level, o.key AS entity_key,
 o.status AS opportunity_status,
 (e.status = 'running' AND e.ends_on <= DATE '2001-07-31') AS due,
 e.status IN ('draft', 'running') AS live
FROM exp_rows e JOIN opp_rows o ON o.id = e.opportunity_id""")
_SIDE = ", ".join(f"MAX(v) FILTER (side = '{s}') AS {s}_value" for s in ("before", "after"))
SQL["evaluate_experiments"] = with_(("exp_rows", "opp_rows", "ad_level"), f"""
, due AS (SELECT e.*, o.level, o.key, o.status AS ostatus FROM exp_rows e
  JOIN opp_rows o ON o.id = e.opportunity_id
  WHERE e.status = 'running' AND e.ends_on <= DATE '2001-07-31'),
req AS (SELECT id, level, key, metric, 'before' AS side, started_on - 6 AS a, started_on AS b FROM due
  UNION ALL SELECT id, level, key, metric, 'after', started_on + 1, started_on + 7 FROM due),
daily AS (SELECT level, key, date, SUM(impressions) AS impressions, SUM(clicks) AS clicks,
  SUM(spend) AS spend, SUM(platform_conversions) AS platform_conversions,
  SUM(platform_revenue) AS platform_revenue FROM ad_level GROUP BY 1, 2, 3),
tot AS (SELECT r.id, r.side, any_value(r.metric) AS metric, count(d.date) AS days,
  {", ".join(f"{dbl(f'SUM(d.{m})')} AS {m}" for m in AD if m != "reach")}
  FROM req r LEFT JOIN daily d ON d.level = r.level AND d.key = r.key AND d.date BETWEEN r.a AND r.b
  GROUP BY 1, 2),
val AS (SELECT *, CASE metric WHEN 'cpa' THEN {kpi("cpa")} WHEN 'roas' THEN {kpi("roas")}
  WHEN 'ctr' THEN {kpi("ctr")} WHEN 'cpc' THEN {kpi("cpc")} ELSE spend / 7 END AS v FROM tot),
m AS (SELECT id, {_SIDE}, MAX(days) FILTER (side = 'after') AS days FROM val GROUP BY 1),
j AS (SELECT d.id, d.opportunity_id, d.metric, m.before_value, m.after_value,
  CAST(m.days AS BIGINT) AS sample_days, d.ends_on AS evaluated_on, d.ostatus,
  (m.after_value - m.before_value) / NULLIF(abs(m.before_value), 0) * 100 AS g, m.days
  FROM due d JOIN m USING (id))
SELECT id, opportunity_id, metric, before_value, after_value, sample_days, evaluated_on, verdict,
 CASE WHEN verdict <> 'worked' AND ostatus = 'experimenting' THEN 'open' ELSE 'resolved' END
  AS opportunity_status FROM (
 SELECT *, {_VERDICT} AS verdict FROM (SELECT *, {_GAIN} AS gain FROM j))""").replace(
    "webdays AS (SELECT 1),\n", "")
SQL["apply_decisions"] = with_(("exp_rows", "dec_rows"), """
SELECT e.id, CASE WHEN e.status = 'draft' THEN CASE WHEN e.id % 3 = 0 THEN 'running'
  ELSE 'rejected' END ELSE e.status END AS status,
 CASE WHEN e.status = 'draft' AND e.id % 3 = 0 THEN DATE '2001-07-20' ELSE e.started_on END
  AS started_on,
 CASE WHEN e.status = 'draft' AND e.id % 3 = 0 THEN DATE '2001-07-27' ELSE e.ends_on END AS ends_on,
 CASE WHEN e.status = 'draft' THEN d.reason END AS reason,
 CASE WHEN e.status = 'draft' AND e.id % 3 = 0 THEN 'experimenting' END AS opportunity_status
FROM exp_rows e JOIN dec_rows d USING (id)""")
# The whole log one step after the other: state before the step, then what the step makes of it.
_STEPS = """
WITH RECURSIVE asked AS MATERIALIZED (
 SELECT *, row_number() OVER (PARTITION BY opportunity_id ORDER BY created_on, id) AS n FROM (
 SELECT (l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey AS id, l_suppkey AS opportunity_id,
  CAST(l_shipdate AS DATE) AS created_on,
  ['draft', 'approve', 'draft', 'reject', 'approve', 'draft', 'dismiss'][
   (l_orderkey + l_linenumber * 3) % 7 + 1] AS kind,
  CASE WHEN l_orderkey % 3 <> 0 THEN 'noted ' || l_returnflag END AS reason FROM lineitem)),
walk AS (
 SELECT DISTINCT opportunity_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id,
  CAST(NULL AS DATE) AS created_on, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS VARCHAR) AS reason,
  'none' AS before, false AS accepted, 'none' AS state, CAST(NULL AS BIGINT) AS live,
  CAST(NULL AS DATE) AS started_on FROM asked
 UNION ALL
 SELECT opportunity_id, n, id, created_on, kind, reason, before, accepted,
  CASE WHEN NOT accepted OR kind = 'dismiss' THEN before
   ELSE CASE kind WHEN 'draft' THEN 'draft' WHEN 'approve' THEN 'running' ELSE 'none' END END,
  CASE WHEN accepted AND kind = 'draft' THEN id ELSE live END,
  CASE WHEN accepted AND kind = 'approve' THEN created_on ELSE started_on END FROM (
  SELECT *, CASE kind WHEN 'draft' THEN before = 'none' WHEN 'dismiss' THEN true
    ELSE before = 'draft' END AS accepted FROM (
   SELECT a.opportunity_id, a.n, a.id, a.created_on, a.kind, a.reason, w.live, w.started_on,
    CASE WHEN w.state = 'running' AND w.started_on + 7 <= a.created_on THEN 'none'
     ELSE w.state END AS before
   FROM walk w JOIN asked a ON a.opportunity_id = w.opportunity_id AND a.n = w.n + 1))),
steps AS (
 SELECT id, opportunity_id, created_on, kind, reason, accepted,
  CASE WHEN met THEN live END AS experiment_id,
  CASE WHEN met THEN CASE WHEN accepted AND kind = 'reject' THEN 'rejected' ELSE state END END
   AS status,
  CASE WHEN met AND state = 'running' THEN started_on END AS started_on,
  CASE WHEN met AND state = 'running' THEN started_on + 7 END AS ends_on FROM (
  SELECT *, kind <> 'dismiss' AND (before <> 'none' OR accepted) AS met FROM walk WHERE n > 0))
"""
SQL["experiment_lifecycle"] = _STEPS + "SELECT * FROM steps"
SQL["lifecycle_experiments"] = _STEPS + """
SELECT experiment_id AS id, opportunity_id,
 CASE WHEN last.status = 'running' AND last.ends_on <= DATE '2001-07-31' THEN 'completed'
  ELSE last.status END AS status, last.reason AS reason, drafted_on, last.started_on AS started_on,
 last.ends_on AS ends_on FROM (
 SELECT experiment_id, opportunity_id, MIN(created_on) AS drafted_on,
  arg_max({'status': status, 'reason': reason, 'started_on': started_on, 'ends_on': ends_on},
   CASE kind WHEN 'draft' THEN 0 ELSE 1 END) AS last
 FROM steps WHERE accepted AND kind <> 'dismiss' GROUP BY 1, 2)"""
SQL["lifecycle_decisions"] = _STEPS + """
SELECT s.id, s.kind, s.opportunity_id, CASE WHEN s.kind <> 'dismiss' THEN s.experiment_id END
 AS experiment_id, s.reason, CAST(abs(CAST(c.c_acctbal AS DECIMAL(14,2))) AS DOUBLE) * 20 AS impact,
 s.created_on FROM steps s JOIN customer c ON c.c_custkey = s.opportunity_id
WHERE s.accepted AND s.kind <> 'draft'"""
# Everything that sets an opportunity's status, in order; a change completes before its day's steps.
SQL["lifecycle_opportunities"] = _STEPS + """
, moves AS (
 SELECT opportunity_id, created_on AS d, 1 AS late, id,
  CASE kind WHEN 'dismiss' THEN 'dismissed' ELSE 'experimenting' END AS status, reason
 FROM steps WHERE accepted AND kind IN ('approve', 'dismiss')
 UNION ALL SELECT opportunity_id, ends_on, 0, id, 'measured', NULL FROM steps
 WHERE accepted AND kind = 'approve' AND ends_on <= DATE '2001-07-31')
SELECT opportunity_id, status, CASE WHEN status = 'dismissed' THEN reason END AS dismissed_reason
FROM (SELECT *, row_number() OVER (PARTITION BY opportunity_id ORDER BY d DESC, late DESC, id DESC)
 AS r FROM moves) WHERE r = 1"""
SQL["decision_chain"] = with_(("exp_rows", "dec_rows", "opp_rows"), """
SELECT d.id, d.kind, d.opportunity_id, d.experiment_id, d.reason, d.created_on, o.entity_name,
 o.primary_metric, e.action, e.verdict FROM dec_rows d JOIN opp_rows o ON o.id = d.opportunity_id
LEFT JOIN exp_rows e ON e.id = d.experiment_id ORDER BY d.created_on DESC, d.id DESC LIMIT 200""")
SQL["decisions_by_month"] = with_(("exp_rows", "dec_rows"), """
SELECT CAST(date_trunc('month', d.created_on) AS DATE) AS month, count(*) AS decisions,
 count(*) FILTER (e.verdict = 'worked') AS worked FROM dec_rows d
LEFT JOIN exp_rows e ON e.id = d.experiment_id GROUP BY 1""")
SQL["settings_view"] = with_("ad", """
, s AS (SELECT CAST(n_nationkey AS BIGINT) AS business_id, CAST(20 + n_nationkey * 4 AS DOUBLE)
  AS gross_margin_pct, CAST(1 + n_nationkey % 5 AS DOUBLE) AS target_roas, n_nationkey AS k
  FROM nation),
c AS (SELECT DISTINCT campaign_id FROM ad)
SELECT business_id, gross_margin_pct, target_roas,
 CASE WHEN gross_margin_pct <= 100 THEN 100 / gross_margin_pct END AS break_even_roas,
 CASE WHEN gross_margin_pct <= 100 THEN target_roas > 100 / gross_margin_pct END
  AS target_profitable,
 CASE WHEN CAST(k AS VARCHAR) IN (SELECT campaign_id FROM c) THEN 0 ELSE CAST(1 AS BIGINT) END
 + CASE WHEN CAST(k % 10 AS VARCHAR) IN (SELECT campaign_id FROM c) THEN 0 ELSE 1 END
  AS unknown_campaigns FROM s""")

# Campaign windows read as opportunities on ROAS: causes from the dominant chain, then the action.
CTES["owner1"] = (("drv2",), """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY as_of, key
 ORDER BY abs(share_pct) DESC, ord) AS r FROM drv) WHERE r = 1 AND abs(share_pct) >= 60""")
CTES["owner2"] = (("owner1",), """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY as_of, key
 ORDER BY abs(share_pct) DESC, ord) AS r FROM drv2) WHERE r = 1 AND abs(share_pct) >= 60
 AND (as_of, key) IN (SELECT as_of, key FROM owner1 WHERE driver = 'cpc')""")
CTES["cases"] = (("owner2", "deepwin"), """
SELECT c.as_of, c.key, cur_roas_v AS cur, base_roas_v AS base, w.cur_spend AS spend,
 CASE WHEN cur_roas_v < base_roas_v THEN 'issue' ELSE 'win' END AS kind,
 a.driver AS d1, a.change_pct AS c1, b.driver AS d2, b.change_pct AS c2,
 COALESCE(b.share_pct, a.share_pct) AS last_share
FROM camp c JOIN deepwin w ON w.level = 'campaign' AND w.key = c.key AND w.as_of = c.as_of
LEFT JOIN owner1 a ON a.as_of = c.as_of AND a.key = c.key
LEFT JOIN owner2 b ON b.as_of = c.as_of AND b.key = c.key
WHERE cur_roas_v IS NOT NULL AND base_roas_v IS NOT NULL""")
CTES["reading"] = (("cases",), """
SELECT *, CAST(row_number() OVER (PARTITION BY as_of, key ORDER BY weight DESC, ord) - 1 AS BIGINT)
 AS place FROM (
 SELECT as_of, key, kind, 1 AS ord, 'channel_opportunity' AS cause, CAST(0.9 AS DOUBLE) AS weight
 FROM cases WHERE kind = 'win'
 UNION ALL SELECT as_of, key, kind, 2, 'creative_fatigue', CAST(0.7 AS DOUBLE) FROM cases
 WHERE kind = 'issue' AND d2 = 'ctr' AND c2 < 0
 UNION ALL SELECT as_of, key, kind, 3, 'cpc_spike', CAST(0.7 AS DOUBLE) FROM cases
 WHERE kind = 'issue' AND d2 = 'cpm' AND c2 > 0
 UNION ALL SELECT as_of, key, kind, 4, 'conversion_drop', CAST(0.5 AS DOUBLE) FROM cases
 WHERE kind = 'issue' AND d1 = 'cvr' AND c1 < 0
 UNION ALL SELECT as_of, key, kind, 5, 'cpc_spike', CAST(0.4 AS DOUBLE) FROM cases
 WHERE kind = 'issue' AND d1 = 'cpc' AND d2 IS NULL)""")
CTES["ranked_causes"] = (("reading",), """
SELECT as_of, key, kind, place, cause, weight FROM reading
UNION ALL SELECT as_of, key, kind, 0, 'unknown', 0 FROM cases c WHERE NOT EXISTS (
 SELECT 1 FROM reading r WHERE r.as_of = c.as_of AND r.key = c.key)""")
SQL["diagnose"] = with_("ranked_causes", "SELECT * FROM ranked_causes")
_SURE = """round_even(CAST(0.1 AS DOUBLE) + (1 - CAST(0.1 AS DOUBLE)) * (
 GREATEST(0, LEAST(1, abs((cur - base) / abs(base) * 100) / 50)) * CAST(0.35 AS DOUBLE)
 + GREATEST(0, LEAST(1, COALESCE(abs(last_share) / 100, CAST(0.5 AS DOUBLE)))) * CAST(0.2 AS DOUBLE)
 + CAST(0.25 AS DOUBLE)), 4)"""
SQL["recommend"] = with_("ranked_causes", f"""
, act AS (SELECT as_of, key, arg_min(CASE cause WHEN 'conversion_drop'
  THEN 'investigate_landing_page' ELSE 'shift_budget' END, place) AS action FROM ranked_causes
 WHERE cause IN ('channel_opportunity', 'cpc_spike', 'conversion_drop') GROUP BY 1, 2),
v AS (SELECT c.*, a.action, abs(cur - base) * spend AS impact, {_SURE} AS confidence
 FROM cases c LEFT JOIN act a ON a.as_of = c.as_of AND a.key = c.key)
SELECT as_of, key, action, confidence, round(impact * confidence, 4) AS priority,
 {_BAND.format(p="impact * confidence")} AS band,
 round(impact * CAST(CASE action WHEN 'shift_budget' THEN 0.2
  WHEN 'investigate_landing_page' THEN 0.3 END AS DOUBLE), 4) AS impact_low,
 round(impact * CAST(CASE action WHEN 'shift_budget' THEN 0.6
  WHEN 'investigate_landing_page' THEN 0.8 END AS DOUBLE), 4) AS impact_high,
 CASE action WHEN 'shift_budget' THEN 'medium' WHEN 'investigate_landing_page' THEN 'low' END
  AS risk,
 CASE action WHEN 'shift_budget' THEN 'roas' WHEN 'investigate_landing_page' THEN 'web_cvr' END
  AS watch FROM v""")
