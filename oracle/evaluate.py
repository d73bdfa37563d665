"""Oracle SQL of the accuracy evaluation."""

from __future__ import annotations

from oracle.base import CTES, with_
from oracle import detect, explain, report  # noqa: F401  (shared expressions)

SQL: dict[str, str] = {}
CTES["ev"] = ((), """
SELECT *, CASE WHEN k % 16 = 6 THEN CAST([] AS VARCHAR[]) WHEN kind = 'creative_fatigue' THEN [
   'creative:' || concat_ws('/', src, k % 80 % 10, k % 80 % 40, pid),
   'campaign:' || concat_ws('/', src, k % 80 % 10),
   'ad_set:' || concat_ws('/', src, k % 80 % 10, k % 80 % 40)]
  WHEN kind = 'audience_mismatch' THEN ['ad_set:' || concat_ws('/', src, k % 40 % 10, pid),
   'age_group:' || concat_ws('/', src, k % 40 % 10, pid) || '|' || age,
   'campaign:' || concat_ws('/', src, k % 40 % 10)]
  WHEN kind = 'cpc_spike' THEN ['campaign:' || src || '/' || pid] ELSE ['channel:' || src] END AS entities,
 ['cpa', 'ctr', 'cpc', 'roas', 'spend'][k % 5 + 1] AS main, CASE kind
  WHEN 'creative_fatigue' THEN ['roas', 'cvr'] WHEN 'audience_mismatch' THEN ['roas']
  WHEN 'channel_opportunity' THEN ['mer', 'store_revenue'] WHEN 'cpc_spike' THEN ['roas']
  WHEN 'landing_page_break' THEN ['bounce_rate', 'atc_rate', 'checkout_rate', 'purchase_rate',
   'web_cvr'] ELSE CAST([] AS VARCHAR[]) END AS extra,
 list_distinct(list_concat([main], extra)) AS metrics,
 CASE kind WHEN 'tracking_break' THEN ['tracking_break'] WHEN 'budget_overpace' THEN ['goal_breach']
  ELSE CAST([] AS VARCHAR[]) END AS detectors,
 CASE kind WHEN 'channel_opportunity' THEN 'win' ELSE 'issue' END AS kind_expected,
 kind <> 'no_issue' AS injected, s + CAST(k % 9 + 3 AS INTEGER) AS e FROM (
 SELECT s_suppkey AS k, 'ev-' || s_suppkey AS id,
  ['creative_fatigue', 'audience_mismatch', 'landing_page_break', 'cpc_spike', 'channel_opportunity',
   'tracking_break', 'budget_overpace', 'no_issue'][s_suppkey % 8 + 1] AS kind,
  DATE '1995-01-25' + CAST(s_suppkey * 97 % 2400 AS INTEGER) AS s,
  CASE s_suppkey % 8 WHEN 0 THEN CAST(s_suppkey % 80 AS VARCHAR)
   WHEN 1 THEN CAST(s_suppkey % 40 AS VARCHAR) ELSE CAST(s_suppkey % 10 AS VARCHAR) END AS pid,
  ['google_ads', 'meta_ads'][s_suppkey % 2 + 1] AS src,
  ['18-24', '25-34', '35-44', '45+'][s_suppkey % 4 + 1] AS age FROM supplier)""")
SQL["read_labelled_events"] = with_("ev", """
SELECT id, kind, s AS start, e AS "end", CASE WHEN k % 2 = 0 THEN 'sudden' ELSE 'gradual' END AS onset,
 array_to_string(entities, ',') AS entities, array_to_string(list_concat(
  [main], list_filter(extra, lambda x: x <> main)), ',') AS metrics,
 array_to_string(detectors, ',') AS detectors, kind_expected,
 ['baseline_change', 'goal_breach'][k % 2 + 1] AS expected_signal_type,
 CASE WHEN injected THEN ['rotate_creative', 'refine_audience', 'investigate_landing_page',
  'shift_budget', 'shift_budget', 'fix_tracking', 'adjust_pacing', 'none'][k % 8 + 1] END
  AS expected_action, injected FROM ev""")
CTES["sight"] = (("ad",), """
SELECT *, CASE WHEN cpa > 800 THEN 'issue' ELSE 'win' END AS kind,
 ['roas', 'ctr', 'cpc'][clicks % 3 + 1] AS second,
 ['baseline_change', 'goal_breach', 'tracking_break'][clicks % 3 + 1] AS detector FROM (
 SELECT entity AS key, channel_id, date AS as_of, CAST(SUM(spend) AS DOUBLE) AS score,
  CAST(SUM(spend) AS DOUBLE) / NULLIF(CAST(SUM(platform_conversions) AS DOUBLE), 0) AS cpa,
  CAST(SUM(clicks) AS BIGINT) AS clicks FROM (
  SELECT 'campaign:' || channel_id || '/' || campaign_id AS entity, ad.* FROM ad
  UNION ALL SELECT 'channel:' || channel_id, ad.* FROM ad
  UNION ALL SELECT 'creative:' || concat_ws('/', channel_id, campaign_id, ad_set_id,
   creative_id), ad.* FROM ad) GROUP BY 1, 2, 3)
WHERE cpa > 800 OR cpa < 350""")
CTES["epi"] = (("sight",), """
SELECT key, key AS entity, arg_min(kind, as_of) AS kind, MIN(as_of) AS detected_on,
 MAX(as_of) AS closed_on, MIN(as_of) - 6 AS window_start, MAX(as_of) AS window_end,
 list_sort(list_distinct(list_concat(['cpa'], list(second)))) AS metrics,
 list_sort(list_distinct(list(detector))) AS detectors, MAX(score) AS peak_score,
 count(*) AS days_open FROM (
 SELECT *, SUM(opens) OVER (PARTITION BY key ORDER BY as_of) AS island FROM (
  SELECT *, CASE WHEN date_diff('day', lag(as_of) OVER (PARTITION BY key ORDER BY as_of), as_of) <= 2
   THEN 0 ELSE 1 END AS opens FROM sight)) GROUP BY key, island""")
CTES["shown_signals"] = (("specific",), """
SELECT as_of, entity_id, arg_max(adverse, (score, id)) AS adverse, MAX(score) AS score,
 list_distinct(list(metric)) AS metrics, list_distinct(list(detector)) AS detectors
FROM specific GROUP BY 1, 2""")
CTES["repi"] = (("shown_signals",), """
SELECT entity_id AS key, entity_id AS entity,
 CASE WHEN arg_min(adverse, as_of) THEN 'issue' ELSE 'win' END AS kind, MIN(as_of) AS detected_on,
 MAX(as_of) AS closed_on, MIN(as_of) - 6 AS window_start, MAX(as_of) AS window_end,
 list_sort(list_distinct(flatten(list(metrics)))) AS metrics,
 list_sort(list_distinct(flatten(list(detectors)))) AS detectors, MAX(score) AS peak_score,
 count(*) AS days_open FROM (
 SELECT *, SUM(opens) OVER (PARTITION BY entity_id ORDER BY as_of) AS island FROM (
  SELECT *, CASE WHEN date_diff('day', lag(as_of) OVER (PARTITION BY entity_id ORDER BY as_of), as_of)
   <= 2 THEN 0 ELSE 1 END AS opens FROM shown_signals)) GROUP BY entity_id, island""")
SQL["replay_episodes"] = with_("repi", """
SELECT key, entity, kind, detected_on, closed_on, window_start, window_end,
 array_to_string(metrics, ',') AS metrics, array_to_string(detectors, ',') AS detectors,
 peak_score, days_open FROM repi""")
SQL["alert_episodes"] = with_("epi", """
SELECT key, entity, kind, detected_on, closed_on, window_start, window_end,
 array_to_string(metrics, ',') AS metrics, array_to_string(detectors, ',') AS detectors,
 peak_score, days_open FROM epi""")
_SEEN = ("e >= (SELECT MIN(as_of) FROM days_asked) AND s <= (SELECT MAX(as_of) FROM days_asked)")
# Matches and scores of the stand-in's episodes, and of those of the replay (r).
for r in ("", "r"):
    CTES[r + "hit"] = (("ev", r + "epi", "days_asked"), f"""
SELECT v.id AS event_id, p.key, p.detected_on FROM ev v JOIN {r}epi p ON p.kind = v.kind_expected
 AND (len(v.entities) = 0 OR list_contains(v.entities, p.entity)) AND p.window_start <= v.e AND v.s <= p.window_end
 AND CASE WHEN len(v.detectors) > 0 THEN list_has_any(p.detectors, v.detectors)
  ELSE list_has_any(p.metrics, v.metrics) END WHERE v.injected AND {_SEEN}""")
    CTES[r + "found"] = ((r + "hit", "days_asked"), f"""
SELECT v.id, v.kind, v.s, v.e, MIN(h.detected_on) AS detected_on,
 date_diff('day', v.s, MIN(h.detected_on)) AS lag FROM ev v LEFT JOIN {r}hit h ON h.event_id = v.id
WHERE v.injected AND {_SEEN} GROUP BY 1, 2, 3, 4""")
    CTES[r + "loose"] = ((r + "hit",), f"""
SELECT * FROM {r}epi WHERE (key, detected_on) NOT IN (SELECT key, detected_on FROM {r}hit)""")
    CTES[r + "dscore"] = ((r + "found", r + "loose"), f"""
SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall)
 END AS f1 FROM (
SELECT injected, detected, injected - detected AS missed, episodes, unexplained, noisy_windows,
 out_of_range, quiet_windows,
 COALESCE(CAST(episodes - unexplained AS DOUBLE) / NULLIF(episodes, 0), 0) AS precision,
 COALESCE(CAST(detected AS DOUBLE) / NULLIF(injected, 0), 0) AS recall,
 COALESCE(CAST(quick AS DOUBLE) / NULLIF(injected, 0), 0) AS recall_within_3,
 COALESCE(CAST(noisy_windows AS DOUBLE) / NULLIF(quiet_windows, 0), 0) AS false_alarm_rate FROM (
 SELECT (SELECT count(*) FROM {r}found) AS injected, (SELECT count(detected_on) FROM {r}found) AS detected,
 (SELECT count(*) FROM {r}found WHERE lag <= 3) AS quick, (SELECT count(*) FROM {r}epi) AS episodes,
 (SELECT count(*) FROM {r}loose) AS unexplained,
 (SELECT count(*) FROM ev WHERE NOT injected AND {_SEEN}) AS quiet_windows,
 (SELECT count(*) FROM ev WHERE NOT injected AND {_SEEN} AND EXISTS (
   SELECT 1 FROM {r}loose WHERE detected_on BETWEEN s AND e)) AS noisy_windows,
 (SELECT count(*) FROM ev WHERE injected AND NOT ({_SEEN})) AS out_of_range))""")
SQL["match_episodes"] = with_("hit", "SELECT * FROM hit")
SQL["detection_score"] = with_("dscore", "SELECT * FROM dscore")
SQL["replay_score"] = with_("rdscore", "SELECT * FROM rdscore")
SQL["days_to_detect"] = with_("found", """
SELECT kind, count(*) AS injected, count(detected_on) AS detected,
 count(*) FILTER (lag <= 3) AS in_time, median(lag) AS median_lag, MAX(lag) AS worst_lag
FROM found GROUP BY 1""")
SQL["split_suppressed"] = with_("found", """
SELECT id, kind, detected_on, lag, CASE WHEN detected_on IS NOT NULL THEN 'detected'
 WHEN s <= DATE '2001-05-10' AND DATE '2001-05-01' <= e THEN 'suppressed' ELSE 'missed' END AS outcome
FROM found""")
SQL["false_positives"] = with_("loose", """
SELECT key, detected_on, kind, peak_score, days_open FROM loose
ORDER BY peak_score DESC, key, detected_on LIMIT 15""")
_C7 = """['creative_fatigue', 'landing_page_break', 'cpc_spike', 'audience_mismatch', 'tracking_break',
 'budget_overpace', 'channel_opportunity']"""
CTES["diag"] = (("chosen",), f"""
SELECT COALESCE(kind, 'all') AS kind, cases, top1_hits, top3_hits, action_hits, action_cases,
 CAST(top1_hits AS DOUBLE) / cases AS top1, CAST(top3_hits AS DOUBLE) / cases AS top3,
 COALESCE(CAST(action_hits AS DOUBLE) / NULLIF(action_cases, 0), 0) AS action_accuracy FROM (
 SELECT kind, count(*) AS cases, count(*) FILTER (cause = kind) AS top1_hits,
  count(*) FILTER (cause = kind OR c2 = kind OR c3 = kind) AS top3_hits,
  count(*) FILTER (wanted IS NOT NULL AND action = wanted) AS action_hits,
  count(wanted) AS action_cases FROM (
  SELECT {_C7}[id % 7 + 1] AS kind, cause, {_C7}[(id + 2) % 7 + 1] AS c2,
   {_C7}[(id + 3) % 7 + 1] AS c3, action, CASE WHEN id % 5 <> 0 THEN
   ['rotate_creative', 'refine_audience', 'shift_budget'][id % 3 + 1] END AS wanted FROM chosen)
 GROUP BY ROLLUP(kind))""")
SQL["diagnosis_score"] = with_("diag", "SELECT * FROM diag")
CTES["brk"] = (("ev",), "SELECT id, s, e, src AS channel_id FROM ev WHERE kind = 'tracking_break'")
CTES["outcome"] = (("brk", "tracking", "sight"), """
SELECT b.id, b.channel_id, b.s, count(j.as_of) AS window_days,
 count(*) FILTER (j.called) AS caught_days, MIN(j.as_of) FILTER (j.called) AS caught_on,
 (SELECT count(DISTINCT a.key) FROM sight a JOIN tracking t ON t.as_of = a.as_of
  AND t.channel_id = a.channel_id AND t.status = 'broken' WHERE a.as_of BETWEEN b.s AND b.e
  AND a.channel_id = b.channel_id AND a.detector <> 'tracking_break') AS leaked
FROM brk b LEFT JOIN (SELECT as_of, channel_id, bool_or(own) AS called FROM (
  SELECT x.as_of, c.channel_id, x.channel_id = c.channel_id AND x.status = 'broken' AS own
  FROM tracking x, (SELECT DISTINCT channel_id FROM tracking) c) GROUP BY 1, 2) j
 ON j.channel_id = b.channel_id AND j.as_of BETWEEN b.s AND b.e GROUP BY 1, 2, 3, b.e""")
SQL["break_outcomes"] = with_("outcome", """
SELECT id, channel_id, window_days, caught_days, caught_on,
 date_diff('day', s, caught_on) AS lag_days, leaked FROM outcome""")
CTES["tscore"] = (("outcome",), """
SELECT *, COALESCE(CAST(caught AS DOUBLE) / NULLIF(breaks, 0), 0) AS accuracy,
 COALESCE(CAST(held_back AS DOUBLE) / NULLIF(breaks, 0), 0) AS suppression,
 COALESCE(CAST(false_days AS DOUBLE) / NULLIF(judged_days, 0), 0) AS false_alarm_rate FROM (
 SELECT count(*) FILTER (window_days > 0) AS breaks, count(*) FILTER (window_days = 0) AS uncovered,
  count(caught_on) AS caught,
  count(*) FILTER (caught_on IS NOT NULL AND leaked = 0) AS held_back,
  (SELECT count(*) FROM tracking t WHERE status = 'broken' AND NOT EXISTS (
    SELECT 1 FROM brk b WHERE t.as_of BETWEEN b.s AND b.e)) AS false_days,
  (SELECT count(*) FROM tracking) AS judged_days FROM outcome)""")
SQL["trust_score"] = with_("tscore", "SELECT * FROM tscore")
_CALLS = report.SQL["grounding_score"].strip()
SQL["scorecard"] = with_(("dscore", "diag", "tscore"), f"""
, calls AS ({_CALLS})
SELECT 'Detection within 3 days' AS criterion, CAST(0.8 AS DOUBLE) AS target,
 recall_within_3 AS measured, recall_within_3 >= CAST(0.8 AS DOUBLE) AS passed FROM dscore
UNION ALL SELECT 'False alarms', 0.1, false_alarm_rate, false_alarm_rate < CAST(0.1 AS DOUBLE)
 FROM dscore
UNION ALL SELECT 'Cause in the top three', 0.8, top3, top3 >= CAST(0.8 AS DOUBLE) FROM diag
 WHERE kind = 'all'
UNION ALL SELECT 'Tracking breaks caught', 0.9, accuracy, accuracy >= CAST(0.9 AS DOUBLE) FROM tscore
UNION ALL SELECT 'Advice suppressed while broken', 0.9, suppression,
 suppression >= CAST(0.9 AS DOUBLE) FROM tscore
UNION ALL SELECT 'Ungrounded numbers shown', 0, leaked, leaked <= 0 FROM calls
 WHERE purpose = 'all'""")
