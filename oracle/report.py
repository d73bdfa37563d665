"""Oracle SQL of opportunity lists, weekly totals and the text checks."""

from __future__ import annotations

from oracle.base import CTES, dbl, with_
from oracle import explain  # noqa: F401  (stored tables)
from oracle.explain import _BAND

SQL: dict[str, str] = {}

SQL["opportunity_list"] = with_("opp_rows", """
SELECT id, status, kind, priority, score FROM opp_rows
WHERE status IN ('open', 'experimenting') AND kind = 'issue'
ORDER BY priority DESC NULLS LAST, score DESC, id LIMIT 50""")
_TITLE = """entity_name || CASE primary_metric
 WHEN 'cpa' THEN CASE kind WHEN 'issue' THEN ' costs more per sale' ELSE ' costs less per sale' END
 WHEN 'roas' THEN CASE kind WHEN 'issue' THEN ' is earning less per rupee'
   ELSE ' is earning more per rupee' END
 WHEN 'ctr' THEN CASE kind WHEN 'issue' THEN ' is getting fewer clicks'
   ELSE ' is getting more clicks' END
 WHEN 'cpc' THEN CASE kind WHEN 'issue' THEN ' is paying more per click'
   ELSE ' is paying less per click' END
 WHEN 'spend' THEN CASE kind WHEN 'issue' THEN ' is spending ahead of plan'
   ELSE ' is spending behind plan' END
 ELSE CASE kind WHEN 'issue' THEN ': frequency moved the wrong way'
   ELSE ': frequency moved the right way' END END"""
SQL["opportunity_summary"] = with_("opp_rows", f"""
SELECT id, {_TITLE} AS title, CASE WHEN priority IS NULL THEN 'low' ELSE {_BAND.format(p="priority")}
  END AS band, date_diff('day', first_seen_date, last_seen_date) AS age_days,
 CASE cause WHEN 'creative_fatigue' THEN 'Creative fatigue'
  WHEN 'landing_page_break' THEN 'Landing page problem' WHEN 'cpc_spike' THEN 'Rising auction cost'
  WHEN 'audience_mismatch' THEN 'Audience mismatch'
  WHEN 'tracking_break' THEN 'Broken conversion tracking'
  WHEN 'budget_overpace' THEN 'Spending ahead of budget'
  WHEN 'channel_opportunity' THEN 'Room to scale'
  WHEN 'conversion_drop' THEN 'Fewer clicks converting' ELSE 'Not clear from the data' END
  AS cause_label, signal_count, current, baseline, change_pct FROM opp_rows""")
_SHOWN = """CASE WHEN primary_metric = 'ctr' THEN printf('%.2f', {v} * 100) || '%'
 WHEN primary_metric IN ('roas', 'frequency') THEN printf('%.2f', {v}) || 'x'
 ELSE '₹' || printf('%.0f', {v}) END"""
SQL["opportunity_headlines"] = with_("opp_rows", f"""
SELECT id, {_TITLE} AS title, CASE WHEN change_pct > 0 THEN 'rose ' ELSE 'fell ' END
 || printf('%.0f', abs(change_pct)) || '%' AS moved, {_SHOWN.format(v="current")} AS current_text,
 {_SHOWN.format(v="baseline")} AS baseline_text FROM opp_rows""")
CTES["keyed"] = (("opp_rows",), """
SELECT *, level || ':' || key || '#' || id AS k2 FROM opp_rows""")
SQL["seen_dates"] = with_("keyed", """
SELECT k2 AS key, DATE '2001-07-25' AS window_start, first_seen_date, last_seen_date
FROM keyed WHERE id % 2 = 0""")
_FIRST = """CASE WHEN date_diff('day', last_seen_date, DATE '2001-07-25') > 7 THEN DATE '2001-07-25'
 ELSE LEAST(first_seen_date, DATE '2001-07-25') END"""
SQL["first_seen"] = with_("keyed", f"SELECT k2 AS key, {_FIRST} AS first_seen FROM keyed WHERE id % 2 = 0")
SQL["save_opportunities"] = with_("keyed", f"""
SELECT k2 AS key, CASE WHEN id % 2 = 0 THEN CASE WHEN status = 'resolved' THEN 'open' ELSE status END
  WHEN status = 'open' THEN 'resolved' ELSE status END AS status,
 CASE WHEN id % 2 = 0 THEN {_FIRST} ELSE first_seen_date END AS first_seen_date,
 CASE WHEN id % 2 = 0 THEN DATE '2001-07-31' ELSE last_seen_date END AS last_seen_date,
 CASE WHEN id % 2 = 0 THEN score * 2 ELSE score END AS score FROM keyed WHERE id % 5 <> 0
UNION ALL SELECT k2, 'open', DATE '2001-07-25', DATE '2001-07-31', score * 2 FROM keyed
 WHERE id % 2 = 0 AND id % 5 = 0
UNION ALL SELECT k2 || '-new', 'open', DATE '2001-07-25', DATE '2001-07-31', score * 2 FROM keyed
 WHERE id % 2 = 0""")
_WEEK = ("DATE '2001-07-31' - 7 * CAST(floor(CAST(date_diff('day', {d}, DATE '2001-07-31') AS DOUBLE)"
         " / 7) AS INTEGER)")
SQL["weekly_issue_win_totals"] = with_("opp_rows", f"""
SELECT {_WEEK.format(d="window_end")} AS week_end,
 COALESCE(CAST(SUM(CAST(abs(impact) AS DECIMAL(24,6))) FILTER (kind = 'issue') AS DOUBLE), 0)
  AS issue_cost,
 COALESCE(CAST(SUM(CAST(abs(impact) AS DECIMAL(24,6))) FILTER (kind = 'win') AS DOUBLE), 0)
  AS win_upside,
 count(*) FILTER (kind = 'issue') AS issues, count(*) FILTER (kind = 'win') AS wins
FROM opp_rows GROUP BY 1""")
CTES["week_ends"] = (("ad", "store"), f"""
SELECT DISTINCT {_WEEK.format(d="date")} AS week_end FROM (
 SELECT date FROM ad UNION SELECT date FROM store) WHERE date <= DATE '2001-07-31'""")
SQL["report_history"] = with_("week_ends", f"""
, r AS (SELECT {_WEEK.format(d="date")} AS week_end, {dbl("SUM(revenue)")} AS store_revenue FROM store
  WHERE date <= DATE '2001-07-31' GROUP BY 1)
SELECT week_end, week_end - 6 AS week_start, CASE WHEN week_end >= DATE '2001-07-01'
 THEN 'regenerated' ELSE 'template' END AS source, DATE '2001-07-31' AS next_week_end,
 true AS covered, store_revenue FROM week_ends LEFT JOIN r USING (week_end)
ORDER BY week_end DESC LIMIT 52""")
# No number of a report may be outside its payload.
SQL["ungrounded_report_numbers"] = """
SELECT CAST(NULL AS DATE) AS week_end, CAST(0 AS DOUBLE) AS value, CAST(0 AS BIGINT) AS times
WHERE false"""
SQL["quotable_numbers"] = with_("opp_rows", """
, n AS (SELECT id, unnest([current, baseline, CASE WHEN primary_metric = 'ctr' THEN current * 100
   ELSE current END, CASE WHEN primary_metric = 'ctr' THEN baseline * 100 ELSE baseline END,
   change_pct, impact, confidence, confidence * 100, CAST(day(window_end) AS DOUBLE),
   CAST(month(window_end) AS DOUBLE), CAST(year(window_end) AS DOUBLE), 7]) AS v FROM opp_rows)
SELECT DISTINCT id, round(abs(v), 6) AS value FROM (SELECT id, v FROM n
 UNION ALL SELECT id, v / 100000 FROM n WHERE abs(v) >= 100000
 UNION ALL SELECT id, v / 10000000 FROM n WHERE abs(v) >= 10000000)""")

# Numbers in documents: the character before a number is consumed here instead of looked behind
# at; per cent signs and multiples do not change a value and need no mention.
_RE = r"(?:^|[^\p{L}\p{N}_.])([0-9][0-9,]*(?:\.[0-9]+)?)(?:\s*(l|lakhs?|cr|crore)(?:$|[^\p{L}\p{N}_]))?"
CTES["docnums"] = ((), f"""
SELECT doc_id, CAST(replace(regexp_extract(m, '{_RE}', 1, 'i'), ',', '') AS DOUBLE) AS bare,
 lower(regexp_extract(m, '{_RE}', 2, 'i')) AS unit FROM (
 SELECT doc_id, unnest(regexp_extract_all(text, '{_RE}', 0, 'i')) AS m FROM documents)""")
CTES["docvals"] = (("docnums",), """
SELECT doc_id, bare AS value FROM docnums UNION ALL
SELECT doc_id, bare * CASE WHEN unit LIKE 'l%' THEN 100000 ELSE 10000000 END FROM docnums
WHERE unit <> ''""")
SQL["numbers_in_text"] = with_("docvals", """
SELECT doc_id, value, count(*) AS times FROM docvals GROUP BY 1, 2""")
SQL["ungrounded_numbers"] = with_("docvals", """
, p AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS p FROM documents
  UNION ALL SELECT doc_id, CAST(len(string_split(text, ' ')) AS DOUBLE) FROM documents
  UNION ALL SELECT doc_id, CAST(100 AS DOUBLE) FROM documents)
SELECT doc_id, value, count(*) AS times FROM docvals v WHERE NOT EXISTS (
 SELECT 1 FROM p WHERE p.doc_id = v.doc_id AND abs(v.value - p.p)
  <= GREATEST(GREATEST(v.value, p.p) * CAST(0.02 AS DOUBLE), CAST(0.5 AS DOUBLE))) GROUP BY 1, 2""")
SQL["ungrounded_references"] = with_(("keyed", "allow"), """
, p AS (SELECT *, ['pause_creative', 'rotate_creative', 'refine_audience',
  'investigate_landing_page', 'fix_tracking', 'shift_budget', 'adjust_pacing', 'raise_bids'][id % 8 + 1]
  AS action, COALESCE(campaign_id, CASE WHEN level = 'campaign' THEN key END, '') = '3' AS protected
  FROM keyed)
SELECT id, 'unknown id ' || k2 || '?' AS problem FROM keyed WHERE id % 3 = 0
UNION ALL SELECT id, action || ': ' || CASE WHEN action = 'raise_bids' THEN 'not in the catalogue'
 WHEN protected THEN 'campaign is protected' ELSE 'cannot be taken on a ' || level END FROM p
WHERE NOT EXISTS (SELECT 1 FROM allow a WHERE a.id = p.id AND a.action = p.action)""")
SQL["grounding_score"] = """
WITH c AS (SELECT role AS purpose, turn + 1 AS attempt, turn % 2 = 0 AS grounded,
  turn = MAX(turn) OVER (PARTITION BY conv_id) AS fallback, length(text) < 200 AS bad
  FROM conversations)
SELECT COALESCE(purpose, 'all') AS purpose, count(*) AS attempts,
 count(*) FILTER (attempt = 1) AS answers, count(*) FILTER (NOT grounded AND NOT bad) AS ungrounded,
 count(*) FILTER (bad) AS errors, count(*) FILTER (attempt = 1 AND fallback) AS fell_back,
 count(*) FILTER (attempt > 1 AND grounded) AS recovered,
 count(*) FILTER (grounded AND fallback) AS leaked, count(*) FILTER (attempt > 1) AS retries,
 CAST(count(*) FILTER (NOT grounded AND NOT bad) AS DOUBLE) / count(*) AS violation_rate,
 COALESCE(CAST(count(*) FILTER (attempt = 1 AND fallback) AS DOUBLE)
  / NULLIF(count(*) FILTER (attempt = 1), 0), 0) AS fallback_rate
FROM c GROUP BY ROLLUP(purpose)"""
