"""Oracle SQL of ingestion and stored tables."""

from __future__ import annotations

from oracle.base import CTES, ad_sums, dbl, with_

SQL: dict[str, str] = {}
CTES["graw"] = (("ad",), """
SELECT *, n % 89 = 4 AS bad_date, n % 101 = 6 AS bad_id, n % 61 = 5 AS bad_cur,
  n % 97 = 3 AS no_cost, n % 53 = 7 AS bad_clicks, n % 83 = 3 AND n % 53 <> 7 AS over FROM (
 SELECT *, line + dayofyear(date) * 13 AS n FROM (
 SELECT *, 'google-' || date AS file, row_number() OVER (PARTITION BY date
  ORDER BY creative_id, age_group, device, region) + 1 AS line
 FROM ad WHERE channel_id = 'google_ads'))""")
_CELLS = """list_filter([
 CASE WHEN bad_date THEN 'Day: expected a date like 2026-10-14 (got ''2001-02-30'')' END,
 CASE WHEN bad_id THEN 'Ad group ID: expected a numeric ID (was the file re-saved from a spreadsheet?) (got ''1.2E+17'')' END,
 CASE WHEN bad_cur THEN 'Currency code: expected one of: INR (got ''USD'')' END,
 CASE WHEN no_cost THEN 'Cost: value is missing' END,
 CASE WHEN bad_clicks THEN 'Clicks: expected a number (got ''lots'')' END], lambda x: x IS NOT NULL)"""
CTES["gall"] = (("graw",), f"""
SELECT *, CASE WHEN len(cells) > 0 THEN array_to_string(cells, '; ')
  WHEN over THEN 'clicks (' || (CAST(impressions AS BIGINT) + 1) || ') exceeds impressions ('
   || CAST(impressions AS BIGINT) || ')' WHEN outline > line THEN 'duplicate of line ' || line
  ELSE '' END AS errors FROM (
 SELECT *, {_CELLS} AS cells FROM (SELECT *, line AS outline FROM graw
  UNION ALL SELECT *, line + 1000000 FROM graw WHERE n % 71 = 9))""")
SQL["parse_cells"] = with_("gall", """
SELECT file, outline AS line, CASE WHEN NOT bad_date THEN date END AS date,
 CASE WHEN NOT bad_id THEN ad_set_id END AS ad_set_external_id, device,
 CASE WHEN NOT bad_cur THEN 'INR' END AS currency,
 CASE WHEN NOT no_cost THEN CAST(CAST(spend AS DECIMAL(14,2)) AS DOUBLE) END AS spend,
 CAST(impressions AS BIGINT) AS impressions, CAST(CASE WHEN bad_clicks THEN NULL
  WHEN over THEN impressions + 1 ELSE clicks END AS BIGINT) AS clicks
FROM gall""")
SQL["validate_rows"] = with_("gall", """
SELECT file, outline AS line, errors, errors = '' AS accepted FROM gall""")
SQL["check_at_most"] = with_("gall", """
SELECT file, outline AS line, errors AS error FROM gall WHERE errors LIKE 'clicks (%'""")
SQL["reject_duplicates"] = with_("gall", """
SELECT file, outline AS line, errors AS error FROM gall WHERE errors LIKE 'duplicate%'""")
SQL["derive_and_project"] = with_("gall", """
SELECT file, outline AS line, date, channel_id, CAST(NULL AS VARCHAR) AS platform,
 CAST(NULL AS BIGINT) AS reach, CAST(clicks AS BIGINT) AS clicks,
 CAST(CAST(spend AS DECIMAL(14,2)) AS DOUBLE) AS spend FROM gall WHERE errors = ''""")
SQL["ingestion_run_log"] = with_("gall", """
SELECT file, 'google_ads' AS source, count(*) AS rows_total,
 count(*) FILTER (errors = '') AS rows_accepted, count(*) FILTER (errors <> '') AS rows_rejected,
 MIN(date) FILTER (errors = '') AS date_from, MAX(date) FILTER (errors = '') AS date_to,
 CASE WHEN count(*) FILTER (errors = '') = 0 THEN 'failed'
  WHEN count(*) FILTER (errors <> '') > 0 THEN 'partial' ELSE 'success' END AS status,
 CASE WHEN count(*) FILTER (errors = '') = 0 THEN 'Every row was rejected.' END AS error
FROM gall GROUP BY 1""")
SQL["recent_runs"] = f"""
WITH log AS ({SQL["ingestion_run_log"]})
SELECT *, batch || '/' || file AS run_id FROM (SELECT *, CAST(1 AS BIGINT) AS batch FROM log
 UNION ALL SELECT *, 2 FROM log WHERE rows_total % 2 = 0) ORDER BY batch DESC, file LIMIT 30"""
SQL["check_net_sales"] = with_("store", """
SELECT date, day(date) <> 13 AS accepted, CASE WHEN day(date) = 13 THEN 'Net sales ('
 || CAST(CAST(revenue + 1 AS DECIMAL(20,2)) AS VARCHAR)
 || ') != gross sales - discounts - returns (' || CAST(CAST(revenue AS DECIMAL(20,2)) AS VARCHAR)
 || ')' ELSE '' END AS errors FROM store""")
# The columns of the four export layouts.
_ROWS = """
 ('google_ads', 'Day', 'date', 'iso_date', true),
 ('google_ads', 'Campaign', 'campaign_name', 'text', true),
 ('google_ads', 'Campaign ID', 'campaign_external_id', 'identifier', true),
 ('google_ads', 'Ad group', 'ad_set_name', 'text', true),
 ('google_ads', 'Ad group ID', 'ad_set_external_id', 'identifier', true),
 ('google_ads', 'Ad ID', 'creative_external_id', 'identifier', true),
 ('google_ads', 'Ad name', 'creative_name', 'text', true),
 ('google_ads', 'Age', 'age_group', 'text', true),
 ('google_ads', 'Device', 'device', 'choice', true),
 ('google_ads', 'Region', 'region', 'text', true),
 ('google_ads', 'Currency code', 'currency', 'choice', false),
 ('google_ads', 'Cost', 'spend', 'amount', true),
 ('google_ads', 'Impr.', 'impressions', 'count', true),
 ('google_ads', 'Clicks', 'clicks', 'count', true),
 ('google_ads', 'Conversions', 'platform_conversions', 'amount', true),
 ('google_ads', 'Conv. value', 'platform_revenue', 'amount', true),
 ('meta_ads', 'Reporting starts', 'date', 'iso_date', true),
 ('meta_ads', 'Reporting ends', 'date_end', 'iso_date', false),
 ('meta_ads', 'Campaign name', 'campaign_name', 'text', true),
 ('meta_ads', 'Campaign ID', 'campaign_external_id', 'identifier', true),
 ('meta_ads', 'Ad set name', 'ad_set_name', 'text', true),
 ('meta_ads', 'Ad set ID', 'ad_set_external_id', 'identifier', true),
 ('meta_ads', 'Ad name', 'creative_name', 'text', true),
 ('meta_ads', 'Ad ID', 'creative_external_id', 'identifier', true),
 ('meta_ads', 'Platform', 'platform', 'choice', true),
 ('meta_ads', 'Age', 'age_group', 'text', true),
 ('meta_ads', 'Device platform', 'device', 'choice', true),
 ('meta_ads', 'Region', 'region', 'text', true),
 ('meta_ads', 'Amount spent (INR)', 'spend', 'amount', true),
 ('meta_ads', 'Impressions', 'impressions', 'count', true),
 ('meta_ads', 'Reach', 'reach', 'count', true),
 ('meta_ads', 'Link clicks', 'clicks', 'count', true),
 ('meta_ads', 'Purchases', 'platform_conversions', 'amount', true),
 ('meta_ads', 'Purchases conversion value', 'platform_revenue', 'amount', true),
 ('web_analytics', 'Date', 'date', 'compact_date', true),
 ('web_analytics', 'Session source / medium', 'source', 'text', true),
 ('web_analytics', 'Device category', 'device', 'choice', true),
 ('web_analytics', 'Sessions', 'sessions', 'count', true),
 ('web_analytics', 'Engaged sessions', 'engaged_sessions', 'count', false),
 ('web_analytics', 'Add to carts', 'add_to_cart', 'count', true),
 ('web_analytics', 'Checkouts', 'checkout', 'count', true),
 ('web_analytics', 'Ecommerce purchases', 'purchases', 'count', true),
 ('web_analytics', 'Purchase revenue', 'revenue', 'amount', true),
 ('store_orders', 'Day', 'date', 'iso_date', true),
 ('store_orders', 'Orders', 'orders', 'count', true),
 ('store_orders', 'Gross sales', 'gross_sales', 'amount', false),
 ('store_orders', 'Discounts', 'discounts', 'deduction', true),
 ('store_orders', 'Returns', 'refunds', 'deduction', true),
 ('store_orders', 'Net sales', 'revenue', 'signed', true),
 ('store_orders', 'New customers', 'new_customers', 'count', true)"""
SQL["template_catalogue"] = with_(("ad", "web", "store"), f"""
, c AS (SELECT channel_id AS source, count(*) AS rows FROM ad GROUP BY 1
 UNION ALL SELECT 'web_analytics', count(*) FROM web UNION ALL SELECT 'store_orders', count(*) FROM store)
SELECT t.source, header, field, kind, stored, rows FROM (VALUES {_ROWS})
 AS t(source, header, field, kind, stored) JOIN c ON c.source = t.source""")
SQL["upsert"] = with_("store", f"""
SELECT date, CASE WHEN date >= DATE '2001-06-01' THEN orders + 100 ELSE orders END AS orders,
 {dbl("revenue")} AS revenue, {dbl("refunds")} AS refunds, new_customers FROM store
WHERE date NOT IN (SELECT date + 365 FROM store WHERE date BETWEEN DATE '2001-07-01' AND DATE '2001-07-31')
UNION ALL SELECT date + 365, orders, {dbl("revenue")}, {dbl("refunds")}, new_customers FROM store
WHERE date BETWEEN DATE '2001-07-01' AND DATE '2001-07-31'""")
SQL["load_dimensions"] = with_("ad", """
SELECT DISTINCT 'channel' AS level, channel_id AS external_id, channel_id AS name FROM ad
UNION ALL SELECT 'campaign', campaign_id, 'campaign-' || campaign_id || '-' || MAX(year(date))
 FROM ad GROUP BY campaign_id
UNION ALL SELECT DISTINCT 'ad_set', ad_set_id, 'adset-' || ad_set_id FROM ad
UNION ALL SELECT DISTINCT 'creative', creative_id, 'creative-' || creative_id FROM ad""")
SQL["rejected_report"] = with_("gall", """
SELECT file, line, errors, refused, currency FROM (
 SELECT file, outline AS line, errors, count(*) OVER (PARTITION BY file) AS refused,
  CASE WHEN bad_cur THEN 'USD' ELSE 'INR' END AS currency,
  row_number() OVER (PARTITION BY file ORDER BY outline) AS place FROM gall WHERE errors <> '')
WHERE place <= 20""")

# What the export files of all facts hold, read back.
_MONEY = "CAST(CAST({m} AS DECIMAL(14,2)) AS DOUBLE) AS {m}"
CTES["counted"] = (("ad", "web", "store"), """
SELECT channel_id AS source, count(*) AS rows, MIN(date) AS first, MAX(date) AS last
FROM ad GROUP BY 1
UNION ALL SELECT 'web_analytics', count(*), MIN(date), MAX(date) FROM web
UNION ALL SELECT 'store_orders', count(*), MIN(date), MAX(date) FROM store""")
SQL["read_export"] = with_("counted", """
SELECT source, rows, 2 AS first_line, rows AS well_formed FROM counted""")
SQL["detect_source"] = with_("counted", """
SELECT source, NULL AS error FROM counted UNION ALL SELECT NULL, 'Headers don''t match any '
 || 'supported export (Google Ads, Meta Ads, Web analytics (GA4), Store orders (Shopify)).'""")
SQL["check_daily_breakdown"] = with_("ad", """
SELECT CASE WHEN CAST(creative_id AS INTEGER) % 10 = 3 THEN
 'Reporting starts and Reporting ends differ; export with a daily breakdown' ELSE '' END AS errors,
 count(*) AS rows FROM ad WHERE channel_id = 'meta_ads' GROUP BY 1""")
SQL["ingest_files"] = with_("counted", """
SELECT source, 'success' AS status, rows AS rows_accepted, 0 AS rows_rejected,
 first AS date_from, last AS date_to FROM counted
UNION ALL SELECT NULL, 'failed', 0, 0, NULL, NULL""")
CTES["ad_read"] = (("ad",), f"""
SELECT date, channel_id, campaign_id, ad_set_id, creative_id, age_group, device, region,
 impressions, reach, clicks, {", ".join(f"CAST({m} AS DECIMAL(14,2)) AS {m}" for m in (
     "spend", "platform_conversions", "platform_revenue"))} FROM ad""")
SQL["load_detector_facts"] = with_("ad_read", f"""
SELECT date, channel_id, campaign_id, ad_set_id, creative_id, age_group, {ad_sums()}
FROM ad_read GROUP BY ALL""")
SQL["load_ad_facts"] = with_("ad_read", f"""
SELECT date, channel_id, campaign_id, ad_set_id, creative_id, age_group, device, region,
 CAST(impressions AS BIGINT) AS impressions, CAST(reach AS BIGINT) AS reach,
 CAST(clicks AS BIGINT) AS clicks, {dbl("spend")} AS spend,
 {dbl("platform_conversions")} AS platform_conversions,
 {dbl("platform_revenue")} AS platform_revenue FROM ad_read""")
SQL["load_web_facts"] = with_("web", f"""
SELECT date, source, device, sessions, bounces, add_to_cart, checkout, purchases,
 {_MONEY.format(m="revenue")} FROM web""")
SQL["load_store_facts"] = with_("store", f"""
SELECT date, orders, {_MONEY.format(m="revenue")}, {_MONEY.format(m="discounts")},
 {_MONEY.format(m="refunds")}, new_customers FROM store""")
SQL["stream_ingest"] = with_("ad_read", f"""
SELECT date, channel_id, count(*) AS rows, {dbl("SUM(spend)")} AS spend FROM ad_read
GROUP BY 1, 2""")
