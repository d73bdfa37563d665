"""Shared common table expressions of the oracle SQL: the canonical facts of the test tables."""

from __future__ import annotations

AD = ("impressions", "reach", "clicks", "spend", "platform_conversions", "platform_revenue")
WEB = ("sessions", "bounces", "add_to_cart", "checkout", "purchases")
STORE = ("store_orders", "store_revenue")

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "ad": ((), """
SELECT CAST(l_shipdate AS DATE) AS date,
  CASE WHEN l_suppkey % 2 = 0 THEN 'google_ads' ELSE 'meta_ads' END AS channel_id,
  CAST(l_suppkey % 10 AS VARCHAR) AS campaign_id, CAST(l_suppkey % 40 AS VARCHAR) AS ad_set_id,
  CAST(l_suppkey % 80 AS VARCHAR) AS creative_id,
  CASE l_partkey % 4 WHEN 0 THEN '18-24' WHEN 1 THEN '25-34' WHEN 2 THEN '35-44' ELSE '45+' END
    AS age_group,
  CASE WHEN l_linestatus = 'O' THEN 'mobile' ELSE 'desktop' END AS device, l_returnflag AS region,
  SUM(CAST(l_quantity AS BIGINT)) * 400 AS impressions,
  CASE WHEN any_value(l_suppkey % 2) = 1 THEN SUM(CAST(l_quantity AS BIGINT)) * 300 END AS reach,
  SUM(l_linenumber * 20 + l_partkey % 50) AS clicks,
  SUM(CAST(CAST(l_extendedprice AS DECIMAL(14,2)) * CAST(l_discount AS DECIMAL(4,2))
    AS DECIMAL(18,4))) AS spend,
  SUM(CAST(CAST(l_tax AS DECIMAL(4,2)) * 100 AS DECIMAL(12,4))) AS platform_conversions,
  SUM(CAST(CAST(l_extendedprice AS DECIMAL(14,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))
    AS DECIMAL(18,4))) AS platform_revenue
FROM lineitem GROUP BY 1, 2, 3, 4, 5, 6, 7, 8"""),
    "web": ((), """
SELECT DATE '1995-01-05'
    + CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01')) / 1080) AS INTEGER) AS date,
  CASE user_id % 4 WHEN 0 THEN 'google / cpc' WHEN 1 THEN 'facebook / paid_social'
    WHEN 2 THEN 'instagram / paid_social' ELSE '(direct) / (none)' END AS source,
  CASE WHEN event_id % 2 = 0 THEN 'mobile' ELSE 'desktop' END AS device,
  count(*) AS sessions, count(*) FILTER (event_type = 'error') AS bounces,
  count(*) FILTER (event_type IN ('click', 'signup', 'purchase')) AS add_to_cart,
  count(*) FILTER (event_type IN ('signup', 'purchase')) AS checkout,
  count(*) FILTER (event_type = 'purchase') AS purchases,
  COALESCE(SUM(CAST(value AS DECIMAL(14,2))) FILTER (event_type = 'purchase'), 0) AS revenue
FROM events GROUP BY 1, 2, 3"""),
    "store": ((), """
SELECT date, orders, revenue, 0 AS discounts, refunds, COALESCE(n, 0) AS new_customers FROM (
  SELECT CAST(o_orderdate AS DATE) AS date, count(*) AS orders,
    SUM(CAST(o_totalprice AS DECIMAL(14,2))) AS revenue,
    COALESCE(SUM(CAST(o_totalprice AS DECIMAL(14,2))) FILTER (o_orderstatus = 'P'), 0) AS refunds
  FROM orders GROUP BY 1) LEFT JOIN (
  SELECT f AS date, count(*) AS n FROM (
    SELECT o_custkey, MIN(CAST(o_orderdate AS DATE)) AS f FROM orders GROUP BY 1) GROUP BY 1)
USING (date)"""),
    "paid": ((), """
SELECT * FROM (VALUES ('google / cpc', 'google_ads'), ('facebook / paid_social', 'meta_ads'),
  ('instagram / paid_social', 'meta_ads')) AS t(source, channel_id)"""),
    # Ad facts once per entity they belong to.
    "ad_level": (("ad",), """
SELECT 'account' AS level, 'all' AS key, CAST(NULL AS VARCHAR) AS chan, ad.* FROM ad
UNION ALL SELECT 'channel', channel_id, channel_id, ad.* FROM ad
UNION ALL SELECT 'campaign', campaign_id, channel_id, ad.* FROM ad
UNION ALL SELECT 'ad_set', ad_set_id, channel_id, ad.* FROM ad
UNION ALL SELECT 'creative', creative_id, channel_id, ad.* FROM ad
UNION ALL SELECT 'age_group', ad_set_id || '|' || age_group, channel_id, ad.* FROM ad"""),
    "web_level": (("web", "paid"), """
SELECT 'account' AS level, 'all' AS key, web.* FROM web
UNION ALL SELECT 'source', source, web.* FROM web
UNION ALL SELECT 'channel', channel_id, web.* FROM web JOIN paid USING (source)"""),
}


def with_(names: tuple[str, ...] | str, body: str) -> str:
    """``body`` preceded by the named common table expressions and what they depend on."""
    wanted = (names,) if isinstance(names, str) else names
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in ordered:
            return
        for needed in CTES[name][0]:
            add(needed)
        ordered.append(name)

    for name in wanted:
        add(name)
    head = ",\n".join(f"{n} AS ({CTES[n][1].strip()})" for n in ordered)
    return f"WITH {head}\n{body.strip()}"


def dbl(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


def reach() -> str:
    return "CASE WHEN count(reach) = count(*) THEN SUM(reach) END"


def ad_sums() -> str:
    """The six ad measures summed as doubles, reach only when complete."""
    return ", ".join(
        f"{dbl(reach() if m == 'reach' else f'SUM({m})')} AS {m}" for m in AD)


def sums(measures: tuple[str, ...]) -> str:
    return ", ".join(f"{dbl(f'SUM({m})')} AS {m}" for m in measures)


KPI = {
    "ctr": "clicks / NULLIF(impressions, 0)",
    "cpc": "spend / NULLIF(clicks, 0)",
    "cpm": "spend / NULLIF(impressions, 0) * 1000",
    "cvr": "platform_conversions / NULLIF(clicks, 0)",
    "cpa": "spend / NULLIF(platform_conversions, 0)",
    "roas": "platform_revenue / NULLIF(spend, 0)",
    "aov": "platform_revenue / NULLIF(platform_conversions, 0)",
    "frequency": "impressions / NULLIF(reach, 0)",
    "bounce_rate": "bounces / NULLIF(sessions, 0)",
    "atc_rate": "add_to_cart / NULLIF(sessions, 0)",
    "checkout_rate": "checkout / NULLIF(add_to_cart, 0)",
    "purchase_rate": "purchases / NULLIF(checkout, 0)",
    "web_cvr": "purchases / NULLIF(sessions, 0)",
    "mer": "store_revenue / NULLIF(spend, 0)",
    "store_aov": "store_revenue / NULLIF(store_orders, 0)",
}


def kpi(metric: str, prefix: str = "") -> str:
    """A ratio over double columns, optionally with a column prefix."""
    import re

    return re.sub(r"\b([a-z_]+)\b(?!\()", lambda m: prefix + m.group(1), KPI[metric]).replace(
        prefix + "NULLIF", "NULLIF")
