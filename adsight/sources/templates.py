"""The four export layouts and their cell parsers, as metadata that generates Columns."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adsight.functions import catalogue as C

# --- fixed values: bounds, kinds and reasons --------------------------------------------------
MAX_COUNT = 2_147_483_647
MAX_AMOUNT = 1_000_000_000_000
NUMBER = "decimal(38,10)"


class Field(NamedTuple):
    header: str
    field: str
    kind: str
    stored: bool = True
    choices: dict[str, str] | None = None


class Template(NamedTuple):
    source: str
    kind: str
    fields: tuple[Field, ...]
    key: tuple[str, ...]
    at_most: tuple[tuple[str, str], ...]
    constants: dict[str, str | None]

    @property
    def label(self) -> str:
        return C.SOURCE_LABELS[self.source]


AD_KEY = ("date", "campaign_external_id", "ad_set_external_id", "creative_external_id",
          "age_group", "device", "region")
TEMPLATES = {
    "google_ads": Template("google_ads", "ad", (
        Field("Day", "date", "iso_date"),
        Field("Campaign", "campaign_name", "text"),
        Field("Campaign ID", "campaign_external_id", "identifier"),
        Field("Ad group", "ad_set_name", "text"),
        Field("Ad group ID", "ad_set_external_id", "identifier"),
        Field("Ad ID", "creative_external_id", "identifier"),
        Field("Ad name", "creative_name", "text"),
        Field("Age", "age_group", "text"),
        Field("Device", "device", "choice", True,
              {"Mobile phones": "mobile", "Computers": "desktop", "Tablets": "tablet"}),
        Field("Region", "region", "text"),
        Field("Currency code", "currency", "choice", False, {"INR": "INR"}),
        Field("Cost", "spend", "amount"),
        Field("Impr.", "impressions", "count"),
        Field("Clicks", "clicks", "count"),
        Field("Conversions", "platform_conversions", "amount"),
        Field("Conv. value", "platform_revenue", "amount"),
    ), AD_KEY, (("clicks", "impressions"),),
        {"channel_id": "google_ads", "reach": None, "platform": None}),
    "meta_ads": Template("meta_ads", "ad", (
        Field("Reporting starts", "date", "iso_date"),
        Field("Reporting ends", "date_end", "iso_date", False),
        Field("Campaign name", "campaign_name", "text"),
        Field("Campaign ID", "campaign_external_id", "identifier"),
        Field("Ad set name", "ad_set_name", "text"),
        Field("Ad set ID", "ad_set_external_id", "identifier"),
        Field("Ad name", "creative_name", "text"),
        Field("Ad ID", "creative_external_id", "identifier"),
        Field("Platform", "platform", "choice", True, {
            "facebook": "facebook", "instagram": "instagram",
            "audience_network": "audience_network", "messenger": "messenger"}),
        Field("Age", "age_group", "text"),
        Field("Device platform", "device", "choice", True,
              {"Mobile app": "mobile", "Desktop": "desktop"}),
        Field("Region", "region", "text"),
        Field("Amount spent (INR)", "spend", "amount"),
        Field("Impressions", "impressions", "count"),
        Field("Reach", "reach", "count"),
        Field("Link clicks", "clicks", "count"),
        Field("Purchases", "platform_conversions", "amount"),
        Field("Purchases conversion value", "platform_revenue", "amount"),
    ), AD_KEY, (("clicks", "impressions"), ("reach", "impressions")),
        {"channel_id": "meta_ads"}),
    "web_analytics": Template("web_analytics", "web", (
        Field("Date", "date", "compact_date"),
        Field("Session source / medium", "source", "text"),
        Field("Device category", "device", "choice", True,
              {"mobile": "mobile", "desktop": "desktop", "tablet": "tablet"}),
        Field("Sessions", "sessions", "count"),
        Field("Engaged sessions", "engaged_sessions", "count", False),
        Field("Add to carts", "add_to_cart", "count"),
        Field("Checkouts", "checkout", "count"),
        Field("Ecommerce purchases", "purchases", "count"),
        Field("Purchase revenue", "revenue", "amount"),
    ), ("date", "source", "device"), (("engaged_sessions", "sessions"),), {}),
    "store_orders": Template("store_orders", "store", (
        Field("Day", "date", "iso_date"),
        Field("Orders", "orders", "count"),
        Field("Gross sales", "gross_sales", "amount", False),
        Field("Discounts", "discounts", "deduction"),
        Field("Returns", "refunds", "deduction"),
        Field("Net sales", "revenue", "signed"),
        Field("New customers", "new_customers", "count"),
    ), ("date",), (("new_customers", "orders"),), {}),
}
REASONS = {
    "iso_date": "expected a date like 2026-10-14",
    "compact_date": "expected a date like 20261014",
    "count": "expected a whole number >= 0",
    "amount": "expected a number >= 0",
    "signed": "expected a number",
    "deduction": "expected a number",
    "text": "text is longer than 255 characters",
    "identifier": "expected a numeric ID (was the file re-saved from a spreadsheet?)",
}
TOLERANCE = "0.05"
DAILY_REASON = "Reporting starts and Reporting ends differ; export with a daily breakdown"


def parse(kind: str, raw: Column, choices: dict[str, str] | None = None) -> Column:
    """Typed value of a trimmed cell, null when the cell does not parse."""
    if kind == "iso_date":
        return F.try_to_date(raw, "yyyy-M-d")
    if kind == "compact_date":
        return F.when(raw.rlike("^[0-9]{8}$"), F.try_to_date(raw, "yyyyMMdd"))
    if kind == "text":
        return F.when(F.length(raw) <= 255, raw)
    if kind == "identifier":
        return F.when(raw.rlike("^[0-9]{1,32}$"), raw)
    if kind == "choice":
        folded = F.create_map(*[F.lit(x) for k, v in choices.items() for x in (k.lower(), v)])
        return F.try_element_at(folded, F.lower(raw))
    number = F.regexp_replace(raw, ",", "").try_cast(NUMBER)
    bounded = F.when(F.abs(number) < MAX_AMOUNT, number)
    if kind == "count":
        whole = (bounded >= 0) & (bounded == F.floor(bounded)) & (bounded <= MAX_COUNT)
        return F.when(whole, bounded.cast("bigint"))
    if kind == "amount":
        return F.when(bounded >= 0, bounded)
    return F.abs(bounded) if kind == "deduction" else bounded


def reason(field: Field) -> str:
    if field.kind == "choice":
        return "expected one of: " + ", ".join(field.choices)
    return REASONS[field.kind]


def cell_errors(template: Template, raw: dict[str, Column], parsed: dict[str, Column]) -> Column:
    """Every reason a row's cells are refused, in column order."""
    problems = []
    for f in template.fields:
        text = raw[f.header]
        missing = F.coalesce(F.length(text), F.lit(0)) == 0
        number_like = f.kind in ("count", "amount")
        why = F.lit(reason(f))
        if number_like:  # a cell that is no number at all is told so
            is_number = parse("signed", text).isNotNull()
            why = F.when(is_number, why).otherwise("expected a number")
        problems.append(
            F.when(missing, f"{f.header}: value is missing").when(
                parsed[f.field].isNull(),
                F.concat(F.lit(f"{f.header}: "), why, F.lit(" (got '"), text, F.lit("')"))))
    return F.array_compact(F.array(*problems))


def check_errors(template: Template, value: dict[str, Column]) -> Column:
    """Cross-field reasons, for rows whose cells all parsed."""
    checks = []
    if template.source == "meta_ads":
        checks.append(F.when(value["date_end"] != value["date"], DAILY_REASON))
    for small, large in template.at_most:
        checks.append(F.when(value[small] > value[large], F.concat(
            F.lit(f"{small} ("), value[small].cast("string"), F.lit(f") exceeds {large} ("),
            value[large].cast("string"), F.lit(")"))))
    if template.source == "store_orders":
        net = value["gross_sales"] - value["discounts"] - value["refunds"]
        off = F.abs(net - value["revenue"]) > F.lit(TOLERANCE).cast("decimal(4,2)")
        checks.append(F.when(off, F.concat(
            F.lit("Net sales ("), value["revenue"].cast("decimal(20,2)").cast("string"),
            F.lit(") != gross sales - discounts - returns ("),
            net.cast("decimal(20,2)").cast("string"), F.lit(")"))))
    return F.array_compact(F.array(*checks))


def catalogue(spark) -> DataFrame:
    rows = [
        F.struct(F.lit(t.source).alias("source"), F.lit(f.header).alias("header"),
                 F.lit(f.field).alias("field"), F.lit(f.kind).alias("kind"),
                 F.lit(f.stored).alias("stored"))
        for t in TEMPLATES.values() for f in t.fields]
    return spark.range(1).select(F.inline(F.array(*rows)))
