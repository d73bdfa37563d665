"""Reading export files: detection by header, line numbers, validation and the run log."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from adsight.functions import catalogue as C
from adsight.plans.stages import staged
from adsight.sources import templates as TP

RECORD_LINES = 100     # a quoted cell over more lines than this is a quote left open
DECIMALS = {"spend": "decimal(14,2)", "platform_revenue": "decimal(14,2)",
            "platform_conversions": "decimal(12,4)", "revenue": "decimal(14,2)",
            "discounts": "decimal(14,2)", "refunds": "decimal(14,2)"}


# --- scanning -------------------------------------------------------------------------------
def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines with their file and, inside each file block, a rising number."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"), "value",
        (F.length("value") - F.length(F.replace("value", F.lit('"')))).alias("quotes"))


def number_lines(lines: DataFrame) -> DataFrame:
    """Physical line numbers, and whether a line starts inside a quoted cell.

    ``lines`` must be stored: how files are cut into blocks depends on the settings and cores at
    planning time, so blocks and lines have to come from the same scan. Counts per block give
    every block the lines and quotes before it, so no file is gathered in one task.
    """
    blocks = lines.groupBy("file", "block").agg(
        F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("n"),
        F.sum("quotes").alias("block_quotes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1)
    placed = blocks.select(
        "file", "block", "first_seq", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("above"),
        F.coalesce(F.sum("block_quotes").over(before), F.lit(0)).alias("quotes_above"))
    inside = Window.partitionBy("file", "block").orderBy("seq").rowsBetween(
        Window.unboundedPreceding, -1)
    opened = F.col("quotes_above") + F.coalesce(F.sum("quotes").over(inside), F.lit(0))
    return lines.join(placed, ["file", "block"]).select(
        "file", "block", (F.col("above") + F.col("seq") - F.col("first_seq") + 1).alias("line"),
        "value", (opened % 2 == 1).alias("inside"), (F.col("quotes") % 2 == 1).alias("odd"))


def records(numbered: DataFrame) -> DataFrame:
    """(file, first, line, value): one row per record; a quoted cell may span lines.

    ``line`` is the last physical line of a record. A quote that stays open for more than
    ``RECORD_LINES`` lines is taken as text: each of its lines is a record of its own then.
    """
    single = numbered.filter("not inside and not odd").select(
        "file", F.col("line").alias("first"), "line", "value")
    multi = numbered.filter("inside or odd")
    started = F.when(~F.col("inside"), F.col("line"))
    so_far = Window.partitionBy("file", "block").orderBy("line")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(
        Window.unboundedPreceding, -1)
    last = multi.groupBy("file", "block").agg(F.max(started).alias("last")).select(
        "file", "block", F.max("last").over(earlier).alias("last_above"))
    owned = multi.join(last, ["file", "block"]).select(
        "file", "line", "value", F.coalesce(
            F.max(started).over(so_far), "last_above", "line").alias("first"))
    sizes = owned.groupBy("file", "first").agg(F.count(F.lit(1)).alias("n"))
    sized = owned.join(sizes, ["file", "first"])
    joined = sized.filter(F.col("n") <= RECORD_LINES).groupBy("file", "first").agg(
        F.max("line").alias("line"),
        F.sort_array(F.collect_list(F.struct("line", "value"))).alias("parts")).select(
        "file", "first", "line", F.array_join(F.col("parts.value"), "\n").alias("value"))
    loose = sized.filter(F.col("n") > RECORD_LINES).select(
        "file", F.col("line").alias("first"), "line", "value")
    return single.unionByName(joined).unionByName(loose)


def split_cells(value: Column) -> Column:
    """Cells of a record; quotes around a cell go and doubled quotes inside it are one."""
    found = F.regexp_extract_all(
        F.concat(value, F.lit(",")), F.lit('("[^"]*+(?:""[^"]*+)*+"[^,]*|[^,]*),'), F.lit(1))
    bare = lambda c: F.replace(F.regexp_replace(
        c, '(?s)^"([^"]*+(?:""[^"]*+)*+)"', "$1"), F.lit('""'), F.lit('"'))
    return F.transform(found, lambda c: F.trim(F.when(c.startswith('"'), bare(c)).otherwise(c)))


def header_cells(header: Column) -> Column:
    """Header cells, folded for comparison."""
    return F.transform(split_cells(header), lambda c: F.lower(c))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Every file under a path, empty ones too (a scan skips those), as the driver's listing has it."""
    names = [re.sub("^([A-Za-z0-9]+):///", r"\1:/", name)
             for name in spark.read.text(path).inputFiles()]
    return spark.createDataFrame([(n,) for n in names], "file string")


def detect_source(headers: DataFrame) -> DataFrame:
    """The template of every file; otherwise the closest one and its missing columns.

    ``headers``: (file, header). Works on all files at once: cells join the template columns.
    """
    spark = headers.sparkSession
    # The template columns are a fixed literal table of about fifty rows.
    wanted = F.broadcast(TP.catalogue(spark).select(
        "source", F.lower("header").alias("cell"), F.col("header").alias("title")))
    sizes = {t.source: len(t.fields) for t in TP.TEMPLATES.values()}
    rank = {s: i for i, s in enumerate(TP.TEMPLATES)}
    present = headers.select("file", F.explode(F.array_distinct(header_cells(
        F.col("header")))).alias("cell")).join(wanted, "cell").groupBy("file", "source").agg(
        F.count(F.lit(1)).alias("found"), F.collect_set("title").alias("titles"))
    size = F.element_at(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]),
                        F.col("source"))
    order = F.element_at(F.create_map(*[F.lit(x) for kv in rank.items() for x in kv]),
                         F.col("source"))
    best = Window.partitionBy("file").orderBy(
        F.desc(F.col("found") == size), F.desc(F.when(F.col("found") == size, size)),
        F.desc(F.col("found") / size), order)
    chosen = present.withColumn("place", F.row_number().over(best)).filter("place = 1")
    titles = F.create_map(*[
        x for t in TP.TEMPLATES.values()
        for x in (F.lit(t.source), F.array(*[F.lit(f.header) for f in t.fields]))])
    missing = F.array_except(titles[F.col("source")], F.col("titles"))
    joined = headers.join(chosen.select("file", "source", missing.alias("missing")), "file", "left")
    label = F.element_at(F.create_map(*[
        F.lit(x) for kv in C.SOURCE_LABELS.items() for x in kv]), F.col("source"))
    every = ", ".join(C.SOURCE_LABELS.values())
    readable = F.col("valid") if "valid" in headers.columns else F.lit(True)
    error = (
        F.when(~readable, "The file is not UTF-8 encoded CSV text.")
        .when(F.length(F.trim(F.regexp_replace("header", '[,"]', ""))) == 0,
              "The file is empty or has no header row.")
        .when(F.col("source").isNull(), f"Headers don't match any supported export ({every}).")
        .when(F.size("missing") > 0, F.concat(
            F.lit("Looks like a "), label, F.lit(" export but is missing columns: "),
            F.array_join("missing", ", "), F.lit("."))))
    return joined.withColumn("error", error).select(
        "file", "header", F.when(F.col("error").isNull(), F.col("source")).alias("source"),
        F.when(F.col("source").isNotNull(), F.col("missing")).alias("missing"), "error")


def positions(source: Column, header: Column) -> Column:
    """Where each field of the source's template stands in a header (from 1), in field order."""
    cells = header_cells(header)
    found = [F.when(source == t.source, F.array(*[
        F.array_position(cells, f.header.lower()).cast("int") for f in t.fields]))
        for t in TP.TEMPLATES.values()]
    return F.coalesce(*found)


def read_export(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """All export files under a path: (rows, files), both stored.

    Rows: file, source, line (last physical line), headers, positions, width, value, cells. Files:
    one row for each file, whatever it holds; only files with a source have rows. The lines are
    scanned once and everything is derived from the stored scan; headers are matched once per
    file, and all rows are cut into cells by one expression. Nothing reaches the driver.
    """
    lines = staged(scan_lines(spark, path), "lines")
    numbered = staged(number_lines(lines), "numbered")
    found = records(numbered)
    first = found.filter("first = 1").select("file", F.regexp_replace(
        "value", "^\ufeff", "").alias("header"))
    valid = numbered.groupBy("file").agg(
        F.bool_and(F.is_valid_utf8("value")).alias("valid"))
    headers = list_files(spark, path).join(valid, "file", "left").join(first, "file", "left").select(
        "file", F.coalesce("valid", F.lit(True)).alias("valid"),
        F.make_valid_utf8(F.coalesce("header", F.lit(""))).alias("header"))
    files = staged(detect_source(headers), "files")
    known = files.filter("source is not null").select(
        "file", "source", split_cells(F.col("header")).alias("headers"),
        positions(F.col("source"), F.col("header")).alias("positions"))
    known = staged(known.withColumn("width", F.size("headers")), "known")
    body = found.join(known, "file").filter(
        (F.col("first") > 1) & (F.length(F.trim(F.translate("value", ',"', ""))) > 0))
    rows = body.select("file", "source", "line", "headers", "positions", "width", "value",
                       split_cells(F.col("value")).alias("cells"))
    return staged(rows, "rows"), files


# --- validation -----------------------------------------------------------------------------
def validate_rows(rows: DataFrame, template: TP.Template) -> DataFrame:
    """Typed fields, ``errors`` and ``accepted`` per row, duplicates included.

    Cell reasons come first; only clean rows are cross-checked, and only rows that pass claim
    their natural key, the earliest line winning. ``positions`` says where the template's fields
    stand in ``cells``, so that no header is looked at here.
    """
    raw = {f.header: F.col(f"raw_{f.field}") for f in template.fields}
    texts = rows.withColumns({
        f"raw_{f.field}": F.get("cells", F.get("positions", F.lit(i)) - 1)
        for i, f in enumerate(template.fields)})
    parsed = texts.withColumns({
        f.field: TP.parse(f.kind, F.col(f"raw_{f.field}"), f.choices) for f in template.fields})
    values = {f.field: F.col(f.field) for f in template.fields}
    count = F.size("cells")
    found = F.when(count != F.col("width"), F.array(F.concat(
        F.lit("expected "), F.col("width").cast("string"), F.lit(" columns, found "),
        count.cast("string"))))
    first = parsed.withColumn("errors", found.otherwise(TP.cell_errors(template, raw, values)))
    checked = first.withColumn("errors", F.when(
        F.size("errors") == 0, TP.check_errors(template, values)).otherwise(F.col("errors")))
    return reject_duplicates(checked, ["file", *template.key]).drop(
        *[f"raw_{f.field}" for f in template.fields])


def reject_duplicates(rows: DataFrame, key: list[str]) -> DataFrame:
    """Adds the duplicate reason and ``accepted``; refused rows do not claim a key.

    Refused rows get a key of their own, so a third of a file failing spreads over the cluster.
    """
    clean = F.size("errors") == 0
    spread = F.when(~clean, F.col("line"))
    by_key = Window.partitionBy(*key, spread).orderBy("line")
    owner = F.first("line").over(by_key)
    marked = rows.withColumn("owner", owner)
    repeated = clean & (F.col("line") > F.col("owner"))
    reason = F.array(F.concat(F.lit("duplicate of line "), F.col("owner").cast("string")))
    return marked.withColumn(
        "errors", F.when(repeated, reason).otherwise(F.col("errors"))).withColumn(
        "accepted", F.size("errors") == 0).drop("owner")


def derive_and_project(validated: DataFrame, template: TP.Template) -> DataFrame:
    """Canonical records of the accepted rows: constants in, derived fields in, checks out."""
    rows = validated.filter("accepted")
    if template.source == "web_analytics":
        rows = rows.withColumn("bounces", F.col("sessions") - F.col("engaged_sessions"))
    for name, value in template.constants.items():
        kind = "bigint" if name == "reach" else "string"
        rows = rows.withColumn(name, F.lit(value).cast(kind))
    rows = rows.withColumns({
        n: F.col(n).cast(t) for n, t in DECIMALS.items() if n in rows.columns})
    keep = [f.field for f in template.fields if f.stored] + list(template.constants)
    keep += ["bounces"] if template.source == "web_analytics" else []
    return rows.select("file", "line", *keep)


def rejected_rows(validated: DataFrame) -> DataFrame:
    """Every refused row with all its reasons and its raw cells beside their headers."""
    return validated.filter("not accepted").select(
        "file", "line", "errors", F.arrays_zip("headers", "cells").alias("cells"))


def rejected_report(validated: DataFrame, sample: int) -> DataFrame:
    """The first ``sample`` refused rows of every file beside the number of all its refused rows."""
    refused = rejected_rows(validated)
    by_line = Window.partitionBy("file").orderBy("line")
    first = refused.withColumn("place", F.row_number().over(by_line)).filter(
        F.col("place") <= sample).drop("place")
    return first.join(refused.groupBy("file").agg(F.count(F.lit(1)).alias("refused")), "file")


def run_log(validated: DataFrame) -> DataFrame:
    """Per file: totals, date range, status and error text. Needs file, source, date, accepted."""
    ok = F.col("accepted")
    counts = validated.groupBy("file", "source").agg(
        F.count(F.lit(1)).alias("rows_total"), F.count_if(ok).alias("rows_accepted"),
        F.count_if(~ok).alias("rows_rejected"),
        F.min(F.when(ok, F.col("date"))).alias("date_from"),
        F.max(F.when(ok, F.col("date"))).alias("date_to"))
    none = F.col("rows_accepted") == 0
    return counts.withColumns({
        "status": F.when(none, "failed").when(F.col("rows_rejected") > 0, "partial")
        .otherwise("success"),
        "error": F.when(none, "Every row was rejected.")})


def ingest_files(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Validated rows per source, and one run-log row for every file, readable or not."""
    rows, files = read_export(spark, path)
    validated = {
        source: staged(validate_rows(rows.filter(F.col("source") == source), template), source)
        for source, template in TP.TEMPLATES.items()}
    logged = reduce(lambda a, b: a.unionByName(b), [
        v.select("file", "source", "date", "accepted") for v in validated.values()])
    log = files.select("file", F.col("source").alias("detected"), F.col("error").alias("problem"))
    counted = log.join(run_log(logged), "file", "left")
    zero = F.lit(0).cast("bigint")
    total = F.coalesce("rows_total", zero)
    return validated, counted.select(
        "file", F.col("detected").alias("source"), total.alias("rows_total"),
        F.coalesce("rows_accepted", zero).alias("rows_accepted"),
        F.coalesce("rows_rejected", zero).alias("rows_rejected"), "date_from", "date_to",
        F.coalesce("status", F.lit("failed")).alias("status"),
        F.coalesce("problem", "error", F.when(total == 0, "The file has no data rows.")).alias(
            "error"))


def load_detector_facts(validated: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Accepted rows of every source as the three canonical fact frames."""
    records = {
        s: derive_and_project(v, TP.TEMPLATES[s]) for s, v in validated.items()}
    ads = records["google_ads"].unionByName(records["meta_ads"])
    return {
        "ads": ads.withColumnsRenamed({
            "campaign_external_id": "campaign_id", "ad_set_external_id": "ad_set_id",
            "creative_external_id": "creative_id"}),
        "web": records["web_analytics"], "store": records["store_orders"]}
