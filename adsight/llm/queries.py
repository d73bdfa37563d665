"""One query per operator of the text pipeline, over whole tables, and their SQL where it exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from adsight.llm import (
    backoff_lm,
    best_fit,
    decontaminate,
    hnsw,
    importance_resampling,
    language_mixture,
    license_scan,
    line_chunks,
    simhash_dedup,
    token_alignment,
    token_counts,
    token_packing,
    warc_index,
)

REGISTRY, SQL = {}, {}


def query(function):
    """Registers a query under its own name."""
    REGISTRY[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document (3-word shingles, 2 bits)."""
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents")).drop("fp")


@query
def op4_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language mixture of every document, learned from two of three folds."""
    return language_mixture.identify(table(spark, sf_dir, "documents"))


@query
def op9_conflict_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of 2048 words with at most one piece of each source and duplicate cluster."""
    return best_fit.pack(table(spark, sf_dir, "documents"))


@query
def op6_line_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the chunks of lines that stand earlier in the corpus."""
    return line_chunks.remove_repeated(table(spark, sf_dir, "documents")).select(
        "doc_id", "text", "removed_chunks")


# A text's lines, the boundaries after them, the chunks between and the first place of each chunk.
SQL["op6_line_chunk_dedup"] = """
with l as (
    select doc_id, i, lines[i] as line, len(lines) as n,
        ('0x' || substr(md5(lines[i]), 1, 7))::bigint as h,
        length(lines[i]) - length(replace(lines[i], ' ', '')) >= 49 as wide
    from (select doc_id, string_split(text, chr(10)) as lines from documents
          where text is not null) as d,
        unnest(range(1, len(lines) + 1)) as u(i)
), e as (
    select *, (h + 257 * coalesce(lag(h) over w, 0)) % 1000003 % 4 = 0 or wide or i = n
        or coalesce(lead(wide) over w, false) as ends
    from l window w as (partition by doc_id order by i)
), c as (
    select *, coalesce(sum(ends::int) over (partition by doc_id order by i
        rows between unbounded preceding and 1 preceding), 0) as no
    from e
), k as (
    select doc_id, no, string_agg(line, chr(10) order by i) as body,
        count(*) >= 2 or bool_or(wide) as fit
    from c group by doc_id, no
), p as (
    select *, fit and row_number() over (partition by fit, body order by doc_id, no) > 1 as gone
    from k
), g as (
    select doc_id, string_agg(body, chr(10) order by no) filter (not gone) as body,
        count(*) filter (gone) as gone
    from p group by doc_id
)
select doc_id, case when coalesce(gone, 0) = 0 then text else coalesce(body, '') end as text,
    coalesce(gone, 0)::integer as removed_chunks
from documents left join g using (doc_id)
"""


@query
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items found in them."""
    return decontaminate.leaks(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_key")


@query
def op2_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged capture index of all pages, written to archives and read back."""
    return warc_index.capture_histories(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL["op2_warc_index_merge"] = """
with p as (
    select page_id, coalesce(html, '') as h from pages
), d as (
    select page_id, h, strlen(h)::bigint as payload_bytes, sha1(h) as s,
        min(page_id) over (partition by h) as first_id
    from p
)
select page_id, payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        (1 + ((('0x' || substr(s, ((i // 4) * 5 + 1)::integer, 5))::bigint
               >> (15 - 5 * (i % 4))::integer) & 31))::integer, 1)), '') as payload_digest,
    case when page_id = first_id then 'response' else 'revisit' end as record_type,
    case when page_id = first_id then null else first_id end as refers_to
from d
"""


@query
def op5_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed id matrix of all documents."""
    return token_packing.pack(table(spark, sf_dir, "documents"))


@query
def op7_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigram and add-one scores of every document."""
    return backoff_lm.score(table(spark, sf_dir, "documents"))


@query
def op8_hnsw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth vector."""
    return hnsw.neighbours(table(spark, sf_dir, "embeddings"))


@query
def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence paragraphs of all documents."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


@query
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it is over 4096 tokens."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between two tokenizers over every document."""
    return token_alignment.align(table(spark, sf_dir, "documents"))


@query
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weight and draw of every document, towards the benchmark texts."""
    return importance_resampling.resample(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
