"""One query per operator, over whole tables and with production parameters, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import cap_filters, exact_dedup, language, licenses, mixing, ngram_join, packing, pitman_yor, quality, substring_dedup
from weftline.llm.scratch import frugal

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    frugal(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    dictionaries = language.learn(docs.where(~language.held_out()))
    return language.identify(docs, dictionaries).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"), texts=False)


def op8_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cap_filters.near_vectors(_table(spark, sf_dir, "embeddings"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


_NORMAL = f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')"


def oracle_sql() -> dict[str, str]:
    return {
        "op2_ngram_join": f"""
            with recursive d as materialized (
                select doc_id, regexp_extract_all({_NORMAL}, '[^\\x20\\x09-\\x0D]+') as w from documents),
            s as materialized (
                select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
                    else [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] end) as g from d),
            n as materialized (select doc_id, len(g)::bigint as n from s),
            e as materialized (select doc_id, unnest(g) as g from s),
            c as materialized (select x.doc_id as a, y.doc_id as b, count(*) as common from e x join e y on x.g = y.g and x.doc_id <> y.doc_id group by all),
            l as materialized (select a, b from c join n na on a = na.doc_id join n nb on b = nb.doc_id where 100 * common >= 80 * (na.n + nb.n - common)),
            r as (select doc_id as a, doc_id as b from n union select r.a, l.b from r join l on r.b = l.a)
            select n.doc_id, n.n as n_shingles, min(r.b) as component_id from n join r on n.doc_id = r.a group by all""",
        "op10_exact_dedup": f"""
            with d as (select doc_id, {_NORMAL} as t from documents),
            g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t)
            select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(d.t) as text_sha256 from d join g on d.t = g.t""",
    }
