"""The queries opN_<name>: each operator with production parameters over its whole table."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from viatrix.llm import sql
from viatrix.session import table


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from viatrix.llm.decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", F.round("similarity", 9).alias("similarity"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from viatrix.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from viatrix.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024, 2)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from viatrix.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from viatrix.llm.embedding_dedup import links

    return links(table(spark, sf_dir, "embeddings"), 0.9)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from viatrix.llm.langid import languages

    return languages(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from viatrix.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from viatrix.llm.chunk_dedup import repeats

    return repeats(table(spark, sf_dir, "documents"), 100)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from viatrix.llm.ngram_join import near_groups

    return near_groups(table(spark, sf_dir, "documents"), 5, 75, 100).drop("n_alike")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from viatrix.llm.line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents"), 2)
    return out.select("doc_id", "n_lines", "n_removed", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from viatrix.llm.fill_in_middle import fill_in_middle, restored

    made = fill_in_middle(table(spark, sf_dir, "documents"), seed=7, rate=100, spm=50, unit="line")
    sha = [F.sha2(x.cast("binary"), 256).alias(n) for n, x in (("output_sha256", F.col("output")), ("restored_sha256", restored(F.col("output"), F.col("form"))))]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *sha)


#: rules (verdict, host, path) of the query
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from viatrix.llm.url_rules import judged, table_of

    pages = table(spark, sf_dir, "pages")
    return judged(pages, table_of(URL_RULES, pages))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from viatrix.llm.filter_audit import filter_audit

    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLES)
