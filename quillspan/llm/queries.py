"""The registered queries of this package and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.sources.tables import spread, table

from . import docpairs, filling, generated, leakage, mixing, parsecheck, pii, secrets, spans


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of usable credentials in the three texts of all code units."""
    units = spread(table(spark, sf_dir, "code_units").select("unit_id", *secrets.FIELDS))
    return secrets.find_secrets(units).select("unit_id", "field", "line_no").distinct()


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every unit's texts with the credentials replaced, as digests and lengths."""
    units = spread(table(spark, sf_dir, "code_units").select("unit_id", *secrets.FIELDS))
    clean = secrets.redact_secrets(units)
    return clean.select(
        "unit_id",
        *[F.sha2(F.col(f), 256).alias(f"{f}_digest") for f in secrets.FIELDS],
        *[F.length(f).alias(f"{f}_chars") for f in secrets.FIELDS],
    ).distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with a unit that cannot be read in the language of the file's extension."""
    return parsecheck.unreadable_files(spread(table(spark, sf_dir, "code_units").select("unit_id", "repo", "file", "full_text")))


def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, flagged files and their rate per repo and language."""
    return parsecheck.fault_rates(spread(table(spark, sf_dir, "code_units").select("unit_id", "repo", "file", "full_text")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of units of different files that share 200 code points in a row or more."""
    return spans.shared_pairs(spread(table(spark, sf_dir, "code_units").select("unit_id", "repo", "file", "full_text")))


def p3_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each unit how many of its code points stand in intervals shared with other files."""
    return spans.shared_amounts(spread(table(spark, sf_dir, "code_units").select("unit_id", "name", "repo", "file", "full_text")))


def _files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    columns = ("unit_id", "repo", "file", "start_line", "doc_comment", "full_text", "compact_text")
    return spread(table(spark, sf_dir, "code_units").select(*columns)), table(spark, sf_dir, "file_cache")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated, minified, vendored and data files of file_cache and code_units."""
    return generated.machine_files(*_files(spark, sf_dir))


def p4_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file with its size and the reason why it is not hand-written, null where it is."""
    return generated.judge_files(*_files(spark, sf_dir)).select("repo", F.col("path").alias("relative_path"), "file_size", "chars", "reason")


def _functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "code_units").select("unit_id", "file", "kind", "name", "signature", "doc_comment", "full_text"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions and methods with words that say what they do."""
    return docpairs.doc_pairs(_functions(spark, sf_dir)).select("unit_id").distinct()


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs themselves: signature, description and code."""
    return docpairs.doc_pairs(_functions(spark, sf_dir)).distinct()


def _containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filling.fill_containers(table(spark, sf_dir, "planned_units"), table(spark, sf_dir, "budget_plans"))


def p6_arrangement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every item of every session."""
    return _containers(spark, sf_dir)


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers and fill per session beside what the recorded plans used."""
    return filling.compare_fill(_containers(spark, sf_dir), table(spark, sf_dir, "budget_plans"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share twelve consecutive words or more with a test item."""
    return leakage.find_leaks(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "eval_items"))


def _drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixing.mix(docs, table(spark, sf_dir, "mix_targets"))


def p8_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents drawn, with their rates and copies."""
    return _drawn(spark, sf_dir).drop("domains")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of all drawn tokens that each listed source reaches."""
    return mixing.shares(_drawn(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal information in all documents."""
    return pii.find_pii(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "name_lexicon"))


def p9_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with typed placeholders, as a digest and a length."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    clean = pii.redact_pii(docs, table(spark, sf_dir, "name_lexicon"))
    return clean.select("doc_id", F.sha2("text", 256).alias("digest"), F.length("text").alias("chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_redacted": p1_redacted,
    "p2_found": p2_found,
    "p2_rates": p2_rates,
    "p3_found": p3_found,
    "p3_shared": p3_shared,
    "p4_found": p4_found,
    "p4_files": p4_files,
    "p5_found": p5_found,
    "p5_pairs": p5_pairs,
    "p6_arrangement": p6_arrangement,
    "p6_fill": p6_fill,
    "p7_found": p7_found,
    "p8_drawn": p8_drawn,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_redacted": p9_redacted,
}


def _shingles_sql(key: str, source: str) -> str:
    words = rf"regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')"
    parts = "list_transform(range(1, len(ws) - 10), lambda i: array_to_string(ws[i:i + 11], ' '))"
    return f"select distinct {key}, unnest({parts}) as s from (select {key}, {words} as ws from {source} where text is not null) where len(ws) >= 12"


SQL: dict[str, str] = {
    "p7_found": f"with d as ({_shingles_sql('doc_id', 'documents')}), i as ({_shingles_sql('item_id', 'eval_items')}) select distinct doc_id, item_id from d join i using (s)",
}
