"""The registered queries ``opN_<name>``: each applies one operator with production parameters to
its whole table and derives the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, infill, jaccard, langid, licenses, maxent, periodic, quality, repeats, rules, token_counts, token_files
from .common import free_names, tables

BPE_FILE = "byte_bpe_multi_50k.tiktoken"
FILE_TOKENIZER = "byte_bpe_50k.json"


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(bpe.encode(tables(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN))


def bpe_digest(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(tables(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE), public_tokenizers.PATTERN)


def op2_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(tables(spark, sf_dir, "documents"))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeats.remove_repeats(tables(spark, sf_dir, "documents").select("doc_id", "text"), passage_words=51)  # over fifty words
    text = F.make_valid_utf8(F.col("kept").cast("string"))  # a cut may part a character's bytes
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.octet_length("kept").cast("bigint").alias("n_kept"), text.alias("text"), "n_passage_words")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(tables(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "benchmark"))


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge(tables(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "posterior", "kept")


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(tables(spark, sf_dir, "documents"), width=3, num=9, den=10)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(tables(spark, sf_dir, "documents"))


def planted(docs: DataFrame) -> DataFrame:
    """``docs`` with the texts of one id in ten made periodic from some word on, as the contract of
    operator 11 says. A null id is not one of them."""
    words, n, g, a = free_names(docs, "_words", "_n", "_g", "_a")
    h = F.crc32(F.col("doc_id").cast("string"))
    rows = docs.withColumns({words: F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))), g: F.floor(h / 10)})
    rows = rows.withColumn(n, F.size(words).cast("bigint")).withColumn(a, F.try_mod(F.col(g), F.col(n)))
    period = 1 + F.floor((F.col(n) - F.col(a)) / (3 + F.col(g) % 8))
    place = lambda i: F.col(a) + (i - F.col(a)) % period
    made = F.array_join(F.transform(words, lambda w, i: F.when(i < F.col(a), w).otherwise(F.get(F.col(words), place(i).cast("int")))), " ")
    return rows.withColumn("text", F.when(F.col(n) > 0, made).otherwise(F.col("text"))).select(*docs.columns)


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.collapse_runs(planted(tables(spark, sf_dir, "documents").select("doc_id", "text"))).drop("text")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    rows = found.withColumn("_best", best)
    length, period = F.col("_best.length"), -F.col("_best.period")
    return rows.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("_best.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"), F.sha2(F.concat(lines, F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
        "n_words",
    )


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.fill_in_middle(tables(spark, sf_dir, "documents").select("doc_id", "text"))
    text = infill.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.new_folder(spark, "ids")
    token_files.write_ids(tables(spark, sf_dir, "documents"), public_tokenizers.path(FILE_TOKENIZER), folder)
    return token_files.read_ids(spark, folder, as_bytes=True).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_maxent": op2_maxent,
    "op3_repeats": op3_repeats,
    "op4_quality": op4_quality,
    "op5_langid": op5_langid,
    "op6_decontaminate": op6_decontaminate,
    "op7_rules": op7_rules,
    "op8_bpe": op8_bpe,
    "op9_jaccard": op9_jaccard,
    "op10_licenses": op10_licenses,
    "op11_periodic": op11_periodic,
    "op12_infill": op12_infill,
    "op13_token_files": op13_token_files,
}
ORACLE_SQL: dict[str, str] = {
    "op6_decontaminate": decontaminate.oracle_sql(),
    "op7_rules": rules.oracle_sql(),
    "op10_licenses": licenses.oracle_sql(),
    "op12_infill": infill.oracle_sql(),
}
