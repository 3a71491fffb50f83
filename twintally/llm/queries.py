"""One query for each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twintally.llm import alignment, codes, copies, credentials, disclosure, languages, leaks, lines, losses, packing, rules, shards, sql, urls
from twintally.llm.frames import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.classes(table(spark, sf_dir, "documents"), of_files=True).select("doc_id", "n_shingles", "component_id")


def op2_fm_index_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct("items"))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, x: n + x["length"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


#: Verdict, host and path.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op3_boosted_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given tables have no labels of URLs, so the trees learn from the URLs that the rules decide."""
    return urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES).drop("blocked")


def op4_suffix_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.measure(table(spark, sf_dir, "documents")).drop("longest_repeat")


def joined_spans(spans: Column, kinds: list[str], by_kind: bool) -> Column:
    """kind:start:end of all spans, by start and kind or by kind and start, comma-joined."""
    number = lambda s: F.array_position(F.array(*map(F.lit, kinds)), s["kind"])
    key = (lambda s: (number(s), s["start"])) if by_kind else (lambda s: (s["start"], number(s)))
    keyed = F.transform(spans, lambda s: F.struct(*(k.cast("bigint").alias(f"k{i}") for i, k in enumerate(key(s))), s["end"].alias("end"), s["kind"].alias("kind"), s["start"].alias("start")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def counted(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")


def op5_grammar_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = credentials.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "grammar")
    return found.select(
        "doc_id",
        *(counted("spans", kind) for kind in credentials.KINDS[:3]),
        F.sha2(joined_spans(base, credentials.KINDS, False), 256).alias("base_sha256"),
        joined_spans(F.col("spans"), credentials.KINDS, False).alias("spans"),
    )


def op6_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = disclosure.find_personal(table(spark, sf_dir, "documents"), of_files=True)
    base = F.filter("spans", lambda s: s["kind"] != "term")
    return found.select(
        "doc_id",
        *(counted("spans", kind) for kind in disclosure.KINDS[:4]),
        F.sha2(joined_spans(base, disclosure.KINDS, True), 256).alias("base_sha256"),
        joined_spans(F.col("spans"), disclosure.KINDS, True).alias("spans"),
    )


def op7_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0")
    return losses.loss_differences(table(spark, sf_dir, "documents"), good)


def op8_bounded_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024).drop("ids")


def op9_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    out = shards.shard(docs, 24, of_files=True)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_deletion_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents"), of_files=True).select("doc_id", "n_lines", "n_dropped", "text")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


def op13_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = lambda: F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4))
    found = languages.predict(docs, languages.learn(docs.where(fold() != 2)))
    return found.select("doc_id", (fold() == 2).alias("held_out"), "lang_pred", "score", F.size("spans").cast("bigint").alias("n_spans"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_grouped_prefix_join, op2_fm_index_leaks, op3_boosted_urls, op4_suffix_rules, op5_grammar_secrets, op6_disclosure, op7_cross_entropy_difference, op8_bounded_best_fit, op9_hypergeometric_shards, op10_deletion_neighbours, op11_token_alignment, op12_vector_codes, op13_language_spans)}
#: The others draw random numbers, train models, or give ids of a tokenizer; tests/llm holds them against brute force.
SQL: dict[str, str] = {
    "op1_grouped_prefix_join": sql.OP1,
    "op2_fm_index_leaks": sql.OP2,
    "op4_suffix_rules": sql.op4(),
    "op10_deletion_neighbours": sql.OP10,
    "op12_vector_codes": sql.op12(),
}
