"""Registered queries of the numbered operators: the driver's tables in, result columns out."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written_once
from . import (
    chats,
    language_model,
    leaks,
    line_dedup,
    loops,
    near_duplicates,
    packing,
    personal,
    repetition,
    secrets,
    token_counts,
    toxicity,
    whitening,
)


def _documents(spark: SparkSession, sf_dir: str, text: str = "description") -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return table.select(F.col("doc_id").alias("clip_id"), F.col("text").alias(text))


def _named(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("clip_id", "doc_id")


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _named(leaks.find_leaks(_documents(spark, sf_dir), items))


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return _named(packing.pack_answers(_documents(spark, sf_dir, "answer"), tokenizer, 4096))


def shared_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    freed = line_dedup.drop_shared_lines(_documents(spark, sf_dir))
    return _named(freed).select("doc_id", "n_lines", "n_dropped", F.sha2("description", 256).alias("kept_sha256"))


def lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _documents(spark, sf_dir)
    held_out = F.crc32(F.coalesce(F.col("clip_id").cast("string"), F.lit(""))) % 7 == 2
    model = language_model.count_model(texts.where(~held_out))
    scored = language_model.score_texts(texts, model)
    return _named(scored.withColumns({"held_out": held_out, "train_tokens": F.lit(model.tokens).cast("bigint")}))


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _documents(spark, sf_dir, "content").select(F.col("clip_id").alias("path"), F.lit(0).alias("version"), "content")
    # Two deliveries: the second one scans only what the stored ledger of the first lacks.
    first = F.coalesce(F.crc32(F.col("path").cast("string")), F.lit(0)) % 2 == 0
    ledger, found = None, None
    for delivery in (files.where(first), files.where(~first)):
        scan = secrets.scan_files(delivery, ledger)
        ledger = written_once(scan.ledger)
        found = scan.findings if found is None else found.unionByName(scan.findings)
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("bigint")
    return found.select(
        F.col("path").alias("doc_id"),
        *(count(k).alias(f"n_{k}") for k in secrets.BASE_KINDS),
        F.sha2(secrets.joined_spans(F.col("findings"), secrets.BASE_KINDS), 256).alias("base_sha256"),
        secrets.joined_spans(F.col("findings")).alias("spans"),
    )


def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    said = r"\### Assistant: </turn> ok"
    probe = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string"
    )
    turns = table.select("conv_id", "turn", "role", "text").unionByName(probe)
    turns = turns.select(F.col("conv_id").alias("clip_id"), "turn", "role", F.col("text").alias("content"))
    return chats.read_chats(chats.format_chats(turns)).withColumnRenamed("clip_id", "conv_id")


def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(near_duplicates.near_duplicates(_documents(spark, sf_dir), width=2, percent=80))


def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return _named(token_counts.count_tokens(_documents(spark, sf_dir, "prompt"), tokenizer, 512))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(repetition.measure_repetition(_documents(spark, sf_dir)))


def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.find_personal_data(_documents(spark, sf_dir))
    return _named(found.withColumnRenamed("plain_sha256", "base_sha256").drop("plain"))


def _with_tail_repeated(texts: DataFrame) -> DataFrame:
    """Texts as the contract of op11 has them: in a tenth, by a hash of the key, a tail of words is a loop."""
    words = F.filter(F.split(F.coalesce("description", F.lit("")), r"[ \t-\r]+"), lambda w: w != "")
    hashed = F.crc32(F.coalesce(F.col("clip_id").cast("string"), F.lit("")))
    g = F.floor(F.col("_h") / 10)
    looped = texts.withColumns({"_h": hashed, "_words": F.when(hashed % 10 == 0, words)})
    looped = looped.withColumn("_n", F.size("_words").cast("bigint"))
    looped = looped.withColumn("_a", F.when(F.col("_n") > 0, (g % F.col("_n")).cast("int")))
    looped = looped.withColumn("_p", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + g % 8))).cast("int"))
    left = (F.col("_n") - F.col("_a")).cast("int")
    period = F.slice("_words", F.col("_a") + 1, F.col("_p"))
    tail = F.slice(F.flatten(F.array_repeat(period, F.ceil(left / F.col("_p")).cast("int"))), 1, left)
    new = F.array_join(F.concat(F.slice("_words", 1, F.col("_a")), tail), " ")
    return looped.select("clip_id", F.when(F.col("_a").isNull(), F.col("description")).otherwise(new).alias("description"))


def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = loops.find_loops(_with_tail_repeated(_documents(spark, sf_dir)))
    longest = F.array_sort(
        F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))
    )
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.concat(F.array_join(F.transform("runs", line), "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    found = found.withColumn("_longest", F.get(longest, 0))
    return _named(found).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("_longest.s").alias("start"),
        (-F.col("_longest.l")).alias("length"),
        F.col("_longest.p").alias("period"),
        F.floor(-1000 * F.col("_longest.l") / F.col("_longest.p")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = table.select(F.col("vec_id").alias("frame_id"), F.col("embedding").alias("features"))
    white = whitening.whiten_vectors(vectors).withColumnRenamed("frame_id", "vec_id")
    return white.withColumn("deviation", F.col("deviation").cast("bigint"))


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("clip_id"), "toxic")
    held_out = F.crc32(F.coalesce(F.col("clip_id").cast("string"), F.lit(""))) % 5 == 0
    weights = toxicity.fit_weights(texts, labels.where(~held_out))
    return _named(toxicity.score_toxicity(texts, weights).withColumn("held_out", held_out))


QUERIES = {
    "op1_decontamination": decontamination,
    "op2_best_fit_packing": best_fit_packing,
    "op3_line_dedup": shared_lines,
    "op4_lm_scoring": lm_scores,
    "op5_secret_scan": secret_scan,
    "op6_chat_formatting": chat_formatting,
    "op7_near_dedup": near_dedup,
    "op8_token_counts": token_count,
    "op9_quality_rules": quality_rules,
    "op10_personal_data": personal_data,
    "op11_periodic_runs": periodic_runs,
    "op12_embedding_whitening": embedding_whitening,
    "op13_toxicity": toxicity_scores,
}
_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
#: DuckDB SQL of the operators that SQL can express; tests/llm compares the others with brute force.
ORACLES = {
    "op3_line_dedup": f"""WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, {_SPACES}), {_LOWER}) AS form FROM l),
shared AS (SELECT form, max(doc_id) AS keeper FROM k WHERE length(form) >= 40 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, keeper IS NOT NULL AND doc_id <> keeper AS gone FROM k LEFT JOIN shared USING (form))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY 1""",
    "op6_chat_formatting": r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(13 + length(role) + length(text) + length(regexp_replace(role, '[^\\<#\n]', '', 'g')) + length(regexp_replace(text, '[^\\<#]', '', 'g'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY 1""",
}
