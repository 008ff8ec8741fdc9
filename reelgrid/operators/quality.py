"""Checks and clean-up of generated metadata answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.numeric import compact, string_array
from ..sources.rules import PlatformRules
from . import scale

# Confidence grades and the answer fields with their JSON types.
PLACE_CONFIDENCE = ["high", "medium", "low", "unknown"]
ANSWER_FIELDS = {
    "title": "STRING",
    "description": "STRING",
    "keywords": "ARRAY<STRING>",
    "subject": "STRING",
    "placeConfidence": "STRING",
    "adobeCategory": "BIGINT",
    "shutterstockCategories": "ARRAY<STRING>",
    "envatoCategory": "STRING",
    "recognizableBuildings": "BOOLEAN",
    "editorialSuggested": "BOOLEAN",
    "editorialReason": "STRING",
}


def extract_json(answer: Column) -> Column:
    """Content of a Markdown fence if there is one, trimmed."""
    return T.unfenced(answer)


def validate_answers(df: DataFrame, rules: PlatformRules, answer: str = "answer") -> DataFrame:
    """Strict structure check. Adds ``parsed`` (struct, null when invalid) and ``errors``."""
    doc = F.col("_doc")
    df = df.withColumn("_json", extract_json(F.col(answer)))
    # Parsed as the only member of a list, so text behind the document is an error.
    listed_doc = F.try_parse_json(F.concat(F.lit("["), F.col("_json"), F.lit("]")))
    single = F.try_variant_get(listed_doc, "$[1]", "variant").isNull()
    df = scale.pinned(df, {"_doc": F.when(single, F.try_variant_get(listed_doc, "$[0]", "variant"))})
    # Every field is read and typed once per answer.
    read = {"ARRAY<STRING>": "array<string>", "BIGINT": "bigint", "BOOLEAN": "boolean", "STRING": "string"}
    values = F.struct(*[F.try_variant_get(doc, f"$.{f}", read[t]).alias(f) for f, t in ANSWER_FIELDS.items()])
    kinds = F.struct(
        *[F.schema_of_variant(F.try_variant_get(doc, f"$.{f}", "variant")).alias(f) for f in ANSWER_FIELDS]
    )
    df = scale.pinned(df, {"_value": values, "_kind": kinds})
    value = lambda f: F.col("_value")[f]
    kind = lambda f: F.col("_kind")[f]

    def complain(field: str, bad: Column, message: str) -> Column:
        return F.when(bad, F.lit(f"{field}: {message}"))

    checks, right = [], {}
    for field, expected in ANSWER_FIELDS.items():
        allowed = [expected]
        if field == "editorialReason":
            allowed.append("VOID")
        if expected.startswith("ARRAY"):
            allowed.append("ARRAY<VOID>")
        right[field] = F.coalesce(kind(field).isin(*allowed), F.lit(False))
        checks.append(complain(field, ~right[field], f"expected {expected.lower()}"))
    for field in ("title", "description", "subject"):
        checks.append(complain(field, right[field] & (F.length(value(field)) == 0), "must not be empty"))
    words = value("keywords")
    checks.append(complain("keywords", right["keywords"] & (F.size(words) == 0), "at least 1 is required"))
    checks.append(complain("keywords", right["keywords"] & F.exists(words, lambda k: k == ""), "must not be empty"))

    def listed(field: str, options: list) -> Column:
        picked = value(field)
        return complain(field, right[field] & ~picked.isin(*options), "not in the list")

    checks.append(listed("placeConfidence", PLACE_CONFIDENCE))
    checks.append(listed("adobeCategory", [c["id"] for c in rules.adobe["categories"]]))
    checks.append(listed("envatoCategory", rules.envato["categories"]))
    picked = value("shutterstockCategories")
    field = "shutterstockCategories"
    checks.append(complain(field, right[field] & ~F.size(picked).between(1, 2), "1 or 2 values are required"))
    unknown = F.size(F.array_except(picked, string_array(rules.shutterstock["categories"]))) > 0
    checks.append(complain(field, right[field] & unknown, "not in the list"))
    extra = F.array_except(F.json_object_keys("_json"), string_array(list(ANSWER_FIELDS)))
    checks.append(F.when(F.size(extra) > 0, F.concat(F.lit("answer: unrecognized keys "), F.array_join(extra, ", "))))
    is_object = F.coalesce(F.schema_of_variant(doc).startswith("OBJECT"), F.lit(False))
    errors = (
        F.when(doc.isNull(), F.array(F.lit("the answer is not valid JSON")))
        .when(~is_object, F.array(F.lit("answer: expected an object")))
        .otherwise(compact(checks))
    )
    df = scale.pinned(df, {"errors": errors})
    return df.withColumn("parsed", F.when(F.size("errors") == 0, F.col("_value"))).drop("_json", "_doc", "_value", "_kind")


def check_limits(
    limits: dict, title: Column, description: Column, keywords: Column, editorial: Column, reason: Column
) -> Column:
    """array<struct<message, hard>> of length and count problems."""

    def entry(cond: Column, message: Column, hard: bool) -> Column:
        return F.when(cond, F.struct(message.alias("message"), F.lit(hard).alias("hard")))

    def sized(cond: Column, prefix: str, n: Column, suffix: str, hard: bool = False) -> Column:
        return entry(cond, F.concat(F.lit(prefix), n.cast("string"), F.lit(suffix)), hard)

    from ..functions.numeric import let

    def entries(unique: Column) -> Column:
        few = f" unique keywords, at least {limits['keywordsMin']} are required"
        t_len, d_len, n = F.length(title), F.length(description), F.size(keywords)
        return compact(
            [
                sized(t_len > limits["titleMax"], "title is ", t_len, f" characters, the maximum is {limits['titleMax']}"),
                sized(
                    d_len > limits["descriptionMax"],
                    "description is ",
                    d_len,
                    f" characters, the maximum is {limits['descriptionMax']}",
                ),
                sized(unique < limits["keywordsHardMin"], "only ", unique, few, True),
                sized(
                    (unique >= limits["keywordsHardMin"]) & (unique < limits["keywordsMin"]), "only ", unique, few
                ),
                sized(n > limits["keywordsMax"], "", n, f" keywords, the maximum is {limits['keywordsMax']}"),
                entry(
                    editorial & (F.coalesce(F.length(F.trim(reason)), F.lit(0)) == 0),
                    F.lit("editorialSuggested is true but editorialReason is empty"),
                    False,
                ),
            ]
        )

    unique = F.size(F.array_distinct(F.transform(F.array_distinct(keywords), lambda k: F.lower(F.trim(k)))))
    return let(unique, entries)


def accept_attempts(log: DataFrame, max_attempts: int = 3) -> DataFrame:
    """Outcome per clip of its attempt log (clip_id, attempt, issues array<struct<message, hard>>).

    The first clean attempt wins; attempt ``max_attempts`` and later ones (a log that goes on after the
    limit) are also accepted with soft issues only. ``surplus`` counts the attempts beyond the limit.
    """
    last = F.col("attempt") >= max_attempts
    soft_only = ~F.exists("issues", lambda i: i["hard"])
    good = (F.size("issues") == 0) | (last & soft_only)
    messages = F.transform("issues", lambda i: i["message"])
    return (
        log.groupBy("clip_id")
        .agg(
            F.min(F.when(good, F.col("attempt"))).alias("accepted_attempt"),
            F.max("attempt").alias("tried"),
            F.max_by(messages, "attempt").alias("last_errors"),
            F.count_if(F.col("attempt") > max_attempts).alias("surplus"),
        )
        .select(
            "clip_id",
            "accepted_attempt",
            F.when(F.col("accepted_attempt").isNotNull(), "accepted")
            .when(F.col("tried") >= max_attempts, "failed")
            .otherwise("pending")
            .alias("outcome"),
            F.when(F.col("accepted_attempt").isNull(), F.col("last_errors")).alias("errors"),
            "surplus",
        )
    )


def answer_stats(log: DataFrame) -> DataFrame:
    """Attempts, failures and duration per model and prompt version."""
    failed = F.size("errors") > 0
    return log.groupBy("model", "prompt_version").agg(
        F.count(F.lit(1)).alias("attempts"),
        F.max("attempt").alias("max_attempt"),
        F.count_if(failed).alias("failures"),
        F.avg("duration_ms").alias("mean_ms"),
    )


def answer_reasons(log: DataFrame) -> DataFrame:
    return (
        log.select("model", "prompt_version", F.explode("errors").alias("reason"))
        .groupBy("model", "prompt_version", "reason")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def postprocess_metadata(df: DataFrame, rules: PlatformRules) -> DataFrame:
    """Filler words out, limits applied, keywords cleaned, categories distinct, reason consistent."""
    limits, words = rules.common["llm"], rules.keyword_rules
    fillers = list(words.filler_words)
    reason = F.trim("editorial_reason")
    return df.withColumns(
        {
            "title": T.truncate_at_word(T.remove_words(F.col("title"), fillers), limits["titleMax"]),
            "description": T.truncate_text(T.remove_words(F.col("description"), fillers), limits["descriptionMax"]),
            "subject": F.array_join(F.slice(F.split(T.collapse(F.col("subject")), " "), 1, 5), " "),
            "keywords": T.clean_keywords(F.col("keywords"), words, limits["keywordsMax"]),
            "shutterstock_categories": F.slice(F.array_distinct("shutterstock_categories"), 1, 2),
            "editorial_reason": F.when(F.col("editorial_suggested") & (F.length(reason) > 0), reason),
        }
    )


def bulk_keywords(clips: DataFrame, edits: DataFrame) -> DataFrame:
    """Keyword edits of selected clips: op add / remove / replace, word, replacement."""
    rows = clips.join(edits, "clip_id", "left")
    words, op = F.col("keywords"), F.col("op")
    same = lambda k: F.lower(k) == F.lower(F.col("word"))
    added = F.when(F.exists(words, same), words).otherwise(F.concat(words, F.array(F.lower("word"))))
    replaced = T.distinct_ci(
        F.filter(
            F.transform(words, lambda k: F.when(same(k), F.lower("replacement")).otherwise(k)), lambda k: k != ""
        )
    )
    result = (
        F.when(op == "add", added)
        .when(op == "remove", F.filter(words, lambda k: ~same(k)))
        .when(op == "replace", replaced)
        .otherwise(words)
    )
    return rows.withColumn("keywords", F.when(words.isNotNull(), result)).drop("op", "word", "replacement")


def patch_metadata(clips: DataFrame, patches: DataFrame, fields: list[str]) -> DataFrame:
    """Overlay the given fields; ``editorial`` is tri-state and only replaced when the patch sets it."""
    p = patches.select("clip_id", *[F.col(f).alias(f"_p_{f}") for f in fields])
    out = clips.join(p, "clip_id", "left")
    return out.withColumns({f: F.coalesce(f"_p_{f}", f) for f in fields}).drop(*[f"_p_{f}" for f in fields])
