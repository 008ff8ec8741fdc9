"""Registered queries over texts, keywords, metadata quality and platform rows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..config import ExportSettings
from ..functions import text as T
from ..operators import naming as N
from ..operators import platforms as P
from ..operators import quality as Q
from ..sources.rules import load_platform_rules
from . import bindings as B
from .bindings import duck, duck_six, six

RULES = load_platform_rules()
LIMITS = RULES.common["llm"]
CONTEXT = P.DeliveryContext(
    ExportSettings(
        adobe_author="Jane Doe", copyright="© Jane Doe 2024", pond5_price=79, pond5_price_large=149,
        envato_price_single=19, envato_price_multi=39.5,
    ),
    date(2024, 8, 2),
    RULES,
)


def _words(spark, sf):
    return B.clip_text(spark, sf).withColumn("keywords", F.split("kw_text", " "))


def truncate_text(spark, sf):
    return B.clip_text(spark, sf).select(
        "clip_id",
        T.truncate_at_word(F.col("title"), 70).alias("title"),
        T.truncate_text(F.col("description"), 200).alias("description"),
    )


def slugify(spark, sf):
    return B.clip_text(spark, sf).select("clip_id", F.md5(T.slugify(F.col("title"))).alias("slug"))


def remove_fillers(spark, sf):
    words = ["the", "of", "and", "le", "la", "der", "und", "el", "de"]
    return B.clip_text(spark, sf).select("clip_id", F.md5(T.remove_words(F.col("title"), words)).alias("kept"))


def _joined(c):
    return F.array_join(c, "|")


def clean_keywords(spark, sf):
    clean = T.clean_keywords(F.col("keywords"), RULES.keyword_rules, 49)
    return _words(spark, sf).select("clip_id", _joined(clean).alias("keywords"))


def csv_keywords(spark, sf):
    out = _words(spark, sf).withColumn("kw", T.limit_keywords(T.csv_keywords(F.col("keywords")), F.size("keywords"), 5, 50))
    return out.select("clip_id", _joined("kw.out").alias("keywords"), _joined(F.col("kw.issues.message")).alias("issues"))


def envato_keywords(spark, sf):
    return _words(spark, sf).select("clip_id", _joined(T.envato_keywords(F.col("keywords"), RULES.tag_rules)).alias("keywords"))


def pond5_text(spark, sf):
    clean = T.pond5_sanitize(F.col("title"), RULES.pond5["forbiddenCharacters"])
    return B.clip_text(spark, sf).select("clip_id", F.md5(clean).alias("title"), F.length(clean).alias("n"))


def split_tags(spark, sf):
    known = F.array(F.lit("the"), F.lit("And"))
    return B.clip_text(spark, sf).select("clip_id", F.md5(_joined(T.split_tags(F.col("title"), known))).alias("tags"))


def norm_names(spark, sf):
    names = B.pois(spark, sf).select("id", F.concat(F.lit("Élan-Ö "), "name").alias("name"))
    return names.select("id", T.norm_name(F.col("name")).alias("key"))


def _named(spark, sf):
    return B.delivery_clips(spark, sf).withColumns(
        {
            "ordinal": F.col("clip_id").cast("int"),
            "first_name": N.render_filename(
                "{subject}_{place}_{motion}_{date}", "mov", F.col("subject"), F.coalesce("city", "region", "country"),
                F.lit("orbit_left"), F.col("capture_date"), F.col("clip_id").cast("int"),
            ),
        }
    )


def filenames(spark, sf):
    return N.assign_filenames(_named(spark, sf).select("job_id", "clip_id", "ordinal", "first_name"), "mov")


def bulk_keywords(spark, sf):
    clips = _words(spark, sf).withColumn("keywords", F.array_distinct("keywords")).select("clip_id", "keywords")
    turn = F.col("clip_id") % 3
    edits = clips.select(
        "clip_id", F.when(turn == 0, "add").when(turn == 1, "remove").otherwise("replace").alias("op"),
        F.lit("of").alias("word"), F.lit("Drone").alias("replacement"),
    )
    return Q.bulk_keywords(clips, edits).select("clip_id", F.md5(_joined(F.array_sort("keywords"))).alias("keywords"), F.size("keywords").alias("n"))


def patch_metadata(spark, sf):
    clips = B.clip_text(spark, sf).select("clip_id", "title", "adobe_category", F.lit(None).cast("boolean").alias("editorial"))
    patches = B.decisions(spark, sf).select(
        "clip_id", F.when(F.col("approved"), "patched").alias("title"), F.lit(None).cast("bigint").alias("adobe_category"), "editorial"
    )
    return Q.patch_metadata(clips, patches, ["title", "adobe_category", "editorial"]).select("clip_id", F.md5("title").alias("title"), "adobe_category", "editorial")


def limit_issues(spark, sf):
    clips = _words(spark, sf)
    issues = Q.check_limits(LIMITS, F.col("title"), F.col("description"), F.col("keywords"), F.col("clip_id") % 5 == 0, F.lit(None).cast("string"))
    return clips.withColumn("issues", issues).select(
        "clip_id", _joined(F.col("issues.message")).alias("messages"), F.exists("issues", lambda i: i["hard"]).alias("hard")
    )


def extract_json(spark, sf):
    fenced = B.answer_log(spark, sf).withColumn(
        "answer", F.when(F.col("attempt") % 2 == 0, F.concat(F.lit("Here:\n```json\n "), "answer", F.lit("\n```\nbye"))).otherwise(F.col("answer"))
    )
    return fenced.select("clip_id", "attempt", F.md5(Q.extract_json(F.col("answer"))).alias("body"))


def _answer_documents(spark, sf):
    """Answers as JSON, with a defect chosen by the clip id."""
    k = F.col("clip_id") % 8
    keywords = F.filter(F.split("kw_text", " "), lambda w: w != "")
    doc = F.struct(
        F.when(k == 1, F.lit("")).otherwise(F.col("title")).alias("title"),
        F.col("description"),
        keywords.alias("keywords"),
        F.lit("river valley").alias("subject"),
        F.when(k == 2, "certain").otherwise("high").alias("placeConfidence"),
        (F.col("adobe_category") + 1).alias("adobeCategory"),
        F.when(k == 3, F.array(F.lit("Nature"), F.lit("Art"), F.lit("People"))).otherwise(F.array(F.lit("Nature"))).alias("shutterstockCategories"),
        F.when(k == 4, "Parks").otherwise("Nature").alias("envatoCategory"),
        (k == 0).alias("recognizableBuildings"),
        F.lit(False).alias("editorialSuggested"),
        F.lit(None).cast("string").alias("editorialReason"),
        F.when(k == 5, F.lit(1)).alias("extra"),
    )
    text = F.to_json(doc, {"ignoreNullFields": "true"})
    closed = F.concat(F.substring(text, F.lit(1), F.length(text) - 1), F.lit(',"editorialReason":null}'))
    return B.clip_text(spark, sf).select("clip_id", F.when(k == 6, F.substring(text, F.lit(2), F.length(text))).when(k == 7, F.concat(F.lit("```json\n"), closed, F.lit("```"))).otherwise(closed).alias("answer"))


def validate_answers(spark, sf):
    out = Q.validate_answers(_answer_documents(spark, sf), RULES)
    return out.select("clip_id", _joined("errors").alias("errors"), F.size("parsed.keywords").alias("n_keywords"))


def _attempts(spark, sf):
    n = F.col("n_chars")
    item = lambda m, hard: F.struct(F.lit(m).alias("message"), F.lit(hard).alias("hard"))
    return B.answer_log(spark, sf).withColumn(
        "issues", F.array_compact(F.array(F.when(n > 150, item("long", False)), F.when(n < 60, item("short", True))))
    )


def accept_attempts(spark, sf):
    return Q.accept_attempts(_attempts(spark, sf)).select("clip_id", "accepted_attempt", "outcome", _joined("errors").alias("errors"), "surplus")


def answer_stats(spark, sf):
    log = _attempts(spark, sf).withColumns(
        {
            "errors": F.transform("issues", lambda i: i["message"]), "model": F.concat(F.lit("m"), (F.col("clip_id") % 3).cast("string")),
            "prompt_version": F.lit("metadata.v1"), "duration_ms": F.col("n_chars") * 10,
        }
    )
    return Q.answer_stats(log).select("model", "attempts", "max_attempt", "failures", six("mean_ms").alias("mean_ms")).join(
        Q.answer_reasons(log).groupBy("model").agg(F.sum("n").alias("reasons")), "model", "left"
    )


def postprocess_metadata(spark, sf):
    out = Q.postprocess_metadata(B.delivery_clips(spark, sf), RULES)
    return out.select("clip_id", "title", "description", "subject", _joined("keywords").alias("keywords"), "editorial_reason")


def media_issues(spark, sf):
    return B.delivery_clips(spark, sf).select("clip_id", _joined(F.transform(P.media_issues(RULES.adobe["limits"]), lambda i: i["message"])).alias("messages"))


def _view(spark, sf):
    return P.csv_clip_view(B.delivery_clips(spark, sf))


def _platform(name):
    def rows(spark, sf):
        out = P.REGISTRY[name](_view(spark, sf), CONTEXT)
        return out.select("clip_id", _joined("row").alias("row"), _joined(F.transform("issues", lambda i: F.concat(i["level"], F.lit(": "), i["message"]))).alias("issues"))

    return rows


def clip_view(spark, sf):
    return _view(spark, sf).select("clip_id", "filename", "editorial")


def clips_by_platform(spark, sf):
    return P.clips_by_platform(_view(spark, sf), CONTEXT).select("clip_id", "platform")


def category_check(spark, sf):
    return P.category_check(B.delivery_clips(spark, sf), CONTEXT)


def report_counts(spark, sf):
    return P.report_counts(P.validations(_view(spark, sf), CONTEXT, ("clip_id", "job_id")))


def report_totals(spark, sf):
    return P.report_totals(B.delivery_clips(spark, sf)).select(
        "job_id", "clips", six("seconds").alias("seconds"), six("gigabytes").alias("gigabytes"), "low_confidence", "editorial"
    )


QUERIES = {
    f.__name__: f
    for f in (
        truncate_text, slugify, remove_fillers, clean_keywords, csv_keywords, envato_keywords, pond5_text, split_tags,
        norm_names, filenames, bulk_keywords, patch_metadata, limit_issues, extract_json, validate_answers,
        accept_attempts, answer_stats, postprocess_metadata, media_issues, clip_view, clips_by_platform,
        category_check, report_counts, report_totals,
    )
} | {f"{p}_rows": _platform(p) for p in P.REGISTRY}

# ---- oracle SQL -------------------------------------------------------------------------------

_US = chr(31)
_WS = r"[\s\x0b\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def _collapse(e):
    return f"trim(regexp_replace({e}, '{_WS}+', ' ', 'g'))"


def _at_word(t, n):
    """Word cut of an already collapsed expression."""
    head = f"substr({t}, 1, {n + 1})"
    to_space = f"regexp_extract({head}, '^(.*) [^ ]*$', 1)"
    base = f"CASE WHEN {head} LIKE '% %' AND length({to_space}) > {n} * 5e-1 THEN {to_space} ELSE substr({t}, 1, {n}) END"
    return f"CASE WHEN length({t}) <= {n} THEN {t} ELSE regexp_replace({base}, '[\\s,;:\\-–—(]+$', '') END"


def _at_sentence(t, n):
    head = f"substr({t}, 1, {n})"
    end = f"greatest(length(regexp_extract({head}, '^(.*[.!?]) .*$', 1)) - 1, CASE WHEN {head} LIKE '%.' THEN {n - 1} ELSE -1 END)"
    return f"CASE WHEN length({t}) <= {n} THEN {t} WHEN {end} > {n} * 5e-1 THEN substr({head}, 1, {end} + 1) ELSE {_at_word(t, n)} END"


def _ascii(e):
    for a, b in (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("ø", "o")):
        e = f"replace({e}, '{a}', '{b}')"
    return f"strip_accents({e})"


def _remove(e, words):
    # A removed word also takes the whitespace behind it.
    pattern = "|".join(words)
    return _collapse(f"regexp_replace({e}, '(?i)\\b(?:{pattern})\\b{_WS}*', '', 'g')")


_TOKENS = """tok AS (SELECT clip_id, pos, w FROM (
  SELECT clip_id, unnest(keywords) AS w, generate_subscripts(keywords, 1) AS pos FROM {src}))"""
_SPLIT = "src AS (SELECT clip_id, string_split(kw_text, ' ') AS keywords FROM clip_text)"


def _csv_list(source, clean, limit, out="csv"):
    """First-wins distinct of cleaned words: (clip_id, n, joined first ``limit``)."""
    return f"""{_TOKENS.format(src=source).replace("tok AS", f"{out}_tok AS")},
{out}_w AS (SELECT clip_id, pos, {clean} AS w FROM {out}_tok),
{out}_d AS (SELECT clip_id, w, min(pos) AS pos FROM {out}_w WHERE w <> '' GROUP BY 1, 2),
{out}_r AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY pos) AS rn FROM {out}_d),
{out} AS (SELECT clip_id, count(*) AS n, string_agg(w, '{_US}' ORDER BY rn) FILTER (WHERE rn <= {limit}) AS kw FROM {out}_r GROUP BY 1)"""


_CSV_CLEAN = _collapse("regexp_replace(w, '[,;\"]+', ' ', 'g')")
_kw_r = RULES.keyword_rules
_quote = lambda ws: ", ".join("'" + w + "'" for w in ws)
_BRANDS = "|".join(w.replace(".", "\\.") for w in _kw_r.brand_names)
_CLEAN = f"""kw0 AS (SELECT clip_id, pos, {_collapse(f"regexp_replace(regexp_replace(lower(w), '[^\\p{{L}}\\p{{N}}{_WS[1:-1]}''-]', ' ', 'g'), '^(?:{_WS}|[''-])+|(?:{_WS}|[''-])+$', '', 'g')")} AS k FROM tok),
kw1 AS (SELECT *, regexp_extract(k, '^(.* )?([^ ]*)$', 1) AS head, regexp_extract(k, '([^ ]*)$', 1) AS tail FROM kw0
  WHERE k <> '' AND k NOT IN ({_quote(w.lower() for w in (*_kw_r.technical_terms, *_kw_r.brand_names))})
    AND NOT regexp_matches(k, '(?i)\\b(?:{_BRANDS})\\b') AND NOT regexp_matches(k, '^\\d+(\\.\\d+)?\\s*(k|p|fps|mbps|bit)$') AND NOT regexp_matches(k, '^\\d+$')),
kw2 AS (SELECT *, head || CASE WHEN length(tail) <= 3 THEN tail WHEN tail LIKE '%ies' THEN substr(tail, 1, length(tail) - 3) || 'y'
  WHEN regexp_matches(tail, '(ches|shes|sses|xes|zes)$') THEN substr(tail, 1, length(tail) - 2)
  WHEN regexp_matches(tail, '[^s]s$') AND NOT regexp_matches(tail, '(ss|us|is)$') THEN substr(tail, 1, length(tail) - 1) ELSE tail END AS norm FROM kw1),
kw3 AS (SELECT clip_id, arg_min(k, pos) AS k, min(pos) AS pos FROM kw2 GROUP BY clip_id, norm),
kw4 AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY pos) AS rn FROM kw3),
kws AS (SELECT clip_id, string_agg(k, '|' ORDER BY rn) AS kw FROM kw4 WHERE rn <= 49 GROUP BY 1)"""

_ENVATO_CLEAN = f"""trim(substr(regexp_replace({_collapse("regexp_replace(" + _ascii("w") + ", '[^A-Za-z0-9. ]+', ' ', 'g')")}, '^\\.+', ''), 1, 100))"""


def _envato(source):
    return f"""{_TOKENS.format(src=source).replace("tok AS", "ev_tok AS")},
ev_w AS (SELECT clip_id, pos, {_ENVATO_CLEAN} AS w FROM ev_tok),
ev_d AS (SELECT clip_id, w, min(pos) AS pos FROM ev_w WHERE w <> '' AND NOT regexp_matches(w, '^[0-9.]+$') GROUP BY 1, 2),
ev_r AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY pos) AS rn,
  sum(length(w) + 1) OVER (PARTITION BY clip_id ORDER BY pos) - 1 AS used FROM ev_d),
ev AS (SELECT clip_id, count(*) AS n, string_agg(w, '{_US}' ORDER BY rn) AS kw FROM ev_r WHERE rn <= 50 AND used <= 2048 GROUP BY 1)"""


def _sanitize(e):
    for ch, words in T.READABLE.items():
        if ch in RULES.pond5["forbiddenCharacters"]:
            e = f"replace({e}, '{ch}', '{words}')"
    e = _ascii(e)
    for ch in RULES.pond5["forbiddenCharacters"]:
        e = f"replace({e}, '{ch.replace(chr(39), chr(39) * 2)}', '')"
    return f"regexp_replace({_collapse('regexp_replace(' + e + ', ' + chr(39) + '[^ -~]' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}, ' +([,.;:!])', '\\1', 'g')"


def _media(lim):
    gb = f"{lim['maxFileSizeBytes'] / 1024**3:.2f}"
    return f"""CASE WHEN duration_sec < {lim['minDurationSec']} THEN 'error: Clip is ' || printf('%.1f', duration_sec) || ' s, the minimum is {lim['minDurationSec']} s'
      WHEN duration_sec > {lim['maxDurationSec']} THEN 'error: Clip is ' || printf('%.1f', duration_sec) || ' s, the maximum is {lim['maxDurationSec']} s' END,
    CASE WHEN size > {lim['maxFileSizeBytes']} THEN 'error: File is ' || printf('%.2f', size / 1073741824e0) || ' GB, the limit is {gb} GB' END"""


def _cut(n_expr, limit, field):
    return f"CASE WHEN {n_expr} > {limit} THEN 'warning: {field} shortened from ' || {n_expr} || ' to {limit} characters' END"


def _count_issues(lim, raw):
    lo, hi = lim["keywordsMin"], lim["keywordsMax"]
    return f"""CASE WHEN coalesce(n, 0) > {hi} THEN 'warning: ' || {raw} || ' keywords, only the first {hi} are used' END,
    CASE WHEN coalesce(n, 0) < {lo} THEN 'error: ' || coalesce(n, 0) || ' keywords, at least {lo} are required' END"""


_TEXT = f"t0 AS (SELECT *, {_collapse('text')} AS t FROM delivery)"
_EDITORIAL_NOTE = "warning: Marked editorial: Adobe Stock video editorial content is limited, check the submission rules"
_DAY = "coalesce('07/' || day || '/2024', '08/02/2024')"
_PREFIX = """CASE WHEN editorial THEN CASE WHEN city = '' AND country = '' THEN '' ELSE concat_ws(', ', nullif(city, ''), nullif(country, '')) || ' ' END
   || coalesce('2024/07/' || day, '2024/08/02') || ': ' ELSE '' END"""

ORACLES = {
    "truncate_text": f"""WITH t AS (SELECT doc_id AS clip_id, {_collapse("text")} AS t FROM documents)
SELECT clip_id, {_at_word("t", 70)} AS title, {_at_sentence("t", 200)} AS description FROM t""",
    "slugify": f"""SELECT doc_id AS clip_id, md5(trim(regexp_replace(lower({_ascii("text")}), '[^a-z0-9]+', '_', 'g'), '_')) AS slug FROM documents""",
    "remove_fillers": f"""SELECT doc_id AS clip_id, md5({_remove("text", ["the", "of", "and", "le", "la", "der", "und", "el", "de"])}) AS kept FROM documents""",
    "clean_keywords": f"""WITH {duck("clip_text")}, {_SPLIT}, {_TOKENS.format(src="src")}, {_CLEAN}
SELECT c.clip_id, coalesce(kw, '') AS keywords FROM clip_text c LEFT JOIN kws ON c.clip_id = kws.clip_id""",
    "csv_keywords": f"""WITH {duck("clip_text")}, {_SPLIT}, {_csv_list("src", _CSV_CLEAN, 50)}
SELECT s.clip_id, coalesce(replace(kw, '{_US}', '|'), '') AS keywords, replace(replace(concat_ws('|', {_count_issues({"keywordsMin": 5, "keywordsMax": 50}, "len(keywords)")}), 'warning: ', ''), 'error: ', '') AS issues
FROM src s LEFT JOIN csv ON s.clip_id = csv.clip_id""",
    "envato_keywords": f"""WITH {duck("clip_text")}, {_SPLIT}, {_envato("src")}
SELECT s.clip_id, coalesce(replace(kw, '{_US}', '|'), '') AS keywords FROM src s LEFT JOIN ev ON s.clip_id = ev.clip_id""",
    "pond5_text": f"""SELECT doc_id AS clip_id, md5({_sanitize("text")}) AS title, CAST(length({_sanitize("text")}) AS INT) AS n FROM documents""",
    "split_tags": f"""WITH {duck("clip_text")},
s AS (SELECT clip_id, string_split(title, ',') AS keywords FROM clip_text), {_TOKENS.format(src="s")},
d AS (SELECT clip_id, lower(trim(w, ' ')) AS w, min(pos) AS pos FROM tok GROUP BY 1, 2)
SELECT c.clip_id, md5(coalesce(string_agg(w, '|' ORDER BY pos) FILTER (WHERE w NOT IN ('', 'the', 'and')), '')) AS tags
FROM clip_text c LEFT JOIN d ON c.clip_id = d.clip_id GROUP BY c.clip_id""",
    "norm_names": "SELECT s_suppkey AS id, 'e lan o ' || trim(regexp_replace(lower(s_name), '[^a-z0-9]+', ' ', 'g')) AS key FROM supplier",
    "filenames": f"""WITH {duck("delivery")},
f AS (SELECT *, lang || '_river_valley_' || CASE WHEN city = '' THEN 'region_co' ELSE 'zurich_' || lang END || '_orbit' || coalesce('_202407' || day, '') AS base FROM delivery),
r AS (SELECT *, row_number() OVER (PARTITION BY job_id, base ORDER BY clip_id) AS k FROM f)
SELECT job_id, clip_id, CAST(clip_id AS INT) AS ordinal, base || CASE WHEN k = 1 THEN '' ELSE '_' || k END || '.mov' AS filename FROM r""",
    "bulk_keywords": f"""WITH {duck("clip_text")}, {_SPLIT}, {_TOKENS.format(src="src")},
w AS (SELECT DISTINCT clip_id, w FROM tok),
e AS (SELECT clip_id, w FROM w WHERE clip_id % 3 = 0 UNION SELECT DISTINCT clip_id, 'of' FROM w WHERE clip_id % 3 = 0
  UNION ALL SELECT clip_id, w FROM w WHERE clip_id % 3 = 1 AND w <> 'of'
  UNION ALL SELECT DISTINCT clip_id, CASE WHEN w = 'of' THEN 'drone' ELSE w END FROM w WHERE clip_id % 3 = 2 AND w <> '')
SELECT c.clip_id, md5(coalesce(string_agg(w, '|' ORDER BY encode(w)), '')) AS keywords, CAST(count(w) AS INT) AS n FROM clip_text c LEFT JOIN e ON c.clip_id = e.clip_id GROUP BY 1""",
    "patch_metadata": f"""WITH {duck("clip_text", "decisions")}
SELECT c.clip_id, md5(CASE WHEN approved THEN 'patched' ELSE title END) AS title, adobe_category, editorial FROM clip_text c LEFT JOIN decisions d ON c.clip_id = d.clip_id""",
    "limit_issues": f"""WITH {duck("clip_text")}, {_SPLIT}, {_TOKENS.format(src="src")},
u AS (SELECT clip_id, count(DISTINCT lower(trim(w, ' '))) AS u, count(*) AS n FROM tok GROUP BY 1)
SELECT c.clip_id, concat_ws('|', CASE WHEN length(title) > 70 THEN 'title is ' || length(title) || ' characters, the maximum is 70' END,
  CASE WHEN length(description) > 200 THEN 'description is ' || length(description) || ' characters, the maximum is 200' END,
  CASE WHEN u < 35 THEN 'only ' || u || ' unique keywords, at least 35 are required' END,
  CASE WHEN n > 49 THEN n || ' keywords, the maximum is 49' END,
  CASE WHEN c.clip_id % 5 = 0 THEN 'editorialSuggested is true but editorialReason is empty' END) AS messages, u < 5 AS hard
FROM clip_text c JOIN u ON c.clip_id = u.clip_id""",
    "extract_json": f"""WITH {duck("answer_log")} SELECT clip_id, attempt, md5(regexp_replace(answer, '^{_WS}+|{_WS}+$', '', 'g')) AS body FROM answer_log""",
    "validate_answers": f"""WITH {duck("clip_text")}, k AS (SELECT *, clip_id % 8 AS k, len(list_filter(string_split(kw_text, ' '), lambda w: w <> '')) AS n FROM clip_text),
e AS (SELECT *, CASE WHEN k = 6 THEN 'the answer is not valid JSON' ELSE concat_ws('|',
    CASE WHEN k = 1 THEN 'title: must not be empty' END, CASE WHEN n = 0 THEN 'keywords: at least 1 is required' END,
    CASE WHEN k = 2 THEN 'placeConfidence: not in the list' END,
    CASE WHEN adobe_category + 1 NOT BETWEEN 1 AND 21 THEN 'adobeCategory: not in the list' END,
    CASE WHEN k = 4 THEN 'envatoCategory: not in the list' END,
    CASE WHEN k = 3 THEN 'shutterstockCategories: 1 or 2 values are required' END,
    CASE WHEN k = 5 THEN 'answer: unrecognized keys extra' END) END AS errors FROM k)
SELECT clip_id, errors, CASE WHEN errors = '' THEN CAST(n AS INT) END AS n_keywords FROM e""",
    "accept_attempts": f"""WITH {duck("answer_log")},
l AS (SELECT *, concat_ws('|', CASE WHEN n_chars > 150 THEN 'long' END, CASE WHEN n_chars < 60 THEN 'short' END) AS errs FROM answer_log),
a AS (SELECT clip_id, min(attempt) FILTER (WHERE errs = '' OR (attempt >= 3 AND n_chars >= 60)) AS accepted_attempt, max(attempt) AS tried, arg_max(errs, attempt) AS errs, count(*) FILTER (WHERE attempt > 3) AS surplus FROM l GROUP BY 1)
SELECT clip_id, surplus, accepted_attempt, CASE WHEN accepted_attempt IS NOT NULL THEN 'accepted' WHEN tried >= 3 THEN 'failed' ELSE 'pending' END AS outcome,
  CASE WHEN accepted_attempt IS NULL THEN errs END AS errors FROM a""",
    "answer_stats": f"""WITH {duck("answer_log")}
SELECT 'm' || clip_id % 3 AS model, count(*) AS attempts, max(attempt) AS max_attempt, count(*) FILTER (WHERE n_chars > 150 OR n_chars < 60) AS failures,
  {duck_six("avg(n_chars * 10)")} AS mean_ms, count(*) FILTER (WHERE n_chars > 150 OR n_chars < 60) AS reasons FROM answer_log GROUP BY 1""",
    "postprocess_metadata": f"""WITH {duck("delivery")}, {_TOKENS.format(src="delivery")}, {_CLEAN},
t AS (SELECT *, {_remove("text", list(_kw_r.filler_words))} AS t FROM delivery)
SELECT t.clip_id, {_at_word("t", 70)} AS title, {_at_sentence("t", 200)} AS description, lang || ' river valley' AS subject,
  coalesce(kw, '') AS keywords, CASE WHEN t.clip_id % 10 = 0 THEN 'landmark' END AS editorial_reason
FROM t LEFT JOIN kws ON t.clip_id = kws.clip_id""",
    "media_issues": f"""WITH {duck("delivery")} SELECT clip_id, replace(concat_ws('|', {_media(RULES.adobe["limits"])}), 'error: ', '') AS messages FROM delivery""",
    "clip_view": f"WITH {duck('delivery')} SELECT clip_id, filename, editorial FROM delivery",
    "clips_by_platform": f"WITH {duck('delivery')} SELECT clip_id, unnest(['adobe', 'shutterstock', 'pond5', 'envato']) AS platform FROM delivery",
    "category_check": f"""WITH {duck("delivery")}
SELECT clip_id, 'adobe' AS platform, CAST(adobe_category AS VARCHAR) AS category FROM delivery WHERE adobe_category NOT BETWEEN 1 AND 21
UNION ALL SELECT clip_id, 'shutterstock', 'Parks/Outdoor' FROM delivery WHERE sh_bad
UNION ALL SELECT clip_id, 'envato', 'Parks' FROM delivery WHERE envato_category = 'Parks'""",
    "report_totals": f"""WITH {duck("delivery")}
SELECT job_id, count(*) AS clips, {duck_six("sum(duration_sec)")} AS seconds, {duck_six("sum(size) / 1073741824e0")} AS gigabytes,
  count(*) FILTER (WHERE clip_id % 4 IN (2, 3)) AS low_confidence,
  count(*) FILTER (WHERE clip_id % 5 = 0 OR coalesce(decision, false)) AS editorial FROM delivery GROUP BY 1""",
}

_ADOBE = f"""{_TEXT}, {_csv_list("delivery", _CSV_CLEAN, 50)},
adobe AS (SELECT d.clip_id, d.job_id, filename || '|' || ({_at_word("t", 70)}) || '|' || coalesce(replace(kw, '{_US}', ', '), '') || '|' || adobe_category || '|' AS row,
  concat_ws('|', {_media(RULES.adobe["limits"])}, {_cut("length(t)", 70, "Title")}, {_count_issues(RULES.adobe["limits"], "len(keywords)")},
    CASE WHEN adobe_category NOT BETWEEN 1 AND 21 THEN 'error: Unknown Adobe category ' || adobe_category END,
    CASE WHEN editorial THEN '{_EDITORIAL_NOTE}' END) AS issues
  FROM t0 d LEFT JOIN csv ON d.clip_id = csv.clip_id)"""
_SHUTTER = f"""sh0 AS (SELECT *, regexp_replace(t, '[.\\s]+$', '') AS head FROM t0),
sh1 AS (SELECT *, CASE WHEN length(head || '. ' || t) <= 200 THEN head || '. ' || t ELSE head END AS txt FROM sh0),
shutter AS (SELECT d.clip_id, d.job_id, filename || '|' || ({_at_word("txt", 200)}) || '|' || coalesce(replace(kw, '{_US}', ','), '') || '|' || sh_ok || '|' || CASE WHEN editorial THEN 'Yes' ELSE 'No' END AS row,
  concat_ws('|', {_media(RULES.shutterstock["limits"])}, {_cut("length(txt)", 200, "Description")}, {_count_issues(RULES.shutterstock["limits"], "len(keywords)")},
    CASE WHEN sh_bad THEN 'error: Shutterstock categories must be 1–2 values from the official list' END) AS issues
  FROM sh1 d LEFT JOIN csv ON d.clip_id = csv.clip_id)"""
_POND = f"""{_csv_list("delivery", _collapse("regexp_replace(" + _sanitize("w") + ", '[,;]+', ' ', 'g')"), 50, "pk")},
p0 AS (SELECT *, {_PREFIX} || {_sanitize("text")} AS txt FROM delivery),
pond AS (SELECT d.clip_id, d.job_id, filename || '|' || ({_at_word("trim(txt)", 80)}) || '|' || ({_at_sentence("trim(txt)", 2000)}) || '|' || coalesce(replace(kw, '{_US}', ','), '') || '|' || city || '|Region and Co|' || country
    || '|' || CASE WHEN d.clip_id % 2 = 0 THEN 'DJI Air 3' ELSE '' END || '|no||Jane Doe 2024|79|149|' || CASE WHEN editorial THEN 'yes' ELSE 'no' END || '|' || {_DAY} AS row,
  concat_ws('|', {_media(RULES.pond5["limits"])}, {_cut("length(trim(txt))", 80, "Title")}, {_cut("length(trim(txt))", 2000, "Description")}, {_count_issues(RULES.pond5["limits"], "len(keywords)")},
    CASE WHEN day IS NULL THEN 'warning: Capture date unknown: the export date is used for datecreated' END) AS issues
  FROM p0 d LEFT JOIN pk ON d.clip_id = pk.clip_id)"""
_ENV = f"""{_envato("delivery")},
env AS (SELECT d.clip_id, d.job_id, filename || '|' || ({_at_word("t", 99)}) || '|' || t || '|' || coalesce(replace(kw, '{_US}', ','), '') || '|' || envato_category || '|$19|$39.50|No|'
    || CASE WHEN buildings THEN 'Yes' ELSE 'No' END || '|||Full Color|' || CASE d.clip_id % 3 WHEN 0 THEN 'Real Time' WHEN 1 THEN 'Slow Motion' ELSE 'Time Lapse' END
    || '|' || CASE WHEN d.clip_id % 2 = 0 THEN 'Aerial,Drone,Arc' ELSE 'Aerial,Drone' END || '|Wide Shot|Outdoors|||||||' AS row,
  concat_ws('|', {_media(RULES.envato["limits"])}, {_cut("length(t)", 99, "Title")},
    CASE WHEN coalesce(n, 0) < least(len(keywords), 50) THEN 'warning: Some keywords were dropped by the Envato keyword rules' END,
    CASE WHEN envato_category = 'Parks' THEN 'error: Unknown Envato category "Parks"' END) AS issues
  FROM t0 d LEFT JOIN ev ON d.clip_id = ev.clip_id)"""
_ALL_ROWS = f"{duck('delivery')}, {_ADOBE}, {_SHUTTER}, {_POND}, {_ENV}"

ORACLES |= {
    "adobe_rows": f"WITH {duck('delivery')}, {_ADOBE} SELECT clip_id, row, issues FROM adobe",
    "shutterstock_rows": f"WITH {duck('delivery')}, {_ADOBE}, {_SHUTTER} SELECT clip_id, row, issues FROM shutter",
    "pond5_rows": f"WITH {duck('delivery')}, {_POND} SELECT clip_id, row, issues FROM pond",
    "envato_rows": f"WITH {duck('delivery')}, {_TEXT}, {_ENV} SELECT clip_id, row, issues FROM env",
    "report_counts": f"""WITH {_ALL_ROWS},
a AS (SELECT job_id, 'adobe' AS platform, issues FROM adobe UNION ALL SELECT job_id, 'shutterstock', issues FROM shutter
  UNION ALL SELECT job_id, 'pond5', issues FROM pond UNION ALL SELECT job_id, 'envato', issues FROM env)
SELECT job_id, platform, count(*) FILTER (WHERE issues = '') AS ok,
  count(*) FILTER (WHERE issues <> '' AND NOT regexp_matches(issues, '(^|\\|)error: ')) AS warning,
  count(*) FILTER (WHERE regexp_matches(issues, '(^|\\|)error: ')) AS error FROM a GROUP BY 1, 2""",
}
