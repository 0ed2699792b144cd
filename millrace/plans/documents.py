"""Queries over documents, labels and pages: filters, duplicates, lines, exports and merges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions import vectors as V
from millrace.operators import chapters, chunking, export, html_markdown, judging, lines, ranking, spans, tables
from millrace.plans.registry import register, table

_BOILER = r"\b(licen[sc]e|copyright|creative commons|cc by-nd|cc-by|colophon|build-date|build-version|disclaimer|indemnif\w*|high risk activities|all rights reserved|table of contents|fihrist|lisans|standard terms)\b"


@register("boilerplate_flag", rf"SELECT doc_id, coalesce(regexp_matches(lower(text), '{_BOILER}'), false) AS boilerplate FROM documents")
def boilerplate_flag(spark, sf_dir):
    """FLT-04 over whole texts."""
    return table(spark, sf_dir, "documents").select("doc_id", T.is_boilerplate(F.col("text")).alias("boilerplate"))


@register(
    "boilerplate_article",
    """SELECT doc_id, regexp_matches(lower(source), 'colophon|table of contents|fihrist|disclaimer|revision history|document history')
       OR regexp_matches(lower(substr(coalesce(text, ''), 1, 400)), 'colophon|creative commons attribution|portions copyright') AS boilerplate FROM documents""",
)
def boilerplate_article(spark, sf_dir):
    """FLT-05: source as title."""
    return table(spark, sf_dir, "documents").select("doc_id", T.is_boilerplate_article(F.col("source"), F.col("text")).alias("boilerplate"))


@register(
    "sft_export",
    rf"""WITH kept AS (SELECT d.*, sha1(d.text) AS h FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
         WHERE coalesce(l.toxic, 0) = 0 AND length(d.text) >= 100 AND NOT regexp_matches(lower(d.text), '{_BOILER}')),
       firsts AS (SELECT h, arg_min(lang, doc_id) AS lang, arg_min(length(text), doc_id) AS n FROM kept GROUP BY h)
       SELECT lang, count(*) AS records, CAST(sum(n) AS BIGINT) AS chars FROM firsts GROUP BY lang""",
)
def sft_export(spark, sf_dir):
    """A clean instruction set: not excluded, long enough, no boilerplate, the first of equal texts; counted by language."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    kept = table(spark, sf_dir, "documents").join(labels, "doc_id", "left").where(F.coalesce("toxic", F.lit(0)) == 0)
    kept = kept.where((F.length("text") >= 100) & ~T.is_boilerplate(F.col("text")))
    firsts = kept.groupBy(F.sha1(F.col("text").cast("binary")).alias("h")).agg(F.min_by(F.struct("lang", F.length("text").alias("n")), "doc_id").alias("r"))
    return firsts.groupBy(F.col("r.lang").alias("lang")).agg(F.count("*").alias("records"), F.sum("r.n").cast("long").alias("chars"))


@register(
    "exact_dedup_first_seen",
    "SELECT min(doc_id) AS doc_id, sha1(text) AS sha1, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY sha1(text)",
)
def exact_dedup_first_seen(spark, sf_dir):
    """MH-02, SET-02 for texts: the first document of equal ones with the number of copies."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.groupBy(F.sha1(F.col("text").cast("binary")).alias("sha1")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "sha1", "copies")


@register(
    "duplicate_of",
    """WITH f AS (SELECT text AS t, min(doc_id) AS first FROM documents GROUP BY text)
       SELECT d.doc_id, CASE WHEN f.first <> d.doc_id THEN f.first END AS duplicate_of FROM documents d JOIN f ON f.t = d.text""",
)
def duplicate_of(spark, sf_dir):
    """WN-02: later copies name the first one."""
    found = tables.first_seen(table(spark, sf_dir, "documents").where("text IS NOT NULL"), F.col("text"), "doc_id")
    return found.select("doc_id", "duplicate_of")


@register(
    "record_union_dedup",
    """WITH u AS (SELECT 0 AS s, doc_id, lang, source, text FROM documents WHERE lang = 'en' UNION ALL SELECT 1, doc_id, lang, source, text FROM documents),
       r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, text ORDER BY s, doc_id) AS k FROM u)
       SELECT s AS source_no, doc_id AS line_no, lang, source, CAST(length(text) AS INTEGER) AS n FROM r WHERE k = 1""",
)
def record_union_dedup(spark, sf_dir):
    """SET-02, CP-08: records of two projects, of equal ones the first; one project's are a part of the other's."""
    docs = table(spark, sf_dir, "documents").select("lang", "source", "text", F.col("doc_id").alias("line_no"))
    found = tables.union_records([docs.where("lang = 'en'"), docs])
    return found.select("source_no", "line_no", "lang", "source", F.length("text").alias("n"))


@register("left_anti_pending", "SELECT d.doc_id, d.lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def left_anti_pending(spark, sf_dir):
    """JN-04, JN-10: documents that no label has been given to."""
    return tables.pending(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang")


@register("inner_enriched", "SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE coalesce(l.toxic, 0) = 0")
def inner_enriched(spark, sf_dir):
    """JN-01, FLT-06: labelled documents that aren't excluded."""
    labels = table(spark, sf_dir, "labels").where("coalesce(toxic, 0) = 0")
    return table(spark, sf_dir, "documents").join(labels, "doc_id").select("doc_id", "lang", "quality")


@register(
    "left_pending",
    """SELECT d.doc_id, d.source, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
       WHERE trim(coalesce(d.text, '')) <> '' AND coalesce(l.quality, 0) = 0""",
)
def left_pending(spark, sf_dir):
    """JN-03, FLT-22: documents with text that are unlabelled or of quality 0."""
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.where((F.trim(F.coalesce("text", F.lit(""))) != "") & (F.coalesce("quality", F.lit(0)) == 0)).select("doc_id", "source", "quality")


@register(
    "grounded_titles",
    """SELECT l.doc_id AS article_id, coalesce(nullif(d.source, ''), 'Article #' || l.doc_id) AS document_title FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id""",
)
def grounded_titles(spark, sf_dir):
    """JN-05: a title for every labelled span, by article, file name or number."""
    articles = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("").alias("title"), F.col("source").alias("filename"))
    return spans.with_titles(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("article_id")), articles)


@register(
    "fk_remap",
    """WITH m AS (SELECT doc_id AS old_id, row_number() OVER (ORDER BY doc_id) + 1000 AS new_id FROM documents WHERE lang = 'en')
       SELECT m.new_id AS doc_id, l.quality, l.toxic FROM labels l JOIN m ON m.old_id = l.doc_id""",
)
def fk_remap(spark, sf_dir):
    """JN-06: labels follow the English documents to their new ids; others are orphans."""
    placed = ranking.with_position(table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id"), "doc_id")
    id_map = placed.select(F.col("doc_id").alias("old_id"), (F.col("position") + 1001).alias("new_id"))
    return tables.remap_ids(table(spark, sf_dir, "labels"), "doc_id", id_map).select("doc_id", "quality", "toxic")


@register(
    "project_merge",
    """WITH u AS (SELECT 0 AS p, doc_id, lang FROM documents WHERE lang = 'de' UNION ALL SELECT 1, doc_id, lang FROM documents WHERE lang = 'fr')
       SELECT p AS project_no, doc_id AS old_id, row_number() OVER (ORDER BY p, doc_id) AS doc_id, lang FROM u""",
)
def project_merge(spark, sf_dir):
    """SET-01: two projects' rows with fresh ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return tables.merge_tables([docs.where("lang = 'de'"), docs.where("lang = 'fr'")], "doc_id").select("project_no", "old_id", "doc_id", "lang")


@register(
    "upsert_coalesce",
    """SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(n.quality, o.quality) AS quality, coalesce(o.toxic, n.toxic) AS toxic
       FROM labels o FULL OUTER JOIN (SELECT doc_id, CAST(n_chars % 2 AS INTEGER) AS quality, CAST(1 AS INTEGER) AS toxic FROM documents) n ON n.doc_id = o.doc_id""",
)
def upsert_coalesce(spark, sf_dir):
    """SNK-03: new qualities replace old ones, an old toxic mark stays."""
    new = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 2).cast("int").alias("quality"), F.lit(1).alias("toxic"))
    return tables.upsert(table(spark, sf_dir, "labels"), new, "doc_id", keep_old=("toxic",)).select("doc_id", "quality", "toxic")


@register(
    "manifest_diff",
    """WITH b AS (SELECT d.doc_id, d.n_chars + l.quality AS size FROM documents d JOIN labels l ON l.doc_id = d.doc_id)
       SELECT coalesce(b.doc_id, d.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'new' WHEN d.doc_id IS NULL THEN 'deleted'
         WHEN b.size = d.n_chars THEN 'unchanged' ELSE 'changed' END AS status FROM b FULL OUTER JOIN documents d ON d.doc_id = b.doc_id""",
)
def manifest_diff(spark, sf_dir):
    """JN-08, JN-09: what an incremental run must read again."""
    docs = table(spark, sf_dir, "documents")
    before = docs.join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", (F.col("n_chars") + F.col("quality")).alias("size"))
    return tables.manifest_diff(before, docs.select("doc_id", F.col("n_chars").alias("size")), "doc_id", "size")


@register(
    "coverage_by_reason",
    rf"""WITH r AS (SELECT lang, CASE WHEN text IS NULL THEN 'unreadable' WHEN regexp_matches(lower(text), '{_BOILER}') THEN 'boilerplate' WHEN length(text) < 100 THEN 'short' ELSE 'kept' END AS reason, n_chars FROM documents)
        SELECT reason, lang, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS chars FROM r GROUP BY GROUPING SETS ((reason), (lang), ())""",
)
def coverage_by_reason(spark, sf_dir):
    """AG-06: documents and characters by reason, by language and in all."""
    reason = F.when(F.col("text").isNull(), "unreadable").when(T.is_boilerplate(F.col("text")), "boilerplate").when(F.length("text") < 100, "short").otherwise("kept")
    rows = table(spark, sf_dir, "documents").select("lang", reason.alias("reason"), "n_chars")
    return rows.groupingSets([["reason"], ["lang"], []], "reason", "lang").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"))


@register("range_slice", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100 OFFSET 50")
def range_slice(spark, sf_dir):
    """FLT-01, FLT-02: the slice 50:150 of all documents in order."""
    return ranking.range_slice(table(spark, sf_dir, "documents").select("doc_id", "lang"), "50:150", "doc_id")


@register(
    "page_search",
    """SELECT doc_id, lang, source FROM documents WHERE text ILIKE '%the%' OR lang ILIKE '%the%' OR source ILIKE '%the%' ORDER BY doc_id LIMIT 20 OFFSET 20""",
)
def page_search(spark, sf_dir):
    """FLT-17, SL-02: the second page of rows of which any text column holds a word."""
    return ranking.page(tables.search_all_text(table(spark, sf_dir, "documents"), "the"), 2, 20, "doc_id").select("doc_id", "lang", "source")


@register("preview_truncate", "SELECT doc_id, CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || '...' ELSE text END AS text_preview FROM documents")
def preview_truncate(spark, sf_dir):
    """PRJ-04."""
    return table(spark, sf_dir, "documents").select("doc_id", T.preview(F.col("text")).alias("text_preview"))


@register(
    "shard_assign",
    """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position, count(*) OVER () AS n FROM documents)
       SELECT doc_id, position, CAST(floor(position / ceil(n / 8.0)) AS INTEGER) AS shard FROM r""",
)
def shard_assign(spark, sf_dir):
    """WN-13, WN-14: eight ranges of near equal counts."""
    return ranking.range_shards(table(spark, sf_dir, "documents").select("doc_id"), 8, "doc_id").select("doc_id", "position", "shard")


@register(
    "category_route",
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'explanation' WHEN 1 THEN 'completion' WHEN 2 THEN 'bug_fix' ELSE 'unit_test' END AS category, doc_id % 100 < 50 AS pragmatic FROM documents""",
)
def category_route(spark, sf_dir):
    """PRJ-11: a category for every unit by its id."""
    names = F.array(*map(F.lit, ("explanation", "completion", "bug_fix", "unit_test")))
    return table(spark, sf_dir, "documents").select("doc_id", F.element_at(names, F.pmod("doc_id", F.lit(4)).cast("int") + 1).alias("category"), (F.pmod("doc_id", F.lit(100)) < 50).alias("pragmatic"))


@register(
    "size_bucket",
    """SELECT source, count(*) AS n, CASE WHEN count(*) < 1000 THEN 'n<1K' WHEN count(*) < 10000 THEN '1K<n<10K' WHEN count(*) < 100000 THEN '10K<n<100K' WHEN count(*) < 1000000 THEN '100K<n<1M' ELSE 'n>1M' END AS bucket
       FROM documents GROUP BY source""",
)
def size_bucket(spark, sf_dir):
    """AG-11, AG-12: samples of each set and their order of magnitude."""
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).withColumn("bucket", T.size_bucket(F.col("n")))


@register(
    "status_breakdown",
    """SELECT CASE quality WHEN 1 THEN 'approved' ELSE 'rejected' END AS judge_status, count(*) AS n, round(avg(3.0 + 4.5 * quality), 2) AS score FROM labels WHERE quality IS NOT NULL GROUP BY 1""",
)
def status_breakdown(spark, sf_dir):
    """AG-02, AG-03."""
    score = F.lit(3.0).cast("double") + F.lit(4.5).cast("double") * F.col("quality")
    rows = table(spark, sf_dir, "labels").where("quality IS NOT NULL").select(judging.status_of(score).alias("judge_status"), score.alias("s"))
    return rows.groupBy("judge_status").agg(F.count("*").alias("n"), F.round(F.avg("s"), 2).alias("score"))


@register(
    "score_overall",
    """SELECT count(*) AS total, count(*) FILTER (quality = 1) AS approved, CAST(0 AS BIGINT) AS borderline, count(*) FILTER (coalesce(quality, 0) = 0) AS rejected FROM labels""",
)
def score_overall(spark, sf_dir):
    """AG-09, AG-10: one row of counters."""
    score = F.lit(3.0) + F.lit(4.5) * F.coalesce("quality", F.lit(0))
    return judging.counters(table(spark, sf_dir, "labels").select(judging.status_of(score).alias("judge_status")))


@register(
    "judge_fallback",
    """SELECT doc_id, CASE WHEN length(trim(coalesce(text, ''), E' \\t\\n\\r')) < 15 THEN CAST(3.0 AS DOUBLE) ELSE CAST(7.5 AS DOUBLE) END AS judge_score,
       CASE WHEN length(trim(coalesce(text, ''), E' \\t\\n\\r')) < 15 THEN 'rejected' ELSE 'approved' END AS judge_status FROM documents""",
)
def judge_fallback(spark, sf_dir):
    """UD-08: the offline verdict on every text."""
    pairs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("chosen"), F.lit("").alias("rejected"))
    found = judging.judged(pairs)
    return found.select("doc_id", F.col("judge_score").cast("double").alias("judge_score"), "judge_status")


@register(
    "golden_by_score",
    """SELECT d.doc_id, CAST(coalesce(3.0 + 4.5 * l.quality, 8.0) AS DOUBLE) AS score FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
       WHERE coalesce(3.0 + 4.5 * l.quality, 8.0) >= 7.5 AND d.text <> '' AND d.source <> ''""",
)
def golden_by_score(spark, sf_dir):
    """CP-12: answers judged 7.5 or better; unjudged ones count as 8."""
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.lit(3.0) + F.lit(4.5) * F.col("quality")).alias("judge_score"))
    rows = table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select("judge_score", F.concat_ws("#", F.nullif("source", F.lit("")), F.col("doc_id").cast("string")).alias("prompt_sft"), F.col("text").alias("response_sft"), "source")
    found = judging.golden(rows.where("source <> ''"))
    return found.select(F.substring_index("instruction", "#", -1).cast("long").alias("doc_id"), F.col("score").cast("double").alias("score"))


@register("fingerprints_sha", "SELECT doc_id, sha1(text) AS sha1, substr(sha256(text), 1, 16) AS sha256_16 FROM documents WHERE text IS NOT NULL")
def fingerprints_sha(spark, sf_dir):
    """MH-02, MH-03."""
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.sha1(F.col("text").cast("binary")).alias("sha1"), F.substring(F.sha2(F.col("text"), 256), 1, 16).alias("sha256_16"))


@register(
    "word_jaccard",
    """WITH w AS (SELECT doc_id, list_distinct(list_filter(string_split_regex(lower(text), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')) AS a,
         list_distinct(list_filter(string_split_regex(lower(substr(text, 1, 400)), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')) AS b FROM documents WHERE text IS NOT NULL)
       SELECT doc_id, round(CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE) END, 6) AS jaccard FROM w""",
)
def word_jaccard(spark, sf_dir):
    """AG-20: how alike a text's words are to those of its preview."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.round(T.word_jaccard(F.col("text"), F.substring("text", 1, 400)), 6).alias("jaccard"))


_LINES = "lines AS (SELECT doc_id, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)"
_ROW = "(NOT starts_with(trim(line), '#') AND contains(line, '|') AND NOT ((starts_with(trim(line), '- ') OR starts_with(trim(line), '* ') OR starts_with(trim(line), '> ')) AND NOT (starts_with(trim(line), '|') AND ends_with(trim(line), '|'))))"


@register(
    "line_repeat_suppress",
    f"""WITH {_LINES}, said AS (SELECT *, trim(line) AS s, {_ROW} AS tab FROM lines WHERE trim(line) <> ''),
       runs AS (SELECT *, sum(CASE WHEN f THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM
         (SELECT *, coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY line_no) <> s OR tab, true) AS f FROM said)),
       k AS (SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id, run ORDER BY line_no) AS n FROM runs)
       SELECT doc_id, line_no, CASE WHEN n <= 2 THEN 'keep' WHEN n = 3 THEN 'mark' ELSE 'drop' END AS action FROM k
       UNION ALL SELECT doc_id, line_no, 'keep' FROM lines WHERE trim(line) = ''""",
)
def line_repeat_suppress(spark, sf_dir):
    """WN-03."""
    rows = lines.lines_of(table(spark, sf_dir, "documents").where("text IS NOT NULL"), "doc_id")
    return lines.marked_runs(rows, "doc_id").select("doc_id", F.col("line_no").cast("long").alias("line_no"), "action")


@register(
    "line_repeat_cap",
    f"""WITH {_LINES}, c AS (SELECT doc_id, line_no, length(trim(line)) > 5 AND NOT {_ROW} AS tracked, count(*) OVER (PARTITION BY doc_id, trim(line)) AS n,
         row_number() OVER (PARTITION BY doc_id, trim(line) ORDER BY line_no) AS k FROM lines)
       SELECT doc_id, line_no, CASE WHEN NOT tracked OR n <= 4 OR k <= 3 THEN 'keep' WHEN k = 4 THEN 'mark' ELSE 'drop' END AS action FROM c""",
)
def line_repeat_cap(spark, sf_dir):
    """WN-04."""
    rows = lines.lines_of(table(spark, sf_dir, "documents").where("text IS NOT NULL"), "doc_id")
    return lines.capped_repeats(rows, "doc_id").select("doc_id", F.col("line_no").cast("long").alias("line_no"), "action")


@register("repetition_filter")
def repetition_filter(spark, sf_dir):
    """STR-08: texts without repeated lines. Compared with a plain loop in the tests."""
    return lines.without_repeats(table(spark, sf_dir, "documents"), "doc_id")


@register(
    "prefix_offsets",
    f"""WITH {_LINES} SELECT doc_id, line_no, CAST(coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset FROM lines""",
)
def prefix_offsets(spark, sf_dir):
    """WN-12."""
    rows = lines.lines_of(table(spark, sf_dir, "documents").where("text IS NOT NULL"), "doc_id")
    return lines.line_offsets(rows, "doc_id").select("doc_id", F.col("line_no").cast("long").alias("line_no"), "byte_offset")


@register(
    "toc_lines",
    rf"""WITH {_LINES} SELECT doc_id, count(*) FILTER (regexp_matches(trim(replace(line, chr(160), ' ')), '(?:\.\s*){{3,}}\d+$|(?:\.\s*){{4,}}|^(?:\.\s*){{3,}}$')) AS toc, count(*) AS n FROM lines GROUP BY doc_id""",
)
def toc_lines(spark, sf_dir):
    """FLT-12: table-of-contents lines of each document."""
    rows = lines.lines_of(table(spark, sf_dir, "documents").where("text IS NOT NULL"), "doc_id")
    return rows.groupBy("doc_id").agg(F.count_if(T.is_toc_line(F.col("line"))).alias("toc"), F.count("*").alias("n"))


@register("token_estimates", "SELECT doc_id, CAST(greatest(1, length(text) // 4) AS INTEGER) AS by_chars FROM documents WHERE text IS NOT NULL")
def token_estimates(spark, sf_dir):
    """STR-12."""
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", T.token_estimate(F.col("text")).alias("by_chars"))


@register("summary_usable", r"SELECT doc_id, length(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) > 20 AS usable FROM documents")
def summary_usable(spark, sf_dir):
    """FLT-29."""
    return table(spark, sf_dir, "documents").select("doc_id", T.summary_usable(F.col("text")).alias("usable"))


@register("turkish_words", r"SELECT doc_id, coalesce(regexp_matches(lower(text), '(^|[^\pL\pN_])(nedir|nelerdir|nasıl|veya|ile|bir|için|bu|ne|ve|de|da)($|[^\pL\pN_])'), false) AS turkish FROM documents")
def turkish_words(spark, sf_dir):
    """FLT-35."""
    return table(spark, sf_dir, "documents").select("doc_id", T.is_turkish(F.col("text")).alias("turkish"))


@register("word_filter", "SELECT doc_id FROM documents WHERE contains(lower(text), 'copyright') OR contains(lower(text), 'license')")
def word_filter(spark, sf_dir):
    """FLT-19: any longer word of a question."""
    return table(spark, sf_dir, "documents").where(tables.any_word(F.col("text"), "the copyright or license")).select("doc_id")


@register("chunk_count")
def chunk_count(spark, sf_dir):
    """UD-12, WN-01: chunks of all documents. Compared with invariants and fixed cases in the tests."""
    return chunking.chunk_documents(table(spark, sf_dir, "documents"), "doc_id").groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("token_estimate").alias("tokens"))


@register("html_markdown")
def html_to_markdown(spark, sf_dir):
    """STR-01, STR-02, SRC-11: Markdown of all pages."""
    return table(spark, sf_dir, "pages").select("page_id", html_markdown.wiki_markdown(F.col("html"), F.col("url")).alias("markdown"))


@register("entity_spans")
def entity_spans(spark, sf_dir):
    """STR-17: technical entities of all documents with their positions."""
    return spans.entities(table(spark, sf_dir, "documents"), "doc_id")


@register(
    "topk_cosine",
    """WITH q AS (SELECT label, min(vec_id) AS query_id FROM embeddings GROUP BY label), s AS (
         SELECT q.query_id, e.vec_id, list_cosine_similarity(CAST(p.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score
         FROM q JOIN embeddings p ON p.vec_id = q.query_id JOIN embeddings e ON e.vec_id <> q.query_id),
       r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s)
       SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 5""",
)
def topk_cosine(spark, sf_dir):
    """JN-13, SL-07: the five nearest points of one query point a label."""
    from millrace.operators import vector_search

    points = table(spark, sf_dir, "embeddings")
    firsts = points.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector"), F.min("vec_id").alias("query_id"))
    found = vector_search.nearest(points.select("vec_id", F.col("embedding").alias("vector")), firsts.select("query_id", "vector"), 5, point="vec_id", leave_out_own=True)
    return found.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@register(
    "cosine_threshold_strict",
    """WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings ORDER BY vec_id LIMIT 1)
       SELECT vec_id FROM embeddings, q WHERE round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), v), 9) > 0.40""",
)
def cosine_threshold_strict(spark, sf_dir):
    """FLT-20, MH-01: points strictly above a score."""
    points = table(spark, sf_dir, "embeddings")
    query = points.orderBy("vec_id").limit(1).select(F.col("embedding").alias("q"))
    return points.join(F.broadcast(query)).where(F.round(V.cosine(F.col("embedding"), F.col("q")), 9) > 0.40).select("vec_id")


@register("dpo_records_valid")
def dpo_records_valid(spark, sf_dir):
    """FLT-26: texts paired with their previews as preference records, with their quality status."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("prompt"), F.col("text").alias("chosen"), F.substring("text", 1, 400).alias("rejected"))
    found = docs.where(export.valid_record(docs)).withColumn("status", judging.preference_status(F.col("prompt"), F.col("chosen"), F.col("rejected")))
    return found.groupBy("status").agg(F.count("*").alias("n"))


# Books are customers, a page an order: a third has an outline, a third pages with headings, a third neither.
_PAGES = "p AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS page, o_orderkey AS k, o_orderpriority AS t FROM orders)"


@register(
    "book_chapters",
    f"""WITH RECURSIVE {_PAGES},
n AS (SELECT doc_id, page AS pos, t AS title, k % 3 AS depth, CASE WHEN k % 7 <> 0 THEN page // 2 END AS page FROM p WHERE doc_id % 3 = 0),
u AS (SELECT n.*, (SELECT max(m.pos) FROM n m WHERE m.doc_id = n.doc_id AND m.pos < n.pos AND m.depth < n.depth) AS parent FROM n),
w AS (SELECT doc_id, pos, CASE WHEN page IS NULL THEN '' ELSE title END AS told FROM u WHERE parent IS NULL
  UNION ALL SELECT u.doc_id, u.pos, CASE WHEN u.page IS NULL THEN told WHEN told = '' THEN u.title ELSE told || ' - ' || u.title END FROM u JOIN w ON u.doc_id = w.doc_id AND u.parent = w.pos),
b AS (SELECT doc_id, max(page) + 1 AS n_pages FROM p GROUP BY doc_id),
f AS (SELECT u.doc_id, u.page, told, depth FROM u JOIN w USING (doc_id, pos) WHERE page IS NOT NULL QUALIFY row_number() OVER (PARTITION BY u.doc_id, u.page ORDER BY pos) = 1),
a AS (SELECT doc_id, told AS title, page AS start, 'outline' AS found_by FROM (SELECT *, bool_or(depth <= 1) OVER (PARTITION BY doc_id) AS any_shallow FROM f) WHERE depth <= 1 OR NOT any_shallow
  UNION ALL SELECT doc_id, 'Chapter ' || k || ' xyz', page, 'headings' FROM p WHERE doc_id % 3 = 1 AND k % 2 = 0),
c AS (SELECT a.doc_id, title, start, coalesce(lead(start) OVER (PARTITION BY a.doc_id ORDER BY start), n_pages) - 1 AS stop, found_by FROM a JOIN b USING (doc_id))
SELECT doc_id, title, start, stop, found_by FROM c
UNION ALL SELECT doc_id, 'Section starting page ' || (start + 1), start, least(start + 15, n_pages) - 1, 'slices' FROM (SELECT *, unnest(range(0, n_pages, 15)) AS start FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a))""",
)
def book_chapters(spark, sf_dir):
    """SRC-27, STR-23, PRJ-10, WN-16: chapters of books down to the second level of their outline, else by headings, else by slices."""
    page = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long") - 1
    text = F.when((F.col("o_custkey") % 3 == 1) & (F.col("o_orderkey") % 2 == 0), F.concat(F.lit("\n Chapter "), "o_orderkey", F.lit(" xyz\nbody"))).otherwise(F.col("o_orderpriority"))
    pages = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), page.alias("page"), text.alias("text"), "o_orderkey", "o_orderpriority")
    known = F.when(F.col("o_orderkey") % 7 != 0, F.floor(F.col("page") / 2))
    nodes = pages.where("doc_id % 3 = 0").select("doc_id", F.col("page").alias("pos"), F.col("o_orderpriority").alias("title"), (F.col("o_orderkey") % 3).alias("depth"), known.alias("page"))
    return chapters.book_segments(pages.select("doc_id", "page", "text"), nodes, max_depth=1)
