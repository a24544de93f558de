"""Queries over pages, segments and token usage, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import clean_text as clean
from tessella.operators import cascade, cost, extract, gate, kg, nested, segment
from tessella.plans.graph_queries import _RET, _VALID
from tessella.plans.problems import READ, _items
from tessella.session import load, stage, union_all
from tessella.sources import reports


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return segment.documents(load(spark, d, "documents"), "doc_id", "text")


def _outline(spark: SparkSession, d: str) -> DataFrame:
    return segment.outline(_docs(spark, d))


def _calls(spark: SparkSession, d: str) -> DataFrame:
    return cost.priced(load(spark, d, "llm_usage"), load(spark, d, "llm_pricing"))


def _wasted(spark: SparkSession, d: str) -> DataFrame:
    v = cascade.validate(kg.entities(load(spark, d, "kg_entities")), kg.relationships(load(spark, d, "kg_relationships")))
    return cost.wasted(cost.document_summary(_calls(spark, d).where(GUIDED)), cascade.retention(v), gate.accuracy(v.ids))


def _wasted_baseline(spark: SparkSession, d: str) -> DataFrame:
    """The same for the graphs of the baseline experiments among the payloads, judged by the same gate."""
    graphs = nested.payload_graphs(load(spark, d, "kg_payloads"), baseline=True)
    ents, rels = extract.graph_rows(graphs)
    v = cascade.validate(ents, rels)
    return cost.wasted(cost.document_summary(_calls(spark, d).where(f"not ({GUIDED})")), cascade.retention(v), gate.accuracy(v.ids))


# The calls table does not say which method a call belongs to: here the guided one is the default model.
GUIDED = "coalesce(model, '') = 'quill-large-2'"


def clean_text(spark, d):
    return load(spark, d, "documents").select("doc_id", clean(F.col("text")).alias("cleaned"))


def title_extract(spark, d):
    return segment.titles(_docs(spark, d))


def toc_page(spark, d):
    return segment.with_toc_page(_docs(spark, d)).select("doc", "toc_page")


def toc_entries(spark, d):
    """The entries of each document's page of contents."""
    t = segment.with_toc_page(_docs(spark, d)).select("doc", F.posexplode(segment.toc_entries(F.coalesce(F.get("pages", F.col("toc_page")), F.lit("")))).alias("toc_idx", "e"))
    return t.select("doc", "toc_idx", "e.*")


def embedded_toc(spark, d):
    """The entries of a contents list inside a text, here the list that the sections of each run would print."""
    m = load(spark, d, "doc_metadata").where("sections is not null")
    line = lambda s: F.concat(F.upper(F.coalesce(s["title"], F.lit(""))), F.lit(" ... "), F.regexp_extract(F.coalesce(s["pages"], F.lit("")), r"^(\d*)", 1))
    one = m.groupBy("document_name", "run_id").agg(F.min("sections").alias("s"))
    text = F.concat(F.lit("Notice\nTable of Contents\n"), F.array_join(F.transform("s", line), "\n"))
    t = one.select(F.concat_ws("/", "document_name", "run_id").alias("doc"), F.posexplode(segment.embedded_entries(text)).alias("toc_idx", "e"))
    return t.select("doc", "toc_idx", "e.*")


def first_content_page(spark, d):
    return segment.with_first_content(segment.with_toc_page(_docs(spark, d))).select("doc", "first_content", "total_pages")


def fixed_chunking(spark, d):
    t = segment.with_first_content(segment.with_toc_page(_docs(spark, d)))
    t = t.select("doc", F.posexplode(segment.fixed_chunks(F.col("first_content"), F.col("total_pages"))).alias("toc_idx", "e"))
    return t.select("doc", "toc_idx", "e.*")


def metadata_ranges(spark, d):
    """Page ranges of the sections listed in the metadata, first metadata row of each run."""
    m = load(spark, d, "doc_metadata").where("total_pages is not null")
    one = m.groupBy(F.col("document_name").alias("doc"), "run_id").agg(F.max("total_pages").alias("total_pages"), F.min("sections").alias("sections"))
    one = one.withColumn("doc", F.concat_ws("/", "doc", "run_id"))
    number = lambda s: F.coalesce(F.regexp_extract(s["pages"], r"^(\d+)", 1).try_cast("long"), F.lit(0).cast("long"))
    toc = one.withColumn("entries", F.transform("sections", lambda s: F.struct(s["number"].alias("number"), s["title"].alias("title"), number(s).alias("page"))))
    return segment.section_ranges(toc.withColumn("first_content", F.lit(1)))


def section_ranges(spark, d):
    return segment.section_ranges(_outline(spark, d))


def page_section_join(spark, d):
    return segment.section_pages(_outline(spark, d)).select("doc", "toc_idx", "page_num", F.length("text").alias("n_chars"))


def section_content(spark, d):
    return segment.sections(_outline(spark, d)).select("doc", "segment_id", "number", "title", "page_start", "page_end", "content")


def section_stats(spark, d):
    return segment.section_stats(segment.sections(_outline(spark, d)))


def segment_words(spark, d):
    from tessella.functions.text import word_count

    return load(spark, d, "doc_segments").select("seg_uid", word_count(F.col("content")).alias("word_count"), F.coalesce(F.size("tables"), F.lit(0)).alias("table_count"))


def table_merge(spark, d):
    return segment.merged_tables(segment.run_tables(load(spark, d, "doc_segments")), ["doc_id", "run_id"])


def table_headers(spark, d):
    return segment.header_pairs(segment.run_tables(load(spark, d, "doc_segments")))


def extraction_prompts(spark, d):
    return extract.prompts(load(spark, d, "doc_segments"))


def answer_kinds(spark, d):
    return extract.answer_kind(load(spark, d, "kg_payloads")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def experiment_counts(spark, d):
    return extract.experiment_counts(load(spark, d, "kg_payloads"))


def token_cost(spark, d):
    return _calls(spark, d).select("usage_id", "input_cost", "output_cost", "total_cost", "page_span")


def cost_summary(spark, d):
    return cost.document_summary(_calls(spark, d))


def cost_batch(spark, d):
    return cost.batch_summary(cost.document_summary(_calls(spark, d)))


def cost_ranking(spark, d):
    return cost.ranking(cost.document_summary(_calls(spark, d)))


def cost_basis(spark, d):
    return cost.cumulative_basis(_calls(spark, d))


def token_summary(spark, d):
    return cost.token_summary(_calls(spark, d))


def uncalled_segments(spark, d):
    return cost.uncalled_segments(load(spark, d, "doc_segments"), load(spark, d, "llm_usage"))


def wasted_cost(spark, d):
    return _wasted(spark, d)


def method_summary(spark, d):
    return cost.method_summary(_wasted(spark, d))


def cost_breakdown(spark, d):
    return reports.cost_breakdown(cost.method_summary(_wasted(spark, d)))


def cost_efficiency(spark, d):
    return reports.cost_efficiency(cost.method_summary(_wasted(spark, d)))


def document_costs(spark, d):
    return reports.document_costs(_wasted(spark, d))


def comparison_tables(spark, d):
    """The four tables of two methods, one below the other as (table, row)."""
    tables = reports.comparison_tables(cost.method_summary(_wasted_baseline(spark, d)), cost.method_summary(_wasted(spark, d)))
    return union_all([t.select(F.lit(name).alias("name"), F.array_join(F.array(*[F.col(c).cast("string") for c in t.columns]), ",").alias("row")) for name, t in tables.items()])


def baseline_cost(spark, d):
    return _wasted_baseline(spark, d)


def _methods(spark: SparkSession, d: str) -> DataFrame:
    return stage(cost.compare_methods(cost.method_summary(_wasted_baseline(spark, d)), cost.method_summary(_wasted(spark, d))), "methods")


def method_comparison(spark, d):
    return _methods(spark, d)


def method_savings(spark, d):
    return cost.savings(_methods(spark, d))


def method_insights(spark, d):
    return cost.insights(_methods(spark, d))


_NAMES = """clean_text title_extract toc_page toc_entries embedded_toc first_content_page fixed_chunking metadata_ranges section_ranges page_section_join section_content
section_stats segment_words table_merge table_headers extraction_prompts answer_kinds experiment_counts token_cost cost_summary cost_batch cost_basis
cost_ranking token_summary uncalled_segments wasted_cost cost_breakdown cost_efficiency document_costs comparison_tables baseline_cost method_summary method_savings method_comparison method_insights"""
QUERIES = {n: globals()[n] for n in _NAMES.split()}

_WS = r"[\t-\r \p{Z}]"
_PAGES = """pg AS (SELECT doc_id AS doc, generate_subscripts(p, 1) - 1 AS page_num, unnest(p) AS text FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS p FROM documents WHERE text IS NOT NULL))"""


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


_CLEAN = _trim("regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\n\\n+', E'\\n\\n', 'g'), ' +', ' ', 'g'), '\\n[0-9]+\\n', E'\\n', 'g'), 'Page [0-9]+', '', 'g')")
_LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {_trim('x')}), lambda x: x <> '')"
_TOCP = f"""{_PAGES},
tocp AS (SELECT doc, coalesce(min(page_num) FILTER (page_num < 10 AND (contains(lower(text), 'contents') OR contains(lower(text), 'introduction') OR contains(lower(text), 'overview')) AND regexp_matches(text, '\\p{{Nd}}+\\.?{_WS}+[A-Z]')), 1)::INTEGER AS toc_page FROM pg GROUP BY doc)"""
_FIRST = f"""{_TOCP},
fst AS (SELECT pg.doc, coalesce(min(page_num) FILTER (page_num BETWEEN 1 AND 9 AND NOT contains(lower(text), 'contents') AND len(list_filter({_LINES}, lambda x: length(x) > 10)) >= 5), any_value(toc_page) + 1)::INTEGER AS first_content,
  (max(page_num) + 1)::INTEGER AS total_pages FROM pg JOIN tocp USING (doc) GROUP BY pg.doc)"""
_CHUNK = """chunk AS (SELECT doc, i::INTEGER AS toc_idx, (i + 1)::VARCHAR AS number, 'Section ' || (i + 1) AS title, (first_content + 10 * i)::BIGINT AS page
  FROM (SELECT doc, first_content, total_pages, unnest(range((total_pages - first_content + 9) // 10)) AS i FROM fst WHERE first_content < total_pages))"""
_USAGE = """calls AS (SELECT u.*, u.input_tokens / 1e6::DOUBLE * coalesce(p.input_usd, d.input_usd) AS input_cost, u.output_tokens / 1e6::DOUBLE * coalesce(p.output_usd, d.output_usd) AS output_cost
  FROM llm_usage u LEFT JOIN llm_pricing p USING (model) LEFT JOIN (SELECT * FROM llm_pricing WHERE model = 'quill-large-2') d ON true)"""
_COSTD = f"""{_USAGE}, perdoc AS (SELECT document_name, count(*) AS n_calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, (sum(input_tokens) + sum(output_tokens))::BIGINT AS total_tokens,
  round(sum(input_cost), 6) AS input_cost, round(sum(output_cost), 6) AS output_cost, round(sum(input_cost + output_cost), 6) AS total_cost,
  array_to_string(list_sort(list_distinct(list(model) FILTER (model IS NOT NULL))), ',') AS models, round(avg(input_cost + output_cost), 6) AS avg_cost FROM calls GROUP BY document_name)"""


def _waste(name: str, calls: str, views: str) -> str:
    """Views for the wasted cost of one method: its calls and the entities and relationships it found."""
    return f"""{name}_p AS (SELECT document_name, round(sum(input_cost + output_cost), 6) AS total_cost FROM calls WHERE {calls} GROUP BY document_name),
{name} AS (SELECT p.document_name, p.total_cost AS extraction_cost, coalesce(c.c, 0)::DOUBLE AS validation_cost, coalesce(r.entities_before, 0)::BIGINT AS entities_before, coalesce(r.entities_after, 0)::BIGINT AS entities_after,
  CASE WHEN coalesce(r.entities_before, 0) = 0 THEN 0.0::DOUBLE ELSE round((r.entities_before - r.entities_after)::DOUBLE / r.entities_before * p.total_cost, 6) END AS wasted_cost
  FROM {name}_p p LEFT JOIN (SELECT * FROM {views}ret WHERE entities_after > 0) r ON r.doc_id = p.document_name
  LEFT JOIN (SELECT doc_id, round(count(*) FILTER (called) * 0.0001::DOUBLE, 4) AS c FROM {views}gate GROUP BY doc_id) c ON c.doc_id = r.doc_id)"""


_GUIDED = "coalesce(model, '') = 'quill-large-2'"
_WASTED = f"{_VALID}, {_RET}, {_USAGE}, {_waste('w', _GUIDED, '')}"
# the same views over the graphs of the baseline experiments
_BASE = f"""{READ}, be AS (SELECT payload_id, doc_id, (generate_subscripts(l, 1) - 1) AS pos, unnest(l) AS v FROM (SELECT payload_id, doc_id, {_items("json_extract(g, '$.entities')")} AS l FROM gr WHERE baseline)),
bent AS (SELECT payload_id * 1000000 + pos AS rec_id, doc_id, v ->> '$.id' AS id, v ->> '$.type' AS type, v ->> '$.label' AS label FROM be WHERE json_type(v) = 'OBJECT'),
bgate AS (SELECT *, NOT known OR coalesce(wrong, false) AS mismatch, known AND label IS NOT NULL AS called FROM (SELECT *, coalesce(type, 'unknown') IN ('Industry', 'ReportingFramework', 'Category', 'Metric', 'Model') AS known, (length(label) + length(coalesce(id, ''))) % 7 = 3 AS wrong FROM bent)),
bids AS (SELECT doc_id, id, count(*) AS n, bool_or(mismatch AND coalesce(id, '') <> '') AS bad FROM bgate GROUP BY ALL),
bret AS (SELECT doc_id, sum(n) AS entities_before, count(*) FILTER (NOT bad AND n = 1) AS entities_after FROM bids GROUP BY doc_id)"""
_BASE_COST = f"{_BASE}, {_USAGE}, {_waste('bw', f'NOT ({_GUIDED})', 'b')}"


def _method(src: str) -> str:
    return f"""SELECT round(e, 4) AS extraction_cost, round(v, 4) AS validation_cost, round(wc, 4) AS wasted_cost, n AS extracted, k AS validated, round(CASE WHEN n = 0 THEN 0 ELSE k::DOUBLE / n * 100 END, 2) AS retention,
  round(CASE WHEN n = 0 THEN 0 ELSE e / n END, 6) AS cost_per_extracted, round(CASE WHEN k = 0 THEN 0 ELSE (e - wc + v) / k END, 6) AS cost_per_validated, round(CASE WHEN k = 0 THEN 0 ELSE (e + v) / k END, 6) AS total_per_validated,
  round(e + v, 4) AS total_cost, round(e - wc + v, 4) AS effective_cost, round(CASE WHEN e + v = 0 THEN 0 ELSE wc / (e + v) * 100 END, 2) AS wasted_percent
  FROM (SELECT *, CASE WHEN n = 0 THEN 0 ELSE (n - k)::DOUBLE / n * e END AS wc FROM (SELECT sum(extraction_cost) AS e, sum(validation_cost) AS v, sum(entities_before)::BIGINT AS n, sum(entities_after)::BIGINT AS k FROM {src}))"""


_COMPARE = f"""{_WASTED}, {_BASE}, {_waste('bw', f'NOT ({_GUIDED})', 'b')},
m1 AS ({_method("bw")}), m2 AS ({_method("w")}),
cmp AS (SELECT *, round(guided - baseline, 6) AS difference FROM ({
    " UNION ALL ".join(f"SELECT '{m}' AS metric, (SELECT {m} FROM m1)::DOUBLE AS baseline, (SELECT {m} FROM m2)::DOUBLE AS guided" for m in ("extraction_cost", "validation_cost", "total_cost", "wasted_cost", "extracted", "validated", "retention", "total_per_validated"))}))"""


_S = r"\t-\r \p{Z}"  # white space inside a class
_TOC_RE = [
    rf"(\p{{Nd}}+\.?\p{{Nd}}*)[{_S}]+([A-Z][^.\n]{{5,50}})[.{_S}]+(\p{{Nd}}+)",
    rf"(Appendix[{_S}]+[A-Z])[{_S}]*[-:]?[{_S}]*([^.\n]{{5,50}})[.{_S}]+(\p{{Nd}}+)",
    rf"([A-Z]\.\p{{Nd}}+)[{_S}]+([A-Z][^.\n]{{5,50}})[.{_S}]+(\p{{Nd}}+)",
]
_IN_RE = [
    rf"([A-Z][A-Za-z{_S}&,\-]+?)[.{_S}]*(\p{{Nd}}+)$", rf"([A-Z][A-Za-z{_S}&,\-()]+?)[.{_S}]*(\p{{Nd}}+)$", rf"([A-Z][A-Za-z{_S}&,\-()]+?)[{_S}]*[.{_S}]*(\p{{Nd}}+)$",
    rf"^([A-Z][A-Z{_S}&,\-()]+?)[{_S}]+(\p{{Nd}}+)$", rf"^([A-Z][A-Z{_S}&,\-()]{{4,}})()$",
]


def _part(i: int) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(line, '{p}', {i}), '')" for p in _TOC_RE) + ")"


def _inner(i: int) -> str:
    return "CASE " + " ".join(f"WHEN length({_trim(f"regexp_extract(line, '{p}', 1)")}) > 3 THEN regexp_extract(line, '{p}', {i})" for p in _IN_RE) + " END"


_HEAD = "coalesce(" + ", ".join(f"nullif(instr(lower(text), '{h}'), 0)" for h in ("table of contents", "contents", "table of content", "content", "index")) + ")"
_LAST = 9223372036854775807
_RANGES = f"""{_FIRST}, {_CHUNK},
tl AS (SELECT doc, generate_subscripts(l, 1) AS line_no, unnest(l) AS line FROM (SELECT pg.doc, list_transform(string_split(text, chr(10)), lambda x: {_trim("x")}) AS l FROM pg JOIN tocp ON tocp.doc = pg.doc AND page_num = toc_page)),
toc AS (SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY line_no) - 1)::INTEGER AS toc_idx, {_trim("number")} AS number, {_trim("title")} AS title, coalesce(try_cast(page AS BIGINT), {_LAST}) AS page
  FROM (SELECT doc, line_no, {_part(1)} AS number, {_part(2)} AS title, {_part(3)} AS page FROM tl) WHERE page IS NOT NULL),
el AS (SELECT doc, page_num, generate_subscripts(l, 1) AS line_no, unnest(l) AS line FROM (SELECT doc, page_num, list_transform(string_split(substring(text, {_HEAD}), chr(10))[1:20], lambda x: {_trim("x")}) AS l FROM pg WHERE contains(lower(text), 'content'))),
en AS (SELECT doc, page_num, line_no, {_inner(1)} AS title, {_inner(2)} AS page
  FROM el WHERE length(line) >= 5 AND NOT regexp_matches(lower(line), 'table of contents|contents|table of content|page|sustainability accounting standard|©|ifrs')),
ek AS (SELECT doc, page_num, k, regexp_replace({_trim("title")}, '{_WS}+', ' ', 'g') AS title, CASE WHEN page = '' THEN k + 1 ELSE coalesce(try_cast(page AS BIGINT), {_LAST}) END AS page
  FROM (SELECT *, row_number() OVER (PARTITION BY doc, page_num ORDER BY line_no) AS k FROM en WHERE title IS NOT NULL)),
ef AS (SELECT * FROM ek WHERE page_num < 5 QUALIFY page_num = min(page_num) OVER (PARTITION BY doc)),
cand AS (SELECT doc, toc_idx, number, title, page, 0 AS priority FROM toc UNION ALL SELECT doc, (k - 1)::INTEGER, k::VARCHAR, title, page, 1 FROM ef UNION ALL SELECT doc, toc_idx, number, title, page, 2 FROM chunk),
best AS (SELECT * FROM cand QUALIFY priority = min(priority) OVER (PARTITION BY doc)),
rg AS (SELECT * FROM (SELECT b.doc, toc_idx, number, title, greatest(page, first_content)::BIGINT AS page_start, coalesce(lead(page) OVER (PARTITION BY b.doc ORDER BY toc_idx) - 1, total_pages - 1)::BIGINT AS page_end FROM best b JOIN fst ON fst.doc = b.doc) WHERE page_start <= page_end)"""
_CONTENT = f"""{_RANGES},
sc AS (SELECT rg.doc, toc_idx, title, page_start, page_end, string_agg(text, chr(10) || chr(10) ORDER BY page_num) AS text FROM rg JOIN pg ON pg.doc = rg.doc AND page_num BETWEEN page_start AND page_end WHERE length({_trim("text")}) > 50 GROUP BY ALL),
cc AS (SELECT doc, toc_idx, title, page_start, page_end, {_CLEAN} AS content FROM sc
  UNION ALL SELECT doc, -1, 'Title & Document Information', 0, 0, {_CLEAN} FROM pg WHERE page_num = 0),
ct AS (SELECT doc, printf('seg_%03d', k) AS segment_id, k::VARCHAR AS number, title, page_start, page_end, content
  FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY toc_idx) AS k FROM cc WHERE toc_idx = -1 OR length(content) >= 100))"""


_RUN_TABLES = f"""rt AS (SELECT doc_id, run_id, (row_number() OVER (PARTITION BY doc_id, run_id ORDER BY t.page, seg_uid, k) - 1)::INTEGER AS page, list_transform(t.headers, lambda c: lower({_trim("coalesce(c, '')")})) AS h, coalesce(len(t.rows), 0) AS n
  FROM (SELECT doc_id, run_id, seg_uid, generate_subscripts(tables, 1) AS k, unnest(tables) AS t FROM doc_segments))"""


def _same(a: str, b: str) -> str:
    return f"(len({a}) > 0 AND len({a}) = len({b}) AND len(list_filter(list_zip({a}, {b}), lambda z: z[1] = z[2]))::DOUBLE / len({a}) >= 0.7)"


ORACLE = {
    "clean_text": f"SELECT doc_id, {_CLEAN} AS cleaned FROM documents",
    "title_extract": f"WITH {_PAGES} SELECT doc, CASE WHEN t = '' THEN 'Untitled Document' ELSE t END AS title FROM (SELECT doc, substring(regexp_replace(array_to_string({_LINES}[1:3], ' '), '{_WS}+', ' ', 'g'), 1, 200) AS t FROM pg WHERE page_num = 0)",
    "toc_page": f"WITH {_TOCP} SELECT * FROM tocp",
    "first_content_page": f"WITH {_FIRST} SELECT * FROM fst",
    "fixed_chunking": f"WITH {_FIRST}, {_CHUNK} SELECT * FROM chunk",
    "metadata_ranges": r"""WITH one AS (SELECT concat_ws('/', document_name, run_id) AS doc, max(total_pages) AS total_pages, min(sections) AS sections FROM doc_metadata WHERE total_pages IS NOT NULL GROUP BY document_name, run_id),
s AS (SELECT doc, total_pages, generate_subscripts(sections, 1) - 1 AS toc_idx, unnest(sections) AS s FROM one),
t AS (SELECT doc, total_pages, toc_idx, s.number AS number, s.title AS title, coalesce(try_cast(regexp_extract(s.pages, '^(\d+)', 1) AS BIGINT), 0) AS page FROM s),
r AS (SELECT doc, toc_idx::INTEGER AS toc_idx, number, title, greatest(page, 1)::BIGINT AS page_start, coalesce(lead(page) OVER (PARTITION BY doc ORDER BY toc_idx) - 1, total_pages - 1)::BIGINT AS page_end FROM t)
SELECT * FROM r WHERE page_start <= page_end""",
    "segment_words": f"SELECT seg_uid, CASE WHEN t = '' THEN 0 ELSE len(string_split_regex(t, '{_WS}+')) END::INTEGER AS word_count, coalesce(len(tables), 0)::INTEGER AS table_count FROM (SELECT seg_uid, tables, {_trim("coalesce(content, '')")} AS t FROM doc_segments)",
    "table_headers": f"WITH {_RUN_TABLES} SELECT b.doc_id, b.run_id, b.page FROM rt a JOIN rt b ON a.doc_id IS NOT DISTINCT FROM b.doc_id AND a.run_id IS NOT DISTINCT FROM b.run_id AND b.page = a.page + 1 WHERE {_same('a.h', 'b.h')}",
    "table_merge": f"""WITH RECURSIVE {_RUN_TABLES}, w AS (SELECT doc_id, run_id, page, h, page AS base FROM rt WHERE page = 0
  UNION ALL SELECT rt.doc_id, rt.run_id, rt.page, CASE WHEN {_same('w.h', 'rt.h')} THEN w.h ELSE rt.h END, CASE WHEN {_same('w.h', 'rt.h')} THEN w.base ELSE rt.page END
  FROM w JOIN rt ON rt.doc_id IS NOT DISTINCT FROM w.doc_id AND rt.run_id IS NOT DISTINCT FROM w.run_id AND rt.page = w.page + 1)
SELECT w.doc_id, w.run_id, CASE WHEN max(w.page) > base THEN 'table_p' || base || '-' || max(w.page) || '_merged' ELSE 'table_p' || base || '_t0' END AS table_id, base AS page, max(w.page) AS last_page, sum(rt.n)::INTEGER AS n_rows
FROM w JOIN rt ON rt.doc_id IS NOT DISTINCT FROM w.doc_id AND rt.run_id IS NOT DISTINCT FROM w.run_id AND rt.page = w.page GROUP BY w.doc_id, w.run_id, base""",
    "extraction_prompts": f"""SELECT seg_uid, doc_id, 'Document: ' || coalesce(doc_id, '') || chr(10) || 'Section: ' || replace(coalesce(section_title, ''), '{{content}}', substring(content, 1, 6000)) || chr(10) || chr(10) || substring(content, 1, 6000) AS prompt
FROM doc_segments WHERE length({_trim('content')}) >= 100""",
    "section_ranges": f"WITH {_RANGES} SELECT * FROM rg",
    "page_section_join": f"WITH {_RANGES} SELECT rg.doc, toc_idx, page_num::INTEGER AS page_num, length(text)::INTEGER AS n_chars FROM rg JOIN pg ON pg.doc = rg.doc AND page_num BETWEEN page_start AND page_end",
    "section_content": f"WITH {_CONTENT} SELECT * FROM ct",
    "section_stats": f"WITH {_CONTENT} SELECT doc, segment_id, page_start || '-' || page_end AS pages, CASE WHEN content = '' THEN 0 ELSE len(string_split_regex(content, '{_WS}+')) END::INTEGER AS word_count, 0::INTEGER AS table_count FROM ct",
    "toc_entries": f"WITH {_RANGES} SELECT * FROM toc",
    "embedded_toc": f"""WITH one AS (SELECT concat_ws('/', document_name, run_id) AS doc, min(sections) AS s FROM doc_metadata WHERE sections IS NOT NULL GROUP BY document_name, run_id),
l AS (SELECT doc, generate_subscripts(s, 1) AS line_no, unnest(list_transform(s, lambda x: upper(coalesce(x.title, '')) || ' ... ' || regexp_extract(coalesce(x.pages, ''), '^([0-9]*)', 1))) AS raw FROM one),
t AS (SELECT doc, line_no, {_trim("raw")} AS line FROM l WHERE line_no < 20),
en AS (SELECT doc, line_no, {_inner(1)} AS title, {_inner(2)} AS page FROM t WHERE length(line) >= 5 AND NOT regexp_matches(lower(line), 'table of contents|contents|table of content|page|sustainability accounting standard|©|ifrs')),
k AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY line_no) AS k FROM en WHERE title IS NOT NULL)
SELECT doc, (k - 1)::INTEGER AS toc_idx, k::VARCHAR AS number, regexp_replace({_trim("title")}, '{_WS}+', ' ', 'g') AS title, CASE WHEN page = '' THEN k + 1 ELSE try_cast(page AS BIGINT) END AS page FROM k""",
    "answer_kinds": f"WITH {READ} SELECT CASE WHEN a IS NULL THEN 'failed' WHEN json_valid(payload) THEN 'plain' ELSE 'wrapped' END AS kind, count(*) AS n FROM rd GROUP BY 1",
    "experiment_counts": f"""WITH {READ}, al AS (SELECT rd.payload_id, gr.g, gr.baseline FROM rd LEFT JOIN gr USING (payload_id))
SELECT CASE WHEN g IS NULL THEN 'none' WHEN baseline THEN 'baseline' ELSE 'guided' END AS method, count(*) AS n_payloads, sum(CASE WHEN json_type(json_extract(g, '$.entities')) = 'ARRAY' THEN json_array_length(g, '$.entities') ELSE 0 END)::BIGINT AS n_listed, sum(CASE WHEN json_type(json_extract(g, '$.relationships')) = 'ARRAY' THEN json_array_length(g, '$.relationships') ELSE 0 END)::BIGINT AS n_rels_listed FROM al GROUP BY 1""",
    "token_cost": f"WITH {_USAGE} SELECT usage_id, input_cost, output_cost, input_cost + output_cost AS total_cost, page_end - page_start + 1 AS page_span FROM calls",
    "cost_summary": f"WITH {_COSTD} SELECT * FROM perdoc",
    "cost_batch": f"WITH {_COSTD} SELECT count(*) AS documents, sum(n_calls)::BIGINT AS n_calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, sum(total_tokens)::BIGINT AS total_tokens, round(sum(total_cost), 4) AS total_cost, round(sum(total_cost) / count(*), 4) AS avg_cost_per_document, round(sum(total_cost) / sum(n_calls), 6) AS avg_cost_per_segment FROM perdoc",
    "cost_ranking": f"WITH {_COSTD} SELECT document_name, n_calls, total_cost, (row_number() OVER (ORDER BY total_cost DESC, document_name))::INTEGER AS place FROM perdoc",
    "cost_basis": f"""WITH {_USAGE}, p AS (SELECT run_id, document_name, sum(input_cost + output_cost) AS own, min(usage_id) AS f FROM calls GROUP BY ALL), q AS (SELECT *, sum(own) OVER (PARTITION BY run_id ORDER BY f) AS reported FROM p)
SELECT round(sum(own), 4) AS spent, round(sum(reported), 4) AS reported_sum FROM q""",
    "token_summary": f"WITH {_USAGE} SELECT count(*) AS total_segments, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, (sum(input_tokens) + sum(output_tokens))::BIGINT AS total_tokens, round((sum(input_tokens) + sum(output_tokens))::DOUBLE / count(*), 0) AS avg_tokens_per_segment, round(sum(input_cost + output_cost) / count(*), 4) AS avg_cost_per_segment FROM calls",
    "uncalled_segments": """SELECT DISTINCT doc_id AS document_name, run_id, segment_id FROM doc_segments s WHERE segment_id IS NOT NULL
AND NOT EXISTS (SELECT 1 FROM llm_usage u WHERE u.document_name = s.doc_id AND u.run_id = s.run_id AND u.segment_id = s.segment_id)""",
    "wasted_cost": f"WITH {_WASTED} SELECT * FROM w",
    "method_summary": f"WITH {_WASTED} {_method('w')}",
    "method_comparison": f"WITH {_COMPARE} SELECT * FROM cmp",
    "cost_breakdown": f"""WITH {_WASTED}, m AS ({_method("w")}) SELECT 'Stage 2 Extraction' AS stage, printf('%.4f', extraction_cost) AS extraction_usd, '0.0000' AS validation_usd, printf('%.4f', extraction_cost) AS total_usd FROM m
UNION ALL SELECT 'Stage 3 Validation', '0.0000', printf('%.4f', validation_cost), printf('%.4f', validation_cost) FROM m UNION ALL SELECT 'Total Pipeline', printf('%.4f', extraction_cost), printf('%.4f', validation_cost), printf('%.4f', extraction_cost + validation_cost) FROM m""",
    "cost_efficiency": f"""WITH {_WASTED}, m AS ({_method("w")}) SELECT unnest(['Cost per Extracted Entity (USD)', 'Cost per Validated Entity (USD)', 'Entity Retention Rate (%)', 'Total Entities Extracted', 'Total Entities Validated', 'Total Entities Filtered', 'Wasted Cost (USD)']) AS metric,
  unnest([printf('%.6f', cost_per_extracted), printf('%.6f', cost_per_validated), printf('%.2f', retention), extracted::VARCHAR, validated::VARCHAR, (extracted - validated)::VARCHAR, printf('%.4f', wasted_cost)]) AS value FROM m""",
    "document_costs": f"""WITH {_WASTED} SELECT document_name AS document, printf('%.4f', floor((round((extraction_cost) * 1e6) + 50) / 100) / 1e4) AS extraction_usd, printf('%.4f', floor((round((validation_cost) * 1e6) + 50) / 100) / 1e4) AS validation_usd, printf('%.4f', floor((round((extraction_cost + validation_cost) * 1e6) + 50) / 100) / 1e4) AS total_usd, entities_before AS extracted, entities_after AS validated,
  printf('%.2f', CASE WHEN entities_before = 0 THEN 0.0::DOUBLE ELSE entities_after::DOUBLE / entities_before * 100 END) AS retention, printf('%.4f', floor((round((wasted_cost) * 1e6) + 50) / 100) / 1e4) AS wasted_usd FROM w""",
    "comparison_tables": f"""WITH {_COMPARE}, b AS (SELECT 'Baseline' AS method, * FROM m1 UNION ALL SELECT 'Ontology-Guided', * FROM m2)
SELECT 'comparison_total_cost' AS name, concat_ws(',', method, printf('%.4f', extraction_cost), printf('%.4f', validation_cost), printf('%.4f', total_cost)) AS row FROM b
UNION ALL SELECT 'comparison_wasted_cost', concat_ws(',', method, printf('%.4f', effective_cost), printf('%.4f', wasted_cost), printf('%.4f', total_cost), printf('%.2f', wasted_percent)) FROM b
UNION ALL SELECT 'comparison_entity_retention', concat_ws(',', method, extracted, validated, extracted - validated, printf('%.2f', retention)) FROM b
UNION ALL SELECT 'comparison_cost_efficiency', concat_ws(',', method, printf('%.6f', total_per_validated), printf('%.4f', total_cost), validated) FROM b""",
    "baseline_cost": f"WITH {_BASE_COST} SELECT * FROM bw",
    "method_savings": f"WITH {_COMPARE} SELECT round((baseline - guided) / baseline * 100, 1) AS savings FROM cmp WHERE metric = 'total_per_validated' AND baseline > 0 AND guided > 0",
    "method_insights": f"""WITH {_COMPARE}, g AS (SELECT *, CASE WHEN metric = 'retention' THEN guided - baseline ELSE baseline - guided END AS gain FROM cmp)
SELECT metric, CASE WHEN gain > 0 THEN 'guided' ELSE 'baseline' END AS winner, CASE metric WHEN 'total_per_validated' THEN round(abs(gain) / baseline * 100, 1) WHEN 'retention' THEN round(abs(gain), 1) ELSE round(abs(gain), 4) END AS lead
FROM g WHERE metric IN ('retention', 'wasted_cost') OR (metric = 'total_per_validated' AND baseline > 0 AND guided > 0)""",
}
