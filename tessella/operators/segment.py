"""Segmentation of page texts: title, contents list, sections, content, tables.

A document is one row that holds its pages as an array. Everything up to the sections is an expression
on that row, so no step from the text to the numbered sections shuffles anything, and a page text only
travels to where a section needs it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import clean_text, filled_lines, strip, title, word_count

# Words that announce a list of contents.
TOC_WORDS = ["contents", "table of contents", "introduction", "overview"]
# Heads of a contents list inside a text, in the order in which they are tried. A page is
# only looked at if it holds one of the first four.
EMBEDDED_HEADS = ["table of contents", "contents", "table of content", "content", "index"]
# A line that holds one of these is the head of the list or no entry of it.
HEAD_LINES = ["table of contents", "contents", "table of content"]
STOP_PARTS = ["page", "sustainability accounting standard", "©", "ifrs"]
# Entries of a contents page (number, title, page), the first that fits a line.
TOC_PATTERNS = [
    r"(?U)(\d+\.?\d*)\s+([A-Z][^\.\n]{5,50})[\.\s]+(\d+)",
    r"(?U)(Appendix\s+[A-Z])\s*[\-\:]?\s*([^\.\n]{5,50})[\.\s]+(\d+)",
    r"(?U)([A-Z]\.\d+)\s+([A-Z][^\.\n]{5,50})[\.\s]+(\d+)",
]
# Entries of a list inside a text (title, page), the first with a title of more than three characters.
EMBEDDED_PATTERNS = [
    r"(?U)([A-Z][A-Za-z\s&,\-]+?)[\.\s]*(\d+)$",
    r"(?U)([A-Z][A-Za-z\s&,\-()]+?)[\.\s]*(\d+)$",
    r"(?U)([A-Z][A-Za-z\s&,\-()]+?)\s*[\.\s]*(\d+)$",
    r"(?U)^([A-Z][A-Z\s&,\-()]+?)\s+(\d+)$",
]
NAME_ALONE = r"(?U)^([A-Z][A-Z\s&,\-()]{4,})$"
TITLE_SECTION = "Title & Document Information"
FAR = 2**63 - 1


def documents(texts: DataFrame, key: str, text: str, mark: str = "\n\n") -> DataFrame:
    """(doc, pages): a text cut into pages at ``mark``; null texts have no pages and no row."""
    return texts.where(F.col(text).isNotNull()).select(F.col(key).alias("doc"), F.split(text, mark).alias("pages"))


def from_pages(pages: DataFrame) -> DataFrame:
    """(doc, pages, tables) from one row per page (doc_id, page_num, text, tables), as a reader gives them.
    A page without text has an empty one, so that page numbers stay places in the array."""
    rows = F.array_sort(F.collect_list(F.struct("page_num", F.coalesce("text", F.lit("")).alias("text"), "tables")))
    g = pages.where("page_num is not null").groupBy(F.col("doc_id").alias("doc")).agg(rows.alias("p"))
    return g.select("doc", F.transform("p", lambda x: x["text"]).alias("pages"), F.transform("p", lambda x: x["tables"]).alias("tables"))


def titles(docs: DataFrame) -> DataFrame:
    """The title of each document, from its first page."""
    return docs.select("doc", title(F.get("pages", 0)).alias("title"))


def _any(text: Column, parts: list[str]) -> Column:
    hit = text.contains(parts[0])
    for p in parts[1:]:
        hit = hit | text.contains(p)
    return hit


def with_toc_page(docs: DataFrame) -> DataFrame:
    """Adds ``toc_page``: the first of ten pages that names its contents and has a numbered heading; 1 if there is none."""
    hit = lambda t: _any(F.lower(t), TOC_WORDS) & F.regexp_like(t, F.lit(r"(?U)\d+\.?\s+[A-Z]"))
    at = F.array_position(F.transform(F.slice("pages", 1, 10), hit), True)
    return docs.withColumn("toc_page", F.when(at > 0, at - 1).otherwise(1).cast("int"))


def with_first_content(docs: DataFrame) -> DataFrame:
    """Adds ``first_content`` and ``total_pages``: the first of pages 1 to 9 without 'contents' and with five lines of
    more than ten characters; else the page after the list of contents."""
    hit = lambda t: ~F.lower(t).contains("contents") & (F.size(F.filter(filled_lines(t), lambda x: F.length(x) > 10)) >= 5)
    at = F.array_position(F.transform(F.slice("pages", 2, 9), hit), True)
    return docs.withColumn("first_content", F.when(at > 0, at).otherwise(F.col("toc_page") + 1).cast("int")).withColumn("total_pages", F.size("pages"))


def _group(text: Column, pattern: str, i: int) -> Column:
    """A group of the first match; NULL if there is none."""
    return F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))


def _page(text: Column) -> Column:
    """A page number; one too long for a number lies behind every page."""
    return F.when(text.isNotNull(), F.coalesce(text.try_cast("long"), F.lit(FAR)))


def _entry(number: Column, name: Column, page: Column) -> Column:
    return F.struct(number.alias("number"), name.alias("title"), page.cast("long").alias("page"))


def toc_entries(text: Column) -> Column:
    """Entries of a page of contents: array of (number, title, page). The first pattern that fits a line wins."""

    def entry(line: Column) -> Column:
        part = lambda i: F.coalesce(*[_group(line, p, i) for p in TOC_PATTERNS])
        return _entry(strip(part(1)), strip(part(2)), _page(part(3)))

    lines = F.transform(F.split(text, "\n"), strip)
    # a cheap test first: every entry has a digit
    return F.filter(F.transform(F.filter(lines, lambda l: F.regexp_like(l, F.lit(r"(?U)\d"))), entry), lambda e: e["page"].isNotNull())


def embedded_entries(text: Column) -> Column:
    """Entries of a contents list inside a text: array of (number, title, page).

    The heads are tried in their order; from the head on twenty lines are read, lines of less than five
    characters, head lines and lines that are no entries passed over. Entries are numbered; one without a
    page gets its number plus one."""
    low = F.lower(text)
    at = F.coalesce(*[F.when(low.contains(h), F.instr(low, h)) for h in EMBEDDED_HEADS])
    lines = F.transform(F.slice(F.split(F.substr(text, at), "\n"), 1, 20), strip)

    def usable(line: Column) -> Column:
        l = F.lower(line)
        return (F.length(line) >= 5) & ~_any(l, HEAD_LINES) & ~_any(l, STOP_PARTS)

    def entry(line: Column) -> Column:
        long = lambda p: F.length(strip(F.regexp_extract(line, p, 1))) > 3
        name = F.coalesce(*[F.when(long(p), F.regexp_extract(line, p, 1)) for p in [*EMBEDDED_PATTERNS, NAME_ALONE]])
        page = F.coalesce(*[F.when(long(p), F.regexp_extract(line, p, 2)) for p in EMBEDDED_PATTERNS])
        return F.struct(F.regexp_replace(strip(name), r"(?U)\s+", " ").alias("title"), _page(page).alias("page"))

    found = F.filter(F.transform(F.filter(lines, usable), entry), lambda e: e["title"].isNotNull())
    numbered = F.transform(found, lambda e, i: _entry((i + 1).cast("string"), e["title"], F.coalesce(e["page"], i + 2)))
    return F.when(_any(low, EMBEDDED_HEADS[:4]), numbered).otherwise(F.array().cast("array<struct<number:string,title:string,page:bigint>>"))


def fixed_chunks(first: Column, total: Column, step: int = 10) -> Column:
    """The fallback: an entry every ``step`` pages from the first page of content; none if there is no such page."""
    starts = F.when(first < total, F.sequence(first, total - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda p, i: _entry((i + 1).cast("string"), F.format_string("Section %d", i + 1), p))


def outline(docs: DataFrame, step: int = 10) -> DataFrame:
    """Adds ``entries``: the list of contents of each document, from its page of contents, else from the first of five
    pages with a list inside its text, else fixed chunks."""
    t = with_first_content(with_toc_page(docs))
    t = t.withColumn("_toc", toc_entries(F.coalesce(F.get("pages", F.col("toc_page")), F.lit(""))))
    inside = F.get(F.filter(F.transform(F.slice("pages", 1, 5), embedded_entries), lambda e: F.size(e) > 0), 0)
    t = t.withColumn("_inside", F.when(F.size("_toc") == 0, inside))
    best = F.when(F.size("_toc") > 0, F.col("_toc")).otherwise(F.coalesce("_inside", fixed_chunks(F.col("first_content"), F.col("total_pages"), step)))
    return t.withColumn("entries", best).drop("_toc", "_inside")


def ranges(entries: Column, first: Column, total: Column) -> Column:
    """Page ranges of the entries: array of (toc_idx, number, title, page_start, page_end). A section ends before the
    next begins, the last with the document; ranges may overlap where the list runs backwards, empty ones
    are dropped."""

    def one(e: Column, i: Column) -> Column:
        last = F.coalesce(F.get(entries, i + 1)["page"] - 1, (total - 1).cast("long"))
        return F.struct(i.alias("toc_idx"), e["number"].alias("number"), e["title"].alias("title"), F.greatest(e["page"], first.cast("long")).alias("page_start"), last.alias("page_end"))

    return F.filter(F.transform(entries, one), lambda r: r["page_start"] <= r["page_end"])


def with_ranges(outlined: DataFrame) -> DataFrame:
    return outlined.withColumn("ranges", ranges(F.col("entries"), F.col("first_content"), F.col("total_pages")))


def section_ranges(outlined: DataFrame) -> DataFrame:
    """(doc, toc_idx, number, title, page_start, page_end), a row per section."""
    return with_ranges(outlined).select("doc", F.inline("ranges"))


def _span(items: Column, r: Column) -> Column:
    """The items of the pages of a range; pages behind the last one do not exist."""
    n = F.size(items).cast("long")
    lo = F.least(r["page_start"], n)
    return F.slice(items, (lo + 1).cast("int"), F.greatest(F.least(r["page_end"] + 1, n) - lo, F.lit(0)).cast("int"))


def section_pages(outlined: DataFrame) -> DataFrame:
    """(doc, toc_idx, page_num, text): every page of every section."""
    t = with_ranges(outlined).select("doc", "pages", F.explode("ranges").alias("r"))
    t = t.select("doc", "r", F.posexplode(_span(F.col("pages"), F.col("r"))).alias("k", "text"))
    return t.select("doc", "r.toc_idx", (F.col("r.page_start") + F.col("k")).cast("int").alias("page_num"), "text")


def sections(outlined: DataFrame, least_page: int = 50, least_section: int = 100) -> DataFrame:
    """(doc, segment_id, number, title, page_start, page_end, content, has_tables, tables).

    The first section is the title page, whatever it holds; the others take their pages of more than
    ``least_page`` characters, in order and cleaned. Sections under ``least_section`` characters are
    dropped and the rest numbered on from 2. ``tables`` of the input (raw tables of each page) become the
    merged tables of each section; without that column they are empty."""
    text = lambda r: clean_text(F.array_join(F.filter(_span(F.col("pages"), r), lambda p: F.length(strip(p)) > least_page), "\n\n"))
    t = with_ranges(outlined)
    # which sections stay is known before any content leaves its row, so numbers need no shuffle
    kept = F.filter("ranges", lambda r: F.length(text(r)) >= least_section)
    head = F.array(F.struct(F.lit(-1).alias("toc_idx"), F.lit("1").alias("number"), F.lit(TITLE_SECTION).alias("title"), F.lit(0).cast("long").alias("page_start"), F.lit(0).cast("long").alias("page_end")))
    raw = raw_tables(F.col("tables")) if "tables" in outlined.columns else F.array().cast(f"array<array<{RAW}>>")
    t = t.withColumn("_raw", raw).select("doc", "pages", "_raw", F.posexplode(F.concat(head, kept)).alias("k", "r"))
    own = F.when(F.col("k") == 0, clean_text(F.coalesce(F.get("pages", 0), F.lit("")))).otherwise(text(F.col("r")))
    t = t.select("doc", "k", "r", own.alias("content"), F.flatten(_span(F.col("_raw"), F.col("r"))).alias("_tables"))
    if "tables" in outlined.columns:
        merged = merge_udf(F.col("_tables"))
        alone = F.transform("_tables", lambda x: F.struct(x["page"].alias("page"), x["table_id"].alias("table_id"), x["headers"].alias("headers"), x["rows"].alias("rows"), F.lit(None).cast("array<int>").alias("pages"), F.lit(None).cast("int").alias("last_page")))
        # tables of the title page are never merged
        t = t.withColumn("tables", F.when((F.col("k") == 0) | (F.size("_tables") == 0), alone).otherwise(merged))
    else:
        t = t.withColumn("tables", F.array().cast(f"array<{TABLE}>"))
    n = F.col("k") + 1
    return t.select("doc", F.format_string("seg_%03d", n).alias("segment_id"), n.cast("string").alias("number"), "r.title", "r.page_start", "r.page_end", "content", (F.size("tables") > 0).alias("has_tables"), "tables")


def section_stats(contents: DataFrame) -> DataFrame:
    return contents.select("doc", "segment_id", F.format_string("%d-%d", "page_start", "page_end").alias("pages"), word_count(F.col("content")).alias("word_count"), F.size("tables").alias("table_count"))


RAW = "struct<page:int,table_id:string,headers:array<string>,rows:array<array<string>>>"
TABLE = "struct<page:int,table_id:string,headers:array<string>,rows:array<array<string>>,pages:array<int>,last_page:int>"


def raw_tables(tables: Column) -> Column:
    """Per page the tables with more than a heading: array of arrays of (page, table_id, headers, rows)."""
    one = lambda p: lambda x, i: F.when(F.size(x) > 1, F.struct(p.alias("page"), F.format_string("table_p%d_t%d", p, i).alias("table_id"), F.get(x, 0).alias("headers"), F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))).alias("rows")))
    return F.transform(tables, lambda page, p: F.filter(F.transform(F.coalesce(page, F.array().cast("array<array<array<string>>>")), one(p)), lambda x: x.isNotNull()))


def headers_match(a: Column, b: Column, share: float = 0.7) -> Column:
    """Equal length and at least 70 % of the places alike, after trimming and lower case; empty ones never match."""
    plain = lambda x: F.transform(x, lambda c: F.lower(strip(F.coalesce(c, F.lit("")))))
    same = F.aggregate(F.zip_with(plain(a), plain(b), lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    n = F.size(a)
    return (n > 0) & (n == F.size(b)) & (same / F.when(n > 0, n) >= share)


def merge(tables: list | None) -> list[dict]:
    """Tables that go on over following pages as one: extended while the next page has a table whose
    headers match the first ones; pages taken up are passed over with whatever else is on them."""
    by_page: dict[int, list] = {}
    for t in tables if tables is not None else []:
        if t is not None and t["page"] is not None:
            by_page.setdefault(int(t["page"]), []).append(t)
    out: list[dict] = []
    done = -1
    for at in sorted(by_page):
        if at <= done:
            continue
        for base in by_page[at]:
            rows, covered = list(base["rows"] if base["rows"] is not None else []), [at]
            while (more := next((t for t in by_page.get(covered[-1] + 1, []) if _alike(base["headers"], t["headers"])), None)) is not None:
                rows += list(more["rows"] if more["rows"] is not None else [])
                covered.append(covered[-1] + 1)
            name = f"table_p{at}-{covered[-1]}_merged" if len(covered) > 1 else base["table_id"]
            out.append({"page": at, "table_id": name, "headers": base["headers"], "rows": rows, "pages": covered, "last_page": covered[-1]})
            done = max(done, covered[-1])
    return out


def _alike(a: object, b: object) -> bool:
    x = [str(v or "").strip().lower() for v in (a if a is not None else [])]
    y = [str(v or "").strip().lower() for v in (b if b is not None else [])]
    return bool(x) and len(x) == len(y) and sum(p == q for p, q in zip(x, y)) / len(x) >= 0.7


def merge_udf(tables: Column) -> Column:
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(merge)

    return F.pandas_udf(run, f"array<{TABLE}>")(tables)


def merged_tables(tables: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, table_id, page, last_page, n_rows) of the merged tables of each row's array ``tables``.

    The walk is greedy and stays within a row, so it runs in Arrow batches."""
    return tables.where("size(tables) > 0").select(*keys, F.explode(merge_udf(F.col("tables"))).alias("t")).select(*keys, "t.table_id", "t.page", "t.last_page", F.size("t.rows").alias("n_rows"))


def run_tables(segments: DataFrame) -> DataFrame:
    """(doc_id, run_id, tables): the tables of each run of a standard in page order, laid on pages of their own
    one after another, so that neighbours can be told."""
    t = segments.where("tables is not null").select("doc_id", "run_id", "seg_uid", F.posexplode("tables").alias("k", "t"))
    listed = F.array_sort(F.collect_list(F.struct(F.col("t.page").alias("p"), "seg_uid", "k", F.col("t.headers").alias("headers"), F.col("t.rows").alias("rows"))))
    g = t.groupBy("doc_id", "run_id").agg(listed.alias("l"))
    return g.select("doc_id", "run_id", F.transform("l", lambda x, i: F.struct(i.alias("page"), F.format_string("table_p%d_t0", i).alias("table_id"), x["headers"].alias("headers"), x["rows"].alias("rows"))).alias("tables"))


def header_pairs(tables: DataFrame) -> DataFrame:
    """(doc_id, run_id, page): pages whose table goes on with the headers of the page before."""
    pairs = F.filter(F.transform("tables", lambda x, i: F.when((i > 0) & headers_match(F.get("tables", i - 1)["headers"], x["headers"]), x["page"])), lambda p: p.isNotNull())
    return tables.select("doc_id", "run_id", F.explode(pairs).alias("page"))
