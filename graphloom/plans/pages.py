"""Scans of pages and source files. No table holds HTML, so pages are made from the tables' columns: the scan must
give back what was put in, which the SQL takes from the columns themselves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.sources import files, html
from graphloom.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def escaped(c: Column | str) -> Column:
    return reduce(lambda x, r: F.replace(x, F.lit(r[0]), F.lit(r[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")), F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))


def page(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


_STRIP = "regexp_replace({c}, '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g')"


@query("select url, count(*) as n from (select regexp_replace(url, '[?#].*$', '') as url from mail_raw where url like 'http%') group by 1")
def scan_html_links(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct link of the pages that fits the rule (here: a web address), without query and fragment."""
    pages = table(spark, d, "mail_raw").where("url is not null").select(page('<li><a href="', escaped("url"), '">mail</a> <a name="x">none</a></li>').alias("html"))
    links = pages.select(F.explode(html.anchors(F.col("html"))).alias("a")).where(F.col("a.href").startswith("http"))
    return links.groupBy(F.regexp_replace("a.href", r"[?#].*$", "").alias("url")).agg(F.count(F.lit(1)).alias("n"))


@query(f"select msg_key, md5(s) as subject, md5(f) as sender, md5(b) as body from (select msg_key, {_STRIP.format(c='subject')} as s, {_STRIP.format(c='\"from\"')} as f, {_STRIP.format(c='body')} as b from thread_message) where s <> '' and f <> '' and b <> ''")
def scan_html_message(spark: SparkSession, d: str) -> DataFrame:
    """Message pages: header table and body; pages without subject, sender or body give nothing."""
    row = lambda name, c: page(f"<tr><th>{name}:</th><td> ", escaped(c), " </td></tr>")
    html_of = page("<html><body><table>", row("From", "from"), row("Subject", "subject"), row("Message-ID", "message_id"), '</table><div class="wide message-content"><p>', escaped("body"), "</p></div></body></html>")
    found = table(spark, d, "thread_message").select("msg_key", F.explode(html.message(html_of)).alias("m"))
    return found.select("msg_key", F.md5("m.subject").alias("subject"), F.md5("m.from").alias("sender"), F.md5("m.body").alias("body"))


@query(f"with t as (select doc_id, {_STRIP.format(c='coalesce(text, \'\')')} as t, nullif({_STRIP.format(c='coalesce(chapter, \'\')')}, '') as c from documents), k as (select * from t where length(t) >= 50) select doc_id, 1 as number, c as section, md5(t) as text, 0 as tables from k union all select doc_id, 2, c, md5('[CODE BLOCK]' || chr(10) || t), 1 from k")
def scan_html_sections(spark: SparkSession, d: str) -> DataFrame:
    """Items of section pages with the heading they stand under; the short paragraph is dropped, the table goes to the item before it."""
    html_of = page('<body><div class="nav"><p>', "n" * 60, '</p></div><div class="content"><h2> ', escaped("chapter"), " </h2><p>short</p><p>", escaped("text"), "</p><pre>", escaped("text"), "</pre><table><tr><th>k</th><td>v</td></tr></table></div></body>")
    found = table(spark, d, "documents").select("doc_id", F.explode(html.sections(html_of)).alias("s"))
    return found.select("doc_id", "s.number", "s.section", F.md5("s.text").alias("text"), F.size("s.tables").alias("tables"))


_KEYS = "select cluster_id, unnest(keywords) as k, generate_subscripts(keywords, 1) - 1 as i from topic_cluster"


def _listed(c: str, of) -> Column:
    """The elements of an array column as one text, each by a function of element and position."""
    return F.array_join(F.transform(F.col(c), of), "")


@query(f"select cluster_id, chapter, title, 'http://book.example/pgsql0' || chapter || '/index.html' as url from (select cluster_id, (cluster_id + i) % 3 as chapter, case when i % 2 = 0 then k else k || ' x' end as title, row_number() over (partition by cluster_id, (cluster_id + i) % 3 order by i) as r from ({_KEYS})) where r = 1")
def scan_html_toc(spark: SparkSession, d: str) -> DataFrame:
    """Chapters of contents pages: number, title without its number, address; the first link of a chapter wins."""

    def link(k: Column, i: Column) -> Column:
        number = F.pmod(F.col("cluster_id") + i, F.lit(3)).cast("string")
        return page('<li><a href="pgsql0', number, '/index.html">', F.when(i % 2 == 0, page(number, ". ", k)).otherwise(page(k, " x")), '</a><a href="other.html">o</a></li>')

    pages = table(spark, d, "topic_cluster").select("cluster_id", F.explode(html.contents(_listed("keywords", link), F.lit("http://book.example/"))).alias("c"))
    return pages.select("cluster_id", "c.chapter", "c.title", "c.url")


@query(f"select cluster_id, list_sort(list_distinct(list(u))) as pages from (select cluster_id, 'http://book.example/pgsql07/0' || (i % 2) || '.html' as u from ({_KEYS}) union all select cluster_id, 'http://book.example/pgsql07/' || i || '.html' from ({_KEYS}) where i % 2 = 1) group by 1")
def chapter_section_links(spark: SparkSession, d: str) -> DataFrame:
    """Section pages in the folder of a chapter, sorted and once each; index pages and other folders are left out."""
    link = lambda k, i: page('<a href="./0', (i % 2).cast("string"), '.html">s</a><a href="../pgsql0', F.when(i % 2 == 1, "7").otherwise("8"), "/", i.cast("string"), '.html">t</a><a href="./index.html">i</a><a href="http://x.example/pgsql07/9.html">w</a>')
    return table(spark, d, "topic_cluster").select("cluster_id", html.chapter_pages(_listed("keywords", link), F.lit("http://book.example/pgsql07/index.html")).alias("pages"))


@query("select cluster_id, array_to_string(list_transform(keywords, lambda k: k || ' | ' || upper(k)), chr(10)) as content from topic_cluster")
def html_table_text(spark: SparkSession, d: str) -> DataFrame:
    row = lambda k: page("<tr><td> ", escaped(k), "</td><th>", escaped(F.upper(k)), "</th></tr><tr></tr>")
    return table(spark, d, "topic_cluster").select("cluster_id", F.explode(html.tables(page("<table>", _listed("keywords", row), "</table>"))).alias("content"))


@query(f"select cluster_id, k as name, (select label from topic_cluster t where t.cluster_id = x.cluster_id) as category, 'about ' || k as description, 'http://m.example/f/' || i as url from ({_KEYS}) x where i % 3 <> 0")
def feature_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Features that version 17 has, with category, description and address; footnote marks are cut off."""
    row = lambda k, i: page('<tr><th title="about  ', escaped(k), '"><a href="/f/', i.cast("string"), '">', escaped(k), '</a> [3]</th><td class="fm_yes">y</td><td class="c ', F.when(i % 3 == 0, "fm_no").when(i % 3 == 1, "fm_yes").otherwise("fm_obs"), '">v</td></tr>')
    html_of = page("<h2>", escaped("label"), '</h2><table class="big matrix"><thead><tr><th>Feature</th><th>18</th><th>17</th></tr></thead><tbody>', _listed("keywords", row), '</tbody></table><table class="matrix"><thead><tr><th>F</th><th>9</th></tr></thead></table>')
    found = table(spark, d, "topic_cluster").select("cluster_id", F.explode(html.matrix(html_of, "17", "http://m.example/")).alias("f"))
    return found.select("cluster_id", "f.*")


def page_headings(c: Column) -> Column:
    """(chapter, section) announced in the first ten lines of a page, null where none is; reading stops once both are found."""
    lines = F.transform(F.slice(F.split(c, "\n"), 1, 10), lambda x: F.trim(x))
    chapters = [r"(?i)^Chapter\s+(\d+)[:.\s]+(.+)$", r"(?i)^Part\s+([IVX]+)[:.\s]+(.+)$", r"(?i)^(\d+)\.\s+([A-Z][^.]+)$"]
    sections = [r"^(\d+\.\d+)[:.\s]+(.+)$", r"^([IVX]+\.[IVX]+)[:.\s]+(.+)$"]

    def heading(x: Column, patterns: list[str], form: str) -> Column:
        return F.coalesce(*[F.when(x.rlike(p), F.format_string(form, F.regexp_extract(x, p, 1), F.trim(F.regexp_extract(x, p, 2)))) for p in patterns])

    state = lambda a, b: F.struct(a.cast("string").alias("chapter"), b.cast("string").alias("section"))
    return F.aggregate(
        lines, state(F.lit(None), F.lit(None)),
        lambda s, x: F.when(s["chapter"].isNotNull() & s["section"].isNotNull(), s).otherwise(state(F.coalesce(heading(x, chapters, "Chapter %s: %s"), s["chapter"]), F.coalesce(heading(x, sections, "%s %s"), s["section"]))),
    )


@query()
def pdf_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of 50 characters or more with the chapter and section last announced in their book. Headings are ranked
    against pages by the as-of pass of counts, so a book of any size stays a sorted scan."""
    pages = table(spark, d, "documents").where("length(text) >= 50").select("source", "doc_id", page_headings(F.col("text")).alias("h"))
    w = Window.partitionBy("source").orderBy("doc_id")
    return pages.select("doc_id", F.last("h.chapter", ignorenulls=True).over(w).alias("chapter"), F.last("h.section", ignorenulls=True).over(w).alias("section"))


def block_comments(c: Column) -> Column:
    """(line_start, content) of the block comments of a source text that hold 50 characters or more before and after
    their leading asterisks are taken off."""
    pattern = r"(?s)/\*\*?(.*?)\*/"
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    newlines = lambda x: F.length(F.regexp_replace(x, r"[^\n]", ""))
    whole, between = F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.split(c, pattern)
    inner = F.regexp_extract_all(c, F.lit(pattern), F.lit(1))
    # lines are counted over the gaps and comments before
    fold = F.aggregate(
        F.arrays_zip(whole.alias("w"), inner.alias("i"), F.slice(between, 1, F.size(whole)).alias("g")),
        F.struct(F.lit(1).alias("line"), F.array().cast("array<struct<line_start:int,content:string>>").alias("out")),
        lambda s, x: F.struct((s["line"] + newlines(x["g"]) + newlines(x["w"])).alias("line"), F.array_append(s["out"], F.struct((s["line"] + newlines(x["g"])).alias("line_start"), strip(x["i"]).alias("content"))).alias("out")),
        lambda s: s["out"],
    )
    long_enough = F.filter(fold, lambda x: F.length(x["content"]) >= 50)
    cleaned = F.transform(long_enough, lambda x: F.struct(x["line_start"], strip(F.regexp_replace(x["content"], r"(?m)^\s*\*\s?", "")).alias("content")))
    return F.filter(cleaned, lambda x: F.length(x["content"]) >= 50)


_COMMENTS = "with t as (select doc_id, '/*' || repeat('-', 60) || '*/' || chr(10) || text || chr(10) || '/** ' || repeat('word ', 12) || '*/' as x from documents where text is not null), p as (select doc_id, string_split_regex(x, '(?s)/\\*\\*?(.*?)\\*/') as g, regexp_extract_all(x, '(?s)/\\*\\*?(.*?)\\*/', 0) as w, regexp_extract_all(x, '(?s)/\\*\\*?(.*?)\\*/', 1) as i from t), u as (select doc_id, k, regexp_replace(i[k], '^\\s+|\\s+$', '', 'g') as c, 1 + length(regexp_replace(array_to_string(g[1:k], '') || array_to_string(w[1:k - 1], ''), '[^\\n]', '', 'g')) as line_start from (select *, unnest(range(1, len(w) + 1)) as k from p)), f as (select doc_id, line_start, regexp_replace(regexp_replace(c, '(?m)^\\s*\\*\\s?', '', 'g'), '^\\s+|\\s+$', '', 'g') as content from u where length(c) >= 50)"


@query(_COMMENTS + " select doc_id, line_start::int as line_start, length(content) as chars from f where length(content) >= 50")
def extract_block_comments(spark: SparkSession, d: str) -> DataFrame:
    """Block comments with their first line; two are put around every text, so that all texts have some."""
    x = F.concat(F.lit("/*" + "-" * 60 + "*/\n"), F.col("text"), F.lit("\n/** " + "word " * 12 + "*/"))
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(block_comments(x)).alias("c"))
    return rows.select("doc_id", "c.line_start", F.length("c.content").alias("chars"))


@query("select doc_id, 'Comment from ' || string_split(file_path, '/')[-1] || ':' || chunk_index as title, file_path || ':' || chunk_index as url, 'C_COMMENT' as source_type from documents where file_path is not null union all select doc_id, 'README: ' || coalesce(chapter, ''), source_url, 'README' from documents where file_path is null")
def content_items(spark: SparkSession, d: str) -> DataFrame:
    """Comments and pages as one kind of item."""
    docs = table(spark, d, "documents")
    at = F.concat(F.lit(":"), F.col("chunk_index").cast("string"))
    comments = docs.where("file_path is not null").select("doc_id", F.concat(F.lit("Comment from "), F.element_at(F.split("file_path", "/"), -1), at).alias("title"), F.concat("file_path", at).alias("url"), F.lit("C_COMMENT").alias("source_type"))
    readme = docs.where("file_path is null").select("doc_id", F.concat(F.lit("README: "), F.coalesce("chapter", F.lit(""))).alias("title"), F.col("source_url").alias("url"), F.lit("README").alias("source_type"))
    return comments.unionByName(readme)


@query("select distinct f as path, case when list_contains(p, 'backend') then coalesce(p[list_position(p, 'backend') + 1], 'unknown') when list_contains(p, 'include') then p[list_position(p, 'include') + 1] else 'unknown' end as component, case when suffix(f, '.c') then 'c' else 'h' end as language from (select f, string_split(f, '/') as p from (select unnest(source_files) as f from all_qa_merged)) where regexp_matches(f, '\\.[ch]$') and not regexp_matches(regexp_extract(f, '^(.*)/[^/]*$', 1), 'build|\\.git|tmp')")
def source_index(spark: SparkSession, d: str) -> DataFrame:
    """The C files that records cite, with component and language (from a folder: :func:`graphloom.sources.files.source_index`)."""
    cited = table(spark, d, "all_qa_merged").select(F.explode("source_files").alias("path")).distinct()
    return files.indexed(cited, "path").select("path", "component", "language")


@query("select '<m' || i || '@mail.example>' as message_id, case when i % 5 = 0 then null else '<m' || (i - i % 5) || '@mail.example>' end as in_reply_to, case when i % 5 = 0 then '' else 'Re: ' end || 'Topic ' || (i // 5) as subject, 'User ' || (i % 7) || ' <u' || (i % 7) || '@mail.example>' as sender from (select unnest(range(50)) as i)")
def sample_mail(spark: SparkSession, d: str) -> DataFrame:
    """Ten made-up threads of five mails."""
    i = F.col("id")
    ident = lambda k: F.concat(F.lit("<m"), k.cast("string"), F.lit("@mail.example>"))
    user = (i % 7).cast("string")
    return spark.range(50).select(ident(i).alias("message_id"), F.when(i % 5 != 0, ident(i - i % 5)).alias("in_reply_to"), F.concat(F.when(i % 5 == 0, "").otherwise("Re: "), F.lit("Topic "), F.floor(i / 5).cast("string")).alias("subject"), F.concat(F.lit("User "), user, F.lit(" <u"), user, F.lit("@mail.example>")).alias("sender"))


@query("select 'https://www.example.org/list/hackers/' || y || '-' || lpad(m::varchar, 2, '0') as url from (select unnest(range(2021, 2025)) as y), (select unnest(range(1, 13)) as m)")
def archive_urls(spark: SparkSession, d: str) -> DataFrame:
    months = spark.range(1).select(F.explode(F.expr("sequence(date'2021-01-01', date'2024-12-01', interval 1 month)")).alias("m"))
    return months.select(F.concat(F.lit("https://www.example.org/list/hackers/"), F.date_format("m", "yyyy-MM")).alias("url"))


@query("select source_type, count(*) as items, count(distinct chapter) as chapters, count(distinct chapter || '/' || chunk_index) as sections, round(avg(length(text)), 4) as mean_length from documents group by 1")
def agg_scrape_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.groupBy("source_type").agg(F.count(F.lit(1)).alias("items"), F.countDistinct("chapter").alias("chapters"), F.countDistinct(F.concat("chapter", F.lit("/"), F.col("chunk_index").cast("string"))).alias("sections"), F.round(F.avg(F.length("text")), 4).alias("mean_length"))
