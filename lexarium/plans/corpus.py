"""Document pipeline queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.functions import text
from lexarium.operators import anchors as a
from lexarium.operators import chunking
from lexarium.plans.base import query, table


def _d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("SELECT doc_id, (len(regexp_extract_all(text, '[一-鿿]')) + len(regexp_extract_all(text, '[a-zA-Z]+')))::BIGINT AS words FROM documents")
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each text."""
    return _d(spark, sf_dir).select("doc_id", text.word_count("text").alias("words"))


@query(r"""SELECT page_id, trim(regexp_replace(list_reduce(list_prepend(replace(replace(html, chr(13) || chr(10), chr(10)), chr(13), chr(10)), ['br', 'u', 'b', 'i', 'em', 'strong', 'center', 'sup', 'sub', 'p']), lambda x, tag: regexp_replace(x, '(?i)</?' || tag || '\s*/?>', '', 'g')), '\n([ \t]*\n){2,}', chr(10) || chr(10), 'g'), chr(32) || chr(9) || chr(10)) AS cleaned FROM pages""")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inline tags out, line ends and blank lines evened."""
    return table(spark, sf_dir, "pages").select("page_id", text.clean("html").alias("cleaned"))


@query("SELECT doc_id, sha256(text || '|' || source) AS source_hash, sha256(text) AS body_hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of source and body."""
    return _d(spark, sf_dir).select("doc_id", F.sha2(F.concat("text", F.lit("|"), "source"), 256).alias("source_hash"), F.sha2("text", 256).alias("body_hash"))


#: Markdown is made of texts in both: a title line, a heading before each third line, and an appendix.
MADE = """md AS (SELECT doc_id, '# Title ' || doc_id || chr(10) || '## Body' || chr(10) || array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i % 3 = 2 THEN '## Part ' || i || chr(10) ELSE '' END || x), chr(10)) || chr(10) || '## Appendix' || chr(10) || 'rest' AS md FROM documents)"""


def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.when((i + 1) % 3 == 2, F.concat(F.lit("## Part "), i + 1, F.lit("\n"))).otherwise(""), x))
    md = F.concat(F.lit("# Title "), "doc_id", F.lit("\n## Body\n"), F.array_join(lines, "\n"), F.lit("\n## Appendix\nrest"))
    return _d(spark, sf_dir).select("doc_id", md.alias("md"))


@query(f"WITH {MADE} SELECT doc_id, heading, n::INT AS n FROM (SELECT doc_id, unnest(h) AS heading, generate_subscripts(h, 1) - 1 AS n FROM (SELECT doc_id, regexp_extract_all(md, '(?m)^##[ \\t]+([^\\r\\n]+)', 1) AS h FROM md))")
def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level-two headings in order."""
    return _markdown(spark, sf_dir).select("doc_id", F.posexplode(text.headings("md")).alias("n", "heading"))


@query(f"WITH {MADE} SELECT doc_id, 'Title ' || doc_id AS title, substr(md, strpos(md, '## Body') + 8, length(md) - strpos(md, '## Body') - 7 - length(chr(10) || '## Appendix' || chr(10) || 'rest')) AS body FROM md")
def body_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and body of Markdown, without the appendix."""
    return _markdown(spark, sf_dir).select("doc_id", text.title("md").alias("title"), text.body("md").alias("body"))


@query(f"WITH {MADE} SELECT doc_id, n::INT AS n, section FROM (SELECT doc_id, unnest(s) AS section, generate_subscripts(s, 1) - 1 AS n FROM (SELECT doc_id, string_split(md, chr(10) || '## ') AS s FROM md))")
def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown split at its headings."""
    return _markdown(spark, sf_dir).select("doc_id", F.posexplode(F.split("md", "\n## ")).alias("n", "section"))


#: Lines with what the heading contract forbids, in most documents none or one kind.
_BROKEN = ("## **bold**", "## __under__", "## `code`", "## [link](u)", "## plain **part**", "## **a** and **b**", "# one", "### three", "note[^1]", "##no heading", "## [note][^2]")


@query(r"""WITH lines AS (SELECT doc_id, unnest(string_split(text || chr(10) || coalesce((['""" + "', '".join(_BROKEN) + r"""'])[doc_id % 17 + 1], ''), chr(10))) AS l FROM documents),
judged AS (SELECT doc_id, l, trim(regexp_extract(l, '^##[ \t]+(.+)$', 1)) AS t FROM lines),
marks AS (SELECT *, EXISTS (SELECT 1 FROM (VALUES ('**'), ('__'), ('`')) v(m) WHERE length(t) > 2 * length(m) AND starts_with(t, m) AND ends_with(t, m) AND NOT contains(t[length(m) + 1 : length(t) - length(m)], m)) AS wrapped FROM judged),
first_other AS (SELECT doc_id, min_by(l, n) AS l FROM (SELECT doc_id, l, row_number() OVER (PARTITION BY doc_id) AS n FROM (SELECT doc_id, l FROM lines WHERE regexp_matches(l, '^(#|###+)[ \t]'))) GROUP BY doc_id)
SELECT doc_id, CASE WHEN any_value(f.l) IS NOT NULL THEN CASE WHEN starts_with(any_value(f.l), '##') THEN 'deep heading' ELSE 'level-one heading' END WHEN bool_or(contains(m.l, '[^')) THEN 'footnote' WHEN bool_or(contains(t, '](')) THEN 'link in heading' WHEN bool_or(wrapped) THEN 'emphasised heading' END AS violation
FROM marks m LEFT JOIN first_other f USING (doc_id) GROUP BY doc_id""")
def contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a text, with a line that may break it, breaks the heading contract."""
    more = F.get(F.array(*map(F.lit, _BROKEN)), (F.col("doc_id") % 17).cast("int"))
    return _d(spark, sf_dir).select("doc_id", text.contract_violation(F.concat("text", F.coalesce(F.concat(F.lit("\n"), more), F.lit("\n")))).alias("violation"))


@query(f"WITH {MADE}, cut AS (SELECT doc_id, string_split(md, chr(10)) AS l FROM md), placed AS (SELECT doc_id, l[i] AS line, coalesce(list_sum(list_transform(l[1 : i - 1], lambda x: length(x) + 1)), 0) AS place FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM cut)) SELECT doc_id, place::INT AS place, trim(substr(line, 4)) AS title FROM placed WHERE regexp_matches(line, '^##[ \\t]+[^ ]')")
def heading_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level-two headings with their places."""
    return _markdown(spark, sf_dir).select("doc_id", F.explode(text.heading_places("md")).alias("h")).select("doc_id", "h.place", "h.title")


@query(r"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '2024-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') WHEN 1 THEN '2023-05-06' END AS published, CASE WHEN doc_id % 3 = 0 THEN '2024-02-29' WHEN doc_id % 3 = 1 AND doc_id % 2 = 0 THEN '2023-12-01' END AS lastmod,
CASE WHEN length(h) > 12 THEN left(h, 12) || '…' ELSE h END AS label FROM (SELECT doc_id, 'Part ' || doc_id || ' of the source ' || source AS h FROM documents)""")
def header_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of header lines and of site maps, and labels of sections."""
    k, day = F.col("doc_id"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")
    head = F.when(k % 4 == 0, F.concat(F.lit("# T\nPublished 2024-01-"), day, F.lit(" | [a](u)\n"))).when(k % 4 == 1, F.lit("Published 2023-05-06\r\n")).when(k % 4 == 2, F.lit("Published 2023-05-06 in prose\n")).otherwise(F.lit("**Published** 2023-05-06\n"))
    stamp = F.when(k % 3 == 0, "2024-02-29T10:00:00Z").when((k % 3 == 1) & (k % 2 == 0), "2023-12-01").when(k % 3 == 1, "2023-02-30").otherwise("soon")
    label = text.section_label(F.concat(F.lit("[**Part "), k, F.lit("**](u)  of the `source` "), "source"))
    return _d(spark, sf_dir).select("doc_id", text.publication_date(F.concat(head, "text")).alias("published"), text.valid_date(stamp).cast("string").alias("lastmod"), label.alias("label"))


@query()
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all texts; lines part paragraphs here."""
    sizes = chunking.Sizes(target=200, most=300, least=10, overlap=30, paragraphs=r"\n")
    return chunking.chunks(_d(spark, sf_dir), sizes).select("chunk_id", "doc_id", "chunk_index", "word_count", F.sha2("text", 256).alias("text_hash"))


@query()
def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors of each page's headings, repeats numbered."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract_all("html", F.lit("(?is)<h[1-6][^>]*>(.*?)</h[1-6]>"), F.lit(1)).alias("h"))
    return pages.select("page_id", F.posexplode(a.anchors("h")).alias("n", "anchor"))


VISIBLE = r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', '', 'g'), '(?i)<(br|/p|/div|/li|/tr|/h1)[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g'), '[ \t\r\n]+', ' ', 'g'), ' ') AS visible FROM pages"""


@query(VISIBLE)
def visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a page shows, white space collapsed (entities stay)."""
    bare = F.regexp_replace("html", "(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", "")
    broken = F.regexp_replace(F.regexp_replace(bare, "(?i)<(br|/p|/div|/li|/tr|/h1)[^>]*>", "\n"), "<[^>]*>", "")
    return table(spark, sf_dir, "pages").select("page_id", text.squeezed(broken).alias("visible"))


@query(r"SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_matches(url, '\.md$') AS is_document FROM pages")
def link_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scheme and host of page addresses, and whether they are documents."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"), F.col("url").rlike(r"\.md$").alias("is_document"))


@query(r"SELECT doc_id, replace(source || '/' || lang || '/' || doc_id, '/', '_') AS slug, source AS channel FROM documents")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slug and channel of a document's address."""
    uri = F.concat("source", F.lit("/"), "lang", F.lit("/"), "doc_id", F.lit(".md"))
    return _d(spark, sf_dir).select("doc_id", text.slug(uri).alias("slug"), F.split(uri, "/")[0].alias("channel"))


@query(r"""SELECT doc_id, CASE WHEN length(s) > 160 THEN left(s, 160) || '…' ELSE s END AS excerpt FROM (SELECT doc_id, trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g'), ' ') AS s FROM documents)""")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 160 characters, white space collapsed."""
    return _d(spark, sf_dir).select("doc_id", text.excerpt("text").alias("excerpt"))


_DIGITS = " || ".join(f"substr('{a.BASE58}', (n // {58**k} % 58 + 1)::INT, 1)" for k in range(7, -1, -1))


@query(f"SELECT page_id, {_DIGITS} AS short_id FROM (SELECT page_id, ('0x' || left(sha256(url), 12))::BIGINT AS n FROM pages)")
def short_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short ids of page addresses."""
    return table(spark, sf_dir, "pages").select("page_id", a.short_ids("url").alias("short_id"))


@query("SELECT doc_id, lang, n_chars FROM documents WHERE n_chars BETWEEN 100 AND 5000 AND (source LIKE 'src1%' OR source = 'src0') AND NOT source LIKE '%2'")
def scan_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Include and exclude patterns and size bounds of a scan."""
    from lexarium.sources.files import matching

    return matching(_d(spark, sf_dir).select("doc_id", "lang", "n_chars", "source"), "source", "n_chars", ["src1*", "src0"], ["*2"], 100, 5000).select("doc_id", "lang", "n_chars")


@query()
def search_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain text of Markdown by section, with the sections' places in it."""
    from lexarium.operators.projection import search_documents

    found = search_documents(_markdown(spark, sf_dir).withColumnRenamed("md", "text"))
    return found.select("doc_id", F.length("body_text").alias("n_chars"), F.posexplode("sections").alias("n", "section")).select("doc_id", "n_chars", "n", "section.start", "section.end", "section.heading", "section.anchor")


@query("SELECT doc_id, source AS channel, 'Doc ' || doc_id AS title FROM documents")
def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a header made of columns, read back."""
    from lexarium.operators.projection import front_matter as read

    made = F.concat(F.lit("---\ntitle: \"Doc "), "doc_id", F.lit("\"\nchannel: "), "source", F.lit("\n---\n"), "text")
    keys = _d(spark, sf_dir).select("doc_id", read(made).alias("m"))
    return keys.select("doc_id", F.col("m")["channel"].alias("channel"), F.col("m")["title"].alias("title"))
