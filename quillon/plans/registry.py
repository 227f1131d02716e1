"""Registered queries of the engine's own operators and the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import constants as C
from quillon.functions import markdown as M
from quillon.functions import text as X
from quillon.operators import fetch, index, resolve, search, sections, status
from quillon.plans import build
from quillon.plans import corpus as P
from quillon.sources import links, openapi, publish
from quillon.sources import pages as sources

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
BASE = f"WITH {P.DOCS}, {P.TOKENIZED}"
SITE = links.Site("www.example.com", "/p/")


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def one(spark: SparkSession, *texts: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")


def asked_sql(*texts: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(texts)) + ") v(query_id, query)"


def top(found: DataFrame) -> DataFrame:
    return found.select("query_id", "place", "id", "kind", F.round("score", 6).alias("score"))


BUILT: dict[tuple[str, str], index.Index] = {}


def built(spark, d) -> index.Index:
    """The index of a folder's documents: built and saved at the first query of an application, opened by later ones."""
    key = (spark.sparkContext.applicationId, d)
    if key not in BUILT:
        BUILT[key] = index.build_index(P.documents(spark, d))
    return BUILT[key]


# --- tokens and index ---


@query(f"""{BASE}, {P.POSTED}, {P.MEASURED} SELECT 'docs' AS name, count(*) AS n, CAST(sum(doc_pos) AS BIGINT) AS mark FROM docs UNION ALL SELECT 'postings', count(*), CAST(sum(weight) AS BIGINT) FROM post
UNION ALL SELECT 'terms', count(*), CAST(sum(df) AS BIGINT) FROM terms UNION ALL SELECT 'doc_stats', count(*), CAST(sum(length) AS BIGINT) FROM stats""")
def index_build(spark, d):
    """A fresh index, built and saved, and what its tables hold."""
    made = index.build_index(P.documents(spark, d))
    marks = {"docs": "doc_pos", "postings": "weight", "terms": "df", "doc_stats": "length"}
    parts = [getattr(made, t).agg(F.lit(t).alias("name"), F.count("*").alias("n"), F.sum(c).cast("long").alias("mark")) for t, c in marks.items()]
    return reduce(DataFrame.union, parts)


@query(f"{BASE} SELECT doc_pos, CAST(len(body) AS BIGINT) AS n_tokens, CAST(len(list_distinct(body)) AS BIGINT) AS n_distinct, md5(array_to_string(body, ' ')) AS digest FROM tok")
def token_counts(spark, d):
    return index.tokenized(P.documents(spark, d)).select(
        "doc_pos", F.size("body").cast("long").alias("n_tokens"), F.size(F.array_distinct("body")).cast("long").alias("n_distinct"), F.md5(F.array_join("body", " ").cast("binary")).alias("digest")
    )


@query(f"{BASE}, {P.POSTED} SELECT doc_pos, term, weight FROM post")
def term_postings(spark, d):
    return index.postings(P.documents(spark, d))


@query(f"{BASE}, {P.POSTED} SELECT term, df FROM terms")
def document_frequency(spark, d):
    return index.term_stats(index.postings(P.documents(spark, d)))


@query(f"{BASE}, {P.MEASURED} SELECT doc_pos, length, round(ratio, 9) AS ratio FROM meas")
def doc_lengths(spark, d):
    return index.measured(P.documents(spark, d)).select("doc_pos", "length", F.round("ratio", 9).alias("ratio"))


@query(f"{BASE}, {P.MEASURED} SELECT kind, round(median, 9) AS median FROM med")
def kind_upper_median(spark, d):
    found = index.upper_median(index.measured(P.documents(spark, d)), "kind", "ratio")
    return found.select("kind", F.round("median", 9).alias("median"))


@query(f"{BASE}, {P.MEASURED} SELECT doc_pos, length, round(norm_length, 5) AS norm_length FROM stats")
def norm_length(spark, d):
    return index.doc_stats(P.documents(spark, d)).select("doc_pos", "length", F.round("norm_length", 5).alias("norm_length"))


@query(f"{BASE}, {P.MEASURED} SELECT n, round(avg_length, 6) AS avg_length FROM corpus")
def corpus_stats(spark, d):
    return index.corpus_stats(index.doc_stats(P.documents(spark, d))).select("n", F.round("avg_length", 6).alias("avg_length"))


DAMAGE = {
    "postings": ("doc_pos % 97 = 0 AND weight >= 3", "doc_pos, term, weight"), "empty": ("doc_pos % 89 = 1", "doc_pos, '' AS term, 1 AS weight"), "weightless": ("doc_pos % 83 = 2", "doc_pos, '#none' AS term, 0 AS weight"),
    "orphans": ("doc_pos % 79 = 3", "-doc_pos - 1 AS doc_pos, 'stray' AS term, 2 AS weight"), "twice": ("doc_pos % 73 = 4", "doc_pos, length, norm_length"),
}
LENGTH, NORM = "CASE WHEN doc_pos % 71 = 5 THEN length + 1 ELSE length END", "CASE WHEN doc_pos % 67 = 6 THEN -1.0 ELSE norm_length END"


def damage_sql(name: str, table: str) -> str:
    return "SELECT {1} FROM {2} WHERE {0}".format(*DAMAGE[name], table)


@query(f"""{BASE}, {P.POSTED}, {P.MEASURED}, p AS (SELECT doc_pos, term, weight FROM post UNION ALL {damage_sql("postings", "post")} UNION ALL {damage_sql("empty", "stats")} UNION ALL {damage_sql("weightless", "stats")} UNION ALL {damage_sql("orphans", "stats")}),
    s AS (SELECT doc_pos, {LENGTH} AS length, {NORM} AS norm_length FROM (SELECT doc_pos, length, norm_length FROM stats UNION ALL {damage_sql("twice", "stats")})), sums AS (SELECT doc_pos, sum(weight) AS total FROM p GROUP BY doc_pos)
    SELECT 'duplicate_posting' AS "check", count(*) AS violations FROM (SELECT 1 FROM p GROUP BY doc_pos, term HAVING count(*) > 1) UNION ALL SELECT 'empty_term', count(*) FROM p WHERE term IS NULL OR term = ''
    UNION ALL SELECT 'weight_below_one', count(*) FROM p WHERE weight < 1 UNION ALL SELECT 'orphan_posting', count(*) FROM p WHERE doc_pos NOT IN (SELECT doc_pos FROM s)
    UNION ALL SELECT 'duplicate_document', count(*) FROM (SELECT 1 FROM s GROUP BY doc_pos HAVING count(*) > 1) UNION ALL SELECT 'length_differs', count(*) FROM s LEFT JOIN sums USING (doc_pos) WHERE length <> coalesce(total, 0)
    UNION ALL SELECT 'bad_norm', count(*) FROM s WHERE norm_length IS NULL OR norm_length < 0""")
def index_integrity(spark, d):
    """The checks on an index that is damaged in seven ways."""
    sound = built(spark, d)
    stats = sound.doc_stats.select("doc_pos", "length", "norm_length")
    hurt = {name: (sound.postings if name == "postings" else stats).where(where).selectExpr(*columns.split(", ")) for name, (where, columns) in DAMAGE.items()}
    posted = reduce(DataFrame.unionByName, [sound.postings.select("doc_pos", "term", "weight"), *(hurt[n] for n in ("postings", "empty", "weightless", "orphans"))])
    twice = stats.unionByName(hurt["twice"]).selectExpr("doc_pos", f"{LENGTH} AS length", f"{NORM} AS norm_length")
    return index.index_problems(index.Index(sound.docs, posted, twice, sound.corpus_stats, sound.terms))


@query(f"SELECT item_id, array_to_string({X.sql_query_tokens('text')}, ' ') AS terms FROM benchmark")
def query_tokens(spark, d):
    return P.table(spark, d, "benchmark").select("item_id", F.array_join(X.query_tokens(F.col("text")), " ").alias("terms"))


# --- search ---


def run_search(*texts: str, k: int = C.DEFAULT_K, kind: str = ""):
    def run(spark, d):
        return top(search.search_many(built(spark, d), one(spark, *texts), k, kind))

    return run


SEARCHES = {
    "bm25_search": (("tion stable",), {"k": 20}),
    "bm25_kind_filter": (("tion stable und",), {"k": 10, "kind": "de"}),
    "bm25_id_query": (("doc-7",), {"k": 20}),
    "bm25_prefix": (("dieer unden chtig",), {"k": 20}),
    "bm25_stopwords_only": (("there where",), {"k": 10}),
    "bm25_no_match": (("qqqqq zzzzz",), {"k": 5}),
}
for name, (texts, more) in SEARCHES.items():
    QUERIES[name] = run_search(*texts, **more)
    ORACLE_SQL[name] = P.search_sql(asked_sql(*texts), **more)

TITLES = "SELECT item_id AS query_id, split_part(text, '.', 1) AS query FROM benchmark"


@query(P.search_sql(TITLES, 5))
def bm25_title_boost(spark, d):
    asked = P.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.split_part("text", F.lit("."), F.lit(1)).alias("query"))
    return top(search.search_many(built(spark, d), asked, 5))


@query(P.search_sql("SELECT item_id AS query_id, text AS query FROM benchmark", 5))
def search_many(spark, d):
    asked = P.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return top(search.search_many(built(spark, d), asked, 5))


@query(P.search_sql(asked_sql("tion stable und", "dieer"), 20, columns="query_id, id, matched, lookups"))
def query_coverage(spark, d):
    found = search.search_many(built(spark, d), one(spark, "tion stable und", "dieer"), 20)
    return found.select("query_id", "id", "matched", F.array_join("lookups", " ").alias("lookups"))


@query(f"{BASE}, {P.POSTED}, asked AS (SELECT unnest(['dieer', 'unden', 'chtig', 'thera']) AS term), {P.PREFIX_SQL} SELECT term, lookup, lookup_df, place FROM expanded")
def prefix_expansion(spark, d):
    terms = built(spark, d).terms
    return search.expand_prefix(spark.createDataFrame([(t,) for t in ("dieer", "unden", "chtig", "thera")], "term string"), terms)


ROUNDED = P.search_sql(asked_sql("tion stable"), 10, columns="id, kind, title, round(score, 4) AS score")


@query(ROUNDED)
def search_rounded(spark, d):
    """The single-query form without its snippets."""
    return search.search(spark, built(spark, d), "  tion stable\t", 10).select("id", "kind", "title", "score")


@query(P.search_sql(asked_sql("tion stable"), C.DEFAULT_K, columns="id, title"))
def search_docs_ids(spark, d):
    """The public form without its snippets."""
    return search.search_docs(spark, built(spark, d), "tion stable", "no number").select("id", "title")


@query()
def search_with_snippets(spark, d):
    return search.search(spark, built(spark, d), "tion stable", 10)


@query()
def search_docs(spark, d):
    return search.search_docs(spark, built(spark, d), "tion stable", "garbage")


# --- text ---


SQUEEZED = "trim(regexp_replace(text, '[ \t\n]+', ' ', 'g'))"


def snippet_sql(t: str, terms: list[str], limit: int) -> str:
    lead = f"(pos - {limit // 3})"
    return f"""WITH s AS (SELECT doc_id, {t} AS t FROM documents), a AS (SELECT doc_id, t, coalesce(least({', '.join(f"nullif(instr(lower(t), '{x}'), 0)" for x in terms)}), 0) - 1 AS pos FROM s),
    b AS (SELECT doc_id, t, pos, length(regexp_extract(left(t, greatest({lead}, 0)), '(?s)^(.* )', 1)) AS back FROM a),
    c AS (SELECT doc_id, t, pos, CASE WHEN back > 0 THEN back ELSE {lead} END AS start FROM b)
    SELECT doc_id, CASE WHEN pos <= {limit // 3} THEN {X.sql_truncate('t', limit)} ELSE '...' || CASE WHEN length(t) > start + {limit} THEN regexp_replace(substr(t, start + 1, {limit}), '(?s) [^ ]*$', '') || '...' ELSE substr(t, start + 1, {limit}) END END AS snippet FROM c"""


@query(snippet_sql(SQUEEZED, ["stable", "erheit"], C.SNIPPET_CHARS))
def plain_snippet(spark, d):
    text = F.trim(F.regexp_replace("text", "[ \t\n]+", " "))
    return P.table(spark, d, "documents").select("doc_id", text.alias("t")).select("doc_id", X.plain_snippet(F.col("t"), ["stable", "erheit"], C.SNIPPET_CHARS).alias("snippet"))


@query(f"SELECT doc_id, {X.sql_truncate('text', C.SUMMARY_CHARS)} AS short FROM documents")
def truncate_text(spark, d):
    return P.table(spark, d, "documents").select("doc_id", X.truncate(F.col("text"), C.SUMMARY_CHARS).alias("short"))


@query("SELECT page_id, md5(regexp_replace(html, '(?s)<!--.*?-->', '', 'g')) AS digest, CAST(length(regexp_replace(html, '(?s)<!--.*?-->', '', 'g')) AS BIGINT) AS n FROM pages")
def strip_comments(spark, d):
    out = X.strip_closed_comments(F.col("html"))
    return P.table(spark, d, "pages").select("page_id", F.md5(out.cast("binary")).alias("digest"), F.length(out).cast("long").alias("n"))


# documents' letters, commas and ends of sentences, without abbreviations: text on which markup is what these queries add
PLAIN = r"trim(regexp_replace(regexp_replace(text, '[^A-Za-z ,.!?\n]', '', 'g'), '(?i)\b(no|vs|etc|fig|approx)\.', '\1', 'g'), ' ')"
SQUEEZE = r"trim(regexp_replace({0}, '[ \n]+', ' ', 'g'))"


def plain_documents(spark, d):
    """doc_id, plain and words (plain with single spaces)."""
    plain = F.trim(F.regexp_replace(F.regexp_replace("text", r"[^A-Za-z ,.!?\n]", ""), r"(?i)\b(no|vs|etc|fig|approx)\.", "$1"))
    return P.table(spark, d, "documents").select("doc_id", plain.alias("plain")).select("doc_id", "plain", F.trim(F.regexp_replace("plain", r"[ \n]+", " ")).alias("words"))


PLAIN_DOCS = f"pd AS (SELECT doc_id, plain, {SQUEEZE.format('plain')} AS words FROM (SELECT doc_id, {PLAIN} AS plain FROM documents))"
SENTENCE = r"CASE WHEN regexp_matches(line, '^.{25,}?[.!?](\s|$)') THEN regexp_extract(line, '^(.{25,}?[.!?])(\s|$)', 1) ELSE line END"


@query(f"""WITH {PLAIN_DOCS}, l AS (SELECT doc_id, unnest(string_split(plain, chr(10))) AS raw, generate_subscripts(string_split(plain, chr(10)), 1) AS pos FROM pd), q AS (SELECT doc_id, pos, {SQUEEZE.format('raw')} AS line FROM l),
    f AS (SELECT doc_id, arg_min(line, pos) AS line FROM q WHERE length(line) >= 3 GROUP BY doc_id), s AS (SELECT doc_id, {SENTENCE} AS sentence FROM f)
    SELECT pd.doc_id, coalesce({X.sql_truncate('sentence', C.SUMMARY_CHARS)}, '') AS summary FROM pd LEFT JOIN s USING (doc_id)""")
def summaries(spark, d):
    """Summaries of pages that hide a heading, code and a table before their prose."""
    page = F.concat(F.lit("# Heading\n```\n# code\n```\n~~~\nmore code\n~~~\n| a | b |\n--- \n"), "plain")
    return plain_documents(spark, d).select("doc_id", M.summary(page).alias("summary"))


@query(f"WITH {PLAIN_DOCS} SELECT doc_id, trim(words || ' see ' || words || ' or a<b ' || words || ' x * y snake_case_name *star* <tag> [open') AS plain FROM pd WHERE words <> ''")
def flattened(spark, d):
    """Text wrapped in every kind of inline markup."""
    wrapped = F.concat(
        F.lit("> - ![" ), "words", F.lit("](pic.png) **see** [*"), "words", F.lit("*](https://x.y/z) or a<b <b class='k'>"), "words",
        F.lit("</b><!-- hidden --> _x_ * y `snake_case_name` \\*star\\* <tag> [open"),
    )
    return plain_documents(spark, d).where("words <> ''").select("doc_id", M.flat(wrapped).alias("plain"))


BODY = "'Kept. ' || words"


@query(f"WITH {PLAIN_DOCS} SELECT doc_id, CASE WHEN doc_id % 10 = 7 THEN NULL ELSE {BODY} || chr(10) || '| A |' || chr(10) || '| --- |' || chr(10) || '| ' || doc_id || ' |' || chr(10) || chr(10) || '<<NAME>>, ok' END AS body, CASE WHEN doc_id % 10 = 7 THEN '' ELSE '2024-01-01' END AS updated_at FROM pd")
def cleaned_pages(spark, d):
    """Raw pages with front matter, boilerplate, comments, a block, variables and navigation; every tenth is HTML."""
    raw = F.concat(
        F.lit("---\r\ntitle: x\r\nupdatedAt: 2024-01-01\r\n---\r\n" + M.BOILERPLATE + " u\r\n\r\n<!-- a\nb -->"), F.lit("Kept. "), "words", F.lit("<!-- c -->\n"),
        F.concat(F.lit('[block:parameters]{"data":{"h-0":"A","0-0":'), "doc_id", F.lit("}}[/block]\n\n<<NAME>><<DASH>>ok\n\n## Sub pages\n- [x](y)\n\n## Sibling pages\n\n* [z](w)\n")),
    )
    page = F.when(F.col("doc_id") % 10 == 7, F.concat(F.lit(" <!DOCTYPE html>"), raw)).otherwise(raw)
    return plain_documents(spark, d).select("doc_id", M.cleaned(page, {"DASH": ", "}).alias("page")).select("doc_id", "page.body", "page.updated_at")


@query("SELECT page_id, trim(regexp_extract('# ' || split_part(url, '/', 3) || CASE WHEN page_id % 3 = 0 THEN ' ##' WHEN page_id % 3 = 1 THEN '##' ELSE '' END, '^# (.*?)( ##)?$', 1)) AS title FROM pages")
def closing_hashes(spark, d):
    """Heading titles with closing hashes, and with hashes that belong to them."""
    line = F.concat(F.lit("# "), F.split_part("url", F.lit("/"), F.lit(3)), F.when(F.col("page_id") % 3 == 0, " ##").when(F.col("page_id") % 3 == 1, "##").otherwise(""))
    return P.table(spark, d, "pages").select("page_id", F.get(M.headings(line)["headings"], F.lit(0))["title"].alias("title"))


# --- addresses and links ---

OK_URL = r"regexp_full_match(url, 'https://www\.example\.com/p/[^/?#%\s]+') AND NOT contains(substr(url, 27), '..') AND length(url) <= 1024"
SLUG = "regexp_replace(substr(url, 27), '\\.md$', '')"
OK_SLUG = "regexp_full_match({0}, '[A-Za-z0-9][A-Za-z0-9._-]*') AND NOT contains({0}, '..') AND length({0}) <= 256"


def urls(spark, d):
    """The pages' addresses, each also below the site of these queries."""
    host = F.regexp_replace("url", r"\Ahttps?://[^/]+/", SITE.base)
    pages = P.table(spark, d, "pages")
    return pages.select("page_id", "url").union(pages.select((F.col("page_id") + 1_000_000_000), host)).union(pages.select((F.col("page_id") + 2_000_000_000), F.concat(F.lit(SITE.base + "page-"), "page_id", F.lit(".md"))))


URLS = r"u AS (SELECT page_id, url FROM pages UNION ALL SELECT page_id + 1000000000, regexp_replace(url, '^https?://[^/]+/', 'https://www.example.com/p/') FROM pages UNION ALL SELECT page_id + 2000000000, 'https://www.example.com/p/page-' || page_id || '.md' FROM pages)"


@query(f"WITH {URLS} SELECT page_id, {OK_URL} AS ok FROM u")
def url_predicates(spark, d):
    return urls(spark, d).select("page_id", links.is_page_url(F.col("url"), SITE).alias("ok"))


@query(f"WITH {URLS} SELECT page_id, CASE WHEN ({OK_URL}) AND {OK_SLUG.format(SLUG)} THEN {SLUG} END AS slug FROM u")
def url_slug(spark, d):
    return urls(spark, d).select("page_id", links.slug_of(F.col("url"), SITE).alias("slug"))


@query(f"WITH {URLS}, l AS (SELECT page_id AS pos, {SLUG} AS slug, url FROM u WHERE ({OK_URL}) AND {OK_SLUG.format(SLUG)}), f AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY pos) AS rn FROM l) SELECT slug, 'Page ' || pos AS title, 'https://www.example.com/p/' || slug || '.md' AS url, 'from ' || pos AS description FROM f WHERE rn = 1")
def link_list(spark, d):
    line = F.concat(F.lit("- [Page "), "page_id", F.lit("]("), "url", F.lit("): from "), "page_id")
    return links.parse_links(urls(spark, d).select(F.col("page_id").alias("pos"), line.alias("value")), SITE)


@query("SELECT host, page_id, url FROM (SELECT regexp_extract(url, '://([^/]+)', 1) AS host, page_id, url, row_number() OVER (PARTITION BY regexp_extract(url, '://([^/]+)', 1) ORDER BY page_id) AS rn FROM pages) WHERE rn = 1")
def first_occurrence(spark, d):
    return links.first_of(P.table(spark, d, "pages").select(F.regexp_extract("url", "://([^/]+)", 1).alias("host"), "page_id", "url"), "host", "page_id")


@query(f"WITH {URLS}, f AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '#.*$', ''), '/$', '') AS u FROM (SELECT page_id, url || '/#part' AS url FROM u WHERE url LIKE 'https://www.example.com/%' UNION ALL SELECT page_id, ' page-' || page_id || '.md ' FROM pages)), g AS (SELECT page_id, u AS url, u LIKE 'http%' AS full_url FROM f) SELECT page_id, CASE WHEN full_url THEN CASE WHEN ({OK_URL}) AND {OK_SLUG.format(SLUG)} THEN {SLUG} END ELSE regexp_replace(trim(url), '\\.md$', '') END AS slug FROM g")
def normalized_ids(spark, d):
    """Addresses with a fragment and a slash, and file names with blanks around them, as slugs."""
    full = urls(spark, d).where(F.startswith("url", F.lit("https://www.example.com/"))).select("page_id", F.concat("url", F.lit("/#part")).alias("raw"))
    names = P.table(spark, d, "pages").select("page_id", F.concat(F.lit(" page-"), "page_id", F.lit(".md ")).alias("raw"))
    return full.union(names).select("page_id", links.page_id(F.col("raw"), SITE).alias("slug"))


# --- sections ---

FOLDED = "f AS (SELECT conv_id AS doc_id, '# Conversation ' || conv_id || chr(10) || string_agg('## Turn ' || turn || ' ' || role || chr(10) || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"
HEADS = "h AS (SELECT doc_id, line, length(regexp_extract(value, '^(#+)', 1)) AS level, trim(regexp_replace(value, '^#+', '')) AS title FROM (SELECT doc_id, unnest(range(len(ls))) AS line, unnest(ls) AS value FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM f)) WHERE regexp_matches(value, '^#{1,6}[ \t]+\\S')), n AS (SELECT doc_id, len(string_split(text, chr(10))) AS n_lines FROM f)"


def folded(spark, d):
    """Each conversation as a markdown page with a heading per turn."""
    turn = F.concat(F.lit("## Turn "), "turn", F.lit(" "), "role", F.lit("\n"), "text")
    grouped = P.table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", turn.alias("part")))).alias("parts"))
    return grouped.select(F.col("conv_id").alias("doc_id"), F.lit("").alias("title"), F.concat(F.lit("# Conversation "), "conv_id", F.lit("\n"), F.array_join(F.transform("parts", lambda p: p["part"]), "\n")).alias("text"))


@query(f"WITH {FOLDED}, {HEADS} SELECT h.doc_id, h.line, CAST(h.level AS BIGINT) AS level, h.title, CAST(coalesce(min(g.line), any_value(n.n_lines)) AS BIGINT) AS end_line FROM h JOIN n USING (doc_id) LEFT JOIN h g ON g.doc_id = h.doc_id AND g.line > h.line AND g.level <= h.level GROUP BY ALL")
def sections_from_headings(spark, d):
    spans = sections.heading_spans(*sections.heading_rows(folded(spark, d)))
    return spans.select("doc_id", F.col("line").cast("long").alias("line"), F.col("level").cast("long").alias("level"), "title", F.col("end_line").cast("long").alias("end_line"))


@query(f"WITH {FOLDED}, {HEADS}, s AS (SELECT doc_id, line, title, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS rn, lead(line) OVER (PARTITION BY doc_id ORDER BY line) AS nxt FROM h WHERE level = 2) SELECT s.doc_id, CAST(rn AS VARCHAR) AS section_id, s.title, md5(regexp_replace(array_to_string(string_split(f.text, chr(10))[line + 1 : coalesce(nxt, n_lines)], chr(10)), '^\n+|\n+$', '', 'g')) AS digest FROM s JOIN f USING (doc_id) JOIN n USING (doc_id)")
def section_text(spark, d):
    rows = sections.section_rows(sections.pages(folded(spark, d)))
    return rows.select("doc_id", "section_id", "title", F.md5(F.col("text").cast("binary")).alias("digest"))


TOC_ROWS = "s AS (SELECT doc_id, line, title, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS rn, lead(line) OVER (PARTITION BY doc_id ORDER BY line) AS nxt FROM h WHERE level = 2), b AS (SELECT s.doc_id, CAST(rn AS VARCHAR) AS id, s.title, regexp_replace(array_to_string(string_split(f.text, chr(10))[line + 2 : coalesce(nxt, n_lines)], chr(10)), '^\n+|\n+$', '', 'g') AS body FROM s JOIN f USING (doc_id) JOIN n USING (doc_id))"


@query(f"WITH {FOLDED}, {HEADS}, {TOC_ROWS} SELECT doc_id, id, title, CASE WHEN octet_length(encode(body)) < {C.INLINE_BYTES} AND trim(body, chr(10) || chr(9) || ' ') <> '' THEN body END AS content FROM b")
def toc(spark, d):
    """The tables of contents, a row for each entry, short sections with their text."""
    entry = "array<struct<id string, title string, content string>>"
    return sections.pages(folded(spark, d)).select("doc_id", F.inline(F.from_json("toc", entry)))


NESTED = "f AS (SELECT conv_id AS doc_id, string_agg(repeat('#', CAST(2 + turn % 3 AS INT)) || ' T' || turn || chr(10) || CASE WHEN turn % 3 = 1 THEN '````' || chr(10) || '# in code' || chr(10) || '````' || chr(10) ELSE '' END, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id)"


@query("WITH h AS (SELECT conv_id AS doc_id, turn, 2 + turn % 3 AS level, sum(CASE WHEN turn % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations WHERE turn > 0 OR conv_id IN (SELECT conv_id FROM conversations GROUP BY conv_id HAVING max(turn) > 2)), "
       "g AS (SELECT *, CASE level WHEN 2 THEN CAST(a AS VARCHAR) WHEN 3 THEN a || '.1' ELSE a || '.1.1' END AS section_id FROM h WHERE a > 0) SELECT doc_id, section_id, CASE level WHEN 2 THEN NULL WHEN 3 THEN CAST(a AS VARCHAR) ELSE a || '.1' END AS parent_id, CAST(level AS BIGINT) AS level, 'T' || turn AS title FROM g")
def nested_sections(spark, d):
    """Sections three deep, with headings inside longer code fences that are none. A page whose first heading stands alone
    at the top has it as its title, so short conversations start below it and are left out here."""
    line = F.concat(F.repeat(F.lit("#"), (F.col("turn") % 3 + 2).cast("int")), F.lit(" T"), "turn", F.lit("\n"), F.when(F.col("turn") % 3 == 1, "````\n# in code\n````\n").otherwise(""))
    turns = P.table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("part")))).alias("parts"))
    docs = turns.where(F.size("parts") > 3).select(F.col("conv_id").alias("doc_id"), F.lit("").alias("title"), F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("text"))
    return sections.section_rows(sections.pages(docs)).select("doc_id", "section_id", "parent_id", F.col("level").cast("long").alias("level"), "title")


@query(f"WITH {FOLDED}, {HEADS}, s AS (SELECT doc_id, title, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS rn FROM h WHERE level = 2) SELECT doc_id, CAST(rn - 1 AS BIGINT) AS ord, CAST(rn AS VARCHAR) AS section_id, title FROM s WHERE rn <= {C.MAX_SECTIONS_LISTED}")
def valid_sections(spark, d):
    rows = sections.top_sections(sections.section_rows(sections.pages(folded(spark, d))))
    return rows.select("doc_id", F.col("ord").cast("long").alias("ord"), "section_id", "title")


@query("SELECT conv_id AS doc_id, conv_id % 2 = 1 AND conv_id % 3 <> 0 AS bare FROM conversations GROUP BY conv_id")
def bare_titles(spark, d):
    """Pages whose first heading is as high as the next (odd ids) or higher, with text between them (multiples of 3) or none."""
    head = F.concat(F.when(F.col("conv_id") % 2 == 1, "## ").otherwise("# "), F.lit("Page\n"), F.when(F.col("conv_id") % 3 == 0, "words\n").otherwise("  \n"), F.lit("## Next\nmore"))
    pages = P.table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), head.alias("text")).distinct()
    return sections.bare_titles(sections.heading_rows(pages)[0], pages.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "value")))


# --- names ---


def parts_as_docs(spark, d):
    part = P.table(spark, d, "part")
    cli = F.concat(F.lit("cli "), F.lower("p_type"), F.lit(" "), "p_partkey")
    return part.select(
        F.col("p_partkey").alias("doc_pos"), F.concat(F.lit("GET /parts/"), "p_partkey").alias("id"), F.lit("api").alias("kind"), F.col("p_name").alias("title"), F.concat(F.lit("getPart"), "p_brand").alias("operation_id"),
        cli.alias("cli"), F.array(F.concat(F.lit("cli part "), "p_size")).alias("cli_aliases"), F.col("p_name").alias("text"),
    )


PARTS = "p AS (SELECT p_partkey AS doc_pos, 'GET /parts/' || p_partkey AS id, lower('getPart' || p_brand) AS op, lower('cli ' || lower(p_type) || ' ' || p_partkey) AS c1, 'cli part ' || p_size AS c2 FROM part)"
ALIASES = f"{PARTS}, names AS (SELECT doc_pos, id, unnest([0, 1, 2, 3, 4, 5]) AS place, unnest([op, c1, trim(regexp_replace(c1, '^cli ', '')), c2, trim(regexp_replace(c2, '^cli ', '')), lower(id)]) AS alias FROM p), aliases AS (SELECT alias, arg_min(id, (doc_pos, place)) AS id FROM names GROUP BY alias)"


@query(f"WITH {ALIASES} SELECT alias, id FROM aliases")
def alias_table(spark, d):
    return resolve.alias_table(parts_as_docs(spark, d))


@query(f"WITH {ALIASES}, asked AS (SELECT 'get   /parts/' || s_suppkey AS raw FROM supplier UNION ALL SELECT 'Cli Part ' || s_suppkey FROM supplier UNION ALL SELECT 'GET /parts/' || s_suppkey FROM supplier UNION ALL SELECT s_name FROM supplier UNION ALL SELECT DISTINCT 'https://docs.example.com/reference/getPartBrand#' || s_suppkey || '?x' FROM supplier UNION ALL SELECT DISTINCT 'https://docs.example.com/reference/GETPART' || p_brand || '/' FROM part WHERE p_brand NOT LIKE '%#%' UNION ALL SELECT 'https://docs.example.com/reference/Cli%20x') SELECT raw, coalesce((SELECT id FROM p WHERE p.id = raw), (SELECT id FROM aliases WHERE alias = lower(raw)), (SELECT id FROM aliases WHERE alias = lower(trim(regexp_extract(raw, '^https://docs.example.com/reference/([^#?]*)', 1), '/'))), (SELECT id FROM p WHERE p.id = regexp_replace(upper(raw), ' +/PARTS', ' /parts'))) AS id FROM asked")
def alias_resolve(spark, d):
    docs, s = parts_as_docs(spark, d), P.table(spark, d, "supplier")
    forms = [F.concat(F.lit("get   /parts/"), "s_suppkey"), F.concat(F.lit("Cli Part "), "s_suppkey"), F.concat(F.lit("GET /parts/"), "s_suppkey"), F.col("s_name")]
    pages = s.select(F.concat(F.lit("https://docs.example.com/reference/getPartBrand#"), "s_suppkey", F.lit("?x")).alias("raw")).distinct()
    plain = P.table(spark, d, "part").where(~F.contains("p_brand", F.lit("#"))).select(F.concat(F.lit("https://docs.example.com/reference/GETPART"), "p_brand", F.lit("/"))).distinct()
    asked = s.select(F.explode(F.array(*forms)).alias("raw")).union(pages).union(plain).union(spark.createDataFrame([("https://docs.example.com/reference/Cli%20x",)], "raw string"))
    return resolve.resolve(asked, docs, resolve.alias_table(docs))


@query()
def suggest(spark, d):
    return resolve.suggest(["get /part/12", "steel tin", "xyz"], parts_as_docs(spark, d))


@query(f"WITH {FOLDED}, {HEADS}, s AS (SELECT doc_id, line, title, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS rn, lead(line) OVER (PARTITION BY doc_id ORDER BY line) AS nxt FROM h WHERE level = 2) SELECT 'conv-' || s.doc_id AS id, '1' AS section, '# Conversation ' || s.doc_id || ' > ' || s.title || ' [conv-' || s.doc_id || ' #1] https://www.example.com/p/conv-' || s.doc_id || chr(10) || chr(10) || regexp_replace(array_to_string(string_split(f.text, chr(10))[line + 1 : coalesce(nxt, n_lines)], chr(10)), '^\n+|\n+$', '', 'g') AS result FROM s JOIN f USING (doc_id) JOIN n USING (doc_id) WHERE rn = 1 UNION ALL SELECT 'GET /parts/' || p_partkey, '', p_name FROM part")
def fetch_many(spark, d):
    """The first section of every conversation and the card of every part."""
    pages = folded(spark, d).select(F.col("doc_id").alias("doc_pos"), F.concat(F.lit("conv-"), "doc_id").alias("id"), F.lit("guide").alias("kind"), "title", "text")
    parts = parts_as_docs(spark, d)
    asked = pages.select("id", F.lit("1").alias("section")).union(parts.select("id", F.lit("")))
    return fetch.fetch_many(asked, pages.unionByName(parts, allowMissingColumns=True), SITE)


@query("SELECT page_id, CASE WHEN length(line) > 120 THEN rtrim(left(line, 117)) || '...' ELSE line END AS reason FROM (SELECT page_id, trim(regexp_extract(html, '^\\s*([^\r\n]*)', 1)) AS line FROM pages)")
def short_reasons(spark, d):
    return P.table(spark, d, "pages").select("page_id", sources.short_reason(F.col("html")).alias("reason"))


# --- catalogue, status, publishing ---


@query("SELECT lang AS kind, count(*) AS n FROM documents GROUP BY lang")
def inventory(spark, d):
    return status.inventory(P.documents(spark, d))


@query("SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS built_at, round((epoch_us(TIMESTAMP '2024-06-01 00:00:00') - epoch_us(ts)) / 86400000000.0, 6) AS age, (epoch_us(TIMESTAMP '2024-06-01 00:00:00') - epoch_us(ts)) / 86400000000.0 > 7 AS stale FROM events WHERE event_id % 50 <> 0 UNION ALL SELECT 'never ' || event_id, NULL, false FROM events WHERE event_id % 50 = 0")
def staleness(spark, d):
    """Ages of the events' times, some of which are no times."""
    at = F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("never "), "event_id")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    found = status.staleness(P.table(spark, d, "events").select(at.alias("built_at")), F.lit("2024-06-01 00:00:00").cast("timestamp"))
    return found.select("built_at", F.round("age", 6).alias("age"), "stale")


@query("SELECT 'doc-' || doc_id AS id, lang AS kind, CAST(length(text) AS BIGINT) AS size, NULL AS cli, true AS numbered FROM documents UNION ALL SELECT 'GET /parts/' || p_partkey, 'api', length(p_name), 'cli ' || lower(p_type) || ' ' || p_partkey, true FROM part")
def union_catalogs(spark, d):
    """Guides and API documents as one catalogue, numbered in the order of kind and id."""
    made = build.catalogue(P.documents(spark, d), parts_as_docs(spark, d))
    before = made.groupBy("kind").agg(F.min("doc_pos").alias("least"), F.max("doc_pos").alias("most")).orderBy("kind").collect()  # a row a kind
    ordered = all(a["most"] < b["least"] for a, b in zip(before, before[1:]))
    return made.select("id", "kind", F.length("text").cast("long").alias("size"), "cli", F.lit(ordered).alias("numbered"))


@query("SELECT doc_id, CAST(greatest(ceil(octet_length(encode(text)) / 1000.0), 1) AS BIGINT) AS chunks, CAST(octet_length(encode(text)) AS BIGINT) AS bytes, sha256(text) AS sha256 FROM documents")
def chunk_manifest(spark, d):
    return publish.manifest(P.table(spark, d, "documents"), "doc_id", "text", 1000)


@query("SELECT doc_id, doc_id % 9 <> 4 OR octet_length(encode(text)) = 0 AS ok, CASE WHEN doc_id % 9 <> 4 OR octet_length(encode(text)) = 0 THEN sha256(text) END AS sha256 FROM documents")
def chunks_assembled(spark, d):
    """Texts cut up and put together again; of every ninth the first chunk has a byte too few."""
    docs = P.table(spark, d, "documents")
    cut = publish.chunks(docs, "doc_id", "text", 1000)
    hurt = cut.withColumn("data", F.when((F.col("doc_id") % 9 == 4) & (F.col("chunk") == 0), F.expr("substring(data, 2)")).otherwise(F.col("data")))
    whole = publish.assemble(hurt, publish.manifest(docs, "doc_id", "text", 1000), "doc_id")
    return whole.select("doc_id", "ok", F.sha2("data", 256).alias("sha256"))


def part_specs(spark, d):
    """Specifications of up to 1,000 parts each: a path with shared parameters and two operations for each part."""
    key = F.col("p_partkey")
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    shared = '"x-cli-command":"parts","parameters":[{"name":"apiVersion","in":"path"},{"name":"size","in":"query","schema":{"type":"integer"},"description":"Old words."}]'
    get = say(
        '"get":{"operationId":"getPart', key, '","summary":" Read part ', key, ' ","x-cli-action":["view","show"],"tags":["', F.col("p_brand"), '"],"security":[{"o":["write:x"]},{"o":["read:x","write:x"]}],'
        '"parameters":[{"name":"size","in":"query","required":true,"schema":{"type":["null","string"]},"description":"The **size**. More."},{"name":"key","in":"path","required":true,"schema":{"type":"array","items":{"enum":["a"]}}}]}',
    )
    post = say(
        '"post":{"operationId":"makePart', key, '","description":"Makes a part of the kind ', F.lower("p_type"), ' now. Rest.","x-cli-skip":true,"x-cli-action":"make","requestBody":{"required":true,"content":{"application/json":{"schema":'
        '{"required":["label","spec"],"properties":{"label":{"type":"string","description":"A name."},"odd":{},"spec":{"required":["deep"],"properties":{"deep":{"properties":{"x":{},"y":{}}}}},"more":{"oneOf":[{"type":"number"}]}}}}}}}',
    )
    path = say('"/{apiVersion}/parts/', key, '":{', shared, ",", get, ",", post, ',"head":"none"}')
    many = P.table(spark, d, "part").groupBy(F.floor(key / 1000).alias("block")).agg(F.array_join(F.array_sort(F.collect_list(path)), ",").alias("paths"))
    return many.select(say('{"paths":{', F.col("paths"), "}}").alias("spec"))


NL = "chr(10)"
GET_CARD = f"'## GET /parts/' || k || {NL} || {NL} || 'Read part ' || k || {NL} || {NL} || 'CLI: `cli parts view`' || {NL} || {NL} || 'Parameters:' || {NL} || '- key (array[string], required)' || {NL} || '- size (string, required): The size. More.' || {NL} || {NL} || 'OAuth scopes: read:x, write:x' || {NL} || {NL} || 'Reference: https://docs.example.com/reference/getPart' || k || {NL}"
POST_CARD = f"'## POST /parts/' || k || {NL} || {NL} || 'Makes a part of the kind ' || t || ' now.' || {NL} || {NL} || 'Parameters:' || {NL} || '- size (integer, optional): Old words.' || {NL} || {NL} || 'Body (required):' || {NL} || '- label (string, required): A name.' || {NL} || '- spec (object, required)' || {NL} || '  - deep (object, required, 2 fields)' || {NL} || '- optional: odd, more' || {NL} || {NL} || 'Reference: https://docs.example.com/reference/makePart' || k || {NL}"


@query(f"""WITH k AS (SELECT p_partkey AS k, p_brand AS b, lower(p_type) AS t FROM part)
    SELECT 'GET /parts/' || k AS id, 'Read part ' || k AS title, 'getPart' || k AS operation_id, 'cli parts view' AS cli, 'cli parts show' AS more_cli, 'GET /parts/' || k || ' Read part ' || k || ' ' || b || ' size key cli parts view cli parts show' AS text, {GET_CARD} AS card FROM k
    UNION ALL SELECT 'POST /parts/' || k, 'POST /parts/' || k, 'makePart' || k, NULL, '', 'POST /parts/' || k || ' Makes a part of the kind ' || t || ' now. size label odd spec more', {POST_CARD} FROM k""")
def api_operations(spark, d):
    found = openapi.api_docs(part_specs(spark, d))
    return found.select("id", "title", "operation_id", "cli", F.array_join("cli_aliases", ",").alias("more_cli"), "text", "card")
