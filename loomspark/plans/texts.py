"""Queries on texts: snippets, prompt lines, tags, JSON in prose, splitting, names from a table."""

from pyspark.sql import functions as F

from ..functions import semantics as S
from ..functions import text as X
from ..operators import dictionary, intel
from ..registry import query, table


@query(r"SELECT conv_id, turn, CASE WHEN p > 0 THEN regexp_replace(substr(text, greatest(1, p - 240), p + 3 + 240 - greatest(1, p - 240)), '^[@WHITE]+|[@WHITE]+$', '', 'g') END AS snippet FROM (SELECT conv_id, turn, text, CASE WHEN regexp_matches(t2, m) THEN strpos(lower(text), 'the') ELSE 0 END AS p FROM (SELECT *, regexp_replace(text, '([^\p{L}\p{N}])', '\1\1', 'g') AS t2, '(?i)(^|[^\p{L}\p{N}])the($|[^\p{L}\p{N}])' AS m FROM conversations) WHERE NOT regexp_matches(text, '(?i)[\p{L}\p{N}]the|the[\p{L}\p{N}]'))")
def brand_snippets(spark, sf_dir):
    """Turns in which "the" stands only as a word of its own, so that SQL can place it."""
    c = table(spark, sf_dir, "conversations").where(~F.col("text").rlike(r"(?i)[\p{L}\p{N}]the|the[\p{L}\p{N}]"))
    return c.select("conv_id", "turn", X.snippet("text", "the").alias("snippet"))


@query(r"""WITH l AS (SELECT conv_id, turn, generate_subscripts(ls, 1) AS k, unnest(ls) AS line FROM (SELECT conv_id, turn, string_split_regex('1. ' || text || chr(10) || '- "quoted words"' || chr(13) || chr(10) || '* ab', '\r?\n') AS ls FROM conversations)),
c AS (SELECT conv_id, turn, k, regexp_replace(regexp_replace(regexp_replace(line, '^[@WHITE]+|[@WHITE]+$', '', 'g'), '^(?:[-*•]\s*|\d+[.)]\s*)+', ''), '^[@WHITE]+|[@WHITE]+$', '', 'g') AS x FROM l), q AS (SELECT conv_id, turn, k, regexp_replace(regexp_replace(regexp_replace(x, '^["'']', ''), '["'']$', ''), '^[@WHITE]+|[@WHITE]+$', '', 'g') AS x FROM c)
SELECT conv_id, turn, count(*) AS n, string_agg(x, chr(31) ORDER BY k) AS lines FROM q WHERE length(x) >= 5 GROUP BY 1, 2""")
def prompt_lines(spark, sf_dir):
    text = F.concat(F.lit("1. "), "text", F.lit('\n- "quoted words"\r\n* ab'))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", X.parse_prompt_lines(text).alias("x"))
    return c.select("conv_id", "turn", F.size("x").cast("long").alias("n"), F.array_join("x", "\x1f").alias("lines"))


@query("""SELECT doc_id, len(v)::INT AS n, v[1] AS first, v[2] AS last FROM (SELECT doc_id, regexp_extract_all('a <var="one">' || text || '</var> b <var="two">' || source || '</var>', '(?s)<var="([^"]+)">(.*?)</var>', 2) AS v FROM documents)""")
def variable_tags(spark, sf_dir):
    v = X.var_tags(F.concat(F.lit('a <var="one">'), "text", F.lit('</var> b <var="two">'), "source", F.lit("</var>")))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(v).alias("n"), F.try_element_at(v, F.lit(1))["value"].alias("first"), F.try_element_at(v, F.lit(2))["value"].alias("last"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE (props::JSON ->> '$.k')::BIGINT END AS k FROM events")
def rescued_json(spark, sf_dir):
    i, props = F.col("event_id"), F.col("props")
    text = F.when(i % 4 == 0, props).when(i % 4 == 1, F.concat(F.lit("Here:\n```json\n"), props, F.lit("\n```\ndone"))).when(i % 4 == 2, F.concat(F.lit("It is "), props, F.lit(" as asked"))).otherwise("no json { here")
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(X.json_from_text(text), "$.k", "bigint").alias("k"))


@query(r"SELECT doc_id, len(x)::INT AS lines, x[1] AS first FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(text, '\r?\n'), lambda s: regexp_replace(s, '^[@WHITE]+|[@WHITE]+$', '', 'g')), lambda s: s <> '') AS x FROM documents)")
def document_lines(spark, sf_dir):
    items = X.split_text("text", "newline")["items"]
    return table(spark, sf_dir, "documents").select("doc_id", F.size(items).alias("lines"), F.try_element_at(items, F.lit(1)).alias("first"))


@query(r"SELECT doc_id, len(text) > 100000 AS too_long, CASE WHEN len(text) > 100000 THEN 0 ELSE len(list_filter(string_split_regex(text, '[.;][ \n]+'), lambda s: regexp_replace(s, '[@WHITE]+', '', 'g') <> '')) END::INT AS parts FROM documents")
def split_by_pattern(spark, sf_dir):
    s = X.split_text("text", "regex", pattern=r"/[.;][ \n]+/g")
    return table(spark, sf_dir, "documents").select("doc_id", s["error"].isNotNull().alias("too_long"), F.size(s["items"]).alias("parts"))


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(left(p_name, 30)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def part_slugs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.slug("p_name").alias("slug"))


#: Names: the first one to four words of every benchmark passage with what stands between them, part and supplier names, and some of symbols.
NAMES_SQL = r"""names AS (SELECT DISTINCT regexp_replace(regexp_extract(text, '^[@WHITE]*((?:[^@WHITE]+[@WHITE]+){' || (item_id % 4) || '}[^@WHITE]+)', 1), '[@WHITE]+', ' ', 'g') AS name FROM benchmark
  UNION SELECT p_name FROM part UNION SELECT s_name FROM supplier UNION VALUES ('.'), ('the'), ('THE'), ('. the'), (', and'), ('or'))"""
#: A text as its words and single other characters, set apart by one character: whole words lie between two, and so do names that begin or end with another character.
APART_SQL = r"""chr(31) || regexp_replace(regexp_replace(lower(%s), '[@WHITE]+', ' ', 'g'), '([^\p{L}\p{N}])', chr(31) || '\1' || chr(31), 'g') || chr(31)"""


def known_names(spark, sf_dir):
    words = F.concat(F.lit(r"(?U)^\s*((?:\S+\s+){"), (F.col("item_id") % 4).cast("string"), F.lit(r"}\S+)"))
    first = F.regexp_replace(F.regexp_extract_all("text", words, F.lit(1))[0], r"(?U)\s+", "  ")
    own = table(spark, sf_dir, "benchmark").select(first.alias("name")).union(table(spark, sf_dir, "part").select("p_name")).union(table(spark, sf_dir, "supplier").select("s_name"))
    return own.union(spark.createDataFrame([(x,) for x in (".", "the", "THE", ". the", ", and", "or", " ", None)], "name string"))


@query(f"WITH {NAMES_SQL} SELECT doc_id, name FROM (SELECT doc_id, {APART_SQL % 'text'} AS t FROM documents) d, (SELECT name, {APART_SQL % 'name'} AS n FROM names) m WHERE contains(t, n)")
def names_in_documents(spark, sf_dir):
    found = dictionary.mentions_of(table(spark, sf_dir, "documents"), "doc_id", "text", known_names(spark, sf_dir))
    return found.select("doc_id", F.regexp_replace("name", "  ", " ").alias("name"))


@query(f"WITH {NAMES_SQL} SELECT conv_id, count(*) AS names FROM (SELECT conv_id, {APART_SQL % 'text'} AS t FROM (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1)) d, (SELECT name, {APART_SQL % 'name'} AS n FROM names) m WHERE contains(t, n) GROUP BY 1")
def names_in_conversations(spark, sf_dir):
    """As a large dictionary would be met: by each name's rarest word."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    texts = turns.select("conv_id", F.array_join(F.transform("turns", lambda t: t["text"]), "\n").alias("text"))
    return dictionary.mentions_of(texts, "conv_id", "text", known_names(spark, sf_dir), most=0).groupBy("conv_id").agg(F.count("*").alias("names"))


@query("SELECT DISTINCT page_id, \"group\", term FROM pages JOIN (SELECT DISTINCT l_shipmode AS \"group\", lower(w) AS term, w AS needle FROM (SELECT l_shipmode, unnest(string_split(l_comment, ' ')) AS w FROM (SELECT 'item' AS l_shipmode, text AS l_comment FROM benchmark))) ON contains(lower(html), lower(needle))")
def words_in_pages(spark, sf_dir):
    """All words of the benchmark passages, thousands, as parts of the pages."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), " ", -1)).alias("term")).distinct()
    terms = words.select(F.lit("item").alias("group"), "term", F.col("term").alias("needle"), F.lit(0).alias("ord"))
    return dictionary.contains_terms(table(spark, sf_dir, "pages"), "page_id", "html", terms).select("page_id", "group", "term")  # once each, as the terms differ


@query("SELECT conv_id, turn, (k - 1)::INT AS ord, x[k] AS item FROM (SELECT conv_id, turn, list_filter(list_transform(string_split(text, ', '), lambda s: regexp_replace(s, '^[@WHITE]+|[@WHITE]+$', '', 'g')), lambda s: s <> '') AS x FROM conversations), (SELECT unnest(range(1, 1 + (SELECT max(length(text)) FROM conversations)::BIGINT)) AS k) r WHERE k <= len(x)")
def split_in_sql(spark, sf_dir):
    X.register_split(spark, "split_turns")
    table(spark, sf_dir, "conversations").createOrReplaceTempView("turns_to_split")
    out = spark.sql("SELECT conv_id, turn, s.ord, s.item FROM turns_to_split, LATERAL split_turns(text, 'delimiter', ', ') s")
    spark.catalog.dropTempView("turns_to_split")  # the plan holds what it needs; the session stays as it was
    spark.sql("DROP TEMPORARY FUNCTION split_turns")
    return out


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)abort|timeout') THEN 'timeout' WHEN regexp_matches(text, '(?i)429|rate.?limit') THEN 'rate_limited' ELSE 'error' END AS status, coalesce(regexp_matches(text, '(?i)429|5[0-9][0-9]|timeout|ETIMEDOUT|ECONNRESET|ENOTFOUND|abort'), false) AS retriable FROM documents")
def text_error_statuses(spark, sf_dir):
    """Whole documents as messages of errors."""
    status = X.classify_error("text")
    return table(spark, sf_dir, "documents").select("doc_id", status["status"].alias("status"), status["retriable"].alias("retriable"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN x = 0 THEN '$0.00' WHEN x < 0.01 THEN '<$0.01' ELSE '$' || format('{:.2f}', floor(x * 100 + 0.5) / 100) END AS cost FROM (SELECT *, l_discount::DOUBLE * l_quantity::DOUBLE * l_extendedprice::DOUBLE / 1e6 AS x FROM lineitem)")
def line_cost_texts(spark, sf_dir):
    cost = F.col("l_discount").cast("double") * F.col("l_quantity").cast("double") * F.col("l_extendedprice").cast("double") / 1e6
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.format_cost(cost).alias("cost"))


@query(r"""SELECT page_id, k, host IS NOT NULL AND lower(scheme) IN ('http', 'https') AND NOT regexp_matches(host, '^(localhost$|127\.|10\.|192\.168\.|169\.254\.|0\.|172\.(1[6-9]|2[0-9]|3[01])\.)') AS valid
FROM (SELECT page_id, k, regexp_extract(u, '^([A-Za-z]+)://', 1) AS scheme, nullif(regexp_extract(u, '^[A-Za-z]+://([^/:?#]+)', 1), '') AS host FROM (SELECT page_id, k, CASE k WHEN 0 THEN url WHEN 1 THEN 'ftp' || substr(url, strpos(url, ':')) WHEN 2 THEN regexp_replace(url, '//[^/]*', '//' || (page_id % 256) || '.' || (page_id * 7 % 256) || '.1.2') ELSE regexp_replace(url, '//[^/]*', '//172.' || (page_id % 40) || '.0.1:80') END AS u FROM pages, (VALUES (0), (1), (2), (3)) v(k)))""")
def checked_page_urls(spark, sf_dir):
    """The pages' own addresses, by another scheme, and with hosts of numbers."""
    i, url = F.col("page_id"), F.col("url")
    scheme = F.concat(F.lit("ftp"), F.regexp_replace(url, "^[^:]*", ""))
    numbers = F.regexp_replace(url, F.lit("//[^/]*"), F.concat(F.lit("//"), (i % 256).cast("string"), F.lit("."), (i * 7 % 256).cast("string"), F.lit(".1.2")))
    private = F.regexp_replace(url, F.lit("//[^/]*"), F.concat(F.lit("//172."), (i % 40).cast("string"), F.lit(".0.1:80")))
    p = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.array(url, scheme, numbers, private)).alias("k", "u"))
    return p.select("page_id", "k", intel.validate_url("u")["valid"].alias("valid"))
