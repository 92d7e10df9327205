"""Text search, clean-up and prices over documents, pages and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from adwatch import fixed
from adwatch.functions import display as D
from adwatch.functions import price as P
from adwatch.functions import text as X
from adwatch.operators import checks, postings, search
from workload import query
from workload import views as V
from workload.streams import work_folder

_SPACE = X.SPACE


@query("html_text", f"""
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'),
  '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '{_SPACE}+', ' ', 'g'), '^{_SPACE}+|{_SPACE}+$', '', 'g') AS text FROM pages""")
def html_text(spark, sf):
    return V.spread(spark, sf, "pages").select("page_id", X.html_text(F.col("html")).alias("text"))


@query("term_filter", """
SELECT doc_id FROM documents WHERE contains(lower(text), 'tion the') OR contains(lower(text), 'für') OR contains(lower(text), 'eauou')""")
def term_filter(spark, sf):
    docs = V.spread(spark, sf, "documents")
    return search.matching_terms(docs, ["Tion The", "", "für", "EAUOU"], F.lit(None).cast("string"), F.col("text")).select("doc_id")


_WORDS = f"list_distinct(regexp_extract_all(lower(text), '{fixed.SEARCH_WORD}'))"


@query("prefix_search", f"""
SELECT doc_id FROM documents WHERE len(list_filter({_WORDS}, lambda w: starts_with(w, 'tion') OR starts_with(w, 'eauo'))) > 0""")
def prefix_search(spark, sf):
    docs = V.spread(spark, sf, "documents")
    return search.prefix_search(docs, "les Tion, eauo de", F.lit(""), F.col("text")).select("doc_id")


@query("prefix_search_plain", "SELECT doc_id FROM documents WHERE contains(lower(text), 'de la')")
def prefix_search_plain(spark, sf):
    docs = V.spread(spark, sf, "documents")
    return search.prefix_search(docs, "De la", F.lit(""), F.col("text")).select("doc_id")


def _terms(spark, sf):
    """Search terms from the data: an opening of every nation-numbered stem, and phrases of stop words."""
    keys = V.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("term_id"))
    stems = ["tion", "eau", "sch", "the", "ung", "re", "de la", "für", "con", "http", "que le"]
    stem = F.element_at(F.array(*[F.lit(s) for s in stems]), (F.col("term_id") % len(stems)).cast("int") + 1)
    tails = ["", "e", "re"]
    tail = F.element_at(F.array(*[F.lit(s) for s in tails]), (F.floor(F.col("term_id") / len(stems))).cast("int") + 1)
    return keys.select("term_id", F.concat(stem, tail).alias("term"))


_TERMS_SQL = f"""terms AS (
  SELECT term_id, term, list_filter(list_distinct(regexp_extract_all(lower(term), '{fixed.SEARCH_WORD}')), lambda w: length(w) >= 3 AND NOT list_contains({fixed.SEARCH_STOPWORDS}, w)) AS tokens
  FROM (SELECT n_nationkey::BIGINT AS term_id, ['tion','eau','sch','the','ung','re','de la','für','con','http','que le'][n_nationkey % 11 + 1] || ['','e','re'][n_nationkey // 11 + 1] AS term FROM nation)),
words AS (SELECT doc_id, unnest({_WORDS}) AS w FROM documents),
hits AS (
  SELECT DISTINCT doc_id, term_id, term FROM words JOIN (SELECT term_id, term, unnest(tokens) AS k FROM terms) ON starts_with(w, k)
  UNION ALL SELECT doc_id, term_id, term FROM documents, terms WHERE len(tokens) = 0 AND contains(lower(text), lower(term)))"""


def _docs(spark, sf):
    return V.spread(spark, sf, "documents").select("doc_id", "text")


@query("search_terms", f"WITH {_TERMS_SQL} SELECT * FROM hits")
def search_terms(spark, sf):
    return search.search_terms(_docs(spark, sf), _terms(spark, sf), "doc_id", "text")


@query("search_terms_joined", f"WITH {_TERMS_SQL} SELECT * FROM hits")
def search_terms_joined(spark, sf):
    body = F.coalesce("text", F.lit(""))
    return search._search_joined(_docs(spark, sf), search.term_tokens(_terms(spark, sf)), "doc_id", body)


def _indexed(spark, sf):
    """An index that is updated twice: all documents with an outdated text, then the English ones, a merge, then the others."""
    root = work_folder(spark)
    docs = V.spread(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    outdated = docs.withColumn("text", F.concat(F.coalesce("source", F.lit("")), F.lit(" tion the eaure für conre de la ")))
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    postings.write_segment(outdated, root, 0, "doc_id", "text")
    postings.write_segment(docs.where(english), root, 1, "doc_id", "text")
    postings.merge_segments(spark, root, 1)
    postings.write_segment(docs.where(~english), root, 2, "doc_id", "text")
    return root


@query("indexed_search", f"WITH {_TERMS_SQL} SELECT * FROM hits")
def indexed_search(spark, sf):
    return postings.search_index(spark, _indexed(spark, sf), _terms(spark, sf)).withColumnRenamed("key", "doc_id")


@query("indexed_search_joined", f"""WITH firsts AS (SELECT DISTINCT left(regexp_extract(lower(text), '{fixed.SEARCH_WORD}'), 4) AS term FROM documents),
terms AS (SELECT term FROM firsts WHERE length(term) >= 3 AND NOT list_contains({fixed.SEARCH_STOPWORDS}, term)),
words AS (SELECT doc_id, unnest({_WORDS}) AS w FROM documents)
SELECT DISTINCT doc_id, term FROM words JOIN terms ON starts_with(w, term)""")
def indexed_search_joined(spark, sf):
    """As many terms as first words of documents have openings."""
    terms = V.table(spark, sf, "documents").select(F.left(F.regexp_extract(F.lower("text"), fixed.SEARCH_WORD, 0), F.lit(4)).alias("term")).distinct()
    terms = terms.where((F.length("term") >= 3) & ~F.col("term").isin(*fixed.SEARCH_STOPWORDS)).withColumn("term_id", F.xxhash64("term"))
    index = postings.Index(spark, _indexed(spark, sf))
    worded = postings.term_tokens(terms).select("term_id", "term", F.explode("_tokens").alias("prefix"))
    return postings.joined_hits(index, worded).select(F.col("key").alias("doc_id"), "term")


@query("first_hits", f"WITH {_TERMS_SQL} SELECT doc_id, min(term_id) AS term_id, arg_min(term, term_id) AS term FROM hits GROUP BY 1")
def first_hits(spark, sf):
    hits = search.search_terms(_docs(spark, sf), _terms(spark, sf), "doc_id", "text")
    return search.first_hits(hits, "doc_id")


@query("site_labels", "SELECT s_name AS label FROM supplier WHERE contains(lower(s_name), '00001')")
def site_labels(spark, sf):
    sites = V.table(spark, sf, "supplier").select(F.col("s_name").alias("label"))
    return search.site_labels_like(sites, "00001")


def _thousands(c):
    """12345.67 as text with an apostrophe between thousands."""
    return F.replace(F.format_number(c, 2), F.lit(","), F.lit("'"))


_WHOLE = "floor(l_extendedprice)::BIGINT"
_CENTS = "lpad((round(l_extendedprice * 100)::BIGINT % 100)::VARCHAR, 2, '0')"


@query("price_strict", f"SELECT l_orderkey, l_linenumber, l_partkey, ({_WHOLE})::DOUBLE AS amount, 'CHF' AS currency FROM lineitem")
def price_strict(spark, sf):
    text = F.concat(F.lit("Prix : "), F.replace(F.format_number(F.floor("l_extendedprice"), 0), F.lit(","), F.lit(" ")), F.lit(" chf"))
    return V.spread(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", P.strict_price(text).alias("p")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "p.*"
    )


@query("price_tolerant", f"""
SELECT l_orderkey, l_linenumber, l_partkey, (round(l_extendedprice * 100)::BIGINT // 100 || '.' || {_CENTS})::DOUBLE AS amount,
       CASE WHEN l_returnflag = 'A' THEN 'EUR' END AS currency FROM lineitem""")
def price_tolerant(spark, sf):
    text = F.concat(_thousands(F.col("l_extendedprice")), F.when(F.col("l_returnflag") == "A", " EUR").otherwise(" "))
    return V.spread(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", P.tolerant_price(text).alias("p")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "p.*"
    )


@query("price_loose", f"""
SELECT l_orderkey, l_linenumber, l_partkey, (round(l_extendedprice * 100)::BIGINT // 100 || '.' || {_CENTS})::DOUBLE AS loose,
       (round(l_extendedprice * 100)::BIGINT // 100 || '.' || {_CENTS})::DOUBLE AS structured FROM lineitem""")
def price_loose(spark, sf):
    text = _thousands(F.col("l_extendedprice"))
    return V.spread(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", P.loose_amount(F.concat(F.lit("env "), text, F.lit(" -"))).alias("loose"),
        P.structured_amount(text).alias("structured"),
    )


@query("after_colon", "SELECT s_suppkey, s_name AS seller, s_name AS plain FROM supplier")
def after_colon(spark, sf):
    name = F.col("s_name")
    return V.table(spark, sf, "supplier").select(
        "s_suppkey", X.after_colon(F.concat(F.lit("Vendeur : "), name)).alias("seller"), X.after_colon(name).alias("plain")
    )


@query("categories", """
SELECT event_id, CASE (json_extract_string(props, '$.k')::INT) % 4 WHEN 0 THEN 'contrefacon' WHEN 1 THEN 'arme' WHEN 2 THEN 'aucune' ELSE 'viande' END AS category FROM events""")
def categories(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int") % 4
    raw = F.when(k == 0, "Contrefaçon").when(k == 1, " ARMÉ ".replace("É", "E")).when(k == 2, "arnaque").otherwise("Vîande")
    return V.table(spark, sf, "events").select("event_id", X.category(raw).alias("category"))


@query("ad_prompts", """
SELECT c_custkey, 'Titre : ' || c_name || chr(10) || 'Description : ' || chr(10) || 'Prix : ' || floor(c_acctbal)::BIGINT || '.0 CHF' ||
  CASE WHEN c_nationkey > 5 THEN chr(10) || 'Lieu : N' || c_nationkey ELSE '' END AS prompt FROM customer""")
def ad_prompts(spark, sf):
    place = F.when(F.col("c_nationkey") > 5, F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))).otherwise("")
    prompt = D.ad_prompt(F.col("c_name"), F.lit(None).cast("string"), F.floor("c_acctbal").cast("double"), F.lit("CHF"), place)
    return V.table(spark, sf, "customer").select("c_custkey", prompt.alias("prompt"))


@query("embedding_texts", r"""
SELECT doc_id, 'passage: ' || trim(source || '. ' || text, E' \t\n\r') AS rule, 'query: ' || trim(source || ' ' || text, E' \t\n\r') AS ad FROM documents""")
def embedding_texts(spark, sf):
    return V.table(spark, sf, "documents").select(
        "doc_id", D.rule_text(F.col("source"), F.col("text"), fixed.PASSAGE_PREFIX).alias("rule"),
        D.ad_query_text(F.col("source"), F.col("text"), fixed.QUERY_PREFIX).alias("ad"),
    )


@query("missing_fields", """
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'price' ELSE '' END || CASE WHEN c_acctbal < 0 AND c_mktsegment = 'BUILDING' THEN ',' ELSE '' END ||
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'description' ELSE '' END AS missing FROM customer""")
def missing_fields(spark, sf):
    fields = {
        "title": F.col("c_name"), "price": F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal").cast("string")),
        "description": F.when(F.col("c_mktsegment") == "BUILDING", "  ").otherwise(F.col("c_mktsegment")),
    }
    return V.table(spark, sf, "customer").select("c_custkey", F.array_join(checks.missing_fields(fields), ",").alias("missing"))


@query("record_problems", """
SELECT c_custkey, c_mktsegment <> 'BUILDING' AND c_acctbal >= 0 AS ok, CASE WHEN c_mktsegment = 'BUILDING' THEN 'title' ELSE '' END ||
  CASE WHEN c_acctbal < 0 AND c_mktsegment = 'BUILDING' THEN ',' ELSE '' END || CASE WHEN c_acctbal < 0 THEN 'price_amount' ELSE '' END AS problems FROM customer""")
def record_problems(spark, sf):
    title = F.when(F.col("c_mktsegment") == "BUILDING", " ").otherwise(F.col("c_name"))
    price = F.when(F.col("c_acctbal") < 0, "cher").otherwise(F.col("c_acctbal").cast("string"))
    found = V.table(spark, sf, "customer").select("c_custkey", checks.record_problems(title, price).alias("r"))
    return found.select("c_custkey", "r.ok", F.array_join("r.problems", ",").alias("problems"))


@query("page_titles", f"SELECT page_id, {V.title_sql()} AS title FROM pages")
def page_titles(spark, sf):
    from adwatch.operators.extract import page_title

    return V.spread(spark, sf, "pages").select("page_id", page_title(F.col("html")).alias("title"))


@query("expanded_terms", """
WITH t AS (SELECT l_orderkey % 100 AS run_id, l_orderkey AS seed_no, l_linenumber AS position, 't' || (l_partkey % 50) AS term FROM lineitem),
f AS (SELECT run_id, term, min((seed_no, position)) AS seen FROM (SELECT run_id, seed_no, term, min(position) AS position FROM t GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT run_id, term FROM f""")
def expanded_terms(spark, sf):
    items = V.table(spark, sf, "lineitem")
    # One answer per order line, its place in the order kept as a fractional seed number.
    answers = items.select(
        (F.col("l_orderkey") % 100).alias("run_id"), F.struct("l_orderkey", "l_linenumber").alias("seed_no"),
        F.array(F.concat(F.lit("t"), (F.col("l_partkey") % 50).cast("string"))).alias("terms"),
    )
    return search.expanded_terms(answers).select("run_id", "term")


@query("expanded_categories", V.ctes(V.RUNS) + "SELECT run_id, unnest(targets) AS category FROM runs")
def expanded_categories(spark, sf):
    answers = V.runs(spark, sf).select("run_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("seed_no"), F.col("params.target_categories").alias("categories"))
    return search.expanded_categories(answers).select("run_id", "category")


@query("third_party", """
SELECT s_suppkey, s_suppkey % 4 = 0 OR (s_suppkey % 4 = 1 AND s_nationkey < 12) AS transfer FROM supplier""")
def third_party(spark, sf):
    key = F.col("s_suppkey") % 4
    model = F.when(key == 0, "anthropic/m").when(key == 1, "openai/m").when(key == 2, "ollama/m").otherwise("plain")
    base = F.when(F.col("s_nationkey") >= 12, "http://inside:8000/v1")
    return V.table(spark, sf, "supplier").select("s_suppkey", D.third_party_transfer(model, base).alias("transfer"))


@query("depth_steps", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 8 WHEN 'O' THEN 25 ELSE 15 END::INTEGER AS steps FROM orders")
def depth_steps(spark, sf):
    depth = F.when(F.col("o_orderstatus") == "F", "rapide").when(F.col("o_orderstatus") == "O", "approfondie").otherwise("autre")
    return V.table(spark, sf, "orders").select("o_orderkey", D.depth_steps(depth).alias("steps"))


@query("exploration_briefs", """
SELECT s_suppkey, 'Start https://x.test/' || s_suppkey || CASE WHEN s_nationkey > 3 THEN chr(10) || 'Objet prioritaire : N' || s_nationkey || chr(10) || 'Exemples, sans s''y limiter : ' || s_name || ', b.' || chr(10) ELSE '' END AS brief FROM supplier""")
def exploration_briefs(spark, sf):
    focus = F.when(F.col("s_nationkey") > 3, F.concat(F.lit(" N"), F.col("s_nationkey").cast("string")))
    url = F.concat(F.lit("https://x.test/"), F.col("s_suppkey").cast("string"))
    brief = D.exploration_brief("Start {start_url}{focus_block}", url, focus, F.array(F.col("s_name"), F.lit(""), F.lit("b")))
    return V.table(spark, sf, "supplier").select("s_suppkey", brief.alias("brief"))


@query("locations", "SELECT s_suppkey, CASE WHEN s_nationkey % 3 = 0 THEN NULL WHEN s_nationkey % 3 = 1 THEN s_name ELSE s_nationkey || ' ' || s_name END AS location FROM supplier")
def locations(spark, sf):
    key = F.col("s_nationkey") % 3
    postal = F.when(key == 2, F.col("s_nationkey").cast("string"))
    return V.table(spark, sf, "supplier").select("s_suppkey", D.compose_location(postal, F.when(key > 0, F.col("s_name"))).alias("location"))
