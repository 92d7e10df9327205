"""Model answers in free text: events and conversations wrapped the way answers arrive."""

from __future__ import annotations

from pyspark.sql import functions as F

from adwatch import fixed
from adwatch.functions import responses as R
from adwatch.operators import score as S
from adwatch.plans import collect as C
from workload import query
from workload import views as V

def _answer():
    """Plain, fenced, wrapped in a sentence, out of range, and no JSON at all."""
    shape = F.col("event_id") % 5
    number = (F.floor(F.col("value") * 10) / F.lit(1000.0)).cast("decimal(8,3)").cast("string")
    body = F.concat(F.lit('{"score": '), number, F.lit(', "categorie": "'), F.col("event_type"), F.lit('", "justification": " '), F.col("event_type"), F.lit(' "}'))
    quoted = F.concat(F.lit('{"score": "'), number, F.lit('", "categorie": "Contrefaçon"}'))
    return (
        F.when(shape == 0, body).when(shape == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(shape == 2, F.concat(F.lit("Voici mon avis : "), body, F.lit(" Merci."))).when(shape == 3, quoted).otherwise("pas de JSON")
    )


@query("score_responses", """
SELECT event_id, event_id % 5 < 4 AS ok, CASE WHEN event_id % 5 < 4 THEN least(1.0::DOUBLE, floor(value * 10) / 1000.0::DOUBLE) END AS suspicion_score,
       CASE event_id % 5 WHEN 4 THEN NULL WHEN 3 THEN 'contrefacon' ELSE 'aucune' END AS category,
       CASE event_id % 5 WHEN 4 THEN NULL WHEN 3 THEN '' ELSE event_type END AS rationale FROM events""")
def score_responses(spark, sf):
    return V.spread(spark, sf, "events").select("event_id", R.score_response(_answer()).alias("r")).select("event_id", "r.*")


@query("terms_responses", """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type || ',lot' WHEN 1 THEN 'a b' ELSE '' END AS terms,
       CASE event_id % 3 WHEN 0 THEN 'arme,tabac' WHEN 1 THEN 'cites' ELSE '' END AS categories FROM events""")
def terms_responses(spark, sf):
    shape = F.col("event_id") % 3
    raw = (
        F.when(shape == 0, F.concat(F.lit('{"termes": [" '), F.upper("event_type"), F.lit('", "lot", "Lot ", ""], "categories": ["Arme", "autre", "tabac", "arme"]}')))
        .when(shape == 1, '{"terms": ["A b"], "categorie": "CITES"}').otherwise("{}")
    )
    return V.spread(spark, sf, "events").select(
        "event_id", F.array_join(R.terms_response(raw), ",").alias("terms"), F.array_join(R.categories_response(raw), ",").alias("categories")
    )


def _explored(spark, sf):
    """Conversation turns as exploration reports: a list in a sentence, an empty list, a useless list, or no list."""
    role, late = F.col("role"), F.col("turn") > 3
    ad = F.struct(
        F.concat(F.lit(" Ad "), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"), F.lit(" ")).alias("title"),
        F.col("text").alias("description"), F.col("turn").alias("price_amount"), F.lit(" chf ").alias("price_currency"),
        F.when(F.col("turn") % 2 == 0, F.concat(F.lit("https://s.test/"), F.col("conv_id").cast("string"))).otherwise("https://s.test/x (approx)").alias("url"),
    )
    listed = F.concat(F.lit("Vu [3 pages] : "), F.to_json(F.array(ad)), F.lit(" fin [1]"))
    none = F.when(late, "Rien : []").otherwise('Voir [{"title": ""}]')
    raw = F.when(role == "user", listed).when(role == "assistant", none).otherwise(F.translate("text", "[]", ""))
    return V.spread(spark, sf, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("session_id"), F.col("turn").alias("run_id"), F.col("role").alias("site"), F.lit("p").alias("platform"),
        F.lit("https://s.test").alias("base_url"), raw.alias("raw"),
    )


@query("explored_sessions", """
SELECT conv_id || '-' || turn AS session_id, CASE WHEN role = 'user' THEN 'ok' WHEN role = 'assistant' AND turn > 3 THEN 'empty' ELSE 'invalid' END AS status,
       CASE role WHEN 'user' THEN 1 ELSE 0 END::INTEGER AS ads FROM conversations""")
def explored_sessions(spark, sf):
    return C.explored_ads(_explored(spark, sf))[1].select("session_id", "status", "ads")


@query("explored_ads", """
SELECT conv_id || '-' || turn AS session_id, 'Ad ' || conv_id || '-' || turn AS title, trim(text, chr(9) || chr(10) || chr(13) || ' ') AS description, turn::DOUBLE AS price_amount,
       'CHF' AS price_currency, CASE WHEN turn % 2 = 0 THEN 'https://s.test/' || conv_id END AS url,
       CASE WHEN turn % 2 = 0 THEN 'https://s.test/' || conv_id ELSE 'browse:' || left(sha256('Ad ' || conv_id || '-' || turn || '|' || turn || '|https://s.test'), 16) END AS external_id
FROM conversations WHERE role = 'user'""")
def explored_ads(spark, sf):
    return C.explored_ads(_explored(spark, sf))[0].select("session_id", "title", "description", "price_amount", "price_currency", "url", "external_id")


@query("parsed_ads", """
SELECT p_partkey, p_name AS title, CASE WHEN p_size % 3 = 2 THEN NULL ELSE floor(p_retailprice)::DOUBLE END AS price_amount, CASE WHEN p_size % 2 = 0 THEN 'CHF' END AS price_currency FROM part""")
def parsed_ads(spark, sf):
    whole = F.floor("p_retailprice").cast("string")
    price = F.when(F.col("p_size") % 3 == 0, whole).when(F.col("p_size") % 3 == 1, F.concat(F.lit('"'), whole, F.lit('.-"'))).otherwise('"sur demande"')
    raw = F.concat(
        F.lit('Réponse ```\n{"title": "'), F.col("p_name"), F.lit('", "price_amount": '), price, F.lit(', "price_currency": '),
        F.when(F.col("p_size") % 2 == 0, '"chf"').otherwise("null"), F.lit("}"),
    )
    return V.spread(spark, sf, "part").select("p_partkey", R.parsed_ad(raw).alias("a")).select("p_partkey", "a.title", "a.price_amount", "a.price_currency")


@query("score_keywords", """
SELECT doc_id, category, CASE WHEN category = 'aucune' THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS suspicion_score, sha256('system') AS prompt_hash FROM (
  SELECT doc_id, CASE {cases} ELSE 'aucune' END AS category FROM (SELECT doc_id, lower(source || ' ' || text) AS low FROM documents))""".replace(
    "{cases}", " ".join("WHEN " + " OR ".join(f"contains(low, '{w}')" for w in words) + f" THEN '{code}'" for code, words in fixed.KEYWORDS.items())
))
def score_keywords(spark, sf):
    ads = V.spread(spark, sf, "documents").select("doc_id", F.col("source").alias("title"), F.col("text").alias("description"))
    return S.score_batch(ads, "system", "keywords", "score_v1").select("doc_id", "category", "suspicion_score", "prompt_hash")


def _read_prompts(batches):
    """A stand-in scorer: the length of the prompt decides."""
    for prompts in batches:
        yield prompts.map(lambda p: '{"score": %s, "categorie": "arme"}' % (len(p) % 100 / 100))


@query("score_plugged", """
SELECT c_custkey, (length('Titre : ' || c_name || chr(10) || 'Description : ' || c_mktsegment || chr(10) || 'Lieu : N' || c_nationkey) % 100) / 100.0::DOUBLE AS suspicion_score,
       'arme' AS category, true AS ok FROM customer""")
def score_plugged(spark, sf):
    none = F.lit(None)
    ads = V.table(spark, sf, "customer").select(
        "c_custkey", F.col("c_name").alias("title"), F.col("c_mktsegment").alias("description"), none.cast("double").alias("price_amount"),
        none.cast("string").alias("price_currency"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("location"),
    )
    return C.scored_ads(ads, "system", "stand-in", "score_v1", _read_prompts).select("c_custkey", "suspicion_score", "category", "ok")
