"""Rules: reading, identity, ingestion and retrieval by vector."""

from __future__ import annotations

from pyspark.sql import functions as F

from adwatch.functions.display import rules_prompt
from adwatch.functions.hashing import rule_id
from adwatch.functions.numbers import round_even
from adwatch.operators import extract, retrieve
from adwatch.sources import readers
from adwatch.sources.writers import upsert_rules
from workload import query
from workload import views as V
from workload.streams import work_folder


def _rule_files(spark, sf):
    """A rule file per supplier: a preamble, a whole rule, and a rule without text."""
    block = F.concat(
        F.lit("# Règles\n\n## Part\n\n### "), F.col("s_name"), F.lit(" \n- **Catégorie** : cites\n- **Source** : RS "), F.col("s_suppkey").cast("string"),
        F.lit("\n- **URL** : https://law.test\n- **Règle** : Permis "), F.col("s_nationkey").cast("string"), F.lit(".\r\n\n### Vide\n- **Source** : x\n"),
    )
    return V.table(spark, sf, "supplier").select(F.col("s_name").alias("path"), block.alias("value"))


@query("markdown_rules", """
SELECT s_name AS path, 1 AS position, s_name AS title, 'cites' AS category, 'RS ' || s_suppkey AS source, 'https://law.test' AS url, 'Permis ' || s_nationkey || '.' AS text FROM supplier""")
def markdown_rules(spark, sf):
    return extract.markdown_rules(_rule_files(spark, sf))


@query("rule_ids", """
WITH h AS (SELECT s_suppkey, sha1('n4s]'::BLOB) AS unused, sha1(unhex('6e3735b03ea85ec3ab1cfeeb5689aa47') || encode('RS ' || s_suppkey || '|' || s_name)) AS d FROM supplier)
SELECT s_suppkey, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' || translate(substr(d, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS rule_id
FROM h""")
def rule_ids(spark, sf):
    return V.table(spark, sf, "supplier").select(
        "s_suppkey", rule_id(F.concat(F.lit("RS "), F.col("s_suppkey").cast("string")), F.col("s_name")).alias("rule_id")
    )


def _label_rules(spark, sf):
    """One rule per label: the mean vector of all its embeddings, in fixed point so that sums are exact."""
    parts = V.table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    fixed_point = F.floor(F.col("x").cast("double") * 1e6).cast("long")
    sums = parts.groupBy("label", "i").agg(F.sum(fixed_point).alias("x"))
    return sums.groupBy(F.col("label").alias("rule_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"].cast("double")).alias("embedding")
    )


_RULES_SQL = """parts AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
sums AS (SELECT label, i, sum(floor(x::DOUBLE * 1e6)::BIGINT)::DOUBLE AS x FROM parts GROUP BY 1, 2),
rules AS (SELECT label AS rule_id, list(x ORDER BY i) AS r FROM sums GROUP BY 1),
pairs AS (SELECT vec_id, rule_id, list_dot_product(embedding::DOUBLE[], r) / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) / sqrt(list_dot_product(r, r)) AS c
          FROM embeddings, rules),
best AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, rule_id) AS rank FROM pairs WHERE c >= 0.2)
SELECT vec_id, rank::INTEGER AS rank, rule_id, printf('%.3f', c)::DOUBLE AS score FROM best WHERE rank <= 3"""


@query("rule_topk", "WITH " + _RULES_SQL)
def rule_topk(spark, sf):
    queries = V.spread(spark, sf, "embeddings").select("vec_id", "embedding")
    return retrieve.retrieve_rules(queries, _label_rules(spark, sf), "vec_id", 3, 0.2).drop("cosine")


@query("rule_topk_blocked", "WITH " + _RULES_SQL)
def rule_topk_blocked(spark, sf):
    queries = V.spread(spark, sf, "embeddings").select("vec_id", "embedding")
    return retrieve.retrieve_rules(queries, _label_rules(spark, sf), "vec_id", 3, 0.2, inline_floats=0, block_floats=200).drop("cosine")


@query("rule_topk_stored", "WITH " + _RULES_SQL.replace("rules AS (SELECT label AS rule_id, list(x ORDER BY i) AS r FROM sums GROUP BY 1)", "rules AS (SELECT vec_id AS rule_id, embedding::DOUBLE[] AS r FROM embeddings)").replace(
    "c >= 0.2", "c >= 0.6"))
def rule_topk_stored(spark, sf):
    """Every vector against all, through a table of clusters that is written once."""
    path = f"{work_folder(spark)}/clusters"
    vectors = V.spread(spark, sf, "embeddings").select("vec_id", "embedding")
    retrieve.store_clusters(vectors.withColumnRenamed("vec_id", "rule_id"), path, 32)
    hits = retrieve.retrieve_clustered(vectors, retrieve.open_clusters(spark, path), "vec_id", 3, 0.6)
    return hits.withColumn("score", round_even(F.col("cosine"), 3)).drop("cosine")


@query("rule_prompts", "WITH " + _RULES_SQL.replace(
    "SELECT vec_id, rank::INTEGER AS rank, rule_id, printf('%.3f', c)::DOUBLE AS score FROM best WHERE rank <= 3",
    """SELECT vec_id, string_agg('L' || rule_id, ',' ORDER BY rank) AS refs, chr(10) || 'Règles douanières potentiellement applicables (appuie-toi dessus si elles sont pertinentes) :'
  || chr(10) || string_agg('- [c] L' || rule_id || ' (s) : t', chr(10) ORDER BY rank) AS prompt FROM best WHERE rank <= 3 GROUP BY 1"""))
def rule_prompts(spark, sf):
    rules = _label_rules(spark, sf).withColumn("title", F.concat(F.lit("L"), F.col("rule_id").cast("string")))
    for name, value in (("category", "c"), ("source", "s"), ("text", "t")):
        rules = rules.withColumn(name, F.lit(value))
    hits = retrieve.retrieve_rules(V.table(spark, sf, "embeddings").select("vec_id", "embedding"), rules, "vec_id", 3, 0.2)
    found = retrieve.rule_titles(hits, rules, "vec_id")
    return found.select("vec_id", F.array_join("rag_refs", ",").alias("refs"), rules_prompt(F.col("rules")).alias("prompt"))


@query("rule_upsert", """
SELECT vec_id AS rule_id, CASE WHEN label < 5 THEN label + 100 ELSE label END AS label FROM embeddings""")
def rule_upsert(spark, sf):
    stored = V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("rule_id"), "embedding", "label")
    incoming = stored.where("label < 5").withColumn("label", F.col("label") + 100)
    return upsert_rules(stored, incoming).select("rule_id", "label")


@query("rule_folder", """
SELECT s_name AS title, 'cites' AS category, 'RS ' || s_suppkey AS source, 'Permis ' || s_nationkey || '.' AS text FROM supplier""")
def rule_folder(spark, sf):
    """Rule files written one a folder part, read back by name, and parsed; other files beside them are passed over."""
    root = work_folder(spark)
    _rule_files(spark, sf).select("value").repartition(4).write.option("lineSep", "\n\n").text(f"{root}/text")
    jvm, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    source = jvm.Path(f"{root}/text")
    store = source.getFileSystem(conf)
    for i, part in enumerate(f.getPath() for f in store.listStatus(source) if f.getPath().getName().endswith(".txt")):  # at most four
        store.rename(part, jvm.Path(f"{root}/text/rules-{i}.md"))
    return extract.markdown_rules(readers.read_rule_files(spark, f"{root}/text")).select("title", "category", "source", "text")


@query("ads_with_rules", "WITH " + _RULES_SQL.replace(
    "SELECT vec_id, rank::INTEGER AS rank, rule_id, printf('%.3f', c)::DOUBLE AS score FROM best WHERE rank <= 3",
    """, named AS (SELECT vec_id, string_agg('L' || rule_id, ',' ORDER BY rank) AS refs, string_agg('L' || rule_id, ',' ORDER BY rank) FILTER (WHERE rank = 1) AS nearest FROM best WHERE rank <= 3 GROUP BY 1)
SELECT e.vec_id, e.label, coalesce(refs, '') AS refs, coalesce(nearest, '') AS nearest FROM embeddings e LEFT JOIN named USING (vec_id)""").replace("rank <= 3), named", "rank <= 3)\n, named"))
def ads_with_rules(spark, sf):
    """Every ad with its nearest rules, by the exact search and by a retriever of one's own that keeps the nearest."""
    from adwatch.plans import collect

    rules = _label_rules(spark, sf).withColumn("title", F.concat(F.lit("L"), F.col("rule_id").cast("string")))
    for name in ("category", "source", "text"):
        rules = rules.withColumn(name, F.lit(name))
    vectors = V.table(spark, sf, "embeddings").select(F.col("vec_id").alias("ad_id"), "embedding", "label")
    search = lambda k: lambda asked, known, key: retrieve.retrieve_rules(asked, known, key, k, 0.2)
    shown = lambda df, name: df.select("ad_id", F.coalesce(F.array_join("rag_refs", ","), F.lit("")).alias(name))
    ads = vectors.select("ad_id", "label")
    all_of, first = (collect.with_rules(ads, vectors.select("ad_id", "embedding"), rules, retriever=search(k)) for k in (3, 1))
    both = ads.join(shown(all_of, "refs"), "ad_id").join(shown(first, "nearest"), "ad_id")
    return both.withColumnRenamed("ad_id", "vec_id")
