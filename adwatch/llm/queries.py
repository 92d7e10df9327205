"""The operators over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from adwatch.llm.common import QUERIES, SQL, batch_bytes, query, shared_folder, table  # noqa: F401


@query("op5_bpe")
def op5_bpe(spark, sf_dir):
    from adwatch.llm import bpe

    batch_bytes(spark)
    path = bpe.vocabulary_path("word_bpe_49k.json")
    encoded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return bpe.decode(encoded, path).select(
        "doc_id",
        (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


@query("op8_token_ids")
def op8_token_ids(spark, sf_dir):
    from adwatch.llm import bpe, tokenids

    batch_bytes(spark)
    folder = shared_folder(spark)
    manifest = tokenids.write_token_files(
        table(spark, sf_dir, "documents"), folder, bpe.vocabulary_path("byte_bpe_50k.json"), bpe.vocabulary_path("byte_bpe_50k.tiktoken"))
    return tokenids.read_token_files(manifest, folder).select(
        "doc_id", "start", "n_tokens", F.crc32("token_ids").alias("ids_crc32"))


@query("op6_secrets")
def op6_secrets(spark, sf_dir):
    from adwatch.llm import bpe, secretscan

    batch_bytes(spark)
    found = secretscan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), bpe.vocabulary_path("byte_bpe_50k.tiktoken"))
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    base = secretscan.joined(F.filter("secrets", lambda s: s["kind"] != "random"))
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(base, 256).alias("base_sha256"), secretscan.joined("secrets").alias("spans"))


@query("op10_toxicity")
def op10_toxicity(spark, sf_dir):
    from adwatch.llm import toxicity

    batch_bytes(spark)
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(documents, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(documents, model, out="score").select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op3_quality", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, (VALUES (0), (1), (2)) AS v(o) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, CAST(list_sum(list_transform(ws, lambda x: length(x))) AS BIGINT) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
      FROM w LEFT JOIN c USING (doc_id))
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 30 * n_words OR 100 * n_dup_lines > 50 * n_lines) AS kept
FROM m""")
def op3_quality(spark, sf_dir):
    from adwatch.llm import quality

    entries = quality.apply_policies(quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality.passes(quality.BASE_MASK)).alias("base_failed"), F.col("kept")[2].alias("kept"))


LINE_SQL = r"""
WITH d AS (SELECT doc_id, text, coalesce(source, chr(0)) AS site, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, site, i, ls[i] AS raw, trim(ls[i], E' \t\x0b\x0c\r') AS line FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM d)),
b AS (SELECT line, min((doc_id, i)) AS first FROM l WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= 10),
f AS (SELECT l.*, b.line IS NOT NULL AS hit, b.line IS NOT NULL AND b.first <> (l.doc_id, l.i) AS lost FROM l LEFT JOIN b USING (line)),
s AS (SELECT doc_id, count(*) FILTER (WHERE lost) AS n_lost, count(*) FILTER (WHERE NOT hit AND line <> '') > 0 AS takes,
             string_agg(raw, chr(10) ORDER BY i) FILTER (WHERE NOT lost) AS shorter FROM f GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN takes THEN n_lost ELSE 0 END AS n_removed_lines,
       CASE WHEN takes AND n_lost > 0 THEN coalesce(shorter, '') ELSE d.text END AS text
FROM d LEFT JOIN s USING (doc_id)"""


@query("op7_line_dedup", f"SELECT doc_id, n_removed_lines, md5(text) AS text_md5 FROM ({LINE_SQL})")
def op7_line_dedup(spark, sf_dir):
    from adwatch.llm import linededup

    found = linededup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "n_removed_lines", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("op1_ngram_jaccard")
def op1_ngram_jaccard(spark, sf_dir):
    from adwatch.llm import ngramjoin

    batch_bytes(spark)
    return ngramjoin.link(table(spark, sf_dir, "documents"), words=4, percent=85)


@query("op2_suffix_dedup")
def op2_suffix_dedup(spark, sf_dir):
    from adwatch.llm import suffixdedup

    batch_bytes(spark)
    return suffixdedup.dedup(table(spark, sf_dir, "documents"), width=400).drop("kept")


@query("op9_decontamination")
def op9_decontamination(spark, sf_dir):
    from adwatch.llm import decontaminate

    batch_bytes(spark)
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("cosine", 4).alias("cosine"), "lcs_share", "answer_share")


@query("op4_license_scan")
def op4_license_scan(spark, sf_dir):
    from adwatch.llm import licensescan

    batch_bytes(spark)
    return licensescan.scan(table(spark, sf_dir, "documents"))


def _planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document as ``op13`` takes them: those from ``a`` on repeat the ``p`` words there, for a tenth of the ids."""
    import zlib

    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


@query("op13_periodic_runs")
def op13_periodic_runs(spark, sf_dir):
    from adwatch.llm import periods

    batch_bytes(spark)
    found = periods.detect(table(spark, sf_dir, "documents").select("doc_id", "text"), rewrite=_planted, key="doc_id")
    best = periods.greatest()
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(periods.listed(), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


@query("op11_collocations")
def op11_collocations(spark, sf_dir):
    from adwatch.llm import phrases

    batch_bytes(spark)
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query("op12_html_text")
def op12_html_text(spark, sf_dir):
    from adwatch.llm import htmltext

    batch_bytes(spark, 200, "2m")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return htmltext.extract(pages).withColumn("n_chars", F.length("text").cast("long"))
