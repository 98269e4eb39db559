"""Registered queries of this package: name -> (query, oracle SQL or None)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.tables import stage
from . import chat, fim, turns
from .decontaminate import leaks
from .lm import score_texts
from .mixing import mixing_rates
from .neighbours import nearest
from .ngram_join import jaccard_components
from .pii import find_personal_data
from .quality import RULES, judge
from .token_files import token_digests
from .toxicity import score_toxicity
from .urls import LOWER, UPPER, filter_urls


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def remainder(of: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % of


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    labels = read(spark, folder, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    return score_toxicity(read(spark, folder, "documents"), labels, held_out=remainder(4) == 2)


def quality_labels(spark: SparkSession, folder: str) -> DataFrame:
    return read(spark, folder, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("good"))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = judge(read(spark, folder, "documents"), quality_labels(spark, folder))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_CUTS = ", ".join(f"('{rule}', {i}, {c}::DOUBLE)" for rule, cs in RULES.items() for i, c in enumerate(cs))
OP2_MEASURES = r"""
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM {documents}),
w AS (SELECT rid, doc_id, stratum, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT rid, i, words[i:i+2] AS tri FROM (SELECT rid, words, unnest(generate_series(1, len(words) - 2)) AS i FROM w)),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (
          SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, tri) AS c FROM win) WHERE c > 1) GROUP BY rid),
m AS (SELECT w.rid, doc_id, stratum, len(words)::BIGINT AS n_words, length(list_aggregate(words, 'string_agg', '')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(regexp_replace(text, '[^!?]', '', 'g')) AS n_marks,
             len(lines) AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN rep ON w.rid = rep.rid),
v AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
             CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbols_per_word,
             CASE WHEN n_words > 0 THEN n_marks / n_words ELSE 0 END AS marks_per_word,
             CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeated_words,
             CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS repeated_lines,
             CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS word_length FROM m),
long AS (UNPIVOT (SELECT rid, doc_id, stratum, base_failed, symbols_per_word::DOUBLE AS symbols_per_word, marks_per_word::DOUBLE AS marks_per_word,
             repeated_words::DOUBLE AS repeated_words, repeated_lines::DOUBLE AS repeated_lines, word_length::DOUBLE AS word_length FROM v)
         ON symbols_per_word, marks_per_word, repeated_words, repeated_lines, word_length INTO NAME rule VALUE x),
cut(rule, step, cutoff) AS (VALUES """ + _CUTS + r"""),
marked AS (SELECT doc_id, min((quality = 1)::INT) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
t AS (SELECT stratum, long.rule, step, cutoff, sum(good)::BIGINT AS n, count(*) FILTER (x > cutoff AND good = 1) AS k,
             count(*) FILTER (x > cutoff AND good = 0) AS bad
      FROM long JOIN cut ON long.rule = cut.rule JOIN marked ON long.doc_id = marked.doc_id WHERE NOT base_failed GROUP BY ALL HAVING sum(good) > 0),
p AS (SELECT t.*, CASE WHEN k >= n * 0.004 THEN 1 ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.004) + (n - i) * ln(0.996)))
             FROM (SELECT unnest(generate_series(0, k)) AS i)) END <= 0.05 / (5 * (SELECT count(DISTINCT stratum) FROM t)) AS passed FROM t),
lim AS (SELECT stratum, rule, arg_max(cutoff, (bad - k) * 1000 - step) AS cutoff FROM (
          SELECT *, coalesce(min(step) FILTER (NOT passed) OVER (PARTITION BY stratum, rule), 1000) AS ended FROM p)
        WHERE step < ended GROUP BY ALL HAVING max(bad - k) > 0),
bad AS (SELECT DISTINCT rid FROM long JOIN lim ON long.rule = lim.rule AND long.stratum = lim.stratum WHERE x > cutoff),
judged AS (SELECT v.*, NOT base_failed AND rid NOT IN (SELECT rid FROM bad) AS kept FROM v)
"""
OP2_SQL = "WITH " + OP2_MEASURES.replace("{documents}", "documents") + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged
"""


def op3_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return score_texts(read(spark, folder, "documents"), held_out=remainder(5) == 1)


def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def op5_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_digests(read(spark, folder, "documents"))


def op6_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(read(spark, folder, "documents"))


#: shares of the expected tokens
MIX = {"en": 0.55, "de": 0.15, "es": 0.15, "fr": 0.15}


def domain_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Languages of the labelled documents, as a table of (id, domain)."""
    marked = read(spark, folder, "labels").select("doc_id").distinct()
    return read(spark, folder, "documents").select("doc_id", "lang").join(marked, "doc_id").select(F.col("doc_id").alias("id"), F.col("lang").alias("domain"))


def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing_rates(read(spark, folder, "documents"), domain_labels(spark, folder), MIX)


def op8_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return find_personal_data(read(spark, folder, "documents"))


def op9_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    turns = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    formatted = stage(chat.format_paths(chat.threads(turns)), "chat-formatted")
    return chat.conversation_digests(formatted).drop("leaf").withColumnRenamed("conv", "conv_id")


OP9_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|start|>' || '<|text|>' || '<|end|>') + length(replace(replace(role, '&', '&amp;'), '<', '&lt;'))
      + length(replace(replace(text, '&', '&amp;'), '<', '&lt;')))::BIGINT AS formatted_chars
FROM t WHERE conv_id IS NOT NULL GROUP BY conv_id
"""

URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = read(spark, folder, "pages").select("page_id", "url")
    return filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = f"""
WITH r(rhost, rpath, rverdict) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
k AS (SELECT DISTINCT host, path FROM p),
m AS (SELECT host, path, max_by(rhost || rpath, length(rhost) + length(rpath)) AS rule, max_by(rverdict, length(rhost) + length(rpath)) AS ruled
      FROM k JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path)
SELECT page_id, p.host, p.path, rule, coalesce(ruled, 'allow') AS verdict
FROM p LEFT JOIN m ON p.host = m.host AND p.path = m.path
"""


def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    rows = fim.fill_in_middle(read(spark, folder, "documents"), seed=7, rate=100, spm_rate=50)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(fim.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units,
             ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2, ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4 FROM d),
c AS (SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1))::BIGINT AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1))::BIGINT AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
                  WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, text, n, form, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


def op12_turn_repair(spark: SparkSession, folder: str) -> DataFrame:
    given = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    return turns.repair_report(turns.edits(turns.damage(given)), given)


def op13_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read(spark, folder, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


CHECKS = {
    "op1_toxicity": (op1_toxicity, None),
    "op2_quality_rules": (op2_quality_rules, OP2_SQL),
    "op3_lm_score": (op3_lm_score, None),
    "op4_decontaminate": (op4_decontaminate, None),
    "op5_token_files": (op5_token_files, None),
    "op6_ngram_join": (op6_ngram_join, None),
    "op7_mixing": (op7_mixing, None),
    "op8_personal_data": (op8_personal_data, None),
    "op9_chat_format": (op9_chat_format, OP9_SQL),
    "op10_url_filter": (op10_url_filter, OP10_SQL),
    "op11_fill_in_middle": (op11_fill_in_middle, OP11_SQL),
    "op12_turn_repair": (op12_turn_repair, None),
    "op13_nearest_vectors": (op13_nearest_vectors, None),
}
