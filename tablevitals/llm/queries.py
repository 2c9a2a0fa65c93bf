"""One query per operator over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablevitals.llm.balltree import top_inner_products
from tablevitals.llm.bpe_backtrack import encode_and_decode
from tablevitals.llm.bpe_heap import count_tokens
from tablevitals.llm.chosen_path import jaccard_join
from tablevitals.llm.common import documents, text_crc32
from tablevitals.llm.gru_lm import score_documents
from tablevitals.llm.minwise_trees import near_duplicates
from tablevitals.llm.mixing import temperature_mix
from tablevitals.llm.pii_weak import digests, find_personal_data
from tablevitals.llm.polarisation import whiten
from tablevitals.llm.quality_mcd import quality_rules
from tablevitals.llm.sharding import shard_uniformly
from tablevitals.llm.toxicity import HELD_OUT, score_toxicity, train_toxicity
from tablevitals.llm.turn_grammar import damaged, repair_conversations

SHARDS = 24
MIX = {"target_entropy": 0.97, "max_repeats": 2.0, "blocks": 64, "seed": 5}


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; the same on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    rows = docs.select("doc_id", size.alias("size"), text_crc32("text").alias("text_crc32"), F.lit("rows").alias("law"))
    return shard_uniformly(rows, SHARDS).withColumn("grown_shard", F.lit(None).cast("int"))


def op2_toxicity_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.coalesce(F.pmod(text_crc32("doc_id"), F.lit(4)) == HELD_OUT, F.lit(False))
    return score_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    return quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op4_heap_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_path("byte_bpe_50k.json"))


def op5_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return temperature_mix(docs, **MIX).select("doc_id", "source", "pass_no", "mix_block", "mix_order")


def op6_backtracking_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_decode(documents(spark, sf_dir).select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"))


def op7_ball_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_inner_products(vectors, F.col("vec_id") % 50 == 0)


def op8_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(find_personal_data(documents(spark, sf_dir).select("doc_id", "text")))


def op9_gru_log_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir).select("doc_id", "text"))


def op10_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(documents(spark, sf_dir).select("doc_id", "text"))


def op11_turn_grammar_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair_conversations(damaged(turns), turns.select("conv_id"))


def op12_polarisation_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return rows.withColumn("deviation", F.col("deviation").cast("long"))


def op13_minwise_tree_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_hypergeometric_shards,
        op2_toxicity_trees,
        op3_quality_outliers,
        op4_heap_token_counts,
        op5_temperature_mix,
        op6_backtracking_bpe,
        op7_ball_tree_search,
        op8_weak_supervision_pii,
        op9_gru_log_likelihood,
        op10_chosen_path_join,
        op11_turn_grammar_repair,
        op12_polarisation_whitening,
        op13_minwise_tree_duplicates,
        pipeline,
    )
}

# The bisection of the exponent is a recursion; the rest follows the plan of the mixture.
OP5_SQL = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, source, coalesce('=' || source, '-') AS s,
         greatest(coalesce(len(regexp_extract_all(text, '[^ \\x09-\\x0D]+')), 0), 1) AS tokens
  FROM documents),
totals AS (SELECT s, sum(tokens)::DOUBLE AS t FROM rows GROUP BY s),
shares AS (SELECT s, t, t / sum(t) OVER () AS p, sum(t) OVER () AS total FROM totals),
want AS (SELECT {MIX['target_entropy']} * ln(count(*)::DOUBLE) AS h, -sum(p * ln(p)) AS own FROM shares),
bisect_entropy AS (
  SELECT 0 AS i, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
  UNION ALL
  SELECT i + 1,
         CASE WHEN ok THEN (low + high) / 2 ELSE low END, CASE WHEN ok THEN high ELSE (low + high) / 2 END
  FROM (SELECT b.i, b.low, b.high,
               (SELECT -sum(w * ln(w)) FROM (SELECT pow(p, (b.low + b.high) / 2) / sum(pow(p, (b.low + b.high) / 2)) OVER () AS w
                                             FROM shares)) >= (SELECT h FROM want) AS ok
        FROM bisect_entropy b WHERE b.i < 60)),
first AS (SELECT CASE WHEN own >= h THEN 1.0 ELSE (SELECT high FROM bisect_entropy WHERE i = 60) END AS a FROM want),
within AS (
  SELECT (SELECT max(w / p) / min(w / p) FROM (SELECT p, pow(p, a) / sum(pow(p, a)) OVER () AS w FROM shares)) <= {MIX['max_repeats']} AS ok
  FROM first),
bisect_repeats AS (
  SELECT 0 AS i, (SELECT a FROM first)::DOUBLE AS low, 1.0::DOUBLE AS high
  UNION ALL
  SELECT i + 1,
         CASE WHEN far THEN (low + high) / 2 ELSE low END, CASE WHEN far THEN high ELSE (low + high) / 2 END
  FROM (SELECT b.i, b.low, b.high,
               (SELECT max(w / p) / min(w / p) FROM (SELECT p, pow(p, (b.low + b.high) / 2) / sum(pow(p, (b.low + b.high) / 2)) OVER () AS w
                                                     FROM shares)) > {MIX['max_repeats']} AS far
        FROM bisect_repeats b WHERE b.i < 60)),
exponent AS (
  SELECT CASE WHEN (SELECT ok FROM within) THEN (SELECT a FROM first) ELSE (SELECT high FROM bisect_repeats WHERE i = 60) END AS a),
weights AS (SELECT s, t, p, total, pow(p, (SELECT a FROM exponent)) / sum(pow(p, (SELECT a FROM exponent))) OVER () AS w FROM shares),
plan AS (
  SELECT s, t::BIGINT AS t, greatest(round(w * total * (SELECT 1.0 / min(w / p) FROM weights))::BIGINT, 1) AS b FROM weights),
drawn AS (
  SELECT doc_id, source, r.s, tokens, t, b, pass_no,
         md5('{MIX['seed']}:' || pass_no || ':' || coalesce(doc_id::VARCHAR, '')) AS o
  FROM rows r JOIN plan USING (s), unnest(range(0, ceil(b::DOUBLE / t)::BIGINT)) AS x(pass_no)),
placed AS (
  SELECT *, pass_no * t + coalesce(sum(tokens) OVER (PARTITION BY s, pass_no ORDER BY o
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM drawn)
SELECT doc_id, source, pass_no::INTEGER AS pass_no, (start * {MIX['blocks']} // b)::INTEGER AS mix_block,
       md5(o || ':block') AS mix_order
FROM placed WHERE start < b
"""

OP7_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""

# One row of candidates a state and turn; the key of cost and audit finds the best of each. Said is the repaired text's lines.
OP11_SQL = """
WITH RECURSIVE named AS (
  SELECT conv_id, coalesce('=' || conv_id, '-') AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
                                        lambda x: ord(x)::BIGINT),
                         lambda crc, x: list_reduce([xor(crc, x), 0, 0, 0, 0, 0, 0, 0, 0],
                                                    lambda b, z: xor(b >> 1, 3988292384 * (b & 1))), 4294967295::BIGINT),
             4294967295) % 20 AS code
  FROM conversations),
damaged AS (
  SELECT c, turn, CASE code WHEN 4 THEN 'user' ELSE role END AS role,
         CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM named, unnest(range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))),
ordered AS (
  SELECT *, substr(role, 1, 1) AS initial, regexp_extract(text, '([^ \\x09-\\x0D])[ \\x09-\\x0D]*\\z', 1) AS last,
         row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, md5(strlen(role) || ':' || role || text)) AS k
  FROM damaged),
judged AS (
  SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY k) AS copy, last = '' AS blank,
         last <> '' AND copy > 1 AS duplicate, last <> '' AND copy = 1 AND last NOT IN ('.', '!', '?') AS truncated,
         coalesce(lag(initial) OVER (PARTITION BY c ORDER BY k) || initial NOT IN ('su', 'ua', 'au'), false) AS illegal
  FROM ordered),
inserted(before, state, price, letters, new) AS (
  VALUES (0, 0, 0, '', []), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []),
         (0, 2, 3, 'I', ['user:']), (1, 2, 3, 'I', ['user:']), (3, 2, 3, 'I', ['user:']), (2, 3, 3, 'I', ['assistant:']),
         (0, 3, 6, 'II', ['user:', 'assistant:']), (1, 3, 6, 'II', ['user:', 'assistant:'])),
steps(state, letter, who, after, price) AS (
  VALUES (0, 'D', '', 0, 4), (1, 'D', '', 1, 4), (2, 'D', '', 2, 4), (3, 'D', '', 3, 4),
         (0, 'K', 's', 1, 0), (0, 'K', 'u', 2, 0), (1, 'K', 'u', 2, 0), (3, 'K', 'u', 2, 0), (2, 'K', 'a', 3, 0),
         (0, 'R', 'user', 2, 3), (1, 'R', 'user', 2, 3), (3, 'R', 'user', 2, 3), (2, 'R', 'assistant', 3, 3)),
walk AS (
  SELECT DISTINCT c, 0::BIGINT AS k, 0 AS state, '000000000000' AS best, []::VARCHAR[] AS said FROM named
  UNION ALL
  SELECT c, k, after, min(best), arg_min(said, best) FROM (
    SELECT w.c, j.k, s.after,
           lpad((w.best[:12]::BIGINT + i.price + s.price + CASE WHEN s.letter <> 'D' AND j.truncated THEN 3 ELSE 0 END)::VARCHAR, 12, '0')
             || w.best[13:] || i.letters || s.letter AS best,
           list_concat(w.said, i.new, CASE s.letter WHEN 'D' THEN [] WHEN 'K' THEN [j.role || ':' || j.text] ELSE [s.who || ':' || j.text] END) AS said
    FROM walk w JOIN judged j ON j.c = w.c AND j.k = w.k + 1
         JOIN inserted i ON i.before = w.state JOIN steps s ON s.state = i.state
    WHERE s.letter = 'D' OR (NOT j.blank AND NOT j.duplicate AND (s.letter = 'R' OR s.who = j.initial)))
  GROUP BY c, k, after),
ended AS (
  SELECT c, min(best) AS best, arg_min(said, best) AS said FROM (
    SELECT w.c, lpad((w.best[:12]::BIGINT + i.price)::VARCHAR, 12, '0') || w.best[13:] || i.letters AS best, list_concat(w.said, i.new) AS said
    FROM walk w JOIN (SELECT c, max(k) AS k FROM walk GROUP BY c) USING (c, k) JOIN inserted i ON i.before = w.state
    WHERE i.state IN (0, 3))
  GROUP BY c),
figures AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank,
         count_if(duplicate) AS duplicate, count_if(truncated) AS truncated, count_if(illegal) AS illegal
  FROM judged GROUP BY c)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, best[:12]::BIGINT AS cost,
       best[13:] AS audit, sha256(array_to_string(said, chr(10))) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, c FROM named) JOIN ended USING (c) LEFT JOIN figures USING (c)
"""

ORACLE: dict[str, str] = {
    "op11_turn_grammar_repair": OP11_SQL,
    "op5_temperature_mix": OP5_SQL,
    "op7_ball_tree_search": OP7_SQL,
}
