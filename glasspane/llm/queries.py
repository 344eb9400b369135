"""Registered queries of the training-data operators, and check queries in DuckDB SQL where SQL can state the result."""

from __future__ import annotations

import importlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import contamination, hmm, mixing, neardup, negatives, pieces, pii, quality, repetition, resample, secrets, toxicity, urlrules

# Target weights of the mix; what is not named shares REST_WEIGHT.
TARGETS = {f"src{i}": 1.0 + i % 5 for i in range(20)}
REST_WEIGHT = 2.0


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


# Written address rules of the check.
ADDRESS_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")


def counted(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


def find_secrets(spark: SparkSession, path: str) -> DataFrame:
    rows = secrets.find(read(spark, path, "documents"))
    base = F.filter("spans", lambda x: x["kind"].isin(*secrets.BASE))
    return rows.select("doc_id", *[counted("spans", k) for k in secrets.BASE], F.sha2(listed(base), 256).alias("base_sha256"),
                       listed(F.col("spans")).alias("spans"))


def judge_addresses(spark: SparkSession, path: str) -> DataFrame:
    return urlrules.judge(read(spark, path, "pages"), ADDRESS_RULES)


def mix_sources(spark: SparkSession, path: str) -> DataFrame:
    rows = read(spark, path, "documents").select("doc_id", "source", "text")
    return mixing.mix(rows, TARGETS, REST_WEIGHT).drop("text")


def toxicity_scores(spark: SparkSession, path: str) -> DataFrame:
    docs, held_out = read(spark, path, "documents"), C.fold("doc_id", 5) == 0
    return toxicity.score(docs, toxicity.train(docs, read(spark, path, "labels"), held_out), held_out)


def find_personal_data(spark: SparkSession, path: str) -> DataFrame:
    rows = pii.find(read(spark, path, "documents"))
    return rows.select("doc_id", *[counted("base", k) for k in pii.KINDS], F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def benchmark_leaks(spark: SparkSession, path: str) -> DataFrame:
    return contamination.find(read(spark, path, "documents"), read(spark, path, "benchmark"))


def near_duplicates(spark: SparkSession, path: str) -> DataFrame:
    return neardup.label(read(spark, path, "documents"))


def quality_scores(spark: SparkSession, path: str) -> DataFrame:
    docs, held_out = read(spark, path, "documents"), C.fold("doc_id", 3) == 1
    return quality.score(docs, quality.train(docs, read(spark, path, "labels"), held_out), held_out)


def repetition_rules(spark: SparkSession, path: str) -> DataFrame:
    return repetition.judge(read(spark, path, "documents"))


def language_model(spark: SparkSession, path: str) -> DataFrame:
    return hmm.score(hmm.train(read(spark, path, "documents"), C.fold("doc_id", 10) == 0))


def piece_model() -> str:
    """Where the vocabulary of the check lies."""
    return importlib.import_module("public_tokenizers").path("piece_bpe_32k.model")


def piece_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids of every text and what they decode to; `agrees` where the library gives the same ids and text."""
    coded = pieces.encode(read(spark, path, "documents"), piece_model(), back=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"), "agrees")


def draw_like_benchmark(spark: SparkSession, path: str) -> DataFrame:
    return resample.resample(read(spark, path, "documents"), read(spark, path, "benchmark"), percent=10, seed=2024)


def hard_negatives(spark: SparkSession, path: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(read(spark, path, "embeddings"), F.col("vec_id") % 100 == 0, label, low=30, high=90)


QUERIES = {
    "op1_secrets": find_secrets,
    "op2_mixing": mix_sources,
    "op3_toxicity": toxicity_scores,
    "op4_address_rules": judge_addresses,
    "op5_personal_data": find_personal_data,
    "op6_repetition": repetition_rules,
    "op7_benchmark_leaks": benchmark_leaks,
    "op8_near_duplicates": near_duplicates,
    "op9_quality": quality_scores,
    "op10_language_model": language_model,
    "op11_pieces": piece_ids,
    "op12_resampling": draw_like_benchmark,
    "op13_hard_negatives": hard_negatives,
}

_SHARES = mixing.exact(TARGETS, REST_WEIGHT)
_CYCLE = sum(_SHARES.values())

CHECKS = {
    # The schedule of a cycle, slot by slot: among the released blocks the one due first. Then every block's slot, then the order.
    "op2_mixing": f"""
WITH RECURSIVE share(pool, c) AS (VALUES {', '.join(f"('{k}', {v})" for k, v in _SHARES.items())}),
edf(slot, state, pick) AS (
  SELECT -1, list({{'pool': pool, 'c': c, 'done': 0}}), '' FROM share
  UNION ALL
  SELECT slot + 1, list_transform(state, lambda s: {{'pool': s.pool, 'c': s.c, 'done': s.done + CASE WHEN s.pool = best THEN 1 ELSE 0 END}}), best
  FROM (SELECT slot, state, list_sort(list_transform(list_filter(state, lambda s: s.done < s.c AND s.done * {_CYCLE} // s.c <= slot + 1),
          lambda s: {{'due': ((s.done + 1) * {_CYCLE} + s.c - 1) // s.c, 'light': -s.c, 'pool': s.pool}}))[1].pool AS best
        FROM edf WHERE slot + 1 < {_CYCLE})),
slots AS (SELECT pick AS pool, slot, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS j FROM edf WHERE slot >= 0),
ranked AS (SELECT doc_id, source, CASE WHEN source IN ({', '.join(f"'{k}'" for k in TARGETS)}) THEN source ELSE '' END AS pool,
  md5(coalesce(cast(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS digest FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY digest) - 1 AS mix_rank FROM ranked),
slotted AS (SELECT p.doc_id, p.source, p.pool AS mix_pool, p.mix_rank, p.mix_rank // 64 + 1 AS mix_block,
  (p.mix_rank // 64) // s.c * {_CYCLE} + t.slot AS mix_slot
  FROM placed p JOIN share s ON s.pool = p.pool JOIN slots t ON t.pool = p.pool AND t.j = (p.mix_rank // 64) % s.c)
SELECT doc_id, source, mix_pool, mix_rank, mix_block, mix_slot,
  row_number() OVER (ORDER BY mix_slot, mix_rank) - 1 AS mix_position FROM slotted""",
    # Words by one pattern, CRC-32 of each distinct word byte by byte, then counts, gains, weights and ranks as the task states them.
    "op12_resampling": f"""
WITH texts AS (SELECT doc_id, row_number() OVER () AS r, 0 AS goal, text FROM documents UNION ALL SELECT NULL, row_number() OVER (), 1, text FROM benchmark),
words AS (SELECT doc_id, r, goal, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts),
each AS (SELECT goal, r, unnest(w) AS word FROM words),
bytes AS (SELECT word, list_transform(range(1, length(h), 2), lambda i: cast('0x' || substr(h, i, 2) AS BIGINT)) AS b
  FROM (SELECT DISTINCT word, hex(encode(word)) AS h FROM each)),
bucket AS (SELECT word, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, step[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM bytes, (SELECT {resample.CRC.tolist()} AS step)),
n AS (SELECT bucket, cast(count(*) FILTER (goal = 0) AS DOUBLE) AS s, cast(count(*) FILTER (goal = 1) AS DOUBLE) AS t FROM each JOIN bucket USING (word) GROUP BY bucket),
total AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM n),
gain AS (SELECT bucket, cast(floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000)))) AS BIGINT) AS gain FROM n, total),
mean AS (SELECT r, cast(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM each JOIN bucket USING (word) JOIN gain USING (bucket) WHERE goal = 0 GROUP BY r),
scored AS (SELECT doc_id, r, cast(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
  cast('0x' || substr(sha256('2024:' || coalesce(cast(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM words LEFT JOIN mean USING (r) WHERE goal = 0),
noisy AS (SELECT *, weight + cast(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM scored),
placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, count(*) OVER () AS all_of FROM noisy WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * all_of // 100 THEN place END AS rank FROM noisy LEFT JOIN placed USING (r)""",
    # Every anchor against every row.
    "op13_hard_negatives": """
WITH rows_in AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * cast(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (SELECT a.r AS ar, a.vec_id AS anchor_id, b.r AS br, b.vec_id AS other, a.label = b.label AS same, cast(list_inner_product(a.v, b.v) AS BIGINT) AS s
  FROM rows_in a JOIN rows_in b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
positive AS (SELECT * FROM pair WHERE same QUALIFY row_number() OVER (PARTITION BY ar ORDER BY s DESC, other NULLS LAST) <= 5),
found AS (SELECT p.anchor_id, p.other AS positive_id, n.other AS negative_id, p.s AS positive_score, n.s AS negative_score,
  row_number() OVER (PARTITION BY p.ar, p.br ORDER BY n.s DESC, n.other NULLS LAST) AS rank
  FROM positive p JOIN pair n ON n.ar = p.ar AND NOT n.same AND 30 * p.s <= 100 * n.s AND 100 * n.s <= 90 * p.s)
SELECT anchor_id, positive_id, cast(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 10""",
}
