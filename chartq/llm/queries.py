"""Registered queries of the training-data operators: thin digests over the operators' outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartq.llm import alignment, bpe, chat, decontam, mixing, negatives, phrases, quality, secrets, simhash, suffix, topk, toxicity
from chartq.llm.common import fold, read_table, utf8

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


OP1_SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('20:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS place
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3.0::DOUBLE * sum(size)::DOUBLE AS most,
         (1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3)::DOUBLE AS weight,
         row_number() OVER (ORDER BY source ASC NULLS LAST) AS s,
         sum(sum(size)) OVER ()::DOUBLE AS total
  FROM sized GROUP BY source),
levels AS (
  SELECT *, (total - coalesce(sum(most) OVER (ORDER BY most / weight, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY most / weight, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
  FROM per),
aimed AS (
  SELECT *, CASE WHEN most <= lev * weight THEN most
                 ELSE weight * max(CASE WHEN most > lev * weight THEN lev END) OVER () END AS target
  FROM levels),
passes AS (
  SELECT *, floor(target / greatest(source_size, 1))::BIGINT AS passes FROM aimed),
rests AS (SELECT *, target - passes * source_size AS rest FROM passes),
placed AS (
  SELECT d.source, place, sum(size)::BIGINT AS w FROM sized d GROUP BY ALL),
runs AS (
  SELECT p.source, p.place, r.rest, p.w, sum(p.w) OVER (PARTITION BY p.source ORDER BY p.place)::BIGINT AS upto,
         ((p.place >> 30) * greatest(ceil(r.source_size / 50000.0)::BIGINT, 1)) >> 30 AS block
  FROM placed p JOIN rests r ON p.source IS NOT DISTINCT FROM r.source WHERE r.rest > 0),
edge AS (SELECT source, min(block) AS block FROM runs WHERE upto >= rest GROUP BY source),
inside AS (
  SELECT r.*, r.rest - coalesce(max(CASE WHEN upto <= rest THEN upto END) OVER (PARTITION BY r.source), min(upto - w) OVER (PARTITION BY r.source)) AS gap,
         coalesce(max(CASE WHEN upto <= rest THEN place END) OVER (PARTITION BY r.source), min(place) OVER (PARTITION BY r.source) - 1) AS cut
  FROM runs r JOIN edge e ON r.source IS NOT DISTINCT FROM e.source AND r.block = e.block),
cuts AS (
  SELECT source, any_value(cut) AS cut,
         arg_min(place, (abs(w - gap), place)) FILTER (WHERE place > cut AND abs(w - gap) < gap) AS extra
  FROM inside GROUP BY source)
SELECT d.doc_id, d.size, r.source_size, r.target,
       (CASE WHEN r.target > 0 THEN d.size * (r.passes + CASE WHEN d.place <= c.cut OR d.place = c.extra THEN 1 ELSE 0 END) ELSE 0 END)::BIGINT AS taken
FROM sized d JOIN rests r ON d.source IS NOT DISTINCT FROM r.source
LEFT JOIN cuts c ON d.source IS NOT DISTINCT FROM c.source
"""


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized, sources, draws = mixing.plan(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    held = mixing.drawn(sized, sources, draws)
    return held.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).cast("long").alias("taken"))


ORACLE["op1_mix"] = OP1_SQL


@_query
def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return topk.search(docs, docs.where("doc_id % 50 = 0")).withColumn("score", F.round("score", 6))


@_query
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"), texts=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@_query
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.scan(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select(
        "row.doc_id", "hits.n_words", "hits.n_hit", F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hits.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("hits.n_hit") > 0).alias("contaminated"))


@_query
def op5_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrases.dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text"), texts=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


@_query
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def number(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select("row.doc_id", *[number(k).alias(f"n_{k}") for k in secrets.KINDS],
                        F.sha2(secrets.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        secrets.joined(F.array_sort(F.concat("base", "added"))).alias("spans"))


@_query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    fitted = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    found = docs.select("doc_id", (fold() == 0).alias("held_out"), toxicity.score_column(spark, fitted).alias("s"))
    return found.select("doc_id", "held_out", "s.score", (F.col("s.score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
                        F.size("s.passages").cast("long").alias("n_passages"))


@_query
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16("fp").alias("fingerprint"), "component_id")


@_query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", (fold() == 0).alias("held_out"), quality.score_column(spark, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


# The templates are written out here, apart from the operator's.
ORACLE["op10_chat"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|im_', '<| im_') AS said FROM conversations),
p AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, said) - 1 AS pos FROM t),
who AS (SELECT DISTINCT conv_id, role AS participant FROM t WHERE role <> 'system'),
piece AS (
  SELECT p.conv_id, p.pos // 512 AS segment, w.participant, p.pos, p.role = w.participant AS own,
         CASE WHEN p.role = w.participant THEN '<|im_start|>assistant' || chr(10) WHEN p.role = 'system' THEN '<|im_start|>system' || chr(10)
              ELSE '<|im_start|>user name=' || regexp_replace(p.role, '[^A-Za-z0-9_-]', '_', 'g') || chr(10) END AS head,
         p.said || '<|im_end|>' AS body
  FROM p JOIN who w ON p.conv_id IS NOT DISTINCT FROM w.conv_id),
placed AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, segment, participant ORDER BY pos
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start
  FROM piece)
SELECT conv_id, segment::BIGINT AS segment, participant, count(*)::BIGINT AS n_turns, sum(own::INT)::BIGINT AS n_own,
       string_agg(head || body || chr(10), '' ORDER BY pos) AS rendered,
       coalesce(string_agg(CASE WHEN own THEN start::BIGINT || ':' || (start + length(body))::BIGINT END, ',' ORDER BY pos), '') AS mask
FROM placed GROUP BY conv_id, segment, participant
"""


@_query
def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.perspectives(read_table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return found.withColumn("mask", mask)


@_query
def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coder = bpe.Tokenizer(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    found = coder.decode(coder.encode(read_table(spark, sf_dir, "documents").select("doc_id", "text")))
    return found.select("row.doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(bpe.packed("ids"), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


ORACLE["op12_hard_negatives"] = """
WITH fit AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pair AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM fit a JOIN fit b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positive AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM pair WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, p.positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other)::INTEGER AS rank,
       n.other AS negative_id, p.positive_score, n.score AS negative_score
FROM positive p JOIN pair n ON p.anchor_id = n.anchor_id AND NOT n.same
 AND 50 * p.positive_score <= 100 * n.score AND 100 * n.score <= 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.other) <= 3
"""


@_query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = negatives.prepare(given.withColumn("label", moved))
    return negatives.mine(rows, F.col("vec_id") % 50 == 0).drop("anchor", "positive")


@_query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))[0]
