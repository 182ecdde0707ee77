"""The queries of the training-data operators and the SQL that some of them must equal."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import chat, line_dedup, matroska, mixing, packing, quality, secrets, simhash, substrings, warc
from strandline.llm.support import table

QUERIES = {
    "op1_matroska": matroska.op1_matroska,
    "op2_substrings": substrings.op2_substrings,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_secrets": secrets.op4_secrets,
    "op5_mixing": mixing.op5_mixing,
    "op6_packing": packing.op6_packing,
    "op7_quality": quality.op7_quality,
    "op8_simhash": simhash.op8_simhash,
    "op9_warc": warc.op9_warc,
    "op10_chat": chat.op10_chat,
}
ORACLE_SQL = {
    "op3_line_dedup": line_dedup.ORACLE_SQL,
    "op4_secrets": secrets.ORACLE_SQL,
    "op10_chat": chat.ORACLE_SQL,
}


# --- columns of operators whose whole result SQL can't express -------------------------------------------------------


def payloads_of_op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was stored and read back, by its length and digest."""
    return matroska.op1_matroska(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def targets_of_op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and targets, and by how much a source's taken words miss its target: less than a word and a rounding."""
    found = mixing.op5_mixing(spark, sf_dir)
    sources = table(spark, sf_dir, "documents").select("doc_id", "source")
    each = found.join(sources, "doc_id").groupBy("source").agg(F.sum("size").alias("size"), F.min("target").alias("target"), F.max("target").alias("most"), F.sum("taken").alias("taken"), F.min("source_size").alias("source_size"))
    near = (F.abs(F.col("target") - F.col("taken")) < 1.001) & (F.col("target") == F.col("most")) & (F.col("size") == F.col("source_size"))
    return each.select("source", "size", F.round("target", 3).alias("target"), near.alias("near"))


def base_counts_of_op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of the base rules, which need no model."""
    return quality.score(table(spark, sf_dir, "documents"), {}).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES |= {"payloads_of_op1": payloads_of_op1, "targets_of_op5": targets_of_op5, "base_counts_of_op7": base_counts_of_op7}

_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
ORACLE_SQL |= {
    "payloads_of_op1": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), n AS (SELECT *, strlen(text) AS n FROM d),
p AS (SELECT *, CASE WHEN n = 0 THEN 192 ELSE (192 - n % 192) % 192 END AS pad FROM n)
SELECT doc_id, n::BIGINT AS n_bytes, (n + pad)::BIGINT AS payload_bytes, sha256(text || repeat(' ', pad::BIGINT)) AS payload_sha256 FROM p""",
    # the cap is met in turns: a source that is held at three times its size in one turn is held in all that follow
    "targets_of_op5": f"""
WITH RECURSIVE s AS (
  SELECT source, sum(len({_WORDS}))::DOUBLE AS size FROM (SELECT source, coalesce(text, '') AS text FROM documents) GROUP BY source
), w AS (SELECT *, 1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS weight FROM s
), turns AS (
  SELECT 0 AS turn, source, size, weight, false AS held, (SELECT sum(size) FROM w) AS rest, (SELECT sum(weight) FROM w WHERE size > 0) AS open FROM w
  UNION ALL
  SELECT turn + 1, source, size, weight, now, total - sum(CASE WHEN now THEN 3 * size ELSE 0 END) OVER (), sum(CASE WHEN now OR size = 0 THEN 0 ELSE weight END) OVER ()
  FROM (SELECT *, size > 0 AND rest * weight / open > 3 * size AS now, sum(size) OVER () AS total FROM turns WHERE turn < 30 AND open > 0)
)
SELECT source, size::BIGINT AS size, round(CASE WHEN size = 0 THEN 0 ELSE least(rest * weight / open, 3 * size) END, 3) AS target, true AS near
FROM turns WHERE turn = 30""",
    "base_counts_of_op7": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (SELECT rid, {_WORDS} AS ws FROM d
), g AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3
), t AS (SELECT rid, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM g
), o AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM t
), r AS (SELECT rid, count(DISTINCT place)::BIGINT AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS place FROM o WHERE n > 1) GROUP BY rid
), l AS (SELECT rid, (count(*) - count(DISTINCT line))::BIGINT AS n FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^ 	-]') GROUP BY rid
), c AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[ 	-]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM d JOIN w USING (rid) LEFT JOIN l USING (rid) LEFT JOIN r USING (rid)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c""",
}
