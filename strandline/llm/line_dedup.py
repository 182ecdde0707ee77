"""Lines that many documents share are dropped from every document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.support import cut, lower_ascii, row_key, table, BLANKS


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z in lower case."""
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def drop_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1, parts: int = 32) -> DataFrame:
    """Drop the lines whose key occurs in at least ``min_docs`` distinct documents.

    Returns one row per input row: ``row`` (the input row as a struct, so that its column names can't clash),
    ``n_lines``, ``n_dropped`` and ``kept`` (the remaining lines joined by a newline).

    Lines are exploded with their positions and hashed to 128 bits; the hashes, without text, are counted by distinct
    document, and those over the threshold meet the exploded positions again in a semi join. Only positions travel
    back to the documents, where the kept stretches between them are sliced out.

    Null or empty text is one empty line, whose key is too short to be counted. Keys of fewer than ``min_chars`` code
    points are always kept. Documents are told apart by id: rows with the same id count once, all null ids count as
    one document. Equal rows get equal results. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.select(row_key(F.col(id_col), text).alias("key"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line")).select("key", "pos", line_key(F.col("line")).alias("line"))
    lines = lines.filter(F.length("line") >= min_chars)
    # texts are taken apart once
    lines = cut(lines.select("key", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")))
    common = (
        lines.select("h1", "h2", F.struct("key.id").alias("doc"))
        .distinct()
        .groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_docs)
        .select("h1", "h2")
    )
    # a line that a third of all documents have would meet its hash in one task: each hash goes to several parts
    lines = lines.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)))
    common = common.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    dropped = lines.join(common, ["h1", "h2", "part"], "left_semi").groupBy("key").agg(F.array_sort(F.collect_set("pos")).alias("gone"))
    base = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), row_key(F.col(id_col), text).alias("key"))
    both = base.join(dropped, base["key"].eqNullSafe(dropped["key"]), "left")
    both = both.select("row", F.split(F.coalesce(F.col("row").getField(text_col), F.lit("")), "\n", -1).alias("lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    # stretch k lies between the dropped positions k - 1 and k; each line is copied once
    start = lambda k: F.when(k == 0, 0).otherwise(F.get("gone", k - 1) + 1)
    end = lambda k: F.coalesce(F.get("gone", k), F.size("lines"))
    stretches = F.transform(F.sequence(F.lit(0), F.size("gone")), lambda k: F.slice("lines", start(k) + 1, end(k) - start(k)))
    return both.select(
        "row",
        F.size("lines").cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_dropped"),
        F.when(F.size("gone") == 0, F.array_join("lines", "\n")).otherwise(F.array_join(F.flatten(stretches), "\n")).alias("kept"),
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drop_common_lines(table(spark, sf_dir, "documents"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT rid, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d
), k AS (
  SELECT rid, doc_id, pos, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), c AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT any_value(k.doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(c.key)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.key = c.key
GROUP BY rid
"""
