"""Secrets in texts: patterns that stand alone, and weak parts that count only where they complete each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.support import table, with_running_totals

# The base patterns. {16,} and {14,} find what + and a later test of the length find, since a run that is
# too short holds no longer match; for assignments that isn't so, and the length is tested afterwards.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
MIN_ASSIGN = 12

# Parts of credentials that are too weak to be reported alone.
IDENTIFIER = r"""(?i)(?:access_key_id|client_id|account_id|tenant_id|username|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,64}"""
#: A token counts if it has characters of each of these kinds.
SECRET, MIXED = r"[A-Za-z0-9+/_=-]{20,}", ("[A-Z]", "[a-z]", "[0-9]")
ENDPOINT = r"""(?i)https?://[a-z0-9.-]{3,}(?::[0-9]{1,5})?(?:/[A-Za-z0-9._~%/-]*)?"""

KINDS = ["assign", "access", "hex", "identifier", "secret", "endpoint"]
#: The fewest code points that a span of each kind has; spans of a kind don't overlap, which bounds how many start nearby.
SHORTEST = {"assign": 8, "access": 18, "hex": 16, "identifier": 9, "secret": 20, "endpoint": 10}


def _with_spans(df: DataFrame, kind: str, pattern: str, where: Column | None = None) -> DataFrame:
    """Adds the array ``kind`` of (start, end, found): leftmost matches that don't overlap, in code points.

    A match begins where the pieces between matches and the matches before it end.
    """
    hit = F.col("text").rlike(pattern) if where is None else where & F.col("text").rlike(pattern)
    df = df.withColumn("_m", F.when(hit, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    step = lambda gap, i: (F.length(gap) + F.when(i > 0, F.length(F.get("_m", i - 1))).otherwise(0)).cast("long")
    gaps = F.slice(F.split("text", pattern, -1), 1, F.size("_m"))
    df = df.withColumn("_steps", F.when(F.size("_m") > 0, F.transform(gaps, step)).otherwise(F.array().cast("array<bigint>")))
    df = with_running_totals(df, "_steps", "_starts")
    spans = F.zip_with("_starts", "_m", lambda s, m: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("found")))
    return df.withColumn(kind, spans).drop("_m", "_steps", "_starts")


def find_secrets(docs: DataFrame, text_col: str = "text", radius: int = 200) -> DataFrame:
    """Spans of secrets: one row per input row, with ``row`` (the input row as a struct), ``base``, ``spans`` and ``links``.

    ``base`` holds what stands alone: assignments of 12 or more characters to a telling name, access key ids, long runs
    of hex digits. ``spans`` adds the weak parts - a named identifier, a mixed token or a short assignment (kind
    ``secret``), an address - where complementary parts start within ``radius`` code points of each other: a weak
    secret needs an identifier, an identifier needs a secret, an address needs both. Both are arrays of
    (start, rank, end, kind) in order; starts and ends count code points, ends are exclusive, and ``rank`` is the
    kind's place in ``KINDS``. ``links`` says which spans complete each other: a pair (a, b) of a name (an identifier or an
    access key id) and a secret (mixed token, assignment or hex run) of its scope, or of an address and a name of its
    scope, in the order of both. A span's scope is the stretch of ``radius`` code points around its start in its row.

    The interval join runs inside each row over the parts sorted by start: the parts within the radius of one are among
    the ``reach`` neighbours on either side, because spans of a kind are disjoint and have a least length. So the join
    is linear in the parts, whole in its results, and needs no exchange. Weak patterns are sought only in texts that
    have an identifier.

    Null or empty text has no spans. Ties in start are ordered by kind. Rows that repeat get equal results.
    """
    df = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    df = _with_spans(df, "assigned", ASSIGN)
    values = F.when(F.size("assigned") > 0, F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2))).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("values", values)
    df = df.withColumn("assigned", F.zip_with("assigned", "values", lambda s, v: F.struct(s["start"].alias("start"), s["end"].alias("end"), (F.length(v) >= MIN_ASSIGN).alias("strong"))))
    df = _with_spans(df, "access", ACCESS)
    df = _with_spans(df, "hex", HEX)
    df = _with_spans(df, "identifier", IDENTIFIER)
    named = (F.size("access") > 0) | (F.size("identifier") > 0)
    df = _with_spans(df, "token", SECRET, named)
    df = df.withColumn("token", F.filter("token", lambda s: s["found"].rlike(MIXED[0]) & s["found"].rlike(MIXED[1]) & s["found"].rlike(MIXED[2])))
    df = _with_spans(df, "endpoint", ENDPOINT, named)

    def parts(spans: Column, kind: str) -> Column:
        rank = KINDS.index(kind)
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    strong = F.filter("assigned", lambda s: s["strong"])
    base = F.sort_array(F.concat(parts(strong, "assign"), parts(F.col("access"), "access"), parts(F.col("hex"), "hex")))
    df = df.withColumn("base", base)
    weak = F.when(named, F.concat(parts(F.filter("assigned", lambda s: ~s["strong"]), "secret"), parts(F.col("token"), "secret"), parts(F.col("identifier"), "identifier"), parts(F.col("endpoint"), "endpoint")))
    weak = F.coalesce(weak, F.array().cast(f"array<struct<start:bigint,rank:int,end:bigint,kind:string>>"))
    df = df.withColumn("weak", weak)
    df = df.withColumn("all", F.when(F.size("weak") > 0, F.sort_array(F.concat("base", "weak"))).otherwise(F.col("base")))
    # tokens and short assignments are both secrets and may overlap: each counts for itself
    reach = sum(radius // n + 1 for n in SHORTEST.values()) + radius // SHORTEST["assign"] + 1
    names, secrets = [KINDS.index(k) for k in ("access", "identifier")], [KINDS.index(k) for k in ("assign", "hex", "secret")]

    def beside(part: Column, i: Column, ranks: list[int]) -> Column:
        near = F.slice("all", F.greatest(i - reach, F.lit(0)) + 1, 2 * reach + 1)
        return F.exists(near, lambda q: q["rank"].isin(ranks) & (F.abs(q["start"] - part["start"]) <= radius))

    # how far base spans reach that begin no later than each part, however long ago they began
    ends = F.transform("all", lambda q: F.when(q["rank"] < 3, q["end"]).otherwise(0).cast("long"))
    df = df.withColumn("_ends", F.when(F.size("weak") > 0, ends).otherwise(F.array().cast("array<bigint>")))
    df = with_running_totals(df, "_ends", "reached", add=lambda x, y: F.greatest(x, y))

    def covered(part: Column, i: Column) -> Column:
        """A weak secret that a reported base span already holds adds nothing."""
        return F.get("reached", i) >= part["end"]

    def keeps(part: Column, i: Column) -> Column:
        kind = part["kind"]
        return (
            F.when(part["rank"] < 3, True)
            .when(kind == "secret", beside(part, i, names) & ~covered(part, i))
            .when(kind == "identifier", beside(part, i, secrets))
            .otherwise(beside(part, i, names) & beside(part, i, secrets))
        )

    df = df.withColumn("spans", F.when(F.size("weak") > 0, F.filter("all", keeps)).otherwise(F.col("base")))

    def partners(part: Column, i: Column) -> Column:
        near = F.slice("spans", F.greatest(i - reach, F.lit(0)) + 1, 2 * reach + 1)
        fits = lambda q: (part["rank"].isin(names) & q["rank"].isin(secrets)) | ((part["rank"] == KINDS.index("endpoint")) & q["rank"].isin(names))
        return F.transform(F.filter(near, lambda q: fits(q) & (F.abs(q["start"] - part["start"]) <= radius)), lambda q: F.struct(part.alias("a"), q.alias("b")))

    span = "struct<start:bigint,rank:int,end:bigint,kind:string>"
    links = F.when(F.exists("spans", lambda p: p["rank"].isin(names)), F.flatten(F.transform("spans", partners))).otherwise(F.array().cast(f"array<struct<a:{span},b:{span}>>"))
    return df.select("row", "base", "spans", links.alias("links"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def listed_links(links: Column) -> Column:
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(links, lambda x: F.concat(text(x["a"]), F.lit("+"), text(x["b"]))), ",")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(F.col("row.doc_id").alias("doc_id"), count("assign"), count("access"), count("hex"), F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), listed_links(F.col("links")).alias("links"))


def _sql() -> str:
    """Spans by splitting at the matches, parts joined by the distance of their starts."""
    patterns = {"assigned": ASSIGN, "access": ACCESS, "hex": HEX, "identifier": IDENTIFIER, "token": SECRET, "endpoint": ENDPOINT}
    quoted = {k: p.replace("'", "''") for k, p in patterns.items()}
    kinds = " UNION ALL ".join(f"SELECT '{k}' AS found, '{p}' AS pattern" for k, p in quoted.items())
    return f"""
WITH p AS ({kinds}),
d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
m AS (
  SELECT rid, text, found, unnest(ms) AS hit, unnest(gs) AS gap, unnest(range(len(ms))) AS i
  FROM (SELECT rid, text, found, regexp_extract_all(text, pattern) AS ms, string_split_regex(text, pattern)[:-2] AS gs FROM d, p WHERE regexp_matches(text, pattern))
), s AS (
  SELECT rid, found, hit, (sum(length(gap) + length(hit)) OVER (PARTITION BY rid, found ORDER BY i) - length(hit))::BIGINT AS "start", length(hit) AS n,
         length(regexp_extract(hit, '{quoted["assigned"]}', 2)) AS value FROM m
), parts AS (
  SELECT rid, "start", "start" + n AS "end", CASE WHEN found = 'assigned' THEN CASE WHEN value >= {MIN_ASSIGN} THEN 0 ELSE 4 END
         ELSE CASE found WHEN 'access' THEN 1 WHEN 'hex' THEN 2 WHEN 'identifier' THEN 3 WHEN 'token' THEN 4 ELSE 5 END END AS rank
  FROM s WHERE found <> 'token' OR (regexp_matches(hit, '[A-Z]') AND regexp_matches(hit, '[a-z]') AND regexp_matches(hit, '[0-9]'))
), marked AS (
  SELECT rid, "start", "end", rank,
    EXISTS (SELECT 1 FROM parts q WHERE q.rid = a.rid AND q.rank IN (1, 3) AND abs(q."start" - a."start") <= 200) AS named,
    EXISTS (SELECT 1 FROM parts q WHERE q.rid = a.rid AND q.rank IN (0, 2, 4) AND abs(q."start" - a."start") <= 200) AS secret,
    EXISTS (SELECT 1 FROM parts q WHERE q.rid = a.rid AND q.rank < 3 AND q."start" <= a."start" AND q."end" >= a."end") AS held
  FROM parts a
), kept AS (
  SELECT rid, "start", "end", rank, ['assign', 'access', 'hex', 'identifier', 'secret', 'endpoint'][rank + 1] || ':' || "start" || ':' || "end" AS span
  FROM marked WHERE rank < 3 OR (rank = 3 AND secret) OR (rank = 4 AND named AND NOT held) OR (rank = 5 AND named AND secret)
), linked AS (
  SELECT a.rid, string_agg(a.span || '+' || b.span, ',' ORDER BY a."start", a.rank, a."end", b."start", b.rank, b."end") AS links
  FROM kept a JOIN kept b ON a.rid = b.rid AND abs(a."start" - b."start") <= 200 AND ((a.rank IN (1, 3) AND b.rank IN (0, 2, 4)) OR (a.rank = 5 AND b.rank IN (1, 3)))
  GROUP BY a.rid
)
SELECT any_value(doc_id) AS doc_id, (count(*) FILTER (WHERE rank = 0))::BIGINT AS n_assign, (count(*) FILTER (WHERE rank = 1))::BIGINT AS n_access,
       (count(*) FILTER (WHERE rank = 2))::BIGINT AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY "start", rank) FILTER (WHERE rank < 3), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY "start", rank, "end"), '') AS spans, coalesce(any_value(links), '') AS links
FROM d LEFT JOIN kept USING (rid) LEFT JOIN linked USING (rid) GROUP BY rid"""


ORACLE_SQL = _sql()
