"""Repeated passages: normalised units of lines, hashed over the whole corpus; the first occurrence stays."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strandline.llm.support import cut, small_batches, table, LOWER, UPPER

_LOWER = str.maketrans(UPPER, LOWER)
_SENTENCE = re.compile(r"[^\n.!?]*(?:[.!?]+(?![ \t\r\x0b\x0c\n]|$)[^\n.!?]*)*(?:[.!?]+|(?=\n)|$)")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Fewest words of a unit but the last of a text; sentences of more are cut; after one word in so many; most words.
LEAST_WORDS, LONG_WORDS, CUT, MOST_WORDS = 5, 24, 8, 48


def units(text: str, least_words: int = LEAST_WORDS) -> list[tuple[int, int, int, str]]:
    """(start, end, words, normal form) of the units of a text, in code points, the end exclusive.

    Units end after sentences and lines of ``least_words`` words or more; shorter ones join what follows, across line
    ends too. A run of short lines is cut after lines with an even checksum, and every 24 words at least, once it has
    ``least_words``. So only the last unit of a text can be shorter. A sentence of over 24 words is cut after words whose
    checksum is a multiple of 8, and every 48 words at least. So where a unit ends depends on the words just before, and two copies of a passage fall into step after its first boundary wherever they stand.
    The normal form is the words in lower case (A-Z), joined by one space.
    """
    out, at, n = [], 0, len(text)
    held: list[tuple[int, int, str]] = []
    while at <= n:
        line_start, line_end = at, text.find("\n", at)
        line_end = n if line_end < 0 else line_end
        while at < line_end:
            stop = max(_SENTENCE.match(text, at, line_end).end(), at + 1)
            part = text[at:stop].translate(_LOWER)
            words = part.split() if part.isascii() and "\x1c" > max(part.translate(_CONTROL), default="") else _WORD.findall(part)
            if len(words) > LONG_WORDS:
                for m in _WORD.finditer(part):
                    held.append((at + m.start(), at + m.end(), m[0]))
                    if len(held) >= least_words and (len(held) >= MOST_WORDS or zlib.crc32(m[0].encode("utf-8", "surrogatepass")) % CUT == 0):
                        out.append(_unit(held))
                        held = []
                if len(held) >= least_words:
                    out.append(_unit(held))
                    held = []
            elif words:
                first = at + len(part) - len(part.lstrip(_BLANKS))
                last = at + len(part.rstrip(_BLANKS))
                if not held and len(words) >= least_words:
                    out.append((first, last, len(words), " ".join(words)))
                else:
                    held.extend((first, last, w) for w in words)
                    if len(words) >= least_words:
                        out.append(_unit(held))
                        held = []
            at = stop
        if len(held) >= least_words:
            own = [w for start, _, w in held if start >= line_start]
            if len(own) >= least_words or len(held) >= LONG_WORDS or (own and zlib.crc32(" ".join(own).encode("utf-8", "surrogatepass")) % 2 == 0):
                out.append(_unit(held))
                held = []
        at = line_end + 1
    if held:
        out.append(_unit(held))
    return out


_BLANKS = " \t\n\x0b\x0c\r"
#: Keeps only the control characters at which str.split would part words that are one here.
_CONTROL = {c: None for c in range(128) if c not in (0x1C, 0x1D, 0x1E, 0x1F)}


def _unit(held: list[tuple[int, int, str]]) -> tuple[int, int, int, str]:
    return held[0][0], held[-1][1], len(held), " ".join(w for _, _, w in held)


UNITS = "doc_id bigint, other bigint, unit_words bigint, start_end bigint, h1 bigint, h2 int"


def content(text: Column) -> Column:
    """What tells rows apart that share an id or have none: a hash of the text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def hashed_units(docs: DataFrame, id_col: str, text_col: str, least_words: int) -> DataFrame:
    """Units with 96 bits of hash; two numbers share a long (``unit`` and words, start and end), as these rows are many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        names = [c.split()[0] for c in UNITS.split(", ")]
        types = [*[pa.int64()] * 5, pa.int32()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), types)], names=names)

        for got in batches:
            rows = []
            for ident, other, text in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), got.column(2)):
                for k, (start, end, words, normal) in enumerate(units(text.as_py() or "", least_words)):
                    h = xxhash.xxh3_128_intdigest(normal.encode("utf-8", "surrogatepass"))
                    rows.append((ident, other, k << 32 | words, start << 32 | end, (h & (2**64 - 1)) - (1 << 63), (h >> 64 & (2**32 - 1)) - (1 << 31)))
                if len(rows) >= 20_000:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), content(F.col(text_col)).alias("other"), F.col(text_col).alias("text"))
    return plain.transform(small_batches).mapInArrow(run, UNITS)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, span_words: int = 0) -> DataFrame:
    """Spans to remove: doc_id, other, start, end (code points of the original text, end exclusive), n_units, n_words, first_doc_id, first_start.

    Digests of units are grouped over all documents. The occurrence with the lowest rank (doc_id, then content, then
    place; rows without an id after all others) stays; the rest are removed, those that run on, unit after unit, as one
    span. With ``span_words`` only spans of that many words or more are, so that a stock phrase alone takes nothing
    from a document. ``first_doc_id`` and ``first_start`` are where the span's first unit stays.

    Texts are read once; only digests and places are stored and exchanged; what is unique goes before the join, and
    partial sums bear a unit that a third of all documents have. Null and empty texts have no units. A document is an id
    and a text (``other`` is a hash of it): rows that share both are one and have the same spans, rows that share an id
    alone don't. An empty table gives an empty result.
    """
    found = cut(hashed_units(docs, id_col, text_col, least_words))
    high, low = lambda c: F.shiftright(c, 32), lambda c: F.col(c).bitwiseAND(F.lit((1 << 32) - 1))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "other", high("start_end").alias("start"))
    first = found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("first")).filter("n > 1").drop("n")
    later = found.join(first, ["h1", "h2"]).filter(rank != F.col("first"))
    document = ["doc_id", "other"]
    later = later.select(*document, high("unit_words").alias("unit"), high("start_end").alias("start"), low("start_end").alias("end"), low("unit_words").alias("words"), F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start")).distinct()
    island = F.col("unit") - F.dense_rank().over(W.partitionBy(*document).orderBy("unit"))
    at_start = lambda c: F.min_by(c, "start").alias(c)
    spans = later.withColumn("island", island).groupBy(*document, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_units"), F.sum("words").alias("n_words"), at_start("first_doc_id"), at_start("first_start"))
    return spans.filter(F.col("n_words") >= span_words).select(*document, "start", "end", "n_units", "n_words", "first_doc_id", "first_start")


def without_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row`` (the input row), ``kept`` (its text without its spans) and ``pieces``: (start, end) in the original of what stays.

    Spans belong to an id, null included, and a text: rows with another text keep theirs. Null texts are empty.
    """
    gone = spans.groupBy(F.col("doc_id").alias("gone_id"), F.col("other").alias("gone_other")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("gone"))
    base = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"), content(F.col(text_col)).alias("other"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    both = base.join(gone, (base["other"] == gone["gone_other"]) & base["id"].eqNullSafe(gone["gone_id"]), "left").select("row", "text", F.coalesce("gone", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("gone"))
    start = lambda k: F.when(k == 0, F.lit(0).cast("long")).otherwise(F.get("gone", k - 1)["end"])
    end = lambda k: F.coalesce(F.get("gone", k)["start"], F.length("text").cast("long"))
    pieces = F.transform(F.sequence(F.lit(0), F.size("gone")), lambda k: F.struct(start(k).alias("start"), end(k).alias("end")))
    both = both.withColumn("pieces", F.filter(pieces, lambda p: p["end"] > p["start"]))
    kept = F.array_join(F.transform("pieces", lambda p: F.substring("text", (p["start"] + 1).cast("int"), (p["end"] - p["start"]).cast("int"))), "")
    return both.select("row", kept.alias("kept"), "pieces")


#: Of the query: passages are looked for, not stock phrases.
SPAN_WORDS = 20


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"), span_words=SPAN_WORDS).drop("other")
