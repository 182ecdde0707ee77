import hashlib
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from strandline.llm.line_dedup import drop_common_lines
from tests.llm.helpers import clashing, tricky

BLANKS = " \t\n\x0b\x0c\r"
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, min_docs):
    key = lambda line: line.strip(BLANKS).translate(LOWER)
    seen = defaultdict(set)
    for ident, text in rows:
        for line in (text or "").split("\n"):
            seen[key(line)].add(ident)
    gone = {k for k, d in seen.items() if k and len(d) >= min_docs}
    out = []
    for ident, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in gone]
        out.append((ident, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def check(spark, rows, min_docs):
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"), ["key", "pos", "gone", "lines", "row", "n_lines", "h1"])
    got = drop_common_lines(docs, min_docs=min_docs).select("row.doc_id", "n_lines", "n_dropped", "kept").collect()
    assert Counter(map(tuple, got)) == brute(rows, min_docs)


def test_against_brute_force(spark):
    r = random.Random(1)
    pool = ["Same Line", "same line ", "\tSAME LINE\r", "é", "É", "", "  ", "x ", "x  ", "\xa0pad\xa0", "a\x1cb", "only here"] + [f"line {i}" for i in range(30)]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(r.randrange(1, 12)))) for i in range(60)]
    rows += [(None, "same line\nline 1"), (None, "same line"), (200, None), (201, ""), (5, rows[5][1]), (5, rows[5][1]), (6, "other text, same id\nline 3")]
    for n in (2, 3, 10):
        check(spark, rows, n)


def test_many_lines_and_repeats(spark):
    rows = [(i, "\n".join(["hot"] * 2000 + [f"own {i} {k}" for k in range(2000)] + ["hot"])) for i in range(10)]
    check(spark, rows, 10)
    check(spark, rows, 11)  # a line that only repeats within documents isn't common


def test_odd_rows(spark):
    docs = tricky(spark)
    got = drop_common_lines(docs).collect()
    assert len(got) == docs.count() and all(x.n_dropped == 0 and x.kept == (x.row.text or "") for x in got)
    assert drop_common_lines(docs.limit(0)).count() == 0
    assert drop_common_lines(docs.withColumn("more", F.array(F.lit(1)))).first().row.more == [1]


def test_query_digest(spark, tmp_path):
    from strandline.llm.line_dedup import op3_line_dedup

    rows = [(i, f"common\nown {i}") for i in range(10)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for x in op3_line_dedup(spark, str(tmp_path)).collect():
        assert (x.n_lines, x.n_dropped, x.kept_sha256) == (2, 1, hashlib.sha256(f"own {x.doc_id}".encode()).hexdigest())
