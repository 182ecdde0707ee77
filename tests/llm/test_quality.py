import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from strandline.llm import quality as q
from tests.llm.helpers import clashing, tricky

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_base_counts():
    r = random.Random(1)
    for i in range(300):
        text = "".join(r.choice(["a", "b", "é", "\U0001f600", " ", " ", "\n", "\t", "[", "]", "#", "|", "\x1c", "\xa0", "\x85", "\x0b", "word", " "]) for _ in range(r.randrange(80)))
        assert q.base_counts(text.encode()) == plain_counts(text), repr(text)
    for i in range(400):
        text = " ".join(r.choice("abcdefgh" if i % 2 else "ab") * r.choice([1, 1, 2]) for _ in range(r.randrange(30, 150)))
        counts = plain_counts(text)
        assert q.passes_base(text) == (not (counts[0] < 50 or 100 * counts[-1] > 50 * counts[0]), counts[0])


def plain_symbols(text, order):
    """Code points; runs of white space are one blank, runs of an ASCII mark one mark, blanks come before the text."""
    out = [" "] * (order - 1)
    for c in text:
        c = " " if c in " \t\n\x0b\x0c\r\0" else c
        if not (c == out[-1] and ord(c) < 128 and not c.isalnum()):
            out.append(c)
    return out


def plain_kneser_ney(texts, order, least):
    """The textbook recursion over symbols, with dictionaries; pruned n-grams have what their history's weight leaves them."""
    grams = Counter()
    for t in texts:
        s = plain_symbols(t, order)
        for i in range(order - 1, len(s)):
            grams[tuple(s[i - order + 1 : i + 1])] += 1
    n, c = {order: grams}, {order: grams}
    for k in range(order - 1, 0, -1):
        n[k] = Counter()
        for g, x in n[k + 1].items():
            n[k][g[1:]] += x
        c[k] = Counter(g[1:] for g in n[k + 1])
    d = {k: (0, *q.discounts(*[sum(v == j for v in c[k].values()) for j in (1, 2, 3, 4)])) for k in c}
    size = len(n[1])

    def whole(g):
        k = len(g)
        if not k:
            return 1 / (size + 1)
        follow = [v for h, v in c[k].items() if h[:-1] == g[:-1]]
        x = c[k].get(g, 0)
        return (max(x - d[k][min(x, 3)], 0) + sum(d[k][min(v, 3)] for v in follow) * whole(g[1:])) / sum(follow)

    kept = {k: {g: whole(g) for g, x in n[k].items() if x >= max(least, 2 if k > 2 else 1)} for k in n}

    def p(g):
        k = len(g)
        if not k or g in kept[k]:
            return kept[k][g] if k else 1 / (size + 1)
        siblings = [h for h in kept[k] if h[:-1] == g[:-1]]
        weight = max(1 - sum(kept[k][h] for h in siblings), 1e-9) / max(1 - sum(whole(h[1:]) for h in siblings), 1e-9)
        return weight * p(g[1:])

    return grams, p


@pytest.mark.parametrize("order, most", [(2, 1 << 20), (3, 1 << 20), (4, 1 << 20), (3, 300)])
def test_model_against_the_recursion(spark, order, most):
    r = random.Random(2)
    texts = [" ".join("".join(r.choice("abcd.9é漢") for _ in range(r.randrange(1, 5))) for _ in range(60)) for _ in range(20)] + ["  a  b", "..  !!a\0b aa"]
    total = sum(len(plain_symbols(t, order)) - order + 1 for t in texts)
    grams, p = plain_kneser_ney(texts, order, -(-total // most))
    rows = [("x", "".join(g), n) for g, n in grams.items()]
    models = q.kneser_ney(spark.createDataFrame(rows, "lang string, gram string, n long"), order, most)
    model = _model(models, order)
    asked = list(grams)[:150] + [tuple(r.choice("abcd.9é漢 z") for _ in range(order)) for _ in range(100)]
    for g in asked:
        x = np.array([ord(c) for c in g], dtype=np.uint32)
        own = q.hashes(x, order)
        before = [np.zeros(1, dtype=np.uint64), *(h[order - 2 : order - 1] for h in own[:-1])]
        got = model.score([h[order - 1 :] for h in own], before)
        assert abs(got[0] - math.log(p(g))) < 1e-4, g
    every = sorted({g[-1] for g in grams})
    for history in {g[:-1] for g in asked[:40]}:  # probabilities add up, with one symbol never seen
        assert abs(sum(p((*history, c)) for c in every) + p((*history, "~")) - 1) < 1e-6
    scorer = q.Scorer({"x": model}, order)
    for t in texts:  # the mean of what the recursion says
        s = plain_symbols(t, order)
        want = [-math.log(p(tuple(s[i - order + 1 : i + 1]))) for i in range(order - 1, len(s))]
        assert abs(scorer.loss("x", t) - sum(want) / len(want)) < 1e-4


def _model(tables, order):
    grams, weights, sizes = tables
    keys, logp, histories, weight = ([None] * order for _ in range(4))
    for found, name, a, b, less in ((grams.collect(), "gram", keys, logp, 0), (weights.collect(), "history", histories, weight, 1)):
        for k in range(1, order + 1):
            rows = sorted(zip(q.gram_hashes([r[name] for r in found if r.k == k], k - less).tolist(), [r[3] for r in found if r.k == k]))
            a[k - 1], b[k - 1] = np.array([x for x, _ in rows], dtype=np.uint64), np.array([y for _, y in rows])
    return q.Model(keys, logp, histories, weight, -math.log(sizes["x"] + 1))


def test_counts_cover_whole_texts(spark):
    r = random.Random(3)
    texts = [" ".join("".join(r.choice("abcdéж") for _ in range(r.randrange(1, 7))) for _ in range(n)) for n in (60, 70, 20_000)] + ["too short to count", None, ""]
    docs = spark.createDataFrame([(t, "x") for t in texts], "text string, lang string").repartition(2)
    got = {x.gram: x.n for x in q.counted(docs, ["x"], "text", "lang", 3).collect()}
    want = Counter()
    for t in texts[:3]:
        s = plain_symbols(t, 3)
        want.update("".join(s[i - 2 : i + 1]) for i in range(2, len(s)))
    assert got == dict(want)


def test_bound_with_a_hundred_languages(spark):
    """Whatever the languages, no order sends more n-grams than the bound, nor more histories."""
    r = random.Random(4)
    rows = [(f"l{k}", "".join(chr(0x400 + 40 * (k % 20) + int(40 * r.random() ** 2)) for _ in range(3)), r.randrange(1, 40)) for k in range(100) for _ in range(300)]
    counts = spark.createDataFrame(rows, "lang string, gram string, n long").groupBy("lang", "gram").sum("n").toDF("lang", "gram", "n")
    grams, weights, sizes = q.kneser_ney(counts, 3, 1000)
    assert len(sizes) == 100
    for table in (grams, weights):
        per = {x.k: x["count"] for x in table.groupBy("k").count().collect()}
        assert per and all(n <= 1000 for n in per.values())


def corpus():
    """Clean texts of two languages, and junk."""
    r = random.Random(5)
    parts = {"en": ["th", "er", "on", "an", "re", "ing", "ed", "ou"], "de": ["sch", "ein", "ung", "lich", "ge", "ver", "ß", "ö"]}
    text = lambda lang, n=120: " ".join("".join(r.choice(parts[lang]) for _ in range(r.randrange(1, 4))) for _ in range(n)) + "."
    rows = [(i, text("en" if i % 2 else "de"), "en" if i % 2 else "de", "clean") for i in range(400)]
    rows += [(1000 + i, " ".join("".join(r.choice("qxzjkvw$%&0;é") for _ in range(r.randrange(3, 9))) for _ in range(90)), lang, "junk") for i, lang in enumerate(["en", "de", "en"])]
    rows += [(1100, " ".join("zq" * r.randrange(1, 30) + "%" * (i % 7) for i in range(90)), "de", "junk")]
    rows += [(1200, text("en", 90) + " " + text("de", 60), "en", "foreign"), (1201, text("en", 49), "en", "short"), (1202, text("en", 20) * 5, "en", "repeats")]
    return rows


def test_junk_in_a_part_and_wrong_languages(spark):
    """A fifth of junk at the end, a label of another language and junk in another script go; clean texts stay."""
    r = random.Random(7)
    base = [row for row in corpus() if row[3] == "clean" and row[0] < 400]
    cyrillic = ["при", "ста", "но", "ени", "ко", "раз", "ть", "во"]
    text = lambda: " ".join("".join(r.choice(cyrillic) for _ in range(r.randrange(1, 4))) for _ in range(150))
    base += [(500 + i, text(), "ru", "clean") for i in range(100)]
    junk = lambda n: " ".join("".join(r.choice("qxzjkvwyQXZ0") for _ in range(r.randrange(3, 9))) for _ in range(n))
    rows = list(base)
    for i, t, lang, _ in base[:40]:
        n = len(t)
        rows.append((2000 + i, t + " " + junk(200)[: n // 4], lang, "junk"))  # 20 % of the whole
    rows += [(3000 + i, t, "de" if lang == "en" else "en", "junk") for i, t, lang, _ in base[40:44]]
    rows += [(4000, "".join(r.sample("".join(set("".join(cyrillic))) * 60, 600)), "ru", "junk"), (4001, " ".join(r.sample(list(text().replace(" ", "")) * 2, 400)), "ru", "junk")]
    got = {x.doc_id: x for x in q.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, kind string")).collect()}
    assert [i for i, _, _, kind in rows if kind == "junk" and got[i].kept] == []
    assert [i for i, _, _, kind in rows if kind == "clean" and not got[i].kept] == []


def test_verdicts(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, kind string")
    got = {r.doc_id: r for r in q.quality(docs).collect()}
    for ident, text, _, kind in corpus():
        r = got[ident]
        n, *rest = plain_counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest)
        assert r.base_failed == (n < 50 or 100 * rest[-1] > 50 * n)
        assert r.kept == (kind == "clean"), (ident, kind, r)
    kept = q.keep_good(docs)
    assert kept.schema == docs.schema and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in got.items() if r.kept)


def test_odd_rows(spark):
    docs = clashing(tricky(spark), ["loss", "band", "kept", "n_words", "n"])
    got = q.quality(docs).collect()
    assert len(got) == docs.count() and not any(r.kept for r in got) and all(r.loss is None for r in got)  # none passes the base rules, so there is no model
    prose = spark.createDataFrame([(i, t, lang, "p", 1) for i, t, lang, kind in corpus() if kind == "clean"], tricky(spark).schema)
    got = q.quality(tricky(spark).unionByName(prose)).collect()
    assert not any(r.kept for r in got if r.n_words < 50) and sum(r.loss is None for r in got) == 6  # null, empty or white space only, or a language in which no document passes the base rules
    assert q.quality(docs.limit(0)).count() == 0 and q.keep_good(docs.limit(0)).count() == 0
    assert set(q.keep_good(docs).columns) == set(docs.columns)


def singles(text):
    """A text's share of letters that few others have: n-grams far down in a corpus's counts."""
    r = random.Random(text)
    return " ".join(w if r.random() < 0.9 else "".join(chr(0x4E00 + int(600 * r.random() ** 3)) for _ in w) for w in text.split(" "))


def test_rare_ngrams_count(spark):
    """However few n-grams are sent out, losses are those of the recursion over all."""
    rows = [(i, singles(t), lang) for i, t, lang, kind in corpus() if kind == "clean" and lang == "en" and i < 60]
    rows += [(900, "#" * 20 + " neverſeen %&; " * 3, "en"), (901, rows[0][1][:100] + " qqxzj", "en")]  # fail the base rules, and hold n-grams of no other text
    docs = spark.createDataFrame([*rows, (902, None, "en"), (903, " ", None)], "doc_id long, text string, lang string")
    grams, p = plain_kneser_ney([t for i, t, _ in rows if i < 900], 3, 1)
    for most in (0, 40, 300, 1 << 20):
        got = {x.doc_id: x for x in q.quality(docs, order=3, most_grams=most).collect()}
        trained = q.train(docs, order=3, most_grams=most)
        assert trained.whole == (most > 300) and sum(len(k) for m in trained.sent.values() for k in m.keys) <= (most if most <= 300 else 3 * most)
        for i, t, _ in rows[:3] + rows[-2:]:
            s = plain_symbols(t, 3)
            want = [-math.log(p(tuple(s[j - 2 : j + 1]))) for j in range(2, len(s))]
            assert abs(got[i].loss - sum(want) / len(want)) < 1e-4, (most, i)
        assert got[902].loss is None and got[903].loss is None and len(got) == len(rows) + 2


@pytest.mark.parametrize("most", [0, 60, 500])
def test_what_is_sent_changes_nothing(spark, most):
    rows = [(i if i % 7 else None, singles(t) if i % 5 == 0 else t, lang if i % 11 else None) for i, t, lang, _ in corpus()]
    docs = spark.createDataFrame(rows + rows[:30], "doc_id long, text string, lang string").repartition(3)
    plain = lambda rows: sorted(map(repr, rows))
    whole, part = q.quality(docs).collect(), q.quality(docs, most_grams=most).collect()
    assert plain(whole) == plain(part) and 0 < sum(x.kept for x in whole) < len(whole)
    want = Counter((x.doc_id, x.n_words, x.word_chars) for x in whole if x.kept)
    for kept in (q.keep_good(docs), q.keep_good(docs, most_grams=most)):
        assert Counter((x.doc_id, len(WORD.findall(x.text)), sum(map(len, WORD.findall(x.text)))) for x in kept.collect()) == want
