import random
import re
from collections import defaultdict

import pytest

from strandline.llm import substrings as s
from tests.llm.helpers import clashing, tricky


def brute(rows, span_words):
    """Every unit of every document in order of rank, against a dictionary of those seen."""
    first, out = {}, []
    for ident, text in sorted(rows):
        run = []
        for k, (a, b, n, normal) in enumerate(s.units(text)):
            seen = first.setdefault(normal, (ident, a)) != (ident, a)
            if seen and run and run[-1][0] == k - 1:
                run.append((k, a, b, n, first[normal]))
            else:
                out.append((ident, run))
                run = [(k, a, b, n, first[normal])] if seen else []
        out.append((ident, run))
    return sorted((i, r[0][1], r[-1][2], len(r), sum(x[3] for x in r), *r[0][4]) for i, r in out if r and sum(x[3] for x in r) >= span_words)


def plain_words(text):
    """(start, end, word) by the contract's rule, without the operator's help."""
    return [(m.start(), m.end(), "".join(c.lower() if "A" <= c <= "Z" else c for c in m[0])) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]


def windows_before(rows):
    """For each row in order of rank the word windows of five that stand in rows before it, and its own words."""
    seen = set()
    for ident, text in sorted(rows):
        words = plain_words(text)
        yield ident, words, set(seen)
        seen |= {tuple(w for *_, w in words[i : i + 5]) for i in range(len(words) - 4)}


def sentence(r, n=None):
    return " ".join("".join(r.choice("abcdefg") for _ in range(r.randrange(2, 7))) for _ in range(n or r.randrange(1, 14))).capitalize() + r.choice([".", ".", "!", "?..."])


def corpus(seed):
    r = random.Random(seed)
    passages = [" ".join(sentence(r) for _ in range(9)) for _ in range(5)] + [sentence(r, 70)]
    docs = []
    for i in range(80):
        words = " ".join(r.choice([" ", "\n"]) + sentence(r) for _ in range(r.randrange(1, 25))).split(" ")
        for p in r.sample(passages, r.randrange(3)):
            words.insert(r.randrange(len(words) + 1), r.choice([p, p.upper(), p.replace(" ", "  ")]))
        docs.append((i, " ".join(words)))
    return docs + [(100 + i, docs[i][1]) for i in range(10)], passages


@pytest.mark.parametrize("least", [0, 20])
def test_against_brute_force(spark, least):
    rows, _ = corpus(1)
    got = s.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), span_words=least).collect()
    assert sorted((r.doc_id, r.start, r.end, r.n_units, r.n_words, r.first_doc_id, r.first_start) for r in got) == brute(rows, least)


def test_against_word_windows(spark):
    """What goes is found before; of what is found before in runs of 50 words, most goes; what isn't found before stays."""
    rows, _ = corpus(5)
    gone = defaultdict(list)
    for x in s.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), span_words=20).collect():
        gone[x.doc_id].append((x.start, x.end))
    repeated = caught = 0
    for ident, words, before in windows_before(rows):
        known = [False] * len(words)
        for i in range(len(words) - 4):
            if tuple(w for *_, w in words[i : i + 5]) in before:
                known[i : i + 5] = [True] * 5
        out = [any(a <= x and y <= b for a, b in gone[ident]) for x, y, _ in words]
        assert not any(o and not k for o, k in zip(out, known))
        at = 0
        while at < len(words):
            end = at
            while end < len(words) and known[end]:
                end += 1
            if end - at >= 50:
                repeated, caught = repeated + end - at, caught + sum(out[at:end])
            at = end + 1
    assert repeated > 2000 and caught > 0.75 * repeated


def test_verse_and_dialogue_that_are_copied_go_whole(spark):
    r = random.Random(9)
    words = lambda n: sentence(r, n).rstrip(".!?")
    poem = "\n".join(words(4) for _ in range(40))
    dialogue = "\n".join(words(12 if k % 2 else 3) for k in range(30))
    rows = [(1, poem), (2, poem), (3, dialogue), (4, dialogue.upper()), (5, words(60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {x.row.doc_id: x.kept for x in s.without_spans(docs, s.repeated_spans(docs)).collect()}
    assert kept[1] == poem and kept[3] == dialogue and kept[5] == rows[4][1]
    assert kept[2].strip() == "" and kept[4].strip() == ""


def test_long_passages_are_found_wherever_they_stand(spark):
    r = random.Random(3)
    host = lambda: " ".join(sentence(r) for _ in range(20)).split(" ")
    passages = [" ".join(sentence(r, r.randrange(4, 15)) for _ in range(8)) for _ in range(30)]
    rows = []
    for i, p in enumerate(passages):
        for j in range(2):
            words = host()
            words.insert(r.randrange(len(words)), p)
            rows.append((10 * i + j, " ".join(words)))
    rows += [(1000 + i, " ".join(host())) for i in range(50)]
    found = {x.doc_id: x for x in s.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), span_words=20).collect()}
    assert set(found) == {10 * i + 1 for i in range(30)}
    for i, p in enumerate(passages):
        x, text = found[10 * i + 1], dict(rows)[10 * i + 1]
        assert x.first_doc_id == 10 * i and text[x.start : x.end] in p and x.n_words > 0.6 * len(p.split())


def test_passages_in_short_lines(spark):
    r = random.Random(8)
    words = lambda n: sentence(r, n).rstrip(".!?")
    verse = lambda: "\n".join(words(r.randrange(1, 5)) for _ in range(40))
    mixed = lambda: "\n".join(words(r.randrange(6, 12) if k % 2 else r.randrange(1, 4)) for k in range(20))
    rows = []
    for i in range(20):
        p = (verse if i % 2 else mixed)()
        rows += [(10 * i, f"{verse()}\n{p}\n{mixed()}"), (10 * i + 1, f"{words(3)}\n{p}\n{verse()}")]
    gone = defaultdict(int)
    for x in s.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), span_words=20).collect():
        gone[x.doc_id] += x.n_words
    assert set(gone) == {10 * i + 1 for i in range(20)} and all(n >= 40 for n in gone.values())


def test_units_cover_their_text():
    for text in ["", "\n\n", "One. Two! a.b c", "a b c d e f. g", "x\x1cy z w v u t.", "ü " * 60, " lead and trail with  gaps \t.  ", "1.5 is not. a stop? " * 9, "no end " * 40]:
        last = 0
        for a, b, n, normal in s.units(text):
            assert last <= a < b <= len(text) and s._WORD.findall(text[a:b].translate(s._LOWER)) == normal.split(" ") and n == len(normal.split(" "))
            last = b
        assert sum(n for *_, n, _ in s.units(text)) == len(s._WORD.findall(text))


def test_removal_keeps_offsets(spark):
    rows, _ = corpus(2)
    docs = clashing(spark.createDataFrame([*rows, (None, "no id"), (500, None)], "doc_id long, text string"), ["kept", "gone", "pieces", "start"])
    spans = s.repeated_spans(docs)
    gone = defaultdict(list)
    for x in spans.collect():
        gone[x.doc_id].append((x.start, x.end))
    for x in s.without_spans(docs, spans).collect():
        text = x.row.text or ""
        assert "".join(text[p.start : p.end] for p in x.pieces) == x.kept
        want = "".join(c for i, c in enumerate(text) if not any(a <= i < b for a, b in gone[x.row.doc_id]))
        assert x.kept == want


def test_rows_that_share_an_id_or_have_none(spark):
    """Each text has its own spans: another text with the same id, or without one, is left alone."""
    r = random.Random(10)
    first, other, third = (" ".join(sentence(r, 12) for _ in range(5)) for _ in range(3))
    rows = [(1, first), (2, first + " " + sentence(r, 9)), (2, other), (None, first), (None, third), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(x.row.doc_id, x.row.text, x.kept.strip()) for x in s.without_spans(docs, s.repeated_spans(docs)).collect()]
    by_text = {text: k for _, text, k in kept if text not in (None, first)}
    assert by_text[other] == other and by_text[third] == third and by_text[rows[1][1]] == rows[1][1][len(first) :].strip()
    assert sorted(k for _, text, k in kept if text == first) == ["", first]
    repeats = spark.createDataFrame([(7, first), (7, first), (8, first)], "doc_id long, text string")
    assert sorted((x.row.doc_id, x.kept) for x in s.without_spans(repeats, s.repeated_spans(repeats)).collect()) == [(7, first), (7, first), (8, "")]


def test_odd_rows(spark):
    docs = clashing(tricky(spark), ["h1", "unit", "first", "other", "start"])
    got = s.repeated_spans(docs).collect()
    assert {r.doc_id for r in got} <= {6, 7}  # the ones that repeat themselves
    assert s.repeated_spans(docs.limit(0)).count() == 0
    kept = s.without_spans(docs, s.repeated_spans(docs))
    assert kept.count() == docs.count() and all(x.kept == "" for x in kept.collect() if not x.row.text)
