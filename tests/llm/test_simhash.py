import random

import numpy as np
import pytest
import xxhash

from strandline.llm import simhash as s
from tests.llm.helpers import clashing, tricky

LOWER = {c: c + 32 for c in range(65, 91)}


def plain_fingerprint(text, k=3):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_fingerprints():
    for text in ["", " \t", "One", "one TWO", "a b c d e f", "É é ẞ x y z\x85w \xa0 q", "x " * 70_000, "\x1c \x1d\x1ea b"]:
        assert s.fingerprint(text.encode()) == plain_fingerprint(text)


def near(seed, n):
    """Clusters of fingerprints a few bits apart, chains among them."""
    r = random.Random(seed)
    out = []
    while len(out) < n:
        x = r.getrandbits(64)
        for _ in range(r.randrange(1, 9)):
            out.append(x)
            for _ in range(r.randrange(4)):
                x ^= 1 << r.randrange(64)
    return out[:n]


@pytest.mark.parametrize("limit", [20_000, 2])
def test_links_and_components(spark, limit):
    fps = near(1, 400)
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(v,) for v in set(signed)], "fp long")
    got = {r.node: r.root for r in s.components(s.links(df, list_limit=limit)).collect()}
    want = plain_components(fps)
    same = {}
    for v, w in zip(signed, want):
        same.setdefault(w, set()).add(got.get(v, v))
    assert all(len(x) == 1 for x in same.values())
    assert len({next(iter(x)) for x in same.values()}) == len(same)


def test_large_bucket_equals_small_bucket_rule():
    r = random.Random(3)
    center = r.getrandbits(64)
    fps = list({center ^ sum(1 << b for b in r.sample(range(40), r.randrange(9))) for _ in range(4000)})
    arr = np.array(fps, dtype=np.uint64)
    assert len(arr) > 2500

    def classes(edges):
        parent = {v: v for v in arr.view(np.int64).tolist()}

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in edges.tolist():
            parent[root(a)] = root(b)
        groups = {}
        for v in parent:
            groups.setdefault(root(v), set()).add(v)
        return sorted(map(sorted, groups.values()))

    large = s.bucket_edges(arr, 2)
    pairs = []
    sorted_ = np.sort(arr)
    for i, v in enumerate(sorted_):
        for j in np.flatnonzero(np.bitwise_count(sorted_[i + 1 :] ^ v) <= 2) + i + 1:
            pairs.append((v, sorted_[j]))
    assert classes(large) == classes(np.array(pairs, dtype=np.uint64).view(np.int64).reshape(-1, 2))
    assert len(large) < len(arr)


def test_chain_and_star_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(-5, 300), (300, 7)]
    got = {r.node: r.root for r in s.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == -5 for i in range(61)) and all(got[100 + i] == 100 for i in range(40)) and got[300] == -5
    assert s.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_against_brute_force(spark):
    r = random.Random(5)
    texts = [" ".join(r.choice("abcdefghij") + r.choice("xyz") for _ in range(60)) for _ in range(40)]
    texts += [t.replace("ax", "bx", 1) for t in texts[:20]] + texts[:10] + ["", " ", None, "One", "one"]
    docs = spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {x.doc_id: x for x in s.near_duplicates(docs).collect()}
    fps = [plain_fingerprint(t or "") for t in texts]
    want = plain_components(fps)
    for i in range(len(texts)):
        assert got[i * 3].fp % 2**64 == fps[i] and got[i * 3].component_id == want[i] * 3


def test_odd_rows(spark):
    docs = clashing(tricky(spark), ["fp", "root", "least", "component_id"])
    got = s.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    empty = {r.component_id for r in got if r.fp == 0}
    assert empty == {1}
    assert s.near_duplicates(docs.limit(0)).count() == 0
