"""SimHash fingerprints, linked through an inverted index on byte positions, and their components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from strandline.llm.support import MAP_BITS, cut, map_of, small_batches, table, tidy

BYTES = 8
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: bytes, words: int = 3) -> int:
    """64 bits: a bit is 1 if it is set in over half of the shingles' hashes. Text without words: 0."""
    import xxhash

    parts = text.translate(_LOWER).split()  # bytes split at ASCII white space only
    if not parts:
        return 0
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        hashes = [digest(joined, 42)]
    else:
        view, lengths = memoryview(joined), np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: len(parts) - words + 1].tolist()
        hashes = [digest(view[a:b], 42) for a, b in zip(starts, ends[words - 1 :].tolist())]
    n, counts = len(hashes), np.zeros(64, dtype=np.int64)
    for i in range(0, n, 65_536):
        bits = np.unpackbits(np.array(hashes[i : i + 65_536], dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed long, of each row's whole text (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            fps = [fingerprint(t.as_py() or b"", words) for t in got.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([got.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).transform(small_batches).mapInArrow(run, "doc_id bigint, fp bigint")


def bucket_edges(fps: np.ndarray, distance: int) -> np.ndarray:
    """Pairs of a forest that connects what the links connect, among distinct fingerprints that share a posting.

    Small buckets compare each fingerprint with the rest in blocks: positional bytes that are equal are tallied, pairs
    below the guaranteed minimum go, the rest are verified bit by bit. In large ones each fingerprint looks up all that
    differ in up to ``distance`` bits, so time grows with the bucket and not with its square.
    """
    fps = np.unique(fps.astype(np.uint64))
    n, parent = len(fps), np.arange(len(fps))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edges = []

    def join(left: np.ndarray, right: np.ndarray) -> None:
        for a, b in zip(left.tolist(), right.tolist()):
            if (x := root(a)) != (y := root(b)):
                parent[max(x, y)] = min(x, y)
                edges.append((a, b))

    if n <= 2500:
        rows = fps.view(np.uint8).reshape(n, BYTES)
        step = max(1, 2_000_000 // max(n, 1))
        for i in range(0, n, step):
            shared = np.zeros((min(step, n - i), n), dtype=np.uint8)
            for p in range(BYTES):
                shared += rows[i : i + step, p, None] == rows[None, :, p]
            left, right = np.nonzero(shared >= BYTES - distance)
            left += i
            keep = left < right
            left, right = left[keep], right[keep]
            near = np.bitwise_count(fps[left] ^ fps[right]) <= distance
            join(left[near], right[near])
    else:
        fixed = np.bitwise_and.reduce(fps) | ~np.bitwise_or.reduce(fps)  # bits in which none differs
        free = [np.uint64(1 << b) for b in range(64) if not int(fixed) >> b & 1]
        for d in range(1, distance + 1):
            for flips in combinations(free, d):
                other = fps ^ np.bitwise_or.reduce(np.array(flips))
                at = np.minimum(np.searchsorted(fps, other), n - 1)
                hit = np.flatnonzero((fps[at] == other) & (at > np.arange(n)))
                join(hit, at[hit])
    out = np.array(edges, dtype=np.int64).reshape(-1, 2)
    return np.stack([fps[out[:, 0]], fps[out[:, 1]]], axis=1).view(np.int64) if len(out) else np.empty((0, 2), dtype=np.int64)


def _mask(positions) -> int:
    mask = sum(0xFF << (8 * (BYTES - 1 - p)) for p in positions)
    return mask - (1 << 64) if mask >> 63 else mask


def links(fps: DataFrame, distance: int = 2, list_limit: int = 20_000) -> DataFrame:
    """Links (a, b) that connect all fingerprints within ``distance`` bits, from distinct ``fp``.

    ``distance`` bits change at most that many of the 8 bytes, so a linked pair has the other bytes in common, each at
    its own position. The positions are dealt to ``distance + 2`` groups; as two groups at least stay whole, an inverted
    index on pairs of groups (their positions and bytes) holds every linked pair in one posting list or more, and only
    lists of two or more are read. A list gives a spanning forest, not its pairs.

    A list of more than ``list_limit`` is indexed anew by all sets of ``8 - distance`` positions that hold its own: its
    linked pairs agree in one of those, and such a list has at most 256 ** distance fingerprints, which fit a task
    however many near copies a text has.
    """
    groups = [range(BYTES)[k :: distance + 2] for k in range(distance + 2)]
    bases = [(*groups[i], *groups[j]) for i, j in combinations(range(len(groups)), 2)]
    posting = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_mask(b))) for b in bases]))
    postings = fps.select("fp", posting.alias("combo", "bytes"))
    lists = postings.groupBy("combo", "bytes").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    held = postings.join(lists, ["combo", "bytes"])

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        found = bucket_edges(rows["fp"].to_numpy(), distance)
        return pa.table([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    wider = [[_mask((*b, *more)) for more in combinations([p for p in range(BYTES) if p not in b], BYTES - distance - len(b))] for b in bases]
    again = F.array(*[F.array(*[F.struct(F.lit(m).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("bytes")) for m in masks]) for masks in wider])
    large = held.filter(F.col("n") > list_limit).select("fp", F.explode(again[F.col("combo")]).alias("key")).select("fp", F.col("key.mask").alias("combo"), F.col("key.bytes").alias("bytes")).distinct()
    small = held.filter(F.col("n") <= list_limit).select("fp", F.col("combo").cast("long").alias("combo"), "bytes")
    return small.unionByName(large).groupBy("combo", "bytes").applyInArrow(run, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the component's smallest node.

    Alternating large-star and small-star rounds: a node's larger neighbours, then its smaller ones, are hung on its
    least neighbour. The rounds grow with the logarithm of the longest path; each is cut off in the checkpoint folder.
    """
    both = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        # large star
        around = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = around.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        after = cut(small.filter("a <> b").distinct())
        if after.count() == both.count() and after.exceptAll(both).isEmpty():
            break
        both = after
    return both.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(both.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, distance: int = 2) -> DataFrame:
    """One row per input row: doc_id, fp (signed long) and component_id.

    Rows with equal fingerprints are one node, so copies are never paired; distinct fingerprints are linked at
    ``distance`` differing bits or fewer, and ``component_id`` is the smallest doc_id that links reach. Nothing but
    fingerprints and ids is exchanged. Null text is empty; empty texts have fingerprint 0, which links like any other.
    Rows that repeat share their component; a null id is passed over unless a component has no other (null then).
    An empty table gives an empty result.
    """
    each = cut(with_fingerprints(docs, id_col, text_col, words))
    distinct = cut(each.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("fp"), distance)).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return each.join(rooted.join(named, "root").select("fp", "component_id"), "fp")


def hexed(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", hexed(F.col("fp")).alias("fingerprint"), "component_id")


# --- the same at a Jaccard similarity: an inverted index on shingles instead of bytes ---------------------------------

_UNIT, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15)  # odd, otherwise arbitrary
#: Cells of the table of frequent shingles, how many it takes, and the part of the texts in which they are counted.
CELL_BITS, MOST_FREQUENT, SAMPLE = 23, 1 << 20, 8


def all_shingles(parts: list[bytes], words: int) -> np.ndarray:
    """The 64-bit hash of each run of ``words`` words, in order; a text of fewer words is one shingle."""
    import xxhash

    if not parts:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), dtype=np.uint64, count=len(parts))
    n = min(words, len(parts))
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for k in range(n):
        out = out * _STEP + h[k : len(h) - n + 1 + k]
    out ^= out >> np.uint64(31)
    out *= _UNIT
    return out ^ (out >> np.uint64(29))


def shingle_set(parts: list[bytes], words: int) -> np.ndarray:
    return np.unique(all_shingles(parts, words))


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()  # bytes split at ASCII white space only


def frequent_shingles(docs: DataFrame, words: int, above: int) -> np.ndarray:
    """How frequent the shingles of (doc_id, text) in each of 2^``CELL_BITS`` cells are: 0 for those in fewer than ``above`` texts or so, else more for each doubling.

    Every eighth text, by its hash and so once however many copies it has, is counted exactly, which is enough to put
    shingles into an order. Where more than ``MOST_FREQUENT`` are found the most frequent are taken, so what reaches the driver
    and is sent out is bounded whatever the corpus; the number of texts that shares a shingle of cell 0 doesn't grow with it before that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for got in batches:
            names, sets = [], []
            for text in got.column(0).cast(pa.binary()):
                text = text.as_py() or b""
                name = xxhash.xxh3_64_intdigest(text)
                if name % SAMPLE == 0:
                    names.append(name)
                    sets.append(shingle_set(normal_words(text), words))
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(names, dtype=np.uint64).view(np.int64)), _lists(sets)], names=["name", "shingles"])

    sample = docs.select("text").transform(small_batches).mapInArrow(run, "name bigint, shingles array<bigint>")
    keys = sample.groupBy("name").agg(F.first("shingles").alias("shingles")).select(F.explode("shingles").alias("key"))
    often = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= max(2, above // SAMPLE))
    often = cut(often.select(F.shiftrightunsigned("key", 64 - CELL_BITS).cast("int").alias("cell"), (F.floor(F.log2("n")) + 1).cast("int").alias("level")))
    least, left = 64, MOST_FREQUENT
    for r in sorted(often.groupBy("level").count().collect(), key=lambda r: -r.level):
        left -= r["count"]
        if left < 0:
            break
        least = r.level
    found = often.filter(F.col("level") >= least).groupBy("cell").agg(F.max("level").alias("level")).toArrow()
    levels = np.zeros(1 << CELL_BITS, dtype=np.uint8)
    levels[found["cell"].to_numpy()] = found["level"].to_numpy().astype(np.uint8)
    return levels


def prefix(hashes: np.ndarray, similarity: float, frequent: np.ndarray) -> np.ndarray:
    """The first shingles in the order (how ``frequent`` its cell is, hash): sets of that Jaccard similarity share one of these at least."""
    n = int(len(hashes) - np.ceil(similarity * len(hashes) - 1e-9) + 1) if len(hashes) else 0
    return hashes[np.argsort(frequent[(hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)], kind="stable")][:n]


def _halves(text: bytes) -> tuple[int, int]:
    import xxhash

    both = xxhash.xxh3_128_digest(text)
    return int.from_bytes(both[:8], "big", signed=True), int.from_bytes(both[8:], "big", signed=True)


def _place(doc_id: int | None, h1: int) -> int:
    """Of a row in the map of ``MAP_BITS`` bits."""
    return ((h1 ^ (doc_id or 0) * int(_STEP)) & (1 << 64) - 1) >> 64 - MAP_BITS


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    """Of signed numbers of the same width."""
    ends, flat = np.cumsum([0, *map(len, arrays)]), np.concatenate(arrays)
    return pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(flat.view(flat.dtype.str.replace("u", "i"))))


def _posted(docs: DataFrame, words: int, similarity: float, frequent: np.ndarray) -> DataFrame:
    """rid, place (see ``_place``), node (hash of the words), size (of the shingle set) and prefix of each row of (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        cells = sent.value
        for got in batches:
            nodes, sizes, prefixes, h1, h2, places = [], [], [], [], [], []
            for ident, text in zip(got.column(0).to_pylist(), got.column(1).cast(pa.binary())):
                text = text.as_py() or b""
                parts = normal_words(text)
                hashes = shingle_set(parts, words)
                nodes.append(xxhash.xxh3_64_intdigest(b" ".join(parts)))
                sizes.append(len(hashes))
                prefixes.append(prefix(hashes, similarity, cells))
                a, b = _halves(text)
                h1.append(a)
                h2.append(b)
                places.append(_place(ident, a))
            if nodes:
                columns = [got.column(0), pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)), pa.array(h1), pa.array(h2), pa.array(places, type=pa.int32()), pa.array(sizes, type=pa.int32()), _lists(prefixes)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "h1", "h2", "place", "size", "prefix"])

    found = docs.transform(small_batches).mapInArrow(run, "doc_id bigint, node bigint, h1 bigint, h2 bigint, place int, size int, prefix array<bigint>")
    return found.select(_rid(), "place", "node", "size", "prefix")


def _rid() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2").alias("rid")


def _sets_of(wanted: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """node and shingles of the nodes of ``wanted`` (node, rid, place): the upper halves of their hashes, made again from the texts of the rows named.

    A map of fixed size tells a scan of (doc_id, text) which rows may be wanted, so that few others are hashed and exchanged.
    """
    sent = docs.sparkSession.sparkContext.broadcast(map_of(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        marks = sent.value
        for got in batches:
            rows = []
            for ident, text in zip(got.column(0).to_pylist(), got.column(1).cast(pa.binary())):
                text = text.as_py() or b""
                a, b = _halves(text)
                place = _place(ident, a)
                if marks[place >> 3] >> (place & 7) & 1:
                    parts = normal_words(text)
                    rows.append((ident, a, b, xxhash.xxh3_64_intdigest(b" ".join(parts)), (shingle_set(parts, words) >> np.uint64(32)).astype(np.uint32)))
            if rows:
                ids, a, b, nodes, sets = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64()), pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)), _lists(sets)], names=["doc_id", "h1", "h2", "node", "shingles"])

    found = docs.transform(small_batches).mapInArrow(run, "doc_id bigint, h1 bigint, h2 bigint, node bigint, shingles array<int>").select("node", _rid(), "shingles")
    named = wanted.select("node", F.col("rid").alias("named"))
    return found.join(named, "node").filter(F.col("rid") == F.col("named")).groupBy("node").agg(F.first("shingles").alias("shingles"))


def _proven(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose shingle sets have that similarity. ``nodes``: node, the least rid, its place."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = cut(_sets_of(cut(nodes.select("node", F.col("least").alias("rid"), "place").join(wanted, "node")), docs, words))
    tidy(docs.sparkSession)
    side = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"{x}s"))
    shared = F.size(F.array_intersect("as", "bs"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("shared", shared)
    return cut(both.filter(F.col("shared") >= similarity * (F.size("as") + F.size("bs") - F.col("shared")) - 1e-9).select("a", "b"))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, list_limit: int = 20_000, above: int = 32) -> DataFrame:
    """One row per input row: ``rid`` (its identity), ``place`` (see ``_place``), doc_id, and ``first``: the identity that stays of its group.

    Groups are the components of the pairs whose sets of ``words``-word shingles have the given Jaccard similarity or
    more: all such pairs, and no others, up to collisions of hashes (64 bits where texts are sought, 32 in the proof of a pair). In any order of the shingles that all texts
    share, the first fifth (at 0.8) of two such sets has a shingle in common, so an inverted index on these prefixes
    misses none. The order is that of the hashes, but shingles that ``above`` texts or more share (see ``frequent_shingles``)
    come last, the more of them the later: a passage that many texts share is indexed only where a text has little else, and other lists
    don't grow with the corpus. The order changes the cost only.

    First each text is compared with one hub, the node of its lists that is in most lists of all, which joins large groups of
    copies without their pairs. Then all pairs of a list that aren't joined yet are tallied: sets that similar share so many
    shingles of their prefixes at least that what lies behind can make up the rest, and at each shared shingle what lies
    before it in lists and behind it has to suffice. Those that reach this minimum are
    proven on their whole sets. A list of more than ``list_limit`` nodes is compared in blocks, each part of it with all
    that isn't in its largest group.

    Texts with equal words (A-Z in any case) are one node. The group's row with the smallest doc_id stays (null last,
    then by content). Texts without words are equal. Rows that repeat have the same identity. An empty table gives an
    empty result.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    each = cut(_posted(texts, words, similarity, frequent_shingles(texts, words, above)))
    nodes = cut(each.groupBy("node").agg(F.min("rid").alias("least"), F.min_by("place", "rid").alias("place"), F.first("size").alias("size")))
    postings = each.select("node", F.posexplode("prefix").alias("at", "key"))
    lists = postings.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).filter("first <> last").select("key")
    tidy(docs.sparkSession)
    held = cut(postings.join(lists, "key").select("key", "node", "at").distinct())
    # of a list's nodes the one that is in most lists: what copies were made from shares more than one of the copies does
    ranked = held.join(held.groupBy("node").agg(F.count(F.lit(1)).alias("lists")), "node")
    central = ranked.groupBy("key").agg(F.max(F.struct("lists", "node")).alias("best")).select("key", F.col("best.node").alias("hub"))
    size = nodes.select("node", "size")
    kept = lambda n: n - F.ceil(similarity * n - 1e-9) + 1

    def enough(n: Column, m: Column, c: Column) -> Column:
        """Whether sets of ``n`` and ``m`` shingles with ``c`` in common in their prefixes can be similar."""
        return c >= F.ceil(similarity / (1 + similarity) * (n + m) - 1e-9) - F.greatest(n - kept(n), m - kept(m))

    near = lambda n, m: F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9

    # each node with one hub
    hubs = held.join(central, "key").filter("node <> hub").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("c")).join(size, "node").join(size.toDF("hub", "hub_size"), "hub")
    hubs = hubs.filter(near(F.col("size"), F.col("hub_size")) & enough(F.col("size"), F.col("hub_size"), F.col("c")))
    hubs = cut(hubs.groupBy("node").agg(F.max_by("hub", F.struct("c", "hub")).alias("b")).select(F.col("node").alias("a"), "b"))
    tidy(docs.sparkSession)
    edges = _proven(hubs, nodes, texts, words, similarity)
    tidy(docs.sparkSession)
    roots = components(edges)

    # then all pairs of a list that are in different groups: at least one of a pair isn't in the list's largest
    rooted = nodes.select("node", "size").join(roots, "node", "left").select("node", "size", F.coalesce("root", "node").alias("root"))
    listed = F.row_number().over(W.partitionBy("node").orderBy("at")) - 1
    rooted = cut(held.select("key", "node", "at", listed.alias("listed")).join(rooted, "node"))
    groups = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("key")
    groups = groups.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("roots"), F.max_by("root", F.struct("n", "root")).alias("largest")).filter("roots > 1")
    parts = F.ceil(F.col("n") / list_limit)
    members = cut(rooted.join(groups, "key").withColumn("other", F.col("root") != F.col("largest")))
    left = members.filter("other").select("key", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"), F.col("node").alias("a"), F.col("size").alias("a_size"), F.col("root").alias("a_root"), F.col("at").alias("a_at"), F.col("listed").alias("a_listed"))
    right = members.select("key", F.pmod(F.xxhash64("node"), parts).alias("part"), F.col("node").alias("b"), F.col("size").alias("b_size"), F.col("root").alias("b_root"), F.col("at").alias("b_at"), F.col("listed").alias("b_listed"), "other")
    # what both have before a shared shingle is in lists, too, and no more can follow it than the shorter rest
    most = F.least("a_listed", "b_listed") + 1 + F.least(F.col("a_size") - F.col("a_at"), F.col("b_size") - F.col("b_at")) - 1
    possible = most >= F.ceil(similarity / (1 + similarity) * (F.col("a_size") + F.col("b_size")) - 1e-9)
    met = left.join(right, ["key", "part"]).filter((F.col("a_root") != F.col("b_root")) & (~F.col("other") | (F.col("a") < F.col("b"))) & near(F.col("a_size"), F.col("b_size")) & possible)
    # which of the two is in the largest group differs by list
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.least("a_size", "b_size").alias("n"), F.greatest("a_size", "b_size").alias("m")]
    counted = met.select(*pair).groupBy("a", "b", "n", "m").agg(F.count(F.lit(1)).alias("c")).filter(enough(F.col("n"), F.col("m"), F.col("c")))
    counted = cut(counted.select("a", "b"))
    del held, members, left, right, met
    tidy(docs.sparkSession)
    more = _proven(counted, nodes, texts, words, similarity)
    tidy(docs.sparkSession)
    if not more.isEmpty():
        roots = components(edges.unionByName(more))
    rooted = nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("first"))
    return each.select("rid", "place", "node").join(rooted.join(named, "root").select("node", "first"), "node").select("rid", "place", F.col("rid.doc_id").alias("doc_id"), "first")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, with all columns, that stay when of each group of near copies the first is kept.

    Null texts are empty, and of those one row stays; of rows that repeat one stays; ties of doc_id go by content; an
    empty table stays empty. Only rows that may have to go are exchanged: a map of fixed size tells which.
    """
    found = similar_documents(docs, id_col, text_col, **options).select("rid", "place", "first")
    found = found.groupBy("rid").agg(F.count(F.lit(1)).alias("n"), F.first("place").alias("place"), F.first("first").alias("first"))
    doubtful = cut(found.filter((F.col("rid") != F.col("first")) | (F.col("n") > 1)).select("rid", "place", (F.col("rid") == F.col("first")).alias("stays")))
    sent = docs.sparkSession.sparkContext.broadcast(map_of(doubtful))
    at_id, at_text = docs.columns.index(id_col), docs.columns.index(text_col)
    h1, h2, flag = (f"{'_' * 9}{x}{max(docs.columns, key=len)}" for x in ("h1", "h2", "flag"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = sent.value
        for got in batches:
            both = [_halves(t.as_py() or b"") for t in got.column(at_text).cast(pa.binary())]
            places = [_place(i, a) for i, (a, _) in zip(got.column(at_id).cast(pa.int64()).to_pylist(), both)]
            added = [pa.array([x[i] for x in both], type=pa.int64()) for i in (0, 1)]
            added.append(pa.array([bool(marks[x >> 3] >> (x & 7) & 1) for x in places], type=pa.bool_()))
            yield pa.RecordBatch.from_arrays([*got.columns, *added], names=[*got.schema.names, h1, h2, flag])

    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema)}, `{h1}` bigint, `{h2}` bigint, `{flag}` boolean"
    rows = docs.transform(small_batches).mapInArrow(run, schema)
    ident = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).cast("long").alias("doc_id"), F.col(h1).alias("h1"), F.col(h2).alias("h2"))
    asked = rows.filter(F.col(flag)).select(F.struct(*[rows[c] for c in docs.columns]).alias("row"), ident.alias("rid")).join(doubtful.select("rid", "stays"), "rid", "left")
    again = asked.filter("coalesce(stays, true)").groupBy("rid").agg(F.first("row").alias("row"))
    return rows.filter(~F.col(flag)).select(docs.columns).unionByName(again.select("row.*"))
