"""Documents packed into as few token sequences as can be, with certified bounds."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.support import cut, small_batches, table

ID_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each length: the longest first, each into the fullest bin that still holds it."""
    order = np.argsort(-lengths, kind="stable")
    bins, by_room, rooms, n = np.empty(len(lengths), dtype=np.int64), {}, 0, 0  # rooms: a bit for each size of gap that some bin has
    for i, length in zip(order.tolist(), lengths[order].tolist()):
        fits = rooms >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            stack = by_room[room]
            b = stack.pop()
            if not stack:
                rooms ^= 1 << room
        else:
            room, b, n = capacity, n, n + 1
        bins[i] = b
        if room := room - length:
            by_room.setdefault(room, []).append(b)
            rooms |= 1 << room
    return bins


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """No packing of these lengths has fewer bins."""
    return lower_bound_of_counts(dict(enumerate(np.bincount(lengths, minlength=1).tolist())), capacity)


def lower_bound_of_counts(counts: dict[int, int], capacity: int) -> int:
    """The best of several dual feasible functions, from the number of pieces of each length.

    A function is dual feasible if what it gives for the pieces of any full bin adds up to 1 at most, so its sum over all
    pieces, rounded up, bounds the bins. Used: the identity, the step functions that round down to k-ths, and those that
    count pieces above ``capacity - t`` as 1 and drop the ones below ``t``.
    """
    count, size = np.zeros(capacity + 1), np.arange(capacity + 1, dtype=np.int64)
    count = count.astype(object if sum(counts.values()) > 1 << 40 else np.int64)
    for length, n in counts.items():
        if n:
            count[length] = n
    best = -(-int((count * size).sum()) // capacity)
    for k in range(1, 33):
        whole, scaled = (k + 1) * size % capacity == 0, (k + 1) * size // capacity
        # k times the function, times the capacity
        value = np.where(whole, k * size, scaled * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    above, below = np.cumsum(count[::-1])[::-1], np.cumsum(count * size)
    for t in range(1, capacity // 2 + 1):
        large = int(above[capacity - t + 1])
        best = max(best, large - (-int(below[capacity - t] - below[t - 1]) // capacity))
    return int(best)


def _packed(columns: dict, capacity: int, group: int) -> dict:
    lengths = np.asarray(columns["length"], dtype=np.int64)
    bins = best_fit_decreasing(lengths, capacity)
    n = int(bins.max()) + 1 if len(bins) else 0
    fill = np.bincount(bins, weights=lengths, minlength=n).astype(np.int64)
    order = np.argsort(bins, kind="stable")
    before = np.cumsum(lengths[order]) - lengths[order]
    first = np.searchsorted(bins[order], np.arange(n))
    offset = np.empty(len(bins), dtype=np.int64)
    offset[order] = before - before[first][bins[order]]
    emptiest = bins == int(fill.argmin())
    return columns | {"group": np.full(len(bins), group), "bin": bins, "offset": offset, "bins": np.full(len(bins), n), "bound": np.full(len(bins), lower_bound(lengths, capacity)), "fill": fill[bins], "emptiest": emptiest}


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", group_pieces: int = 100_000, rounds: int = 4, with_ids: bool = False) -> DataFrame:
    """Pieces of documents with their places in sequences of at most ``capacity`` tokens.

    Returns one row per piece: doc_id, piece, start (the document's tokens before it), length, ids_crc32, optionally
    ``ids`` (little-endian unsigned 32-bit), group, bin, offset, bins and bound. (group, bin) names a sequence.
    A document is its ids followed by ``end_id``; only one longer than ``capacity`` is cut, into pieces of that length.

    Each task tokenizes its documents and packs them by best-fit decreasing, in groups of ``group_pieces`` at most, so
    memory is bounded and nothing is exchanged. Dual feasible functions bound the bins of each group from below, and from
    the number of pieces of each length those of the corpus; a group that meets its bound is certified. Then pieces change
    groups: all bins with room of groups that miss their bound, and the emptiest bin of each certified one, or, where the
    corpus has more bins above its bound than one a group, all bins with room of any group. They are dealt by a hash to
    mixed groups and packed again; the new bins count if they are fewer. Up to ``rounds`` exchanges run, until the corpus
    meets its bound, one group is left or nothing improves.

    Null or empty text is one piece of one token. Rows that repeat are packed separately, and ties in length go by order
    of arrival in a task. An empty table gives an empty result.
    """
    kind = dict(docs.select(F.col(id_col).alias("doc_id")).dtypes)["doc_id"]
    fields = [pa.field("doc_id", ID_TYPES.get(kind, pa.string())), pa.field("piece", pa.int32()), pa.field("start", pa.int64()), pa.field("length", pa.int64()), pa.field("ids_crc32", pa.int64())]
    fields += [pa.field("ids", pa.binary())] if with_ids else []
    names = [f.name for f in fields]
    schema = pa.schema([*fields, pa.field("group", pa.int64()), *(pa.field(n, pa.int64()) for n in ("bin", "offset", "bins", "bound", "fill")), pa.field("emptiest", pa.bool_())])
    ddl = ", ".join(f"`{n}` {({pa.int64(): 'bigint', pa.int32(): 'int', pa.binary(): 'binary', pa.bool_(): 'boolean', pa.string(): 'string'})[schema.field(n).type]}" for n in schema.names)

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from strandline.llm.tokens import word_cache

        words, closing = word_cache(tokenizer_path), int(end_id).to_bytes(4, "little")
        task, groups, held = TaskContext.get().partitionId(), 0, {n: [] for n in names}

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, groups
            if held["length"]:
                out = _packed(held, capacity, (task << 20) + groups)
                yield pa.RecordBatch.from_arrays([pa.array(out[n], type=schema.field(n).type) for n in schema.names], schema=schema)
            held, groups = {n: [] for n in names}, groups + 1

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), ["" if t is None else t for t in batch.column(1).to_pylist()]
            for doc, found in zip(ids, words.encode(texts)):
                found += closing
                for piece, at in enumerate(range(0, len(found), 4 * capacity)):
                    part = found[at : at + 4 * capacity]
                    for name, value in zip(names, (doc, piece, at // 4, len(part) // 4, zlib.crc32(part), part)):
                        held[name].append(value)
                if len(held["length"]) >= group_pieces:
                    yield from flush()
        yield from flush()

    def repack(key: tuple, rows: pa.Table) -> pa.Table:
        out = _packed({n: rows[n].to_pylist() for n in names}, capacity, key[0].as_py())
        return pa.table([pa.array(out[n], type=schema.field(n).type) for n in schema.names], schema=schema)

    # a document's id is passed through as text unless it is a number
    plain = F.col(id_col) if kind in ID_TYPES else F.col(id_col).cast("string")
    packed = cut(docs.select(plain.alias("doc_id"), F.col(text_col).alias("text")).transform(small_batches).mapInArrow(tokenize, ddl))
    count = lambda df: df.select("group", "bin").distinct().count()
    state = packed.agg(F.count_distinct("group").alias("groups"), F.count_distinct("group", "bin").alias("bins")).first()
    groups, bins, bound, done = state.groups, state.bins, corpus_bound(packed, capacity), None
    for turn in range(rounds):
        # together the groups may waste a bin each; more means that their pieces don't suit each other, though each be certified
        apart = bins - bound > groups
        loose = (F.col("fill") < capacity) & (F.lit(apart) | (F.col("bins") > F.col("bound")) | F.col("emptiest"))
        pool = packed.filter(loose)
        n = pool.count()
        targets = max(1, min(-(-n // group_pieces), groups if apart else -(-groups // 2)))
        if n < 2 or groups < 2 or bins <= bound:
            break
        to = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(turn)), F.lit(targets))
        dealt = pool.select("*", (F.lit(-1 - (turn << 32)) - to.cast("long")).alias("to"))
        again = cut(dealt.groupBy("to").applyInArrow(repack, ddl))
        saved = count(pool) - count(again)
        if saved <= 0:
            break
        settled = packed.filter(~loose)
        done, packed, groups, bins = settled if done is None else done.unionByName(settled), again, targets, bins - saved
    done = packed if done is None else done.unionByName(packed)
    return done.drop("fill", "emptiest")


def corpus_bound(packed: DataFrame, capacity: int) -> int:
    """The lower bound over all pieces, from how many there are of each length: a table of ``capacity`` rows at most."""
    rows = packed.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    return lower_bound_of_counts({r.length: r.n for r in rows}, capacity)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def packed_pieces(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Pieces with their sequence and place in it: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    As of ``pack``: null or empty text is one piece of one token, rows that repeat are packed separately, ties in length go
    by order of arrival, an empty table gives an empty result.
    """
    found = pack(docs, tokenizer_path)
    sequence = F.col("group") * (1 << 20) + F.col("bin")
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), "offset")
