"""Quality rules: plain counts, and perplexity under a modified Kneser-Ney model of the corpus itself."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window as W

from strandline.llm.support import MAP_BITS, cut, map_of, small_batches, table, tidy

#: Code points an n-gram has.
ORDER = 4
#: So many n-grams and histories of each order are sent out, for all languages together. Of a larger model the rest is joined.
MOST_GRAMS = 1 << 20
#: Losses are added up as whole numbers of so many a nat, so that their sum is the same in any order.
UNITS = 1 << 24

_BLANK = b" \t\n\x0b\x0c\r"
_NOT_WORD_CHARS = _BLANK + bytes(range(0x80, 0xC0))
_MARKS = b"[#*$%&|<>]"  # the brackets belong to the pattern's class, not to its characters

#: Of ASCII: white space (and the character 0), other marks, and what may repeat: letters, digits and all beyond ASCII.
_WHITE, _MARK, _LETTER = 1, 2, 0
_CLASS = np.full(129, _MARK, dtype=np.uint8)
_CLASS[[0, *_BLANK]] = _WHITE
_CLASS[48:58] = _CLASS[65:91] = _CLASS[97:123] = _CLASS[128] = _LETTER
_UNIT, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15)  # odd, otherwise arbitrary


def symbols(text: str, order: int = ORDER) -> np.ndarray:
    """The code points of a text after ``order - 1`` blanks. A run of white space is one blank, a run of one ASCII mark one mark."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kind = _CLASS[np.minimum(x, 128)]
    x = np.where(kind == _WHITE, np.uint32(32), x)
    keep = kind == _LETTER
    keep[1:] |= x[1:] != x[:-1]
    keep[:1] |= x[:1] != 32
    return np.concatenate([np.full(order - 1, 32, dtype=np.uint32), x[keep]])


def hashes(x: np.ndarray, order: int = ORDER) -> list[np.ndarray]:
    """For each k from 1 up the 64-bit hash of the k symbols that end at each place (of fewer, at the first places)."""
    out = [(x.astype(np.uint64) + np.uint64(1)) * _UNIT]
    for _ in range(1, order):
        longer = out[0].copy()
        longer[1:] += out[-1][:-1] * _STEP
        out.append(longer)
    return out


def gram_hashes(grams: list[str], k: int) -> np.ndarray:
    """The hashes of n-grams of ``k`` symbols; of the empty one: 0."""
    if not k or not grams:
        return np.zeros(len(grams), dtype=np.uint64)
    x = np.frombuffer("".join(grams).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(-1, k).astype(np.uint64)
    h = np.zeros(len(x), dtype=np.uint64)
    for j in range(k):
        h = h * _STEP + (x[:, j] + np.uint64(1)) * _UNIT
    return h


@dataclass
class Model:
    """For each order from 1 up: sorted hashes of the n-grams kept and their log probabilities; sorted hashes of histories and the log weights that they give the next lower order."""

    keys: list
    logp: list
    histories: list
    weight: list
    #: what a symbol never seen has, before weights
    unseen: float

    def score(self, own: list[np.ndarray], before: list[np.ndarray]) -> np.ndarray:
        """Log probabilities of symbols: ``own[k - 1]`` has the hashes of the k symbols up to each, ``before[k - 1]`` of the k - 1 before it."""
        n = len(own[0])
        out, off, open_ = np.zeros(n), np.zeros(n), np.arange(n)
        for k in range(len(self.keys), 0, -1):
            at, hit = _find(self.keys[k - 1], own[k - 1][open_])
            out[open_[hit]] = off[open_[hit]] + self.logp[k - 1][at[hit]]
            open_ = open_[~hit]
            if not len(open_):
                return out
            at, hit = _find(self.histories[k - 1], before[k - 1][open_])
            off[open_[hit]] += self.weight[k - 1][at[hit]]
        out[open_] = off[open_] + self.unseen
        return out


def _find(keys: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(want), dtype=np.int64), np.zeros(len(want), dtype=bool)
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return at, keys[at] == want


class Buckets:
    """Where in a sorted array of hashes those with each leading bits begin, so that a look-up is a step or two."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.ends = np.cumsum(np.bincount((keys >> self.shift).astype(np.int64), minlength=1 << bits), dtype=np.int32)
        self.starts = np.concatenate([np.zeros(1, dtype=np.int32), self.ends[:-1]])
        self.keys = np.append(keys, np.uint64(0))

    def find(self, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bucket = (want >> self.shift).astype(np.int64)
        at = self.starts[bucket]
        hit = (self.keys[at] == want) & (at < len(self.keys) - 1)
        open_ = np.flatnonzero(~hit)
        while len(open_):
            open_ = open_[at[open_] + 1 < self.ends[bucket[open_]]]
            at[open_] += 1
            hit[open_] = self.keys[at[open_]] == want[open_]
            open_ = open_[~hit[open_]]
        return at, hit


POOL = ""


def languages(docs: DataFrame, lang_col: str, min_share: float) -> list[str]:
    """Those that at least ``min_share`` of the documents have, so 1 / min_share at most; the rest and null are pooled."""
    n = docs.groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n")).first()[0] or 0
    return sorted(r.lang for r in n.filter((F.col("n") >= max(1.0, min_share * total)) & F.col("lang").isNotNull() & (F.col("lang") != POOL)).collect())


def counted(docs: DataFrame, named: list[str], text_col: str, lang_col: str, order: int) -> DataFrame:
    """lang, gram (``order`` code points) and n, how often it occurs in the documents that pass the base rules."""
    known = set(named)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        waiting: dict[str, int] = {}
        totals: dict[str, tuple[Buckets, np.ndarray, np.ndarray]] = {}

        def add(lang: str) -> None:
            texts = held.pop(lang)
            waiting[lang] = 0
            x = np.concatenate(texts)
            real = np.ones(len(x), dtype=bool)
            starts = np.cumsum([0, *(len(t) for t in texts[:-1])])
            for k in range(order - 1):
                real[starts + k] = False
            ends = np.flatnonzero(real)
            own = hashes(x, order)[-1][ends]
            known, grams, n = totals.get(lang) or (Buckets(own[:0]), np.empty((0, order), dtype=np.uint32), np.zeros(0, dtype=np.int64))
            at, hit = known.find(own)
            n = n + np.bincount(at[hit], minlength=len(n))
            if not hit.all():
                miss = np.flatnonzero(~hit)
                fresh, at, more = np.unique(own[miss], return_index=True, return_counts=True)
                at = ends[miss[at]]
                keys = np.concatenate([known.keys[:-1], fresh])
                grams = np.concatenate([grams, np.stack([x[at - k] for k in range(order - 1, -1, -1)], axis=1)])
                in_order = np.argsort(keys)
                known, grams, n = Buckets(keys[in_order]), grams[in_order], np.concatenate([n, more])[in_order]
            totals[lang] = known, grams, n

        for got in batches:
            for lang, text in zip(got.column(0).to_pylist(), got.column(1)):
                text = text.as_py() or ""
                if not passes_base(text)[0]:
                    continue
                lang = lang if lang in known else POOL
                x = symbols(text, order)
                if len(x) >= order:
                    held.setdefault(lang, []).append(x)
                    waiting[lang] = waiting.get(lang, 0) + len(x)
                    if waiting[lang] > 1 << 18:  # counted bit by bit, so that few symbols wait
                        add(lang)
        for lang in list(held):
            add(lang)
        for lang, (_, grams, n) in totals.items():
            for i in range(0, len(n), 100_000):
                part = np.ascontiguousarray(grams[i : i + 100_000]).view(f"<U{order}").ravel()
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), type=pa.string()), pa.array(part.tolist(), type=pa.string()), pa.array(n[i : i + 100_000])], names=["lang", "gram", "n"])

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    partial = rows.transform(small_batches).mapInArrow(count, "lang string, gram string, n bigint")
    return partial.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """What modified Kneser-Ney takes from counts of 1, 2, and 3 or more, by how many n-grams have each count up to 4."""
    n1, n2, n3, n4 = (max(float(n), 0.5) for n in (n1, n2, n3, n4))
    y = n1 / (n1 + 2 * n2)
    raw = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    # few counts can give figures outside what a count holds
    return tuple(min(max(d, 0.1 * k), 0.95 * k) for k, d in enumerate(raw, 1))


def kneser_ney(counts: DataFrame, order: int = ORDER, most_grams: int | None = None) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """The interpolated model from (lang, gram, n) as tables: (lang, k, gram, logp, n), (lang, k, history, weight), and the number of symbols of each language.

    Counts of lower orders are those of the distinct symbols to the left, all taken before anything is pruned. N-grams of
    three symbols and more that occur once aren't in the model, whatever the size of the corpus: a text would vouch for
    itself by them. They have their history's weight times their probability one order down, and the weights are such
    that probabilities add up to 1. All others are in it, however many, unless ``most_grams`` asks for a smaller model,
    without those that are less than that part of all symbols. ``train`` doesn't.
    """
    levels = [cut(counts.select("lang", "gram", "n", F.col("n").alias("c")))]
    for k in range(order - 1, 0, -1):
        levels.insert(0, levels[0].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("c")))
    once = lambda j: F.sum((F.col("c") == j).cast("long")).alias(f"n{j}")
    stats = None
    for k, level in enumerate(levels, 1):
        of = level.groupBy("lang").agg(F.lit(k).alias("k"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("distinct"), *(once(j) for j in (1, 2, 3, 4)))
        stats = of if stats is None else stats.unionByName(of)
    rows = stats.collect()  # a row for each language and order
    if not rows:
        return levels[0].selectExpr("lang", "1 AS k", "gram", "0D AS logp", "n"), levels[0].selectExpr("lang", "1 AS k", "gram AS history", "0D AS weight"), {}
    sizes, total = {r.lang: r.distinct for r in rows if r.k == 1}, sum(r["all"] for r in rows if r.k == 1)
    grams, weights = None, None
    for k, level in enumerate(levels, 1):
        taken = _by_language({r.lang: discounts(r.n1, r.n2, r.n3, r.n4) for r in rows if r.k == k})
        level = level.withColumn("history", F.substring("gram", 1, k - 1)).withColumn("d", F.get(taken, F.least(F.col("c"), F.lit(3)).cast("int") - 1))
        of_history = W.partitionBy("lang", "history")
        level = level.withColumn("total", F.sum("c").over(of_history)).withColumn("given", F.sum("d").over(of_history))
        if k == 1:
            level = level.withColumn("low", 1 / (_by_language(sizes) + 1))
        else:
            shorter = below.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("low"))
            level = level.withColumn("suffix", F.substring("gram", 2, k - 1)).join(shorter, ["lang", "suffix"])
        p = (F.col("c") - F.col("d") + F.col("given") * F.col("low")) / F.col("total")
        least = max(2 if k > 2 else 1, -(-total // most_grams) if most_grams else 1)
        below = cut(level.select("lang", "gram", "n", "history", "low", p.alias("p"), (F.col("n") >= least).alias("kept")))
        kept = below.filter("kept")
        of = kept.select("lang", F.lit(k).alias("k"), "gram", F.log("p").alias("logp"), "n")
        grams = of if grams is None else grams.unionByName(of)
        left = F.greatest(1 - F.sum("p"), F.lit(1e-9)) / F.greatest(1 - F.sum("low"), F.lit(1e-9))
        of = kept.groupBy("lang", "history").agg(F.log(left).alias("weight")).select("lang", F.lit(k).alias("k"), "history", "weight")
        weights = of if weights is None else weights.unionByName(of)
    return grams, weights, sizes


def _by_language(values: dict) -> Column:
    lit = lambda v: F.array(*map(F.lit, v)) if isinstance(v, tuple) else F.lit(v)
    return F.element_at(F.create_map(*[x for lang, v in values.items() for x in (F.lit(lang), lit(v))]), F.col("lang"))


@dataclass
class Trained:
    """A model of each language and one for the pool of rare ones: its tables (see ``kneser_ney``), and what of them is sent out."""

    grams: DataFrame
    weights: DataFrame
    sizes: dict[str, int]
    order: int
    sent: dict[str, Model]
    #: whether all is sent; else only the most frequent of the longest n-grams are
    whole: bool


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = ORDER, min_share: float = 0.01, most_grams: int = MOST_GRAMS) -> Trained:
    """A model for each language, and one for the pool of rare ones, from the n-grams of all documents that pass the base rules.

    Tasks count their n-grams, Spark adds them up and makes the model of them, table by table. What reaches the driver
    and is sent out is bounded by ``most_grams`` n-grams and as many histories of each order: 100 MB at order 4. A model
    that has more stays whole in its tables, and only the longest n-grams that are most frequent are sent, so many at most.
    """
    named = languages(docs, lang_col, min_share)
    grams, weights, sizes = kneser_ney(counted(docs, named, text_col, lang_col, order), order)
    whole = all(r["count"] <= most_grams for rows in (grams, weights) for r in rows.groupBy("k").count().collect())
    sent = (grams, weights) if whole else (_most_frequent(grams.filter(F.col("k") == order), most_grams), weights.limit(0))
    arrays = {}
    for what, found in (("gram", sent[0].select("lang", "k", "gram", "logp").toArrow()), ("history", sent[1].toArrow())):
        langs, ks = found["lang"].to_numpy(zero_copy_only=False), found["k"].to_numpy()
        texts, values = found[what].to_numpy(zero_copy_only=False), found.column(3).to_numpy().astype(np.float32)
        for lang in sizes:
            for k in range(1, order + 1):
                here = np.flatnonzero((langs == lang) & (ks == k))
                keys = gram_hashes(texts[here].tolist(), k if what == "gram" else k - 1)
                in_order = np.argsort(keys)
                arrays[lang, what, k] = keys[in_order], values[here][in_order]
    models = {lang: Model(*[[arrays[lang, what, k][i] for k in range(1, order + 1)] for what in ("gram", "history") for i in (0, 1)], _unseen(size)) for lang, size in sizes.items()}
    return Trained(grams, weights, sizes, order, models, whole)


def _unseen(size: int) -> float:
    return -math.log(size + 1)


def _most_frequent(grams: DataFrame, most: int) -> DataFrame:
    """Those of ``grams`` with the greatest ``n``, no more than ``most``: as many sixteenths of a doubling as fit."""
    step = F.floor(F.log2("n") * 16)
    least, left = None, most
    for r in sorted(grams.groupBy(step.alias("step")).count().collect(), key=lambda r: -r.step):  # a thousand at most
        left -= r["count"]
        if left < 0:
            break
        least = r.step
    return grams.limit(0) if least is None else grams.filter(step >= least)


def rest_of_model(asked: DataFrame, trained: Trained) -> DataFrame:
    """lang, gram and units (its loss, see ``UNITS``) for each row (lang, gram) of ``asked``, from the model's tables: as ``Model.score`` finds them."""
    order, rows = trained.order, asked.select("lang", "gram", F.lit(0.0).alias("off"), F.lit(None).cast("double").alias("found"))
    number = lambda c: F.col(c).cast("float").cast("double")
    for k in range(order, 0, -1):
        own = trained.grams.filter(F.col("k") == k).select("lang", F.col("gram").alias("own"), number("logp").alias("logp"))
        before = trained.weights.filter(F.col("k") == k).select("lang", F.col("history").alias("before"), number("weight").alias("weight"))
        rows = rows.withColumn("own", F.substring("gram", order - k + 1, k)).withColumn("before", F.substring("gram", order - k + 1, k - 1))
        rows = rows.join(own, ["lang", "own"], "left").join(F.broadcast(before) if k == 1 else before, ["lang", "before"], "left")
        rows = rows.select("lang", "gram", (F.col("off") + F.coalesce("weight", F.lit(0.0))).alias("off"), F.coalesce("found", F.col("off") + F.col("logp")).alias("found"))
    unseen = _by_language({lang: _unseen(size) for lang, size in trained.sizes.items()})
    return rows.select("lang", "gram", F.rint(F.coalesce("found", F.col("off") + unseen) * -UNITS).cast("long").alias("units"))


def with_loss(scored: DataFrame, trained: Trained) -> DataFrame:
    """``scored`` (band, n, units, misses and more; see ``PARTS``) with ``loss`` for these: the mean loss a symbol, all n-grams counted."""
    loss = lambda units: (units / F.lit(float(UNITS)) / F.col("n")).alias("loss")
    others = [c for c in scored.columns if c not in ("n", "units", "misses")]
    if trained.whole:
        return scored.select(*others, loss(F.col("units")))
    scored = cut(scored.withColumn("row", F.monotonically_increasing_id()))
    missed = scored.select("row", F.col("band").alias("lang"), F.explode("misses").alias("miss")).select("row", "lang", "miss.gram", "miss.times")
    found = cut(rest_of_model(missed.select("lang", "gram").distinct(), trained))
    more = missed.join(found, ["lang", "gram"]).groupBy("row").agg(F.sum(F.col("times") * F.col("units")).alias("more"))
    return scored.drop("misses").join(more, "row", "left").select(*others, loss(F.col("units") + F.coalesce("more", F.lit(0))))


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()  # bytes split at ASCII white space only
    n = len(words)
    chars = len(text.translate(None, _NOT_WORD_CHARS))
    symbols_ = len(text) - len(text.translate(None, _MARKS[1:-1]))
    seen, dup = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    return n, chars, symbols_, dup, repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """The words that lie in three-word windows found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    often, marks = Counter(windows), bytearray(len(words))
    for i, w in enumerate(windows):
        if often[w] > 1:
            marks[i : i + 3] = b"\1\1\1"
    return sum(marks)


MIN_WORDS, MAX_REPEAT = 50, 50
BASE = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean"


def passes_base(text: str) -> tuple[bool, int]:
    """Whether the base rules hold, and the number of words, without the counts where a bound tells: of n - 2 windows with d
    distinct ones no more than twice the excess occur twice, and each has three words."""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    if n < MIN_WORDS:
        return False, n
    excess = n - 2 - len(set(zip(words, words[1:], words[2:])))
    return 100 * 6 * excess <= MAX_REPEAT * n or 100 * repeated_words(words) <= MAX_REPEAT * n, n


def base_failed(n_words: int, word_chars: int, n_symbols: int, n_dup_lines: int, n_repeat_words: int) -> bool:
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT * n_words


#: What a text's loss is made of: its symbols, the loss of those whose n-gram was sent, and the other n-grams (none where the whole model is).
PARTS = "n bigint, units bigint, misses array<struct<gram: string, times: bigint>>"


@dataclass
class Scorer:
    """Mean log loss a symbol of whole texts, each under the model of its own language."""

    models: dict[str, Model]
    order: int
    #: whether the models are all there is (see ``Trained``)
    whole: bool = True
    tables: dict = field(default_factory=dict)

    def key(self, lang: str | None) -> str:
        return lang if lang in self.models else POOL

    def losses(self, lang: str, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each symbol of a text in ``UNITS``, and which of them aren't known (0 then): nearly all are looked up among the longest n-grams, the rest go through the weights."""
        own, model, first = hashes(x, self.order), self.models[lang], self.order - 1
        if lang not in self.tables:
            self.tables[lang] = Buckets(model.keys[-1]), np.append(_units(model.logp[-1]), 0)
        buckets, units = self.tables[lang]
        at, hit = buckets.find(own[-1][first:])
        out, miss = units[np.minimum(at, len(units) - 1)], np.flatnonzero(~hit)
        if not len(miss):
            return out, miss
        here = miss + first
        if not self.whole:
            out[miss] = 0
            return out, here
        before = [np.zeros(len(here), dtype=np.uint64), *(h[here - 1] for h in own[:-1])]
        out[miss] = _units(model.score([h[here] for h in own], before))
        return out, miss[:0]

    def parts(self, lang: str | None, text: str) -> tuple[int | None, int, list[str], list[int]]:
        """``PARTS`` of a text. ``n`` is None for a text without symbols, or where there is no model."""
        x, lang = symbols(text, self.order), self.key(lang)
        if len(x) < self.order or lang not in self.models:
            return None, 0, [], []
        out, here = self.losses(lang, x)
        grams, times = [], []
        if len(here):
            wide = np.stack([x[here - k] for k in range(self.order - 1, -1, -1)], axis=1)
            found, times = np.unique(np.ascontiguousarray(wide).view(f"<U{self.order}").ravel(), return_counts=True)
            grams, times = found.tolist(), times.tolist()
        return len(out), int(out.sum()), grams, times

    def loss(self, lang: str | None, text: str) -> float | None:
        """Where the models are all there is."""
        n, units, *_ = self.parts(lang, text)
        return units / UNITS / n if n else None


def _units(logp: np.ndarray) -> np.ndarray:
    return np.rint(np.asarray(logp, dtype=np.float64) * -UNITS).astype(np.int64)


def _columns(parts: list[tuple]) -> list[pa.Array]:
    """Those of ``PARTS``."""
    n, units, grams, times = zip(*parts)
    flat = [pa.array([x for of in column for x in of], type=kind) for column, kind in ((grams, pa.string()), (times, pa.int64()))]
    ends = pa.array(np.cumsum([0, *map(len, grams)]), type=pa.int32())
    return [pa.array(n, type=pa.int64()), pa.array(units, type=pa.int64()), pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(flat, names=["gram", "times"]))]


_NAMES = ["n", "units", "misses"]


def score(docs: DataFrame, models: dict[str, Model], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, whole: bool = True) -> DataFrame:
    """doc_id, band (the language whose model and band hold), the base counts, base_failed and ``PARTS``, for each whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value, order, whole)
        for got in batches:
            found, stats, parts = [], [], []
            for lang, text in zip(got.column(1).to_pylist(), got.column(2)):
                text = text.as_py() or ""
                counts = base_counts(text.encode("utf-8", "surrogatepass"))
                found.append(scorer.key(lang))
                stats.append((*counts, base_failed(*counts)))
                parts.append(scorer.parts(lang, text))
            if found:
                names = ["doc_id", "band", *(c.split()[0] for c in BASE.split(", ")), *_NAMES]
                yield pa.RecordBatch.from_arrays([got.column(0), pa.array(found), *map(pa.array, zip(*stats)), *_columns(parts)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).transform(small_batches).mapInArrow(run, f"doc_id bigint, band string, {BASE}, {PARTS}")


#: Losses are put in bins of so many a nat to find their quartiles.
BINS = 1000


def bands(scored: DataFrame, below: float = 8.0, above: float = 8.0) -> dict[str, tuple[float, float, float]]:
    """The middle loss of each language, and how far below and above it a document may lie: so many times the distance of the outer quartile.

    Only documents that pass the base rules count. Quartiles are those of all their losses, in bins of a thousandth; so
    a hundred languages (see ``train``) times the bins reach the driver at most, and the same corpus has the same bands.
    """
    return bands_of_bins(scored.filter("NOT base_failed AND loss IS NOT NULL").groupBy("band", F.floor(F.col("loss") * BINS).alias("bin")).agg(F.count(F.lit(1)).alias("n")), below, above)


def bands_of_bins(bins: DataFrame, below: float = 8.0, above: float = 8.0) -> dict[str, tuple[float, float, float]]:
    """The same from how many documents of a band have their loss in a bin: band, bin, n."""
    rows = bins.collect()
    least = 0.008  # of a corpus of copies
    found = {}
    for lang in {r.band for r in rows}:
        bins = sorted((r.bin, r.n) for r in rows if r.band == lang)
        upto, total = np.cumsum([n for _, n in bins]), sum(n for _, n in bins)
        q = [(bins[int(np.searchsorted(upto, total * x))][0] + 0.5) / BINS for x in (0.25, 0.5, 0.75)]
        found[lang] = q[1], below * max(q[1] - q[0], least), above * max(q[2] - q[1], least)
    return found


def judged(scored: DataFrame, found: dict[str, tuple[float, float, float]]) -> DataFrame:
    """Adds ``kept``: the base rules passed and the loss within its language's band.

    Short texts vary more: below 300 words the band widens with the inverse root of the length. No band, no verdict.
    """
    within = F.lit(True)
    if found:
        flat = [x for lang, (mid, low, high) in found.items() for x in (F.lit(lang), F.struct(F.lit(mid).alias("mid"), F.lit(low).alias("low"), F.lit(high).alias("high")))]
        band, wide = F.element_at(F.create_map(*flat), F.col("band")), F.sqrt(F.greatest(F.lit(1.0), 300 / F.greatest("n_words", F.lit(1))))
        within = F.coalesce((F.col("loss") >= band["mid"] - band["low"] * wide) & (F.col("loss") <= band["mid"] + band["high"] * wide), F.lit(True))
    return scored.withColumn("kept", ~F.col("base_failed") & within)


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = ORDER, most_grams: int = MOST_GRAMS) -> DataFrame:
    """The rows of ``docs`` that ``quality`` keeps, with all their columns, whatever their names.

    Null and empty texts fail and go; rows that repeat are judged alike; null and rare languages are pooled; an empty
    table stays empty. Texts are scored where they lie and known by a hash of language and text from then on. A map of
    fixed size tells which may have to go; only the rows of those are exchanged.
    """
    trained = train(docs, text_col, lang_col, order, most_grams=most_grams)
    tidy(docs.sparkSession)
    models = docs.sparkSession.sparkContext.broadcast(trained.sent)
    whole = trained.whole

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(models.value, order, whole)
        for got in batches:
            found, parts = [], []
            for lang, text in zip(got.column(0).to_pylist(), got.column(1)):
                text = text.as_py() or ""
                good, n_words = passes_base(text)
                if good:
                    found.append((*_content(lang, text), scorer.key(lang), n_words))
                    parts.append(scorer.parts(lang, text))
            if found:
                yield pa.RecordBatch.from_arrays([*map(pa.array, zip(*found)), *_columns(parts)], names=["h1", "h2", "band", "n_words", *_NAMES])

    texts = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    scored = cut(texts.transform(small_batches).mapInArrow(measured, f"h1 bigint, h2 bigint, band string, n_words bigint, {PARTS}"))
    scored = with_loss(scored, trained).withColumn("base_failed", F.lit(False))
    if not whole:
        scored = cut(scored)
    tidy(docs.sparkSession)
    gone = cut(judged(scored, bands(scored)).filter(~F.col("kept")).select("h1", "h2").distinct())
    marks = docs.sparkSession.sparkContext.broadcast(map_of(gone.select(F.shiftrightunsigned("h1", 64 - MAP_BITS).cast("int").alias("place"))))
    at_lang, at_text = docs.columns.index(lang_col), docs.columns.index(text_col)
    h1, h2 = (f"{'_' * 9}{x}{max(docs.columns, key=len)}" for x in ("h1", "h2"))

    def passing(marked: bool) -> DataFrame:
        """The rows that pass the base rules, and may have to go or not, with the hashes of their content."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for got in batches:
                found, keep = [], []
                for lang, text in zip(got.column(at_lang).cast(pa.string()).to_pylist(), got.column(at_text).cast(pa.string())):
                    text = text.as_py() or ""
                    a, b = _content(lang, text)
                    place = (a & (1 << 64) - 1) >> 64 - MAP_BITS
                    found.append((a, b))
                    keep.append(bool(marks.value[place >> 3] >> (place & 7) & 1) == marked and passes_base(text)[0])
                added = [pa.array([x[i] for x in found], type=pa.int64()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*got.columns, *added], names=[*got.schema.names, h1, h2]).filter(pa.array(keep, type=pa.bool_()))

        return docs.transform(small_batches).mapInArrow(run, StructType([*docs.schema.fields, StructField(h1, LongType()), StructField(h2, LongType())]))

    rows = passing(False).select(docs.columns)
    if not gone.isEmpty():
        rows = rows.unionByName(passing(True).join(gone.toDF(h1, h2), [h1, h2], "left_anti").select(docs.columns))
    return rows


def _content(lang: str | None, text: str) -> tuple[int, int]:
    """128 bits of hash of a language and a text, as two signed numbers."""
    import xxhash

    both = xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"), xxhash.xxh3_64_intdigest((lang or POOL).encode("utf-8", "surrogatepass")))
    return int.from_bytes(both[:8], "big", signed=True), int.from_bytes(both[8:], "big", signed=True)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, most_grams: int = MOST_GRAMS) -> DataFrame:
    """One row per input row: doc_id, band, the base counts, base_failed, loss and kept.

    Words are runs of anything but ASCII white space. A document fails the base rules with fewer than 50 words or with
    more than half of them in three-word windows that it repeats. Otherwise the perplexity per symbol of its whole text
    (the exponential of ``loss``) under the model of its own language has to lie in that language's band. The model is of
    n-grams of code points, in any script; it is counted over all documents that pass the base rules, and grows with them.
    ``most_grams`` of each order are sent out; n-grams that weren't are looked up by a join, so that the result is the same.

    Null or empty text has no words and fails; null and rare languages share a model and band. Rows that repeat count
    each time and get equal results. Where no document passes the base rules there is no model, and ``loss`` is null as it
    is for texts of white space only. An empty table gives an empty result.
    """
    trained = train(docs, text_col, lang_col, order, most_grams=most_grams)
    scored = with_loss(cut(score(docs, trained.sent, id_col, text_col, lang_col, order, trained.whole)), trained)
    if not trained.whole:
        scored = cut(scored)
    return judged(scored, bands(scored))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.exp("loss").alias("perplexity"))
