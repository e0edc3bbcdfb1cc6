"""Language-model scoring by prediction by partial matching over bytes.

A trie of byte contexts up to ``order`` holds how often each symbol (256 bytes and an
end of text) followed each context. A symbol is coded in the longest context that
the trie holds; if it never followed there, an escape is coded (method D: each
distinct symbol gives half a count to the escape) and the next shorter context is
tried, without the symbols that the longer one has already ruled out. Below order 0 the
symbols left are equally likely. The code length of a text is the sum over its symbols.

Pretrained scoring gathers the counts of the whole training part with Spark; the trie
that is broadcast keeps all contexts seen at least ``t`` times, with the smallest t
that fits ``max_nodes``. Symbols whose longest context was not kept meet the counts of
all contexts in a shuffle by their shortest context that was not kept: all longer ones
lie in the same part, the kept ones in the broadcast, so every context scores. Adaptive
scoring learns from the text itself as it goes.

The base score is a word model with add-one smoothing over all training words. Counts
of the ``max_words`` most frequent words are broadcast; all other words of a
document are joined with the full table.

Defined results: a null text is empty (only its end is coded); a null id hashes as
the empty text; repeated rows are scored each; without training texts every symbol
is equally likely; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carelake.llm.common import GramCache, find, held_out, read_table, written

EDGE = 256       # before and after a text
SYMBOLS = 257
BITS = 9         # of a symbol in a packed gram
PIECE = 1 << 21  # bytes that are read at a time


@dataclass(frozen=True)
class PpmParams:
    order: int = 5
    max_nodes: int = 2_000_000    # entries of the broadcast trie
    max_words: int = 400_000      # words whose counts are broadcast
    part_grams: int = 500_000     # grams of contexts that were not kept, in a part of the shuffle


def pieces(texts: list[bytes], order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(packed grams of order + 1 symbols, number of the text of each): all predicted symbols of all texts, in parts of bounded size."""
    parts, owners, size = [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t)), PIECE):
            end = min(len(t), at + PIECE)
            before = np.full(order, EDGE, np.uint64)
            if at:  # the last symbols of the piece before
                before = np.frombuffer(t[at - order: at], np.uint8).astype(np.uint64)
            parts.append((before, t[at:end], end == len(t)))
            owners.append(i)
            size += end - at
            if size >= PIECE:
                yield _grams(parts, owners, order)
                parts, owners, size = [], [], 0
    if parts:
        yield _grams(parts, owners, order)


def _grams(parts: list, owners: list[int], order: int) -> tuple[np.ndarray, np.ndarray]:
    lens = np.array([order + len(t) + last for _, t, last in parts])
    sym = np.empty(lens.sum(), np.uint64)
    at = 0
    for (before, t, last), n in zip(parts, lens):
        sym[at: at + order] = before
        sym[at + order: at + order + len(t)] = np.frombuffer(t, np.uint8)
        if last:
            sym[at + n - 1] = EDGE
        at += n
    gram = sym[: len(sym) - order].copy()
    for k in range(1, order + 1):
        gram <<= np.uint64(BITS)
        gram |= sym[k: len(sym) - order + k]
    # A gram is of a text where its last symbol is; those that end in the context of the next piece go.
    ends = np.cumsum(lens)
    keep = np.ones(len(sym), bool)
    for k in range(order):
        keep[np.concatenate([[0], ends[:-1]]) + k] = False
    owner = np.repeat(np.array(owners), lens - order)
    return gram[keep[order:]], owner


def trie_orders(order: int) -> list[int]:
    return [(1 << BITS * (k + 1)) - 1 for k in range(order + 1)]


class Trie:
    """Sorted grams and contexts of each order, ready for scoring."""

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]], base: Trie | None = None, whole: bool = True) -> None:
        """grams[k]: (keys of k + 1 symbols, counts), any order; shorter suffixes of a gram must be there too, or in ``base``."""
        self.order, self.base, self.whole = len(grams) - 1, base, whole
        self.keys, self.counts, self.ctx, self.total, self.distinct, self.ruled = [], [], [], [], [], []
        for k, (keys, counts) in enumerate(grams):
            rank = np.argsort(keys)
            keys, counts = keys[rank].astype(np.uint64), counts[rank].astype(np.float64)
            ctx, inverse = np.unique(keys >> np.uint64(BITS), return_inverse=True)
            self.keys.append(keys)
            self.counts.append(counts)
            self.ctx.append(ctx)
            self.total.append(np.bincount(inverse, counts, len(ctx)))
            self.distinct.append(np.bincount(inverse, minlength=len(ctx)).astype(np.float64))
            # What the symbols of this context weigh in the next shorter one, which no longer codes them.
            lower = np.zeros(len(keys))
            if k:
                lower = self.count(k - 1, keys & np.uint64((1 << BITS * k) - 1))
            self.ruled.append(np.bincount(inverse, lower, len(ctx)))

    def count(self, k: int, keys: np.ndarray) -> np.ndarray:
        """Count of each key of k + 1 symbols; 0 if it is not there."""
        at, seen = find(self.keys[k], keys)
        out = np.zeros(len(keys))
        out[seen] = self.counts[k][at[seen]]
        if self.base is not None:
            out[~seen] = self.base.count(k, keys[~seen])
        return out

    def context(self, k: int, ctx: np.ndarray) -> np.ndarray:
        """(total, distinct, ruled) x contexts of k symbols; zeros if a context is not there."""
        at, there = find(self.ctx[k], ctx)
        out = np.zeros((3, len(ctx)))
        out[:, there] = self.total[k][at[there]], self.distinct[k][at[there]], self.ruled[k][at[there]]
        if self.base is not None:
            out[:, ~there] = self.base.context(k, ctx[~there])
        return out

    def depth(self, grams: np.ndarray) -> np.ndarray:
        """Order of the longest context of each gram that is there (-1: not even the empty one)."""
        out = np.full(len(grams), -1)
        left = np.arange(len(grams))
        for k in range(self.order, -1, -1):
            _, there = find(self.ctx[k], (grams[left] & np.uint64((1 << BITS * (k + 1)) - 1)) >> np.uint64(BITS))
            out[left[there]] = k
            left = left[~there]
        return out

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's last symbol after the ones before."""
        out = np.zeros(len(grams))
        live = np.arange(len(grams))
        gone, gone_distinct = np.zeros(len(grams)), np.zeros(len(grams))
        for k in range(self.order, -1, -1):
            key = grams[live] & np.uint64((1 << BITS * (k + 1)) - 1)
            total, distinct, ruled = self.context(k, key >> np.uint64(BITS))
            there = total > 0
            if not there.any():
                continue
            mass = np.where(there, total - gone[live], 0.0)
            left = np.where(there, distinct - gone_distinct[live], 0.0)
            c = self.count(k, key)
            seen = c > 0
            out[live[seen]] += np.log10((c[seen] - 0.5) / mass[seen])
            escape = ~seen & (mass > 0)
            out[live[escape]] += np.log10(0.5 * left[escape] / mass[escape])
            moved = there & ~seen
            gone[live[moved]] = ruled[moved]
            gone_distinct[live[moved]] = distinct[moved]
            live = live[~seen]
            if not len(live):
                return out
        # gone_distinct: symbols known at order 0
        out[live] -= np.log10(np.maximum(1.0, SYMBOLS - gone_distinct[live]))
        return out


class Scorer:
    """Scores of texts by a trie; with ``split`` the grams whose longest context it lacks are handed on instead."""

    def __init__(self, trie: Trie, split: bool = False) -> None:
        self.trie, self.split, self.cache = trie, split, GramCache(1, slot_bits=22)

    def values(self, grams: np.ndarray) -> np.ndarray:
        if not self.split:
            return self.trie.log10(grams)
        out = np.full(len(grams), np.nan)
        _, there = find(self.trie.ctx[-1], grams >> np.uint64(BITS))
        out[there] = self.trie.log10(grams[there])
        return out

    def parts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The score of each text, and the grams handed on with the number of the text of each."""
        out = np.zeros(len(texts))
        owners, rest = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for grams, owner in pieces(texts, self.trie.order):
            ids = self.cache.numbers(grams, lambda new, g=grams: self.values(g[new])[None])
            got = self.cache.values[0][ids]
            if self.split:
                far = np.isnan(got)
                owners.append(owner[far])
                rest.append(grams[far])
                got = np.where(far, 0.0, got)
            out += np.bincount(owner, got, len(texts))
        return out, np.concatenate(owners), np.concatenate(rest)

    def log10(self, texts: list[bytes]) -> np.ndarray:
        return self.parts(texts)[0]


def adaptive_log10(text: bytes, order: int = 4) -> float:
    """log10 probability of a text under a trie that starts empty and learns each symbol once it is coded."""
    trie: dict[tuple, Counter] = defaultdict(Counter)
    symbols, bits = [EDGE] * order + list(text) + [EDGE], 0.0
    for i in range(order, len(symbols)):
        s, ruled = symbols[i], frozenset()
        for k in range(order, -1, -1):
            seen = {x: c for x, c in trie[tuple(symbols[i - k: i])].items() if x not in ruled}
            mass = sum(seen.values())
            if s in seen:
                bits += math.log10((seen[s] - 0.5) / mass)
                break
            if mass:
                bits += math.log10(0.5 * len(seen) / mass)
            ruled |= seen.keys()
        else:
            bits -= math.log10(max(1, SYMBOLS - len(ruled)))
        for k in range(order + 1):
            trie[tuple(symbols[i - k: i])][s] += 1
    return bits


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts, and the text of each. The ASCII functions know A-Z and the six ASCII blanks only, as the contract does."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, owner = lists.flatten(), pc.list_parent_indices(lists)
    real = pc.not_equal(words, "")  # blanks at either end leave empty words
    return words.filter(real), owner.filter(real).to_numpy()


def texts_of(batch: pa.RecordBatch) -> tuple[pa.Array, list[bytes]]:
    texts = batch.column("text").fill_null("")
    return texts, texts.cast(pa.binary()).to_pylist()


COUNTS = pa.schema([("word", pa.string()), ("gram", pa.int64()), ("c", pa.int64())])


def counts(docs: DataFrame, params: PpmParams) -> DataFrame:
    """(word, gram, c) over all texts: rows of words have no gram, rows of grams no word; the end of text is the empty word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, raw = texts_of(batch)
            found = pc.value_counts(tokens(texts)[0])
            n = len(found)
            yield pa.RecordBatch.from_arrays([found.field("values"), pa.nulls(n, pa.int64()), found.field("counts")], schema=COUNTS)
            yield pa.RecordBatch.from_arrays([pa.array([""]), pa.nulls(1, pa.int64()), pa.array([len(raw)])], schema=COUNTS)
            keys, amounts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for grams, _ in pieces(raw, params.order):
                key, c = np.unique(grams, return_counts=True)
                keys.append(key)
                amounts.append(c)
            key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            c = np.bincount(inverse, np.concatenate(amounts), len(key)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(key), pa.string()), pa.array(key.astype(np.int64)), pa.array(c)], schema=COUNTS)

    got = docs.select("text").mapInArrow(run, "word string, gram long, c long")
    return got.groupBy("word", "gram").agg(F.sum("c").alias("c"))


def _columns(table: DataFrame) -> list[np.ndarray]:
    got = table.toArrow()
    return [got.column(i).to_numpy() for i in range(got.num_columns)]


def _cut(histogram: list, limit: int) -> int:
    """Smallest bound such that the entries at or above it are at most ``limit``; histogram: (bound, entries)."""
    left, cut = 0, None
    for bound, n in sorted(histogram, reverse=True):
        left += n
        if left > limit:
            break
        cut = bound
    return cut if cut is not None else 1 << 62


def gather_trie(table: DataFrame, params: PpmParams) -> Trie:
    """The trie of the gram counts, within ``max_nodes`` entries; ``whole`` tells whether that is all of them."""
    grams = table.where("gram is not null").select("gram", "c")
    orders = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("gram").bitwiseAND(F.lit(m).cast("long")).alias("key"))
                                 for k, m in enumerate(trie_orders(params.order))]))
    entries = grams.select(orders.alias("e"), "c").groupBy("e.k", "e.key").agg(F.sum("c").alias("c"))
    contexts = entries.groupBy("k", F.shiftright("key", BITS).alias("ctx")).agg(F.sum("c").alias("n"), F.count("*").alias("d"))
    entries, contexts = written(entries, "ppm-entries"), written(contexts, "ppm-contexts")
    # Eight bounds an octave; a shorter context is never rarer, so what stays is closed under shortening.
    bound = F.floor(F.log2("n") * 8).alias("b")
    histogram = contexts.groupBy(bound).agg(F.sum("d").alias("d")).collect()
    cut = _cut([(r["b"], r["d"]) for r in histogram], params.max_nodes)
    kept = entries
    if cut > 0:
        fit = contexts.where(F.floor(F.log2("n") * 8) >= cut).select("k", "ctx")
        kept = entries.withColumn("ctx", F.shiftright("key", BITS)).join(fit, ["k", "ctx"], "left_semi").select("k", "key", "c")
    k, key, c = _columns(kept)
    whole = all(r["b"] >= cut for r in histogram)
    return Trie([(key[k == i], c[k == i]) for i in range(params.order + 1)], whole=whole)


REQUESTS = pa.schema([("part", pa.int32()), ("row", pa.int64()), ("gram", pa.int64()), ("c", pa.int64())])


def shortest_missing(trie: Trie, grams: np.ndarray) -> np.ndarray:
    """Hash of the shortest context of each gram that the trie lacks."""
    k = (trie.depth(grams) + 1).astype(np.uint64)
    ctx = (grams >> np.uint64(BITS)) & ((np.uint64(1) << np.uint64(BITS) * k) - np.uint64(1))
    return ((ctx + (k << np.uint64(56))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int32)


def deeper(trie: Trie, grams: np.ndarray, c: np.ndarray) -> Trie:
    """The contexts that ``trie`` lacks, from training grams that hold all or none of a shortest missing context's."""
    depth, out = trie.depth(grams), []
    for k, m in enumerate(trie_orders(trie.order)):
        own = depth < k
        key, inverse = np.unique(grams[own] & np.uint64(m), return_inverse=True)
        out.append((key, np.bincount(inverse, c[own], len(key))))
    return Trie(out, trie)


def far_scores(table: DataFrame, rest: DataFrame, shared: Broadcast, params: PpmParams) -> DataFrame:
    """rest (row, rest: grams) -> row, score: the part of a row's score that contexts outside the broadcast decide.

    A missing context was seen fewer than t times, so no group of training grams is
    large; a part reads its training grams first and then streams the rows' grams.
    """
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value[0]
        for batch in batches:
            gram = batch.column("gram").to_numpy().astype(np.uint64)
            _, there = find(trie.ctx[-1], gram >> np.uint64(BITS))
            yield requests(trie, np.full((~there).sum(), -1), gram[~there], batch.column("c").to_numpy()[~there])

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = shared.value[0]
        for batch in batches:
            lists = batch.column("rest")
            row = batch.column("row").to_numpy()[pc.list_parent_indices(lists).to_numpy()]
            gram = lists.flatten().to_numpy().astype(np.uint64)
            yield requests(trie, row, gram, np.ones(len(gram), np.int64))

    def requests(trie: Trie, row: np.ndarray, gram: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(shortest_missing(trie, gram)), pa.array(row), pa.array(gram.astype(np.int64)),
                                           pa.array(c)], schema=REQUESTS)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, amounts, model = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], None
        for batch in batches:
            row, gram, c = (batch.column(x).to_numpy() for x in ("row", "gram", "c"))
            first = int(np.searchsorted(row, 0))  # training grams have row -1
            grams.append(gram[:first].astype(np.uint64))
            amounts.append(c[:first])
            if first == len(row):
                continue
            if model is None:
                model = deeper(shared.value[0], np.concatenate(grams), np.concatenate(amounts))
            key, inverse = np.unique(gram[first:].astype(np.uint64), return_inverse=True)
            rows, number = np.unique(row[first:], return_inverse=True)
            yield pa.RecordBatch.from_pydict({"row": rows, "score": np.bincount(number, model.log10(key)[inverse], len(rows))})

    known = table.where("gram is not null").select("gram", "c")
    kind = "part int, row long, gram long, c long"
    n = max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-known.count() // params.part_grams))
    return (known.mapInArrow(train, kind).unionByName(rest.mapInArrow(wanted, kind))
            .repartition(n, "part").sortWithinPartitions("row").select("row", "gram", "c")
            .mapInArrow(resolve, "row long, score double"))


@dataclass(frozen=True)
class Words:
    """Counts of the frequent words, and the figures of the whole table."""

    frequent: pa.Array
    counts: np.ndarray
    total: int
    distinct: int
    ends: int


def gather_words(table: DataFrame, params: PpmParams) -> Words:
    words = table.where("word is not null")
    facts = words.agg(F.sum("c").alias("n"), F.count("*").alias("v"),
                      F.sum(F.when(F.length("word") == 0, F.col("c"))).alias("ends")).first()
    histogram = words.groupBy(F.least("c", F.lit(100_000)).alias("b")).agg(F.count("*").alias("n")).collect()
    cut = _cut([(r["b"], r["n"]) for r in histogram], params.max_words)
    kept = words.where((F.col("c") >= cut) & (F.length("word") > 0)).select("word", "c").toArrow()
    word = pa.concat_arrays([pa.array([], pa.string()), *kept.column("word").cast(pa.string()).chunks])
    return Words(word, kept.column("c").to_numpy(), facts["n"] or 0, facts["v"], facts["ends"] or 0)


def score(docs: DataFrame, train: Column, params: PpmParams = PpmParams()) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_tokens, n_known, train_tokens, base_score, score, and n_bytes."""
    table = written(counts(docs.where(train), params), "ppm-counts")
    words, trie = gather_words(table, params), gather_trie(table, params)
    space = words.total + words.distinct + 1
    shared = docs.sparkSession.sparkContext.broadcast((trie, words))  # bounded by max_nodes and max_words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, words = shared.value
        model = Scorer(trie, split=not trie.whole)
        log, end = np.log10((words.counts + 1) / space), math.log10((words.ends + 1) / space)
        for batch in batches:
            texts, raw = texts_of(batch)
            word, owner = tokens(texts)
            at = pc.index_in(word, value_set=words.frequent).fill_null(-1).to_numpy()
            hit, n = at >= 0, len(raw)
            near, far, grams = model.parts(raw)
            far = np.concatenate([[0], np.cumsum(np.bincount(far, minlength=n))]).astype(np.int32)
            rare = np.concatenate([[0], np.cumsum(np.bincount(owner[~hit], minlength=n))]).astype(np.int32)
            yield pa.RecordBatch.from_pydict({
                "row": batch.column("row"), "doc_id": batch.column("doc_id"),
                "n_tokens": np.bincount(owner, minlength=n) + 1,
                "n_known": np.bincount(owner[hit], minlength=n) + int(words.ends > 0),
                "base": np.bincount(owner[hit], log[at[hit]], n) + end,
                "rare": pa.ListArray.from_arrays(pa.array(rare), word.filter(pa.array(~hit))),
                "rest": pa.ListArray.from_arrays(pa.array(far), pa.array(grams.astype(np.int64))),
                "score": near,
                "n_bytes": np.fromiter(map(len, raw), np.int64, n)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = written(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(
        run, f"row long, doc_id {kind}, n_tokens long, n_known long, base double, rare array<string>, rest array<long>, score double, n_bytes long"), "ppm-scored")
    # All words that were not broadcast meet the full table; hot words are broadcast ones, so no key is hot here.
    rare = scored.select("row", F.explode("rare").alias("word"))
    more = (rare.join(table.where("word is not null").select("word", "c"), "word", "left")
            .select("row", F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(space))).alias("base"),
                    F.col("c").isNotNull().cast("long").alias("known"), F.lit(0.0).alias("score")))
    if not trie.whole:
        far = far_scores(table, scored.select("row", "rest"), shared, params)
        more = more.unionByName(far.select("row", F.lit(0.0).alias("base"), F.lit(0).cast("long").alias("known"), "score"))
    found = more.groupBy("row").agg(F.sum("base").alias("more"), F.sum("known").alias("more_known"), F.sum("score").alias("more_score"))
    return (scored.drop("rare", "rest").join(found, "row", "left")
            .select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
                    F.lit(words.total).cast("long").alias("train_tokens"),
                    (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
                    (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"), "n_bytes"))


def op4_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    got = score(docs, ~held_out(F.col("doc_id"), 7, 2))
    return got.select("doc_id", held_out(F.col("doc_id"), 7, 2).alias("held_out"), "n_tokens", "n_known",
                      "train_tokens", "base_score", "score", "n_bytes")
