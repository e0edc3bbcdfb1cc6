"""Benchmark decontamination: item-sized windows, CGK embedding, bit-sampling LSH.

Texts and items are read as words. For each item size m, the windows of m words of
every document are embedded by random walks (CGK: a step writes the current word and
moves on by a random bit of it), which turn a small edit distance into a small
Hamming distance. A table samples a few places of a walk; a window and an item that
agree there are candidates. For each item size the number of walks is the smallest by
which randomly edited items of that size are found with the target recall; where
``max_walks`` do not reach it (long items), every item that shares a run with a window
that can match is a candidate. Candidates are verified by their exact edit distance:
a match needs at most ``max_edits`` of the item's words.

Only windows that can match are embedded. Two conditions tell, and neither loses a
match: with k edits some run of m // (k + 1) words (four at most are looked at) must
be one of an item of m words, and at most k words may be foreign to those items.

Items are read in blocks of bounded size; each block is broadcast and passes over all
documents. Defined results: null and empty texts match nothing; items of fewer than
``min_words`` words match only as they are (no edits); equal items match each; a document's best window counts, the first of equals; repeated rows match each;
empty tables give an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carelake.llm.common import find, read_table, shingle_hashes, words_of


@dataclass(frozen=True)
class DecontamParams:
    max_edits: float = 0.2       # of an item's words
    min_words: int = 8           # of an item that may be edited
    run: int = 4                 # words of a run that is looked up
    places: int = 4              # of a walk that a table samples
    tables_per_walk: int = 4
    target_recall: float = 0.99
    max_walks: int = 24          # of a size; sizes that need more are searched without walks
    probes: int = 200            # edited items of a size on which the number of its walks is set
    block_words: int = 100_000   # words of the items that are broadcast at a time
    batch_words: int = 2_000_000
    seed: int = 5


class Known(dict):
    """Word -> id for the words of the items; 0 for all others."""

    def __missing__(self, word: str) -> int:
        return 0


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def embed(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, steps: int, wanted: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """(wanted x walks x windows) the words that each walk writes at the wanted steps (sorted); 1 beyond the window's end."""
    out = np.empty((len(wanted), len(seeds), len(starts)), np.uint64)
    at, column = np.repeat(starts[None], len(seeds), 0), 0
    last = len(words) - 1
    for j in range(steps):
        word = np.where(at < ends, words[np.minimum(at, last)], np.uint64(1))
        while column < len(wanted) and wanted[column] == j:
            out[column] = word
            column += 1
        if column == len(wanted):
            break
        at += (mix(word + seeds[:, None] * np.uint64(2 * steps + 1) + np.uint64(2 * j + 1)) >> np.uint64(63)).astype(np.int64)
    return out


def edit_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Fewest word edits between the item and any run of words of the text, and where that run ends."""
    n = len(text)
    step = np.arange(n + 1)
    row = np.zeros(n + 1, np.int64)
    for i, w in enumerate(item, 1):
        best = row + 1
        best[1:] = np.minimum(best[1:], row[:-1] + (text != w))
        row = np.minimum.accumulate(best - step) + step
    return int(row.min()), int(row.argmin())


class Index:
    """The items of one block, their walks and tables."""

    def __init__(self, ids: list, texts: list[str], params: DecontamParams) -> None:
        self.params = params
        words = [words_of((t or "").lower()) for t in texts]
        kept = [i for i, w in enumerate(words) if w]
        self.ids = [ids[i] for i in kept]
        self.known = Known((w, max(2, xxhash.xxh64_intdigest(w))) for i in kept for w in words[i])
        self.items = [self.read(words[i]) for i in kept]
        self.by_size: dict[int, list[int]] = defaultdict(list)
        for i, w in enumerate(self.items):
            self.by_size[len(w)].append(i)
        # Runs of the items, and which of them (and which words) belong to items of m words.
        self.runs = {q: np.unique(np.concatenate([shingle_hashes(w, q) for w in self.items]))
                     for q in sorted({self.run(m) for m in self.by_size})}
        self.runs_of, self.words_of = {}, {}
        for m, numbers in self.by_size.items():
            grams = self.runs[self.run(m)]
            own = np.zeros(len(grams), bool)
            for i in numbers:
                own[np.searchsorted(grams, shingle_hashes(self.items[i], self.run(m)))] = True
            self.runs_of[m] = own
            self.words_of[m] = np.unique(np.concatenate([self.items[i] for i in numbers]))
        # Walks for each size; None where the items of each run are listed instead, as (run, item) by run.
        self.walks = {m: self.needed_walks(m) for m in self.by_size}
        self.tables = {m: self.build(m) for m, walks in self.walks.items() if walks}
        self.holders = {m: self.runs_held(m) for m, walks in self.walks.items() if not walks}

    def read(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))

    def edits(self, m: int) -> int:
        return int(self.params.max_edits * m) if m >= self.params.min_words else 0

    def run(self, m: int) -> int:
        return min(self.params.run, m // (self.edits(m) + 1))

    def keys(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray, m: int, walks: int) -> list[np.ndarray]:
        """For each table and walk the key of each window."""
        p, steps = self.params, 2 * m
        rng = np.random.default_rng([p.seed, m])
        picked = [np.sort(rng.choice(steps, min(p.places, steps), replace=False)) for _ in range(p.tables_per_walk)]
        wanted = np.unique(np.concatenate(picked))
        seeds = mix(np.arange(p.seed, p.seed + walks, dtype=np.uint64) * np.uint64(7919) + np.uint64(m))
        got = embed(words, starts, ends, steps, wanted, seeds)
        out = []
        for table, places in enumerate(picked):
            key = np.full((walks, len(starts)), m * 16 + table, np.uint64)
            for column in np.searchsorted(wanted, places):
                key = mix(key * np.uint64(31) + got[column])
            out += list(key)
        return out

    def needed_walks(self, m: int) -> int | None:
        """Walks by which randomly edited items of m words are found with the target recall; None if ``max_walks`` are too few."""
        p = self.params
        rng = np.random.default_rng([p.seed, m, 1])
        picked = [self.items[i] for i in rng.choice(self.by_size[m], p.probes)]
        edited = [self.edited(item, rng) for item in picked]
        size = np.array([len(e) for e in edited])
        ends = np.cumsum(size)
        plain = self.keys(np.concatenate(picked), np.arange(p.probes) * m, np.arange(1, p.probes + 1) * m, m, p.max_walks)
        other = self.keys(np.concatenate(edited), ends - size, ends - size + np.minimum(m, size), m, p.max_walks)
        same = np.array([a == b for a, b in zip(plain, other)]).reshape(p.tables_per_walk, p.max_walks, p.probes)
        recall = np.logical_or.accumulate(same.any(0), 0).mean(1)
        enough = np.flatnonzero(recall >= p.target_recall)
        return int(enough[0]) + 1 if len(enough) else None

    def edited(self, item: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        out = list(item)
        for _ in range(self.edits(len(item))):
            at, kind = int(rng.integers(len(out))), rng.integers(3)
            if kind == 0:
                out[at] = np.uint64(0)
            elif kind == 1:
                out.insert(at, np.uint64(0))
            elif len(out) > 1:
                del out[at]
        return np.array(out, np.uint64)

    def runs_held(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        """(run number, item) of the items of m words, in order of the runs."""
        q = self.run(m)
        held = [np.unique(np.searchsorted(self.runs[q], shingle_hashes(self.items[i], q))) for i in self.by_size[m]]
        run, item = np.concatenate(held), np.repeat(self.by_size[m], [len(h) for h in held])
        rank = np.argsort(run, kind="stable")
        return run[rank], item[rank]

    def build(self, m: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each table and walk: sorted keys and their items."""
        numbers = np.array(self.by_size[m])
        words = np.concatenate([self.items[i] for i in numbers])
        starts = np.arange(len(numbers)) * m
        out = []
        for key in self.keys(words, starts, starts + m, m, self.walks[m]):
            rank = np.argsort(key, kind="stable")
            out.append((key[rank], numbers[rank]))
        return out

    def windows(self, words: np.ndarray, begin: np.ndarray, end: np.ndarray,
                hits: dict[int, tuple[np.ndarray, np.ndarray]], m: int) -> np.ndarray:
        """Starts of the windows of m words that can match. hits: by run length the places of item runs and the runs' numbers."""
        k, q = self.edits(m), self.run(m)
        at, run = hits[q]
        at = at[self.runs_of[m][run]]
        if not len(at):
            return at
        start = at[:, None] - np.arange(m - q + 1)
        start = np.unique(start[start >= begin[at][:, None]])
        upto = np.minimum(start + m, end[start])
        return self.familiar(words, end, start[upto - start >= m - k], self.words_of[m], m)

    def familiar(self, words: np.ndarray, end: np.ndarray, start: np.ndarray, own: np.ndarray, m: int) -> np.ndarray:
        """Starts of the windows of m words with at most k words that are not in ``own`` (sorted)."""
        kept = []
        for part in np.array_split(start, max(1, len(start) * m // 4_000_000)):
            place = part[:, None] + np.arange(m)
            inside = place < end[part][:, None]
            _, there = find(own, words[np.minimum(place, len(words) - 1)].ravel())
            kept.append(part[(there.reshape(place.shape) & inside).sum(1) >= m - self.edits(m)])
        return np.concatenate(kept)

    def by_walks(self, words: np.ndarray, end: np.ndarray, starts: np.ndarray, m: int) -> Iterator[tuple[int, int]]:
        """(window start, item): those that agree in a table."""
        stops = np.minimum(starts + m, end[starts])
        for key, (keys, numbers) in zip(self.keys(words, starts, stops, m, self.walks[m]), self.tables[m]):
            low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            for w in np.flatnonzero(high > low):
                for i in numbers[low[w]:high[w]]:
                    yield int(starts[w]), int(i)

    def by_runs(self, words: np.ndarray, begin: np.ndarray, end: np.ndarray, starts: np.ndarray,
                hits: dict[int, tuple[np.ndarray, np.ndarray]], m: int) -> Iterator[tuple[int, int]]:
        """(window start, item): those that share a run, where at most k words of the window are foreign to the item."""
        q = self.run(m)
        at, run = hits[q]
        runs, items = self.holders[m]
        low, high = np.searchsorted(runs, run, "left"), np.searchsorted(runs, run, "right")
        n = high - low
        at = np.repeat(at, n)
        item = items[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
        for i in np.unique(item):
            place = at[item == i]
            first = np.searchsorted(starts, np.maximum(begin[place], place - (m - q)))
            change = np.bincount(first, minlength=len(starts) + 1) - np.bincount(
                np.searchsorted(starts, place, "right"), minlength=len(starts) + 1)
            near = starts[np.cumsum(change)[:-1] > 0]
            for start in self.familiar(words, end, near, np.unique(self.items[i]), m):
                yield int(start), int(i)

    def matches(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(text, item number, edits, first word, words of the item): the best window of each text for each item it matches."""
        out: list[tuple[int, int, int, int, int]] = []
        if not self.items:
            return out
        part, first, size = [], 0, 0
        for i, t in enumerate(texts):
            part.append(self.read(words_of(t.lower())) if t else np.zeros(0, np.uint64))
            size += len(part[-1])
            if size >= self.params.batch_words or i == len(texts) - 1:
                out += [(first + d, *rest) for d, *rest in self._matches(part)]
                part, first, size = [], i + 1, 0
        return out

    def _matches(self, docs: list[np.ndarray]) -> Iterator[tuple[int, int, int, int, int]]:
        words = np.concatenate(docs)
        if not len(words):
            return
        ends = np.cumsum([len(d) for d in docs])
        owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        end, begin = ends[owner], (ends - [len(d) for d in docs])[owner]
        known = np.concatenate([[0], np.cumsum(words != 0)])
        hits = {}
        for q, grams in self.runs.items():
            at = np.zeros(0, np.int64)
            if len(words) >= q:
                at = np.flatnonzero(known[q:] - known[:-q] == q)  # runs of known words
                at = at[end[at] >= at + q]
            number, there = find(grams, shingle_hashes(words, q)[at]) if len(at) else (at, np.zeros(0, bool))
            hits[q] = at[there], number[there]
        for m, walks in self.walks.items():
            starts = self.windows(words, begin, end, hits, m)
            if not len(starts):
                continue
            near = defaultdict(set)
            for start, i in self.by_walks(words, end, starts, m) if walks else self.by_runs(words, begin, end, starts, hits, m):
                near[(int(owner[start]), i)].add(start)
            k = self.edits(m)
            for (doc, i), at in near.items():
                best = None
                for a, b in clusters(sorted(at), m):
                    lo, hi = max(int(begin[a]), a - k), min(int(end[a]), b + m + k)
                    d, stop = edit_distance(self.items[i], words[lo:hi])
                    if d <= k and (best is None or d < best[0]):
                        best = (d, max(0, lo + stop - m - int(begin[a])))
                if best is not None:
                    yield doc, i, best[0], best[1], m


def clusters(starts: list[int], gap: int) -> Iterator[tuple[int, int]]:
    first = last = starts[0]
    for s in starts[1:]:
        if s - last > gap:
            yield first, last
            first = s
        last = s
    yield first, last


def blocks(items: DataFrame, params: DecontamParams) -> Iterator[Index]:
    """The items in blocks of about ``block_words`` words each."""
    items = items.select("item_id", "text").where("text is not null")
    words = items.agg(F.sum(F.regexp_count("text", F.lit(r"\w+"))).alias("n")).first()["n"] or 0
    n = max(1, -(-words // params.block_words))
    numbered = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
    for block in range(n):
        rows = numbered.where(F.col("block") == block).select("item_id", "text").collect()
        if rows:
            rows.sort(key=lambda r: (str(r["item_id"]), r["text"]))
            yield Index([r["item_id"] for r in rows], [r["text"] for r in rows], params)


def leaks(docs: DataFrame, items: DataFrame, params: DecontamParams = DecontamParams()) -> DataFrame:
    """doc_id, item_id, edits, item_words, similarity, first_word: a row for each document and item that it holds."""
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, edits int, item_words int, similarity double, first_word long"
    out = docs.sparkSession.createDataFrame([], schema)
    for index in blocks(items, params):
        shared = docs.sparkSession.sparkContext.broadcast(index)  # bounded by block_words

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = shared.value
            for pdf in batches:
                ids = pdf["doc_id"].tolist()
                found = index.matches(pdf["text"].tolist())
                yield pd.DataFrame([(ids[d], index.ids[i], e, m, 1 - e / m, at) for d, i, e, at, m in found],
                                   columns=["doc_id", "item_id", "edits", "item_words", "similarity", "first_word"])

        out = out.unionByName(docs.select("doc_id", "text").mapInPandas(run, schema))
    return out


def _holds_none(shared: Broadcast) -> Callable[[Column], Column]:
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        hit = {d for d, *_ in shared.value.matches([t if isinstance(t, str) else None for t in texts])}
        return pd.Series([i not in hit for i in range(len(texts))], dtype=bool)
    return clean


def without_leaks(docs: DataFrame, items: DataFrame, params: DecontamParams = DecontamParams()) -> DataFrame:
    """Documents that hold no item, with the columns of ``docs``."""
    for index in blocks(items, params):
        docs = docs.where(_holds_none(docs.sparkSession.sparkContext.broadcast(index))(F.col("text")))
    return docs


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
