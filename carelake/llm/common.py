"""Shared pieces of the training-data operators."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carelake.session import checkpoint_dir

#: White space of the size and token contracts: space and tab to carriage return.
WORD_RE = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage at a table that every executor can read again, so a lost
    executor costs a re-read and not a re-computation. Columns derived from the
    row order (generated ids) are frozen by the write.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(table: DataFrame, rows: int) -> DataFrame:
    """A written table with a broadcast hint if it has at most so many rows; else as it is, for a shuffled join."""
    return F.broadcast(table) if table.count() <= rows else table


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id as text has the given remainder (null id: as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus == remainder


def text_key(text: Column) -> Column:
    """32 bytes that stand for one text (null: the empty text)."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each wanted key in sorted ``keys``, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class GramCache:
    """Numbers for 64-bit gram keys, with the values that were computed for each.

    A table of slots by hash finds most keys at once; the rest (slots that another key
    took, new keys) are found by search. Beyond ``limit`` keys it starts anew.
    """

    def __init__(self, width: int, limit: int = 2_000_000, slot_bits: int = 20) -> None:
        self.width, self.limit, self.slot_bits = width, limit, slot_bits
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(1, np.uint64)               # by number; number 0 is no key's
        self.values = np.zeros((self.width, 1))
        self.sorted, self.order = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.slots = np.zeros(1 << self.slot_bits, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - self.slot_bits)).astype(np.int64)

    def numbers(self, keys: np.ndarray, values_of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The number of each key. ``values_of(places)`` gives the values (width x n) of the keys at those places."""
        if len(self.keys) > self.limit:
            self.forget()
        ids = self.slots[self._slot(keys)]
        missed = np.flatnonzero((self.keys[ids] != keys) | (ids == 0))
        if len(missed):
            distinct, first, inverse = np.unique(keys[missed], return_index=True, return_inverse=True)
            at, known = find(self.sorted, distinct)
            numbers = np.zeros(len(distinct), np.int64)
            numbers[known] = self.order[at[known]]
            new = distinct[~known]
            if len(new):
                got = values_of(missed[first[~known]])
                numbers[~known] = fresh = np.arange(len(self.keys), len(self.keys) + len(new))
                self.keys = np.concatenate([self.keys, new])
                self.values = np.concatenate([self.values, got], 1)
                self.slots[self._slot(new)] = fresh
                both = np.concatenate([self.sorted, new])
                rank = np.argsort(both, kind="stable")
                self.sorted, self.order = both[rank], np.concatenate([self.order, fresh])[rank]
            ids[missed] = numbers[inverse]
        return ids


def sample_texts(docs: DataFrame, group: DataFrame | None, by: str, rows: int, chars: int) -> DataFrame:
    """(by, text): for each value of ``by`` whole texts in hash order, at most ``rows``, until ``chars`` are reached.

    ``docs`` has doc_id, text (and ``by``, else ``group`` gives it by doc_id). Only ids,
    hashes and lengths are ranked, and of those only a share by hash that is sure to
    hold the sample; the chosen ids, at most ``rows`` a group, fetch their texts.
    """
    docs = docs.where("doc_id is not null and text is not null")
    narrow = docs.select("doc_id", *([by] if group is None else []), F.xxhash64("text").alias("__h"),
                         F.length("text").cast("long").alias("__n"))
    if group is not None:
        narrow = narrow.join(group, "doc_id")
    narrow = narrow.where(F.col(by).isNotNull())
    whole = narrow.groupBy(by).agg(F.count("*").alias("__rows"), F.sum("__n").alias("__chars"))
    unit = F.shiftrightunsigned(F.xxhash64("doc_id", "__h"), 11) / F.lit(float(1 << 53))
    share = F.least(F.lit(float(rows)) / F.col("__rows"), F.lit(float(chars)) / F.greatest("__chars", F.lit(1)))
    first = Window.partitionBy(by).orderBy("__u", "doc_id", "__h")
    ranked = (narrow.withColumn("__u", unit).join(whole, by).where(F.col("__u") < share * 1.5 + 1e-9)
              .withColumn("__rank", F.row_number().over(first))
              .withColumn("__upto", F.sum("__n").over(first.rowsBetween(Window.unboundedPreceding, -1)))
              .where((F.col("__rank") <= rows) & (F.coalesce("__upto", F.lit(0)) < chars)))
    keys = F.broadcast(ranked.select("doc_id", "__h", F.col(by).alias("__by")).distinct())
    full = docs.withColumn("__h", F.xxhash64("text")).join(keys, ["doc_id", "__h"])
    return full.select(F.col("__by").alias(by), "text")


class WordIds(dict):
    """Word -> 64-bit id, the same in every process; memory is bounded by ``limit`` words."""

    def __init__(self, limit: int = 1_000_000) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        self[word] = got = xxhash.xxh64_intdigest(word)
        return got

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


words_of = re.compile(r"\w+").findall


def shingle_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of each run of ``width`` words; a shorter text is one shingle, an empty one none."""
    n = len(ids)
    if n == 0:
        return ids
    width = min(width, n)
    h = ids[: n - width + 1].copy()
    for k in range(1, width):
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += ids[k: n - width + 1 + k]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each connected component of ``edges`` (a, b).

    Alternating large and small star steps. Minima are partial aggregates, so a
    node with many neighbours is never gathered; each round is written to the
    shared folder. Nodes without an edge are not listed; null ends are dropped.
    """
    cur = written(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a is not null and b is not null and a <> b").distinct(), name)
    def sums(table: DataFrame) -> tuple:
        return tuple(table.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())

    state = sums(cur)
    for _ in range(max_rounds):
        both = cur.select("a", "b").unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.join(low, "a").where("b > a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                              F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        cur = written(small.where("a <> b").distinct(), name)
        # A round that changes no edge: settled. Compared by count and two checksums.
        before, state = state, sums(cur)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = cur.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
