"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0..n-1 in a fixed order; a keyed permutation of 0..n-1 gives
each its place p, with shard = p mod shards and slot = p div shards. Anyone with
(n, seed, shards) can compute a row's place, and back, without a table.

Defined results: null text has no bytes; null ids come first in their bucket;
repeated rows get numbers of their own; texts count whole, however long, and are never
compared; columns of other names stay as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carelake.llm.common import read_table

PRIME = (1 << 31) - 1


@dataclass(frozen=True)
class ShardParams:
    shards: int = 16
    seed: int = 20_241
    rounds: int = 4
    rows_per_bucket: int = 8_192    # rows that one task numbers (and, in the pipeline, carries with their texts)


def sides(n: int) -> tuple[int, int]:
    """a, b with a * b >= n and a * b - n < a: walks are short."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def div(x: Column, y: int) -> Column:
    return F.call_function("div", x, F.lit(y).cast("long"))


def round_keys(params: ShardParams) -> list[tuple[int, int]]:
    keys, x = [], params.seed % PRIME
    for _ in range(2 * params.rounds):
        x = (x * 48_271 + 11) % PRIME
        y = (x * 69_621 + 7) % PRIME
        keys.append((x | 1, y))
    return keys


def permute(place: Column, n: int, params: ShardParams) -> Column:
    """The keyed permutation of 0..n-1 as one expression: rounds on Z_a x Z_b, walked until below n."""
    a, b = sides(n)
    keys = F.array(*[F.struct(F.lit(m).cast("long").alias("m"), F.lit(c).cast("long").alias("c"),
                              F.lit(m2).cast("long").alias("m2"), F.lit(c2).cast("long").alias("c2"))
                     for (m, c), (m2, c2) in zip(*[iter(round_keys(params))] * 2)])

    def mixed(x: Column, m: Column, c: Column, side: int) -> Column:
        y = (x % PRIME * m + c) % PRIME
        return (y * y + x % PRIME) % PRIME % side

    def let(value: Column, body: Callable[[Column], Column]) -> Column:
        return F.element_at(F.transform(F.array(value), body), 1)

    def one_round(s: Column, k: Column) -> Column:
        return let((s["l"] + mixed(s["r"], k["m"], k["c"], a)) % a,
                   lambda l: F.struct(l.alias("l"), ((s["r"] + mixed(l, k["m2"], k["c2"], b)) % b).alias("r")))

    def once(x: Column) -> Column:
        return F.aggregate(keys, F.struct(div(x, b).alias("l"), (x % b).alias("r")), one_round,
                           lambda s: s["l"] * b + s["r"])

    # Fewer than a places lie beyond n, so a walk of a steps always ends; beyond 64 steps
    # its chance is below (1 / a) ** 64, and the last expression would raise, not repeat a place.
    steps = min(a, 64)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), once(place),
                         lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return let(walked, lambda x: F.when(x < n, x).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("long")))


def numbered(docs: DataFrame, order: list[Column], n: int, params: ShardParams) -> DataFrame:
    """docs + row: 0..n-1. Buckets by id and checksum of the text are counted, and rows numbered within
    their bucket: no global sort, no window over the whole table, and rows of one id (or none) spread by text."""
    buckets = max(1, -(-n // params.rows_per_bucket))
    of_id = F.pmod(F.coalesce(F.col("doc_id"), F.lit(0)), F.lit(buckets)).cast("long")
    bucket = (of_id + F.col("text_crc32") % buckets) % buckets
    rows = docs.withColumn("__bucket", bucket)
    counts = docs.groupBy(bucket.alias("__bucket")).agg(F.count(F.lit(1)).alias("__rows"))
    before = F.sum("__rows").over(Window.orderBy("__bucket")) - F.col("__rows")
    starts = counts.select("__bucket", before.alias("__start"))  # one row a bucket
    inner = F.row_number().over(Window.partitionBy("__bucket").orderBy(*order)) - 1
    return (rows.withColumn("__inner", inner).join(starts, "__bucket")
            .withColumn("__row", F.col("__start") + F.col("__inner")).drop("__bucket", "__inner", "__start"))


def shard(rows: DataFrame, params: ShardParams = ShardParams()) -> DataFrame:
    """rows (doc_id, size, text_crc32, ...) + shard, slot. The order of the numbers: doc_id, size, text_crc32."""
    n = rows.count()
    order = [F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("text_crc32")]
    placed = numbered(rows, order, n, params).withColumn("__place", permute(F.col("__row"), n, params))
    return (placed.withColumn("shard", (F.col("__place") % params.shards).cast("int"))
            .withColumn("slot", div(F.col("__place"), params.shards))
            .drop("__row", "__place"))


def sized() -> list[Column]:
    """size and text_crc32 of a document."""
    return [(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
            F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32")]


def shard_documents(docs: DataFrame, params: ShardParams = ShardParams()) -> DataFrame:
    """The columns of ``docs`` + shard, slot (which replace columns of these names)."""
    names = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    rows = docs.select("doc_id", *sized(), F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"))
    return shard(rows, params).select(*[F.col("doc").getField(c).alias(c) for c in names], "shard", "slot")


def op8_shard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return shard(docs.select("doc_id", *sized())).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def _step_sql(params: ShardParams) -> str:
    """One permutation step of the walk: a nested query a half round."""
    sql, keys = "select row, n, a, b, x // b as l, x % b as r from walk, dims where not done", round_keys(params)
    for k, (mult, add) in enumerate(keys):
        of, to, side = ("r", "l", "a") if k % 2 == 0 else ("l", "r", "b")
        sql = f"select *, ({of} % {PRIME} * {mult} + {add}) % {PRIME} as y from ({sql})"
        moved = f"({to} + (y * y + {of} % {PRIME}) % {PRIME} % {side}) % {side} as {to}"
        sql = f"select row, n, a, b, {moved}, {of} from ({sql})"
    return f"select row, l * b + r as x, l * b + r < n as done from ({sql})"


def _crc_digits() -> str:
    """The 256 remainders of CRC-32, ten digits each (DuckDB has no crc32)."""
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ 0xEDB88320 if x & 1 else x >> 1
        out.append(f"{x:010d}")
    return "".join(out)


_DEFAULT = ShardParams()
OP8_SQL = f"""
with recursive
docs as (
  select doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 1 as size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) as bytes
  from documents),
sums as (
  select doc_id, size, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bytes),
    lambda c, b: xor(substr('{_crc_digits()}', 10 * (xor(c, b) & 255) + 1, 10)::BIGINT, c >> 8)))::BIGINT as text_crc32
  from docs),
dims as (
  select n, a, (n + a - 1) // a as b, (n + {_DEFAULT.rows_per_bucket - 1}) // {_DEFAULT.rows_per_bucket} as buckets
  from (select count(*) as n, floor(sqrt(greatest(count(*) - 1, 0)))::BIGINT + 1 as a from documents)),
numbered as (
  select s.*, row_number() over (order by (((coalesce(doc_id, 0) % buckets) + buckets) % buckets + text_crc32 % buckets) % buckets,
    doc_id nulls first, size, text_crc32) - 1 as row from sums s, dims),
walk as (
  select row, row as x, false as done from numbered
  union all
  {_step_sql(_DEFAULT)})
select doc_id, size, text_crc32, 'rows' as law, (x % {_DEFAULT.shards})::INTEGER as shard,
  (x // {_DEFAULT.shards})::BIGINT as slot, NULL::INTEGER as grown_shard
from numbered join walk using (row) where done
"""
