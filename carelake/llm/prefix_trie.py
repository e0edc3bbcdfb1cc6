"""Trie of conversation prefixes by splitters and a skeleton.

A turn becomes a record of 20 bytes: 16 of the SHA-256 of its role and text, and the number
of its code points. A conversation's path is its records in a row, so the order of paths
as bytes is the order of a trie, and a node is a run of whole records at a path's beginning.

1. Equal paths are one path with its number of conversations, the smallest id, and the
   hash of all ids, which are streamed in order.
2. Splitters taken from a sample cut the paths into ranges (shards) that Spark sorts. A node
   with conversations in two shards lies on what the last path of one shard and the first
   of the next have in common; these paths are the skeleton and go to every task.
3. A task walks the sorted paths of a shard with a stack. Nodes off the skeleton have their
   whole subtree there and are finished at once. For a node of the skeleton the task hands
   on its share of each figure. All shares add up: a node that an earlier shard has too
   counts as child and for its own length there and not here.
4. Shares are reduced by node, and the few children that hang off the skeleton get their
   parent's id from the reduced table.

Defined results: null role and text are empty; turns with one number are ordered by the
SHA-256 of role and text, null numbers come first; rows without conversation id belong to
no conversation and are left out; repeated rows are turns of their own; texts count whole, however
long, and only their hashes travel; columns of other names are ignored; an empty table has
no node. A conversation's records (20 bytes a turn) are one row.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carelake.llm.common import read_table, small, written

REC = 20


@dataclass(frozen=True)
class TrieParams:
    block: int = 100            # conversations that share the first one's beginning
    shared: int = 6             # of which fewer than this many turns
    shard_bytes: int = 1 << 22  # of different paths in a shard
    sampled: int = 32           # paths a shard in the sample for the splitters
    small_rows: int = 200_000   # skeleton nodes that are broadcast for their ids


def paths_of(turns: DataFrame) -> DataFrame:
    """conv_id, path: the original conversations."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32)
    record = F.concat(digest, F.lpad(F.hex(F.length(text).cast("long")), 8, "0")).alias("rec")
    one = turns.where("conv_id is not null").select("conv_id", F.struct("turn", record).alias("t"))
    return one.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select(
        "conv_id", F.unhex(F.array_join("t.rec", "")).alias("path"))


def rebuilt(originals: DataFrame, params: TrieParams) -> DataFrame:
    """conv_id, path, pkey: each conversation with the beginning of its block's first one."""
    c = F.col("conv_id")
    h = (F.crc32(c.cast("string").cast("binary")) % params.shared).cast("int")
    heads = originals.where(c % params.block == 0).select(
        c.alias("base"), F.substring("path", 1, (params.shared - 1) * REC).alias("head"))
    path = F.concat(F.expr(f"substring(coalesce(head, x''), 1, h * {REC})"), F.expr(f"substring(path, h * {REC} + 1)"))
    return originals.select("conv_id", "path", (c - c % params.block).alias("base"), h.alias("h")).join(
        heads, "base", "left").select("conv_id", path.alias("path")).withColumn(
        "pkey", F.unhex(F.substring(F.sha2("path", 256), 1, 32)))


def ends(rows: DataFrame) -> DataFrame:
    """pkey, ends_sha256: the ids of each path, ascending, streamed into one hash (which has no parts to merge)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hashed, out = None, None, []
        for batch in batches:
            for key, conv in zip(batch.column("pkey").to_pylist(), batch.column("conv_id").to_pylist()):
                if key != at:
                    if at is not None:
                        out.append((at, hashed.hexdigest()))
                    at, hashed = key, hashlib.sha256(str(conv).encode())
                else:
                    hashed.update(b",%d" % conv)
            yield _batch(out, ENDS)
            out = []
        if at is not None:
            yield _batch([(at, hashed.hexdigest())], ENDS)

    return (rows.select("pkey", "conv_id").repartition("pkey").sortWithinPartitions("pkey", "conv_id")
            .mapInArrow(run, "pkey binary, ends_sha256 string"))


ENDS = pa.schema([("pkey", pa.binary()), ("ends_sha256", pa.string())])
NODE = pa.schema([
    ("skeleton", pa.bool_()), ("node", pa.binary()), ("parent", pa.binary()), ("parent_conv_id", pa.int64()), ("conv_id", pa.int64()),
    ("depth", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
    ("ends_sha256", pa.string())])
NODE_SQL = ("skeleton boolean, node binary, parent binary, parent_conv_id long, conv_id long, depth long, n_convs long, "
            "n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
NO_END = hashlib.sha256(b"").hexdigest()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def common(a: bytes, b: bytes) -> int:
    """Number of whole records that both begin with."""
    n = min(len(a), len(b)) // REC
    low, high = 0, n + 1  # the first ``low`` are common, the first ``high`` are not
    while high - low > 1:
        mid = (low + high) // 2
        if a[: mid * REC] == b[: mid * REC]:
            low = mid
        else:
            high = mid
    return low


def unique_paths(rows: DataFrame) -> DataFrame:
    """pkey, path, n, conv_id, ends_sha256: one row a different path."""
    once = rows.groupBy("pkey").agg(F.first("path").alias("path"), F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    return once.join(ends(rows), "pkey")


def splitters(paths: DataFrame, params: TrieParams) -> list[bytes]:
    """Paths that cut all into ranges of about ``shard_bytes``, from some ``sampled`` paths a range."""
    spark = paths.sparkSession
    n, size = paths.agg(F.count("*"), F.sum(F.length("path"))).first()
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // params.shard_bytes))
    share = min(1.0, 2 * shards * params.sampled / max(n, 1))
    unit = F.conv(F.hex(F.substring("pkey", 1, 4)), 16, 10).cast("double") / float(1 << 32)
    got = sorted(bytes(r[0]) for r in paths.where(unit < share).select("path").toLocalIterator())
    return sorted({got[k * len(got) // shards] for k in range(1, shards)}) if got else []


def with_shards(paths: DataFrame, cuts: list[bytes]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [bisect_right(cuts, p) for p in batch.column("path").to_pylist()]
            yield batch.append_column("shard", pa.array(at, pa.int32()))

    return paths.mapInArrow(run, "pkey binary, path binary, n long, conv_id long, ends_sha256 string, shard int")


def skeleton(sharded: DataFrame) -> dict[int, tuple[bytes | None, bytes | None]]:
    """For each shard what its first path shares with the shard before, and its last with the one after (None: no such shard)."""
    @F.udf("binary")
    def shared_part(a, b):
        return None if a is None else bytes(a[: REC * common(bytes(a), bytes(b))])

    in_order = Window.orderBy("shard")  # one row a shard
    bounds = sharded.groupBy("shard").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    joint = bounds.withColumn("before", F.lag("last").over(in_order)).select("shard", shared_part("before", "first").alias("p")).orderBy("shard").collect()
    paths = [None if r["p"] is None else bytes(r["p"]) for r in joint] + [None]
    return {r["shard"]: (paths[i], paths[i + 1]) for i, r in enumerate(joint)}


def node_key(prefix: bytes) -> bytes:
    return hashlib.sha256(prefix).digest()[:16]


class Open:
    """A node whose subtree is being read; ``key`` is set for nodes of the skeleton only."""

    __slots__ = ("children", "conv", "depth", "end", "key", "kids", "leaves", "length", "n", "old", "saved")

    def __init__(self, depth: int, length: int, key: bytes | None, old: bool) -> None:
        self.depth, self.length, self.key, self.old = depth, length, key, old
        self.n, self.conv, self.children, self.leaves, self.saved, self.end = 0, None, 0, 0, 0, None
        self.kids: list[tuple] = []


class Walk:
    """Reads the different paths of one shard in order and adds its nodes to ``out``.

    ``left`` and ``right`` are what the shard's first and last path share with the
    neighbouring shards (None: there is no such shard). A node on either is of the
    skeleton; one on ``left`` was met by an earlier shard.
    """

    def __init__(self, left: bytes | None, right: bytes | None, out: list[tuple]) -> None:
        self.left, self.right, self.out = left, right, out
        self.stack: list[Open] = []
        self.path = b""

    def push(self, path: bytes, n: int, conv: int, end: str) -> None:
        keep = common(self.path, path) if self.stack else -1
        while len(self.stack) > keep + 1:
            self._close()
        for depth in range(len(self.stack), len(path) // REC + 1):
            prefix = path[: depth * REC]
            old = self.left is not None and self.left[: depth * REC] == prefix
            on = old or (self.right is not None and self.right[: depth * REC] == prefix)
            self.stack.append(Open(depth, int.from_bytes(prefix[-4:], "big"), node_key(prefix) if on else None, old))
        self.path, top = path, self.stack[-1]
        top.n += n
        top.conv = conv if top.conv is None else min(top.conv, conv)
        top.end = end

    def finish(self) -> None:
        while self.stack:
            self._close()

    def _close(self) -> None:
        node = self.stack.pop()
        up = self.stack[-1] if self.stack else None
        node.saved += (node.n - (not node.old)) * node.length
        if node.key is None and not node.children:
            node.leaves = 1  # nodes of the skeleton go on in this shard or the next
        self.out.extend((False, None, None, node.conv, *kid) for kid in node.kids)
        row = (node.conv, node.depth, node.n, node.children, node.leaves, node.saved, node.end)
        if node.key is not None:
            self.out.append((True, node.key, up.key if up else None, None, *row))
        elif up is None or up.key is not None:
            self.out.append((False, None, up.key if up else None, None, *row))
        else:
            up.kids.append(row)  # until the parent's smallest id is known
        if up:
            up.n += node.n
            up.conv = node.conv if up.conv is None else min(up.conv, node.conv)
            up.children += not node.old
            up.leaves += node.leaves
            up.saved += node.saved


def shard_nodes(sharded: DataFrame, bones: dict[int, tuple[bytes | None, bytes | None]]) -> DataFrame:
    """Finished nodes, and the shares of the skeleton's nodes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        at, walk = None, None
        for batch in batches:
            for shard, *row in zip(*(batch.column(c).to_pylist() for c in ("shard", "path", "n", "conv_id", "ends_sha256"))):
                if shard != at:
                    if walk:
                        walk.finish()
                    at, walk = shard, Walk(*bones[shard], out)
                walk.push(*row)
            yield _batch(out, NODE)
            out.clear()
        if walk:
            walk.finish()
        yield _batch(out, NODE)

    return (sharded.select("shard", "path", "n", "conv_id", "ends_sha256").repartition("shard").sortWithinPartitions("shard", "path")
            .mapInArrow(run, NODE_SQL))


def prefix_trie(turns: DataFrame, params: TrieParams = TrieParams()) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row a node."""
    originals = written(paths_of(turns), "trie-originals")
    rows = written(rebuilt(originals, params), "trie-rebuilt")
    paths = written(unique_paths(rows), "trie-paths")
    sharded = written(with_shards(paths, splitters(paths, params)), "trie-shards")
    nodes = written(shard_nodes(sharded, skeleton(sharded)), "trie-nodes")
    bones = written(nodes.where("skeleton").groupBy("node").agg(
        F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.max("ends_sha256").alias("ends_sha256")), "trie-skeleton")
    done = nodes.where("not skeleton and parent is null")
    ids = small(bones.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), params.small_rows)
    hanging = (nodes.where("not skeleton and parent is not null").drop("skeleton", "node", "parent_conv_id")
               .unionByName(bones.drop("node")).join(ids, "parent", "left"))
    return done.unionByName(hanging, allowMissingColumns=True).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NO_END)).alias("ends_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read_table(spark, sf_dir, "conversations"))


# DuckDB has no crc32: the checksum is folded over the decimal's bytes from its polynomial.
_CRC = ("list_reduce([4294967295::BIGINT] || list_transform(range(1, length(c) + 1), lambda i: ascii(c[i])::BIGINT), lambda x, b: "
        "list_reduce([xor(x, b)] || range(8), lambda y, k: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END))")

OP11_SQL = f"""
with turns as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first) as i from conversations where conv_id is not null),
convs as (
  select conv_id, xor({_CRC}, 4294967295) % 6 as h from (select distinct conv_id, conv_id::VARCHAR as c from turns)),
rebuilt as (
  select c.conv_id, t.i, t.role, t.text from convs c join turns t on t.conv_id = c.conv_id - c.conv_id % 100 and t.i <= c.h
  union all
  select c.conv_id, 1000000 + t.i, t.role, t.text from convs c join turns t on t.conv_id = c.conv_id and t.i > c.h),
placed as (
  select conv_id, row_number() over w as d, length(text) as n,
    list(md5(md5(role) || md5(text))) over (w rows unbounded preceding) as p from rebuilt window w as (partition by conv_id order by i)),
steps as (
  select conv_id, d, n, array_to_string(p, '') as k, array_to_string(p[:d - 1], '') as up from placed
  union all select conv_id, 0, 0, '', null from convs),
last as (select conv_id, max(d) as d from steps group by conv_id),
nodes as (
  select k, any_value(d) as d, any_value(up) as up, any_value(n) as n, min(conv_id) as conv_id, count(*) as n_convs from steps group by k),
kids as (select up as k, count(*) as n_children from nodes where up is not null group by up),
below as (
  select s.k, sum((u.n_convs - 1) * u.n) as saved, count(*) filter (c.n_children is null) as leaves
  from nodes u left join kids c on c.k = u.k join steps s on s.conv_id = u.conv_id and s.d <= u.d group by s.k),
ends as (
  select s.k, string_agg(s.conv_id::VARCHAR, ',' order by s.conv_id) as ids from steps s join last using (conv_id, d) group by s.k)
select n.conv_id, n.d::BIGINT as depth, p.conv_id as parent_conv_id, n.n_convs::BIGINT as n_convs,
  coalesce(c.n_children, 0)::BIGINT as n_children, b.leaves::BIGINT as n_leaves, b.saved::BIGINT as saved_tokens,
  sha256(coalesce(e.ids, '')) as ends_sha256
from nodes n left join nodes p on p.k = n.up left join kids c on c.k = n.k join below b on b.k = n.k left join ends e on e.k = n.k
"""
