"""Vector code compression: product codes whose entries are searched with a GNAT.

Vectors become integers, floor(scale * x), and are cut into equal parts; each part is
coded as the nearest entry of its codebook. Codebooks begin as the parts of the first
vectors and move for some rounds to the floor of the mean of the parts they got.

The nearest entry is found with a geometric near-neighbour access tree over the entries.
A node has a few split points; every other entry belongs to the nearest one, and each
split point stores, for each child, the range of its distances to what the child holds.
By the triangle inequality, the distance of a query to a split point then rules out whole
children. Distances are square roots of exact integers, rounded outward, and a child
goes only if it is strictly farther than the best so far; what is left is compared by
exact integers, ties to the lower entry.

The table of integers is written once and read by each round. A task adds up the parts of
each entry, so a round shuffles at most parts x entries rows a task and hands the driver
parts x entries sums: both bounded by the parameters, whatever the number of vectors.

Defined results: rows whose vector is null or holds a null, NaN or infinity are dropped;
vectors end in zeros up to a common length that the parts divide (an empty vector is all
zeros); integers are held within bounds (some 10^8) in which squared distances stay exact; a null id
comes after all others; ids that occur several times are ordered by vector and each row has
its code; with fewer vectors than entries there are as many entries; null labels are one
label; columns of other names are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelake.llm.common import read_table, small, written


@dataclass(frozen=True)
class CodeParams:
    scale: int = 4096
    parts: int = 8
    entries: int = 16
    rounds: int = 6
    degree: int = 4        # split points of a node
    leaf: int = 4          # entries that are compared one by one
    rows: int = 20_000     # vectors that a task compares at a time
    small_labels: int = 100_000


def squared(q: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact squared distances, queries x points."""
    out = np.zeros((len(q), len(points)), np.int64)
    for k in range(q.shape[1]):
        out += (q[:, k, None] - points[None, :, k]) ** 2
    return out


def below(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, -np.inf)


def above(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


@dataclass
class Node:
    """Entries by number: split points, and for each of them a child with the entries nearest to it."""

    splits: np.ndarray
    children: list[Node | np.ndarray] = field(default_factory=list)
    low: np.ndarray | None = None     # [split, child]: no entry of the child is nearer to the split point
    high: np.ndarray | None = None    # ... or farther


class Gnat:
    """Nearest entry of a codebook (entries x width, integers)."""

    def __init__(self, entries: np.ndarray, degree: int, leaf: int) -> None:
        self.entries, self.degree, self.leaf = entries, degree, leaf
        self.compared = 0     # distances computed, for measurement
        self.root = self._node(np.arange(len(entries)))

    def _node(self, own: np.ndarray) -> Node | np.ndarray:
        if len(own) <= max(self.leaf, self.degree):
            return own
        points = self.entries[own]
        # Split points far from each other: each is the entry farthest from those already chosen.
        chosen = [0]
        nearest = squared(points, points[:1])[:, 0]
        while len(chosen) < self.degree:
            chosen.append(int(np.argmax(nearest)))
            nearest = np.minimum(nearest, squared(points, points[chosen[-1:]])[:, 0])
        chosen = sorted(set(chosen))
        if len(chosen) < 2:
            return own  # all entries are equal
        rest = np.setdiff1d(np.arange(len(own)), chosen)
        far = squared(points[rest], points[chosen])
        home = far.argmin(1)
        node = Node(own[chosen])
        k = len(chosen)
        node.low, node.high = np.full((k, k), np.inf), np.full((k, k), -np.inf)
        for c in range(k):
            mine = home == c
            node.children.append(self._node(own[rest[mine]]))
            if mine.any():
                dist = np.sqrt(far[mine].astype(np.float64))
                node.low[:, c], node.high[:, c] = below(dist.min(0)), above(dist.max(0))
        return node

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance for each query; ties to the lower entry."""
        best = np.full(len(q), len(self.entries), np.int64)
        dist = np.full(len(q), np.iinfo(np.int64).max, np.int64)
        self._search(self.root, q, np.arange(len(q)), best, dist)
        return best, dist

    def _take(self, own: np.ndarray, d: np.ndarray, who: np.ndarray, best: np.ndarray, dist: np.ndarray) -> None:
        self.compared += d.size
        at = d.argmin(1)  # entries are in ascending order: the first of equal ones is the lowest
        got, entry = d[np.arange(len(who)), at], own[at]
        better = (got < dist[who]) | ((got == dist[who]) & (entry < best[who]))
        best[who[better]], dist[who[better]] = entry[better], got[better]

    def _search(self, node: Node | np.ndarray, q: np.ndarray, who: np.ndarray, best: np.ndarray, dist: np.ndarray) -> None:
        own = node.splits if isinstance(node, Node) else node
        if not len(who) or not len(own):
            return
        d = squared(q[who], self.entries[own])
        self._take(own, d, who, best, dist)
        if not isinstance(node, Node):
            return
        root = np.sqrt(d.astype(np.float64))
        near, far = below(root), above(root)
        for c, child in enumerate(node.children):
            if isinstance(child, np.ndarray) and not len(child):
                continue
            # At least so far away, by each split point; rounded down.
            least = below(np.maximum(node.low[None, :, c] - far, near - node.high[None, :, c])).max(1)
            stays = least <= above(np.sqrt(dist[who].astype(np.float64)))
            self._search(child, q, who[stays], best, dist)


def integers(vectors: DataFrame, params: CodeParams) -> DataFrame:
    """vec_id, label, v (little-endian 4-byte integers): the kept rows, all of one length."""
    x = F.col("embedding")
    kept = vectors.select("vec_id", "label", "embedding").where(
        x.isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
    longest = kept.agg(F.max(F.size("embedding"))).first()[0] or 0
    width = -(-longest // params.parts) * params.parts
    bound = min((1 << 31) - 1, math.isqrt((1 << 62) // max(width, 1)) // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            whole = np.zeros((len(lists), width), np.int64)
            row = np.repeat(np.arange(len(lists)), size)
            column = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            whole[row, column] = np.clip(np.floor(flat * params.scale), -bound, bound).astype(np.int64)
            raw = whole.astype("<i4").tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"),
                 pa.array([raw[4 * width * i: 4 * width * (i + 1)] for i in range(len(lists))], pa.binary())], ["vec_id", "label", "v"])

    return kept.mapInArrow(run, f"vec_id {_kind(kept, 'vec_id')}, label {_kind(kept, 'label')}, v binary")


def _kind(df: DataFrame, name: str) -> str:
    kind = df.schema[name].dataType.simpleString()
    return "int" if kind == "void" else kind


def _parts(raw: list[bytes], params: CodeParams) -> np.ndarray:
    """vectors x parts x width."""
    flat = np.frombuffer(b"".join(raw), "<i4").astype(np.int64)
    return flat.reshape(len(raw), params.parts, -1)


def assign(v: np.ndarray, trees: list[Gnat]) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance, each vectors x parts."""
    got = [tree.nearest(np.ascontiguousarray(v[:, p])) for p, tree in enumerate(trees)]
    return np.stack([g[0] for g in got], 1), np.stack([g[1] for g in got], 1)


def forest(books: np.ndarray, params: CodeParams) -> list[Gnat]:
    return [Gnat(book, params.degree, params.leaf) for book in books]


def sums(table: DataFrame, books: np.ndarray, params: CodeParams) -> DataFrame:
    """part, entry, n, total (array): what each entry got, over all vectors."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = forest(books, params)
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, params.rows):
                v = _parts(batch.column("v").slice(at, params.rows).to_pylist(), params)
                code, _ = assign(v, trees)
                for p in range(parts):
                    n[p] += np.bincount(code[:, p], minlength=entries)
                    np.add.at(total[p], code[:, p], v[:, p])
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_pydict({
            "part": pa.array(p, pa.int32()), "entry": pa.array(e, pa.int32()), "n": pa.array(n[p, e], pa.int64()),
            "total": pa.array(list(total[p, e]), pa.list_(pa.int64()))})

    got = table.select("v").mapInArrow(run, "part int, entry int, n long, total array<long>")
    # One task's sums fit a long; those of all may not.
    return got.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[
        F.sum(F.get("total", F.lit(k)).cast("decimal(38,0)")) for k in range(width)]).alias("total"))


def train(table: DataFrame, params: CodeParams) -> np.ndarray:
    """Codebooks, parts x entries x width."""
    first = table.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(params.entries).select("v").collect()
    if not first:
        return np.zeros((params.parts, 0, 0), np.int64)
    books = _parts([bytes(r[0]) for r in first], params).transpose(1, 0, 2).copy()
    for _ in range(params.rounds if books.shape[2] else 0):
        moved = books.copy()
        for part, entry, n, total in sums(table, books, params).collect():
            moved[part, entry] = [int(t) // n for t in total]
        if (moved == books).all():
            break  # settled: further rounds change nothing
        books = moved
    return books


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(table: DataFrame, books: np.ndarray, params: CodeParams) -> DataFrame:
    """vec_id, label, code, error of every vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = forest(books, params)
        for batch in batches:
            for at in range(0, batch.num_rows, params.rows):
                part = batch.slice(at, params.rows)
                code, dist = assign(_parts(part.column("v").to_pylist(), params), trees)
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id"), part.column("label"),
                     pa.array(["".join(f"{c:02x}" for c in row) for row in code.tolist()], pa.string()),
                     pa.array(dist.sum(1), pa.int64())], ["vec_id", "label", "code", "error"])

    return table.mapInArrow(run, f"vec_id {_kind(table, 'vec_id')}, label {_kind(table, 'label')}, code string, error long")


def compress(vectors: DataFrame, params: CodeParams = CodeParams()) -> DataFrame:
    """vec_id, label, code, error, label_error, codebooks_sha256: one row a kept vector."""
    table = written(integers(vectors, params), "codes-integers")
    books = train(table, params)
    coded = written(encode(table, books, params), "codes-coded")
    # Labels are few as a rule; their sums are broadcast only if the count says so.
    by_label = small(written(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "codes-labels"), params.small_labels)
    l, r = coded.alias("l"), by_label.alias("r")
    return l.join(r, F.col("l.label").eqNullSafe(F.col("r.label"))).select(
        "l.vec_id", "l.label", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(read_table(spark, sf_dir, "embeddings")).drop("label")


def _sql(p: CodeParams = CodeParams()) -> str:
    """One level of the SQL a round: distances of all parts to all entries, the first nearest, the floors of the means."""
    def nearest(k: int) -> str:
        return f"""a{k} as materialized (
  select p.vec_id, p.part, min(d) as d, arg_min(e, (d, e)) as e from (
    select p.vec_id, p.part, b.e, list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT as d
    from parts p join b{k} b on p.part = b.part) p group by all)"""

    steps = []
    for k in range(p.rounds):
        steps.append(nearest(k))
        steps.append(f"""b{k + 1} as materialized (
  select b.part, b.e, coalesce(m.x, b.x) as x from b{k} b left join (
    select part, e, list(((s - ((s % n) + n) % n) // n)::BIGINT order by i) as x from (
      select a.part, a.e, i, sum(p.x[i]) as s, count(*) as n from a{k} a join parts p using (vec_id, part),
        unnest(range(1, len(p.x) + 1)) u(i) group by all) group by part, e) m on b.part = m.part and b.e = m.e)""")
    steps.append(nearest(p.rounds))
    return f"""
with kept as (
  select vec_id, label, list_transform(embedding, lambda x: floor({p.scale} * x::DOUBLE)::BIGINT) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
parts as materialized (
  select vec_id, part, v[part * (len(v) // {p.parts}) + 1 : (part + 1) * (len(v) // {p.parts})] as x from kept, unnest(range({p.parts})) u(part)),
b0 as materialized (
  select part, row_number() over (partition by part order by vec_id) - 1 as e, x from parts
  where vec_id in (select vec_id from kept order by vec_id limit {p.entries})),
{", ".join(steps)},
coded as (
  select vec_id, string_agg(printf('%02x', e), '' order by part) as code, sum(d)::BIGINT as error from a{p.rounds} group by vec_id),
books as (
  select sha256(string_agg(array_to_string(x, ','), ',' order by part, e)) as s from b{p.rounds})
select vec_id, code, error, (sum(error) over (partition by label))::BIGINT as label_error, s as codebooks_sha256
from coded join kept using (vec_id), books
"""


OP12_SQL = _sql()
