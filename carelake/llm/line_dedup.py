"""Removal of lines that many documents share, with two Bloom filters.

A line's key is the line without white space at both ends and with A-Z in lower case.
Long keys that stand in ``min_docs`` documents or more lose their lines everywhere but
in the document with the largest id.

1. One pass writes the key hashes of each document, 16 bytes a line.
2. Tasks mark the bits of their keys in a filter of what they saw once and one of what
   they saw twice, and send only the cells that they touched, as lists of offsets or as
   bit maps, whichever is smaller. Cells merge in a shuffle: a bit that two tasks saw once
   was seen twice.
3. Keys whose bits were all seen twice are suspects. Only these shuffle, as a hash and
   an id, for the exact count and the choice of the document that keeps the line.
4. The confirmed keys go to every task if they are few by count; else they are joined with
   the suspects (very frequent keys aside, which are few by their count), gathered by
   document, and brought to the texts.

The filters have ``bits_per_key`` bits a key up to ``max_bits``, which bounds what is sent
to the driver and broadcast (an eighth as many bytes). Beyond it more keys are suspected
and shuffle; the result is the same.

Defined results: a row is a document; a null or empty text is one empty line; a null id is
below all ids, and lines held by null ids only stay in all of them; rows that share the
largest id all keep the line; a key counts once a document however often it stands there;
texts are read whole, however long; columns of other names are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelake.llm.common import read_table, written

WHITE = " \t\n\x0b\x0c\r"
CELL_BITS = 16          # a cell of the filter has 2 ** 16 bits, so that offsets take two bytes
KEY = 16                # bytes of a key's SHA-256


@dataclass(frozen=True)
class LineParams:
    min_chars: int = 20
    min_docs: int = 3
    bits_per_key: int = 16
    max_bits: int = 1 << 29
    chunk_keys: int = 2_000_000    # keys whose bits a task holds at a time
    max_broadcast: int = 1_000_000  # confirmed keys sent to every task (some 25 bytes each)
    hot_share: int = 1_000         # a key held by more than this part of all suspects is joined by broadcast


def slices(batch: pa.RecordBatch, column: str, limit: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``limit`` bytes of ``column`` (a single row may be longer)."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size, dtype=np.int64) // limit
    cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cut, cut[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def line_keys(texts: pa.Array, params: LineParams) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Lines of each text, the places (over all lines) of those with a long key, and these keys' hashes."""
    lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    counts = pc.list_value_length(lines).to_numpy(zero_copy_only=False)
    keys = pc.ascii_lower(pc.ascii_trim(pc.list_flatten(lines), characters=WHITE))
    long = pc.greater_equal(pc.utf8_length(keys), params.min_chars)
    digests = [hashlib.sha256(k).digest()[:KEY] for k in keys.filter(long).cast(pa.binary()).to_pylist()]
    return counts, np.flatnonzero(long.to_numpy(zero_copy_only=False)), digests


def key_lists(docs: DataFrame, params: LineParams) -> DataFrame:
    """doc_id, tkey (16 bytes of the text's SHA-256), keys (the document's different key hashes, joined), n_keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                counts, at, digests = line_keys(part.column("text"), params)
                cut = np.searchsorted(at, np.concatenate([[0], np.cumsum(counts)])).tolist()
                own = [list(dict.fromkeys(digests[a:b])) for a, b in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "tkey": part.column("tkey"),
                    "keys": pa.array([b"".join(k) for k in own], pa.binary()),
                    "n_keys": pa.array([len(k) for k in own], pa.int32())})

    tkey = F.unhex(F.substring(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256), 1, 2 * KEY))
    return docs.select("doc_id", "text", tkey.alias("tkey")).mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, tkey binary, keys binary, n_keys int")


def hashes_of(keys: list[bytes]) -> np.ndarray:
    """First eight bytes of each key in the joined lists."""
    return np.frombuffer(b"".join(keys), "<u8")[::2]


def bits_of(hashes: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each key; both lie in one cell."""
    cell = (hashes >> np.uint64(2 * CELL_BITS)) % np.uint64(cells)
    low = np.uint64((1 << CELL_BITS) - 1)
    base = cell << np.uint64(CELL_BITS)
    return base | (hashes & low), base | ((hashes >> np.uint64(CELL_BITS)) & low)


def packed(offsets: np.ndarray) -> bytes:
    """Offsets of a cell as two bytes each, or as a bit map (which has one length of its own) if that is smaller."""
    if 2 * len(offsets) < (1 << CELL_BITS) // 8:
        return offsets.astype("<u2").tobytes()
    cell = np.zeros(1 << CELL_BITS, np.uint8)
    cell[offsets] = 1
    return np.packbits(cell).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    if len(raw) == (1 << CELL_BITS) // 8:
        return np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8)))
    return np.frombuffer(raw, "<u2")


def mark_cells(hashes: np.ndarray, cells: int) -> pa.RecordBatch:
    """cell, once, twice: bits that these keys touch, and those that they touch more than once."""
    bits, count = np.unique(np.concatenate(bits_of(hashes, cells)), return_counts=True)
    cell, low = bits >> np.uint64(CELL_BITS), bits & np.uint64((1 << CELL_BITS) - 1)
    names, start = np.unique(cell, return_index=True)
    rows = [(low[a:b], low[a:b][count[a:b] > 1]) for a, b in zip(start, np.append(start[1:], len(cell)))]
    return pa.RecordBatch.from_pydict({
        "cell": pa.array(names.astype(np.int64), pa.int64()), "once": pa.array([packed(o) for o, _ in rows], pa.binary()),
        "twice": pa.array([packed(t) for _, t in rows], pa.binary())})


def merge_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """cell, seen: the bits seen twice, from rows (cell, once, twice) sorted by cell; one cell is held at a time."""
    at, count = None, np.zeros(1 << CELL_BITS, np.uint8)

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"cell": pa.array([at], pa.int64()), "seen": pa.array([packed(np.flatnonzero(count > 1))], pa.binary())})

    for batch in batches:
        for cell, once, twice in zip(*(batch.column(c).to_pylist() for c in ("cell", "once", "twice"))):
            if cell != at:
                if at is not None:
                    yield done()
                at, count = cell, np.zeros(1 << CELL_BITS, np.uint8)
            one = unpacked(once)
            count[one] = np.minimum(count[one] + 1, 2)
            count[unpacked(twice)] = 2
    if at is not None:
        yield done()


def seen_twice(lists: DataFrame, cells: int, params: LineParams) -> np.ndarray:
    """The filter of what was seen twice, as bytes; at most ``max_bits`` / 8 of them."""
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(hashes_of(batch.column("keys").to_pylist()))
            if sum(map(len, held)) >= params.chunk_keys:
                yield mark_cells(np.concatenate(held), cells)
                held = []
        if sum(map(len, held)):
            yield mark_cells(np.concatenate(held), cells)

    marked = lists.select("keys").mapInArrow(mark, "cell long, once binary, twice binary")
    merged = marked.repartition("cell").sortWithinPartitions("cell").mapInArrow(merge_cells, "cell long, seen binary")
    seen = np.zeros((cells, (1 << CELL_BITS) // 8), np.uint8)
    for cell, raw in merged.toLocalIterator():
        one = np.zeros(1 << CELL_BITS, np.uint8)
        one[unpacked(bytes(raw))] = 1
        seen[cell] = np.packbits(one)
    return seen.ravel()


def suspected(lists: DataFrame, params: LineParams) -> DataFrame:
    """key, doc_id, tkey: a row for each document and key whose bits were all seen twice (a written table)."""
    spark = lists.sparkSession
    n_keys = lists.agg(F.sum("n_keys")).first()[0] or 0
    wanted = min(params.max_bits, n_keys * params.bits_per_key)
    cells = 1 << max(0, (wanted - 1).bit_length() - CELL_BITS)
    seen = spark.sparkContext.broadcast(seen_twice(lists, cells, params))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bit = seen.value
        for batch in batches:
            raw = batch.column("keys").to_pylist()
            hit = np.ones(sum(map(len, raw)) // KEY, bool)
            for at in bits_of(hashes_of(raw), cells):
                hit &= (bit[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8) & 1) > 0
            places = np.flatnonzero(hit)
            owner = np.repeat(np.arange(len(raw)), [len(r) // KEY for r in raw])[places]
            whole = b"".join(raw)
            yield pa.RecordBatch.from_arrays(
                [pa.array([whole[KEY * p: KEY * p + KEY] for p in places.tolist()], pa.binary()),
                 batch.column("doc_id").take(pa.array(owner)), batch.column("tkey").take(pa.array(owner))],
                ["key", "doc_id", "tkey"])

    got = lists.select("doc_id", "tkey", "keys").mapInArrow(
        run, f"key binary, doc_id {lists.schema['doc_id'].dataType.simpleString()}, tkey binary")
    out = written(got, "line-suspects")
    seen.destroy()
    return out


def confirmed_keys(suspects: DataFrame, params: LineParams) -> DataFrame:
    """key, n_docs, keeper: the keys that really stand in enough documents, and the largest id holding each."""
    return suspects.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper")).where(
        F.col("n_docs") >= params.min_docs)


class Drops:
    """Sorted confirmed keys with the document that keeps each."""

    def __init__(self, keys: list[bytes], keepers: list) -> None:
        pairs = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
        order = np.argsort(pairs[:, 0], kind="stable")
        self.first, self.rest = pairs[order, 0], pairs[order, 1]
        self.keepers = [keepers[i] for i in order.tolist()]

    def places(self, digests: list[bytes]) -> np.ndarray:
        """The place of each key, or -1."""
        pairs = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
        out, at = np.full(len(pairs), -1), np.searchsorted(self.first, pairs[:, 0])
        live = np.arange(len(pairs))
        while len(live):  # keys with equal first halves are next to each other
            live = live[at[live] < len(self.first)]
            live = live[self.first[at[live]] == pairs[live, 0]]
            same = self.rest[at[live]] == pairs[live, 1]
            out[live[same]] = at[live[same]]
            live = live[~same]
            at[live] += 1
        return out


def _verdict(text: bytes, n_lines: int, gone: list[int]) -> tuple[int, int, str]:
    if gone:
        drop, lines = set(gone), text.split(b"\n")
        text = b"\n".join(x for i, x in enumerate(lines) if i not in drop)
    return n_lines, len(gone), hashlib.sha256(text).hexdigest()


RESULT = "n_lines long, n_dropped long, kept_sha256 string"


def _results(ids: pa.Array, rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([ids, pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())],
                                      ["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def _dropped_everywhere(docs: DataFrame, confirmed: DataFrame, params: LineParams) -> DataFrame:
    """The result from the confirmed keys in every task (few, as counted)."""
    rows = confirmed.select("key", "keeper").collect()
    drops = docs.sparkSession.sparkContext.broadcast(Drops([bytes(r[0]) for r in rows], [r[1] for r in rows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = drops.value
        for batch in batches:
            for part in slices(batch, "text"):
                counts, at, digests = line_keys(part.column("text"), params)
                hit = known.places(digests) if digests and len(known.first) else np.full(len(digests), -1)
                start = np.concatenate([[0], np.cumsum(counts)])
                cut, out = np.searchsorted(at, start).tolist(), []
                ids, texts = part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist()
                for i, (doc, text) in enumerate(zip(ids, texts)):
                    own = hit[cut[i]: cut[i + 1]]
                    gone = [int(at[cut[i] + j] - start[i]) for j in np.flatnonzero(own >= 0).tolist() if known.keepers[own[j]] != doc]
                    out.append(_verdict(text or b"", int(counts[i]), gone))
                yield _results(part.column("doc_id"), out)

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {RESULT}")


def _dropped_by_join(docs: DataFrame, suspects: DataFrame, confirmed: DataFrame, params: LineParams) -> DataFrame:
    """The result by joins: each document gets the list of its keys to drop (no longer than its text)."""
    # Fewer than ``hot_share`` keys can each hold more than that part of the suspects.
    floor = suspects.count() // params.hot_share
    hot, rest = confirmed.where(F.col("n_docs") > floor), confirmed.where(F.col("n_docs") <= floor)
    gone = ~F.col("doc_id").eqNullSafe(F.col("keeper"))
    pairs = suspects.join(F.broadcast(hot), "key").unionByName(suspects.join(rest, "key")).where(gone)
    # Repeated rows have one list. A null id is a value of its own here.
    named = [F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id"), F.lit(0)).alias("id"), "tkey"]
    lists = pairs.select("key", *named).groupBy("no_id", "id", "tkey").agg(F.collect_set("key").alias("drop"))
    tkey = F.unhex(F.substring(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256), 1, 2 * KEY)).alias("tkey")
    both = docs.select("doc_id", "text", tkey).select("doc_id", "text", *named).join(lists, ["no_id", "id", "tkey"], "left").select("doc_id", "text", "drop")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                counts, at, digests = line_keys(part.column("text"), params)
                start = np.concatenate([[0], np.cumsum(counts)])
                cut, out = np.searchsorted(at, start).tolist(), []
                for i, (text, drop) in enumerate(zip(part.column("text").cast(pa.binary()).to_pylist(), part.column("drop").to_pylist())):
                    bad = set(drop or ())
                    out.append(_verdict(text or b"", int(counts[i]), [
                        int(at[j] - start[i]) for j in range(cut[i], cut[i + 1]) if digests[j] in bad]))
                yield _results(part.column("doc_id"), out)

    return both.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {RESULT}")


def drop_lines(docs: DataFrame, params: LineParams = LineParams()) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256: one row a document."""
    docs = docs.select("doc_id", "text")
    suspects = suspected(written(key_lists(docs, params), "line-keys"), params)
    confirmed = written(confirmed_keys(suspects, params), "line-confirmed")
    if confirmed.count() <= params.max_broadcast:
        return _dropped_everywhere(docs, confirmed, params)
    return _dropped_by_join(docs, suspects, confirmed, params)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_lines(read_table(spark, sf_dir, "documents"))


OP13_SQL = """
with docs as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
lines as (
  select r, doc_id, i, lines[i] as line,
    translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from docs, unnest(range(1, len(lines) + 1)) u(i)),
held as (
  select key, max(doc_id) as keeper from lines where length(key) >= 20
  group by key having count(distinct r) >= 3),
marked as (
  select r, i, line, h.key is not null and l.doc_id is distinct from h.keeper as gone from lines l left join held h on l.key = h.key),
kept as (
  select r, count(*) as n, count(*) filter (gone) as dropped, string_agg(line, chr(10) order by i) filter (not gone) as k
  from marked group by r)
select doc_id, n::BIGINT as n_lines, dropped::BIGINT as n_dropped, sha256(coalesce(k, '')) as kept_sha256
from docs join kept using (r)
"""
