"""Removal of long repeated byte strings with run-length indexes.

A byte goes if a string of ``length`` bytes that covers it also starts at another
place, in any document. The corpus is cut so that equal strings meet:

1. Every window of ``length`` bytes has an anchor, the place of its least gram hash;
   equal windows have equal anchors. Windows in a row with one anchor form a segment.
2. Segments whose anchor occurs once cannot repeat. The others are cut out of their
   texts, and equal segments become one with a number of occurrences: a segment that
   occurs twice repeats as a whole.
3. Different segments of one anchor are trimmed to what each can share with another on
   both sides of the anchor. Parts that differ still are indexed together, in batches of
   bounded size: suffix order, run-compressed Burrows-Wheeler transform, and at both ends of each run
   a sampled suffix with its common prefix with the neighbour. Within a run these
   lengths fall by one a byte, so the matching statistics of all places stream from
   the samples. Places with a match of ``length`` or more begin a repeat.
4. An anchor with more segments than a task should hold, or whose trimmed parts exceed a
   batch, has its windows counted one by one, by hash, in a shuffle: the same result
   without a large group.

Texts are known by 128 bits of their SHA-256 and handled once; a text that occurs
twice goes as a whole. Defined results: a null text is empty and keeps nothing;
texts shorter than ``length`` lose nothing; repeated rows count as copies; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carelake.llm.common import read_table, written
from carelake.session import checkpoint_dir


@dataclass(frozen=True)
class RepeatParams:
    length: int = 400
    gram: int = 32              # bytes of the grams that anchor windows; a multiple of 8
    batch_bytes: int = 1 << 18  # of segments that one index holds (it takes some 200 bytes for each)
    group_bytes: int = 1 << 24  # of one anchor's segments to be trimmed in a task; beyond, windows are counted
    piece: int = 1 << 18        # bytes of text read at a time


def key16(text: Column) -> Column:
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def gram_hashes(buffer: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hash of the gram at each place."""
    n = len(buffer) - gram + 1
    padded = np.concatenate([buffer, np.zeros(16, np.uint8)])
    eight = np.empty(len(buffer) + 8, np.uint64)
    for o in range(8):
        got = padded[o: o + (len(padded) - o) // 8 * 8].view("<u8")
        eight[o::8][: len(got)] = got[: len(eight[o::8])]
    h = np.zeros(n, np.uint64)
    for k in range(0, gram, 8):
        h += eight[k: k + n]
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by running minima of blocks from both sides."""
    n = len(x)
    blocks = -(-n // width)
    grid = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    grid[:n] = x
    grid = grid.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1: n])


def anchors(texts: list[bytes], params: RepeatParams) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, anchor hash, first window, last window, anchor's place) of the segments of all texts, in parts."""
    parts, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, len(t) - params.length + 1, params.piece):
            piece = t[at: at + params.piece + params.length - 1]
            parts.append((i, at, piece))
            size += len(piece)
            if size >= params.piece:
                yield _anchors(parts, params)
                parts, size = [], 0
    if parts:
        yield _anchors(parts, params)


def _anchors(parts: list[tuple[int, int, bytes]], params: RepeatParams) -> tuple[np.ndarray, ...]:
    buffer = np.frombuffer(b"".join(p for *_, p in parts), np.uint8)
    lens = np.array([len(p) for *_, p in parts])
    first = np.concatenate([[0], np.cumsum(lens)[:-1]])
    h = gram_hashes(buffer, params.gram)
    low = np.uint64((1 << 24) - 1)  # a part has less than 2 ** 24 bytes
    least = sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), params.length - params.gram + 1) & low
    part = np.repeat(np.arange(len(parts)), lens)[: len(least)]
    start = np.arange(len(least))
    valid = start + params.length <= (first + lens)[part]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (part[1:] != part[:-1])
    begin = np.flatnonzero(new & valid)
    ends = np.concatenate([np.flatnonzero(new)[1:], [len(least)]])
    stop = ends[np.searchsorted(ends, begin, "right")]
    own = part[begin]
    # The windows of the last segment of a part end where the part has no more whole window.
    stop = np.minimum(stop, (first + lens)[own] - params.length + 1)
    offset = np.array([at for _, at, _ in parts])[own] - first[own]
    number = np.array([i for i, *_ in parts])[own]
    place = least[begin].astype(np.int64)
    return number, h[place].view(np.int64), begin + offset, stop - 1 + offset, place + offset


def suffix_order(symbols: np.ndarray, longest: int) -> tuple[np.ndarray, list[np.ndarray], list[int]]:
    """Suffix array by prefix doubling, the ranks at each depth, and the depths.

    symbols: bytes + 1, and 0 after each segment. Zeros are told apart by place, so no
    two suffixes are equal beyond ``longest`` symbols.
    """
    n = len(symbols)
    padded = np.concatenate([symbols, np.zeros(7, np.uint64)])
    key, ends = np.zeros(n, np.uint64), np.zeros(n, bool)
    for k in range(7):
        key = (key << np.uint64(9)) | np.where(ends, np.uint64(0), padded[k: k + n])
        ends |= padded[k: k + n] == 0
    order = np.argsort(key)
    # Where a segment ends, equal keys are ordered by place: the zeros differ, and always in one way.
    at = np.flatnonzero(ends[order])
    some = order[at]
    order[at] = some[np.lexsort((some, key[some]))]
    sorted_key = key[order]
    new = np.ones(n, bool)
    new[1:] = (sorted_key[1:] != sorted_key[:-1]) | ends[order[1:]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    ranks, depths, depth = [rank], [7], 7
    while depth < longest + 1:
        head = np.zeros(n + 1, bool)
        head[rank] = True
        head[n] = True
        single = np.zeros(n, bool)
        single[:] = head[:-1] & head[1:]
        live = np.flatnonzero(~single[rank])
        if not len(live):
            break
        ahead = np.zeros(len(live), np.int64)
        inside = live + depth < n
        ahead[inside] = rank[live[inside] + depth] + 1
        pair = (rank[live].astype(np.uint64) << np.uint64(32)) | ahead.astype(np.uint64)
        by = np.argsort(pair)
        sorted_pair, place = pair[by], live[by]
        group = rank[place]
        first = np.ones(len(by), bool)
        first[1:] = sorted_pair[1:] != sorted_pair[:-1]
        in_group = np.ones(len(by), bool)
        in_group[1:] = group[1:] != group[:-1]
        step = np.arange(len(by))
        # A group keeps its places: its rank plus the offset within it.
        offset = step - np.maximum.accumulate(np.where(in_group, step, 0))
        slot = group + offset
        rank = rank.copy()
        rank[place] = np.maximum.accumulate(np.where(first, step, 0)) - step + slot
        order[slot] = place
        depth *= 2
        ranks.append(rank)
        depths.append(depth)
    return order, ranks, depths


def common_prefix(a: np.ndarray, b: np.ndarray, symbols: np.ndarray, ranks: list[np.ndarray], depths: list[int]) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b (pairwise), up to the first zero."""
    n, a, b, out = len(symbols), a.copy(), b.copy(), np.zeros(len(a), np.int64)
    for rank, depth in zip(reversed(ranks), reversed(depths)):
        inside = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[inside] = rank[a[inside]] == rank[b[inside]]
        step = np.where(same, depth, 0)
        a += step
        b += step
        out += step
    for _ in range(7):
        inside = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[inside] = (symbols[a[inside]] == symbols[b[inside]]) & (symbols[a[inside]] != 0)
        if not same.any():
            break
        a += same
        b += same
        out += same
    return out


def matching_statistics(symbols: np.ndarray, longest: int) -> np.ndarray:
    """For each place the longest string that begins there and at another place too."""
    n = len(symbols)
    order, ranks, depths = suffix_order(symbols, longest)
    bwt = symbols[order - 1]  # the symbol before the first place is the zero that ends the last segment
    change = np.ones(n, bool)
    # Zeros differ from each other: each is a run of its own.
    change[1:] = (bwt[1:] != bwt[:-1]) | (bwt[1:] == 0)
    heads = np.flatnonzero(change)
    tails = np.concatenate([heads[1:] - 1, [n - 1]])
    best = np.zeros(n, np.int64)
    for ends, step in ((heads, -1), (tails, 1)):
        other = ends + step
        place = order[ends]
        length = np.zeros(len(ends), np.int64)
        has = (other >= 0) & (other < n)
        length[has] = common_prefix(place[has], order[other[has]], symbols, ranks, depths)
        # From a sampled place on, the length falls by one a byte until the next sample.
        sample = np.full(n, -1, np.int64)
        sample[place] = place
        last = np.maximum.accumulate(sample)
        at = np.zeros(n, np.int64)
        at[place] = length
        got = np.where(last >= 0, at[last] - (np.arange(n) - last), 0)
        best = np.maximum(best, got)
    return best


def shared(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] is common, a[:high] is not
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def longest_shared(texts: list[bytes]) -> list[int]:
    """For each text the longest beginning that another one has too: a neighbour in sorted order has it."""
    order = sorted(range(len(texts)), key=texts.__getitem__)
    out = [0] * len(texts)
    for x, y in zip(order, order[1:]):
        n = shared(texts[x], texts[y])
        out[x], out[y] = max(out[x], n), max(out[y], n)
    return out


def trimmed(segments: list[bytes], anchors_at: list[int], length: int) -> list[tuple[int, int]]:
    """For each segment of one anchor the part (from, to) that any other one can share with it around the anchor.

    A window that repeats in another segment lies at the same distance from the anchor
    there, so it ends within the longest common bytes on either side.
    """
    right = longest_shared([s[a:] for s, a in zip(segments, anchors_at)])
    left = longest_shared([s[:a][::-1] for s, a in zip(segments, anchors_at)])
    parts = [(a - l, a + r) for a, l, r in zip(anchors_at, left, right)]
    return [(a, b) if b - a >= length else (0, 0) for a, b in parts]


def repeated_windows(segments: list[bytes], params: RepeatParams) -> list[np.ndarray]:
    """For each of the (different) segments its windows that occur at another place of any of them."""
    longest = max(map(len, segments))
    symbols = np.zeros(sum(map(len, segments)) + len(segments), np.uint64)
    at, starts = 0, []
    for s in segments:
        starts.append(at)
        symbols[at: at + len(s)] = np.frombuffer(s, np.uint8).astype(np.uint64) + np.uint64(1)
        at += len(s) + 1
    long_match = matching_statistics(symbols, longest) >= params.length
    return [np.flatnonzero(long_match[a: a + len(s) - params.length + 1]) for a, s in zip(starts, segments)]


def covered(windows: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Merged (from, to) byte ranges of sorted windows."""
    if not len(windows):
        return []
    cut = np.flatnonzero(np.diff(windows) > length) + 1
    begin = windows[np.concatenate([[0], cut])]
    end = windows[np.concatenate([cut - 1, [len(windows) - 1]])] + length
    return list(zip(begin.tolist(), end.tolist()))


def index_batches(batches: Iterator[pa.RecordBatch], params: RepeatParams) -> Iterator[pa.RecordBatch]:
    """(sid, a, b) from rows (anchor, sid, seg, pos, n) sorted by anchor: what repeats in each segment.

    A segment that occurs twice repeats as a whole. The others are trimmed to what they
    can share; trimmed parts that are equal repeat as a whole too, and the different
    parts that are left of an anchor go to the index. If they exceed ``batch_bytes`` they are
    handed on instead, as rows (sid, a, anchor, part), to have their windows counted.
    """
    out: list[tuple[bytes, int, int]] = []
    left: list[tuple[bytes, int, int, bytes]] = []
    held: list[tuple[bytes, list[tuple[bytes, int]]]] = []  # a part, and the segments (with its place) that have it
    size = 0

    def take(anchor: int, group: list[tuple[bytes, bytes, int, int]]) -> None:
        nonlocal size
        parts: dict[bytes, list[tuple[bytes, int]]] = {}
        for (sid, seg, _, n), (a, b) in zip(group, trimmed([g[1] for g in group], [g[2] for g in group], params.length)):
            if n > 1:
                out.append((sid, 0, len(seg)))
            if b > a:
                parts.setdefault(seg[a:b], []).append((sid, a))
        for part, owners in parts.items():
            if len(owners) > 1:
                out.extend((sid, a, a + len(part)) for sid, a in owners)
        if len(parts) > 1 and (own := sum(map(len, parts))) > params.batch_bytes:
            left.extend((sid, a, anchor, part) for part, owners in parts.items() for sid, a in owners)
        elif len(parts) > 1:
            held.extend(parts.items())
            size += own

    def flush() -> pa.RecordBatch:
        nonlocal size
        if held:
            for (_, owners), windows in zip(held, repeated_windows([p for p, _ in held], params)):
                spans = covered(windows, params.length)
                out.extend((sid, at + a, at + b) for sid, at in owners for a, b in spans)
        none = [None] * len(out)
        got = pa.RecordBatch.from_pydict({
            "sid": pa.array([o[0] for o in out + left], pa.binary()), "a": pa.array([o[1] for o in out + left], pa.int32()),
            "b": pa.array([*(o[2] for o in out), *[None] * len(left)], pa.int32()),
            "anchor": pa.array([*none, *(x[2] for x in left)], pa.int64()),
            "part": pa.array([*none, *(x[3] for x in left)], pa.binary())})
        out.clear(), held.clear(), left.clear()
        size = 0
        return got

    group, anchor = [], None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "sid", "seg", "pos", "n"))):
            if row[0] != anchor:
                if group:
                    take(anchor, group)
                if size >= params.batch_bytes or len(out) > 100_000 or left:
                    yield flush()
                group, anchor = [], row[0]
            group.append(row[1:])
    if group:
        take(anchor, group)
    yield flush()


def unique_texts(docs: DataFrame) -> DataFrame:
    """tkey, text, copies: each text once, as a table bucketed by tkey, so that the joins
    that bring lists of places to their texts move the lists and never the texts again."""
    spark = docs.sparkSession
    texts = docs.select(key16(F.col("text").cast("binary")).alias("tkey"), "text")
    once = texts.groupBy("tkey").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    name = f"carelake_texts_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (once.write.format("parquet").bucketBy(buckets, "tkey")
     .option("path", f"{checkpoint_dir(spark)}/llm/{name}").saveAsTable(name))
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")   # the files stay; the catalog keeps no entry of a run
    return table


def find_anchors(texts: DataFrame, params: RepeatParams) -> DataFrame:
    """tkey, anchor, s0, s1, at: the segments of every text long enough."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, raw = pdf["tkey"].to_numpy(), [t.encode() for t in pdf["text"]]
            for i, anchor, s0, s1, at in anchors(raw, params):
                yield pd.DataFrame({"tkey": keys[i], "anchor": anchor, "s0": s0, "s1": s1, "at": at})

    long = texts.where(F.octet_length("text") >= params.length).select("tkey", "text")
    return long.mapInPandas(run, "tkey binary, anchor long, s0 long, s1 long, at long")


def frames(rows: Iterator[dict[str, list | np.ndarray]], size: str | None = None, limit: int = 200_000) -> Iterator[pd.DataFrame]:
    """Frames of about ``limit`` rows (or bytes, summed over column ``size``) from the columns of one text after another."""
    held: list[dict] = []
    amount = 0
    for row in rows:
        held.append(row)
        amount += sum(map(len, row[size])) if size else len(next(iter(row.values())))
        if amount >= limit:
            yield _joined(held)
            held, amount = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[dict]) -> pd.DataFrame:
    return pd.DataFrame({k: np.concatenate([h[k] for h in held]) if isinstance(held[0][k], np.ndarray)
                         else [x for h in held for x in h[k]] for k in held[0]})


def name_segments(places: DataFrame, texts: DataFrame, params: RepeatParams) -> DataFrame:
    """tkey, s0, anchor, pos, bytes, sid (128 bits of the segment's SHA-256): no text leaves."""
    def of(pdf: pd.DataFrame) -> Iterator[dict]:
        for key, text, anchor, s0, s1, at in zip(*(pdf[c] for c in ("tkey", "text", "anchor", "s0", "s1", "at"))):
            raw, end = text.encode(), s1 + params.length
            yield {"tkey": [key] * len(s0), "s0": s0, "anchor": anchor, "pos": at - s0, "bytes": end - s0,
                   "sid": [hashlib.sha256(raw[a:b]).digest()[:16] for a, b in zip(s0.tolist(), end.tolist())]}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield from frames(of(pdf))

    return with_lists(places, ["anchor", "s0", "s1", "at"], texts).mapInPandas(
        run, "tkey binary, s0 long, anchor long, pos long, bytes long, sid binary")


def with_lists(places: DataFrame, columns: list[str], texts: DataFrame) -> DataFrame:
    """One row a text: tkey, text, and an array for each column of its places (no longer than the text)."""
    lists = places.groupBy("tkey").agg(F.collect_list(F.struct(*columns)).alias("cuts"))
    return lists.join(texts.select("tkey", "text"), "tkey").select(
        "tkey", "text", *[F.col(f"cuts.{c}").alias(c) for c in columns])


def cut_out(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """anchor, sid, seg, pos, n from (tkey, s0, anchor, sid, pos, bytes, n)."""
    def of(pdf: pd.DataFrame) -> Iterator[dict]:
        for text, anchor, s0, size, sid, pos, n in zip(*(pdf[c] for c in ("text", "anchor", "s0", "bytes", "sid", "pos", "n"))):
            raw = text.encode()
            yield {"anchor": anchor, "sid": list(sid), "pos": pos, "n": n,
                   "seg": [raw[a: a + b] for a, b in zip(s0.tolist(), size.tolist())]}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield from frames(of(pdf), "seg", 8_000_000)

    return with_lists(wanted, ["anchor", "s0", "bytes", "sid", "pos", "n"], texts).mapInPandas(
        run, "anchor long, sid binary, pos long, n long, seg binary").select("anchor", "sid", "seg", "pos", "n")


def count_windows(segments: DataFrame, params: RepeatParams) -> DataFrame:
    """(sid, a, b) of the windows that repeat, each window counted by itself, from (anchor, sid, seg, n, first):
    ``first`` is the place of ``seg`` in its segment."""
    at = F.explode(F.sequence(F.lit(0), (F.length("seg") - params.length).cast("int")))
    windows = segments.select("anchor", "sid", "seg", "n", "first", at.alias("at")).select(
        "anchor", "sid", "n", (F.col("first") + F.col("at")).alias("at"), key16(F.substring("seg", F.col("at") + 1, F.lit(params.length))).alias("w"))
    again = windows.groupBy("anchor", "w").agg(F.sum("n").alias("times")).where("times > 1").select("anchor", "w")
    return windows.join(again, ["anchor", "w"]).select("sid", F.col("at").alias("a"), (F.col("at") + params.length).alias("b"))


def repeated_ranges(texts: DataFrame, params: RepeatParams) -> DataFrame:
    """tkey, ranges: array of (a, b) byte ranges (they may overlap) that repeat, for each unique text."""
    where = written(find_anchors(texts, params), "repeat-anchors")
    # Written, so that both sides of the joins below are plain shuffles, whose large partitions are split.
    often = written(where.groupBy("anchor").agg(F.count("*").alias("k")).where("k > 1").select("anchor"), "repeat-often")
    segments = written(name_segments(where.join(often, "anchor"), texts, params), "repeat-segments")
    # One row a different segment, with one place where it stands. Equal segments have their anchor at the same place.
    kinds = written(segments.groupBy("anchor", "sid").agg(
        F.count("*").alias("n"), F.min(F.struct("tkey", "s0")).alias("first"), F.min("pos").alias("pos"),
        F.min("bytes").alias("bytes")), "repeat-kinds")
    groups = written(kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("bytes").alias("all_bytes")), "repeat-groups")
    alone = (kinds.where("n > 1").join(groups.where("kinds = 1").select("anchor"), "anchor")
             .select("sid", F.lit(0).alias("a"), F.col("bytes").cast("int").alias("b")))

    def cut(some: DataFrame) -> DataFrame:
        return cut_out(kinds.join(some.select("anchor"), "anchor").select(
            "first.tkey", "first.s0", "bytes", "anchor", "sid", "pos", "n"), texts)

    several = groups.where("kinds > 1")
    few = cut(several.where(F.col("all_bytes") <= params.group_bytes))
    indexed = written(few.repartition("anchor").sortWithinPartitions("anchor", "sid").mapInArrow(
        lambda it: index_batches(it, params), "sid binary, a int, b int, anchor long, part binary"), "repeat-index")
    found = alone.unionByName(indexed.where("part is null").select("sid", "a", "b"))
    many = several.where(F.col("all_bytes") > params.group_bytes)
    large = indexed.where("part is not null").select("anchor", "sid", F.col("part").alias("seg"), F.lit(1).alias("n"), F.col("a").alias("first"))
    if not many.isEmpty():
        large = large.unionByName(cut(many).drop("pos").withColumn("first", F.lit(0)))
    if not large.isEmpty():
        found = found.unionByName(count_windows(large, params))
    return (segments.select("sid", "tkey", "s0").join(found, "sid")
            .select("tkey", F.struct((F.col("s0") + F.col("a")).alias("a"), (F.col("s0") + F.col("b")).alias("b")).alias("r"))
            .groupBy("tkey").agg(F.collect_set("r").alias("ranges")))


def merged(ranges: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((r["a"], r["b"]) for r in ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, params: RepeatParams = RepeatParams()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256: one row a document."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = unique_texts(docs)
    ranges = repeated_ranges(texts, params)
    partly = ranges.join(texts.where("copies = 1").select("tkey", "text"), "tkey")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, found, text in zip(pdf["tkey"], pdf["ranges"], pdf["text"]):
                raw, spans, at, kept = text.encode(), merged(list(found)), 0, hashlib.sha256()
                for a, b in spans:
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                rows.append((key, sum(b - a for a, b in spans), len(spans), kept.hexdigest()))
            yield pd.DataFrame(rows, columns=["tkey", "gone", "spans", "kept"])

    cleaned = partly.mapInPandas(run, "tkey binary, gone long, spans long, kept string")
    size = F.octet_length("text").cast("long")
    whole = (texts.where("copies > 1").select("tkey", size.alias("gone")).where(F.col("gone") >= params.length)
             .select("tkey", "gone", F.lit(1).cast("long").alias("spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept")))
    verdicts = written(cleaned.unionByName(whole), "repeat-verdicts")
    narrow = docs.select("doc_id", key16(F.col("text").cast("binary")).alias("tkey"), size.alias("n_bytes"),
                         F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    return narrow.join(verdicts, "tkey", "left").select(
        "doc_id", "n_bytes", F.coalesce("gone", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept", "sha").alias("kept_sha256"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"))


OP10_SQL = """
with docs as (
  select row_number() over () as r, doc_id, encode(coalesce(text, '')) as raw, hex(encode(coalesce(text, ''))) as h from documents),
windows as (
  select r, i, md5(raw[i + 1:i + 400]) as w from docs, unnest(range(0, octet_length(raw) - 399)) u(i)),
hits as (
  select r, i, i - row_number() over (partition by r order by i) as g
  from windows semi join (select w from windows group by w having count(*) > 1) using (w)),
runs as (
  select r, min(i) as a, max(i) + 400 as b from hits group by r, g),
marks as (
  select *, case when a > max(b) over (partition by r order by a rows between unbounded preceding and 1 preceding)
    or row_number() over (partition by r order by a) = 1 then 1 else 0 end as new from runs),
spans as (
  select r, s, min(a) as a, max(b) as b from (select *, sum(new) over (partition by r order by a) as s from marks) group by r, s),
gaps as (
  select r, a, coalesce(lag(b) over (partition by r order by a), 0) as before, b, row_number() over (partition by r order by a desc) as last
  from spans),
kept as (
  select d.r, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a)
    || substr(any_value(h), 2 * max(b) + 1) as k, sum(b - a) as gone, count(*) as n
  from gaps g join docs d on g.r = d.r group by d.r)
select doc_id, (len(h) // 2)::BIGINT as n_bytes, coalesce(gone, 0)::BIGINT as n_removed, coalesce(n, 0)::BIGINT as n_spans,
  sha256(unhex(coalesce(k, h))) as kept_sha256
from docs left join kept using (r)
"""
