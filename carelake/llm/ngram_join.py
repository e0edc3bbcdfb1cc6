"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of word n-grams. Each distinct text gets MinHash values; texts that
agree on a band of them are candidates. The values of a candidate pair are compared
step by step, and the pair is dropped as soon as the posterior probability (uniform
prior) that its similarity reaches the threshold falls below the tolerance. What
remains is verified on the full n-gram sets. A pair is looked at in the first band
that its texts share, so it is counted once.

Equal texts are one text with a number of copies. A band's texts are never expanded
into pair rows: pairs are compared as arrays inside a task, in blocks of bounded
size, and each text hands on its number of links and one edge to the group it is
linked with. Classes are the connected components of these edges.

Words are runs of letters, digits and underscores in lower case. Defined results: a
text with fewer words than n is one n-gram; a null text is the empty text; texts
without words are linked to equal texts only; repeated rows count as copies; a class
is named by its smallest id; all n-grams of a text count, however long it is; columns of
other names are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelake.llm.common import (WordIds, components, read_table, shingle_hashes,
                                 text_key, words_of, written)


@dataclass(frozen=True)
class JoinParams:
    width: int = 5              # words of an n-gram
    threshold: float = 0.8
    bands: int = 24
    band_rows: int = 4          # a pair at 0.8 shares no band with probability 3e-6
    step: int = 16              # values compared between two looks at the posterior
    tolerance: float = 1e-6
    block: int = 1_500          # texts of a band's group that meet in one task at a time
    chunk: int = 500_000        # n-grams hashed, and pairs times 16 compared, at a time

    @property
    def values(self) -> int:
        return self.bands * self.band_rows


def seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(90_125)
    return (rng.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1)), rng.integers(0, 2**32, n, dtype=np.uint32)


def min_hashes(sets: list[np.ndarray], params: JoinParams) -> np.ndarray:
    """(sets x values) MinHash values; a set without n-grams gets the largest values."""
    out = np.full((len(sets), params.values), 0xFFFFFFFF, np.uint32)
    lens = np.fromiter(map(len, sets), np.int64, len(sets))
    full = np.flatnonzero(lens)
    mult, add = seeds(params.values)
    at = 0
    while at < len(full):
        upto = at + max(1, int(np.searchsorted(np.cumsum(lens[full[at:]]), params.chunk, "right")))
        part = full[at:upto]
        x = (np.concatenate([sets[i] for i in part]) >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum(lens[part])[:-1]])
        for k in range(params.values):
            h = x * mult[k]
            h += add[k]
            h ^= h >> np.uint32(16)
            h *= np.uint32(0x85EBCA6B)
            out[part, k] = np.minimum.reduceat(h, starts)
        at = upto
    return out


def least_matches(params: JoinParams) -> np.ndarray:
    """By number of values compared: the fewest matches with which a pair stays.

    With m matches in n under a uniform prior the similarity is Beta(m + 1, n - m + 1);
    its chance to reach t is the chance of at most m heads in n + 1 throws with bias t.
    """
    t, out = params.threshold, np.zeros(params.values + 1, np.int64)
    for n in range(params.step, params.values + 1, params.step):
        below, m = 0.0, -1
        while below < params.tolerance:
            m += 1
            below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out[n] = m
    return out


def surviving(sig: np.ndarray, a: np.ndarray, b: np.ndarray, band: np.ndarray, params: JoinParams, least: np.ndarray) -> np.ndarray:
    """Places of the pairs (a, b) of rows of ``sig`` that share no earlier band and pass the pruning."""
    kept = []
    size = max(1, params.chunk // 16)
    for at in range(0, len(a), size):
        live = np.arange(at, min(at + size, len(a)))
        matches = np.zeros(len(live), np.int64)
        for n in range(params.step, params.values + 1, params.step):
            same = sig[a[live], n - params.step: n] == sig[b[live], n - params.step: n]
            matches += same.sum(1)
            whole = same.reshape(len(live), -1, params.band_rows).all(2)
            number = (n - params.step) // params.band_rows + np.arange(whole.shape[1])
            earlier = (whole & (number < band[live][:, None])).any(1)
            stay = (matches >= least[n]) & ~earlier
            live, matches = live[stay], matches[stay]
            if not len(live):
                break
        kept.append(live)
    return np.concatenate(kept) if kept else np.zeros(0, np.int64)


def pairs_of(starts: np.ndarray, ends: np.ndarray, side: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, group) rows of all pairs of each group, in parts of about ``limit`` pairs.

    side: 0 and 1 for the two blocks of a group of two (pairs go across), -1 for a whole group.
    """
    a, b, g, held = [], [], [], 0
    for k, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
        if side[s] < 0:
            i, j = np.triu_indices(e - s, 1)
            i, j = i + s, j + s
        else:
            left, right = np.flatnonzero(side[s:e] == 0) + s, np.flatnonzero(side[s:e] == 1) + s
            i, j = np.repeat(left, len(right)), np.tile(right, len(left))
        a.append(i), b.append(j), g.append(np.full(len(i), k))
        held += len(i)
        if held >= limit:
            yield np.concatenate(a), np.concatenate(b), np.concatenate(g)
            a, b, g, held = [], [], [], 0
    if held:
        yield np.concatenate(a), np.concatenate(b), np.concatenate(g)


GROUP = ["band", "key", "bi", "bj"]


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups from rows that come sorted by group."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table])
        marks = changes(table)
        if not len(marks):
            rest = table
            continue
        yield table.slice(0, int(marks[-1]))
        rest = table.slice(int(marks[-1]))
    if rest is not None and rest.num_rows:
        yield rest


def changes(table: pa.Table) -> np.ndarray:
    """Rows at which a new group begins, but for the first."""
    differ = np.zeros(max(0, table.num_rows - 1), bool)
    for c in GROUP:
        v = table.column(c).to_numpy()
        differ |= v[1:] != v[:-1]
    return np.flatnonzero(differ) + 1


def _arrays(table: pa.Table, params: JoinParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    marks = changes(table)
    starts = np.concatenate([[0], marks]).astype(np.int64)
    ends = np.concatenate([marks, [table.num_rows]]).astype(np.int64)
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(table.num_rows, params.values)
    return starts, ends, table.column("side").to_numpy(), sig


def prune(batches: Iterator[pa.RecordBatch], params: JoinParams) -> Iterator[pa.RecordBatch]:
    """The rows of each group that have a surviving pair in it."""
    least = least_matches(params)
    for table in whole_groups(batches):
        starts, ends, side, sig = _arrays(table, params)
        band = table.column("band").to_numpy()
        need = np.zeros(table.num_rows, bool)
        for a, b, _ in pairs_of(starts, ends, side, params.chunk):
            live = surviving(sig, a, b, band[a], params, least)
            need[a[live]] = True
            need[b[live]] = True
        if need.any():
            yield from table.filter(pa.array(need)).combine_chunks().to_batches()


def verified(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs reach the threshold exactly."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    if len(a) <= 4 * len(sets):
        both = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b)], np.int64)
    else:
        # Many pairs: n-grams that two sets or more hold, as columns, a part at a time.
        grams, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), sizes)
        shared = count[column] > 1
        number = np.cumsum(count > 1) - 1
        row, column = row[shared], number[column[shared]]
        common = np.zeros((len(sets), len(sets)), np.float32)
        for at in range(0, int((count > 1).sum()), 2048):
            here = (column >= at) & (column < at + 2048)
            x = np.zeros((len(sets), 2048), np.float32)
            x[row[here], column[here] - at] = 1
            common += x @ x.T
        both = common[a, b].astype(np.int64)
    return both >= threshold * (sizes[a] + sizes[b] - both) - 1e-9


def verify(batches: Iterator[pa.RecordBatch], params: JoinParams) -> Iterator[pa.RecordBatch]:
    """(uid, other, texts, docs): links of each row's text in its group, and the smallest text of its linked set."""
    least = least_matches(params)
    for table in whole_groups(batches):
        starts, ends, side, sig = _arrays(table, params)
        band = table.column("band").to_numpy()
        uid, copies = table.column("uid").to_numpy(), table.column("copies").to_numpy()
        raw = table.column("grams")
        texts, docs = np.zeros(table.num_rows, np.int64), np.zeros(table.num_rows, np.int64)
        label = np.arange(table.num_rows)
        for k, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
            sets = [np.frombuffer(x.as_py(), np.uint64) for x in raw.slice(s, e - s)]
            links = []
            for a, b, _ in pairs_of(np.array([s]), np.array([e]), side, params.chunk):
                live = surviving(sig, a, b, band[a], params, least)
                a, b = a[live], b[live]
                good = verified(sets, a - s, b - s, params.threshold)
                links.append((a[good], b[good]))
            a, b = (np.concatenate(x) for x in zip(*links)) if links else (np.zeros(0, np.int64),) * 2
            np.add.at(texts, a, 1), np.add.at(texts, b, 1)
            np.add.at(docs, a, copies[b]), np.add.at(docs, b, copies[a])
            while len(a):  # smallest row of each linked set
                low = np.minimum(label[a], label[b])
                if (label[a] == low).all() and (label[b] == low).all():
                    break
                np.minimum.at(label, a, low), np.minimum.at(label, b, low)
                label = label[label]
        linked = texts > 0
        if linked.any():
            yield pa.RecordBatch.from_pydict({"uid": uid[linked], "other": uid[label[linked]], "texts": texts[linked], "docs": docs[linked]})


def grouped(rows: DataFrame, params: JoinParams) -> DataFrame:
    """Rows (band, key, n, uid, ...) sorted by group within partitions; a large group is cut
    into blocks, and each pair of blocks is a group of its own (bi <= bj; side tells the block)."""
    blocks = F.ceil(F.col("n") / params.block).cast("int")
    own = F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = (rows.withColumn("with", other)
            .withColumn("bi", F.least("own", "with")).withColumn("bj", F.greatest("own", "with"))
            .withColumn("side", F.when(F.col("own") == F.col("with"), -1)
                        .otherwise(F.when(F.col("own") < F.col("with"), 0).otherwise(1)).cast("int"))
            .drop("blocks", "own", "with"))
    return rows.repartition(*GROUP).sortWithinPartitions(*GROUP, "side", "uid")


def signatures(docs: DataFrame, params: JoinParams) -> DataFrame:
    """uid, tkey, rep (smallest id), copies, sig: one row a distinct text."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = WordIds()
        for pdf in batches:
            sets = [shingle_hashes(ids.of(words_of((t or "").lower())), params.width) for t in pdf.pop("text")]
            yield pdf.assign(sig=[row.tobytes() for row in min_hashes(sets, params)], some=[len(s) > 0 for s in sets])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_key(F.col("text")).alias("tkey"), "text").mapInPandas(
        run, f"doc_id {kind}, tkey binary, sig binary, some boolean")
    return (rows.groupBy("tkey").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"),
                                     F.first("sig").alias("sig"), F.first("some").alias("some"))
            .withColumn("uid", F.monotonically_increasing_id()))  # frozen by the write that follows


def shingle_sets(docs: DataFrame, wanted: DataFrame, params: JoinParams) -> DataFrame:
    """uid, grams: the sorted n-gram hashes of the wanted texts (uid, tkey, rep)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = WordIds()
        for pdf in batches:
            pdf["grams"] = [np.unique(shingle_hashes(ids.of(words_of((t or "").lower())), params.width)).tobytes()
                            for t in pdf.pop("text")]
            yield pdf

    texts = docs.select(F.col("doc_id"), text_key(F.col("text")).alias("tkey"), "text")
    wanted = wanted.select("uid", F.col("tkey").alias("w_tkey"), "rep")
    found = texts.join(wanted, (F.col("tkey") == F.col("w_tkey")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    return found.select("uid", "text").dropDuplicates(["uid"]).mapInPandas(run, "uid long, grams binary")


def links(docs: DataFrame, params: JoinParams = JoinParams()) -> tuple[DataFrame, DataFrame]:
    """(texts, found): distinct texts, and for each linked text and group its links and an edge."""
    texts = written(signatures(docs, params), "join-texts")
    width = 4 * params.band_rows
    bands = (texts.where("some")
             .select("uid", F.explode(F.array(*[
                 F.struct(F.lit(b).alias("band"), F.xxhash64(F.substring("sig", 1 + b * width, width)).alias("key"))
                 for b in range(params.bands)])).alias("g")).select("uid", "g.*"))
    full = bands.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    rows = bands.join(full, ["band", "key"]).join(texts.select("uid", "sig", "copies"), "uid")
    schema = "band int, key long, n long, uid long, sig binary, copies long, bi int, bj int, side int"
    order = [f.split()[0] for f in schema.split(", ")]
    members = written(grouped(rows, params).select(*order).mapInArrow(lambda it: prune(it, params), schema), "join-members")
    wanted = texts.join(members.select("uid").distinct(), "uid", "left_semi")
    sets = shingle_sets(docs, wanted, params)
    ready = members.join(sets, "uid").repartition(*GROUP).sortWithinPartitions(*GROUP, "side", "uid")
    found = ready.select(*order, "grams").mapInArrow(
        lambda it: verify(it, params), "uid long, other long, texts long, docs long")
    return texts, written(found, "join-links")


def classes(docs: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """tkey, copies, class_id, class_key, n_texts, n_docs: one row a distinct text."""
    texts, found = links(docs, params)
    counts = found.groupBy("uid").agg(F.sum("texts").alias("n_texts"), F.sum("docs").alias("n_docs"))
    roots = components(found.select(F.col("uid").alias("a"), F.col("other").alias("b")), "join-classes")
    rows = (texts.select("uid", "tkey", "rep", "copies").join(counts, "uid", "left")
            .join(roots.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid")))
    names = rows.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull(), F.col("rep"), F.col("tkey"))).alias("first"))
    return (rows.join(names, "root")
            .select("tkey", "copies", F.col("first.rep").alias("class_id"), F.col("first.tkey").alias("class_key"),
                    F.coalesce("n_texts", F.lit(0)).cast("long").alias("n_texts"),
                    (F.coalesce("n_docs", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_docs")))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, n_links (other documents linked to it), n_texts (different texts among them)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = classes(docs)
    return (docs.select("doc_id", text_key(F.col("text")).alias("tkey")).join(found, "tkey")
            .select("doc_id", "class_id", F.col("n_docs").alias("n_links"), "n_texts"))


def one_of_each(docs: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """The document of each class with the smallest id, with the columns of ``docs``."""
    names = docs.columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), F.col("doc_id"),
                       text_key(F.col("text")).alias("tkey"))
    kept = classes(docs.select("doc_id", "text"), params).select(
        F.col("class_key").alias("k_tkey"), F.col("class_id").alias("k_id")).distinct()
    found = rows.join(kept, (F.col("tkey") == F.col("k_tkey")) & F.col("doc_id").eqNullSafe(F.col("k_id")), "left_semi")
    return found.dropDuplicates(["tkey"]).select(*[F.col("doc").getField(c).alias(c) for c in names])
