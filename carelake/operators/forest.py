"""M06, M07 on large tables: a random forest from counts of what is not zero.

Spark ML keeps 4 bytes a feature and tree for each row and adds every chosen feature of a
node for every row, zero or not; on text features (hundreds of places, a few entries) most of its
time and memory goes there. This trainer follows the same rules (candidate thresholds from a
sample of the same size, Poisson bags, a random feature subset for each node, Gini gain of
weighted classes, least bagged rows in a child, leaves of one prediction put together) and
gives a ``RandomForestClassificationModel``; only the random draws are others.

Rows become blocks of (feature, bin) entries, some 5 bytes an entry. Trees grow level by
level, all of them in one job: a task finds each row's node, counts the entries of the chosen
features by node, bin and class, and hands on the cells that are not zero; cells of one part
of a tree's nodes meet in one task, which picks the splits. The count of a feature's zeros is the
node's total less its other counts. What reaches the driver is one split a node.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel, TaskContext
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.session import checkpoint_dir, written

SAMPLE_ROWS = 10_000          # rows that the candidate thresholds come from, as in Spark ML
BLOCK_ROWS = 8_192
CHUNK_CELLS = 1 << 20         # cells of the counts that one task adds up at a time
HITS_AT_ONCE = 1 << 24        # counted entries that a task keeps for the trees it works on
BLOCK_SCHEMA = "task int, block int, n int, y binary, lens binary, f binary, b binary"


# ------------------------------------------------------------------ rows
def _entries(train: DataFrame, features: str) -> DataFrame:
    """(idx, val, y): the places and values of each row's vector, stored sparse or dense, and its class."""
    v = F.unwrap_udt(features)
    place = F.when(v["type"] == 0, v["indices"]).otherwise(F.sequence(F.lit(0), F.size(v["values"]) - 1))
    return train.select(place.alias("idx"), v["values"].alias("val"), F.coalesce(v["size"], F.size(v["values"])).alias("size"),
                        F.col("label_idx").cast("int").alias("y"))


def thresholds_of(values: np.ndarray, weights: np.ndarray, zeros: float, max_bins: int) -> np.ndarray:
    """Candidate thresholds of a feature from its weighted values that are not zero and the weight of its zeros."""
    v, at = np.unique(values, return_inverse=True)
    w = np.bincount(at, weights=weights, minlength=len(v))
    if zeros > 0:
        k = int(np.searchsorted(v, 0.0))
        v, w = np.insert(v, k, 0.0), np.insert(w, k, zeros)
    if len(v) < 2:
        return np.empty(0)
    between = (v[:-1] + v[1:]) / 2
    if len(between) <= max_bins - 1:
        return between
    stride, out = w.sum() / max_bins, []
    current = w[0]
    target = stride
    for i in range(1, len(v)):
        before, current = current, current + w[i]
        if abs(before - target) < abs(current - target):
            out.append(between[i - 1])
            target += stride
    return np.array(out)


def find_thresholds(sample: list, weights: list[float], size: int, max_bins: int) -> list[np.ndarray]:
    f = np.concatenate([np.asarray(r["idx"], dtype=np.int64) for r in sample])
    x = np.concatenate([np.asarray(r["val"], dtype=np.float64) for r in sample])
    row_w = np.array([weights[r["y"]] for r in sample])
    w = np.repeat(row_w, [len(r["idx"]) for r in sample])
    keep = (x != 0) & ~np.isnan(x)
    f, x, w = f[keep], x[keep], w[keep]
    order = np.argsort(f, kind="stable")
    f, x, w = f[order], x[order], w[order]
    ends = np.searchsorted(f, np.arange(size + 1))
    out = []
    for k in range(size):
        part = slice(ends[k], ends[k + 1])
        zeros = row_w.sum() - w[part].sum() if ends[k + 1] - ends[k] < len(sample) else 0.0
        out.append(thresholds_of(x[part], w[part], zeros, min(max_bins, len(sample))))
    return out


def _pack(cuts: list[np.ndarray]):
    """Tables of (idx, val, y) to blocks: the entries whose bin is not the feature's bin of zero."""
    ends = np.cumsum([0, *[len(c) for c in cuts]])
    flat = np.concatenate(cuts) if ends[-1] else np.empty(0)
    zero = np.array([np.searchsorted(c, 0.0) for c in cuts], dtype=np.uint8)
    kind = np.uint16 if len(cuts) <= 1 << 16 else np.uint32

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, block = TaskContext.get().partitionId(), 0
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(start, BLOCK_ROWS)
                lens = pc.list_value_length(batch.column("idx")).to_numpy(zero_copy_only=False).astype(np.int64)
                f = batch.column("idx").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                x = batch.column("val").flatten().to_numpy(zero_copy_only=False)
                y = batch.column("y").to_numpy(zero_copy_only=False)
                if batch.column("y").null_count:
                    raise ValueError("a training row has no class")
                row = np.repeat(np.arange(len(lens)), lens)
                b = np.empty(len(f), dtype=np.uint8)
                order = np.argsort(f, kind="stable")
                edges = np.searchsorted(f[order], np.arange(len(cuts) + 1))
                for k in np.flatnonzero(np.diff(edges)):
                    at = order[edges[k]:edges[k + 1]]
                    b[at] = np.searchsorted(flat[ends[k]:ends[k + 1]], x[at])
                keep = b != zero[f]
                yield pa.RecordBatch.from_pydict({
                    "task": pa.array([task], pa.int32()), "block": pa.array([block], pa.int32()), "n": pa.array([len(lens)], pa.int32()),
                    "y": [y.astype(np.uint16).tobytes()],
                    "lens": [np.bincount(row[keep], minlength=len(lens)).astype(kind).tobytes()],
                    "f": [f[keep].astype(kind).tobytes()], "b": [b[keep].tobytes()]})
                block += 1
    return pack, zero, kind


# ---------------------------------------------------------------- levels
class Level:
    """The nodes of one tree that a level splits: ``subset`` has each one's features, ``total`` its bagged rows by class.

    ``path`` leads there: for each level above, feature and bin of each node's split and the node on either side
    (the number of nodes where a row has come to a leaf).
    """

    def __init__(self, path: list, subset: np.ndarray, total: np.ndarray):
        self.path, self.subset, self.total = path, subset, total


def _poisson_table() -> np.ndarray:
    """The bag count of each 16-bit number: Poisson with mean 1."""
    p = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    return np.searchsorted(p, (np.arange(1 << 16) + 0.5) / (1 << 16), side="right").astype(np.uint8)


class Grower:
    """What the tasks of a level need besides the trees."""

    def __init__(self, size: int, zero: np.ndarray, bins: np.ndarray, kind, weights: list[float], n_trees: int, min_leaf: int, seed: int, bagged: bool):
        self.n_trees = n_trees
        self.size, self.zero, self.bins, self.kind = size, zero, bins, kind
        self.weights, self.min_leaf, self.seed, self.bagged = np.array(weights), min_leaf, seed, bagged
        self.n_bins = int(bins.max(initial=1))
        self.n_classes = len(weights)

    def bags(self, r: dict) -> np.ndarray:
        """How often each of a block's rows is in each tree's bag; the same in every pass."""
        if not self.bagged:
            return np.ones((self.n_trees, r["n"]), dtype=np.uint8)
        rng = np.random.Generator(np.random.SFC64(np.random.SeedSequence([self.seed, r["task"], r["block"]])))
        return _POISSON.take(rng.integers(0, 1 << 16, (self.n_trees, r["n"]), dtype=np.uint16))

    def roots(self, blocks: Iterator) -> Iterator:
        total = np.zeros((self.n_trees, self.n_classes), dtype=np.int64)
        for r in blocks:
            y = np.frombuffer(r["y"], dtype=np.uint16)
            for t, bag in enumerate(self.bags(r)):
                total[t] += np.bincount(y, weights=bag, minlength=self.n_classes).astype(np.int64)
        yield total

    def chunk_nodes(self, level: Level) -> int:
        return max(1, CHUNK_CELLS // (level.subset.shape[1] * self.n_bins * self.n_classes))

    def _hits(self, block: tuple, bag: np.ndarray, level: Level, slots: np.ndarray, chosen: np.ndarray) -> tuple:
        """Cell and bag count of the block's entries that the tree's nodes look at."""
        x, y, lens, f, b, row = block
        rows = np.flatnonzero(bag)
        at, node = rows * self.size, np.zeros(len(rows), dtype=np.int64)
        for feature, cut, child in level.path:
            node = child.take(2 * node + (x.take(at + feature.take(node)) > cut.take(node)))
            on = node < child[-1]
            if np.count_nonzero(on) < 0.8 * len(node):       # the others have come to a leaf
                rows, at, node = rows[on], at[on], node[on]
        of_row = np.full(len(bag), len(level.subset) * self.size, dtype=np.int64)
        of_row[rows] = node * self.size
        key = np.repeat(of_row, lens)
        key += f
        hit = np.flatnonzero(chosen.take(key))
        row = row[hit]
        return (slots[key[hit]] * self.n_bins + b[hit]) * self.n_classes + y[row], bag[row]

    def count(self, blocks: Iterator, levels: dict[int, Level]) -> Iterator:
        """((tree, chunk), (cells, counts)) of a task's blocks: the counts that are not zero, by cells in order."""
        blocks = list(blocks)
        entries = sum(len(r["b"]) for r in blocks)
        todo = sorted(levels)
        while todo:
            m = max(level.subset.shape[1] for level in levels.values())
            group = todo[:max(1, int(HITS_AT_ONCE * self.size / max(entries * m, 1)))]
            todo = todo[len(group):]
            slots = {}
            for t in group:
                subset = levels[t].subset
                s = np.full((len(subset) + 1) * self.size, -1, dtype=np.int64)      # the last node: rows that have come to a leaf
                s[np.arange(len(subset))[:, None] * self.size + subset] = np.arange(subset.size).reshape(subset.shape)
                slots[t] = s, s >= 0
            found = {t: ([], []) for t in group}
            for r in blocks:
                lens = np.frombuffer(r["lens"], dtype=self.kind)
                f, b = np.frombuffer(r["f"], dtype=self.kind).astype(np.int64), np.frombuffer(r["b"], dtype=np.uint8)
                x = np.tile(self.zero, r["n"])
                row = np.repeat(np.arange(r["n"]), lens)
                x[row * self.size + f] = b
                block, bags = (x, np.frombuffer(r["y"], dtype=np.uint16), lens, f, b, row), self.bags(r)
                for t in group:
                    cells, n = self._hits(block, bags[t], levels[t], *slots[t])
                    found[t][0].append(cells)
                    found[t][1].append(n)
            for t in group:
                level = levels[t]
                cells, n = (np.concatenate(a) if a else np.empty(0, dtype=np.int64) for a in found.pop(t))
                all_cells = level.subset.size * self.n_bins * self.n_classes
                if len(cells) * 8 > all_cells:
                    counts = np.bincount(cells, weights=n, minlength=all_cells)
                    cells = np.flatnonzero(counts)
                    counts = counts[cells].astype(np.int32)
                else:
                    cells, at = np.unique(cells, return_inverse=True)
                    counts = np.bincount(at, weights=n, minlength=len(cells)).astype(np.int32)
                width = self.chunk_nodes(level) * level.subset.shape[1] * self.n_bins * self.n_classes
                for k in range(-(-all_cells // width)):
                    low, high = np.searchsorted(cells, [k * width, (k + 1) * width])
                    if low < high:
                        yield (t, k), ((cells[low:high] - k * width).astype(np.int32), counts[low:high])

    def splits(self, parts: Iterator, levels: dict[int, Level]) -> Iterator:
        """(tree, node, feature, bin, gain, bagged rows on the left by class) of a partition's nodes that can be split."""
        key, counts = None, None
        for k, (cells, n) in parts:
            if k != key:
                if key is not None:
                    yield from self._best(*key, counts, levels[key[0]])
                key, level = k, levels[k[0]]
                nodes = min(self.chunk_nodes(level), len(level.subset) - k[1] * self.chunk_nodes(level))
                counts = np.zeros(nodes * level.subset.shape[1] * self.n_bins * self.n_classes, dtype=np.int64)
            counts[cells] += n
        if key is not None:
            yield from self._best(*key, counts, levels[key[0]])

    def _best(self, tree: int, chunk: int, counts: np.ndarray, level: Level) -> Iterator:
        first, m = chunk * self.chunk_nodes(level), level.subset.shape[1]
        counts = counts.reshape(-1, m, self.n_bins, self.n_classes)
        nodes = np.arange(first, first + len(counts))
        subset, total = level.subset[nodes], level.total[nodes]
        # What is in no counted bin is in the feature's bin of zero.
        i, j = np.indices(subset.shape)
        counts[i, j, self.zero[subset]] += total[:, None, :] - counts.sum(axis=2)
        left = counts.cumsum(axis=2)[:, :, :-1]
        ok = np.arange(self.n_bins - 1) < (self.bins[subset] - 1)[:, :, None]
        rows_left, rows = left.sum(axis=3), total.sum(axis=1)[:, None, None]
        ok &= (rows_left >= self.min_leaf) & (rows - rows_left >= self.min_leaf)
        wl = left * self.weights
        wt = total * self.weights
        wr = wt[:, None, None, :] - wl
        w = wt.sum(axis=1)
        impurity = 1 - (wt ** 2).sum(axis=1) / w ** 2
        with np.errstate(divide="ignore", invalid="ignore"):
            nl, nr = wl.sum(axis=3), wr.sum(axis=3)
            rest = (nl - (wl ** 2).sum(axis=3) / nl) + (nr - (wr ** 2).sum(axis=3) / nr)
            gain = np.where(ok, impurity[:, None, None] - rest / w[:, None, None], -np.inf).reshape(len(counts), -1)
        if not gain.shape[1]:
            return
        best = gain.argmax(axis=1)
        for k in np.flatnonzero(gain[np.arange(len(counts)), best] > 0):
            at, cut = divmod(int(best[k]), self.n_bins - 1)
            yield tree, int(nodes[k]), int(subset[k, at]), cut, float(gain[k, best[k]]), left[k, at, cut]


_POISSON = _poisson_table()


def _gini(counts: np.ndarray, weights: np.ndarray) -> float:
    w = counts * weights
    return float(1 - (w ** 2).sum() / w.sum() ** 2) if w.sum() else 0.0


# ---------------------------------------------------------------- growth
def _grow(blocks: RDD, grower: Grower, max_depth: int, subset_size: int, tasks: int) -> list[list[dict]]:
    """The nodes of each tree; a node that is split has a feature, a bin, a gain and two children."""
    sc, n_trees = blocks.context, grower.n_trees
    total = blocks.mapPartitions(grower.roots).treeReduce(lambda a, b: a + b)
    trees = [[{"n": total[t]}] for t in range(n_trees)]
    active = {t: [0] for t in range(n_trees) if _gini(total[t], grower.weights) > 2.3e-16}
    paths: dict[int, list] = {t: [] for t in range(n_trees)}
    for depth in range(max_depth):
        if not active:
            break
        levels = {}
        for t, nodes in active.items():
            rng = np.random.default_rng([grower.seed, 1, t, depth])
            subset = np.argsort(rng.random((len(nodes), grower.size)), axis=1)[:, :subset_size]
            levels[t] = Level(paths[t], subset, np.array([trees[t][k]["n"] for k in nodes]))
        shipped = sc.broadcast(levels)
        cells = sum(level.subset.size * grower.n_bins * grower.n_classes for level in levels.values())
        parts = max(1, min(tasks, -(-cells // CHUNK_CELLS)))
        found = (blocks.mapPartitions(lambda b: grower.count(b, shipped.value))
                 .repartitionAndSortWithinPartitions(parts, lambda key: key[0] * 31 + key[1])
                 .mapPartitions(lambda p: grower.splits(p, shipped.value)).collect())      # at most one a node
        shipped.unpersist()
        following: dict[int, list] = {}
        for t, nodes in active.items():
            feature, cut = np.zeros(len(nodes) + 1, dtype=np.int64), np.full(len(nodes) + 1, 255, dtype=np.uint8)
            child = np.full((len(nodes) + 1, 2), -1, dtype=np.int64)
            paths[t] = [*paths[t], (feature, cut, child)]
            following[t] = []
        for t, k, f, b, gain, left in sorted(found, key=lambda s: s[:2]):
            feature, cut, child = paths[t][-1]
            feature[k], cut[k] = f, b
            node = trees[t][active[t][k]]
            node |= {"feature": f, "bin": b, "gain": gain, "children": (len(trees[t]), len(trees[t]) + 1)}
            for side, n in enumerate((left, node["n"] - left)):
                if depth + 1 < max_depth and _gini(n, grower.weights) > 2.3e-16:
                    child[k, side] = len(following[t])
                    following[t].append(len(trees[t]))
                trees[t].append({"n": n})
        for t in list(following):
            feature, cut, child = paths[t][-1]
            child[child < 0] = len(following[t])
            paths[t][-1] = (feature, cut, child.reshape(-1))
        active = {t: nodes for t, nodes in following.items() if nodes}
    return trees


def _ordered(nodes: list[dict], weights: np.ndarray) -> list[dict]:
    """A tree's nodes, each before its children; two leaves of one prediction are their parent's."""
    for node in reversed(nodes):              # children come after their parent
        node["prediction"] = int(np.argmax(node["n"] * weights))
        if "children" in node:
            a, b = (nodes[k] for k in node["children"])
            if "children" not in a and "children" not in b and a["prediction"] == b["prediction"]:
                del node["children"]
                node["prediction"] = a["prediction"]
    out: list[dict] = []

    def walk(k: int) -> int:
        me = len(out)
        out.append(dict(nodes[k], id=me))
        if "children" in nodes[k]:
            out[me]["children"] = tuple([walk(c) for c in nodes[k]["children"]])
        return me
    walk(0)
    return out


def _model(classifier: RandomForestClassifier, trees: list[list[dict]], grower: Grower, cuts: list[np.ndarray], spark) -> RandomForestClassificationModel:
    """The trees as a Spark ML model, by way of its stored form."""
    rows: dict[str, list] = {"treeID": [], "nodeData": []}
    for t, nodes in enumerate(trees):
        for node in _ordered(nodes, grower.weights):
            inner = "children" in node
            left, right = node["children"] if inner else (-1, -1)
            stats = node["n"] * grower.weights
            rows["treeID"].append(t)
            rows["nodeData"].append({
                "id": node["id"], "prediction": float(node["prediction"]), "impurity": _gini(node["n"], grower.weights),
                "impurityStats": stats.tolist(), "rawCount": int(node["n"].sum()), "gain": node["gain"] if inner else -1.0,
                "leftChild": left, "rightChild": right,
                "split": {"featureIndex": node["feature"] if inner else -1,
                          "leftCategoriesOrThreshold": [float(cuts[node["feature"]][node["bin"]])] if inner else [], "numCategories": -1}})
    split = pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())), ("numCategories", pa.int32())])
    data = pa.struct([("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()), ("impurityStats", pa.list_(pa.float64())),
                      ("rawCount", pa.int64()), ("gain", pa.float64()), ("leftChild", pa.int32()), ("rightChild", pa.int32()), ("split", split)])
    table = pa.table({"treeID": pa.array(rows["treeID"], pa.int32()), "nodeData": pa.array(rows["nodeData"], data)})
    path = f"{checkpoint_dir(spark)}/tables/forest-{uuid.uuid4().hex}"
    spark.createDataFrame(table).coalesce(1).write.parquet(f"{path}/data")
    params = {p.name: v for p, v in classifier.extractParamMap().items() if v != ""}
    base = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version, "defaultParamMap": {}}
    tree_params = {k: v for k, v in params.items() if k not in ("numTrees", "featureSubsetStrategy", "subsamplingRate", "bootstrap")}
    meta = [(t, json.dumps(base | {"class": "org.apache.spark.ml.classification.DecisionTreeClassificationModel", "uid": f"dtc_{uuid.uuid4().hex[:12]}",
                                   "paramMap": tree_params}), 1.0) for t in range(len(trees))]
    spark.createDataFrame(meta, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    whole = base | {"class": "org.apache.spark.ml.classification.RandomForestClassificationModel", "uid": classifier.uid, "paramMap": params,
                    "numFeatures": grower.size, "numClasses": grower.n_classes, "numTrees": len(trees)}
    spark.createDataFrame([(json.dumps(whole),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return RandomForestClassificationModel.load(path)


def fit(train: DataFrame, classifier: RandomForestClassifier, rows: int, weights: list[float], tasks: int) -> RandomForestClassificationModel:
    """The forest that ``classifier`` describes, on ``train`` (features, label_idx), whose ``rows`` rows weigh by class.

    ``tasks`` work on the rows. Of the classifier's settings those of ``models.fit_forest`` are followed.
    """
    spark, max_bins = train.sparkSession, classifier.getMaxBins()
    table = _entries(train, classifier.getFeaturesCol())
    want = max(max_bins ** 2, SAMPLE_ROWS)
    sample = table.sample(False, min(1.0, want / rows), classifier.getSeed()).collect()
    size = max(r["size"] for r in sample)
    cuts = find_thresholds(sample, weights, size, max_bins)
    pack, zero, kind = _pack(cuts)
    grower = Grower(size, zero, np.array([len(c) + 1 for c in cuts]), kind, weights, classifier.getNumTrees(), classifier.getMinInstancesPerNode(),
                    classifier.getSeed() % (1 << 32), classifier.getBootstrap())
    # Written: a pass sees each row in the same place, so that it is in the same bags.
    blocks = written(table.select("idx", "val", "y").repartition(tasks).mapInArrow(pack, BLOCK_SCHEMA), "forest-blocks")
    dealt = (blocks.rdd.map(lambda r: (r["task"], r.asDict())).partitionBy(tasks, lambda task: task).values()
             .persist(StorageLevel.MEMORY_AND_DISK))
    strategy = classifier.getFeatureSubsetStrategy()
    subset = {"sqrt": math.ceil(math.sqrt(size)), "all": size}[strategy]
    try:
        trees = _grow(dealt, grower, classifier.getMaxDepth(), subset, tasks)
    finally:
        dealt.unpersist()
    return _model(classifier, trees, grower, cuts, spark)
