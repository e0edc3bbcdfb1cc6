"""Deterministic sampling: M01 symptom dropout, M02 label noise, W03 split, W04 folds.

Randomness is a hash of (seed, row id, position): the first 8 hex digits of
md5, read as an unsigned 32-bit number. It is stateless, so a lost executor
recomputes the same values, and DuckDB computes the same numbers.

Exact "k smallest" selections (label noise, exact split, folds) avoid a global
sort or a window over a whole class: the cut (hash, tie) of each class is found
from counts by hash bucket, and rows are compared with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carelake.functions import constants as K
from carelake.functions import text as T
from carelake.session import written

TWO32 = float(2 ** 32)


def hash32(*parts) -> Column:
    """First 8 hex digits of md5(p1:p2:...) as a long in [0, 2^32)."""
    cols = [F.lit(str(p)) if not isinstance(p, Column) else p.cast("string") for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *cols)), 1, 8), 16, 10).cast("long")


def hash01(*parts) -> Column:
    return hash32(*parts) / TWO32


# ---------------------------------------------------------------- M01
def symptom_dropout(text: Column, row_id: Column, keep: float = K.SYMPTOM_KEEP_PROB,
                    seed: int = K.SEED) -> Column:
    """Keep each stripped non-blank item when its hash is below ``keep``; at least one kept.

    The scored list is bound once (``let``) and then filtered and searched.
    """
    items = T.split_items(text)
    scored = F.transform(items, lambda s, i: F.struct(hash01(seed, row_id, i).alias("h"), s.alias("s")))

    def pick(sc):
        kept = F.filter(sc, lambda e: e["h"] < keep)
        return F.when(F.size(sc) == 0, F.lit("")).otherwise(F.array_join(
            F.when(F.exists(sc, lambda e: e["h"] < keep), F.transform(kept, lambda e: e["s"]))
            .otherwise(F.array(F.array_min(sc)["s"])), ", "))
    return T.let(scored, pick)


# ------------------------------------------------------- k smallest rows
def _edge(counts: DataFrame, need: DataFrame, keys: list[str], cell: str) -> DataFrame:
    """Per key the first ``cell`` at which the running count reaches ``need``, and what is still needed in it."""
    run = Window.partitionBy(*keys).orderBy(cell)
    sums = counts.withColumn("_cum", F.sum("_n").over(run)).join(need, keys)
    return (sums.where((F.col("_need") > 0) & (F.col("_cum") >= F.col("_need"))).groupBy(*keys)
            .agg(F.min_by(F.struct(F.col(cell).alias("cell"), (F.col("_need") - F.col("_cum") + F.col("_n")).alias("left")),
                          cell).alias("_e"))
            .select(*keys, F.col("_e.cell").alias("_cell"), F.col("_e.left").alias("_need")))


def one_a_key(df: DataFrame, name: str, rows: int = 10_000) -> DataFrame:
    """A table with one row a key: broadcast if it has no more rows than that (which is looked at), so that
    large sides need not move; else written, for a shuffled join."""
    got = df.take(rows + 1)
    return F.broadcast(df.sparkSession.createDataFrame(got, df.schema)) if len(got) <= rows else written(df, name)


Wanted = int | dict[tuple, int] | Callable[[Column], Column]


def _wanted(k: Wanted, keys: list[str]) -> Column:
    """The number of rows per key: the same for all, by key (0 for others), or from the key's row count."""
    if isinstance(k, int):
        return F.lit(k)
    if isinstance(k, dict):
        out = F.lit(0)
        for key, n in k.items():
            hit = F.lit(True)
            for c, v in zip(keys, key):
                hit = hit & (F.col(c) == F.lit(v))
            out = F.when(hit, F.lit(n)).otherwise(out)
        return out
    return k(F.col("_total"))


def cuts(work: DataFrame, h: str, tie: str, k: Wanted, keys: list[str]) -> DataFrame:
    """Per key the (h, tie) of its k-th smallest row; no row where k is 0, the last row where the key has fewer.

    Hash values are counted in 2^12 buckets (few enough for the tasks to add them up before
    the shuffle), then the values of the boundary bucket, and only rows that share the boundary value are ranked. Nothing is
    collected, so the number of keys is not bounded. ``work`` is read three times: a
    written table, narrow (keys, hash, tie) where the rows are wide.
    """
    bucket = (F.col(h) / 2 ** 20).cast("long")
    coarse = work.groupBy(*keys, bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    need = (coarse.groupBy(*keys).agg(F.sum("_n").alias("_total"))
            .withColumn("_need", F.least(_wanted(k, keys).cast("long"), F.col("_total"))).drop("_total"))
    first = one_a_key(_edge(coarse, need, keys, "_b"), "cut-cells")
    inside = work.join(first, keys).where(bucket == F.col("_cell"))
    second = one_a_key(_edge(inside.groupBy(*keys, F.col(h).alias("_b")).agg(F.count(F.lit(1)).alias("_n")),
                             first.select(*keys, "_need"), keys, "_b"), "cut-values")
    ranked = work.join(second, keys).where(F.col(h) == F.col("_cell")).withColumn(
        "_r", F.row_number().over(Window.partitionBy(*keys).orderBy(tie)))
    return one_a_key(ranked.where(F.col("_r") <= F.col("_need")).groupBy(*keys)
                     .agg(F.max("_cell").alias("_cut_h"), F.max(tie).alias("_cut_tie")), "cuts")


def k_smallest(df: DataFrame, h: str, tie: str, k: Wanted, keys: list[str] | None = None,
               flag: str = "selected") -> DataFrame:
    """Flag, per key, the ``k`` rows with the smallest (h, tie); h in [0, 2^32), ``tie`` unique per row.

    ``k`` is a number, a number by key, or a function of the key's row count. The input is written
    once to the shared folder, so the passes read it instead of recomputing it; they read its
    keys, hash and tie only.
    """
    work = written(df if keys else df.withColumn("_one", F.lit(1)), "k-smallest")
    kcols = list(keys or ["_one"])
    out = work.join(cuts(work.select(*kcols, h, tie), h, tie, k, kcols), kcols, "left")
    below = (F.col(h) < F.col("_cut_h")) | ((F.col(h) == F.col("_cut_h")) & (F.col(tie) <= F.col("_cut_tie")))
    out = out.withColumn(flag, F.coalesce(below, F.lit(False))).drop("_cut_h", "_cut_tie")
    return out if keys else out.drop("_one")


# --------------------------------------------------------------- quantiles
def order_statistic(df: DataFrame, col: str, rank: int, cells: int = 4096, few: int = 4096) -> float:
    """The value with ``rank`` smaller ones before it (0: the least), by refining a histogram.

    Each pass counts the values of the current range in ``cells`` equal parts and goes on
    with the part that holds the rank, until that part has one value or few rows. Only
    counts and at most ``few`` values reach the driver.
    """
    low, high = df.agg(F.min(col), F.max(col)).first()
    inside, before = df.where(F.col(col).isNotNull()), 0
    while low < high:
        cell = F.least(F.floor((F.col(col) - F.lit(low)) / F.lit(high - low) * cells), F.lit(cells - 1))
        found = sorted(inside.where((F.col(col) >= low) & (F.col(col) <= high)).groupBy(cell.alias("c")).agg(
            F.count(F.lit(1)).alias("n"), F.min(col).alias("low"), F.max(col).alias("high")).collect())
        for _, n, low, high in found:
            if before + n > rank:
                break
            before += n
        if low < high and n <= few:
            values = inside.where((F.col(col) >= low) & (F.col(col) <= high)).select(col).collect()
            return float(sorted(r[0] for r in values)[rank - before])
    return float(low)


def exact_quantile(df: DataFrame, col: str, q: float) -> float:
    """The q-quantile of the values (linear between neighbours). ``df`` is read several times: a written table."""
    n = df.agg(F.count(col)).first()[0]
    at = q * (n - 1)
    low = int(at)
    first = order_statistic(df, col, low)
    return first if at == low else first + (at - low) * (order_statistic(df, col, low + 1) - first)


# ---------------------------------------------------------------- M02
def label_noise(df: DataFrame, label: str, id_col: str, classes: list[str],
                pct: float = K.LABEL_NOISE_PCT, seed: int = K.SEED, out: str = "label_noisy",
                tie_col: str | None = None) -> DataFrame:
    """Exactly floor(pct * n) rows (smallest hash of (seed, id)) move to another class.

    ``tie_col`` must be unique per row (defaults to ``id_col``).
    """
    h = df.withColumn("_h", hash32(seed, F.col(id_col)))
    flagged = k_smallest(h, "_h", tie_col or id_col, lambda n: F.floor(n * F.lit(pct)), flag="_noisy")
    others = F.filter(F.array(*[F.lit(c) for c in classes]), lambda c: c != F.col(label))
    pick = F.get(others, (hash32(seed, "alt", F.col(id_col)) % F.greatest(F.size(others), F.lit(1))).cast("int"))
    return flagged.withColumn(out, F.when(F.col("_noisy"), pick).otherwise(F.col(label))).drop("_h", "_noisy")


# ---------------------------------------------------------------- W03, W04
def split_hash(id_col: str, test_size: float = 0.2, seed: int = K.SEED) -> Column:
    """W03 at scale: stateless test flag, hash < test_size."""
    return hash01(seed, "split", F.col(id_col)) < test_size


def split_exact(df: DataFrame, label: str, id_col: str, test_size: float = 0.2, seed: int = K.SEED,
                tie_col: str | None = None) -> DataFrame:
    """W03 exact: per class, the floor(test_size * n_c + 0.5) rows of smallest hash are test."""
    h = df.withColumn("_h", hash32(seed, "split", F.col(id_col)))
    return k_smallest(h, "_h", tie_col or id_col, lambda n: F.floor(n * F.lit(test_size) + 0.5),
                      keys=[label], flag="is_test").drop("_h")


def folds(df: DataFrame, label: str, id_col: str, n_folds: int = 3, seed: int = K.SEED,
          tie_col: str | None = None, out: str = "fold") -> DataFrame:
    """Stratified folds. The rows of each class, in hash order, are cut into ``n_folds`` parts of equal size."""
    tie = tie_col or id_col
    work = written(df.withColumn("_h", hash32(seed, "fold", F.col(id_col))), "folds")
    fold = F.lit(0)
    rows = work
    for f in range(1, n_folds):
        cut = cuts(work.select(label, "_h", tie), "_h", tie, lambda n, f=f: F.ceil(n * f / n_folds), [label])
        rows = rows.join(cut.withColumnsRenamed({"_cut_h": f"_h{f}", "_cut_tie": f"_t{f}"}), label, "left")
        past = (F.col("_h") > F.col(f"_h{f}")) | ((F.col("_h") == F.col(f"_h{f}")) & (F.col(tie) > F.col(f"_t{f}")))
        fold = fold + F.when(past, 1).otherwise(0)
    return rows.withColumn(out, fold.cast("int")).drop("_h", *[f"_{x}{f}" for f in range(1, n_folds) for x in "ht"])


def fold_hash(id_col: str, folds: int = 3, seed: int = K.SEED) -> Column:
    """A stateless fold number from the row hash, balanced in expectation only (for streams)."""
    return (hash32(seed, "fold", F.col(id_col)) % folds).cast("int")
