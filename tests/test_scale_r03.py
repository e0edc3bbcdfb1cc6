"""Forest tasks, products that a query asks for, row numbers of tables in part files, copies of image rows."""

import os
import tempfile

from pyspark.sql import Window
from pyspark.sql import functions as F

from carelake.operators import models as M
from carelake.plans import q_files as QF
from carelake.plans import training as TR
from carelake.plans.runs import RunStore
from carelake.sources import files as FS
from carelake.sources.fixture import encounters_raw

SMALL = TR.TrainParams(n_trees=2, disease_depth=3, risk_depth=3, iso_trees=6, iso_samples=32, at_once=2)


def new_dir():
    return tempfile.mkdtemp(prefix="scale-", dir="/tmp")


def test_forest_tasks_end_at_the_cores():
    p = M.ForestParams()
    assert [M.forest_tasks(n, p, 12) for n in (0, 20_000, 20_001, 120_000)] == [1, 1, 2, 6]
    assert M.forest_tasks(9_000_000, p, 12) == 12         # 450 before: each sends all nodes' statistics
    assert M.forest_tasks(60_000_000, p, 12) == 60        # beyond, by what a task keeps


def test_large_runs_train_one_forest_after_another(spark, sf_dir):
    run = TR.TrainRun(encounters_raw(spark, sf_dir, with_copy=True), SMALL, RunStore(spark, "w", root=new_dir()))
    run.n_rows = 9_000_000
    assert run._workers() == 1
    run.n_rows = 100_000
    assert run._workers() == 2


def test_isolation_forest_makes_neither_folds_nor_feature_tables(spark, sf_dir):
    run = TR.TrainRun(encounters_raw(spark, sf_dir, with_copy=True), SMALL, RunStore(spark, "i", root=new_dir()))
    assert run.iso_nodes.select("tree").distinct().count() == 6
    made = [n for n in os.listdir(run.store.base) if not n.startswith(".")]
    assert not [n for n in made if n.startswith(("features", "fold", "tagged"))], made
    # What the sampled rows give equals what the whole feature table gives.
    from carelake.operators import isoforest as ISO
    whole = ISO.fit(run.feature_arrays(), "feature_array", "row_key", 6, 32)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, run.iso_nodes.collect()))


def tables(spark, keys):
    d = new_dir()
    o = spark.createDataFrame([(k, k % 30, f"1995-01-{k % 28 + 1:02d}") for k in keys], "o_orderkey long, o_custkey long, o_orderdate string")
    o.withColumn("o_orderdate", F.col("o_orderdate").cast("date")).coalesce(1).write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame([(k, k + i) for k in set(keys) for i in range(3)], "l_orderkey long, l_partkey long").coalesce(1).write.parquet(f"{d}/lineitem.parquet")
    return d


def test_row_numbers_of_rows_that_come_twice(spark):
    """Copies far apart in the input stand together in the file."""
    d = tables(spark, [*range(1, 400), *range(1, 400, 7)])
    got = FS.read_encounters_csv(spark, QF.one_csv(spark, d), canonical=False, row_col="row_no", row_scope="folder").select(
        F.col("encounter_id").cast("long").alias("e"), F.col("row_no").cast("long").alias("n"))
    w = Window.partitionBy(F.col("encounter_id") % 8).orderBy("encounter_id")
    want = encounters_raw(spark, d).select(F.col("encounter_id").alias("e"), F.row_number().over(w).cast("long").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_row_numbers_run_on_over_a_folders_files(spark):
    """One file has a line break inside quotes and is read in another way; the numbers pass through it."""
    d = new_dir()
    for name, lines in (("a.csv", ["1", "2"]), ("b.csv", ['"3\nx"', "4"]), ("c.csv", ["5"])):
        with open(f"{d}/{name}", "w") as f:
            f.write("encounter_id,Age\n" + "".join(f"{x},30\n" for x in lines))
    got = FS.read_encounters_csv(spark, d, canonical=False, row_col="n", row_scope="folder").collect()
    assert sorted((r["n"], r["encounter_id"][0]) for r in got) == [(i, str(i)) for i in range(1, 6)]
    alone = FS.read_encounters_csv(spark, d, canonical=False, row_col="n").collect()
    assert sorted((r["n"], r["encounter_id"][0]) for r in alone) == [(1, "1"), (1, "3"), (1, "5"), (2, "2"), (2, "4")]
