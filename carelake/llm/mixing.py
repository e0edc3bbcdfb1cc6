"""Mixing sources to target weights by hash-threshold histograms.

Every row gets a 60-bit hash. Words are summed by (source, hash cell); the cell
in which a source's budget ends is refined into finer cells, and only that cell.
A row is taken once more if its hash lies below its source's threshold: a filter,
no sort. Thresholds are nested: a larger budget takes a superset of the rows.

Defined results: null text counts 0 words; null source is a source of its own
(last in order); a source without words has target 0; repeated rows get copy
numbers, so that each has its own hash; all words of a text are counted, however long;
columns of other names stay as they are; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carelake.llm.common import WORD_RE, read_table, small, written


MAX_SOURCES = 100_000  # thresholds that are broadcast; beyond, the join shuffles


@dataclass(frozen=True)
class MixParams:
    """Weights repeat over the sources in code-point order (null last)."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5           # budget over the words of all sources
    max_epochs: int = 2          # a source's target is at most this many times its size
    bits: int = 12               # hash bits that one histogram resolves
    levels: int = 3              # histograms; bits * levels <= 60
    seed: str = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def unit_hash(doc_id: Column, copy: Column, seed: str) -> Column:
    """60 bits, equally likely, from (seed, id, copy)."""
    text = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), copy.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """(source, source_size) -> + target: the budget shared by weight, each source's part
    at most ``max_epochs`` times its size, the excess shared anew until none is above.

    The water level is found in closed form over the sources in order of size by
    weight. One row a source passes the window, never a document.
    """
    weights = F.array(*map(F.lit, params.weights))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(weights, (rank % len(params.weights) + 1).cast("int")).cast("long")
    s = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * params.max_epochs)
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    to_end = order.rowsBetween(0, Window.unboundedFollowing)
    s = (s.withColumn("w_rest", F.sum("w").over(to_end))
         .withColumn("cap_before", F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
         .withColumn("budget", F.sum("source_size").over(Window.partitionBy()) * F.lit(params.share)))
    full = F.col("cap") * F.col("w_rest") <= (F.col("budget") - F.col("cap_before")) * F.col("w")
    s = s.withColumn("full", full)
    level = F.first(F.when(~F.col("full"), (F.col("budget") - F.col("cap_before")) / F.col("w_rest")),
                    ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("w") * F.col("level"))
    return s.withColumn("level", level).select("source", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, targets: DataFrame, params: MixParams) -> DataFrame:
    """targets + epochs (whole passes) and cut: rows whose top hash bits are below ``cut`` are taken once more.

    ``rows`` has source, size, h.
    """
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    state = (targets.withColumn("epochs", epochs.cast("long"))
             .withColumn("need", F.col("target") - F.col("epochs") * F.col("source_size"))
             .withColumn("prefix", F.lit(0).cast("long")).withColumn("below", F.lit(0).cast("long")))
    for level in range(1, params.levels + 1):
        state = written(state, "mix-state")  # one row a source: keeps the plan of each level small
        shift = 60 - params.bits * level
        cell = F.shiftright("h", shift)
        if level == 1:
            cells = rows.groupBy("source", cell.alias("cell")).agg(F.sum("size").alias("words"))
        else:  # only the rows of the boundary cells
            edge = state.select(F.col("source").alias("e_source"), F.col("prefix").alias("e_prefix"))
            cells = (rows.withColumn("up", F.shiftright("h", shift + params.bits))
                     .join(edge, F.col("source").eqNullSafe(F.col("e_source")) & (F.col("up") == F.col("e_prefix")))
                     .groupBy("source", cell.alias("cell")).agg(F.sum("size").alias("words")))
        run = Window.partitionBy("source").orderBy("cell")
        sums = cells.select(F.col("source").alias("c_source"), "cell", "words", F.sum("words").over(run).alias("upto"))
        over = sums.join(state.select("source", "need", "below"), F.col("c_source").eqNullSafe(F.col("source")))
        first = (over.where(F.col("below") + F.col("upto") > F.col("need"))
                 .groupBy(F.col("c_source"))
                 .agg(F.min_by(F.struct("cell", "words", "upto"), "cell").alias("b")))
        state = (state.join(first, F.col("source").eqNullSafe(F.col("c_source")), "left")
                 .withColumn("past", F.shiftleft(F.col("prefix") + 1, params.bits))
                 .withColumn("prefix", F.coalesce(F.col("b.cell"), F.col("past")))
                 .withColumn("below", F.col("below") + F.coalesce(F.col("b.upto") - F.col("b.words"), F.lit(0)))
                 .withColumn("edge_words", F.col("b.words")).drop("c_source", "b", "past"))
    # The last cell (a row, as a rule) is taken if that brings the source nearer to its target.
    nearer = F.col("below") + F.col("edge_words") - F.col("need") <= F.col("need") - F.col("below")
    cut = F.col("prefix") + F.when(nearer, 1).otherwise(0)
    return state.select("source", "source_size", "target", "epochs", cut.alias("cut"))


def mix(rows: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """rows (source, size, h, ...) -> + source_size, target, times (passes over the row), taken (words)."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = written(thresholds(rows, source_targets(sizes, params), params), "mix-plan")
    plan = small(plan, MAX_SOURCES).withColumnRenamed("source", "p_source")
    below = F.shiftright("h", 60 - params.bits * params.levels) < F.col("cut")
    return (rows.join(plan, F.col("source").eqNullSafe(F.col("p_source")))
            .withColumn("times", F.col("epochs") + F.when(below, 1).otherwise(0))
            .withColumn("taken", F.col("times") * F.col("size")).drop("p_source", "epochs", "cut"))


def sized_rows(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """doc_id, source, size, h: one row a document. Repeated rows are counted first and
    then numbered, so a much repeated id is neither one window nor one hash."""
    keyed = (docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
             .groupBy("doc_id", "source", "size").count())
    return (keyed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("count"))))
            .select("doc_id", "source", "size", unit_hash(F.col("doc_id"), F.col("copy"), params.seed).alias("h")))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = MixParams()
    rows = written(sized_rows(read_table(spark, sf_dir, "documents"), params), "mix-rows")
    return mix(rows, params).select("doc_id", "size", "source", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, params: MixParams = MixParams()) -> DataFrame:
    """Documents of the mix, each as often as it is taken, with the columns of ``docs``.

    Rows equal in id and source have one hash here and stand or fall together.
    """
    names = docs.columns
    doc = F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc")
    rows = docs.select(doc, F.col("source"), word_count(F.col("text")).alias("size"),
                       unit_hash(F.col("doc_id"), F.lit(1), params.seed).alias("h"))
    narrow = written(rows.select("source", "size", "h"), "mix-rows")
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = written(thresholds(narrow, source_targets(sizes, params), params), "mix-plan")
    plan = small(plan, MAX_SOURCES).select(F.col("source").alias("p_source"), "epochs", "cut")
    below = F.shiftright("h", 60 - params.bits * params.levels) < F.col("cut")
    times = (F.col("epochs") + F.when(below, 1).otherwise(0)).cast("int")
    return (rows.join(plan, F.col("source").eqNullSafe(F.col("p_source"))).where(times > 0)
            .select("doc", F.explode(F.array_repeat(F.lit(0), times)))
            .select(*[F.col("doc").getField(c).alias(c) for c in names]))


OP1_SQL = r"""
with rows as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT as size from documents),
num as (select *, row_number() over (partition by doc_id, source, size) as copy from rows),
hashed as (
  select doc_id, source, size,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy::VARCHAR), 1, 15))::BIGINT as h from num),
sizes as (
  select source, sum(size)::BIGINT as source_size,
    ([5, 2, 1])[(((row_number() over (order by source nulls last)) - 1) % 3 + 1)::INT] as w from hashed group by source),
caps as (
  select *, 2 * source_size as cap,
    sum(w) over (order by 2 * source_size / w::DOUBLE, source nulls last rows between current row and unbounded following) as w_rest,
    sum(2 * source_size) over (order by 2 * source_size / w::DOUBLE, source nulls last rows between unbounded preceding and current row) - 2 * source_size as cap_before,
    sum(source_size) over () * 1.5::DOUBLE as budget from sizes),
lev as (
  select *, (cap * w_rest)::DOUBLE <= (budget - cap_before) * w as is_full from caps),
tgt as (
  select source, source_size, case when is_full then cap::DOUBLE
    else w * (select min((budget - cap_before) / w_rest) from (select * from lev where not is_full order by cap / w::DOUBLE limit 1)) end as target from lev),
plan as (
  select *, case when source_size > 0 then floor(target / source_size)::BIGINT else 0 end as epochs from tgt),
cells as (
  select source, h >> 24 as cell, sum(size)::BIGINT as words from hashed group by 1, 2),
runs as (
  select c.source, c.cell, c.words, sum(c.words) over (partition by c.source order by c.cell) as upto,
    p.target - p.epochs * p.source_size as need
  from cells c join plan p on c.source is not distinct from p.source),
edge as (
  select source, arg_min(struct_pack(cell := cell, words := words, upto := upto, need := need), cell) as b from runs where upto > need group by source),
cuts as (
  select p.*, case when e.b is null then 1::BIGINT << 40
    else e.b.cell + case when e.b.upto - e.b.need <= e.b.need - (e.b.upto - e.b.words) then 1 else 0 end end as cut
  from plan p left join edge e on p.source is not distinct from e.source)
select h.doc_id, h.size, h.source, c.source_size, c.target,
  (h.size * (c.epochs + case when (h.h >> 24) < c.cut then 1 else 0 end))::BIGINT as taken
from hashed h join cuts c on h.source is not distinct from c.source
"""
