"""Document fingerprints: SimHash with permuted block tables.

Each distinct word of a text votes with its length (at most 16) on the 128 bits of
its hash; a bit of the fingerprint is set where the words that set it weigh more
than half. Votes of four bits share one long sum (16 bits each), so a text costs
32 sums; long texts vote in parts of 2,000 words, whose votes are added later.

``neighbours`` finds all fingerprints within a Hamming radius: the bits are cut
into blocks, and two fingerprints within the radius agree on all blocks but
``radius``; one table for each choice of the agreeing blocks finds every pair.

Defined results: a null text is the empty text, whose fingerprint is zero; equal
texts have equal fingerprints; ties in doc_id are ordered by text hash, null ids
come last; the only document is its own next document; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carelake.llm.common import read_table, written

LANES = 0x0001_0001_0001_0001
MAX_WEIGHT = 16
PART_WORDS = 2_000        # PART_WORDS * MAX_WEIGHT < 2 ** 15: a lane cannot overflow
BUCKET_CHARS = 4_000_000  # text that one task orders
KNOTS = 128
HOT_CUTS = 1024             # buckets of an id that fills a quantile
SUMS = [(h, i) for h in ("h0", "h1") for i in range(16)]


def words(text: Column) -> Column:
    return F.array_distinct(F.split(text, r"[\x20\x09-\x0D]+"))


def fingerprints(texts: DataFrame, keys: list[str], columns: dict[str, str]) -> DataFrame:
    """keys + one fingerprint (struct of two longs) per text column, as ``columns`` names them.

    ``keys`` must tell the rows apart.
    """
    which = F.explode(F.array(*[F.struct(F.lit(i).alias("which"), words(F.col(c)).alias("words"))
                                for i, c in enumerate(columns)]))
    terms = (texts.select(*keys, which.alias("t"))
             .select(*keys, "t.which", F.posexplode_outer("t.words").alias("pos", "word"))
             .select(*keys, "which", F.call_function("div", "pos", F.lit(PART_WORDS)).alias("part"),
                     F.coalesce(F.least(F.length("word"), F.lit(MAX_WEIGHT)), F.lit(0)).cast("long").alias("w"),
                     F.xxhash64("word").alias("h0"), F.xxhash64(F.lit(7).cast("long"), "word").alias("h1")))
    votes = [F.sum(F.shiftright(h, i).bitwiseAND(F.lit(LANES)) * F.col("w")).alias(f"{h}_{i}") for h, i in SUMS]
    parts = terms.groupBy(*keys, "which", "part").agg(F.sum("w").alias("weight"), *votes)
    # A bit's votes over the parts of a text: 128 plain sums of one row a text (as a rule).
    bits = [F.sum(F.shiftright(f"{h}_{i}", 16 * lane).bitwiseAND(F.lit(0x7FFF).cast("long"))).alias(f"{h}_{i}_{lane}")
            for h, i in SUMS for lane in range(4)]
    whole = parts.groupBy(*keys, "which").agg(F.sum("weight").alias("weight"), *bits)

    def half(h: str) -> Column:
        out = F.lit(0).cast("long")
        for lane in range(4):
            for i in range(16):
                k = 16 * lane + i
                one = F.lit((1 << k) - (1 << 64 if k == 63 else 0)).cast("long")
                out = out.bitwiseOR(F.when(F.col(f"{h}_{i}_{lane}") * 2 > F.col("weight"), one).otherwise(F.lit(0).cast("long")))
        return out

    halves = whole.select(*keys, "which", half("h0").alias("hi"), half("h1").alias("lo"))
    picked = [F.struct(*[F.max(F.when(F.col("which") == i, F.col(part))).alias(part) for part in ("hi", "lo")]).alias(name)
              for i, name in enumerate(columns.values())]
    return halves.groupBy(*keys).agg(*picked)


def likeness(x: Column, y: Column) -> Column:
    """Share of equal bits."""
    apart = F.bit_count(x["hi"].bitwiseXOR(y["hi"])) + F.bit_count(x["lo"].bitwiseXOR(y["lo"]))
    return 1 - apart / F.lit(128.0)


def as_hex(fp: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(fp["hi"]), 16, "0"), F.lpad(F.hex(fp["lo"]), 16, "0")))


def ordered(docs: DataFrame) -> DataFrame:
    """doc_id, text, bucket, place: buckets and places ascend as ids descend (null ids last).

    Buckets hold about ``BUCKET_CHARS`` of text: quantiles of the ids bound them, evenly
    cut between two quantiles where there are more buckets than quantiles. Rows of one id
    are ordered by their text's hash, so an id that fills a quantile or more, and the rows
    without id, are cut into ``HOT_CUTS`` more buckets by that hash.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    steps = [i / KNOTS for i in range(1, KNOTS)]
    facts = docs.agg(F.sum(F.length("text")).alias("chars"), F.percentile_approx("doc_id", steps).alias("knots"),
                     F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    knots = sorted({facts["low"], facts["high"], *(facts["knots"] or [])} - {None})
    hot = sorted(k for k, n in Counter(facts["knots"] or []).items() if n > 1)
    fine = max(1, -(-(facts["chars"] or 0) // (BUCKET_CHARS * max(1, len(knots) - 1))))
    coarse = max(1, (len(knots) - 1) * BUCKET_CHARS // max(1, facts["chars"] or 1))
    kept = sorted({*knots[::coarse], *hot})    # a hot id is the least of its bucket, so that the others come first
    if not kept:
        bucket = F.lit(0).cast("long")
    else:
        at = F.array(*[F.lit(k).cast("long") for k in kept])
        ends = F.array(*[F.lit(k).cast("long") for k in [*kept[1:], knots[-1] + 1]])
        i = F.greatest(F.size(F.filter(at, lambda k: k <= F.col("doc_id"))), F.lit(1))  # a null id's place is set below
        span = F.element_at(ends, i) - F.element_at(at, i)
        sub = F.floor((F.col("doc_id") - F.element_at(at, i)) * F.lit(float(fine)) / span)
        bucket = F.coalesce(F.lit(0) - (i * fine + F.least(sub, F.lit(fine - 1))), F.lit(1)).cast("long")
    docs = docs.withColumn("h", F.xxhash64("text"))
    part = F.floor((F.lit(0.5) - F.col("h") / F.lit(float(1 << 64))) * F.lit(float(HOT_CUTS - 1)))    # falls as the hash rises
    is_hot = F.col("doc_id").isNull() | (F.col("doc_id").isin(hot) if hot else F.lit(False))
    cut = F.when(is_hot, F.least(F.greatest(part, F.lit(0)), F.lit(HOT_CUTS - 2)) + 1).otherwise(F.lit(0))
    docs = docs.withColumn("bucket", bucket * HOT_CUTS + cut)
    by = Window.partitionBy("bucket").orderBy(F.col("doc_id").desc_nulls_last(), F.col("h").desc())
    return docs.withColumn("place", F.row_number().over(by)).withColumn("next_text", F.lead("text").over(by))


def with_next(rows: DataFrame, value: str, first: DataFrame) -> DataFrame:
    """Fill the ``value`` of a bucket's last row with the first of the next bucket, and of the last bucket's with the very first."""
    order = Window.orderBy("bucket")
    ring = first.select("bucket", F.coalesce(
        F.lead("first").over(order),
        F.first("first").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("turn"))
    return rows.join(ring, "bucket").withColumn(value, F.coalesce(value, "turn")).drop("turn")


def edited_texts(docs: DataFrame) -> DataFrame:
    """bucket, place, doc_id, text, edited: the last third of the code points replaced by as many first ones of the next document."""
    rows = ordered(docs)
    narrow = rows.where("place = 1")
    first = narrow.select("bucket", F.col("text").alias("first"))
    rows = with_next(rows, "next_text", first)
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring("text", 1, F.length("text") - third), F.substring("next_text", 1, third))
    return rows.select("bucket", "place", "doc_id", "text", edited.alias("edited"))


def neighbours(prints: DataFrame, queries: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """(q, fp, distance): for each query fingerprint q all fingerprints within the radius.

    Both frames have one column ``fp`` (hi, lo). Equal fingerprints meet once; each
    pair is found by the first table that holds it, so none comes twice.
    """
    edges = [round(128 * i / blocks) for i in range(blocks + 1)]

    def block(fp: Column, b: int) -> Column:
        def part(word: Column, lo: int, hi: int) -> Column:
            if hi <= lo:
                return F.lit(0).cast("long")
            return F.shiftrightunsigned(F.shiftleft(word, 64 - hi), 64 - hi + lo)
        lo, hi = edges[b], edges[b + 1]
        return F.struct(part(fp["hi"], min(lo, 64), min(hi, 64)), part(fp["lo"], max(lo - 64, 0), max(hi - 64, 0)))

    tables = list(combinations(range(blocks), blocks - radius))

    def spread(frame: DataFrame, name: str) -> DataFrame:
        keys = F.array(*[F.struct(F.lit(t).alias("table"), F.xxhash64(*[block(F.col("fp"), b) for b in picked]).alias("key"))
                         for t, picked in enumerate(tables)])
        return frame.select("fp").distinct().select(F.col("fp").alias(name), F.explode(keys).alias("k")).select(name, "k.*")

    pairs = spread(queries, "q").join(spread(prints, "fp"), ["table", "key"])
    apart = F.bit_count(F.col("q.hi").bitwiseXOR(F.col("fp.hi"))) + F.bit_count(F.col("q.lo").bitwiseXOR(F.col("fp.lo")))
    pairs = pairs.withColumn("distance", apart).where(F.col("distance") <= radius)
    same = [block(F.col("q"), b) == block(F.col("fp"), b) for b in range(blocks)]
    first = F.coalesce(*[F.when(F.expr("true") if not picked else _all([same[b] for b in picked]), F.lit(t))
                         for t, picked in enumerate(tables)])
    return pairs.where(F.col("table") == first).select("q", "fp", "distance")


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = edited_texts(read_table(spark, sf_dir, "documents"))
    texts = texts.withColumn("n_chars", F.length("text").cast("long")).withColumn(
        "edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    keys = ["bucket", "place", "doc_id", "n_chars", "edited_sha256"]
    prints = written(fingerprints(texts, keys, {"text": "fp", "edited": "edited_fp"}), "simhash")
    by = Window.partitionBy("bucket").orderBy("place")
    first = prints.where("place = 1").select("bucket", F.col("fp").alias("first"))
    rows = with_next(prints.withColumn("next_fp", F.lead("fp").over(by)), "next_fp", first)
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_hex(F.col("fp")).alias("fingerprint"),
        as_hex(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
