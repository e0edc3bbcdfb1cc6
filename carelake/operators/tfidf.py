"""TF-IDF over symptom text with the reference's exact weighting (K9).

Terms are word unigrams and bigrams of the tokens ``(?U)\\b\\w\\w+\\b``;
tf is sublinear (1 + ln tf), idf is ln((1 + n) / (1 + df)) + 1, rows are
L2-normalised, terms need df >= 2 and the vocabulary keeps the 400 terms of
highest total count (ties by term).

Terms are counted inside each row, as runs of its sorted list. Fitting is one
grouped aggregation by term with map-side combine, for any number of row subsets
at once (final models and folds), then a top-400 cut for each. A fitted
vocabulary has at most ``max_features`` rows; it travels as one literal, cut into
small maps by a cheap property of the term, so that a look-up reads a few entries.
``TermWeights`` is the fitted Spark ML stage: text in, sparse vector out.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel, keyword_only
from pyspark.ml import Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as TT

from carelake.functions import text as T

TOKEN_RE = r"(?U)\b\w\w+\b"
MAX_FEATURES = 400
MIN_DF = 2


def with_terms(df: DataFrame, text_col: str, out: str = "_terms") -> DataFrame:
    """Add ``out``: unigrams then bigrams of the lower-cased token list.

    Tokens are a column of their own, so the bigram lambda reads the list
    instead of re-extracting it per element (the optimizer keeps a non-cheap
    column referenced several times as one computed value).
    """
    d = df.withColumn("_toks", F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(TOKEN_RE), 0))
    toks = F.col("_toks")
    bigrams = F.transform(F.slice(toks, 2, F.greatest(F.size(toks) - 1, F.lit(0))),
                          lambda t, i: F.concat_ws(" ", F.get(toks, i), t))
    return d.withColumn(out, F.concat(toks, bigrams)).drop("_toks")


def with_term_counts(df: DataFrame, text_col: str, out: str = "_tc") -> DataFrame:
    """Add ``out``: array<struct<term, tf>> of the row's document (no shuffle).

    The sorted list has equal terms in a row: a term's count is the way from the
    place where its run begins to the place where the next one does.
    """
    d = with_terms(df, text_col, "_list").withColumn("_sorted", F.array_sort("_list")).drop("_list")
    t = F.col("_sorted")
    begins = F.filter(F.transform(t, lambda x, i: F.when((i == 0) | (F.get(t, i - 1) != x), i)), lambda i: i.isNotNull())
    d = d.withColumn("_begins", begins)
    b = F.col("_begins")
    return d.withColumn(out, F.transform(b, lambda at, i: F.struct(
        F.get(t, at).alias("term"), (F.coalesce(F.get(b, i + 1), F.size(t)) - at).alias("tf")))).drop("_sorted", "_begins")


def term_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, term, tf): one row per document term (each input row is a document)."""
    # Outer generator plus an explicit null filter: a plain one makes the
    # optimizer add size(array) > 0, recomputing the whole term chain.
    return (with_term_counts(docs.select(id_col, text_col), text_col)
            .select(id_col, F.inline_outer("_tc")).filter(F.col("term").isNotNull()))


Vocabulary = list[tuple[str, int, float]]     # term, df, idf; in alphabetical order


def fit_vocabularies(docs: DataFrame, text_col: str, subsets: dict[str, Column],
                     max_features: int = MAX_FEATURES, min_df: int = MIN_DF) -> dict[str, Vocabulary]:
    """The vocabulary of each subset of ``docs`` (a condition on its rows).

    One grouped aggregation over (term) with map-side combine gives df and the total
    count in every subset. Every document also emits one marker term "" (real terms
    have at least two characters), whose df is the subset's document count: one pass.
    """
    marks = [f"_in{k}" for k in range(len(subsets))]
    marker = F.array(F.struct(F.lit("").alias("term"), F.lit(1).alias("tf")))
    tc = (with_term_counts(docs.select(text_col, *[F.coalesce(c, F.lit(False)).alias(m) for c, m in zip(subsets.values(), marks)]), text_col)
          .select(*marks, F.inline_outer(F.concat(F.col("_tc"), marker))))
    stats = tc.groupBy("term").agg(*[e for m in marks for e in (
        F.count_if(m).alias(f"df{m}"), F.sum(F.when(F.col(m), F.col("tf"))).alias(f"total{m}"))])
    stats = stats.persist(StorageLevel.MEMORY_AND_DISK)          # one row per distinct term
    out = {}
    try:
        first = stats.filter(F.col("term") == "").first()
        for name, m in zip(subsets, marks):
            n_docs = int(first[f"df{m}"]) if first else 0
            top = (stats.filter((F.col("term") != "") & (F.col(f"df{m}") >= min_df)).select("term", F.col(f"df{m}").alias("df"), f"total{m}")
                   .orderBy(F.desc(f"total{m}"), "term").limit(max_features).collect())   # <= max_features rows
            out[name] = [(r["term"], r["df"], math.log((1.0 + n_docs) / (1.0 + r["df"])) + 1.0)
                         for r in sorted(top, key=lambda r: r["term"])]
    finally:
        stats.unpersist()
    return out


def fit_vocabulary(docs: DataFrame, id_col: str, text_col: str,
                   max_features: int = MAX_FEATURES, min_df: int = MIN_DF) -> DataFrame:
    """(term, idx, df, idf): the fitted vocabulary, alphabetical index order."""
    rows = fit_vocabularies(docs, text_col, {"all": F.lit(True)}, max_features, min_df)["all"]
    return docs.sparkSession.createDataFrame([(t, i, df, idf) for i, (t, df, idf) in enumerate(rows)],
                                             "term string, idx int, df long, idf double")


COUNTS = "_term_counts"


def weights_of(counts: Column, terms: list[str], idf: list[float]) -> Column:
    """array<struct<i, term, w>>: the exact weights of a row's vocabulary terms, in index order, from its term counts."""
    look_up = T.literal_maps({t: {"i": i, "idf": w} for i, (t, w) in enumerate(zip(terms, idf))}, "struct<i:int,idf:double>")
    hits = F.filter(F.transform(counts, lambda e: F.struct(
        look_up(e["term"]).alias("v"), e["term"].alias("term"), e["tf"].alias("tf"))),
        lambda e: e["v"].isNotNull())
    raw = F.transform(hits, lambda e: F.struct(          # terms are sorted, so the indices are
        e["v"]["i"].alias("i"), e["term"].alias("term"), ((1.0 + F.log(e["tf"].cast("double"))) * e["v"]["idf"]).alias("w")))

    def scaled(r: Column) -> Column:
        norm = F.sqrt(F.aggregate(r, F.lit(0.0), lambda a, e: a + e["w"] * e["w"]))
        return T.let(norm, lambda n: F.transform(r, lambda e: F.struct(e["i"].alias("i"), e["term"].alias("term"), (e["w"] / n).alias("w"))))
    return T.let(raw, scaled)


def weights_long(docs: DataFrame, vocab: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, term, weight): sublinear tf x idf, L2-normalised per document; computed inside each row, no shuffle."""
    rows = vocab.orderBy("idx").collect()
    w = weights_of(F.col("_tc"), [r["term"] for r in rows], [float(r["idf"]) for r in rows])
    d = with_term_counts(docs.select(id_col, text_col), text_col).select(id_col, w.alias("_w"))
    return d.select(id_col, F.inline_outer("_w")).filter(F.col("term").isNotNull()).select(id_col, "term", F.col("w").alias("weight"))


def sparse_vector(size: int, indices: Column, values: Column) -> Column:
    """A Spark ML sparse vector from its arrays. SQL has no constructor; the JSON reader builds the type on the JVM."""
    kind = TT.StructType([TT.StructField("v", VectorUDT())])
    fields = F.struct(F.lit(0).alias("type"), F.lit(size).alias("size"), indices.alias("indices"), values.alias("values"))
    return F.from_json(F.to_json(F.struct(fields.alias("v"))), kind)["v"]


class TermWeights(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted TF-IDF stage: a text column becomes a sparse vector over the vocabulary. Can be saved in a pipeline.

    Rows that have their term counts already (``COUNTS``, for several vocabularies) are not counted again.
    """

    terms = Param(Params._dummy(), "terms", "vocabulary, in index order", TypeConverters.toListString)
    idf = Param(Params._dummy(), "idf", "inverse document frequency of each term", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCol: str = "model_text", outputCol: str = "tfidf", terms: list[str] | None = None,
                 idf: list[float] | None = None):
        super().__init__()
        self._setDefault(inputCol="model_text", outputCol="tfidf", terms=[], idf=[])
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    @classmethod
    def of(cls, vocabulary: Vocabulary) -> TermWeights:
        return cls(terms=[t for t, _, _ in vocabulary], idf=[w for _, _, w in vocabulary])

    def size(self) -> int:
        return len(self.getOrDefault("terms"))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        terms, idf = self.getOrDefault("terms"), self.getOrDefault("idf")
        out, counted = self.getOutputCol(), COUNTS in dataset.columns
        d = dataset if counted else with_term_counts(dataset, self.getInputCol(), COUNTS)
        d = d.withColumn("_w", weights_of(F.col(COUNTS), terms, idf))
        d = d.withColumn(out, sparse_vector(len(terms), F.col("_w.i"), F.col("_w.w"))).drop("_w", *([] if counted else [COUNTS]))
        return d.withMetadata(out, {"ml_attr": {"num_attrs": len(terms)}})   # the assembler reads the size there


def assembler(weights: TermWeights, out: str = "features") -> VectorAssembler:
    """TF-IDF then age then gender code, as one sparse vector (no stay length, K22)."""
    return VectorAssembler(inputCols=[weights.getOutputCol(), "age", "gender_enc"], outputCol=out, handleInvalid="keep")
