import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOC = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text[, lang[, source]]) rows, with extra columns of clashing names if asked."""
    def make(rows, extra=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOC)
        if extra:
            for name in ("h", "size", "score", "tkey", "copies", "taken", "shard", "rank", "word", "c", "bucket"):
                df = df.withColumn(name, F.lit("x"))
        return df
    return make


@pytest.fixture
def tables(spark, tmp_path, make_docs):
    """Write tables into a folder that a query can read; returns its path."""
    def write(docs, labels=(), benchmark=(), conversations=(), extra=False, embeddings=()):
        make_docs(docs, extra).write.parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
        spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
        chats = spark.createDataFrame(list(conversations), "conv_id long, turn long, role string, text string")
        vectors = spark.createDataFrame(list(embeddings), "vec_id long, embedding array<float>, label int")
        for name, df in (("conversations", chats), ("embeddings", vectors)):
            for c in ("path", "node", "n", "h", "code", "error", "v") if extra else ():
                df = df.withColumn(c, F.lit("x"))
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)
    return write


LONG = " ".join(f"word{i % 97} and" for i in range(30_000))
ODD = [(1, None, None, None), (2, "", "en", "a"), (3, "   \n\t ", "en", "a"), (4, "one", "de", None),
       (5, "the same text twice over and over", "en", "b"), (6, "the same text twice over and over", "en", "b"),
       (6, "the same text twice over and over", "en", "b"), (None, "no id here at all", "fr", "a"), (7, LONG, "en", "a"),
       (8, "café \U0001f600 naïve Über", "fr", "c")]


@pytest.fixture
def odd_rows():
    return list(ODD)
