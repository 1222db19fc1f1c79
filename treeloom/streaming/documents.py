"""The token pipeline as a stateless stream: documents come and go whole, so no state outlives a micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from treeloom.functions import text as T
from treeloom.sources import toy


def source(spark: SparkSession, sf_dir: str, name: str = "documents", files: int = 1) -> DataFrame:
    """A table's files as a stream, `files` of them a micro-batch."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}*.parquet")


def words(docs: DataFrame) -> DataFrame:
    """doc_id, tok_ix, txt, kind and lemma of every token; needs no window, so it runs in any output mode."""
    rows = docs.select("doc_id", F.posexplode(T.token_array(F.col("text"))).alias("tok_ix", "txt")).withColumn("kind", T.kind(F.col("txt")))
    made = toy.describe(F.lower("txt"), F.col("kind") == "WORD")
    return rows.select("doc_id", "tok_ix", "txt", "kind", made["cat"].alias("cat"), made["lemma"].alias("lemma"))


def run(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Start a query that hands each micro-batch to the sink and stops when the input is used up."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tokenised(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """All tokens of the documents, made by the stream and written to a folder, batch by batch."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")  # a batch that is done again replaces itself

    run(words(source(spark, sf_dir)), sink, f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("batch")
