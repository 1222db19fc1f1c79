"""Sharding by a two-pass external shuffle, with DataFrame functions only.

Pass one scatters the rows by seeded hashes: a rendezvous hash of the key picks the shard, a second hash, of key and
text, one of the shard's memory-sized buckets. Each shard has as many buckets as its own bytes ask for, so a key of
many rows gets more of them; only rows alike in key and text stay together. Pass two brings each bucket into one
partition of its own, sorts it so that the outcome does not depend on the order of arrival, and runs Fisher-Yates over
it with a seed fixed by the bucket. The law held is `key`: the shard depends on the key and the number of shards
alone, and one more shard takes rows only into itself.

Defined results: a null key counts as the empty string, a null text has no bytes, an empty table gives an empty
result, equal rows get different slots, other columns (also ones named shard or slot, and maps) are kept inside the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from treeloom.llm.common import keep, read, small

SHARDS = 40
SEED = 20_241
#: Bytes of text that one bucket holds on average; a task shuffles a bucket in memory.
BUCKET_BYTES = 24 << 20


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard whose hash with the key is the largest."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    scores = [F.struct(F.xxhash64(text, F.lit(seed), F.lit(s)).alias("h"), F.lit(s).alias("s")) for s in range(shards)]
    return F.array_max(F.array(*scores))["s"]


def n_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(16).cast("long")


def _has_map(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return any(_has_map(f.dataType) for f in kind)
    return isinstance(kind, MapType) or isinstance(kind, ArrayType) and _has_map(kind.elementType)


def ordered(value: Column, kind: DataType) -> Column:
    """value with each map as its entries in order, so that rows can be sorted."""
    if not _has_map(kind):
        return value
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*[ordered(value[f.name], f.dataType).alias(f.name) for f in kind]))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: ordered(x, kind.elementType))
    return F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].alias("key"), ordered(e["value"], kind.valueType).alias("value"))))


def restored(value: Column, kind: DataType) -> Column:
    """What ordered() was given."""
    if not _has_map(kind):
        return value
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*[restored(value[f.name], f.dataType).alias(f.name) for f in kind]))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: restored(x, kind.elementType))
    return F.map_from_entries(F.transform(value, lambda e: F.struct(e["key"].alias("key"), restored(e["value"], kind.valueType).alias("value"))))


def shards(docs: DataFrame, n: int = SHARDS, bucket_bytes: int = BUCKET_BYTES, seed: int = SEED, key: str = "doc_id") -> DataFrame:
    """Rows as (row struct, shard, slot): row holds all columns of docs."""
    held = docs.select(shard_of(F.col(key), n, seed).alias("s"), n_bytes(F.col("text")).alias("b")).groupBy("s").agg(F.sum("b").alias("b"))
    per_shard = {r.s: r.b for r in held.collect()}  # one row for each shard
    each = [max(1, -(-per_shard.get(s, 0) // bucket_bytes)) for s in range(n)]
    first = [sum(each[:s]) for s in range(n)]
    of_shard = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("_shard") + 1)
    text_key = F.coalesce(F.col(key).cast("string"), F.lit(""))
    rows = docs.select(F.struct(text_key.alias("_k"), F.struct(*[ordered(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in docs.schema]).alias("row")).alias("item"), F.col(key).alias("_key"))
    rows = rows.withColumn("_shard", shard_of(F.col("_key"), n, seed).cast("int"))
    scattered = F.pmod(F.xxhash64(F.col("item._k"), F.col("item.row.text"), F.lit(seed), F.lit("bucket")), of_shard(each))
    rows = rows.withColumn("_bucket", (of_shard(first) + scattered).cast("int"))
    shuffled = F.shuffle(F.sort_array(F.collect_list("item")), F.lit(seed))
    buckets = rows.select("_shard", "_bucket", "item").repartitionById(sum(each), F.col("_bucket")).groupBy("_bucket").agg(F.first("_shard").alias("_shard"), shuffled.alias("items"))
    out = buckets.select("_shard", "_bucket", F.posexplode("items").alias("_pos", "item"))
    out = out.select(F.col("item.row").alias("row"), F.col("_shard").alias("shard"), "_bucket", F.col("_pos").cast("long").alias("slot"))
    if max(each) > 1:
        counts = keep(rows.groupBy("_shard", "_bucket").count(), "shard-counts")  # a row for each bucket
        before = Window.partitionBy("_shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        starts = counts.select(F.col("_bucket").alias("_b"), F.coalesce(F.sum("count").over(before), F.lit(0).cast("long")).alias("_start"))
        out = out.join(small(starts), F.col("_bucket") == F.col("_b"), "left").withColumn("slot", F.col("slot") + F.col("_start"))
    if _has_map(docs.schema):
        out = out.withColumn("row", restored(F.col("row"), docs.schema))
    return out.select("row", "shard", "slot")


def write(docs: DataFrame, path: str, **options) -> None:
    """Write the shards as Parquet, a folder for each shard, rows in slot order."""
    placed = shards(docs, **options)
    placed.select("row.*", F.col("shard").alias("_shard"), F.col("slot").alias("_slot")).sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").parquet(path)


def op10_shards(spark, sf_dir: str) -> DataFrame:
    placed = shards(read(spark, sf_dir, "documents").select("doc_id", "text"))
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return placed.select(
        F.col("row.doc_id").alias("doc_id"),
        n_bytes(F.col("row.text")).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        shard_of(F.col("row.doc_id"), SHARDS + 1).cast("int").alias("grown_shard"),
    )


QUERIES = {"op10_shards": op10_shards}
ORACLE: dict[str, str] = {}
