"""What the corpus operators share: reading tables, word splitting, and tables kept on shared storage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom import session

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of a side table up to which a broadcast is taken; larger sides are shuffled.
BROADCAST_ROWS = 200_000

#: Rows of one key from which on a join deals the key over several tasks.
HOT_ROWS = 500

#: Folders made where the session names none, by application.
_OWN: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table of a data folder; only Spark opens the path."""
    return session.table(spark, sf_dir, table)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where it is unset on a local master (tests) a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = _OWN.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="treeloom-")
        _OWN[spark.sparkContext.applicationId] = found
    return found.rstrip("/")


def keep(df: DataFrame, what: str = "step") -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    session.ship(spark)
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_kept(*tables: DataFrame) -> None:
    """Delete the files behind tables of keep() once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """df.mapInArrow, after the package has been sent to the executors."""
    session.ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def fields(df: DataFrame) -> str:
    """The columns of df as a schema string."""
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema)


def free(df: DataFrame, name: str) -> str:
    """A column name that df does not have yet, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def n_words(text: Column) -> Column:
    """Number of words of a text as long, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count shows that it has at most `rows` rows, else df as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def joined(rows: DataFrame, one: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """rows joined with `one`, which has one row for each key; hot has (key, n), the keys of at least HOT_ROWS rows.

    Rows of hot keys are dealt by a salt besides the key, and the other side's rows of these keys are there once for
    each salt, so no task gets a key's rows as a whole. The hot keys are a HOT_ROWS-th of the rows at most.
    """
    hot = keep(hot, "hot-keys")
    if hot.isEmpty():
        return rows.join(one, key)
    salts = F.ceil(F.coalesce("_n", F.lit(1)) / F.lit(HOT_ROWS)).cast("int")
    named = small(hot.select(F.col(key).alias("_hot"), F.col("n").alias("_n")))
    salt = F.pmod(F.xxhash64(*rows.columns), salts).cast("int")
    left = rows.join(named, F.col(key) == F.col("_hot"), "left").withColumn("_salt", salt).drop("_hot", "_n")
    right = one.join(named, F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_hot", "_n")
    return left.join(right, [key, "_salt"]).drop("_salt")
