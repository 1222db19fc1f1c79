"""Mixing sources to target weights.

Tokens are counted per source, targets are filled by weight up to a cap, and each document is emitted floor(rate)
times plus one hash-seeded Bernoulli copy whose probability is the fraction of the rate.

Defined results: a null text has size 0, a null source is a source of its own and comes last, a source without words
has target 0, an empty table gives an empty result, rows repeated in the input are mixed like any others, and columns
besides doc_id, text and source are carried along untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from treeloom.llm.common import keep, n_words, read, small

#: Weights dealt to the sources in order, again and again.
WEIGHTS = (5, 2, 1)
#: Candidate seeds for each source; the one whose Bernoulli copies come nearest to the target is taken.
SEEDS = 16
SEED = "mix-7"


def _u(k: int):
    """The k-th uniform number in [0, 1) of a document: 52 bits of the digest of its id."""
    digest = F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1 + k, 13), 16, 10).cast("double") / F.lit(float(2**52))


def _whole():
    return F.floor(F.col("rate")).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share=(3, 2), cap: int = 2) -> DataFrame:
    """source, source_size, target and rate from a table of source and size.

    Water is filled in closed form: in ascending order of cap over weight, a source is capped if its cap is at most
    its share of what the capped ones before it leave. All sums are integers, in units of 1 / share[1].
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row for each source
    cases = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("w", cases.cast("long")).withColumn("cap", F.col("source_size") * cap * share[1])
    ranked = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    zero = F.lit(0).cast("long")
    per = (
        per.withColumn("left_w", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), zero))
        .withColumn("left", F.sum("source_size").over(every) * share[0] - F.coalesce(F.sum("cap").over(before), zero))
        .withColumn("capped", F.col("cap") * F.col("left_w") <= F.col("left") * F.col("w"))
    )
    free = F.when(~F.col("capped"), F.col("w"))
    spent = F.when(F.col("capped"), F.col("cap"))
    pool = F.sum("source_size").over(every) * share[0] - F.coalesce(F.sum(spent).over(every), zero)
    per = per.withColumn("target", F.when(F.col("capped"), (F.col("source_size") * cap).cast("double")).otherwise(F.col("w").cast("double") * pool.cast("double") / (F.lit(float(share[1])) * F.sum(free).over(every).cast("double"))))
    rate = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.col("target") / F.col("source_size").cast("double"))
    return per.select("source", "source_size", "target", rate.alias("rate"))


def _with(rows: DataFrame, plan: DataFrame, *columns: str) -> DataFrame:
    """The plan's columns beside each row; a broadcast if the number of sources allows it, else a join that AQE splits."""
    named = plan.select(F.col("source").alias("_source"), *columns)
    return rows.join(small(named), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")


def plan(sizes: DataFrame, weights=WEIGHTS) -> DataFrame:
    """One row for each source: source_size, target, rate, and the seed k whose copies come nearest to the target."""
    per = keep(targets(sizes, weights), "mix-targets")
    fraction = F.col("rate") - _whole()
    taken = [F.sum(F.col("size") * (_whole() + (_u(k) < fraction).cast("long"))).alias(f"t{k}") for k in range(SEEDS)]
    seen = _with(sizes, per, "target", "rate").groupBy("source").agg(F.first("target").alias("target"), *taken)
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"t{k}").cast("double") - F.col("target")).alias("off"), F.lit(k).alias("k")) for k in range(SEEDS)]))
    chosen = seen.select(F.col("source").alias("_source"), best["k"].alias("k"))
    return keep(per.join(chosen, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source"), "mix-plan")


def copies(rows: DataFrame, mix: DataFrame) -> DataFrame:
    """rows with source_size, target and copies, the number of times that the mix takes each."""
    named = _with(rows, mix, "source_size", "target", "rate", "k")
    chance = F.lit(2.0)
    for k in reversed(range(SEEDS)):
        chance = F.when(F.col("k") == k, _u(k)).otherwise(chance)
    return named.withColumn("copies", _whole() + (chance < F.col("rate") - _whole()).cast("long")).drop("rate", "k")


def sizes_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))


def mix(docs: DataFrame, weights=WEIGHTS) -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it, with the columns of docs."""
    made = plan(keep(sizes_of(docs), "mix-sizes"), weights)
    names = docs.columns
    inner = docs.select(F.struct(*names).alias("row"), "doc_id", "source")
    return copies(inner, made).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def op5_mix(spark, sf_dir: str) -> DataFrame:
    sizes = keep(sizes_of(read(spark, sf_dir, "documents")), "mix-sizes")
    got = copies(sizes, plan(sizes))
    return got.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


_HEX = " + ".join(f"(instr('0123456789abcdef', substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1 + k + {i}, 1)) - 1)::BIGINT * {16 ** (12 - i)}" for i in range(13))

OP5_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS w, source_size * 4 AS cap FROM s),
c AS (SELECT *, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS left_w, sum(source_size) OVER () * 3 - coalesce(sum(cap) OVER b, 0) AS rest
      FROM w WINDOW b AS (ORDER BY cap::DOUBLE / w::DOUBLE ASC, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, cap * left_w <= rest * w AS capped FROM c),
t AS (SELECT source, source_size,
      CASE WHEN capped THEN (source_size * 2)::DOUBLE
           ELSE w::DOUBLE * (sum(source_size) OVER () * 3 - coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0))::DOUBLE
                / (2.0::DOUBLE * (sum(CASE WHEN NOT capped THEN w END) OVER ())::DOUBLE) END AS target FROM m),
r AS (SELECT *, CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE target / source_size::DOUBLE END AS rate FROM t),
e AS (SELECT d.doc_id, d.size, r.source, r.source_size, r.target, k,
      (floor(rate)::BIGINT + (({_HEX})::DOUBLE / 4503599627370496.0::DOUBLE < rate - floor(rate))::BIGINT) * size AS taken
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source, range({SEEDS}) g(k)),
b AS (SELECT source, k, row_number() OVER (PARTITION BY source ORDER BY abs(sum(taken)::DOUBLE - any_value(target)), k) AS n FROM e GROUP BY source, k)
SELECT e.doc_id, e.size, e.source_size, e.target, e.taken FROM e JOIN b ON e.source IS NOT DISTINCT FROM b.source AND e.k = b.k WHERE b.n = 1
"""

QUERIES = {"op5_mix": op5_mix}
ORACLE = {"op5_mix": OP5_SQL}
