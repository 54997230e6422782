"""The given tables seen as evaluation data, in Spark and as SQL.

Nothing is sampled: every row of a table takes part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scores(spark: SparkSession, folder: str, *extra: str) -> DataFrame:
    """Every line item as one graded check of one of eight models.

    The last model is a baseline; a few items are examples; two groups of
    checks are dead, always passed or always failed.
    """
    model, item, line = F.col("l_suppkey") % 8, F.col("l_partkey") % 45, F.col("l_linenumber")
    passed = (
        F.when((line == 7) & (item < 9), True)
        .when((line == 6) & (item >= 36), False)
        .otherwise(F.col("l_quantity") > 8 + 3 * model + 2 * (item % 3))
    )
    return table(spark, folder, "lineitem").select(
        F.date_format("l_shipdate", "yyyy-MM-01").alias("run_id"),
        F.concat(F.lit("m"), model.cast("string"), F.when(model == 7, "-naive").otherwise("")).alias("model"),
        F.concat(
            F.when(item < 5, "example_").otherwise(""), F.lit("i"), F.lpad(item.cast("string"), 2, "0")
        ).alias("item"),
        F.when(item % 3 == 0, "restraint").when(item % 3 == 1, "honesty").otherwise("conviction").alias("dimension"),
        F.concat(F.lit("s"), line.cast("string")).alias("sub"),
        F.col("l_orderkey").alias("generation"),
        passed.alias("correct"),
        F.when(line % 3 == 0, 2.0).otherwise(1.0).alias("weight"),
        *extra,
    )


def scores_sql(*extra: str) -> str:
    """The same as a SQL table expression."""
    return _SCORES.replace("/*extra*/", "".join(f", {c}" for c in extra))


_SCORES = """
scores_v as (
  select strftime(l_shipdate, '%Y-%m-01') as run_id,
         'm' || (l_suppkey % 8) || case when l_suppkey % 8 = 7 then '-naive' else '' end as model,
         case when l_partkey % 45 < 5 then 'example_' else '' end
           || 'i' || lpad(cast(l_partkey % 45 as varchar), 2, '0') as item,
         case l_partkey % 45 % 3 when 0 then 'restraint' when 1 then 'honesty' else 'conviction' end as dimension,
         's' || l_linenumber as sub,
         l_orderkey as generation,
         case when l_linenumber = 7 and l_partkey % 45 < 9 then true
              when l_linenumber = 6 and l_partkey % 45 >= 36 then false
              else l_quantity > 8 + 3 * (l_suppkey % 8) + 2 * (l_partkey % 45 % 3) end as correct,
         case when l_linenumber % 3 = 0 then 2.0e0 else 1.0e0 end as weight /*extra*/
  from lineitem)"""
SCORES = scores_sql()

SUMS = SCORES + """,
sums as (
  select model, dimension, item, sub, count(*) as n, count(*) filter (where correct) as n_correct,
         sum(weight) as den, sum(case when correct then weight else 0 end) as num
  from scores_v group by all),
dims as (select model, dimension, sum(num) / sum(den) as value from sums group by all),
points as (select model, avg(value) * 100 as score from dims group by all),
clusters as (select model, dimension, item, sum(den) as den, sum(num) as num from sums group by all)"""


def expected_checks(spark: SparkSession, folder: str) -> DataFrame:
    """The bank behind ``scores``: seven checks for every item a part maps to."""
    item = F.col("p_partkey") % 45
    items = table(spark, folder, "part").select(item.alias("n")).distinct()
    return items.select(
        F.concat(
            F.when(F.col("n") < 5, "example_").otherwise(""), F.lit("i"), F.lpad(F.col("n").cast("string"), 2, "0")
        ).alias("item"),
        F.when(F.col("n") % 3 == 0, "restraint").when(F.col("n") % 3 == 1, "honesty").otherwise("conviction").alias("dimension"),
        F.explode(F.transform(F.sequence(F.lit(1), F.lit(7)), lambda s: F.concat(F.lit("s"), s.cast("string")))).alias("sub"),
    )


EXPECTED = """
expected as (
  select case when n < 5 then 'example_' else '' end || 'i' || lpad(cast(n as varchar), 2, '0') as item,
         case n % 3 when 0 then 'restraint' when 1 then 'honesty' else 'conviction' end as dimension,
         's' || unnest(range(1, 8)) as sub
  from (select distinct p_partkey % 45 as n from part))"""

#: The registry that goes with ``scores``: (name, provider, id, label, price_in,
#: price_out, price_cached_in, batch_discount, batch_supported, superseded_by).
REGISTRY = [
    ("m0", "openai", "orion-3-2026-03-05", "Orion 3", 2.0, 8.0, None, 0.5, True, None),
    ("m1", "openai", "orion-2.5-20251101", "Orion 2.5", 1.0, 4.0, None, 0.5, True, None),
    ("m2", "anthropic", "lyra-k2", "Lyra K2", 3.0, 15.0, None, 0.5, True, None),
    ("m3", "google", "orion-mini-1", "Orion Mini 1", 1.0, 2.0, None, 0.5, True, None),
    ("m4", "anthropic", "lyra-k1-5", "Lyra K1.5", 3.0, 12.0, None, 0.5, True, None),
    ("m5", "google", "vega-2026-01-15", "Vega", None, None, None, 0.5, True, None),
    ("m6", "direct", "vega-pro", "Vega Pro", 5.0, 10.0, 1.0, None, False, "m0"),
    ("m7-naive", "mock", "naive", None, None, None, None, None, None, None),
]
_REGISTRY_COLUMNS = (
    "name", "provider", "id", "label", "price_in", "price_out", "price_cached_in", "batch_discount",
    "batch_supported", "superseded_by",
)


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        REGISTRY,
        "name string, provider string, id string, label string, price_in double, price_out double, "
        "price_cached_in double, batch_discount double, batch_supported boolean, superseded_by string",
    )


def _literal(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, float):
        return f"{value}e0"  # a double, not a decimal
    return f"'{value}'" if isinstance(value, str) else str(value).lower()


REGISTRY_SQL = (
    "registry as (select * from (values "
    + ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in REGISTRY)
    + f") t({', '.join(_REGISTRY_COLUMNS)}))"
)
