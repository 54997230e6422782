"""Queries over a run on its way to publication: completeness, gates, stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrid.operators import bank, coverage
from evalgrid.plans import views
from evalgrid.plans.registry import query
from evalgrid.plans.views import table
from evalgrid.session import cut, scratch_path
from evalgrid.sources import ledger as runs

#: Generations that every model but the mock ones owes in the run below.
_OWED = 2

# A run of every supplier as a model over the items of the bank. Some models
# have saved scores that were changed, renamed, cut or lost; some are unknown.
_RUN = "with" + views.EXPECTED + f""",
resp as (select 'v' || l_suppkey as model, l_suppkey as k,
           case when l_partkey % 45 < 5 then 'example_' else '' end || 'i' || lpad(cast(l_partkey % 45 as varchar), 2, '0') as item,
           l_orderkey % {_OWED} + case when l_suppkey % 11 = 4 and l_orderkey % 97 = 0 then {_OWED} else 0 end as generation,
           cast(sum(l_quantity) as bigint) as q from lineitem group by all),
graded as (select model, k, item, generation, dimension, sub, (q + cast(sub[2:] as bigint)) % 3 <> 0 as correct, 1.0e0 as weight
           from resp join expected using (item)),
saved as (select model, item, generation, dimension, case when k % 11 = 5 and item = 'i10' then 's9' else sub end as sub,
            correct <> (k % 11 = 1 and sub = 's3' and generation = 0) as correct, weight
          from graded where k % 11 <> 3 and not (k % 11 = 2 and item = 'i07' and sub = 's3')),
reg as (select 'v' || s_suppkey as model, case when s_suppkey % 17 = 0 then 1 else {_OWED} end as owed, s_acctbal >= 0 as wanted
        from supplier where s_suppkey % 13 <> 5),
size as (select count(*) as n_checks, count(distinct item) as n_items from expected),
each as (select model, item, generation, dimension, sub, count(*) as n from graded group by all),
whole as (select model, item, generation from each join (select item, count(*) as per_item from expected group by all) using (item)
          group by model, item, generation, per_item having count(*) filter (n = 1) = per_item and count(*) = per_item),
made as (select model, count(*) as n_complete from whole join reg using (model) where generation < owed group by all),
more as (select model, count(*) as n_extra from resp join reg using (model)
         where item in (select item from expected) and generation >= owed group by all),
raw as (select model, owed * n_items as n_intended, owed * n_items - coalesce(n_complete, 0) as n_incomplete, coalesce(n_extra, 0) as n_extra
        from reg left join made using (model) left join more using (model), size)"""


def _run(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the run: answers, fresh and saved grades, bank, registry."""
    k, part = F.col("l_suppkey"), F.col("l_partkey") % 45
    item = F.concat(F.when(part < 5, "example_").otherwise(""), F.lit("i"), F.lpad(part.cast("string"), 2, "0"))
    surplus = F.when((k % 11 == 4) & (F.col("l_orderkey") % 97 == 0), _OWED).otherwise(0)
    answers = table(spark, folder, "lineitem").groupBy(
        F.concat(F.lit("v"), k.cast("string")).alias("model"), k.alias("k"), item.alias("item"),
        (F.col("l_orderkey") % _OWED + surplus).cast("bigint").alias("generation"),
    ).agg(F.sum("l_quantity").cast("bigint").alias("q"))
    answers = cut(answers)
    expected = cut(views.expected_checks(spark, folder))
    kind, number = F.col("k") % 11, F.substring("sub", 2, 9).cast("bigint")
    graded = answers.join(expected, "item").select(
        "model", "k", "item", "generation", "dimension", "sub", ((F.col("q") + number) % 3 != 0).alias("correct"), F.lit(1.0).alias("weight")
    )
    lost = (kind == 2) & (F.col("item") == "i07") & (F.col("sub") == "s3")
    flipped = (kind == 1) & (F.col("sub") == "s3") & (F.col("generation") == 0)
    saved = graded.filter((kind != 3) & ~lost).select(
        "model", "item", "generation", "dimension",
        F.when((kind == 5) & (F.col("item") == "i10"), "s9").otherwise(F.col("sub")).alias("sub"),
        (F.col("correct") != flipped).alias("correct"), "weight",
    )
    supplier = F.col("s_suppkey")
    registry = table(spark, folder, "supplier").filter(supplier % 13 != 5).select(
        F.concat(F.lit("v"), supplier.cast("string")).alias("name"),
        F.when(supplier % 17 == 0, "mock").otherwise("openai").alias("provider"),
        (F.col("s_acctbal") >= 0).alias("wanted"),
    )
    return {"answers": answers, "graded": graded.drop("k"), "saved": saved, "expected": expected, "registry": registry}


@query(_RUN + " select * from raw")
def raw_completeness(spark: SparkSession, folder: str) -> DataFrame:
    """Incomplete and surplus generations of every model of the registry."""
    run = _run(spark, folder)
    owed = F.when(F.col("provider") == "mock", 1).otherwise(_OWED).cast("bigint")
    roster = run["registry"].select(F.col("name").alias("model"), owed.alias("generations"))
    return coverage.generation_counts(run["answers"], run["graded"], run["expected"], roster)


@query(_RUN + """,
present as (select model, count(*) as n_atomic from saved group by all),
rated as (select * from reg join present using (model)),
sums as (select model, owed, item, dimension, sub, count(*) as n from saved join rated using (model) group by all),
cov as (select model, count(*) filter (where e.item is not null and n = owed) as n_exact,
          count(*) filter (where e.item is null) as n_unexpected, count(distinct dimension) as spans
        from sums left join (select item, dimension, sub from expected) e using (item, dimension, sub) group by all),
diff as (select model, count(*) as n from (
           select model, item, dimension, sub, correct, weight, sum(side) as excess from (
             select model, item, dimension, sub, correct, weight, 1 as side from saved
             union all select model, item, dimension, sub, correct, weight, -1 from graded) group by all)
         where excess <> 0 group by all)
select model, 'score file missing' as error, 1 as n from reg where wanted and model not in (select model from present)
union all select model, 'scores of an unknown model', 1 from present where model not in (select model from reg)
union all select model, 'score coverage incomplete', n_atomic from cov join present using (model), size
  where n_exact <> n_checks or n_unexpected > 0 or spans < 3
union all select model, 'raw generations incomplete', n_incomplete from raw join rated using (model) where n_incomplete > 0
union all select model, 'raw generations unexpected', n_extra from raw join rated using (model) where n_extra > 0
union all select model, 'saved scores do not match regrade', n from diff join rated using (model) join raw using (model)
  where n_incomplete <= 0 and n_extra = 0
union all select '', 'saved evaluation fingerprint does not match', 1""")
def publication_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Every reason against publishing the run, of all its models at once."""
    run = _run(spark, folder)
    requested = run["registry"].filter("wanted").select(F.col("name").alias("model"))
    hashes = table(spark, folder, "region").limit(1)
    recorded = hashes.select(F.lit("all").alias("scope"), F.lit("h0").alias("evaluation_hash"))
    current = hashes.select(F.lit("all").alias("scope"), F.lit("h1").alias("evaluation_hash"))
    return coverage.completeness_errors(
        requested, run["registry"], run["answers"], run["saved"], run["graded"], run["expected"], _OWED,
        recorded=recorded, current=current,
    )


@query(_RUN + """
select model, 'unknown requested model' as error, 1 as n from (select distinct 'v' || l_suppkey as model from lineitem)
where model not in (select model from reg)""")
def publication_audit_unknown(spark: SparkSession, folder: str) -> DataFrame:
    """The same run when models are asked for that the registry lacks."""
    run = _run(spark, folder)
    requested = run["answers"].select("model").distinct()
    return coverage.completeness_errors(requested, run["registry"], run["answers"], run["saved"], run["graded"], run["expected"], _OWED)


_PAIR_ROWS = """select 'm' || (l_suppkey % 20) as a, 'm' || (20 + l_partkey % 20) as b, cast(sum(cast(round(l_discount * 100) as bigint) - cast(round(l_tax * 100) as bigint)) as double) / count(*) as delta,
  count(distinct l_orderkey) as n_items, case when count(*) % 3 > 0 then 'm' || (l_suppkey % 20) end as winner from lineitem group by l_suppkey % 20, l_partkey % 20"""


@query(_PAIR_ROWS)
def pair_store(spark: SparkSession, folder: str) -> DataFrame:
    """Pair records published as lines and read back; a tie has no winner."""
    left, right = F.col("l_suppkey") % 20, F.col("l_partkey") % 20 + 20
    cents = F.round(F.col("l_discount") * 100).cast("bigint") - F.round(F.col("l_tax") * 100).cast("bigint")  # sums in any order
    made = table(spark, folder, "lineitem").groupBy(
        F.concat(F.lit("m"), left.cast("string")).alias("a"), F.concat(F.lit("m"), right.cast("string")).alias("b")
    ).agg(
        (F.sum(cents).cast("double") / F.count(F.lit(1))).alias("delta"), F.countDistinct("l_orderkey").alias("n_items"),
        F.count(F.lit(1)).alias("n"),
    ).withColumn("winner", F.when(F.col("n") % 3 > 0, F.col("a"))).drop("n")
    path = scratch_path(spark, "pairs")
    runs.write_pairs(made, path)
    return runs.read_pairs(spark, path).select("a", "b", "delta", "n_items", "winner")


@query("""with c as (select p_partkey as id, case when p_partkey % 9 = 0 then 'example_' else 'p' end || p_partkey as name,
    case when p_partkey % 7 = 0 then ' ' else p_brand end as source,
    case when p_partkey % 5 = 0 then '(' || p_type || ')' else p_type end as alias from part),
n as (select l_partkey // 2 as id, count(*) as n from lineitem where l_linenumber = 1 group by all),
o as (select c.*, coalesce(n.n, 0) as n from c left join n using (id) where name[1:1] = 'p')
select 'missing_source' as finding, name as item, '' as detail from o where trim(source) = ''
union all select case when n = 0 then 'missing_provenance' else 'duplicate_provenance' end, name, '' from o where n <> 1
union all select 'unmatchable_alias', name, alias from o where alias[1:1] = '('
union all select 'signoff_pending', name, '' from o where id in (select l_suppkey from lineitem)""")
def bank_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as a bank: sources, provenance, aliases and sign-offs in one audit."""
    parts, lines = table(spark, folder, "part"), table(spark, folder, "lineitem")

    def name(number):
        return F.concat(F.when(number % 9 == 0, "example_").otherwise("p"), number.cast("string"))

    key = F.col("p_partkey")
    cases = parts.select(name(key).alias("id"), F.lit("honesty").alias("type"), F.when(key % 7 == 0, " ").otherwise(F.col("p_brand")).alias("source"))
    alias = F.when(key % 5 == 0, F.concat(F.lit("("), F.col("p_type"), F.lit(")"))).otherwise(F.col("p_type"))
    mine = F.struct(F.lit("kind").alias("id"), F.lit("").alias("why"), F.array(alias).alias("aliases"))
    keys = parts.select(
        name(key).alias("id"), F.lit("honesty").alias("type"), F.array(mine).alias("landmines"),
        F.array().cast("array<struct<id:string,why:string,aliases:array<string>>>").alias("false_alarms"),
        F.lit(None).cast("map<string,string>").alias("labels"), F.lit(None).cast("map<string,double>").alias("weights"),
        F.lit(None).cast("array<string>").alias("initial_expected"),
        F.lit(None).cast("array<struct<id:string,weight:double,pass_if_in:array<string>,strict_hold:boolean>>").alias("turns"),
    )
    noted = lines.filter("l_linenumber = 1").select(name(F.floor(F.col("l_partkey") / 2)).alias("id"))
    register = lines.select(name(F.col("l_suppkey")).alias("id")).distinct()
    return bank.audit(cases, keys, noted, register)
