"""Queries over files that are written and read back, over gates and histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrid import schemas
from evalgrid.functions import parsing, verdicts
from evalgrid.operators import audit, checks, gates, generations, ledger, pairs, rank, requests
from evalgrid.plans import run_queries, views
from evalgrid.plans import vendor_text as texts
from evalgrid.plans.registry import query
from evalgrid.plans.views import table
from evalgrid.session import scratch_path, slices
from evalgrid.sources import bank, batch_files, files, judge_files, scores
from evalgrid.sources import ledger as runs

_MODEL_ROWS = """select 'c' || c_custkey as name, case when c_custkey % 3 = 0 then 'Customer ' || c_custkey end as label,
  'vendor-' || (2015 + c_custkey % 10) || '-0' || (1 + c_custkey % 9) || '-15' as id, c_acctbal as price_in from customer"""


@query(f"""select name, coalesce(label, name) as label, id, price_in,
  regexp_extract(id, '[0-9-]+$')[2:] as released from ({_MODEL_ROWS})""")
def registry_read(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as a registry of models, written as lines and read back."""
    key = F.col("c_custkey")
    models = table(spark, folder, "customer").select(
        F.concat(F.lit("c"), key.cast("string")).alias("name"),
        F.when(key % 3 == 0, F.concat(F.lit("Customer "), key.cast("string"))).alias("label"),
        F.concat_ws("-", F.lit("vendor"), (key % 10 + 2015).cast("string"), F.concat(F.lit("0"), (key % 9 + 1).cast("string")), F.lit("15")).alias("id"),
        F.col("c_acctbal").alias("price_in"),
    )
    path = scratch_path(spark, "registry")
    models.write.json(path)
    return bank.read_models(spark, path).select("name", "label", "id", "price_in", "released")


@query("select cast(s_suppkey as varchar) as id, 'restraint' as type, s_name as prompt, 1 as n_features from supplier where s_acctbal >= 0")
def cases_read(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as cases, a document each; those without an id are left out."""
    rows = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("part"),
        F.when(F.col("s_acctbal") >= 0, F.col("s_suppkey").cast("string")).alias("id"),
        F.lit("restraint").alias("type"),
        F.col("s_name").alias("prompt"),
        F.array(F.struct(F.lit("f").alias("id"), F.lit("F").alias("label"))).alias("features"),
    )
    path = scratch_path(spark, "cases")
    named = rows.select(F.concat(F.col("part").cast("string"), F.lit(".json")).alias("name"), F.to_json(F.struct("id", "type", "prompt", "features")).alias("value"))
    files.write_named(named.repartition(slices(spark), "name"), path)
    return bank.read_cases(spark, path).select("id", "type", "prompt", F.size("features").alias("n_features"))


@query("select event_type, count(*) as n_lines, cast(sum(length(props)) as bigint) as n_chars from events group by all")
def result_lines_read(spark: SparkSession, folder: str) -> DataFrame:
    """Event properties as result and error files with blank lines between."""
    events = table(spark, folder, "events").select("event_id", F.concat_ws("\t", "event_type", "props").alias("value"))
    paths = [scratch_path(spark, "results"), scratch_path(spark, "errors")]
    for part, path in enumerate(paths):
        lines = events.filter(F.col("event_id") % 2 == part).select(F.explode(F.array("value", F.lit("  "))).alias("value"))
        lines.write.text(path)
    read = batch_files.read_result_lines(spark, *paths)
    kind, props = F.substring_index("value", "\t", 1), F.substring_index("value", "\t", -1)
    return read.groupBy(kind.alias("event_type")).agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length(props)).cast("bigint").alias("n_chars"))


@query("""select 'ja_' || o_orderkey as audit_id, o_totalprice > 200000 as overstrict, o_clerk as rationale from
  (select o_orderkey, o_totalprice, case when o_orderkey % 4 = 0 then null else o_orderpriority end as o_clerk from orders)""")
def judge_records_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Judge records as lines and back; absent values stay absent."""
    orders = table(spark, folder, "orders").select(
        F.concat(F.lit("ja_"), F.col("o_orderkey").cast("string")).alias("audit_id"),
        (F.col("o_totalprice") > 200000).alias("overstrict"),
        F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).alias("rationale"),
    )
    path = scratch_path(spark, "records")
    judge_files.write_lines(orders, path)
    return judge_files.read_records(spark, path, schemas.ddl(schemas.JUDGMENT)).select("audit_id", "overstrict", "rationale")


@query("""select o_orderkey % 5 = 0 as unreadable, case when o_orderkey % 5 = 0 then 'no parseable audit record'
    when o_orderkey % 7 = 0 and o_orderstatus <> 'F' then 'non-keep action requires rationale' else 'ok' end as errors, count(*) as n
  from orders where o_orderkey % 5 = 0 or (o_orderkey % 7 = 0 and o_orderstatus <> 'F') group by all""")
def judge_file_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Every bad line of a judge file: cut lines, and calls without a reason."""
    orders = table(spark, folder, "orders")
    number = F.col("o_orderkey")
    record = F.to_json(F.struct(
        F.concat(F.lit("ja_"), number.cast("string")).alias("audit_id"),
        F.when(F.col("o_orderstatus") == "F", "keep").otherwise("edit_key").alias("recommended_action"),
        F.when(number % 7 == 0, "").otherwise("why").alias("rationale"),
        F.lit("judge").alias("judge_model"),
    ))
    lines = orders.select(F.when(number % 5 == 0, F.left(record, F.lit(20))).otherwise(record).alias("value"))
    bad = audit.file_errors(lines, texts.seeds(orders))
    return bad.groupBy(F.col("value").isNotNull().alias("unreadable"), F.array_join("errors", "|").alias("errors")).agg(F.count(F.lit(1)).alias("n"))


@query("""select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by d nulls first, o_orderkey) - 1 as occurrence
  from (select o_custkey % 3 as o_custkey, o_orderkey, case when o_orderkey % 10 <> 0 then epoch(o_orderdate)::bigint end as d from orders)""")
def occurrence_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of three hot keys in order of dates, some of them absent."""
    orders = table(spark, folder, "orders").select(
        (F.col("o_custkey") % 3).alias("o_custkey"), "o_orderkey",
        F.when(F.col("o_orderkey") % 10 != 0, F.unix_timestamp("o_orderdate")).alias("d"),
    )
    return audit.with_occurrence(orders, ["o_custkey"], "d", ["o_orderkey"]).select("o_custkey", "o_orderkey", "occurrence")


# c_at, s_at: where the values begin in the text that the query below makes
_ORDER_CUT = """with o as (select o_orderkey, o_orderpriority as p, cast(o_custkey as varchar) as c, o_orderstatus as s from orders),
t as (select *, 13 + length(p) + 7 as c_at, 13 + length(p) + 7 + length(c) + 19 as s_at from o),
cut as (select *, 1 + (o_orderkey * 7 + 3) % (s_at + length(s) + 16) as n from t)"""


@query(_ORDER_CUT + """ select o_orderkey, case when n >= 13 then rtrim(left(p, cast(n - 13 as int))) end as priority,
  case when n > c_at then cast(left(c, cast(n - c_at as int)) as bigint) end as customer,
  case when n >= s_at then left(s, cast(n - s_at as int)) end as status from cut""")
def json_salvage(spark: SparkSession, folder: str) -> DataFrame:
    """Every order as an answer cut somewhere; what stood before the cut is kept.

    Blanks at the end of an answer are trimmed before anything else.
    """
    fields = F.struct(
        F.col("o_orderpriority").alias("priority"),
        F.col("o_custkey").alias("by"),
        F.array(F.struct(F.col("o_orderstatus").alias("state"), F.lit("a, {b").alias("w"))).alias("list"),
    )
    # dealt anew: reading rows costs far less than repairing them, and a file may be one piece
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_custkey", "o_orderstatus")
    texts_ = orders.repartition(slices(spark), "o_orderkey").select("o_orderkey", F.to_json(fields).alias("whole"))
    n = F.lit(1) + (F.col("o_orderkey") * 7 + 3) % F.length("whole")
    parsed = parsing.parse_objects(texts_.select("o_orderkey", F.left("whole", n.cast("int")).alias("text")))
    return parsed.select(
        "o_orderkey",
        F.try_variant_get("parsed", "$.priority", "string").alias("priority"),
        F.try_variant_get("parsed", "$.by", "bigint").alias("customer"),
        F.try_variant_get("parsed", "$.list[0].state", "string").alias("status"),
    )


@query("with" + views.SCORES + """
select model, count(*) as n, cast(sum(case when correct then 1 else 0 end) as bigint) as n_correct, sum(weight) as weight
from scores_v group by all""")
def audit_trail(spark: SparkSession, folder: str) -> DataFrame:
    """All graded rows as CSV and back."""
    path = scratch_path(spark, "trail")
    scores.write_audit_trail(views.scores(spark, folder), path)
    kinds = "model string, item string, dimension string, sub string, correct int, weight double"
    read = spark.read.schema(kinds).option("header", True).csv(path)
    return read.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum("correct").alias("n_correct"), F.sum("weight").alias("weight"))


@query("""select 'm' || (o_custkey % 5) as model, case when o_orderkey % 2 = 0 then 1 else 2 end as stage, count(*) as n_lines,
  count(distinct o_orderkey) as n_ids from orders group by all""")
def request_files(spark: SparkSession, folder: str) -> DataFrame:
    """Requests and their manifest by model and stage, written and read back."""
    made = table(spark, folder, "orders").select(
        F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("custom_id"),
        F.concat(F.lit("m"), (F.col("o_custkey") % 5).cast("string")).alias("model"),
        F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(2).alias("stage"),
        F.lit("id").alias("model_id"),
        F.array(F.struct(F.lit("user").alias("role"), F.col("o_orderpriority").alias("content"))).alias("messages"),
        F.lit(64).alias("max_tokens"),
    )
    lines, asked = scratch_path(spark, "requests"), scratch_path(spark, "manifest")
    batch_files.write_requests(made, lines)
    batch_files.write_manifest(made, asked)
    sent = batch_files.read_request_lines(spark, lines).select("model", F.get_json_object("value", "$.custom_id").alias("custom_id"))
    joined = sent.join(batch_files.read_manifest(spark, asked).select("model", "stage", "custom_id"), ["model", "custom_id"])
    return joined.groupBy("model", "stage").agg(F.count(F.lit(1)).alias("n_lines"), F.countDistinct("custom_id").alias("n_ids"))


@query("""select 'r' || (user_id % 4) as run_id, event_type as model, count(*) as calls, round(sum(value), 4) as spent
  from events group by all""")
def cost_store(spark: SparkSession, folder: str) -> DataFrame:
    """Cost sums stored by run and model; a second write replaces its run only."""
    events = table(spark, folder, "events").withColumn("run_id", F.concat(F.lit("r"), (F.col("user_id") % 4).cast("string")))
    sums = events.groupBy("run_id", F.col("event_type").alias("model")).agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 4).alias("spent"))
    path = scratch_path(spark, "costs")
    scores.write_costs(sums.withColumn("calls", F.when(F.col("run_id") == "r1", 0).otherwise(F.col("calls"))), path)
    scores.write_costs(sums.filter("run_id = 'r1'"), path)
    return spark.read.parquet(path).select("run_id", "model", "calls", "spent")


_RUN_ROWS = "select strftime(o_orderdate, '%Y-%m') as run_id, 'm' || (o_custkey % 5) as model, round(avg(o_totalprice), 2) as score from orders group by all"


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").groupBy(
        F.date_format("o_orderdate", "yyyy-MM").alias("run_id"), F.concat(F.lit("m"), (F.col("o_custkey") % 5).cast("string")).alias("model")
    ).agg(F.round(F.avg("o_totalprice"), 2).alias("score"))


@query(_RUN_ROWS)
def run_store(spark: SparkSession, folder: str) -> DataFrame:
    """Runs stored by id; storing a year again replaces its runs."""
    path, made = scratch_path(spark, "runs"), _runs(spark, folder)
    late = F.col("run_id") >= "1996"
    runs.write_runs(made.withColumn("score", F.when(late, 0.0).otherwise(F.col("score"))), path)
    runs.write_runs(made.filter(late), path)
    return runs.read_runs(spark, path).select(F.col("run_id").cast("string").alias("run_id"), "model", "score")


@query(f"""with r as ({_RUN_ROWS})
select run_id, model, case when run_id < '1995' then score when model in ('m0', 'm1') then score + 1 else score end as score from r""")
def run_upsert(spark: SparkSession, folder: str) -> DataFrame:
    """Later models folded into stored runs by run and model."""
    made = _runs(spark, folder)
    new = made.filter(F.col("run_id") >= "1995").filter(F.col("model").isin("m0", "m1")).withColumn("score", F.col("score") + 1)
    return ledger.upsert(made, new, ["run_id", "model"])


@query("with" + views.SCORES + """
select model, count(*) as n from scores_v where not contains(model, 'naive') group by all""")
def merge_of_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs with different models as one board, baselines dropped."""
    rows = views.scores(spark, folder)
    odd = F.col("model").isin("m1", "m3", "m5")
    parts = [rows.filter(odd).withColumn("run_id", F.lit("first")), rows.filter(~odd).withColumn("run_id", F.lit("second"))]
    return ledger.merge_runs(*parts).groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@query("""select cast(p_partkey as varchar) as id, p_brand as brand, p_type as key_type, p_size as key_size,
  n as n_sold from part join (select l_partkey, count(*) as n from lineitem group by all) on l_partkey = p_partkey""")
def attached_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Parts that were sold as cases, each with the key that belongs to it."""
    parts = table(spark, folder, "part")
    sold = table(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n_sold"))
    cases = parts.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("brand"))
    cases = cases.join(sold.select(F.col("p_partkey").cast("string").alias("id")), "id", "left_semi")
    keys = parts.join(sold, "p_partkey").select(F.col("p_partkey").cast("string").alias("id"), "p_type", "p_size", "n_sold")
    attached = checks.attach_keys(cases, keys)
    return attached.select("id", "brand", F.col("key.p_type").alias("key_type"), F.col("key.p_size").alias("key_size"), "key.n_sold")


_BOARD = """with b as (select 'm' || (l_suppkey % 40) as model, avg(l_quantity) as score, l_suppkey % 40 = 7 as is_baseline,
  l_suppkey % 40 % 3 > 0 as ranked_eligible from lineitem group by all)"""


def _board(spark: SparkSession, folder: str) -> DataFrame:
    number = F.col("l_suppkey") % 40
    return table(spark, folder, "lineitem").groupBy(number.alias("k")).agg(F.avg("l_quantity").alias("score")).select(
        F.concat(F.lit("m"), F.col("k").cast("string")).alias("model"), "score", (F.col("k") == 7).alias("is_baseline"),
        (F.col("k") % 3 > 0).alias("ranked_eligible"),
    )


@query(_BOARD + """ select model, row_number() over (order by is_baseline, not is_baseline and not ranked_eligible, score desc, model) as place from b""")
def display_order(spark: SparkSession, folder: str) -> DataFrame:
    """Where each model stands on the displayed board."""
    return rank.places(_board(spark, folder)).select("model", "place")


@query(_BOARD + " select model, round(score, 4) as value, round(score - 1, 4) as lo, round(score + 1, 4) as hi from b")
def score_triples(spark: SparkSession, folder: str) -> DataFrame:
    """Scores with their intervals as stored boards keep them."""
    triple = verdicts.triple(F.col("score"), F.col("score") - 1, F.col("score") + 1)
    return _board(spark, folder).select("model", triple.alias("s")).select("model", "s.*")


_DUELS = """with d as (select 'm' || (l_suppkey % 20) as a, 'm' || (20 + l_partkey % 20) as b, avg(l_discount) - avg(l_tax) as diff from lineitem group by all),
w as (select *, case when diff > 0.012 then a when diff < 0.008 then b end as winner from d),
v as (select a as model, winner from w union all select b, winner from w),
n as (select model, count(*) filter (where winner = model) as wins, count(*) as compared from v group by all)"""


@query(_DUELS + " select max(wins) as best, cast(sum(wins) as bigint) as decisive from n")
def best_duels(spark: SparkSession, folder: str) -> DataFrame:
    """The most decisive wins of any model, and all decisive wins."""
    duels = table(spark, folder, "lineitem").groupBy(
        F.concat(F.lit("m"), (F.col("l_suppkey") % 20).cast("string")).alias("a"),
        F.concat(F.lit("m"), (F.col("l_partkey") % 20 + 20).cast("string")).alias("b"),
    ).agg((F.avg("l_discount") - F.avg("l_tax")).alias("diff"))
    winner = F.when(F.col("diff") > 0.012, F.col("a")).when(F.col("diff") < 0.008, F.col("b"))
    records = duels.select("a", "b", "diff", F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"), winner.alias("winner"))
    return pairs.best_record(pairs.wins(records)).select("best", "decisive")


@query("""with l as (select cast(p_partkey as varchar) as model, lower(p_name) || case when p_partkey % 3 = 0 then ' pro' else '' end as family,
  case when p_partkey % 7 = 0 then null when p_partkey % 2 = 0 then [p_size::bigint, p_partkey % 10] else [p_size::bigint] end as version from part),
n as (select family, max(version) as top from l where version is not null group by all),
s as (select model from l join n using (family) where n.top > l.version)
select model in (select model from s) as previous, count(*) as n from l group by all""")
def generation_split(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as models: how many are current and how many have a successor."""
    board = run_queries._labelled_parts(spark, folder).withColumns(
        {"superseded_by": F.lit(None).cast("string"), "is_baseline": F.lit(False), "ranked_eligible": F.lit(True)}
    )
    current, previous = generations.split(board)
    return current.select(F.lit(False).alias("previous")).union(previous.select(F.lit(True))).groupBy("previous").agg(F.count(F.lit(1)).alias("n"))


@query("""select (select count(*) from (select c_custkey as k from customer where c_acctbal > 0 except select c_custkey from customer)) = 0
   and (select count(*) from customer where c_acctbal > 0) > 0
   and (select count(*) from customer where not c_acctbal > 0) > 0 as subset""")
def subset_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the customers in credit are a strict part of all customers."""
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("model"), "c_acctbal")
    return gates.subset_row(customers.filter("c_acctbal > 0"), customers)


@query("""select outcome, count(*) as n from (select case when event_id % 11 = 0 then 'unreadable' when event_id % 5 = 0 then 'unknown' else 'merged' end as outcome
  from events) group by all""")
def staged_results(spark: SparkSession, folder: str) -> DataFrame:
    """Results of ids that were asked in two stages, with cut and unknown lines."""
    events = table(spark, folder, "events").select("event_id")
    name = F.concat(F.lit("e"), F.col("event_id").cast("string"))
    line = F.to_json(F.struct(name.alias("custom_id"), F.struct(
        F.lit(200).alias("status_code"),
        F.struct(F.lit("yes").alias("output_text"), F.struct(F.lit(1).alias("input_tokens")).alias("usage")).alias("body"),
    ).alias("response")))
    lines = events.select(F.when(F.col("event_id") % 11 == 0, F.left(line, F.lit(12))).otherwise(line).alias("value"))
    asked = events.filter("event_id % 5 <> 0").select(
        name.alias("custom_id"), F.lit("r").alias("run_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("stage"), F.lit("i").alias("item"),
        F.lit(0).cast("bigint").alias("generation"), F.lit("response").alias("turn_id"), F.lit("restraint").alias("schema"),
        F.lit("openai").alias("provider"), F.lit("m").alias("model"), F.lit("id").alias("model_id"),
        *[F.lit(0.0).alias(c) for c in ("price_in", "price_out", "price_cached_in", "batch_discount")],
    )
    return requests.normalize_results(lines, asked).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))
