"""Queries over runs: usage, settings, audits, history, banks, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrid.functions import hashing, ids, usage
from evalgrid.operators import (
    audit,
    bank,
    cost,
    gates,
    generations,
    leaks,
    ledger,
    rank,
    requests,
    scan,
    scope,
)
from evalgrid.plans import answers, views
from evalgrid.plans import vendor_text as texts
from evalgrid.plans.registry import query
from evalgrid.plans.views import table
from evalgrid.schemas import AUDIT_FLAGS
from evalgrid.session import cut, scratch_path
from evalgrid.sources import scores as score_store
from evalgrid.streaming import ingest, stages
from evalgrid.streaming.state import TurnState

# --- usage, cost and settings -------------------------------------------------

#: Vendor prices that go with the events: provider, price_in, price_out, cached.
PRICES = [("view", 1.0, 4.0, None), ("click", 2.0, 8.0, 0.5), ("purchase", 3.0, 15.0, None),
          ("signup", None, None, None), ("error", 0.5, 1.5, 0.1)]


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", "user_id", "event_type", "value", "props")


def _traces(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a call whose usage comes in its vendor's shape."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    out = F.floor(F.col("value"))
    shaped = (
        F.when(F.col("event_type") == "view", F.to_json(F.struct(
            k.alias("input_tokens"), out.alias("output_tokens"), (k + out).alias("total_tokens"))))
        .when(F.col("event_type") == "click", F.to_json(F.struct(
            k.alias("prompt_tokens"), out.alias("completion_tokens"), (k + out + F.lit(7)).alias("total_tokens"),
            F.struct(F.lit(7).alias("reasoning_tokens")).alias("completion_tokens_details"),
            F.struct(F.floor(k / 2).alias("cached_tokens")).alias("prompt_tokens_details"))))
        .when(F.col("event_type") == "purchase", F.to_json(F.struct(
            k.alias("promptTokenCount"), out.alias("candidatesTokenCount"), F.lit(3).alias("thoughtsTokenCount"))))
        .when(F.col("event_type") == "signup", F.to_json(F.struct(
            k.alias("input_tokens"), out.alias("output_tokens"),
            F.struct(F.lit(5).alias("reasoning_tokens")).alias("output_tokens_details"),
            (k + out).alias("total_tokens"))))
        .otherwise(F.to_json(F.struct(k.alias("prompt_token_count"), (k + F.lit(1)).alias("cached_input_tokens"))))
    )
    prices = spark.createDataFrame(
        PRICES, "event_type string, price_in double, price_out double, price_cached_in double"
    )
    return (
        _events(spark, folder)
        .select("event_type", "user_id", shaped.alias("raw"), out.alias("out"))
        .join(F.broadcast(prices), "event_type", "left")
        .select(
            F.col("event_type").alias("model"),
            F.when(F.col("user_id") % 2 == 0, "batch").otherwise("live").alias("run_mode"),
            usage.normalize_usage(F.try_parse_json("raw")).alias("usage"),
            "price_in", "price_out", "price_cached_in", F.lit(0.5).alias("batch_discount"),
            F.when(F.col("out") > 100, "MAX_TOKENS").when(F.col("out") > 50, "length").otherwise("stop").alias("finish_reason"),
        )
        .withColumn("cost_usd", usage.cost_usd(
            F.col("usage"), F.col("price_in"), F.col("price_out"), F.col("price_cached_in"),
            F.col("batch_discount"), F.col("run_mode")))
    )


_TRACES = """with e as (select event_type as model, case when user_id % 2 = 0 then 'batch' else 'live' end as run_mode,
    cast(props->>'$.k' as bigint) as k, cast(floor(value) as bigint) as o from events),
u as (select model, run_mode, k as input_tokens, o,
        case model when 'click' then o + 7 when 'purchase' then o + 3 when 'error' then null else o end as output_tokens,
        case model when 'view' then k + o when 'click' then k + o + 7 when 'signup' then k + o end as total_tokens,
        case model when 'click' then k // 2 when 'error' then k + 1 end as cached from e),
p as (select * from (values """ + ", ".join(
    "(" + ", ".join("null" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in PRICES
) + """) t(model, price_in, price_out, price_cached)),
c as (select u.*, round((case when price_cached is not null and cached > 0 and cached <= input_tokens
          then (input_tokens - cached) * price_in::double + cached * price_cached::double
          else input_tokens * price_in::double end + coalesce(output_tokens, 0) * price_out::double) / 1000000
        * case when run_mode = 'batch' then 0.5e0 else 1.0e0 end, 8) as cost from u join p using (model))"""


@query(_TRACES + """
select model, run_mode, count(*) as requests, cast(coalesce(sum(input_tokens), 0) as bigint) as input_tokens,
  cast(coalesce(sum(output_tokens), 0) as bigint) as output_tokens,
  cast(coalesce(sum(total_tokens), 0) as bigint) as total_tokens,
  cast(coalesce(sum(cached), 0) as bigint) as cached_input_tokens, cast(round(sum(cast(cost as decimal(28, 8))), 6) as double) as estimated_cost_usd
from c group by all""")
def usage_cost(spark: SparkSession, folder: str) -> DataFrame:
    return cost.cost_summary(_traces(spark, folder), ["model", "run_mode"])


@query(_TRACES + """ select model, case when o > 100 then 'MAX_TOKENS' else 'length' end as finish_reason, count(*) as n
from c where o > 50 group by all""")
def truncated_answers(spark: SparkSession, folder: str) -> DataFrame:
    cut_off = gates.truncated(_traces(spark, folder))
    return cut_off.groupBy("model", "finish_reason").agg(F.count(F.lit(1)).alias("n"))


@query(_TRACES + """ select model, count(*) filter (where run_mode = 'live') as n_live,
count(*) filter (where run_mode = 'batch') as n_batch, count(distinct run_mode) > 1 as mixed_modes from c group by all""")
def run_modes(spark: SparkSession, folder: str) -> DataFrame:
    return cost.run_modes(_traces(spark, folder))


def _requests(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as an archived request; a few set what they must not."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    body = (
        F.when(F.col("event_type") == "view", F.to_json(F.struct(F.struct((k * 10).alias("max_output_tokens")).alias("body"))))
        .when(F.col("event_type") == "click", F.to_json(F.struct(
            F.struct((k + 1).alias("max_tokens"), F.when(k > 90, k).alias("temperature")).alias("params"))))
        .when(F.col("event_type") == "purchase", F.to_json(F.struct(
            F.array(F.struct(F.struct(k.alias("max_completion_tokens")).alias("inner"))).alias("deep"))))
        .otherwise(F.to_json(F.struct(k.alias("max_tokens"), F.when(k < 5, "low").alias("reasoning_effort"))))
    )
    return _events(spark, folder).select(F.col("event_type").alias("model"), body.alias("value"))


_REQUESTS = "with e as (select event_type as model, cast(props->>'$.k' as bigint) as k from events)"


@query(_REQUESTS + """
select model, case when model = 'click' then 'temperature' else 'reasoning_effort' end as forbidden, count(*) as n
from e where (model = 'click' and k > 90) or (model in ('signup', 'error') and k < 5) group by all""")
def forbidden_parameters(spark: SparkSession, folder: str) -> DataFrame:
    marked = cost.with_forbidden(_requests(spark, folder)).filter("forbidden is not null")
    return marked.groupBy("model", "forbidden").agg(F.count(F.lit(1)).alias("n"))


@query(_REQUESTS + """
select model, case model when 'view' then 'max_output_tokens' when 'purchase' then 'max_completion_tokens' else 'max_tokens' end as key,
  cast(case model when 'view' then k * 10 when 'click' then k + 1 else k end as varchar) as value, count(*) as n
from e group by all""")
def token_ceilings(spark: SparkSession, folder: str) -> DataFrame:
    return cost.ceilings(_requests(spark, folder))


@query("""select s_name as name, case when s_nationkey % 3 = 0 then 'local' when s_suppkey % 2 = 0 then 'batch' else 'direct' end as route
from supplier""")
def routes(spark: SparkSession, folder: str) -> DataFrame:
    models = table(spark, folder, "supplier").select(
        F.col("s_name").alias("name"),
        F.when(F.col("s_nationkey") % 3 == 0, "mock").otherwise("vendor").alias("provider"),
        F.when(F.col("s_suppkey") % 2 == 0, True).alias("batch_supported"),
    )
    return scope.with_route(models).select("name", "route")


# --- reviews ------------------------------------------------------------------

_TIES = ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")

_NUMBERED = "with" + views.scores_sql(*_TIES) + f""",
missed as (select *, row_number() over (partition by run_id, model, item, dimension, sub
             order by generation, {", ".join(_TIES)}) - 1 as occurrence from scores_v where not correct)"""


@query(_NUMBERED + """
select 'ja_' || substr(sha1(concat_ws('|', run_id, model, item, dimension, sub, occurrence)), 1, 16) as audit_id,
  run_id, occurrence, generation, item, dimension, sub, model as graded_model, false as deterministic_correct, weight,
  'keep' as recommended_action, 'outputs/' || run_id || '/scores/' || model || '.json' as deterministic_score_pointer,
  'outputs/' || run_id || '/raw/' || model || '__' || item || '.json#' || generation as raw_output_pointer
from missed""")
def audit_seed(spark: SparkSession, folder: str) -> DataFrame:
    seeds = audit.seed_records(views.scores(spark, folder, *_TIES), ties=list(_TIES))
    return seeds.drop("judge_model", "rationale", *AUDIT_FLAGS)


def _judgments(spark: SparkSession, folder: str) -> DataFrame:
    """Every line item as a judged record."""
    flag = {name: (F.col("l_partkey") % (i + 3) == 0) for i, name in enumerate(AUDIT_FLAGS)}
    action = F.element_at(
        F.array(*[F.lit(a) for a in ("keep", "review_key", "edit_key", "pull_item", "needs_human")]),
        (F.col("l_linenumber") % 5 + 1).cast("int"),
    )
    return table(spark, folder, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").alias("audit_id"),
        F.concat(F.lit("i"), (F.col("l_partkey") % 45).cast("string")).alias("item"),
        F.concat(F.lit("m"), (F.col("l_suppkey") % 8).cast("string")).alias("graded_model"),
        F.lit("restraint").alias("dimension"),
        F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("sub"),
        (F.col("l_quantity") > 25).alias("deterministic_correct"),
        *[rule.alias(name) for name, rule in flag.items()],
        action.alias("recommended_action"),
        F.when(F.col("l_linenumber") % 5 == 0, F.lit("")).when(F.col("l_tax") == 0, F.lit("")).otherwise("why").alias("rationale"),
        F.when(F.col("l_discount") > 0, "judge").alias("judge_model"),
    )


_JUDGED = """with j as (select 'i' || (l_partkey % 45) as item, 'm' || (l_suppkey % 8) as graded_model,
    l_quantity > 25 as right_call, """ + ", ".join(
    f"l_partkey % {i + 3} = 0 as {name}" for i, name in enumerate(AUDIT_FLAGS)
) + """, (['keep', 'review_key', 'edit_key', 'pull_item', 'needs_human'])[l_linenumber % 5 + 1] as recommended_action,
    case when l_linenumber % 5 = 0 or l_tax = 0 then '' else 'why' end as rationale,
    case when l_discount > 0 then 'judge' end as judge_model from lineitem),
k as (select *, missing_acceptable_answer or overstrict or understrict or source_mismatch or not key_valid as issue from j)"""


@query(_JUDGED + """,
g as (select recommended_action as a, item as i, graded_model as m, grouping_id(recommended_action, item, graded_model) as gid,
  count(*) as records, """ + ", ".join(f"count(*) filter (where {f}) as {f}" for f in AUDIT_FLAGS) + """,
  count(*) filter (where not right_call and issue) as disputed_miss, count(*) filter (where fairness_risk) as fairness_flag,
  count(*) filter (where issue or recommended_action <> 'keep') as key_review
  from k group by grouping sets ((recommended_action), (item), (graded_model), ()))
select case gid when 3 then 'action' when 5 then 'item' when 6 then 'model' else 'all' end as facet,
  coalesce(a, i, m, '') as value, records, """ + ", ".join(AUDIT_FLAGS) + ", disputed_miss, fairness_flag, key_review from g")
def judge_summary(spark: SparkSession, folder: str) -> DataFrame:
    return audit.summarize(_judgments(spark, folder))


@query(_JUDGED + """
select array_to_string(list_filter([case when judge_model is null then 'missing judge_model' end,
         case when recommended_action <> 'keep' and rationale = '' then 'non-keep action requires rationale' end],
         lambda x: x is not null), '; ') as errors, count(*) as n from k group by all""")
def judgment_errors(spark: SparkSession, folder: str) -> DataFrame:
    checked = gates.judgment_errors(_judgments(spark, folder))
    return checked.groupBy(F.array_join("errors", "; ").alias("errors")).agg(F.count(F.lit(1)).alias("n"))


@query("""with q as (select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders)
select 'ja_' || o_orderkey as audit_id, case when o_orderkey % 3 = 0 then 'late' else 'judge' end as judge_model,
  case o_orderstatus when 'F' then 'keep' when 'O' then 'edit_key' else 'pull_item' end as recommended_action,
  o_totalprice > 200000 as overstrict, case when o_orderkey % 4 = 0 then true else false end as key_valid from q""")
def judgment_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Vendor-wrapped judge lines, read and laid over their seeds."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    merged = audit.merge_judgments(
        texts.seeds(orders), audit.read_judgments(texts.judge_lines(orders)), judge_model="late"
    )
    return merged.select("audit_id", "judge_model", "recommended_action", "overstrict", "key_valid")


@query("with" + answers.LABEL_ANSWERS + """,
misses as (select model, item, generation, sub from answers where readable and coalesce(predicted, '') <> expected),
raw as (select l_orderkey as o, count(*) as n from lineitem group by all)
select model, count(*) as n_payloads, count(raw.o) as n_with_answer from misses left join raw on raw.o = generation group by all""")
def audit_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Review payloads of missed labels with the saved answers behind them."""
    from evalgrid.operators import checks, grade
    from evalgrid.plans.grade_queries import _full

    responses = cut(answers.label_responses(spark, folder))  # graded, and joined to their records
    graded = grade.grade(responses, checks.checks_from_keys(_full(answers.label_keys(spark, folder))))
    payloads = audit.request_payloads(audit.seed_records(graded), responses)
    return payloads.groupBy(F.col("graded_model").alias("model")).agg(
        F.count(F.lit(1)).alias("n_payloads"), F.count("saved_model_output").alias("n_with_answer")
    )


# --- labels, dates and history --------------------------------------------------


@query("""with l as (select p_name, p_size, p_partkey % 10 as minor, p_partkey from part),
v as (select p_partkey, lower(p_name) || case when p_partkey % 3 = 0 then ' pro' else '' end as family,
        case when p_partkey % 7 = 0 then null when p_partkey % 2 = 0 then [p_size::bigint, minor] else [p_size::bigint] end as version from l)
select cast(p_partkey as varchar) as model, family, array_to_string(version, '.') as version from v""")
def lineage(spark: SparkSession, folder: str) -> DataFrame:
    named = generations.with_lineage(_labelled_parts(spark, folder))
    return named.select("model", "family", F.array_join(F.transform("version", lambda v: v.cast("string")), ".").alias("version"))


def _labelled_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Every part as a model whose label carries a version, or none."""
    number = F.col("p_partkey")
    version = (
        F.when(number % 7 == 0, "")
        .when(number % 2 == 0, F.concat_ws(".", F.col("p_size").cast("string"), (number % 10).cast("string")))
        .otherwise(F.concat(F.lit("K"), F.col("p_size").cast("string")))
    )
    spaced = F.when(number % 5 == 0, F.regexp_replace(F.initcap("p_name"), " ", "-")).otherwise(F.initcap("p_name"))
    label = F.concat(spaced, F.lit(" "), version, F.when(number % 3 == 0, " Pro").otherwise(""))
    return table(spark, folder, "part").select(number.cast("string").alias("model"), label.alias("label"))


@query("""with l as (select cast(p_partkey as varchar) as model, lower(p_name) || case when p_partkey % 3 = 0 then ' pro' else '' end as family,
  case when p_partkey % 7 = 0 then null when p_partkey % 2 = 0 then [p_size::bigint, p_partkey % 10] else [p_size::bigint] end as version,
  p_retailprice < 1500 as ranked from part),
n as (select family, max({'version': version, 'model': model}) as top from l where ranked and version is not null group by all)
select l.model, n.top.model as successor from l join n using (family) where n.top.version > l.version""")
def successions(spark: SparkSession, folder: str) -> DataFrame:
    prices = table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("model"), (F.col("p_retailprice") < 1500).alias("ranked_eligible")
    )
    board = (
        _labelled_parts(spark, folder)
        .join(prices, "model")
        .withColumn("is_baseline", F.lit(False))
        .withColumn("superseded_by", F.lit(None).cast("string"))
    )
    return generations.successions(board)


@query("""select case when o_orderkey % 2 = 0 and year(o_orderdate) >= 2000 then strftime(o_orderdate, '%Y-%m-%d') end as released,
  strftime(o_orderdate, '%Y-%m-%d') as run_date, count(*) as n from orders group by all""")
def release_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Dates inside model ids (from the year 2000 on) and run ids."""
    day = F.date_format("o_orderdate", "yyyyMMdd")
    rows = table(spark, folder, "orders").select(
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("orion-"), day)).otherwise("orion-13").alias("model_id"),
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("-rerun")).alias("run_id"),
    )
    return rows.groupBy(
        ids.released_from_id(F.col("model_id")).alias("released"), ids.run_date(F.col("run_id")).alias("run_date")
    ).agg(F.count(F.lit(1)).alias("n"))


def _order_board(spark: SparkSession, folder: str) -> DataFrame:
    """One board per month of orders, a model per customer class."""
    orders = table(spark, folder, "orders")
    model = F.concat(
        F.lit("m"), (F.col("o_custkey") % 5).cast("string"), F.when(F.col("o_custkey") % 5 == 4, "-naive").otherwise("")
    )
    return orders.groupBy(F.date_format("o_orderdate", "yyyy-MM-01").alias("run_id"), model.alias("model")).agg(
        F.round(F.avg("o_totalprice"), 6).alias("score"), F.count(F.lit(1)).alias("n")
    )


_BOARD = """with board as (select strftime(o_orderdate, '%Y-%m-01') as run_id,
  'm' || (o_custkey % 5) || case when o_custkey % 5 = 4 then '-naive' else '' end as model,
  round(avg(o_totalprice), 6) as score, count(*) as n from orders group by all)"""


@query(_BOARD + """
select run_id, arg_max(model, score) as best_model, max(score) as best_score, count(distinct model) as n_models
from board where not contains(model, 'naive') group by all""")
def run_history(spark: SparkSession, folder: str) -> DataFrame:
    return rank.best_per_run(_order_board(spark, folder))


@query(_BOARD + """,
shipped as (select strftime(l_shipdate, '%Y-%m-01') as run_id, 'shipped' as source, count(*) as n from lineitem group by all),
ordered as (select run_id, 'ordered' as source, cast(sum(n) as bigint) as n from board group by all)
select run_id, run_id as run_date, source, n from shipped
union all select run_id, run_id, source, n from ordered where run_id not in (select run_id from shipped)""")
def ledger_append(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly order runs with the months that shipping re-measured replaced."""
    old = _order_board(spark, folder).groupBy("run_id").agg(F.sum("n").alias("n"))
    new = table(spark, folder, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM-01").alias("run_id")).agg(
        F.count(F.lit(1)).alias("n")
    )
    dated = [
        t.select("run_id", ids.run_date(F.col("run_id")).alias("run_date"), F.lit(name).alias("source"), "n")
        for t, name in ((old, "ordered"), (new, "shipped"))
    ]
    return ledger.append_snapshot(*dated)


@query(_BOARD + """,
late as (select strftime(l_shipdate, '%Y-%m-01') as run_id, 'm' || (l_suppkey % 8) as model,
           round(avg(l_extendedprice), 6) as score, count(*) as n from lineitem group by all)
select * from late union all
select * from board b where not exists (select 1 from late where late.run_id = b.run_id and late.model = b.model)""")
def ledger_merge(spark: SparkSession, folder: str) -> DataFrame:
    """Late models folded into existing runs by name."""
    late = table(spark, folder, "lineitem").groupBy(
        F.date_format("l_shipdate", "yyyy-MM-01").alias("run_id"),
        F.concat(F.lit("m"), (F.col("l_suppkey") % 8).cast("string")).alias("model"),
    ).agg(F.round(F.avg("l_extendedprice"), 6).alias("score"), F.count(F.lit(1)).alias("n"))
    return ledger.upsert(_order_board(spark, folder), late, ["run_id", "model"])


@query("""select 'c' || o_custkey as model, count(distinct strftime(o_orderdate, '%Y')) as n_runs,
  min(strftime(o_orderdate, '%Y')) as first_run, max(strftime(o_orderdate, '%Y')) as last_run
from orders group by all having count(distinct strftime(o_orderdate, '%Y')) > 1""")
def models_in_several_runs(spark: SparkSession, folder: str) -> DataFrame:
    measured = table(spark, folder, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("model"),
        F.date_format("o_orderdate", "yyyy").alias("run_id"),
    )
    return gates.models_in_several_runs(measured)


@query("""with m as (select strftime(o_orderdate, '%Y-%m-01') as run_id, strftime(o_orderdate, '%Y') as bank,
  max(case when o_orderkey % 900 = 0 then 'v' || strftime(o_orderdate, '%Y') end) as version from orders group by all),
p as (select *, lag(bank) over (order by run_id) as prior from m),
e as (select *, coalesce(bank = prior, false) as same_bank from p),
g as (select *, sum(case when same_bank then 0 else 1 end) over (order by run_id) as era from e)
select run_id, version, same_bank, not same_bank and version is null as must_declare,
  last_value(version ignore nulls) over (partition by era order by run_id) as effective_version from g""")
def version_inheritance(spark: SparkSession, folder: str) -> DataFrame:
    """Monthly runs whose bank changes every year."""
    year = F.date_format("o_orderdate", "yyyy")
    runs = table(spark, folder, "orders").groupBy(
        F.date_format("o_orderdate", "yyyy-MM-01").alias("run_id"), year.alias("items_hash")
    ).agg(F.max(F.when(F.col("o_orderkey") % 900 == 0, F.concat(F.lit("v"), year))).alias("version"))
    dated = runs.select(
        "run_id", ids.run_date(F.col("run_id")).alias("run_date"), F.lit("all").alias("scope"), "version", "items_hash",
        F.lit(None).cast("string").alias("evaluation_hash"), F.lit(None).cast("string").alias("content_hash"),
    )
    return ledger.inherit_versions(dated).select(
        "run_id", "version", "same_bank", "must_declare", "effective_version"
    )


# --- banks ----------------------------------------------------------------------


@query("with" + views.EXPECTED + """
select dimension, count(distinct item) as n_items,
  'sha256:' || sha256(string_agg(distinct item, chr(10) order by item)) as items_hash from expected group by all""")
def roster_hash(spark: SparkSession, folder: str) -> DataFrame:
    return views.expected_checks(spark, folder).groupBy("dimension").agg(
        F.countDistinct("item").alias("n_items"), hashing.roster_hash(F.col("item")).alias("items_hash")
    )


@query("""with d as (select distinct sha256(s_name) as d from supplier),
b as (select count(*) as n, """ + ", ".join(
    f"cast(sum(cast('0x' || substr(d, {at}, 8) as hugeint)) as varchar) as s{at}" for at in range(1, 65, 8)) + """ from d)
select n as n_values, 'sha256:' || sha256(concat_ws(':', n, """ + ", ".join(f"s{at}" for at in range(1, 65, 8)) + """)) as fingerprint from b""")
def roster_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return hashing.set_fingerprint(table(spark, folder, "supplier"), "s_name")


@query("""select p_partkey as id, sha256('{"brand":"' || p_brand || '","id":' || p_partkey || ',"names":["' || p_name || '"],"size":{"n":'
  || p_size || '}}') as digest from part""")
def content_digests(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical digests of parts as cases; private fields do not count."""
    cases = table(spark, folder, "part").select(
        F.struct(F.col("p_size").alias("n"), F.col("p_type").alias("_type")).alias("size"),
        F.array("p_name").alias("names"),
        F.col("p_partkey").alias("id"),
        F.col("p_brand").alias("brand"),
        F.col("p_retailprice").alias("_price"),
    )
    return bank.row_digests(cases)


@query("with" + views.EXPECTED + """
select dimension, count(distinct item) as n_items, count(distinct item) filter (where starts_with(item, 'example_')) as n_examples
from expected group by all""")
def bank_dimensions(spark: SparkSession, folder: str) -> DataFrame:
    return bank.dimension_counts(views.expected_checks(spark, folder))


@query(r"""with a as (select page_id, url, lower(url) as u from pages)
select cast(page_id as varchar) as item, url as alias from a
where not regexp_matches(u, '\b' || regexp_escape(u) || '(?:s|es|d|ed|ing)?\b')""")
def unmatchable_aliases(spark: SparkSession, folder: str) -> DataFrame:
    """Page addresses as aliases that cannot match themselves."""
    from evalgrid.operators import checks

    rows = table(spark, folder, "pages").select(
        F.col("page_id").cast("string").alias("item"), F.lit("landmine:url").alias("sub"), F.array("url").alias("aliases")
    )
    return checks.dead_pattern_aliases(rows).select("item", "alias")


@query("""with c as (select l_partkey as id, count(*) as n from lineitem group by all)
select status, count(*) as n_items, cast(sum(n) as bigint) as n_rows from (
  select coalesce(n, 0) as n, case when n is null then 'missing' when n > 1 then 'duplicate' else 'ok' end as status
  from part left join c on id = p_partkey) group by all""")
def provenance(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "part").select(F.col("p_partkey").alias("id"))
    rows = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("id"))
    return bank.provenance_counts(items, rows).groupBy("status").agg(
        F.count(F.lit(1)).alias("n_items"), F.sum("n_rows").alias("n_rows")
    )


@query("select c_custkey as id from customer where c_custkey in (select user_id from events)")
def pending_signoff(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"))
    register = table(spark, folder, "events").select(F.col("user_id").alias("id"))
    return bank.pending_signoff(items, register)


@query("""with ids as (select distinct split_part(text, '.', 1) as id from benchmark),
tokens as (select id as token from ids union
           select case when contains(id, ' ') then split_part(id, ' ', 1) || ' ' else id end from ids)
select token, count(*) as n_documents from tokens join documents on contains(text, token) where token <> '' group by all""")
def leak_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Opening sentences of benchmark items, and their first words, in documents."""
    items = table(spark, folder, "benchmark").select(F.substring_index("text", ".", 1).alias("id"))
    tokens = leaks.leak_tokens(items, separator=" ")
    return leaks.leak_counts(table(spark, folder, "documents").select("doc_id", "text"), tokens, "doc_id")


@query("select l_orderkey || '-' || l_linenumber as id, count(*) as n from lineitem group by all having count(*) > 1")
def duplicate_ids(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"))
    return gates.duplicate_ids(rows, "id")


@query("""select p_partkey as id, p_type as type from part where lower(p_type) not in ('economy', 'small')""")
def unknown_types(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as cases: two kinds stand for known types, the rest for unknown ones."""
    from evalgrid.operators import checks

    kinds = F.when(F.lower("p_type") == "economy", "restraint").when(F.lower("p_type") == "small", "honesty").otherwise(F.col("p_type"))
    return checks.unknown_types(table(spark, folder, "part").select(F.col("p_partkey").alias("id"), kinds.alias("type")))


# --- batches --------------------------------------------------------------------

_TOKEN_SQL = """case when length({t}) <= {n} then {t} else substr({t}, 1, {n} - 7) || '-' || substr(sha1({v}), 1, 6) end"""


def _token_sql(value: str, limit: int) -> str:
    cleaned = f"coalesce(nullif(trim(regexp_replace({value}, '[^A-Za-z0-9_-]+', '_', 'g'), '_'), ''), 'x')"
    return _TOKEN_SQL.format(t=cleaned, n=limit, v=value)


_CUSTOM_ID = f"'ss-pages-' || {_token_sql('url', 24)} || '-g0-response'"


@query(f"select page_id, {_CUSTOM_ID} as custom_id from pages")
def request_ids(spark: SparkSession, folder: str) -> DataFrame:
    return _page_requests(spark, folder)


def _page_requests(spark: SparkSession, folder: str) -> DataFrame:
    made = ids.custom_id(F.lit("pages"), F.col("url"), F.lit(0), F.lit("response"))
    return table(spark, folder, "pages").select("page_id", made.alias("custom_id"))


@query(f"""with k as (select regexp_replace(url, '[0-9]+$', '') as url from pages)
select {_CUSTOM_ID} as custom_id, count(*) as n from k group by all having count(*) > 1""")
def request_id_collisions(spark: SparkSession, folder: str) -> DataFrame:
    """Pages whose addresses differ in a last number only, asked under one id."""
    stem = F.regexp_replace("url", "[0-9]+$", "")
    made = table(spark, folder, "pages").select(ids.custom_id(F.lit("pages"), stem, F.lit(0), F.lit("response")).alias("custom_id"))
    return gates.duplicate_ids(made, "custom_id")


def _threads(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Questions and answers of every conversation; some answers are empty."""
    rows = table(spark, folder, "conversations")
    slot = F.floor(F.col("turn") / 2).cast("int")
    turn = F.concat(F.lit("t"), slot.cast("string"))
    first_system = F.col("role") == "user"
    asked = rows.filter(first_system).groupBy("conv_id", slot.alias("position")).agg(
        F.max("text").alias("content")
    ).withColumn("turn_id", F.concat(F.lit("t"), F.col("position").cast("string")))
    said = rows.filter(F.col("role") == "assistant").groupBy("conv_id", turn.alias("turn_id")).agg(
        F.max(F.when(F.length("text") % 5 == 0, "").otherwise(F.col("text"))).alias("text")
    )
    return asked, said


_THREADS = """with asked as (select conv_id, cast(turn // 2 as int) as position, max(text) as content from conversations
  where role = 'user' group by all),
said as (select conv_id, cast(turn // 2 as int) as position, max(case when length(text) % 5 = 0 then '' else text end) as text
  from conversations where role = 'assistant' group by all),
pending as (select a.conv_id, min(a.position) as position from asked a left join said s using (conv_id, position)
  where coalesce(s.text, '') = '' group by all)"""


@query(_THREADS + " select conv_id, 't' || position as turn_id, position from pending")
def pending_turns(spark: SparkSession, folder: str) -> DataFrame:
    asked, said = _threads(spark, folder)
    return requests.pending_turns(asked, said, ["conv_id"])


@query(_THREADS + """
select a.conv_id, a.position * 2 as message, 'user' as role, a.content from asked a join pending p using (conv_id)
where a.position <= p.position
union all
select s.conv_id, s.position * 2 + 1, 'assistant', s.text from said s join asked a using (conv_id, position)
join pending p using (conv_id) where s.position < p.position""")
def conversation_prefix(spark: SparkSession, folder: str) -> DataFrame:
    asked, said = _threads(spark, folder)
    waiting = requests.pending_turns(asked, said, ["conv_id"])
    return requests.conversation_rows(asked, said, waiting, ["conv_id"])


@query("""select page_id, trim(concat_ws(chr(10) || chr(10), nullif(url, ''),
  case when page_id % 2 = 0 then 'Candidate features:' || chr(10) || '- p: ' || url || chr(10) || '- q: two' end, 'Decide.')) as prompt
from pages""")
def prompt_text(spark: SparkSession, folder: str) -> DataFrame:
    feature = "array<struct<id:string,label:string>>"
    listed = F.array(F.struct(F.lit("p").alias("id"), F.col("url").alias("label")),
                     F.struct(F.lit("q").alias("id"), F.lit("two").alias("label")))
    features = F.when(F.col("page_id") % 2 == 0, listed).otherwise(F.array().cast(feature))
    made = requests.user_prompt(F.col("url"), features, F.lit("Decide."))
    return table(spark, folder, "pages").select("page_id", made.alias("prompt"))


_RESULTS_SQL = """with r as (select event_id as e, event_type as t, user_id as u, cast(props->>'$.k' as bigint) as k,
  cast(floor(value) as bigint) as o from events),
v as (select *, case when t in ('view', 'signup') then 'openai' when t = 'click' then 'anthropic' else 'google' end as provider,
  e % 11 = 3 as failed, e % 13 = 5 as stray from r)"""


@query(_RESULTS_SQL + """
select case when stray then 'unknown' when failed then 'error' else 'merged' end as outcome,
  case when not stray then provider end as provider,
  case when stray or failed then null when provider = 'openai' then 'completed' when provider = 'anthropic' then 'end_turn'
       when t = 'error' then 'MAX_TOKENS' else 'STOP' end as finish_reason,
  count(*) as n, cast(coalesce(sum(case when not stray and not failed then k end), 0) as bigint) as tokens_in,
  cast(coalesce(sum(case when not stray and not failed then o end), 0) as bigint) as tokens_out,
  round(coalesce(sum(case when not stray and not failed then round((k * 2.0e0 + o * 8.0e0) / 1000000 * 0.5e0, 8) end), 0), 6) as cost_usd,
  count(distinct case when not stray and not failed then 'answer ' || e end) as n_texts
from v group by all""")
def result_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Result lines of three vendors in one schema, matched to the manifest."""
    events = _events(spark, folder)
    found = requests.normalize_results(texts.result_lines(events), texts.manifest(events))
    return found.groupBy("outcome", "provider", "finish_reason").agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum("usage.input_tokens"), F.lit(0)).alias("tokens_in"),
        F.coalesce(F.sum("usage.output_tokens"), F.lit(0)).alias("tokens_out"),
        F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("cost_usd"),
        F.countDistinct(F.when(F.col("outcome") == "merged", F.col("text"))).alias("n_texts"),
    )


@query(_RESULTS_SQL + """,
kept as (select provider, u, k, arg_max('answer ' || e, e) as text from v where not stray and not failed group by all)
select provider as model, u as generation, 't' || k as turn_id, text from kept""")
def stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Result files taken in as a stream; the last answer to a turn stays."""
    base = scratch_path(spark, "ingest")
    events = _events(spark, folder)
    texts.result_lines(events, texts.turn_request_id()).write.text(f"{base}/lines")
    job = ingest.ingest_results(
        spark, f"{base}/lines", cut(texts.turn_manifest(events)), f"{base}/log", f"{base}/checkpoint",
        written_at="$.written_at", max_files=2,
    )
    job.awaitTermination()
    latest = ingest.current_responses(ingest.read_log(spark, f"{base}/log"))
    return latest.select("model", "generation", "turn_id", "text")


@query(_RESULTS_SQL + """
select provider as model, u as generation, 't' || k as turn_id, arg_max('answer ' || e, e) filter (where not failed) as answer,
  arg_max(failed, e) as call_failed, count(*) as n_calls
from v where not stray group by all""")
def turn_state(spark: SparkSession, folder: str) -> DataFrame:
    """The state of every turn after three deliveries, each taken in by streams started anew."""
    base = scratch_path(spark, "turns")
    events = _events(spark, folder)
    asked = cut(texts.turn_manifest(events))
    state = TurnState(spark, f"{base}/log", f"{base}/state")
    for part in (2, 0, 1):
        delivered = texts.result_lines(events.filter(F.col("event_id") % 3 == part), texts.turn_request_id())
        delivered.write.mode("append").text(f"{base}/lines")
        ingest.ingest_results(
            spark, f"{base}/lines", asked, f"{base}/log", f"{base}/checkpoint", written_at="$.written_at"
        ).awaitTermination()
        state.follow()
    return state.turns().select(
        "model", "generation", "turn_id", "answer", F.col("error").isNotNull().alias("call_failed"), "n_calls"
    )


_SPOKEN = """with u as (select conv_id, text, row_number() over (partition by conv_id order by turn, text) as i
  from conversations where role = 'user'),
s as (select conv_id, text, row_number() over (partition by conv_id order by turn, text) as i
  from conversations where role = 'assistant'),"""


@query(_SPOKEN + """
m as (select 'm' || k as model, k from (values (0), (1)) as t(k)),
q as (select model, u.conv_id, u.i, u.text, coalesce(s.text <> '' and length(s.text) % 5 <> k, false) as answered
  from u cross join m left join s using (conv_id, i)),
g as (select model, conv_id, count(*) as n, coalesce(min(case when not answered then i end), count(*) + 1) as stop from q group by all),
stages as (select unnest(generate_series(1, (select max(stop) from g))) as stage)
select g.model, cast(g.conv_id as varchar) as item, cast(stage as integer) as stage,
  case when q.i = 1 then 'setup' else 't' || q.i end as turn_id,
  cast(2 * q.i - 1 as integer) as n_messages, md5(q.text) as question
from g cross join stages join q on q.model = g.model and q.conv_id = g.conv_id and q.i = least(stage, stop)""")
def staged_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations put to two models stage by stage, until a stage brings no new answer.

    A question that fails or gets an empty answer is asked again in the next stage.
    """
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    order = [F.col("turn").asc(), F.col("text").asc()]
    spoken = {r: scan.numbered(rows.filter(F.col("role") == r), order, "i", ("conv_id",)) for r in ("user", "assistant")}
    item = F.col("conv_id").cast("string")
    turn = F.when(F.col("i") == 1, "setup").otherwise(F.concat(F.lit("t"), F.col("i").cast("string")))
    none = F.lit(None).cast("string")
    later = F.when(F.col("i") > 1, F.struct(F.col("i"), turn.alias("id"), F.col("text").alias("content")))
    cases = spoken["user"].groupBy(item.alias("id")).agg(
        F.max(F.when(F.col("i") == 1, F.col("text"))).alias("setup_prompt"),
        F.sort_array(F.collect_list(later)).alias("turns"),
    ).select(
        "id", F.lit("conviction").alias("type"), none.alias("brief"), none.alias("prompt"),
        F.array().cast("array<struct<id:string,label:string>>").alias("features"), "setup_prompt", "turns",
    )
    models = spark.createDataFrame(
        [(f"m{k}", p, "x", 1.0, 2.0, None, 0.5, True) for k, p in enumerate(("openai", "anthropic"))],
        "name string, provider string, id string, price_in double, price_out double, price_cached_in double, "
        "batch_discount double, batch_supported boolean",
    )
    answers_said = cut(spoken["assistant"].select(item.alias("item"), turn.alias("turn_id"), F.col("text").alias("said")))
    run = stages.StagedRun(spark, scratch_path(spark, "staged"), models, cut(cases), 1, "r1")

    def send(stage: DataFrame, deliveries: str) -> None:
        texts.answer_lines(stage.join(answers_said, ["item", "turn_id"])).write.mode("append").text(deliveries)

    run.settle(send)
    return run.asked().select(
        "model", "item", "stage", "turn_id", F.size("messages").alias("n_messages"),
        F.md5(F.element_at("messages", -1)["content"]).alias("question"),
    )


@query("with" + views.SCORES + """
select model, count(*) as n, count(*) filter (where correct) as n_correct from scores_v
where run_id = (select max(run_id) from scores_v) group by all""")
def score_store_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Scores written by run and model, and the last run read back."""
    path = scratch_path(spark, "scores")
    scores = views.scores(spark, folder)
    score_store.write_scores(scores, path)
    last = scores.agg(F.max("run_id").alias("r")).first()["r"]
    return score_store.read_scores(spark, path, last).groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("n_correct")
    )
