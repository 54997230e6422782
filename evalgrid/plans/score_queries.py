"""Queries over graded rows: scores, coverage, difficulty, intervals, bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrid import DIMENSIONS
from evalgrid.operators import aggregate, agreement, coverage, gates, rank, resample, scope
from evalgrid.plans import boards, views
from evalgrid.plans.registry import query
from evalgrid.session import cut

MODEL = ["model"]
_SCORES = "with" + views.SCORES
_SUMS = "with" + views.SUMS


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _sums(spark: SparkSession, folder: str, keys: list[str] | None = None) -> DataFrame:
    return aggregate.check_sums(views.scores(spark, folder), keys or MODEL)


@query(_SUMS + """
select model, round(score, 6) as score, row_number() over (order by score desc, model) as pos,
       contains(model, 'naive') as is_baseline from points""")
def headline_board(spark: SparkSession, folder: str) -> DataFrame:
    board = boards.point_board(views.scores(spark, folder))
    return _rounded(board, "score").select("model", "score", F.col("pos").cast("bigint").alias("pos"), "is_baseline")


@query(_SUMS + " select model, dimension, round(value, 6) as value from dims")
def dimension_scores(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(aggregate.dimension_scores(_sums(spark, folder), MODEL), "value")


@query(_SCORES + """,
scoped as (select unnest(['all', case when starts_with(item, 'example_') then 'examples' else 'official_real_only' end])
             as scope, model, dimension, weight, correct from scores_v),
d as (select scope, model, dimension, count(*) as n, sum(case when correct then weight else 0 end) / sum(weight) as v
      from scoped group by all)
select scope, model, cast(sum(n) as bigint) as n, round(avg(v) * 100, 6) as score from d group by all""")
def scope_filter(spark: SparkSession, folder: str) -> DataFrame:
    rows = _sums(spark, folder).withColumn("scope", F.explode(scope.scopes_of(F.col("item"))))
    keys = ["scope", "model"]
    counts = rows.groupBy(*keys, "dimension").agg(
        F.sum("n").alias("n"), F.try_divide(F.sum("num"), F.sum("den")).alias("value")
    )
    return counts.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.round(F.avg("value") * 100, 6).alias("score")
    )


@query(_SUMS + " select model, dimension, item, den, num from clusters")
def cluster_sums(spark: SparkSession, folder: str) -> DataFrame:
    return aggregate.cluster_sums(_sums(spark, folder), MODEL)


@query(_SCORES + """
select model, item, sub, min(dimension) as dimension, min(weight) as weight,
       round(avg(case when correct then 1.0e0 else 0.0e0 end), 6) as rate, count(*) as n_generations
from scores_v group by all""")
def generation_means(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(aggregate.generation_means(views.scores(spark, folder), MODEL), "rate")


@query(_SUMS + """
select item, sub, round(sum(n_correct) / sum(n), 6) as pass_rate, cast(sum(n) as bigint) as n,
       sum(n_correct) in (0, sum(n)) as dead from sums group by all""")
def difficulty(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(aggregate.difficulty(_sums(spark, folder)), "pass_rate")


@query(_SUMS + """,
ranked as (select * from sums where not contains(model, 'naive')),
dead as (select item, sub from ranked group by all having sum(n_correct) in (0, sum(n))),
live as (select * from ranked r where not exists (select 1 from dead d where d.item = r.item and d.sub = r.sub)),
d as (select model, dimension, sum(num) / sum(den) as v, sum(n) as n from live group by all)
select model, round(avg(v) * 100, 6) as score, cast(sum(n) as bigint) as n_live,
       (select count(*) from dead) as n_dead from d group by all""")
def live_subset_score(spark: SparkSession, folder: str) -> DataFrame:
    sums = cut(_sums(spark, folder))
    live = aggregate.live_sums(sums)
    dead = aggregate.difficulty(scope.ranked_only(sums)).filter("dead").agg(F.count(F.lit(1)).alias("n"))
    per_dim = live.groupBy("model", "dimension").agg(
        F.try_divide(F.sum("num"), F.sum("den")).alias("value"), F.sum("n").alias("n")
    )
    return per_dim.groupBy("model").agg(
        F.round(F.avg("value") * 100, 6).alias("score"), F.sum("n").alias("n_live")
    ).withColumn("n_dead", dead.scalar())


@query("with" + views.SCORES + "," + views.EXPECTED + """,
s as (select run_id, model, dimension, item, sub, count(*) as n from scores_v group by all),
b as (select count(distinct item) as bi, count(*) as bc from expected),
c as (select run_id, model, count(distinct item) as n_items, count(*) as n_checks, cast(sum(n) as bigint) as n_atomic,
        concat_ws(',', case when bool_or(dimension = 'restraint') then null else 'restraint' end,
                       case when bool_or(dimension = 'honesty') then null else 'honesty' end,
                       case when bool_or(dimension = 'conviction') then null else 'conviction' end) as missing_dimensions
      from s group by all),
e as (select c.*, round(n_items / bi, 4) as coverage_ratio, round(n_checks / bc, 4) as check_coverage_ratio,
        contains(model, 'naive') as is_baseline,
        not contains(model, 'naive') and n_items >= bi and n_checks >= bc and missing_dimensions = '' as ranked_eligible
      from c, b)
select *, case when is_baseline then 'baseline' when ranked_eligible then 'ranked' else 'provisional' end
         as coverage_status from e""")
def coverage_board(spark: SparkSession, folder: str) -> DataFrame:
    keys = ["run_id", "model"]
    return coverage.coverage_board(_sums(spark, folder, keys), views.expected_checks(spark, folder), keys)


@query("with" + views.SCORES + "," + views.EXPECTED + """,
s as (select run_id, model, item, dimension, sub, count(*) as n from scores_v group by all),
roster as (select run_id, model, cast(round(avg(n)) as bigint) as g from s group by all),
grid as (select run_id, model, item, dimension, sub, g from roster cross join expected),
o as (select run_id, model, case when coalesce(g, 0) = 0 then 'unexpected' when n is null then 'missing'
               when n < g then 'short' when n > g then 'extra' end as status, coalesce(n, 0) as n
      from grid full outer join s using (run_id, model, item, dimension, sub))
select run_id, model, status, count(*) as n_checks, cast(sum(n) as bigint) as n_seen
from o where status is not null group by all""")
def coverage_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Checks off the typical number of generations of their run and model."""
    sums = cut(_sums(spark, folder, ["run_id", "model"]))
    roster = sums.groupBy("run_id", "model").agg(F.round(F.avg("n")).cast("bigint").alias("generations"))
    gaps = coverage.coverage_gaps(sums, views.expected_checks(spark, folder), roster, ["run_id"])
    return gaps.groupBy("run_id", "model", "status").agg(
        F.count(F.lit(1)).alias("n_checks"), F.sum("n_seen").alias("n_seen")
    )


@query("with" + views.SUMS + "," + views.EXPECTED + """,
g as (select model, cast(floor(avg(n)) as bigint) as generations from sums group by all),
j as (select s.model, s.n, g.generations, e.item is not null as hit
      from sums s join g using (model) left join expected e using (item, dimension, sub)),
c as (select model, cast(sum(n) as bigint) as n_atomic, count(*) filter (where hit and n = generations) as n_exact,
             count(*) filter (where hit and n < generations) as n_short,
             count(*) filter (where hit and n > generations) as n_extra,
             count(*) filter (where not hit) as n_unexpected from j group by all)
select *, (select count(*) from expected) - n_exact - n_short - n_extra as n_missing,
       n_exact = (select count(*) from expected) and n_unexpected = 0 as complete from c""")
def coverage_counts(spark: SparkSession, folder: str) -> DataFrame:
    sums = cut(_sums(spark, folder))
    roster = sums.groupBy("model").agg(F.floor(F.avg("n")).alias("generations"))
    return coverage.coverage_counts(sums, views.expected_checks(spark, folder), roster)


@query(_SCORES + """
select item, sub, min(dimension) as min_dimension, max(dimension) as max_dimension,
       min(weight) as min_weight, max(weight) as max_weight from scores_v group by all""")
def constant_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return gates.metadata_spread(views.scores(spark, folder))


@query(_SUMS + """,
again as (select 'm' || (l_suppkey % 8) || case when l_suppkey % 8 = 7 then '-naive' else '' end as model,
            case when l_partkey % 45 < 5 then 'example_' else '' end
              || 'i' || lpad(cast(l_partkey % 45 as varchar), 2, '0') as item,
            's' || l_linenumber as sub,
            l_quantity > 10 + 3 * (l_suppkey % 8) + 2 * (l_partkey % 45 % 3) as correct from lineitem),
d as (select model, item, sub, correct, sum(side) as excess from
        (select model, item, sub, correct, 1 as side from scores_v
         union all select model, item, sub, correct, -1 from again) group by all)
select model, cast(sum(greatest(excess, 0)) as bigint) as only_saved,
       cast(sum(greatest(-excess, 0)) as bigint) as only_regraded, count(*) as n_kinds
from d where excess <> 0 group by all""")
def regrade_mismatches(spark: SparkSession, folder: str) -> DataFrame:
    """Saved grades against a regrade under a stricter rule."""
    saved = views.scores(spark, folder)
    model, item = F.col("l_suppkey") % 8, F.col("l_partkey") % 45
    again = views.table(spark, folder, "lineitem").select(
        F.concat(F.lit("m"), model.cast("string"), F.when(model == 7, "-naive").otherwise("")).alias("model"),
        F.concat(F.when(item < 5, "example_").otherwise(""), F.lit("i"), F.lpad(item.cast("string"), 2, "0")).alias("item"),
        F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("sub"),
        (F.col("l_quantity") > 10 + 3 * model + 2 * (item % 3)).alias("correct"),
    )
    differing = gates.multiset_difference(saved, again, ["model", "item", "sub", "correct"])
    return differing.groupBy("model").agg(
        F.sum(F.greatest("excess", F.lit(0))).alias("only_saved"),
        F.sum(F.greatest(-F.col("excess"), F.lit(0))).alias("only_regraded"),
        F.count(F.lit(1)).alias("n_kinds"),
    )


def draws_sql(clusters: str, keys: str, n: int, n_head: int | None = None) -> str:
    """SQL for the replicates of a cluster table, with the same draws.

    ``n_head`` is the number of draws of the headline, all of them by default.
    """
    return f"""
idx as (select {keys}, dimension, den, num,
          row_number() over (partition by {keys}, dimension order by item) - 1 as idx,
          count(*) over (partition by {keys}, dimension) as k from {clusters}),
sizes as (select distinct dimension, k from idx),
slots as (select draw, dimension, k, unnest(range(k)) as slot from sizes, range({n}) t(draw)),
picked as (select draw, dimension, k,
             cast('0x' || substr(md5('0:' || draw || ':' || dimension || ':' || slot), 1, 8) as bigint) % k as idx
           from slots),
times as (select draw, dimension, k, idx, count(*) as times from picked group by all),
reps as (select {keys}, draw, dimension, sum(times * num) / sum(times * den) as ratio
         from times join idx using (dimension, k, idx) group by all),
heads as (select {keys}, draw, avg(ratio) as m from reps where draw < {n_head or n} group by all)"""


_DIMENSION_CI = _SUMS + "," + draws_sql("clusters", "model", resample.DIMENSION_DRAWS)
_HEADLINE_CI = _SUMS + "," + draws_sql("clusters", "model", resample.HEADLINE_DRAWS)
_BOTH_CI = _SUMS + "," + draws_sql("clusters", "model", resample.DIMENSION_DRAWS, resample.HEADLINE_DRAWS)


@query(_DIMENSION_CI + """
select model, dimension, round(value, 6) as value, round(lo, 6) as lo, round(hi, 6) as hi from dims join
  (select model, dimension, quantile_cont(ratio, 0.025) as lo, quantile_cont(ratio, 0.975) as hi from reps group by all)
  using (model, dimension)""")
def bootstrap_ci_dimension(spark: SparkSession, folder: str) -> DataFrame:
    clusters = cut(aggregate.cluster_sums(_sums(spark, folder), MODEL))
    intervals = resample.dimension_intervals(clusters, MODEL)
    joined = aggregate.dimension_scores(clusters, MODEL).join(intervals, ["model", "dimension"])
    return _rounded(joined, "value", "lo", "hi")


@query(_HEADLINE_CI + """
select model, round(score, 6) as score, round(lo * 100, 6) as lo, round(hi * 100, 6) as hi from points join
  (select model, quantile_cont(m, 0.025) as lo, quantile_cont(m, 0.975) as hi from heads group by all) using (model)""")
def bootstrap_ci_headline(spark: SparkSession, folder: str) -> DataFrame:
    return headline_with_bounds(_sums(spark, folder))


def headline_with_bounds(sums: DataFrame, n: int = resample.HEADLINE_DRAWS) -> DataFrame:
    clusters = cut(aggregate.cluster_sums(sums, MODEL))
    points = aggregate.headline(aggregate.dimension_scores(clusters, MODEL), MODEL)
    bounds = resample.headline_intervals(clusters, MODEL, n)
    return points.join(bounds, MODEL).select(
        "model", F.round("score", 6).alias("score"),
        F.round(F.col("lo") * 100, 6).alias("lo"), F.round(F.col("hi") * 100, 6).alias("hi"),
    )


_BOUNDS = """,
bounds as (select model, """ + ", ".join(
    f"quantile_cont(ratio, 0.025) filter (where dimension = '{d}') as {d}_lo, "
    f"quantile_cont(ratio, 0.975) filter (where dimension = '{d}') as {d}_hi" for d in DIMENSIONS
) + """ from reps group by all),
head_bounds as (select model, quantile_cont(m, 0.025) * 100 as lo, quantile_cont(m, 0.975) * 100 as hi from heads group by all),
wide as (select model, """ + ", ".join(f"max(value) filter (where dimension = '{d}') as {d}" for d in DIMENSIONS) + """
         from dims group by all),
board as (select * from points join head_bounds using (model) join wide using (model) join bounds using (model))"""

_SUMMARY_COLUMNS = ["score", "lo", "hi", *[f"{d}{e}" for d in DIMENSIONS for e in ("", "_lo", "_hi")]]


@query(_BOTH_CI + _BOUNDS + " select model, "
       + ", ".join(f"round({c}, 4) as {c}" for c in _SUMMARY_COLUMNS) + " from board")
def model_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(boards.summary(_sums(spark, folder)), *_SUMMARY_COLUMNS, digits=4)


_BANDS = _BOTH_CI + _BOUNDS + """,
ordered as (select model, score, lo, hi, row_number() over (order by score desc, model) as pos
            from board where not contains(model, 'naive'))"""


@query(_BANDS + " select model, round(score, 4) as score, round(hi, 4) as hi, "
       "round((select lo from ordered where pos = 1), 4) as leader_lo from ordered "
       "where hi >= (select lo from ordered where pos = 1)")
def leader_band(spark: SparkSession, folder: str) -> DataFrame:
    board = scope.ranked_only(boards.summary(_sums(spark, folder)))
    return _rounded(rank.leader_band(board).select("model", "score", "hi", "leader_lo"), "score", "hi", "leader_lo", digits=4)


@query("with recursive" + _BANDS.removeprefix("with") + """,
walk as (select pos, 1 as band, lo as leader_lo, model from ordered where pos = 1
         union all
         select o.pos, case when o.hi < w.leader_lo then w.band + 1 else w.band end,
                case when o.hi < w.leader_lo then o.lo else w.leader_lo end, o.model
         from walk w join ordered o on o.pos = w.pos + 1)
select model, pos, band as rank, count(*) over (partition by band) > 1 as tied from walk""")
def overlap_bands(spark: SparkSession, folder: str) -> DataFrame:
    board = boards.summary(_sums(spark, folder)).select(
        "model", "score", "lo", "hi", scope.is_baseline(F.col("model")).alias("is_baseline"),
        F.lit(True).alias("ranked_eligible"),
    )
    banded = rank.overlap_bands(board)
    return banded.select("model", F.col("pos").cast("bigint").alias("pos"), "rank", "tied")


@query(_BOTH_CI + _BOUNDS + "," + views.REGISTRY_SQL + "," + views.EXPECTED + """,
checked as (select model, count(*) = (select count(*) from expected) as full_bank from sums group by all),
ordered as (select model, score, lo, hi, price_in, price_out, row_number() over (order by score desc, model) as pos
            from board join checked using (model) left join registry on name = model
            where full_bank and not contains(model, 'naive')),
band1 as (select *, price_in + price_out as price from ordered
          where pos <= coalesce((select min(pos) - 1 from ordered
                                 where hi < (select lo from ordered where pos = 1)), (select max(pos) from ordered))
            and price_in is not null and price_out is not null)
select * from (select arg_min(model, price * 1000 + pos) as cheapest, arg_max(model, price * 1000 - pos) as dearest,
       min(price) as cheapest_price, max(price) as dearest_price, count(*) as n_priced from band1)
where n_priced >= 2 and cheapest <> dearest""")
def price_span(spark: SparkSession, folder: str) -> DataFrame:
    board = boards.snapshot(
        views.scores(spark, folder), views.expected_checks(spark, folder), views.registry(spark)
    )
    return rank.price_span(board)


@query(_SUMS + """
select round(arg_min(score, model), 1) as naive_floor, min(model) as baseline
from points where contains(model, 'naive')""")
def naive_floor(spark: SparkSession, folder: str) -> DataFrame:
    return rank.naive_floor(boards.point_board(views.scores(spark, folder)))


@query(_SUMS + """,
wide as (select model, """ + ", ".join(f"max(value) filter (where dimension = '{d}') as {d[0]}" for d in DIMENSIONS) + """
         from dims where not contains(model, 'naive') group by all),
q as (select count(*) as n_models, corr(r, h) as a, corr(r, c) as b, corr(h, c) as g, corr(r, (r + h + c) / 3) as ir,
             corr(h, (r + h + c) / 3) as ih, corr(c, (r + h + c) / 3) as ic from wide),
m as (select *, (a * a + b * b + g * g) / 3 as third from q)
select n_models, round(a, 6) as corr_rh, round(b, 6) as corr_rc, round(g, 6) as corr_hc,
       round(ir, 6) as influence_restraint, round(ih, 6) as influence_honesty, round(ic, 6) as influence_conviction,
       round((1 + 2 * sqrt(third) * cos(acos(greatest(-1, least(1, a * b * g / pow(third, 1.5)))) / 3)) / 3, 6) as pc1_share
from m""")
def dimension_structure(spark: SparkSession, folder: str) -> DataFrame:
    values = aggregate.dimension_scores(scope.ranked_only(_sums(spark, folder)), MODEL)
    row = agreement.dimension_structure(values)
    return _rounded(row, *[c for c in row.columns if c != "n_models"])
