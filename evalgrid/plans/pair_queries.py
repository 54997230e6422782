"""Queries over paired comparisons and successions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrid.operators import aggregate, coverage, generations, pairs, rank, resample, scope
from evalgrid.plans import boards, views
from evalgrid.plans.registry import query
from evalgrid.plans.score_queries import _rounded, _sums, draws_sql
from evalgrid.session import cut

MODEL = ["model"]
#: Resamples and sign flips of the registered pair queries: the library defaults.
DRAWS, FLIPS = resample.PAIR_DRAWS, resample.SIGN_FLIPS

_CLUSTERS = "with" + views.SUMS + """,
means as (select model, item, sub, min(dimension) as dimension, min(weight) as weight,
            avg(case when correct then 1.0e0 else 0.0e0 end) as rate
          from scores_v where not contains(model, 'naive') group by all),
place as (select model, row_number() over (order by score desc, model) as pos from points where not contains(model, 'naive')),
shared as (select x.model as a, y.model as b, x.dimension, x.item, x.sub, x.weight, x.rate - y.rate as delta
           from means x join place p on p.model = x.model
           join means y on y.item = x.item and y.sub = x.sub
           join place q on q.model = y.model where p.pos < q.pos),
pc as (select a, b, dimension, item, sum(weight) as den, sum(weight * delta) as num, count(*) as n_checks
       from shared group by all),
pd as (select a, b, dimension, sum(num) / sum(den) as v, sum(n_checks) as n, count(*) as k from pc group by all),
diffs as (select a, b, avg(v) as diff, cast(sum(n) as bigint) as n_pairs, cast(sum(k) as bigint) as n_items
          from pd group by all)"""

_CI = _CLUSTERS + "," + draws_sql("pc", "a, b", DRAWS) + """,
ci as (select a, b, quantile_cont(m, 0.025) as lo, quantile_cont(m, 0.975) as hi from heads group by all)"""

_FLIP = f""",
dens as (select a, b, dimension, sum(den) as d from pc group by all),
ndims as (select a, b, count(*) as k from dens group by all),
coefs as (select a, b, dimension, item, num / d / k as coef from pc join dens using (a, b, dimension) join ndims using (a, b)),
obs as (select a, b, sum(coef) as observed from coefs group by all),
units as (select distinct dimension, item from coefs),
signs as (select flip, dimension, item,
            cast('0x' || substr(md5('0:' || flip || ':' || dimension || ':' || item), 1, 8) as bigint) % 2 * 2 - 1 as sign
          from units, range({FLIPS}) t(flip)),
nulls as (select a, b, flip, sum(sign * coef) as v from signs join coefs using (dimension, item) group by all),
flips as (select a, b, case when abs(max(observed)) <= 1e-8 then 1.0e0
             else (count(*) filter (where abs(v) >= abs(observed) - 1e-12) + 1) / {FLIPS + 1} end as p_value
          from nulls join obs using (a, b) group by all)"""

_VERDICTS = _CI + _FLIP + """,
joined as (select * from diffs join ci using (a, b) join flips using (a, b)),
stepped as (select *, (count(*) over () - row_number() over (order by p_value, a, b) + 1) * p_value as step from joined),
holm as (select * exclude (step), least(1.0, max(step) over (order by p_value, a, b rows unbounded preceding)) as p_adjusted
         from stepped),
verdicts as (select *, case when p_adjusted <= 0.05 and diff <> 0 then case when diff > 0 then a else b end end as winner
             from holm),
views2 as (select a as model, b as opponent, diff, lo, hi, winner from verdicts
           union all select b, a, -diff, -hi, -lo, winner from verdicts)"""


def _means(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The means per model and check, and the order of the board."""
    ranked = scope.ranked_only(cut(_sums(spark, folder)))
    means = ranked.select(
        "model", "item", "sub", "dimension", (F.col("den") / F.col("n")).alias("weight"),
        (F.col("n_correct") / F.col("n")).alias("rate"),
    )
    return means, rank.positions(aggregate.headline(aggregate.dimension_scores(ranked, MODEL), MODEL))


@query(_CLUSTERS + " select a, b, round(diff, 6) as diff, n_pairs, n_items from diffs")
def paired_diff(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(pairs.paired_diff(pairs.pair_clusters(pairs.shared_checks(*_means(spark, folder)))), "diff")


@query(_CI + " select a, b, round(lo, 6) as lo, round(hi, 6) as hi from ci")
def paired_ci(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(pairs.pair_intervals(*_means(spark, folder), DRAWS), "lo", "hi")


@query(_CLUSTERS + _FLIP + " select a, b, round(p_value, 8) as p_value from flips")
def signflip_p(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(pairs.pair_tests(*_means(spark, folder), FLIPS), "p_value", digits=8)


def _verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return boards.pair_table(views.scores(spark, folder), DRAWS, FLIPS)


@query(_VERDICTS + """
select a, b, round(diff, 6) as diff, round(lo, 6) as lo, round(hi, 6) as hi, n_pairs, n_items,
       round(p_value, 8) as p_value, round(p_adjusted, 8) as p_adjusted, winner from verdicts""")
def pair_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(_rounded(_verdicts(spark, folder), "diff", "lo", "hi"), "p_value", "p_adjusted", digits=8)


@query(_VERDICTS + """
select model, count(*) filter (where winner = model) as wins, count(*) as compared from views2 group by all""")
def pair_wins(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.wins(_verdicts(spark, folder))


@query(_VERDICTS + """,
cells as (select model, opponent, case when winner = model then 'wd' when winner is not null then 'ld'
            when lo > 0 then 'ws' when hi < 0 then 'ls' else 'nd' end as state from views2)
select model, """ + ", ".join(f"max(state) filter (where opponent = 'm{i}') as m{i}" for i in range(7)) + """,
       count(*) filter (where state = 'wd') as decisive_wins from cells group by all""")
def h2h_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.head_to_head(_verdicts(spark, folder), [f"m{i}" for i in range(7)])


@query(_CI + """
select a, b, round(diff * 100, 4) as diff, round(lo * 100, 4) as lo, round(hi * 100, 4) as hi, n_items,
       lo > 0 or hi < 0 as detected
from diffs join ci using (a, b)
where a = (select model from place where pos = 1) and b = (select model from place where pos = 2)""")
def top_two_gap(spark: SparkSession, folder: str) -> DataFrame:
    sums = cut(_sums(spark, folder))
    ranked = scope.ranked_only(sums)
    order = rank.positions(aggregate.headline(aggregate.dimension_scores(ranked, MODEL), MODEL)).filter("pos <= 2")
    means = ranked.select(
        "model", "item", "sub", "dimension", (F.col("den") / F.col("n")).alias("weight"),
        (F.col("n_correct") / F.col("n")).alias("rate"),
    )
    clusters = cut(pairs.pair_clusters(pairs.shared_checks(means, order)))
    gap = pairs.paired_diff(clusters).join(resample.headline_intervals(clusters, pairs.PAIR, DRAWS), pairs.PAIR)
    return gap.select(
        "a", "b",
        *[F.round(F.col(c) * 100, 4).alias(c) for c in ("diff", "lo", "hi")],
        "n_items",
        pairs.excludes_zero(F.col("lo"), F.col("hi")).alias("detected"),
    )


@query(_VERDICTS + "," + views.EXPECTED + """,
full_bank as (select model from sums group by model having count(*) = (select count(*) from expected)),
line as (select * from (values ('m0', 'orion', [3]), ('m1', 'orion', [2, 5]), ('m2', 'lyra', [2]),
           ('m3', 'orion mini', [1]), ('m4', 'lyra', [1, 5])) t(model, family, version)),
ranked_line as (select line.* from line join full_bank using (model)),
newest as (select family, max({'version': version, 'model': model}) as top from ranked_line group by family),
inferred as (select line.model as prev, newest.top.model as curr from line join newest using (family)
             where newest.top.version > line.version),
succ as (select * from inferred union all select 'm6', 'm0' where exists (select 1 from full_bank where model = 'm0')),
pub as (select a, b, round(diff, 3) as delta, round(lo, 3) as lo, round(hi, 3) as hi, winner from verdicts),
both_ways as (select a as curr, b as prev, delta, lo, hi, winner from pub
              union all select b, a, -delta, -hi, -lo, winner from pub),
j as (select succ.prev, succ.curr, delta * 100 as delta, lo * 100 as lo, hi * 100 as hi, winner is not null as decisive,
        winner is null and coalesce(lo > 0 or hi < 0, false) as suggestive,
        case when winner = succ.curr then 'curr' when winner = succ.prev then 'prev' when lo > 0 then 'curr'
             when hi < 0 then 'prev' when delta > 0 then 'curr' when delta < 0 then 'prev' end as winner
      from succ left join both_ways using (curr, prev))
select prev, curr, round(delta, 4) as delta, round(lo, 4) as lo, round(hi, 4) as hi, winner, decisive, suggestive,
       case when delta is null then 'not paired' when winner is null then 'dead even'
            else case when decisive then 'decisive ' else 'slight ' end
              || case when winner = 'curr' then 'upgrade' else 'downgrade' end end as verdict,
       case when delta is null or winner is null then '' when decisive then 'statistically significant'
            when suggestive then 'not conclusive after correction' else 'not statistically significant' end as confidence
from j""")
def generation_pairs(spark: SparkSession, folder: str) -> DataFrame:
    scores = views.scores(spark, folder)
    covered = coverage.coverage_board(
        aggregate.check_sums(scores, MODEL), views.expected_checks(spark, folder), MODEL
    ).select("model", "is_baseline", "ranked_eligible")
    names = views.registry(spark).select(F.col("name").alias("model"), "label", "superseded_by")
    board = cut(covered.join(F.broadcast(names), "model", "left"))
    found = generations.succession_pairs(board, pairs.published(_verdicts(spark, folder)))
    return _rounded(found.drop("holm_p"), "delta", "lo", "hi", digits=4)
