"""Bet statistics, strategy grids, ledgers (A*, B*, T*, W7-W12, W17-W18, W20, J15)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import odds as O
from ..functions import score as S
from ..operators import evaluate as E
from ..operators import reshape as R
from ..operators.median import exact_median
from ..plans import backtest as B
from .odds_math import CANDIDATES, MAX, ONE_PER_MATCH, PS, PSC, best_bets, value_bets
from .registry import query, r, sql_power, sql_power_probs
from .views import view

PNL = "(case when won then odds-1 else -1 end)"
BETS = f"""{CANDIDATES}, b as (select * from (select *, {ONE_PER_MATCH} as rn from ev where ev >= 0.02 and ev <= 0.30) where rn = 1)"""
STATS = f"count(*) as n, round(avg({PNL}),6) as roi, round(avg(case when won then 1.0 else 0.0 end),6) as hit_rate, round(avg(odds),6) as mean_odds"
# the view's seasons are 1995-2001; the dev/test split is moved there
DEV, TEST = (1995, 1997), (1998, 2001)


def rounded(df, *keys, digits=6):
    return df.select(*keys, *[r(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes if c not in keys])


@query("W7_one_bet_per_match", f"with {BETS} select match_id, selection, round(ev,6) as ev from b", ("matches",))
def w7(spark, sf):
    return R.top_by(value_bets(spark, sf), ["match_date", "match_id"], "ev", "selection").select("match_id", "selection", r("ev").alias("ev"))


@query("A4_roi_stats", f"with {BETS} select {STATS} from b", ("matches",))
def a4(spark, sf):
    return rounded(E.roi_stats(best_bets(spark, sf)))


MODELS = {"dc": ["dc_ph", "dc_pd", "dc_pa"], "elo": ["elo_ph", "elo_pd", "elo_pa"], "mk": ["mk_ph", "mk_pd", "mk_pa"]}


def _score_sql(keys, where=""):
    parts = []
    for m in MODELS:
        parts.append(f"select {keys}, y, '{m}' as model, {m}_ph as p0, {m}_pd as p1, {m}_pa as p2 from y where elo_ph is not null and mk_ph is not null{where}")
    return f"""with y as (select *, case when fthg>ftag then 0 when fthg=ftag then 1 else 2 end as y, case when season<=1997 then 'dev' else 'test' end as period from model_probs),
l as ({' union all '.join(parts)})
select {keys}, model, count(*) as n, round(avg((power(p0-(y<=0)::int,2)+power(p0+p1-(y<=1)::int,2))/2),6) as rps,
 round(avg(-ln(case y when 0 then p0 when 1 then p1 else p2 end)),6) as log_loss,
 round(avg(power(p0-(y=0)::int,2)+power(p1-(y=1)::int,2)+power(p2-(y=2)::int,2)),6) as brier,
 round(avg(((case when p0=greatest(p0,p1,p2) then 0 when p1=greatest(p0,p1,p2) then 1 else 2 end)=y)::int),6) as accuracy
from l group by {keys}, model"""


@query("A1_score_table", _score_sql("period"), ("model_probs",))
def a1(spark, sf):
    m = R.add_labels(view(spark, sf, "model_probs")).withColumn("period", F.when(F.col("season") <= 1997, "dev").otherwise("test"))
    return rounded(E.score_table(m, MODELS, keys=["period"]), "period", "model")


@query("A2_quality_by_league", """with y as (select p.*, case when p.fthg>p.ftag then 0 when p.fthg=p.ftag then 1 else 2 end as y, 1/m.psh+1/m.psd+1/m.psa-1 as margin
 from model_probs p join matches m using (match_id) where p.elo_ph is not null and p.mk_ph is not null)
select league, count(*) as n, round(avg((power(dc_ph-(y<=0)::int,2)+power(dc_ph+dc_pd-(y<=1)::int,2))/2),6) as rps_dc,
 round(avg((power(mk_ph-(y<=0)::int,2)+power(mk_ph+mk_pd-(y<=1)::int,2))/2),6) as rps_mk, round(avg(margin),6) as mean_margin from y group by league""",
       ("model_probs", "matches"))
def a2(spark, sf):
    odds = view(spark, sf, "matches").select("match_id", O.margin(O.array_of(*PS)).alias("margin"))
    m = R.add_labels(view(spark, sf, "model_probs")).where("elo_ph is not null and mk_ph is not null").join(odds, "match_id")
    return rounded(m.groupBy("league").agg(F.count(F.lit(1)).alias("n"), F.avg(S.rps(MODELS["dc"], "y")).alias("rps_dc"),
                                           F.avg(S.rps(MODELS["mk"], "y")).alias("rps_mk"), F.avg("margin").alias("mean_margin")), "league")


BANDS = [1.0, 1.5, 2.0, 3.0, 5.0, 10.0, 1000]


def band_sql(c, edges):
    return "case " + " ".join(f"when {c}>{a} and {c}<={b} then '({a}, {b}]'" for a, b in zip(edges[:-1], edges[1:])) + " end"


_bias_parts = " union all ".join(f"select '{b}' as book, '{o.upper()}' as outcome, {b}{o} as odds, {w} as won from match_books"
                                 for b in ("avg", "bw", "b365") for o, w in (("h", "fthg>ftag"), ("d", "fthg=ftag"), ("a", "fthg<ftag")))


@query("A3_bias_map", f"""with l as ({_bias_parts}), b as (select *, {band_sql('odds', BANDS)} as band from l where odds is not null)
select book, outcome, band, count(*) as n, round(avg({PNL}),6) as roi, round(stddev_pop({PNL})/sqrt(count(*)),6) as std_error
from b where band is not null group by all""", ("match_books",))
def a3(spark, sf):
    return rounded(E.bias_map(R.add_labels(view(spark, sf, "match_books")), ["avg", "bw", "b365"], BANDS), "book", "outcome", "band")


_cdf = " ".join(f"when u < {c} then {k}" for k, c in enumerate(E.POISSON1_CDF))


def _boot_sql(keys, base, reps):
    return f"""bd as (select {keys}, s, g, id, unnest(range(0,{(reps + 3) // 4})) as d from ({base})),
bh as (select {keys}, s, g, d, md5(concat(id, '|', d)) as h from bd),
bu as (select {keys}, s, g, d*4+i as rep, cast(('0x' || substr(h, 1+8*i, 8)) as ubigint)/4294967296.0::double as u from (select *, unnest(range(0,4)) as i from bh)),
bp as (select {keys}, s, g, rep, case {_cdf} else {len(E.POISSON1_CDF)} end as w from bu where rep < {reps}),
bq as (select {keys}, rep, sum(w*g)/sum(w*s) as roi from bp where w > 0 group by {keys}, rep)
select {keys}, round(quantile_cont(roi, 0.025),6) as roi_low, round(quantile_cont(roi, 0.975),6) as roi_high,
 round(avg(case when roi <= 0 then 1.0 else 0.0 end),6) as p_roi_le0 from bq group by {keys}"""


@query("A5_bootstrap_roi", f"with {BETS}, {_boot_sql('season', f'select season, match_id as id, 1.0::double as s, {PNL} as g from b', 1000)}", ("matches",))
def a5(spark, sf):
    return rounded(E.bootstrap_roi(best_bets(spark, sf), ["season"], F.col("match_id"), 1000), "season")


@query("A5_block_bootstrap_roi", f"""with {BETS}, {_boot_sql('season', f"select season, cast(match_date as varchar) as id, count(*)::double as s, sum({PNL}) as g from b group by 1, 2", 1000)}""", ("matches",))
def a5b(spark, sf):
    return rounded(E.bootstrap_roi(best_bets(spark, sf), ["season"], F.col("match_id"), 1000, block=F.col("match_date")), "season")


@query("A6_bet_summary", f"""with {BETS}, c2 as (select b.*, {sql_power(PSC)} as k2, m.psch, m.pscd, m.psca from b join matches m using (match_id)),
s as (select *, least(0.25*greatest(0,(p*odds-1)/(odds-1)),0.05) as stake,
 odds*(case selection when 'H' then {sql_power_probs(PSC, 'k2')[0]} when 'D' then {sql_power_probs(PSC, 'k2')[1]} else {sql_power_probs(PSC, 'k2')[2]} end)-1 as clv from c2)
select season, count(*) as n, round(sum(stake),6) as total_stake, round(sum(case when won then stake*(odds-1) else -stake end),6) as profit,
 round(sum(case when won then stake*(odds-1) else -stake end)/sum(stake),6) as roi, round(avg(won::int),6) as hit_rate,
 round(avg(odds),6) as mean_odds, round(avg(clv),6) as mean_clv, round(avg((clv>0)::int),6) as clv_positive from s group by season""", ("matches",))
def a6(spark, sf):
    from ..functions.stake import stake_fraction
    return rounded(E.bet_summary(bets_with_clv(spark, sf).withColumn("stake", stake_fraction("p", "odds")), ["season"]), "season")


def bets_with_clv(spark, sf):
    m = R.add_labels(view(spark, sf, "matches"))
    m = O.with_devig(m, PS, ["sharp_ph", "sharp_pd", "sharp_pa"])
    m = O.with_devig(m, PSC, ["c_ph", "c_pd", "c_pa"], fair_cols=["fair_psc_h", "fair_psc_d", "fair_psc_a"])
    return R.best_bet(m, R.three_way_legs("sharp", "max", "psc"), ["match_id", "match_date", "season", "country", "league"], 0.02, 0.30, match_key=["match_date", "match_id"])


@query("A7_breakdowns", f"""with {BETS} select grouping(season)::int as all_seasons, grouping(country)::int as all_countries, season, country, {STATS}
from b group by grouping sets ((season),(country),(season,country))""", ("matches",))
def a7(spark, sf):
    b = best_bets(spark, sf)
    out = b.groupingSets([["season"], ["country"], ["season", "country"]], "season", "country").agg(
        F.grouping("season").cast("int").alias("all_seasons"), F.grouping("country").cast("int").alias("all_countries"),
        F.count(F.lit(1)).alias("n"), F.avg(E.unit_pnl()).alias("roi"), F.avg(F.col("won").cast("double")).alias("hit_rate"), F.avg("odds").alias("mean_odds"))
    return rounded(out, "season", "country", "all_seasons", "all_countries")


TENNIS = f"""p as (select *, {sql_power(['ps_home', 'ps_away'])} as k from two_way),
c as (select match_id, season, tour, surface, 'home' as selection, {sql_power_probs(['ps_home', 'ps_away'], 'k')[0]} as p, max_home as odds, home_win as won from p
 union all select match_id, season, tour, surface, 'away', {sql_power_probs(['ps_home', 'ps_away'], 'k')[1]}, max_away, not home_win from p),
e as (select *, p*odds-1 as ev from c), v as (select * from e where ev > 0.02 and ev <= 0.3),
b as (select * from (select *, row_number() over (partition by match_id order by ev desc, selection) as rn from v) where rn=1)"""


def tennis_bets(spark, sf, dedupe=True):
    t = O.with_devig(view(spark, sf, "two_way"), ["ps_home", "ps_away"], ["p_home", "p_away"])
    c = R.candidate_bets(t, R.two_way_legs("p_home", "max_home", "max_away"), ["match_id", "season", "tour", "surface"])
    v = R.select_value(c, 0.02, 0.3, strict_min=True)
    return R.top_by(v, ["match_id"], "ev", "selection") if dedupe else v


@query("A8_B6_tennis_breakdowns", f"""with {TENNIS}, t as (select *, season >= 1998 as test, {band_sql('odds', [1, 1.5, 2, 3, 5, 100])} as band from b)
select tour, test, season, surface, band, count(*) as n, round(avg({PNL}),6) as roi from t group by grouping sets ((tour,test),(season),(test,surface),(test,band))""", ("two_way",))
def a8(spark, sf):
    b = tennis_bets(spark, sf).withColumns({"test": F.col("season") >= 1998, "band": S.band("odds", [1, 1.5, 2, 3, 5, 100])})
    out = b.groupingSets([["tour", "test"], ["season"], ["test", "surface"], ["test", "band"]], "tour", "test", "season", "surface", "band").agg(
        F.count(F.lit(1)).alias("n"), F.avg(E.unit_pnl()).alias("roi"))
    return rounded(out, "tour", "test", "season", "surface", "band")


@query("B6_tennis_all_sides", f"with {TENNIS} select tour, {STATS} from v group by tour", ("two_way",))
def b6(spark, sf):
    return rounded(E.roi_stats(tennis_bets(spark, sf, dedupe=False), ["tour"]), "tour")


@query("A9_calibration_equal_width", """with c as (select least(9,greatest(0,floor(dc_ph*10)))::int as bin, dc_ph as p, (fthg>ftag)::int as y from model_probs)
select bin, count(*) as n, round(avg(p),6) as predicted, round(avg(y),6) as observed from c group by bin""", ("model_probs",))
def a9(spark, sf):
    m = R.add_labels(view(spark, sf, "model_probs"))
    return rounded(E.calibration(m, F.col("dc_ph"), F.col("won_h"), S.equal_width_bin("dc_ph")), "bin")


CAL = [0, .05, .1, .15, .2, .25, .3, .4, .5, .7, 1]


@query("A10_calibration_bands", f"""with c as (select league, {band_sql('dc_pa', CAL)} as bin, dc_pa as p, (fthg<ftag)::int as y from model_probs)
select league, bin, count(*) as n, round(avg(p),6) as predicted, round(avg(y),6) as observed from c where bin is not null group by league, bin""", ("model_probs",))
def a10(spark, sf):
    m = R.add_labels(view(spark, sf, "model_probs"))
    return rounded(E.calibration(m, F.col("dc_pa"), F.col("won_a"), S.band("dc_pa", CAL), ["league"]), "league", "bin")


@query("A14_base_rates", """select round(avg((fthg>ftag)::int),6) as p_home, round(avg((fthg=ftag)::int),6) as p_draw, round(avg((fthg<ftag)::int),6) as p_away,
 count(*) as n from matches where season < 1999""", ("matches",))
def a14(spark, sf):
    m = R.add_labels(view(spark, sf, "matches")).where("season < 1999")
    return rounded(m.agg(*[F.avg(F.col(f"won_{o}").cast("double")).alias(n) for o, n in (("h", "p_home"), ("d", "p_draw"), ("a", "p_away"))], F.count(F.lit(1)).alias("n")))


@query("A16_distinct_counts", "select country, count(distinct home) as teams, count(distinct match_date) as days, count(*) as n from matches group by country", ("matches",))
def a16(spark, sf):
    return view(spark, sf, "matches").groupBy("country").agg(F.countDistinct("home").alias("teams"), F.countDistinct("match_date").alias("days"), F.count(F.lit(1)).alias("n"))


@query("A17_roi_pivot", f"""with l as ({_bias_parts}), b as (select *, {band_sql('odds', BANDS)} as band from l where odds is not null)
select outcome, band, round(avg(case when book='avg' then {PNL} end),6) as avg, round(avg(case when book='bw' then {PNL} end),6) as bw,
 round(avg(case when book='b365' then {PNL} end),6) as b365 from b where band is not null group by outcome, band""", ("match_books",))
def a17(spark, sf):
    b = E.bias_map(R.add_labels(view(spark, sf, "match_books")), ["avg", "bw", "b365"], BANDS)
    return rounded(b.groupBy("outcome", "band").pivot("book", ["avg", "bw", "b365"]).agg(F.first("roi")), "outcome", "band")


@query("A18_over_under_pivot", """with t as (select market_id, book, cast(cast(ts as date) as varchar) as day, side, max(odds) as o from odds_ticks group by all),
w as (select market_id, book, day, max(case when side=0 then o end) as over_odds, max(case when side=1 then o end) as under_odds from t group by all)
select market_id, book, day, round(over_odds,6) as over_odds, round(under_odds,6) as under_odds, round((1/over_odds)/(1/over_odds+1/under_odds),6) as p_over,
 round(1/over_odds+1/under_odds,6) as book_sum from w""", ("odds_ticks",))
def a18(spark, sf):
    t = view(spark, sf, "odds_ticks").withColumn("day", F.to_date("ts").cast("string"))
    w = t.groupBy("market_id", "book", "day").pivot("side", [0, 1]).agg(F.max("odds")).withColumnsRenamed({"0": "over_odds", "1": "under_odds"})
    inv = 1 / F.col("over_odds") + 1 / F.col("under_odds")
    return rounded(w.withColumns({"p_over": 1 / F.col("over_odds") / inv, "book_sum": inv}), "market_id", "book", "day")


@query("A20_tracking_summary", f"""with {BETS}, c2 as (select b.*, {sql_power(PSC)} as k2, m.psch, m.pscd, m.psca, m.maxh from b join matches m using (match_id)),
s as (select *, odds*(case selection when 'H' then {sql_power_probs(PSC, 'k2')[0]} when 'D' then {sql_power_probs(PSC, 'k2')[1]} else {sql_power_probs(PSC, 'k2')[2]} end)-1 as clv,
 match_date < date '2001-06-01' as settled from c2)
select count(*) as n_picks, count(*) filter (settled) as n_settled, round(sum({PNL}) filter (settled),6) as profit_units,
 round(avg({PNL}) filter (settled),6) as roi_flat, round(avg(clv),6) as clv_mean, round(avg((clv>0)::int),6) as clv_positive_share from s""", ("matches",))
def a20(spark, sf):
    b = bets_with_clv(spark, sf).withColumn("settled", F.col("match_date") < "2001-06-01")
    s = F.when(F.col("settled"), E.unit_pnl())
    return rounded(b.agg(F.count(F.lit(1)).alias("n_picks"), F.count(s).alias("n_settled"), F.sum(s).alias("profit_units"), F.avg(s).alias("roi_flat"),
                         F.avg("clv").alias("clv_mean"), F.avg((F.col("clv") > 0).cast("double")).alias("clv_positive_share")))


@query("A21_comparison_by_book", """with c as (select book, odds*0.4-1 as ev from odds_ticks)
select book, count(*) as compared, count(*) filter (ev >= 0.03) as value_bets, round(quantile_cont(ev,0.5),6) as ev_median from c group by rollup(book)""", ("odds_ticks",))
def a21(spark, sf):
    c = view(spark, sf, "odds_ticks").select("book", (F.col("odds") * 0.4 - 1).alias("ev"))
    each = c.select(F.explode(F.array("book", F.lit(None).cast("string"))).alias("book"), "ev")          # the book and the total of all
    counts = c.rollup("book").agg(F.count(F.lit(1)).alias("compared"), F.count(F.when(F.col("ev") >= 0.03, 1)).alias("value_bets"))
    m = exact_median(each, "ev", ["book"], "ev_median").withColumnRenamed("book", "_book")
    return rounded(counts.join(m, F.col("book").eqNullSafe(F.col("_book"))).drop("_book"), "book")


@query("A22_announced_probability_audit", """with t as (select concat(cast(cast(round(100*(1/psh)/(1/psh+1/psd+1/psa)+12) as int) as varchar), '%') as announced, maxh as odds, fthg>ftag as won from matches),
p as (select cast(replace(announced,'%','') as double)/100 as p, odds, won from t)
select count(*) as n, round(avg(p),6) as announced, round(avg(won::int),6) as observed, round(avg(1/odds),6) as implied,
 round(avg(power(p-won::int,2)),6) as brier_model, round(avg(power(1/odds-won::int,2)),6) as brier_market, round(avg(case when won then odds-1 else -1 end),6) as roi from p""", ("matches",))
def a22(spark, sf):
    m = R.add_labels(view(spark, sf, "matches")).withColumn("p0", O.devig(O.array_of(*PS), "multiplicative")[0])
    t = m.select(F.concat(F.round(100 * F.col("p0") + 12).cast("int").cast("string"), F.lit("%")).alias("announced"), F.col("maxh").alias("odds"), F.col("won_h").alias("won"))
    t = t.withColumns({"p": F.regexp_replace("announced", "%", "").cast("double") / 100, "w": F.col("won").cast("double")})
    return rounded(t.agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("announced"), F.avg("w").alias("observed"), F.avg(1 / F.col("odds")).alias("implied"),
                         F.avg((F.col("p") - F.col("w")) ** 2).alias("brier_model"), F.avg((1 / F.col("odds") - F.col("w")) ** 2).alias("brier_market"), F.avg(E.unit_pnl()).alias("roi")))


# ------------------------------------------------------------------ grids
PROBS = {"mk_ps": PS, "mk_bfe": ["bfeh", "bfed", "bfea"]}
BOOKS = {b: [f"{b}h", f"{b}d", f"{b}a"] for b in ("max", "b365", "bw", "avg")}


def grid_configs():
    out = []
    for fam, prob in (("sharp", "mk_ps"), ("exchange", "mk_bfe"), ("consensus", "kz"), ("model", "dc"), ("hybrid", "hyb")):
        for book in ("max", "b365", "bw", "avg"):
            for ev in (0.0, 0.02, 0.05):
                for mo in (3.5, 10.0):
                    out.append(dict(family=fam, prob=prob, book=book, min_ev=ev, max_odds=mo))
    return out


def grid_bets(spark, sf):
    m = R.add_labels(view(spark, sf, "match_books").drop("league"))
    mx = view(spark, sf, "matches").select("match_id", *MAX, "psh", "psd", "psa", *PSC)
    dc = view(spark, sf, "model_probs").select("match_id", "dc_ph", "dc_pd", "dc_pa")
    m = m.join(mx, "match_id").join(dc, "match_id")
    m = O.with_devig(m, PS, ["mk_ps_ph", "mk_ps_pd", "mk_ps_pa"])
    m = O.with_devig(m, PROBS["mk_bfe"], ["mk_bfe_ph", "mk_bfe_pd", "mk_bfe_pa"])
    m = O.with_devig(m, PSC, ["c0", "c1", "c2"], fair_cols=["fair_h", "fair_d", "fair_a"])
    m = m.withColumns({f"kz_p{o}": 1 / F.col(f"avg{o}") - 0.034 for o in "hda"})
    m = m.withColumn("_h", O.log_pool(O.array_of("dc_ph", "dc_pd", "dc_pa"), O.array_of("mk_ps_ph", "mk_ps_pd", "mk_ps_pa"), 0.2))
    m = m.withColumns({f"hyb_p{o}": F.col("_h")[i] for i, o in enumerate("hda")})
    configs = grid_configs()
    probs = {p: [f"{p}_p{o}" for o in "hda"] for p in ("mk_ps", "mk_bfe", "kz", "dc", "hyb")}
    return B.strategy_grid(m, configs, probs, BOOKS, ["won_h", "won_d", "won_a"], R.OUTCOMES, ["match_id", "season"], ["fair_h", "fair_d", "fair_a"])


def _grid_sql():
    bfe = ["bfeh", "bfed", "bfea"]
    cols = []
    for i, o in enumerate("hda"):
        cols += [f"{sql_power_probs(PS, 'k1')[i]} as mk_ps_{o}", f"{sql_power_probs(bfe, 'k2')[i]} as mk_bfe_{o}",
                 f"{sql_power_probs(PSC, 'k3')[i]} as close_{o}", f"1/avg{o}-0.034 as kz_{o}", f"dc_p{o} as dc_{o}"]
    won = {"h": "fthg>ftag", "d": "fthg=ftag", "a": "fthg<ftag"}
    cells = []
    for prob in ("mk_ps", "mk_bfe", "kz", "dc", "hyb"):
        for book in ("max", "b365", "bw", "avg"):
            for o in "hda":
                cells.append(f"select match_id, season, '{prob}' as prob, '{book}' as book, '{o.upper()}' as selection, {prob}_{o} as p, {book}{o} as odds, {won[o]} as won, {book}{o}*close_{o}-1 as clv from x")
    conf = ", ".join(f"({i},'{c['family']}','{c['prob']}','{c['book']}',{c['min_ev']}::double,{c['max_odds']}::double)" for i, c in enumerate(grid_configs()))
    return f"""w as (select b.*, m.maxh, m.maxd, m.maxa, m.psh, m.psd, m.psa, m.psch, m.pscd, m.psca, d.dc_ph, d.dc_pd, d.dc_pa
 from match_books b join matches m using (match_id) join model_probs d using (match_id)),
k as (select *, {sql_power(PS)} as k1, {sql_power(bfe)} as k2, {sql_power(PSC)} as k3 from w),
y as (select *, {', '.join(cols)} from k),
z as (select *, exp(0.2*ln(dc_h)+0.8*ln(mk_ps_h)) as eh, exp(0.2*ln(dc_d)+0.8*ln(mk_ps_d)) as ed, exp(0.2*ln(dc_a)+0.8*ln(mk_ps_a)) as ea from y),
x as (select *, eh/(eh+ed+ea) as hyb_h, ed/(eh+ed+ea) as hyb_d, ea/(eh+ed+ea) as hyb_a from z),
long as ({' union all '.join(cells)}), ev as (select *, p*odds-1 as ev from long where p is not null and odds is not null),
conf(config_id, family, prob, book, min_ev, max_odds) as (values {conf}),
sel as (select e.*, config_id from ev e join conf c on e.prob=c.prob and e.book=c.book and e.ev >= c.min_ev and e.ev <= 0.3 and e.odds <= c.max_odds),
one as (select * from (select *, row_number() over (partition by config_id, match_id order by ev desc, selection) as rn from sel) where rn=1),
per as (select *, case when season between 1995 and 1997 then 'dev' when season between 1998 and 2001 then 'test' end as period from one),
st as (select config_id, {', '.join(f"count(*) filter (period='{p}') as {p}_n, avg({PNL}) filter (period='{p}') as {p}_roi, avg(odds) filter (period='{p}') as {p}_mean_odds, avg(won::int) filter (period='{p}') as {p}_hit_rate, avg(clv) filter (period='{p}') as {p}_mean_clv" for p in ("dev", "test"))} from per group by config_id),
rep as (select c.*, coalesce(dev_n,0) as dev_n, dev_roi, dev_mean_odds, dev_hit_rate, dev_mean_clv, coalesce(test_n,0) as test_n, test_roi, test_mean_odds, test_hit_rate, test_mean_clv from conf c left join st using (config_id))"""


_REP = "config_id, family, prob, book, min_ev, max_odds, dev_n, test_n, " + ", ".join(f"round({p}_{c},6) as {p}_{c}" for p in ("dev", "test") for c in ("roi", "mean_odds", "hit_rate", "mean_clv"))


@query("B1_J15_strategy_grid", f"with {_grid_sql()} select {_REP} from rep", ("match_books", "matches", "model_probs"))
def b1(spark, sf):
    bets, conf = grid_bets(spark, sf)
    return rounded(B.grid_report(bets, conf, DEV, TEST), "config_id", "family", "prob", "book", "min_ev", "max_odds")


@query("B3_W9_select_on_dev", f"""with {_grid_sql()}, g as (select *, row_number() over (partition by family order by dev_roi desc, config_id) as rank from rep where dev_n >= 300 and book in ('max','b365'))
select {_REP}, rank from g where rank <= 3""", ("match_books", "matches", "model_probs"))
def b3(spark, sf):
    bets, conf = grid_bets(spark, sf)
    rep = B.grid_report(bets, conf, DEV, TEST)
    return rounded(B.select_on_dev(rep, 300, ["max", "b365"]), "config_id", "family", "prob", "book", "min_ev", "max_odds")


_po = sql_power_probs(["po", "pu"], "k")


@query("B2_over_under_grid", f"""with k as (select *, {sql_power(['po', 'pu'])} as k, {sql_power(['pco', 'pcu'])} as k2 from match_books),
l as (select match_id, season, 'Over2.5' as selection, {_po[0]} as p, maxo as odds, fthg+ftag>2 as won, maxo*{sql_power_probs(['pco', 'pcu'], 'k2')[0]}-1 as clv from k
 union all select match_id, season, 'Under2.5', {_po[1]}, maxu, fthg+ftag<=2, maxu*{sql_power_probs(['pco', 'pcu'], 'k2')[1]}-1 from k),
e as (select *, p*odds-1 as ev from l), t(min_ev) as (values (0.02::double),(0.05::double),(0.1::double)),
per as (select e.*, t.min_ev as min_ev, case when season between 1995 and 1997 then 'dev' else 'test' end as period from e join t on e.ev >= t.min_ev and e.ev <= 0.3)
select min_ev, period, count(*) as n, round(avg({PNL}),6) as roi, round(avg(won::int),6) as hit_rate, round(avg(odds),6) as mean_odds, round(avg(clv),6) as mean_clv from per group by all
union all select null, case when season between 1995 and 1997 then 'dev' else 'test' end, count(*), round(avg({PNL}),6), round(avg(won::int),6), round(avg(odds),6), null
 from (select season, maxo as odds, fthg+ftag>2 as won, {_po[0]} as p from k) where p-1/odds >= 0.05 group by 2""", ("match_books",))
def b2(spark, sf):
    m = R.add_labels(view(spark, sf, "match_books"))
    m = O.with_devig(m, ["po", "pu"], ["over", "under"])
    m = O.with_devig(m, ["pco", "pcu"], ["co", "cu"], fair_cols=["fo", "fu"]).withColumn("period", F.when(F.col("season") <= 1997, "dev").otherwise("test"))
    c = R.candidate_bets(m, R.over_under_legs("over", "maxo", "maxu", ("fo", "fu")), ["match_id", "period"])
    thresholds = F.explode(F.filter(F.array(*[F.lit(t) for t in (0.02, 0.05, 0.1)]), lambda t: t <= F.col("ev")))
    g = E.roi_stats(c.where("ev >= 0.02 and ev <= 0.3").withColumn("min_ev", thresholds), ["min_ev", "period"], clv=True)
    old = E.roi_stats(B.legacy_over_rule(m, "over", "maxo"), ["period"]).withColumns({"min_ev": F.lit(None).cast("double"), "mean_clv": F.lit(None).cast("double")})
    return rounded(g.unionByName(old), "min_ev", "period")


@query("B4_independent_sample", f"""with k as (select match_books.*, {sql_power(['bfeh', 'bfed', 'bfea'])} as k from match_books where bfeh is not null),
p as (select *, {sql_power_probs(['bfeh', 'bfed', 'bfea'], 'k')[0]} as p0, {sql_power_probs(['bfeh', 'bfed', 'bfea'], 'k')[1]} as p1, {sql_power_probs(['bfeh', 'bfed', 'bfea'], 'k')[2]} as p2 from k),
l as ({' union all '.join(f"select match_id, season, league, '{b}' as book, '{o.upper()}' as selection, p{i} as p, {b}{o} as odds, {w} as won from p" for b in ('b365', 'bw', 'avg') for i, (o, w) in enumerate((('h', 'fthg>ftag'), ('d', 'fthg=ftag'), ('a', 'fthg<ftag'))))}),
e as (select *, p*odds-1 as ev from l where odds is not null), t(thr) as (values (0.0::double),(0.02::double),(0.05::double)),
o as (select e.*, thr, row_number() over (partition by match_id, book, thr order by ev desc, selection) as rn from e join t on ev > thr and ev <= 0.3)
select book, thr, case when season <= 1997 then 'early' else 'late' end as period, {STATS} from o where rn=1 group by all""", ("match_books",))
def b4(spark, sf):
    m = R.add_labels(view(spark, sf, "match_books")).where("bfeh is not null")
    m = O.with_devig(m, ["bfeh", "bfed", "bfea"], ["s_ph", "s_pd", "s_pa"])
    long = B.priced_outcomes(m, {"s": ["s_ph", "s_pd", "s_pa"]}, BOOKS | {}, ["won_h", "won_d", "won_a"], R.OUTCOMES, ["match_id", "season", "league"],
                             {("s", b) for b in ("b365", "bw", "avg")})
    v = long.where("ev > 0 and ev <= 0.3")
    # one bet per match is the best outcome whatever the threshold, so thresholds fan out after the reduction
    best = R.top_by(v, ["match_id", "book"], "ev", "selection")
    best = best.withColumn("thr", F.explode(F.filter(F.array(*[F.lit(t) for t in (0.0, 0.02, 0.05)]), lambda t: t < F.col("ev"))))
    return rounded(E.roi_stats(best.withColumn("period", F.when(F.col("season") <= 1997, "early").otherwise("late")), ["book", "thr", "period"]), "book", "thr", "period")


@query("B5_bias_and_information", f"""with p as (select *, {sql_power(['avg_home', 'avg_away'])} as k from two_way),
l as (select match_id, season, avg_home as odds, home_win as won, open_home as open_odds, open_home*{sql_power_probs(['avg_home', 'avg_away'], 'k')[0]}-1 as clv, 'home' as side from p
 union all select match_id, season, avg_away, not home_win, open_away, open_away*{sql_power_probs(['avg_home', 'avg_away'], 'k')[1]}-1, 'away' from p),
s as (select 'favourites' as strategy, odds, won from l where odds < 2 union all select 'outsiders', odds, won from l where odds >= 2
 union all select 'big favourites', odds, won from l where odds < 1.3 union all select 'big outsiders', odds, won from l where odds > 4
 union all select 'always home', odds, won from l where side='home' union all select 'always away', odds, won from l where side='away'
 union all select 'price will shorten', open_odds, won from l where clv > 0.02 union all select 'price will drift', open_odds, won from l where clv < -0.02)
select strategy, {STATS} from s group by strategy""", ("two_way",))
def b5(spark, sf):
    t = O.with_devig(view(spark, sf, "two_way"), ["avg_home", "avg_away"], ["c0", "c1"], fair_cols=["fair_home", "fair_away"])
    side = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"avg_{s}").alias("close"), F.col(f"open_{s}").alias("open"), w.alias("won"),
                                        (F.col(f"open_{s}") / F.col(f"fair_{s}") - 1).alias("clv"))
                               for s, w in (("home", F.col("home_win")), ("away", ~F.col("home_win")))]))
    t = t.select(side.alias("s")).select("s.*")
    rules = {"favourites": F.col("close") < 2, "outsiders": F.col("close") >= 2, "big favourites": F.col("close") < 1.3, "big outsiders": F.col("close") > 4,
             "always home": F.col("side") == "home", "always away": F.col("side") == "away", "price will shorten": F.col("clv") > 0.02, "price will drift": F.col("clv") < -0.02}
    tags = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    t = t.withColumn("strategy", F.explode(tags)).withColumn("odds", F.when(F.col("strategy").startswith("price"), F.col("open")).otherwise(F.col("close")))
    return rounded(E.roi_stats(t, ["strategy"]), "strategy")


@query("B10_report_text", f"""with {BETS} select season, count(*) as n, concat(format('{{:.2f}}', round(100*avg({PNL}),2)), ' %') as roi_text from b group by season""", ("matches",))
def b10(spark, sf):
    g = E.roi_stats(best_bets(spark, sf), ["season"])
    return g.select("season", "n", B.percent_text(F.col("roi")).alias("roi_text"))


@query("W11_cumulative_profit", f"""with {BETS}, d as (select match_date, count(*) as n, sum({PNL}) as profit from b group by match_date)
select cast(match_date as varchar) as match_date, n, round(profit,6) as profit, round(sum(profit) over (order by match_date),6) as cum_profit from d""", ("matches",))
def w11(spark, sf):
    return rounded(B.cumulative_profit(best_bets(spark, sf)).withColumn("match_date", F.col("match_date").cast("string")), "match_date")


def _ledger_sql():
    pol = ", ".join(f"('{n}','{m}',{f}::double,{c}::double)" for n, m, f, c in B.POLICIES)
    return f"""pol(policy, method, frac, cap) as (values {pol}),
ls as (select match_date, policy, method, odds, won, case when method='kelly' then least(frac*greatest(0,(p*odds-1)/(odds-1)),cap) else frac end as share from b join pol on true),
ld as (select policy, method, match_date, sum((share>0)::int)::bigint as n, sum(share) as exposure, sum(case when won then share*(odds-1) else -share end) as ret from ls group by all),
ld2 as (select policy, method, match_date, n, ret*(case when method<>'flat' and exposure>0.5 then 0.5/exposure else 1.0 end) as ret from ld),
lc as (select *, case when method='flat' then 1000*(1+sum(ret) over w) else 1000*exp(sum(ln(greatest(1e-12,1+ret))) over w) end as bankroll from ld2 window w as (partition by policy order by match_date)),
la as (select *, coalesce(sum((bankroll<=1)::int) over (partition by policy order by match_date rows between unbounded preceding and 1 preceding),0) as ruined from lc)"""


@query("W17_ledger", f"with {BETS}, {_ledger_sql()} select policy, cast(match_date as varchar) as match_date, n, round(ret,8) as ret, round(ln(greatest(bankroll,1e-9)),5) as log_bankroll from la where ruined=0", ("matches",))
def w17(spark, sf):
    led = B.ledger(best_bets(spark, sf))
    return led.select("policy", F.col("match_date").cast("string").alias("match_date"), "n", r("ret", 8).alias("ret"),
                      r(F.log(F.greatest("bankroll", F.lit(1e-9))), 5).alias("log_bankroll"))


@query("W12_W18_staking_report", f"""with {BETS}, {_ledger_sql()}, lk as (select *, greatest(1000.0::double, max(bankroll) over (partition by policy order by match_date)) as peak from la where ruined=0)
select policy, sum(n)::bigint as n_bets, round(ln(arg_max(bankroll, match_date)),5) as log_final, round(greatest(0, max((peak-bankroll)/peak)),6) as max_drawdown from lk group by policy""", ("matches",))
def w18(spark, sf):
    rep = B.staking_report(B.ledger(best_bets(spark, sf)))
    return rep.select("policy", "n_bets", r(F.log("final_bankroll"), 5).alias("log_final"), r("max_drawdown").alias("max_drawdown"))


@query("W20_price_moves", f"""with p as (select *, {sql_power(['avg_home', 'avg_away'])} as k from two_way),
c as (select match_id, avg_home/open_home-1 as move, open_home*{sql_power_probs(['avg_home', 'avg_away'], 'k')[0]}-1 as clv from p)
select match_id, round(move,6) as move, case when clv > 0.02 then 'shorten' when clv < -0.02 then 'drift' else 'flat' end as bucket from c""", ("two_way",))
def w20(spark, sf):
    t = O.with_devig(view(spark, sf, "two_way"), ["avg_home", "avg_away"], ["c0", "c1"], fair_cols=["fh", "fa"])
    clv = O.clv("open_home", "fh")
    return t.select("match_id", r(F.col("avg_home") / F.col("open_home") - 1).alias("move"),
                    F.when(clv > 0.02, "shorten").when(clv < -0.02, "drift").otherwise("flat").alias("bucket"))


@query("T2_top_configs_per_league", f"""with {BETS}, s as (select country, home, {STATS} from b group by country, home),
k as (select *, row_number() over (partition by country order by roi desc, home) as rank from s) select country, home, n, roi, rank from k where rank <= 8""", ("matches",))
def t2(spark, sf):
    g = rounded(E.roi_stats(best_bets(spark, sf), ["country", "home"]), "country", "home")
    return R.top_n_by(g, ["country"], [F.desc("roi"), F.asc("home")], 8).select("country", "home", "n", "roi", "rank")


@query("T4_last_picks", f"with {BETS} select match_id, cast(match_date as varchar) as match_date, selection, round(ev,6) as ev from b order by b.match_date desc, match_id desc limit 30", ("matches",))
def t4(spark, sf):
    b = best_bets(spark, sf).orderBy(F.desc("match_date"), F.desc("match_id")).limit(30)
    return b.select("match_id", F.col("match_date").cast("string").alias("match_date"), "selection", r("ev").alias("ev"))


@query("T3_main_total_line", """with t as (select match_id, l, 1/(1+exp((l-2.6-0.01*(match_id%37)::int)*1.1)) as p from matches, (values (1.5::double),(2.5::double),(3.5::double)) v(l))
select match_id, arg_min(l, (abs(p-0.5), l)) as main_line, round(arg_min(p, (abs(p-0.5), l)),6) as p_over from t group by match_id""", ("matches",))
def t3(spark, sf):
    m = view(spark, sf, "matches").select("match_id", F.explode(F.array(*[F.lit(x) for x in (1.5, 2.5, 3.5)])).alias("l"))
    m = m.withColumn("p", 1 / (1 + F.exp((F.col("l") - 2.6 - 0.01 * (F.col("match_id") % 37)) * 1.1)))
    key = F.struct(F.abs(F.col("p") - 0.5).alias("a"), F.col("l"))
    return m.groupBy("match_id").agg(F.min_by("l", key).alias("main_line"), r(F.min_by("p", key)).alias("p_over"))


@query("T6_best_setting", f"""with {BETS}, s as (select country, round(avg({PNL}),6) as roi from b where season <= 1997 group by country) select country, roi from s order by roi desc, country limit 1""", ("matches",))
def t6(spark, sf):
    g = rounded(E.roi_stats(best_bets(spark, sf).where("season <= 1997"), ["country"]), "country")
    return g.orderBy(F.desc("roi"), F.asc("country")).limit(1).select("country", "roi")
