"""Odds mathematics (F*) and the flagship query."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import odds as O
from ..functions import score as S
from ..functions import stake as K
from ..operators import evaluate as E
from ..operators import groups as G
from ..operators import reshape as R
from .registry import query, r, sql_bisect, sql_power, sql_power_probs
from .views import view

PS, MAX, PSC = ["psh", "psd", "psa"], ["maxh", "maxd", "maxa"], ["psch", "pscd", "psca"]
KP = sql_power(PS)
PP = sql_power_probs(PS, "k")
ONE_PER_MATCH = "row_number() over (partition by match_date, match_id order by ev desc, selection)"
CANDIDATES = f"""p as (select *, {KP} as k from matches),
q as (select *, {PP[0]} as p0, {PP[1]} as p1, {PP[2]} as p2 from p),
c as (select match_id, match_date, season, country, home, away, 'H' as selection, p0 as p, maxh as odds, fthg>ftag as won from q
 union all select match_id, match_date, season, country, home, away, 'D', p1, maxd, fthg=ftag from q
 union all select match_id, match_date, season, country, home, away, 'A', p2, maxa, fthg<ftag from q),
ev as (select *, p*odds-1 as ev from c)"""


def value_bets(spark, sf, keep=("match_id", "match_date", "season", "country", "home", "away")):
    """Candidates of the best price against the sharp fair price, EV in [2 %, 30 %]."""
    m = R.add_labels(view(spark, sf, "matches"))
    m = O.with_devig(m, PS, ["sharp_ph", "sharp_pd", "sharp_pa"])
    return R.select_value(R.candidate_bets(m, R.three_way_legs("sharp", "max"), list(keep)), 0.02, 0.30)


def best_bets(spark, sf, keep=("match_id", "match_date", "season", "country", "home", "away")):
    """One bet per match: best EV of the best price, in [2 %, 30 %]."""
    m = R.add_labels(view(spark, sf, "matches"))
    m = O.with_devig(m, PS, ["sharp_ph", "sharp_pd", "sharp_pa"])
    return R.best_bet(m, R.three_way_legs("sharp", "max"), list(keep), 0.02, 0.30, match_key=["match_date", "match_id"])


@query("FLAGSHIP_value_by_season", f"""with {CANDIDATES},
b as (select *, {ONE_PER_MATCH} as rn from ev where ev >= 0.02 and ev <= 0.30)
select season, count(*) as n, round(avg(case when won then odds-1 else -1 end), 6) as roi,
 round(avg(odds), 6) as mean_odds, round(avg(case when won then 1.0 else 0.0 end), 6) as hit_rate
from b where rn = 1 group by season""", ("matches",))
def flagship(spark, sf):
    return E.roi_stats(best_bets(spark, sf), ["season"]).select("season", "n", r("roi").alias("roi"), r("mean_odds").alias("mean_odds"),
                                                r("hit_rate").alias("hit_rate"))


@query("F1_american_to_decimal", """with a as (select l_orderkey, l_linenumber,
 cast(l_quantity*20 - 500 as double) as price from lineitem)
select l_orderkey, l_linenumber, round(case when abs(price) >= 100 then case when price > 0 then 1+price/100
 when price < 0 then 1+100/abs(price) end end, 6) as strict_odds,
 round(case when price > 0 then 1+price/100 when price < 0 then 1+100/abs(price) end, 6) as raw_odds from a""")
def f1(spark, sf):
    a = view(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 20 - 500).alias("price"))
    return a.select("l_orderkey", "l_linenumber", r(O.american_to_decimal("price")).alias("strict_odds"),
                    r(O.american_to_decimal("price", strict=False)).alias("raw_odds"))


@query("F2_overround", """select match_id, round(coalesce(1/bwh,0)+coalesce(1/bwd,0)+coalesce(1/bwa,0)+1/psh0,6) as book_sum,
 round(coalesce(1/bwh,0)+coalesce(1/bwd,0)+coalesce(1/bwa,0)+1/psh0-1,6) as margin
from (select *, avgh as psh0 from match_books)""", ("match_books",))
def f2(spark, sf):
    m = view(spark, sf, "match_books")
    arr = O.array_of("bwh", "bwd", "bwa", "avgh")
    return m.select("match_id", r(O.overround(arr)).alias("book_sum"), r(O.margin(arr)).alias("margin"))


def _devig_query(name, method, sql):
    @query(name, sql, ("matches",))
    def run(spark, sf):
        m = O.with_devig(view(spark, sf, "matches"), PSC, ["ph", "pd", "pa"], method)
        return m.select("match_id", r("ph").alias("ph"), r("pd").alias("pd"), r("pa").alias("pa"))


_inv = "1/psch as a, 1/pscd as b, 1/psca as c"
_devig_query("F3_devig_multiplicative", "multiplicative", f"""with i as (select match_id, {_inv} from matches)
select match_id, round(a/(a+b+c),6) as ph, round(b/(a+b+c),6) as pd, round(c/(a+b+c),6) as pa from i""")
_devig_query("F4_devig_additive", "additive", f"""with i as (select match_id, {_inv} from matches),
j as (select match_id, greatest(a-(a+b+c-1)/3,1e-6) as a, greatest(b-(a+b+c-1)/3,1e-6) as b, greatest(c-(a+b+c-1)/3,1e-6) as c from i)
select match_id, round(a/(a+b+c),6) as ph, round(b/(a+b+c),6) as pd, round(c/(a+b+c),6) as pa from j""")
_pc = sql_power_probs(PSC, "k")
_devig_query("F5_devig_power", "power", f"""with p as (select *, {sql_power(PSC)} as k from matches)
select match_id, round({_pc[0]},6) as ph, round({_pc[1]},6) as pd, round({_pc[2]},6) as pa from p""")


def _shin(z, v):
    return f"((sqrt({z}*{z}+4*(1-{z})*{v}*{v}/(a+b+c))-{z})/(2*(1-{z})))"


_sh = " + ".join(_shin("{m}", v) for v in "abc")
# distinct price triples keep the twin's bisection short; the join brings every match back
_devig_query("F6_devig_shin", "shin", f"""with d as (select distinct psch, pscd, psca, {_inv} from matches),
z as (select *, {sql_bisect(0.0, 0.99, f"({_sh}) > 1.0")} as z from d),
p as (select *, case when a+b+c<=1 then a else {_shin("z", "a")} end as x, case when a+b+c<=1 then b else {_shin("z", "b")} end as y,
 case when a+b+c<=1 then c else {_shin("z", "c")} end as w from z)
select match_id, round(x/(x+y+w),6) as ph, round(y/(x+y+w),6) as pd, round(w/(x+y+w),6) as pa
from matches join p using (psch, pscd, psca)""")


def _or(cc, v):
    return f"({v}/({cc}+{v}-{cc}*{v}))"


_orr = " + ".join(_or("{m}", v) for v in "abc")
_devig_query("F7_devig_odds_ratio", "odds_ratio", f"""with d as (select distinct psch, pscd, psca, {_inv} from matches),
z as (select *, {sql_bisect(0.2, 10.0, f"({_orr}) > 1.0")} as z from d),
p as (select *, {_or("z", "a")} as x, {_or("z", "b")} as y, {_or("z", "c")} as w from z)
select match_id, round(x/(x+y+w),6) as ph, round(y/(x+y+w),6) as pd, round(w/(x+y+w),6) as pa
from matches join p using (psch, pscd, psca)""")


@query("F8_fair_odds", f"""with p as (select *, {sql_power(PSC)} as k from matches)
select match_id, round(1/({_pc[0]}),6) as fair_h, round(1/({_pc[1]}),6) as fair_d, round(1/({_pc[2]}),6) as fair_a from p""", ("matches",))
def f8(spark, sf):
    m = O.with_devig(view(spark, sf, "matches"), PSC, ["ph", "pd", "pa"], fair_cols=["fh", "fd", "fa"])
    return m.select("match_id", r("fh").alias("fair_h"), r("fd").alias("fair_d"), r("fa").alias("fair_a"))


@query("F9_long_devig_multiplicative", """with t as (select tick_id, market_id, cast(ts as date) as d, side, odds from odds_ticks)
select tick_id, round((1/odds)/sum(1/odds) over (partition by market_id, d), 6) as fair_prob,
 round(sum(1/odds) over (partition by market_id, d) - 1, 6) as margin from t""", ("odds_ticks",))
def f9(spark, sf):
    t = view(spark, sf, "odds_ticks").withColumn("d", F.to_date("ts"))
    out = G.long_devig_multiplicative(t, ["market_id", "d"], "odds")
    return out.select("tick_id", r("fair_prob").alias("fair_prob"), r("margin").alias("margin"))


@query("F9_long_devig_power", f"""with t as (select market_id, cast(cast(ts as date) as varchar) as d, side, max(odds) as odds from odds_ticks group by 1,2,3),
w as (select a.market_id, a.d, a.odds as o0, b.odds as o1 from t a join t b on a.market_id=b.market_id and a.d=b.d and a.side=0 and b.side=1),
p as (select *, {sql_power(["o0", "o1"])} as k from w)
select market_id, d, 0 as side, round({sql_power_probs(["o0", "o1"], "k")[0]},6) as fair_prob, round(1/o0+1/o1-1,6) as margin from p
union all select market_id, d, 1, round({sql_power_probs(["o0", "o1"], "k")[1]},6), round(1/o0+1/o1-1,6) from p""", ("odds_ticks",))
def f9p(spark, sf):
    t = view(spark, sf, "odds_ticks").withColumn("d", F.to_date("ts").cast("string"))
    return G.long_devig(t, ["market_id", "d"], ["side"], "odds").select(
        "market_id", "d", "side", r("fair_prob").alias("fair_prob"), r("margin").alias("margin"))


@query("F10_F11_ev_clv", f"""with p as (select *, {sql_power(PSC)} as k from matches)
select match_id, round(({_pc[0]})*maxh-1,6) as ev, round(maxh*({_pc[0]})-1,6) as clv from p""", ("matches",))
def f10(spark, sf):
    m = O.with_devig(view(spark, sf, "matches"), PSC, ["ph", "pd", "pa"], fair_cols=["fh", "fd", "fa"])
    return m.select("match_id", r(O.expected_value("ph", "maxh")).alias("ev"), r(O.clv("maxh", "fh")).alias("clv"))


@query("F12_F13_kelly_stakes", """with p as (select match_id, (1/psh)/(1/psh+1/psd+1/psa) as p, maxh as o from matches),
k as (select *, greatest(0, (p*o-1)/(o-1)) as f from p)
select match_id, round(f,6) as kelly, round(least(0.25*f,0.05),6) as kelly_stake, 0.01::double as flat_stake,
 round(least(greatest(0,p*o-1)*0.25,0.05),6) as prop_stake, round(100*least(f*0.25,0.02),2) as live_percent,
 round(least(round(round(100*least(f*0.25,0.02),2)/100*1000,2), 10.0),2) as live_money from k""", ("matches",))
def f12(spark, sf):
    m = view(spark, sf, "matches").withColumn("p", O.devig(O.array_of(*PS), "multiplicative")[0])
    m = m.withColumn("pct", K.stake_percent("p", "maxh"))
    return m.select("match_id", r(K.kelly_fraction("p", "maxh")).alias("kelly"),
                    r(K.stake_fraction("p", "maxh")).alias("kelly_stake"),
                    K.stake_fraction("p", "maxh", "flat").alias("flat_stake"),
                    r(K.stake_fraction("p", "maxh", "prop")).alias("prop_stake"), F.col("pct").alias("live_percent"),
                    F.round(K.stake_money("pct", 1000.0, F.lit(10.0)), 2).alias("live_money"))


@query("F14_simultaneous_stakes", """with p as (select match_id, match_date, (1/psh)/(1/psh+1/psd+1/psa) as p, maxh as o from matches),
k as (select *, greatest(0, (p*o-1)/(o-1))*0.25 as f from p), t as (select *, sum(f) over (partition by match_date) as tot from k)
select match_id, round(case when tot > 0.5 then f*0.5/tot else f end, 6) as stake from t""", ("matches",))
def f14(spark, sf):
    m = view(spark, sf, "matches").withColumn("p", O.devig(O.array_of(*PS), "multiplicative")[0])
    m = m.withColumn("f", K.kelly_fraction("p", "maxh") * 0.25).select("match_id", "match_date", "f")
    t = G.attach_totals(m, ["match_date"], tot=F.sum("f"))
    return t.select("match_id", r(F.when(F.col("tot") > 0.5, F.col("f") * 0.5 / F.col("tot")).otherwise(F.col("f"))).alias("stake"))


@query("F15_pools", """select match_id, round(0.3*dc_ph+0.7*mk_ph,6) as lin_h, round(a/(a+b+c),6) as log_h, round(b/(a+b+c),6) as log_d
from (select *, exp(0.3*ln(dc_ph)+0.7*ln(mk_ph)) as a, exp(0.3*ln(dc_pd)+0.7*ln(mk_pd)) as b, exp(0.3*ln(dc_pa)+0.7*ln(mk_pa)) as c
 from model_probs where mk_ph is not null)""", ("model_probs",))
def f15(spark, sf):
    m = view(spark, sf, "model_probs").where("mk_ph is not null")
    dc, mk = O.array_of("dc_ph", "dc_pd", "dc_pa"), O.array_of("mk_ph", "mk_pd", "mk_pa")
    m = m.withColumns({"lin": O.linear_pool(dc, mk, 0.3), "lg": O.log_pool(dc, mk, 0.3)})
    return m.select("match_id", r(F.col("lin")[0]).alias("lin_h"), r(F.col("lg")[0]).alias("log_h"), r(F.col("lg")[1]).alias("log_d"))


@query("F16_consensus", """select match_id, round(1/avgh-0.034,6) as kz_h, round(1/avgd-0.034,6) as kz_d, round(1/avga-0.034,6) as kz_a
from match_books""", ("match_books",))
def f16(spark, sf):
    c = O.consensus(O.array_of("avgh", "avgd", "avga"))
    return view(spark, sf, "match_books").select("match_id", *[r(c[i]).alias(f"kz_{o}") for i, o in enumerate("hda")])


_sets = {"ps": PS, "avg": ["avgh", "avgd", "avga"], "bw": ["bwh", "bwd", "bwa"], "bfe": ["bfeh", "bfed", "bfea"]}


def _f17_sql():
    with_k, out = [], []
    src = "match_books"
    for n, cols in _sets.items():
        if n == "ps":
            continue
        with_k.append(f"{sql_power(cols)} as k_{n}")
        pr = sql_power_probs(cols, f"k_{n}")
        out += [f"round({pr[0]},6) as mk_{n}_ph", f"round({pr[2]},6) as mk_{n}_pa",
                f"round(1/{cols[0]}+1/{cols[1]}+1/{cols[2]}-1,6) as mk_{n}_margin"]
    ou = sql_power_probs(["po", "pu"], "k_ou")
    with_k.append(f"{sql_power(['po', 'pu'])} as k_ou")
    out.append(f"round({ou[0]},6) as mk_ou_over")
    return f"with p as (select *, {', '.join(with_k)} from {src}) select match_id, {', '.join(out)} from p"


@query("F17_market_probabilities", _f17_sql(), ("match_books",))
def f17(spark, sf):
    m = view(spark, sf, "match_books")
    cols = []
    for n, odds in _sets.items():
        if n == "ps":
            continue
        m = O.with_devig(m, odds, [f"mk_{n}_ph", f"mk_{n}_pd", f"mk_{n}_pa"], margin_col=f"mk_{n}_margin")
        cols += [f"mk_{n}_ph", f"mk_{n}_pa", f"mk_{n}_margin"]
    m = O.with_devig(m, ["po", "pu"], ["mk_ou_over", "mk_ou_under"])
    return m.select("match_id", *[r(c).alias(c) for c in [*cols, "mk_ou_over"]])


@query("F18_scores", """with y as (select *, case when fthg>ftag then 0 when fthg=ftag then 1 else 2 end as y from model_probs)
select match_id, round((power(dc_ph-(case when y<=0 then 1 else 0 end),2)+power(dc_ph+dc_pd-(case when y<=1 then 1 else 0 end),2))/2,6) as rps,
 round(-ln(case y when 0 then dc_ph when 1 then dc_pd else dc_pa end),6) as log_loss,
 round(power(dc_ph-(y=0)::int,2)+power(dc_pd-(y=1)::int,2)+power(dc_pa-(y=2)::int,2),6) as brier,
 case when (case when dc_ph=greatest(dc_ph,dc_pd,dc_pa) then 0 when dc_pd=greatest(dc_ph,dc_pd,dc_pa) then 1 else 2 end)=y then 1.0::double else 0.0::double end as hit
from y""", ("model_probs",))
def f18(spark, sf):
    m = R.add_labels(view(spark, sf, "model_probs"))
    p = ["dc_ph", "dc_pd", "dc_pa"]
    return m.select("match_id", r(S.rps(p, "y")).alias("rps"), r(S.log_loss(p, "y")).alias("log_loss"),
                    r(S.brier(p, "y")).alias("brier"), S.hit(p, "y").alias("hit"))


@query("F19_F20_logit_goal_multiplier", """select match_id, round(ln(dc_ph/(1-dc_ph)),6) as logit_h,
 round(1/(1+exp(-ln(dc_ph/(1-dc_ph)))),6) as back, case when abs(fthg-ftag)<=1 then 1.0::double when abs(fthg-ftag)=2 then 1.5::double
 else (11.0+abs(fthg-ftag))/8.0::double end as mult from model_probs""", ("model_probs",))
def f19(spark, sf):
    m = view(spark, sf, "model_probs")
    return m.select("match_id", r(O.logit("dc_ph")).alias("logit_h"), r(O.expit(O.logit("dc_ph"))).alias("back"),
                    S.goal_multiplier(F.col("fthg") - F.col("ftag")).alias("mult"))


@query("F21_F22_scorer_probabilities", """with s as (select game_id, player_id, goals, toi/sum(toi) over (partition by game_id, home) as share,
 sum(goals) over (partition by game_id, home) as tg from player_games),
p as (select *, 1-exp(-2.8*share) as p1 from s), mu as (select *, -ln(1-least(0.999,greatest(1e-9,p1))) as mu from p)
select game_id, player_id, round(p1,6) as p_score, round(1-power(1-share,tg),6) as p_given,
 round(1-exp(-mu)*(1+mu),6) as p_two, round(1-exp(-mu)*(1+mu+mu*mu/2),6) as p_three from mu""", ("player_games",))
def f21(spark, sf):
    g = view(spark, sf, "player_games")
    s = G.attach_totals(g, ["game_id", "home"], tt=F.sum("toi"), tg=F.sum("goals")).withColumn("share", F.col("toi") / F.col("tt"))
    s = s.withColumn("p1", S.p_score(F.lit(2.8), "share"))
    return s.select("game_id", "player_id", r("p1").alias("p_score"), r(S.p_score_given_goals("tg", "share")).alias("p_given"),
                    r(S.p_more_than("p1", F.lit(1.5))).alias("p_two"), r(S.p_more_than("p1", F.lit(2.5))).alias("p_three"))


@query("F23_regulation_time", """with g as (select game_id, sum(case when home then shots else 0 end)/8.0+1 as lh, sum(case when home then 0 else shots end)/8.0+1 as la
 from player_games group by game_id),
t as (select *, list_sum(list_transform(range(0,25), lambda k: exp(-lh+k*ln(lh)-lgamma(k+1))*exp(-la+k*ln(la)-lgamma(k+1)))) as tie from g)
select game_id, round(1-0.672*tie/(lh+la),6) as ratio, round(1-power(1-0.3,1-0.672*tie/(lh+la)),6) as p_reg from t""", ("player_games",))
def f23(spark, sf):
    g = view(spark, sf, "player_games").groupBy("game_id").agg(
        (F.sum(F.when(F.col("home"), F.col("shots")).otherwise(0)) / 8.0 + 1).alias("lh"),
        (F.sum(F.when(F.col("home"), 0).otherwise(F.col("shots"))) / 8.0 + 1).alias("la"))
    g = g.withColumn("ratio", S.regulation_ratio("lh", "la"))
    return g.select("game_id", r("ratio").alias("ratio"), r(S.to_regulation(F.lit(0.3), "ratio")).alias("p_reg"))


@query("F24_bonus_values", """select match_id, round(p*(maxh-1),6) as freebet, round(maxh*p-1,6) as boosted,
 round(p*(maxh-1)-(1-p)+(1-p)*0.7,6) as refund from (select match_id, maxh, (1/psh)/(1/psh+1/psd+1/psa) as p from matches)""", ("matches",))
def f24(spark, sf):
    m = view(spark, sf, "matches").withColumn("p", O.devig(O.array_of(*PS), "multiplicative")[0])
    return m.select("match_id", r(O.freebet_value("p", "maxh")).alias("freebet"), r(O.boosted_ev("maxh", 1 / F.col("p"))).alias("boosted"),
                    r(O.refund_ev("p", "maxh")).alias("refund"))


@query("F25_arbitrage", """with d as (select market_id, cast(cast(ts as date) as varchar) as day, side, max(odds) as o, arg_max(book, (odds, book)) as book from odds_ticks group by 1,2,3),
t as (select *, sum(1/o) over (partition by market_id, day) as s, count(*) over (partition by market_id, day) as n from d)
select market_id, day, side, book, round(o,6) as odds, round(s,6) as book_sum, round((1/o)/s,6) as stake_share from t where n = 2 and s < 1""", ("odds_ticks",))
def f25(spark, sf):
    t = view(spark, sf, "odds_ticks").withColumn("day", F.to_date("ts").cast("string"))
    best = t.groupBy("market_id", "day", "side").agg(F.max("odds").alias("o"), F.max_by("book", F.struct("odds", "book")).alias("book"))
    tot = G.attach_totals(best, ["market_id", "day"], s=F.sum(1 / F.col("o")), n=F.count(F.lit(1)))
    return tot.where("n = 2 and s < 1").select("market_id", "day", "side", "book", r("o").alias("odds"), r("s").alias("book_sum"),
                                               r(1 / F.col("o") / F.col("s")).alias("stake_share"))


@query("F26_parlay_margin", """select match_id, round((1/psh+1/psd+1/psa)*(1/maxh+1/maxd+1/maxa)*(1/psch+1/pscd+1/psca)-1,6) as parlay_margin from matches""", ("matches",))
def f26(spark, sf):
    m = view(spark, sf, "matches")
    margins = F.array(*[O.margin(O.array_of(*c)) for c in (PS, MAX, PSC)])
    return m.select("match_id", r(O.parlay_margin(margins)).alias("parlay_margin"))
