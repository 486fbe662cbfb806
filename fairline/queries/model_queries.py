"""Ratings and fitted probabilities (M*, B7, B8, B9, T1)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import odds as O
from ..functions import score as S
from ..models import boosting, fits, goals, ratings
from ..models import shares as SH
from ..operators import evaluate as E
from ..operators import form as FM
from ..operators import groups as G
from ..operators import reshape as R
from ..operators.form import both_sides
from ..session import cut, stored
from .backtests import rounded
from .history import HP, hockey, hockey_features
from .odds_math import PS
from .registry import query, r, sql_power, sql_power_probs
from .views import view


def _ratings(spark, sf, fold, group, v="matches"):
    return ratings.run_fold(view(spark, sf, v), fold, group, "match_id", "match_date")


@query("M1_football_elo")
def m1(spark, sf):
    return rounded(_ratings(spark, sf, ratings.football_elo(), ["country"])[0], "country", "match_id")


@query("M2_binary_elo")
def m2(spark, sf):
    return rounded(_ratings(spark, sf, ratings.pair_elo(dynamic_k=True, surface_col="surface"), ["tour"], "two_way")[0], "tour", "match_id")


@query("M3_two_outcome_elo")
def m3(spark, sf):
    fold = ratings.pair_elo(k=20, hfa=48, regress=0.33, margin_col="margin", neutral_col="neutral")
    return rounded(_ratings(spark, sf, fold, ["tour"], "two_way")[0], "tour", "match_id")


def international(spark, sf):
    """National-team shape: tournament names from the league, K by importance."""
    names = F.array(*[F.lit(x) for x in ("FIFA World Cup", "UEFA Euro", "UEFA Euro qualification", "Friendly", "Island Games")])
    m = view(spark, sf, "matches").withColumn("tournament", names[(F.col("match_id") % 5).cast("int")])
    return m.withColumns({"k": R.importance_k("tournament"), "neutral": F.col("match_id") % 4 == 0})


def international_ratings(spark, sf, pre=True):
    m = international(spark, sf)
    fold = ratings.football_elo(hfa=100.0, new_team_quantile=None, k_col="k", neutral_col="neutral")
    before, final = ratings.run_fold(m, fold, ["country"], "match_id", "match_date", pre=pre)
    return m, before, final


@query("M4_international_elo")
def m4(spark, sf):
    return rounded(international_ratings(spark, sf)[1], "country", "match_id")


@query("P12_importance_k", """with t as (select match_id, (['FIFA World Cup','UEFA Euro','UEFA Euro qualification','Friendly','Island Games'])[(match_id%5)::int+1] as tournament from matches)
select match_id, case tournament when 'FIFA World Cup' then 60.0::double when 'UEFA Euro' then 50.0::double when 'UEFA Euro qualification' then 40.0::double when 'Friendly' then 20.0::double else 30.0::double end as k from t""", ("matches",))
def p12(spark, sf):
    return international(spark, sf).select("match_id", "k")


@query("M5_pi_ratings")
def m5(spark, sf):
    return rounded(_ratings(spark, sf, ratings.pi_ratings(), ["country"])[0], "country", "match_id")


@query("T1_team_ranking")
def t1(spark, sf):
    m, _, final = international_ratings(spark, sf, pre=False)
    seen = m.select(F.col("match_date").alias("date"), F.explode(F.array("home", "away")).alias("team"))
    final = final.withColumn("team", F.col("team"))
    return ratings.rank_active(final, seen, "2001-11-04").limit(40).select("country", "team", F.round("rating", 0).alias("rating"))


def season_ordered(df, x, prefix, window=6):
    """Walk-forward ordered logit: each season scored by a fit on the previous ones, all fits batched."""
    # every iteration reads three columns of the rows anew, and the scores all of them: what leads to them is done once
    df = stored(df)
    served = fits.served_seasons(df, "season", window)
    train = df.select(F.col("season").alias("fold"), x, "y").where(F.col("fold").isin(list(served)))
    params = fits.fit_ordered_logit(train, x, "y", served=served)
    return fits.apply_ordered_logit(df, params, x, "season", prefix)


def elo_matches(spark, sf):
    pre = stored(_ratings(spark, sf, ratings.football_elo(), ["country"])[0].drop("country"))
    return R.add_labels(view(spark, sf, "matches")).join(pre, "match_id")


@query("M7_ordered_logit")
def m7(spark, sf):
    return rounded(season_ordered(elo_matches(spark, sf).select("match_id", "season", "y", "elo_diff"), "elo_diff", "elo").select("match_id", "elo_ph", "elo_pd", "elo_pa"), "match_id")


@query("B8_international_quality")
def b8(spark, sf):
    m, pre, _ = international_ratings(spark, sf)
    df = R.add_labels(m).join(stored(pre.select("match_id", "elo_diff")), "match_id")
    scored = season_ordered(df.select("season", "tournament", "y", "elo_diff"), "elo_diff", "p", window=10)
    return rounded(E.score_table(scored, {"elo": ["p_ph", "p_pd", "p_pa"]}, keys=["tournament"]), "tournament", "model")


def blend_matches(spark, sf):
    t = view(spark, sf, "two_way")
    feats = ["elo_diff", "elo_surf_diff"]
    pre = ratings.run_fold(t, ratings.pair_elo(dynamic_k=True, surface_col="surface"), ["tour"], "match_id", "match_date")[0]
    t = O.with_devig(t, ["ps_home", "ps_away"], ["p_mkt", "_q"]).join(pre.select("match_id", *feats), "match_id")
    # read by every iteration of the fit and by the scoring: joined once
    t = stored(t.select("match_id", "tour", "season", "home_win", "p_mkt", *feats))
    served = fits.served_seasons(t, "season", None)
    train = t.select(F.col("season").alias("fold"), F.col("home_win").cast("int").alias("y"), *feats).where(F.col("fold").isin(list(served)))
    t = fits.apply_logistic(t, fits.fit_logistic(train, feats, "y", served=served), feats, "season", "p_model")
    return t


@query("M8_walk_forward_logistic")
def m8(spark, sf):
    return rounded(blend_matches(spark, sf).select("match_id", "p_model"), "match_id")


@query("B5_model_market_blend_quality")
def b5q(spark, sf):
    t = stored(blend_matches(spark, sf).where("p_model is not null").withColumns(
        {"lg_mkt": O.logit("p_mkt"), "lg_model": O.logit("p_model"), "y": F.col("home_win").cast("int")}).select("tour", "season", "y", "p_model", "p_mkt", "lg_mkt", "lg_model"))
    served = fits.served_seasons(t, "season", None)
    train = t.withColumnRenamed("season", "fold").where(F.col("fold").isin(list(served)))
    b = fits.apply_logistic(t, fits.fit_logistic(train, ["lg_mkt", "lg_model"], "y", served=served), ["lg_mkt", "lg_model"], "season", "p_blend")
    b = b.where("p_blend is not null")
    return rounded(b.groupBy("tour").agg(F.count(F.lit(1)).alias("n"), *[F.avg(S.binary_log_loss(p, "y")).alias(f"ll_{p}") for p in ("p_model", "p_mkt", "p_blend")],
                                         F.avg((F.col("p_blend") - F.col("y")) ** 2).alias("brier_blend")), "tour")


@query("M9_dixon_coles_walk_forward")
def m9(spark, sf):
    m = view(spark, sf, "matches")
    params = cut(goals.fit_walk_forward(m, "country"))
    d = goals.score_matches(m, params, "country")
    return d.select("match_id", "dc_known", *[r(f"dc_{c}").alias(f"dc_{c}") for c in ("ph", "pd", "pa", "over25", "btts", "lambda", "mu")])


@query("M24_dixon_coles_today")
def m24(spark, sf):
    return rounded(goals.fit_today(view(spark, sf, "matches"), "country", "2001-06-01"), "grp", "team", digits=5)


_pm = "exp(-{l}+{k}*ln({l})-lgamma({k}+1))"


@query("M10_score_probabilities", f"""with g as (select match_id, 0.6+0.02*(match_id%89)::int as lam, 0.5+0.015*(match_id%97)::int as mu, -0.1+0.002*(match_id%83)::int as rho from matches),
d as (select distinct lam, mu, rho from g),
c as (select lam, mu, rho, h, a, {_pm.format(l='lam', k='h')}*{_pm.format(l='mu', k='a')}*(case when h=0 and a=0 then greatest(1-lam*mu*rho,1e-10) when h=0 and a=1 then 1+lam*rho
 when h=1 and a=0 then 1+mu*rho when h=1 and a=1 then 1-rho else 1 end) as p from d, (select unnest(range(0,11)) as h), (select unnest(range(0,11)) as a)),
s as (select lam, mu, rho, sum(p) as t, sum(p) filter (h>a) as w, sum(p) filter (h=a) as e, sum(p) filter (h<a) as l, sum(p) filter (h+a>2) as o, sum(p) filter (h>0 and a>0) as b from c group by 1,2,3)
select match_id, round(w/t,6) as ph, round(e/t,6) as pd, round(l/t,6) as pa, round(o/t,6) as over25, round(b/t,6) as btts from g join s using (lam, mu, rho)""", ("matches",))
def m10(spark, sf):
    m = view(spark, sf, "matches").select("match_id", (0.6 + 0.02 * (F.col("match_id") % 89)).alias("lam"), (0.5 + 0.015 * (F.col("match_id") % 97)).alias("mu"),
                                          (-0.1 + 0.002 * (F.col("match_id") % 83)).alias("rho"))
    s = m.select("match_id", F.explode(F.array(goals.score_probs(F.col("lam"), F.col("mu"), F.col("rho")))).alias("s"))
    return s.select("match_id", *[r(F.col(f"s.{c}")).alias(c) for c in ("ph", "pd", "pa", "over25", "btts")])


_mp = sql_power_probs(PS, "k")
_MKT = f"p as (select match_id, {_mp[0]} as ph, {_mp[1]} as pd, {_mp[2]} as pa, 0.42+0.004*(match_id%29)::int as po from (select *, {sql_power(PS)} as k from matches))"


def market(spark, sf):
    m = O.with_devig(view(spark, sf, "matches").select("match_id", *PS), PS, ["ph", "pd", "pa"])
    return m.withColumn("po", 0.42 + 0.004 * (F.col("match_id") % 29)).select("match_id", "ph", "pd", "pa", "po")


@query("M11_market_implied_goals", f"with {_MKT} select match_id, round(ph/(ph+pa),5) as home_share, round(po::double,5) as p_over from p", ("matches",))
def m11(spark, sf):
    """Round trip: the implied goals give back the home share of decided matches and the over price."""
    m = market(spark, sf)
    m = m.withColumn("g", goals.football_goals("ph", "pd", "po", F.lit(2.5)))
    m = m.select("match_id", F.explode_outer(F.array(goals.score_probs(F.col("g.lam_h"), F.col("g.lam_a"), F.lit(0.0), 15))).alias("s"))
    return m.select("match_id", r(F.col("s.ph") / (F.col("s.ph") + F.col("s.pa")), 5).alias("home_share"), r("s.over25", 5).alias("p_over"))


@query("M11_hockey_implied_goals", f"with {_MKT} select match_id, round(ph+pd/2,4) as p_home, round(po::double,4) as p_over from p", ("matches",))
def m11h(spark, sf):
    m = market(spark, sf)
    m = m.withColumn("g", goals.hockey_goals(F.col("ph") + F.col("pd") / 2, "po", F.lit(2.5)))
    m = m.select("match_id", F.explode_outer(F.array(goals.score_probs(F.col("g.lam_h"), F.col("g.lam_a"), F.lit(0.0), 20))).alias("s"))
    return m.select("match_id", r(F.col("s.ph") + F.col("s.pd") / 2, 4).alias("p_home"), r("s.over25", 4).alias("p_over"))


def fitted_grid(spark, sf):
    """Coherent prices: outcome and total probabilities of known goal rates, fitted back."""
    m = view(spark, sf, "matches").select("match_id", (0.8 + 0.1 * (F.col("match_id") % 13)).alias("lam"), (0.7 + 0.1 * (F.col("match_id") % 11)).alias("mu"))
    m = m.select("match_id", F.explode_outer(F.array(goals.score_probs(F.col("lam"), F.col("mu"), F.lit(-0.05)))).alias("s")).select("match_id", "s.*")
    m = m.withColumn("g", goals.score_grid("ph", "pd", F.array(F.lit(2.5)), F.array("over25")))
    return m.select("match_id", "ph", "pd", "over25", "g.*")


_GRID = f"""g as (select match_id, 0.8+0.1*(match_id%13)::int as lam, 0.7+0.1*(match_id%11)::int as mu from matches), d as (select distinct lam, mu from g),
c as (select lam, mu, h, a, {_pm.format(l='lam', k='h')}*{_pm.format(l='mu', k='a')}*(case when h=0 and a=0 then 1+0.05*lam*mu when h=0 and a=1 then 1-0.05*lam when h=1 and a=0 then 1-0.05*mu when h=1 and a=1 then 1.05 else 1 end) as p
 from d, (select unnest(range(0,11)) as h), (select unnest(range(0,11)) as a))"""


@query("M12_M13_score_grid", f"""with {_GRID}, s as (select lam, mu, sum(p) as t, sum(p) filter (h>a) as w, sum(p) filter (h-a>=2) as m2, sum(p) filter (h>a and a=0) as nil, sum(p) filter (h>0 and a>0 and h+a>2) as bo from c group by 1,2)
select match_id, round(w/t,3) as p_home, round(m2/t,3) as p_margin2, round(nil/t,3) as p_win_nil, round(bo/t,3) as p_btts_over from g join s using (lam, mu)""", ("matches",))
def m12(spark, sf):
    ev = {"p_home": lambda h, a: h > a, "p_margin2": lambda h, a: h - a >= 2, "p_win_nil": lambda h, a: (h > a) & (a == 0), "p_btts_over": lambda h, a: (h > 0) & (a > 0) & (h + a > 2)}
    return rounded(goals.event_probabilities(fitted_grid(spark, sf), ["match_id"], "lam_h", "lam_a", "rho", {n: goals.indicator(c) for n, c in ev.items()}), "match_id", digits=3)


@query("M14_players_and_score", f"""with {_GRID}, s as (select lam, mu, sum(p) as t, sum(p*(1-power(1-0.972*0.3,h))) filter (h>a) as one, sum(p*(1-power(1-0.972*0.3,h)-power(1-0.972*0.2,h)+power(1-0.972*0.5,h))) as two,
 sum(p*(1-power(1-0.972*0.4,a)-a*0.972*0.4*power(1-0.972*0.4,greatest(a-1,0)))) as brace from c group by 1,2)
select match_id, round(one/t,3) as p_win_and_scorer, round(two/t,3) as p_two_scorers, round(brace/t,3) as p_brace from g join s using (lam, mu)""", ("matches",))
def m14(spark, sf):
    ev = {"p_win_and_scorer": lambda h, a: goals.indicator(lambda x, y: x > y)(h, a) * goals.players_factor(h, [F.lit(0.3)]),
          "p_two_scorers": lambda h, a: goals.players_factor(h, [F.lit(0.3), F.lit(0.2)]), "p_brace": lambda h, a: goals.brace_factor(a, F.lit(0.4))}
    return rounded(goals.event_probabilities(fitted_grid(spark, sf), ["match_id"], "lam_h", "lam_a", "rho", ev), "match_id", digits=3)


@query("M17_conditional_logit")
def m17(spark, sf):
    f = stored(hockey_features(spark, sf).select("season", "game_id", "home", "goals", *SH.HOCKEY_FEATURES))
    train = fits.season_folds(f, "season", 3)
    beta = fits.fit_conditional_logit(train, ["game_id", "home"], SH.HOCKEY_FEATURES, "goals", [1.0, 0.0, 1.0, 1.0, 0.0, 0.0])
    rows = [(int(k), n, float(b)) for k, v in sorted(beta.items()) for n, b in zip(SH.HOCKEY_FEATURES, v)]
    return spark.createDataFrame(rows, "season int, feature string, beta double").select("season", "feature", r("beta", 5).alias("beta"))


@query("M18_hyperparameter_grid")
def m18(spark, sf):
    """Shrinkage grid: settings are the fold key of one batched fit, scored on held-out seasons."""
    h = stored(hockey(spark, sf).select("season", "game_id", "home", "pos", "goals", "shots", "toi", "pp_toi", "n_prev", "s_toi", "s_shots", "s_goals", "toi_exp", "pp_exp"))
    pri = SH.hockey_priors(h.where("season <= 1998"))
    grid = [(i, float(kt), float(ks)) for i, (kt, ks) in enumerate([(a, b) for a in (150, 600) for b in (50, 300)])]
    spec = F.explode(F.array(*[F.struct(F.lit(i).alias("fold"), F.lit(a).alias("k_toi"), F.lit(b).alias("k_shots")) for i, a, b in grid]))
    f = h.withColumn("_s", spec).select("*", "_s.*").drop("_s")
    f = SH.hockey_features(f, pri, F.col("k_toi"), F.col("k_shots"))
    f = stored(f.select("fold", "k_toi", "k_shots", "season", "game_id", "home", "goals", *SH.HOCKEY_FEATURES))
    beta = fits.fit_conditional_logit(f.where("season <= 1998"), ["game_id", "home"], SH.HOCKEY_FEATURES, "goals", [1.0, 0.0, 1.0, 1.0, 0.0, 0.0])
    names = [f"b{i}" for i in range(len(SH.HOCKEY_FEATURES))]
    v = f.where("season between 1999 and 2000").join(fits._param_table(spark, beta, names, "int"), "fold")
    eta = F.lit(0.0)
    for n, c in zip(names, SH.HOCKEY_FEATURES):
        eta = eta + F.col(n) * F.col(c)
    s = G.softmax_share(v, ["fold", "game_id", "home"], eta)
    return rounded(SH.log_loss_per_goal(s, keys=["fold", "k_toi", "k_shots"]).orderBy("ll_per_goal").limit(1), "fold", "k_toi", "k_shots", digits=5)


@query("M20_season_boosting")
def m20(spark, sf):
    m = R.add_labels(view(spark, sf, "match_books"))
    form = cut(both_sides(FM.team_form(view(spark, sf, "match_books"), spans=(5,)).select("match_id", "is_home", "n_played", "gf_ew5", "ga_ew5", "pts_ew5")))
    d = m.join(form, "match_id").select("match_id", "season", "y", "over25", "po", "avgh", "avga", *[f"{s}_{c}" for s in "ha" for c in ("gf_ew5", "ga_ew5", "pts_ew5")])
    feats = ["avgh", "avga"] + [f"{s}_{c}" for s in "ha" for c in ("gf_ew5", "ga_ew5", "pts_ew5")]
    d = cut(d)
    out = boosting.season_boosting(d, feats, "over25", 2, "gbmou", [2001], trees=5, depth=3, min_rows=100)
    return out.select("match_id", r("gbmou_p").alias("gbmou_p"))


@query("B7_scorer_evaluation")
def b7(spark, sf):
    """Share model against baselines, given the team's goals: log-loss and Brier per method."""
    f = hockey_features(spark, sf)
    f = G.softmax_share(f, ["game_id", "home"], fits.linear_predictor(SH.HOCKEY_FEATURES, SH.HOCKEY_BETA))
    t = G.attach_totals(f.withColumn("rg", F.col("s_goals") + 0.5), ["game_id", "home"], tg=F.sum("goals"), n=F.count(F.lit(1)), rs=F.sum("rg"), ns=F.sum("r_simple"))
    methods = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), c.alias("s")) for m, c in
                                  (("uniform", 1 / F.col("n")), ("recent goals", F.col("rg") / F.col("rs")), ("naive product", F.col("r_simple") / F.col("ns")), ("model", F.col("share")))]))
    t = t.select("tg", (F.col("goals") > 0).cast("double").alias("y"), methods.alias("m")).select("tg", "y", "m.*").where("tg > 0")
    p = S.p_score_given_goals("tg", "s")
    return rounded(t.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.avg(S.binary_log_loss(p, F.col("y"), 1e-6)).alias("log_loss"), F.avg((p - F.col("y")) ** 2).alias("brier")), "method")


@query("B9_prediction_features")
def b9(spark, sf):
    """Feature and prediction table: market, Elo, pi-ratings, Dixon-Coles and calibrations per match."""
    m = R.add_labels(view(spark, sf, "matches"))
    m = O.with_devig(m, PS, ["mk_ph", "mk_pd", "mk_pa"])
    elo = _ratings(spark, sf, ratings.football_elo(), ["country"])[0].select("match_id", "elo_diff")
    pi = _ratings(spark, sf, ratings.pi_ratings(), ["country"])[0].select("match_id", "pi_gd")
    params = cut(goals.fit_walk_forward(view(spark, sf, "matches"), "country"))
    dc = goals.score_matches(view(spark, sf, "matches"), params, "country").select("match_id", "dc_ph", "dc_pd", "dc_pa")
    d = m.join(elo, "match_id").join(pi, "match_id").join(dc, "match_id", "left")
    d = season_ordered(d.select("season", "y", "mk_ph", "mk_pd", "mk_pa", "elo_diff", "pi_gd", "dc_ph", "dc_pd", "dc_pa"), "elo_diff", "elo")
    d = season_ordered(d, "pi_gd", "pi")
    return rounded(E.score_table(d, {"market": ["mk_ph", "mk_pd", "mk_pa"], "elo": ["elo_ph", "elo_pd", "elo_pa"], "pi": ["pi_ph", "pi_pd", "pi_pa"],
                                     "dixon_coles": ["dc_ph", "dc_pd", "dc_pa"]}), "model")
