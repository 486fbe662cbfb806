"""Streaming operators run over everything available (L15-L18, L9, L10, M6, S15), SQL functions (D*), name joins."""
from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import register as REG
from ..functions import score as S
from ..operators import fuzzy
from ..plans import live as L
from ..sources import feeds, files
from ..session import shared_dir
from ..streaming import feeds as FD
from ..streaming import live as ST
from .backtests import rounded
from .model_queries import goals
from .registry import query, r
from .views import table, view

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
                       T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def tick_stream(spark, sf):
    """The events table as a file stream in the shape of odds ticks."""
    e = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf)
    return e.select(F.col("event_id").alias("tick_id"), F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 50).cast("int").alias("market_id"), F.col("event_type").alias("book"),
                    (F.col("event_id") % 2).cast("int").alias("side"), (1.05 + F.col("value") / 50).alias("odds"))


@query("L16_line_movement", """with w as (select market_id, time_bucket(interval 1 day, ts) as w, ts, tick_id, odds from odds_ticks)
select market_id, cast(w as varchar) as window_start, round(arg_min(odds,(ts,tick_id)),6) as open, round(max(odds),6) as high, round(min(odds),6) as low, round(arg_max(odds,(ts,tick_id)),6) as close, count(*) as n from w
where w < (select time_bucket(interval 1 day, max(ts)) from odds_ticks) group by market_id, w""", ("odds_ticks",))
def l16(spark, sf):
    """Daily windows; the last one stays open until the watermark passes it and is not emitted yet."""
    out = ST.run_available(ST.line_movement(tick_stream(spark, sf), ["market_id"], "1 day"), "ohlc", shared_dir(spark))
    last = view(spark, sf, "odds_ticks").agg(F.date_trunc("day", F.max(F.col("ts").cast("timestamp"))).alias("_last"))
    return rounded(out.join(F.broadcast(last), F.col("window_start") < F.col("_last")).drop("_last").withColumn("window_start", F.col("window_start").cast("string")), "market_id", "window_start")


@query("L16_quote_sessions")
def l16s(spark, sf):
    return ST.run_available(ST.quote_sessions(tick_stream(spark, sf), ["market_id"], "6 hours"), "sessions", shared_dir(spark)).groupBy("market_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("sessions"))


@query("L15_new_picks_once", "select count(distinct (market_id, side, book)) as n from odds_ticks", ("odds_ticks",))
def l15(spark, sf):
    t = tick_stream(spark, sf).select(F.col("market_id").cast("string").alias("event"), F.col("side").cast("string").alias("selection"), "book", F.col("ts").alias("detected_at"))
    out = ST.run_available(ST.new_picks_once(t, "60 days"), "picks", shared_dir(spark))
    return out.select("event", "selection", "book").agg(F.count(F.lit(1)).alias("n"))


@query("L9_stream_clv", """with pk as (select market_id, side, min(ts) as detected_at, arg_min(odds, (ts, tick_id)) as odds from odds_ticks group by market_id, side), k as (select *, detected_at + interval 10 day as start from pk),
t as (select k.market_id, k.side, arg_max(t.odds, (t.ts, t.odds)) as fair from k join odds_ticks t on t.market_id=k.market_id and t.side=k.side where t.ts > detected_at and t.ts < start group by 1,2)
select k.market_id, k.side, round(k.odds/fair-1,6) as clv from k left join t using (market_id, side)""", ("odds_ticks",))
def l9s(spark, sf):
    t = view(spark, sf, "odds_ticks").withColumn("ts", F.col("ts").cast("timestamp"))
    pk = t.groupBy("market_id", "side").agg(F.min("ts").alias("at"), F.min_by("odds", F.struct("ts", "tick_id")).alias("price"))
    start = pk.select("market_id", "side", "at", (F.col("at") + F.expr("interval 10 days")).alias("start"), "price")
    rows = start.select("market_id", "side", F.lit("pick").alias("kind"), F.col("at").alias("ts"), "start", "price").unionByName(
        t.join(start.select("market_id", "side", "start", "at"), ["market_id", "side"]).where("ts > at").select("market_id", "side", F.lit("tick").alias("kind"), "ts", "start", F.col("odds").alias("price")))
    path = f"{shared_dir(spark)}/clv-in-{uuid4().hex}"
    rows.write.parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    out = ST.run_available(ST.freeze_clv(stream), "clv", shared_dir(spark))
    return out.select("market_id", "side", r("clv").alias("clv"))


@query("L10_stream_settlement", """with p as (select market_id, min(ts) as start from odds_ticks group by 1) select market_id::int as pick_event, case when market_id%2=0 then 'won' else 'lost' end as result from p""", ("odds_ticks",))
def l10s(spark, sf):
    """Picks joined to results a day later; open picks beyond the watermark are not in the settled part read here."""
    t = view(spark, sf, "odds_ticks").withColumn("ts", F.col("ts").cast("timestamp"))
    p = t.groupBy("market_id").agg(F.min("ts").alias("start"))
    base = f"{shared_dir(spark)}/settle-in-{uuid4().hex}"
    picks = p.select(F.col("market_id").alias("pick_event"), "start", F.lit("H").alias("selection"), F.lit(2.0).alias("odds"))
    res = p.select(F.col("market_id").alias("result_event"), (F.col("start") + F.expr("interval 1 day")).alias("ended"), F.when(F.col("market_id") % 2 == 0, "H").otherwise("A").alias("outcome"))
    picks.write.parquet(f"{base}/p")
    res.write.parquet(f"{base}/r")
    s = ST.settle_stream(spark.readStream.schema(picks.schema).parquet(f"{base}/p"), spark.readStream.schema(res.schema).parquet(f"{base}/r"))
    out = ST.run_available(s.select("pick_event", "result", "profit_units"), "settle", shared_dir(spark))
    return out.where("result <> 'expired'").select("pick_event", "result")


@query("L18_feed_isolation", """with t as (select case when book in ('click','view') then book else 'rest' end as source, tick_id, market_id, odds from odds_ticks),
x as (select source, count(*) as n, count(distinct tick_id) as ids, round(sum(odds),4) as total from t group by source)
select source, case when source='rest' then 'failed' else 'complete' end as first_status, case when source='rest' then 0 else n end as first_held, 'complete' as status,
 case when source='rest' then n else 0 end as taken, n as held, ids, total from x""", ("odds_ticks",))
def l18(spark, sf):
    """Three feeds of ticks, one of which breaks in the first run and is mended in the second; the others are whole after the first."""
    t = tick_stream(spark, sf).withColumn("source", F.when(F.col("book").isin("click", "view"), F.col("book")).otherwise("rest"))
    feed = lambda name: t.where(F.col("source") == name).drop("source")
    broken = feed("rest").withColumn("odds", F.when(F.col("tick_id") > 0, F.raise_error(F.lit("feed is down")).cast("double")).otherwise(F.col("odds")))
    folder = f"{shared_dir(spark)}/feeds-{uuid4().hex}"
    schema = feed("rest").schema
    first = FD.feed_report(FD.run_feeds({"rest": broken, "click": feed("click"), "view": feed("view")}, folder), FD.feed_rows(spark, folder, schema)).select(
        "source", F.col("status").alias("first_status"), F.col("held").alias("first_held")).collect()
    second = FD.run_feeds({x: feed(x) for x in ("click", "rest", "view")}, folder)
    rows = FD.feed_rows(spark, folder, schema)
    sums = rows.groupBy("source").agg(F.countDistinct("tick_id").alias("ids"), r(F.sum("odds"), 4).alias("total"))
    report = FD.feed_report(second, rows).join(spark.createDataFrame(first), "source").join(sums, "source")
    # a batch counts the rows it read; what a feed took in are those that its table gained
    return report.select("source", "first_status", "first_held", "status", (F.col("held") - F.col("first_held")).alias("taken"), "held", "ids", "total")


@query("M6_streaming_elo")
def m6(spark, sf):
    m = view(spark, sf, "matches").select("country", "match_id", "match_date", "home", "away", (F.col("fthg") - F.col("ftag")).alias("gd"))
    out = ST.run_in_order(m, ST.elo_stream, "elo", shared_dir(spark), "country")
    return rounded(out, "match_id", digits=5)


@query("S15_archive_round_trip", "select cast(cast(ts as date) as varchar) as capture_date, count(*) as n from odds_ticks group by 1", ("odds_ticks",))
def s15(spark, sf):
    path = f"{shared_dir(spark)}/archive-{uuid4().hex}"
    t = view(spark, sf, "odds_ticks").withColumn("captured_at", F.col("ts").cast("timestamp"))
    files.append_archive(t.where("side = 0"), path)
    files.append_archive(t.where("side = 1"), path)
    return spark.read.parquet(path).groupBy(F.col("capture_date").cast("string").alias("capture_date")).agg(F.count(F.lit(1)).alias("n"))


@query("S3_S18_dataset_round_trip", "select season, count(*) as n, count(distinct (home, away)) as pairs from matches group by season", ("matches",))
def s3(spark, sf):
    base = f"{shared_dir(spark)}/dataset-{uuid4().hex}"
    m = view(spark, sf, "matches").select(F.col("season").alias("Season"), F.col("match_date").alias("Date"), F.col("league").alias("League"), F.col("home").alias("HomeTeam"), F.col("away").alias("AwayTeam"))
    files.write_dataset(files.with_match_id(m), f"{base}/p")
    g = spark.read.parquet(f"{base}/p").groupBy(F.col("Season").alias("season")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("HomeTeam", "AwayTeam").alias("pairs"))
    files.write_table_csv(g, f"{base}/csv")
    return spark.read.schema("season int, n long, pairs long").option("header", True).csv(f"{base}/csv")


@query("S4_two_outcome_source", """with t as (select match_id, case when country=0 then '0' when home='T1' then 'Coyotes' else home end as home, away, home_win, case when abs(margin*40-400)>=100 then case when margin*40-400>0 then 1+(margin*40-400)/100 else 1+100/abs(margin*40-400) end end as o
 from (select t.*, m.country from two_way t join matches m using (match_id))) select match_id, home, round(case when o between 1.01 and 100 then o end,6) as odds_home from t where home <> '0'""", ("two_way", "matches"))
def s4(spark, sf):
    t = view(spark, sf, "two_way").join(view(spark, sf, "matches").select("match_id", "country"), "match_id")
    t = t.select("match_id", F.col("match_date").alias("date"), F.when(F.col("country") == 0, "0").otherwise(F.col("home")).alias("home"), "away", "home_win", (F.col("margin") * 40 - 400).alias("odds_home"))
    return files.two_outcome_events(t, "ice_hockey", F.lit("NHL"), {"T1": "Coyotes"}, ["odds_home"]).select("match_id", "home", r("odds_home").alias("odds_home"))


@query("S11_state_payload", """select market_id as page_id, concat('P', cast(tick_id as varchar)) as player, 'Buts' as stat, 1.5::double as line, round(odds,6) as odds from odds_ticks where tick_id%3 <> 0""", ("odds_ticks",))
def s11(spark, sf):
    t = view(spark, sf, "odds_ticks").withColumn("page_id", F.concat_ws("-", "market_id", F.to_date("ts").cast("string")))
    k = F.col("tick_id").cast("string")
    g = t.groupBy("page_id", "market_id").agg(F.collect_list("tick_id").alias("ids"), F.map_from_entries(F.collect_list(F.struct(k, F.struct(F.concat(F.lit("P"), k).alias("label"), (F.col("tick_id") % 3 != 0).alias("available"))))).alias("outcomes"),
                                           F.map_from_entries(F.collect_list(F.struct(k, "odds"))).alias("odds"))
    one = F.create_map(F.lit("9"), F.struct(F.lit("Marque 2 buts ou plus").alias("betTitle"), F.lit("").alias("betTypeHelp"), F.lit(True).alias("available"), F.col("ids").alias("outcomes")))
    m = F.create_map(F.lit("1"), F.struct(F.lit(1).alias("matchId"), F.lit("A - B").alias("title"), F.lit(1704067200).alias("matchStart"), F.array(F.lit(9)).alias("bets")))
    p = g.select("page_id", F.to_json(F.struct(m.alias("matches"), one.alias("bets"), "outcomes", "odds")).alias("payload"))
    return feeds.normalised_state_props(p).select(F.split_part("page_id", F.lit("-"), F.lit(1)).cast("int").alias("page_id"), "player", "stat", F.col("line").cast("double").alias("line"), r("odds").alias("odds"))


@query("S12_tree_payload", "select distinct concat('P', cast(tick_id as varchar)) as player, book as market, round(odds,6) as odds from odds_ticks where tick_id%4 <> 0", ("odds_ticks",))
def s12(spark, sf):
    t = view(spark, sf, "odds_ticks").withColumn("page_id", F.concat_ws("-", "market_id", F.to_date("ts").cast("string")))
    sel = F.struct(F.concat(F.lit("P"), F.col("tick_id").cast("string")).alias("name"), "odds", F.when(F.col("tick_id") % 4 == 0, 2).otherwise(1).alias("status"))
    g = t.groupBy("page_id", "book").agg(F.collect_list(sel).alias("selections"))
    grouped = F.struct(F.lit("group").alias("name"), F.array(F.struct(F.col("book").alias("name"), "selections")).alias("groupMarkets"), F.array().cast("array<struct<name:string,odds:double,status:int>>").alias("selections"))
    plain = F.struct(F.col("book").alias("name"), F.array().cast("array<struct<name:string,selections:array<struct<name:string,odds:double,status:int>>>>").alias("groupMarkets"), F.col("selections"))
    m = g.groupBy("page_id").agg(F.collect_list(F.when(F.col("book") == "click", grouped).otherwise(plain)).alias("markets"))
    p = m.select("page_id", F.to_json(F.struct(F.lit("A - B").alias("name"), F.lit("2024-01-01T00:00:00Z").alias("start"), "markets")).alias("payload"))
    return feeds.tree_props(p).select("player", "market", r("odds").alias("odds")).distinct()


@query("D1_sql_functions", """select match_id, round((1/psh)/(1/psh+1/psd+1/psa)*maxh-1,6) as ev, round(greatest(0,((1/psh)/(1/psh+1/psd+1/psa)*maxh-1)/(maxh-1)),6) as kelly from matches""", ("matches",))
def d1(spark, sf):
    REG.register(spark)
    m = view(spark, sf, "matches")
    return spark.sql("select match_id, round(ev(p, maxh), 6) as ev, round(kelly(p, maxh), 6) as kelly from (select match_id, maxh, devig_multiplicative(array(psh, psd, psa))[0] as p from {m})", m=m)


@query("D3_score_cells", """with g as (select distinct 0.8+0.1*(match_id%13)::int as lh, 0.7+0.1*(match_id%11)::int as la from matches)
select round(lh::double,3) as lh, round(la::double,3) as la, round(sum(exp(-lh-la+h*ln(lh)+a*ln(la)-lgamma(h+1)-lgamma(a+1))) filter (h>a),6) as w_home from g, (select unnest(range(0,11)) as h), (select unnest(range(0,11)) as a) group by g.lh, g.la""", ("matches",))
def d3(spark, sf):
    rates = view(spark, sf, "matches").select((0.8 + 0.1 * (F.col("match_id") % 13)).alias("lh"), (0.7 + 0.1 * (F.col("match_id") % 11)).alias("la")).distinct()
    c = REG.score_cells(rates, ["lh", "la"])
    return c.groupBy("lh", "la").agg(r(F.sum(F.when(F.col("h") > F.col("a"), F.col("w")).otherwise(0.0))).alias("w_home")).select(F.round("lh", 3).alias("lh"), F.round("la", 3).alias("la"), "w_home")


# ------------------------------------------------------------------ name joins
@query("J17_name_lookup", """with k as (select p_brand as g, concat('jean ', p_name, ' ', cast(p_partkey%5 as varchar)) as player, p_partkey as pid from part),
u as (select g, player, count(distinct pid) as n, min(pid) as pid from k group by 1,2) select g, player as name, pid as player_id from u where n=1""")
def j17(spark, sf):
    """Exact names only count when one player carries them; shared names are left unresolved."""
    k = table(spark, sf, "part").select(F.col("p_brand").alias("g"), F.concat(F.lit("jean "), "p_name", F.lit(" "), (F.col("p_partkey") % 5).cast("string")).alias("player"), F.col("p_partkey").alias("player_id"))
    w = k.select("g", F.col("player").alias("name")).distinct()
    return fuzzy.lookup_names(w, k, ["g"]).select("g", "name", "player_id")


@query("J9_alias_votes", """select distinct 'C'||cast(country as varchar) as league, 'club '||home||' x' as home, home as alias from matches""", ("matches",))
def j9(spark, sf):
    m = view(spark, sf, "matches").select(F.concat(F.lit("C"), F.col("country").cast("string")).alias("league"), F.col("match_date").alias("day"), "home", "away", "match_id")
    left = m.select(F.col("match_id").alias("id"), "league", "day", F.concat(F.lit("club "), "home", F.lit(" x")).alias("home"), F.concat(F.lit("club "), "away", F.lit(" x")).alias("away"))
    right = m.select(F.col("match_id").alias("id"), "league", "day", F.concat("home").alias("home"), F.concat("away").alias("away"))
    alias = fuzzy.alias_votes(left, right, min_score=1.0)
    return alias.select("league", "home", "alias")


@query("L4_L6_player_prop_comparison", """with b as (select market_id, tick_id%30 as pl, max(odds) as odds, max((tick_id%4=0)::int)=1 as reg from odds_ticks group by 1,2),
s as (select distinct market_id, pl from b where pl%3=0), x as (select b.*, case when pl%3=0 then 0.35 when pl%3=1 then 0.30 end as p, case when pl%3=0 then 'sharp' when pl%3=1 then 'model' end as ref from b),
y as (select *, case when reg then 1-power(1-p,1-0.0246) else p end as fair from x where p is not null), z as (select *, fair*odds-1 as ev from y)
select market_id, pl, ref, round(ev,6) as ev, ev >= case when ref='sharp' then 0.03 else 0.1 end and ev <= 0.3 and odds between 1.15 and 10 as publish from z""", ("odds_ticks",))
def l4(spark, sf):
    t = view(spark, sf, "odds_ticks").withColumn("pl", F.col("tick_id") % 30)
    b = t.groupBy("market_id", "pl").agg(F.max("odds").alias("odds"), F.max(F.col("tick_id") % 4 == 0).alias("reg_only"))
    name = F.concat(F.lit("player "), F.col("pl").cast("string"), F.lit("a"))
    books = b.select("market_id", "pl", F.col("market_id").cast("string").alias("ub_event_id"), F.lit("B").alias("book"), name.alias("player"), F.lit("Buts").alias("stat"), F.lit(0.5).alias("line"), "odds", "reg_only")
    ev = F.concat(F.lit("e"), F.col("market_id").cast("string"))
    sharp = b.where("pl % 3 = 0").select(ev.alias("event"), name.alias("player"), F.lit("Buts").alias("stat"), F.lit(0.5).alias("line"), F.lit(0.35).alias("pin_prob"))
    model = b.where("pl % 3 = 1").select(ev.alias("event"), name.alias("player"), F.lit(0.30).alias("model_prob"))
    links = b.select(F.col("market_id").cast("string").alias("ub_event_id"), ev.alias("event")).distinct()
    ratios = links.select("event", F.lit(None).cast("double").alias("ratio"))
    c = L.compare_props(books, sharp, model, links, ratios)
    pub = (F.col("ev") >= F.col("threshold")) & (F.col("ev") <= L.MAX_EV) & F.col("odds").between(L.MIN_ODDS, L.MAX_ODDS)
    return c.select("market_id", "pl", "ref", r("ev").alias("ev"), pub.alias("publish"))


@query("J4_market_goals_to_players", """select game_id, player_id, round(case when home then 2.5+0.01*(game_id%50) else 2.2+0.01*(game_id%40) end::double,6) as lam, round(1-exp(-(case when home then 2.5+0.01*(game_id%50) else 2.2+0.01*(game_id%40) end)*0.1),6) as p from player_games""", ("player_games",))
def j4(spark, sf):
    g = view(spark, sf, "player_games")
    lam = g.select("game_id").distinct().withColumns({"lam_h": 2.5 + 0.01 * (F.col("game_id") % 50), "lam_a": 2.2 + 0.01 * (F.col("game_id") % 40)})
    j = g.join(lam, "game_id").withColumn("lam", F.when(F.col("home"), F.col("lam_h")).otherwise(F.col("lam_a")))
    return j.select("game_id", "player_id", r("lam").alias("lam"), r(S.p_score("lam", F.lit(0.1))).alias("p"))


@query("L5_scorer_comparison", """with b as (select player_id, game_id, goals, shots, 0.05+0.01*(shots%40) as p, 1.5+0.5*(goals%2) as line_, 2+shots/3.0 as odds from player_games),
m as (select *, -ln(1-p) as mu from b), f as (select *, case when line_=1.5 then 1-exp(-mu)*(1+mu) else 1-exp(-mu)*(1+mu) end as fair, case when goals%2=0 then 0.5 else 1.5 end as line from m)
select game_id, player_id, round((case when line=0.5 then p else fair end)*odds-1,6) as ev from f""", ("player_games",))
def l5(spark, sf):
    g = view(spark, sf, "player_games").withColumn("k", F.concat(F.lit("p"), F.col("player_id").cast("string"), F.lit("x")))
    pred = g.select(F.col("game_id").cast("string").alias("event"), F.col("k").alias("player"), (0.05 + 0.01 * (F.col("shots") % 40)).alias("model_prob"))
    books = g.select("game_id", "player_id", F.col("game_id").cast("string").alias("ub_event_id"), F.col("k").alias("player"), F.when(F.col("goals") % 2 == 0, 0.5).otherwise(1.5).alias("line"), (2 + F.col("shots") / 3.0).alias("odds"))
    links = g.select(F.col("game_id").cast("string").alias("ub_event_id"), F.col("game_id").cast("string").alias("event")).distinct()
    return L.compare_scorers(pred, books, links).select("game_id", "player_id", r("ev").alias("ev"))
