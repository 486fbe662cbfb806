"""Projections, text, feeds, joins and live operators (P*, X*, S*, J*, L*, U*, W8, W14, W15)."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as Y
from ..functions import odds as O
from ..functions import score as S
from ..functions import text as X
from ..operators import fuzzy
from ..operators import reshape as R
from ..plans import live as L
from ..sources import feeds, files
from ..session import cut, shared_dir
from .backtests import rounded
from .odds_math import PS, PSC
from .registry import query, r, sql_power, sql_power_probs
from .views import table, view


# ------------------------------------------------------------------ projections
@query("P2_parse_day", """select match_id, cast(match_date as varchar) as day from matches""", ("matches",))
def p2(spark, sf):
    m = view(spark, sf, "matches").select("match_id", F.when(F.col("match_id") % 2 == 0, F.date_format("match_date", "dd/MM/yyyy")).otherwise(F.date_format("match_date", "dd/MM/yyyy")).alias("t"))
    return m.select("match_id", X.parse_day("t").cast("string").alias("day"))


@query("P3_implausible_odds", """select l_orderkey, l_linenumber, case when l_quantity/10 >= 1.01 and l_quantity/10 <= 4 then l_quantity/10 end as odds from lineitem""")
def p3(spark, sf):
    t = view(spark, sf, "lineitem")
    return t.select("l_orderkey", "l_linenumber", O.implausible_to_null((F.col("l_quantity") / 10).cast("string"), 1.01, 4.0).alias("odds"))


@query("P4_labels", """select match_id, case when fthg>ftag then 0 when fthg=ftag then 1 else 2 end as y, (fthg+ftag>2.5)::int as over25, (fthg>0 and ftag>0)::int as btts, fthg=ftag as won_d from matches""", ("matches",))
def p4(spark, sf):
    return R.add_labels(view(spark, sf, "matches")).select("match_id", "y", "over25", "btts", "won_d")


@query("P5_country_of_league", "select match_id, regexp_replace(replace(league,'-',''), '[0-9]+$', '') as ctry from matches", ("matches",))
def p5(spark, sf):
    return view(spark, sf, "matches").select("match_id", R.country_of(F.regexp_replace("league", "-", "")).alias("ctry"))


@query("P6_symmetric_players", """select match_id, least(w,l) as p1, greatest(w,l) as p2, w <= l as p1_won, round(case when w>l then ol else ow end,6) as odds_1, round(case when w>l then ow else ol end,6) as odds_2
from (select match_id, case when home_win then home else away end as w, case when home_win then away else home end as l, case when home_win then ps_home else ps_away end as ow, case when home_win then ps_away else ps_home end as ol from two_way)""", ("two_way",))
def p6(spark, sf):
    t, h = view(spark, sf, "two_way"), F.col("home_win")
    t = t.select("match_id", F.when(h, F.col("home")).otherwise(F.col("away")).alias("w"), F.when(h, F.col("away")).otherwise(F.col("home")).alias("l"),
                 F.when(h, F.col("ps_home")).otherwise(F.col("ps_away")).alias("ow"), F.when(h, F.col("ps_away")).otherwise(F.col("ps_home")).alias("ol"))
    return rounded(R.to_symmetric(t, "w", "l", {"odds": ("ow", "ol")}), "match_id", "p1", "p2", "p1_won")


@query("P7_select_value", f"""with p as (select *, {sql_power(PS)} as k from matches), c as (select match_id, 'H' as selection, ({sql_power_probs(PS, 'k')[0]})*maxh-1 as ev, maxh as odds from p
 union all select match_id, 'A', ({sql_power_probs(PS, 'k')[2]})*maxa-1, maxa from p) select match_id, selection, round(ev,6) as ev from c where ev >= 0.03 and ev <= 1 and odds >= 1.01 and odds <= 5""", ("matches",))
def p7(spark, sf):
    from .odds_math import MAX
    m = O.with_devig(R.add_labels(view(spark, sf, "matches")), PS, ["s_ph", "s_pd", "s_pa"])
    c = R.candidate_bets(m, R.three_way_legs("s", "max"), ["match_id"])
    return R.select_value(c, 0.03, 1.0, 1.01, 5.0, ["H", "A"]).select("match_id", "selection", r("ev").alias("ev"))


@query("P8_P9_horizon_period", """select tick_id from odds_ticks where ts > timestamp '2024-01-10 00:00:00' and ts < timestamp '2024-01-11 12:00:00'""", ("odds_ticks",))
def p8(spark, sf):
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    return L.upcoming(view(spark, sf, "odds_ticks").withColumn("start", F.col("ts").cast("timestamp")), now, 36).select("tick_id")


@query("P10_competition_filter", """select match_id, league from matches where regexp_matches(league, '^C[0-3]-(0|1)$')""", ("matches",))
def p10(spark, sf):
    return view(spark, sf, "matches").where(F.col("league").rlike("^C[0-3]-(0|1)$")).select("match_id", "league")


@query("P13_P14_sharp_fallback_best_price", """select match_id, round(coalesce(pinh, bfeh),6) as sharp_h, round(greatest(b365h, bwh),6) as best_h from match_books""", ("match_books",))
def p13(spark, sf):
    return view(spark, sf, "match_books").select("match_id", r(F.coalesce("pinh", "bfeh")).alias("sharp_h"), r(O.best_price("b365h", "bwh")).alias("best_h"))


SHARP = """s as (select tick_id, market_id, side, odds, 1/odds+0.02*(tick_id%7)/10 as fair_prob, 0.01*(tick_id%12) as pin_margin, case when tick_id%3=0 then 'moneyline' when tick_id%3=1 then 'total' else 'spread' end as market from odds_ticks)"""


def sharp_ticks(spark, sf):
    t = view(spark, sf, "odds_ticks")
    m = F.when(F.col("tick_id") % 3 == 0, "moneyline").when(F.col("tick_id") % 3 == 1, "total").otherwise("spread")
    return t.withColumns({"fair_prob": 1 / F.col("odds") + 0.02 * (F.col("tick_id") % 7) / 10, "pin_margin": 0.01 * (F.col("tick_id") % 12), "market": m}).withColumn("fair_odds", 1 / F.col("fair_prob"))


@query("P15_watchlist", f"""with {SHARP} select tick_id, round((1/fair_prob)*1.03,6) as min_odds, case when market='moneyline' then 'Vainqueur / 1N2' else 'Total (plus/moins)' end as market_label
from s where pin_margin <= 0.08 and 1/fair_prob >= 1.05 and market in ('moneyline','total')""", ("odds_ticks",))
def p15(spark, sf):
    w = L.watchlist(sharp_ticks(spark, sf))
    return w.select("tick_id", r(F.col("fair_odds") * 1.03).alias("min_odds"), "market_label")


@query("P16_props_table", """with p as (select p_partkey, p_name, case when p_partkey%3=0 then 'Total Goals' when p_partkey%3=1 then 'Total Points' else 'Mystery' end as st, case when p_partkey%2=0 then 'Over' else 'Under' end as selection from part)
select p_partkey, case when st='Mystery' then concat(p_name,' ',st) else p_name end as player, case st when 'Total Goals' then 'Buts' when 'Total Points' then 'Points' else '' end as stat, selection from p where not (st='Total Goals' and selection='Under')""")
def p16(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    st = F.when(k % 3 == 0, "Total Goals").when(k % 3 == 1, "Total Points").otherwise("Mystery")
    s = p.select("p_partkey", F.concat(F.lit("Player Props: "), "p_name", F.lit(" "), st).alias("market"), F.lit(True).alias("is_prop"), F.lit(0.5).alias("line"), F.when(k % 2 == 0, "Over").otherwise("Under").alias("selection"))
    return L.props_table(s).select("p_partkey", "player", "stat", "selection")


# ------------------------------------------------------------------ text
_STOPS = ", ".join(f"'{t}'" for t in X.STOP_TOKENS)


@query("X1_normalise_names", f"""with l as (select doc_id, unnest(string_split(text, chr(10))) as t, generate_subscripts(string_split(text, chr(10)), 1) as line from documents),
t as (select doc_id, line, trim(regexp_replace(lower(regexp_replace(strip_accents(t), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9'' ]+', ' ', 'g')) as s from l),
k as (select doc_id, line, s, list_filter(string_split_regex(s, '\\s+'), lambda w: w <> '' and w not in ({_STOPS})) as w from t)
select doc_id, line::int as line, case when len(w) > 0 then array_to_string(w, ' ') else s end as name from k""")
def x1(spark, sf):
    """Every line of every text as a name; a null text has none."""
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    return d.select("doc_id", (F.col("line") + 1).alias("line"), X.norm_name("t").alias("name"))


@query("X2_similarity", """with a as (select distinct p_name as n from part), t as (select x.n as l, y.n as r from a x join a y on split_part(x.n,' ',1)=split_part(y.n,' ',1)),
j as (select *, list_distinct(string_split(l,' ')) as x, list_distinct(string_split(r,' ')) as y from t)
select l, r, round(case when l=r then 1.0 else greatest(len(list_intersect(x,y))::double/len(list_distinct(list_concat(x,y))), case when (contains(l,r) or contains(r,l)) and least(length(l),length(r))>=4 then 0.9 else 0 end, 1 - levenshtein(l,r)::double/greatest(length(l),length(r))) end,6) as sim from j""")
def x2(spark, sf):
    a = table(spark, sf, "part").select(X.norm_name("p_name").alias("l")).distinct().withColumn("w", F.split_part("l", F.lit(" "), F.lit(1)))
    j = a.join(a.withColumnRenamed("l", "r"), "w")
    return j.select("l", "r", r(X.similarity(F.col("l"), F.col("r"))).alias("sim"))


@query("X3_X4_slug_first_last", """select c_custkey, regexp_replace(regexp_replace(lower(c_name),'[^a-z0-9]+','-','g'),'^-+|-+$','','g') as slug, concat(c_mktsegment,' ',c_name) as flipped from customer""")
def x3(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", X.slug("c_name").alias("slug"), X.first_last(F.concat_ws(", ", "c_name", "c_mktsegment")).alias("flipped"))


BOOST = """concat('CB - ', home, ' gagne et plus de ', cast(1+fthg as varchar), ',5 buts (2,10 -> 2,', cast(20+ftag as varchar), ' / mise max ', cast(10+fthg as varchar), ' €)')"""


def boosts(spark, sf):
    m = view(spark, sf, "matches")
    t = F.concat(F.lit("CB - "), "home", F.lit(" gagne et plus de "), (1 + F.col("fthg")).cast("string"), F.lit(",5 buts (2,10 -> 2,"), (20 + F.col("ftag")).cast("string"),
                 F.lit(" / mise max "), (10 + F.col("fthg")).cast("string"), F.lit(" €)"))
    return m.withColumn("raw", t)


@query("X5_X6_boost_legs", """select match_id, concat(home, ' gagne et plus de ', cast(1+fthg as varchar), ',5 buts') as text, 2.1::double as orig_odds, (10+fthg)::double as max_stake,
 concat('win:', lower(home), '|over:', cast(fthg+1.5 as double)) as legs from matches""", ("matches",))
def x5(spark, sf):
    b = boosts(spark, sf).select("match_id", F.explode(F.array(Y.boost_fields("raw"))).alias("f")).select("match_id", "f.*")      # fields are found once
    legs = F.array_join(F.transform(Y.parse_legs("text"), lambda x: F.concat(x["kind"], F.lit(":"), F.coalesce(x["line"].cast("string"), x["who"]))), "|")
    return b.select("match_id", "text", "orig_odds", "max_stake", legs.alias("legs"))


@query("X7_X8_team_words", """select match_id, case when fthg%2=0 then 'marseille' else 'germany' end as team, case when fthg%2=0 then 'psg v germany' else 'spain v wales' end as en from matches""", ("matches",))
def x7(spark, sf):
    m = view(spark, sf, "matches")
    even = F.col("fthg") % 2 == 0
    return m.select("match_id", Y.plain_team(F.when(even, "L'OM").otherwise("Allemagne")).alias("team"),
                    X.countries_to_english(F.when(even, "PSG v Allemagne").otherwise("Espagne v Pays de Galles")).alias("en"))


@query("X9_X10_clock", """select tick_id, cast(ts::date as varchar) as day, epoch(date_trunc('second', ts))::bigint as secs, strftime((date_trunc('minute', ts) + interval 0 hour), '%Y-%m-%dT%H:%M:00Z') as iso from odds_ticks""", ("odds_ticks",))
def x9(spark, sf):
    t = view(spark, sf, "odds_ticks").withColumn("t", F.col("ts").cast("timestamp"))
    utc = X.local_to_utc(F.date_format("t", "yyyy-MM-dd"), F.date_format("t", "HH:mm"), "Europe/London")       # January: London is UTC
    return t.select("tick_id", F.to_date("t").cast("string").alias("day"), F.unix_timestamp("t").alias("secs"), F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


@query("X11_durations", "select l_orderkey, l_linenumber, round(l_linenumber + l_quantity/60,6) as minutes from lineitem")
def x11(spark, sf):
    t = table(spark, sf, "lineitem")
    return t.select("l_orderkey", "l_linenumber", r(X.duration_minutes(F.concat(F.lit("PT"), "l_linenumber", F.lit("M"), "l_quantity", F.lit("S")))).alias("minutes"))


@query("X12_X13_page_state", """select page_id, length(html) as n, contains(html, '<script id="serverApp-state"') as has_state, len(regexp_extract_all(html, '(?s)<script[^>]*type="application/ld\\+json"[^>]*>(.*?)</script>')) as ld_blocks,
 regexp_extract(html, '<title>([^<]*)</title>', 1) as title from pages""")
def x12(spark, sf):
    p = table(spark, sf, "pages")
    wrapped = F.concat(F.lit('<script id="serverApp-state" type="application/json">'), F.replace(F.regexp_extract("html", r"<title>([^<]*)</title>", 1), F.lit("&"), F.lit("&a;")), F.lit("</script>"))
    return p.select("page_id", F.length("html").alias("n"), X.page_state("html", "serverApp-state").isNotNull().alias("has_state"), F.size(X.linked_data("html")).cast("long").alias("ld_blocks"),
                    F.coalesce(X.page_state(wrapped, "serverApp-state"), F.lit("")).alias("title"))


@query("X14_season_codes", """select match_id, concat(lpad(cast((s%100)::int as varchar),2,'0'), lpad(cast(((s+1)%100)::int as varchar),2,'0')) as code, (year(match_date) - (month(match_date)<9)::int)::int as hockey_season
from (select *, year(match_date) - (month(match_date)<7)::int as s from matches)""", ("matches",))
def x14(spark, sf):
    m = view(spark, sf, "matches")
    return m.select("match_id", X.season_code("match_date").alias("code"), X.season_start("match_date", 9).alias("hockey_season"))


# ------------------------------------------------------------------ sources
@query("S1_P1_csv_tree", """select season, count(*) as n, sum(fthg)::bigint as goals, count(*) filter (avgh >= 1.01) as priced, round(sum(case when avgh >= 1.01 then avgh end),4) as odds from match_books group by season""", ("match_books",))
def s1(spark, sf):
    """Per-season CSVs with old and new headers written to the shared folder and read back."""
    from uuid import uuid4
    base = f"{shared_dir(spark)}/csv-{uuid4().hex}"
    m = view(spark, sf, "match_books").select("season", F.col("home").alias("HomeTeam"), F.col("away").alias("AwayTeam"), F.date_format("match_date", "dd/MM/yyyy").alias("Date"),
                                              F.col("fthg").alias("FTHG"), F.col("ftag").alias("FTAG"), F.col("avgh").alias("AvgH"))
    old = m.where("season < 1998").withColumnsRenamed({"AvgH": "BbAvH", "Date": " Date "})
    old.write.option("header", True).partitionBy("season").csv(f"{base}/old")
    m.where("season >= 1998").write.option("header", True).partitionBy("season").csv(f"{base}/new")
    df = files.load_main(spark, [f"{base}/old", f"{base}/new"])
    s = F.year("Date").cast("int").alias("season")
    return df.groupBy(s).agg(F.count(F.lit(1)).alias("n"), F.sum("FTHG").alias("goals"), F.count("AvgH").alias("priced"), F.round(F.sum("AvgH"), 4).alias("odds"))


@query("S7_bookmaker_payload", """select cast(market_id as varchar) as event_id, book, case when side=0 then 'moneyline' else 'total' end as market, case when tick_id%5=0 then 'Nul' else concat('S', cast(tick_id as varchar)) end as selection, round(odds,6) as odds from odds_ticks where book <> 'error'""", ("odds_ticks",))
def s7(spark, sf):
    t = view(spark, sf, "odds_ticks")
    day = F.to_date("ts")
    o = F.struct(F.when(F.col("tick_id") % 5 == 0, "Draw").otherwise(F.concat(F.lit("S"), F.col("tick_id").cast("string"))).alias("name"), F.col("odds").alias("price"), F.lit(None).cast("double").alias("point"))
    m = t.groupBy("market_id", day.alias("d"), "book", F.when(F.col("side") == 0, "h2h").otherwise("totals").alias("key")).agg(F.collect_list(o).alias("outcomes"))
    b = m.groupBy("market_id", "d", "book").agg(F.collect_list(F.struct("key", "outcomes")).alias("markets"))
    e = b.groupBy("market_id", "d").agg(F.collect_list(F.struct(F.col("book").alias("key"), "markets")).alias("bookmakers"))
    p = e.select(F.to_json(F.array(F.struct(F.col("market_id").cast("string").alias("id"), F.col("d").cast("timestamp").alias("commence_time"), F.lit("A").alias("home_team"), F.lit("B").alias("away_team"), "bookmakers"))).alias("payload"))
    books = ["click", "view", "purchase", "signup", "scroll", "login", "logout", "search"]
    present = [x[0] for x in t.select("book").distinct().collect() if x[0] != "error"]
    return feeds.flatten_bookmakers(p, sorted(set(books) | set(present))).select("event_id", "book", "market", "selection", r("odds").alias("odds"))


@query("S8_matchup_feed", f"""with m as (select match_id, home, away, psh, psd, psa from matches where match_id%10 <> 0), p as (select *, {sql_power(PS)} as k from m)
select match_id as event_id, 'moneyline' as market, home as selection, round({sql_power_probs(PS, 'k')[0]},4) as fair_prob from p union all select match_id, 'moneyline', 'Nul', round({sql_power_probs(PS, 'k')[1]},4) from p
union all select match_id, 'moneyline', away, round({sql_power_probs(PS, 'k')[2]},4) from p""", ("matches",))
def s8(spark, sf):
    m = view(spark, sf, "matches")
    mu = m.select(F.col("match_id").alias("id"), F.lit(None).cast("long").alias("parent_id"), F.lit("matchup").alias("type"), (F.col("match_id") % 10 == 0).alias("is_live"), F.col("match_date").cast("timestamp").alias("start"),
                  "home", "away", F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("description"))
    am = lambda c: F.when(F.col(c) >= 2, 100 * (F.col(c) - 1)).otherwise(-100 / (F.col(c) - 1))      # noqa: E731
    pr = F.array(*[F.struct(F.lit(d).alias("designation"), F.lit(None).cast("string").alias("participant"), F.lit(None).cast("double").alias("points"), am(c).alias("price")) for d, c in zip(("home", "draw", "away"), PS)])
    mk = m.select(F.col("match_id").alias("matchup_id"), F.lit("s;0;m").alias("key"), F.lit("moneyline").alias("market_type"), F.lit(0).alias("period"), F.lit("open").alias("status"), F.lit(False).alias("is_alternate"), pr.alias("prices"))
    return feeds.matchup_odds(mu, mk).select("event_id", "market", "selection", r("fair_prob", 4).alias("fair_prob"))


@query("S9_match_payload", """select match_id, player_id, home, team_id, cast(minutes as int) as time, goals, pen_att::bigint as pen_att, round(greatest(npxg - pen_att*0.05,0),6) as npxg, starter from football_players""", ("football_players",))
def s9(spark, sf):
    p = view(spark, sf, "football_players").withColumn("side", F.when(F.col("home"), "h").otherwise("a"))
    row = F.struct(F.col("player_id").cast("string").alias("player_id"), F.col("team_id").cast("string").alias("team_id"), F.lit("P").alias("player"), F.when(F.col("starter"), F.col("slot")).otherwise("Sub").alias("position"),
                   F.col("minutes").cast("int").cast("string").alias("time"), F.col("goals").cast("string").alias("goals"), F.col("npxg").cast("string").alias("xG"))
    shot = F.struct(F.col("player_id").cast("string").alias("player_id"), F.lit("Penalty").alias("situation"), F.lit("Goal").alias("result"), F.lit("0.05").alias("xG"))
    sides = p.groupBy("match_id", "side").agg(F.map_from_entries(F.collect_list(F.struct(F.col("player_id").cast("string"), row))).alias("r"),
                                             F.flatten(F.collect_list(F.when(F.col("pen_att") > 0, F.array_repeat(shot, F.col("pen_att"))).otherwise(F.array()))).alias("s"))
    m = sides.groupBy("match_id").agg(F.map_from_entries(F.collect_list(F.struct("side", "r"))).alias("rosters"), F.map_from_entries(F.collect_list(F.struct("side", "s"))).alias("shots"))
    out = feeds.match_rows(m.select("match_id", F.to_json(F.struct("rosters", "shots")).alias("payload")))
    return out.select("match_id", "player_id", "home", "team_id", "time", "goals", "pen_att", r("npxg").alias("npxg"), "starter")


@query("S10_skater_reports", """select game_id, player_id, round(toi,6) as toi, round(case when player_id%3=0 then 0 else pp_toi end,6) as pp_toi, goals from player_games""", ("player_games",))
def s10(spark, sf):
    g = view(spark, sf, "player_games")
    a = g.select("game_id", "player_id", "goals", "shots", (F.col("toi") * 60).alias("time_on_ice_per_game"))
    t = g.where("player_id % 3 <> 0").select("game_id", "player_id", (F.col("toi") * 60).alias("time_on_ice"), (F.col("pp_toi") * 60).alias("pp_time_on_ice"))
    return feeds.skater_games(a, t).select("game_id", "player_id", r("toi").alias("toi"), r("pp_toi").alias("pp_toi"), "goals")


@query("S13_player_props", """select match_id as ub_event_id, 'Buts' as stat, home as player, fthg+0.5::double as line, round(maxh,6) as odds from matches where match_id%7 <> 0""", ("matches",))
def s13(spark, sf):
    m = view(spark, sf, "matches")
    out = F.array(F.struct(F.concat("home", F.lit(" "), (F.col("fthg") + 1).cast("string"), F.lit("+")).alias("description"), F.replace(F.col("maxh").cast("string"), F.lit("."), F.lit(",")).alias("price"), (F.col("match_id") % 7 == 0).alias("suspended"), F.lit(False).alias("hidden")),
                  F.struct(F.lit("Aucun").alias("description"), F.lit("9,5").alias("price"), F.lit(False).alias("suspended"), F.lit(False).alias("hidden")))
    g = F.array(F.struct(F.lit("Nombre de Buts - Joueur - Match").alias("description"), F.array(F.struct(F.lit("x").alias("description"), F.lit(False).alias("suspended"), out.alias("outcomes"))).alias("markets")))
    p = m.select(F.to_json(F.struct(F.array(F.struct(F.col("match_id").alias("id"), F.lit("e").alias("description"), F.col("match_date").cast("timestamp").alias("parsedStart"), g.alias("groupedMarkets"))).alias("events"))).alias("payload"))
    return feeds.player_props(p).select("ub_event_id", "stat", "player", F.col("line").cast("double").alias("line"), r("odds").alias("odds"))


@query("S14_J5_new_rows", "select match_id from matches where season = 2000 and match_id % 3 <> 0", ("matches",))
def s14(spark, sf):
    m = view(spark, sf, "matches").where("season = 2000")
    return files.new_rows(m, m.where("match_id % 3 = 0"), ["match_id"]).select("match_id")


@query("S16_fresh_feed", "select tick_id from odds_ticks where ts >= timestamp '2024-01-20 08:00:00' and ts + interval 6 hour > timestamp '2024-01-20 12:00:00'", ("odds_ticks",))
def s16(spark, sf):
    t = view(spark, sf, "odds_ticks").withColumn("captured_at", F.date_trunc("second", F.col("ts").cast("timestamp"))).withColumn("start", F.col("ts").cast("timestamp") + F.expr("interval 6 hours"))
    return feeds.fresh_rows(t, F.lit("2024-01-20 12:00:00").cast("timestamp"), 4.0).select("tick_id")


@query("S17_json_safe", """select match_id, case when fthg=0 then null else round(ftag/fthg::double,6) end as ratio from matches""", ("matches",))
def s17(spark, sf):
    m = view(spark, sf, "matches").select("match_id", r(F.try_divide(F.col("ftag"), F.col("fthg"))).alias("q"), "fthg")
    m = m.select("match_id", F.when(F.col("fthg") == 0, float("nan")).otherwise(F.col("q")).alias("ratio"))
    return files.json_rows(m).select(F.from_json("value", "match_id decimal(38,0), ratio double").alias("j")).select("j.*")


@query("S19_prediction_market_rows", """select tick_id, concat('P', cast(market_id as varchar)) as player, (1+side)::int as threshold, 'goals' as stat, round((0.3+0.31)/2,6) as mid from odds_ticks""", ("odds_ticks",))
def s19(spark, sf):
    t = view(spark, sf, "odds_ticks").select("tick_id", F.concat(F.lit("P"), "market_id", F.lit(": "), (1 + F.col("side")).cast("string"), F.lit("+ goals")).alias("title"), F.lit(0.3).alias("yes_bid"), F.lit(0.31).alias("yes_ask"))
    return feeds.prediction_market_rows(t).select("tick_id", "player", "threshold", "stat", r("mid").alias("mid"))


@query("S20_pair_rows", """with n as (select l_orderkey as k, l_linenumber as ln, (row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey)-1) as rn, l_quantity as q from lineitem)
select (rn//2)::bigint as game_no, max(case when rn%2=0 then q end) as q_v, max(case when rn%2=1 then q end) as q_h from n group by 1""")
def s20(spark, sf):
    t = table(spark, sf, "lineitem").select(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("o"), F.floor(F.col("l_orderkey") / 1000).alias("slice"), F.col("l_quantity").alias("q"))
    return R.pair_consecutive(t, "o", ["q"], "slice")


# ------------------------------------------------------------------ joins and live operators
def events_pair(spark, sf):
    """Two sources of the same fixtures: the second one starts a little later and spells some teams differently."""
    m = view(spark, sf, "matches")
    names = lambda c: F.concat(F.lit("club "), F.element_at(F.array(*[F.lit(x) for x in _CLUBS]), F.substring(c, 2, 2).cast("int") + 1), F.lit(" "), F.col("country").cast("string"))
    left = m.select(F.col("match_id").alias("event_id"), F.col("match_date").cast("timestamp").alias("start"), names("home").alias("home"), names("away").alias("away"))
    right = m.select((-F.col("match_id")).alias("event_id"), (F.col("match_date").cast("timestamp") + F.expr("interval 1 hour")).alias("start"),
                     F.regexp_replace(names("home"), "club ", "").alias("home"), F.concat(names("away"), F.lit(" fc")).alias("away"))
    return left, right


_CLUBS = ("red star", "blue river", "green valley", "white eagles", "black forest", "golden lions", "silver sharks", "iron wolves", "stone bridge", "north harbour", "south gate", "east point", "west field",
          "high park", "low town", "old mill", "new castle", "long lane", "short hill", "bright moor")


def _sql_similarity(a: str, b: str) -> str:
    x, y = f"list_distinct(string_split({a}, ' '))", f"list_distinct(string_split({b}, ' '))"
    return f"""case when {a} = {b} then 1.0 else greatest(len(list_intersect({x}, {y}))::double / len(list_distinct(list_concat({x}, {y}))),
 case when (contains({a}, {b}) or contains({b}, {a})) and least(length({a}), length({b})) >= 4 then 0.9 else 0.0 end, 1.0 - levenshtein({a}, {b})::double / greatest(length({a}), length({b}))) end"""


def _sql_club(team: str) -> str:
    # a lone 1 is one of the tokens that names lose
    return f"([{', '.join(repr(x) for x in _CLUBS)}])[substr({team}, 2, 2)::int + 1] || case when country = 1 then '' else ' ' || country end"


_J7 = f"""e as (select match_id, match_date as d, {_sql_club('home')} as h, {_sql_club('away')} as a from matches),
p as (select l.match_id as left_id, -r.match_id as right_id, {_sql_similarity('l.h', 'r.h')} as sh, {_sql_similarity('l.a', 'r.a')} as sa from e l join e r on l.d = r.d),
c as (select left_id, right_id, least(sh, sa) as score from p where sh >= 0.7 and sa >= 0.7),
k as (select *, row_number() over (partition by left_id order by score desc, right_id) as n, lead(score) over (partition by left_id order by score desc, right_id) as second from c)
select left_id, right_id, round(score, 6) as score from k where n = 1 and score >= 0.8 and (second is null or second <= score - 0.1)"""


@query("J7_match_events", f"with {_J7}", ("matches",))
def j7(spark, sf):
    """Fixtures of the other source by both names; those with a second one nearly as similar are left out."""
    left, right = events_pair(spark, sf)
    return fuzzy.match_events(left, right, max_hours=3.0).select("left_id", "right_id", r("score").alias("score"))


@query("J10_match_by_players", """with b as (select game_id, player_id from player_games), c as (select game_id, count(distinct player_id) as n from b group by 1)
select game_id as book_event, game_id as event, n as common from c where n >= 3""", ("player_games",))
def j10(spark, sf):
    g = view(spark, sf, "player_games").select("game_id", (F.col("game_date").cast("timestamp") + F.make_interval(mins=F.pmod(F.col("game_id") * 37, F.lit(1440)))).alias("start"), F.concat(F.lit("p"), F.col("player_id").cast("string"), F.lit("x"), F.pmod("game_id", F.lit(97)).cast("string")).alias("k"))
    books = g.select(F.col("game_id").alias("book_event"), "start", "k")
    ref = g.select(F.col("game_id").alias("event"), "start", "k")
    return fuzzy.match_by_players(books, ref)


@query("J12_L17_last_snapshot", """with t as (select *, date_trunc('day', ts) + interval 18 hour as start from odds_ticks)
select market_id, side, cast(start::date as varchar) as day, arg_max(tick_id, (ts, tick_id)) as tick_id, round(arg_max(odds, (ts, tick_id)),6) as odds from t where ts < start group by market_id, side, start""", ("odds_ticks",))
def j12(spark, sf):
    t = view(spark, sf, "odds_ticks").withColumn("start", F.date_trunc("day", F.col("ts").cast("timestamp")) + F.expr("interval 18 hours")).withColumn("ts", F.col("ts").cast("timestamp"))
    s = L.last_snapshot(t.select("market_id", "side", "start", "ts", "tick_id", "odds"), ["market_id", "side", "start"], tie="tick_id")
    return s.select("market_id", "side", F.to_date("start").cast("string").alias("day"), "tick_id", r("odds").alias("odds"))


@query("J16_L11_exact_settlement", f"""with b as (select match_id, home, maxh as odds, case when match_id%3=0 then 'H' when match_id%3=1 then 'D' else 'A' end as selection from matches), p as (select *, {sql_power(PSC)} as k from matches),
q as (select match_id, {sql_power_probs(PSC, 'k')[0]} as a, {sql_power_probs(PSC, 'k')[1]} as b, {sql_power_probs(PSC, 'k')[2]} as c, case when fthg>ftag then 'H' when fthg=ftag then 'D' else 'A' end as outcome from p where match_id%4 <> 0)
select b.match_id, case when outcome is null then 'pending' when outcome=selection then 'won' else 'lost' end as status, round(case when outcome=selection then 10*(odds-1) when outcome is not null then -10 end,2) as profit,
 round(odds*(case selection when 'H' then a when 'D' then q.b else c end)-1,4) as clv from b left join q using (match_id)""", ("matches",))
def j16(spark, sf):
    m = R.add_labels(view(spark, sf, "matches"))
    picks = m.select("match_id", F.col("maxh").alias("odds"), F.element_at(F.array(F.lit("H"), F.lit("D"), F.lit("A")), (F.col("match_id") % 3 + 1).cast("int")).alias("selection"), F.lit(10.0).alias("stake"))
    res = O.with_devig(m.where("match_id % 4 <> 0"), PSC, ["c0", "c1", "c2"], fair_cols=["fair_h", "fair_d", "fair_a"])
    res = res.select("match_id", F.element_at(F.array(F.lit("H"), F.lit("D"), F.lit("A")), F.col("y") + 1).alias("outcome"), "fair_h", "fair_d", "fair_a")
    return L.settle_exact(picks, res, ["match_id"]).select("match_id", "status", "profit", "clv")


@query("W8_best_price", "select market_id, side, max(odds) as odds, arg_max(book, (odds, book)) as book from odds_ticks group by market_id, side", ("odds_ticks",))
def w8(spark, sf):
    return view(spark, sf, "odds_ticks").groupBy("market_id", "side").agg(F.max("odds").alias("odds"), F.max_by("book", F.struct("odds", "book")).alias("book"))


PROPS = """p as (select tick_id, book, cast(market_id as varchar)||'-'||cast(cast(ts as date) as varchar) as ub_event_id, concat('player ', cast(tick_id%40 as varchar)) as player, 'Buts' as stat, 0.5::double as line, round(odds,1) as odds from odds_ticks)"""


def props(spark, sf):
    t = view(spark, sf, "odds_ticks")
    return t.select("tick_id", "book", F.concat_ws("-", F.col("market_id").cast("string"), F.to_date("ts").cast("string")).alias("ub_event_id"), F.concat(F.lit("player "), (F.col("tick_id") % 40).cast("string")).alias("player"),
                    F.lit("Buts").alias("stat"), F.lit(0.5).alias("line"), F.round("odds", 1).alias("odds"))


@query("W14_mixed_markets", f"""with {PROPS}, d as (select distinct book, ub_event_id, player, odds from p), b as (select distinct book, ub_event_id from (select book, ub_event_id, player, count(*) as n from d group by all) where n > 1)
select d.book, d.ub_event_id, d.player, d.odds from d left join b on d.book=b.book and d.ub_event_id=b.ub_event_id where b.book is null""", ("odds_ticks",))
def w14(spark, sf):
    return L.drop_mixed_markets(props(spark, sf)).select("book", "ub_event_id", "player", "odds")


@query("W15_implausible_books", """with c as (select tick_id, book, market_id as ub_event_id, odds*0.2-1 as ev from odds_ticks), b as (select book, ub_event_id from c group by all having count(*) >= 5 and quantile_cont(ev,0.5) > 0.05)
select tick_id, round(ev,6) as ev from c anti join b using (book, ub_event_id)""", ("odds_ticks",))
def w15(spark, sf):
    c = view(spark, sf, "odds_ticks").select("tick_id", "book", F.col("market_id").alias("ub_event_id"), (F.col("odds") * 0.2 - 1).alias("ev"))
    return L.drop_implausible(c).select("tick_id", r("ev").alias("ev"))


_L1 = sql_power_probs(PS, "k")


@query("L1_find_value", f"""with k as (select *, {sql_power(PS)} as k from matches), q as (select *, {_L1[0]} as p0, {_L1[1]} as p1, {_L1[2]} as p2 from k),
l as ({' union all '.join(f"select match_id, '{o}' as selection, '{b}' as book, {b}{c} as odds, p{i} as p from q" for b in ('max', 'psc') for i, (o, c) in enumerate(zip('HDA', 'hda')))}),
e as (select *, p*odds-1 as ev from l where odds is not null), s as (select *, row_number() over (partition by match_id order by ev desc, selection, book) as rn from e where ev >= 0.03 and ev <= 0.3 and odds <= 10)
select match_id, selection, book, round(odds,6) as odds, round(ev,6) as ev, round(100*least(0.25*greatest(0,(p*odds-1)/(odds-1)),0.02),2) as stake_pct from s where rn=1""", ("matches",))
def l1(spark, sf):
    m = O.with_devig(view(spark, sf, "matches"), PS, ["p0", "p1", "p2"])
    v = L.find_value(m, ["p0", "p1", "p2"], {"max": ["maxh", "maxd", "maxa"], "psc": PSC}, ["match_id"])
    return v.select("match_id", "selection", "book", r("odds").alias("odds"), r("ev").alias("ev"), "stake_pct")


@query("L2_soft_vs_sharp", """with s as (select market_id as id, 1/(2+side) as p, side from (select distinct market_id, side from odds_ticks)),
f as (select market_id, book, side, odds, case when side=0 then 'A' else 'B' end as sel from odds_ticks)
select f.market_id as sharp_id, sel as sharp_selection, arg_max(book, (odds, book)) as book, max(odds) as odds, round(max(odds)*max(p)-1,6) as ev from f join s on id=market_id and s.side=f.side where book <> 'error' group by f.market_id, sel""", ("odds_ticks",))
def l2(spark, sf):
    """Books that also quote a draw (here 'error') are left out because the sharp market is two-way."""
    t = view(spark, sf, "odds_ticks")
    soft = t.select(F.col("market_id").alias("event_id"), "book", F.lit("moneyline").alias("market"), F.when(F.col("side") == 0, "A").otherwise("B").alias("selection"), F.lit(None).cast("double").alias("line"), "odds", F.lit("A").alias("home"), F.lit("B").alias("away"))
    draw = t.where("book = 'error'").select(F.col("market_id").alias("event_id"), "book", F.lit("moneyline").alias("market"), F.lit("Nul").alias("selection"), F.lit(None).cast("double").alias("line"), F.lit(3.0).alias("odds"), F.lit("A").alias("home"), F.lit("B").alias("away"))
    sharp = t.select(F.col("market_id").alias("event_id"), F.lit("moneyline").alias("market"), F.when(F.col("side") == 0, "A").otherwise("B").alias("selection"), F.lit(None).cast("double").alias("line"), (1 / (2 + F.col("side"))).alias("fair_prob"), F.lit("A").alias("home"), F.lit("B").alias("away")).distinct()
    links = t.select(F.col("market_id").alias("left_id"), F.col("market_id").alias("right_id"), F.lit(False).alias("swapped")).distinct()
    return L.compare_with_sharp(sharp, soft.unionByName(draw), links).select("sharp_id", "sharp_selection", "book", "odds", r("ev").alias("ev"))


@query("L8_T5_merge_value_bets", """with a as (select concat('e', cast(market_id as varchar)) as event, book as market, cast(tick_id as varchar) as selection, odds, 1.04/odds+0.002*(tick_id%50)/odds as fair_prob, case when tick_id%4=0 then 0.09 else 0.02 end as pin_margin from odds_ticks),
e as (select *, round(fair_prob*odds-1,9) as ev from a), g as (select *, row_number() over (partition by event, market order by ev desc, selection) as rn from e where ev between 0.03 and 0.3 and odds between 1.15 and 10 and pin_margin <= 0.08)
select event, market, selection, round(ev,6) as ev, round(100*least(0.25*greatest(0,(fair_prob*odds-1)/(odds-1)),0.02),2) as stake_pct from g where rn=1""", ("odds_ticks",))
def l8(spark, sf):
    t = view(spark, sf, "odds_ticks")
    a = t.select(F.concat(F.lit("e"), "market_id").alias("event"), F.col("book").alias("market"), F.col("tick_id").cast("string").alias("selection"), "odds", "tick_id",
                 (1.04 / F.col("odds") + 0.002 * (F.col("tick_id") % 50) / F.col("odds")).alias("fair_prob"), F.when(F.col("tick_id") % 4 == 0, 0.09).otherwise(0.02).alias("pin_margin"))
    a = a.withColumn("ev", F.round(F.col("fair_prob") * F.col("odds") - 1, 9))
    v = L.merge_value_bets([a.where("tick_id % 2 = 0").drop("tick_id"), a.where("tick_id % 2 = 1").drop("tick_id")])
    return v.select("event", "market", "selection", r("ev").alias("ev"), "stake_pct")


@query("L9_J13_pick_ledger", """with pk as (select market_id, side, min(ts) as detected_at, arg_min(odds, (ts, tick_id)) as odds from odds_ticks group by market_id, side), k as (select *, detected_at + interval 10 day as start from pk),
t as (select k.market_id, k.side, arg_max(t.odds, (t.ts, t.odds)) as fair from k join odds_ticks t on t.market_id=k.market_id and t.side=k.side where t.ts > detected_at and t.ts < start group by 1,2)
select k.market_id, k.side, round(k.odds/fair-1,4) as clv from k left join t using (market_id, side)""", ("odds_ticks",))
def l9(spark, sf):
    t = view(spark, sf, "odds_ticks").withColumn("ts", F.col("ts").cast("timestamp"))
    pk = t.groupBy("market_id", "side").agg(F.min("ts").alias("detected_at"), F.min_by("odds", F.struct("ts", "tick_id")).alias("odds"))
    pk = pk.select(F.col("market_id").cast("string").alias("event"), F.col("side").cast("string").alias("selection"), F.lit("b").alias("book"), "odds", "detected_at", (F.col("detected_at") + F.expr("interval 10 days")).alias("start"), F.col("market_id").cast("string").alias("market_key"))
    ticks = t.select(F.col("market_id").cast("string").alias("market_key"), F.col("side").cast("string").alias("selection"), "ts", F.col("odds").alias("fair_odds"))
    led = L.upsert_picks(pk.where("event < '3'"), pk, ticks, F.lit("2024-03-01").cast("timestamp"))
    return led.select(F.col("event").cast("int").alias("market_id"), F.col("selection").cast("int").alias("side"), "clv")


@query("L10_settle_main", """select match_id, case when match_id%6=0 then 'expired' when match_id%2=0 then case when fthg+ftag=3 then 'refunded' when fthg+ftag>3 then 'won' else 'lost' end when fthg>ftag then 'won' else 'lost' end as result from matches""", ("matches",))
def l10(spark, sf):
    m = view(spark, sf, "matches")
    even = F.col("match_id") % 2 == 0
    picks = m.select(F.col("match_id").alias("pick_id"), F.col("match_id").alias("event_id"), F.col("match_date").cast("timestamp").alias("start"), F.when(even, "total").otherwise("moneyline").alias("market"), F.when(even, "over").otherwise("home").alias("side"), F.lit(3.0).alias("line"), F.col("maxh").alias("odds"))
    sc = m.select(F.col("match_id").alias("score_id"), F.lit(True).alias("completed"), F.col("fthg").alias("home_score"), F.col("ftag").alias("away_score"))
    links = m.where("match_id % 6 <> 0").select(F.col("match_id").alias("event_id"), F.col("match_id").alias("score_id"), F.lit(False).alias("swapped"))
    return L.settle_main(picks, sc, links, F.lit("2002-06-01").cast("timestamp")).select(F.col("pick_id").alias("match_id"), "result")


@query("L12_settle_props", """with g as (select player_id, game_date, count(*) as n, max(goals) as goals, max(ot_goals) as ot from player_games group by 1,2), w as (select a.player_id, a.game_date, a.goals, a.ot, a.n, (select sum(n) from g b where b.player_id=a.player_id and abs(b.game_date - a.game_date) <= 1) as near from g a)
select player_id, cast(game_date as varchar) as day, case when near > 1 then 'open' when goals - case when player_id%2=0 then ot else 0 end > 0.5 then 'won' else 'lost' end as result from w""", ("player_games",))
def l12(spark, sf):
    g = view(spark, sf, "player_games").select("player_id", F.col("game_date").alias("day"), "goals", "assists", "ot_goals")
    picks = g.select("player_id", "day").distinct().withColumns({"stat": F.lit("Buts"), "line": F.lit(0.5), "odds": F.lit(3.0), "reg_only": F.col("player_id") % 2 == 0})
    return L.settle_props(picks, g, F.lit("2002-06-01").cast("date")).select("player_id", F.col("day").cast("string").alias("day"), "result")


@query("L14_settle_combined", """select match_id, case when match_id%9=0 then 'refunded' when fthg>ftag and fthg+ftag>2 and (match_id%5)>=1 then 'won' else 'lost' end as result from matches""", ("matches",))
def l14(spark, sf):
    m = view(spark, sf, "matches")
    leg = lambda kind, **k: F.struct(F.lit(kind).alias("kind"), F.lit(k.get("side")).cast("string").alias("side"), F.lit(k.get("line")).cast("double").alias("line"), F.lit(k.get("k")).cast("int").alias("k"), F.lit(k.get("pid")).cast("long").alias("player_id"))
    p = m.select("match_id", F.col("match_date").cast("timestamp").alias("start"), F.col("maxh").alias("odds"), F.col("fthg").alias("home_score"), F.col("ftag").alias("away_score"),
                 F.array(leg("win", side="h"), leg("over", line=2.5), leg("scores", side="h", pid=7)).alias("legs"),
                 F.when(F.col("match_id") % 9 == 0, F.create_map().cast("map<bigint,int>")).otherwise(F.create_map(F.lit(7).cast("long"), (F.col("match_id") % 5).cast("int"))).alias("goals"))
    return L.settle_combined(p, F.lit("2002-06-01").cast("timestamp")).select("match_id", "result")


@query("L7_label_pricing", """select match_id, case when match_id%3=0 then 'sharp' when match_id%3=1 then 'grid' end as method, case when match_id%3=2 then 'not evaluable' when 0.5*maxh-1 >= case when match_id%3=0 then 0.03 else 0.08 end then 'play' when 0.5*maxh-1 >= 0 then 'marginal' else 'avoid' end as verdict from matches""", ("matches",))
def l7(spark, sf):
    m = view(spark, sf, "matches").withColumn("odds", F.col("maxh"))
    k = F.col("match_id") % 3
    p = L.price_labels(m, F.when(k == 0, F.lit(0.5)), F.lit(None).cast("double"), F.when(k == 1, F.lit(0.5)))
    return p.select("match_id", "method", "verdict")


@query("A15_archive_evaluation", """with a as (select market_id, side, cast(ts as date) as d, arg_max(odds, (ts, tick_id)) as o from odds_ticks where ts < date_trunc('day', ts) + interval 18 hour group by 1,2,3),
e as (select least(0.95,greatest(0.05,1/o)) as pm, least(0.95,greatest(0.05,0.9/o)) as pp, (market_id+side)%2 as y from a), b as (select *, 1/(1+exp(-(0.5*ln(pm/(1-pm))+0.5*ln(pp/(1-pp))))) as pb from e)
select count(*) as n, round(avg(-(y*ln(pm)+(1-y)*ln(1-pm))),6) as ll_model, round(avg(-(y*ln(pp)+(1-y)*ln(1-pp))),6) as ll_sharp, round(avg(-(y*ln(pb)+(1-y)*ln(1-pb))),6) as ll_blend from b""", ("odds_ticks",))
def a15(spark, sf):
    t = view(spark, sf, "odds_ticks").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("d", F.to_date("ts")).withColumn("start", F.date_trunc("day", "ts") + F.expr("interval 18 hours"))
    a = L.last_snapshot(t.select("market_id", "side", "d", "ts", "tick_id", "odds", "start"), ["market_id", "side", "d"], tie="tick_id")
    clip = lambda c: F.least(F.lit(0.95), F.greatest(F.lit(0.05), c))      # noqa: E731
    a = a.select(clip(1 / F.col("odds")).alias("pm"), clip(0.9 / F.col("odds")).alias("pp"), ((F.col("market_id") + F.col("side")) % 2).alias("y"))
    pb = O.expit(0.5 * O.logit("pm") + 0.5 * O.logit("pp"))
    return rounded(a.agg(F.count(F.lit(1)).alias("n"), F.avg(S.binary_log_loss("pm", "y")).alias("ll_model"), F.avg(S.binary_log_loss("pp", "y")).alias("ll_sharp"), F.avg(S.binary_log_loss(pb, "y")).alias("ll_blend")))


@query("U4_U6_team_universe", "select team, count(distinct country) as countries from (select home as team, country from matches union select away, country from matches) group by team", ("matches",))
def u4(spark, sf):
    m = view(spark, sf, "matches")
    u = m.select(F.col("home").alias("team"), "country").union(m.select("away", "country")).distinct()
    return u.groupBy("team").agg(F.countDistinct("country").alias("countries"))


@query("U7_intersect_except", """select match_id, 'both' as part from (select match_id from model_probs where elo_ph is not null intersect select match_id from model_probs where mk_ph is not null)
union all select match_id, 'elo only' from (select match_id from model_probs where elo_ph is not null except select match_id from model_probs where mk_ph is not null)""", ("model_probs",))
def u7(spark, sf):
    m = view(spark, sf, "model_probs")
    e, k = m.where("elo_ph is not null").select("match_id"), m.where("mk_ph is not null").select("match_id")
    return e.intersect(k).withColumn("part", F.lit("both")).union(e.exceptAll(k).withColumn("part", F.lit("elo only")))
