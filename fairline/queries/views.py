"""Sports-shaped views over the supplied tables, in SQL text both engines accept.

The same text builds the Spark DataFrame and the CTE of the twin SQL, so both sides start from
equal rows. A match id holds all four key columns of its row, each with the digits that the largest scale needs. Outcomes are unrelated to odds here: values test arithmetic only.
"""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")

# rows of lineitem that one task joins and groups
ROWS_A_TASK = 250_000

VIEWS: dict[str, str] = {}

VIEWS["match_base"] = """
select cast(cast(l_orderkey as decimal(12,0)) * cast(10000000000000000000000 as decimal(23,0)) + cast(l_partkey as decimal(11,0)) * cast(100000000000 as decimal(12,0))
  + cast(l_suppkey as decimal(10,0)) * cast(10 as decimal(2,0)) + cast(l_linenumber as decimal(1,0)) as decimal(38,0)) as match_id,
 cast(l_shipdate as date) as match_date, cast(year(l_shipdate) as int) as season,
 cast(l_orderkey % 8 as int) as country,
 concat('C', cast(l_orderkey % 8 as varchar(9)), '-', cast(l_partkey % 3 as varchar(9))) as league,
 concat('T', cast(l_suppkey % 20 as varchar(9))) as home,
 concat('T', cast((l_suppkey % 20 + 1 + l_partkey % 19) % 20 as varchar(9))) as away,
 cast(cast(l_quantity as int) % 5 as int) as fthg, cast(l_partkey % 4 as int) as ftag,
 cast(1 + l_suppkey % 5 as double) as wh, cast(1.5 as double) as wd, cast(1 + l_partkey % 6 as double) as wa,
 l_linenumber as ln, l_orderkey as ok, l_partkey as pk, cast(l_quantity as int) as q
from lineitem"""

VIEWS["matches"] = """
select match_id, match_date, season, country, league, home, away, fthg, ftag,
 (wh+wd+wa)/(wh*1.025) as psh, (wh+wd+wa)/(wd*1.025) as psd, (wh+wd+wa)/(wa*1.025) as psa,
 (wh+wd+wa)/(wh*1.06)*(1+(ln+ok)%7*0.025) as maxh, (wh+wd+wa)/(wd*1.06)*(1+(ln+pk)%7*0.025) as maxd,
 (wh+wd+wa)/(wa*1.06)*(1+(ok+pk)%7*0.025) as maxa,
 (wh+wd+wa)/(wh*(1.01+(pk%4)*0.01)) as psch, (wh+wd+wa)/(wd*(1.01+(ok%4)*0.01)) as pscd,
 (wh+wd+wa)/(wa*(1.01+(ln%4)*0.01)) as psca
from match_base"""

VIEWS["match_books"] = """
select m.*,
 (wh+wd+wa)/(wh*1.06) as avgh, (wh+wd+wa)/(wd*1.06) as avgd, (wh+wd+wa)/(wa*1.06) as avga,
 (wh+wd+wa)/(wh*1.07)*(1+(ln+ok)%5*0.02) as b365h, (wh+wd+wa)/(wd*1.07)*(1+(ln+pk)%5*0.02) as b365d,
 (wh+wd+wa)/(wa*1.07)*(1+(ok+pk)%5*0.02) as b365a,
 case when ok%9 <> 0 then (wh+wd+wa)/(wh*1.08)*(1+(pk+q)%4*0.03) end as bwh,
 case when ok%9 <> 0 then (wh+wd+wa)/(wd*1.08)*(1+(ok+q)%4*0.03) end as bwd,
 case when ok%9 <> 0 then (wh+wd+wa)/(wa*1.08)*(1+(ln+q)%4*0.03) end as bwa,
 case when pk%7 <> 0 then (wh+wd+wa)/(wh*1.015) end as bfeh, case when pk%7 <> 0 then (wh+wd+wa)/(wd*1.02) end as bfed,
 case when pk%7 <> 0 then (wh+wd+wa)/(wa*1.03) end as bfea,
 case when ok%10 <> 0 then (wh+wd+wa)/(wh*1.025) end as pinh, case when ok%10 <> 0 then (wh+wd+wa)/(wd*1.025) end as pind,
 case when ok%10 <> 0 then (wh+wd+wa)/(wa*1.025) end as pina,
 1/((0.35+0.05*((pk+ok)%7))*1.025) as po, 1/((0.65-0.05*((pk+ok)%7))*1.025) as pu,
 1/((0.35+0.05*((pk+ok)%7))*1.05)*(1+(ln+q)%6*0.03) as maxo, 1/((0.65-0.05*((pk+ok)%7))*1.05)*(1+(pk+q)%6*0.03) as maxu,
 1/((0.35+0.05*((pk+ok)%7))*1.015) as pco, 1/((0.65-0.05*((pk+ok)%7))*1.02) as pcu,
 cast(5 + q%12 as int) as hs, cast(4 + pk%11 as int) as as_, cast(2 + q%5 as int) as hst, cast(1 + pk%5 as int) as ast_,
 cast(q%9 as int) as hc, case when ok%13 <> 0 then cast(pk%8 as int) end as ac
from match_base m"""

VIEWS["model_probs"] = """
select match_id, match_date, season, country, league, home, away, fthg, ftag,
 (wh+0.4*q%3)/(wh+wd+wa+0.4*q%3) as dc_ph, wd/(wh+wd+wa+0.4*q%3) as dc_pd, wa/(wh+wd+wa+0.4*q%3) as dc_pa,
 case when ok%11 <> 0 then (wh+0.5)/(wh+wd+wa+1.5) end as elo_ph, case when ok%11 <> 0 then (wd+0.5)/(wh+wd+wa+1.5) end as elo_pd,
 case when ok%11 <> 0 then (wa+0.5)/(wh+wd+wa+1.5) end as elo_pa,
 case when pk%13 <> 0 then wh/(wh+wd+wa) end as mk_ph, case when pk%13 <> 0 then wd/(wh+wd+wa) end as mk_pd,
 case when pk%13 <> 0 then wa/(wh+wd+wa) end as mk_pa
from match_base"""

VIEWS["two_way"] = """
select match_id, match_date, season, case when country%2=0 then 'ATP' else 'WTA' end as tour,
 case when ln%3=0 then 'Hard' when ln%3=1 then 'Clay' else 'Grass' end as surface,
 home, away, q%2=0 as home_win, cast(0 as int) as neutral, cast(q%23 as double) as margin,
 (wh+wa)/(wh*1.025) as ps_home, (wh+wa)/(wa*1.025) as ps_away,
 (wh+wa)/(wh*1.055)*(1+(ln+ok)%5*0.02) as max_home, (wh+wa)/(wa*1.055)*(1+(ln+pk)%5*0.02) as max_away,
 (wh+wa)/(wh*1.06) as avg_home, (wh+wa)/(wa*1.06) as avg_away,
 (wh+wa)/(wh*1.04)*(1+(ok+pk)%5*0.02) as open_home, (wh+wa)/(wa*1.04)*(1+(ok+q)%5*0.02) as open_away
from match_base"""

VIEWS["player_games"] = """
select l_orderkey as game_id, cast(o_orderdate as date) as game_date, cast(year(o_orderdate) as int) as season,
 cast(l_partkey % 400 as int) as player_id,
 min(l_linenumber) % 2 = 1 as home, case when l_partkey % 400 % 3 = 0 then 'D' else 'F' end as pos,
 concat('T', cast((l_orderkey + (min(l_linenumber) % 2)) % 20 as varchar(9))) as team,
 cast(sum(case when cast(l_quantity as int) % 9 = 0 then 1 else 0 end) as int) as goals,
 cast(sum(cast(l_quantity as int) % 2) as int) as assists, cast(max(case when cast(l_quantity as int) % 18 = 0 then 1 else 0 end) as int) as ot_goals,
 cast(sum(cast(l_quantity as int) % 6) as int) as shots,
 cast(sum(8 + cast(l_quantity as int) % 15) as double) as toi, cast(sum(l_linenumber % 3) as double) as pp_toi
from lineitem join orders on l_orderkey = o_orderkey
group by l_orderkey, cast(o_orderdate as date), cast(year(o_orderdate) as int), l_partkey % 400"""

VIEWS["football_players"] = """
select l_orderkey as match_id, cast(o_orderdate as date) as match_date, cast(year(o_orderdate) as int) as season,
 concat('L', cast(l_orderkey % 5 as varchar(9))) as league,
 cast((l_orderkey % 20) * 2 + min(l_linenumber) % 2 as int) as team_id, min(l_linenumber) % 2 = 1 as home,
 cast(l_partkey % 400 as int) as player_id,
 case when l_partkey % 4 = 0 then 'DC' when l_partkey % 4 = 1 then 'MC' when l_partkey % 4 = 2 then 'AMC' else 'FW' end as slot,
 min(l_linenumber) % 5 <> 0 as starter,
 cast(least(90, sum(20 + cast(l_quantity as int))) as double) as minutes,
 cast(sum(case when cast(l_quantity as int) % 9 = 0 then 1 else 0 end) as int) as goals,
 cast(sum(case when cast(l_quantity as int) % 27 = 0 then 1 else 0 end) as int) as pen_goals,
 cast(sum(case when cast(l_quantity as int) % 13 = 0 then 1 else 0 end) as int) as pen_att,
 cast(sum(cast(l_quantity as int) % 7) as double) * 0.05 as npxg,
 cast(sum(case when cast(l_quantity as int) % 13 = 0 then 1 else 0 end) as double) * 0.76 as pen_xg,
 cast(1 + l_orderkey % 4 as int) as team_goals
from lineitem join orders on l_orderkey = o_orderkey
group by l_orderkey, cast(o_orderdate as date), cast(year(o_orderdate) as int), l_partkey % 400, l_partkey % 4"""

VIEWS["odds_ticks"] = """
select event_id as tick_id, ts, cast(user_id % 50 as int) as market_id, event_type as book,
 cast(event_id % 2 as int) as side, 1.05 + value / 50 as odds, props from events"""

# events with names of letters, four an hour; boosts that speak of them in other spellings, hours off, or of no event at all
VIEWS["label_events"] = """
select o_orderkey as event, cast(floor(o_orderkey / 4) as bigint) % 10000000 as hour_no,
 translate(substr(md5(concat('h', cast(o_custkey as varchar(20)))), 1, 8), '0123456789', 'ghijklmnop') as home,
 translate(substr(md5(concat('a', cast(o_orderkey as varchar(20)))), 1, 8), '0123456789', 'ghijklmnop') as away,
 translate(substr(md5(concat('p', cast(o_orderkey as varchar(20)))), 1, 8), '0123456789', 'ghijklmnop') as striker,
 translate(substr(md5(concat('q', cast(o_orderkey as varchar(20)))), 1, 8), '0123456789', 'ghijklmnop') as winger,
 cast(1.1 as double) + 0.05 * (o_orderkey % 10) as lam_h, cast(0.9 as double) + 0.05 * (o_orderkey % 8) as lam_a
from orders"""

VIEWS["label_boosts"] = """
select event as boost_id, hour_no + case event % 5 when 0 then 0 when 1 then 3 when 2 then -4 when 3 then 4 else 5 end as hour_no,
 event % 13 <> 0 and event % 5 <> 4 as known, kind, cast(1.2 as double) + 0.0973 * (event % 30) as odds,
 case when event % 13 = 0 then 'qqqqqqqq - zzzzzzzz' when event % 3 = 0 then concat(upper(home), ' - ', away)
  when event % 3 = 1 then concat('Le match ', home, ' contre ', upper(away)) else concat(substr(home, 1, 7), ' - ', away) end as title,
 case kind when 0 then concat('CB - Victoire de ', home, ' (1,50 -> 1,80)') when 1 then concat('les ', away, ' gagne ') when 2 then 'Match nul' when 3 then 'Plus de 2,5 buts'
  when 4 then 'Les deux équipes marquent' when 5 then concat(home, ' gagne et les deux équipes marquent') when 6 then concat('+ de 2,5 buts & victoire de ', away)
  when 7 then concat(home, ' gagne avec au moins 2 buts d''écart') when 8 then concat('Boost FR - ', away, ' marque 2 buts ou plus') when 9 then concat(home, ' ne perd pas')
  when 10 then concat('Au moins 4 buts et ', home, ' gagne') when 11 then concat(home, ' mène à la mi-temps et gagne le match') when 12 then concat(home, ' gagne sur un penalty')
  when 13 then 'Zzzz gagne' when 14 then concat(striker, ' est buteur') else 'Jean marque' end as raw
from (select *, cast(case when event % 13 = 0 then 3 else event % 16 end as int) as kind from label_events) x"""

_NAME = re.compile(r"\b(from|join)\s+(\w+)")


def _needs(view: str) -> list[str]:
    return [n for _, n in _NAME.findall(VIEWS[view])]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dealt(spark: SparkSession, deps: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Lines and orders dealt by their common key into as many parts as the lines fill: what a task sorts and groups does not grow with them.

    Left to itself Spark sizes the tasks by compressed bytes, of which these narrow rows have few.
    """
    parts = -(-deps["lineitem"].count() // ROWS_A_TASK)
    if parts <= spark.sparkContext.defaultParallelism:
        return deps
    return {**deps, "lineitem": deps["lineitem"].repartition(parts, "l_orderkey"), "orders": deps["orders"].repartition(parts, "o_orderkey")}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a Spark DataFrame, its inputs bound by name."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    deps = {n: view(spark, sf_dir, n) for n in _needs(name)}
    if {"lineitem", "orders"} <= deps.keys():
        deps = _dealt(spark, deps)
    text = _NAME.sub(lambda m: f"{m.group(1)} {{{m.group(2)}}}", VIEWS[name])
    return spark.sql(text, **deps)


def with_views(sql: str, *names: str) -> str:
    """Twin SQL with the named views (and what they need) as leading CTEs."""
    done: list[str] = []

    def add(n: str) -> None:
        if n in TABLES or n in done:
            return
        for d in _needs(n):
            add(d)
        done.append(n)

    for n in names:
        add(n)
    ctes = ",\n".join(f"{n} as ({VIEWS[n].strip()})" for n in done)
    body = sql.strip()
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"
