"""File sources read from trees that Spark writes out of the tables: mixed encodings and headers (S1), extra leagues (S2), single events (S5), a tennis tour."""
from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources import files
from .registry import query, r
from .views import view


def _tree(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid4().hex}"


@query("S1_mixed_encodings", """select season, count(*) as n, sum(fthg)::bigint as goals, sum(length(home)+1)::bigint as letters, count(*) filter (home like 'T1%') as ones,
 count(*) filter (avgh >= 1.01) as priced from match_books group by season""", ("match_books",))
def s1_encodings(spark, sf):
    """Even seasons in Latin-1 with old headers, odd ones in UTF-8 with new headers in another order; team names begin with an accent."""
    base = _tree(spark, "encodings")
    m = view(spark, sf, "match_books").select("season", F.concat(F.lit("\u00c9"), "home").alias("HomeTeam"), F.concat(F.lit("\u00ef"), "away").alias("AwayTeam"), F.date_format("match_date", "dd/MM/yyyy").alias("Date"),
                                              F.col("fthg").alias("FTHG"), F.col("ftag").alias("FTAG"), F.col("avgh").alias("AvgH"))
    m.where("season % 2 = 0").withColumnsRenamed({"AvgH": "BbAvH", "Date": " Date "}).write.option("header", True).option("encoding", "ISO-8859-1").partitionBy("season").csv(f"{base}/old")
    m.where("season % 2 <> 0").select("AvgH", F.lit("x").alias("Unknown"), "FTAG", "FTHG", "Date", "AwayTeam", "HomeTeam", "season").write.option("header", True).partitionBy("season").csv(f"{base}/new")
    df = files.load_main(spark, [base])
    return df.groupBy(F.year("Date").cast("int").alias("season")).agg(F.count(F.lit(1)).alias("n"), F.sum("FTHG").alias("goals"), F.sum(F.length("HomeTeam")).cast("long").alias("letters"),
                                                                      F.sum(F.col("HomeTeam").startswith("\u00c9T1").cast("long")).alias("ones"), F.count("AvgH").alias("priced"))


@query("S6_tennis_tree", """with p as (select *, case when wh >= 1.005 then wh end as w, case when bfeh >= 1.005 then bfeh end as b from match_books)
select match_id, match_date as date, least(home, away) as home, greatest(home, away) as away, home <= away as home_win, 'S' || (fthg % 3)::varchar as series,
 round(case when home <= away then case when wh between 1.01 and 100 then wh end else case when wa between 1.01 and 100 then wa end end, 6) as odds_home,
 round(case when home <= away then coalesce(w, b) else coalesce(case when wa >= 1.005 then wa end, case when bfea >= 1.005 then bfea end) end, 6) as sharp_home
from p where ftag % 4 <> 3""", ("match_books",))
def s6(spark, sf):
    """Two generations of files (Tier, later Series), retired matches among them."""
    base = _tree(spark, "tennis")
    m = view(spark, sf, "match_books").select(F.col("match_id").cast("string").alias("Tournament"), "season", F.date_format("match_date", "yyyy-MM-dd").alias("Date"), F.concat("home", F.lit(" ")).alias("Winner"), F.col("away").alias("Loser"),
                                              F.concat(F.lit("S"), (F.col("fthg") % 3).cast("string")).alias("Series"), F.when(F.col("ftag") % 4 == 3, "Retired").otherwise("Completed ").alias("Comment"),
                                              F.col("wh").alias("PSW"), F.col("wa").alias("PSL"), F.col("bfeh").alias("BFEW"), F.col("bfea").alias("BFEL"))
    m.where("season % 2 = 0").withColumnRenamed("Series", "Tier").drop("season").write.option("header", True).option("ignoreTrailingWhiteSpace", False).csv(f"{base}/old")
    m.where("season % 2 <> 0").drop("season").write.option("header", True).option("ignoreTrailingWhiteSpace", False).csv(f"{base}/new")
    t = files.load_tennis(spark, [base])
    return t.select(F.col("competition").cast("decimal(38,0)").alias("match_id"), "date", "home", "away", "home_win", "series", r("odds_home").alias("odds_home"), r("sharp_home").alias("sharp_home"))


@query("S5_event_sources", """with m as (select *, case home when 'T1' then 'LV' when 'T2' then 'LAC' else home end as nh, case when wh between 1.01 and 100 then wh end as o, case when wa between 1.01 and 100 then wa end as oa from match_books),
e as (select 'baseball' as sport, home, fthg > ftag as won, o from m union all select 'american_football', nh, fthg > ftag, o from m where fthg <> ftag
 union all select 'mma', least(home, away), case when home <= away then fthg > ftag else ftag > fthg end, case when home <= away then o else oa end from m where fthg <> ftag
 union all select 'international', home, fthg > ftag, null from m where fthg < 4)
select sport, home, count(*) as n, count(*) filter (won) as wins, count(o) as priced, round(sum(o), 4) as odds from e group by sport, home""", ("match_books",))
def s5(spark, sf):
    """Each source from its own kind of file: games in Parquet, games with moved clubs, fights by corner, and matches without a score among others."""
    base = _tree(spark, "events")
    m = view(spark, sf, "match_books")
    american = lambda c: F.when(F.col(c) >= 2, 100 * (F.col(c) - 1)).when(F.col(c) > 1, -100 / (F.col(c) - 1))     # noqa: E731
    club = lambda c: F.when(F.col(c) == "T1", "OAK").when(F.col(c) == "T2", "SD").otherwise(F.col(c))              # noqa: E731
    m.select(F.col("match_date").alias("game_date"), F.col("home").alias("home_team_abbr"), F.col("away").alias("away_team_abbr"), (F.col("fthg") > F.col("ftag")).cast("int").alias("Home_Win"),
             american("wh").alias("home_odds"), american("wa").alias("away_odds")).write.parquet(f"{base}/games")
    m.select("season", F.lit("REG").alias("game_type"), F.col("match_date").alias("gameday"), club("away").alias("away_team"), F.col("ftag").alias("away_score"), club("home").alias("home_team"), F.col("fthg").alias("home_score"),
             F.lit("Home").alias("location"), (F.col("fthg") - F.col("ftag")).alias("result"), american("wa").alias("away_moneyline"), american("wh").alias("home_moneyline"), F.lit(1.5).alias("spread_line")).write.option("header", True).csv(f"{base}/nfl")
    m.select(F.col("home").alias("R_fighter"), F.col("away").alias("B_fighter"), american("wh").alias("R_odds"), american("wa").alias("B_odds"), F.col("match_date").alias("date"),
             F.when(F.col("fthg") > F.col("ftag"), "Red").when(F.col("fthg") < F.col("ftag"), "Blue").otherwise("Draw").alias("Winner"), F.lit(True).alias("title_bout")).write.option("header", True).csv(f"{base}/fights")
    m.select(F.col("match_date").alias("date"), F.col("home").alias("home_team"), F.col("away").alias("away_team"), F.when(F.col("fthg") < 4, F.col("fthg")).alias("home_score"), F.col("ftag").alias("away_score")).write.option("header", True).csv(f"{base}/nations")
    cols = ["sport", "home", "home_win", "odds_home"]
    nations = files.load_international(spark, [f"{base}/nations"]).select(F.lit("international").alias("sport"), F.col("home_team").alias("home"), (F.col("home_score") > F.col("away_score")).alias("home_win"), F.lit(None).cast("double").alias("odds_home"))
    e = files.load_mlb(spark, [f"{base}/games"]).select(cols).unionAll(files.load_nfl(spark, [f"{base}/nfl"]).select(cols)).unionAll(files.load_fights(spark, [f"{base}/fights"]).select(cols)).unionAll(nations)
    return e.groupBy("sport", "home").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("home_win").cast("long")).alias("wins"), F.count("odds_home").alias("priced"), r(F.sum("odds_home"), 4).alias("odds"))


@query("S2_extra_leagues", """select season, 'Land ' || country::varchar as country, count(*) as n, sum(fthg-ftag)::bigint as margin, count(*) filter (fthg > ftag) as home_wins, count(pinh) as priced, round(sum(pinh), 4) as odds
from match_books where fthg <> 5 group by season, country""", ("match_books",))
def s2(spark, sf):
    """Files of the extra leagues: other names for teams and goals, seasons over two years, matches not yet played among them."""
    base = _tree(spark, "extra")
    m = view(spark, sf, "match_books")
    m.select(F.concat(F.lit("Land "), F.col("country").cast("string")).alias("Country"), F.concat_ws("/", F.col("season").cast("string"), (F.col("season") + 1).cast("string")).alias("Season"),
             F.date_format("match_date", "dd/MM/yyyy").alias("Date"), F.col("home").alias("Home"), F.col("away").alias("Away"), F.when(F.col("fthg") != 5, F.col("fthg")).alias("HG"), F.col("ftag").alias("AG"),
             F.when(F.col("fthg") > F.col("ftag"), "H").when(F.col("fthg") < F.col("ftag"), "A").otherwise("D").alias("Res"), F.col("pinh").alias("PSCH")).write.option("header", True).csv(base)
    df = files.load_extra(spark, [base])
    return df.groupBy(F.col("Season").cast("int").alias("season"), F.col("Country").alias("country")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("FTHG") - F.col("FTAG")).cast("long").alias("margin"),
                                                                                                           F.sum((F.col("FTR") == "H").cast("long")).alias("home_wins"), F.count("PSCH").alias("priced"), r(F.sum("PSCH"), 4).alias("odds"))
