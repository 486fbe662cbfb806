"""File sources and sinks: drifting CSV trees, event tables, incremental loads, archives."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.odds import american_to_decimal, implausible_to_null
from ..functions.text import parse_day
from ..session import cut

# Old header names and their current equivalents.
HEADER_RENAMES = {"BbAvH": "AvgH", "BbAvD": "AvgD", "BbAvA": "AvgA", "BbMxH": "MaxH", "BbMxD": "MaxD", "BbMxA": "MaxA",
                  "BbAv>2.5": "Avg>2.5", "BbAv<2.5": "Avg<2.5", "BbMx>2.5": "Max>2.5", "BbMx<2.5": "Max<2.5", "BbAHh": "AHh",
                  "BbAvAHH": "AvgAHH", "BbAvAHA": "AvgAHA", "BbMxAHH": "MaxAHH", "BbMxAHA": "MaxAHA", "BbOU": "NbBooksOU",
                  "Bb1X2": "NbBooks1X2", "BbAH": "NbBooksAH"}
EXTRA_RENAMES = {"Home": "HomeTeam", "Away": "AwayTeam", "HG": "FTHG", "AG": "FTAG", "Res": "FTR"}
TEXT_COLUMNS = ["Div", "Date", "Time", "HomeTeam", "AwayTeam", "FTR", "HTR", "Referee"]
COUNT_COLUMNS = ["FTHG", "FTAG", "HTHG", "HTAG", "HS", "AS", "HST", "AST", "HF", "AF", "HC", "AC", "HY", "AY", "HR", "AR", "NbBooks1X2"]
BOOKS = ["B365", "BW", "IW", "LB", "PS", "WH", "VC", "1XB", "BF", "BFE", "Max", "Avg"]
TOTAL_BOOKS = ["B365", "P", "Max", "Avg", "BFE"]
HANDICAP_LINES = ["AHh", "AHCh"]
ODDS_COLUMNS = ([f"{b}{c}{o}" for b in BOOKS for c in ("", "C") for o in "HDA"]
                + [f"{b}{c}{s}2.5" for b in TOTAL_BOOKS for c in ("", "C") for s in "><"]
                + [f"{b}{c}AH{s}" for b in ("B365", "P", "Max", "Avg") for c in ("", "C") for s in "HA"])


#: Most bytes of paths and header lines of a tree that are broadcast.
HEADS_BYTES = 32 << 20


def read_csv_tree(spark: SparkSession, paths: Sequence[str], renames: dict[str, str], columns: Sequence[str]) -> DataFrame:
    """Files with different headers and encodings as one text table: `columns`, and `source_path` of each row.

    `paths` are files, folders or patterns. A file is UTF-8 if all of its lines are valid, else Latin-1. Its header is its first line; names are
    trimmed and harmonised, of equal names the first counts, missing columns and empty fields are null. Short lines are filled with
    nulls; a line with a value beyond its header, or equal to its header, is dropped. A quoted field may hold commas, but no line break.
    Files without a line give no row.

    One pass gives encoding and header of every file, one more reads the rows; no job and no scan per file or per header. To the driver go the
    width of the widest header and the size of all headers; they are broadcast up to HEADS_BYTES, joined by file beyond.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(list(paths)).select("value", F.col("_metadata.file_path").alias("source_path"), F.col("_metadata.file_block_start").alias("_b"))
    place = F.struct("_b", F.monotonically_increasing_id())             # only compared within this one pass
    text = F.when(F.col("_utf8"), F.col("value")).otherwise(F.decode(F.col("value").cast("binary"), "ISO-8859-1"))
    known = F.create_map(*[F.lit(x) for kv in renames.items() for x in kv]) if renames else F.lit(None).cast("map<string,string>")
    names = F.transform(F.split(F.regexp_replace("_first", "^\ufeff", ""), ","), lambda x: F.trim(F.regexp_replace(F.trim(x), '^"|"$', "")))
    heads = cut(lines.withColumn("_at", place).groupBy("source_path").agg(F.bool_and(F.is_valid_utf8("value")).alias("_utf8"), F.min_by("value", "_at").alias("value"))
                .select("source_path", "_utf8", F.col("value").alias("_line"), text.alias("_first")).withColumn("_names", F.transform(names, lambda x: F.coalesce(known[x], x))).drop("_first"))
    widest, held = heads.agg(F.max(F.size("_names")), F.sum(3 * F.octet_length("_line") + F.octet_length("source_path"))).first()
    width = widest or 1
    fields = ", ".join(f"c{i} string" for i in range(width + 1))
    # places of the columns are found once a file; explodes of one-element arrays are fences: filters stay above them, so a line is parsed once
    places = heads.select("source_path", "_utf8", "_line", F.size("_names").alias("_n"), F.array(*[F.array_position("_names", F.lit(c)).cast("int") - 1 for c in columns]).alias("_p"))
    rows = (lines.join(F.broadcast(places) if (held or 0) <= HEADS_BYTES else places, "source_path").where((F.col("value") != F.col("_line")) & (F.trim("value") != ""))
            .select("source_path", "_n", "_p", F.explode_outer(F.array(F.from_csv(text, fields, {"mode": "PERMISSIVE"}))).alias("_c"))
            .select("source_path", "_n", "_p", F.array(*[F.col(f"_c.c{i}") for i in range(width + 1)]).alias("_v"))
            .where(~F.exists(F.slice("_v", F.col("_n") + 1, width + 1), lambda x: x.isNotNull())))
    picked = F.struct(*[F.get("_v", F.get("_p", F.lit(k))).alias(c) for k, c in enumerate(columns)])
    return rows.select(F.explode_outer(F.array(picked)).alias("_r"), "source_path").select("_r.*", "source_path")


# Books of the tennis files, of which W and L are the winner's and the loser's price; lowest price taken as one.
TENNIS_BOOKS = ["PS", "B365", "Max", "Avg", "BFE"]
TENNIS_LOWEST = 1.005


def load_tennis(spark: SparkSession, paths: Sequence[str], tour: str = "atp", book: str = "PS") -> DataFrame:
    """Completed matches of a tour with both players in alphabetical order as home and away, and the prices of each book.

    Rows without date, winner or loser go. The sharp price is that of PS, where it is missing that of BFE.
    """
    texts = ["Tournament", "Date", "Series", "Surface", "Round", "Winner", "Loser", "Comment"]
    raw = read_csv_tree(spark, paths, {"Tier": "Series"}, [*texts, "Best of", "WRank", "LRank", *[f"{b}{s}" for b in TENNIS_BOOKS for s in "WL"]])
    df = raw.withColumns({"date": F.coalesce(F.to_date(F.try_to_timestamp("Date", F.lit("yyyy-MM-dd"))), parse_day("Date")), "w": F.trim("Winner"), "l": F.trim("Loser")})
    df = df.where("date is not null and w is not null and l is not null").where(F.lower(F.trim("Comment")) == "completed")
    price = lambda c: F.when(F.col(c).try_cast("double") >= TENNIS_LOWEST, F.col(c).try_cast("double"))     # noqa: E731
    won = F.col("w") <= F.col("l")
    both = lambda a, b: (F.when(won, a).otherwise(b), F.when(won, b).otherwise(a))                        # noqa: E731
    home, away = both(F.col("w"), F.col("l"))
    rank_1, rank_2 = both(F.col("WRank").try_cast("double"), F.col("LRank").try_cast("double"))
    odds = {f"{b}_{side}": x for b in TENNIS_BOOKS for side, x in zip(("home", "away"), both(price(f"{b}W"), price(f"{b}L")))}
    df = df.select("date", F.year("date").alias("season"), home.alias("home"), away.alias("away"), won.alias("home_win"), F.lit(1).alias("neutral"), F.col("Surface").alias("surface"),
                   F.col("Series").alias("series"), F.col("Round").alias("round"), F.col("`Best of`").try_cast("double").alias("best_of"), rank_1.alias("rank_1"), rank_2.alias("rank_2"),
                   F.col("Tournament").alias("_tournament"), *[x.alias(n) for n, x in odds.items()])
    df = df.withColumns({"odds_home": F.col(f"{book}_home"), "odds_away": F.col(f"{book}_away"), "sharp_home": F.coalesce("PS_home", "BFE_home"), "sharp_away": F.coalesce("PS_away", "BFE_away")})
    return two_outcome_events(df, "tennis", F.col("_tournament")).withColumn("tour", F.lit(tour.upper())).drop("_tournament")


def load_main(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Main league files (<season>/<league>.csv): typed, dates parsed, absurd odds nulled, match id added."""
    raw = read_csv_tree(spark, paths, HEADER_RENAMES, TEXT_COLUMNS + COUNT_COLUMNS + ODDS_COLUMNS + HANDICAP_LINES)
    cols: dict[str, Column] = {c: F.col(c).try_cast("int") for c in COUNT_COLUMNS}
    cols |= {c: implausible_to_null(F.col(f"`{c}`")) for c in ODDS_COLUMNS}
    cols |= {c: F.col(c).try_cast("double") for c in HANDICAP_LINES}
    cols["Date"] = parse_day("Date")
    cols["Season"] = F.regexp_extract("source_path", r"([^/]+)/[^/]+\.csv", 1)
    cols["League"] = F.regexp_extract("source_path", r"([^/]+)\.csv", 1)
    df = raw.where("HomeTeam is not null and AwayTeam is not null").withColumns(cols).drop("source_path")
    return with_match_id(df.where("Date is not null and FTHG is not null and FTAG is not null"))


def load_extra(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Extra league files: closing odds only, season = first four characters."""
    odds = [f"{b}C{o}" for b in ("PS", "Max", "Avg", "B365", "BFE") for o in "HDA"]
    raw = read_csv_tree(spark, paths, EXTRA_RENAMES, ["Country", "Season", "Date", "Time", "HomeTeam", "AwayTeam", "FTHG", "FTAG", "FTR", *odds])
    df = raw.withColumns({**{c: F.col(c).try_cast("double") for c in odds}, "FTHG": F.col("FTHG").try_cast("int"), "FTAG": F.col("FTAG").try_cast("int"),
                          "Date": parse_day("Date"), "Season": F.substring("Season", 1, 4), "League": F.regexp_extract("source_path", r"([^/]+)\.csv", 1)})
    return df.where("Date is not null and FTHG is not null and FTAG is not null").drop("source_path")


def with_match_id(df: DataFrame) -> DataFrame:
    return df.withColumn("MatchId", F.concat_ws("_", "League", F.date_format("Date", "yyyyMMdd"), F.replace(F.col("HomeTeam"), F.lit(" "), F.lit("")),
                                                F.replace(F.col("AwayTeam"), F.lit(" "), F.lit(""))))


def write_dataset(df: DataFrame, path: str, partition: str = "Season") -> None:
    """Normalised Parquet, one directory per season; rows are clustered so a season is not spread over tiny files."""
    df.repartitionByRange(F.col(partition), F.col("Date")).sortWithinPartitions(partition, "Date").write.mode("overwrite").partitionBy(partition).parquet(path)


def two_outcome_events(df: DataFrame, sport: str, competition: Column, aliases: dict[str, str] | None = None, american: Sequence[str] = ()) -> DataFrame:
    """Common shape of two-outcome sports: aliases fixed, placeholder teams dropped, American prices converted, absurd odds nulled."""
    if aliases:
        m = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
        df = df.withColumns({c: F.coalesce(m[F.col(c)], F.col(c)) for c in ("home", "away")})
    df = df.where("home <> '0' and away <> '0' and date is not null and home_win is not null")
    df = df.withColumns({c: american_to_decimal(c) for c in american})
    odds = [c for c in ("odds_home", "odds_away", "odds_home_open", "odds_away_open") if c in df.columns]
    df = df.withColumns({c: implausible_to_null(c, 1.01, 100.0) for c in odds})
    return df.withColumns({"sport": F.lit(sport), "competition": competition})


# Clubs that moved, by their old and new code.
MOVED_CLUBS = {"OAK": "LV", "SD": "LAC", "STL": "LA"}


def load_mlb(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Baseball games with American prices, from Parquet."""
    df = spark.read.parquet(*paths).select(F.col("game_date").cast("date").alias("date"), F.year(F.col("game_date").cast("date")).alias("season"), F.col("home_team_abbr").alias("home"),
                                           F.col("away_team_abbr").alias("away"), (F.col("Home_Win").cast("int") == 1).alias("home_win"), F.col("home_odds").alias("odds_home"), F.col("away_odds").alias("odds_away"))
    return two_outcome_events(df, "baseball", F.lit("MLB"), american=("odds_home", "odds_away"))


def load_nfl(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """American football games that have a winner, with spread and margin; clubs under their present code."""
    raw = read_csv_tree(spark, paths, {}, ["season", "game_type", "gameday", "away_team", "away_score", "home_team", "home_score", "location", "result", "away_moneyline", "home_moneyline", "spread_line"])
    num = lambda c: F.col(c).try_cast("double")                                                            # noqa: E731
    df = raw.where(num("home_score") != num("away_score")).select(
        F.col("gameday").try_cast("date").alias("date"), F.col("season").try_cast("int").alias("season"), F.col("home_team").alias("home"), F.col("away_team").alias("away"),
        (num("home_score") > num("away_score")).alias("home_win"), num("home_moneyline").alias("odds_home"), num("away_moneyline").alias("odds_away"), num("spread_line").alias("spread_line"),
        num("result").alias("margin"), F.coalesce((F.col("location") == "Neutral").cast("int"), F.lit(0)).alias("neutral"), (F.col("game_type") == "REG").alias("_regular"))
    return two_outcome_events(df, "american_football", F.when(F.col("_regular"), "NFL saison").otherwise("NFL playoffs"), MOVED_CLUBS, ("odds_home", "odds_away")).drop("_regular")


def load_fights(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Decided fights; the fighter whose name comes first in the alphabet is home, so that the corner tells nothing."""
    raw = read_csv_tree(spark, paths, {}, ["R_fighter", "B_fighter", "R_odds", "B_odds", "date", "Winner", "title_bout"]).where(F.col("Winner").isin("Red", "Blue"))
    red_first = F.col("R_fighter") <= F.col("B_fighter")
    pick = lambda a, b: F.when(red_first, F.col(a)).otherwise(F.col(b))                                   # noqa: E731
    df = raw.select(F.col("date").try_cast("date").alias("date"), F.year(F.col("date").try_cast("date")).alias("season"), pick("R_fighter", "B_fighter").alias("home"), pick("B_fighter", "R_fighter").alias("away"),
                    ((F.col("Winner") == "Red") == red_first).alias("home_win"), pick("R_odds", "B_odds").try_cast("double").alias("odds_home"), pick("B_odds", "R_odds").try_cast("double").alias("odds_away"),
                    F.lit(1).alias("neutral"), F.coalesce(F.col("title_bout").try_cast("boolean"), F.lit(False)).alias("title_bout"))
    return two_outcome_events(df, "mma", F.lit("UFC"), american=("odds_home", "odds_away"))


def load_international(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Matches of national teams with both scores known."""
    raw = read_csv_tree(spark, paths, {}, ["date", "home_team", "away_team", "home_score", "away_score", "tournament", "city", "country", "neutral"])
    df = raw.withColumns({"date": F.col("date").try_cast("date"), "home_score": F.col("home_score").try_cast("double").cast("int"), "away_score": F.col("away_score").try_cast("double").cast("int"),
                          "neutral": F.col("neutral").try_cast("boolean")})
    return df.where("home_score is not null and away_score is not null").drop("source_path")


def new_rows(incoming: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not stored yet."""
    return incoming.join(stored.select(*keys).distinct(), list(keys), "left_anti")


def refresh_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Overwrite only the partitions present in `df` (the current season)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def append_archive(df: DataFrame, path: str, captured_at: str = "captured_at") -> None:
    """Append-only odds archive, one partition per capture day."""
    df.withColumn("capture_date", F.to_date(captured_at)).write.mode("append").partitionBy("capture_date").parquet(path)


def write_table_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def json_rows(df: DataFrame) -> DataFrame:
    """Strict JSON records: NaN and infinities become null."""
    def clean(c: str, t: str) -> Column:
        x = F.col(c)
        return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x).alias(c) if t in ("double", "float") else x
    return df.select(F.to_json(F.struct(*[clean(c, t) for c, t in df.dtypes]), {"ignoreNullFields": "false"}).alias("value"))
