"""Nested odds and result payloads to long rows. Each takes a table of payload texts, batch or streaming."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.odds import american_to_decimal, implausible_to_null
from ..functions.text import first_last
from ..session import large

BOOKS_PAYLOAD = ("array<struct<id: string, commence_time: timestamp, home_team: string, away_team: string, bookmakers: array<struct<key: string, "
                 "markets: array<struct<key: string, outcomes: array<struct<name: string, price: double, point: double>>>>>>>>")


def flatten_bookmakers(payloads: DataFrame, books: list[str] | None = None) -> DataFrame:
    """Event, bookmaker, market, outcome payload to one row per outcome."""
    e = payloads.select(F.explode(F.from_json("payload", BOOKS_PAYLOAD)).alias("e"))
    b = e.select("e.id", "e.commence_time", "e.home_team", "e.away_team", F.explode("e.bookmakers").alias("b"))
    if books is not None:
        b = b.where(F.col("b.key").isin(books))
    m = b.select("id", "commence_time", "home_team", "away_team", F.col("b.key").alias("book"), F.explode("b.markets").alias("m"))
    o = m.select("id", "commence_time", "home_team", "away_team", "book", F.col("m.key").alias("mk"), F.explode("m.outcomes").alias("o"))
    market = F.when(F.col("mk") == "h2h", "moneyline").when(F.col("mk") == "totals", "total").otherwise(F.col("mk"))
    return o.select(F.col("id").alias("event_id"), F.col("commence_time").alias("start"), F.col("home_team").alias("home"), F.col("away_team").alias("away"),
                    "book", market.alias("market"), F.when(F.col("o.name") == "Draw", "Nul").otherwise(F.col("o.name")).alias("selection"),
                    F.col("o.point").alias("line"), F.col("o.price").alias("odds"))


def matchup_odds(matchups: DataFrame, markets: DataFrame, method: str = "power") -> DataFrame:
    """Sharp feed rows: open pre-match markets joined to their matchup (specials to the parent), devigged per market key.

    matchups(id, parent_id, type, is_live, start, home, away, category, description),
    markets(matchup_id, key, market_type, period, status, is_alternate, prices array<struct<designation, participant, points, price>>).
    """
    from ..operators.groups import devig_markets
    live = matchups.where("not is_live")
    tidy = lambda c: F.replace(F.col(c), F.lit(" (Games)"), F.lit(""))      # noqa: E731
    # what a market takes from its matchup is settled on the smaller side, so games and specials meet the markets in one join
    game = live.where((F.col("type") == "matchup") & ~(F.col("home").contains("(") & ~F.col("home").endswith(" (Games)")))
    game = game.select("id", "start", tidy("home").alias("home"), tidy("away").alias("away"), F.when(F.col("home").endswith(" (Games)"), "jeux").alias("unit"),
                       F.lit(False).alias("is_prop"), F.lit(None).cast("string").alias("_title"), F.lit(None).cast(matchups.schema["id"].dataType).alias("_pid"))
    parent = matchups.select(F.col("id").alias("_pid"), F.col("start").alias("_ps"), F.col("home").alias("_ph"), F.col("away").alias("_pa"))
    special = live.where(F.col("type") == "special").join(parent, F.col("parent_id") == F.col("_pid"))
    special = special.select("id", F.col("_ps").alias("start"), F.col("_ph").alias("home"), F.col("_pa").alias("away"), F.lit(None).cast("string").alias("unit"),
                             F.lit(True).alias("is_prop"), F.concat_ws(": ", "category", "description").alias("_title"), "_pid")
    sides = game.unionByName(special)
    m = markets.where((F.coalesce("status", F.lit("open")) == "open") & (F.size("prices") >= 2))
    on, by = F.col("matchup_id") == F.col("id"), ["id", "key"]
    kind = matchups.schema["id"].dataType
    if kind == markets.schema["matchup_id"].dataType and isinstance(kind, T.DecimalType):
        # wide decimals are dear to compare: their hashes are compared first
        m, sides, by = m.withColumn("_mh", F.xxhash64("matchup_id")), sides.withColumn("_h", F.xxhash64("id")), ["_h", "id", "key"]
        on = (F.col("_mh") == F.col("_h")) & on
    elif isinstance(kind, T.StringType):
        by = ["market_key"]     # with a bar in them, two ids and keys can make one market key
    main = ~F.col("is_alternate") & (F.col("period") == 0) & F.col("market_type").isin("moneyline", "spread", "total")
    m = large(m).join(large(sides), on).where(F.col("is_prop") | main)

    def row(p: Column) -> Column:
        side = p["designation"]
        s = (F.when(F.col("is_prop"), p["participant"]).when(side == "home", F.col("home")).when(side == "away", F.col("away")).when(side == "draw", "Nul")
             .when(side == "over", "Plus").when(side == "under", "Moins").otherwise(side))
        return F.struct(s.alias("selection"), p["points"].alias("line"), american_to_decimal(p["price"], strict=False).alias("pin_odds"))

    m = m.select(*[c for c in by if c != "market_key"], *[c for c in ("id", "key") if c not in by], "_pid", "start", "home", "away", "unit", "is_prop",
                 F.when(F.col("is_prop"), F.col("_title")).otherwise(F.col("market_type")).alias("market"), F.concat_ws("|", "id", "key").alias("market_key"),
                 F.transform("prices", row).alias("rows"))
    fair = devig_markets(m, by, "rows", "selection", "pin_odds", method, margin="pin_margin")
    return fair.select("market_key", "selection", F.when(F.col("is_prop"), F.col("_pid")).otherwise(F.col("id")).alias("event_id"), "start", "home", "away",
                       F.concat_ws(" - ", "home", "away").alias("event"), "market", "is_prop", "unit", "line", "pin_odds", "fair_prob", "pin_margin",
                       (1 / F.col("fair_prob")).alias("fair_odds"))


MATCH_PAYLOAD = ("struct<rosters: map<string, map<string, struct<player_id: string, team_id: string, player: string, position: string, time: string, goals: string, "
                 "xG: string>>>, shots: map<string, array<struct<player_id: string, situation: string, result: string, xG: string>>>>")


def match_rows(payloads: DataFrame) -> DataFrame:
    """Match payloads (match_id, payload) to one row per player with penalties summed from the shots."""
    p = payloads.select("match_id", F.from_json("payload", MATCH_PAYLOAD).alias("d"))
    shots = p.select("match_id", F.explode(F.flatten(F.map_values("d.shots"))).alias("s")).where("s.situation = 'Penalty'")
    pens = shots.groupBy("match_id", F.col("s.player_id").alias("player_id")).agg(
        F.count(F.lit(1)).alias("pen_att"), F.count(F.when(F.col("s.result") == "Goal", 1)).alias("pen_goals"), F.sum(F.col("s.xG").cast("double")).alias("pen_xg"))
    rows = p.select("match_id", F.explode("d.rosters").alias("side", "r")).select("match_id", "side", F.explode(F.map_values("r")).alias("x"))
    rows = rows.select("match_id", (F.col("side") == "h").alias("home"), F.col("x.player_id").alias("player_id"), F.col("x.team_id").cast("int").alias("team_id"),
                       F.col("x.player").alias("player"), F.col("x.position").alias("position"), F.coalesce(F.col("x.time").try_cast("int"), F.lit(0)).alias("time"),
                       F.coalesce(F.col("x.goals").try_cast("int"), F.lit(0)).alias("goals"), F.coalesce(F.col("x.xG").try_cast("double"), F.lit(0.0)).alias("xg"))
    out = rows.join(pens, ["match_id", "player_id"], "left").fillna({"pen_att": 0, "pen_goals": 0, "pen_xg": 0.0})
    return out.withColumns({"npxg": F.greatest(F.col("xg") - F.col("pen_xg"), F.lit(0.0)), "starter": F.col("position") != "Sub", "player_id": F.col("player_id").cast("int")})


def skater_games(summary: DataFrame, ice_time: DataFrame) -> DataFrame:
    """Two skater reports joined on game and player, seconds to minutes, one row per game and player."""
    j = summary.join(ice_time, ["game_id", "player_id"], "left")
    secs = F.coalesce("time_on_ice", "time_on_ice_per_game").cast("double")
    j = j.withColumns({"toi": secs / 60, "pp_toi": F.coalesce("pp_time_on_ice", F.lit(0)).cast("double") / 60, "goals": F.coalesce("goals", F.lit(0)), "shots": F.coalesce("shots", F.lit(0))})
    return j.dropDuplicates(["game_id", "player_id"])


PROPS_PAYLOAD = ("struct<events: array<struct<id: decimal(38,0), description: string, parsedStart: timestamp, groupedMarkets: array<struct<description: string, markets: "
                 "array<struct<description: string, suspended: boolean, outcomes: array<struct<description: string, price: string, suspended: boolean, hidden: boolean>>>>>>>>>")
# Prefixes of player markets and their statistic; scorer markets and their line.
PROP_STATS = {"Nombre de Buts - Joueur": "Buts", "Nombre de Points - Joueur": "Points", "Nombre de Passes décisives - Joueur": "Passes décisives"}
SCORER_LINES = {"Buteur": 0.5, "Buteur 2+": 1.5, "Buteur 3+": 2.5}


def _offers(payloads: DataFrame) -> DataFrame:
    e = payloads.select(F.explode(F.from_json("payload", PROPS_PAYLOAD)["events"]).alias("e"))
    g = e.select("e.id", "e.description", "e.parsedStart", F.explode("e.groupedMarkets").alias("g"))
    m = g.select("id", "description", "parsedStart", F.col("g.description").alias("group"), F.explode("g.markets").alias("m")).where("not coalesce(m.suspended, false)")
    o = m.select("id", "description", "parsedStart", "group", F.trim("m.description").alias("market"), F.explode("m.outcomes").alias("o"))
    o = o.where("not coalesce(o.suspended, false) and not coalesce(o.hidden, false)")
    return o.select(F.col("id").alias("ub_event_id"), F.col("description").alias("ub_event"), F.col("parsedStart").alias("start"), "group", "market",
                    F.trim("o.description").alias("label"), F.replace(F.col("o.price"), F.lit(","), F.lit(".")).try_cast("double").alias("odds")).where("odds is not null")


def player_props(payloads: DataFrame) -> DataFrame:
    """'Player k+' outcomes of player markets: line k - 0.5."""
    o = _offers(payloads)
    stat = None
    for prefix, name in PROP_STATS.items():
        stat = F.when(F.col("group").startswith(prefix), name) if stat is None else stat.when(F.col("group").startswith(prefix), name)
    o = o.withColumn("stat", stat).where("stat is not null and not contains(group, 'Tiers')")
    rx = r"^(.+?)\s+(\d+)\+$"
    return o.where(F.col("label").rlike(rx)).select("ub_event_id", "ub_event", "start", "stat", F.regexp_extract("label", rx, 1).alias("player"),
                                                    (F.regexp_extract("label", rx, 2).cast("int") - 0.5).alias("line"), "odds")


def football_scorers(payloads: DataFrame) -> DataFrame:
    o = _offers(payloads).where("group like 'Buteurs - 90%' or group like 'Buteurs Multiples - 90%'")
    line = F.create_map(*[F.lit(x) for kv in SCORER_LINES.items() for x in kv])[F.col("market")]
    return o.withColumn("line", line).where("line is not null and odds > 1").select(
        "ub_event_id", "ub_event", "start", F.lit("Buts").alias("stat"), "line", first_last("label").alias("player"), "odds")


STATE_PAYLOAD = ("struct<matches: map<string, struct<matchId: long, title: string, matchStart: long, bets: array<long>>>, bets: map<string, struct<betTitle: string, "
                 "betTypeHelp: string, available: boolean, outcomes: array<long>>>, outcomes: map<string, struct<label: string, available: boolean>>, odds: map<string, double>>")
# Bet titles of player markets: (pattern, statistic).
STATE_TITLES = [(r"^Buteur$|^Buteur \(hors prolongation\)$", "Buts"), (r"^Marque (\d+) buts? ou plus", "Buts"), (r"^(\d+) points? ou plus", "Points")]


def normalised_state_props(payloads: DataFrame) -> DataFrame:
    """Normalised page state (matches, bets, outcomes, odds maps) to player prices by exploding and joining the maps."""
    p = payloads.select("page_id", F.from_json("payload", STATE_PAYLOAD).alias("s"))
    m = p.select("page_id", F.explode(F.map_values("s.matches")).alias("m")).select("page_id", "m.title", "m.matchStart", F.explode("m.bets").alias("bet_id"))
    b = p.select("page_id", F.explode("s.bets").alias("bet_id", "b")).select("page_id", F.col("bet_id").cast("long").alias("bet_id"), "b.*").where("coalesce(available, true)")
    o = p.select("page_id", F.explode("s.outcomes").alias("oid", "o")).select("page_id", F.col("oid").cast("long").alias("oid"), "o.label", F.coalesce("o.available", F.lit(True)).alias("ok"))
    q = p.select("page_id", F.explode("s.odds").alias("oid", "odds")).select("page_id", F.col("oid").cast("long").alias("oid"), "odds")
    j = m.join(b, ["page_id", "bet_id"]).withColumn("oid", F.explode("outcomes")).drop("outcomes").join(o, ["page_id", "oid"]).join(q, ["page_id", "oid"])
    stat = k = None
    for rx, name in STATE_TITLES:
        n = F.coalesce(F.regexp_extract("betTitle", rx, 1).try_cast("int"), F.lit(1)) if "(\\d+)" in rx else F.lit(1)
        stat = F.when(F.col("betTitle").rlike(rx), name) if stat is None else stat.when(F.col("betTitle").rlike(rx), name)
        k = F.when(F.col("betTitle").rlike(rx), n) if k is None else k.when(F.col("betTitle").rlike(rx), n)
    hlp = F.lower(F.coalesce("betTypeHelp", F.lit("")))
    return j.withColumns({"stat": stat, "k": k}).where("stat is not null and ok and odds > 1 and label is not null").select(
        "page_id", F.col("title").alias("event"), F.timestamp_seconds("matchStart").alias("start"), "stat", (F.col("k") - 0.5).alias("line"), F.col("label").alias("player"),
        "odds", (~(hlp.contains("prolongation") & hlp.contains("inclus"))).alias("reg_only"))


TREE_PAYLOAD = ("struct<name: string, start: timestamp, markets: array<struct<name: string, groupMarkets: array<struct<name: string, selections: array<struct<name: string, odds: double, "
                "status: int>>>>, selections: array<struct<name: string, odds: double, status: int>>>>>")


def tree_props(payloads: DataFrame) -> DataFrame:
    """Market tree to leaf markets (a market, or each of its sub-markets) to active selections."""
    p = payloads.select("page_id", F.from_json("payload", TREE_PAYLOAD).alias("t"))
    m = p.select("page_id", "t.name", "t.start", F.explode("t.markets").alias("m"))
    leaves = F.when(F.size("m.groupMarkets") > 0, F.col("m.groupMarkets")).otherwise(F.array(F.struct(F.col("m.name").alias("name"), F.col("m.selections").alias("selections"))))
    s = m.select("page_id", "name", "start", F.explode(leaves).alias("l")).select("page_id", F.col("name").alias("event"), "start", F.col("l.name").alias("market"), F.explode("l.selections").alias("s"))
    return s.where("s.status = 1 and s.odds > 1").select("page_id", "event", "start", "market", F.col("s.name").alias("player"), F.col("s.odds").alias("odds")).distinct()


def fresh_rows(feed: DataFrame, now: Column, max_age_hours: float, captured: str = "captured_at", start: str = "start") -> DataFrame:
    """Rows captured recently enough whose event has not started."""
    return feed.where((F.unix_timestamp(now) - F.unix_timestamp(captured) <= 3600 * max_age_hours) & (F.col(start) > now))


def prediction_market_rows(df: DataFrame, title: str = "title") -> DataFrame:
    """'Player: k+ statistic' titles to player, threshold and statistic; bid and ask to a mid price and odds."""
    rx = r"^(.+?):\s*(\d+)\+\s*(.+)$"
    mid = (F.col("yes_bid") + F.col("yes_ask")) / 2
    return df.withColumns({"player": F.nullif(F.regexp_extract(title, rx, 1), F.lit("")), "threshold": F.regexp_extract(title, rx, 2).try_cast("int"),
                           "stat": F.nullif(F.regexp_extract(title, rx, 3), F.lit("")), "mid": mid, "mid_odds": 1 / mid})


def plausible(df: DataFrame, odds: list[str], low: float = 1.01, high: float | None = None) -> DataFrame:
    return df.withColumns({c: implausible_to_null(c, low, high) for c in odds})
