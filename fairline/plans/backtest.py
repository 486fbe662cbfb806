"""Back-test plans: strategy grids, dev/test selection, staking ledgers and reports."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stake import kelly_fraction
from ..operators import evaluate as E
from ..operators import reshape as R
from ..operators import scans

# Selection and never-tuned periods, palpable-error cap.
DEV = (2012, 2018)
TEST = (2019, 2026)
MAX_EV = 0.30


def period_of(season: Column, dev: tuple[int, int] = DEV, test: tuple[int, int] = TEST) -> Column:
    return (F.when(season.between(*dev), F.lit("dev")).when(season.between(*test), F.lit("test")))


def config_table(spark: SparkSession, configs: Sequence[dict]) -> DataFrame:
    """Strategy settings as a table, of the caller's list alone: it does not grow with the input."""
    rows = [(i, c["family"], c["prob"], c["book"], float(c["min_ev"]), float(c.get("max_odds", 100.0)))
            for i, c in enumerate(configs)]
    return spark.createDataFrame(
        rows, "config_id int, family string, prob string, book string, min_ev double, max_odds double")


def priced_outcomes(df: DataFrame, probs: dict[str, Sequence[str]], books: dict[str, Sequence[str]],
                    won: Sequence[str], labels: Sequence[str], keep: Sequence[str],
                    pairs: set[tuple[str, str]], close: Sequence[str] | None = None) -> DataFrame:
    """Every (probability set, book, outcome) combination a grid needs, in one scan of the matches."""
    entries = []
    for prob, book in sorted(pairs):
        for i, label in enumerate(labels):
            f = [F.lit(prob).alias("prob"), F.lit(book).alias("book"), F.lit(label).alias("selection"),
                 F.col(probs[prob][i]).cast("double").alias("p"), F.col(books[book][i]).cast("double").alias("odds"),
                 F.col(won[i]).alias("won")]
            f.append((F.col(close[i]) if close else F.lit(None)).cast("double").alias("close_fair_odds"))
            entries.append(F.struct(*f))
    long = df.select(*keep, F.explode(F.array(*entries)).alias("r")).select(*keep, "r.*")
    return (long.where("p is not null and odds is not null")
            .withColumn("ev", F.col("p") * F.col("odds") - 1).withColumn("clv", F.col("odds") / F.col("close_fair_odds") - 1))


def strategy_grid(df: DataFrame, configs: Sequence[dict], probs: dict[str, Sequence[str]], books: dict[str, Sequence[str]],
                  won: Sequence[str], labels: Sequence[str], keep: Sequence[str], close: Sequence[str] | None = None,
                  max_ev: float = MAX_EV) -> tuple[DataFrame, DataFrame]:
    """Selected bets of every configuration (one per match and configuration) and the settings table.

    The pick of a match depends only on (prob, book, max_odds): its best EV qualifies for a
    configuration exactly when it reaches that configuration's min_ev. So picks are row-level
    maxima over the match row, and only then fan out over an equi-join with the settings.
    """
    table = config_table(df.sparkSession, configs)
    order = sorted(labels, reverse=True)

    def choice(names: dict[str, Sequence[str]], tag: str) -> Column:
        used = sorted({c[tag] for c in configs})
        return F.explode(F.array(*[F.struct(F.lit(x).alias(tag), *[F.col(names[x][i]).cast("double").alias(f"v{i}")
                                                                   for i in range(len(labels))]) for x in used]))

    base = [*keep, *won, *(close or [])]
    book_cols = sorted({x for b in {c["book"] for c in configs} for x in books[b]})
    d = df.select(*base, *book_cols, choice(probs, "prob").alias("_p")).select(*base, "_p", choice(books, "book").alias("_o"))
    tops = sorted({float(c.get("max_odds", 100.0)) for c in configs})
    d = d.select(*base, "_p", "_o", F.explode(F.array(*[F.lit(t) for t in tops])).alias("max_odds"))

    def cell(i: int) -> Column:
        p, o = F.col(f"_p.v{i}"), F.col(f"_o.v{i}")
        clv = (o / F.col(close[i]) - 1) if close else F.lit(None).cast("double")
        return F.when((p * o - 1 <= max_ev) & (o <= F.col("max_odds")), F.struct(
            (p * o - 1).alias("ev"), F.lit(order.index(labels[i])).alias("pref"), F.lit(labels[i]).alias("selection"),
            p.alias("p"), o.alias("odds"), F.col(won[i]).alias("won"), clv.alias("clv")))

    best = F.explode_outer(F.array(F.greatest(*[cell(i) for i in range(len(labels))]))).alias("b")
    picks = d.select(*keep, "_p.prob", "_o.book", "max_odds", best)
    picks = picks.select(*keep, "prob", "book", "max_odds", "b.*").drop("pref")
    floor = min(float(c["min_ev"]) for c in configs)
    # a table out of a list has no known size, and adaptive execution takes back a broadcast whose side leaves most shuffle partitions empty:
    # left to itself Spark shuffles every pick
    chosen = picks.where(F.col("ev") >= floor).join(F.broadcast(table), ["prob", "book", "max_odds"]).where("ev >= min_ev")
    return chosen, table


def grid_report(bets: DataFrame, configs: DataFrame, dev: tuple[int, int], test: tuple[int, int]) -> DataFrame:
    """One row per configuration with dev and test columns."""
    tagged = bets.withColumn("period", period_of(F.col("season"), dev, test)).where("period is not null")
    stats = tagged.groupBy("config_id").pivot("period", ["dev", "test"]).agg(
        F.count(F.lit(1)).alias("n"), F.avg(E.unit_pnl()).alias("roi"), F.avg("odds").alias("mean_odds"),
        F.avg(F.col("won").cast("double")).alias("hit_rate"), F.avg("clv").alias("mean_clv"))
    return configs.join(stats, "config_id", "left").withColumns(
        {"dev_n": F.coalesce("dev_n", F.lit(0)), "test_n": F.coalesce("test_n", F.lit(0))})


def select_on_dev(report: DataFrame, min_n: int, books: Sequence[str], per_family: int = 3) -> DataFrame:
    """Best configurations per family, chosen on the dev period only."""
    ok = report.where((F.col("dev_n") >= min_n) & F.col("book").isin(list(books)))
    return R.top_n_by(ok, ["family"], [F.desc("dev_roi"), F.asc("config_id")], per_family)


def legacy_over_rule(df: DataFrame, p_over: str, odds: str, edge: float = 0.05) -> DataFrame:
    """Old rule kept for audit: back the over when the probability exceeds 1/odds by the edge."""
    return (df.where((F.col(p_over) - 1 / F.col(odds)) >= edge)
            .withColumns({"odds": F.col(odds), "won": F.col("won_o")}))


# ------------------------------------------------------------------ bankroll ledgers

# The compared staking policies.
POLICIES = (("flat_1pct", "flat", 0.01, 0.05), ("bankroll_1pct", "flat_pct", 0.01, 0.05),
            ("kelly_1_10", "kelly", 0.1, 0.05), ("kelly_1_4", "kelly", 0.25, 0.05),
            ("kelly_1_2", "kelly", 0.5, 0.05), ("kelly_full", "kelly", 1.0, 0.2))


def ledger(bets: DataFrame, date_col: str = "match_date", policies: Sequence[tuple] = POLICIES,
           bankroll: float = 1000.0, max_daily_exposure: float = 0.5) -> DataFrame:
    """Bankroll after each day per policy.

    All bets of a day are sized with the morning bankroll, so bankroll-relative policies compound
    day returns and have the closed form bank_0 * prod(1 + R_d); flat stakes add up. The daily
    exposure cap is bankroll-relative and scales R_d. Days after the bankroll first reaches 1 are
    dropped. Bets are reduced to one row per (policy, day) before any ordered step.
    """
    spec = F.array(*[F.struct(F.lit(n).alias("policy"), F.lit(m).alias("method"), F.lit(float(f)).alias("frac"),
                              F.lit(float(c)).alias("cap")) for n, m, f, c in policies])
    rows = bets.select(date_col, "p", "odds", "won", F.explode(spec).alias("s")).select(date_col, "p", "odds", "won", "s.*")
    share = F.when(F.col("method") == "kelly", F.least(F.col("frac") * kelly_fraction("p", "odds"), F.col("cap"))).otherwise(F.col("frac"))
    rows = rows.withColumn("share", share)
    gain = F.when(F.col("won"), F.col("share") * (F.col("odds") - 1)).otherwise(-F.col("share"))
    daily = rows.groupBy("policy", "method", date_col).agg(
        F.sum(F.when(F.col("share") > 0, 1).otherwise(0)).alias("n"), F.sum("share").alias("exposure"), F.sum(gain).alias("ret"))
    scale = F.when((F.col("method") != "flat") & (F.col("exposure") > max_daily_exposure), max_daily_exposure / F.col("exposure")).otherwise(1.0)
    daily = daily.withColumns({"ret": F.col("ret") * scale, "exposure": F.col("exposure") * scale, "_year": F.year(date_col)})
    growth = F.log(F.greatest(F.lit(1e-12), 1 + F.col("ret")))
    run = scans.running(daily, ["policy", "method"], [date_col], "_year",
                        sums={"cum": F.when(F.col("method") == "flat", F.col("ret")).otherwise(growth)}, inclusive=True)
    bank = F.when(F.col("method") == "flat", bankroll * (1 + F.col("cum"))).otherwise(bankroll * F.exp("cum"))
    run = run.withColumn("bankroll", bank)
    alive = scans.running(run, ["policy", "method"], [date_col], "_year",
                          sums={"ruined": F.when(F.col("bankroll") <= 1, 1).otherwise(0)})
    return alive.where("ruined = 0").select("policy", "method", date_col, "_year", "n", "exposure", "ret", "bankroll")


def staking_report(book: DataFrame, date_col: str = "match_date", bankroll: float = 1000.0) -> DataFrame:
    """Final bankroll and maximum drawdown per policy."""
    last = book.groupBy("policy").agg(F.sum("n").alias("n_bets"), F.max_by("bankroll", date_col).alias("final_bankroll"))
    dd = scans.max_drawdown(book, ["policy"], [date_col], "_year", "bankroll", bankroll)
    return last.join(dd, "policy")


def cumulative_profit(bets: DataFrame, date_col: str = "match_date") -> DataFrame:
    """Unit-stake profit per day and its running total."""
    daily = bets.groupBy(date_col).agg(F.count(F.lit(1)).alias("n"), F.sum(E.unit_pnl()).alias("profit"))
    daily = daily.withColumns({"_all": F.lit(0), "_year": F.year(date_col)})
    return scans.running(daily, ["_all"], [date_col], "_year", sums={"cum_profit": F.col("profit")},
                         inclusive=True).drop("_all", "_year")


def percent_text(c: Column) -> Column:
    return F.concat(F.format_number(100 * c, 2), F.lit(" %"))
