"""User-facing questions about players, teams and matches, over the tables of ``sources.matches``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchline.functions import formulas as fx

FORMATS = ("t20", "odi", "test")


def valid_format(name: str | None) -> str | None:
    if name is not None and name.lower() not in FORMATS:
        raise ValueError(f"format must be one of {', '.join(FORMATS)}")
    return name and name.lower()


def search(entities: DataFrame, name: str, pattern: str, limit: int = 10) -> DataFrame:
    """Entities whose ``name`` contains ``pattern``, by name; the pattern is plain text in any case."""
    return entities.where(F.contains(F.lower(name), F.lit(pattern.lower()))).orderBy(name, *entities.columns).limit(limit)


def find(entities: DataFrame, key: str, name: str, wanted: str) -> DataFrame:
    """The best match, one row at most: the key itself, then the whole name, then a part of it."""
    how = F.when(F.col(key) == wanted, 0).when(F.lower(name) == wanted.lower(), 1).when(F.contains(F.lower(name), F.lit(wanted.lower())), 2)
    return entities.withColumn("_how", how).where("_how is not null").orderBy("_how", name, key).limit(1).drop("_how")


def batting(balls: DataFrame) -> DataFrame:
    """``player_id, innings, balls, runs, outs, average, strike_rate, boundary_share``; a wide is no ball faced."""
    faced = F.count_if(F.coalesce(F.col("wides"), F.lit(0)) == 0)
    out = F.count_if(F.col("is_wicket") & (F.col("player_out_id") == F.col("batter_id")))
    per = balls.groupBy(F.col("batter_id").alias("player_id")).agg(F.countDistinct("match_id", "innings").alias("innings"), faced.alias("balls"), F.sum("runs_batter").alias("runs"), out.alias("outs"), F.count_if(F.col("is_four") | F.col("is_six")).alias("_b"))
    return per.select("player_id", "innings", "balls", "runs", "outs", fx.rate(F.col("runs"), F.col("outs")).alias("average"), fx.rate(F.col("runs"), F.col("balls"), 100).alias("strike_rate"), fx.rate(F.col("_b"), F.col("balls")).alias("boundary_share"))


#: Ways of getting out that are not the bowler's.
NOT_BOWLED = ("run out", "retired hurt", "retired out", "retired not out", "obstructing the field")


def bowling(balls: DataFrame) -> DataFrame:
    """``player_id, balls, runs, wickets, economy, average, strike_rate``; byes and leg byes are not the bowler's."""
    legal = F.count_if((F.coalesce(F.col("wides"), F.lit(0)) == 0) & (F.coalesce(F.col("noballs"), F.lit(0)) == 0))
    given = F.sum(F.col("runs_total") - F.coalesce("byes", F.lit(0)) - F.coalesce("legbyes", F.lit(0)))
    wickets = F.count_if(F.col("is_wicket") & ~F.coalesce(F.lower("wicket_kind").isin(*NOT_BOWLED), F.lit(False)))
    per = balls.groupBy(F.col("bowler_id").alias("player_id")).agg(legal.alias("balls"), given.alias("runs"), wickets.alias("wickets"))
    return per.select("player_id", "balls", "runs", "wickets", fx.rate(F.col("runs"), F.col("balls"), 6).alias("economy"), fx.rate(F.col("runs"), F.col("wickets")).alias("average"), fx.rate(F.col("balls"), F.col("wickets")).alias("strike_rate"))


def analyze_players(balls: DataFrame, players: DataFrame, *wanted: str) -> DataFrame:
    """One row for each named player with both records; the filter on the player reaches the balls."""
    keys = players.where(F.col("player_id").isin(*wanted) | F.lower("player_name").isin(*(w.lower() for w in wanted)))
    bat = batting(balls.join(F.broadcast(keys.select(F.col("player_id").alias("batter_id")).distinct()), "batter_id", "left_semi")) if wanted else batting(balls)
    bowl = bowling(balls.join(F.broadcast(keys.select(F.col("player_id").alias("bowler_id")).distinct()), "bowler_id", "left_semi")) if wanted else bowling(balls)
    named = lambda df, role: df.select("player_id", *(F.col(c).alias(f"{role}_{c}") for c in df.columns if c != "player_id"))
    return (keys if wanted else players).join(named(bat, "bat"), "player_id", "left").join(named(bowl, "bowl"), "player_id", "left")


def analyze_matches(balls: DataFrame, top: int = 5) -> DataFrame:
    """``match_id, role, place, player_id, value``: the best batters by runs and bowlers by wickets of each match.

    Ties go to fewer balls, then to the smaller id.
    """
    out = None
    for role, who, value in (("batting", "batter_id", F.sum("runs_batter")), ("bowling", "bowler_id", F.count_if(F.col("is_wicket") & ~F.coalesce(F.lower("wicket_kind").isin(*NOT_BOWLED), F.lit(False))))):
        per = balls.groupBy("match_id", F.col(who).alias("player_id")).agg(value.cast("long").alias("value"), F.count("*").alias("_n"))
        place = F.row_number().over(Window.partitionBy("match_id").orderBy(F.desc("value"), "_n", "player_id"))
        part = per.withColumn("place", place).where(F.col("place") <= top).select("match_id", F.lit(role).alias("role"), "place", "player_id", "value")
        out = part if out is None else out.unionByName(part)
    return out


def teams(rated: DataFrame, team: str, day: str, elo: str) -> DataFrame:
    """``team, matches, last_day, elo``: the latest rating of each team."""
    return rated.groupBy(F.col(team).alias("team")).agg(F.count("*").alias("matches"), F.max(day).alias("last_day"), F.max_by(elo, F.struct(day, elo)).alias("elo"))


def predict(mine: Column, theirs: Column, home_edge: float = 50.0, runs_per_point: float = 0.1) -> Column:
    """struct of the win probability and the expected margin in runs; no edge on neutral ground is 0."""
    gap = mine + home_edge - theirs
    return F.struct(fx.expected_score(mine + home_edge, theirs).alias("win_probability"), (gap * runs_per_point).alias("margin"))
