"""Nested match documents as relational tables.

A document has ``info`` and ``innings``, a list of overs of deliveries.  The
file name without its ending is the match id.  All tables come from one scan
with an explicit schema; broken documents and missing parts give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_DELIVERY = "struct<batter: string, bowler: string, non_striker: string, runs: struct<batter: int, extras: int, total: int>, extras: struct<wides: int, noballs: int, byes: int, legbyes: int, penalty: int>, wickets: array<struct<player_out: string, kind: string, fielders: array<struct<name: string>>>>>"
_INFO = "struct<dates: array<string>, teams: array<string>, match_type: string, gender: string, venue: string, city: string, event: struct<name: string>, toss: struct<winner: string, decision: string>, outcome: struct<winner: string, result: string, by: struct<runs: int, wickets: int>>, players: map<string, array<string>>, registry: struct<people: map<string, string>>>"
SCHEMA = f"info {_INFO}, innings array<struct<team: string, overs: array<struct<over: int, deliveries: array<{_DELIVERY}>>>>>"


def read_matches(spark: SparkSession, path: str) -> DataFrame:
    """One row a document: ``match_id, info, innings``."""
    name = F.regexp_extract("_metadata.file_name", r"^(.*?)(\.json)?$", 1)
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path).select(name.alias("match_id"), "info", "innings").where("info is not null")


def matches(raw: DataFrame) -> DataFrame:
    i = F.col("info")
    by = i["outcome"]["by"]
    margin = F.when(by["runs"].isNotNull(), "runs").when(by["wickets"].isNotNull(), "wickets")
    return raw.select(
        "match_id", F.lower(i["match_type"]).alias("match_type"), i["gender"].alias("gender"), i["venue"].alias("venue"), i["city"].alias("city"), F.get(i["dates"], 0).cast("date").alias("match_date"), F.get(i["teams"], 0).alias("team1"), F.get(i["teams"], 1).alias("team2"),
        i["toss"]["winner"].alias("toss_winner"), i["toss"]["decision"].alias("toss_decision"), i["outcome"]["winner"].alias("winner"), i["outcome"]["result"].alias("result"), margin.alias("win_by"), F.coalesce(by["runs"], by["wickets"]).alias("win_margin"), i["event"]["name"].alias("event"),
    )


def players(raw: DataFrame) -> DataFrame:
    """``player_id, player_name`` once each; a name that is not registered is its own id."""
    named = raw.select(F.explode("info.players").alias("team", "names"), F.col("info.registry.people").alias("ids")).select(F.explode("names").alias("player_name"), "ids")
    return named.select(F.coalesce(F.try_element_at("ids", F.col("player_name")), "player_name").alias("player_id"), "player_name").distinct()


def deliveries(raw: DataFrame) -> DataFrame:
    """One row a ball.

    ``ball`` counts every delivery of the over, extras too; ``total_runs`` and
    ``wickets_fallen`` are those after the ball; fours and sixes need a ball
    without extras.
    """
    d = raw.select("match_id", F.col("info.teams").alias("teams"), F.col("info.registry.people").alias("ids"), F.posexplode("innings").alias("_i", "inn"))
    d = d.select("match_id", "teams", "ids", (F.col("_i") + 1).alias("innings"), F.col("inn.team").alias("batting_team"), F.explode("inn.overs").alias("o"))
    d = d.select("*", F.col("o.over").alias("over"), F.posexplode("o.deliveries").alias("_b", "x")).drop("o")
    x = F.col("x")
    extra = lambda k: F.coalesce(x["extras"][k], F.lit(0))
    person = lambda c: F.coalesce(F.try_element_at("ids", c), c)
    out_first = F.get(x["wickets"], 0)
    clean = F.coalesce(x["runs"]["extras"], F.lit(0)) == 0
    d = d.select(
        "match_id", "innings", "batting_team", F.when(F.get("teams", 0) == F.col("batting_team"), F.get("teams", 1)).otherwise(F.get("teams", 0)).alias("bowling_team"), "over", (F.col("_b") + 1).alias("ball"),
        person(x["batter"]).alias("batter_id"), person(x["bowler"]).alias("bowler_id"), person(x["non_striker"]).alias("non_striker_id"), x["runs"]["batter"].alias("runs_batter"), x["runs"]["extras"].alias("runs_extras"), x["runs"]["total"].alias("runs_total"),
        *(extra(k).alias(k) for k in ("wides", "noballs", "byes", "legbyes", "penalty")),
        ((x["runs"]["batter"] == 4) & clean).alias("is_four"), ((x["runs"]["batter"] == 6) & clean).alias("is_six"),
        F.coalesce(F.size(x["wickets"]) > 0, F.lit(False)).alias("is_wicket"), out_first["kind"].alias("wicket_kind"), person(out_first["player_out"]).alias("player_out_id"),
        F.get(out_first["fielders"], 0)["name"].alias("fielder1"), F.get(out_first["fielders"], 1)["name"].alias("fielder2"), F.greatest(F.coalesce(F.size(x["wickets"]), F.lit(0)), F.lit(0)).alias("_w"),
    )
    w = Window.partitionBy("match_id", "innings").orderBy("over", "ball").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    name = F.format_string("%s_%s_%d_%03d_%02d", "match_id", F.replace(F.coalesce("batting_team", F.lit("")), F.lit(" "), F.lit("_")), "innings", "over", "ball")
    return d.withColumns({"delivery_id": name, "total_runs": F.sum("runs_total").over(w), "wickets_fallen": F.sum("_w").over(w)}).drop("_w")


def innings_totals(balls: DataFrame) -> DataFrame:
    """Runs, wickets and overs of each innings; overs are whole overs and balls over all deliveries."""
    n = F.col("n")
    per = balls.groupBy("match_id", "innings", "batting_team").agg(F.count("*").alias("n"), F.sum("runs_total").alias("total_runs"), F.max("wickets_fallen").alias("total_wickets"))
    return per.select("match_id", "innings", "batting_team", "total_runs", "total_wickets", (F.floor(n / 6) + n % 6 / 10).alias("total_overs"))


def hourly_weather(spark: SparkSession, path: str) -> DataFrame:
    """``latitude, longitude, at, <measures>`` from landed weather documents: one row for each hour.

    A document holds parallel arrays below ``hourly``; an array that is shorter
    or missing gives nulls.
    """
    measures = ("temperature_2m", "relative_humidity_2m", "precipitation", "cloud_cover", "wind_speed_10m")
    schema = "latitude double, longitude double, hourly struct<time:array<string>," + ",".join(f"{m}:array<double>" for m in measures) + ">"
    docs = spark.read.schema(schema).option("multiLine", True).json(path)
    hours = docs.select("latitude", "longitude", F.posexplode("hourly.time").alias("_i", "_at"), "hourly")
    return hours.select("latitude", "longitude", F.to_timestamp_ntz("_at").alias("at"), *(F.get(F.col("hourly")[m], F.col("_i")).alias(m) for m in measures))


def with_canonical(df: DataFrame, column: str, aliases: DataFrame) -> DataFrame:
    """``column`` by the lookup ``alias, canonical``; names without an alias stay.  Aliases are unique."""
    named = aliases.select(F.col("alias").alias("_alias"), F.col("canonical").alias("_canonical"))
    return df.join(named, F.col(column) == F.col("_alias"), "left").withColumn(column, F.coalesce("_canonical", column)).drop("_alias", "_canonical")
