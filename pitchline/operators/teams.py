"""Team ratings, their propagation, and what is known of two teams before a match."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitchline.operators.ratings import _scan


@dataclass(frozen=True)
class TeamRules:
    """Fixed values of the team ratings: steps, home edge, margin factor, tiers and seasons."""

    k_most: float = 32.0
    k_least: float = 16.0
    k_half: float = 30.0
    home_edge: float = 50.0
    divisor: float = 400.0
    base: float = 1500.0
    tier_start: tuple[float, ...] = (1550.0, 1525.0, 1475.0, 1425.0)
    tier_memory: float = 0.8
    cross_tier: float = 0.5
    most_cross_tier: float = 2.5
    margin_power: float = 0.7
    margin_offset: float = 5.0
    margin_base: float = 10.0
    margin_gap: float = 0.004
    margin_bounds: tuple[float, float] = (0.5, 2.5)
    season_keep: float = 1.0

    def start(self, tier: int) -> float:
        return self.tier_start[min(max(int(tier), 1), len(self.tier_start)) - 1]

    def margin_factor(self, margin: float, winner: float, loser: float) -> float:
        low, high = self.margin_bounds
        return max(low, min(high, (abs(margin) + self.margin_offset) ** self.margin_power / max(1.0, self.margin_base + self.margin_gap * (winner - loser))))


def team_scan(matches: DataFrame, league: str, order: list[str], home: str, away: str, result: str, margin: str, tier: str, edge: str, season: str, rules: TeamRules = TeamRules()) -> DataFrame:
    """Ratings of both teams before and after each match, in order within a league.

    ``result`` is 1, 0.5 or 0 for the home team; ``edge`` is 1 where it plays at
    home, -1 where the other does, 0 on neutral ground.  A null or zero margin
    and a draw weigh one.  A team enters at its event's tier; its own tier
    follows the events it plays, and matches across tiers move ratings more.
    A new season leaves ``season_keep`` of each rating's distance from the base:
    that is caught up with when a team plays, so no match touches all teams.
    """
    kind = matches.schema[league].dataType.simpleString()
    schema = f"{league} {kind}, {home} long, {away} long, home_before double, away_before double, home_after double, away_after double, expected double, weight double"

    def step(state: dict, r) -> tuple:
        teams = state.setdefault("teams", {})
        if state.get("season") != (now := getattr(r, season)):
            state["count"] = state.get("count", -1) + 1
            state["season"] = now
        level, seen = getattr(r, tier), []
        for key in (getattr(r, home), getattr(r, away)):
            value, n, mean_tier, at = teams.get(key, (rules.start(level), 0, float(level), state["count"]))
            value = rules.base + rules.season_keep ** (state["count"] - at) * (value - rules.base)
            seen.append((key, value, n, mean_tier))
        (h, a), (rh, ra) = (seen[0][0], seen[1][0]), (seen[0][1], seen[1][1])
        score, by = float(getattr(r, result)), getattr(r, margin)
        expected = 1 / (1 + 10 ** ((ra - rh - rules.home_edge * getattr(r, edge)) / rules.divisor))
        apart = abs(round(seen[0][3]) - round(seen[1][3]))
        weight = min(1 + apart * rules.cross_tier, rules.most_cross_tier)
        if score != 0.5 and by is not None and not math.isnan(by) and by != 0:
            weight *= rules.margin_factor(by, *((rh, ra) if score > 0.5 else (ra, rh)))
        after = []
        for (key, value, n, mean_tier), sign in zip(seen, (1, -1)):
            k = rules.k_least + (rules.k_most - rules.k_least) * math.exp(-n / rules.k_half)
            after.append(value + sign * k * weight * (score - expected))
            teams[key] = (after[-1], n + 1, rules.tier_memory * mean_tier + (1 - rules.tier_memory) * level, state["count"])
        return getattr(r, league), h, a, rh, ra, *after, expected, weight

    return _scan(matches, league, order, dict, step, schema)


def propagate(rated: DataFrame, results: DataFrame, alike: DataFrame, share: float = 0.15) -> DataFrame:
    """``team, elo``: each team moved by what the teams it is alike with won and lost.

    ``rated`` is ``team, elo``; ``results`` ``winner, loser, delta``; ``alike``
    ``team, other, likeness``.  Results are summed by team before they meet the
    likenesses; teams without any stay as they are.
    """
    moves = results.select(F.explode(F.array(F.struct(F.col("winner").alias("team"), F.col("delta").alias("d")), F.struct(F.col("loser").alias("team"), (-F.col("delta")).alias("d")))).alias("m"))
    net = moves.groupBy(F.col("m.team").alias("team")).agg(F.sum("m.d").alias("net"))
    spread = alike.join(net, "team").groupBy(F.col("other").alias("team")).agg(F.sum(F.col("net") * F.col("likeness")).alias("_by"))
    return rated.join(spread, "team", "left").select("team", (F.col("elo") + share * F.coalesce("_by", F.lit(0.0))).alias("elo"))


def pre_match(matches: DataFrame, n: int = 5, least: int = 5) -> DataFrame:
    """What was known before each match's day, for all matches at once.

    ``matches`` is ``match_id, day, home, away, venue, winner, first_total,
    chased``: the winner is null where there was none, ``chased`` says whether
    the side batting second won.  Adds ``home_form`` and ``away_form`` (share won
    of the last ``n`` decided matches), ``h2h_total`` and ``h2h_wins`` (of the
    home team), and of the venue's decided matches ``venue_n`` and, from
    ``least`` matches on, ``venue_score`` and ``venue_chased``.  Matches of the
    same day never see each other.  Frames are ranges of days that only grow,
    so a key with a long history costs one ordered pass, not a join with it.
    """
    # an empty name is no winner
    matches = matches.withColumn("winner", F.when(F.col("winner").cast("string") != "", F.col("winner")))
    decided = F.col("winner").isNotNull()
    day = F.unix_date("day")

    def earlier(*keys: Column):
        return Window.partitionBy(*keys).orderBy("_day").rangeBetween(Window.unboundedPreceding, -1)

    pair = earlier(F.least("home", "away"), F.greatest("home", "away"))
    # the other orientation of the pair counts the home team's wins by the team's name
    low_wins = F.sum((F.col("winner") == F.least("home", "away")).cast("int")).over(pair)
    rows = matches.withColumn("_day", day)
    rows = rows.withColumn("h2h_total", F.count("winner").over(pair)).withColumn("_low", F.coalesce(low_wins, F.lit(0)))
    rows = rows.withColumn("h2h_wins", F.when(F.col("home") < F.col("away"), F.col("_low")).otherwise(F.col("h2h_total") - F.col("_low")))
    at = earlier(F.col("venue"))
    rows = rows.withColumn("venue_n", F.count("winner").over(at))
    known = F.col("venue_n") >= least
    rows = rows.withColumn("venue_score", F.when(known, F.avg(F.when(decided, F.col("first_total"))).over(at))).withColumn("venue_chased", F.when(known, F.avg(F.when(decided, F.col("chased").cast("double"))).over(at)))
    sides = matches.select("match_id", "day", "winner", F.explode(F.array(F.struct(F.lit("home").alias("side"), F.col("home").alias("team")), F.struct(F.lit("away").alias("side"), F.col("away").alias("team")))).alias("s")).select("match_id", "day", "winner", "s.side", "s.team")
    form = _form(sides, n)
    wide = form.groupBy("match_id").agg(F.max(F.when(F.col("side") == "home", F.col("form"))).alias("home_form"), F.max(F.when(F.col("side") == "away", F.col("form"))).alias("away_form"))
    return rows.drop("_day", "_low").join(wide, "match_id")


def _form(sides: DataFrame, n: int) -> DataFrame:
    """``match_id, side, form`` from ``match_id, day, winner, side, team``.

    Each row is an asker and, if decided, a result too.  Askers come before the
    results of their day; the number of results before them finds the prefix
    sums they need: an equi-join by position.
    """
    won = (F.col("winner") == F.col("team")).cast("int")
    results = sides.where("winner is not null").withColumn("_won", won)
    both = sides.withColumn("_won", F.lit(None).cast("int")).unionByName(results)
    w = Window.partitionBy("team").orderBy("day", F.col("_won").isNotNull(), "match_id", "side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_i", F.count("_won").over(w)).withColumn("_s", F.coalesce(F.sum("_won").over(w), F.lit(0)))
    past = both.where("_won is not null").select(F.col("team").alias("_t"), F.col("_i").alias("_at"), F.col("_s").alias("_before"))
    asked = both.where("_won is null")
    out = asked.join(past, (F.col("team") == F.col("_t")) & (F.col("_i") - n == F.col("_at")), "left")
    return out.select("match_id", "side", F.try_divide(F.col("_s") - F.coalesce("_before", F.lit(0)), F.least(F.col("_i"), F.lit(n))).alias("form"))
