"""Feed adapters: five layouts of match statistics read into one conformed set of tables.

An adapter only renames and reshapes: it gives ``games`` (game, event, date, year, map, team_1, team_2, score_1, score_2,
winner) and ``entries`` (game, map, team, player, agent and the statistics, all as text). ``conform`` does the rest once
for all feeds: names by their dimensions, the year, decisive scores, canonical sides, full sides, keys and slots.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.functions import normalize as n
from matchloom.operators import conform as c
from matchloom.sources.shared import written
from matchloom.sources.tables import read_csv, read_year_folders

STATS = ("kills", "deaths", "assists", "kast", "adr", "hs", "fk", "fd", "acs")
GAMES = ("game", "event", "date", "year", "map", "team_1", "team_2", "score_1", "score_2", "winner")


@dataclass(frozen=True)
class Feed:
    """One feed's source name, games and entries."""

    source: str
    games: DataFrame
    entries: DataFrame


def _named(df: DataFrame, **columns: Column | str) -> DataFrame:
    """The columns of ``GAMES`` that are given, as text; the others null."""
    made = {k: F.col(f"`{v}`") if isinstance(v, str) else v for k, v in columns.items()}
    return df.select(*((made[k] if k in made else F.lit(None)).cast("string").alias(k) for k in GAMES))


def _entries(df: DataFrame, game: Column, map_: str, team: str, player: str, agent: str, stats: dict[str, tuple[str, ...]]) -> DataFrame:
    """Entries; each statistic is the first of its alternative columns that is filled."""
    filled = lambda names: F.coalesce(*(F.nullif(F.trim(F.col(f"`{x}`")), F.lit("")) for x in names))
    return df.select(game.alias("game"), F.col(map_).alias("map"), F.col(team).alias("team"), F.col(f"`{player}`").alias("player"), F.col(agent).alias("agent"), *(filled(stats[s]).alias(s) for s in STATS))


# The feeds' column names.
_TOUR = {
    "kills": ("Kills", "K"), "deaths": ("Deaths", "D"), "assists": ("Assists", "A"), "kast": ("Kill, Assist, Trade, Survive %", "KAST%", "kast"), "adr": ("Average Damage Per Round", "ADR"),
    "hs": ("Headshot %", "HS%"), "fk": ("First Kills", "FK"), "fd": ("First Deaths", "FD"), "acs": ("Average Combat Score", "ACS"),
}
_FLAT = {"kills": ("k",), "deaths": ("d",), "assists": ("a",), "kast": ("kast",), "adr": ("adr",), "hs": ("hs",), "fk": ("fk",), "fd": ("fd",), "acs": ("acs",)}
_EVENT = _FLAT | {"kills": ("kill",), "deaths": ("death",), "assists": ("assist",), "kast": ("kast%",), "hs": ("hs%",)}
_DETAIL = _FLAT | {"hs": ("hs_percent",)}
_SCRAPED = _FLAT | {"kills": ("kills",), "deaths": ("deaths",), "assists": ("assists",), "hs": ("hs_pct",), "fk": ("fb",)}


def _flat_names(stats: dict[str, tuple[str, ...]]) -> list[str]:
    return [x for names in stats.values() for x in names]


def tour(spark: SparkSession, root: str, prefix: str, source: str) -> Feed:
    """Year folders with a score file and an overview file; the overview's rows of single halves go."""
    scores = read_year_folders(spark, root, prefix, "matches/maps_scores.csv", ["Tournament", "Match Name", "Map", "Team A", "Team B", "Team A Score", "Team B Score"])
    rows = read_year_folders(spark, root, prefix, "matches/overview.csv", ["Side", "Match Name", "Map", "Team", "Player", "Agents", *_flat_names(_TOUR)])
    rows = rows.where(F.coalesce(c.equals_ignoring_case(F.col("Side"), "both"), F.lit(True)))
    game = F.concat_ws("|", F.col("year"), F.trim("Match Name"))
    games = _named(scores.withColumn("game", game), game="game", event="Tournament", year="year", map="Map", team_1="Team A", team_2="Team B", score_1="Team A Score", score_2="Team B Score")
    return Feed(source, games, _entries(rows, game, "Map", "Team", "Player", "Agents", _TOUR))


def flat_matches(spark: SparkSession, path: str, source: str) -> Feed:
    """One Latin-1 file with a row a player that repeats its game."""
    rows = read_csv(spark, path, ["match-datetime", "map", "team1", "team2", "team1-score", "team2-score", "player-team", "player-name", "agent", *_flat_names(_FLAT)], "ISO-8859-1")
    game = F.concat_ws("|", F.col("`match-datetime`"), "team1", "team2")
    once = rows.select(game.alias("game"), "match-datetime", "map", "team1", "team2", "team1-score", "team2-score").distinct()
    games = _named(once, game="game", date="match-datetime", map="map", team_1="team1", team_2="team2", score_1="team1-score", score_2="team2-score")
    return Feed(source, games, _entries(rows.withColumnRenamed("player-team", "team"), game, "map", "team", "player-name", "agent", _FLAT))


def single_event(spark: SparkSession, path: str, source: str, event: str) -> Feed:
    """One file with a row a player and scores from that player's side."""
    rows = read_csv(spark, path, ["match_id", "game_id", "map", "team", "opponent", "score_team", "score_opp", "player", "agent", *_flat_names(_EVENT)])
    game = F.concat_ws("|", "match_id", "game_id")
    # both sides tell the game; the view of the side that sorts first stands for it
    view = rows.where("team <= opponent").select(game.alias("game"), "map", "team", "opponent", "score_team", "score_opp").distinct()
    other = rows.where("team > opponent").select(game.alias("game"), "map", F.col("opponent").alias("team"), F.col("team").alias("opponent"), F.col("score_opp").alias("score_team"), F.col("score_team").alias("score_opp")).distinct()
    games = _named(view.union(other).distinct(), game="game", event=F.lit(event), map="map", team_1="team", team_2="opponent", score_1="score_team", score_2="score_opp")
    return Feed(source, games, _entries(rows, game, "map", "team", "player", "agent", _EVENT))


def event_stats(spark: SparkSession, stats_path: str, maps_path: str, source: str) -> Feed:
    """Player rows of several kinds, of which those of single maps count, and a file of scores such as 13-5."""
    rows = read_csv(spark, stats_path, ["stat_type", "match_id", "map_name", "team1", "team2", "player_team", "map_winner", "match_date", "event_name", "player_name", "agent", *_flat_names(_DETAIL)])
    rows = rows.where(c.equals_ignoring_case(F.col("stat_type"), "map"))
    maps = read_csv(spark, maps_path, ["match_id", "map_name", "score"])
    pair = n.score_pair(F.col("score"))
    scores = maps.groupBy("match_id", "map_name").agg(F.max(pair).alias("s"))
    once = rows.groupBy("match_id", "map_name").agg(F.min(F.struct("event_name", "match_date", "team1", "team2", "map_winner")).alias("g")).select("match_id", "map_name", "g.*")
    once = once.join(scores, ["match_id", "map_name"], "left")
    games = _named(once, game="match_id", event="event_name", date="match_date", map="map_name", team_1="team1", team_2="team2", score_1=F.col("s.a"), score_2=F.col("s.b"), winner="map_winner")
    return Feed(source, games, _entries(rows, F.col("match_id"), "map_name", "player_team", "player_name", "agent", _DETAIL))


def scraped(spark: SparkSession, maps_path: str, players_path: str, details_path: str, source: str) -> Feed:
    """Two rows a game, one a team, beside players and match details."""
    maps = read_csv(spark, maps_path, ["match_id", "game_id", "map", "team", "score", "map_winner"])
    both = c.paired_rows(maps, "game_id", ["team"], ["team", "match_id", "map", "score", "map_winner"])
    details = read_csv(spark, details_path, ["match_id", "event", "date"]).groupBy("match_id").agg(F.min(F.struct("event", "date")).alias("d"))
    both = both.join(details.select(F.col("match_id").alias("match_id_1"), F.col("d.event").alias("event"), F.col("d.date").alias("date")), "match_id_1", "left")
    games = _named(both, game="game_id", event="event", date="date", map="map_1", team_1="team_1", team_2="team_2", score_1="score_1", score_2="score_2", winner="map_winner_1")
    rows = read_csv(spark, players_path, ["game_id", "team", "player", "agent", *_flat_names(_SCRAPED)]).join(maps.groupBy("game_id").agg(F.min("map").alias("map")), "game_id")
    return Feed(source, games, _entries(rows, F.col("game_id"), "map", "team", "player", "agent", _SCRAPED))


def conform(feed: Feed, maps: DataFrame, agents: DataFrame, patch_years: dict[int, int], teams: DataFrame | None = None, size: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matches, players, comps) of a feed.

    ``maps``, ``agents`` (raw, name and, for agents, role) and ``teams`` are dimensions; names they lack drop the row, but an
    unknown team keeps its own. A game needs a map, two teams, two different scores, or a winner where scores are missing
    or equal (then 13 to 5), and exactly ``size`` known agents on either side.
    """
    named = lambda df, col, dim, keep=False: n.with_canonical(df, col, dim, "raw", "name", keep)
    team = lambda df, *cols: reduce(lambda d, x: named(d, x, teams, True), cols, df) if teams is not None else df.withColumns({x: F.trim(x) for x in cols})
    games = team(named(feed.games, "map", maps), "team_1", "team_2", "winner").where("map is not null and team_1 <> '' and team_2 <> ''")
    year, year_source = n.year_and_source(F.col("event"), F.col("date"), patch_years)
    score = [n.to_double(F.col(f"score_{i}")) for i in (1, 2)]
    told = F.coalesce(score[0] != score[1], F.lit(False))
    won_first = F.when(F.col("winner") == F.col("team_1"), True).when(F.col("winner") == F.col("team_2"), False)
    filled = [F.when(told, s).otherwise(F.when(won_first == first, 13.0).when(won_first.isNotNull(), 5.0)) for s, first in zip(score, (True, False))]
    games = games.select("game", "event", "date", F.coalesce(year, F.col("year").try_cast("int")).alias("year"), year_source.alias("year_source"), "map", F.col("team_1").alias("team_a"), F.col("team_2").alias("team_b"), filled[0].alias("score_a"), filled[1].alias("score_b"))
    games = c.canonical_sides(c.decisive(games, "score_a", "score_b"), [("team_a", "team_b"), ("score_a", "score_b")], "label")
    key = n.surrogate_key(F.lit(feed.source), F.concat_ws("|", "game", "map"), F.col("map"))
    dedup = n.match_dedup_key(F.col("year"), F.col("team_a"), F.col("team_b"), F.col("map"), F.col("score_a"), F.col("score_b"))
    games = games.select("*", key.alias("match_key"), dedup.alias("dedup_key"), F.lit(feed.source).alias("source"), F.concat_ws("/", F.lit(feed.source), "game").alias("provenance"))
    games = c.keep_first(games, ["match_key"], [F.col("dedup_key")])

    entries = team(named(named(feed.entries, "map", maps), "agent", agents), "team").where("map is not null and agent is not null and team <> ''")
    # whole rows move once, to their match: teams, sides and slots are counted there
    entries = entries.where("game is not null").select(key.alias("match_key"), "team", F.trim("player").alias("player"), "agent", *STATS).repartition("match_key")
    rows = [c for c in entries.columns if c != "team"]
    here = F.count(F.lit(1)).over(Window.partitionBy("match_key", "team"))  # the players of one team in one game
    teams = games.select("match_key", "team_a", "team_b")
    side = F.explode(F.filter(F.array(*(F.when(F.col("team") == F.col(f"team_{s}"), s) for s in "ab")), lambda x: x.isNotNull()))
    placed = entries.withColumn("_n", here).where(F.col("_n") == size).join(teams, "match_key").select(*rows, side.alias("side"))
    # longer or shorter groups failed; both sides are there if all their rows are
    both = F.count(F.lit(1)).over(Window.partitionBy("match_key"))
    slot = F.row_number().over(Window.partitionBy("match_key", "side").orderBy("player", "agent"))
    kept = placed.withColumn("_n", both).where(F.col("_n") == 2 * size)
    roles = agents.groupBy("name").agg(F.min("role").alias("role"))
    players = kept.join(roles, kept.agent == roles.name, "left").select(
        "match_key", "side", slot.alias("player_slot"), "player", "agent", "role", n.kill_ratio(F.col("kills"), F.col("deaths"), 10.0).alias("kd"), n.percent(F.col("kast")).alias("kast"), n.percent(F.col("hs")).alias("hs"),
        *(n.to_double(F.col(x)).alias(x) for x in ("adr", "assists", "fk", "fd", "acs")), F.lit(feed.source).alias("source"),
    )
    matches = games.join(kept.select("match_key"), "match_key", "left_semi")
    comps = players.groupBy("match_key", "side").agg(n.composition_key(F.collect_list("agent")).alias("comp"))  # a side's own agents
    return matches, players, comps


def conform_all(feeds: list[Feed], *dims, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All feeds conformed and united, before any source contract or dedup across sources. Dimensions are written, so that Spark
    knows which are small, and sends those to all tasks instead of shuffling the entries of every feed to meet them."""
    dims = [written(d) if isinstance(d, DataFrame) else d for d in dims]
    done = [conform(f, *dims, **options) for f in feeds]
    return tuple(c.union_feeds([d[i] for d in done]) for i in range(3))
