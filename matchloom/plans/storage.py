"""Feeds and stores: what the tables hold is written to the shared folder in each layout, read back and held against SQL.

Orders are games between two clubs, line items their players; two players make a full side. The key's remainder by five
names the layout that tells of a game: year folders, one flat Latin-1 file, one event, player statistics with a file of
scores, or a scrape with two rows a game.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.operators import splits
from matchloom.plans.bindings import M, matches, table
from matchloom.plans.registry import collector
from matchloom.sources import feeds, tables
from matchloom.sources.shared import shared_dir, written

QUERIES, ORACLES, query = collector()

# Made-up years of patches, in the query and in its SQL.
_PATCHES = {1: 2021, 2: 2022, 3: 2022, 4: 2023, 5: 2024}
_SOURCES = ("kaggle_tour", "kaggle_flat", "kaggle_event", "kaggle_stats", "vlrgg_scrape")


def _games(spark, sf):
    """One row an order: two clubs, their scores, where it was played, and what its layouts say of its date."""
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey AS k", "o_orderkey % 5 AS layout", "year(o_orderdate) AS folder_year", "lower(o_orderpriority) AS map",
        "concat(char(65 + o_custkey % 20), o_custkey) AS team_1", "concat(if(o_orderkey % 7 = 0, 'É', char(65 + o_orderkey % 23)), 'x', o_orderkey % 50) AS team_2",
        "cast(floor(o_totalprice) AS long) % 14 AS s1", "o_custkey % 14 AS s2",
        "if(o_orderkey % 3 = 0, concat('Cup 20', 10 + o_orderkey % 10), 'Open') AS event", "concat('Patch ', o_orderkey % 9, '.0 game ', o_orderkey) AS date",
    ).selectExpr("*", "CASE k % 3 WHEN 0 THEN team_1 WHEN 1 THEN team_2 END AS winner")


def _entries(spark, sf):
    """One row an order, side, supplier and part, with the game's columns: a player and their statistics."""
    parts = table(spark, sf, "part").selectExpr("p_partkey AS l_partkey", "lower(p_brand) AS agent")
    # raw numbers move, by part and then by order; what players and statistics are called is made where they have come to
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linestatus", "l_suppkey", "l_partkey", "l_quantity", "l_linenumber", "l_extendedprice").repartition("l_partkey").groupBy("l_orderkey", "l_linestatus", "l_suppkey", "l_partkey").agg(F.min("l_quantity").alias("q"), F.min("l_linenumber").alias("n"), F.min("l_extendedprice").alias("price"))
    rows = lines.join(parts, "l_partkey").repartition("l_orderkey").selectExpr(
        "l_orderkey AS k", "l_linestatus = 'F' AS first", "concat('S', l_suppkey, '/', l_partkey) AS player", "agent", "cast(floor(q) AS int) AS kills", "n AS deaths", "l_suppkey % 10 AS assists",
        "concat(l_suppkey % 100, '%') AS kast", "cast(floor(price) AS long) AS adr", "concat(l_partkey % 100, '%') AS hs", "l_suppkey % 5 AS fk", "l_partkey % 5 AS fd", "200 AS acs",
    )
    return rows.join(_games(spark, sf), "k").withColumn("team", F.expr("if(first, team_1, team_2)"))


def _csv(df, path, names, **options):
    """Write columns under other names, compressed: text that repeats its game on every row is several times smaller so."""
    df.select(*(F.col(a).alias(b) for a, b in names.items())).write.csv(path, header=True, compression="gzip", **options)


_NAMES = {"player": "player", "agent": "agent", "kast": "kast", "adr": "adr", "hs": "hs", "fk": "fk", "fd": "fd", "acs": "acs"}


def _conformed(spark, sf):
    """Matches, players and compositions of all orders, each by way of the files of its layout."""
    root = shared_dir(spark)
    # once for all layouts and years, as the joins left them: evening out the wide entries would shuffle them all once more
    games, entries = written(_games(spark, sf), even=False), written(_entries(spark, sf), even=False)
    g, e = ([df.where(F.col("layout") == i) for i in range(5)] for df in (games, entries))

    title = F.concat(F.lit("order "), F.col("k"))
    for y in (r.folder_year for r in games.select("folder_year").where("folder_year is not null").distinct().collect()):  # a folder a year
        mine = F.col("folder_year") == y
        _csv(g[0].where(mine).withColumn("title", title), f"{root}/tour_{y}/matches/maps_scores.csv", {"event": "Tournament", "title": "Match Name", "map": "Map", "team_1": "Team A", "s1": "Team A Score", "team_2": "Team B", "s2": "Team B Score"})
        halves = e[0].where(mine).withColumns({"title": title, "half": F.explode(F.array(F.lit("both"), F.lit("attack")))})
        _csv(halves, f"{root}/tour_{y}/matches/overview.csv", {"half": "Side", "title": "Match Name", "map": "Map", "team": "Team", "player": "Player", "agent": "Agents", "kills": "K", "deaths": "Deaths", "assists": "A", "kast": "KAST%", "adr": "ADR", "hs": "HS%", "fk": "FK", "fd": "FD", "acs": "ACS"})
    _csv(e[1], f"{root}/flat.csv", {"date": "match-datetime", "map": "map", "team_1": "team1", "s1": "team1-score", "team_2": "team2", "s2": "team2-score", "team": "player-team", "player": "player-name", "kills": "k", "deaths": "d", "assists": "a"} | {c: c for c in _NAMES if c != "player"}, encoding="ISO-8859-1")
    own = e[2].selectExpr("*", "concat('m', k) AS match_id", "concat('g', k) AS game_id", "if(first, team_2, team_1) AS opponent", "if(first, s1, s2) AS score_team", "if(first, s2, s1) AS score_opp")
    _csv(own, f"{root}/event.csv", {c: c for c in ("match_id", "game_id", "map", "team", "opponent", "score_team", "score_opp")} | {"kills": "kill", "deaths": "death", "assists": "assist"} | _NAMES | {"kast": "kast%", "hs": "hs%"})
    kinds = e[3].withColumns({"match_id": F.concat(F.lit("m"), "k"), "kind": F.explode(F.array(F.lit("map"), F.lit("overall")))})
    _csv(kinds, f"{root}/stats.csv", {"kind": "stat_type", "match_id": "match_id", "map": "map_name", "team_1": "team1", "team_2": "team2", "team": "player_team", "winner": "map_winner", "date": "match_date", "event": "event_name", "kills": "k", "deaths": "d", "assists": "a"} | _NAMES | {"player": "player_name", "hs": "hs_percent"})
    _csv(g[3].selectExpr("concat('m', k) AS match_id", "map AS map_name", "if(k % 4 = 0, NULL, concat(s1, '-', s2)) AS score"), f"{root}/scores.csv", {c: c for c in ("match_id", "map_name", "score")})
    told = g[4].selectExpr("concat('m', k) AS match_id", "concat('g', k) AS game_id", "map", "event", "date", "winner AS map_winner", "inline(array(named_struct('team', team_1, 'score', if(k % 4 = 0, NULL, s1)), named_struct('team', team_2, 'score', if(k % 4 = 0, NULL, s2))))")
    _csv(told, f"{root}/maps.csv", {c: c for c in ("match_id", "game_id", "map", "team", "score", "map_winner")})
    _csv(e[4].withColumn("game_id", F.concat(F.lit("g"), "k")), f"{root}/players.csv", {"game_id": "game_id", "team": "team", "kills": "kills", "deaths": "deaths", "assists": "assists"} | _NAMES | {"hs": "hs_pct", "fk": "fb"})
    _csv(told.select("match_id", "event", "date").distinct(), f"{root}/details.csv", {c: c for c in ("match_id", "event", "date")})

    read = [
        feeds.tour(spark, root, "tour", _SOURCES[0]),
        feeds.flat_matches(spark, f"{root}/flat.csv", _SOURCES[1]),
        feeds.single_event(spark, f"{root}/event.csv", _SOURCES[2], "Champions 2021"),
        feeds.event_stats(spark, f"{root}/stats.csv", f"{root}/scores.csv", _SOURCES[3]),
        feeds.scraped(spark, f"{root}/maps.csv", f"{root}/players.csv", f"{root}/details.csv", _SOURCES[4]),
    ]
    maps = table(spark, sf, "orders").where("o_orderpriority <> '4-NOT SPECIFIED'").selectExpr("o_orderpriority AS raw", "substring(o_orderpriority, 3) AS name").distinct()
    agents = table(spark, sf, "part").where("p_brand <> 'Brand#13'").groupBy("p_brand").agg(F.min("p_type").alias("role")).selectExpr("p_brand AS raw", "upper(p_brand) AS name", "role")
    return feeds.conform_all(read, maps, agents, _PATCHES, size=2)


_G = """g0 AS (SELECT o_orderkey AS k, o_orderkey % 5 AS layout, year(o_orderdate) AS folder_year, o_orderpriority AS priority,
    concat(chr(CAST(65 + o_custkey % 20 AS INTEGER)), o_custkey) AS team_1,
    concat(CASE WHEN o_orderkey % 7 = 0 THEN 'É' ELSE chr(CAST(65 + o_orderkey % 23 AS INTEGER)) END, 'x', o_orderkey % 50) AS team_2,
    CAST(floor(o_totalprice) AS BIGINT) % 14 AS s1, o_custkey % 14 AS s2,
    CASE WHEN o_orderkey % 3 = 0 THEN concat('Cup 20', 10 + o_orderkey % 10) ELSE 'Open' END AS event,
    concat('Patch ', o_orderkey % 9, '.0 game ', o_orderkey) AS date FROM orders),
  g1 AS (SELECT k, layout, team_1, team_2, priority,
    CASE layout WHEN 0 THEN 'kaggle_tour' WHEN 1 THEN 'kaggle_flat' WHEN 2 THEN 'kaggle_event' WHEN 3 THEN 'kaggle_stats' ELSE 'vlrgg_scrape' END AS source,
    CASE layout WHEN 0 THEN concat(folder_year, '|order ', k) WHEN 1 THEN concat(date, '|', team_1, '|', team_2) WHEN 2 THEN concat('m', k, '|g', k) WHEN 3 THEN concat('m', k) ELSE concat('g', k) END AS game,
    CASE layout WHEN 1 THEN '' WHEN 2 THEN 'Champions 2021' ELSE event END AS event, CASE WHEN layout IN (0, 2) THEN '' ELSE date END AS date,
    CASE WHEN layout = 0 THEN folder_year END AS folder_year,
    CASE WHEN layout < 3 OR k % 4 <> 0 THEN s1 END AS s1, CASE WHEN layout < 3 OR k % 4 <> 0 THEN s2 END AS s2,
    CASE WHEN layout >= 3 THEN CASE k % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END END AS won_first FROM g0),
  g2 AS (SELECT *, substr(priority, 3) AS map, COALESCE(s1 <> s2, FALSE) AS told,
    COALESCE(TRY_CAST(regexp_extract(event, '(20[12]\\d)', 1) AS INTEGER), TRY_CAST(regexp_extract(date, '(20[12]\\d)', 1) AS INTEGER)) AS named,
    CASE TRY_CAST(regexp_extract(date, 'Patch (\\d+)\\.\\d+', 1) AS INTEGER) WHEN 1 THEN 2021 WHEN 2 THEN 2022 WHEN 3 THEN 2022 WHEN 4 THEN 2023 WHEN 5 THEN 2024 END AS patch
    FROM g1 WHERE priority <> '4-NOT SPECIFIED'),
  g3 AS (SELECT k, source, game, map, team_1, team_2, COALESCE(named, patch, folder_year) AS year,
    CASE WHEN named IS NOT NULL THEN 'event' WHEN patch IS NOT NULL THEN 'patch' ELSE 'unknown' END AS year_source,
    CAST(CASE WHEN told THEN s1 WHEN won_first = 1 THEN 13 WHEN won_first = 0 THEN 5 END AS DOUBLE) AS p1,
    CAST(CASE WHEN told THEN s2 WHEN won_first = 1 THEN 5 WHEN won_first = 0 THEN 13 END AS DOUBLE) AS p2 FROM g2),
  g4 AS (SELECT k, source, game, map, year, year_source, least(team_1, team_2) AS team_a, greatest(team_1, team_2) AS team_b, team_1 < team_2 AS straight,
    CASE WHEN team_1 < team_2 THEN p1 ELSE p2 END AS score_a, CASE WHEN team_1 < team_2 THEN p2 ELSE p1 END AS score_b FROM g3 WHERE p1 <> p2),
  role AS (SELECT p_brand, min(p_type) AS role FROM part WHERE p_brand <> 'Brand#13' GROUP BY p_brand),
  line AS (SELECT l_orderkey AS k, l_linestatus = 'F' AS first, l_suppkey AS s, l_partkey AS p, min(l_quantity) AS q, min(l_linenumber) AS n, min(l_extendedprice) AS price FROM lineitem GROUP BY ALL),
  e AS (SELECT line.*, upper(p_brand) AS agent, role, concat('S', s, '/', p) AS player, count(*) OVER (PARTITION BY k, first) AS c FROM line JOIN part ON p = p_partkey JOIN role USING (p_brand)),
  x AS (SELECT e.*, g4.* EXCLUDE (k), CASE WHEN first = straight THEN 'a' ELSE 'b' END AS side,
    substr(sha1(concat(source, '|', game, '|', map, '|', map)), 1, 16) AS match_key FROM e JOIN g4 USING (k) WHERE c = 2),
  full_ AS (SELECT k FROM x GROUP BY k HAVING count(*) = 4)"""


@query(f"""WITH {_G} SELECT match_key, source, concat(source, '/', game) AS provenance, year, year_source, map, team_a, team_b, score_a, score_b, CASE WHEN score_a > score_b THEN 1 ELSE 0 END AS label,
  substr(sha1(concat(COALESCE(CAST(year AS VARCHAR), ''), '|', least(lower(team_a), lower(team_b)), '|', greatest(lower(team_a), lower(team_b)), '|', map, '|', CAST(least(score_a, score_b) AS INTEGER), '|', CAST(greatest(score_a, score_b) AS INTEGER))), 1, 24) AS dedup_key,
  string_agg(agent, '|' ORDER BY agent) FILTER (WHERE side = 'a') AS comp_a, string_agg(agent, '|' ORDER BY agent) FILTER (WHERE side = 'b') AS comp_b
  FROM x SEMI JOIN full_ USING (k) GROUP BY ALL""")
def o02_o05_feed_matches(spark, sf):
    """Every order as a game, by way of files in its layout: conformed matches and both compositions."""
    games, _, comps = _conformed(spark, sf)
    wide = comps.groupBy("match_key").agg(*(F.max(F.when(F.col("side") == s, F.col("comp"))).alias(f"comp_{s}") for s in "ab"))
    return games.join(wide, "match_key").select("match_key", "source", "provenance", "year", "year_source", "map", "team_a", "team_b", "score_a", "score_b", "label", "dedup_key", "comp_a", "comp_b")


@query(f"""WITH {_G} SELECT match_key, side, CAST(row_number() OVER (PARTITION BY k, side ORDER BY player) AS INTEGER) AS player_slot, player, agent, role, source,
  least(floor(q) / greatest(n, 1), 10.0::DOUBLE) AS kd, CASE WHEN s % 100 > 1 THEN (s % 100) / 100.0::DOUBLE ELSE (s % 100)::DOUBLE END AS kast, CASE WHEN p % 100 > 1 THEN (p % 100) / 100.0::DOUBLE ELSE (p % 100)::DOUBLE END AS hs,
  floor(price)::DOUBLE AS adr, (s % 10)::DOUBLE AS assists, (s % 5)::DOUBLE AS fk, (p % 5)::DOUBLE AS fd, 200.0::DOUBLE AS acs FROM x SEMI JOIN full_ USING (k)""")
def o03_o04_feed_players(spark, sf):
    """The players of those games: slots, roles and statistics, whatever the layout calls them."""
    return _conformed(spark, sf)[1]


@query(f"WITH {M} SELECT split, CAST(count(*) AS BIGINT) AS n, CAST(sum(team) AS BIGINT) AS teams, CAST(count(*) AS BIGINT) AS n_csv, CAST(sum(team) AS BIGINT) AS teams_csv FROM (SELECT team, CASE WHEN year < 2000 THEN 'train' ELSE 'test' END AS split FROM m WHERE year IS NOT NULL) GROUP BY split")
def o07_split_sinks(spark, sf):
    """Split matches written as Parquet by split and as CSV, and both read back."""
    root = shared_dir(spark)
    rows = splits.chrono_split(matches(spark, sf), "year", test_from=2000).select("match_key", "team", "split")
    tables.write_splits(rows, f"{root}/parquet")
    tables.write_csv(rows, f"{root}/csv")
    kept = spark.read.schema(rows.schema).parquet(f"{root}/parquet").groupBy("split").agg(F.count("*").alias("n"), F.sum("team").alias("teams"))
    text = tables.read_csv(spark, f"{root}/csv", rows.columns).groupBy("split").agg(F.count("*").alias("n_csv"), F.sum(F.col("team").cast("long")).alias("teams_csv"))
    return kept.join(text, "split")


@query(f"""WITH {M} SELECT map, CAST(cutoff_year AS INTEGER) AS cutoff_year, CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS ids, CAST(count_if(label = 1) AS BIGINT) AS wins, round(avg(CASE WHEN label = 1 THEN 0.75 ELSE 0.25 END), 6) AS probability,
  CAST(min(team) AS VARCHAR) AS first_player, TRUE AS timed FROM (SELECT *, year + 1 AS cutoff_year FROM m WHERE label IS NOT NULL) GROUP BY map, cutoff_year""")
def o09_o95_history_store(spark, sf):
    """Every decided match saved as a prediction in two appends, each row with an id and a time of its own, then read back by its request."""
    path = f"{shared_dir(spark)}/history"
    tables.init_history(spark, path)
    rows = matches(spark, sf).where("label is not null").selectExpr(
        "map", "cast(year + 1 AS int) AS cutoff_year", "if(label = 1, 'a', 'b') AS winner", "if(label = 1, 0.75D, 0.25D) AS probability",
        "to_json(struct(array(struct(cast(team AS string) AS player, map AS agent)) AS team_a, array(struct('none' AS player, map AS agent)) AS team_b)) AS request_json", "to_json(struct(label)) AS response_json", "match_key % 2 AS part",
    )
    for i in range(2):
        tables.append_history(rows.where(F.col("part") == i).drop("part"), path)
    store = tables.request_lists(spark.read.parquet(path))
    first = F.min(F.col("players_a")[0].cast("long")).cast("string")
    return store.groupBy("map", "cutoff_year").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count_if(F.col("winner") == "a").alias("wins"), F.round(F.avg("probability"), 6).alias("probability"), first.alias("first_player"), F.bool_and(F.col("created_at").isNotNull()).alias("timed"))


@query("SELECT c_custkey, c_name AS name, 'NEW' AS segment, 'gold' AS tier, CAST(3 AS INTEGER) AS n_entries FROM customer")
def o149_patched_documents(spark, sf):
    """A document a customer, written as JSON, read back and merged with a patch that replaces one entry and adds another."""
    path = f"{shared_dir(spark)}/documents"
    table(spark, sf, "customer").select("c_custkey", F.create_map(F.lit("name"), "c_name", F.lit("segment"), "c_mktsegment").alias("doc")).write.json(path)
    docs = tables.patched(spark.read.schema("c_custkey long, doc map<string,string>").json(path), {"segment": "NEW", "tier": "gold"})
    return docs.select("c_custkey", *(F.col("doc")[k].alias(k) for k in ("name", "segment", "tier")), F.size("doc").alias("n_entries"))
