"""Each of the five layouts, written as files, comes out as the same conformed tables."""

import csv
import re

import pytest

from matchloom.sources import feeds

TEAMS = {"Zed": ["z1", "z2", "z3", "z4", "z5"], "Abe": ["a1", "a2", "a3", "a4", "a5"]}
AGENTS = ["Alpha", "Beta", "GA/MMA", "Delta", "Eps"]


def write(path, header, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", newline="", encoding="latin-1") as f:
        csv.writer(f).writerows([header, *rows])
    return str(path)


@pytest.fixture(scope="module")
def dims(spark):
    maps = spark.createDataFrame([("bind", "Bind"), ("haven", "Haven")], "raw string, name string")
    agents = spark.createDataFrame([(a.lower(), a, "duelist" if a == "Alpha" else "sentinel") for a in AGENTS], "raw string, name string, role string")
    return maps, agents, {8: 2024}


def people(stats=("20", "10", "4", "75%", "150", "30%", "3", "2", "230")):
    for team, names in TEAMS.items():
        for p, agent in zip(names, AGENTS):
            yield team, p, "gamma" if agent == "GA/MMA" and team == "Abe" else agent.upper(), stats


def check(tables, year, source, **more):
    matches, players, comps = (t.collect() for t in tables)
    assert [(m.team_a, m.team_b, m.score_a, m.score_b, m.label, m.map, m.year, m.source) for m in matches] == [("Abe", "Zed", 5.0, 13.0, 0, "Bind", year, source)]
    assert {(p.side, p.player_slot, p.player) for p in players} == {(s, i + 1, p) for s, t in (("a", "Abe"), ("b", "Zed")) for i, p in enumerate(TEAMS[t])}
    assert {(p.kd, p.kast, p.adr, p.assists, p.source) for p in players} == {(2.0, 0.75, 150.0, 4.0, source)}
    assert {(p.agent, p.role) for p in players} == {(a, "duelist" if a == "Alpha" else "sentinel") for a in AGENTS}
    assert {(x.side, x.comp) for x in comps} == {(s, "|".join(sorted(AGENTS))) for s in "ab"}
    assert len(matches[0].match_key) == 16 and len(matches[0].dedup_key) == 24
    return matches[0]


@pytest.fixture(scope="module")
def spelled(dims, spark):
    """The agents' dimension with another spelling of one of them."""
    maps, agents, patches = dims
    return maps, agents.union(spark.createDataFrame([("gamma", "GA/MMA", "sentinel")], agents.schema)), patches


def test_tour_folders(spark, tmp_path, spelled):
    root = tmp_path / "vct_2023" / "matches"
    write(root / "maps_scores.csv", ["Tournament", "Match Name", "Map", "Team A", "Team A Score", "Team B", "Team B Score"], [["Masters", "Zed vs Abe", "bind", "Zed", 13, "Abe", 5], ["Masters", "Zed vs Abe", "Haven", "Zed", 7, "Abe", 7], ["Masters", "Zed vs Abe", "nowhere", "Zed", 9, "Abe", 7]])
    rows = [[s, "Zed vs Abe", m, t, p, a, *x] for m in ("Bind", "Haven") for s in ("both", "attack") for t, p, a, x in people()]
    write(root / "overview.csv", ["Side", "Match Name", "Map", "Team", "Player", "Agents", "K", "Deaths", "A", "KAST%", "ADR", "HS%", "FK", "FD", "ACS"], rows)
    check(feeds.conform(feeds.tour(spark, str(tmp_path), "vct", "kaggle_tour"), *spelled), 2023, "kaggle_tour")


def test_flat_file(spark, tmp_path, spelled):
    rows = [["2022-05-01 10:00", "BIND", "Zed", "Abe", 13, 5, t, p, a, *x] for t, p, a, x in people()]
    path = write(tmp_path / "flat.csv", ["match-datetime", "map", "team1", "team2", "team1-score", "team2-score", "player-team", "player-name", "agent", "k", "d", "a", "kast", "adr", "hs", "fk", "fd", "acs"], rows)
    check(feeds.conform(feeds.flat_matches(spark, path, "kaggle_flat"), *spelled), 2022, "kaggle_flat")


def test_single_event(spark, tmp_path, spelled):
    rows = [["m1", "g1", "Bind", t, "Abe" if t == "Zed" else "Zed", *((13, 5) if t == "Zed" else (5, 13)), p, a, *x] for t, p, a, x in people()]
    path = write(tmp_path / "event.csv", ["match_id", "game_id", "map", "team", "opponent", "score_team", "score_opp", "player", "agent", "kill", "death", "assist", "kast%", "adr", "hs%", "fk", "fd", "acs"], rows)
    check(feeds.conform(feeds.single_event(spark, path, "kaggle_event", "Champions 2021"), *spelled), 2021, "kaggle_event")


@pytest.mark.parametrize("score, scores", [("13-5", True), ("", False)])
def test_event_stats(spark, tmp_path, spelled, score, scores):
    """Without a score the winner tells the sides apart."""
    rows = [[k, "m1", "Bind", "Zed", "Abe", t, "Zed", "Patch 8.05", "Masters", p, a, *x] for k in ("map", "overall") for t, p, a, x in people()]
    stats = write(tmp_path / "s.csv", ["stat_type", "match_id", "map_name", "team1", "team2", "player_team", "map_winner", "match_date", "event_name", "player_name", "agent", "k", "d", "a", "kast", "adr", "hs_percent", "fk", "fd", "acs"], rows)
    maps = write(tmp_path / "m.csv", ["match_id", "map_name", "score"], [["m1", "Bind", score]])
    m = check(feeds.conform(feeds.event_stats(spark, stats, maps, "kaggle_stats"), *spelled), 2024, "kaggle_stats")
    assert m.year_source == "patch"


def test_scraped_and_all_together(spark, tmp_path, spelled):
    maps = write(tmp_path / "maps.csv", ["match_id", "game_id", "map", "team", "score", "map_winner"], [["m1", "g1", "Bind", "Zed", 13, "Zed"], ["m1", "g1", "Bind", "Abe", 5, "Zed"], ["m1", "g2", "Bind", "Zed", 13, "Zed"]])
    players = write(tmp_path / "p.csv", ["game_id", "team", "player", "agent", "kills", "deaths", "assists", "kast", "adr", "hs_pct", "fb", "fd", "acs"], [["g1", t, p, a, *x] for t, p, a, x in people()] + [["g2", "Zed", "z1", "Alpha", *["1"] * 9]])
    details = write(tmp_path / "d.csv", ["match_id", "event", "date"], [["m1", "Cup", "2025-01-02"]])
    feed = feeds.scraped(spark, maps, players, details, "vlrgg_x")
    check(feeds.conform(feed, *spelled), 2025, "vlrgg_x")
    every, people_, comps = feeds.conform_all([feed, feeds.Feed("kaggle_y", feed.games, feed.entries)], *spelled)
    assert sorted(r.source for r in every.collect()) == ["kaggle_y", "vlrgg_x"] and people_.count() == 20 and comps.count() == 4
    assert every.select("dedup_key").distinct().count() == 1  # so the cross-source dedup keeps one


def test_entries_move_once_to_their_match(spark, capsys):
    stats = ", ".join(f"'1' as {s}" for s in feeds.STATS)
    games = spark.sql("select 'g1' as game, 'Cup 2021' as event, null as date, null as year, 'x' as map, 't1' as team_1, 't2' as team_2, '13' as score_1, '5' as score_2, null as winner")
    entries = spark.sql(f"select 'g1' as game, 'x' as map, t as team, concat(t, 'p', i) as player, 'a1' as agent, {stats} from values ('t1', 1), ('t1', 2), ('t2', 1), ('t2', 2), ('t3', 1) v(t, i)")
    maps, agents = spark.sql("select 'x' as raw, 'X' as name"), spark.sql("select 'a1' as raw, 'A1' as name, 'duelist' as role")
    _, players, _ = feeds.conform_all([feeds.Feed("s", games, entries)], maps, agents, {}, size=2)
    players.explain("formatted")
    moved = re.findall(r"\) Exchange\s*\nInput \[\d+\]: \[(.*?)\]\n", capsys.readouterr().out)
    assert sum("kast#" in columns for columns in moved) == 1, moved
    assert [(r.side, r.player_slot, r.player) for r in players.orderBy("side", "player_slot").collect()] == [("a", 1, "t1p1"), ("a", 2, "t1p2"), ("b", 1, "t2p1"), ("b", 2, "t2p2")]
