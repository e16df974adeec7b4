import pytest
from pyspark.sql import functions as F

from matchloom.functions import normalize as n
from matchloom.operators import audit, conform, features, insights, metrics, splits


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items())) if values else spark.range(1)
    return row.select(column.alias("v")).first().v


@pytest.mark.parametrize("raw, want", [("75%", 0.75), ("0.75", 0.75), ("1", 1.0), ("x", None), ("", None), (None, None)])
def test_percent(spark, raw, want):
    assert one(spark, n.percent(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("event, date, want", [("VCT 2023", None, (2023, "event")), ("Masters", "Patch 8.05", (2024, "patch")), ("Patch 8.05", None, (None, "unknown")), ("x", "2021-05-06", (2021, "event")), (None, "Patch 99.1", (None, "unknown")), ("VCT 2023", "Patch 8.05", (2023, "event"))])
def test_year_cascade(spark, event, date, want):
    y, s = n.year_and_source(F.lit(event).cast("string"), F.lit(date).cast("string"), {8: 2024})
    assert tuple(spark.range(1).select(y, s).first()) == want


@pytest.mark.parametrize("kills, deaths, want", [("10", "4", 2.5), ("10", "x", 0.0), ("x", "2", 0.0), (None, "2", 0.0), ("10", None, 10.0), ("10", "", 10.0), ("10", "0", 10.0)])
def test_kill_ratio(spark, kills, deaths, want):
    assert one(spark, n.kill_ratio(F.lit(kills).cast("string"), F.lit(deaths).cast("string"))) == want


def test_canonical_swap(spark):
    df = spark.createDataFrame([("Zed", "Abe", 13, 5)], "a string, b string, sa int, sb int")
    got = conform.canonical_sides(conform.decisive(df, "sa", "sb"), [("a", "b"), ("sa", "sb")], "label").first()
    assert tuple(got) == ("Abe", "Zed", 5, 13, 0)


def test_forfeits(spark):
    df = spark.createDataFrame([(13, 0), (13, 5), (None, 3)], "a int, b int")
    assert sorted(r.b for r in conform.without_forfeits(df, "a", "b").collect()) == [3, 5]


def test_source_priority(spark):
    df = spark.createDataFrame([("k1", "d", "scraped"), ("k2", "d", "curated")], "k string, d string, source string")
    rank = F.when(F.col("source") == "curated", 0).otherwise(1)
    assert [r.k for r in conform.source_dedup(df, "k", "d", rank).collect()] == ["k2"]


def test_gate_needs_both_sides(spark):
    rows = [(1, s) for s in "aabb"] + [(2, s) for s in "aab"]
    p = spark.createDataFrame(rows, "m int, side string")
    assert [r.m for r in conform.full_sides(p, "m", "side", 2).collect()] == [1]


def test_entropy(spark):
    assert one(spark, n.entropy([F.lit(5), F.lit(0), F.lit(0), F.lit(0)])) == 0
    assert one(spark, n.entropy([F.lit(2), F.lit(1), F.lit(1), F.lit(1)])) == pytest.approx(0.960964, abs=1e-6)


def test_similarity(spark):
    lits = lambda v: [F.lit(float(x)) for x in v]
    assert one(spark, n.vector_similarity(lits((1, 2, 1, 1)), lits((1, 2, 1, 1)))) == 1.0
    assert one(spark, n.vector_similarity(lits((1, 2, 1, 1)), lits((2, 1, 1, 1)))) == pytest.approx(0.8)


def test_boundary_year(spark):
    df = spark.createDataFrame([(y, 100 * y + i) for y, k in ((2021, 50), (2022, 30), (2023, 20)) for i in range(k)], "year int, match_key int")
    assert splits.boundary_year(df, "year", "match_key").first()[0] == 2023
    many = df.unionByName(df.where("match_key = 202300").crossJoin(spark.range(500)).drop("id"))  # one match told often is one match
    assert splits.boundary_year(many, "year", "match_key").first()[0] == 2023
    for rows, year in ((df.where("year = 2021"), None), (df, 2021), (df, 2024)):
        with pytest.raises(ValueError):
            splits.chrono_split(rows, "year", test_from=year)


def test_support(spark):
    df = spark.createDataFrame([("x", 1)] * 9 + [("y", 0)] * 10, "agent string, won int")
    assert [(r.agent, r.n) for r in insights.group_rate(df, ["agent"], "won").collect()] == [("y", 10)]


def test_equal_width_bins_put_edges_where_pandas_does(spark):
    import pandas as pd

    x = [round(i / 7, 3) for i in range(200)] + [0.0, 10.0, 20.0]
    want = pd.cut(pd.Series(x), 10).value_counts(sort=False).tolist()
    got = {r.bin: r.n for r in insights.equal_width_rate(spark.createDataFrame([(v, 1) for v in x], "x double, won int"), "x", "won").collect()}
    assert [got.get(i + 1, 0) for i in range(10)] == want


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.9, 1), (0.1, 0)], "s double, y int")
    assert metrics.auc(df, "s", "y").first().auc == pytest.approx(0.875)


def test_auc_of_many_scores_equals_ranks(spark):
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(3)
    x = pd.DataFrame({"s": np.concatenate([rng.normal(size=3000), np.repeat(0.1, 500), rng.normal(size=300)]), "y": rng.integers(0, 2, 3800), "g": rng.integers(0, 3, 3800)})

    def area(d):
        r, pos = d.s.rank(), d.y == 1
        return (r[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())

    df = spark.createDataFrame(x)
    assert metrics.auc(df, "s", "y").first().auc == pytest.approx(area(x), abs=1e-12)
    assert {r.g: round(r.auc, 10) for r in metrics.auc(df, "s", "y", ["g"]).collect()} == {g: round(area(d), 10) for g, d in x.groupby("g")}


def test_running_sums_in_parts(spark):
    rows = [(g, float(i), i) for g in (None, "a", "b") for i in range(200)]
    df = spark.createDataFrame(rows, "g string, x double, v int")
    for down in (False, True):
        for r in metrics.running(df, ["g"], "x", ["v"], descending=down, parts=7).collect():
            assert r.before_v == sum(range(r.v + 1, 200) if down else range(r.v))


def test_thinned_curve_takes_numpys_places(spark):
    import numpy as np

    for n, points in ((1000, 260), (1000, 50), (261, 260), (5, 50)):
        df = spark.range(n).select(F.col("id").alias("place"))
        got = sorted(r.place for r in metrics.thinned(df, points).collect())
        assert got == (sorted(set(np.linspace(0, n - 1, points, dtype=int).tolist())) if n > points else list(range(n)))


@pytest.mark.parametrize("rows", [2, 30, 300, 1500])
def test_labels_move_at_every_size(spark, rows):
    df = spark.range(rows).select("id", F.col("id").alias("y"))
    got = splits.shuffled_labels(df, "id", "y").collect()
    assert sorted(r.y for r in got) == list(range(rows)) == sorted(r.id for r in got)
    assert sum(r.id == r.y for r in got) <= 6  # a random permutation leaves one in its place
    pairs = spark.createDataFrame([(None, 1), (None, 2), (5, 3), (5, 4)], "id int, y int")
    assert sorted((r.id or 0, r.y) for r in splits.shuffled_labels(pairs, "id", "y").select("id", "y").collect())[0][0] == 0


def test_numbers_have_no_gaps_whatever_the_groups(spark):
    df = spark.range(700).select("id")
    for bits in (0, 3, 10):
        got = splits.numbered(df, splits.stable_hash(F.col("id")), "n", bits).collect()
        assert sorted(r.n for r in got) == list(range(700))
        order = [r.id for r in sorted(got, key=lambda r: r.n)]
        assert bits == 0 or order == first
        first = order


def test_lineup_rules(spark):
    def lineup(players, agents):
        return [{"player": p, "agent": a} for p, a in zip(players, agents)]

    schema = "lineup_a array<struct<player:string,agent:string>>, lineup_b array<struct<player:string,agent:string>>"
    good, other = lineup("abcde", "vwxyz"), lineup("fghij", "vwxyz")
    rows = [(good, other), (good[:4], other), (good, good), (lineup("abcde", "vvxyz"), other), (None, other)]
    ok = [r.ok for r in spark.createDataFrame(rows, schema).select(audit.valid_lineups().alias("ok")).collect()]
    assert ok == [True, False, False, False, False]
    spelled = [(lineup("abcde", ["KAY/O", "KAYO ", "x", "y", "z"]), other), (lineup(["A ", "b", "c", "d", "e"], "vwxyz"), lineup("afghi", "vwxyz")), (lineup("abcde", ["?", "?", "x", "y", "z"]), other)]
    check = lambda **k: [r.ok for r in spark.createDataFrame(spelled, schema).select(audit.valid_lineups(**k).alias("ok")).collect()]
    assert check() == [False, False, True] and check(agents=["x", "y", "z", "v", "w"]) == [True, False, True]


def test_balance_rules(spark):
    def codes(duelists, initiators, controllers, sentinels):
        w = spark.range(1).select(audit.balance_warnings(*map(F.lit, (duelists, initiators, controllers, sentinels))).alias("w")).first().w
        return [(x.code, x.severity) for x in w]

    assert codes(1, 1, 2, 1) == [] and codes(3, 1, 1, 0) == []
    assert codes(0, 0, 0, 3) == [("no_controller", "high"), ("too_many_sentinel", "high"), ("no_duelist", "medium"), ("no_initiator", "medium")]
    assert codes(4, 1, 0, 0) == [("no_controller", "high"), ("too_many_duelist", "low")]


def test_forbidden_names():
    bad = ["a_kills", "h2h_wr", "map_prior_wr", "a_p1_kd", "round_diff", "team_a_id", "recent5_wr", "a_score"]
    assert features.forbidden_names([*bad, "prior_kd"]) == bad
    maps = [f"m{i}" for i in range(12)]
    assert features.forbidden_names(features.advanced_contract(maps)) == []


def test_gate_has_ten_checks():
    trust = {"checks": dict.fromkeys(("feature_count", "no_forbidden_names", "sources_allowed", "no_overlap", "train_before_test"), True)}
    meta = {"feature_contract": "advanced", "n_features": 179, "weights": [2.0, 3.0, 0.1]}
    good = audit.advanced_gate(trust, {"rf": 179}, meta, 0, 3, 0.701)
    assert len(good["checks"]) == 10 and good["verdict"] == "passed" and good["checks"]["case_collisions"] == "warned" and good["exit_code"] == 0
    assert audit.advanced_gate(trust, {"rf": 178}, meta, 0, 0, 0.701)["failures"] == ["model_width"]
    assert audit.advanced_gate(trust, {"rf": 179}, meta, 0, 0, 0.61)["verdict"] == "insufficient"
    assert audit.advanced_gate(trust, {"rf": 179}, meta | {"weights": [1, 0, 1]}, 2, 0, None)["failures"] == ["weights", "perspective_flips", "auc_below_gate"]


def test_verdict_order():
    assert audit.final_verdict([], 0.7)["exit_code"] == 0
    assert audit.final_verdict(["no_overlap"], 0.7)["verdict"] == "untrusted"
    assert audit.final_verdict([], 0.5)["failures"] == ["auc_below_gate"]


def test_explanations():
    values = {"a_prior_games_mean": 30.0, "b_prior_games_mean": 10.4, "a_prior_kd_mean": 0.9, "b_prior_kd_mean": 1.15, "a_prior_kast_mean": 0.75, "b_prior_kast_mean": 0.7, "a_synergy_mean": 1.0, "b_synergy_mean": 1.0}
    ranked = ["a_prior_games_mean", "a_prior_kd_mean", "b_prior_kd_mean", "map_bind", "a_synergy_mean", "a_prior_kast_mean"]
    got = audit.explanations(values, ranked)
    assert [x["text"] for x in got] == ["Team A leads by 20 games of earlier years", "Team B leads in mean K/D by 0.25", "Team A leads in KAST by 5%"]
    assert got[0]["feature"] == "prior_games" and len(audit.explanations(values, ranked, 2)) == 2


def test_vector_message(spark):
    names, rate = ["duelists", "controllers"], F.lit(0.535)
    lits = lambda v: [F.lit(x) for x in v]
    assert one(spark, audit.vector_message(names, lits((2, 1)), lits((1, 2)), rate)) == "1 more duelists, 1 fewer controllers (nearest composition wins 54%)"
    assert one(spark, audit.vector_message(names, lits((1, 1)), lits((1, 1)), rate)).startswith("as the composition")


def test_player_groups_need_both_teams(spark):
    scores = spark.createDataFrame([(1, "x", "y"), (2, "x", "z"), (3, "y", "x")], "game int, one string, two string")
    players = spark.createDataFrame([(g, t, f"{t}{i}") for g, t, n in ((1, "x", 2), (1, "y", 3), (2, "x", 2), (2, "z", 1), (3, "x", 2)) for i in range(n)], "game int, team string, player string")
    got = conform.with_player_groups(scores, players, ["game"], "one", "two", "team", ["player"], 2).collect()
    assert [(r.game, [p.player for p in r.players_a], [p.player for p in r.players_b]) for r in got] == [(1, ["x0", "x1"], ["y0", "y1", "y2"])]


def test_nearest_prefers_more_games(spark):
    df = spark.createDataFrame([("x", 3, 0.4, 1.0), ("y", 9, 0.5, 1.0), ("z", 1, 0.9, 5.0)], "comp string, n int, win_rate double, u double")
    assert insights.nearest(df, ["u"], [1.0]).first().comp == "y"


def test_rejects_name_the_first_failure(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, -1)], "id int, x int")
    ok, bad = conform.rejects(df, [("missing", F.col("x").isNull()), ("negative", F.col("x") < 0)])
    assert [r.id for r in ok.collect()] == [2]
    assert {r.id: r.reject_reason for r in bad.collect()} == {1: "missing", 3: "negative"}
