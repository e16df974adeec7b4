"""Hand-computed histories: expected values follow from the definitions in the docstrings."""

import pytest

from matchloom.operators import features, history


def facts(spark, rows):
    return spark.createDataFrame(rows, "player string, year int, x double")


def by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_first_year_has_no_history(spark):
    h = by(history.shrunk_history(facts(spark, [("p", 2021, 2.0)]), ["player"], "year", ["x"]), "player", "year")
    assert h["p", 2021].prior_n == 0 and h["p", 2021].x_mean == 0.0


def test_rows_of_one_year_do_not_see_each_other(spark):
    h = by(history.prior_stats(facts(spark, [("p", 2021, 1.0), ("p", 2022, 5.0), ("p", 2022, 7.0)]), ["player"], "year", ["x"]), "player", "year")
    assert (h["p", 2022].prior_n, h["p", 2022].prior_sum_x) == (1, 1.0)


def test_shrinkage_and_cliff(spark):
    rows = [("p", 2021, 2.0), ("q", 2021, 0.0), ("p", 2022, 9.0), ("new", 2022, 9.0)]
    h = by(history.shrunk_history(facts(spark, rows), ["player"], "year", ["x"]), "player", "year")
    assert h["p", 2022].x_mean == pytest.approx((2 + 5 * 1) / 6)
    assert h["new", 2022].x_mean == 0.0


def test_gap_years_and_windows(spark):
    f = facts(spark, [("p", 2021, 2.0), ("p", 2024, 3.0)])
    assert by(history.prior_stats(f, ["player"], "year", ["x"]), "year")[2024,].prior_n == 1
    assert by(history.prior_stats(f, ["player"], "year", ["x"], window=2), "year")[2024,].prior_n == 0


def test_later_rows_change_nothing_earlier(spark):
    f = facts(spark, [("p", 2021, 2.0), ("p", 2022, 3.0)])
    more = f.union(facts(spark, [("p", 2022, 100.0), ("p", 2023, 50.0)]))
    a, b = (by(history.shrunk_history(x, ["player"], "year", ["x"]), "year")[2022,].x_mean for x in (f, more))
    assert a == b


def test_serving_state_equals_history_of_a_new_year(spark):
    f = facts(spark, [("p", 2021, 2.0), ("q", 2021, 0.0), ("p", 2022, 4.0)])
    s = by(history.state_before(f, ["player"], "year", ["x"], 2023), "player")
    assert s["p",].prior_n == 2 and s["p",].x_mean == pytest.approx((6 + 5 * 2.0) / 7)
    assert ("new",) not in s


def test_outcomes_without_a_label_do_not_count(spark):
    o = spark.createDataFrame([("t", 2021, None, 3.0), ("t", 2021, 1, 4.0), ("t", 2022, 0, 1.0)], "team string, year int, won int, margin double")
    h = by(history.outcome_history(o, ["team"], "year"), "year")
    assert (h[2021,].prior_n, h[2021,].success, h[2021,].margin) == (0, 0.5, 0.0)
    assert (h[2022,].prior_n, h[2022,].success, h[2022,].margin) == (1, 1.0, 4.0)


def test_form_takes_the_newest_of_earlier_years(spark):
    games = [("t", 2021, i, int(i >= 7), 1.0) for i in range(12)] + [("t", 2023, 100, 0, 0.0)]
    o = spark.createDataFrame(games, "team string, year int, k int, won int, margin double")
    f = by(history.last_n_form(o, ["team"], "year", ["k"]), "year")
    assert (f[2023,].form5, f[2023,].form10) == (1.0, 0.5)
    assert (f[2021,].form5, f[2021,].form10_margin) == (0.5, 0.0)


def test_form_over_several_years(spark):
    games = [("t", 2019, 1, 1, 1.0), ("t", 2020, 2, 0, 2.0), ("t", 2021, 3, None, 9.0), ("t", 2022, 4, 1, 4.0)]
    f = by(history.last_n_form(spark.createDataFrame(games, "team string, year int, k int, won int, margin double"), ["team"], "year", ["k"], sizes=(1, 2)), "year")
    assert (f[2021,].form1, f[2021,].form2) == (0.0, 0.5)
    assert (f[2022,].form1, f[2022,].form2_margin) == (0.0, 1.5)


def team_rows(spark, rows):
    return spark.createDataFrame(rows, "team string, year int, match int, side string, player string")


def test_pairs_of_a_stable_five(spark):
    five = "abcde"
    rows = [("t", y, m, "a", p) for y, m in ((2021, 1), (2022, 2)) for p in five]
    for scope in ([], ["team"]):
        h = by(history.pair_history(team_rows(spark, rows), scope, "year", "match", "side", "player"), "match")
        assert (h[1,].synergy, h[1,].known) == (0.0, 0.0)
        assert (h[2,].synergy, h[2,].known) == (1.0, 1.0)


def test_roster_overlap(spark):
    rows = [("t", 2021, 1, "a", p) for p in "abcde"] + [("t", 2022, 2, "a", p) for p in "abcxy"]
    h = by(history.roster_overlap(team_rows(spark, rows), "team", "year", "match", "player"), "match")
    assert (h[1,].overlap, h[2,].overlap) == (0.0, 0.6)


def test_contract_sizes():
    maps, agents = [f"m{i}" for i in range(13)], [f"g{i}" for i in range(28)]
    assert len(set(features.baseline_contract(maps, ["a1", "b1", "c1", "d1"], agents))) == 178
    assert len(set(features.advanced_contract(maps[:12]))) == 179
    with pytest.raises(RuntimeError):
        features.check_contract(["x"], 2)


def test_swapping_sides_negates_diffs(spark):
    rows = [(1, "a", 3.0), (1, "b", 1.0), (2, "a", 2.0)]
    df = spark.createDataFrame(rows, "match int, side string, q double")
    flipped = spark.createDataFrame([(m, "b" if s == "a" else "a", q) for m, s, q in rows], df.schema)
    a, b = (by(features.spread_sides(x, "match", "side", ["q"]), "match") for x in (df, flipped))
    assert all(a[m,].diff_q == -b[m,].diff_q for m in (1, 2))


def test_imputation_uses_the_fitting_rows(spark):
    fit = spark.createDataFrame([(2.0,), (0.0,), (4.0,)], "x double")
    hold = spark.createDataFrame([(0.0,), (7.0,)], "x double")
    assert [r.x for r in features.impute_zeros(hold, features.nonzero_means(fit, ["x"]), ["x"]).collect()] == [3.0, 7.0]


def test_forbidden_names():
    assert features.forbidden_names(["a_prior_kd_mean", "score_a", "winner", "label", "diff_form5_success"]) == ["score_a", "winner"]
