from __future__ import annotations

import random

import pytest
from conftest import at, by, rows_of

from strideline.operators import cohorts as C
from strideline.operators import flow, paths
from strideline.specs import Cohort, Condition, EventMatch, Filter, PathStep, SpecError


@pytest.fixture(scope="module")
def shop(make_events):
    rows = [("u1", "search", at(0)), ("u1", "view", at(0, 1)), ("u2", "search", at(0)), ("u2", "view", at(0, 2))]
    rows += [("u3", "search", at(0)), ("u3", "checkout", at(0, 3)), ("u4", "search", at(0)), ("u5", "other", at(0))]
    return make_events(rows)


def level(rows, path, *args, **options):
    table = flow.flow_level(rows, C.all_users(rows), path, *args, **options)
    return by(table, "next_event", "users", "anchor_users")


def test_forward(shop):
    assert level(shop, ["search"]) == {"view": (2, 4), "checkout": (1, 4), flow.NO_FURTHER: (1, 4)}


def test_timing(shop):
    table = flow.flow_level(shop, C.all_users(shop), ["search"])
    times = by(table, "next_event", "p20_seconds", "median_seconds", "p80_seconds")
    assert times["view"] == (pytest.approx(4320.0), 5400.0, pytest.approx(6480.0))
    assert times[flow.NO_FURTHER] == (None, None, None)


def test_other_and_rank_order(shop):
    table = flow.flow_level(shop, C.all_users(shop), ["search"], top_n=1, timing=False)
    assert [(r.next_event, r.users) for r in table.orderBy("position").collect()] == [("view", 2), (flow.OTHER, 1), (flow.NO_FURTHER, 1)]


def test_reverse_takes_the_nearest_previous(make_events):
    rows = make_events([("u", "a", at(0)), ("u", "b", at(0, 1)), ("u", "z", at(0, 2)), ("u", "c", at(0, 3)), ("u", "z", at(0, 4))])
    assert level(rows, ["z"], "reverse", timing=False) == {"b": (1, 1), flow.NO_FURTHER: (0, 1)}
    assert level(rows, ["z", "a"], "reverse", timing=False) == {flow.NO_FURTHER: (1, 1)}


def test_self_loop_and_deeper_paths(make_events):
    rows = make_events([("u", "a", at(0)), ("u", "a", at(1)), ("u", "x", at(2)), ("u", "b", at(3)), ("u", "c", at(4)), ("v", "a", at(0))])
    assert level(rows, ["a"], timing=False) == {"a": (1, 2), flow.NO_FURTHER: (1, 2)}
    assert level(rows, ["a", "b"], timing=False) == {"c": (1, 1), flow.NO_FURTHER: (0, 1)}
    assert level(rows, ["a", "a"], timing=False) == {"x": (1, 1), flow.NO_FURTHER: (0, 1)}


def test_root_filter_applies_to_the_root_only(make_events):
    rows = make_events([("u", "a", at(0), {"p": 1}), ("u", "a", at(1), {"p": 2}), ("u", "b", at(2), {"p": 1})], p="int")
    assert level(rows, ["a"], where=Filter("p", "=", [2]), timing=False) == {"b": (1, 1), flow.NO_FURTHER: (0, 1)}
    assert level(rows, ["a"], where=Filter("p", "=", []), timing=False) == {"a": (1, 1), flow.NO_FURTHER: (0, 1)}


def test_events_before_joining_do_not_count(make_events):
    rows = make_events([("u", "a", at(0)), ("u", "b", at(1)), ("u", "buy", at(2)), ("u", "a", at(3)), ("u", "c", at(4))])
    members = C.build_membership(rows, [Cohort(1, "buyers", [Condition("buy")])])
    assert by(flow.flow_level(rows, members, ["a"], timing=False), "next_event", "users") == {"c": 1, flow.NO_FURTHER: 0}
    back = flow.flow_level(rows, members, ["a"], "reverse", timing=False)
    assert by(back, "next_event", "users") == {"buy": 1, flow.NO_FURTHER: 0}


def test_cohorts_are_kept_apart(shop):
    members = C.build_membership(shop, [Cohort(1, "all"), Cohort(2, "viewers", [Condition("view")], join_type="first_event")])
    table = by(flow.flow_level(shop, members, ["search"], timing=False), ["cohort_id", "next_event"], "users")
    assert table[(1, "view")] == table[(2, "view")] == 2
    assert table[(2, flow.NO_FURTHER)] == 0
    ranks = flow.rank_targets(flow.transitions(shop, flow.flow_anchors(shop, members, ["search"]), 1))
    assert by(ranks, "next_event", "total_users") == {"view": 2, "checkout": 1}


def test_flow_limits(shop):
    members = C.all_users(shop)
    for call in (
        lambda: flow.flow_level(shop, members, ["a"] * 20),
        lambda: flow.flow_level(shop, members, []),
        lambda: flow.flow_level(shop, members, ["search", flow.OTHER]),
        lambda: flow.flow_level(shop, members, ["search"], "sideways"),
        lambda: flow.flow_level(shop, members, ["search"], top_n=51),
    ):
        with pytest.raises(SpecError):
            call()


def test_edges_follow_levels(shop):
    edges = flow.flow_edges(shop, C.all_users(shop), "search", depth=2, top_n=3)
    found = by(edges, ["source_path", "target_event"], "source_users", "target_users")
    assert found[("search", "view")] == (4, 2)
    assert found[("search > view", flow.NO_FURTHER)] == (2, 2)
    assert {r.target_step for r in edges.collect()} == {1, 2}


def reached(rows, *names, gap=None, upto=None):
    steps = [s if isinstance(s, PathStep) else PathStep.of(s) for s in names]
    trails = paths.path_trails(rows, C.all_users(rows), steps, gap, upto)
    return {r.user_id: len(r.trail) for r in trails.collect()}


def test_same_instant_rules(make_events):
    pair = make_events([("u", "A", at(0)), ("u", "B", at(0))])
    assert reached(pair, "A", "B") == {"u": 2}
    assert reached(pair, "B", "A") == {"u": 2}
    assert reached(pair, "A", "B", "A") == {"u": 2}
    three = make_events([("u", "A", at(0))] * 3)
    assert reached(three, "A", "A", "A") == {"u": 3}
    assert reached(three, "A", "A", "A", "A") == {"u": 3}
    assert reached(make_events([("u", "A", at(0))]), "A", "A") == {"u": 1}


@pytest.fixture(scope="module")
def five(make_events):
    rows = []
    for i in range(5):
        rows.append((f"u{i}", "A", at(0, i)))
        if i < 3:
            rows.append((f"u{i}", "B", at(1, i)))
        if i < 2:
            rows.append((f"u{i}", "C", at(2, i)))
    return make_events(rows + [("u3", "C", at(1)), ("u4", "B", at(-1)), ("u0", "X", at(1))])


def test_conversion(five):
    steps = [PathStep.of(n) for n in "ABC"]
    members = C.build_membership(five, [Cohort(1, "A", [Condition("A")])])
    table = paths.path_conversion(paths.path_trails(five, members, steps), members, steps)
    assert by(table, "step", "users", "conversion_pct", "drop_off_pct") == {1: (5, 100.0, None), 2: (3, 60.0, 40.0), 3: (2, 40.0, 33.3)}
    assert by(table, "step", "mean_seconds", "p20_seconds")[2] == (86_400.0, None)
    insights = rows_of(paths.path_insights(table))
    assert insights == [(1, 2, "drop_off", 40.0), (1, 3, "drop_off", 33.3)]


def test_dropoff_and_reached_cohorts(five):
    steps = [PathStep.of(n) for n in "ABC"]
    members = C.build_membership(five, [Cohort(1, "A", [Condition("A")])])
    assert rows_of(paths.dropoff_cohort(five, members, steps, 1), "user_id") == []
    assert rows_of(paths.dropoff_cohort(five, members, steps, 2), "user_id") == [("u3",), ("u4",)]
    assert rows_of(paths.dropoff_cohort(five, members, steps, 3), "user_id", "join_time") == [("u2", at(0, 2))]
    assert rows_of(paths.reached_cohort(five, members, steps, 3), "user_id") == [("u0",), ("u1",)]


def test_greedy_matching_does_not_backtrack(make_events):
    rows = make_events([("u", "A", at(0)), ("u", "B", at(minutes=2)), ("u", "B", at(minutes=9)), ("u", "C", at(minutes=10))])
    assert reached(rows, "A", "B", "C", gap=5) == {"u": 2}
    assert reached(rows, "A", "B", "C") == {"u": 3}


def test_or_groups(make_events):
    rows = make_events(
        [("a", "A", at(0), {"p": "x"}), ("a", "C", at(1), {"p": "x"}), ("b", "A", at(0), {"p": "y"}), ("b", "B", at(1), {"p": "x"}), ("b", "C", at(0, 12), {"p": "y"})]
        + [("c", "A", at(0), {"p": "x"}), ("c", "B", at(1), {"p": "x"})],
        p="string",
    )
    steps = [PathStep.of("A"), PathStep((EventMatch("B"), EventMatch("C", {"p": "x"})))]
    members = C.all_users(rows)
    trails = paths.path_trails(rows, members, steps)
    shares = by(paths.group_breakdown(trails, steps), "event", "users", "share_pct")
    assert shares == {"B": (2, 66.7), "C": (1, 33.3)}
    overlap = [PathStep.of("A"), PathStep((EventMatch("C"), EventMatch("C", {"p": "x"})))]
    assert {r.branch for r in paths.reached_steps(paths.path_trails(rows, members, overlap)).where("step = 2").collect()} == {0}


def test_gaps_between_the_three_largest(spark):
    data = [(c, s, size, 10, pct) for c, size in ((1, 50), (2, 40), (3, 30), (4, 5)) for s, pct in ((1, 100.0), (2, {1: 50.0, 2: 61.0, 3: 45.0, 4: 0.0}[c]))]
    table = spark.createDataFrame(data, "cohort_id int, step int, size long, users long, conversion_pct double")
    assert rows_of(paths.cohort_gaps(table)) == [(2, 2, 1, 11.0), (2, 2, 3, 16.0)]


def test_references(five):
    steps = [PathStep.of("A"), PathStep((EventMatch("Z"), EventMatch("B", {"row_id": 1})))]
    assert by(paths.path_references(five, steps), ["column_name", "value"], "present") == {
        ("event_name", "A"): True, ("event_name", "Z"): False, ("event_name", "B"): True, ("row_id", "1"): True
    }


@pytest.mark.parametrize(
    "steps",
    [
        [PathStep.of("A")],
        [PathStep.of("A")] * 11,
        [PathStep.of("A"), PathStep(())],
        [PathStep.of("A"), PathStep.of("B", "B")],
        [PathStep.of("A"), PathStep.of("")],
    ],
)
def test_bad_paths(five, steps):
    with pytest.raises(SpecError):
        paths.path_trails(five, C.all_users(five), steps)


def _walk(history, steps, gap):
    """Greedy matching of one user's sorted rows in plain Python."""
    used, last = [], None
    for step in steps:
        found = None
        for moment, row_id, name in history:
            if name not in step or row_id in used:
                continue
            if last is not None and (moment < last or (gap is not None and (moment - last).total_seconds() > gap * 60)):
                continue
            found = (moment, row_id)
            break
        if found is None:
            break
        last = found[0]
        used.append(found[1])
    return used


@pytest.mark.parametrize("gap", [None, 90])
def test_paths_against_brute_force_with_and_without_salts(make_events, salted, gap):
    rng = random.Random(11)
    rows = [("u%d" % (i * i % 7), rng.choice("ABC"), at(0, rng.randrange(30), rng.choice([0, 30]))) for i in range(150)]
    frame = make_events(rows)
    members = C.all_users(frame)
    steps = [PathStep.of("A"), PathStep.of("B", "C"), PathStep.of("A"), PathStep.of("C")]
    expected = {}
    for user in {r[0] for r in rows}:
        history = sorted((r[2], i, r[1]) for i, r in enumerate(rows) if r[0] == user)
        expected[user] = _walk(history, [("A",), ("B", "C"), ("A",), ("C",)], gap)

    def trails():
        return {r.user_id: [t.id for t in r.trail] for r in paths.path_trails(frame, members, steps, gap).collect()}

    assert trails() == expected
    with salted():
        assert trails() == expected


def test_flows_of_hot_users_are_the_same(make_events, salted):
    rng = random.Random(12)
    frame = make_events([("u%d" % (i * i % 6), rng.choice("abcd"), at(0, rng.randrange(40))) for i in range(120)])
    members = C.build_membership(frame, [Cohort(1, "all"), Cohort(2, "d", [Condition("d", 2)])])

    def results():
        return [
            rows_of(flow.flow_level(frame, members, ["a"])),
            rows_of(flow.flow_level(frame, members, ["a", "b"], "reverse", timing=False)),
            rows_of(flow.flow_edges(frame, members, "a", 2)),
        ]

    plain = results()
    with salted():
        assert results() == plain


def test_hot_users_are_found(make_events, salted):
    from strideline.operators.skew import hot_keys

    frame = make_events([("big", "e", at(0, i)) for i in range(7)] + [("small", "e", at(0))])
    assert hot_keys(frame).salts is None
    with salted():
        assert rows_of(hot_keys(frame).salts) == [("big", 4)]


def test_plans_have_no_cross_join(shop):
    steps = [PathStep.of("search"), PathStep.of("view")]
    plan = paths.path_trails(shop, C.all_users(shop), steps)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
