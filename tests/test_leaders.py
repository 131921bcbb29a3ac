import random

from sievework.operators import dedupe
from sievework.operators.leaders import first_leaders


def replay(rows):
    """First leader in order that shares a key, else a new one."""
    keys = {}
    for pos, key in rows:
        keys.setdefault(pos, set()).add(key)
    leaders, out = [], {}
    for pos in sorted(keys):
        out[pos] = next((at for at in leaders if keys[at] & keys[pos]), pos)
        if out[pos] == pos:
            leaders.append(pos)
    return out


def groups(spark, rows, schema="pos long, key string, size int"):
    df = spark.createDataFrame([(*r, 1) for r in rows], schema)
    return {r["pos"]: r["group_pos"] for r in first_leaders(df, ["key"]).collect()}


def test_random_ties_against_replay(spark):
    rng = random.Random(5)
    for n, many in ((60, 12), (200, 150)):
        rows = [(rng.randrange(n), f"k{rng.randrange(many)}") for _ in range(2 * n)]
        want = replay(rows)
        assert groups(spark, rows) == want
        assert 1 < len({*want.values()}) < len(want)


def test_chain_and_hot_key(spark):
    chain = [(i, f"c{k}") for i in range(12) for k in (i, i + 1)]
    hot = [(100 + i, "hot") for i in range(3000)] + [(100 + i, f"own{i}") for i in range(3000)]
    assert groups(spark, chain) == replay(chain) == {i: i - i % 2 for i in range(12)}
    assert groups(spark, hot) == {100 + i: 100 for i in range(3000)}


def test_a_leader_behind_a_settled_record_of_its_key(spark):
    rows = [(0, "a"), (1, "a"), (1, "b"), (2, "b"), (3, "b")]
    assert groups(spark, rows) == {0: 0, 1: 0, 2: 2, 3: 2}


def test_odd_rows(spark):
    assert groups(spark, []) == {}
    assert groups(spark, [(None, "a"), (1, None), (2, "a"), (2, "a"), (3, "a")]) == {2: 2, 3: 2}
    assert groups(spark, [("b", "x"), ("a", "x")], "pos string, key string, size int") == {"a": "a", "b": "a"}


def test_policy_records_without_a_title_are_a_block(spark):
    rows = [(5, "M", None, "v", "2024", None), (3, "M", "", "v", "2023", None), (4, "M", "t", "v", "2023", None), (5, "M", None, "v", "2024", None)]
    df = spark.createDataFrame(rows, "pos long, authority string, title string, version string, publication_date string, effective_date string")
    assert sorted(map(tuple, dedupe.policy_groups(df).collect())) == [(3, 3), (4, 4), (5, 3), (5, 3)]
