import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from rillset.zset import ZSet, differentiate, integrate

SCHEMA = "k INT, s STRING"
ROWS = st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 3)), st.sampled_from(["a", "b", None]), st.integers(-2, 2)), max_size=8)
SLOW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def made(spark, rows):
    return ZSet.from_data(spark, SCHEMA, [r[:2] for r in rows], [r[2] for r in rows])


def weights(rows):
    out = {}
    for *r, w in rows:
        out[tuple(r)] = out.get(tuple(r), 0) + w
    return {r: w for r, w in out.items() if w}


@SLOW
@given(ROWS, ROWS)
def test_group_laws(spark, a, b):
    x, y = made(spark, a), made(spark, b)
    assert x.add(y).to_dict() == weights([*a, *b])
    assert x.subtract(x).is_empty()
    assert x.add(y).equals(y.add(x))
    assert x.negate().negate().equals(x)
    assert x.scale(3).to_dict() == {r: 3 * w for r, w in weights(a).items()}


@SLOW
@given(ROWS, ROWS)
def test_sets(spark, a, b):
    one, two = ({r for r, w in weights(x).items() if w > 0} for x in (a, b))
    x, y = made(spark, a), made(spark, b)
    assert x.distinct().to_dict() == dict.fromkeys(one, 1)
    assert x.except_(y).to_dict() == dict.fromkeys(one - two, 1)
    assert x.intersect(y).to_dict() == dict.fromkeys(one & two, 1)
    assert x.positive().to_dict() == {r: w for r, w in weights(a).items() if w > 0}
    assert sorted(map(str, (tuple(r) for r in x.expand().collect()))) == sorted(str(r) for r, w in weights(a).items() for _ in range(max(0, w)))


def test_product_join_and_keys(spark):
    x = ZSet.from_data(spark, "k INT", [(1,), (2,)], [2, -1])
    y = ZSet.from_data(spark, "v INT", [(7,)], [3])
    assert x.multiply(y).to_dict() == {(1, 7): 6, (2, 7): -3}
    left = ZSet.from_data(spark, "k INT, a STRING", [(1, "x"), (2, "y"), (None, "n")])
    right = ZSet.from_data(spark, "k INT, b STRING", [(1, "p"), (None, "q")])
    assert left.join(right, ["k"]).to_dict() == {(1, "x", "p"): 1}
    assert left.join(right, ["k"], "left_semi").to_dict() == {(1, "x"): 1}
    assert left.join(right, ["k"], "left_anti").to_dict() == {(2, "y"): 1, (None, "n"): 1}
    assert left.group_count(["k"]) == 3
    assert left.deindex(["k"]).columns == ["a"]
    parts = left.hash_partition(["k"], 3)
    assert ZSet.concat(parts).equals(left)
    assert ZSet.empty(spark, "k INT").is_empty()
    with pytest.raises(ValueError):
        ZSet.from_root(spark.range(1))


def test_integrate_and_differentiate(spark):
    deltas = [ZSet.from_data(spark, "k INT", [(1,), (2,)]), ZSet.from_data(spark, "k INT", [(1,)], [-1]), ZSet.from_data(spark, "k INT", [(3,)])]
    states = integrate(deltas)
    assert [s.to_dict() for s in states] == [{(1,): 1, (2,): 1}, {(2,): 1}, {(2,): 1, (3,): 1}]
    assert [d.to_dict() for d in differentiate(states)] == [d.to_dict() for d in deltas]


def test_outer_joins_take_cancelled_rows_as_gone(spark):
    left = ZSet.from_data(spark, "k INT, a INT", [(1, 1), (2, 2)])
    right = ZSet.from_data(spark, "k INT, b INT", [(1, 9), (1, 9), (2, 5)], [1, -1, 2])
    assert left.join(right, ["k"], "left").to_dict() == {(1, 1, None): 1, (2, 2, 5): 2}
