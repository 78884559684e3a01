"""Step-level scenarios: exact signed changes of views, and the law that content equals recomputation."""

import datetime as dt
import math
import os
import random
from decimal import Decimal

import pytest

from rillset.engine import Engine
from rillset.udf import AggregateUdf
from rillset.zset import ZSet

EMP = "id INT, dept STRING, salary INT"
VIEWS = {
    "v_lin": "SELECT id, upper(dept) AS d, salary * 2 AS s FROM emp WHERE salary > 10",
    "v_agg": "SELECT dept, SUM(salary) AS s, COUNT(*) AS n, COUNT(salary) AS c, AVG(salary) AS a FROM emp GROUP BY dept",
    "v_min": "SELECT dept, MIN(salary) AS mi, MAX(salary) AS ma, COUNT(DISTINCT id) AS k FROM emp GROUP BY dept",
    "v_glob": "SELECT COUNT(*) AS n, SUM(salary) AS s FROM emp",
    "v_self": "SELECT a.id AS i, b.id AS j FROM emp a JOIN emp b ON a.dept = b.dept AND a.id < b.id",
    "v_left": "SELECT a.id AS i, b.id AS j FROM emp a LEFT JOIN emp b ON a.id = b.salary AND b.id > 1",
    "v_full": "SELECT a.id AS i, b.salary AS j FROM emp a FULL JOIN emp b ON a.id = b.salary",
    "v_win": "SELECT id, dept, ROW_NUMBER() OVER (PARTITION BY dept ORDER BY salary DESC, id) AS r, SUM(salary) OVER (PARTITION BY dept) AS t FROM emp",
    "v_dist": "SELECT DISTINCT dept FROM emp",
    "v_un": "SELECT id FROM emp WHERE id % 2 = 0 UNION ALL SELECT salary FROM emp",
    "v_exc": "SELECT id FROM emp EXCEPT SELECT salary FROM emp",
    "v_roll": "SELECT dept, id % 2 AS o, SUM(salary) AS s FROM emp GROUP BY ROLLUP (dept, id % 2)",
    "v_view": "SELECT dept, n * 2 AS m FROM v_agg WHERE n > 1",
    "v_in": "SELECT id FROM emp WHERE dept IN (SELECT dept FROM emp WHERE salary >= 100)",
    "v_notin": "SELECT id FROM emp WHERE id NOT IN (SELECT salary FROM emp WHERE salary IS NOT NULL)",
    "v_sub": "SELECT id FROM emp WHERE salary > (SELECT AVG(salary) FROM emp)",
    "v_top": "SELECT id, salary FROM emp ORDER BY salary DESC NULLS LAST, id LIMIT 2",
    "v_nest": "SELECT n, COUNT(*) AS c FROM (SELECT dept, COUNT(*) AS n FROM emp GROUP BY dept) GROUP BY n",
    "v_ia": "SELECT id FROM emp INTERSECT ALL SELECT salary FROM emp",
}


def z(spark, schema, rows, weights=None):
    return ZSet.from_data(spark, schema, rows, weights)


def test_law_over_random_changes(spark):
    """Content of every view after each step equals its query over the tables, and outputs add up to it."""
    rng = random.Random(5)
    engine = Engine(spark)
    engine.create_table("emp", EMP)
    for name, text in VIEWS.items():
        engine.sql(text, name)
    rules = {n: [r for _, r, _ in v.program.lines(v.plan)] if v.program else [] for n, v in engine.views.items()}
    assert not any("Recompute" in r for n in ("v_agg", "v_self", "v_left", "v_win", "v_exc", "v_roll", "v_in", "v_nest") for r in rules[n])
    assert rules["v_agg"][0] == "Aggregate(partial sums)" and engine.views["v_sub"].program is None
    sums = {n: {} for n in VIEWS}
    live = []
    for _ in range(2):
        fresh = [(rng.randint(1, 6), rng.choice(["x", "y", None]), rng.choice([1, 2, 50, 100, None])) for _ in range(5)]
        gone = [live.pop(rng.randrange(len(live))) for _ in range(min(2, len(live)))]
        live += fresh
        engine.push("emp", z(spark, EMP, fresh + gone, [1] * len(fresh) + [-1] * len(gone))).step()
        for name, view in engine.views.items():
            for row, w in engine.output(name).to_dict().items():
                sums[name][row] = sums[name].get(row, 0) + w
            want = ZSet(engine._recompute(view, "old")).to_dict()
            assert engine.snapshot(name).to_dict() == want, name
            assert {r: w for r, w in sums[name].items() if w} == want, name
    engine.step()
    assert all(engine.output(n).is_empty() for n in VIEWS)
    engine.close()


def test_group_disappears_and_update(spark):
    engine = Engine(spark)
    engine.create_table("employees", EMP)
    engine.sql("SELECT dept, SUM(salary) AS s, COUNT(*) AS n FROM employees GROUP BY dept", "by_dept")
    engine.push("employees", z(spark, EMP, [(1, "Eng", 120000), (2, "Eng", 95000), (3, "Mkt", 80000)])).step()
    engine.push("employees", z(spark, EMP, [(3, "Mkt", 80000)], [-1])).step()
    assert engine.output("by_dept").to_dict() == {("Mkt", 80000, 1): -1}
    assert engine.snapshot("BY_DEPT").to_dict() == {("Eng", 215000, 2): 1}
    engine.reset()
    engine.push("employees", z(spark, EMP, [(9, "Ops", 5)])).step()
    assert engine.snapshot(0).to_dict() == {("Ops", 5, 1): 1} == engine.output(0).to_dict()


def test_rolling_window_and_late_rows(spark):
    engine = Engine(spark)
    engine.create_table("txn", "cc INT, ts INT, amt INT")
    engine.sql("SELECT cc, ts, amt, SUM(amt) OVER (PARTITION BY cc ORDER BY ts RANGE BETWEEN 10 PRECEDING AND CURRENT ROW) AS s FROM txn", "v")
    t = "cc INT, ts INT, amt INT"
    engine.push("txn", z(spark, t, [(1, 5, 100), (1, 15, 200)])).step()
    engine.push("txn", z(spark, t, [(1, 10, 50)])).step()
    assert engine.output("v").to_dict() == {(1, 10, 50, 150): 1, (1, 15, 200, 300): -1, (1, 15, 200, 350): 1}


def test_outer_joins(spark):
    engine = Engine(spark)
    engine.create_table("l", "id INT, name STRING")
    engine.create_table("r", "id INT, score INT")
    engine.sql("SELECT l.id AS a, name, r.id AS b, score FROM l RIGHT JOIN r ON l.id = r.id", "right_view")
    engine.sql("SELECT l.id AS a, name, r.id AS b, score FROM l FULL JOIN r ON l.id = r.id", "full_view")
    engine.sql("SELECT id, name FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.id = l.id)", "anti")
    left, right = "id INT, name STRING", "id INT, score INT"
    engine.push("l", z(spark, left, [(1, "alice"), (3, "charlie")])).push("r", z(spark, right, [(1, 100), (2, 200)])).step()
    assert engine.snapshot("full_view").entry_count() == 3
    engine.push("l", z(spark, left, [(2, "bob")])).step()
    assert engine.output("right_view").to_dict() == {(None, None, 2, 200): -1, (2, "bob", 2, 200): 1}
    engine.push("r", z(spark, right, [(1, 100)], [-1])).step()
    assert engine.output("anti").to_dict() == {(1, "alice"): 1}


def test_pushes_add_up_and_errors(spark):
    engine = Engine(spark)
    engine.create_table("t", "a INT")
    engine.push("t", z(spark, "a INT", [(1,)], [-1])).push("T", z(spark, "a INT", [(1,), (2,)]))
    name = engine.sql("SELECT a FROM t")
    engine.step()
    assert name == "view_0" and engine.snapshot().to_dict() == {(2,): 1} and engine.output_count() == 1
    for wrong in (lambda: engine.push("nope", z(spark, "a INT", [])), lambda: engine.create_table("T", "a INT"), lambda: engine.push("t", z(spark, "a INT, b INT", [])), lambda: engine.snapshot("nope")):
        with pytest.raises(ValueError):
            wrong()
    engine.sql("SELECT CAST(1 AS INT) / (a - 2) AS x FROM t", "bad", backfill=False)
    engine.push("t", z(spark, "a INT", [(2,)]))
    with pytest.raises(Exception):
        engine.step()
    assert engine.snapshot().to_dict() == {(2,): 1}  # a failed step changes nothing


def test_view_added_late_starts_with_what_is_there(spark):
    engine = Engine(spark)
    engine.create_table("t", "k STRING, a INT")
    engine.push("t", z(spark, "k STRING, a INT", [("x", 1), ("x", 2)])).step()
    engine.sql("SELECT k, SUM(a) AS s FROM t GROUP BY k", "late")
    assert engine.snapshot("late").to_dict() == {("x", 3): 1}
    engine.push("t", z(spark, "k STRING, a INT", [("x", 4)])).step()
    assert engine.output("late").to_dict() == {("x", 3): -1, ("x", 7): 1}


def test_event_time(spark):
    engine = Engine(spark)
    engine.create_table("users", "id INT, name STRING")
    engine.sql("SELECT id, name, event_time() AS seen FROM users", "stamped")
    engine.sql("SELECT name FROM stamped WHERE seen > 1500", "recent")
    engine.sql("SELECT id FROM users WHERE event_time() >= 2000", "late")
    u = "id INT, name STRING"
    engine.push("users", z(spark, u, [(1, "alice")]), event_time=1000).step()
    engine.push("users", z(spark, u, [(2, "bob")]), event_time=2000).step()
    assert engine.get_event_time() == 2000
    assert engine.snapshot("stamped").to_dict() == {(1, "alice", 1000): 1, (2, "bob", 2000): 1}
    assert engine.snapshot("recent").to_dict() == {("bob",): 1} and engine.snapshot("late").to_dict() == {(2,): 1}
    with pytest.raises(ValueError):
        engine.sql("SELECT id, MAX(event_time()) AS t FROM users GROUP BY id", "no")


def test_functions_of_users(spark):
    class Total(AggregateUdf):
        def initialize(self):
            return 0

        def accumulate(self, acc, value, weight):
            return acc + (0 if value is None else int(value) * weight)

        def finalize(self, acc):
            return acc

    engine = Engine(spark)
    engine.create_table("csv_in", "id INT, csv STRING")
    engine.register_udf("turned_text", lambda s: None if s is None else s[::-1], ["string"], "string")
    engine.register_udaf("my_total", Total(), "i64", "i64")
    with pytest.raises(ValueError):
        engine.register_udf("TURNED_TEXT", lambda s: s, ["string"], "string")
    engine.apply_table_udf("parts", "csv_in", [0, 1], lambda i, s: None if s is None else [(i, p, k) for k, p in enumerate(s.split(","))], "id INT, part STRING, idx INT")
    engine.sql("SELECT part, COUNT(*) AS n FROM parts GROUP BY part", "counted")
    engine.sql("SELECT id, turned_text(csv) AS t FROM csv_in", "turned")
    engine.sql("SELECT csv, my_total(CAST(id AS BIGINT)) AS s FROM csv_in GROUP BY csv", "totals")
    with pytest.raises(IndexError):
        engine.apply_table_udf("wrong", "csv_in", [5], lambda x: None, "a INT")
    c = "id INT, csv STRING"
    engine.push("csv_in", z(spark, c, [(1, "a,b,c"), (7, None)])).step()
    assert engine.output("parts").entry_count() == 3
    engine.push("csv_in", z(spark, c, [(2, "a,y"), (1, "a,b,c")], [1, 1])).step()
    engine.push("csv_in", z(spark, c, [(1, "a,b,c")], [-2])).step()
    assert engine.output("parts").to_dict() == {(1, "a", 0): -2, (1, "b", 1): -2, (1, "c", 2): -2}
    assert engine.snapshot("counted").to_dict() == {("a", 1): 1, ("y", 1): 1}
    assert engine.snapshot("turned").to_dict() == {(2, "y,a"): 1, (7, None): 1}
    assert engine.snapshot("totals").to_dict() == {("a,y", 2): 1, (None, 7): 1}


def test_bitemporal_sinks(spark, tmp_path):
    engine = Engine(spark)
    engine.create_table("orders", "id INT, customer STRING, amount INT")
    engine.sql("SELECT id, customer FROM orders WHERE amount > 100", "big")
    sink = engine.accumulate_view("big")
    engine.write_table_to_parquet("orders", str(tmp_path / "out"))
    o = "id INT, customer STRING, amount INT"
    engine.push("orders", z(spark, o, [(1, "Alice", 999), (2, "Bob", 50), (3, "Charlie", 349)]), 1000).step()
    engine.push("orders", z(spark, o, [(3, "Charlie", 349)], [-1]), 1001).step()
    assert {tuple(r) for r in sink.closed_rows().collect()} == {(3, "Charlie", 1000, 1001)}
    engine.set_event_time(1002)
    engine.close()
    assert {tuple(r) for r in sink.rows(5).collect()} == {(3, "Charlie", 1000, 1001), (1, "Alice", 1000, 1002)}
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    with pytest.raises(RuntimeError):
        sink.record(None, 1)


def test_bitemporal_pairs_first_in_first_out(spark):
    """Against a queue, on random signed units."""
    rng = random.Random(11)
    engine = Engine(spark)
    engine.create_table("t", "a INT")
    sink = engine.accumulate_table("t")
    queue, want = [], []
    for step in range(8):
        n = rng.choice([-2, -1, 1, 2])
        engine.push("t", z(spark, "a INT", [(1,)], [n]), 100 + step).step()
        for _ in range(abs(n)):
            if n > 0:
                queue.append(100 + step)
            else:
                want.append((1, queue.pop(0), 100 + step) if queue else (1, 100 + step, 100 + step))
    want += [(1, s, 500) for s in queue]
    engine.set_event_time(500)
    assert sorted(tuple(r) for r in sink.rows(500).collect()) == sorted(want)


def test_reports(spark):
    engine = Engine(spark)
    engine.create_table("t", "a INT")
    engine.sql("SELECT a, COUNT(*) AS n FROM t WHERE a > 0 GROUP BY a", "v")
    engine.sql("SELECT n FROM v", "w")
    engine.push("t", z(spark, "a INT", [(1,)])).step()
    assert engine.metrics()["0:v"].steps == 0
    engine.set_metrics_enabled(True)
    engine.push("t", z(spark, "a INT", [(1,)])).step()
    assert engine.metrics()["0:v"].steps == 1 and engine.metrics()["0:v"].rows == 2 and engine.metrics()["0:v"].average_ms > 0
    drawing = engine.to_dot()
    assert drawing.startswith("digraph Circuit") and "Aggregate(partial sums)" in drawing and drawing.count('label="Input\\nt"') == 1


def test_right_sums_after_retractions_and_for_wide_decimals(spark):
    """The law for floats (huge ones and infinities too), large integers and decimals of full scale, over insertions and retractions."""
    schema = "k STRING, f DOUBLE, b BIGINT, d DECIMAL(28,10), e DECIMAL(38,18)"
    text = "SELECT k, SUM(f) AS sf, AVG(f) AS af, SUM(b) AS sb, AVG(b) AS ab, SUM(d) AS sd, SUM(e) AS se, CAST(SUM(d) AS DOUBLE) AS cd, COUNT(*) FILTER (WHERE b > 5) AS nb, MAX(f) AS mf FROM t GROUP BY k"
    engine = Engine(spark)
    engine.create_table("t", schema)
    engine.sql(text, "v")
    engine.sql("SELECT SUM(f) AS s, AVG(b) AS a, MIN(d) AS m FROM t", "g")
    assert [r for _, r, _ in engine.views["v"].program.lines(engine.views["v"].plan)][0] == "Aggregate(partial sums)"
    small, big, inf = ("x", 1.0, 1, Decimal("0.0000000004"), Decimal("0.000000000000000001")), ("x", 1e20, 1 << 62, Decimal("1.0000000003"), Decimal("1E+15")), ("x", math.inf, 3, None, None)
    for rows, weights in (([small, ("y", 0.1, 7, None, None)], [1, 1]), ([big, small], [1, 2]), ([big, inf], [-1, 1]), ([inf, ("y", 0.2, 6, None, None)], [-1, 1]), ([small], [-2])):
        engine.push("t", z(spark, schema, rows, weights)).step()
        for name in ("v", "g"):
            assert engine.snapshot(name).to_dict() == ZSet(engine._recompute(engine.views[name], "old")).to_dict()
    assert engine.snapshot("v").to_dict() == {
        ("x", 1.0, 1.0, 1, 1.0, Decimal("0.0000000004"), Decimal("0.000000000000000001"), 4e-10, 0, 1.0): 1,
        ("y", 0.1 + 0.2, (0.1 + 0.2) / 2, 13, 6.5, None, None, None, 2, 0.2): 1,
    }


def test_a_refused_view_leaves_nothing_behind(spark):
    engine = Engine(spark)
    engine.create_table("t", "a INT, s STRING")
    for wrong in ("SELECT s, MAX(event_time()) AS m FROM t GROUP BY s", "SELECT s, COUNT(now()) AS n FROM t GROUP BY s"):
        with pytest.raises(ValueError):
            engine.sql(wrong, "v")
    engine.sql("SELECT s, COUNT(*) AS n FROM t WHERE s <> 'now()' GROUP BY s", "v")  # text is no clock
    engine.push("t", z(spark, "a INT, s STRING", [(1, "x"), (2, "now()")])).step()
    assert engine.snapshot("v").to_dict() == {("x", 1): 1}


def test_a_failing_sink_changes_nothing(spark):
    engine = Engine(spark)
    engine.create_table("t", "a INT")
    engine.sql("SELECT a, COUNT(*) AS n FROM t GROUP BY a", "v")
    first, second = engine.accumulate_table("t"), engine.accumulate_view("v")
    engine.push("t", z(spark, "a INT", [(1,)])).step()
    whole, second.stage = second.stage, lambda *_: 1 / 0
    engine.push("t", z(spark, "a INT", [(2,)]))
    for _ in range(2):
        with pytest.raises(ZeroDivisionError):
            engine.step()
        assert engine.snapshot("v").to_dict() == {(1, 1): 1} and first.rows(9).count() == 1
    second.stage = whole
    engine.step()
    assert engine.snapshot("v").to_dict() == {(1, 1): 1, (2, 1): 1} and first.rows(9).count() == 2 == second.rows(9).count()
    engine.push("t", z(spark, "a INT", [(3,)])).discard().step()
    assert engine.snapshot("v").entry_count() == 2


def test_without_backfill_what_was_there_does_not_count(spark):
    engine = Engine(spark)
    engine.create_table("t", "k STRING, a INT")
    t = "k STRING, a INT"
    engine.push("t", z(spark, t, [("x", 1), ("x", 7), ("y", 5)])).step()
    texts = {"n": "SELECT k, COUNT(*) AS v FROM t GROUP BY k", "m": "SELECT k, MAX(a) AS v FROM t GROUP BY k", "w": "SELECT k, SUM(a) OVER (PARTITION BY k) AS v FROM t", "s": "SELECT k, a AS v FROM t WHERE a > (SELECT MIN(a) FROM t)"}
    for name, text in texts.items():
        engine.sql(text, name, backfill=False)
        assert engine.snapshot(name).is_empty()
    engine.push("t", z(spark, t, [("x", 2), ("x", 3)])).step()
    assert [engine.snapshot(n).to_dict() for n in texts] == [{("x", 2): 1}, {("x", 3): 1}, {("x", 5): 2}, {("x", 3): 1}]
    engine.push("t", z(spark, t, [("x", 3)], [-1])).step()
    assert [engine.snapshot(n).to_dict() for n in texts] == [{("x", 1): 1}, {("x", 2): 1}, {("x", 2): 1}, {}]


def test_engines_of_one_session_stay_apart(spark):
    spark.range(3).createOrReplaceTempView("t")
    one, two = Engine(spark), Engine(spark)
    one.create_table("t", "a INT")
    one.sql("SELECT a, event_time() AS seen FROM t", "v")
    two.create_table("t", "a STRING")
    two.sql("SELECT a FROM t", "v")
    two.set_event_time(7)
    one.push("t", z(spark, "a INT", [(1,)]), 5).step()
    two.push("t", z(spark, "a STRING", [("x",)])).step()
    two.close()
    two.drop()
    assert one.snapshot("v").to_dict() == {(1, 5): 1} and spark.table("t").count() == 3
    assert one.views["v"].program and one.snapshot("v").schema[0].dataType.simpleString() == "int"
    spark.catalog.dropTempView("t")


def test_an_engine_is_opened_again_from_its_folder(spark, tmp_path):
    def build():
        engine = Engine(spark, folder=f"file://{tmp_path}/state")
        engine.create_table("t", "k STRING, a DOUBLE")
        engine.sql("SELECT k, SUM(a) AS s, MAX(a) AS m FROM t GROUP BY k", "sums")
        engine.sql("SELECT k, s FROM sums ORDER BY s DESC LIMIT 1", "best")
        engine.sql("SELECT MAX(s) AS top, COUNT(*) AS n FROM sums", "over")
        engine.accumulate_view("best")
        return engine

    t = "k STRING, a DOUBLE"
    first = build()
    first.push("t", z(spark, t, [("x", 1.0), ("y", 2.0)]), 10).step()
    first.push("t", z(spark, t, [("x", 5.0)]), 11).step()
    first.push("t", z(spark, t, [("z", 99.0)]))  # never taken
    again = build()
    assert again.get_event_time() == 11 and again.steps == 2
    assert again.output("sums").to_dict() == {("x", 1.0, 1.0): -1, ("x", 6.0, 5.0): 1}
    again.push("t", z(spark, t, [("x", 5.0), ("y", 1.5)], [-1, 1]), 12).step()
    assert again.snapshot("sums").to_dict() == {("x", 1.0, 1.0): 1, ("y", 3.5, 2.0): 1}
    assert again.snapshot("best").to_dict() == {("y", 3.5): 1} and again.snapshot("over").to_dict() == {(3.5, 2): 1}
    assert sorted(tuple(r) for r in again.sinks[("view", "best")].rows(20).collect()) == [("x", 6.0, 11, 12), ("y", 2.0, 10, 11), ("y", 3.5, 12, 20)]
    with pytest.raises(ValueError):
        Engine(spark, folder=f"file://{tmp_path}/state").create_table("t", "k INT")
    again.drop()
    assert not os.path.exists(tmp_path / "state")


def test_feeds_take_each_batch_once_over_restarts(spark, tmp_path):
    from rillset.streaming.adapter import feed

    def build(folder):
        engine = Engine(spark, folder=f"file://{tmp_path}/{folder}")
        engine.create_table("e", "a INT")
        engine.sql("SELECT COUNT(*) AS n, SUM(a) AS s FROM e", "v")
        return engine

    def run(engine):
        stream = spark.readStream.schema("a INT").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        feed(engine, "e", stream, f"{tmp_path}/checkpoint").awaitTermination()
        return engine.snapshot("v").to_dict()

    spark.range(3).selectExpr("CAST(id AS INT) AS a").coalesce(1).write.parquet(f"{tmp_path}/in")
    engine = build("state")
    assert run(engine) == {(3, 3): 1} and engine.feeds == {f"{tmp_path}/checkpoint": 0}
    spark.range(3, 5).selectExpr("CAST(id AS INT) AS a").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    whole, engine.step = engine.step, lambda feed: whole(feed) and 1 / 0  # the step counts, its process ends behind it
    with pytest.raises(Exception):
        run(engine)
    again = build("state")
    assert again.snapshot("v").to_dict() == {(5, 10): 1}
    assert run(again) == {(5, 10): 1}  # the batch comes again and is skipped
    spark.range(5, 6).selectExpr("CAST(id AS INT) AS a").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    with pytest.raises(Exception, match="open it on the folder"):
        run(build("other"))
    assert run(again) == {(6, 15): 1}


def test_joins_over_joins_follow_the_change(spark):
    """A change of c meets only rows of a and b that its keys lead to: no join of a and b as a whole is planned."""
    engine = Engine(spark)
    for name in "abc":
        engine.create_table(name, "k INT, j INT, v INT")
    engine.sql("SELECT a.v AS x, b.v AS y, c.v AS w FROM a JOIN b ON a.k = b.k JOIN c ON b.j = c.j", "v")
    engine.sql("SELECT a.k, COUNT(*) AS n FROM a JOIN b ON a.k = b.k JOIN c ON b.j = c.j GROUP BY a.k", "g")
    rng, t = random.Random(3), "k INT, j INT, v INT"
    rows = lambda n: [(rng.randint(0, 9), rng.randint(0, 9), rng.randint(0, 99)) for _ in range(n)]
    engine.push("a", z(spark, t, rows(60))).push("b", z(spark, t, rows(60))).step()
    program = engine.views["v"].program
    engine.tables["c"].log.stage(z(spark, t, [(1, 4, 0)]).df)
    written = []
    whole, engine.store.part = engine.store.part, lambda df, name, tracked=(): written.append((df, whole(df, name, tracked))) or written[-1][1]
    program.delta(engine.views["v"].plan)
    engine.store.part = whole
    b_rows = [df for df, (_, segment) in written if "LeftSemi" in df._jdf.queryExecution().optimizedPlan().toString()]
    assert b_rows and all("Inner" not in df._jdf.queryExecution().optimizedPlan().toString() for df in b_rows)
    engine.tables["c"].log.abort()
    program.abort()
    for changed in "cab":
        engine.push(changed, z(spark, t, rows(4))).step()
        engine.push("b", z(spark, t, rows(2))).push("c", z(spark, t, rows(2))).step()
        for name in "vg":
            assert engine.snapshot(name).to_dict() == ZSet(engine._recompute(engine.views[name], "old")).to_dict()


def test_logs_merge_by_size_and_files_go(spark, tmp_path):
    engine = Engine(spark, folder=f"file://{tmp_path}/state")
    engine.create_table("t", "a INT")
    engine.sql("SELECT a % 3 AS k, COUNT(*) AS n, MAX(a) AS m FROM t GROUP BY a % 3", "v")
    engine.push("t", ZSet(spark.range(5000).selectExpr("CAST(id AS INT) AS a"))).step()
    base = engine.tables["t"].log.segments[0].path
    for i in range(12):
        engine.push("t", z(spark, "a INT", [(5000 + i,), (i,)], [1, -1])).step()
    log = engine.tables["t"].log
    assert log.segments[0].path == base and len(log.segments) < 8  # the base is never rewritten for small changes
    assert engine.snapshot("v").to_dict() == ZSet(engine._recompute(engine.views["v"], "old")).to_dict()
    assert engine.snapshot("v").to_dict() == {(0, 1667, 5010): 1, (1, 1667, 5011): 1, (2, 1666, 5009): 1}
    names = os.listdir(tmp_path / "state")
    assert not any("-part-" in n for n in names) and len(names) < 40 and len(os.listdir(tmp_path / "state" / "manifest")) <= 4
    engine.reset()
    engine.push("t", z(spark, "a INT", [(1,)])).step()
    assert engine.snapshot("v").to_dict() == {(1, 1, 1): 1}


def test_steps_open_only_files_within_the_range_of_their_keys(spark):
    """Keys that come with time: a change of the last days leaves segments of the days before alone, in joins, groups and windows."""
    o, l = "k BIGINT, day DATE, c STRING", "k BIGINT, q INT"
    engine = Engine(spark)
    engine.create_table("o", o)
    engine.create_table("l", l)
    texts = {
        "j": "SELECT o.k, day, q FROM o JOIN l ON o.k = l.k WHERE q > 0",
        "a": "SELECT k, SUM(q) AS s, MAX(q) AS m FROM l GROUP BY k",
        "d": "SELECT day, COUNT(*) AS n FROM o GROUP BY day",
        "w": "SELECT k, day, ROW_NUMBER() OVER (PARTITION BY day ORDER BY k) AS r FROM o",
        "f": "SELECT o.k, l.q FROM o LEFT JOIN l ON o.k = l.k",
        "n": "SELECT a.k, s, day FROM a JOIN o ON a.k = o.k",
    }
    for name, text in texts.items():
        engine.sql(text, name)
    day = lambda t: dt.date(2024, 1, 1 + t)
    for t in range(4):
        engine.push("o", z(spark, o, [(100 * t + i, day(t), "x") for i in range(5)] + ([(None, None, "x")] if t == 1 else [])))
        engine.push("l", z(spark, l, [(100 * t + i % 5, i) for i in range(9)] + ([(None, 7)] if t == 2 else []))).step()
    first = {s.path for log in (*(t.log for t in engine.tables.values()), *(g for v in engine.views.values() if v.program for g in v.program.logs.values())) for s in log.segments[:1]}
    opened, whole = set(), engine.store.read
    engine.store.read = lambda schema, segments: opened.update(s.path for s in segments) or whole(schema, segments)
    engine.push("o", z(spark, o, [(305, day(3), "y")])).push("l", z(spark, l, [(305, 1), (303, 8)], [1, -1])).step()
    engine.store.read = whole
    assert opened and not opened & first
    for rows, weights in (([(None, 7), (0, 0)], [-1, 1]), ([(203, 3), (None, 9)], [1, 1])):
        engine.push("l", z(spark, l, rows, weights)).push("o", z(spark, o, [(None, day(2), "y"), (7, None, "z")])).step()
        for name in texts:
            assert engine.snapshot(name).to_dict() == ZSet(engine._recompute(engine.views[name], "old")).to_dict(), name


def test_operators_are_measured_by_what_they_write(spark):
    engine = Engine(spark)
    engine.create_table("t", "a INT, b INT")
    engine.sql("SELECT a, COUNT(*) AS n FROM t WHERE b > 0 GROUP BY a", "v")
    engine.set_metrics_enabled(True)
    engine.push("t", z(spark, "a INT, b INT", [(1, 1), (1, 2), (2, 3), (2, 0)])).step()
    engine.push("t", z(spark, "a INT, b INT", [(1, 5)])).step()
    found = {k.split(" ")[-1] if "Agg" not in k else "Aggregate": m for k, m in engine.metrics().items() if k.startswith("v/")}
    assert found["Filter"].rows == 4 and found["Filter"].steps == 2 and found["Input"].rows == 5
    assert found["Aggregate"].rows == 4 and all(ms > 0 for ms in found["Aggregate"].each_ms)
    assert engine.snapshot("v").to_dict() == {(1, 3): 1, (2, 1): 1}


def test_limits_over_insertions_and_retractions(spark):
    engine = Engine(spark)
    engine.create_table("t", "a INT, b STRING")
    t = "a INT, b STRING"
    texts = {"top": "SELECT a, b FROM t ORDER BY a DESC LIMIT 2", "off": "SELECT a, b FROM t ORDER BY a DESC, b LIMIT 2 OFFSET 1"}
    for name, text in texts.items():
        engine.sql(text, name)
    engine.push("t", z(spark, t, [(1, "p"), (5, "q"), (3, "r")])).step()
    engine.push("t", z(spark, t, [(4, "s"), (0, "u")])).step()
    assert engine.output("top").to_dict() == {(3, "r"): -1, (4, "s"): 1}
    assert engine.snapshot("off").to_dict() == {(4, "s"): 1, (3, "r"): 1}
    engine.push("t", z(spark, t, [(5, "q"), (4, "s")], [-1, -1])).step()
    assert engine.snapshot("top").to_dict() == {(3, "r"): 1, (1, "p"): 1} and engine.snapshot("off").to_dict() == {(1, "p"): 1, (0, "u"): 1}


def test_recompute_mode_agrees(spark):
    text = "SELECT dept, COUNT(*) AS n FROM emp GROUP BY dept"
    outputs = []
    for mode in ("incremental", "recompute"):
        engine = Engine(spark, mode=mode)
        engine.create_table("emp", EMP)
        engine.sql(text, "v")
        seen = []
        for rows, w in (([(1, "x", 1), (2, "x", 2)], [1, 1]), ([(1, "x", 1), (3, None, 1)], [-1, 1])):
            engine.push("emp", z(spark, EMP, rows, w)).step()
            seen.append((engine.output("v").to_dict(), engine.snapshot("v").to_dict()))
        outputs.append(seen)
        engine.close()
    assert outputs[0] == outputs[1]


def semi_joins(df):
    """The right sides of the left-semi joins in a frame's optimized plan."""
    left, out = [df._jdf.queryExecution().optimizedPlan()], []
    while left:
        node = left.pop()
        if node.nodeName() == "Join" and node.joinType().toString() == "LeftSemi":
            out.append(node.children().apply(1))
        left += [node.children().apply(i) for i in range(node.children().size())]
    return out


def test_old_states_meet_each_touched_group_once(spark, monkeypatch):
    """A change of many rows of few groups goes to the groups' states as few keys, not as its rows in a task for each group."""
    engine, seen = Engine(spark), []
    engine.create_table("emp", EMP)
    engine.sql("SELECT dept, SUM(salary) AS s, COUNT(*) AS n FROM emp GROUP BY dept", "v")
    engine.push("emp", z(spark, EMP, [(i, "ab"[i % 2], i) for i in range(10)])).step()
    whole = engine.store.write
    monkeypatch.setattr(engine.store, "write", lambda df, *more: seen.extend(semi_joins(df)) or whole(df, *more))
    engine.push("emp", z(spark, EMP, [(i, "ab"[i % 2], i) for i in range(10, 20)])).step()
    assert seen and all("Aggregate" in (x.nodeName(), x.children().apply(0).nodeName()) for x in seen)
    assert engine.snapshot("v").to_dict() == {("a", 90, 10): 1, ("b", 100, 10): 1}


def test_partitions_follow_the_rows(spark, monkeypatch):
    """Shuffles of a step, and of reading a view with retractions, have partitions for the rows at hand; the settings stay."""
    from rillset.operators import state

    monkeypatch.setattr(state, "PARTITION_ROWS", 10)
    names, seen = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes"), []
    before, engine = [spark.conf.get(n) for n in names], Engine(spark)
    engine.create_table("emp", EMP)
    engine.sql("SELECT a.id AS i, b.id AS j FROM emp a LEFT JOIN emp b ON a.id = b.salary", "v")
    whole = engine.store.write
    monkeypatch.setattr(engine.store, "write", lambda df, *more: seen.append([df.sparkSession.conf.get(n) for n in names]) or whole(df, *more))
    rows = [(i, "a", i + 1) for i in range(200)]
    engine.push("emp", z(spark, EMP, rows)).step()
    assert [str(20), str(state.PARTITION_BYTES)] in seen and [spark.conf.get(n) for n in names] == before
    engine.push("emp", z(spark, EMP, rows[:1], [-1])).step()
    assert engine.rows("v").rdd.getNumPartitions() >= 20
    assert sorted(map(tuple, engine.rows("v").collect())) == sorted((i, i - 1 if i > 1 else None) for i in range(1, 200))
