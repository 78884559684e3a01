"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each full run makes an engine, pushes a table's rows, steps and counts the view. Incremental shapes report seconds a step
for deltas of 1 % of the rows, beside the seconds of recomputing the same query over whole tables and writing its rows, as
a step does. The same deltas over tables of 10 and 30 times the rows (names with x10, x30; not in the total) show how both
grow.
"""

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from rillset.engine import Engine  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
KEY = {"lineitem": "l_orderkey", "orders": "o_orderkey", "customer": "c_custkey"}

FULL = {
    "filter_50": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 25", ["lineitem"]),
    "filter_10": ("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45", ["lineitem"]),
    "project_arith": ("SELECT l_orderkey, l_linenumber, l_quantity + 1 AS a, l_quantity * 2 AS b, l_extendedprice - l_tax AS c FROM lineitem", ["lineitem"]),
    "agg_few_groups": ("SELECT l_returnflag, SUM(l_quantity) AS s, COUNT(*) AS n, AVG(l_quantity) AS a FROM lineitem GROUP BY l_returnflag", ["lineitem"]),
    "agg_many_groups": ("SELECT l_suppkey, SUM(l_quantity) AS s, COUNT(*) AS n FROM lineitem GROUP BY l_suppkey", ["lineitem"]),
    "inner_join": ("SELECT o_orderkey, l_linenumber, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey", ["orders", "lineitem"]),
    "left_join": ("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey", ["customer", "orders"]),
    "filter_group": ("SELECT l_suppkey, COUNT(*) AS n FROM lineitem WHERE l_extendedprice > 500 GROUP BY l_suppkey", ["lineitem"]),
}


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    frames = {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in KEY}

    def engine_of(tables: list[str]) -> Engine:
        e = Engine(spark)
        for t in tables:
            e.create_table(t, frames[t].schema)
        return e

    def full(texts: list[str], tables: list[str]) -> float:
        began = time.perf_counter()
        e = engine_of(tables)
        for i, text in enumerate(texts):
            e.sql(text, f"v{i}")
        for t in tables:
            e.push(t, frames[t])
        e.step()
        for i in range(len(texts)):
            e.output(f"v{i}").df.count()
        took = time.perf_counter() - began
        e.drop()
        return took

    def times(t: str, n: int) -> DataFrame:
        """A table n times, each time with keys of its own."""
        far = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("copy")
        key = [c for c in frames[t].columns if c in KEY.values()]
        moved = frames[t].select("*", far)
        return moved.select(*[(F.col(c) + F.col("copy").cast("long") * 100_000_000).cast(frames[t].schema[c].dataType).alias(c) if c in key else F.col(c) for c in frames[t].columns])

    def steps(text: str, tables: list[str], n: int, scale: int) -> tuple[float, float]:
        """(seconds a step of about 1 % of the plain rows, seconds of one recomputation) after all other rows were pushed."""
        e = engine_of(tables)
        e.sql(text, "v")
        part = {t: F.pmod(F.xxhash64(KEY[t]), F.lit(100)) for t in tables}
        for t in tables:
            rows = times(t, scale) if scale > 1 else frames[t]
            e.push(t, rows.where((part[t] >= n) | (F.col(KEY[t]) >= 100_000_000)))
        e.step()
        began = time.perf_counter()
        for k in range(n):
            for t in tables:
                e.push(t, frames[t].where(part[t] == k))
            e.step()
        took = (time.perf_counter() - began) / n
        again = []
        for _ in range(2):
            began = time.perf_counter()
            e.store.write(e._weighted(e._recompute(e.views["v"], "old")), "again")
            again.append(time.perf_counter() - began)
        e.drop()
        return took, min(again)

    full([FULL["agg_few_groups"][0]], ["lineitem"])  # warm up
    out = {name: round(full([text], tables), 3) for name, (text, tables) in FULL.items()}
    out["two_views_shared_scan"] = round(full([FULL["filter_50"][0], FULL["agg_many_groups"][0]], ["lineitem"]), 3)
    for name, key, n, more in (("incremental_aggregate", "agg_many_groups", 20, 5), ("incremental_join", "inner_join", 10, 5)):
        for scale, count in ((1, n), (10, more), (30, more)):
            step, again = steps(*FULL[key], count, scale)
            end = "" if scale == 1 else f"_x{scale}"
            out[f"{name}_step{end}"], out[f"{name}_recompute{end}"] = round(step, 3), round(again, 3)
    total = sum(v for k, v in out.items() if "_recompute" not in k and "_x" not in k)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(total, 3), "unit": "sec", "queries": out, "sf": os.path.basename(SF.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
