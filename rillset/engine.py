"""The engine: tables take signed changes, views are SQL, and a step turns changes of tables into changes of views."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillset.functions import scalar
from rillset.operators.delta import Program, Source, Unsupported, negated
from rillset.operators.state import Log, Segment, Store, expand, sized
from rillset.plans.catalyst import Catalyst
from rillset.plans.report import Metrics, dot
from rillset.scratch import scratch_root
from rillset.sources.bitemporal import BitemporalSink, ParquetSink
from rillset.types import struct_of
from rillset.udf import AggregateUdf, UdfRegistry, apply_table_udf
from rillset.zset import WEIGHT, ZSet

#: What the text of a query with a clock holds, and the expressions that its plan then holds.
CLOCKED = re.compile(r"event_time|current_date|current_timestamp|current_time|localtimestamp|curdate|now", re.IGNORECASE)
CLOCKS = {"CurrentDate", "CurrentTimestamp", "CurrentTime", "LocalTimestamp", "Now", "CurrentBatchTimestamp", "UnixTimestamp"}
MANIFESTS = "manifest"


class View:
    """A view: how it is made (SQL text, a function, or a table function over a source), its program, content and last change.

    hidden: segments of the sources, by name, that were there before a view without backfill and do not count for it.
    """

    def __init__(self, name: str, sql: str | None, build: Callable[[], DataFrame] | None):
        self.name, self.sql, self.build = name, sql, build
        self.source: Source | None = None
        self.clocked = False
        self.program: Program | None = None
        self.plan = None
        self.table_udf: tuple | None = None
        self.hidden: dict[str, list[Segment]] = {}
        self.why = ""
        self.last: list = []
        self.metrics = Metrics()

    @property
    def log(self) -> Log:
        return self.source.log

    @property
    def definition(self) -> str:
        return self.sql or ("table function" if self.table_udf else "DataFrame plan")


class Engine:
    """One set of tables and views over one Spark session.

    mode 'incremental' takes the delta rules wherever they hold; 'recompute' runs each view's query on old and new tables.
    Names and functions live in a session of the engine's own, made from the given one, so that engines and the user's own
    views never meet. folder keeps the state; an engine that is opened on the folder of an earlier one and given the same
    tables and views goes on where that one's last step ended.
    """

    def __init__(self, spark: SparkSession, mode: str = "incremental", folder: str | None = None):
        if mode not in ("incremental", "recompute"):
            raise ValueError(f"mode {mode}")
        self.spark, self.mode = spark, mode
        if not getattr(spark, "_rillset_functions", False):  # once a session
            scalar.register(spark)
            spark._rillset_functions = True
        self.catalyst = Catalyst(spark)
        self.session = self.catalyst.private_session()
        self.store = Store(spark, folder or scratch_root(spark))
        self.tables: dict[str, Source] = {}
        self.views: dict[str, View] = {}
        self.pending: dict[str, ZSet] = {}
        self.udfs = UdfRegistry(self.session)
        self.sinks: dict[tuple[str, str], BitemporalSink] = {}
        self.steps, self.feeds = 0, {}
        self.event_time: int | None = None
        self.metrics_enabled = False
        self.closed = False
        self.found = self._found() if folder else {}
        self._clock_function()

    def _found(self) -> dict:
        """The last manifest of the folder."""
        names = [n for n in self.store.names(MANIFESTS) if n.endswith(".json")]
        if not names:
            return {}
        found = json.loads(self.store.get(f"{MANIFESTS}/{names[-1]}"))
        self.steps, self.feeds, self.event_time = found["steps"], found["feeds"], found["event_time"]
        return found

    def _manifest(self, feed: tuple[str, int] | None) -> None:
        """Write down what counts once the step at hand does; from here on it has happened."""
        feeds = self.feeds | ({feed[0]: feed[1]} if feed else {})
        saved = {
            "steps": self.steps + 1, "feeds": feeds, "event_time": self.event_time,
            "tables": {k: t.log.saved() for k, t in self.tables.items()},
            "views": {
                k: v.log.saved() | {"definition": v.definition, "last": [s.saved() for s in v.log.staged if s.rows], "hidden": {n: [s.saved() for s in some] for n, some in v.hidden.items()}, "program": v.program.saved(v.plan) if v.program else None}
                for k, v in self.views.items()
            },
            "sinks": {f"{kind} {k}": sink.saved() for (kind, k), sink in self.sinks.items()},
        }
        self.store.put(f"{MANIFESTS}/{self.steps + 1:012d}.json", json.dumps(saved))
        self.steps, self.feeds = self.steps + 1, feeds

    # -- tables -------------------------------------------------------------------------------------------------------
    def create_table(self, name: str, schema: str | T.StructType) -> None:
        """Add a table; in the folder of an earlier engine the table of that name, which must have the same columns."""
        self._free(name)
        source = self._source(name, struct_of(schema))
        if (saved := self.found.get("tables", {}).get(name.lower())) is not None:
            source.log.restore(saved)
        self.tables[name.lower()] = source

    def _source(self, name: str, schema: T.StructType) -> Source:
        log = Log(self.store, name, schema)
        # an RDD stays a leaf of its own in optimized plans, where an empty local table would be folded away
        template = self.session.createDataFrame(self.spark.sparkContext.emptyRDD(), log.data)
        template.createOrReplaceTempView(name)
        return Source(name, template, log, template._jdf.queryExecution().analyzed().rdd().id())

    def _free(self, name: str) -> None:
        if name.lower() in self.tables or name.lower() in self.views:
            raise ValueError(f"{name} exists already")

    def _find(self, name: str) -> Source:
        key = name.lower()
        if key in self.views:
            return self.views[key].source
        if key in self.tables:
            return self.tables[key]
        raise ValueError(f"no table or view {name}")

    # -- functions ----------------------------------------------------------------------------------------------------
    def register_udf(self, name: str, f: Callable, argument_types: Iterable[str | T.DataType], return_type: str | T.DataType, vectorized: bool = False) -> None:
        self.udfs.scalar(name, f, argument_types, return_type, vectorized)

    def register_udaf(self, name: str, f: AggregateUdf, argument_type: str | T.DataType, return_type: str | T.DataType) -> None:
        self.udfs.aggregate(name, f, argument_type, return_type)

    # -- views --------------------------------------------------------------------------------------------------------
    def sql(self, query: str, name: str | None = None, backfill: bool = True) -> str:
        """Add a view; its name (view_<n> unless given) can be read by later views.

        A view of tables that have rows starts with them; without backfill it takes them as not there, now and later.
        """
        return self._add(View(name or f"view_{len(self.views)}", query, None), backfill)

    def dataframe_view(self, build: Callable[[Callable[[str], DataFrame]], DataFrame], name: str | None = None, backfill: bool = True) -> str:
        """A view from a DataFrame plan: build gets a function from table names to DataFrames."""
        return self._add(View(name or f"view_{len(self.views)}", None, lambda: build(self.session.table)), backfill)

    def _add(self, view: View, backfill: bool) -> str:
        self._free(view.name)
        df = self._analyze(view)
        if len(set(map(str.lower, df.columns))) < len(df.columns):
            raise ValueError(f"{view.name}: columns of one name; give each an alias")
        text = view.sql if view.sql is not None else df._jdf.queryExecution().analyzed().toString()
        view.clocked = bool(CLOCKED.search(text)) and self.catalyst.calls(df, CLOCKS, {"event_time"})
        sources = self._sources()
        if not backfill:
            view.hidden = {s.name: list(s.log.segments) for s in sources if s.log.segments}
            self.store.pinned |= {x.path for some in view.hidden.values() for x in some}
        self._program(view, df)
        # only now, so that a refused view leaves nothing behind
        view.source = self._source(view.name, df.schema)
        try:
            if not self._picked_up(view) and backfill and not view.clocked and any(s.log.segments for s in sources):
                view.last = [view.log.stage(self._weighted(self._recompute(view, "old")))]
                if view.program:
                    view.program.seed(view.plan)
                    view.program.commit()
                view.log.commit()
        except Exception:
            view.log.abort()
            self.session.catalog.dropTempView(view.name)
            raise
        self.views[view.name.lower()] = view
        return view.name

    def _picked_up(self, view: View) -> bool:
        """Whether the view, as it is, is one of the engine whose folder this is; it then has that one's content."""
        saved = self.found.get("views", {}).get(view.name.lower())
        if saved is None or saved["definition"] != view.definition:
            return False
        program = saved["program"]
        if (program is None) != (view.program is None) or (program and program["lines"] != view.program.shape(view.plan)):
            return False
        view.hidden = {n: [Segment(*x) for x in some] for n, some in saved["hidden"].items()}
        self.store.pinned |= {x.path for some in view.hidden.values() for x in some}
        if view.program:
            view.program.hidden = self._hidden(view)
            view.program.restore(view.plan, program)
        view.log.restore(saved)
        view.last = [Segment(*x) for x in saved["last"]]
        return True

    def _sources(self) -> list[Source]:
        return [*self.tables.values(), *(v.source for v in self.views.values())]

    def _hidden(self, view: View) -> dict[int, list[Segment]]:
        return {s.leaf_id: view.hidden[s.name] for s in self._sources() if s.name in view.hidden}

    def apply_table_udf(self, name: str, source: str, columns: Sequence[int], f: Callable[..., Iterable[tuple] | None], schema: str | T.StructType) -> str:
        """A view of the rows that f makes of chosen cells (by place) of each row of a table or view."""
        self._free(name)
        found, out = self._find(source), struct_of(schema)
        fields = found.log.data.fieldNames()
        if any(not 0 <= i < len(fields) for i in columns):
            raise IndexError(f"columns {list(columns)} of {len(fields)}")
        view = View(name, None, None)
        view.source = self._source(name, out)
        view.table_udf = (found, [fields[i] for i in columns], f, out)
        if not self._picked_up(view) and found.log.segments:
            view.last = [view.log.stage(ZSet(apply_table_udf(found.log.old(), *view.table_udf[1:])).compact().df)]
            view.log.commit()
        self.views[name.lower()] = view
        return name

    def _analyze(self, view: View) -> DataFrame:
        return self.session.sql(view.sql) if view.sql is not None else view.build()

    def _clock_function(self) -> None:
        t = self._clock()
        self.session.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION event_time() RETURNS BIGINT RETURN {t}L")

    def _clock(self) -> int:
        return self.event_time if self.event_time is not None else int(time.time() * 1000)

    def _program(self, view: View, df: DataFrame) -> None:
        if self.mode == "recompute" and not view.clocked:
            view.why = "mode"
            return
        sources = {s.leaf_id: s for s in self._sources() if s is not view.source}
        program = view.program or Program(self.catalyst, self.store, view.name, sources, self._hidden(view))
        program.sources = sources
        try:
            view.plan = program.prepare(df)
            view.program = program
        except Unsupported as e:
            if view.clocked:
                raise ValueError(f"{view.name}: a view with a clock needs rules of its own, but it has {e}") from None
            view.program, view.plan, view.why = None, None, str(e)
            return
        if view.clocked:
            bad = [rule for _, rule, _ in program.lines(view.plan) if rule not in ("Input", "Project", "Filter", "Union", "Sort", "InnerJoin", "CrossJoin", "Generate")]
            if bad:
                raise ValueError(f"{view.name}: a clock under {bad[0]} would stamp history anew; make the stamped rows a view and read that")

    # -- steps --------------------------------------------------------------------------------------------------------
    def push(self, table: str, changes: ZSet | DataFrame, event_time: int | None = None) -> Engine:
        """Changes for the next step; several before one step add up."""
        key = table.lower()
        if key not in self.tables:
            raise ValueError(f"no table {table}")
        if event_time is not None:
            self.set_event_time(event_time)
        changes = changes if isinstance(changes, ZSet) else ZSet(changes)
        want = self.tables[key].log.data
        if len(changes.columns) != len(want):
            raise ValueError(f"{table} has {len(want)} columns, not {len(changes.columns)}")
        named = changes.df.toDF(*want.fieldNames(), WEIGHT)
        changes = ZSet(named.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in want], WEIGHT))
        self.pending[key] = self.pending[key].add(changes) if key in self.pending else changes
        return self

    def step(self, feed: tuple[str, int] | None = None) -> Engine:
        """Take all pending changes; tables, views and sinks change together or, on an error, nothing does.

        What has happened is what the manifest says, which is the last thing written. After an error the pending changes are
        still there: a further step takes them again, discard() drops them. feed names a stream and the batch that this is.
        """
        if any(v.clocked for v in self.views.values()):
            self._clock_function()
        logs = [self.tables[k].log for k in self.pending]
        programs = [v.program for v in self.views.values() if v.program]
        clock = self._clock()
        try:
            for key, changes in self.pending.items():
                self.tables[key].log.stage(changes.df)
            with sized((self.spark, self.session), sum(x.log.count for x in self._sources())):
                for view in self.views.values():
                    began = time.perf_counter()
                    staged = self._advance(view)
                    if self.metrics_enabled:
                        view.metrics.add((time.perf_counter() - began) * 1000, staged.rows if staged else 0)
                for (kind, key), sink in self.sinks.items():
                    source = self.views[key].source if kind == "view" else self.tables[key]
                    changed = source.log.delta()
                    sink.stage(None if changed is None else ZSet(changed).compact().df, clock)
            self._manifest(feed)
        except Exception:
            for part in [*logs, *(v.log for v in self.views.values()), *programs, *self.sinks.values()]:
                part.abort()
            raise
        for view in self.views.values():
            view.last = [s for s in view.log.staged if s.rows]
        parts = [*logs, *(v.log for v in self.views.values()), *programs, *self.sinks.values()]
        for part in parts:
            part.commit()
        self.pending = {}
        self.store.end_step()
        for part in parts:
            part.tidy()
        self.store.delete([f"{self.store.root}/{MANIFESTS}/{self.steps - 2:012d}.json"])
        return self

    def discard(self) -> Engine:
        """Drop the pending changes."""
        self.pending = {}
        return self

    def _advance(self, view: View):
        if view.table_udf:
            source, columns, f, schema = view.table_udf
            d = source.log.delta()
            return view.log.stage(ZSet(apply_table_udf(d, columns, f, schema)).compact().df) if d is not None else None
        if view.clocked:
            self._program(view, self._analyze(view))
        if view.program is not None:
            view.program.measured = self.metrics_enabled
            d = view.program.delta(view.plan)
            if d is None:
                return None
            d = d.toDF(*view.log.data.fieldNames(), WEIGHT)
            # where nothing can cancel, no shuffle is spent on it
            return view.log.stage(d if view.program.only_adds(view.plan) else ZSet(d).compact().df)
        new = self._weighted(self._recompute(view, "new"))
        return view.log.stage(ZSet(new.toDF(*view.log.data.fieldNames(), WEIGHT)).subtract(ZSet(view.log.old())).compact().df)

    @staticmethod
    def _weighted(df: DataFrame) -> DataFrame:
        return df.withColumn(WEIGHT, F.lit(1).cast("long"))

    def _recompute(self, view: View, version: str) -> DataFrame:
        """The view's query over whole tables and views, as of before or after the step."""
        if view.table_udf:
            source, columns, f, schema = view.table_udf
            return apply_table_udf(self._weighted(source.log.rows(version)), columns, f, schema).drop(WEIGHT)
        readable = [s for s in self._sources() if s is not view.source]
        try:
            for s in readable:
                self._visible(view, s, version).createOrReplaceTempView(s.name)
            df = self._analyze(view)
            df.schema  # resolved against these views from here on
            return df
        finally:
            for s in readable:
                s.template.createOrReplaceTempView(s.name)

    def _visible(self, view: View, s: Source, version: str) -> DataFrame:
        """A source's rows as the view takes them, as a table of the engine's own session."""
        hidden = view.hidden.get(s.name)
        df = expand(s.log.at(version).union(negated(self.store.read(s.log.schema, hidden)))) if hidden else s.log.rows(version)
        return Catalyst(self.session).frame(df._jdf.queryExecution().analyzed())

    # -- results ------------------------------------------------------------------------------------------------------
    def _view(self, which: str | int) -> View:
        if isinstance(which, int):
            return list(self.views.values())[which]
        if which.lower() not in self.views:
            raise ValueError(f"no view {which}")
        return self.views[which.lower()]

    def output(self, which: str | int = 0) -> ZSet:
        """The view's change in the last step."""
        view = self._view(which)
        return ZSet(self.store.read(view.log.schema, view.last))

    def snapshot(self, which: str | int = 0) -> ZSet:
        """The view's content."""
        log = self._view(which).log
        return ZSet(log.old()).compact()

    def rows(self, which: str | int = 0) -> DataFrame:
        """The view's content as plain rows, ordered as its SQL asks where that ends in an ORDER BY."""
        view = self._view(which)
        df = view.log.rows("old")
        if view.plan is not None and self.catalyst.kind(view.plan) == "Sort":
            keys = [o.sql() for o in self.catalyst.items(view.plan.order())]
            df = df.orderBy(*[F.expr(k) for k in keys])
        return df

    def output_count(self) -> int:
        return len(self.views)

    # -- sinks --------------------------------------------------------------------------------------------------------
    def _attach(self, kind: str, name: str, path: str | None) -> BitemporalSink:
        key = name.lower()
        held = self.views if kind == "view" else self.tables
        if key not in held:
            raise ValueError(f"no {kind} {name}")
        source = held[key].source if kind == "view" else held[key]
        sink = ParquetSink(self.store, source.name, source.log.data, path) if path else BitemporalSink(self.store, source.name, source.log.data)
        if (saved := self.found.get("sinks", {}).get(f"{kind} {key}")) is not None:
            sink.restore(saved)
        self.sinks[(kind, key)] = sink
        return sink

    def write_view_to_parquet(self, view: str, path: str) -> None:
        self._attach("view", view, path)

    def write_table_to_parquet(self, table: str, path: str) -> None:
        self._attach("table", table, path)

    def accumulate_view(self, view: str) -> BitemporalSink:
        return self._attach("view", view, None)

    def accumulate_table(self, table: str) -> BitemporalSink:
        return self._attach("table", table, None)

    # -- clock, reports, life -----------------------------------------------------------------------------------------
    def set_event_time(self, t: int | None) -> None:
        self.event_time = t
        self._clock_function()

    def get_event_time(self) -> int:
        return self._clock()

    def set_metrics_enabled(self, on: bool) -> None:
        self.metrics_enabled = on

    def metrics(self) -> dict[str, Metrics]:
        """By view, '<place>:<name>', and by operator, '<view>/<place in the plan> <rule>': steps, milliseconds of its own, rows."""
        out = {f"{i}:{v.name}": v.metrics for i, v in enumerate(self.views.values())}
        for v in self.views.values() if self.metrics_enabled else ():
            for operator, each in (v.program.metrics if v.program else {}).items():
                m = out[f"{v.name}/{operator}"] = Metrics()
                for ms, rows in each:
                    m.add(ms, rows)
        return out

    def to_dot(self) -> str:
        views = {}
        for v in self.views.values():
            if v.table_udf:
                views[v.name] = [(0, "TableUdf", v.name), (1, "Input", v.table_udf[0].name)]
            elif v.program and v.plan is not None:
                views[v.name] = v.program.lines(v.plan)
            else:
                views[v.name] = [(0, "RecomputeDiff", v.why)]
        return dot(views)

    def set_parallelism(self, partitions: int) -> None:
        """Shuffle partitions of the session; adaptive execution coalesces small ones."""
        for session in (self.spark, self.session):
            session.conf.set("spark.sql.shuffle.partitions", str(partitions))

    def reset(self) -> None:
        """Forget all content of tables and views; sinks and pending changes stay."""
        for source in self._sources():
            source.log.clear()
        for v in self.views.values():
            v.last, v.hidden = [], {}
            if v.program:
                v.program.hidden = {}
                v.program.clear()

    def close(self) -> None:
        """Close the sinks; those to Parquet are written now. The state stays in the folder until drop()."""
        if not self.closed:
            for sink in self.sinks.values():
                sink.close(self._clock())
            self.store.end_step()
            self.closed = True

    def drop(self) -> None:
        """Close the engine and delete its folder, all results not yet read included."""
        self.close()
        self.store.pinned = set()
        self.store.delete([self.store.root])

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
