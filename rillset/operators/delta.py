"""Delta rules over the optimized Catalyst plan of a view.

Notation: d is a step's change, old and new the content before and after it, w the weight.

  Filter, Project, Union         applied to d, w carried along
  Generate, Expand and the like  applied to the inserted and the retracted rows of d
  inner and cross Join           d(L) join old(R) + new(L) join d(R), weights multiplied; any condition. A side that is itself
                                 computed is limited to the keys of the change before it is joined
  Aggregate                      a stored state for each group, of which the latest counts. Counts, exact sums and averages add
                                 the change to it; so do MIN, MAX and floating sums where the step only inserts into the group.
                                 All others are computed anew from the group's rows
  Limit                          the stored rows and inserted ones; after a retraction all rows
  Window, outer, semi, anti Join keys touched by d; the node over old and over new rows of these keys; the difference
  anything else                  the node over old and new; the difference

Restricting to touched keys is a left-semi join that Catalyst pushes towards the scans. A node's own semantics always
come from running the node itself.
"""

from __future__ import annotations

import functools
import operator
import time
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillset.operators.state import GroupLog, Log, Range, Segment, Store, expand, has_range, spanned
from rillset.plans.catalyst import Catalyst
from rillset.types import nullable
from rillset.zset import WEIGHT, ZSet

WHOLE = (T.ByteType, T.ShortType, T.IntegerType)
FLOATS = (T.FloatType, T.DoubleType)
ORDERED = ("GlobalLimit", "LocalLimit", "Offset", "Tail")
#: Digits up to which decimals are multiplied by a weight without losing scale.
WIDE = 17


class Source:
    """A table or a view as others read it: a template that stands in plans, and a log of its content."""

    def __init__(self, name: str, template: DataFrame, log: Log, leaf_id: int):
        self.name, self.template, self.log, self.leaf_id = name, template, log, leaf_id


class Unsupported(Exception):
    """A plan that no rule takes; the view is recomputed instead."""


class Measure:
    """An aggregate call that a stored state can maintain: its function, argument and filter, and the type of its argument."""

    def __init__(self, function: str, argument: Any, condition: Any, kind: T.DataType | None):
        self.function, self.argument, self.condition, self.kind = function, argument, condition, kind

    @property
    def fragile(self) -> bool:
        """Whether a retraction cannot be taken back out of the state."""
        return self.function in ("min", "max") or (self.function in ("sum", "average") and isinstance(self.kind, FLOATS))

    @property
    def wide(self) -> bool:
        return isinstance(self.kind, T.DecimalType) and self.kind.precision > WIDE

    def summed(self, x: Column, w: Column) -> Column:
        """The state's part of a change: what the argument's values, each as often as its weight says, add up to."""
        if self.function == "min":
            return F.min(x)
        if self.function == "max":
            return F.max(x)
        if isinstance(self.kind, WHOLE):
            return F.sum(x.cast("long") * w)
        if isinstance(self.kind, T.LongType):
            return F.sum(x.cast("decimal(20,0)") * w.cast("decimal(18,0)")).cast("decimal(38,0)")
        if self.wide:  # weights are 1 and -1 here
            return F.sum(F.when(w > 0, x).otherwise(-x))
        return F.sum(x.cast("double") * w.cast("double") if isinstance(self.kind, FLOATS) else x * w)

    def folded(self, s: Column) -> Column:
        """States of one group as one."""
        return F.min(s) if self.function == "min" else F.max(s) if self.function == "max" else F.sum(s)

    def merged(self, was: Column, more: Column) -> Column:
        if self.function in ("min", "max"):
            return F.least(was, more) if self.function == "min" else F.greatest(was, more)
        if isinstance(self.kind, T.DecimalType):
            # a sum of 38 digits would lose scale
            kind = T.DecimalType(37, self.kind.scale)
            was, more = was.cast(kind), more.cast(kind)
        return F.coalesce(was + more, was, more)

    def value(self, n: Column, s: Column) -> Column:
        if self.function == "count":
            return n
        return F.when(n > 0, s.cast("double") / n if self.function == "average" else s)


def numbered(df: DataFrame) -> DataFrame:
    """The same columns by place: inner results may repeat names."""
    n = len(df.columns)
    return df.toDF(*[f"c{i}" for i in range(n - 1)], WEIGHT)


def weighted(df: DataFrame, w: int) -> DataFrame:
    named = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return named.withColumn(WEIGHT, F.lit(w).cast("long"))


def negated(df: DataFrame) -> DataFrame:
    return df.withColumn(WEIGHT, -F.col(WEIGHT))


def same_keys(left: str, right: str, n: int) -> Column:
    return functools.reduce(operator.and_, [F.col(f"{left}{i}").eqNullSafe(F.col(f"{right}{i}")) for i in range(n)])


class Program:
    """The delta rules of one view. State that rules keep lives in logs, by the node's place in the plan.

    hidden: segments of sources, by leaf, that the view takes as not there.
    """

    def __init__(self, catalyst: Catalyst, store: Store, name: str, sources: dict[int, Source], hidden: dict[int, list[Segment]] | None = None):
        self.c, self.store, self.name, self.sources, self.hidden = catalyst, store, name, sources, hidden or {}
        self.logs: dict[str, Log] = {}
        self.places: dict[int, str] = {}
        self.parts: dict[str, Any] = {}
        self.first, self.steps = True, 0
        self.measured = False
        self.metrics: dict[str, list[tuple[float, int]]] = {}
        self._inner = 0.0

    # -- plans --------------------------------------------------------------------------------------------------------
    def prepare(self, df: DataFrame) -> Any:
        """The optimized plan; raises Unsupported where it holds what stands outside of its own tree."""
        plan = self.c.optimized(df)
        text = plan.toString()
        if any(x in text for x in ("subquery#", "exists#", "list#", "CTERelation")):
            raise Unsupported("sub-queries inside expressions")
        self._check(plan)
        self.places, self.parts = {}, {}
        self._place(plan, "0")
        self._track(plan)
        return plan

    def _track(self, node: Any) -> None:
        """Let sources note the ranges of the columns that the plan joins, groups or parts by."""
        kind, children = self.c.kind(node), self.c.children(node)
        keys: list[list] = []
        if kind == "Join":
            keys = list(self.c.equi_keys(node) or [])
        elif kind in ("Aggregate", "Window"):
            keys = [self._bare(node) if kind == "Aggregate" else self.c.items(node.partitionSpec())]
        for x, own in zip(children, keys):
            for k in own:
                if found := self._leaf_column(x, k):
                    found[0].tracked.add(found[1])
        for x in children:
            self._track(x)

    def _leaf_column(self, node: Any, key: Any) -> tuple[Log, str] | None:
        """The source and column that a key of a node is, where only Projects, Filters and Sorts lie between."""
        while (kind := self.c.kind(node)) in ("Project", "Filter", "Sort"):
            if kind == "Project" and (key := self._below(node, key)) is None:
                return None
            node = self.c.children(node)[0]
        if kind != "LogicalRDD" or (place := self.c.position(key, self.c.output(node))) is None:
            return None
        log = self.sources[node.rdd().id()].log
        field = log.data[place]
        return (log, field.name) if has_range(field.dataType) else None

    def _change_ranges(self, node: Any, keys: list, with_null: bool) -> list[Range | None]:
        """The range of each key in the step's change of a node, None where it is not known."""
        found = [self._leaf_column(node, k) for k in keys]
        return [f and spanned(f[0].staged, f[1], with_null) for f in found]

    def _bounds(self, node: Any, keys: list, ranges: list[Range | None]) -> dict[int, Range]:
        """The ranges of a node's columns, by place, that those of its keys are."""
        places = [self.c.position(k, self.c.output(node)) for k in keys]
        return {p: r for p, r in zip(places, ranges) if p is not None and r is not None}

    def _place(self, node: Any, place: str) -> None:
        self.places[self._identity(node)] = place
        for i, x in enumerate(self.c.children(node)):
            self._place(x, f"{place}.{i}")

    def _identity(self, node: Any) -> int:
        return self.c.identity(node)

    def place(self, node: Any) -> str:
        """A name for a node of the plan at hand, the same whenever the view's plan is."""
        return self.places[self._identity(node)]

    def _check(self, node: Any) -> None:
        kind, children = self.c.kind(node), self.c.children(node)
        if not children and not (kind == "LogicalRDD" and node.rdd().id() in self.sources) and not (kind == "LocalRelation" and node.data().isEmpty()):
            raise Unsupported(f"a leaf of kind {kind}")
        for x in children:
            self._check(x)

    def lines(self, node: Any, depth: int = 0) -> list[tuple[int, str, str]]:
        """(depth, rule, node) of a plan, for reports and drawings."""
        kind, children = self.c.kind(node), self.c.children(node)
        return [(depth, self.rule(node), self.sources[node.rdd().id()].name if kind == "LogicalRDD" else kind), *(y for x in children for y in self.lines(x, depth + 1))]

    def rule(self, node: Any) -> str:
        kind = self.c.kind(node)
        if kind in ("LogicalRDD", "LocalRelation"):
            return "Input"
        if kind in ("Project", "Filter", "Union", "Generate", "Expand", "Sort"):
            return kind
        if kind == "Join":
            how = self.how(node)
            return f"{how}Join" if how in ("Inner", "Cross") or self.c.equi_keys(node) else f"RecomputeDiff({how}Join)"
        if kind == "Aggregate":
            return "Aggregate(partial sums)" if self.measures(node) is not None else "Aggregate(touched groups)"
        if kind in ORDERED:
            return f"{kind}(stored rows)" if self._keeps(node) else f"RecomputeDiff({kind})"
        if kind == "Window":
            return "Window(touched partitions)"
        return f"RecomputeDiff({kind})"

    def how(self, join: Any) -> str:
        return join.joinType().toString()

    # -- content ------------------------------------------------------------------------------------------------------
    def state(self, node: Any, version: str, bounds: dict[int, Range] | None = None) -> DataFrame:
        """The node's content before or after the step: its columns by place, then the weight; not compacted.

        With bounds, ranges of columns by place, rows outside of them, or null there, may be left out.
        """
        kind, children = self.c.kind(node), self.c.children(node)
        if kind == "LogicalRDD":
            log = self.sources[node.rdd().id()].log
            return numbered(self._content(node.rdd().id(), version, {log.data[p].name: r for p, r in (bounds or {}).items() if has_range(log.data[p].dataType)}))
        if kind == "LocalRelation":
            return weighted(self.c.frame(node), 1)
        if kind in ("Project", "Filter"):
            below = bounds or {}
            if kind == "Project" and below:
                out = self.c.output(node)
                made = [(e, r) for p, r in below.items() if (e := self._below(node, out[p])) is not None]
                below = self._bounds(children[0], [e for e, _ in made], [r for _, r in made])
            return numbered(self.c.carried(node, [self.state(children[0], version, below)]))
        if kind == "Sort":
            return self.state(children[0], version, bounds)
        if kind == "Union":
            parts = [self.state(x, version, bounds) for x in children]
            out = parts[0]
            for p in parts[1:]:
                out = out.union(p)
            return out
        if kind == "Join" and self.how(node) in ("Inner", "Cross"):
            return self._product(node, *[self.state(x, version) for x in children])
        if kind == "Aggregate":
            log = self._groups(node)
            groups = log.current(log.at(version, self._group_bounds(node, bounds)))
            return self._group_rows(node, groups.select(*log.keys, "state", F.lit(1).cast("long").alias(WEIGHT)))
        if kind in ORDERED:
            if self._keeps(node):
                return numbered(self._kept(node).at(version))
            return weighted(self._whole_order(node, version), 1)
        return weighted(self.c.over(node, [self._rows(x, version) for x in children]), 1)

    def _group_bounds(self, node: Any, bounds: dict[int, Range] | None) -> dict[str, Range]:
        """The ranges of an Aggregate's columns as those of its groups' keys."""
        if not bounds:
            return {}
        out, named = self.c.output(node), [g.toAttribute() for g in self._taken_apart(node)[0]] if self._taken_apart(node) else []
        places = {p: self.c.position(out[p], named) for p in bounds}
        return {f"g{g}": bounds[p] for p, g in places.items() if g is not None and f"g{g}" in self._groups(node).tracked}

    def _content(self, leaf: int, version: str, within: dict[str, Range] | None = None) -> DataFrame:
        log = self.sources[leaf].log
        if hidden := self.hidden.get(leaf):
            return log.at(version).union(negated(self.store.read(log.schema, hidden)))
        return log.at(version, within)

    def _whole_order(self, node: Any, version: str) -> DataFrame:
        base = self._base(node)
        return self.c.above(node, base, self._rows(base, version))

    def _base(self, node: Any) -> Any:
        """What lies below limits and the sort under them, which only together have a meaning."""
        while self.c.kind(node) in (*ORDERED, "Sort"):
            node = self.c.children(node)[0]
        return node

    def _rows(self, node: Any, version: str, keys: list[Any] | None = None, touched: DataFrame | None = None, ranges: list[Range | None] | None = None) -> DataFrame:
        """The node's content as rows; with keys, only where these expressions take touched values, which lie in the ranges."""
        df = self.state(node, version) if keys is None else self._limited(node, version, keys, touched, ranges)
        return expand(df, self._only_inserts(node))

    def _limited(self, node: Any, version: str, keys: list[Any], touched: DataFrame, ranges: list[Range | None] | None = None) -> DataFrame:
        """The node's content where the keys take touched values (columns t0, t1, ...), whose ranges may be known.

        Below a join the limit goes to the side that has the keys, and from there, by the keys that are left, to the other:
        no join of whole tables is made for a few of its rows.
        """
        kind, children = self.c.kind(node), self.c.children(node)
        ranges = ranges or [None] * len(keys)
        if self._deep(node):
            if kind in ("Project", "Filter", "Sort"):
                below = keys if kind != "Project" else [self._below(node, k) for k in keys]
                if None not in below:
                    df = self._limited(children[0], version, below, touched, ranges)
                    return df if kind == "Sort" else numbered(self.c.carried(node, [df]))
            if kind == "Join" and self.how(node) in ("Inner", "Cross") and (equal := self.c.equi_keys(node)):
                for side in (0, 1):
                    if all(self.c.position(k, self.c.output(children[side])) is not None for k in keys):
                        places = [self.c.position(k, self.c.output(children[side])) for k in equal[side]]
                        near, part = self.store.part(self._limited(children[side], version, keys, touched, ranges), self.name, [f"c{p}" for p in places if p is not None])
                        found = [None if p is None else spanned([part], f"c{p}", False) for p in places]
                        far = self._limited(children[1 - side], version, equal[1 - side], self._touched(children[side], near, equal[side]), found)
                        return self._product(node, *((near, far) if side == 0 else (far, near)))
        return self._restrict(node, self.state(node, version, self._bounds(node, keys, ranges)), keys, touched)

    def _deep(self, node: Any) -> bool:
        kind = self.c.kind(node)
        return kind in ("Join", "Aggregate", "Window") or (kind in ("Project", "Filter", "Sort") and self._deep(self.c.children(node)[0]))

    def _below(self, project: Any, key: Any) -> Any | None:
        """What a Project's output column is made of, None for keys that are more than a column."""
        place = self.c.position(key, self.c.output(project))
        if place is None:
            return None
        e = self.c.items(project.projectList())[place]
        return e.child() if self.c.kind(e) == "Alias" else e

    def _touched(self, node: Any, df: DataFrame, keys: list[Any]) -> DataFrame:
        columns = self.c.evaluate(node, df, [(k, f"t{i}") for i, k in enumerate(keys)])
        return columns.select(*[f"t{i}" for i in range(len(keys))]).distinct()

    def _only_inserts(self, node: Any) -> bool:
        kind, children = self.c.kind(node), self.c.children(node)
        if kind == "LogicalRDD":
            leaf = node.rdd().id()
            return self.sources[leaf].log.only_inserts and not self.hidden.get(leaf)
        return kind in ("Project", "Filter", "Union", "Sort") and all(map(self._only_inserts, children))

    def only_adds(self, node: Any, node_is_root: bool = True) -> bool:
        """Whether the step's change of the node has insertions alone, or is compact as it is."""
        kind, children = self.c.kind(node), self.c.children(node)
        if kind == "LogicalRDD":
            log = self.sources[node.rdd().id()].log
            return all(s.least > 0 for s in log.staged)
        if kind in ("Project", "Filter", "Union", "Sort", "Generate", "Expand"):
            return all(self.only_adds(x, False) for x in children)
        if node_is_root and kind in ("Aggregate", "Window", "Join", *ORDERED) and not (kind == "Join" and self.how(node) in ("Inner", "Cross")):
            return True
        return kind == "Join" and self.how(node) in ("Inner", "Cross") and self._only_inserts(children[0]) and self._only_inserts(children[1])

    def _restrict(self, node: Any, df: DataFrame, keys: list[Any], touched: DataFrame) -> DataFrame:
        places = [self.c.position(k, self.c.output(node)) for k in keys]
        named = df
        if None in places:
            named = self.c.evaluate(node, df, [*[(a, f"c{i}") for i, a in enumerate(self.c.output(node))], *[(k, f"k{i}") for i, k in enumerate(keys)]])
            columns = [F.col(f"k{i}") for i in range(len(keys))]
        else:
            columns = [F.col(f"c{p}") for p in places]
        condition = functools.reduce(operator.and_, [c.eqNullSafe(F.col(f"t{i}")) for i, c in enumerate(columns)])
        return named.join(touched, condition, "left_semi").select(*df.columns)

    def _product(self, node: Any, left: DataFrame, right: DataFrame) -> DataFrame:
        both = self.c.carried(node, [left.withColumnRenamed(WEIGHT, "wl"), right.withColumnRenamed(WEIGHT, "wr")])
        n = len(both.columns)
        flat = both.toDF(*[f"c{i}" for i in range(n - 2)], "wl", "wr")
        return flat.select(*flat.columns[:-2], (F.col("wl") * F.col("wr")).alias(WEIGHT))

    # -- changes ------------------------------------------------------------------------------------------------------
    def delta(self, node: Any) -> DataFrame | None:
        """The node's change by this step, None where nothing can have changed.

        Where operators are measured, each one's change is written before the next one reads it, so that its time and rows are
        its own.
        """
        if not self.measured:
            return self._delta(node)
        began, outer, self._inner = time.perf_counter(), self._inner, 0.0
        df, rows = self._delta(node), 0
        if df is not None:
            df, segment = self.store.part(df, self.name)
            rows = segment.rows
        whole = time.perf_counter() - began
        self.metrics.setdefault(f"{self.place(node)} {self.rule(node)}", []).append(((whole - self._inner) * 1000, rows))
        self._inner = outer + whole
        return df

    def _delta(self, node: Any) -> DataFrame | None:
        kind, children = self.c.kind(node), self.c.children(node)
        if kind == "LogicalRDD":
            found = self.sources[node.rdd().id()].log.delta()
            return None if found is None else numbered(found)
        if kind == "LocalRelation":
            return None
        if kind == "Sort":
            return self.delta(children[0])
        if kind == "Union":
            parts = [d for d in map(self.delta, children) if d is not None]
            out = parts[0] if parts else None
            for p in parts[1:]:
                out = out.union(p)
            return out
        if kind in ("Project", "Filter"):
            d = self.delta(children[0])
            return None if d is None else numbered(self.c.carried(node, [d]))
        if kind in ("Generate", "Expand"):
            d = self.delta(children[0])
            if d is None:
                return None
            d, _ = self.store.part(d, self.name)
            return self._signed(lambda rows: self.c.over(node, [rows]), d)
        if kind == "Join" and self.how(node) in ("Inner", "Cross"):
            parts = []
            for side, d in enumerate([self.delta(x) for x in children]):
                if d is not None:
                    d, other = self._facing(node, side, d)
                    parts.append(self._product(node, *((d, other) if side == 0 else (other, d))))
            return parts[0].union(parts[1]) if len(parts) == 2 else parts[0] if parts else None
        if kind == "Aggregate":
            return self._aggregate(node)
        if kind == "Window":
            return self._keyed(node, [self.c.items(node.partitionSpec())])
        if kind == "Join":
            keys = self.c.equi_keys(node)
            return self._keyed(node, list(keys) if keys else None)
        if kind in ORDERED:
            return self._ordered(node)
        return self._keyed(node, None)

    def _facing(self, join: Any, side: int, d: DataFrame) -> tuple[DataFrame, DataFrame]:
        """A change of one side of a join, and what it meets of the other: the left side's meets old rows, the right side's new."""
        children, version = self.c.children(join), "old" if side == 0 else "new"
        other, keys = children[1 - side], self.c.equi_keys(join)
        if not keys:
            return d, self.state(other, version)
        ranges = self._change_ranges(children[side], keys[side], False)
        if not self._deep(other):
            return d, self.state(other, version, self._bounds(other, keys[1 - side], ranges))
        d, _ = self.store.part(d, self.name)
        return d, self._limited(other, version, keys[1 - side], self._touched(children[side], d, keys[side]), ranges)

    def _keeps(self, node: Any) -> bool:
        """Whether the rows that limits let through tell, with inserted ones, which they will let through."""
        while self.c.kind(node) in (*ORDERED, "Sort"):
            if self.c.kind(node) in ("Offset", "Tail"):
                return False
            node = self.c.children(node)[0]
        return True

    def _kept(self, node: Any) -> Log:
        place = self.place(node)
        if place not in self.logs:
            fields = [T.StructField(f"c{i}", T._parse_datatype_json_string(a.dataType().json())) for i, a in enumerate(self.c.output(node))]
            self.logs[place] = Log(self.store, f"{self.name}-top", T.StructType(fields))
        return self.logs[place]

    def _ordered(self, node: Any) -> DataFrame | None:
        base = self._base(node)
        d = self.delta(base)
        if d is None:
            return None
        if not self._keeps(node):
            return ZSet(weighted(self._whole_order(node, "new"), 1).union(weighted(self._whole_order(node, "old"), -1))).compact().df
        log = self._kept(node)
        if self.only_adds(base, False):
            rows = expand(log.old(), log.only_inserts).union(expand(numbered(d), True))
            new = self.c.above(node, base, rows)
        else:
            new = self._whole_order(node, "new")
        log.stage(ZSet(weighted(new, 1).union(negated(log.old()))).compact().df)
        found = log.delta()
        return None if found is None else numbered(found)

    def _signed(self, run: Any, d: DataFrame) -> DataFrame:
        """A linear node over the inserted and the retracted rows of a change."""
        flip = d.withColumn(WEIGHT, -F.col(WEIGHT))
        return weighted(run(expand(d, True)), 1).union(weighted(run(expand(flip, True)), -1))

    def _keyed(self, node: Any, keys: list[list[Any]] | None) -> DataFrame | None:
        """The node over old and new rows of the touched keys (one list of key expressions per child; None: all rows)."""
        children = self.c.children(node)
        changes = [self.delta(x) for x in children]
        if all(d is None for d in changes):
            return None
        touched = None
        if keys is not None and any(keys):
            parts = [self._touched(x, d, ks) for x, d, ks in zip(children, changes, keys) if d is not None]
            touched = parts[0]
            for p in parts[1:]:
                touched = touched.union(p)
            names = [f"t{i}" for i in range(len(touched.columns))]
            touched, part = self.store.part(touched.distinct().withColumn(WEIGHT, F.lit(1).cast("long")), self.name, names)
            touched, ranges = touched.drop(WEIGHT), [spanned([part], t, True) for t in names]
        else:
            keys, ranges = None, None

        def run(version: str) -> DataFrame:
            return self.c.over(node, [self._rows(x, version, None if keys is None else ks, touched, ranges) for x, ks in zip(children, keys or children)])

        return ZSet(weighted(run("new"), 1).union(weighted(run("old"), -1))).compact().df

    def _is_global(self, node: Any) -> bool:
        return self.c.kind(node) == "Aggregate" and node.groupingExpressions().size() == 0

    def _starts(self, node: Any) -> bool:
        """An aggregate over all rows has a row even of nothing, from the first step on."""
        return self.first and self._is_global(node)

    # -- aggregates ---------------------------------------------------------------------------------------------------
    def _taken_apart(self, node: Any) -> tuple[list, list, list] | None:
        place = self.place(node)
        if place not in self.parts:
            self.parts[place] = self.c.aggregation(node)
        return self.parts[place]

    def _grouping(self, node: Any) -> list:
        return self.c.items(node.groupingExpressions())

    def _bare(self, node: Any) -> list:
        """The grouping expressions without names."""
        return [g.child() if self.c.kind(g) == "Alias" else g for g in self._grouping(node)]

    def measures(self, node: Any) -> list[Measure] | None:
        """The aggregate calls of the node if a stored state can maintain them all, else None."""
        key = f"measures {self.place(node)}"
        if key not in self.parts:
            self.parts[key] = self._measures(node)
        return self.parts[key]

    def _measures(self, node: Any) -> list[Measure] | None:
        found = self._taken_apart(node)
        if found is None:
            return None
        out = []
        for call in found[1]:
            if self.c.kind(call) != "AggregateExpression" or call.isDistinct():
                return None
            f = call.aggregateFunction()
            function, arguments = self.c.kind(f), self.c.items(f.children())
            condition = call.filter().get() if call.filter().isDefined() else None
            if len(arguments) != 1 or function not in ("Count", "Sum", "Average", "Min", "Max"):
                return None
            kind = None if function == "Count" else T._parse_datatype_json_string(arguments[0].dataType().json())
            if function in ("Sum", "Average") and not isinstance(kind, (*WHOLE, T.LongType, *FLOATS, T.DecimalType)):
                return None
            if (function == "Average" and isinstance(kind, T.DecimalType)) or isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
                return None
            out.append(Measure(function.lower(), arguments[0], condition, kind))
        return out

    def _starts(self, node: Any) -> bool:
        """An aggregate over all rows has a row even of nothing, from the first step on."""
        return self.first and not self._grouping(node)

    def _groups(self, node: Any) -> GroupLog:
        """The log of the node's groups. Its first use in a plan fixes the columns of the state."""
        place = self.place(node)
        if place not in self.logs:
            child, n = self.c.children(node)[0], len(self._grouping(node))
            empty = self._anew(node, self.state(child, "old").limit(0).drop(WEIGHT))
            keys = [f"g{i}" for i in range(n)]
            state = T.StructField("state", nullable(empty.schema["state"].dataType))
            schema = T.StructType([*[empty.schema[k] for k in keys], state, T.StructField("was", state.dataType), T.StructField("seq", T.LongType())])
            self.logs[place] = GroupLog(self.store, f"{self.name}-groups", schema, keys)
        return self.logs[place]

    def _flat(self, node: Any, d: DataFrame, measures: list[Measure]) -> tuple[DataFrame, list[Column]]:
        """(g0, ..., x0, ..., weight) of a change of the node's child, and what is summed up of a group's rows.

        The sums are `rows`, `lost` (whether the change retracts anything), n0, s0, ...
        """
        child, w = self.c.children(node)[0], F.col(WEIGHT)
        if any(m.wide for m in measures):
            d = d.withColumn(WEIGHT, F.explode(F.array_repeat(F.signum(w).cast("long"), F.abs(w).cast("int"))))
        grouping = [(g, f"g{i}") for i, g in enumerate(self._bare(node))]
        wanted = [(m.argument, f"x{i}") for i, m in enumerate(measures)] + [(m.condition, f"f{i}") for i, m in enumerate(measures) if m.condition is not None]
        flat = self.c.evaluate(child, d, [*grouping, *wanted])
        sums: list[Column] = [F.sum(w).alias("rows"), F.max(w < 0).alias("lost")]
        for i, m in enumerate(measures):
            x = F.col(f"x{i}") if m.condition is None else F.when(F.col(f"f{i}"), F.col(f"x{i}"))
            sums.append(F.sum(F.when(x.isNotNull(), w)).alias(f"n{i}"))
            if m.function != "count":
                sums.append(m.summed(x, w).alias(f"s{i}"))
        return flat, sums

    @staticmethod
    def _packed(measures: list[Measure], rows: Column, n: list[Column], s: list[Column | None]) -> Column:
        """A group's state."""
        fields = [rows.cast("long").alias("rows")]
        for i, m in enumerate(measures):
            fields.append(n[i].cast("long").alias(f"n{i}"))
            if s[i] is not None:
                fields.append(s[i].alias(f"s{i}"))
        return F.struct(*fields)

    def _anew(self, node: Any, rows: DataFrame) -> DataFrame:
        """(g0, ..., state) of the groups that rows of the child make."""
        measures, keys = self.measures(node), [f"g{i}" for i in range(len(self._grouping(node)))]
        if measures is None:
            made = self.c.keyed_aggregate(node, rows)
            own = len(made.columns) - len(keys)
            named = made.toDF(*keys, *[f"c{i}" for i in range(own)])
            return named.select(*keys, F.struct(F.lit(1).cast("long").alias("rows"), *[f"c{i}" for i in range(own)]).alias("state"))
        flat, sums = self._flat(node, rows.withColumn(WEIGHT, F.lit(1).cast("long")), measures)
        sums = flat.groupBy(*keys).agg(*sums)
        zero = lambda c: F.coalesce(F.col(c), F.lit(0))
        state = self._packed(measures, zero("rows"), [zero(f"n{i}") for i in range(len(measures))], [None if m.function == "count" else F.col(f"s{i}") for i, m in enumerate(measures)])
        return sums.select(*keys, state.alias("state"))

    def _group_rows(self, node: Any, groups: DataFrame) -> DataFrame:
        """The node's own columns, then the weight, for groups (g0, ..., state, weight)."""
        measures, found = self.measures(node), self._taken_apart(node)
        n = len(self._grouping(node))
        if measures is None:
            return numbered(groups.select(*[F.col(f"state.c{i}") for i in range(len(self.c.output(node)))], WEIGHT))
        calls = [call.resultAttribute() for call in found[1]]
        attributes = [*[g.toAttribute() for g in found[0]], *calls]
        values = [m.value(F.col(f"state.n{i}"), None if m.function == "count" else F.col(f"state.s{i}")).cast(a.dataType().catalogString()).alias(f"v{i}") for i, (m, a) in enumerate(zip(measures, calls))]
        return numbered(self.c.results(found[2], attributes, groups.select(*[f"g{i}" for i in range(n)], *values, WEIGHT)))

    def _aggregate(self, node: Any) -> DataFrame | None:
        child = self.c.children(node)[0]
        d = self.delta(child)
        if d is None and not self._starts(node):
            return None
        log, measures, n = self._groups(node), self.measures(node), len(self._grouping(node))
        d = self.state(child, "new").limit(0) if d is None else d
        keys, bare = log.keys, self._bare(node)
        # what the change says of each group it touches, and whether the group has to be computed anew
        sums, anew, ranges = [], False, self._change_ranges(child, bare, True)
        if measures is None:
            change = self._touched(child, d, bare).toDF(*keys) if n else self.store.spark.range(1).select()
            change = change.withColumn("lost", F.lit(True))
        else:
            change, sums = self._flat(node, d, measures)
        if measures is None or (any(m.fragile for m in measures) and not self.only_adds(child, False)):
            change = change.groupBy(*keys).agg(*sums) if sums else change
            # a group to compute anew weighs -1, so that the written part tells whether there is one
            change, part = self.store.part(change.withColumn(WEIGHT, F.when(F.col("lost"), -1).otherwise(1).cast("long")), self.name, keys)
            ranges = [spanned([part], k, True) for k in keys]
            change, anew = change.drop(WEIGHT), part.least < 0
            folded = {c: measures[int(c[1:])].folded(F.col(c)) if c[0] == "s" else F.sum(c) for c in change.columns if c not in (*keys, "lost")}
            sums = [F.max("lost").alias("lost"), *[f.alias(c) for c, f in folded.items()]]
        both, last = change, []
        if log.segments:
            old = log.old({k: r for k, r in zip(keys, ranges) if r is not None and k in log.tracked})
            if n:
                # distinct, as the rows of one group would all meet in one task
                touched = change.select(*[F.col(k).alias(f"t{i}") for i, k in enumerate(keys)]).distinct()
                old = old.join(touched, same_keys("g", "t", n), "left_semi")
            both, last = old.select(*keys, "state", "seq").unionByName(change, allowMissingColumns=True), log.last()
        if anew:
            again = change.where("lost").select(*[F.col(k).alias(f"t{i}") for i, k in enumerate(keys)])
            rows = self._rows(child, "new", bare, again, ranges) if n else self._rows(child, "new")
            both = both.unionByName(self._anew(node, rows).withColumnRenamed("state", "fresh"), allowMissingColumns=True)
            sums.append(F.first("fresh", ignorenulls=True).alias("fresh"))
        # one aggregation brings a group's last state and its change together
        total = both.groupBy(*keys).agg(*last, *sums).withColumn("was", log.packed() if last else F.lit(None).cast(log.schema["state"].dataType))
        if measures is None:
            state = F.col("fresh")
        else:
            count = lambda c: F.coalesce(F.col(f"was.{c}"), F.lit(0)) + F.coalesce(F.col(c), F.lit(0))
            merged = [None if m.function == "count" else m.merged(F.col(f"was.s{i}"), F.col(f"s{i}")) for i, m in enumerate(measures)]
            state = self._packed(measures, count("rows"), [count(f"n{i}") for i in range(len(measures))], merged).cast(log.schema["state"].dataType)
            state = F.when(state["rows"] > 0, state) if n else state
            state = F.when(F.col("lost"), F.col("fresh")).otherwise(state) if anew else state
        moves = total.select(*keys, state.alias("state"), "was").where(~F.col("state").eqNullSafe(F.col("was")))
        log.stage(moves.withColumn("seq", F.lit(self.steps).cast("long")).withColumn(WEIGHT, F.lit(1).cast("long")))
        found = log.delta()
        if found is None:
            return None
        pair = F.array(*[F.struct(F.col(c).alias("state"), F.lit(w).cast("long").alias("w")) for c, w in (("state", 1), ("was", -1))])
        rows = found.select(*keys, F.explode(pair).alias("x")).where("x.state IS NOT NULL")
        return self._group_rows(node, rows.select(*keys, F.col("x.state").alias("state"), F.col("x.w").alias(WEIGHT)))

    # -- life ---------------------------------------------------------------------------------------------------------
    def seed(self, node: Any) -> None:
        """State of the content at hand, for a view that starts late; the lower nodes' first, which the upper ones read."""
        kind = self.c.kind(node)
        for x in [self._base(node)] if kind in ORDERED else self.c.children(node):
            self.seed(x)
        log = None
        if kind == "Aggregate":
            log = self._groups(node)
            made = self._anew(node, self._rows(self.c.children(node)[0], "old"))
            log.stage(made.withColumn("was", F.lit(None).cast(log.schema["state"].dataType)).withColumn("seq", F.lit(-1).cast("long")).withColumn(WEIGHT, F.lit(1).cast("long")))
        elif kind in ORDERED and self._keeps(node):
            log = self._kept(node)
            log.stage(weighted(self._whole_order(node, "old"), 1))
        if log is not None:
            log.commit()

    def saved(self, plan: Any) -> dict:
        """What a manifest says of the program once the step at hand counts."""
        return {"steps": self.steps + 1, "lines": self.shape(plan), "logs": {place: log.saved() for place, log in self.logs.items()}}

    def shape(self, plan: Any) -> list[list]:
        """The lines of the plan, as a manifest keeps them."""
        if "lines" not in self.parts:
            self.parts["lines"] = [list(x) for x in self.lines(plan)]
        return self.parts["lines"]

    def restore(self, node: Any, saved: dict) -> None:
        if (place := self.place(node)) in saved["logs"]:
            (self._groups(node) if self.c.kind(node) == "Aggregate" else self._kept(node)).restore(saved["logs"][place])
        for x in self.c.children(node):
            self.restore(x, saved)
        self.first, self.steps = False, saved["steps"]

    def commit(self) -> None:
        self.first, self.steps = False, self.steps + 1
        for log in self.logs.values():
            log.commit()

    def tidy(self) -> None:
        for log in self.logs.values():
            log.tidy()

    def abort(self) -> None:
        for log in self.logs.values():
            log.abort()

    def clear(self) -> None:
        self.first = True
        for log in self.logs.values():
            log.clear()
