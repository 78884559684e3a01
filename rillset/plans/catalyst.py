"""The one module that touches Catalyst objects: walking optimized plans and running single nodes over other inputs.

A node of a view's optimized plan is run over any DataFrames with the columns of its children: their columns are given
the expression ids that the node expects, the node takes them as its children, and the result is a DataFrame again. So
operators keep Spark's own semantics, and nothing here interprets an expression.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession


class Catalyst:
    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark._jvm
        catalyst = self.jvm.org.apache.spark.sql.catalyst
        # looking a class up is a call to the JVM for each part of its name
        self._alias, self._fresh_id = catalyst.expressions.Alias, catalyst.expressions.NamedExpression.newExprId
        self._project, self._aggregate = catalyst.plans.logical.Project, catalyst.plans.logical.Aggregate
        self._equi_join, self._taken_apart = catalyst.planning.ExtractEquiJoinKeys, catalyst.planning.PhysicalAggregation
        self._to_seq, self._of_rows = self.jvm.org.apache.spark.api.python.PythonUtils.toSeq, self.jvm.org.apache.spark.sql.classic.Dataset.ofRows
        self._none, self._empty, self.identity = self.jvm.scala.Option.empty(), self.seq([]), self.jvm.System.identityHashCode

    def seq(self, items: list) -> Any:
        return self._to_seq(items)

    @staticmethod
    def items(seq: Any) -> list:
        return [seq.apply(i) for i in range(seq.size())]

    def optimized(self, df: DataFrame) -> Any:
        return df._jdf.queryExecution().optimizedPlan()

    @staticmethod
    def kind(node: Any) -> str:
        return node.getClass().getSimpleName().rstrip("$")

    def children(self, node: Any) -> list:
        return self.items(node.children())

    def output(self, node: Any) -> list:
        return self.items(node.output())

    def private_session(self) -> SparkSession:
        """A session with the settings, views and functions that this one has now, whose own later ones stay apart."""
        return SparkSession(self.spark.sparkContext, self.spark._jsparkSession.cloneSession())

    def calls(self, df: DataFrame, kinds: set[str], functions: set[str]) -> bool:
        """Whether the analyzed plan of df holds an expression of one of the classes, or calls one of the SQL functions."""

        def in_expression(e: Any) -> bool:
            kind = self.kind(e)
            if kind in kinds or (kind in ("SQLScalarFunction", "SQLFunctionExpression") and e.function().name().funcName().lower() in functions):
                return True
            return any(map(in_expression, self.items(e.children()))) or (hasattr(e, "plan") and "Subquery" in kind and in_plan(e.plan()))

        def in_plan(node: Any) -> bool:
            return any(map(in_expression, self.items(node.expressions()))) or any(map(in_plan, [*self.children(node), *self.items(node.innerChildren())]))

        return in_plan(df._jdf.queryExecution().analyzed())

    def frame(self, plan: Any) -> DataFrame:
        return DataFrame(self._of_rows(self.spark._jsparkSession, plan), self.spark)

    def alias(self, child: Any, name: str, expr_id: Any = None) -> Any:
        return self._alias(child, name, expr_id or self._fresh_id(), self._empty, self._none, self._empty)

    def bind(self, df: DataFrame, attributes: list) -> tuple[Any, list]:
        """A plan over df whose first columns carry the ids of the attributes, and the attributes of df's other columns."""
        plan = df._jdf.queryExecution().analyzed()
        out = self.output(plan)
        named = [self.alias(out[i], a.name(), a.exprId()) for i, a in enumerate(attributes)]
        more = [self.alias(o, o.name()) for o in out[len(attributes) :]]
        bound = self._project(self.seq([*named, *more]), plan)
        return bound, self.output(bound)[len(attributes) :]

    def over(self, node: Any, inputs: list[DataFrame]) -> DataFrame:
        """The node over other inputs, which have exactly the columns of its children."""
        bound = [self.bind(df, self.output(child))[0] for df, child in zip(inputs, self.children(node), strict=True)]
        return self.frame(node.withNewChildren(self.seq(bound)))

    def above(self, node: Any, base: Any, df: DataFrame) -> DataFrame:
        """The single-child nodes from node down to base, over other rows of base."""

        def rebuilt(x: Any) -> Any:
            if self.identity(x) == self.identity(base):
                return self.bind(df, self.output(base))[0]
            return x.withNewChildren(self.seq([rebuilt(self.children(x)[0])]))

        return self.frame(rebuilt(node))

    def carried(self, node: Any, inputs: list[DataFrame]) -> DataFrame:
        """A Filter, Project or Join over inputs with one more column each, which come last in the result."""
        pairs = [self.bind(df, self.output(child)) for df, child in zip(inputs, self.children(node), strict=True)]
        plans, more = [p for p, _ in pairs], [a for _, extra in pairs for a in extra]
        if self.kind(node) == "Project":
            return self.frame(self._project(self.seq([*self.items(node.projectList()), *more]), plans[0]))
        new = node.withNewChildren(self.seq(plans))
        return self.frame(self._project(self.seq([*self.output(node), *more]), new))

    def evaluate(self, child: Any, df: DataFrame, columns: list[tuple[Any, str]]) -> DataFrame:
        """Expressions over the child's columns, evaluated on df, then df's further columns."""
        plan, more = self.bind(df, self.output(child))
        return self.frame(self._project(self.seq([*[self.alias(e, n) for e, n in columns], *more]), plan))

    def results(self, expressions: list, attributes: list, df: DataFrame) -> DataFrame:
        """Named expressions over attributes, for which the first columns of df stand, then df's further columns."""
        plan, more = self.bind(df, attributes)
        return self.frame(self._project(self.seq([*expressions, *more]), plan))

    def aggregation(self, node: Any) -> tuple[list, list, list] | None:
        """The grouping expressions, aggregate calls and result expressions of an Aggregate, as Spark's planner takes them apart."""
        found = self._taken_apart.unapply(node)
        if not found.isDefined():
            return None
        parts = found.get()
        return self.items(parts._1()), self.items(parts._2()), self.items(parts._3())

    def keyed_aggregate(self, node: Any, df: DataFrame) -> DataFrame:
        """An Aggregate over df, which has the columns of its child, with the grouping expressions g0, g1, ... before its own columns."""
        keys = [self.alias(g, f"g{i}") for i, g in enumerate(self.items(node.groupingExpressions()))]
        bound = self.bind(df, self.output(self.children(node)[0]))[0]
        made = self._aggregate(node.groupingExpressions(), self.seq([*keys, *self.items(node.aggregateExpressions())]), bound, self._none)
        return self.frame(made)

    def position(self, expression: Any, attributes: list) -> int | None:
        """The place of an attribute among others, None for other expressions."""
        if self.kind(expression) != "AttributeReference":
            return None
        ids = [a.exprId().id() for a in attributes]
        own = expression.exprId().id()
        return ids.index(own) if own in ids else None

    def equi_keys(self, join: Any) -> tuple[list, list] | None:
        """The left and right keys of a join's equalities, None without any."""
        found = self._equi_join.unapply(join)
        if not found.isDefined():
            return None
        keys = found.get()
        return self.items(keys._2()), self.items(keys._3())
