"""Handles of plans: their text, their parts, and the figures that Spark kept while it ran them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame


def _seq(s: Any) -> list[Any]:
    return [s.apply(i) for i in range(s.size())]


class LogicalPlan:
    """A logical plan; ``df`` runs it."""

    def __init__(self, df: DataFrame, node: Any = None, optimized: bool = False):
        self.df, self.optimized = df, optimized
        q = df._jdf.queryExecution()
        self._node = node if node is not None else q.optimizedPlan() if optimized else q.analyzed()

    def inputs(self) -> list[LogicalPlan]:
        return [LogicalPlan(self.df, c, self.optimized) for c in _seq(self._node.children())]

    def name(self) -> str:
        return self._node.nodeName()

    def display(self) -> str:
        """The node alone."""
        return str(self._node.simpleString(200))

    def display_indent(self) -> str:
        return str(self._node.treeString())

    def display_indent_schema(self) -> str:
        return str(self._node.treeString(True, True, 200, False))

    def display_graphviz(self) -> str:
        lines, number = ["digraph {"], 0

        def add(p: LogicalPlan) -> int:
            nonlocal number
            me, number = number, number + 1
            label = p.name().replace('"', "'")
            lines.append(f'  {me}[shape=box label="{label}"]')
            for c in p.inputs():
                lines.append(f"  {me} -> {add(c)}")
            return me

        add(self)
        return "\n".join([*lines, "}"])

    __str__ = __repr__ = display_indent

    def __contains__(self, text: str) -> bool:
        return text in self.display_indent()

    def __eq__(self, other: object) -> bool:
        return isinstance(other, LogicalPlan) and bool(self._node.sameResult(other._node))

    def __hash__(self) -> int:
        return self._node.semanticHash()


@dataclass(frozen=True)
class Metric:
    name: str
    value: int
    node: str


class MetricsSet:
    """The figures of one operator, or of a whole plan."""

    def __init__(self, metrics: list[Metric]):
        self._metrics = metrics

    def metrics(self) -> list[Metric]:
        return list(self._metrics)

    def sum_by_name(self, name: str) -> int | None:
        found = [m.value for m in self._metrics if m.name == name]
        return sum(found) if found else None

    @property
    def output_rows(self) -> int | None:
        return self.sum_by_name("numOutputRows")

    @property
    def elapsed_compute(self) -> int | None:
        """Nanoseconds of the pipelines."""
        ms = [m.value for m in self._metrics if m.name in ("pipelineTime", "aggTime", "sortTime", "scanTime")]
        return sum(ms) * 1_000_000 if ms else None

    @property
    def spill_count(self) -> int:
        """Operators that spilled."""
        return sum(m.name == "spillSize" and m.value > 0 for m in self._metrics)

    @property
    def spilled_bytes(self) -> int:
        return self.sum_by_name("spillSize") or 0

    def __repr__(self) -> str:
        return f"MetricsSet({', '.join(f'{m.node}.{m.name}={m.value}' for m in self._metrics)})"


class ExecutionPlan:
    """A physical plan. Its figures are filled by ``run``, or by any action on the frame that it belongs to."""

    def __init__(self, df: DataFrame, node: Any = None):
        self.df = df
        self._node = node if node is not None else df._jdf.queryExecution().executedPlan()

    def children(self) -> list[ExecutionPlan]:
        kind = self._node.getClass().getSimpleName()
        nodes = [self._node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [self._node.plan()] if kind.endswith("QueryStageExec") else _seq(self._node.children())
        return [ExecutionPlan(self.df, n) for n in nodes]

    def name(self) -> str:
        return self._node.nodeName().strip()

    def display(self) -> str:
        return str(self._node.simpleString(200))

    def display_indent(self) -> str:
        return str(self._node.treeString())

    __str__ = __repr__ = display_indent

    def __contains__(self, text: str) -> bool:
        return text in self.display_indent()

    @property
    def partition_count(self) -> int:
        return self.df.rdd.getNumPartitions()

    def _walk(self) -> Iterator[ExecutionPlan]:
        yield self
        for c in self.children():
            yield from c._walk()

    def metrics(self) -> MetricsSet:
        """Of this operator."""
        out, it = [], self._node.metrics().iterator()
        while it.hasNext():
            pair = it.next()
            out.append(Metric(pair._1(), int(pair._2().value()), self.name()))
        return MetricsSet(out)

    def collect_metrics(self) -> list[tuple[str, MetricsSet]]:
        """Of all operators, from the top down."""
        return [(p.name(), m) for p in self._walk() if (m := p.metrics()).metrics()]

    def run(self) -> MetricsSet:
        """Run the plan, drop the rows, and return all figures."""
        # The frame's own plan runs, so that the figures are its.
        self.df._jdf.queryExecution().toRdd().count()
        return MetricsSet([m for _, s in self.collect_metrics() for m in s.metrics()])
