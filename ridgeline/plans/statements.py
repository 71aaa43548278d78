"""What a SQL statement does, read from its parsed plan before anything runs."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import SparkSession

# Parsed plan nodes that only read.
READING = frozenset(
    """Aggregate AsOfJoin Assignment BaseGroupingSets CTERelationDef CTERelationRef Cube Deduplicate Distinct DomainJoin EventTimeWatermark Except Expand Filter Generate GlobalLimit GroupingSets InlineTable Intersect Join LateralJoin
    Limit LocalLimit LocalRelation Offset OneRowRelation ParameterizedQuery NamedParametersQuery PosParameterizedQuery NameParameterizedQuery NaturalJoin Pivot Project Range RebalancePartitions Repartition RepartitionByExpression ResolvedHint ResolvedInlineTable
    ReturnAnswer Rollup Sample Sort Subquery SubqueryAlias Tail Union UnionLoop UnionLoopRef Unpivot UnresolvedHaving UnresolvedHint UnresolvedInlineTable UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedTVFAliases
    UnresolvedTableValuedFunction UnresolvedWith UsingJoin View Window WithCTE WithWindowDefinition
    CurrentNamespace UnresolvedNamespace UnresolvedTable UnresolvedTableOrView UnresolvedView UnresolvedIdentifier UnresolvedFunctionName
    DescribeColumn DescribeRelation DescribeFunction DescribeNamespace ShowColumns ShowCreateTable ShowFunctions ShowNamespaces ShowPartitions ShowTableExtended ShowTables ShowTableProperties ShowViews
    ExplainCommand DescribeQueryCommand DescribeTableCommand ShowTablesCommand""".split()
)
_DDL = ("Create", "Drop", "Alter", "Truncate", "Rename", "Replace", "Analyze", "Repair", "Recover", "Comment", "AddColumns", "AddPartitions", "AddTable")
_DML = ("Insert", "Delete", "Update", "Merge", "Overwrite", "Append", "Load")
# Functions that run code by name.
REFLECTION = frozenset(("java_method", "reflect", "try_reflect"))


def _items(seq: Any) -> list[Any]:
    return [seq.apply(i) for i in range(seq.size())]


def _nodes(plan: Any) -> Iterator[Any]:
    """The plan's nodes, those of its common tables, subqueries and explained statements among them."""
    todo = [plan]
    while todo:
        node = todo.pop()
        yield node
        todo += _items(node.children())
        name = _name(node)
        inner = _items(node.innerChildren())
        todo += [n for n in inner if ".plans.logical." in n.getClass().getName() or ".catalyst.analysis." in n.getClass().getName() or ".execution.command." in n.getClass().getName()]
        if name in ("ExplainCommand", "DescribeQueryCommand"):
            todo.append(node.logicalPlan() if name == "ExplainCommand" else node.plan())


def _name(node: Any) -> str:
    return node.getClass().getName().rsplit(".", 1)[1].split("$")[0]


def _functions(expressions: list[Any]) -> Iterator[str]:
    todo = list(expressions)
    while todo:
        e = todo.pop()
        if _name(e) == "UnresolvedFunction":
            yield e.nameParts().mkString(".").lower()
        todo += _items(e.children())


def parsed(spark: SparkSession, sql: str) -> Any:
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)


def kinds(spark: SparkSession, sql: str) -> dict[str, str]:
    """What the statement holds besides reading: ``ddl``, ``dml`` or ``statements``, each with the name of a node that does it."""
    out: dict[str, str] = {}
    for node in _nodes(parsed(spark, sql)):
        name = _name(node)
        if name not in READING:
            out.setdefault("ddl" if name.startswith(_DDL) else "dml" if name.startswith(_DML) else "statements", name)
    return out


def outside(spark: SparkSession, sql: str) -> str | None:
    """What the statement reaches besides registered relations and plain functions: a path as a table, or a function that runs code by name."""
    for node in _nodes(parsed(spark, sql)):
        if _name(node) == "UnresolvedRelation":
            parts = [str(p) for p in _items(node.multipartIdentifier())]
            if any("/" in p or "\\" in p for p in parts) or len(parts) == 2 and not spark.catalog.databaseExists(parts[0]):
                return ".".join(parts)
        if _name(node) == "UnresolvedTableValuedFunction" and (bad := REFLECTION & {node.name().mkString(".").lower()}):
            return bad.pop()
        for f in _functions(_items(node.expressions())):
            if f.rsplit(".", 1)[-1] in REFLECTION:
                return f
    return None


def plain_expression(spark: SparkSession, text: str) -> bool:
    """Whether an expression calls no function that runs code by name and holds no subquery."""
    e = spark._jsparkSession.sessionState().sqlParser().parseExpression(text)
    if any(f.rsplit(".", 1)[-1] in REFLECTION for f in _functions([e])):
        return False
    todo = [e]
    while todo:
        x = todo.pop()
        if _name(x) in ("ScalarSubquery", "Exists", "InSubquery", "ListQuery", "LateralSubquery"):
            return False
        todo += _items(x.children())
    return True
