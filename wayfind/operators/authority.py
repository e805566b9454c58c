"""Who may read what, decided on the analysed plan: names are resolved there, and nothing has run yet.

A statement may read the views that it is given and call the functions that the catalogue brings along. Everything else is
refused: the default is no. What a view itself reads is not looked at; whoever gave the view gave that.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession

#: Nodes of analysed plans that only combine what lies below them.
COMBINING = set(
    "Aggregate AsOfJoin CTERelationDef CTERelationRef Deduplicate Distinct Except Expand Filter Generate GlobalLimit Intersect Join LateralJoin "
    "LocalLimit LocalRelation Offset OneRowRelation Pivot Project Range RebalancePartitions Repartition RepartitionByExpression "
    "ResolvedHint Sample Sort SubqueryAlias Tail Union UnionLoop UnionLoopRef Unpivot Window WithCTE".split()
)
#: Where the catalogue's own expressions live. Functions that users registered come from elsewhere or are wrapped in a ...UDF.
OWN = "org.apache.spark.sql.catalyst.expressions."
#: Own expressions that reach out of the data: Java methods, the user, files and the place of execution.
OUTSIDE = set("CallMethodViaReflection CurrentUser CurrentCatalog CurrentDatabase InputFileName InputFileBlockStart InputFileBlockLength SparkVersion VariableReference GetJavaVersion".split())


class Refused(ValueError):
    """The statement is not a read of the registered views."""


def _all(found) -> Iterator:
    return (found.apply(i) for i in range(found.size()))


def _short(x) -> str:
    return x.getClass().getSimpleName().rstrip("$")


def _expression(e, functions: set[str]) -> Iterator:
    """Refuse what is not allowed among an expression and its parts; gives the plans of its subqueries."""
    stack = [e]
    while stack:
        x = stack.pop()
        name, kind = x.getClass().getName(), _short(x)
        if kind.endswith(("UDF", "UDAF", "UDTF")):
            called = str(x.name())
            if called.lower() not in functions:
                raise Refused(f"function {called} is not allowed")
        elif not name.startswith(OWN) or kind in OUTSIDE:
            raise Refused(f"{kind} is not allowed")
        if kind in ("ScalarSubquery", "ListQuery", "Exists", "LateralSubquery", "FunctionTableSubqueryArgumentExpression", "DynamicPruningSubquery"):
            yield x.plan()
        stack += _all(x.children())


def authorise(analysed, views: Iterable[str], functions: Iterable[str] = (), fold=str.lower) -> None:
    """Raise Refused unless an analysed plan reads the given views alone, by their resolved names, through allowed expressions."""
    allowed, known, stack = {fold(v) for v in views}, {f.lower() for f in functions}, [analysed]
    while stack:
        node = stack.pop()
        kind = _short(node)
        if kind == "View":
            name = node.desc().identifier()
            parts = [p for p in (name.catalog(), name.database()) if p.isDefined()]
            full = fold(".".join([*(p.get() for p in parts), name.table()]))
            if not (node.isTempView() and fold(name.table()) in allowed) and full not in allowed:
                raise Refused(f"unknown or forbidden relation: {full}")
            continue
        if kind not in COMBINING:
            raise Refused(f"{kind} is not allowed")
        for e in _all(node.expressions()):
            stack += _expression(e, known)
        stack += [*_all(node.children()), *(x for x in _all(node.innerChildren()) if ".plans.logical." in x.getClass().getName())]


def analysed_plan(spark: SparkSession, parsed):
    """The plan with all names resolved. Commands are not run by this, but should not come here."""
    jvm = spark._jvm.org.apache.spark.sql.execution
    return spark._jsparkSession.sessionState().executePlan(parsed, getattr(jvm, "CommandExecutionMode").SKIP()).analyzed()
