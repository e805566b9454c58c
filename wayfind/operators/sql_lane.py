"""The SQL lane: plan guard, execution with a row cap, extraction from model output, template rules and one repair."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.operators.authority import Refused, analysed_plan, authorise

ROW_CAP = 200
STATEMENT_SECONDS = 8.0

#: Plan nodes that read. Anything else (commands, inserts, DDL) is refused.
READING_NODES = set(
    "Aggregate AsOfJoin CTERelationDef CTERelationRef Deduplicate Distinct Except Expand Filter Generate GlobalLimit "
    "Intersect Join LateralJoin LocalLimit LocalRelation OneRowRelation Pivot Project Range RepartitionByExpression "
    "Repartition Sample Sort SubqueryAlias Tail Union Unpivot UnresolvedHaving UnresolvedInlineTable UnresolvedRelation "
    "UnresolvedSubqueryColumnAliases UnresolvedWith WithWindowDefinition Window UnresolvedTableValuedFunction "
    "UnresolvedTVFAliases Offset RebalancePartitions UnresolvedHint Hint WithCTE UnresolvedOrdinal".split()
)
#: Functions that reach out of the data.
REFLECTION = {"java_method", "reflect", "try_reflect"}


def _inner(node) -> Iterable:
    for way in ("children", "innerChildren"):
        found = getattr(node, way)()
        for i in range(found.size()):
            yield found.apply(i)


def _subplans(node) -> Iterable:
    expressions = node.expressions()
    found = [expressions.apply(i) for i in range(expressions.size())]
    if node.getClass().getSimpleName() == "WithWindowDefinition":  # a map, which expressions() passes over
        defined = node.windowDefinitions().values().toSeq()
        found += [defined.apply(i) for i in range(defined.size())]
    for one in found:
        stack = [one]
        while stack:
            e = stack.pop()
            yield "expression", e
            if e.getClass().getSimpleName() in ("ScalarSubquery", "ListQuery", "Exists", "InSubquery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"):
                if hasattr(e, "plan") and e.getClass().getSimpleName() != "InSubquery":
                    yield "plan", e.plan()
            children = e.children()
            stack += [children.apply(k) for k in range(children.size())]


def guard(spark: SparkSession, sql: str, views: Iterable[str] | None = None, functions: Iterable[str] = ()) -> str:
    """The statement, if its whole plan only reads registered views (or the given ones); Refused otherwise.

    The text is parsed, not matched: comments and semicolons inside literals are harmless, and a WITH that ends in INSERT
    is refused. Names that are not plain views (paths, other catalogs) are refused too. A WITH query hides a table of its name
    only where the WITH query can be seen. What passes is analysed, and the analysed plan decides (authority): views by their
    resolved names, functions by what they turned out to be. An analysis error is raised as it is.

    functions: names of registered functions of the user that may be called.
    """
    sensitive = spark.conf.get("spark.sql.caseSensitive") == "true"
    fold = (lambda n: n) if sensitive else str.lower
    allowed = {fold(v) for v in (views if views is not None else (t.name for t in spark.catalog.listTables() if t.isTemporary))}
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:  # a Java parse error behind Py4J
        raise Refused(f"not a statement: {str(e).strip().splitlines()[0][:300]}") from e
    unknown: set[str] = set()
    stack: list[tuple] = [(plan, frozenset())]  # with each node the names of the WITH queries that it can see
    while stack:
        node, seen = stack.pop()
        kind = node.getClass().getSimpleName().rstrip("$")
        if kind not in READING_NODES:
            raise Refused(f"{kind} is not allowed")
        if kind == "UnresolvedRelation":
            parts = [node.multipartIdentifier().apply(i) for i in range(node.multipartIdentifier().size())]
            name = fold(".".join(parts))
            if name not in allowed and not (len(parts) == 1 and name in seen):
                unknown.add(name)
        if kind == "UnresolvedTableValuedFunction":
            called = node.name().mkString(".").lower()
            if called not in ("range", "explode", "explode_outer", "posexplode", "inline", "stack"):
                raise Refused(f"{called} is not allowed")
        for what, x in _subplans(node):
            if what == "plan":
                stack.append((x, seen))
            elif x.getClass().getSimpleName() == "UnresolvedFunction" and x.nameParts().last().lower() in REFLECTION:
                raise Refused(f"{x.nameParts().last()} is not allowed")
        if kind == "UnresolvedWith":
            # A WITH query is seen by those after it and by the body, by itself only if it is recursive, and not from outside.
            for i in range(node.cteRelations().size()):
                pair = node.cteRelations().apply(i)
                name = fold(pair._1())
                stack.append((pair._2(), seen | {name} if node.allowRecursion() else seen))
                seen = seen | {name}
            stack.append((node.child(), seen))
            continue
        stack += [(x, seen) for x in _inner(node) if "plans.logical" in x.getClass().getName() or "catalyst.analysis" in x.getClass().getName()]
    if unknown:
        raise Refused(f"unknown or forbidden relation: {', '.join(sorted(unknown))}")
    authorise(analysed_plan(spark, plan), allowed, functions, fold)
    return sql


@dataclass
class SqlResult:
    ok: bool
    rows: list[dict] = field(default_factory=list)
    row_count: int = 0
    columns: list[str] = field(default_factory=list)
    truncated: bool = False
    error: str | None = None


def sql_query(spark: SparkSession, sql: str, views: Iterable[str] | None = None, cap: int = ROW_CAP, seconds: float = STATEMENT_SECONDS) -> SqlResult:
    """Guard, run, and bring at most `cap` rows; row_count is the full count. Never raises: failures are in the result.

    The cap is in the plan, so rows beyond it never reach the driver; the count runs only when it was passed.
    """
    tag, over, late = f"sql-{uuid.uuid4().hex}", threading.Event(), threading.Event()
    context = spark.sparkContext

    def watch() -> None:
        if not over.wait(seconds):
            late.set()
            while not over.wait(0.2):  # again: a plan may start further jobs
                context.cancelJobsWithTag(tag)

    try:
        df = spark.sql(guard(spark, sql, views))
        context.addJobTag(tag)
        context.setInterruptOnCancel(True)
        threading.Thread(target=watch, daemon=True).start()
        rows = df.limit(cap + 1).collect()
        truncated = len(rows) > cap
        total = df.count() if truncated else len(rows)
        return SqlResult(True, [dict(zip(df.columns, r, strict=True)) for r in rows[:cap]], total, df.columns, truncated)
    except Refused as e:
        return SqlResult(False, error=f"refused: {e}")
    except Exception as e:  # whatever the engine says, the caller gets a result
        if late.is_set():
            return SqlResult(False, error=f"cancelled after {seconds:g} s")
        first = str(e).strip().splitlines()[0] if str(e).strip() else type(e).__name__
        return SqlResult(False, error=first[:500])
    finally:
        over.set()
        context.removeJobTag(tag)


def extract_sql(raw: Column) -> Column:
    """The first SELECT or WITH statement in model output: code fence, then `sql:` prefix dropped, up to the semicolon; else null."""
    trimmed = F.btrim(raw, F.lit(" \t\r\n"))
    fenced = F.regexp_extract(trimmed, r"(?is)```(?:sql)?\s*(.*?)```", 1)
    body = F.btrim(F.when(fenced != "", fenced).otherwise(trimmed), F.lit(" \t\r\n"))
    body = F.btrim(F.regexp_replace(body, r"(?i)^sql\s*[:\n]", ""), F.lit(" \t\r\n"))
    found = F.btrim(F.regexp_extract(body, r"(?is)(?<![A-Za-z0-9_])((?:select|with)(?![A-Za-z0-9_])[^;]*)", 1), F.lit(" \t\r\n"))
    return F.when(found != "", found)


#: Patterns that a question must all match, and the statement for it. The first rule that fits holds.
_COLUMNS = "id, user_id, status, amount, created_at"
TEMPLATE_RULES = [
    (["환불", "주문"], f"SELECT {_COLUMNS} FROM orders WHERE status = 'refunded' ORDER BY id"),
    (["취소", "주문"], f"SELECT {_COLUMNS} FROM orders WHERE status = 'cancelled' ORDER BY id"),
    (["주문.*(건수|개수|몇)|(건수|개수|몇).*주문"], "SELECT CAST(count(*) AS INT) AS order_count FROM orders"),
    (["(사용자|회원|유저).*(수|몇|명)"], "SELECT CAST(count(DISTINCT user_id) AS INT) AS user_count FROM orders"),
    (["상태별|(?i)status"], "SELECT status, CAST(count(*) AS INT) AS n FROM orders GROUP BY status ORDER BY status"),
    (["평균", "금액|매출|결제"], "SELECT CAST(round(avg(amount)) AS INT) AS avg_amount FROM orders"),
    (["총|합계|전체", "금액|매출|결제"], "SELECT CAST(sum(amount) AS INT) AS total_amount FROM orders"),
]


def template_sql(question: Column) -> Column:
    """The statement of the first rule that fits the question, else null."""
    q = F.btrim(question, F.lit(" \t\r\n"))
    out = None
    for patterns, sql in TEMPLATE_RULES:
        fits = F.lit(True)
        for p in patterns:
            fits &= q.rlike(p)
        out = F.when(fits, F.lit(sql)) if out is None else out.when(fits, F.lit(sql))
    return out


def template_nl2sql(question: str) -> str | None:
    """The same rules for one question on the driver."""
    q = question.strip()
    return next((sql for patterns, sql in TEMPLATE_RULES if all(re.search(p.replace("|(?i)status", "|[Ss][Tt][Aa][Tt][Uu][Ss]"), q) for p in patterns)), None)


def statement_of(raw: str) -> str | None:
    """extract_sql for one text on the driver."""
    fenced = re.search(r"(?is)```(?:sql)?\s*(.*?)```", raw)
    body = re.sub(r"(?i)^sql\s*[:\n]", "", (fenced[1] if fenced and fenced[1] else raw).strip()).strip()
    found = re.search(r"(?is)(?<![A-Za-z0-9_])((?:select|with)(?![A-Za-z0-9_])[^;]*)", body)
    return found[1].strip() if found else None


def nl2sql_prompt(question: str, card: str, naive: bool = False) -> str:
    """What a model is told to write a statement. card: tables with their columns; naive: table names alone, for comparison."""
    if naive:
        names = ", ".join(re.findall(r"(?m)^\s*([A-Za-z_][A-Za-z0-9_]*)", card))
        return f"Write one SELECT statement for the question.\nTables: {names}\nQuestion: {question}\nSQL:"
    rules = [
        "Write one Spark SQL SELECT statement that answers the question, and nothing else.",
        "Use the tables and columns below and no others; join on the columns whose names match.",
        "Return the columns that the question asks for, in its order; count and sum in the statement.",
        "A question for the most or least of something wants ORDER BY with LIMIT; a period wants a half-open range of dates.",
    ]
    return "\n".join([*rules, "", "Tables:", card, "", f"Question: {question}", "SQL:"])


def model_nl2sql(llm: Callable[[str], str], card: str, naive: bool = False) -> Callable[[str], str | None]:
    """Engine.nl2sql from an injected model: prompt, then the statement in what it says."""
    return lambda question: statement_of(llm(nl2sql_prompt(question, card, naive)))


def columns_of(spark: SparkSession, sql: str) -> dict[str, list[str]]:
    """The views that a statement names, with their columns in order: what a repair is told."""
    names = {t.name for t in spark.catalog.listTables() if t.isTemporary}
    used = [n for n in sorted(names) if re.search(rf"(?<![A-Za-z0-9_]){re.escape(n)}(?![A-Za-z0-9_])", sql, re.IGNORECASE)]
    return {n: spark.table(n).columns for n in used}


def repair(spark: SparkSession, question: str, sql: str, result: SqlResult, fix: Callable[[str, str, str, dict], str | None]) -> tuple[str, SqlResult]:
    """One more try, only if the engine raised: fix(question, sql, error, columns) gives a new statement or None."""
    if result.ok or (result.error or "").startswith("refused"):
        return sql, result
    again = fix(question, sql, result.error or "", columns_of(spark, sql))
    return (again, sql_query(spark, again)) if again else (sql, result)


def render_rows(df: DataFrame, sql: str) -> DataFrame:
    """One text a row, k=v | k=v after the statement, with null spelled out."""
    parts = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null"))) for c in df.columns]
    return df.select(F.concat(F.lit(f"[{sql}] "), F.concat_ws(" | ", *parts)).alias("text"))


__all__ = ["ROW_CAP", "PySparkException", "Refused", "SqlResult", "columns_of", "extract_sql", "guard", "render_rows", "repair", "sql_query", "template_nl2sql", "template_sql"]
