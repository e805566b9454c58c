"""Multi-step plans: resolve, graph and SQL steps where each works on what the one before found."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.operators import graph
from wayfind.operators.sql_lane import sql_query

AGGREGATES = {"count": lambda c: F.count("*"), "sum": F.sum, "avg": F.avg, "max": F.max}


def join_aggregate(fact: DataFrame, dim: DataFrame, fk: str, dim_key: str, dim_name: str, names: DataFrame | list[str], agg: str, column: str = "amount") -> DataFrame | None:
    """name, value: an allowed aggregate of the fact rows of each named dimension row; None for one that is not allowed.

    Columns and functions are looked up, never pasted into a statement.
    """
    if agg not in AGGREGATES or not {fk, column} <= set(fact.columns) or not {dim_key, dim_name} <= set(dim.columns):
        return None
    chosen = dim.where(F.col(dim_name).isin(names)) if isinstance(names, list) else dim.join(names.select(F.col("name").alias(dim_name)).distinct(), dim_name, "left_semi")
    chosen = chosen.select(F.col(dim_key).alias("__k"), F.col(dim_name).alias("name"))
    joined = fact.join(chosen, fact[fk] == F.col("__k"))
    return joined.groupBy("name").agg(AGGREGATES[agg](F.col(column)).alias("value"))


@dataclass
class Step:
    name: str
    ok: bool
    detail: str
    rows: list[dict] = field(default_factory=list)


@dataclass
class MultiStepResult:
    steps: list[Step]
    complete: bool

    @property
    def context(self) -> str:
        show = lambda r: r.get("canonical_name") or r.get("name") or str(r)
        return "\n".join(f"[{s.name}] " + (", ".join(map(show, s.rows[:12])) if s.rows else s.detail) for s in self.steps)


def end_points(seeds: DataFrame, relations: DataFrame, entities: DataFrame, rel_types: list[str] | None, depth: int = 1, end_types: list[str] | None = None) -> DataFrame:
    """query_id, id, type, name of the other ends of the edges around the seeds, each once."""
    edges = graph.named_few(graph.graph_expand(seeds, relations, depth, rel_types), entities)
    is_source = F.col("src") == F.col("seed")
    other = lambda a, b: F.when(is_source, F.col(b)).otherwise(F.col(a))
    out = edges.select("query_id", other("src", "dst").alias("id"), other("src_type", "dst_type").alias("type"), other("src_name", "dst_name").alias("name"))
    return (out.where(F.col("type").isin(end_types)) if end_types else out).distinct()


def run_plan(spark: SparkSession, plan: list[dict], text: str, entities: DataFrame, aliases: DataFrame, relations: DataFrame, most: int = 10_000) -> MultiStepResult:
    """Run the steps in order; the first that finds nothing or fails ends the plan. What passes between steps stays a
    DataFrame; a step's record shows at most `most` rows."""
    steps: list[Step] = []
    current: DataFrame = spark.createDataFrame([(0, text)], "query_id long, query string")
    for spec in plan:
        if spec["kind"] == "resolve":
            hits = graph.ontology_search(current, entities, aliases, spec.get("k", 5)).where("rank = 1")
            rows = [r.asDict() for r in hits.collect()]
            if not rows:
                steps.append(Step(spec["name"], False, "no entity found"))
                return MultiStepResult(steps, False)
            steps.append(Step(spec["name"], True, f"{rows[0]['canonical_name']} ({rows[0]['type']})", rows))
            current = hits.select("query_id", F.col("id").alias("seed"))
        elif spec["kind"] == "graph":
            seeds = current if "seed" in current.columns else current.select("query_id", F.col("id").alias("seed"))
            ends = end_points(seeds, relations, entities, spec.get("rel_types"), spec.get("depth", 1), spec.get("end_types"))
            rows = [r.asDict() for r in ends.orderBy("id").limit(most).collect()]
            if not rows:
                steps.append(Step(spec["name"], False, "no edges found"))
                return MultiStepResult(steps, False)
            steps.append(Step(spec["name"], True, f"{len(rows)} ends", rows))
            current = ends
        elif spec["kind"] == "join_aggregate":
            names = current.select("name").distinct() if "name" in current.columns else []
            out = join_aggregate(spec["fact"], spec["dim"], spec["fk"], spec["dim_key"], spec["dim_name"], names, spec["agg"], spec["column"])
            if out is None:
                steps.append(Step(spec["name"], False, f"{spec['agg']} over {spec['column']} is not allowed"))
                return MultiStepResult(steps, False)
            steps.append(Step(spec["name"], True, "aggregated", [r.asDict() for r in out.orderBy("name").limit(most).collect()]))
            current = out
        elif spec["kind"] == "sql":
            result = sql_query(spark, spec["sql"])
            if not result.ok:
                steps.append(Step(spec["name"], False, f"SQL failed: {result.error}"))
                return MultiStepResult(steps, False)
            some = any(v not in (None, "", 0) for r in result.rows for v in r.values())
            steps.append(Step(spec["name"], True, f"{result.row_count} rows{'' if some else ' (nothing fits the condition)'}", result.rows))
        else:
            raise ValueError(f"no such step: {spec['kind']}")
    return MultiStepResult(steps, True)
