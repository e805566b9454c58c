"""The engine's face: route, sql, vector search, ontology search, graph expansion, retrieve, ask, explain_audit.

Model steps are injected: nl2sql(question) -> statement or None, embedder(text) -> vector, llm(prompt) -> text. Lanes fail
apart: one that raises is named in errors and the others go on.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wayfind.operators import adjacency, audit, curate, fusion, graph, keyword, retrieval, router, sql_lane, vector
from wayfind.sources.sinks import keep

#: What audit records are made of, a row for each run.
RUN_SCHEMA = "query_id long, query string, route string, tools array<string>, sql string, sql_ok boolean, errors array<string>, fused array<struct<key:string,score:double,sources:array<string>,text:string>>, kept array<int>, dropped array<int>, tokens_used int, budget int"


@dataclass
class Retrieved:
    query: str
    decision: dict
    context: str
    kept: list[int]
    dropped: list[int]
    fused: list[dict]
    errors: list[str]
    tokens_used: int
    budget: int
    sql: str | None = None
    sql_ok: bool | None = None
    answer: str | None = None
    failed: bool = False


@dataclass
class Engine:
    spark: SparkSession
    documents: DataFrame | None = None  # doc_id, text[, embedding]
    entities: DataFrame | None = None
    aliases: DataFrame | None = None
    relations: DataFrame | None = None
    links: DataFrame | None = None
    keyword_index: DataFrame | None = None
    nl2sql: Callable[[str], str | None] = sql_lane.template_nl2sql
    fix_sql: Callable[[str, str, str, dict], str | None] | None = None
    embedder: Callable[[str], list[float]] | None = None
    llm: Callable[[str], str] | None = None
    vector_dim: int | None = None  # of the corpus' vectors; an embedder that gives another length is refused
    hashed: DataFrame | None = None  # doc_id, embedding: hash vectors of documents, made once where no embedder is given
    lexicon: DataFrame | None = None
    pairs: DataFrame | None = None
    strict_parity: bool = False  # run the graph lane only for the route "graph", whatever the tools say
    most_scanned: int | None = 60  # edges that a scan for a filter lists; None: all
    most_rows: int | None = 200  # rows of a lane that go on to fusion; None: all
    extra_lanes: dict[str, Callable[[str], DataFrame]] = field(default_factory=dict)

    def _ask(self, query: str) -> DataFrame:
        return self.spark.createDataFrame([(0, query)], "query_id long, query string")

    def route(self, query: str) -> dict:
        return router.route_one(self.spark, query, self.lexicon, self.pairs)

    def sql(self, statement: str) -> sql_lane.SqlResult:
        return sql_lane.sql_query(self.spark, statement)

    def vector_search(self, query: str, k: float = 5) -> DataFrame:
        """query_id, doc_id, score, rank: by the injected embedder, or by hashed terms without one."""
        if self.embedder and "embedding" in self.documents.columns:
            asked = self.embedder(query)
            if self.vector_dim and len(asked) != self.vector_dim:
                raise ValueError(f"the embedder gives {len(asked)} numbers, the corpus has {self.vector_dim}")
            hits = vector.cosine_topk(self.documents, asked, k, "doc_id", "embedding")
            return fusion.ranked_list(hits.withColumn("query_id", F.lit(0).cast("long")), 0, [F.desc("score"), F.col("doc_id")], F.col("doc_id"), "vector", F.lit("")).select("query_id", F.col("key").alias("doc_id"), "rank")
        if self.hashed is None:
            self.hashed = self.documents.select("doc_id", vector.hash_embedding(F.col("text")).alias("embedding")).persist()
        asked = self._ask(query).select("query_id", vector.hash_embedding(F.col("query")).alias("embedding"))
        return vector.cosine_topk_many(self.hashed, asked, k, "doc_id", places=9)

    def ontology_search(self, query: str, k: int = 5) -> DataFrame:
        return graph.ontology_search(self._ask(query), self.entities, self.aliases, k)

    def graph_expand(self, entity_id: int, depth: int = 1, rel_types: list[str] | None = None, direction: str = "both") -> DataFrame:
        seeds = self.spark.createDataFrame([(0, entity_id)], "query_id long, seed long")
        return graph.named_few(graph.graph_expand(seeds, self.relations, depth, rel_types, direction), self.entities)

    # Lanes: each gives ranked rows (query_id, rank, key, source, text).

    def _sql_lane(self, query: str, note: dict) -> DataFrame | None:
        statement = self.nl2sql(query)
        if not statement:
            return None
        result = self.sql(statement)
        if not result.ok and self.fix_sql:
            statement, result = sql_lane.repair(self.spark, query, statement, result, self.fix_sql)
        note |= {"sql": statement, "sql_ok": result.ok}
        if not result.ok:
            raise RuntimeError(result.error)
        rows = [(0, i + 1, f"sql#{i}", "sql", f"[{statement}] " + " | ".join(f"{k}={'null' if v is None else v}" for k, v in r.items())) for i, r in enumerate(result.rows)]
        return self.spark.createDataFrame(rows, "query_id long, rank int, key string, source string, text string")

    def _vector_lane(self, query: str) -> DataFrame:
        hits = self.vector_search(query)
        return hits.join(self.documents.select("doc_id", "text"), "doc_id").select("query_id", "rank", F.concat(F.lit("documents#"), F.col("doc_id").cast("string")).alias("key"), F.lit("vector").alias("source"), "text")

    def _keyword_lane(self, query: str) -> DataFrame:
        hits = keyword.keyword_search(self.keyword_index, self._ask(query))
        return hits.join(self.documents.select("doc_id", "text"), "doc_id").select("query_id", "rank", F.concat(F.lit("documents#"), F.col("doc_id").cast("string")).alias("key"), F.lit("keyword").alias("source"), "text")

    def graph_lane(self, query: str, plan: dict | None = None, k: int = 5, depth: int = 2) -> DataFrame:
        """Edges of the best seeds, then a ranking or scan, then the seeds. A named relation means one step. Where nothing is
        found and the plan asks for no aggregate or filter, one item says so."""
        plan = plan or {}
        rels = plan.get("rel_types") or None
        hits = keep(self.ontology_search(query, k), "hits")
        none = hits.isEmpty()
        if none and not (plan.get("aggregate") or plan.get("filter")):
            terms = [r[0] for r in self._ask(query).select(F.explode(graph.T.seed_terms(F.col("query")))).collect()]
            text = f"[그래프] 질의에 등장한 대상({', '.join(terms)})을 지식그래프에서 찾지 못했습니다."
            return self.spark.createDataFrame([(0, 1, "unresolved#" + "+".join(terms), "graph", text)], "query_id long, rank int, key string, source string, text string")
        parts = []
        if not none:
            seeds = graph.best_seeds(hits).select("query_id", F.col("id").alias("seed"), F.col("rank").alias("at"))
            edges = graph.named_few(graph.graph_expand(seeds, self.relations, 1 if rels else depth, rels), self.entities)
            parts.append(graph.edge_candidates(edges.join(seeds.select("seed", "at"), "seed"), F.col("seed")).select(F.lit(0).alias("g"), F.struct("at", "depth", "id").alias("o"), "canonical_key", "text"))
        if rels and (plan.get("aggregate") or plan.get("filter") or none):
            f = plan.get("filter") or {}
            scan = graph.relation_scan(self.relations, self.entities, rels, f.get("side"), f.get("key"), f.get("value"))
            if plan.get("aggregate"):
                top = graph.ranking_candidates(graph.degree_ranking(scan, plan["aggregate"]), rels[0])
                parts.append(top.select(F.lit(1).alias("g"), F.struct(F.col("rank").alias("at"), F.lit(0).alias("depth"), F.col("entity_id").alias("id")).alias("o"), "canonical_key", "text"))
            else:
                listed = graph.edge_candidates(scan if self.most_scanned is None else scan.orderBy("id").limit(self.most_scanned))
                parts.append(listed.select(F.lit(1).alias("g"), F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), "id").alias("o"), "canonical_key", "text"))
        parts.append(graph.ontology_candidates(hits).select(F.lit(2).alias("g"), F.struct(F.col("rank").alias("at"), F.lit(0).alias("depth"), "id").alias("o"), "canonical_key", "text"))
        items = reduce(DataFrame.unionByName, parts).withColumn("query_id", F.lit(0).cast("long"))
        return fusion.ranked_list(items, 0, [F.col("g"), F.col("o")], F.col("canonical_key"), "graph", F.col("text")).drop("list_idx")

    def retrieve(self, query: str, budget: int = 256) -> Retrieved:
        decision = self.route(query)
        tools, note = set(decision["tools"]), {}
        lanes: dict[str, Callable[[], DataFrame | None]] = {}
        if router.SQL in tools:
            lanes["sql"] = lambda: self._sql_lane(query, note)
        if router.VECTOR in tools and self.documents is not None:
            lanes["vector"] = lambda: self._vector_lane(query)
            if keyword.has_index(self.keyword_index):
                lanes["keyword"] = lambda: self._keyword_lane(query)
        if router.GRAPH in tools and self.entities is not None and (decision["route"] == "graph" or not self.strict_parity):
            lanes["graph"] = lambda: self.graph_lane(query, decision["graph_plan"])
        lanes |= {name: (lambda f=f: f(query)) for name, f in self.extra_lanes.items()}

        def run(name: str) -> tuple[str, list | None, str | None]:
            try:
                df = lanes[name]()
                if df is None:
                    return name, [], None
                rows = df.select("query_id", "rank", "key", "source", "text").orderBy("rank")
                return name, [tuple(r) for r in (rows if self.most_rows is None else rows.limit(self.most_rows)).collect()], None
            except Exception as e:
                return name, None, f"{name}: {(str(e).strip() or type(e).__name__).splitlines()[0][:300]}"

        with ThreadPoolExecutor(max(1, len(lanes))) as pool:
            done = list(pool.map(run, lanes))
        errors = [e for _, _, e in done if e]
        rows = [(q, i, r, k, s, t) for i, (_, found, _) in enumerate(done) for q, r, k, s, t in found or []]
        ranked = self.spark.createDataFrame(rows, "query_id long, list_idx int, rank int, key string, source string, text string")
        fused = [r.asDict(True) for r in fusion.rrf_named(ranked).orderBy("rank").collect()] if rows else []
        kept, dropped, context, used = [], [], "", 0
        if fused:
            items = self.spark.createDataFrame([(0, i, f["text"]) for i, f in enumerate(fused)], "query_id long, idx int, text string")
            c = curate.curate(items, self._ask(query), budget).first()
            kept, dropped, context, used = list(c["kept"]), list(c["dropped"]), c["context"], c["tokens_used"]
        return Retrieved(query, decision, context, kept, dropped, fused, errors, used, budget, note.get("sql"), note.get("sql_ok"))

    def ask(self, query: str, budget: int = 256) -> Retrieved:
        """retrieve, then the injected model over the context. No context because lanes failed is said, not answered."""
        r = self.retrieve(query, budget)
        if not r.context and r.errors:
            r.answer, r.failed = "Retrieval failed: " + "; ".join(r.errors), True
            return r
        try:
            if self.llm is None:
                raise RuntimeError("no model")
            r.answer = self.llm(answer_prompt(query, r.context))
        except Exception as e:
            r.answer, r.failed = f"Generation failed: {e}", True
        return r

    def explain_audit(self, query: str, budget: int = 256) -> dict:
        """The audit record of a fresh run; never from a cache."""
        return self.audit_records([self.retrieve(query, budget)]).first().asDict(True)

    def audit_records(self, runs: list[Retrieved]) -> DataFrame:
        rows = [(i, r.query, r.decision["route"], r.decision["tools"], r.sql, r.sql_ok, r.errors, [(f["key"], f["score"], f["sources"], f["text"]) for f in r.fused], r.kept, r.dropped, r.tokens_used, r.budget) for i, r in enumerate(runs)]
        return audit.audit_records(self.spark.createDataFrame(rows, RUN_SCHEMA))

    def retrieve_many(self, questions: DataFrame, budget: int = 256, statements: DataFrame | None = None) -> retrieval.RetrievedMany:
        """retrieve for all questions (query_id, query) in one keyed plan; the embedder is called a text at a time in tasks. The graph
        lane follows the router's tools, lists what the best three entities have edges to, and makes the adjacency once."""
        one, steps = self.embedder, None if self.relations is None else keep(adjacency.adjacency(self.relations), "adjacency")
        embed = (lambda texts: [one(t) for t in texts]) if one and self.documents is not None and "embedding" in self.documents.columns else None
        return retrieval.retrieve_many(questions, self.documents, self.entities, self.aliases, steps, self.keyword_index, None, statements, self.lexicon, self.pairs, budget, embedder=embed, dim=self.vector_dim)

    def kg_retrieve(self, query: str, k: int = 5, expand: int = 3, errors: list[str] | None = None) -> DataFrame:
        """query_id, key, score, sources, text, rank: vector hits and graph facts fused, hits bridged to the entities they name.

        errors: takes what a failing embedder says, and the graph's list stands alone; without it that is raised."""
        try:
            first = self._bridged(query, k)
        except Exception as e:
            if errors is None:
                raise
            errors.append(f"vector: {(str(e).strip() or type(e).__name__).splitlines()[0][:300]}")
            first = None
        found = keep(self.ontology_search(query, k), "hits")
        seeds = found.where(F.col("rank") <= expand).select("query_id", F.col("id").alias("seed"), F.col("rank").alias("at"))
        edges = graph.edge_candidates(graph.named_few(graph.graph_expand(seeds, self.relations, 1), self.entities).join(seeds.select("seed", "at"), "seed"))
        items = graph.ontology_candidates(found).select("query_id", F.lit(0).alias("g"), F.struct(F.col("rank").alias("at"), "id").alias("o"), "canonical_key", "text").unionByName(edges.select("query_id", F.lit(1).alias("g"), F.struct("at", "id").alias("o"), "canonical_key", "text"))
        second = fusion.ranked_list(items, 1, [F.col("g"), F.col("o")], F.col("canonical_key"), "graph", F.col("text"))
        return fusion.rrf_named(second if first is None else first.unionByName(second))

    def _bridged(self, query: str, k: int) -> DataFrame:
        hits = self.vector_search(query, k).join(self.documents.select("doc_id", "text"), "doc_id")
        bridged = fusion.bridge(hits, self.links, self.entities) if self.links is not None else hits.withColumn("canonical_key", F.concat(F.lit("documents#"), F.col("doc_id").cast("string")))
        return fusion.ranked_list(bridged, 0, [F.col("rank")], F.col("canonical_key"), "vector", F.col("text"))


def audit_schema(spark: SparkSession) -> StructType:
    """The schema of the records that audits return."""
    return audit.audit_records(spark.createDataFrame([], RUN_SCHEMA)).schema


def answer_prompt(query: str, context: str, language: str | None = "Korean") -> str:
    """What a model is told: nothing but the context counts, and how to read its lines. language None: any language."""
    rules = [
        "Use only what the context below says; add nothing from elsewhere and do not guess.",
        "A line that begins with a statement in brackets gives rows that the database returned; take its values as they are.",
        "A line marked [그래프] states one relation between two things; a question about that relation is answered by it.",
        "If a line marked [그래프 집계] is a tie (공동), name everything that shares the place.",
        "Give names, not ids or codes, wherever the context has the name.",
        "Only if the context has nothing on the question, say that the given information does not hold the answer.",
    ]
    if language:
        rules.append(f"Write in {language} alone; proper names stay as they are.")
    return "\n".join([*rules, "", "Context:", context.strip() or "(empty)", "", f"Question: {query}", "Answer:"])
