"""Questions as data: routing, template rules and extraction over forms filled from a table, with the rules as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfind.functions.text import AFTER, BEFORE
from wayfind.operators import evaluate, router, sql_lane
from wayfind.plans.registry import query, table
from wayfind.sources import kg

QUESTIONS = [
    ("환불된 주문 목록", "hybrid"),
    ("전체 주문 건수는 몇 개야", "structured"),
    ("가장 많은 이슈가 접수된 제품", "graph"),
    ("Client-A를 담당하는 직원", "graph"),
    ("설치 가이드를 보여줘", "semantic"),
    ("장애 원인을 설명해줘", "semantic"),
    ("2025년 분기별 매출 합계", "structured"),
    ("비슷한 내용 요약", "semantic"),
    ("Product-C1 알려줘", "hybrid"),
    ("안녕", "hybrid"),
    ("매출 합계와 관련된 내용", "hybrid"),
    ("진행 중인 프로젝트를 이끄는 사람", "graph"),
]


def _about(spark: SparkSession, sf_dir: str, forms: list[tuple[int, str, str]]) -> DataFrame:
    """k, n_name of each nation with each form: i, q, label."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(q).alias("q"), F.lit(e).alias("label")) for i, q, e in forms])).alias("x")
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("k"), "n_name", each).select("k", "n_name", "x.*")


def _values(rows: list[tuple]) -> str:
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


def _any(group: list[tuple[str, str]]) -> str:
    """Does one of the signals stand in q? Word boundaries as RE2 has them; a look behind becomes a test of its own."""
    tests = []
    for name, pattern in group:
        p = pattern.replace(BEFORE, r"\b").replace(AFTER, r"\b").replace("(?<![된는인])", "")
        test = f"regexp_matches(q, '{p}')"
        if name == "person":
            names = " ".join(router.NOT_A_NAME.split())
            test = f"({test} AND NOT regexp_matches(q, '[된는인]\\s*(직원|사원|담당자)') AND NOT list_contains(string_split('{names}', ' '), regexp_extract(q, '([가-힣]{{2,4}})\\s*(?:직원|사원|담당자)', 1)))"
        tests.append(test)
    return "(" + " OR ".join(tests) + ")"


def _ladder() -> str:
    """The rules without an ontology, from the tables of signals."""
    v, g, n, d, e, m = map(_any, (router.VERBS, router.GENERIC, router.NOUNS, router.DOCUMENT, router.ENTITIES, router.SEMANTIC))
    top, structured = _any([x for x in router.STRUCTURED if x[0] == "superlative"]), _any(router.STRUCTURED)
    return f"CASE WHEN {v} OR ({g} AND {e}) THEN 'graph' WHEN {d} THEN 'semantic' WHEN {n} AND ({e} OR {top}) THEN 'graph' WHEN {structured} AND {m} THEN 'hybrid' WHEN {structured} THEN 'structured' WHEN {m} THEN 'semantic' ELSE 'hybrid' END"


MORE = ["지난 분기 매출이 가장 높은 고객", "product 3 id = 7", "재직 중인 직원 수", "김철수 직원", "개발팀 소속 인원", "장애 건수 상위 5", "연결된 프로젝트", "Client-B와 연결된 제품", "관련 제품의 평균 금액", "안내"]


@query("WITH p(query_id, q) AS (VALUES " + _values([(i, q) for i, q in enumerate([q for q, _ in QUESTIONS] + MORE)]) + f"), a AS (SELECT query_id * 100 + n_nationkey AS query_id, q || ' ' || n_name AS q FROM p, nation) SELECT CAST(query_id AS INTEGER) AS query_id, {_ladder()} AS route FROM a")
def route_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions about each nation, against the ladder of rules in SQL."""
    asked = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("k"), "n_name", F.explode(F.array(*[F.struct(F.lit(i).alias("p"), F.lit(q).alias("q")) for i, q in enumerate([q for q, _ in QUESTIONS] + MORE)])).alias("x"))
    return router.route(asked.select((F.col("x.p") * 100 + F.col("k")).alias("query_id"), F.concat("x.q", F.lit(" "), "n_name").alias("query"))).select("query_id", "route")


#: Which lanes a route reaches, as SQL over its name and the signals: e stands for an entity, two for figures and meaning.
_REACHED = "route = expected OR (expected IN ('structured', 'semantic') AND route = 'hybrid') OR (expected = 'graph' AND route = 'hybrid' AND e AND NOT two)"


@query("WITH p(query_id, q, label) AS (VALUES " + _values([(i, q, e) for i, (q, e) in enumerate(QUESTIONS)]) + f"""), a AS (SELECT q || ' ' || n_name AS q, CASE WHEN n_nationkey % 4 = 0 THEN 'graph' ELSE label END AS expected FROM p, nation),
r AS (SELECT expected, {_ladder()} AS route, {_any(router.ENTITIES)} AS e, {_any(router.STRUCTURED)} AND {_any(router.SEMANTIC)} AS two FROM a), x AS (SELECT route = expected AS strict, {_REACHED} AS reached FROM r)
SELECT count(*) AS n, round(avg(strict::INTEGER), 3) AS strict, round(avg(reached::INTEGER), 3) AS coverage, count(*) FILTER (reached AND NOT strict) AS fan_out, count(*) FILTER (NOT reached) AS true_miss FROM x""")
def route_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled questions about each nation; for every fourth one the label is graph whatever is asked, so that not all are met."""
    asked = _about(spark, sf_dir, [(i, q, e) for i, (q, e) in enumerate(QUESTIONS)])
    expected = F.when(F.col("k") % 4 == 0, "graph").otherwise(F.col("label"))
    rows = asked.select((F.col("i") * 100 + F.col("k")).alias("query_id"), F.concat("q", F.lit(" "), "n_name").alias("query"), expected.alias("expected"))
    return evaluate.route_eval(router.route(rows), rows.select("query_id", "expected"))


@query("""SELECT CAST(0 AS BIGINT) AS query_id, 'graph' AS route, 'IN_NATION' AS relation UNION ALL SELECT 1, 'hybrid', NULL""")
def route_with_ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and type pairs of the derived graph: a nation named with a type it has edges to is a graph question."""
    ents = kg.entities(spark, sf_dir).where("type = 'nation'").select(F.col("canonical_name").alias("name"), F.lit("department").alias("type"))
    pairs = spark.createDataFrame([("department", "client", "IN_NATION"), ("client", "department", "IN_NATION")], "from_type string, to_type string, relation string")
    name = ents.agg(F.min("name")).first()[0]
    asked = spark.createDataFrame([(0, f"{name} 거래처"), (1, f"{name} ?")], "query_id long, query string")
    return router.route(asked, ents, pairs).select("query_id", "route", F.col("type_pair.relation").alias("relation"))


#: What a model may say about a table {n}.
_RAW = [
    "```sql\nSELECT 1 AS a FROM {n};\n```",
    "sql: select * from {n} where x = 2; drop table {n}",
    "Here you are: WITH a AS (SELECT 1) SELECT * FROM a, {n}",
    "no statement on {n}",
    "DELETE FROM {n}",
]


_TRIM = "trim({}, chr(32) || chr(9) || chr(13) || chr(10))"


@query("WITH p(i, form) AS (VALUES " + _values(list(enumerate(_RAW))) + rf"""), r AS (SELECT i * 100 + n_nationkey AS id, replace(form, '{{n}}', n_name) AS raw FROM p, nation), f AS (SELECT id, raw, regexp_extract(raw, '(?is)```(?:sql)?\s*(.*?)```', 1) AS fenced FROM r),
b AS (SELECT id, {_TRIM.format("regexp_replace(" + _TRIM.format("CASE WHEN fenced <> '' THEN fenced ELSE raw END") + r", '(?i)^sql\s*[:\n]', '')")} AS body FROM f)
SELECT id, nullif({_TRIM.format(r"regexp_extract(body, '(?is)\b((?:select|with)\b[^;]*)', 1)")}, '') AS sql FROM b""")
def sql_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What models say about each nation."""
    said = _about(spark, sf_dir, [(i, r, "") for i, r in enumerate(_RAW)])
    return said.select((F.col("i") * 100 + F.col("k")).alias("id"), sql_lane.extract_sql(F.replace("q", F.lit("{n}"), F.col("n_name"))).alias("sql"))


_TEMPLATED = [(0, "환불된 주문"), (1, "취소 주문 목록"), (2, "주문 건수"), (3, "회원은 몇 명"), (4, "상태별 현황"), (5, "평균 결제 금액"), (6, "총 매출"), (7, "날씨"), (8, "환불 취소 주문"), (9, "유저가 몇 명이고 주문 개수는"), (10, "orders by STATUS"), (11, "전체 결제"), (12, "평균 매출 합계")]


def _first_rule() -> str:
    lit = lambda x: "'" + x.replace("'", "''") + "'"
    return "CASE " + " ".join(f"WHEN {' AND '.join(f'regexp_matches(q, {lit(p)})' for p in patterns)} THEN {lit(sql)}" for patterns, sql in sql_lane.TEMPLATE_RULES) + " END"


@query("WITH p(i, form) AS (VALUES " + _values(_TEMPLATED) + f"), t AS (SELECT i * 100 + n_nationkey AS id, n_name || ' ' || form AS q FROM p, nation) SELECT id, {_first_rule()} AS sql FROM t")
def sql_template_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions about each nation."""
    asked = _about(spark, sf_dir, [(i, q, "") for i, q in _TEMPLATED])
    return asked.select((F.col("i") * 100 + F.col("k")).alias("id"), sql_lane.template_sql(F.concat("n_name", F.lit(" "), "q")).alias("sql"))


#: Statements about a nation {n} called {name} and the view of its region, {r}: is it refused always, where that view may not be read, or never?
_GUARDED = [
    ("SELECT count(*) AS n FROM region_{r} WHERE r_regionkey = {r}", "hidden"),
    ("SELECT n_name, row_number() OVER w AS s FROM nation WINDOW w AS (ORDER BY CASE WHEN exists(SELECT 1 FROM region_{r}) THEN 1 ELSE n_nationkey END)", "hidden"),
    ("SELECT b.r_name FROM (WITH region_{r} AS (SELECT {n} AS x) SELECT * FROM region_{r}) a CROSS JOIN region_{r} b", "hidden"),
    ("WITH region_{r} AS (SELECT '{name}' AS x) SELECT * FROM region_{r}", "never"),
    ("SELECT IDENTIFIER('reflect')('java.lang.System', 'getProperty', '{name}') AS x FROM nation", "always"),
    ("INSERT INTO region_{r} VALUES ({n}, '{name}', '')", "always"),
]


@query(
    "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, form, kind = 'always' OR (kind = 'hidden' AND n_regionkey % 2 = 1) AS refused FROM nation CROSS JOIN (VALUES "
    + ", ".join(f"({k}, '{kind}')" for k, (_, kind) in enumerate(_GUARDED))
    + ") f(form, kind)"
)
def sql_guard_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which statements of each nation are refused where nation may be read, and the views of regions with an even key."""
    nations, regions = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    nations.createOrReplaceTempView("nation")
    given, seen = ["nation"], []
    for (r,) in regions.select("r_regionkey").collect():
        regions.where(F.col("r_regionkey") == r).createOrReplaceTempView(f"region_{r}")
        given += [f"region_{r}"] * (r % 2 == 0)
    for n, name, r in nations.select("n_nationkey", "n_name", "n_regionkey").collect():
        for form, (sql, _) in enumerate(_GUARDED):
            try:
                sql_lane.guard(spark, sql.format(n=n, name=name.replace("'", "''"), r=r), given)
                seen.append((n, form, False))
            except sql_lane.Refused:
                seen.append((n, form, True))
    return spark.createDataFrame(seen, "n_nationkey long, form int, refused boolean")
