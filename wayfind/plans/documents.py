"""Text, keyword, chunking and curation queries over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfind.functions import text as T
from wayfind.operators import claims, curate, evaluate, places, positions
from wayfind.plans.registry import query, table
from wayfind.sources.readers import chunk_markdown

#: The text rules as RE2, for the oracle.
_PARTICLES = T.PARTICLES
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS.split())
_TERMS = f"list_distinct(list_filter(list_transform(regexp_extract_all(lower({{}}), '([가-힣]+|[a-z0-9]+)', 1), lambda w: regexp_replace(w, '({_PARTICLES})$', '')), lambda w: length(w) >= 2 AND w NOT IN ({_STOP})))"
_WHITE = r"\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_TOKENS = rf"(len(regexp_extract_all({{0}}, '[가-힣]')) + len(regexp_extract_all({{0}}, '[A-Za-z0-9]+')) + len(regexp_extract_all({{0}}, '[^A-Za-z0-9_{_WHITE}가-힣]')))"


def terms_sql(column: str) -> str:
    return _TERMS.replace("{}", column)


def tokens_sql(column: str) -> str:
    return _TOKENS.replace("{0}", column)


@query(f"SELECT doc_id, CAST({tokens_sql('text')} AS INTEGER) AS tokens FROM documents")
def txt_est_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.est_tokens(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, array_to_string(list_sort({terms_sql('text')}), ' ') AS terms FROM documents")
def txt_content_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(T.content_terms(F.col("text"))), " ").alias("terms"))


_SEED_STOP = ", ".join(f"'{w}'" for w in T.SEED_STOP_WORDS.split())


#: The rule of seed terms for a text column.
SEEDS_SQL = f"""list_distinct(list_filter(list_transform(regexp_extract_all({{}}, '([A-Za-z][A-Za-z0-9]*(?:[-_][A-Za-z0-9]+)*|[가-힣]{{{{2,}}}})', 1),
lambda w: regexp_replace(w, '({_PARTICLES})$', '')), lambda w: length(w) >= 2 AND w NOT IN ({_SEED_STOP})))"""


@query(f"SELECT p_partkey, array_to_string(list_sort({SEEDS_SQL.format("p_name || ' ' || p_brand || '의 제품'")}), ' ') AS terms FROM part")
def txt_seed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("p_name", F.lit(" "), "p_brand", F.lit("의 제품"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(T.seed_terms(text)), " ").alias("terms"))


#: For text without Hangul, normalisation is terms of two characters, split identifiers, and joined neighbours.
_RAW = "regexp_extract_all(lower({}), '([a-z0-9]+)', 1)"
_NORMAL = f"""list_distinct(list_concat(
 list_concat(list_filter({_RAW}, lambda w: length(w) >= 2),
  flatten(list_transform(list_filter({_RAW}, lambda w: length(w) >= 2 AND regexp_matches(w, '[a-z]') AND regexp_matches(w, '[0-9]')), lambda w: list_filter(regexp_extract_all(w, '([a-z]+|[0-9]+)', 1), lambda p: length(p) >= 2)))),
 list_concat(list_filter(list_transform({_RAW}, lambda w: CASE w WHEN 'client' THEN '고객사' WHEN 'product' THEN '제품' WHEN 'employee' THEN '직원' WHEN 'department' THEN '부서' WHEN 'project' THEN '프로젝트' WHEN 'contract' THEN '계약' WHEN 'ticket' THEN '티켓' WHEN 'sales' THEN '매출' END), lambda s: s IS NOT NULL),
 list_filter(list_transform(range(1, len({_RAW})), lambda i: {_RAW}[i] || {_RAW}[i + 1]), lambda w: length(w) BETWEEN 2 AND 24))))"""


@query(f"SELECT p_partkey, array_to_string(list_sort({_NORMAL.replace('{}', '(p_name || p_brand)')}), ' ') AS tokens FROM part")
def txt_normalize_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(T.normalize_tokens(F.concat("p_name", "p_brand"))), " ").alias("tokens"))


@query("SELECT doc_id, substr(sha256(replace(text, chr(13) || chr(10), chr(10))), 1, 16) AS digest FROM documents")
def ev_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("digest"))


@query("SELECT doc_id FROM documents WHERE list_bool_and(list_transform(['the', 'THAT', 'and'], lambda k: contains(lower(text), lower(k))))")
def ev_lexical_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(F.lit("the"), F.lit("THAT"), F.lit("and"))
    return table(spark, sf_dir, "documents").where(T.contains_all(F.col("text"), words)).select("doc_id")


_PROBES = [(1, "the thing"), (2, "license version"), (3, "tion")]


@query("""
WITH q(query_id, prefix) AS (VALUES (1, 'the'), (1, 'thing'), (1, 'thething'), (2, 'license'), (2, 'version'), (2, 'licenseversion'), (3, 'tion')),
w AS (SELECT doc_id, regexp_extract_all(lower(text), '([a-z0-9]+)', 1) AS ws FROM documents),
t AS (SELECT DISTINCT doc_id, unnest(list_concat(list_concat(list_filter(ws, lambda x: length(x) >= 2),
  flatten(list_transform(list_filter(ws, lambda x: regexp_matches(x, '[a-z]') AND regexp_matches(x, '[0-9]')), lambda x: list_filter(regexp_extract_all(x, '([a-z]+|[0-9]+)', 1), lambda p: length(p) >= 2)))),
  list_filter(list_transform(range(1, len(ws)), lambda i: ws[i] || ws[i + 1]), lambda x: length(x) BETWEEN 2 AND 24))) AS token FROM w),
s AS (SELECT query_id, doc_id, count(DISTINCT token) AS score FROM t JOIN q ON starts_with(token, prefix) GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s)
SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 5""")
def kw_prefix_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = spark.createDataFrame(_PROBES, "query_id int, query string")
    found = positions.search_texts(table(spark, sf_dir, "documents"), queries)
    return found.select("query_id", "doc_id", F.round(F.col("score") / positions.WEIGHT).cast("long").alias("score"), "rank")


_ASKED = "SELECT doc_id AS query_id, list_distinct(regexp_extract_all(lower(text), '([a-z]{4,})', 1)[1:2]) AS ts FROM documents WHERE doc_id % 100 = 0"
def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two words of each hundredth document as a question."""
    words = F.array_distinct(F.slice(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"), F.lit(1)), 1, 2))
    return table(spark, sf_dir, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.array_join(words, " ").alias("query"))


@query(f"""
WITH q AS ({_ASKED}), p AS (SELECT query_id, len(ts) AS terms, unnest(ts) AS prefix, generate_subscripts(ts, 1) AS term FROM q),
w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '([a-z]+)', 1)) AS word, generate_subscripts(regexp_extract_all(lower(text), '([a-z]+)', 1), 1) AS nr FROM documents),
t AS (SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY min(nr)) AS pos FROM w WHERE length(word) >= 2 GROUP BY doc_id, word),
h AS (SELECT query_id, terms, doc_id, pos, bool_or(term = 1) AS one, bool_or(term = 2) AS two FROM t JOIN p ON starts_with(word, prefix) GROUP BY ALL),
l AS (SELECT *, row_number() OVER o AS nr, max(CASE WHEN one THEN pos END) OVER o AS p1, max(CASE WHEN two THEN pos END) OVER o AS p2 FROM h WINDOW o AS (PARTITION BY query_id, doc_id ORDER BY pos)),
b AS (SELECT *, CASE WHEN terms = 1 THEN p1 WHEN p1 IS NOT NULL AND p2 IS NOT NULL THEN least(p1, p2) END AS start FROM l),
c AS (SELECT *, lag(start) OVER (PARTITION BY query_id, doc_id ORDER BY pos) AS before FROM b),
v AS (SELECT c.query_id, c.doc_id, c.pos, c.start, c.nr - f.nr + 1 AS held FROM c JOIN l f ON f.query_id = c.query_id AND f.doc_id = c.doc_id AND f.pos = c.start WHERE c.start > coalesce(c.before, -1)),
s AS (SELECT query_id, doc_id, round(sum(0.1::DOUBLE / (1 + (pos - start) - (held - 1))), 9) AS score FROM v GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s)
SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 10""")
def kw_cover_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents in which two words stand nearest together, for each hundredth document's first two words. Texts are cut to a-z words here, so that SQL can place them."""
    docs = table(spark, sf_dir, "documents")
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)), lambda w: F.length(w) >= 2))
    placed = F.transform(words, lambda t, k: F.struct(t.alias("token"), (k + 1).alias("pos")))
    index = docs.select("doc_id", F.explode(placed).alias("p")).select("doc_id", "p.token", "p.pos")
    found = positions.search(index, _asked(spark, sf_dir), 10, "all", digits=9)
    return found.select("query_id", "doc_id", "score", "rank")


_TRIM = "trim({}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


@query(rf"""
WITH m AS (SELECT doc_id, string_split(regexp_replace('# ' || lang || chr(10) || replace(text, chr(10), chr(10) || chr(10)), '(?m)^(#{{1,3}}[ \t]+)', chr(1) || '\1', 'g'), chr(1)) AS parts FROM documents),
p AS (SELECT doc_id, generate_subscripts(parts, 1) AS sec, {_TRIM.format('unnest(parts)')} AS content FROM m),
c AS (SELECT *, CASE WHEN regexp_matches(content, '^#{{1,3}}[ \t]+') THEN {_TRIM.format("regexp_extract(content, '^#{1,3}[ \t]+([^\n]*)', 1)")} ELSE '(head)' END AS section FROM p WHERE content <> ''),
f AS (SELECT doc_id, sec, section, CASE WHEN length(content) <= 1200 THEN [content] ELSE (SELECT list_append(r.done, r.open) FROM (SELECT list_reduce(
  list_transform(regexp_split_to_array(content, '\n{{2,}}'), lambda x: {{'done': CAST([] AS VARCHAR[]), 'open': x, 'n': length(x)}}),
  lambda s, x: CASE WHEN s.n + x.n > 1200 THEN {{'done': list_append(s.done, s.open), 'open': x.open, 'n': x.n}} ELSE {{'done': s.done, 'open': s.open || chr(10) || chr(10) || x.open, 'n': s.n + x.n}} END) AS r)) END AS pieces FROM c),
e AS (SELECT doc_id, sec, section, generate_subscripts(pieces, 1) AS piece, unnest(pieces) AS content FROM f)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sec, piece) - 1 AS INTEGER) AS chunk_index, section, content FROM e""")
def src_chunk_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as Markdown: a heading, and each line a paragraph, so that long sections are cut at blank lines."""
    paragraphs = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    marked = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("# "), "lang", F.lit("\n"), paragraphs).alias("text"))
    return chunk_markdown(marked).select("doc_id", "chunk_index", "section", "content")


_CURATE_COST = tokens_sql("text")


@query(f"""
WITH i AS (SELECT doc_id // 20 AS query_id, CAST(doc_id % 20 AS INTEGER) AS idx, text, {tokens_sql('text')} AS cost,
  len(list_intersect({terms_sql('text')}, {terms_sql("'the thing that is heard and ternth'")})) AS rel FROM documents),
g AS (SELECT query_id, list({{'idx': idx, 'cost': CAST(cost AS INTEGER)}} ORDER BY rel DESC, idx) AS items FROM i GROUP BY 1),
f AS (SELECT query_id, list_reduce(items, lambda s, x: CASE WHEN s.used + x.cost <= 800 THEN {{'used': s.used + x.cost, 'kept': list_append(s.kept, x.idx)}} ELSE s END, {{'used': 0, 'kept': CAST([] AS INTEGER[])}}) AS r
  FROM (SELECT query_id, items FROM g))
SELECT query_id, array_to_string(list_sort(r.kept), ',') AS kept, r.used AS tokens_used FROM f""".replace("list_reduce(items, lambda s, x:", "list_reduce(list_transform(items, lambda x: {'used': 0, 'kept': CAST([] AS INTEGER[]), 'idx': x.idx, 'cost': x.cost}), lambda s, x:").replace("'kept': list_append(s.kept, x.idx)}", "'kept': list_append(s.kept, x.idx), 'idx': 0, 'cost': 0}").replace("{'used': 0, 'kept': CAST([] AS INTEGER[])})", "{'used': 0, 'kept': CAST([] AS INTEGER[]), 'idx': 0, 'cost': 0})"))
def curate_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty documents a question under 800 tokens: whole documents, greedy, passing over what does not fit."""
    docs = table(spark, sf_dir, "documents").select(F.expr("doc_id div 20").alias("query_id"), (F.col("doc_id") % 20).cast("int").alias("idx"), "text")
    asked = docs.select("query_id").distinct().withColumn("query", F.lit("the thing that is heard and ternth"))
    out = curate.curate(docs, asked, 800)
    return out.select("query_id", F.array_join(F.transform("kept", lambda x: x.cast("string")), ",").alias("kept"), "tokens_used")


@query(rf"""
WITH i AS (SELECT doc_id // 20 AS query_id, doc_id % 20 AS idx, length(text) AS n, text FROM documents),
w AS (SELECT query_id, string_agg(text, chr(10) ORDER BY idx) AS whole FROM i GROUP BY 1),
ch AS (SELECT query_id, unnest(string_split(whole, '')) AS c, generate_subscripts(string_split(whole, ''), 1) AS pos FROM w),
k AS (SELECT query_id, pos, CASE WHEN regexp_matches(c, '[A-Za-z0-9]') THEN 1 ELSE 0 END AS word, CASE WHEN regexp_matches(c, '[가-힣]') OR regexp_matches(c, '[^A-Za-z0-9_{_WHITE}가-힣]') THEN 1 ELSE 0 END AS single FROM ch),
t AS (SELECT query_id, pos, single + CASE WHEN word = 1 AND coalesce(lag(word) OVER (PARTITION BY query_id ORDER BY pos), 0) = 0 THEN 1 ELSE 0 END AS n FROM k),
u AS (SELECT query_id, pos, sum(n) OVER (PARTITION BY query_id ORDER BY pos) AS upto FROM t),
cut AS (SELECT query_id, max(pos) AS cut, max(upto) AS used FROM u WHERE upto <= 800 GROUP BY 1),
s AS (SELECT query_id, n, coalesce(sum(n + 1) OVER (PARTITION BY query_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM i)
SELECT s.query_id AS query_id, CAST(cut AS INTEGER) AS cut, CAST(count(*) FILTER (cut >= start + n) AS INTEGER) AS n_kept, CAST(count(*) FILTER (cut <= start AND n > 0) AS INTEGER) AS n_dropped,
 CAST(count(*) FILTER (cut > start AND cut < start + n) AS INTEGER) AS broken_rows, CAST(used AS INTEGER) AS tokens_used FROM s JOIN cut USING (query_id) GROUP BY s.query_id, cut, used""")
def curate_naive_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.expr("doc_id div 20").alias("query_id"), (F.col("doc_id") % 20).cast("int").alias("idx"), F.lit("row").alias("kind"), "text")
    return curate.naive_truncate(docs, 800)


_NUM = r"(\d[\d,]*(?:\.\d+)?\s*(?:%|건|명|개|원|초|분|시간|일|ms|GB|MB)?)"
_STATES = r"\b(in_progress|completed|on_hold|planning|resolved|closed|open|active|critical|high|medium|low)\b"
_EDGES = "chr(32) || chr(9) || chr(10) || chr(13)"


def atoms_sql(column: str) -> str:
    """claims.atoms as RE2, for text without Hangul, which persons need."""
    found = lambda p: f"list_transform(regexp_extract_all({column}, '{p}', 1), lambda a: trim(a, {_EDGES}))"
    numbers = f"list_filter({found(_NUM)}, lambda v: regexp_matches(v, '\\d{{2,}}') OR regexp_matches(v, '[%건명개원초분일]|ms|GB|MB|시간'))"
    parts = [found(r"([A-Z][A-Za-z]*-[A-Z0-9]+)"), found(r"(\d{4}-\d{2}-\d{2})"), found(_STATES), numbers]
    return f"list_distinct(flatten([{', '.join(parts)}]))"


@query(f"SELECT doc_id, array_to_string(list_sort({atoms_sql('text')}), '|') AS atoms FROM documents")
def claims_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(claims.atoms(F.col("text"))), "|").alias("atoms"))


@query(rf"""
WITH b AS (SELECT conv_id, turn + 1 AS turn, text AS context FROM conversations),
a AS (SELECT a.conv_id || '#' || a.turn AS query_id, a.text AS answer, coalesce(b.context, '') AS context FROM conversations a LEFT JOIN b USING (conv_id, turn) WHERE role = 'assistant'),
s AS (SELECT query_id, context, unnest(list_filter(list_transform(regexp_split_to_array(regexp_replace(answer, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: trim(x, {_EDGES})), lambda x: x <> '')) AS s FROM a),
c AS (SELECT query_id, context, {atoms_sql('s')} AS atoms FROM s),
m AS (SELECT query_id, atoms, list_filter(atoms, lambda x: NOT (contains(context, x) OR (regexp_replace(x, '[,\s]', '', 'g') <> '' AND contains(regexp_replace(context, '[,\s]', '', 'g'), regexp_replace(x, '[,\s]', '', 'g')))
  OR (regexp_extract(x, '^(\d[\d,]*)', 1) <> '' AND list_contains(regexp_extract_all(replace(context, ',', ''), '\b(\d+)\b', 1), replace(regexp_extract(x, '^(\d[\d,]*)', 1), ',', ''))))) AS missing FROM c),
g AS (SELECT query_id, count(*) FILTER (len(atoms) > 0) AS scorable, count(*) FILTER (len(atoms) > 0 AND len(missing) = 0) AS full_, sum(len(atoms)) AS total, sum(len(missing)) AS lost, list_sort(flatten(list(missing))) AS un FROM m GROUP BY 1)
SELECT a.query_id AS query_id, CAST(coalesce(scorable, 0) AS INTEGER) AS scorable, CAST(coalesce(full_, 0) AS INTEGER) AS fully_grounded, round((total - lost) / nullif(total, 0), 3) AS atom_grounded_rate,
 round(full_ / nullif(scorable, 0), 3) AS claim_grounded_rate, coalesce(array_to_string(un, ','), '') AS ungrounded FROM a LEFT JOIN g USING (query_id)""")
def claims_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each assistant turn held against the turn before it."""
    turns = table(spark, sf_dir, "conversations")
    answers = turns.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("context"))
    rows = answers.join(before, ["conv_id", "turn"], "left").withColumn("query_id", F.concat_ws("#", "conv_id", "turn"))
    return claims.score_claims(rows).withColumn("ungrounded", F.array_join(F.array_sort("ungrounded"), ","))


@query("""
WITH g AS (SELECT doc_id AS query_id, quality FROM labels), h AS (SELECT quality, count(*) AS n, sum(toxic) AS hits FROM labels GROUP BY quality),
c AS (SELECT quality, CAST(n AS DOUBLE) AS n, CAST(hits AS DOUBLE) / n AS p FROM h)
SELECT quality, CAST(n AS BIGINT) AS n, round(greatest(0, (p + 1.96*1.96/(2*n) - 1.96*sqrt(p*(1-p)/n + 1.96*1.96/(4*n*n))) / (1 + 1.96*1.96/n)), 3) AS lo,
 round(least(1, (p + 1.96*1.96/(2*n) + 1.96*sqrt(p*(1-p)/n + 1.96*1.96/(4*n*n))) / (1 + 1.96*1.96/n)), 3) AS hi FROM c""")
def ev_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "labels").groupBy("quality").agg(F.count("*").alias("n"), F.sum("toxic").alias("hits"))
    lo, hi = evaluate.wilson(F.col("hits"), F.col("n"))
    return counts.select("quality", "n", lo.alias("lo"), hi.alias("hi"))


@query("SELECT quality AS tax, CAST(sum(toxic) AS BIGINT) AS n_correct, count(*) AS n FROM labels GROUP BY quality")
def ev_accuracy_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.accuracy_by(table(spark, sf_dir, "labels").select(F.col("quality").alias("tax"), (F.col("toxic") == 1).alias("correct")), "tax")


@query("SELECT quality AS expected, toxic AS got, count(*) AS n FROM labels WHERE quality <> toxic GROUP BY ALL")
def ev_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.confusion(table(spark, sf_dir, "labels").select(F.col("quality").alias("expected"), F.col("toxic").alias("got")))


@query("SELECT count(*) AS n, list_sort(list(n_chars))[len(list(n_chars)) // 2 + 1] AS median, min(n_chars) AS least, max(n_chars) AS most FROM documents")
def ev_upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper median of all text lengths, by counting between cut points rather than gathering them."""
    return places.upper_median_by(table(spark, sf_dir, "documents").select("n_chars"), "n_chars")
