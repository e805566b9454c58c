"""Readers and the Markdown chunker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEADING = r"^#{1,3}\s+"
MOST_CHARS = 1200


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One object a line; blank lines are skipped."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def read_json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("multiLine", True).json(path)


def read_markdown(spark: SparkSession, folder: str, index: str) -> DataFrame:
    """filename, title, type, text of the files that an index (JSON array of filename, title, type) names; a missing file raises."""
    names = read_json_array(spark, index, "filename string, title string, type string")
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md").select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("filename"), F.col("value").alias("text"))
    missing = names.join(files, "filename", "left_anti").select("filename").limit(5).collect()
    if missing:
        raise FileNotFoundError(", ".join(r[0] for r in missing))
    return names.join(files, "filename")


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 1, **options: str) -> DataFrame:
    """A table of an external database (SQLite, PostgreSQL and others whose driver is on the class path). With a whole-number
    key and its bounds the rows are read in `parts` ranges of it, each by a task; rows outside the bounds come too."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts))
    return reader.load()


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\x0B]+|[\s\x0B]+$", "")


def chunk_markdown(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, chunk_index, section, content. A section (heading of level 1 to 3 and body) is whole up to MOST_CHARS; a larger one
    is cut at blank lines, each piece as large as fits. Text before the first heading is section (head). Empty sections go.
    """
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), "\r\n", "\n")
    # A heading begins a section unless nothing stands before it; cut before each line that is one.
    parts = docs.select(F.col(id_col), F.posexplode(F.split(text, r"(?m)(?=^#{1,3}[ \t]+)")).alias("sec", "body"))
    parts = parts.withColumn("content", _trim(F.col("body"))).where("content <> ''")
    title = _trim(F.regexp_extract("content", r"^#{1,3}[ \t]+([^\n]*)", 1))
    parts = parts.withColumn("section", F.when(F.col("content").rlike(r"^#{1,3}[ \t]+"), title).otherwise("(head)"))
    # Greedy: a paragraph joins the open piece unless it would pass the limit (and the piece has something).
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("n"))

    def step(s: Column, p: Column) -> Column:
        full = s["open"].isNotNull() & (s["n"] + F.length(p) > MOST_CHARS)
        return F.when(full, F.struct(F.concat(s["done"], F.array(s["open"])).alias("done"), p.alias("open"), F.length(p).alias("n"))).otherwise(
            F.struct(s["done"].alias("done"), F.when(s["open"].isNull(), p).otherwise(F.concat(s["open"], F.lit("\n\n"), p)).alias("open"), (s["n"] + F.length(p)).alias("n"))
        )

    folded = F.aggregate(F.split("content", r"\n{2,}"), start, step)
    pieces = F.when(F.length("content") <= MOST_CHARS, F.array("content")).otherwise(F.concat(folded["done"], F.array(folded["open"])))
    out = parts.select(id_col, "sec", "section", F.posexplode(pieces).alias("piece", "content"))
    from pyspark.sql import Window

    w = Window.partitionBy(id_col).orderBy("sec", "piece")
    return out.select(id_col, (F.row_number().over(w) - 1).alias("chunk_index"), "section", "content")


def document_view(chunks: DataFrame) -> DataFrame:
    """id, title, body from chunks with JSON metadata: title and section, where there is one."""
    title, section = F.get_json_object("metadata", "$.title"), F.get_json_object("metadata", "$.section")
    return chunks.select("id", F.concat_ws(" - ", title, section).alias("title"), F.col("content").alias("body"))
