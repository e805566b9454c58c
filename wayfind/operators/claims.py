"""Claim grounding: what an answer asserts, and what of it stands in the context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfind.functions.text import AFTER, BEFORE, WHITE

# Shapes of checkable atoms.
ID = r"([A-Z][A-Za-z]*-[A-Z0-9]+)"
DATE = r"(\d{4}-\d{2}-\d{2})"
PERSON = r"([가-힣]{2,4})(?=\s*(?:씨|님|과장|대리|부장|팀장|사원|이사))"
STATUS = rf"{BEFORE}(in_progress|completed|on_hold|planning|resolved|closed|open|active|critical|high|medium|low){AFTER}"
NUMBER = r"(\d[\d,]*(?:\.\d+)?\s*(?:%|건|명|개|원|초|분|시간|일|ms|GB|MB)?)"
SENTENCE_END = r"(?<=[.!?])\s+|\n+|(?<=(?:다|요|음|임))\s*[.。]\s*"
MENTIONED_PERSON = r"([가-힣]{2,4})(?=\s*(?:씨|님|과장|대리|부장|팀장))"
UNIT = r"\d{2,}|[%건명개원초분일]|ms|GB|MB|시간"

#: White space, of which Java's own \\s has the ASCII part only.
_ENDS = " \t\r\n\x0b\x0c\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def _white(pattern: str) -> str:
    return pattern.replace(r"\s", f"[{WHITE}]")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), _white(SENTENCE_END)), lambda s: F.btrim(s, F.lit(_ENDS))), lambda s: s != "")


def _all(text: Column, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(_white(pattern)), F.lit(1)), lambda s: F.btrim(s, F.lit(_ENDS)))


def atoms(sentence: Column) -> Column:
    """Distinct identifiers, dates, persons, states, and numbers with a unit or two digits."""
    numbers = F.filter(_all(sentence, NUMBER), lambda v: v.rlike(UNIT))
    return F.array_distinct(F.concat(*[_all(sentence, p) for p in (ID, DATE, PERSON, STATUS)], numbers))


def in_context(atom: Column, context: Column) -> Column:
    """As written, without commas and spaces, or its number alone as a word."""
    bare = F.regexp_replace(atom, f"[,{WHITE}]", "")
    number = F.replace(F.regexp_extract(atom, r"^(\d[\d,]*)", 1), F.lit(","), F.lit(""))
    words = F.regexp_extract_all(F.replace(context, F.lit(","), F.lit("")), F.lit(rf"{BEFORE}(\d+){AFTER}"), F.lit(1))
    return F.contains(context, atom) | ((bare != "") & F.contains(F.regexp_replace(context, f"[,{WHITE}]", ""), bare)) | ((number != "") & F.array_contains(words, number))


def score_claims(answers: DataFrame) -> DataFrame:
    """answers: query_id, answer, context. query_id, scorable, fully_grounded, atom_grounded_rate, claim_grounded_rate (three
    places, null without anything to score), ungrounded (array)."""
    split = answers.withColumn("sents", sentences(F.col("answer"))).withColumn("context", F.coalesce("context", F.lit("")))
    found = split.withColumn("claims", F.transform("sents", lambda s: F.struct(atoms(s).alias("atoms"))))
    checked = found.withColumn("claims", F.transform("claims", lambda c: F.struct(c["atoms"].alias("atoms"), F.filter(c["atoms"], lambda a: ~in_context(a, F.col("context"))).alias("missing"))))
    checked = checked.withColumn("claims", F.filter("claims", lambda c: F.size(c["atoms"]) > 0))
    count = lambda f: F.aggregate("claims", F.lit(0), lambda s, c: s + f(c))
    out = checked.withColumns({"scorable": F.size("claims"), "full": count(lambda c: F.when(F.size(c["missing"]) == 0, 1).otherwise(0)), "total": count(lambda c: F.size(c["atoms"])), "lost": count(lambda c: F.size(c["missing"]))})
    return out.select(
        "query_id", "scorable", F.col("full").alias("fully_grounded"),
        F.round((F.col("total") - F.col("lost")) / F.nullif("total", F.lit(0)), 3).alias("atom_grounded_rate"),
        F.round(F.col("full") / F.nullif("scorable", F.lit(0)), 3).alias("claim_grounded_rate"),
        F.flatten(F.transform("claims", lambda c: c["missing"])).alias("ungrounded"),
    )


def completeness(rows: DataFrame) -> DataFrame:
    """rows: query_id, required (array), context. query_id, covered, missing, rate (null if nothing is required)."""
    out = rows.withColumn("covered", F.filter("required", lambda r: in_context(r, F.col("context")))).withColumn("missing", F.filter("required", lambda r: ~in_context(r, F.col("context"))))
    return out.select("query_id", "covered", "missing", F.round(F.size("covered") / F.nullif(F.size("required"), F.lit(0)), 3).alias("rate"))


def outside_mentions(answer: Column, context: Column) -> Column:
    """Identifiers and titled persons of the answer that the context does not hold."""
    named = F.array_distinct(F.concat(_all(answer, ID), _all(answer, MENTIONED_PERSON)))
    return F.filter(named, lambda n: ~F.contains(context, n))
