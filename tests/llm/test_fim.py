"""Fill-in-middle against the contract's SQL and a plain version, by pieces of every size."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from wayfind.llm import fim
from wayfind.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "doc_id long, text string, n long, form string, k1 string, fim_tokens int"
TEXTS = [None, "", "a", "ab", " ", "\n", "one two", "<P", "<P>", "a<S>b", "<<M>", "< P>", "x<Px>", "漢字 é🙂é ab", "ab12cd" * 50, "<" * 70 + "P>", "z" * 200, "é" * 130, "a " * 20_000, "ab<" * 30_000 + "M>", "x" * 70_000]
ROWS = [(i, t) for k in range(6) for i, t in enumerate(TEXTS, 100 * k)] + [(None, "null id, some words"), (None, None), (5, "a b c"), (5, "a b c"), (5, "other text")]


def plain(doc_id, text):
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(tokens), "plain", None, None, sha(text), sha(text)
    spm = h[3] % 100 < 20
    out = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, len(tokens), "spm" if spm else "psm", len(p), len(m), sha(out), sha(text)


def order(rows):
    return sorted(map(str, rows))


def test_op11_odd_rows(spark):
    docs = spark.createDataFrame([(*r, 1, "f", "k", 2) for r in ROWS], SCHEMA)
    want = order(plain(*r) for r in ROWS)
    assert order(map(tuple, fim.fim_report(docs).collect())) == want
    assert {eval(r)[2] for r in want} == {"plain", "psm", "spm"}


@pytest.mark.parametrize("piece", [1, 7, 64, 300])
def test_op11_pieces_do_not_matter(spark, piece):
    rows = [r for r in ROWS if len(r[1] or "") < 400]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    same = lambda p: fim.fill_in_middle(docs, piece=p)
    assert order(same(piece).collect()) == order(same(32_768).collect())


def test_op11_many_blocks(spark):
    text = "ab, <P x" * 4000
    docs = spark.createDataFrame([(k, text) for k in range(20)], "doc_id long, text string")
    made = fim.fill_in_middle(docs, piece=20)  # 1,600 pieces, seven blocks
    assert made.where(F.col("fim_tokens") != len(re.findall("[A-Za-z]+|[^A-Za-z]", text))).isEmpty()
    assert made.where(fim.restore(F.col("fim_output"), F.col("fim_form")) != F.col("text")).isEmpty()
    assert order(made.collect()) == order(fim.fill_in_middle(docs).collect())


def test_op11_scan_from_every_state():
    """Sums of parts compose to the sum of the whole, wherever it is cut."""
    text = "a<P>b <M <S>> <Px PS"
    whole = fim.Scan([text]).summary(0)
    for k in range(len(text) + 1):
        scan = fim.Scan([text[:k], text[k:]])
        (f, m), (g, n) = scan.summary(0), scan.summary(1)
        assert ([g[s] for s in f], [c + n[s] for c, s in zip(m, f, strict=True)]) == whole


def test_op11_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    found = con.sql(ORACLE_SQL["op11_fill_in_middle"])
    made = QUERIES["op11_fill_in_middle"](spark, small)
    assert made.columns == found.columns
    assert order(map(tuple, made.collect())) == order(found.fetchall())


def test_op11_empty_table(spark):
    assert fim.fim_report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_op11_keeps_columns_and_parameters(spark):
    docs = spark.createDataFrame([(k, "some words here", "x") for k in range(50)], "id long, body string, doc_id string")
    made = fim.fill_in_middle(docs, "id", "body", plain_from=100, spm_below=100)
    assert made.columns[:3] == ["id", "body", "doc_id"]
    assert {r["fim_form"] for r in made.collect()} == {"spm"}
