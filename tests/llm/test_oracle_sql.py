"""The SQL of the queries agrees with the operators on repeated and null ids and on relative links."""
from collections import Counter

import duckdb
import pandas as pd

from sentiscope.llm import decontaminate, merkle, minhash, url_filter
from sentiscope.llm.oracle import ORACLE


def rows_of(sql, columns, **tables):
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        con.register(f"_{name}", pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")], dtype=object))
        casts = ", ".join(f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in schema.split(", "))
        con.execute(f"CREATE TABLE {name} AS SELECT {casts} FROM _{name}")
    return Counter(con.execute(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall())


def agree(df, sql, **tables):
    assert Counter(map(tuple, df.collect())) == rows_of(sql, df.columns, **tables)


DOCUMENTS = "doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT"


def test_documents_with_repeated_and_null_ids(spark, edge_docs, edge_rows):
    short = [r[:5] for r in edge_rows if len(r[1] or "") < 50_000]
    docs = spark.createDataFrame(short, "doc_id long, text string, lang string, source string, n_chars long")
    items = [(1, "Alpha3 beta3 alpha4 beta4 alpha5 beta5 alpha6 beta6 alpha7 beta7 ALPHA8"), (2, "one"), (3, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    tables = {"documents": (short, DOCUMENTS), "benchmark": (items, "item_id BIGINT, text VARCHAR")}
    agree(decontaminate.hit_report(docs, bench), ORACLE["op3_decontamination"], **tables)
    agree(minhash.near_duplicates(docs, 85, 100), ORACLE["op5_minhash_dedup"], **tables)
    agree(merkle.verify_documents(docs), ORACLE["op11_merkle_manifest"], **tables)


def test_pages_with_relative_links(spark):
    def page(target):
        return f'<html><link rel="canonical" href="{target}"></html>'

    urls = [("http://a.example.com/x/y.html", "../de/z"), ("http://b.example.com/q/", "r/./s/.."), ("http://c.example.com/p?x=1", "?id=3"),
            ("http://c.example.com/p?id=3", "#top"), ("http://d.example.com", "de/x"), ("http://e.example.com/a/b", "/de/../../de/k"),
            ("http://f.example.com/m", "//g.net/n"), ("http://h.example.com/o", "mailto:me"), ("plain", "rel"), (None, "x"),
            ("http://example.com/de/z", ""), ("http://a.example.com/de/z", "https://k.org/fr/1"), ("http://k.org/other", "fr/1")]
    rows = [(i, u, page(t)) for i, (u, t) in enumerate(urls)] + [(99, "http://c.example.com/p", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    agree(url_filter.judge_pages(pages), ORACLE["op10_url_filter"], pages=(rows, "page_id BIGINT, url VARCHAR, html VARCHAR"))
