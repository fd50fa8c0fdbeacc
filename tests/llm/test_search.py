"""Ranked search against its SQL and against plain Python."""

import math
import re
from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from scribeflow.llm import lexical_search
from scribeflow.llm.common import Scratch

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k=10):
    """Sorted rows (item_id, rank, doc_id, score)."""
    held = [(d, Counter(terms_of(t))) for d, t in docs]
    n_docs, total = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item_id, text in items:
        best = []
        for at, (d, c) in enumerate(held):
            m = 25 + (75 * sum(c.values()) * n_docs) // total if c else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms_of(text) if c[t])
            if score > 0:
                best.append((-score, d is None, d or 0, at, d))
        out += [(item_id, r, x[4], -x[0]) for r, x in enumerate(sorted(best)[:k], 1)]
    return Counter(out)


def rows_of(df):
    return Counter(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()))


DOCS = [
    (1, "Stone light, stone river"), (2, "STONE light"), (3, "stone light"), (3, "stone light"), (None, "stone light"), (None, None), (4, None), (5, ""), (6, " .,!"), (7, "Élan élan É x stone"),
    (8, "river " * 2000 + "stone"), (9, "日本 stone-river_42"), (10, "light42 light 42"), *[(20 + i, f"filler word{i} light") for i in range(30)],
]
ITEMS = [(0, "Stone river"), (1, "stone stone LIGHT"), (1, "élan É 日本"), (None, "river"), (2, None), (3, ""), (4, "nowhere"), (5, "light"), (6, "42 light42")]


def frames(spark):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in DOCS], "doc_id long, text string, term string, n int").repartition(3)
    items = spark.createDataFrame([(i, t, "x") for i, t in ITEMS], "item_id long, text string, doc string")
    return docs, items


def test_op12_odd_texts(spark):
    docs, items = frames(spark)
    scratch = Scratch(spark, "t12")
    asked = scratch.write(lexical_search.item_terms(items), "asked")
    want = plain_search(DOCS, ITEMS)
    assert sum(want.values()) > 30
    for terms in (asked, None):
        index = lexical_search.build_index(docs, f"{scratch.path}/index-{terms is None}", terms)
        assert rows_of(lexical_search.search(index, asked)) == want
        assert rows_of(lexical_search.search(index, asked, 3)) == plain_search(DOCS, ITEMS, 3)


def test_op12_without_broadcasts(spark, monkeypatch):
    docs, items = frames(spark)
    monkeypatch.setattr(lexical_search, "BROADCAST_TERMS", 0)
    scratch = Scratch(spark, "t12")
    asked = scratch.write(lexical_search.item_terms(items), "asked")
    index = lexical_search.build_index(docs, f"{scratch.path}/index", asked)
    assert rows_of(lexical_search.search(index, asked)) == plain_search(DOCS, ITEMS)


def test_op12_index_is_bucketed_by_term(spark):
    docs, items = frames(spark)
    scratch = Scratch(spark, "t12")
    index = lexical_search.build_index(docs, f"{scratch.path}/index")
    assert index.where("bucket >= 0").groupBy("term").agg({"bucket": "min"}).count() == len({t for _, x in DOCS for t in terms_of(x)})
    assert index.where("bucket = -1").count() == len(DOCS)
    one = lexical_search.read_index(spark, f"{scratch.path}/index").where("bucket = 3")
    assert "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().executedPlan().toString()


def test_op12_whole_table_and_sql(spark):
    got = rows_of(lexical_search.op12_lexical_search(spark, SF))
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert got == plain_search(docs, items)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert got == Counter(con.sql(f"select item_id, rank, doc_id, score from ({lexical_search.OP12_SQL})").fetchall())


def test_op12_no_documents(spark, tmp_path):
    pq.write_table(pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([1], pa.int64()), "text": pa.array(["stone"], pa.string())}), tmp_path / "benchmark.parquet")
    assert lexical_search.op12_lexical_search(spark, str(tmp_path)).count() == 0


def test_sql_is_text():
    from scribeflow.llm import registry

    assert set(registry.ORACLES) <= set(registry.QUERIES) and all(isinstance(v, str) for v in registry.ORACLES.values())
