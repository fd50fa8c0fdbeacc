"""Ranked lexical search: postings kept by term bucket, integer scores, the best documents of each item.

``build_index`` reads the documents once and writes postings (term, doc, doc_id, tf, n), partitioned by a hash of
the term; bucket -1 has a row for each document with its number of terms. Frequent terms don't fill a task: rows
go to tasks by bucket and by a slice of the documents. Where the terms to be asked for are known, only their
postings are kept; the counts of documents and terms are those of all.

``search`` joins the items' terms to their postings, scores each posting once, moves the scores of a document
together and sums them by item and document there, so that (item, document) pairs are never shuffled; a window
takes each item's first k, with a limit before its exchange. Items' terms are broadcast up to ``BROADCAST_TERMS``
rows, else joined by shuffle.

Score, all in 64-bit integers but for the logarithm: w * ((1000000000 * tf) div (1000 * tf + 8 * m)) summed over
the item's terms, repeats included; w = floor(1000 * ln((2N + 2) / (2 df + 1))); m = 25 + (75 * n * N) div L.

Defined results: null texts and texts without terms are in no result and not in N; items without terms, or with no
document above 0, give no rows; each row of documents is a document and each row of items an item, also with equal
or null ids; equal scores go by ascending doc_id, nulls last, then by the order of reading. Other columns are
left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, mapped, slices

#: Runs of ASCII letters and digits and of bytes beyond ASCII: in UTF-8 just the runs of such code points.
TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: The same as a pattern over code points.
TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

BUCKETS = 32
#: Rows of terms, about 100 bytes each, that may be broadcast.
BROADCAST_TERMS = 200_000

POSTINGS = "term string, doc long, doc_id long, tf long, n long"
INDEX = POSTINGS + ", bucket int"


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each distinct term of a document, and one without a term for the document itself."""
    schema = pa.schema([("term", pa.string()), ("doc", pa.int64()), ("doc_id", pa.int64()), ("tf", pa.int64()), ("n", pa.int64())])
    doc = TaskContext.get().partitionId() << 32
    for batch in batches:
        for piece in slices(batch, mb=1.0):
            terms, docs, ids, tfs, ns = [], [], [], [], []
            for doc_id, text in zip(piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()):
                found = Counter(TERM.findall(text.encode("utf-8", "surrogatepass").lower())) if text else {}
                k = 1 + len(found)
                terms.append(None)
                terms += found
                tfs.append(0)
                tfs += found.values()
                docs += [doc] * k
                ids += [doc_id] * k
                ns += [sum(found.values())] * k
                doc += 1
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.binary()).cast(pa.string()), pa.array(docs, pa.int64()), pa.array(ids, pa.int64()), pa.array(tfs, pa.int64()), pa.array(ns, pa.int64())], schema=schema)


def postings(docs: DataFrame) -> DataFrame:
    """term, doc (number of the row), doc_id, tf, n (terms of the document); a null term stands for the document."""
    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _postings, POSTINGS)


def bucket_of(term) -> F.Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _small(df: DataFrame) -> DataFrame:
    """The frame, broadcast if a count proves it small."""
    return F.broadcast(df) if df.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else df


def build_index(docs: DataFrame, path: str, terms: DataFrame | None = None) -> DataFrame:
    """Writes the postings of ``docs`` under ``path``, of the distinct ``terms`` (column term) alone where given."""
    spark = docs.sparkSession
    found = postings(docs)
    if terms is not None:
        asked = terms.select("term").distinct().withColumn("asked", F.lit(True))
        found = found.join(_small(asked), "term", "left").where("term is null or asked").drop("asked")
    found = found.withColumn("bucket", F.coalesce(F.when(F.col("term").isNotNull(), bucket_of("term")), F.lit(-1)))
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    slices_ = max(1, -(-4 * n // BUCKETS))
    dealt = found.repartition(n, "bucket", F.pmod(F.xxhash64("doc"), F.lit(slices_)))
    dealt.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(path)
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(path)


def item_terms(items: DataFrame) -> DataFrame:
    """item (number of the row), item_id, term, times."""
    numbered = items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), F.translate("text", UPPER, LOWER).alias("text"))
    rows = numbered.select("item", "item_id", F.explode(F.regexp_extract_all("text", F.lit(TERM_PATTERN), F.lit(0))).alias("term"))
    return rows.groupBy("item", "item_id", "term").agg(F.count("*").alias("times"))


def search(index: DataFrame, asked: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score of the ``k`` best documents of each item; ``asked`` as ``item_terms`` gives it, written."""
    whole = index.where("bucket = -1").agg(F.coalesce(F.count_if(F.col("n") > 0), F.lit(0)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    n_docs, n_terms = whole["docs"], max(whole["terms"], 1)
    wanted = _small(asked.select("term").distinct())
    hits = index.where("bucket >= 0").join(wanted, "term", "left_semi")
    in_docs = hits.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    weights = _small(in_docs.select("term", weight.alias("w")))
    m = F.expr(f"25 + ((75L * n * {n_docs}L) div {n_terms}L)")
    scored = hits.join(weights, "term").withColumn("m", m).select("term", "doc", "doc_id", F.expr("w * ((1000000000L * tf) div (1000L * tf + 8L * m))").alias("part"))
    parts = max(1, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sums = scored.repartition(parts, "doc").join(_small(asked), "term").groupBy("doc", "doc_id", "item", "item_id").agg(F.sum(F.col("part") * F.col("times")).alias("score"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "doc")
    first = sums.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return first.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "search")
    asked = scratch.write(item_terms(spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "asked")
    index = build_index(spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{scratch.path}/index", asked)
    found = scratch.write(search(index, asked), "result")
    scratch.drop("asked", "index")
    return found


OP12_SQL = rf"""
with item_terms as (
    select item, item_id, term, count(*) as times
    from (select item, item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM_PATTERN}')) as term
          from (select row_number() over () as item, item_id, text from benchmark))
    group by all
),
docs as (
    select row_number() over () as doc, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM_PATTERN}') as terms
    from documents where text is not null
),
whole as (select count(*) as n_docs, sum(len(terms))::bigint as n_terms from docs where len(terms) > 0),
found as (
    select doc, doc_id, n, term, count(*) as tf
    from (select doc, doc_id, len(terms) as n, unnest(terms) as term from docs)
    where term in (select term from item_terms) group by all
),
weights as (
    select term, floor(1000.0 * ln((2 * any_value(n_docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w
    from found cross join whole group by term
),
sums as (
    select item, item_id, doc, doc_id,
        sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + ((75 * n * n_docs) // n_terms)))))::bigint as score
    from found join weights using (term) join item_terms using (term) cross join whole group by all
)
select item_id, rank::int as rank, doc_id, score from (
    select *, row_number() over (partition by item order by score desc, doc_id, doc) as rank from sums where score > 0)
where rank <= 10
"""
