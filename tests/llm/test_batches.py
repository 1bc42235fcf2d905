"""Results do not depend on how rows are dealt into partitions and batches."""

import pytest
from pyspark.sql import functions as F

from survista.llm import chat, html, neardup, packing, pii, quality, secrets, substrings, topk


def cut(df):
    return substrings.without_repeats(df).select("doc_id", "n_removed", "n_spans", F.md5("kept"))


def mains(df):
    return html.extract(df.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://h.x/"), F.col("doc_id")).alias("url"), F.concat(F.lit("<nav>a b c d e f g h i</nav><p>"), F.col("text"), F.lit("</p>")).alias("html")))


def nearest(df):
    v = df.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("row"), F.col("doc_id").alias("vec_id"), F.array(*[(F.length("text") % k).cast("double") for k in (3, 5, 7)]).alias("vector")).dropDuplicates(["row"])
    v = v.where("forall(vector, x -> x IS NOT NULL)")
    return topk.top_k(v, v.where("vec_id % 7 = 0"), 3, shard=20, block=4).select("query_row", "rank", "vec_id", "score")


def turns(df):
    return chat.format_events(chat.events_of_turns(df.select((F.col("doc_id") % 3).alias("conv_id"), F.col("doc_id").alias("turn"), F.col("source").alias("role"), F.substring("text", 1, 40).alias("text"))), together=True).select("conv_id", "formatted")


OPS = {
    "quality": lambda df: quality.good_documents(df).select("doc_id", F.md5("text")), "top_k": nearest, "near": lambda df: neardup.near_duplicates(df, 4, 85), "secrets": secrets.scanned, "chat": turns,
    "pii": lambda df: pii.replace_entities(df).select("doc_id", F.md5("text")), "pieces": lambda df: packing.pieces(df, capacity=64), "cut": cut, "html": mains,
}


@pytest.mark.parametrize("name", [*OPS])
def test_batches_of_any_size(spark, docs, name):
    show = lambda df: sorted(map(str, df.collect()))
    want = show(OPS[name](docs.coalesce(1)))
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    spark.conf.set(rows, "2")
    try:
        assert show(OPS[name](docs.repartition(7))) == want
    finally:
        spark.conf.set(rows, before)
