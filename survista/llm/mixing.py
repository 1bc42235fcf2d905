"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame functions only).

Targets are water-filled: weight shares of all words, held at `epochs` times a source's own words,
the excess shared again by weight. The words of each source, its documents in a keyed shuffle, are
laid end to end and cut into equal blocks (they differ by one word at most), as many as BLOCK words a block make,
and PARTS at least, so that a small source has small ones. A source gets as many slots of the mix as its target holds
of its blocks. All slots stand side by side, source after source; slot i of the mix is the one that the van der Corput
point of i falls on, in whole numbers (the bits of i mirrored), so that every stretch of the mix has each
source in about its share. The r-th slot of a source takes its block r modulo its blocks: passes over a
source differ by one block at most, and what is taken misses the target by half a block at most.

Defined results: null text has size 0 and takes 0; null sources form one source, placed last; a
repeated row is a document of its own; an empty table gives an empty table; equal shuffle keys are
ordered by doc_id and size; a very long text spans as many blocks as it holds, in pieces of its row's own;
other columns of the input are kept by `mixed_documents` and ignored here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from survista.llm.common import discard, materialize, n_words, prefix_sum

WEIGHTS = (5, 2, 1)
EPOCHS = 3
#: Words of a block at most.
BLOCK = 8192
#: Blocks of a source at least, or as many as it has words.
PARTS = 256
#: Slots made by one task at once, and ranked together.
STRETCH = 65536
#: Documents ranked together, on the average.
TOGETHER = 512


def targets(sized: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS, block: int = BLOCK) -> DataFrame:
    """One row a source: source, source_size, weight, target, blocks, slots, low (slots of the sources before it),
    source_no. What orders all sources in one task has a row a source, not a document."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    one = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    one = one.withColumn("weight", w.cast("long")).withColumn("cap", F.col("source_size") * epochs)
    fill = Window.orderBy((F.col("cap").cast("double") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    so_far = fill.rowsBetween(Window.unboundedPreceding, -1)
    one = (
        one.withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(so_far), F.lit(0)))
        .withColumn("shares", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(so_far), F.lit(0)))
        .withColumn("level", F.col("left").cast("double") / F.col("shares"))
        # the level at the first source that its cap does not hold is the level of all after it
        .withColumn("free", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")))
        .withColumn("level", F.min_by("free", F.when(F.col("free").isNotNull(), F.col("shares") * -1)).over(whole))
    )
    target = F.least(F.col("level") * F.col("weight"), F.col("cap").cast("double"))
    one = one.withColumn("target", F.coalesce(target, F.lit(0.0)))
    size = F.col("source_size")
    blocks = F.greatest(F.expr(f"(source_size + {block - 1}) div {block}"), F.least(size, F.lit(PARTS)))
    # held just off halves, so that a count is rounded alike however the sums before it were taken
    slots = F.when(size > 0, F.floor(F.round(target / size * F.col("blocks"), 6) + 0.5)).otherwise(0).cast("long")
    one = one.withColumn("blocks", blocks.cast("long")).withColumn("slots", slots)
    low = F.coalesce(F.sum("slots").over(by_name.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return one.select("source", "source_size", "weight", "target", "blocks", "slots", low.alias("low"), (F.row_number().over(by_name)).alias("source_no"))


def van_der_corput(i, bits: int):
    """The lowest `bits` bits of i mirrored."""
    return F.conv(F.reverse(F.lpad(F.bin(i), bits, "0")), 2, 10).cast("long")


def schedule(per_source: DataFrame, slots: int) -> DataFrame:
    """slot, source_no, rank, block of each slot of the mix, in the order of slot. Place v of all slots side by side is the
    van der Corput point of slot v mirrored, so each source makes its own slots, in stretches."""
    bits = max(1, (slots - 1).bit_length())
    s = per_source.where("slots > 0").select("source_no", "low", "blocks", "slots", F.explode(F.expr(f"sequence(0L, (slots - 1) div {STRETCH})")).alias("_part"))
    s = s.repartition("source_no", "_part").select("source_no", "low", "blocks", F.explode(F.expr(f"sequence(_part * {STRETCH}, least(slots, (_part + 1) * {STRETCH}) - 1)")).alias("_v"))
    s = s.select("source_no", "blocks", van_der_corput(F.col("low") + F.col("_v"), bits).alias("slot"))
    s = s.withColumn("_stretch", F.expr(f"slot div {STRETCH}")).withColumn("_one", F.lit(1).cast("long"))
    s = prefix_sum(s, ["source_no"], "_stretch", ["slot"], "_one", "rank")
    return s.select("slot", "source_no", "rank", (F.col("rank") % F.col("blocks")).alias("block"))


def mix(docs: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS, seed: str = "mix", block: int = BLOCK) -> DataFrame:
    """doc_id, row_key, size, source, source_size, target, taken of every row of docs; `no_id` tells rows without doc_id apart."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    no_id = F.when(F.col("doc_id").isNull(), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    sized = materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), key.alias("row_key"), no_id.alias("no_id")), "mix-sizes")
    per_source = materialize(targets(sized, weights, epochs, block), "mix-sources")
    n, slots = sized.count(), per_source.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    times = schedule(per_source, slots).groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("times"))
    digits = 1
    while n > TOGETHER * 16**digits:
        digits += 1
    placed = prefix_sum(sized.withColumn("bucket", F.substring("row_key", 1, digits)), ["source"], "bucket", ["row_key", "doc_id", "size", "no_id"], "size", "start")
    placed = placed.join(per_source.withColumnRenamed("source", "_name").drop("weight", "slots", "low"), F.col("source").eqNullSafe(F.col("_name"))).drop("_name", "bucket")
    placed = materialize(placed.withColumn("row_no", F.monotonically_increasing_id()), "mix-places")
    discard(sized)
    # block k of a source holds its words from k * size div blocks on
    edge = "({} * source_size) div blocks"
    of = "(cast(({0} + 1) AS decimal(38,0)) * blocks - 1) div source_size"
    cut = placed.where("size > 0").select("row_no", "source_no", "start", "size", "source_size", "blocks", F.explode(F.expr(f"sequence({of.format('start')}, {of.format('(start + size - 1)')})")).alias("block"))
    high, low = (F.expr(edge.format(f"cast({k} AS decimal(38,0))")) for k in ("block + 1", "block"))
    span = (F.least(F.col("start") + F.col("size"), high) - F.greatest(F.col("start"), low)).cast("long")
    taken = cut.withColumn("span", span).join(times, ["source_no", "block"]).groupBy("row_no").agg(F.sum(F.col("span") * F.col("times")).alias("taken"))
    out = placed.join(taken, "row_no", "left")
    return out.select("doc_id", "row_key", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "no_id")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS, seed: str = "mix") -> DataFrame:
    """The documents as the mix takes them: each as often as its words are taken, to the nearest whole
    document where a block ends inside; those never taken go, wordless ones too. All columns of docs are
    kept; copies carry the doc_id of their document."""
    m = mix(docs, weights, epochs, seed)
    copies = F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1)) + 0.5).cast("int")
    m = m.groupBy(F.col("doc_id").alias("_id"), F.col("size").alias("_size"), F.col("no_id").alias("_no_id")).agg(F.max(copies).alias("_copies")).where("_copies > 0")
    no_id = F.when(F.col("doc_id").isNull(), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_doc"), n_words(F.col("text")).alias("_n"), no_id.alias("_key"))
    j = d.join(m, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_n") == F.col("_size")) & F.col("_key").eqNullSafe(F.col("_no_id")))
    return j.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


_MIRRORED = "CAST(list_sum(list_transform(range(0, bits), lambda x: ((p >> x) & 1) * (1::BIGINT << (bits - 1 - x)))) AS BIGINT)"
ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS k, CASE WHEN doc_id IS NULL THEN md5(coalesce(text, '')) END AS no_id,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size
  FROM documents),
one AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight,
         source_size * 3 AS cap FROM one),
filled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER f, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0)) AS level,
         sum(weight) OVER () - coalesce(sum(weight) OVER f, 0) AS shares
  FROM weighed WINDOW f AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
held AS (SELECT *, (SELECT arg_max(level, shares) FROM filled WHERE level * weight <= cap) AS held_at FROM filled),
aimed AS (SELECT source, source_size, least(held_at * weight, cap::DOUBLE) AS target,
                 greatest((source_size + {BLOCK - 1}) // {BLOCK}, least(source_size, {PARTS}))::BIGINT AS blocks FROM held),
counted AS (SELECT *, CASE WHEN source_size > 0 THEN floor(round(target / source_size * blocks, 6) + 0.5) ELSE 0 END::BIGINT AS slots FROM aimed),
listed AS (SELECT *, coalesce(sum(slots) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS low FROM counted),
width AS (SELECT greatest(1, ceil(log2(greatest(2, sum(slots))))::INT) AS bits FROM counted),
points AS (SELECT source, blocks, low + unnest(range(0, slots)) AS p FROM listed WHERE slots > 0),
ranked AS (SELECT source, blocks, row_number() OVER (PARTITION BY source ORDER BY {_MIRRORED}) - 1 AS r FROM points, width),
times AS (SELECT source, r % blocks AS block, count(*) AS times FROM ranked GROUP BY ALL),
placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id NULLS FIRST, size, no_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
         row_number() OVER () AS row_no FROM sized),
cut AS (
  SELECT row_no, p.source, start, size, source_size, blocks, unnest(range((((start + 1)::HUGEINT * blocks - 1) // source_size)::BIGINT, (((start + size)::HUGEINT * blocks - 1) // source_size + 1)::BIGINT)) AS block
  FROM placed p JOIN aimed a ON p.source IS NOT DISTINCT FROM a.source WHERE size > 0),
took AS (
  SELECT row_no, sum((least(start + size, (cut.block + 1)::HUGEINT * source_size // blocks) - greatest(start, cut.block::HUGEINT * source_size // blocks)) * times)::BIGINT AS taken
  FROM cut JOIN times ON cut.block = times.block AND cut.source IS NOT DISTINCT FROM times.source GROUP BY row_no)
SELECT p.doc_id, p.size, a.source_size, a.target, coalesce(t.taken, 0)::BIGINT AS taken
FROM placed p JOIN aimed a ON p.source IS NOT DISTINCT FROM a.source LEFT JOIN took t ON t.row_no = p.row_no
"""
