"""Removal of long byte strings that repeat, within documents or across them.

Every byte under a string of LENGTH bytes that also starts elsewhere goes. Sampled suffixes stand in for
all suffixes: of the LENGTH - GRAM + 1 grams of GRAM bytes in a string, the one with the least hash is the
string's anchor, so that equal strings have equal anchors at equal places, and strings that follow each
other mostly share theirs (a run). Repeated intervals are then refined by growing common prefixes, and
what stands alone drops out at each step without its suffixes ever being sorted again:

1. anchors with equal grams; runs among them with equal bytes throughout are repeated as a whole;
2. of the other runs, one for each content, pieces of CHUNK strings with equal common bytes;
3. single strings of the pieces that are left.

What a batch shows to be repeated within itself is counted there and sent once, so that neither a frequent
passage nor a periodic text gathers its occurrences in one task. Documents are told apart by a digest of
their text: equal texts have equal results, and count as places of their own.

Defined results: null text is empty; texts under LENGTH bytes lose nothing; repeated rows repeat each
other; an empty table gives an empty table; a cut inside a character leaves its bytes cut (in `text` of the query U+FFFD stands
for them); a very long text is worked on in segments; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from survista.llm.common import Places, bytes_of, discard, materialize, slices, trimmed
from survista.llm.rolling import Ranges, mix, parts

LENGTH = 400
#: Texts marked at most, 4 bytes each on their way.
MARKS = 1 << 22
GRAM = 200
CHUNK = 25
#: Bytes of a longer text worked on at once; the low bits of a key hold the place within.
SEGMENT = 1 << 18
PLACE = np.uint64((1 << 24) - 1)


def runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(gram hash, content hash, row, start, strings, anchor) arrays, one entry a run: `strings` strings
    from `start` on, places counted from the start of data."""
    n, w = len(data), length - gram + 1
    if n < length:
        return None
    r = Ranges(data)
    grams = r.of(slice(0, n - gram + 1), slice(gram, n + 1))
    # least hash of each w grams, leftmost of equal ones: hash above, place below
    m, count = len(grams), n - length + 1
    blocks = np.full((-(-m // w), w), np.uint64(2**64 - 1))
    blocks.ravel()[:m] = (grams & ~PLACE) | np.arange(m, dtype=np.uint64)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    anchor = (np.minimum(back[:count], ahead[w - 1 : w - 1 + count]) & PLACE).astype(np.int64)
    inside = np.zeros(count + 1, np.int64)
    long = np.diff(offsets) >= length
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[1:][long] - length + 1, -1)
    at = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(at):
        return None
    of = anchor[at]
    new = np.ones(len(at), bool)
    new[1:] = (of[1:] != of[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(at)))
    start, of = at[first], of[first]
    content = mix(r.raw(start, start + size - 1 + length) + mix((of - start).astype(np.uint64) * np.uint64(1 << 20) + size.astype(np.uint64)))
    return grams[of], content, np.searchsorted(offsets, start, side="right") - 1, start, size, of


def pieces_of(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(place of the first byte in its text, bytes, offsets): a part as it is, a longer text in segments that overlap."""
    if len(data) <= SEGMENT:
        yield 0, data, offsets
        return
    for s in range(0, len(data) - length + 1, SEGMENT):
        part = data[s : s + SEGMENT + length - 1]
        yield s, part, np.array([0, len(part)], np.int64)


def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges that overlap or touch as one, in order."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(hi[order])
    new = np.flatnonzero(np.append(True, lo[1:] > reach[:-1]))
    return lo[new], reach[np.append(new[1:], len(lo)) - 1]


def place(doc):
    """One of 2 ** 24 places of a text's digest."""
    return F.conv(F.hex(F.substring(doc, 1, 3)), 16, 10).cast("int").alias("place")


def places_of(docs: DataFrame):
    """A table of bits, 2 MB, that tells which texts may be among docs; none where so many are that it would spare little."""
    marks, places = None, docs.select(place(F.col("doc"))).distinct()
    if places.count() <= MARKS:
        marks = Places(places.toArrow()["place"].to_numpy())
    return docs.sparkSession.sparkContext.broadcast(marks)


def _among(marked):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows that may be among those marked; the last column is their place."""
        for b in batches:
            if marked.value is not None:
                b = b.filter(pa.array(marked.value.has(b.column("place").to_numpy())))
            yield b.drop_columns(["place"])

    return run


SPAN = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
RUNS = "doc binary, gram bigint, content bigint, start bigint, strings int, before int, times int, spans array<struct<lo:bigint,hi:bigint>>"


def _anchors(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs = b.column(0)
            got = []
            for row, data, offsets in parts(b.column(1)):
                for base, piece, edges in pieces_of(data, offsets, length):
                    if (r := runs(piece, edges, length, gram)) is not None:
                        g, c, doc, start, size, of = r
                        got.append((g, c, doc + row, start - edges[doc] + base, size, of - start))
            if not got:
                continue
            g, c, doc, start, size, before = (np.concatenate(x) for x in zip(*got, strict=True))
            order = np.lexsort((c, g))
            g, c, doc, start, size, before = (x[order] for x in (g, c, doc, start, size, before))
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(g)))
            twice = np.repeat(times > 1, times)
            by = np.argsort(doc[twice], kind="stable")
            own, at = np.unique(doc[twice][by], return_index=True)
            m = len(own)
            lo = start[twice][by]
            hi = lo + size[twice][by] - 1 + length
            found = [merged(lo[i:k], hi[i:k]) for i, k in zip(at, np.append(at, len(lo))[1:], strict=True)]
            edges = np.append(0, np.cumsum([len(x) for x, _ in found])).astype(np.int32)
            ends = [pa.array(np.concatenate([f[k] for f in found] or [np.zeros(0)]).astype(np.int64)) for k in (0, 1)]
            spans = pa.ListArray.from_arrays(pa.array(edges), pa.StructArray.from_arrays(ends, ["lo", "hi"]))
            # rows of spans only are spread by a gram that nothing else has a reason to have
            loose = mix(np.arange(m, dtype=np.uint64) + np.frombuffer(hashlib.blake2b(repr(docs[0]).encode(), digest_size=8).digest(), np.uint64))
            ints = lambda a, t, k=m: pa.concat_arrays([pa.array(a.astype(t)), pa.nulls(k, pa.from_numpy_dtype(t))])
            yield pa.RecordBatch.from_arrays(
                [
                    docs.take(pa.array(np.concatenate([doc[first], own]).astype(np.int64))),
                    pa.array(np.concatenate([g[first], loose]).view(np.int64)), ints(c[first].view(np.int64), np.int64), ints(start[first], np.int64),
                    ints(size[first], np.int32), ints(before[first], np.int32), ints(times, np.int32), pa.concat_arrays([pa.nulls(len(first), SPAN), spans.cast(SPAN)]),
                ],
                [x.split()[0] for x in RUNS.replace("lo:bigint,hi:bigint", "").split(", ")],
            )

    return run


OPEN = "doc binary, gram bigint, start bigint, before int, bytes binary"


def _contexts(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in slices(whole, bytes_of(whole.column("text")))):
            doc, gram, start, before, cut = [], [], [], [], []
            for d, text, wanted in zip(b.column("doc"), b.column("text"), b.column("wanted").to_pylist(), strict=True):
                raw = text.as_py().encode()
                for w in wanted:
                    doc.append(d.as_py())
                    gram.append(w["gram"])
                    start.append(w["start"])
                    before.append(w["before"])
                    cut.append(raw[w["start"] : w["start"] + w["strings"] - 1 + length])
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.binary()), pa.array(gram, pa.int64()), pa.array(start, pa.int64()), pa.array(before, pa.int32()), pa.array(cut, pa.binary())],
                ["doc", "gram", "start", "before", "bytes"],
            )

    return run


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _chunks(length: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chunk j of a run: its strings that start chunk * j to chunk * j + chunk - 1 bytes before the anchor."""
        for b in batches:
            data, offsets = _bytes(b.column("bytes"))
            r = Ranges(data)
            before = b.column("before").to_numpy().astype(np.int64)
            after = np.diff(offsets) - length - before  # strings that start behind the anchor's place: none, or negative
            low, high = np.maximum(0, -after) // chunk, before // chunk
            many = high - low + 1
            row = np.repeat(np.arange(len(before)), many)
            j = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + low[row]
            # the bytes that all strings of the chunk have, as far as they are in this run
            lo = np.maximum(0, before[row] - chunk * j)
            hi = before[row] - chunk * j - (chunk - 1) + length
            lo, hi = offsets[:-1][row] + lo, np.minimum(offsets[:-1][row] + hi, offsets[1:][row])
            yield pa.RecordBatch.from_arrays(
                [pa.array(b.column("run").to_numpy()[row]), pa.array(b.column("gram").to_numpy()[row]), pa.array(j.astype(np.int32)), pa.array(r.of(lo, hi).view(np.int64))],
                ["run", "gram", "chunk", "content"],
            )

    return run


def _strings(length: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = _bytes(b.column("bytes"))
            r = Ranges(data)
            docs, runs_, grams, starts, contents = [], [], [], [], []
            before, size = b.column("before").to_numpy(), np.diff(offsets)
            first, gram, no = b.column("start").to_numpy(), b.column("gram").to_numpy(), b.column("run").to_numpy()
            for i, js in enumerate(b.column("chunks").to_pylist()):
                s = np.concatenate([np.arange(before[i] - chunk * j - chunk + 1, before[i] - chunk * j + 1) for j in js])
                s = s[(s >= 0) & (s <= size[i] - length)]
                docs.append(np.full(len(s), i))
                starts.append(s + first[i])
                grams.append(np.full(len(s), gram[i]))
                runs_.append(np.full(len(s), no[i]))
                contents.append(r.of(offsets[i] + s, offsets[i] + s + length).view(np.int64))
            at = pa.array(np.concatenate(docs).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc").take(at), pa.array(np.concatenate(runs_)), pa.array(np.concatenate(grams)), pa.array(np.concatenate(contents)), pa.array(np.concatenate(starts).astype(np.int64))],
                ["doc", "run", "gram", "content", "start"],
            )

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, chunk: int = CHUNK) -> DataFrame:
    """doc, spans: the repeated byte ranges of each distinct text (doc: its digest), not merged. docs: doc, text."""
    found = docs.mapInArrow(trimmed(_anchors(length, gram)), RUNS)
    same = Window.partitionBy("gram", "content")
    found = found.withColumn("no", F.row_number().over(same.orderBy("doc", "start"))).withColumn("equal", F.sum("times").over(same))
    found = found.withColumn("all", F.sum("times").over(Window.partitionBy("gram")))
    found = materialize(found.where("spans IS NOT NULL OR `all` > 1"), "repeats-runs")
    whole = found.where("equal > 1").select("doc", F.struct(F.col("start").alias("lo"), (F.col("start") + F.col("strings") - 1 + length).alias("hi")).alias("span"))
    local = found.where("spans IS NOT NULL").select("doc", F.explode("spans").alias("span"))
    wanted = found.where("equal < `all` AND no = 1").groupBy("doc").agg(F.collect_list(F.struct("gram", "start", "strings", "before")).alias("wanted"))
    # one document for each text: copies would find each other again
    wanted = materialize(wanted, "repeats-wanted")
    some = docs.select("doc", "text", place(F.col("doc"))).mapInArrow(trimmed(_among(places_of(wanted))), "doc binary, text string")
    one = some.join(wanted, "doc").select("doc", "text", "wanted").dropDuplicates(["doc"])
    open_runs = one.mapInArrow(trimmed(_contexts(length)), OPEN)
    open_runs = materialize(open_runs.withColumn("run", F.monotonically_increasing_id()), "repeats-open")
    alike = Window.partitionBy("gram", "chunk", "content")
    chunks = open_runs.select("run", "gram", "before", "bytes").mapInArrow(trimmed(_chunks(length, chunk)), "run bigint, gram bigint, chunk int, content bigint")
    chunks = chunks.withColumn("a", F.min("run").over(alike)).withColumn("b", F.max("run").over(alike)).where("a < b").groupBy("run").agg(F.collect_list("chunk").alias("chunks"))
    strings = open_runs.join(chunks, "run").select("doc", "run", "gram", "start", "before", "bytes", "chunks").mapInArrow(trimmed(_strings(length, chunk)), "doc binary, run bigint, gram bigint, content bigint, start bigint")
    alike = Window.partitionBy("gram", "content")
    strings = strings.withColumn("a", F.min("run").over(alike)).withColumn("b", F.max("run").over(alike)).where("a < b")
    single = strings.select("doc", F.struct(F.col("start").alias("lo"), (F.col("start") + length).alias("hi")).alias("span"))
    every = whole.unionByName(local).unionByName(single)
    spans = materialize(every.groupBy("doc").agg(F.collect_list("span").alias("spans")), "repeats-spans")
    discard(found, wanted, open_runs)
    return spans


CUT = "n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept, the remaining bytes, for every row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.unhex(F.md5(text)).alias("doc"))
    spans = repeated_spans(keyed.select("doc", "text").where(F.octet_length("text") >= length), length)
    marked = places_of(spans)

    def cut(b: pa.RecordBatch, los: np.ndarray, his: np.ndarray, edges: np.ndarray) -> pa.RecordBatch:
        size, gone, count, kept = [], [], [], []
        for k, text in enumerate(b.column("text")):
            raw = text.as_py().encode()
            lo, hi = merged(los[edges[k] : edges[k + 1]], his[edges[k] : edges[k + 1]])
            ends = zip([0, *hi.tolist()], [*lo.tolist(), len(raw)], strict=True)
            size.append(len(raw))
            gone.append(int((hi - lo).sum()))
            count.append(len(lo))
            kept.append(b"".join([raw[x:y] for x, y in ends]) if len(lo) else raw)
        return pa.RecordBatch.from_arrays(
            [b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (size, gone, count)), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
        )

    def with_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in slices(whole, bytes_of(whole.column("text")))):
            spans = b.column("spans")
            edges = np.append(0, np.cumsum(spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
            flat = spans.flatten()
            yield cut(b, *(flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1)), edges)

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for whole in batches:
            whole = whole.filter(pa.array(~marked.value.has(whole.column("place").to_numpy())))
            for b in slices(whole, bytes_of(whole.column("text"))):
                yield cut(b, none, none, np.zeros(len(b) + 1, np.int64))

    # texts that lose nothing are not shuffled
    some = keyed.select("doc_id", "text", "doc", place(F.col("doc"))).mapInArrow(trimmed(_among(marked)), f"doc_id {kind}, text string, doc binary")
    found = some.join(spans, "doc", "left").select("doc_id", "text", "spans").mapInArrow(trimmed(with_spans), f"doc_id {kind}, {CUT}")
    if marked.value is None:
        return found
    rest = keyed.select("doc_id", "text", place(F.col("doc"))).mapInArrow(trimmed(without), f"doc_id {kind}, {CUT}")
    return found.unionByName(rest)


def op8_repeated_substrings(spark, sf_dir: str) -> DataFrame:
    cut = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"), F.make_valid_utf8(F.col("kept").cast("string")).alias("text"))


#: A character of UTF-8 in hexadecimal digits.
_CHARACTER = "(?:[0-7].|(?:C[2-9A-F]|D.)[89AB].|(?:E0[AB].|E[1-9A-CEF][89AB].|ED[89].)[89AB].|(?:F0[9AB].|F[123][89AB].|F48.)[89AB].[89AB].)"


def oracle(length: int = LENGTH, chunk: int = 400) -> str:
    """Every string of `length` bytes by its digest. Bytes are worked on as hexadecimal digits, in chunks of their starts."""
    return f"""
WITH raw AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
cut AS (SELECT r, k * {chunk} AS p, substr(h, 1 + {2 * chunk} * k, {2 * (chunk + length - 1)}) AS part FROM (SELECT r, h, unnest(range(0, greatest(0, (len(h) // 2 - {length} + {chunk}) // {chunk}))) AS k FROM raw)),
strings AS (SELECT r, p + i AS s, md5(substr(part, 1 + 2 * i, {2 * length})) AS d FROM (SELECT r, p, part, unnest(range(0, least({chunk}, len(part) // 2 - {length - 1}))) AS i FROM cut)),
twice AS (SELECT d FROM strings GROUP BY d HAVING count(*) > 1),
hit AS (SELECT r, s, lag(s) OVER o AS before, lead(s) OVER o AS after FROM strings JOIN twice USING (d) WINDOW o AS (PARTITION BY r ORDER BY s)),
gone AS (SELECT r, sum(least({length}, coalesce(after - s, {length})))::BIGINT AS n_removed, count(*) FILTER (before IS NULL OR s - before > {length}) AS n_spans FROM hit GROUP BY r),
edges AS (SELECT r, s AS lo, coalesce(before + {length}, 0) AS hi FROM hit UNION ALL SELECT r, len(h) // 2, coalesce((SELECT max(s) + {length} FROM hit WHERE hit.r = raw.r), 0) FROM raw),
kept AS (SELECT r, string_agg(substr(h, 1 + 2 * hi, 2 * (lo - hi)), '' ORDER BY lo) AS h FROM edges JOIN raw USING (r) WHERE lo > hi GROUP BY r),
shown AS (SELECT r, h, array_to_string(list_transform(regexp_extract_all(h, '{_CHARACTER}|E[0-9A-F][89AB].|F[0-4][89AB].(?:[89AB].)?|..'), lambda x: CASE WHEN regexp_full_match(x, '{_CHARACTER}') THEN x ELSE 'EFBFBD' END), '') AS t FROM kept)
SELECT raw.doc_id, (len(raw.h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(shown.h, ''))) AS kept_sha256, decode(unhex(coalesce(shown.t, ''))) AS text
FROM raw LEFT JOIN gone USING (r) LEFT JOIN shown USING (r)
"""
