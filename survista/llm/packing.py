"""Best-fit packing with certified bin counts.

Documents become token ids; those longer than a sequence are cut into whole sequences and a rest.
Full pieces are sequences of their own. The others are dealt to partitions by a hash and packed
there best-fit decreasing. Dual-feasible-function lower bounds certify a partition: where its bins equal
its bound, no packing of its pieces has fewer, and it is done. Partitions with a gap give up the
documents of their worst-filled bins; those are pooled, dealt anew over fewer partitions and packed
again, with the bins that stayed closed. Rounds go on until no gap is left, one partition remains, or
a round gains nothing.

Tokenization keeps, per worker, a bounded table of words already seen: a word's ids do not depend on
its neighbours, as the tokenizer's pieces never cross white space.

Defined results: null text is empty and packs as its end token alone; repeated rows are packed each
for itself; ties of length are broken by piece number; a very long text is tokenized whole and cut
into whole sequences; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from survista.llm.common import bytes_of, materialize, slices, trimmed

CAPACITY = 4096
END = 1
VOCABULARY = "word_bpe_49k.json"
#: Words and parts of words a worker remembers before it starts over: some 150 bytes each.
REMEMBERED = 400_000
#: Pieces packed together in a round, on the average.
DEALT = 50_000
#: A deal with a gap of g bins gives up its (g + 1) * LOOSENED emptiest ones, as much as may mix with what others give up.
LOOSENED = 8
#: Bins of one deal at most, as numbers of sequences are made: far beyond what DEALT pieces fill.
BINS = 1 << 24


class _Seen(dict):
    """Ids by word; those of a word not seen yet are made."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> bytes:
        return self.make(word)


class Words:
    """Token ids of texts, as little-endian 4-byte integers, by a table of words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        import regex

        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        self.plain = regex.compile(r"[\x21-\x7e\xc0-ɏ]+").fullmatch
        self.model = self.whole.model
        self.words: dict[str, bytes] = _Seen(self.word)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        #: bytes as the model's alphabet shows them: printable ones as they are, others from 256 on
        self.shown = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(rest)}

    def part(self, piece: str) -> bytes:
        got = self.words.get(piece)  # in lower case and of one part, so the ids of a word alike
        if got is None:
            text = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.shown)
            got = self.words[piece] = b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(text))
        return got

    def word(self, word: str) -> bytes:
        """The ids of a word not seen yet."""
        if word.isalpha() and word.isascii():
            got = self.part(word.lower())
        elif self.plain(word) and "<|" not in word:
            got = b"".join(map(self.part, self.pieces(word.lower())))
        else:
            got = b"".join(i.to_bytes(4, "little") for i in self.whole.encode(word, add_special_tokens=False).ids)
        self.words[word] = got
        return got

    def ids(self, text: str) -> bytes:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to split(), not to the tokenizer
            return b"".join(i.to_bytes(4, "little") for i in self.whole.encode(text, add_special_tokens=False).ids)
        if len(self.words) >= REMEMBERED:
            self.words.clear()
        return b"".join(map(self.words.__getitem__, text.split()))


_WORDS: dict[str, Words] = {}


def words(path: str) -> Words:
    if path not in _WORDS:
        _WORDS[path] = Words(path)
    return _WORDS[path]


PIECE = ["piece", "start", "length", "ids_crc32"]


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, capacity: int = CAPACITY, end: int = END, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of docs with piece, start, length, ids_crc32: one row a piece, each text read once."""
    keep = keep or ["doc_id"]
    src = docs.select(F.col("text").alias("_text"), *[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)])
    kept = [f for f in src.schema.fields if f.name != "_text"]
    from pyspark.sql import types as T

    out = T.StructType(kept + [T.StructField("_piece", T.IntegerType()), T.StructField("_start", T.LongType()), T.StructField("_length", T.LongType()), T.StructField("_crc", T.LongType())])
    mark = end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        table = words(public_tokenizers.path(vocabulary))
        for b in (x for whole in batches for x in slices(whole, bytes_of(whole.column(0)))):
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(b.column(0)):
                ids = table.ids(text.as_py() or "") + mark
                n = len(ids) // 4
                for k, s in enumerate(range(0, n, capacity)):
                    part = ids[4 * s : 4 * (s + capacity)]
                    row.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            at = pa.array(row, pa.int64())
            cols = [b.column(j + 1).take(at) for j in range(len(kept))]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                [f.name for f in out.fields],
            )

    done = src.mapInArrow(trimmed(run), out)
    return done.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], *[F.col(f.name).alias(c) for f, c in zip(out.fields[len(kept) :], PIECE, strict=True)])


def lower_bound(lengths: list[int], capacity: int) -> int:
    """The largest bound that the dual feasible functions below give on the bins of these lengths.

    f0 is the identity; fk rounds a length up onto the grid of k equal parts less one (Fekete and Schepers'
    u(k)); and for a threshold t, lengths over capacity - t count as whole bins and those under t as none.
    """
    if not lengths:
        return 0
    best = -(-sum(lengths) // capacity)
    for k in range(1, 21):
        # u(k)(x) = x if (k+1) x is whole, else floor((k+1) x) / k, in units of capacity * k
        total = 0
        for x in lengths:
            q, r = divmod((k + 1) * x, capacity)
            total += k * x if r == 0 else q * capacity
        best = max(best, -(-total // (capacity * k)))
    ordered = sorted(lengths)
    before = [0]
    for x in ordered:
        before.append(before[-1] + x)
    n = len(ordered)
    for t in {x for x in ordered if 2 * x <= capacity} | {0}:
        lo, hi = bisect_left(ordered, t), bisect_left(ordered, capacity - t + 1)
        best = max(best, (n - hi) + -(-(before[hi] - before[lo]) // capacity) if hi >= lo else n - hi)
    return best


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[int]:
    """The bin of each length: longest first, each into the fullest bin that still takes it."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms: list[int] = []  # distinct rooms with bins, ascending
    out, bins = [0] * len(lengths), 0
    for i in order:
        x = lengths[i]
        at = bisect_left(open_rooms, x)
        if at == len(open_rooms):
            b, left = bins, capacity - x
            bins += 1
        else:
            r = open_rooms[at]
            b = room[r].pop()
            if not room[r]:
                open_rooms.pop(at)
            left = r - x
        out[i] = b
        if left:
            if not room[left]:
                insort(open_rooms, left)
            room[left].append(b)
    return out


PLACED = "piece_no bigint, length bigint, sequence_id bigint, offset bigint, again boolean"


def _packer(capacity: int, base: int):
    """base: deals of the rounds before, so that no two deals number sequences alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One partition: a bounded deal of pieces."""
        number, length, deal = [], [], []
        for b in batches:
            number += b.column("piece_no").to_pylist()
            length += b.column("length").to_pylist()
            deal += b.column("deal").to_pylist()
        of: dict[int, list[int]] = {}
        for i, d in enumerate(deal):
            of.setdefault(d, []).append(i)
        for d, rows in sorted(of.items()):
            rows.sort(key=lambda i: number[i])
            size = [length[i] for i in rows]
            where = best_fit_decreasing(size, capacity)
            fill, at = {}, []
            for i, b in enumerate(where):
                at.append(fill.get(b, 0))
                fill[b] = at[-1] + size[i]
            gap = len(fill) - lower_bound(size, capacity)
            worst = set(sorted(fill, key=lambda b: (fill[b], b))[: LOOSENED * (gap + 1)]) if gap > 0 else set()
            loose = {b for b in worst if fill[b] < capacity}
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number[i] for i in rows], pa.int64()), pa.array(size, pa.int64()), pa.array([(base + d) * BINS + b for b in where], pa.int64()),
                    pa.array(at, pa.int64()), pa.array([b in loose for b in where], pa.bool_()),
                ],
                ["piece_no", "length", "sequence_id", "offset", "again"],
            )

    return run


def pack(cut: DataFrame, capacity: int = CAPACITY, dealt: int = DEALT, rounds: int | None = None) -> DataFrame:
    """sequence_id and offset for the rows of cut, which has a bigint piece_no (distinct, from 0) and length. Full pieces
    are sequences numbered below 0, those of a deal have a range of their own. `rounds` ends the exchange early."""
    whole = cut.where(F.col("length") >= capacity).select("piece_no", (-1 - F.col("piece_no")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    loose, out, before, base, k = cut.where(F.col("length") < capacity).select("piece_no", "length"), whole, None, 0, 0
    while True:
        n = loose.count()
        if not n:
            return out
        deals = max(1, -(-n // dealt))
        # small deals, so that a partition's rows fit its memory whatever the table's size
        dealt_out = loose.withColumn("deal", F.pmod(F.xxhash64("piece_no", F.lit(k)), F.lit(deals)).cast("long")).repartition(deals, "deal")
        placed = materialize(dealt_out.mapInArrow(trimmed(_packer(capacity, base)), PLACED), f"pack-{k}")
        k, base = k + 1, base + deals
        bins, least = placed.where("again").agg(F.count_distinct("sequence_id"), F.ceil(F.sum("length") / capacity)).first()
        # no gap left, one partition alone, or nothing gained: else every round has fewer bins to exchange
        if deals == 1 or k == rounds or not bins or bins <= least or (before is not None and bins >= before):
            return out.unionByName(placed.select("piece_no", "sequence_id", "offset"))
        out = out.unionByName(placed.where("NOT again").select("piece_no", "sequence_id", "offset"))
        loose, before = placed.where("again").select("piece_no", "length"), bins


def packed(docs: DataFrame, keep: list[str] | None = None, vocabulary: str = VOCABULARY, capacity: int = CAPACITY) -> DataFrame:
    """One row a piece: the columns `keep`, then PIECE, sequence_id, offset; a kept column may be called like one of these."""
    keep = keep or ["doc_id"]
    cut = pieces(docs, vocabulary, capacity, keep=keep)
    cut = cut.toDF(*[f"_k{i}" for i in range(len(keep))], *PIECE).withColumn("piece_no", F.monotonically_increasing_id())
    cut = materialize(cut, "pack-pieces")
    placed = pack(cut.select("piece_no", "length"), capacity)
    return cut.join(placed, "piece_no").select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], *PIECE, "sequence_id", "offset")


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
