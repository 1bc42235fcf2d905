"""N-gram Jaccard join with adaptive multi-match prefixes, and the components of its links.

A document is the set of its distinct word shingles. Documents of equal sets are one class. Tokens are
put in one order, those known to be frequent last. Two sets with Jaccard similarity of at least s share,
for any l, at least l tokens of their prefixes of length n - ceil(s n) + l. Each class picks the l for
which the estimated cost of its candidates is least: a longer prefix costs more postings, but asks for
more shared tokens before a pair is verified. A pair is verified if its prefixes share as many tokens as
the smaller l of the two asks for, or as the two sizes imply if that is more.

Pairs are never listed. Each token names a hub, the most central class of its postings, and a class joins
the group of every hub that its prefix tokens name: classes that share a prefix token share a hub. Every
class of a group meets its hub first; those similar to it are one component already, and need not meet
each other. Only classes that are not similar to their hub meet the rest of the group, in blocks bounded by
classes and by tokens, where shared prefix tokens, and then whole intersections, are counted by products of
token matrices. Of the links found there a spanning forest is sent on, which is all that components need.

Defined results: null or wordless text has an empty set and is linked with nothing (its component is its
own doc_id); fewer words than a shingle has make one shingle of all; repeated rows are one class; ties do
not matter, as similarity is compared in integers; a component without any doc_id has a null one; a very
long text is read whole, in pieces; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from survista.llm.common import Places, bytes_of, discard, materialize, slices, trimmed
from survista.llm.rolling import mix, parts, windows, word_hashes

#: Frequent tokens that the order knows of at most: a bound on what is broadcast (16 bytes each). The order
#: decides on cost alone, never on results.
KNOWN = 1 << 20
#: Times a token stands in the documents of one stretch for it to be counted as frequent.
OFTEN = 2
LONGEST = 8
#: Cost of verifying a pair, in postings.
VERIFY = 64
#: Classes and tokens of a block, on the average; a task holds two blocks.
BLOCK = 512
TOKENS = 1 << 19
#: Parts of a group of more than one block.
SALTS = 64
#: Tokens of the sets held at once while texts are read.
HELD = 1 << 19
#: Documents marked at most, 4 bytes each on their way.
MARKS = 1 << 22
#: Columns of a token matrix at once.
COLUMNS = 4096
#: Links whose components one task finds: 16 bytes each, some 100 in its table.
FEW = 500_000


def shingle_sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z in lower case, words by WORD."""
    for _, data, offsets in parts(column):
        start, word = word_hashes(np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8), offsets)
        first = np.searchsorted(start, offsets)
        whole = windows(word, words)
        for i in range(len(offsets) - 1):
            a, z = int(first[i]), int(first[i + 1])
            if z - a >= words:
                yield np.unique(whole[a : z - words + 1])
            elif z > a:
                yield mix(windows(word[a:z], z - a) + np.uint64(z - a))
            else:
                yield np.zeros(0, np.uint64)


def signature(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def _longs(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _stretches(column: pa.Array, words: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sets) of consecutive rows with some HELD tokens together."""
    row, size, sets = 0, 0, []
    for s in shingle_sets(column, words):
        sets.append(s)
        size += len(s)
        if size >= HELD:
            yield row, sets
            row, size, sets = row + len(sets), 0, []
    if sets:
        yield row, sets


def _survey(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a document (its id, set size and signature), and a row a frequent token of a stretch of documents."""
        for b in batches:
            for row, sets in _stretches(b.column(1), words):
                sigs = [signature(s) for s in sets]
                # equal sets count once: their classes are joined anyway
                distinct = dict(zip(sigs, sets, strict=True)).values()
                token, count = np.unique(np.concatenate([*distinct]), return_counts=True)
                token, count = token[count >= OFTEN], count[count >= OFTEN]
                n, m = len(sets), len(token)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([b.column(0).slice(row, n), pa.nulls(m, b.column(0).type)]),
                        pa.array([len(s) for s in sets] + [None] * m, pa.int64()),
                        pa.array(sigs + [None] * m, pa.binary()),
                        pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(_longs(token))]),
                        pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(count.astype(np.int64))]),
                    ],
                    ["doc_id", "n", "sig", "token", "times"],
                )

    return run


def choose(costs: np.ndarray, n: int, least: int) -> tuple[int, int]:
    """(l, prefix length) of the smallest estimated cost. costs: other documents with each token, in order."""
    best = (1, n - least + 1)
    base = float(costs[: best[1]].sum())
    low = best[1] + VERIFY * base
    for m in range(2, LONGEST + 1):
        p = n - least + m
        if p > n or base == 0:
            break
        listed = float(costs[:p].sum())
        cost = p + VERIFY * listed / m
        if cost < low:
            best, low = (m, p), cost
    return best


def prefix_of(s: np.ndarray, percent: int, frequent: np.ndarray, times: np.ndarray) -> tuple[int, np.ndarray, int]:
    """(l, prefix, how many of its tokens are known to be frequent) of a set; these come last."""
    n = len(s)
    if not n:
        return 1, s, 0
    order, costs, hot = s, np.zeros(n), s[:0]
    if len(frequent):
        where = np.searchsorted(frequent, s)
        where[where == len(frequent)] = 0
        often = frequent[where] == s
        if often.any():
            hot, c = s[often], times[where[often]]
            by = np.lexsort((hot, c))
            order = np.concatenate([s[~often], hot[by]])
            costs[n - len(hot) :] = c[by]
    m, p = choose(costs, n, -(-percent * n // 100))
    return m, order[:p], max(0, p - (n - len(hot)))


def _prefixes(words: int, percent: int, known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a set, once in a stretch: l, prefix, how many of its last tokens are frequent, and how many documents share them."""
        frequent, times = known.value
        for b in batches:
            for _, sets in _stretches(b.column(0), words):
                sig, match, flat, at, hot, shares, seen = [], [], [], [0], [], [], set()
                for s in sets:
                    if not len(s) or (g := signature(s)) in seen:
                        continue
                    seen.add(g)
                    m, p, k = prefix_of(s, percent, frequent, times)
                    match.append(m)
                    flat.append(p)
                    sig.append(g)
                    hot.append(k)
                    shares.append(int(times[np.searchsorted(frequent, p[len(p) - k :])].sum()) if k else 0)
                    at.append(at[-1] + len(p))
                tokens = np.concatenate(flat) if flat else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sig, pa.binary()), pa.array(match, pa.int32()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(_longs(tokens))), pa.array(hot, pa.int32()), pa.array(shares, pa.int64())],
                    ["sig", "l", "tokens", "hot", "shares"],
                )

    return run


def _signed(words: int, marked):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Signatures and packed texts of the documents that are marked, or have no id."""
        marks = marked.value
        for b in batches:
            if marks is not None:
                place = b.column("place")
                hit = marks.has(place.fill_null(0).to_numpy()) | place.is_null().to_numpy(zero_copy_only=False)
                b = b.filter(pa.array(hit))
            for part in slices(b, bytes_of(b.column("text"))):
                texts = part.column("text")
                sig = [signature(s) for s in shingle_sets(texts, words)]
                body = [t.as_py().encode() for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sig, pa.binary()), pa.array([zlib.compress(t, 1) for t in body], pa.binary()), pa.array([len(t) for t in body], pa.int64())], ["sig", "text", "size"]
                )

    return run


def _place(doc_id):
    """One of 2 ** 24 places of a document's id; null for none."""
    return F.when(doc_id.isNotNull(), F.pmod(F.xxhash64(doc_id), F.lit(1 << 24)).cast("int"))


def texts_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame, words: int, tag: str) -> DataFrame:
    """class, text (packed), size of the wanted classes, each from one document that has its set.

    Which ids may be among them is told by a table of bits, 2 MB whatever the corpus; where so many are wanted
    that it would spare little, all texts are read.
    """
    spark = docs.sparkSession
    wanted = materialize(classes.join(wanted.distinct(), "class", "left_semi").select("sig", "class", _place(F.col("first_id")).alias("place")), f"{tag}-wanted")
    places = wanted.where("place IS NOT NULL").select("place").distinct()
    marks = None
    if places.count() <= MARKS:
        marks = Places(places.toArrow()["place"].to_numpy())
    marked = spark.sparkContext.broadcast(marks)
    signed = docs.where("text IS NOT NULL").select("text", _place(F.col("doc_id")).alias("place")).mapInArrow(trimmed(_signed(words, marked)), "sig binary, text binary, size bigint")
    texts = materialize(signed.join(wanted.select("sig", "class"), "sig").dropDuplicates(["class"]).select("class", "text", "size"), f"{tag}-texts")
    discard(wanted)
    return texts


def shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of `left` with each of `right`."""
    out = np.zeros((len(left), len(right)), np.int64)
    a, b = np.concatenate(left), np.concatenate(right)
    tokens = np.intersect1d(a, b)
    if not len(tokens):
        return out
    sides = []
    for flat, side in ((a, left), (b, right)):
        row = np.repeat(np.arange(len(side)), [len(s) for s in side])
        at = np.searchsorted(tokens, flat)
        at[at == len(tokens)] = 0
        hit = tokens[at] == flat
        row, at = row[hit], at[hit]
        by = np.argsort(at, kind="stable")
        sides.append((row[by], at[by]))
    for lo in range(0, len(tokens), COLUMNS):
        width = min(COLUMNS, len(tokens) - lo)
        m = []
        for (row, at), n in zip(sides, (len(left), len(right)), strict=True):
            i, j = np.searchsorted(at, [lo, lo + width])
            x = np.zeros((n, width), np.float32)
            x[row[i:j], at[i:j] - lo] = 1
            m.append(x)
        out += (m[0] @ m[1].T).astype(np.int64)  # exact: below 2 ** 24
    return out


def open_pairs_of(left: tuple, right: tuple, percent: int) -> np.ndarray:
    """Which pairs share enough prefix tokens. A side: sizes, l, prefix lengths, prefixes (or what of them others have).

    Of the tokens that two sets share, all but those behind the prefix that ends first are shared by the
    prefixes: their count, and what either set has behind its prefix, bound the intersection.
    """
    (na, la, pa_, ta), (nb, lb, pb, tb) = left, right
    total = na[:, None] + nb[None, :]
    needed = -(-percent * total // (100 + percent)) - np.maximum.outer(na - pa_, nb - pb)
    asked = np.maximum(np.minimum.outer(la, lb), needed)
    return (shared(ta, tb) >= asked) & (100 * np.minimum.outer(na, nb) >= percent * np.maximum.outer(na, nb))


def similar_pairs(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    n, m = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    both = shared(left, right)
    return 100 * both >= percent * (n[:, None] + m[None, :] - both)


def forest(pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """A spanning forest of the pairs' graph."""
    parent: dict = {}

    def root(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    out = []
    for a, b in pairs:
        u, v = root(a), root(b)
        if u != v:
            parent[u] = v
            out.append((a, b))
    return out


KEY = ("hub", "i", "j")


def _meetings(rows: Iterator[tuple]) -> Iterator[tuple[tuple, list, list]]:
    """(key, rows of side 0, rows of side 1) of each meeting, from rows (hub, i, j, side, ...) in that order; side 2 is both."""
    key, sides = None, ([], [])
    for hub, i, j, side, *rest in rows:
        if (hub, i, j) != key:
            if sides[0] and sides[1]:
                yield key, *sides
            key, sides = (hub, i, j), ([], [])
        for k in (0, 1) if side == 2 else (side,):
            sides[k].append(rest)
    if sides[0] and sides[1]:
        yield key, *sides


def _screen(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each meeting, what shares enough prefix tokens with something of the other side."""

        def rows() -> Iterator[tuple]:
            for b in batches:
                tokens = b.column("tokens")
                flat, edges = tokens.flatten().to_numpy().view(np.uint64), np.append(0, np.cumsum(tokens.value_lengths().to_numpy()))
                for k, row in enumerate(zip(*(b.column(x).to_pylist() for x in (*KEY, "side", "class", "n", "l")), strict=True)):
                    yield *row, flat[edges[k] : edges[k + 1]].copy()

        def side(of: list) -> tuple:
            n, m = np.array([r[1] for r in of]), np.array([r[2] for r in of])
            return n, m, np.minimum(n, n + (-percent * n // 100) + m), [r[3] for r in of]

        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = [pa.array([r[c] for r in out], pa.int64()) for c in range(5)]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, [*KEY, "side", "class"])

        for key, left, right in _meetings(rows()):
            found = open_pairs_of(side(left), side(right), percent)
            found &= np.array([r[0] for r in left])[:, None] != np.array([r[0] for r in right])[None, :]
            one, other = ({of[k][0] for k in np.flatnonzero(found.any(axis=axis))} for of, axis in ((left, 1), (right, 0)))
            out += [(*key, 2 if c in one and c in other else 0 if c in one else 1, c) for c in one | other]
            if len(out) > 50_000:
                yield batch()
        yield batch()

    return run


def _verify(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links (a, b) between the sides of each meeting, a spanning forest of them."""

        def rows() -> Iterator[tuple]:
            for whole in batches:
                for b in slices(whole, whole.column("size").to_numpy()):
                    texts = pa.array([zlib.decompress(t).decode() for t in b.column("text").to_pylist()], pa.string())
                    for row, s in zip(zip(*(b.column(x).to_pylist() for x in (*KEY, "side", "class")), strict=True), shingle_sets(texts, words), strict=True):
                        yield *row, s

        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = [pa.array([r[c] for r in out], pa.int64()) for c in range(3)]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, ["hub", "a", "b"])

        for (hub, *_), left, right in _meetings(rows()):
            similar = similar_pairs([s for _, s in left], [s for _, s in right], percent)
            pairs = ((left[i][0], right[j][0]) for i, j in zip(*(x.tolist() for x in np.nonzero(similar)), strict=True))
            out += [(hub, a, b) for a, b in forest((a, b) for a, b in pairs if a != b)]
            if len(out) > 50_000:
                yield batch()
        yield batch()

    return run


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union by smallest node over all links of one bounded partition."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            u, v = root(u), root(v)
            if u != v:
                parent[max(u, v)] = min(u, v)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "component"])


def components(links: DataFrame, few: int = FEW) -> DataFrame:
    """node, component (its smallest node) for every node of links (a, b): in one task for up to `few` links,
    beyond that by alternating large and small stars."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    if edges.count() <= few:
        return edges.coalesce(1).mapInArrow(_forest, "node bigint, component bigint")
    edges = materialize(edges.distinct(), "cc-links")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = materialize(small, "cc-stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def blocks_of(groups: DataFrame, block: int, least: int = 1) -> DataFrame:
    """hub, blocks: how many blocks bound a group's classes and tokens, for groups of `least` classes or more."""
    size = groups.groupBy("hub").agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("tokens")).where(F.col("classes") >= least)
    return size.select("hub", F.greatest(F.ceil(F.col("classes") / block), F.ceil(F.col("tokens") / TOKENS)).cast("int").alias("blocks"))


def _part(blocks: str, seed: int):
    return F.pmod(F.xxhash64("class", F.lit(seed)), F.expr(blocks)).cast("long")


def met(meetings: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows of the meetings with the facts of their classes, each meeting whole in one task and in order."""
    return meetings.join(facts, "class").repartition(*KEY).sortWithinPartitions(*KEY, "side")


MEETING = "hub bigint, i bigint, j bigint, side bigint, class bigint"


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, block: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    spark, block = docs.sparkSession, block or BLOCK
    kind = docs.schema["doc_id"].dataType.simpleString()
    survey = docs.select("doc_id", "text").mapInArrow(trimmed(_survey(words)), f"doc_id {kind}, n bigint, sig binary, token bigint, times bigint")
    survey = materialize(survey, "jaccard-survey")
    mine = survey.where("sig IS NOT NULL").select("doc_id", "n", "sig")
    # at most KNOWN rows, whatever the corpus
    top = survey.where("token IS NOT NULL").groupBy("token").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "token").limit(KNOWN).toArrow()
    token = top["token"].to_numpy().view(np.uint64)
    order = np.argsort(token)
    known = spark.sparkContext.broadcast((token[order], top["times"].to_numpy()[order]))
    classes = mine.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("first_id"), F.min("n").alias("n")).withColumn("class", F.monotonically_increasing_id())
    classes = materialize(classes, "jaccard-classes")

    prefixes = docs.select("text").where("text IS NOT NULL").mapInArrow(trimmed(_prefixes(words, percent, known)), "sig binary, l int, tokens array<bigint>, hot int, shares bigint")
    # what copies were made from shares more of its tokens, with more documents, than a copy does; rank and l travel as one number
    rank = F.expr("-16 * cast(least(16 * shares / n, 1e15) AS bigint) + l")
    listed = prefixes.dropDuplicates(["sig"]).join(classes.select("sig", "class", "n"), "sig").select("class", rank.alias("rank"), "hot", F.posexplode("tokens").alias("at", "token"), F.size("tokens").alias("p"))
    # a token that is not known to be frequent stands in few classes, one a stretch of documents: most in a single one
    rare = listed.where("at < p - hot").select("class", "rank", "token").withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("token"))).where("df > 1").drop("df")
    postings = materialize(rare.unionByName(listed.where("at >= p - hot").select("class", "rank", "token")), "jaccard-postings")
    hubs = postings.groupBy("token").agg(F.min(F.struct("rank", "class")).alias("first"), F.count(F.lit(1)).alias("df")).where("df > 1").select("token", F.col("first.class").alias("hub"))
    named = postings.join(hubs, "token").groupBy("class").agg(F.expr("cast(pmod(min(rank), 16) AS int)").alias("l"), F.collect_list("token").alias("tokens"), F.collect_set("hub").alias("hubs"))
    known_of = materialize(named.join(classes.select("class", "n"), "class"), "jaccard-facts")
    discard(postings)
    groups = known_of.select("class", "n", F.explode("hubs").alias("hub")).where("class <> hub")
    facts = known_of.drop("hubs")

    # every class meets its hub: block j of the group, and the hub on the other side
    # large groups are dealt in SALTS parts for what is looked up by hub
    salt = _part(str(SALTS), 2).alias("salt")
    large = blocks_of(groups, block).where("blocks > 1").select("hub", "blocks", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")).alias("salt"))
    groups = groups.select("hub", "class", "n", salt).join(large, ["hub", "salt"], "left").select("hub", "class", "n", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    groups = materialize(groups, "jaccard-groups")
    placed = groups.select("hub", F.lit(-1).cast("long").alias("i"), _part("blocks", 0).alias("j"), F.lit(1).cast("long").alias("side"), "class")
    hub_rows = placed.select("hub", "i", "j").distinct().select("hub", "i", "j", F.lit(0).cast("long").alias("side"), F.col("hub").alias("class"))
    open_ = materialize(met(placed.unionByName(hub_rows), facts).mapInArrow(trimmed(_screen(percent)), MEETING), "jaccard-open")
    texts = texts_of(docs, classes, open_.select("class"), words, "jaccard-hub")
    with_hub = materialize(met(open_, texts).mapInArrow(trimmed(_verify(words, percent)), "hub bigint, a bigint, b bigint"), "jaccard-hub-links")
    discard(open_, texts)

    # the others meet all of the group but the hub; one that stands on both sides of a meeting is sent once
    linked = with_hub.select("hub", F.col("b").alias("class"), F.lit(True).alias("linked")).distinct()
    rest = materialize(groups.join(linked, ["hub", "class"], "left").select("hub", "class", "n", "blocks", F.col("linked").isNull().alias("alone")), "jaccard-rest")
    alone = rest.where("alone")
    left = blocks_of(alone, block).withColumnRenamed("blocks", "i_blocks").join(blocks_of(rest, block, least=2).withColumnRenamed("blocks", "j_blocks"), "hub")
    salts = f"IF(blocks > 1, {SALTS}, 1)"
    left = left.join(alone.groupBy("hub").agg(F.expr(f"max({salts})").alias("salts")), "hub")
    left = materialize(left.select("hub", "i_blocks", "j_blocks", F.explode(F.expr("sequence(0L, salts - 1L)")).alias("salt")), "jaccard-left")
    both = rest.withColumn("salt", _part(salts, 2)).join(left, ["hub", "salt"]).withColumns({"own_i": _part("i_blocks", 1), "own_j": _part("j_blocks", 0)})
    one, other = (F.sequence(F.lit(0).cast("long"), F.col(c).cast("long") - 1) for c in ("i_blocks", "j_blocks"))
    first = both.where("alone").select("hub", F.col("own_i").alias("i"), F.explode(other).alias("j"), "own_j", "class")
    first = first.select("hub", "i", "j", F.expr("IF(j = own_j, 2L, 0L)").alias("side"), "class")
    second = both.select("hub", F.explode(one).alias("i"), F.col("own_j").alias("j"), "own_i", "alone", "class").where("NOT (alone AND i = own_i)")
    second = second.select("hub", "i", "j", F.lit(1).cast("long").alias("side"), "class")
    open_ = materialize(met(first.unionByName(second), facts).mapInArrow(trimmed(_screen(percent)), MEETING), "jaccard-rest-open")
    discard(known_of, groups, rest, left)
    links = with_hub.select("a", "b")
    if not open_.isEmpty():
        texts = texts_of(docs, classes, open_.select("class"), words, "jaccard-rest")
        links = links.unionByName(materialize(met(open_, texts).mapInArrow(trimmed(_verify(words, percent)), "hub bigint, a bigint, b bigint"), "jaccard-rest-links").select("a", "b"))
        discard(texts)
    discard(open_)
    if links.isEmpty():
        of = classes.select("sig", F.col("first_id").alias("component_id"))
    else:
        component = components(links).withColumnRenamed("node", "class")
        of = classes.join(component, "class", "left").withColumn("component", F.coalesce("component", "class"))
        smallest = of.groupBy("component").agg(F.min("first_id").alias("component_id"))
        of = of.join(smallest, "component").select("sig", "component_id")
    some = mine.where("n > 0").join(of, "sig").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return some.unionByName(mine.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def first_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id (a repeated row once);
    documents without words and those without doc_id stay, and so does every text of a doc_id that several have."""
    keep = near_duplicates(docs, words, percent).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(keep, "doc_id", "left_semi").select(docs.columns)
    return docs.where("doc_id IS NULL").unionByName(kept.dropDuplicates(["doc_id", "text"]))


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4, percent=85)


def oracle(words: int = 4, percent: int = 85) -> str:
    """Shingles joined with each other, and links followed until nothing new is reached."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE split AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT r, doc_id, CASE WHEN len(w) >= {words} THEN list_distinct(list_transform(range(1, len(w) - {words - 2}), lambda i: array_to_string(w[i:i + {words - 1}], ' ')))
                         WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM split),
tokens AS (SELECT r, unnest(s) AS t FROM sets),
shared AS (SELECT a.r AS a, b.r AS b, count(*) AS n FROM tokens a JOIN tokens b ON a.t = b.t AND a.r < b.r GROUP BY a.r, b.r),
links AS (SELECT a, b FROM shared JOIN sets x ON x.r = a JOIN sets y ON y.r = b WHERE 100 * n >= {percent} * (len(x.s) + len(y.s) - n)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT r, r AS o FROM sets UNION SELECT reach.r, edges.b FROM reach JOIN edges ON edges.a = reach.o)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE min(o.doc_id) END AS component_id
FROM sets s JOIN reach USING (r) JOIN sets o ON o.r = reach.o GROUP BY s.r, s.doc_id, s.s
"""
