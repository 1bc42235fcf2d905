"""HTML extraction: page structure cuts blocks, and a host's repeated runs tell which of them are boilerplate.

Elements that never hold main text (menus, page headers, footers, sidebars, adverts, notices, forms,
comments, scripts, styles) are left out by name, role, class or id. Text in an <article> or <main> is main
text. Where a page has neither, all its remaining blocks are open.

The token streams of all pages of a host stand end to end, and their suffixes are named by their first RUN tokens:
suffixes of one name are an interval of the host's suffix array whose common prefix has RUN tokens at least. An interval
that spans two distinct page contents at least, and SHARE percent of the host's, is boilerplate where its suffixes
stand outside main text, and a longer repeated substring is a chain of such suffixes. A block goes as a whole where these
runs cover all its tokens: an open block by runs of open or left out text, a main block only by runs that
stand in the left out text of most contents of the host (MAIN_SHARE percent, MAIN_PAGES at least), as menus and footers do and
adverts that quote articles do not. Main text alone is no evidence, so copies of an article keep it.

Names are dealt by host and name, contents counted after a first count of distinct ones, so that no host and no run is one
task's. Which names are boilerplate is told to the second pass over the pages by a table of bits of bounded size, and checked exactly after it.

Defined results: null or empty html gives an empty text; text without any tag is one open block;
unclosed elements end with their parent or the page; a null url is a host of its own; repeated rows are
pages of their own, but count once as evidence; a very long page is read whole; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from survista.llm.common import Places, bytes_of, discard, materialize, slices, trimmed
from survista.llm.rolling import mix, parts, windows, word_hashes

#: Tokens of a repeated run at least.
RUN = 8
#: Percent of a host's distinct page contents, two at least, that boilerplate stands on.
SHARE = 10
#: For a block of main text: percent of the contents that have the run in left out text, and how many at least.
MAIN_SHARE, MAIN_PAGES = 50, 5
#: Places of the table of bits, and names beyond which it would spare little and is left out.
PLACES, MARKS = 1 << 24, 1 << 22
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|svg|iframe|textarea|select)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|[^<]+|<", re.S | re.I)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SPACE = re.compile(r"[\x20\x09-\x0D]+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
HIDDEN = frozenset("head title noscript object".split())
LEFT_OUT = frozenset("head title nav footer aside form button dialog menu noscript object".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|sidebar|aside|widget|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|signup|login|share|social|related|recommended|comments?|replies|reply|disqus|pagination|pager|toolbar|skip)(?:$|[\s_-])",
    re.I,
)


def _left_out(name: str, attributes: str, in_main: bool) -> bool:
    if name in LEFT_OUT or name == "header" and not in_main:
        return True
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id") and name not in ("body", "html", "article", "main") and NAMES.search(value):
            return True
        if key in ("class", "id") and name in ("article", "main") and re.search(r"(?:^|[\s_-])(?:comments?|reply|replies|related|promo\w*|ads?)(?:$|[\s_-])", value, re.I):
            return True
        if key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True
    return False


def blocks(page: str) -> tuple[list[str], list[str], list[str]]:
    """(main blocks, open blocks, left out blocks) of a page in order: decoded, white space made one space."""
    main: list[str] = []
    rest: list[str] = []
    gone: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, left out, main
    part: list[str] = []
    hidden = 0  # elements of the head that are open

    def flush() -> None:
        if part:
            text = SPACE.sub(" ", "".join(part)).strip(" ")
            part.clear()
            if text:
                (gone if stack and stack[-1][1] else main if stack and stack[-1][2] else rest).append(text)

    for m in TOKEN.finditer(page):
        name = m[3]
        if name is None:
            if (m[0][0] != "<" or m[0] == "<") and not hidden:
                part.append(entities.unescape(m[0]) if "&" in m[0] else m[0])
            continue
        name = name.lower()
        if m[2]:
            if name not in INLINE:
                flush()
            if any(s[0] == name for s in stack):
                while True:
                    if stack[-1][0] not in INLINE or stack[-1][1] and not (len(stack) > 1 and stack[-2][1]):
                        flush()
                    hidden -= stack[-1][0] in HIDDEN
                    if stack.pop()[0] == name:
                        break
            continue
        if name not in INLINE:
            flush()
        if name in VOID:
            continue
        out, within = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        if name == "body":
            out, hidden = False, 0
            stack = [s for s in stack if not s[1]]
        drop = out or _left_out(name, m[4], within)
        if drop and not out:
            flush()
        within = not drop and (within or name in ("article", "main") or "main" in (m[4] or "") and re.search(r"role\s*=\s*[\"']?main\b", m[4], re.I) is not None)
        if not m[4].rstrip().endswith("/") or name in ("article", "main", "div", "p"):
            stack.append((name, drop, within))
            hidden += name in HIDDEN
    flush()
    return main, rest, gone


def runs_of(texts: list[str], run: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(names, number of tokens) of each token stream: the name of the suffix at each token with `run` tokens left."""
    for _, data, offsets in parts(pa.array(texts, pa.string())):
        start, word = word_hashes(data, offsets)
        first = np.searchsorted(start, offsets)
        names = windows(word, run)
        for a, z in zip(first.tolist(), first[1:].tolist(), strict=False):
            yield names[a : max(a, z - run + 1)].view(np.int64), z - a


HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def _host(pages: DataFrame):
    """A number for the host; pages without url are one host."""
    return F.xxhash64(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))).alias("host")


def _evidence(run: int):
    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """host, content, and name and kind of the suffixes outside main text, once a page; and a row a page."""
        for b in (x for whole in batches for x in slices(whole, bytes_of(whole.column(1)), 1 << 21)):
            host = b.column(0).to_numpy()
            every = [blocks(page.as_py() or "") for page in b.column(1)]
            # a page's content: all its streams, in any order of kinds
            content = [mix(sum((windows(n.view(np.uint64), 1).sum(keepdims=True) for n in part), np.zeros(1, np.uint64))).view(np.int64)[0] for part in zip(*(_whole(every, k) for k in range(3)), strict=True)]
            rows = [(host, np.array(content, np.int64), np.zeros(len(b), np.int64), np.full(len(b), -1))]
            for kind, at in ((0, 1), (1, 2)):
                for k, (found, _) in enumerate(runs_of([" ".join(x[at]) for x in every], run)):
                    found = np.unique(found)
                    rows.append((np.full(len(found), host[k]), np.full(len(found), content[k]), found, np.full(len(found), kind)))
            cols = [np.concatenate([r[c] for r in rows]) for c in range(4)]
            yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int64)) for c in cols[:3]), pa.array(cols[3].astype(np.int32))], ["host", "content", "name", "kind"])

    return names


def _whole(every: list[tuple], kind: int) -> list[np.ndarray]:
    """One number for the whole of each stream of a kind."""
    texts = [" ".join(x[kind]) for x in every]
    out = []
    for _, data, offsets in parts(pa.array(texts, pa.string())):
        start, word = word_hashes(data, offsets)
        first = np.searchsorted(start, offsets)
        place = mix(np.arange(len(word), dtype=np.uint64) - np.repeat(first[:-1], np.diff(first)).astype(np.uint64))
        total = np.append(np.uint64(0), np.cumsum(mix(word ^ place)))
        out += [x.reshape(1) for x in mix((total[first[1:]] - total[first[:-1]]) + np.uint64(kind + 1) + mix(np.diff(first).astype(np.uint64)))]
    return out


def extract(pages: DataFrame, run: int = RUN, share: int = SHARE) -> DataFrame:
    """page_id, url, text of every row of pages."""
    spark = pages.sparkSession
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    seen = pages.select(_host(pages), "html").mapInArrow(trimmed(_evidence(run)), "host bigint, content bigint, name bigint, kind int").distinct()
    # counted by distinct contents, rows of pages (kind -1) with the rest
    counts = materialize(seen.groupBy("host", "name", "kind").agg(F.count(F.lit(1)).alias("on")).where("kind < 0 OR `on` > 1"), "html-counts")
    hosts = counts.where("kind < 0").select("host", F.col("on").alias("contents"))
    repeated = counts.where("kind >= 0").join(hosts, "host").where(F.col("on") * 100 >= F.col("contents") * share)
    strong = (F.col("kind") == 1) & (F.col("on") >= MAIN_PAGES) & (F.col("on") * 100 >= F.col("contents") * MAIN_SHARE)
    repeated = materialize(repeated.groupBy("host", "name").agg(F.max(strong).alias("strong")), "html-repeated")
    discard(counts)
    place = F.col("name").bitwiseXOR(F.col("host")).bitwiseAND(F.lit(PLACES - 1)).cast("int")
    places, marks = repeated.select(place.alias("p")).distinct(), None
    if places.count() <= MARKS:
        marks = Places(places.toArrow()["p"].to_numpy())
    marked = spark.sparkContext.broadcast(marks)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The blocks of each page that may be its text, and where their stream may have boilerplate."""
        marks = marked.value
        for b in (x for whole in batches for x in slices(whole, bytes_of(whole.column(3)), 1 << 21)):
            host = b.column(2).to_numpy()
            every = [blocks(page.as_py() or "") for page in b.column(3)]
            text = [main or rest for main, rest, _ in every]
            hits = []
            for k, (names, _) in enumerate(runs_of([" ".join(x) for x in text], run)):
                at = np.arange(len(names)) if marks is None else np.flatnonzero(marks.has((names ^ host[k]) & (PLACES - 1)))
                hits.append([{"at": int(a), "name": int(names[a])} for a in at])
            kind = pa.list_(pa.struct([("at", pa.int32()), ("name", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array([bool(main) for main, _, _ in every]), pa.array(text, pa.list_(pa.string())), pa.array(hits, kind)], ["page_id", "url", "host", "main", "blocks", "hits"]
            )

    parsed = pages.select("page_id", "url", _host(pages), "html").mapInArrow(
        trimmed(cut), f"page_id {kinds['page_id']}, url {kinds['url']}, host bigint, main boolean, blocks array<string>, hits array<struct<at:int,name:bigint>>"
    )
    parsed = materialize(parsed.withColumn("page_no", F.monotonically_increasing_id()), "html-blocks")
    hits = parsed.where(F.size("hits") > 0).select("page_no", "host", "main", F.explode("hits").alias("h")).select("page_no", "host", "main", "h.at", "h.name")
    covered = hits.join(repeated, ["host", "name"]).where("strong OR NOT main").groupBy("page_no").agg(F.sort_array(F.collect_list("at")).alias("starts"))
    left = parsed.where(F.size("hits") > 0).select("page_no", "page_id", "url", "blocks").join(covered, "page_no", "left")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [" ".join(unique(of, starts or (), run)) for of, starts in zip(b.column("blocks").to_pylist(), b.column("starts").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string())], ["page_id", "url", "text"])

    left = left.select("page_id", "url", "blocks", "starts").mapInArrow(choose, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return parsed.where(F.size("hits") == 0).select("page_id", "url", F.array_join("blocks", " ").alias("text")).unionByName(left)


def unique(of: list[str], starts, run: int) -> list[str]:
    """The blocks with a token that no run of `run` tokens from one of `starts` covers."""
    ends, at = [], 0
    for x in of:
        at += x.count(" ") + 1
        ends.append(at)
    marked = bytearray(at)
    for s in starts:
        marked[s : s + run] = b"\1" * run
    return [x for x, a, z in zip(of, [0, *ends], ends, strict=False) if 0 in marked[a:z]]


def op9_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.length("text").cast("long"))
