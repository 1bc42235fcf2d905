r"""Secret scans with recursive decoding.

A text is the first layer of a worklist. Each layer is scanned for secrets, then searched for encoded
runs: percent escapes, \u and &#...; escapes, base64, and gzip or zlib data or UTF-16 in it. A decoded run is
a new layer, whose characters carry the span of the text they came from; the list is worked off until
no layer brings a new one, however deep. A layer already seen for the same part of the text (a digest is kept) is not
unwrapped again, which ends cycles; decoding only shrinks a run except for compressed data, which is
scanned in windows of MOST_INFLATED bytes. A base64 run is decoded at each of its four alignments, over
line breaks, and each printable stretch of what it holds is a layer, so neighbours from its
alphabet or binary bytes hide nothing. A run of 16 letters is the shortest that holds a secret (12 bytes).

Defined results: null text is empty and has no spans; the base spans are those of the undecoded
text; of the spans found in decoded layers those are added that lie in no other span of their kind, so ties (one
secret by two ways) are one span, and secrets of one compressed run are as well;
repeated rows are scanned alike; a very long text is scanned whole; an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from survista.llm.common import bytes_of, slices

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww](?:[Oo][Rr])?[Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Compressed data that would inflate beyond this is scanned in windows, each with the end of the one before.
MOST_INFLATED = 64 << 20
OVERLAP = 1 << 20
#: Bytes of the shortest text with a secret, plain (12) or encoded.
LEAST = 12
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};)+")
ONE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});")
#: A run may go on over line breaks, written out or escaped.
BREAK = re.compile(r"[\x20\t]*(?:\r?\n|\\r\\n|\\n)[\x20\t]*")
BASE64 = re.compile(rf"[A-Za-z0-9+/_-]{{16,}}(?:{BREAK.pattern}[A-Za-z0-9+/_-]+)*")
URL_SAFE = str.maketrans("-_", "+/")
STRETCH = re.compile(rb"(?:[\t\r\n\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")
#: Printable ASCII in two bytes each, either first.
WIDE = re.compile(rb"(?:[\t\r\n\x20-\x7e]\x00){12,}|(?:\x00[\t\r\n\x20-\x7e]){12,}")
#: Headers of gzip and zlib data.
PACKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base secrets of a text: leftmost, not overlapping within a kind."""
    found = []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 6:
            found.append((m.start(), m.end(), 0))
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return found


def _characters(m: re.Match) -> str:
    code = int(m[1] or m[2] or m[4] or "0", 16) if m[3] is None else int(m[3])
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�"


def _escaped(layer: str, pattern: re.Pattern) -> tuple[str, list[tuple[int, int, int]]] | None:
    """The layer with all runs of `pattern` decoded, and (start, end in it, offset of the run) pieces
    that say where each character came from."""
    parts: list[str] = []
    pieces: list[tuple[int, int, int, int]] = []
    at = size = 0
    for m in pattern.finditer(layer):
        if pattern is PERCENT:
            raw = bytes.fromhex(m[0].replace("%", ""))
            try:
                got = raw.decode()
            except UnicodeDecodeError:
                got = raw.decode("latin-1")
        else:
            got = ONE.sub(_characters, m[0])
        if m.start() > at:
            pieces.append((size, size + m.start() - at, at, m.start()))
            parts.append(layer[at : m.start()])
            size += m.start() - at
        each = (m.end() - m.start()) // len(got) if got else 0
        # a run of equally long escapes maps character by character, another as a whole
        if got and each * len(got) == m.end() - m.start() and pattern is PERCENT and len(raw) == len(got):
            pieces += [(size + k, size + k + 1, m.start() + k * each, m.start() + (k + 1) * each) for k in range(len(got))]
        else:
            pieces.append((size, size + len(got), m.start(), m.end()))
        parts.append(got)
        size += len(got)
        at = m.end()
    if not parts:
        return None
    pieces.append((size, size + len(layer) - at, at, len(layer)))
    parts.append(layer[at:])
    return "".join(parts), pieces


def _through(pieces: list[tuple[int, int, int, int]], starts: list[int], start: int, end: int) -> tuple[int, int]:
    """The span of the outer text that characters start..end of a decoded layer came from. Pieces are in order on both sides."""
    first, last = pieces[max(0, bisect_right(starts, start) - 1)], pieces[max(0, bisect_left(starts, max(end, start + 1)) - 1)]
    a, b, x, y = first
    lo = x + max(0, start - a) if b - a == y - x else x
    a, b, x, y = last
    return lo, x + min(b, end) - a if b - a == y - x else y


def _inflated(raw: bytes, at: int) -> Iterator[bytes]:
    """What the compressed data at raw[at:] holds, whole up to MOST_INFLATED bytes, else in windows of as many that
    share OVERLAP bytes; broken data as far as it goes."""
    unpack, todo, tail, size = zlib.decompressobj(47), raw[at:], b"", 0
    parts: list[bytes] = []
    try:
        while todo and not unpack.eof:
            parts.append(unpack.decompress(todo, 1 << 20))
            todo = unpack.unconsumed_tail
            size += len(parts[-1])
            if size >= MOST_INFLATED:
                tail = b"".join(parts)
                yield tail
                parts = [tail[-OVERLAP:]]
                size = len(parts[0])
    except zlib.error:
        pass
    if size > (len(tail) and OVERLAP):
        yield b"".join(parts)


def _texts(raw: bytes) -> Iterator[tuple[str, int, int, int]]:
    """(text, start, end, bytes a character) of the printable stretches of raw, and of those of compressed data in it (0 bytes
    a character), which stand for all of raw from their header on."""
    work: list[tuple[Iterator[bytes], int]] = [(iter([raw]), -1)]
    while work:
        windows, at = work[-1]
        got = next(windows, None)
        if got is None:
            work.pop()
            continue
        for m in STRETCH.finditer(got):
            if m.end() - m.start() >= LEAST:
                yield (m[0].decode("utf-8", "replace"), m.start(), m.end(), 1) if at < 0 else (m[0].decode("utf-8", "replace"), at, len(raw), 0)
        if b"\0" in got:
            for m in WIDE.finditer(got):
                text = m[0].replace(b"\0", b"").decode()
                yield (text, m.start(), m.end(), 2) if at < 0 else (text, at, len(raw), 0)
        work += [(_inflated(got, m.start()), m.start() if at < 0 else at) for m in PACKED.finditer(got)]


def _blob(run: str) -> Iterator[tuple[str, Callable[[int, int], tuple[int, int]]]]:
    """Texts that a base64 run holds, plain or compressed, at each of the four alignments, and maps of their spans onto the run."""
    core = run.translate(URL_SAFE)
    for shift in range(min(4, len(core))):
        part = core[shift:]
        part = part[: len(part) - (len(part) % 4 == 1)]
        raw = base64.b64decode(part + "=" * (-len(part) % 4))
        chars = lambda s, e, o=shift, n=len(core): (o + s * 4 // 3, min(n, o - (-e * 4 // 3)))
        for got, start, end, wide in _texts(raw):
            if not wide:
                yield got, lambda s, e, x=chars(start, end): x
            elif got.isascii():
                yield got, lambda s, e, a=start, f=chars, w=wide: f(a + w * s, a + w * e)
            else:
                yield got, lambda s, e, a=start, g=got, f=chars: f(a + len(g[:s].encode()), a + len(g[:e].encode()))


def _inner(layer: str) -> Iterator[tuple[str, Callable[[int, int], tuple[int, int]]]]:
    """The layers encoded in a layer, and maps of their spans onto it."""
    for pattern, sign in ((PERCENT, "%"), (ESCAPE, ("\\u", "\\x", "&#"))):
        if any(s in layer for s in sign) and (got := _escaped(layer, pattern)):
            yield got[0], lambda s, e, p=got[1], q=[x[0] for x in got[1]]: _through(p, q, s, e)
    for m in BASE64.finditer(layer):
        run = m[0]
        if not BREAK.search(run):
            for got, f in _blob(run):
                yield got, lambda s, e, a=m.start(), f=f: tuple(a + x for x in f(s, e))
        else:  # wrapped over lines
            gaps = [(x.start(), x.end()) for x in BREAK.finditer(run)]
            lines = list(zip([0, *(b for _, b in gaps)], [*(a for a, _ in gaps), len(run)], strict=True))
            at = [m.start() + k for a, b in lines for k in range(a, b)]
            for got, f in _blob("".join(run[a:b] for a, b in lines)):
                yield got, lambda s, e, at=at, f=f: (lambda x: (at[x[0]], at[x[1] - 1] + 1))(f(s, e))


def spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans of a text, each sorted by start, then kind."""
    base = sorted(scan(text), key=lambda s: (s[0], s[2], s[1]))
    decoded: set[tuple[int, int, int]] = set()
    digest = lambda s: hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    # a layer: its text, and a map of its spans onto those of the text
    work = [(text, lambda s, e: (s, e))]
    seen = {(digest(text), 0, len(text))} if "%" in text or "\\" in text or "&#" in text else set()
    hits: dict[bytes, list[tuple[int, int, int]]] = {}
    while work:
        layer, out = work.pop()
        for got, f in _inner(layer):
            back = lambda s, e, f=f, out=out: out(*f(s, e))
            # the same layer for the same part of the text: a cycle, or another way to it
            if (d := (digest(got), *back(0, len(got)))) in seen:
                continue
            seen.add(d)
            if d[0] not in hits:
                hits[d[0]] = scan(got)
            decoded.update((*back(s, e), kind) for s, e, kind in hits[d[0]])
            work.append((got, back))
    return base, sorted({*base, *_outermost(decoded, base)}, key=lambda s: (s[0], s[2], s[1]))


def _outermost(decoded: set[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans that lie in no other of their kind."""
    out, reach = [], [-1] * len(KINDS)
    for s, e, kind in sorted({*decoded, *base}, key=lambda x: (x[0], -x[1])) if decoded else ():
        if e > reach[kind]:
            reach[kind] = e
            out.append((s, e, kind))
    return out


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in found)


SPANS = "n_assign bigint, n_access bigint, n_hex bigint, base string, spans string"


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base spans by kind, base and spans (joined), row by row, no shuffle."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in slices(whole, bytes_of(whole.column(1)))):
            counts, base, every = ([], [], []), [], []
            for text in b.column(1):
                first, all_found = spans(text.as_py() or "")
                for k in range(3):
                    counts[k].append(sum(s[2] == k for s in first))
                base.append(joined(first))
                every.append(joined(all_found))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(base, pa.string()), pa.array(every, pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, {SPANS}")


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scanned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base"), 256).alias("base_sha256"), "spans")
