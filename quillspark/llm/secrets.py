"""Secret scans with a recursive decoding worklist.

Each layer of a text is scanned by the three patterns, then unwrapped: percent escapes, backslash-u (and
-x) escapes, gzip, zlib, bzip2 and xz streams (all members) among their bytes, and runs of base64, at each
alignment and over wrapped lines, raw deflate in them included. Bytes that are not UTF-8 are read one character each. What is unwrapped
goes on the worklist until nothing new comes (fixpoint); a layer that was seen before for the same piece
of text is not scanned again (cycle detection). Escapes decode to a layer with a map of its stretches
back to the layer above; a base64 run is mapped as a whole. A secret found in a layer is reported as the
smallest stretch of the original text that holds it; spans are code points, end exclusive.

All layers are scanned, whatever their length, depth first, so that only the layers above one are held.
A compressed stream is read chunk by chunk: what it holds is a layer in one piece up to `max_layer` bytes
or 4 times its compressed size, whichever is more, and beyond that a row of windows of this size that
overlap by OVERLAP bytes. What a window cannot show whole is flagged in `truncated`, and redact() takes
its stretch out: a stream inside a window that goes on past its end, and all beyond MAX_DECODED bytes that
one text's streams unpack to (a bomb of bombs would never end).

Defined cases: null counts as empty; empty texts have no spans; repeated rows give equal results; spans
that coincide are reported once per kind; other columns are kept by redact() and ignored by scan().
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Generator, Iterable, Iterator
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import computed, replaced, table

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
BACKSLASH = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2})+")
UNIT = re.compile(r"\\u([0-9A-Fa-f]{4})|\\u\{([0-9A-Fa-f]{1,6})\}|\\x([0-9A-Fa-f]{2})")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{12,}+[ \t]*\r?\n[ \t]*)+[A-Za-z0-9+/_-]+={0,2}")
BREAK = re.compile(r"[ \t\r\n]+")
# zlib's first two bytes: method 8 with a window of 256 bytes to 32 KB, no dictionary, a multiple of 31 together
ZLIB = [bytes([a, b]) for a in range(0x08, 0x80, 0x10) for b in range(256) if not b & 0x20 and (a << 8 | b) % 31 == 0]
PACKED = re.compile("|".join(["\x1f\x8b\x08", "BZh[1-9]1AY&SY", "\xfd7zXZ\0", *(re.escape(x.decode("latin-1")) for x in ZLIB)]))
BROKEN = (zlib.error, lzma.LZMAError, OSError, ValueError, EOFError)
BYTES = re.compile("[\x00-\xff]*")
LEAST = 12  # bytes of the shortest secret; a compressed or nested one is longer
MAX_LAYER, OVERLAP, STEP, CHUNK, MAX_DECODED = 16 << 20, 1 << 16, 1 << 18, 1 << 20, 4 << 30


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns, leftmost and not overlapping per kind. Hex and access runs
    are maximal, so a length in the pattern keeps just the runs that are long enough."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def _escapes(text: str, pattern: re.Pattern, decode) -> tuple[str, list[tuple[int, int, int]]] | None:
    """The text with its escapes decoded, and (start in it, start in text, whether decoded) of each stretch."""
    parts, marks, at, done = [], [], 0, 0
    for m in pattern.finditer(text):
        new = decode(m[0])
        if new is None or new == m[0]:
            continue
        if m.start() > done:
            marks.append((at, done, 0))
            parts.append(text[done : m.start()])
            at += m.start() - done
        marks.append((at, m.start(), m.end()))
        parts.append(new)
        at, done = at + len(new), m.end()
    if not parts:
        return None
    marks.append((at, done, 0))
    return "".join([*parts, text[done:]]), marks


def _percent(s: str) -> str:
    return bytes.fromhex(s.replace("%", "")).decode("utf-8", "replace")


def _percent_bytes(s: str) -> str:
    return bytes.fromhex(s.replace("%", "")).decode("latin-1")


def _backslash(s: str) -> str | None:
    try:
        out = "".join(chr(int(a or b or c, 16)) for a, b, c in UNIT.findall(s))
        return out.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    except (ValueError, OverflowError):
        return None


def _decoder(data: bytes):
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor(lzma.FORMAT_XZ, memlimit=256 << 20) if data[:1] == b"\xfd" else zlib.decompressobj(47)


def _member(d, data: bytes) -> Generator[bytes, None, bytes | bool | None]:
    """What one compressed stream holds, at most CHUNK bytes at a time; returns what follows it, None if it breaks off, False if it is none."""
    at, deflate = 0, hasattr(d, "unconsumed_tail")
    try:
        while not d.eof:
            piece = d.unconsumed_tail if deflate else b""
            if not piece if deflate else d.needs_input:
                if at >= len(data):
                    if deflate and (out := d.flush()):
                        yield out
                    break
                piece = data[at : at + STEP]
                at += STEP
            if out := d.decompress(piece, CHUNK):
                yield out
    except BROKEN:
        return False
    return d.unused_data + data[at:] if d.eof else None


def _outcome(d, data: bytes) -> bytes | bool | None:
    """What _member returns, without what it yields."""
    member = _member(d, data)
    while True:
        try:
            next(member)
        except StopIteration as end:
            return end.value


def _opens(data: bytes, part: bool = False) -> bool:
    """Whether the bytes begin with a compressed stream. The first 256 bytes tell, but for zlib, whose two bytes come
    in plain text as well: it must decode to its end, or with the usual first byte as far as the bytes go. part: there are more bytes than these."""
    if not PACKED.match(data[:10].decode("latin-1")):
        return False
    if part or data[:1] in (b"\x1f", b"B", b"\xfd"):
        return _outcome(_decoder(data), data[:256]) is not False
    got = _outcome(_decoder(data), data)
    return isinstance(got, bytes) or (got is None and data[:1] == b"x")


def _stream(data: bytes) -> Generator[bytes, None, bool]:
    """What all members of a compressed stream hold, then what follows them; returns whether the last came to its end."""
    while _opens(data):
        rest = yield from _member(_decoder(data), data)
        if not isinstance(rest, bytes):
            return False
        data = rest
    yield data
    return True


def _windows(chunks: Iterable[bytes], size: int) -> Iterator[tuple[bytes, bool]]:
    """(window, whether more follows) of joined chunks."""
    held, step = bytearray(), size - min(OVERLAP, size // 2)
    for c in chunks:
        held += c
        while len(held) > size:
            yield bytes(held[:size]), True
            del held[:step]
    yield bytes(held), False


def _unbase64(body: str) -> bytes:
    if len(body) % 4 == 1:
        body = body[:-1]
    return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)


def _texts(data: bytes) -> list[str]:
    """What bytes can be read as: UTF-8, else (and if they may be packed) one character a byte; with NULs, UTF-16 too."""
    try:
        out = [data.decode("utf-8"), *([data.decode("latin-1")] if not data.isascii() and PACKED.match(data[:10].decode("latin-1")) else [])]
    except UnicodeDecodeError:
        out = [data.decode("latin-1")]
    return [*out, data.decode("utf-16-le", "replace"), data.decode("utf-16-be", "replace")] if b"\0" in data else out


def layers(text: str, max_layer: int, cuts: set[tuple[int, int]]) -> Iterator[tuple[str, object]]:
    """(layer, map): all layers below the text itself; map takes a span of the layer to one of the text."""
    seen: set[tuple[int, int, bytes]] = set()
    room = MAX_DECODED

    def new(layer: str, at: tuple[int, int]) -> bool:
        key = (*at, hashlib.blake2b(layer.encode("utf-8", "surrogatepass"), digest_size=16).digest())
        if key in seen:
            return False
        seen.add(key)
        return True

    def stretch(where, marks):
        starts = [m[0] for m in marks]

        def back(a: int, b: int) -> tuple[int, int]:
            i, j = bisect_right(starts, a) - 1, bisect_right(starts, max(a, b - 1)) - 1
            lo = marks[i][1] if marks[i][2] else marks[i][1] + a - marks[i][0]
            hi = marks[j][2] if marks[j][2] else marks[j][1] + b - marks[j][0]
            return where(lo, hi)

        return back

    def counted(chunks: Generator[bytes, None, bool | bytes | None], at: tuple[int, int], goes_on: bool) -> Iterator[bytes]:
        nonlocal room
        ended = yield from spent(chunks)
        if room <= 0 or (goes_on and not ended):
            cuts.add(at)

    def spent(chunks):
        nonlocal room
        while room > 0:
            try:
                c = next(chunks)
            except StopIteration as end:
                return end.value
            room -= len(c)
            yield c

    def unpacked(data: bytes, at: tuple[int, int], above: str, goes_on: bool, raw: bool):
        """Layers of bytes; goes_on: they are cut off at the end of a window; raw: they may be raw deflate."""
        made = [iter([(data, goes_on)])]
        size = max(max_layer, 4 * len(data))
        if _opens(data):
            made = [_windows(counted(_stream(data), at, goes_on), size)]
        elif raw and _outcome(zlib.decompressobj(-15), data) == b"":
            made.append(_windows(counted(_member(zlib.decompressobj(-15), data), at, False), size))
        for window, more in chain.from_iterable(made):
            for t in _texts(window) if len(window) >= LEAST else ():
                if t != above and new(t, at):
                    yield t, (lambda a, b: at), more

    def below(layer: str, where, goes_on: bool):
        """(layer, map, whether it is cut off at its end) of what one layer unwraps to."""
        for sign, pattern, decode in (("%", PERCENT, _percent), ("%", PERCENT, _percent_bytes), ("\\", BACKSLASH, _backslash)):
            if sign in layer and (got := _escapes(layer, pattern, decode)) and new(got[0], where(0, len(layer))):
                yield got[0], stretch(where, got[1]), goes_on
        for m in PACKED.finditer(layer):
            if not _opens(BYTES.match(layer[m.start() : m.start() + 256])[0].encode("latin-1"), True):
                continue
            end = BYTES.match(layer, m.start()).end()
            yield from unpacked(layer[m.start() : end].encode("latin-1"), where(m.start(), end), layer, goes_on and end == len(layer), False)
        for m in chain(BASE64.finditer(layer), WRAPPED.finditer(layer)):
            # plain words and hex runs decode as well, to what no pattern finds; a run can begin with other
            # words ('path/', 'name_'), so that its groups of four can begin at any of four places
            body = BREAK.sub("", m[0]).rstrip("=").replace("-", "+").replace("_", "/")
            at, cut = where(m.start(), m.end()), goes_on and m.end() == len(layer)
            for i in range(4):
                yield from unpacked(_unbase64(body[i:]), at, layer, cut, True)

    work = [below(text, lambda a, b: (a, b), False)]  # the worklist, deepest last
    while work:
        if (got := next(work[-1], None)) is None:
            work.pop()
            continue
        yield got[:2]
        work.append(below(*got))


def _spans(text: str, max_layer: int) -> tuple[set[tuple[int, int, str]], set[tuple[int, int, str]], set[tuple[int, int]]]:
    """(base spans, all spans, stretches of truncated layers)."""
    base, cuts = set(base_spans(text)), set()
    found = set(base)
    for layer, back in layers(text, max_layer, cuts):
        found.update((*back(a, b), kind) for a, b, kind in base_spans(layer))
    return base, found, cuts


def spans(text: str | None, max_layer: int = MAX_LAYER) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]], bool]:
    """(base spans, all spans, truncated), each sorted by start and then kind as listed."""
    base, found, cuts = _spans(text or "", max_layer)
    order = lambda s: (s[0], KINDS.index(s[2]), s[1])
    return sorted(base, key=order), sorted(found, key=order), bool(cuts)


def joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base, spans, truncated) per row; the counts are of the base spans."""
    made = [*((f"n_{k}", "long") for k in KINDS), ("base", "string"), ("spans", "string"), ("truncated", "boolean")]

    def found(texts: list) -> dict:
        rows = []
        for t in texts:
            base, every, cut = spans(t)
            rows.append((*(sum(s[2] == k for s in base) for k in KINDS), joined(base), joined(every), cut))
        return {n: [r[i] for r in rows] for i, (n, _) in enumerate(made)}

    return computed(docs, [F.col(id_col)], F.col(text_col), found, made)


def redacted(text: str | None, mark: str = "[SECRET]", max_layer: int = MAX_LAYER) -> str | None:
    """The text with each maximal stretch of spans, or of a layer that was not read to its end, replaced by the mark."""
    if not text:
        return text
    out, done = [], 0
    _, found, cuts = _spans(text, max_layer)
    for a, b in sorted({(a, b) for a, b, _ in found} | cuts):
        if b <= done:
            continue
        if a >= done:
            out += [text[done:a], mark]
        done = b
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the secrets in text replaced; n_chars, where it is there, is counted anew."""
    out = replaced(docs, text_col, lambda texts: [redacted(t) for t in texts])
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length(text_col)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op2_secret_scans(spark, sf_dir: str) -> DataFrame:
    s = scan(table(spark, sf_dir, "documents"))
    return s.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base"), 256).alias("base_sha256"), "spans", "truncated")
