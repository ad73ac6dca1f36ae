"""Byte-pair encoding and decoding as streaming transducers.

Encoder.feed takes pieces of a text and returns the ids that no later piece can change; finish returns
the rest. Every pre-token goes through the transducer Word symbol by symbol. For each prefix there is
exactly one last token of its encoding, namely the token that ends there and is compatible with the last
token of the prefix before it (the two together encode to themselves), so a state is a last token for
each of the newest prefixes. `lookahead` is the merge list's sufficient lookahead: one merge can only
touch a later-ranked one that shares a symbol with it, which gives a longest chain of merges, and a symbol
that comes later than that chain changes nothing. Tokens that end `lookahead` symbols back are emitted, so
memory does not grow with the text or the pre-token. What a short pre-token gives is remembered, up to a
fixed number of them; every text of every length takes this one path.

Held back besides: a stretch that may be a special token's beginning, an apostrophe that may open a
contraction, and the last character with the combining marks after it. Only a run of combining marks is
held for as long as it goes on, as canonical order may still move any of them.

Decoder.feed maps ids to text: the tokens' bytes run through an incremental UTF-8 state machine.

Defined cases: null and empty texts have no ids and decode to the empty text; lone surrogates cannot
occur in Spark strings; unknown ids raise; repeated rows give equal results; other columns, of any type,
are kept by encode_documents where they do not clash with its own, which then replace them.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import computed, table

FILE, PIECE, CACHE, KEPT, STATES = "word_bpe_49k.json", 1 << 16, 200_000, 64, 1 << 15
NONE = 1 << 62
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_SPACES = regex.compile(f"[{SPACE}]+")
_ODD = regex.compile("[\x1c-\x1f]")  # separators that str.split drops, but that are no white space here
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^" + SPACE + r"{L}{N}]+"

# The library's character tables, where they differ from the Unicode version of Python's unicodedata (15.1).
# Letters and numbers that it has besides, by first and last code point.
MORE_LETTERS = [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
MORE_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
# Lower-case letters that it has besides, by first and last upper-case letter and the distance.
MORE_LOWER = [(0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B)]
# Marks that its canonical composition, of an older version, takes for characters that nothing joins or reorders.
LATE_MARKS = [(0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715), (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF)]


def _class(ranges: list[tuple[int, int]]) -> str:
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in ranges)


_RARE = re.compile("[\u0530-\U0010ffff]")  # below, all versions agree
_LATE = re.compile(f"([{_class(LATE_MARKS)}])")
_LOWER = {c: c + by for a, b, by in MORE_LOWER for c in range(a, b + 1)}


class Patterns:
    """Pre-tokens, runs of letters, runs of others, and pre-tokens that nothing can make longer."""

    def __init__(self, letters: str, numbers: str, lib) -> None:
        fill = lambda p: lib.compile(p.replace("{L}", letters).replace("{N}", numbers))
        self.pre, self.letters, self.others = fill(_SPLIT), fill("[{L}]*"), fill(r"[^" + SPACE + r"{L}{N}]*")
        self.whole = fill(r"'s|'t|'re|'ve|'m|'ll|'d|[{N}]|[" + SPACE + "]")


_FAST = Patterns(r"\p{L}", r"\p{N}", regex)
_exact: list[Patterns] = []


def patterns(text: str) -> Patterns:
    """The fast patterns where all of a text's characters are of the same class in every version, else exact tables."""
    rare = _RARE.findall(text) if not text.isascii() else ()
    if not any(unicodedata.category(c) == "Cn" for c in rare):
        return _FAST
    if not _exact:
        kinds = {"L": list(MORE_LETTERS), "N": list(MORE_NUMBERS)}
        for c in range(0x110000):
            k = unicodedata.category(chr(c))[0]
            if k in kinds:
                if kinds[k][-1][1] == c - 1:
                    kinds[k][-1] = (kinds[k][-1][0], c)
                else:
                    kinds[k].append((c, c))
        _exact.append(Patterns(_class(kinds["L"]), _class(kinds["N"]), re))
    return _exact[0]


def model_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(FILE)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(extra)
            extra += 1
    return [out[b] for b in range(256)]


class Model:
    """A vocabulary with ranked merges, of bytes with an end-of-word suffix."""

    def __init__(self, text: str) -> None:
        j = json.loads(text)
        m = j["model"]
        self.suffix = m["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = m["vocab"]
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        v = self.vocab
        pairs = [(p[0], p[1]) if isinstance(p, list) else tuple(p.split(" ")) for p in m["merges"]]
        merges = [(v[a], v[b], v[a + b]) for a, b in pairs]
        if max(v.values()) > 0xFFFF:
            raise ValueError("vocabularies of over 65,536 tokens need wider pair keys")
        self.ranked = {a << 16 | b: r << 16 | c for r, (a, b, c) in enumerate(merges)}
        sym = byte_symbols()
        self.inner = [v[s] for s in sym]
        self.last = [v[s + self.suffix] for s in sym]
        self.parts = {x: (x,) for x in [*self.inner, *self.last]}  # token -> its base symbols
        for a, b, c in merges:
            if c not in self.parts and a in self.parts and b in self.parts:
                self.parts[c] = self.parts[a] + self.parts[b]
        # symbols as characters: the byte, or 256 + the byte where it ends a word
        sign = {x: chr(k) for k, x in enumerate([*self.inner, *self.last])}
        self.by_signs = {"".join([sign[x] for x in p]): t for t, p in self.parts.items()}
        self.sorted = sorted(self.by_signs)
        self.clear()
        self.longest = max(map(len, self.parts.values()))
        self.lookahead = self._chain(merges)
        self.fit: dict[int, bool] = {}
        self._special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.openings = {t[:k] for t in self.special for k in range(1, len(t))}  # what a special token may begin with

    def clear(self) -> None:
        """Forgets the steps that were met. A state stands for the longest suffix of what was read that begins some
        token; it holds the state after each symbol met there and, under "", (length, token) of the tokens that end there, longest first."""
        self.states: dict[str, dict] = {}
        self.start = self._state("")

    def _state(self, suffix: str) -> dict:
        got = self.states.get(suffix)
        if got is None:
            if len(self.states) >= STATES:
                self.clear()
            ends = [(len(suffix) - i, self.by_signs[suffix[i:]]) for i in range(len(suffix)) if suffix[i:] in self.by_signs]
            got = self.states[suffix] = {"": ends, "suffix": suffix}
        return got

    def step(self, state: dict, symbol: str) -> dict:
        """The state after one more symbol, the first time that it is met."""
        suffix = state["suffix"] + symbol
        while True:
            at = bisect_left(self.sorted, suffix)
            if at < len(self.sorted) and self.sorted[at].startswith(suffix):
                break
            suffix = suffix[1:]
        got = state[symbol] = self._state(suffix)
        return got

    def _chain(self, merges: list[tuple[int, int, int]]) -> int:
        """Symbols within which all merges that can depend on each other lie: along a chain of merges of
        rising rank, each sharing a symbol with the one before, the lengths of the tokens add up."""
        reach: dict[int, int] = {}
        for a, b, c in merges:
            far = max(reach.get(a, 0), reach.get(b, 0)) + len(self.parts.get(c, ()))
            reach[a] = reach[b] = reach[c] = far
        return max(reach.values(), default=1)

    def merged(self, ids: list[int]) -> list[int]:
        """Merges pairs by rank, leftmost first; the ranks of all pairs are kept beside the ids."""
        get, none = self.ranked.get, NONE
        ranks = [get(a << 16 | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks:
            least = min(ranks)
            if least == none:
                break
            i = ranks.index(least)
            c = least & 0xFFFF
            ids[i] = c
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << 16 | c, none)
            if i < len(ranks):
                ranks[i] = get(c << 16 | ids[i + 1], none)
        return ids

    def fits(self, a: int, t: int) -> bool:
        """Whether t is its own encoding and, after a (-1 at a word's start), stays apart from it."""
        if len(self.fit) > 200_000:
            self.fit.clear()
        out = self.merged(list(self.parts[t])) == [t] and (a < 0 or self.merged([*self.parts[a], *self.parts[t]]) == [a, t])
        self.fit[a << 16 | t] = out
        return out


class Word:
    """One pre-token, symbol by symbol. Holds the newest symbols with the last tokens of their prefixes, at
    most 3 * lookahead of them: what lies `lookahead` symbols back is stable and is emitted."""

    def __init__(self, model: Model) -> None:
        self.m = model
        self.signs = ""  # the symbols that are not emitted yet
        self.lasts = [-1]  # of their prefixes, the last token of the encoding; first that of what is emitted
        self.state = model.start
        self.held = -1  # the newest byte: only the end tells which symbol it is

    def _run(self, new: str) -> None:
        self.signs += new
        m, lasts, state = self.m, self.lasts, self.state
        fit, keep = m.fit.get, lasts.append
        for c in new:
            state = state.get(c) or m.step(state, c)
            for n, t in state[""]:
                left = lasts[-n]
                ok = fit(left << 16 | t)
                if ok or (ok is None and m.fits(left, t)):
                    keep(t)
                    break
            else:
                raise AssertionError("a prefix without encoding")
        self.state = state

    def _path(self) -> list[int]:
        out, end, parts = [], len(self.signs), self.m.parts
        while end:
            out.append(self.lasts[end])
            end -= len(parts[out[-1]])
        return out[::-1]

    def feed(self, data: bytes) -> list[int]:
        if not data:
            return []
        new = (chr(self.held) if self.held >= 0 else "") + data[:-1].decode("latin-1")
        self.held = data[-1]
        out: list[int] = []
        far = self.m.lookahead
        for i in range(0, len(new), far):
            self._run(new[i : i + far])
            if len(self.signs) >= 2 * far:
                cut = 0
                for t in self._path():
                    if cut + len(self.m.parts[t]) > len(self.signs) - far:
                        break
                    cut += len(self.m.parts[t])
                    out.append(t)
                self.signs, self.lasts = self.signs[cut:], self.lasts[cut:]
        return out

    def finish(self) -> list[int]:
        if self.held < 0:
            return []
        self._run(chr(256 + self.held))
        return self._path()

    def whole(self, data: bytes) -> list[int]:
        """A pre-token of up to `lookahead` bytes that has come to its end: nothing of it is stable earlier."""
        self._run(data[:-1].decode("latin-1") + chr(256 + data[-1]))
        return self._path()


_seconds: set[str] = set()


def starts_fresh(c: str) -> bool:
    """Whether canonical composition never joins a character, or reorders it, with what stands before it."""
    if c.isascii():
        return True
    if not _seconds:
        for x in range(0x80, 0x110000):
            d = unicodedata.decomposition(chr(x)).split(" ")
            if len(d) == 2 and d[0][0] != "<":
                _seconds.add(chr(int(d[1], 16)))
        _seconds.update(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]))
    first = unicodedata.normalize("NFD", c)[0]
    return unicodedata.combining(first) == 0 and first not in _seconds


class Encoder:
    """feed() takes pieces of a text; finish() ends it. Held between pieces: raw text that a special token or
    a composed character may still grow from, an apostrophe that may open a contraction, and the open
    pre-token: its text up to KEPT characters, its transducer beyond."""

    def __init__(self, model: Model, cache: int = CACHE) -> None:
        self.m, self.room = model, cache
        self.cache: dict[str, bytes] = {}  # the newer half
        self.older: dict[str, bytes] = {}
        self.reset()

    def reset(self) -> None:
        self.raw = self.mark = self.open = self.kind = ""
        self.word: Word | None = None

    @property
    def held(self) -> int:
        """Characters and tokens held back."""
        return len(self.raw) + len(self.mark) + len(self.open) + (len(self.word.lasts) if self.word else 0)

    def _ids(self, pre: str) -> bytes:
        got = self.cache.get(pre)
        if got is None:
            got = self.older.get(pre)
            if got is None:
                w, data = Word(self.m), pre.encode()
                got = array("I", w.whole(data) if len(data) <= self.m.lookahead else w.feed(data) + w.finish()).tobytes()
            self._store(pre, got)
        return got

    def _miss(self, chunk: str) -> bytes:
        pres = [chunk] if chunk.isalpha() else [chunk[:-1], chunk[-1]] if chunk[-1] in ".,!?;:" and chunk[:-1].isalpha() else patterns(chunk).pre.findall(chunk)
        return b"".join(map(self._ids, pres))

    def _store(self, pre: str, ids: bytes) -> None:
        """Keeps what short pre-tokens give, `room` of them at most: those not met for longest go first."""
        if len(pre) <= KEPT:
            if len(self.cache) >= self.room // 2:
                self.older, self.cache = self.cache, {}
            self.cache[pre] = ids

    @staticmethod
    def normal(text: str) -> str:
        """NFC, then lower case letter by letter (without the final sigma of str.lower)."""
        if text.isascii():
            return text.lower()
        if not _RARE.search(text):
            return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        # nothing is joined or moved across a late mark
        parts = [x if _LATE.match(x) else unicodedata.normalize("NFC", x) for x in _LATE.split(text)]
        return "".join(parts).translate(_LOWER).replace("Σ", "σ").lower()

    def _closed(self, text: str) -> bytes:
        """Ids of normal text that begins at a pre-token and ends before white space."""
        chunks = text.split() if not _ODD.search(text) else [c for c in _SPACES.split(text) if c]
        get, miss = self.cache.get, self._miss
        return b"".join([get(c) or miss(c) for c in chunks])

    def _grow(self, text: str) -> bytes:
        """The open pre-token gets longer."""
        self.open += text
        if self.word is None and len(self.open) <= KEPT:
            return b""
        self.word = self.word or Word(self.m)
        data, self.open = self.open.encode(), ""
        return array("I", self.word.feed(data)).tobytes()

    def _close(self) -> bytes:
        """The open pre-token ends."""
        if self.word is not None:
            out, self.word = array("I", self.word.finish()).tobytes(), None
            return out
        pre, self.open = self.open, ""
        return self._ids(pre) if pre else b""

    def _plain(self, text: str) -> bytes:
        """Normal text without special tokens; its last pre-token stays open."""
        text, self.mark = self.mark + text, ""
        out = []
        if self.word is not None or self.open:
            p = patterns(text)
            n = (p.letters if self.kind == "L" else p.others).match(text).end()
            out.append(self._grow(text[:n]))
            if n == len(text):
                return b"".join(out)
            out.append(self._close())
            text = text[n:]
        cut = max(text.rfind(" "), text.rfind("\n"))
        if cut >= 0:
            out.append(self._closed(text[:cut]))
            text = text[cut + 1 :]
        p = patterns(text)
        found = list(p.pre.finditer(text))
        # an apostrophe that begins a pre-token may open a contraction with what comes
        if found and found[-1].end() == len(text):
            k = 1 if found[-1][0] == "'" else 2 if text[-2:] in ("'r", "'v", "'l") and len(found) > 1 and found[-2][0] == "'" else 0
            if k:
                self.mark = text[found[-k].start() :]
                found = found[:-k]
            elif not p.whole.fullmatch(found[-1][0]):
                last = found.pop()[0]
                out += [*(self._ids(x[0]) for x in found), self._grow(last)]
                self.kind = "L" if p.letters.match(last).end() else "O"
                return b"".join(out)
        return b"".join([*out, *(self._ids(x[0]) for x in found)])

    def _text(self, text: str) -> bytes:
        """Raw text that no later piece changes."""
        if not self.m._special or "<" not in text:
            return self._plain(self.normal(text))
        out, at = [], 0
        for x in self.m._special.finditer(text):
            out += [self._plain(self.normal(text[at : x.start()])), self._end(), array("I", [self.m.special[x[0]]]).tobytes()]
            at = x.end()
        return b"".join([*out, self._plain(self.normal(text[at:]))])

    def _end(self) -> bytes:
        """The end of a stretch of text."""
        mark, self.mark = self.mark, ""
        return self._close() + b"".join(map(self._ids, patterns(mark).pre.findall(mark)))

    def feed(self, piece: str) -> bytes:
        """Ids, as little-endian 32-bit integers, that are stable after this piece."""
        raw = self.raw + piece
        whole = 0
        if self.m._special and "<" in raw:
            whole = max((x.end() for x in self.m._special.finditer(raw)), default=0)
        cut = len(raw)
        for k in range(min(len(raw) - whole, max(map(len, self.m.special), default=1) - 1), 0, -1):
            if raw[-k:] in self.m.openings:
                cut -= k
                break
        cut -= 1
        while cut > whole and not starts_fresh(raw[cut]):
            cut -= 1
        cut = max(cut, whole)
        self.raw = raw[cut:]
        return self._text(raw[:cut])

    def finish(self) -> bytes:
        out = self._text(self.raw) + self._end()
        self.reset()
        return out

    def stream(self, text: str | None) -> Iterator[bytes]:
        """The ids of a text, as they become stable. A text of up to PIECE characters is one closed piece."""
        if text and len(text) > PIECE:
            for i in range(0, len(text), PIECE):
                yield self.feed(text[i : i + PIECE])
        elif text:
            yield self._text(text)
        yield self.finish()

    def encode(self, text: str | None) -> bytes:
        return b"".join(self.stream(text))


class Decoder:
    """Ids to text: the bytes of each token go through an incremental UTF-8 state machine. Tokens are written
    as they are named with spaces between them, as by a tokenizer without decoder, or with as_text=True as
    the bytes that they stand for."""

    def __init__(self, model: Model, as_text: bool = False) -> None:
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")
        self.between = b"" if as_text else b" "
        back = {c: b for b, c in enumerate(byte_symbols())}
        end = model.suffix
        if as_text:
            self.bytes = {i: (t.encode() if t in model.special else bytes(back[c] for c in t.removesuffix(end)) + b" " * t.endswith(end)) for i, t in model.names.items()}
        else:
            self.bytes = {i: t.encode() for i, t in model.names.items()}
        self.first = True

    def feed(self, ids) -> str:
        if not len(ids):
            return ""
        out = self.between.join([self.bytes[i] for i in ids])
        if not self.first:
            out = self.between + out
        self.first = False
        return self.utf8.decode(out)

    def finish(self) -> str:
        self.first = True
        return self.utf8.decode(b"", True)


_coders: dict[str, tuple[Encoder, Decoder]] = {}


def coders(source: str) -> tuple[Encoder, Decoder]:
    """The coders of a vocabulary, made once a worker process."""
    name = hashlib.sha256(source.encode()).hexdigest()
    if name not in _coders:
        model = Model(source)
        _coders[name] = Encoder(model), Decoder(model)
    return _coders[name]


def encode_documents(docs: DataFrame, text_col: str = "text", path: str | None = None, keep: list[str] | None = None, with_ids: bool = True) -> DataFrame:
    """docs' columns `keep` (all others than the text if not given) with n_tokens, ids (or not),
    ids_sha256 and decoded_sha256. The vocabulary travels with the tasks: one file of fixed size."""
    made = [("n_tokens", "long"), *([("ids", "array<long>")] if with_ids else []), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    own = ["n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in own and (keep is not None or c != text_col)]
    with open(model_path(path), encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())

    def coded(texts: list) -> dict:
        enc, dec = coders(source.value)
        out: dict[str, list] = {n: [] for n in own}
        for t in texts:
            kept, n_tokens, of_ids, of_text = array("I"), 0, hashlib.sha256(), hashlib.sha256()
            for data in enc.stream(t):  # only ids that are asked for are held
                ids = array("I", data)
                n_tokens += len(ids)
                of_ids.update(data)
                of_text.update(dec.feed(ids).encode())
                if with_ids:
                    kept += ids
            of_text.update(dec.finish().encode())
            for n, x in zip(own, (n_tokens, kept.tolist() if with_ids else None, of_ids.hexdigest(), of_text.hexdigest()), strict=True):
                out[n].append(x)
        return out

    return computed(docs, [F.col(f"`{c}`") for c in keep], F.col(text_col), coded, made)


def op4_bpe_encoding(spark, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), keep=["doc_id"], with_ids=False)
