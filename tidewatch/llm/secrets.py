"""Secret scan with a recursive decoding worklist.

Each text is the first layer. A layer is scanned; its URL, Unicode, base64 and compressed regions are
unwrapped into new layers, which join the worklist until no new layer appears. A layer whose content
was seen before at the same place is not taken again, so cycles end; equal layers of other places are.
Every layer knows which spans of the document it came from, so findings are reported in code points of
the document. A base64 run is decoded at each of its four phases, line by line and also joined across
single line breaks; its findings have the span of the run, so a secret in one of several lines may have
two. Every member of a compressed layer is inflated to its end, or up to damage.

URL and Unicode escapes are undone level by level, and each level is scanned, up to DEPTH levels. Escapes nested
deeper are all undone in one pass, so that a tower of escapes costs linear time. No pattern holds an
escape's first character, so what a skipped level shows is still there, perhaps as part of more, in the last one.

Edge cases: null and empty texts have no spans; a text of any length is scanned whole; a null doc_id stays null; equal
rows are each scanned; findings of one place are ordered by kind; an empty table gives no rows; other columns, also
ones whose names differ from doc_id or text in case only, play no part; decoded bytes are scanned whatever they
are, readable or not. A decoded layer of more than max_layer_bytes is kept in a temporary file and scanned
whole; n_oversize counts these.
"""

from __future__ import annotations

import binascii
import hashlib
import mmap
import re
import tempfile
import zlib
from array import array
from collections import deque
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame

from .common import map_rows, pick

BASE_KINDS = ("assign", "access", "hex")
_RANK = {k: i for i, k in enumerate((*BASE_KINDS, "decoded_assign", "decoded_access", "decoded_hex"))}
#: Decoded layers beyond this are kept in a temporary file, so that decompression bombs do not fill the memory.
MAX_LAYER_BYTES = 16 << 20
#: Levels of nested escapes that are undone and scanned one by one.
DEPTH = 8
#: Bytes decoded at a time; a multiple of 4.
_STEP = 1 << 16

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|&#x[0-9A-Fa-f]{1,6};|&#[0-9]{1,7};)+")
_ESCAPE_ONE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
_B64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: A run that goes on behind single line breaks. It may hold less than 16 characters.
_B64_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}+(?:\r?\n[A-Za-z0-9+/_-]++)*+|[A-Za-z0-9+/_-]++(?:\r?\n[A-Za-z0-9+/_-]++)++)={0,2}")
#: The same over bytes. All patterns are ASCII, so that bytes find the same as UTF-8 text and no byte is bad.
_ASSIGN_BYTES, _ACCESS_BYTES = re.compile(_ASSIGN.pattern.encode(), re.I), re.compile(rb"AKIA[A-Z0-9]{16}")
_HEX_BYTES, _B64_LINES_BYTES = re.compile(rb"[0-9a-f]{24}"), re.compile(_B64_LINES.pattern.encode())
_PERCENT_BYTES, _ESCAPE_BYTES = re.compile(rb"(?:%[0-9A-Fa-f]{2}){1,9999}"), re.compile(_ESCAPE_ONE.pattern.encode())
_MAGIC = (b"\x1f\x8b\x08", b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda")
_MEMBER = re.compile(b"|".join(map(re.escape, _MAGIC)))
_TO_B64 = bytes.maketrans(b"-_", b"+/")
_CUES = ("passw", "secret", "token", "api")
_CUES_BYTES = tuple(c.encode() for c in _CUES)


def scan(text: str) -> list[tuple[str, int, int]]:
    """The base findings of one layer."""
    out: list[tuple[str, int, int]] = []
    small = text.lower()
    if any(c in small for c in _CUES):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return out


class _Layer:
    """A document's text, or that with regions decoded in place, plus lists of where each character came from."""

    __slots__ = ("text", "starts", "ends")

    def __init__(self, text: str, starts: Sequence[int] | None = None, ends: Sequence[int] | None = None):
        self.text, self.starts, self.ends = text, starts, ends

    def origins(self, a: int, b: int) -> tuple[Sequence[int], Sequence[int]]:
        return (range(a, b), range(a + 1, b + 1)) if self.starts is None else (self.starts[a:b], self.ends[a:b])

    def origin(self, a: int, b: int) -> tuple[int, int]:
        if self.starts is None:
            return a, b
        return self.starts[a], self.ends[b - 1]

    def key(self) -> tuple:
        """Content and origin, as digests."""
        place = None if self.starts is None else hashlib.sha256(array("q", [*self.starts, *self.ends]).tobytes()).digest()
        return hashlib.sha256(self.text.encode("utf-8", "surrogatepass")).digest(), place


def _holds(data, *needles: bytes, fold: bool = False) -> bool:
    """Is any of these short words in there? Much faster than the patterns they stand for."""
    for at in range(0, len(data), _STEP):
        piece = bytes(data[at : at + _STEP + 15])
        if fold:
            piece = piece.lower()
        if any(n in piece for n in needles):
            return True
    return False


class _Blob:
    """A decoded layer, written piece by piece: in memory up to limit bytes, beyond in an unnamed temporary file. All of it has one origin."""

    def __init__(self, limit: int):
        self.limit, self.data, self.file, self.sha = limit, bytearray(), None, hashlib.sha256()

    def write(self, piece: bytes) -> None:
        self.sha.update(piece)
        if self.file is None and len(self.data) + len(piece) > self.limit:
            self.file = tempfile.TemporaryFile()
            self.file.write(self.data)
            self.data = bytearray()
        if self.file is None:
            self.data += piece
        else:
            self.file.write(piece)

    def done(self) -> _Blob:
        if self.file is not None:
            self.file.flush()
            self.data = mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ)
        return self

    def kinds(self) -> set[str]:
        out = set()
        if _holds(self.data, *_CUES_BYTES, fold=True) and any(m.end(2) - m.start(2) >= 6 for m in _ASSIGN_BYTES.finditer(self.data)):
            out.add("assign")
        if _holds(self.data, b"AKIA") and _ACCESS_BYTES.search(self.data):
            out.add("access")
        if _HEX_BYTES.search(self.data):
            out.add("hex")
        return out


def _unbased(data, a: int, b: int, limit: int) -> Iterator[_Blob]:
    """The base64 run at data[a:b], which line breaks may cut, decoded from each of its first four characters: what stands before a word shifts it."""
    for skip in range(4):
        out, rest, first = _Blob(limit), b"", True
        for at in range(a, b, _STEP):
            rest += bytes(data[at : min(b, at + _STEP)]).translate(_TO_B64, b"=\r\n")
            if first:
                if len(rest) < 16:
                    return
                rest, first = rest[skip:], False
            n = len(rest) // 4 * 4
            out.write(binascii.a2b_base64(rest[:n]))
            rest = rest[n:]
        if len(rest) > 1:  # a single character is less than a byte
            out.write(binascii.a2b_base64(rest + b"=" * (4 - len(rest))))
        yield out.done()


def _inflated(data, at: int, limit: int) -> tuple[_Blob, int]:
    """What the compressed member at this place holds, up to damage if any, and where to look for the next one."""
    out, d, i = _Blob(limit), zlib.decompressobj(47), at
    while not d.eof and i < len(data):
        piece = bytes(data[i : i + _STEP])
        i += len(piece)
        while piece and not d.eof:
            before = d.copy()
            try:
                out.write(d.decompress(piece, _STEP))
            except zlib.error:
                try:
                    for k in range(len(piece)):
                        out.write(before.decompress(piece[k : k + 1]))
                except zlib.error:
                    pass
                return out.done(), at + 1
            piece = d.unconsumed_tail
    if d.eof:
        return out.done(), i - len(d.unused_data)
    out.write(d.flush())
    return out.done(), at + 1


def _rewritten(data, pattern: re.Pattern, decode, limit: int) -> Iterator[_Blob]:
    """The layer with each region of the pattern decoded, if there is any."""
    if not pattern.search(data):
        return
    out, at = _Blob(limit), 0
    for m in pattern.finditer(data):
        for i in range(at, m.start(), _STEP):
            out.write(data[i : min(m.start(), i + _STEP)])
        out.write(decode(m))
        at = m.end()
    for i in range(at, len(data), _STEP):
        out.write(data[i : i + _STEP])
    yield out.done()


def _percent_bytes(m: re.Match) -> bytes:
    return bytes.fromhex(m[0].replace(b"%", b"").decode())


def _escape_bytes(m: re.Match) -> bytes:
    code = int(m[1] or m[2] or m[3] or b"0", 16) if m[4] is None else int(m[4])
    return chr(code).encode("utf-8", "surrogatepass") if code <= 0x10FFFF else bytes(m[0])


_HEX_CODES, _DIGIT_CODES = frozenset(b"0123456789abcdefABCDEF"), frozenset(b"0123456789")


def _ended(codes: list[int]) -> tuple[int, int] | None:
    """(length, code) of the escape that the codes end in."""
    last = codes[-1]
    if last in _HEX_CODES:
        for head, digits in ((b"%", 2), (b"\\x", 2), (b"\\u", 4)):
            n = len(head) + digits
            if len(codes) >= n and codes[-n] == head[0] and codes[-n : len(codes) - digits] == list(head) and all(c in _HEX_CODES for c in codes[-digits:]):
                return n, int(bytes(codes[-digits:]), 16)
    elif last == 0x3B:  # ;
        for n in range(4, 12):
            if len(codes) >= n and codes[-n] == 0x26 and codes[1 - n] == 0x23:
                body = codes[2 - n : -1]
                base = 16 if body[0] == 0x78 else 10  # x
                body = body[1:] if base == 16 else body
                if body and len(body) <= (6 if base == 16 else 7) and all(c in (_HEX_CODES if base == 16 else _DIGIT_CODES) for c in body):
                    code = int(bytes(body), base)
                    return (n, code) if code <= 0x10FFFF else None
                return None
    return None


def _settled(layer: _Layer) -> _Layer | None:
    """The layer with all its escapes undone in one pass, nested ones too: a decoded character may end an escape that began before it."""
    out, starts, ends, changed = [], [], [], False
    for i, c in enumerate(map(ord, layer.text)):
        a, b = layer.origin(i, i + 1)
        out.append(c)
        starts.append(a)
        ends.append(b)
        while (found := _ended(out)) is not None:
            n, changed = found[0], True
            a, b = starts[-n], ends[-1]
            del out[-n:], starts[-n:], ends[-n:]
            out.append(found[1])
            starts.append(a)
            ends.append(b)
    return _Layer("".join(map(chr, out)), starts, ends) if changed else None


def _settled_bytes(data, limit: int) -> Iterator[_Blob]:
    """The same of decoded bytes. What is no byte becomes UTF-8."""
    out, changed = [], False
    for c in bytes(data):
        out.append(c)
        while (found := _ended(out)) is not None:
            changed = True
            del out[-found[0] :]
            if found[1] < 256:
                out.append(found[1])
            else:
                out.extend(chr(found[1]).encode("utf-8", "surrogatepass"))
    if changed:
        blob = _Blob(limit)
        blob.write(bytes(out))
        yield blob.done()


def _inside(blob: _Blob, limit: int, deep: bool) -> Iterator[_Blob]:
    """The layers directly inside decoded bytes; deep: with nested escapes undone at once, where they are in memory."""
    data = blob.data
    if deep and blob.file is None:
        if _holds(data, b"%", b"\\", b"&#"):
            yield from _settled_bytes(data, limit)
    else:
        if _holds(data, b"%"):
            yield from _rewritten(data, _PERCENT_BYTES, _percent_bytes, limit)
        if _holds(data, b"\\", b"&#"):
            yield from _rewritten(data, _ESCAPE_BYTES, _escape_bytes, limit)
    for m in _B64_LINES_BYTES.finditer(data):
        yield from _unbased(data, *m.span(), limit)
    at = 0 if _holds(data, *_MAGIC) else len(data)
    while m := _MEMBER.search(data, at):
        inner, at = _inflated(data, m.start(), limit)
        yield inner


def _closure(word: bytes, limit: int) -> tuple[set[str], int]:
    """(kinds found in any layer inside a base64 run, layers beyond the limit). Depth first: only a chain of layers exists at a time."""
    found, large, seen = set(), 0, set()
    stack = [_unbased(word, 0, len(word), limit)]
    while stack:
        blob = next(stack[-1], None)
        if blob is None:
            stack.pop()
        elif (key := blob.sha.digest()) not in seen:
            seen.add(key)
            large += blob.file is not None
            found |= blob.kinds()
            stack.append(_inside(blob, limit, len(stack) > DEPTH))
    return found, large


def _replaced(layer: _Layer, pattern: re.Pattern, decode) -> _Layer | None:
    """The layer with each region of the pattern decoded; the rest stays, so that a secret may straddle."""
    text, parts, starts, ends, at, changed = layer.text, [], [], [], 0, False
    for m in pattern.finditer(text):
        chars = decode(m)
        changed = True
        parts.append(text[at : m.start()])
        kept = layer.origins(at, m.start())
        starts.extend(kept[0])
        ends.extend(kept[1])
        for c, a, b in chars:
            a, b = layer.origin(a, b)
            parts.append(c)
            starts.append(a)
            ends.append(b)
        at = m.end()
    if not changed:
        return None
    kept = layer.origins(at, len(text))
    starts.extend(kept[0])
    ends.extend(kept[1])
    parts.append(text[at:])
    return _Layer("".join(parts), starts, ends)


def _percent(m: re.Match) -> list[tuple[str, int, int]]:
    data = bytes(int(m[0][i + 1 : i + 3], 16) for i in range(0, len(m[0]), 3))
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return [(chr(c), m.start() + 3 * i, m.start() + 3 * i + 3) for i, c in enumerate(data)]
    out, at = [], m.start()
    for c in text:
        n = 3 * len(c.encode())
        out.append((c, at, at + n))
        at += n
    return out


def _escape(m: re.Match) -> list[tuple[str, int, int]]:
    out = []
    for x in _ESCAPE_ONE.finditer(m.string, m.start(), m.end()):
        code = int(x[1] or x[2] or x[3] or "0", 16) if x[4] is None else int(x[4])
        if code > 0x10FFFF:  # no character: stays as it is
            out += [(m.string[i], i, i + 1) for i in range(x.start(), x.end())]
            continue
        out.append((chr(code), x.start(), x.end()))
    return out


def unwrap(layer: _Layer, deep: bool = False) -> Iterator[_Layer | None]:
    """The layer with its URL and Unicode regions decoded in place; deep: to the last level at once."""
    if deep:
        yield _settled(layer) if any(c in layer.text for c in ("%", "\\", "&#")) else None
        return
    if "%" in layer.text:
        yield _replaced(layer, _PERCENT, _percent)
    if "\\" in layer.text or "&#" in layer.text:
        yield _replaced(layer, _ESCAPE, _escape)


def _runs(text: str) -> Iterator[re.Match]:
    """The base64 runs of a text: those over several lines, and each line's own."""
    for m in _B64_LINES.finditer(text):
        if "\n" in m[0]:
            yield from _B64.finditer(text, *m.span())
        yield m


def find(text: str | None, limit: int = MAX_LAYER_BYTES) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]], int]:
    """(base spans, spans found in decoded layers, decoded layers beyond the limit)."""
    if not text:
        return [], [], 0
    base, extra, oversize = [], set(), 0
    seen, work, words, known_words = set(), deque([(_Layer(text), 0)]), set(), {}
    while work:
        layer, depth = work.popleft()
        if (key := layer.key()) in seen:
            continue
        seen.add(key)
        for kind, a, b in scan(layer.text):
            if not depth:
                base.append((kind, a, b))
            else:
                extra.add((f"decoded_{kind}", *layer.origin(a, b)))
        for m in _runs(layer.text):
            if (place := (m[0], *layer.origin(*m.span()))) in words:
                continue
            words.add(place)
            if m[0] not in known_words:
                known_words[m[0]] = _closure(m[0].encode(), limit)
            kinds, large = known_words[m[0]]
            extra.update((f"decoded_{kind}", *place[1:]) for kind in kinds)
            oversize += large
        work.extend((inner, depth + 1) for inner in unwrap(layer, depth >= DEPTH) if inner is not None)
    order = lambda s: (s[1], _RANK[s[0]], s[2])
    base.sort(key=order)
    known = set(base)
    return base, sorted((s for s in extra if (s[0][8:], s[1], s[2]) not in known), key=order), oversize


def secret_spans(docs: DataFrame, max_layer_bytes: int = MAX_LAYER_BYTES) -> DataFrame:
    """One row per document: doc_id, counts of the base kinds, their digest, all spans, n_decoded, n_oversize. No shuffle."""

    def start():
        def row(doc_id: int | None, text: str | None) -> Iterator[tuple]:
            base, extra, oversize = find(text, max_layer_bytes)
            said = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
            both = sorted(base + extra, key=lambda s: (s[1], _RANK[s[0]], s[2]))
            yield (doc_id, *[sum(s[0] == k for s in base) for k in BASE_KINDS], hashlib.sha256(said(base).encode()).hexdigest(), said(both), len(extra), oversize)

        return row

    return map_rows(pick(docs, "doc_id", "text"), start, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_decoded long, n_oversize long")
