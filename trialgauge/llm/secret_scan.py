"""Secret scans with a recursive decoding worklist.

A text is scanned as it stands. Then every stretch that looks encoded (URL escapes, Unicode
escapes, base64 in one or several lines, and what base64 wraps in zlib or gzip) is decoded into a
layer, the layer is scanned and searched for further stretches, and so on until no new layer
appears. Layers already seen for the same stretch are skipped, so cycles end. A finding in such a
layer is reported as the outermost encoded stretch of the original text. Escapes are also decoded in
place, so that a plain key and an escaped value meet; a finding there that holds a decoded
character is reported from its first to its last character in the original text.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain
from urllib.parse import unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame

# The three kinds and what they match.
ASSIGN = re.compile(
    r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGN, MIN_ACCESS = 6, 20
KINDS = ("assign", "access", "hex")

#: A text without any of these, in lower case, has no assignment.
_ASSIGN_HINT = re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"'\x20]*[:=]")
# runs that may hold escapes; each is one linear match, and looked into afterwards
_URL_RUN, _URL_ESCAPE = re.compile(r"[A-Za-z0-9+/_.=:%-]+"), re.compile(r"%[0-9A-Fa-f]{2}")
_UNICODE_RUN = re.compile(r"[\x21-\x7E]+")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 that tools break into lines.
_WRAPPED = re.compile(r"(?:[A-Za-z0-9+/_-]{40,}\r?\n[\x20\t]*)+[A-Za-z0-9+/_-]+={0,2}")
# escapes of one code unit or code point: \u0070, \x70, \u{70}, \U00000070, &#112;, &#x70;
_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|\\u\{([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
_ESCAPE_HINT = re.compile(r"\\[uUx]|&#")
# neighbouring escapes are one piece, so that bytes and surrogates of one character stay together
_URL_PIECE, _ESCAPE_PIECE = re.compile(r"(?:%[0-9A-Fa-f]{2})+"), re.compile(f"(?:{_ESCAPE.pattern})+")

#: Compressed data is inflated in pieces and read in windows of about this many bytes that overlap: a secret longer than
#: the overlap, or an encoded stretch longer than a window, can be cut where two windows meet.
PIECE, WINDOW, OVERLAP = 1 << 20, 16 << 20, 1 << 16

SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_layers bigint"

Span = tuple[int, int, int]  # start, kind, end


def scan(text: str) -> list[Span]:
    """Base findings of one text: leftmost non-overlapping per kind, short ones dropped."""
    found: list[Span] = []
    if _ASSIGN_HINT.search(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def _is_text(data: bytes) -> bool:
    try:
        return all(c >= " " or c in "\t\r\n" for c in data.decode("utf-8"))
    except UnicodeDecodeError:
        return False


def _compressed(data: bytes) -> bool:
    return data[:2] == b"\x1f\x8b" or (data[:1] == b"\x78" and int.from_bytes(data[:2]) % 31 == 0)


def _inflate(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Output of all members in bounded pieces, and what follows the last; up to the first fault."""
    engine = None
    for data in pieces:
        out = b""
        while data or len(out) == PIECE:
            if engine is None:
                if not _compressed(data):
                    if data:
                        yield data
                    break
                # 47 accepts both the zlib and the gzip header
                engine = zlib.decompressobj(47)
            try:
                out = engine.decompress(data, PIECE)
            except zlib.error:
                return
            if out:
                yield out
            data = engine.unused_data if engine.eof else engine.unconsumed_tail
            if engine.eof:
                engine, out = None, b""


def _windows(pieces: Iterator[bytes]) -> Iterator[bytes]:
    held = b""
    for piece in pieces:
        held += piece
        if len(held) >= WINDOW:
            yield held
            held = held[-OVERLAP:]
    yield held


def _unpacked(data: bytes) -> Iterator[bytes]:
    """Windows of the data, inflated for as long as it is compressed."""
    pieces, head, seen = iter((data,)), data, set()
    while _compressed(head) and (digest := hashlib.sha256(head).digest()) not in seen:
        seen.add(digest)
        inner = _inflate(pieces)
        first = next(inner, None)
        if first is None:
            pieces = chain((head,), pieces)
            break
        head, pieces = first, chain((first,), inner)
    return _windows(pieces)


def _from_base64(piece: str) -> Iterator[bytes]:
    body = piece.rstrip("=").replace("-", "+").replace("_", "/")
    # one character too many holds no byte
    body = body[: len(body) - (len(body) % 4 == 1)]
    try:
        data = base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return iter(())
    return _unpacked(data)


def _from_url(piece: str) -> str:
    return unquote_to_bytes(piece).decode("utf-8", "replace")


def _character(m: re.Match) -> str:
    number = int(m[6]) if m[6] else int(m[m.lastindex], 16)
    return chr(number) if number < 0x110000 else "\ufffd"


def _from_unicode(piece: str) -> str:
    out = _ESCAPE.sub(_character, piece)
    return out.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


class InPlace:
    """A text with its escapes decoded, and where each of its characters comes from."""

    def __init__(self, text: str, pieces: re.Pattern, decode: Callable[[str], str]) -> None:
        parts, self.starts, self.ends, self.before, self.after, at, to = [], [], [], [], [], 0, 0
        for m in pieces.finditer(text):
            found = decode(m[0])
            to += m.start() - at
            parts += [text[at : m.start()], found]
            self.starts.append(to)
            to += len(found)
            self.ends.append(to)
            self.before.append(m.start())
            self.after.append(m.end())
            at = m.end()
        self.text = "".join([*parts, text[at:]])

    def origin(self, start: int, end: int) -> tuple[int, int] | None:
        """The stretch of the encoded text behind a stretch that holds a decoded character."""
        first = bisect.bisect_right(self.ends, start)
        last = bisect.bisect_left(self.starts, end) - 1
        if first > last:
            return None
        shift = self.after[first - 1] - self.ends[first - 1] if first else 0
        low = self.before[first] if self.starts[first] <= start else start + shift
        high = self.after[last] if self.ends[last] >= end else end + self.after[last] - self.ends[last]
        return low, high


def _whole(inner: InPlace, start: int, end: int) -> tuple[int, int]:
    """Like ``origin``, for any stretch."""
    if (found := inner.origin(start, end)) is not None:
        return found
    before = bisect.bisect_right(inner.ends, start)
    shift = inner.after[before - 1] - inner.ends[before - 1] if before else 0
    return start + shift, end + shift


def in_place(text: str) -> Iterator[InPlace]:
    if "%" in text and _URL_ESCAPE.search(text):
        yield InPlace(text, _URL_PIECE, _from_url)
    if _ESCAPE_HINT.search(text) and _ESCAPE.search(text):
        yield InPlace(text, _ESCAPE_PIECE, _from_unicode)


def layers(text: str) -> Iterator[tuple[int, int, str, bool]]:
    """Start, end and decoded form of every encoded stretch of a text, and whether it is text for sure;
    undecodable bytes become replacement characters."""
    if "%" in text:
        for m in _URL_RUN.finditer(text):
            if _URL_ESCAPE.search(m[0]):
                yield m.start(), m.end(), _from_url(m[0]), True
                if "+" in m[0]:
                    # in a query a plus is a blank
                    yield m.start(), m.end(), _from_url(m[0].replace("+", " ")), True
    if _ESCAPE_HINT.search(text):
        for m in _UNICODE_RUN.finditer(text):
            if _ESCAPE.search(m[0]):
                yield m.start(), m.end(), _from_unicode(m[0]), True
    if "\n" in text:
        for m in _WRAPPED.finditer(text):
            for data in _from_base64(re.sub(r"\s+", "", m[0])):
                if data:
                    yield m.start(), m.end(), data.decode("utf-8", "replace"), _is_text(data)
    for m in _BASE64.finditer(text):
        for data in _from_base64(m[0]):
            if data:
                yield m.start(), m.end(), data.decode("utf-8", "replace"), _is_text(data)


def unwrap(text: str) -> tuple[list[Span], int]:
    """Findings inside decoded layers, mapped to the text, and the number of layers.

    Any long word passes for base64, so a decoded stretch that is not all text counts as a layer only if
    it has a finding; it is searched for further stretches all the same.
    """
    found: set[Span] = set()
    seen: set[tuple[int, int, bytes]] = set()
    n_layers = 0
    digest = lambda layer: hashlib.sha256(layer.encode("utf-8", "surrogatepass")).digest()
    # a layer's place maps its stretches to the text; None where a stretch holds nothing decoded
    whole = lambda start, end: (start, end)
    work: list[tuple[Callable, Iterator]] = [(whole, layers(text))]

    def decoded_in_place(layer: str, place: Callable) -> None:
        nonlocal n_layers
        for inner in in_place(layer):
            key = *place(0, len(layer)), digest(inner.text)
            if key in seen:
                continue
            seen.add(key)
            n_layers += 1

            def through(start: int, end: int, inner: InPlace = inner) -> tuple[int, int] | None:
                origin = inner.origin(start, end)
                return None if origin is None else place(*origin)

            for start, kind, end in scan(inner.text):
                if (at := through(start, end)) is not None:
                    found.add((at[0], kind, at[1]))
            work.append((through, layers(inner.text)))
            decoded_in_place(inner.text, lambda start, end, inner=inner: place(*_whole(inner, start, end)))

    decoded_in_place(text, whole)
    while work:
        place, source = work[-1]
        item = next(source, None)
        if item is None:
            work.pop()
            continue
        at = place(*item[:2])
        if at is None:
            continue
        start, end = at
        layer, sure = item[2:]
        key = start, end, digest(layer)
        if key in seen:
            continue
        seen.add(key)
        hits = scan(layer)
        found |= {(start, kind, end) for _, kind, _ in hits}
        n_layers += sure or bool(hits)
        work.append((lambda _, __, at=at: at, layers(layer)))
        decoded_in_place(layer, lambda _, __, at=at: at)
    return sorted(found), n_layers


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def secret_row(text: str | None) -> tuple:
    text = text or ""
    base = sorted(scan(text))
    added, n_layers = unwrap(text)
    digest = hashlib.sha256(_joined(base).encode()).hexdigest()
    counts = [sum(kind == k for _, kind, _ in base) for k in range(3)]
    return *counts, digest, _joined(sorted({*base, *added})), n_layers


def redact(text: str, mark: str = "[secret]") -> str:
    """The text with every finding, decoded ones included, replaced by ``mark``."""
    spans, out, at = sorted({*scan(text), *unwrap(text)[0]}), [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def secret_scan(docs: DataFrame) -> DataFrame:
    """Findings of every row of ``docs(doc_id, text)``.

    Null and empty texts have none; repeated rows and null ids are scanned row by row; other
    columns are ignored; an empty table gives an empty result. One pass without a shuffle;
    one text is in Python at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [secret_row(t.as_py()) for t in batch.column(1)]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(6)]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=[c.split()[0] for c in SCHEMA.split(", ")],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
