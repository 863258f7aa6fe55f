"""Secret scans through nested encodings.

Each text is the first layer of a worklist. A layer is scanned with the three
patterns and then unwrapped in every way that applies: percent escapes and
Unicode escapes over the whole layer, base64 runs one by one (those broken over
lines of one length joined, and words glued to their front passed over), and
compressed payloads (gzip, zlib, bz2, xz, Zstandard, of several members, too, and
raw deflate) in base64 or written as escaped bytes. A payload is read as UTF-8,
UTF-16 and Latin-1; whatever it holds is scanned, and what is nine tenths
printable in one of these is a layer, unwrapped further. New
layers join the list until none is left. A layer with the text and place of one
seen before is dropped, so cycles end, and each occurrence of a blob counts.
Every layer carries a map of its positions to the text's, and a finding is
reported at the span of the text that holds it. Unwrapped layers only add
findings that touch unwrapped characters.

Null texts count as empty, with no findings. Very long texts are scanned whole.
Against decompression bombs, a payload of over ``MOST_INFLATED`` bytes is scanned
as a stream and not unwrapped further, and the layers of a text together hold at
most ``LAYERS`` times its characters and MOST_INFLATED more; layers beyond that
are scanned but not unwrapped. :func:`scan` says so of a row in ``truncated``.
Repeated rows are scanned one by one; :func:`scan` ignores extra columns and
:func:`redact` keeps them.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

KINDS = ("assign", "access", "hex")
MOST_INFLATED = 64 << 20
LAYERS = 64
#: Characters that a base64 run has at least to be tried.
LEAST_RUN = 16

_ASSIGN = re.compile(r"""(?ia)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
# One escaped character a match, so that positions map one by one: a UTF-8 sequence, or an escape or surrogate pair.
_PERCENT = re.compile(r"(?i)%[0-7][0-9a-f]|%[cd][0-9a-f]%[89ab][0-9a-f]|%e[0-9a-f](?:%[89ab][0-9a-f]){2}|%f[0-7](?:%[89ab][0-9a-f]){3}")
_UNICODE = re.compile(r"\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
_ONE = re.compile(r"\\u\{([0-9A-Fa-f]+)\}|\\[uUx]([0-9A-Fa-f]+)|&#[xX]([0-9A-Fa-f]+);|&#([0-9]+);")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
# Words and paths may hang on a run by marks that are letters of one of the alphabets.
_PARTS = [re.compile(r"[A-Za-z0-9+/]{16,}={0,2}"), re.compile(r"[A-Za-z0-9+_-]{16,}={0,2}"), re.compile(r"[A-Za-z0-9+]{16,}={0,2}")]
_WRAPPED = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:[\x20\t]*\r?\n[\x20\t]*[A-Za-z0-9+/_-]+)+={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
# How gzip, zlib, bz2, xz and Zstandard begin in base64.
_HEADS = re.compile(r"H4sI|eAE|eF4|eJ[w-z]|eN[o-r]|Qlpo|/Td6|_Td6|KLUv")
# Escaped bytes that begin as a compressed payload does, in the manner of a URL or of a string literal.
_URL_BYTES = re.compile(r"(?:%1[fF]%8[bB]|(?:x|%78)%(?:01|5[eE]|9[cC]|[dD][aA])|%[fF][dD]7zXZ|(?:%28|\()%[bB]5(?:%2[fF]|/)%[fF][dD]|BZh[1-9]1AY%26SY)(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~!*'()/+-])*")
_LITERAL_BYTES = re.compile(r"(?:\\x1[fF]\\x8[bB]|x(?:\\x01|\^|\\x9[cC]|\\x[dD][aA])|\\x[fF][dD]7zXZ|\(\\x[bB]5/\\x[fF][dD]|BZh[1-9]1AY&SY)(?:\\x[0-9A-Fa-f]{2}|\\[\\'\"nrt0]|[\x20!#-\[\]-~])*")
_BYTE = re.compile(r"%[0-9A-Fa-f]{2}|\\x[0-9A-Fa-f]{2}|\\?.")
_LITERAL = re.compile(rb"\\x([0-9A-Fa-f]{2})|\\([\\'\"nrt0])")
_PLAIN = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"0": b"\0"}

SCANNED = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long, truncated boolean"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Findings of the three patterns in one layer."""
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    return out + [("hex", *m.span()) for m in _HEX.finditer(text)]


def _ordered(spans) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in spans)


class _Layer:
    """A text with, for sorted runs of it, the span of the first layer each stands for."""

    def __init__(self, text: str, starts: list[int], roots: list[tuple[int, int, bool]]):
        self.text, self.starts, self.roots = text, starts, roots  # roots: start, end, unwrapped

    def root(self, a: int, z: int) -> tuple[int, int, bool]:
        """The first layer's span of text[a:z], and whether it holds anything unwrapped."""
        i, j = bisect_right(self.starts, a) - 1, bisect_right(self.starts, max(a, z - 1)) - 1
        (ra, re_, ru), (za, ze, zu) = self.roots[i], self.roots[j]
        start = ra if ru else ra + a - self.starts[i]
        end = ze if zu else za + z - self.starts[j]
        return start, end, any(u for *_, u in self.roots[i : j + 1])

    def replaced(self, pattern: re.Pattern, by) -> "_Layer | None":
        """The layer with each match of the pattern unwrapped, None if there is none."""
        pieces, starts, roots, at, size = [], [], [], 0, 0

        def keep(a, z):
            nonlocal size
            i = bisect_right(self.starts, a) - 1
            while a < z:
                stop = min(z, self.starts[i + 1] if i + 1 < len(self.starts) else z)
                ra, rz, unwrapped = self.roots[i]
                starts.append(size)
                roots.append((ra, rz, True) if unwrapped else (ra + a - self.starts[i], ra + stop - self.starts[i], False))
                pieces.append(self.text[a:stop])
                size += stop - a
                a, i = stop, i + 1

        for m in pattern.finditer(self.text):
            new = by(m[0])
            if new is None:
                continue
            keep(at, m.start())
            if new:
                starts.append(size)
                roots.append((*self.root(*m.span())[:2], True))
                pieces.append(new)
                size += len(new)
            at = m.end()
        if not at:
            return None
        keep(at, len(self.text))
        return _Layer("".join(pieces), starts or [0], roots or [(0, 0, True)])


def _percent(run: str) -> str | None:
    try:
        return bytes.fromhex(run.replace("%", "")).decode()
    except UnicodeDecodeError:
        return None


def _unicode(run: str) -> str | None:
    try:
        return "".join(chr(int(m[1] or m[2] or m[3], 16) if not m[4] else int(m[4])) for m in _ONE.finditer(run)).encode("utf-16", "surrogatepass").decode("utf-16")
    except (ValueError, OverflowError):
        return None


_PIECE = 1 << 14
_BROKEN = (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError, ValueError)
_GZIP, _ZSTD = b"\x1f\x8b", b"\x28\xb5\x2f\xfd"


def _opener(head: bytes, first: bool = True):
    """A new decompressor for what begins with these bytes, None if it is no compressed payload. Zlib has no further members."""
    if head[:2] == _GZIP or first and head[:1] == b"\x78" and len(head) > 2 and (head[0] << 8 | head[1]) % 31 == 0:
        return zlib.decompressobj(47)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\0":
        return lzma.LZMADecompressor()
    return zstandard.ZstdDecompressor().decompressobj() if head[:4] == _ZSTD else None


def _inflated(data: bytes):
    """Pieces of the content of a payload, member by member, and how far each reaches; ValueError at a cut one."""
    at = 0
    while (one := _opener(data[at : at + 8], not at)) is not None:
        while not one.eof:
            step = data[at : at + _PIECE]
            if not step:
                raise ValueError("cut")
            piece = one.decompress(step)
            at += len(step) - len(one.unused_data)
            yield piece, at


def _whole(start: int, run: str, data: bytes) -> list[tuple[int, int, bytes]]:
    """Escaped bytes up to the end of the payload; what follows it is none of its own."""
    size = 0
    try:
        for _, size in _inflated(data):
            pass
    except _BROKEN:
        return []
    ends = [m.end() for m in _BYTE.finditer(run)]
    return [(start, start + ends[size - 1], data[:size])] if 0 < size <= len(ends) else []


def _opened(data: bytes) -> tuple[bytes, bool] | None:
    """What is in a payload under all its compression, and whether there is more than that; None if one is broken."""
    seen = set()
    while _opener(data[:8]) is not None:
        mark = hashlib.sha256(data).digest()
        if mark in seen:
            return None
        seen.add(mark)
        pieces, size = [], 0
        try:
            for piece, _ in _inflated(data):
                pieces.append(piece)
                size += len(piece)
                if size > MOST_INFLATED:
                    return data, True
        except _BROKEN:
            return None
        data = b"".join(pieces)
    return data, False


def _kinds_in(data: bytes) -> set[str]:
    """The kinds of findings in a payload that is too large to keep; pieces overlap by as much as they hold."""
    kinds, tail = set(), b""
    try:
        for piece, _ in _inflated(data):
            for at in range(0, len(piece), 1 << 20):
                tail = tail[-(1 << 20) :] + piece[at : at + (1 << 20)]
                kinds.update(k for k, *_ in base_spans(tail.decode(errors="replace")))
    except _BROKEN:
        pass
    return kinds


def _readings(data: bytes):
    """Texts that a payload may be, and whether each looks like one that is worth unwrapping; only the first may be sure."""
    likely = lambda text: sum(c.isprintable() or c in "\r\n\t" for c in text) >= 0.9 * len(text)
    text = data.decode("utf-8" if _is_utf8(data) else "latin-1")
    yield text, likely(text)
    if b"\0" in data:  # of ASCII in UTF-16, in whichever order, every other byte is zero
        for at in (0, 1):
            text = data[at:].decode("utf-16-le", "replace")
            yield text, likely(text)


def _is_utf8(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


def _deflated(data: bytes) -> tuple[bytes, bool] | None:
    """What is in a payload of raw deflate, and whether there is more; None if it is none."""
    one = zlib.decompressobj(-15)
    try:
        out = one.decompress(data, MOST_INFLATED + 1)
    except zlib.error:
        return None
    if len(out) > MOST_INFLATED:
        return out, True
    return (out, False) if out and one.eof and not one.unused_data else None


def _decoded(run: str, glued: int = 0) -> bytes | None:
    """The bytes that a base64 run stands for, without so many characters in front."""
    body = run[glued:].rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:  # no whole byte is lost with the last character
        body = body[:-1]
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4))
    except (binascii.Error, ValueError):
        return None


def _unescaped(run: str) -> bytes:
    return _LITERAL.sub(lambda m: bytes([int(m[1], 16)]) if m[1] else _PLAIN.get(m[2], m[2]), run.encode())


def _joined_lines(text: str):
    """Start, end and joined characters of base64 over several lines of one length, the last one shorter or not in it."""
    for block in _WRAPPED.finditer(text):
        lines = [m.span() for m in _LINE.finditer(text, *block.span())]
        i = 0
        while i < len(lines):
            width, j = lines[i][1] - lines[i][0], i + 1
            while j < len(lines) and lines[j][1] - lines[j][0] == width:
                j += 1
            if width >= LEAST_RUN and width % 4 == 0:
                ends = [j + 1] if j < len(lines) and lines[j][1] - lines[j][0] < width else []
                yield [(lines[i][0], lines[k - 1][1], "".join(text[a:z] for a, z in lines[i:k])) for k in [*ends, *[j] * (j - i > 1)]]
            i = j


def _blobs(text: str):
    """Lists of (start, end, bytes) to be tried in turn until one holds something: readings of one place."""
    for choices in _joined_lines(text):
        yield [(a, z, data) for a, z, run in choices if (data := _decoded(run)) is not None]
    for m in _RUN.finditer(text):
        # A run that a word is glued to is read from one of four places; a compressed one from its beginning only.
        yield [(m.start() + k, m.end(), data) for k in range(4) if (data := _decoded(m[0], k)) is not None]
        yield from ([(m.start() + head.start(), m.end(), data)] for head in _HEADS.finditer(m[0], 1) if (data := _decoded(m[0], head.start())) is not None)
        tried = {m.span()}
        for parts in _PARTS if "/" in m[0] or "_" in m[0] or "-" in m[0] else []:
            for part in parts.finditer(text, *m.span()):
                if part.span() not in tried and (data := _decoded(part[0])) is not None:
                    tried.add(part.span())
                    yield [(*part.span(), data)]
    if "%" in text:
        for m in _URL_BYTES.finditer(text):
            yield _whole(m.start(), m[0], unquote_to_bytes(m[0]))
    if "\\x" in text:
        for m in _LITERAL_BYTES.finditer(text):
            yield _whole(m.start(), m[0], _unescaped(m[0]))


def all_spans(text: str) -> tuple[list, list, bool]:
    """The base findings of a text, all findings with those of unwrapped layers, both in order, and whether layers were too large to unwrap."""
    base = base_spans(text)
    found = set(base)
    first = _Layer(text, [0], [(0, len(text), False)])
    todo, seen, left, truncated = [first], set(), MOST_INFLATED + LAYERS * len(text), False
    while todo:
        layer = todo.pop()
        new = [layer.replaced(_PERCENT, _percent) if "%" in layer.text else None, layer.replaced(_UNICODE, _unicode) if "\\" in layer.text or "&#" in layer.text else None]
        for choices in _blobs(layer.text):
            for a, z, data in choices:
                root = (*layer.root(a, z)[:2], True)
                inner, more = _opened(data) or (data, False)
                if more:
                    truncated = True
                    found.update((kind, *root[:2]) for kind in _kinds_in(inner))
                    break
                readings, sure = list(_readings(inner)), _is_utf8(inner)
                if not (sure and readings[0][1]) and (deflated := _deflated(inner)) is not None:
                    truncated |= deflated[1]
                    inner, more = _opened(deflated[0]) or deflated
                    readings += _readings(inner)
                for inner_text, likely in readings:
                    if likely and inner_text:
                        new.append(_Layer(inner_text, [0], [root]))
                    else:
                        found.update((kind, *root[:2]) for kind, *_ in base_spans(inner_text))
                if sure and inner and readings[0][1]:
                    break
        for one in new:
            if one is None or (mark := (hash(one.text), hash(tuple(one.starts)), hash(tuple(one.roots)))) in seen:
                continue
            seen.add(mark)
            for kind, a, z in base_spans(one.text):
                start, end, unwrapped = one.root(a, z)
                if unwrapped:
                    found.add((kind, start, end))
            if len(one.text) <= left:
                left -= len(one.text)
                todo.append(one)
            else:
                truncated = True
    return _ordered(base), _ordered(found), truncated


def _long_run(data: np.ndarray, offsets: np.ndarray, among: np.ndarray, least: int) -> np.ndarray:
    """Which documents hold a run of so many bytes of a class."""
    start, end, doc = T.words(data, offsets, ~among)
    out = np.zeros(len(offsets) - 1, bool)
    out[doc[end - start >= least]] = True
    return out


_BASE64 = np.array([chr(c).isalnum() and c < 128 or chr(c) in "+/_-" for c in range(256)])
_MARKS = np.array([chr(c) in "%\\&" for c in range(256)])


def worth_a_look(column: pa.Array) -> np.ndarray:
    """Documents that may have any finding at all: an exact screen over the bytes."""
    data, offsets = T.utf8(column)
    # A run of LEAST_RUN characters is needed for hex, access and base64; escapes need a mark.
    look = _long_run(data, offsets, _BASE64, LEAST_RUN) | (T.per_doc(_MARKS[data], offsets) > 0)
    low = T.LOWER[data].tobytes()
    ends = offsets.tolist()
    for i in np.flatnonzero(~look).tolist():
        if any(low.find(k, ends[i], ends[i + 1]) >= 0 for k in _KEYWORDS):
            look[i] = True
    return look


def _of(column: pa.Array):
    """(base, all) findings for each text, and whether layers were left."""
    for text, look in zip(column, worth_a_look(column)):
        yield all_spans(text.as_py()) if look else ([], [], False)


def scan(docs: DataFrame) -> DataFrame:
    """Counts and spans of findings for each document."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc_id, (base, every, truncated) in zip(part.column("doc_id").to_pylist(), _of(part.column("text"))):
            n = {k: sum(s[0] == k for s in base) for k in KINDS}
            rows.append((doc_id, n["assign"], n["access"], n["hex"], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), len(every) - len(base), truncated))
        names = [c.split()[0] for c in SCANNED.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(T.mapper(run), SCANNED)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each run of overlapping findings replaced by a mark of the first one's kind."""
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, a, z = spans[i]
        while i < len(spans) and spans[i][1] < max(z, a + 1):
            z = max(z, spans[i][2])
            i += 1
        out += [text[at:a], f"[{kind}]"]
        at = z
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """All documents, secrets replaced by marks; n_chars, where there is one, follows the text."""
    schema = docs.schema

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        column = part.column("text")
        texts, changed = column.to_pylist(), {}
        for i, (_, every, _) in enumerate(_of(column)):
            if every:
                changed[i] = redacted(texts[i], every)
        if not changed:
            return part
        arrays = list(part.columns)
        names = part.schema.names
        arrays[names.index("text")] = pa.array([changed.get(i, t) for i, t in enumerate(texts)], column.type)
        if "n_chars" in names:
            at = names.index("n_chars")
            arrays[at] = pa.array([len(changed[i]) if i in changed else v for i, v in enumerate(arrays[at].to_pylist())], arrays[at].type)
        return pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.mapInArrow(T.mapper(run), schema)
