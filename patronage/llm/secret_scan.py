"""Secrets in texts, also below layers of encoding.

A worklist begins with the text itself. Every layer is scanned, and whatever in it is percent-encoded, escaped as
Unicode, base64 or compressed becomes a layer of its own, until nothing new turns up. Layers know for each character
which stretch of the text it comes from, so that a secret found in any of them is told by its place in the
text. A layer that has been seen at the same place is not entered again, which ends cycles.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import lzma
import re
import zlib
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The patterns of secrets, and the least length of what must be long (group 2, or the whole match).
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
#: Runs that fail by length cannot hold a longer one, so these may ask for it at once; ASSIGN may not.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_VALUE = 8

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(
    r"\\u\{([0-9A-Fa-f]{1,6})\}|((?:\\u[0-9A-Fa-f]{4})+)|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#([0-9]{1,7});|&#[xX]([0-9A-Fa-f]{1,6});"
)
#: The shortest secret, "token=" and eight characters, takes 19 characters in base64.
BASE64 = re.compile(r"(?:[A-Za-z0-9+/]{60,}\r?\n)*[A-Za-z0-9+/_-]{19,}")
#: Stretches of bytes that can hold a secret.
READABLE = re.compile(rb"[\t\n\r\x20-\x7e]{14,}")
#: What compressed data begins with, and what undoes it.
COMPRESSED = {
    b"\x1f\x8b": lambda: zlib.decompressobj(31), b"\x78\x01": zlib.decompressobj, b"\x78\x5e": zlib.decompressobj,
    b"\x78\x9c": zlib.decompressobj, b"\x78\xda": zlib.decompressobj, b"BZh": bz2.BZ2Decompressor, b"\xfd7zXZ\x00": lzma.LZMADecompressor,
}
#: Decompressed data is scanned in parts of so many bytes that share so many with the part before, so that data
#: which unpacks to any size takes bounded memory.
PART_BYTES, SHARED_BYTES = 1 << 22, 1 << 12
#: Layers below each other. Cycles end by themselves; only layers that grow at every step get here.
DEEPEST = 64


class Layer(NamedTuple):
    """A text (or bytes that are no text) and, for each of its characters, where that lies in the original."""

    content: str | bytes
    begins: np.ndarray | None  # None: the original itself
    ends: np.ndarray | None
    path: tuple[str, ...]  # the encodings around it

    def place(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.begins is None else (int(self.begins[start]), int(self.ends[end - 1]))

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        if self.begins is not None:
            return self.begins, self.ends
        at = np.arange(len(self.content) + 1, dtype=np.int64)
        return at[:-1], at[1:]


class Span(NamedTuple):
    start: int
    kind: int
    end: int
    path: tuple[str, ...]


def matches(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, kind, end) of the secrets that a text shows, leftmost and not overlapping within each kind."""
    for found in ASSIGN.finditer(text):
        if found.end(2) - found.start(2) >= LEAST_VALUE:
            yield found.start(), 0, found.end()
    for kind, pattern in ((1, ACCESS), (2, HEX)):
        for found in pattern.finditer(text):
            yield found.start(), kind, found.end()


def as_text(data: bytes) -> str | None:
    """Data that is readable text, else None."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return None
    return text if all(c.isprintable() or c.isspace() for c in text) else None


def char_bytes(text: str) -> np.ndarray:
    """Where each character of a text begins in its bytes, and where the last one ends."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    widths = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
    return np.concatenate(([0], np.cumsum(widths))).astype(np.int64)


def from_bytes(data: bytes, begins: np.ndarray, ends: np.ndarray, path: tuple[str, ...]) -> Layer | None:
    """A layer of decoded bytes, if they are readable or compressed. ``begins`` and ``ends`` are of each byte."""
    text = as_text(data)
    if text is not None:
        at = char_bytes(text)
        return Layer(text, begins[at[:-1]], ends[at[1:] - 1], path)
    return Layer(data, begins[:1], ends[-1:], path) if unpacker(data) else None


def unpacker(data: bytes):
    return next((undo for magic, undo in COMPRESSED.items() if data.startswith(magic)), None)


def parts_of(data: bytes) -> Iterator[bytes]:
    """Compressed data unpacked, in parts. Damaged data gives what can be read."""
    undo = unpacker(data)()
    whole = isinstance(undo, (bz2.BZ2Decompressor, lzma.LZMADecompressor))  # these keep what they have not read yet
    try:
        while not undo.eof:
            part = undo.decompress(data, PART_BYTES)
            data = b"" if whole else undo.unconsumed_tail
            if not part and (undo.needs_input if whole else not data):
                break
            yield part
    except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
        return


def unpacked(layer: Layer) -> Iterator[Layer]:
    """What compressed data holds; all of it comes from the whole stretch. Texts come in parts, compressed data within
    compressed data at once."""
    (start, end), path, before = layer.place(0, 1), (*layer.path, "compressed"), b""
    parts = parts_of(layer.content)
    for part in parts:
        if not before and unpacker(part):
            yield Layer(b"".join([part, *parts]), np.array([start]), np.array([end]), path)
            return
        text = (before + part).decode(errors="replace")  # parts may cut a character in two
        if text:
            yield Layer(text, np.full(len(text), start), np.full(len(text), end), path)
        before = part[-SHARED_BYTES:]


def percent_decoded(layer: Layer) -> Iterator[Layer]:
    """The whole layer without its percent codes; runs of them that are compressed data make layers too."""
    pieces = []
    for found in PERCENT.finditer(layer.content):
        data = bytes.fromhex(found.group().replace("%", ""))
        at = found.start() + 3 * np.arange(len(data) + 1)
        text = as_text(data)
        if text is not None:
            pieces.append((found.start(), found.end(), text, at[char_bytes(text)]))
        elif unpacker(data):
            begins, ends = layer.bounds()
            yield Layer(data, begins[at[:1]], ends[at[-1:] - 1], (*layer.path, "url"))
    if pieces:
        yield rewritten(layer, pieces, "url")


def unescaped(found: re.Match) -> tuple[str, list[int]] | None:
    """The characters of an escape and where each begins in it, and its end; None if there are no such characters."""
    braced, units, long, byte, decimal, hexadecimal = found.groups()
    if units:
        values = [int(unit, 16) for unit in units.split("\\u")[1:]]
        out, at, k = [], [0], 0
        while k < len(values):
            pair = 0xD800 <= values[k] < 0xDC00 and k + 1 < len(values) and 0xDC00 <= values[k + 1] < 0xE000
            if not pair and 0xD800 <= values[k] < 0xE000:
                return None
            out.append(chr(0x10000 + (values[k] - 0xD800 << 10) + values[k + 1] - 0xDC00) if pair else chr(values[k]))
            k += 2 if pair else 1
            at.append(6 * k)
        return "".join(out), at
    value = int(decimal) if decimal else int(braced or long or byte or hexadecimal, 16)
    if value > 0x10FFFF or 0xD800 <= value < 0xE000:
        return None
    return chr(value), [0, found.end() - found.start()]


def unicode_decoded(layer: Layer) -> Iterator[Layer]:
    """The whole layer without its Unicode escapes and numeric character references."""
    pieces = []
    for found in ESCAPE.finditer(layer.content):
        done = unescaped(found)
        if done:
            pieces.append((found.start(), found.end(), done[0], found.start() + np.array(done[1])))
    if pieces:
        yield rewritten(layer, pieces, "unicode")


def rewritten(layer: Layer, pieces: list[tuple], name: str) -> Layer:
    """A layer with some stretches replaced: (start, end, text, where in the layer each character begins and the last ends)."""
    begins, ends = layer.bounds()
    texts, starts, stops, at = [], [], [], 0
    for start, end, text, bounds in pieces:
        texts += [layer.content[at:start], text]
        starts += [begins[at:start], begins[bounds[:-1]]]
        stops += [ends[at:start], ends[bounds[1:] - 1]]
        at = end
    texts.append(layer.content[at:])
    return Layer("".join(texts), np.concatenate([*starts, begins[at:]]), np.concatenate([*stops, ends[at:]]), (*layer.path, name))


def base64_decoded(layer: Layer) -> Iterator[Layer]:
    """Each run of base64 (also the URL-safe kind, also in lines) as a layer.

    A run may begin within other letters, so all four alignments are tried. If none makes the whole run readable, readable
    stretches of them make layers.
    """
    begins, ends = layer.bounds()
    for found in BASE64.finditer(layer.content):
        run, parts = found.group(), []
        places = np.fromiter((k for k, c in enumerate(run) if c not in "\r\n"), dtype=np.int64) if "\n" in run else np.arange(len(run))
        letters = run.replace("\r", "").replace("\n", "").replace("-", "+").replace("_", "/")
        for skip in range(4):
            part = letters[skip:]
            part = part[: len(part) - (len(part) % 4 == 1)]
            try:
                data = base64.b64decode(part + "=" * (-len(part) % 4))
            except binascii.Error:
                continue
            n = np.arange(len(data))
            first = found.start() + places[skip + n // 3 * 4 + n % 3]
            last = found.start() + places[skip + n // 3 * 4 + n % 3 + 1]
            child = from_bytes(data, begins[first], ends[last], (*layer.path, "base64"))
            if child is not None:
                yield child
                break
            parts += [(m.group().decode(), begins[first[m.start() : m.end()]], ends[last[m.start() : m.end()]]) for m in READABLE.finditer(data)]
        else:
            for text, starts, stops in parts:
                yield Layer(text, starts, stops, (*layer.path, "base64"))


def children(layer: Layer) -> Iterator[Layer]:
    if isinstance(layer.content, bytes):
        yield from unpacked(layer)
        return
    if "%" in layer.content:
        yield from percent_decoded(layer)
    if "\\" in layer.content or "&#" in layer.content:
        yield from unicode_decoded(layer)
    yield from base64_decoded(layer)


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """The secrets that a text shows, and those of it and all layers below, each in order.

    A secret that several layers show at one place is told once, by the layer found first.
    """
    base = [Span(start, kind, end, ()) for start, kind, end in matches(text)]
    found = {span[:3]: span for span in base}
    work, seen = deque([Layer(text, None, None, ())]), set()
    while work:
        layer = work.popleft()
        for child in children(layer) if len(layer.path) < DEEPEST else ():
            raw = child.content if isinstance(child.content, bytes) else child.content.encode("utf-8", "surrogatepass")
            mark = (xxhash.xxh3_128_digest(raw), int(child.begins[0]), int(child.ends[-1]))
            if mark in seen:
                continue
            seen.add(mark)
            if isinstance(child.content, str):
                for start, kind, end in matches(child.content):
                    begin, stop = child.place(start, end)
                    found.setdefault((begin, kind, stop), Span(begin, kind, stop, child.path))
            work.append(child)
    return sorted(base), sorted(found.values())


SPANS = "array<struct<kind:string,start:bigint,end:bigint,layers:string>>"


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``spans``, arrays of (kind, start, end, layers).

    ``base`` has what the text itself shows, ``spans`` that and what its layers show, at the place in the text that it was
    decoded from; ``layers`` names the encodings from the outside in, joined by ``>`` (empty: the text itself).
    Places are code points, ends exclusive; both arrays are ordered by start, then kind (assign, access, hex), then end. A null or
    empty text has none; texts are read whole, whatever their length; repeated rows are scanned each; ids do not
    matter. Columns named base or spans already in ``docs`` are replaced. An empty table stays empty. Data
    that unpacks to more than 4 MB of text is scanned in parts that overlap, so that memory is bounded; layers more than 64
    deep are not entered.
    """
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("layers", pa.string())])

    def told(spans: list[Span]) -> list[dict]:
        return [{"kind": KINDS[s.kind], "start": s.start, "end": s.end, "layers": ">".join(s.path)} for s in spans]

    @F.arrow_udf(f"struct<base:{SPANS},spans:{SPANS}>")
    def scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            both = [scan(value.as_py() or "") for value in batch]
            columns = [pa.array([told(pair[k]) for pair in both], pa.list_(kind)) for k in range(2)]
            yield pa.StructArray.from_arrays(columns, ["base", "spans"])

    found = F.col("scanned__")
    return docs.withColumn("scanned__", scanned(F.col(text))).withColumn("base", found["base"]).withColumn("spans", found["spans"]).drop("scanned__")
