"""Trainer states too large for one cell: where their logs can be cut, found in one pass that holds no more than a slice.

A slice is a trainer state of its own: the first has the text around the log, the others the log alone. Only plain JSON
is cut, and only where each slice parses as its part of the whole would; all else is left whole.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

CHUNK = 1 << 18
KEY_BYTES = 1 << 12
LOG = "log_history"

_QUOTE, _APOSTROPHE, _COMMA, _LIST = b"\"',["
_STEP = np.zeros(256, np.int8)
_STEP[list(b"[{")], _STEP[list(b"]}")] = 1, -1
_KEY = re.compile(rb'("(?:[^"\\]|\\.)*+")[ \t\r\n]*+:[ \t\r\n]*+\[\Z', re.DOTALL)


@dataclass
class Slices:
    """The text before and after a log's entries, and per slice the number of its first entry, its start and its end."""

    head: bytes
    tail: bytes
    spans: list[tuple[int, int, int]] = field(default_factory=list)

    def texts(self, file) -> Iterator[tuple[int, bytes]]:
        if not self.spans:
            yield 0, self.head + self.tail
        for first, start, end in self.spans:
            file.seek(start)
            text = file.read(end - start)
            yield first, self.head + text + self.tail if start == len(self.head) else b'{"%s":[%s]}' % (LOG.encode(), text)


def log_slices(file, most: int) -> Slices | None:
    """Slices of about ``most`` bytes of the state in a file, or None where the state has to be parsed whole.

    A state that breaks off in its log becomes one text that breaks off there too, without the entries before.
    """
    head, piece, tail, spans = bytearray(), bytearray(), bytearray(), []
    place = head
    base = depth = inside = first = start = 0
    escaped = False
    while chunk := file.read(CHUNK):
        bare, escaped = _unescaped(chunk, escaped)
        raw = np.frombuffer(bare, np.uint8)
        quoted = (np.cumsum(raw == _QUOTE) + inside) & 1 == 1
        if (raw[~quoted] == _APOSTROPHE).any():
            return None
        step = np.where(quoted, 0, _STEP[raw])
        depths = depth + np.cumsum(step)
        edges = np.flatnonzero(((step == 1) & (depths == 2)) | ((step == -1) & (depths == 1)))
        commas = np.flatnonzero((raw == _COMMA) & ~quoted & (depths == 2))
        at = 0
        for edge in [*edges.tolist(), len(chunk)]:
            opens = edge < len(chunk) and step[edge] == 1
            upto = edge + 1 if opens else edge
            if place is piece:
                while (i := np.searchsorted(commas, max(at, start + most - base))) < len(commas) and commas[i] < upto:
                    cut = int(commas[i])
                    piece += chunk[at:cut]
                    if not (n := _entries(piece)):
                        return None
                    spans.append((first, start, base + cut))
                    first, start, at = first + n, base + cut + 1, cut + 1
                    piece.clear()
            place += chunk[at:upto]
            at = upto
            if opens and chunk[edge] == _LIST and place is not piece and _last_key(place) == LOG:
                if place is tail:
                    return None
                place, start = piece, base + upto
            elif place is piece and edge < len(chunk):
                n = _entries(piece)
                if n is None or (spans and not n):
                    return None
                spans.append((first, start, base + edge))
                place = tail
        base, depth, inside = base + len(chunk), int(depths[-1]), int(quoted[-1])
    if place is piece:
        return Slices(bytes(head), bytes(piece))
    return Slices(bytes(head), bytes(tail), spans) if spans and _one_log(bytes(head + tail)) else None


def _unescaped(chunk: bytes, escaped: bool) -> tuple[bytes, bool]:
    """The chunk with escapes blanked, and whether its end escapes what follows."""
    if escaped:
        chunk = b"_" + chunk[1:]
    if b"\\" not in chunk:
        return chunk, False
    chunk = re.sub(rb"\\.", b"__", chunk, flags=re.DOTALL)
    return chunk.replace(b"\\", b"_"), chunk.endswith(b"\\")


def _last_key(text: bytearray) -> str | None:
    """The key of the list that a text ends with."""
    found = _KEY.search(text, max(0, len(text) - KEY_BYTES))
    try:
        return found and json.loads(found[1])
    except ValueError:
        return None


def _entries(piece: bytearray) -> int | None:
    """How many entries a piece of a log holds; None if it is no list of objects and nulls."""
    try:
        entries = json.loads(f"[{piece.decode('utf-8', 'replace')}]")
    except (ValueError, RecursionError):
        return None
    return len(entries) if all(e is None or isinstance(e, dict) for e in entries) else None


def _one_log(text: bytes) -> bool:
    """Whether a text is one JSON object with one log."""
    try:
        pairs = json.loads(text.decode("utf-8", "replace"), object_pairs_hook=list)
    except (ValueError, RecursionError):
        return False
    return text.lstrip()[:1] == b"{" and sum(key == LOG for key, _ in pairs) == 1
