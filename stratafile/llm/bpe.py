"""Byte-level BPE by a priority queue of merge ranks over a doubly linked symbol list.

``encode(df)`` gives the token ids of every whole text, ``decode(df)`` the text
of every id list, both as the tokenizers library does with the same file.

A text is cut at single spaces between two non-space characters: no piece of
the pre-tokenizer's pattern spans such a cut, so the units between cuts are
encoded on their own and one cache of at most ``CACHE_BYTES`` keeps what came
out. Only units not in the cache go through the pattern and the queue.

Null texts count as empty: no ids, empty decoded text. Ids are little-endian
unsigned 32-bit integers in one binary value. Rows with a null key and rows
that repeat are encoded each by itself; other columns, whatever their names,
are left out by :func:`encode` and kept by :func:`decode`, but for one named
``decoded``, which gives way.
"""

from __future__ import annotations

import heapq
import json
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: White space of the pre-tokenizer's pattern, spelt out (fixed values).
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: The pre-tokenizer's pattern (fixed values).
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"

#: What a worker's cache of units may take in all, counted with what Python adds to each entry.
CACHE_BYTES = 128 << 20
ENTRY_BYTES = 230
#: Marks that end words; none is a letter, a number, white space or an apostrophe.
MARKS = ".,;:!?#*$%&|"
LONGEST_CACHED = 64
ROWS_AT_ONCE = 256


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def token_bytes(path: str) -> dict[int, bytes]:
    """The bytes of every id of a byte-level BPE file."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    letters = {c: b for b, c in enumerate(byte_letters())}
    special = {x["content"]: x["id"] for x in told.get("added_tokens", [])}
    of = {i: bytes(letters[c] for c in token) for token, i in told["model"]["vocab"].items() if token not in special}
    return of | {i: s.encode() for s, i in special.items()}


class Vocabulary:
    """What a byte-level BPE file says to an encoder: ids of bytes, merge ranks, special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        ids = told["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in told.get("added_tokens", [])}
        self.of_byte = [ids[c] for c in byte_letters()]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(told["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((ids[a], ids[b]), (rank, ids[a + b]))

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: lowest rank first, leftmost among equals, until nothing merges."""
        ids = [self.of_byte[b] for b in piece]
        n = len(ids)
        if n < 2:
            return ids
        merges = self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            found = merges.get((ids[i], ids[i + 1]))
            if found:
                queue.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right, made = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue  # stale: one of the two has merged since
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                found = merges.get((made, ids[k]))
                if found:
                    heapq.heappush(queue, (found[0], i, made, ids[k], found[1]))
            h = before[i]
            if h >= 0:
                found = merges.get((ids[h], made))
                if found:
                    heapq.heappush(queue, (found[0], h, ids[h], made, found[1]))
        return [x for x in ids if x >= 0]


class QueueBackend:
    """Encodes units by the pattern and :meth:`Vocabulary.merge`."""

    def __init__(self, path: str):
        import regex

        self.vocabulary = Vocabulary(path)
        self.special = self.vocabulary.special
        self.pieces = regex.compile(PATTERN).findall

    def encode_units(self, units: list[str]) -> list[list[int]]:
        pieces, merge = self.pieces, self.vocabulary.merge
        return [[i for piece in pieces(unit) for i in merge(piece.encode())] for unit in units]


class LibraryBackend:
    """Encodes units with the tokenizers library."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.special = {x.content: i for i, x in self.library.get_added_tokens_decoder().items()}
        vocabulary = self.library.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that begin with a space
        space = byte_letters()[32]
        self.begins[[i for token, i in vocabulary.items() if token[0] == space]] = True

    def spaced(self, units: list[str]) -> list[bytes]:
        """Packed ids of units that each follow a space and hold none: one call for all, cut where a token begins with a space."""
        ids = np.array(self.library.encode_batch_fast([" " + " ".join(units)], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = np.nonzero(self.begins[ids])[0]
        if len(cuts) != len(units):
            raise ValueError("a token spans two units")
        data, edges = ids.tobytes(), [*(cuts * 4).tolist(), 4 * len(ids)]
        return [data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def encode_units(self, units: list[str]) -> list[list[int]]:
        return [x.ids for x in self.library.encode_batch_fast(units, add_special_tokens=False)]


class Encoder:
    """Whole texts to packed ids, unit by unit, with a bounded cache."""

    def __init__(self, backend):
        import re

        self.backend = backend
        # by what follows a space; a first unit is kept under a space and itself. When half of the bytes are used, what is
        # there becomes the older half and the half before it goes; a unit that is met again moves up
        self.inner: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        self.cuts = re.compile(r"(?<=\S) (?=\S)").split
        self.by_special = re.compile("(" + "|".join(map(re.escape, sorted(backend.special, key=len, reverse=True))) + ")").split if backend.special else None

    def _spaced(self, units: list[str]) -> list[bytes]:
        """Packed ids of clean units as they are after a space."""
        if units and isinstance(self.backend, LibraryBackend):
            return self.backend.spaced(units)
        return self._packed([" " + u for u in units])

    def _packed(self, units: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(x)}I", *x) for x in self.backend.encode_units(units)]

    def _segment(self, text: str) -> bytes:
        """Ids of a text without special strings."""
        if not text:
            return b""
        first, *rest = text.split(" ")
        inner = self.inner
        if first and not (rest and first[-1].isspace()):
            try:
                return self._first(first) + b"".join(map(inner.__getitem__, rest))
            except KeyError:
                pass
        missing = set(rest).difference(inner)
        older = self.older
        again = {u: older[u] for u in missing if u in older}
        missing.difference_update(again)
        if not first or rest and first[-1].isspace() or any(not u or u[0].isspace() or u[-1].isspace() for u in missing):
            first, *rest = self.cuts(text)  # white space beside a space: no cut there, and such units stay out of the cache
            return self._first(first) + b"".join(self._packed([" " + u for u in rest]))
        here = {u: inner[u] for u in set(rest) if u in inner} | again
        here |= (fresh := self._fresh(missing))
        data = b"".join([here[u] for u in rest])
        self._keep(again)
        self._keep(fresh)
        return self._first(first) + data

    def _keep(self, fresh: dict[str, bytes]) -> None:
        """Puts units into the newer half of the cache."""
        for unit, ids in fresh.items():
            if len(unit) <= LONGEST_CACHED and unit not in self.inner:
                cost = ENTRY_BYTES + 2 * len(unit) + len(ids)
                if self.held + cost > CACHE_BYTES // 2:
                    self.older, self.inner, self.held = self.inner, {}, 0
                self.held += cost
                self.inner[unit] = ids

    def _known(self, unit: str) -> bytes | None:
        return self.inner.get(unit) or self.older.get(unit)

    def _fresh(self, missing: set[str]) -> dict[str, bytes]:
        """Ids of units after a space. Letters and the marks after them are pre-tokens of their own, each looked up by itself."""
        whole, composed, known = [], [], {}
        for unit in missing:
            stem = unit.rstrip(MARKS)
            if len(stem) < len(unit) and stem.isalpha():
                composed.append((unit, stem))
                if stem not in known and stem not in missing:
                    if (ids := self._known(stem)) is not None:
                        known[stem] = ids
                    else:
                        whole.append(stem)
            else:
                whole.append(unit)
        whole = list(dict.fromkeys(whole))
        marks = {m: self._first(m) for m in {unit[len(stem) :] for unit, stem in composed}}
        fresh = dict(zip(whole, self._spaced(whole), strict=True))
        for unit, stem in composed:
            fresh[unit] = (fresh[stem] if stem in fresh else known[stem]) + marks[unit[len(stem) :]]
        return fresh

    def _first(self, unit: str) -> bytes:
        """Ids of a text's first unit, which has no space before it."""
        found = self._known(" " + unit)
        if found is None:
            found = self._packed([unit])[0]
            self._keep({" " + unit: found})
        return found

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.by_special and any(s in text for s in self.backend.special):
            special = self.backend.special
            return b"".join(struct.pack("<I", special[part]) if i % 2 else self._segment(part) for i, part in enumerate(self.by_special(text)))
        return self._segment(text)


_ENCODERS: dict[tuple[str, str], Encoder] = {}
_BYTES: dict[str, dict[int, bytes]] = {}


def encoder(path: str, backend: str = "queue") -> Encoder:
    """One encoder for each Python worker, so its cache outlives a task."""
    key = (path, backend)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder({"queue": QueueBackend, "library": LibraryBackend}[backend](path))
    return _ENCODERS[key]


def vocabulary_bytes(path: str) -> dict[int, bytes]:
    if path not in _BYTES:
        _BYTES[path] = token_bytes(path)
    return _BYTES[path]


def decode_ids(packed: bytes, bytes_of: dict[int, bytes]) -> str:
    """Vocabulary strings one after the other; bytes that are no UTF-8 become U+FFFD."""
    ids = memoryview(packed).cast("I") if struct.pack("=I", 1) == struct.pack("<I", 1) else struct.unpack(f"<{len(packed) // 4}I", packed)
    return b"".join(map(bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def by_slices(batches: Iterator[pa.RecordBatch], work: Callable[[pa.RecordBatch], pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield work(batch.slice(at, rows))


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", backend: str = "queue") -> DataFrame:
    """(key, ids binary, n_tokens long) for every row of ``df``; other columns are left out."""
    out = T.StructType([df.schema[key], T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        turn = encoder(path, backend).encode
        packed = [turn(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), pa.array([len(x) // 4 for x in packed], pa.int64())], names=[key, "ids", "n_tokens"])

    return df.select(key, text).mapInArrow(lambda batches: by_slices(batches, work), out)


def decode(df: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded`` to a result of :func:`encode`."""
    df = df.drop("decoded")
    out = T.StructType([*df.schema.fields, T.StructField("decoded", T.StringType())])
    at, names = df.columns.index("ids"), [*df.columns, "decoded"]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        table = vocabulary_bytes(path)
        texts = [decode_ids(x.as_buffer(), table) for x in batch.column(at)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=names)

    return df.mapInArrow(lambda batches: by_slices(batches, work), out)
