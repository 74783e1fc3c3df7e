"""SentencePiece encoding and decoding by suffix-array matching.

The distinct units of a batch of texts are concatenated and indexed: suffixes are sorted by as many characters as the
longest piece has.  Every piece is looked up by binary search; the suffixes between its bounds are its occurrences.
These edges (position, length, piece) are put in order of position, and are then relaxed: for BPE models by merging,
in each unit, the adjacent pair whose joint edge has the best score until none is left, for unigram models by the best
path over the edges.  Results equal those of the public library for the same model file.

A unit is a run of spaces and what follows up to the next space or line feed.  No piece crosses such a border (that is
checked when a model is loaded; otherwise whole texts are units), so units can be encoded one by one and looked up
when they occur again.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extended, map_arrow, quoted, rest

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_CHUNK = 400_000  # characters indexed at a time
_TEXTS = 3_000_000  # characters of texts handled at a time
_CACHE = 250_000  # units remembered
_LONG = 48  # units longer than this are merged with a heap
_CELLS = 2_000_000  # places of units whose best paths are found together


def _fields(buf: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(field number, value) of a protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            b = buf[i]
            i += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while i < len(buf):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: bytes | int = varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            value, i = buf[i : i + n], i + n
        yield tag >> 3, value


@dataclass
class Model:
    """Pieces of a model file.  Only models without a character map, extra-space removal and user-defined pieces are taken."""

    pieces: list[str]
    scores: np.ndarray
    types: np.ndarray
    bpe: bool
    dummy_prefix: bool
    unk: int

    @classmethod
    def parse(cls, raw: bytes) -> Model:
        pieces, scores, types, bpe, dummy, charsmap, squeeze = [], [], [], False, True, b"", True
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                types.append(piece.get(3, 1))
            elif number == 2:
                bpe = dict(_fields(value)).get(3, 1) == 2
            elif number == 3:
                spec = dict(_fields(value))
                dummy, charsmap, squeeze = bool(spec.get(3, 1)), spec.get(2, b""), bool(spec.get(4, 1))
        if charsmap or squeeze or {4, 5} & set(types):
            raise ValueError("models with a character map, removal of extra spaces, or user-defined or unused pieces are not supported")
        return cls(pieces, np.array(scores), np.array(types), bpe, dummy, types.index(2))


class _Index(dict):
    """Numbers of units in order of their first lookup; fresh holds those not yet encoded."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, unit: str) -> int:
        self[unit] = number = len(self)
        self.fresh.append(unit)
        return number


class Codec:
    """Encodes and decodes batches of texts."""

    def __init__(self, model: Model):
        self.m = model
        self.normal = [i for i, t in enumerate(model.types) if t == 1]
        texts = [model.pieces[i] for i in self.normal]
        self.longest = max(map(len, texts), default=1)
        self.byte = {int(model.pieces[i][3:5], 16): i for i, t in enumerate(model.types) if t == 6}
        whole = any(SPACE in p.lstrip(SPACE) for p in texts)
        line = not any("\n" in p for p in texts if len(p) > 1)
        # Where lines and spaces are borders, texts without runs of spaces are split plainly: see _units.
        self.plain = line and not whole and model.dummy_prefix
        self.unit = re.compile(r"(?s).+" if whole else f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if line else f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        flat = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        self.lens = np.array([len(t) for t in texts])
        self.chars = np.zeros((len(texts), self.longest), np.uint32)
        self.chars[np.arange(self.longest) < self.lens[:, None]] = flat
        self.ids = np.array(self.normal, np.int32)
        self.kind = np.int16 if len(model.pieces) < 1 << 15 else np.int32
        self.letters, self.spell = np.unique(self.chars, return_inverse=True)
        self.spell = self.spell.reshape(self.chars.shape)
        out = [bytes([int(p[3:5], 16)]) if t == 6 else b" \xe2\x81\x87 " if t == 2 else b"" if t == 3 else p.replace(SPACE, " ").encode() for p, t in zip(model.pieces, model.types, strict=True)]
        self.out_len = np.array([len(x) for x in out])
        self.out_at = np.concatenate([[0], np.cumsum(self.out_len)])
        self.out = np.frombuffer(b"".join(out), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.index = _Index()
        self.at, self.flat = np.zeros(1, np.int64), np.zeros(0, np.int32)

    # Index and edges

    def _edges(self, codes: np.ndarray) -> np.ndarray:
        """Piece of each position and length, -1 where none: the occurrence edges in order of position, flat.

        codes: code points plus 1, 0 between units.
        """
        alphabet, rank = np.unique(codes, return_inverse=True)
        if not len(alphabet) or alphabet[0] != 0:
            alphabet, rank = np.concatenate([[0], alphabet]), rank + 1
        bits = max(1, int(len(alphabet)).bit_length())
        per = 1 << ((63 // bits).bit_length() - 1)
        words = -(-self.longest // per)
        full = (1 << bits) - 1

        # Suffixes as packed words of `per` characters each; sorting these sorts the suffixes.
        n = len(codes)
        word, have = np.concatenate([rank.astype(np.int64), np.zeros(words * per, np.int64)]), 1
        while have < per:  # twice as many characters each time
            word = (word << (bits * have)) | np.concatenate([word[have:], np.zeros(have, np.int64)])
            have *= 2
        keys = [word[w * per : w * per + n] for w in range(words)]
        order = np.lexsort(keys[::-1]) if words > 1 else np.argsort(keys[0], kind="stable")
        keys = [k[order] for k in keys]

        # Pieces whose characters all occur, with 0 (lower bound) or the largest code (upper bound) behind their end.
        inside = np.arange(self.longest) < self.lens[:, None]
        letters = self.letters.astype(np.int64) + 1
        spot = np.searchsorted(alphabet, letters)
        known = (spot < len(alphabet)) & (alphabet[np.minimum(spot, len(alphabet) - 1)] == letters)
        use = (known[self.spell] | ~inside).all(1)
        spot, inside, lens, ids = spot[self.spell[use]], inside[use], self.lens[use], self.ids[use]
        bounds = []
        for fill in (0, full):
            filled = np.full((len(lens), words * per), fill, np.int64)
            filled[:, : self.longest][inside] = spot[inside]
            packed = []
            for w in range(words):
                k = np.zeros(len(lens), np.int64)
                for j in range(w * per, (w + 1) * per):
                    k = (k << bits) | filled[:, j]
                packed.append(k)
            bounds.append(self._search(keys, packed, right=fill > 0))
        low, high = bounds
        count = high - low
        total = int(count.sum())
        place = order[np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)]
        table = np.full(n * self.longest, -1, self.kind)
        table[place * self.longest + np.repeat(lens - 1, count)] = np.repeat(ids.astype(self.kind), count)
        return table

    @staticmethod
    def _search(keys: list[np.ndarray], wanted: list[np.ndarray], right: bool) -> np.ndarray:
        """Binary search of all wanted tuples at once in the sorted tuples of keys."""
        n = len(keys[0])
        low, high = np.zeros(len(wanted[0]), np.int64), np.full(len(wanted[0]), n, np.int64)
        for _ in range(n.bit_length() + 1):
            open_ = low < high
            if not open_.any():
                break
            mid = np.minimum((low + high) // 2, n - 1)
            less, equal = np.zeros(len(mid), bool), np.ones(len(mid), bool)
            for k, w in zip(keys, wanted, strict=True):
                v = k[mid]
                less |= equal & (v < w)
                equal &= v == w
            go = open_ & (less | (equal if right else False))
            low = np.where(go, mid + 1, low)
            high = np.where(open_ & ~go, mid, high)
        return low

    # Relaxation

    def _merge(self, table: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """BPE: symbols (unit, position, length) after all merges, in order."""
        score = np.concatenate([self.m.scores, [-np.inf]])  # piece -1: no edge
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        short = np.flatnonzero(size <= _LONG)
        unit = np.repeat(short, size[short])
        pos = np.arange(len(unit)) - np.repeat(np.cumsum(size[short]) - size[short], size[short]) + np.repeat(begin[short], size[short])
        length = np.ones(len(unit), np.int64)
        while len(unit):
            both = length[:-1] + length[1:]
            ok = (unit[:-1] == unit[1:]) & (both <= self.longest)
            gain = np.full(len(unit), -np.inf)
            where = np.flatnonzero(ok)
            gain[where] = score[table[pos[where] * self.longest + both[where] - 1]]
            first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
            best = np.maximum.reduceat(gain, first)
            span = np.diff(np.concatenate([first, [len(unit)]]))
            wide = np.repeat(best, span)
            ended = wide == -np.inf
            if ended.any():
                done.append((unit[ended], pos[ended], length[ended]))
            take = np.flatnonzero((gain == wide) & ~ended)
            take = take[np.concatenate([[True], unit[take][1:] != unit[take][:-1]])] if len(take) else take
            length[take] = both[take]
            keep = ~ended
            keep[take + 1] = False
            unit, pos, length = unit[keep], pos[keep], length[keep]
        for u in np.flatnonzero(size > _LONG):
            p, ln = self._merge_long(table, int(begin[u]), int(size[u]), score)
            done.append((np.full(len(p), u), p, ln))
        if not done:
            z = np.zeros(0, np.int64)
            return z, z, z
        unit, pos, length = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.lexsort((pos, unit))
        return unit[order], pos[order], length[order]

    def _merge_long(self, table: np.ndarray, begin: int, n: int, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for one unit of any length, with a heap: n log n."""
        nxt, prv, size = list(range(1, n + 1)), list(range(-1, n - 1)), [1] * n
        heap: list[tuple[float, int, int]] = []

        def offer(i: int) -> None:
            j = nxt[i]
            if i >= 0 and j < n and size[i] + size[j] <= self.longest and (p := table[(begin + i) * self.longest + size[i] + size[j] - 1]) >= 0:
                heapq.heappush(heap, (-score[p], i, size[i] + size[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, total = heapq.heappop(heap)
            if not size[i] or (j := nxt[i]) >= n or size[i] + size[j] != total:
                continue
            size[i], size[j], nxt[i] = total, 0, nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            offer(i)
            if prv[i] >= 0:
                offer(prv[i])
        at = [i for i in range(n) if size[i]]
        return np.array(at) + begin, np.array([size[i] for i in at])

    def _best_path(self, table: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unigram: symbols on the best path.  Units of like lengths are relaxed together, as many as _CELLS places hold."""
        order, parts, i = np.argsort(size, kind="stable"), [], 0
        while i < len(order):
            j = i + 1
            while j < len(order) and (j + 1 - i) * (size[order[j]] + 1) <= _CELLS:
                j += 1
            parts.append(self._best_paths(table, begin, size, order[i:j]))
            i = j
        if not parts:
            return (np.zeros(0, np.int64),) * 3
        unit, pos, length = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((pos, unit))
        return unit[order], pos[order], length[order]

    def _best_paths(self, table: np.ndarray, begin: np.ndarray, size: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for some units, in order of size, end by end; ties go to the longer last piece."""
        score = np.concatenate([self.m.scores, [-np.inf]])
        unknown = (self.m.scores[self.ids].min() if len(self.ids) else 0.0) - 10
        begin, size = begin[units], size[units]
        longest = int(size.max(initial=0))
        best = np.full((len(units), longest + 1), -np.inf)
        best[:, 0] = 0
        back = np.ones((len(units), longest + 1), np.int16)
        for end in range(1, longest + 1):
            u = np.arange(np.searchsorted(size, end), len(units))
            for ln in range(1, min(self.longest, end) + 1):
                gain = score[table[(begin[u] + end - ln) * self.longest + ln - 1]]
                if ln == 1:
                    gain = np.where(gain == -np.inf, unknown, gain)
                new = best[u, end - ln] + gain
                better = new >= best[u, end]
                best[u[better], end], back[u[better], end] = new[better], ln
        # All paths are walked back together, a piece at a time.
        at, out = size.astype(np.int64).copy(), []
        while (live := np.flatnonzero(at > 0)).size:
            step = back[live, at[live]].astype(np.int64)
            at[live] -= step
            out.append((units[live], begin[live] + at[live], step))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3

    def _learn(self, units: list[str]) -> None:
        """Encode new units, which follow those encoded so far."""
        size = np.array([len(u) for u in units])
        text = "\0".join(units) + "\0"
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.int64) + 1
        begin = np.cumsum(size + 1) - (size + 1)
        codes[begin + size] = 0
        table = self._edges(codes)
        unit, pos, length = (self._merge if self.m.bpe else self._best_path)(table, begin, size)
        piece = table[pos * self.longest + length - 1].astype(np.int32)
        lost = np.flatnonzero(piece < 0)
        count = np.ones(len(piece), np.int64)
        spelled = {}
        if len(lost):
            for c in np.unique(codes[pos[lost]]):
                spelled[c] = [self.byte[b] for b in chr(c - 1).encode()] if self.byte else [self.m.unk]
            count[lost] = [len(spelled[c]) for c in codes[pos[lost]]]
        flat = np.repeat(piece, count)
        if len(lost):
            at = np.cumsum(count) - count
            for i in lost:
                own = spelled[codes[pos[i]]]
                flat[at[i] : at[i] + len(own)] = own
        per = np.bincount(unit, count, len(units)).astype(np.int64)
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(per)])
        self.flat = np.concatenate([self.flat, flat.astype(np.int32)])

    # Texts

    def _units(self, text: str) -> list[str]:
        """Keys of the units of a text.  A plain key is a word with the space before it left out, or a line feed and
        the word that begins the line; behind a NUL stands a unit as it is."""
        if not text:
            return []
        if self.plain and SPACE not in text and "\0" not in text:
            spread = text.replace("\n", " \n")
            words = spread.split(" ")
            if "" not in words:
                return words
        return ["\0" + u for u in self.unit((SPACE if self.m.dummy_prefix else "") + text.replace(" ", SPACE))]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of a batch of texts; an empty text has no ids."""
        if len(self.index) > _CACHE:
            self.forget()
        per_text = [self._units(t) for t in texts]
        total = sum(map(len, per_text))
        code = np.fromiter(map(self.index.__getitem__, chain.from_iterable(per_text)), np.int64, total)
        new, chars = [], 0
        for key in self.index.fresh:
            u = key[1:] if key[0] == "\0" else key if key[0] == "\n" else SPACE + key
            if chars and chars + len(u) > _CHUNK:
                self._learn(new)
                new, chars = [], 0
            new.append(u)
            chars += len(u) + 1
        if new:
            self._learn(new)
        self.index.fresh.clear()
        count = self.at[code + 1] - self.at[code]
        ends = np.concatenate([[0], np.cumsum(count)])
        ids = self.flat[np.arange(ends[-1]) + np.repeat(self.at[code] - ends[:-1], count)]
        return ends[np.concatenate([[0], np.cumsum([len(us) for us in per_text])]).astype(np.int64)], ids

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> list[str]:
        """Texts of a batch of ids: bytes of the pieces, without the dummy prefix."""
        count = self.out_len[ids]
        ends = np.concatenate([[0], np.cumsum(count)])
        raw = self.out[np.arange(ends[-1]) + np.repeat(self.out_at[ids] - ends[:-1], count)].tobytes()
        bounds = ends[offsets]
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return [t[1:] if self.m.dummy_prefix and t[:1] == " " else t for t in texts]


def _slices(b: pa.RecordBatch, texts: list[str]) -> Iterator[tuple[int, int]]:
    start = chars = 0
    for i, t in enumerate(texts):
        if chars and chars + len(t) > _TEXTS:
            yield start, i
            start, chars = i, 0
        chars += len(t)
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, model_file: str = MODEL, text_col: str = "text") -> DataFrame:
    """docs without text_col, with ids (array<int>), n_ids, n_chars_decoded and exact: whether decoding gives the text back.

    exact is false only for texts that hold the piece space character itself, which decodes to a space.  Null text
    counts as empty: no ids, exact.  Very long texts are encoded whole, a text at a time.  Input columns of the result's names are replaced, others pass through, repeated
    rows are encoded alike, an empty table gives an empty table; one pass, no shuffle.
    The model file (0.5 MB) is read on the driver and broadcast.
    """
    with open(model_file, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())
    others = docs.select(*quoted(rest(docs, text_col, "ids", "n_ids", "n_chars_decoded", "exact")))
    schema, k = extended(others.schema, "ids array<int>, n_ids long, n_chars_decoded long, exact boolean"), len(others.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(Model.parse(raw.value))
        for b in batches:
            texts = [t or "" for t in b.column(k).to_pylist()]
            for i, j in _slices(b, texts):
                part = texts[i:j]
                offsets, ids = codec.encode(part)
                back = codec.decode(offsets, ids)
                new = [
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())),
                    pa.array(np.diff(offsets), pa.int64()),
                    pa.array([len(t) for t in back], pa.int64()),
                    pa.array([x == y for x, y in zip(part, back, strict=True)], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in b.columns[:k]), *new], schema.names)

    return map_arrow(docs.select(*quoted(others.columns), F.col(text_col).cast("string")), run, schema)


def decode(rows: DataFrame, model_file: str = MODEL, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """rows with text_col decoded from ids_col, in place of an input column of that name; null ids decode to null."""
    with open(model_file, "rb") as f:
        raw = rows.sparkSession.sparkContext.broadcast(f.read())
    rows = rows.select(*quoted(rest(rows, text_col)))
    schema = extended(rows.schema, f"`{text_col}` string")
    k = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(Model.parse(raw.value))
        for b in batches:
            lists = b.column(k).to_pylist()
            offsets = np.concatenate([[0], np.cumsum([len(x or ()) for x in lists])]).astype(np.int64)
            texts = codec.decode(offsets, np.array([i for x in lists for i in x or ()], np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([t if x is not None else None for t, x in zip(texts, lists, strict=True)], pa.string())], schema.names)

    return map_arrow(rows, run, schema)
