"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The model file compiles to three transducers that are composed lazily with each input:

* normaliser (:class:`Normaliser`): longest character mappings, a mark put before the text, runs of spaces squeezed where the
  model asks for it. It is deterministic and of weight 0, so composing an input with it is reading the input through it;
* pieces (:class:`Pieces`): a trie whose final states give a piece's id and go back to the start. In a unigram model the arc
  weighs minus the piece's score. In a merge (BPE) model arcs weigh 0, but the weight of a piece after another is 0 only if
  merging leaves the two apart, and infinite otherwise: a sequence is what merging gives if and only if each adjacent pair
  stays apart, so a state holds the last piece and the only path of finite weight is the encoding;
* byte fallback: a character that no piece covers goes through the ids of its bytes.

States of the composition are (position in the input, last piece). They are made as the search for the shortest path in the
tropical semiring reaches them: always the state of least weight, the farthest of equals, goes on; infinite arcs end there.
User-defined pieces are cut out first, as the model demands. The input is cut where no piece can cross (before a run of marks,
around line ends), and paths of short segments are remembered.

Defined results: null and empty texts have no ids; a mark in the text reads as a space, as in the model; repeated rows are
encoded alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Segments up to this many characters are remembered, this many of them at most.
REMEMBERED_CHARS, REMEMBERED = 48, 400_000
_UNIGRAM, _MERGES = 1, 2
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message."""

    def varint(i):
        value = shift = 0
        while True:
            value |= (data[i] & 127) << shift
            shift, i = shift + 7, i + 1
            if data[i - 1] < 128:
                return value, i

    i = 0
    while i < len(data):
        key, i = varint(i)
        kind = key & 7
        if kind == 0:
            value, i = varint(i)
        else:
            n, i = varint(i) if kind == 2 else ({1: 8, 5: 4}[kind], i)
            value, i = data[i : i + n], i + n
        yield key >> 3, value


class CharacterMap:
    """Mappings of a precompiled character map: a double-array trie over bytes and the texts that its leaves point to."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if size else ()
        self.texts = blob[4 + size :]

    @staticmethod
    def _base(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes read, what they become) of the longest mapping at a place, or None."""
        found, units = None, self.units
        node = self._base(units[0])
        for end in range(at, len(data)):
            node ^= data[end]
            if node >= len(units) or units[node] & 0x800000FF != data[end]:
                break
            unit = units[node]
            node ^= self._base(unit)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                found = end + 1 - at, self.texts[start : self.texts.index(0, start)]
        return found


class Normaliser:
    """Reads a text into what the pieces are matched with. Its states: at the start, after a space, in a word."""

    def __init__(self, blob: bytes, prefix: bool, squeeze: bool, kept: re.Pattern | None):
        self.map = CharacterMap(blob) if len(blob) > 4 else None
        self.prefix, self.squeeze, self.kept = prefix, squeeze, kept

    def _mapped(self, text: str) -> str:
        data, at, out = text.encode("utf-8", "surrogatepass"), 0, []
        while at < len(data):
            found = self.map.longest(data, at)
            if found:
                n, said = found
            else:
                n = 1 if data[at] < 128 else 2 if data[at] < 224 else 3 if data[at] < 240 else 4
                said = data[at : at + n]
            out.append(said)
            at += n
        return b"".join(out).decode("utf-8", "surrogatepass")

    def read(self, text: str) -> str:
        """The normalised text with spaces as marks' stand-ins; empty if nothing is left."""
        if self.map:
            parts = re.split(self.kept, text) if self.kept else [text]  # user-defined pieces stand at odd places, as they are
            text = "".join(p if i % 2 else self._mapped(p) for i, p in enumerate(parts))
        text = text.replace(MARK, " ")
        if self.squeeze:
            text = re.sub(" {2,}", " ", text.strip(" "))
        return " " + text if text and self.prefix else text


class Pieces:
    """The trie of pieces with their ids and weights, and the weight of a piece after another."""

    _KEY = 0x110000

    def __init__(self, merges: bool):
        self.merges = merges
        self.ids: dict[str, int] = {}
        self.weight: dict[str, float] = {}
        self.child: dict[int, int] = {}
        self.final: list[str | None] = [None]
        self._apart: dict[tuple[str, str], bool] = {}

    def add(self, piece: str, number: int, weight: float) -> None:
        self.ids[piece], self.weight[piece] = number, weight
        state = 0
        for c in piece:
            state = self.child.setdefault(state * self._KEY + ord(c), len(self.final))
            if state == len(self.final):
                self.final.append(None)
        self.final[state] = piece

    def arcs(self, text: str, at: int) -> list[str]:
        """The pieces that can be read at a position, the shortest first, and before them a character without a piece."""
        out: list[str] = []
        state, child, final, key = 0, self.child, self.final, self._KEY
        if text[at] not in self.ids:
            out.append(text[at])
        for end in range(at, len(text)):
            state = child.get(state * key + ord(text[end]))
            if state is None:
                break
            if final[state] is not None:
                out.append(final[state])
        return out

    def finite(self, a: str, b: str) -> bool:
        """Whether b after a has a finite weight. With a empty: whether b is reached at all."""
        known = self._apart.get((a, b))
        if known is None:
            if len(self._apart) > 2 * REMEMBERED:
                self._apart.clear()
            known = self._apart[a, b] = self._merged(a + b) == ([a, b] if a else [b])
        return known

    def _merged(self, text: str) -> list[str]:
        """Merging from characters: of adjacent parts that form a piece, the one of least weight, the leftmost of ties."""
        parts, none, weight = list(text), float("inf"), self.weight.get
        costs = [weight(x + y, none) for x, y in zip(parts, parts[1:], strict=False)]
        while costs and (least := min(costs)) != none:
            i = costs.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i:
                costs[i - 1] = weight(parts[i - 1] + parts[i], none)
            if i < len(costs):
                costs[i] = weight(parts[i] + parts[i + 1], none)
        return parts


class PieceTransducer:
    """The compiled model. Marks are spaces inside: the two stand for each other."""

    def __init__(self, model: bytes):
        self.byte_ids = [-1] * 256
        self.printed: list[bytes] = []
        self.unknown, kind, prefix, squeeze, blob = 0, _UNIGRAM, True, True, b""
        found: list[tuple[str, int, float]] = []
        user: dict[str, int] = {}
        for number, value in _fields(model):
            if number == 1:
                piece, score, sort = "", 0.0, _NORMAL
                for f, v in _fields(value):
                    if f == 1:
                        piece = v.decode()
                    elif f == 2:
                        score = struct.unpack("<f", v)[0]
                    elif f == 3:
                        sort = v
                here, plain = len(self.printed), piece.replace(MARK, " ")
                self.printed.append(plain.encode())
                if sort == _BYTE:
                    self.byte_ids[int(piece[3:5], 16)] = here
                    self.printed[here] = bytes([int(piece[3:5], 16)])
                elif sort == _NORMAL:
                    found.append((plain, here, -score))
                elif sort == _USER:
                    user[plain] = here
                elif sort == _UNKNOWN:
                    self.unknown = here
                    self.printed[here] = " ⁇ ".encode()
                elif sort == _CONTROL:
                    self.printed[here] = b""
            elif number == 2:
                kind = next((v for f, v in _fields(value) if f == 3), _UNIGRAM)
            elif number == 3:
                spec = dict(_fields(value))
                prefix, squeeze, blob = bool(spec.get(3, 1)), bool(spec.get(4, 1)), spec.get(2, b"")
                if not spec.get(5, 1):
                    raise ValueError("models that don't mark white space aren't supported")
        if kind not in (_UNIGRAM, _MERGES):
            raise ValueError(f"model type {kind} isn't supported")
        if min(self.byte_ids) < 0:
            self.byte_ids = []
        self.pieces = Pieces(kind == _MERGES)
        for entry in found:
            self.pieces.add(*entry)
        self.prefix, self.user = prefix, user
        self.user_pattern = re.compile("(" + "|".join(map(re.escape, sorted(user, key=len, reverse=True))) + ")") if user else None
        self.normaliser = Normaliser(blob, prefix, squeeze, self.user_pattern)
        self.unknown_weight = max(self.pieces.weight.values(), default=0.0) + 10
        # Where no piece can cross: before a run of marks, and around line ends.
        whole = [*self.pieces.ids, *user]
        known = lambda c: bool(self.byte_ids) or c in self.pieces.ids  # noqa: E731  a run of unknown characters is one piece
        self.cut_marks = known(" ") and not any(re.search("[^ ] ", p) for p in whole)
        self.cut_lines = self.cut_marks and known("\n") and not any("\n" in p for p in whole)
        self.line_end = self._packed(self._fallback("\n"))

    def __reduce__(self):
        raise TypeError("a compiled model isn't shipped; compile it in the task")

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}i", *ids)

    def _fallback(self, char: str) -> list[int]:
        if char in self.pieces.ids:
            return [self.pieces.ids[char]]
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown]

    def shortest_path(self, segment: str) -> list[int]:
        """Ids of the path of least weight through the composition of ``segment`` with the model."""
        ids: list[int] = []
        for i, part in enumerate(self.user_pattern.split(segment) if self.user_pattern else [segment]):
            for arc in [part] if i % 2 else self.tropical_path(part):
                if i % 2:
                    ids.append(self.user[arc])
                elif arc in self.pieces.ids:
                    ids.append(self.pieces.ids[arc])
                elif self.byte_ids or not ids or ids[-1] != self.unknown:  # a run of unknown characters is one piece
                    ids += self._fallback(arc)
        return ids

    def tropical_path(self, text: str) -> list[str]:
        """What the arcs of the lightest path read. Weights after the last piece are looked at when a state's turn comes."""
        pieces, merges, unknown = self.pieces, self.pieces.merges, self.unknown_weight
        weight = {} if merges else pieces.weight
        # (weight, minus the position, tie, what the arc read, the state before); a state is (position, last piece).
        heap: list[tuple] = [(0.0, 0, 0, "", None)]
        settled: dict[tuple, tuple | None] = {}
        tie = 0
        while heap:
            total, at, _, arc, before = heapq.heappop(heap)
            at = -at
            state = (at, arc if merges else "")
            if state in settled or (merges and before is not None and not pieces.finite(before[1], arc)):
                continue
            settled[state] = (before, arc)
            if at == len(text):
                path = []
                while before is not None:
                    path.append(arc)
                    before, arc = settled[before]
                return path[::-1]
            for reads in pieces.arcs(text, at):
                tie += 1
                heapq.heappush(heap, (total + (0.0 if merges else weight.get(reads, unknown)), -at - len(reads), tie, reads, state))
        raise ValueError("no path of finite weight")


class _Remembered(dict):
    """Packed ids of segments by their text after ``lead``."""

    def __init__(self, model: PieceTransducer, lead: str):
        super().__init__()
        self.model, self.lead = model, lead
        self.older: dict[str, bytes] = {}  # what was remembered before; what is used again comes back

    def __missing__(self, text: str) -> bytes:
        packed = self.older.get(text)
        if packed is None:
            packed = self.model._packed(self.model.shortest_path(self.lead + text))
        if len(text) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.older = self.copy()
                self.clear()
            self[text] = packed
        return packed


class Codec:
    """Encodes and decodes whole texts."""

    def __init__(self, model: bytes):
        self.model = PieceTransducer(model)
        self.after_space, self.bare = _Remembered(self.model, " "), _Remembered(self.model, "")

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        model = self.model
        text = model.normaliser.read(text)
        if not text:
            return b""
        if not model.cut_marks:
            return self.bare[text]
        out: list[bytes] = []
        for k, line in enumerate(text.split("\n") if model.cut_lines else [text]):
            if k:
                out.append(model.line_end)
            if k == 0 and model.prefix:
                line = line[1:]
                marked = True
            else:
                marked = False
            if "  " in line or line[:1] == " " or line[-1:] == " ":
                out += [self.bare[s] for s in re.findall(" *[^ ]+| +", " " + line if marked else line)]
                continue
            words = line.split(" ")
            if not marked:
                out.append(self.bare[words[0]] if words[0] else b"")
                del words[0]
            out += map(self.after_space.__getitem__, words)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        data = b"".join(map(self.model.printed.__getitem__, ids.tolist()))
        return (data.removeprefix(b" ") if self.model.prefix else data).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def _codec(path: str, model: bytes) -> Codec:
    """One codec a worker: what it remembers serves later tasks too."""
    if path not in _CODECS:
        _CODECS[path] = Codec(model)
    return _CODECS[path]


def encode_documents(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id, ids, n_tokens of every text, and the decoded text's sha256 with whether it is the text again."""
    with open(model_file, "rb") as f:
        model = f.read()  # under a megabyte, shipped with the task
    name = hashlib.sha256(model).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name, model)
        for batch in batches:
            packed, digests, same = [], [], []
            for text in batch.column("text").to_pylist():
                ids = codec.encode(text or "")
                back = codec.decode(np.frombuffer(ids, dtype="<i4"))
                packed.append(ids)
                digests.append(hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
                same.append(back == (text or ""))
            n = np.array([len(p) // 4 for p in packed], dtype=np.int64)
            values = pa.array(np.frombuffer(b"".join(packed), dtype="<i4"))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), values)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(n), pa.array(digests), pa.array(same)], ["doc_id", "ids", "n_tokens", "decoded_sha256", "exact"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, decoded_sha256 string, exact boolean")
