"""Merge-type piece encoding by backtracking, and decoding, as a piece vocabulary's own library does them.

A row of tokens is what greedy merging makes of a text exactly if every two neighbours are what it makes of the two alone:
no merge ever crossed a border, so what stands on either side came about by itself. So no queue of merges is needed. From
the left, the longest piece that begins at a place (Aho-Corasick) is tried, then shorter ones; a piece must fit to the one
before it, which is found by merging the two anew, once for each pair of pieces. A place where nothing fits is marked in a
bitfield, so that it is never entered again, and the piece that led there gives way to a shorter one.

Characters without a piece become byte pieces; they take part in no merge. Between two characters that no piece holds next
to each other nothing is ever merged, so texts fall into parts there, and the encoding of short parts is kept.

Defined results: a null or empty text has the begin and the end id alone and decodes to an empty text; repeated rows are
encoded each; extra columns are ignored; an empty table gives an empty result; texts are encoded whole, whatever their length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import vocabulary_path

SPACE = "▁"
#: Parts up to this length are kept, and so many of them; likewise the pairs that were tried.
KEEP_LENGTH, KEEP = 32, 1 << 19
RESULT = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
_loaded: dict[str, Pieces] = {}


class _Kept(dict):
    """Results of a function by its argument; begun anew when there are KEEP of them."""

    def __init__(self, f, keeps=lambda key: True):
        super().__init__()
        self.f, self.keeps = f, keeps

    def __missing__(self, key):
        found = self.f(key)
        if self.keeps(key):
            if len(self) >= KEEP:
                self.clear()
            self[key] = found
        return found


class Pieces:
    """A piece model of merge type with an identity normaliser, a dummy prefix and byte fallback."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = " a  b\tcﬁ "
        if sentencepiece.SentencePieceNormalizer(model_file=path).normalize(probe) != self.marked(probe):
            raise ValueError("only models that leave texts as they are, but for a dummy prefix, are supported")
        n = model.get_piece_size()
        self.begin, self.end = model.bos_id(), model.eos_id()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.special = {i for i in range(n) if model.is_control(i)}
        self.byte = {int(self.pieces[i][1:-1], 16): i for i in range(n) if model.is_byte(i)}
        self.is_byte = np.array([model.is_byte(i) for i in range(n)])
        self.unknown = model.unk_id()
        self.ids = {self.pieces[i]: i for i in range(n) if not (i in self.special or self.is_byte[i] or i == self.unknown)}
        alone = {p for p in self.ids if len(p) == 1}
        if len(self.byte) != 256 or not set("".join(self.ids)) <= alone or any(model.is_unused(i) for i in self.ids.values()):
            raise ValueError("only models with byte fallback, a piece for each character and no unused pieces are supported")
        self.rank = {p: -model.get_score(i) for p, i in self.ids.items()}
        #: What each id stands for in a decoded text.
        self.shown = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for value, i in self.byte.items():
            self.shown[i] = bytes([value])
        for i in self.special:
            self.shown[i] = b""
        self.shown[self.unknown] = " ⁇ ".encode()
        self.search = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.search.add_word(p, i)
        self.search.make_automaton()
        self.length = [len(p) for p in self.pieces]
        #: The longest piece that a piece begins with, other than itself.
        self.shorter = [next((self.ids[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.ids), None) if p in self.ids else None for p in self.pieces]
        #: A number for each character of the pieces (0: others), and which stand next to each other in one.
        self.number = np.zeros(0x110000, np.uint16)
        self.number[[ord(c) for c in alone]] = np.arange(1, len(alone) + 1)
        self.width = len(alone) + 1
        self.joined = np.zeros(self.width**2, bool)
        for p in self.ids:
            at = self._numbers(p)
            self.joined[at[:-1] * self.width + at[1:]] = True
        self._fits = _Kept(self._unmerged)
        self._parts = _Kept(self._encode_part, lambda part: len(part) <= KEEP_LENGTH)

    @staticmethod
    def marked(text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def merged(self, text: str) -> list[str]:
        """Greedy merging of a short text: the best pair first, of equal ones the leftmost."""
        parts = list(text)
        while True:
            pairs = [(self.rank[p], k) for k in range(len(parts) - 1) if (p := parts[k] + parts[k + 1]) in self.rank]
            if not pairs:
                return parts
            k = min(pairs)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def _unmerged(self, pair: int) -> bool:
        """Whether merging makes this piece, or this one (lower 32 bits) after another (upper bits), of their text."""
        pieces = [self.pieces[pair & 0xFFFFFFFF]]
        if pair >> 32:
            pieces.insert(0, self.pieces[pair >> 32])
        return self.merged("".join(pieces)) == pieces

    def _numbers(self, text: str) -> np.ndarray:
        return self.number[np.frombuffer(text.encode("utf-32-le"), "<u4")].astype(np.int64)

    def parts(self, text: str) -> list[str]:
        """Parts of a marked text that are encoded each by itself."""
        at = self._numbers(text)
        cuts = [0, *(np.flatnonzero(~self.joined[at[:-1] * self.width + at[1:]]) + 1).tolist(), len(text)]
        return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _backtrack(self, part: str) -> list[int]:
        """Ids of a part, all of whose characters have a piece."""
        n, length, fits, search = len(part), self.length, self._fits, self.search
        shut = None  # the bitfield, once a place has failed
        found: list[int] = []
        longest = search.iter_long(part)
        at, i = 0, next(longest)[1]
        while True:
            before = found[-1] << 32 if found else 0
            tried = i
            while i is not None:
                end = at + length[i]
                if (shut is None or not shut[end >> 3] >> (end & 7) & 1) and fits[before | i]:
                    break
                i = self.shorter[i]
            if i is None:
                if shut is None:
                    shut = bytearray(n // 8 + 1)
                shut[at >> 3] |= 1 << (at & 7)
                i = found.pop()
                at -= length[i]
                longest = None
                continue
            found.append(i)
            at = end
            if at == n:
                return found
            if longest is None or i != tried:
                longest = search.iter_long(part, at)
            i = next(longest)[1]

    def _encode_part(self, part: str) -> bytes:
        if self.number[ord(part[0])]:
            return np.array(self._backtrack(part), "<u4").tobytes()
        return np.array([self.byte[b] for b in part.encode()], "<u4").tobytes()

    def packed(self, text: str) -> bytes:
        """Ids of a text, without begin and end, as little-endian 32-bit numbers."""
        return b"".join(map(self._parts.__getitem__, self.parts(self.marked(text)))) if text else b""

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.packed(text), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: special ones vanish, a space mark at the very front too, bytes that are no characters are replaced."""
        ids = ids.tolist()
        first = next((i for i in ids if i not in self.special), None)
        cut = first is not None and self.pieces[first].startswith(SPACE)
        try:
            if not self.special.isdisjoint(ids[1:-1]):  # special ones part the bytes of a character
                return self._repaired(ids)[cut:]
            return b"".join(map(self.shown.__getitem__, ids))[cut:].decode()
        except UnicodeDecodeError:
            return self._repaired(ids)[cut:]

    def _repaired(self, ids: list[int]) -> str:
        out, run = [], bytearray()
        for i in [*ids, None]:
            if i is not None and self.is_byte[i]:
                run += self.shown[i]
                continue
            at = 0
            while at < len(run):
                width = 1 + (run[at] >= 0xC0) + (run[at] >= 0xE0) + (run[at] >= 0xF0)
                try:
                    out.append(bytes(run[at : at + width]).decode())
                    at += width
                except UnicodeDecodeError:
                    out.append("�")
                    at += 1
            run.clear()
            if i is not None:
                out.append(self.shown[i].decode())
        return "".join(out)


def loaded(path: str) -> Pieces:
    """The model at a path; kept for the life of the worker."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded): the ids of each text between begin and end id, and what they decode to."""
    path = model or vocabulary_path("piece_bpe_32k.model")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                ids = [np.concatenate([[pieces.begin], pieces.encode(t.as_py() or ""), [pieces.end]]).astype(np.int32) for t in part.column(1)]
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array([pieces.decode(x) for x in ids])], names=["id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(of, "id long, ids array<int>, decoded string")


def digests(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): the same ids and texts by their hashes, made where they are, so that
    neither leaves the task."""
    path = model or vocabulary_path("piece_bpe_32k.model")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(path)
        first, last = np.array([pieces.begin], "<u4").tobytes(), np.array([pieces.end], "<u4").tobytes()
        for batch in batches:
            n, ids_hash, text_hash = [], [], []
            for text in batch.column(1):
                packed = first + pieces.packed(text.as_py() or "") + last
                n.append(len(packed) // 4)
                ids_hash.append(hashlib.sha256(packed).hexdigest())
                text_hash.append(hashlib.sha256(pieces.decode(np.frombuffer(packed, "<u4")).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(of, RESULT)
