"""Token ids of whole texts by the tokenizers library, with each distinct piece encoded once.

Both word and byte BPE end every token at a space that stands between two other characters,
so a text is cut there and its pieces are encoded on their own; where other white space may
stand beside a space there is no cut. Pieces are byte ranges, known by their 64-bit hash in
a table of open addresses, so a piece that was met before costs no Python object. The ids
also end between a letter or digit and punctuation other than an apostrophe: a new piece is
looked up as a word and the punctuation after it, and only new words reach the library;
plain ones many at a time as one text, whose ids fall apart into words by the marks that
tokens of words carry. A worker keeps the ids of up to ``PIECES`` pieces and ``WORDS``
words; when there are more, those met once go.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa

from gullwatch.llm.common import range_hashes, utf8

PIECES, WORDS = 1_000_000, 300_000
#: Words that are encoded as one text.
TOGETHER = 200

_WHITE = np.array([b == 0x20 or 0x09 <= b <= 0x0D or 0x1C <= b <= 0x1F for b in range(256)])
#: First bytes of the characters beyond ASCII that hold white space, of two bytes and of three.
_TWO, _THREE = np.isin(np.arange(256), (0xC2,)), np.isin(np.arange(256), (0xE1, 0xE2, 0xE3))
#: ASCII punctuation that may be cut off behind a word.
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_TABLE_BITS = 22
_encoders: dict[str, Encoder] = {}


def cut_pieces(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Start of every piece; a piece ends where the next one or another text starts."""
    starts = at[:-1][np.diff(at) > 0]
    i = np.flatnonzero(data[1:-1] == 0x20) + 1 if len(data) > 2 else np.zeros(0, np.int64)
    before, after = data[i - 1], data[i + 1]
    plain = ~(_WHITE[before] | _WHITE[after] | _TWO[after] | _THREE[after] | _TWO[data[i - 2]] | _THREE[data[i - 3]])
    inside = np.ones(len(data) + 1, bool)
    inside[at] = False
    inside[np.minimum(at + 1, len(data))] = inside[np.minimum(at + 2, len(data))] = False  # too near the start to look back
    i = i[plain & inside[i] & inside[i + 1]]
    return np.sort(np.concatenate([starts, i]))


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens, self.closes = (np.zeros(max(names.values()) + 1, bool) for _ in range(2))
        for name, i in names.items():
            self.opens[i], self.closes[i] = name[0] == "Ġ", name.endswith("</w>")
        self.words: dict[str, bytes] = {"": b""}
        self.again: set[str] = set()
        self._reset(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint32))

    def _reset(self, hashes: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> None:
        self.bits = _TABLE_BITS
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.hashes, self.sizes, self.flat = hashes, sizes, flat
        self.begin, self.uses = np.cumsum(sizes) - sizes, np.zeros(len(sizes), np.int64)
        self._place(np.arange(len(hashes)))

    def _place(self, codes: np.ndarray) -> None:
        if 2 * len(self.hashes) > len(self.slots):  # one very long text
            self.bits = int(4 * len(self.hashes)).bit_length()
            self.slots, codes = np.full(1 << self.bits, -1, np.int32), np.arange(len(self.hashes))
        at = (self.hashes[codes] >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(codes):
            free = self.slots[at] < 0
            self.slots[at[free]] = codes[free]
            lost = self.slots[at] != codes
            codes, at = codes[lost], (at[lost] + 1) & (len(self.slots) - 1)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Code of each hash, or -1."""
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.slots[at]
        if not len(self.hashes):
            return out
        rest = np.flatnonzero((out >= 0) & (self.hashes[out] != hashes))
        at = at[rest]
        while len(rest):
            at = (at + 1) & (len(self.slots) - 1)
            out[rest] = self.slots[at]
            going = (out[rest] >= 0) & (self.hashes[out[rest]] != hashes[rest])
            rest, at = rest[going], at[going]
        return out

    @staticmethod
    def _split(piece: str) -> tuple[str, str]:
        word = piece.rstrip(_TAIL)
        return (word, piece[len(word) :]) if word and word[-1].isalnum() and "<|" not in piece else (piece, "")

    def _encode(self, unknown: set[str]) -> None:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        plain = [x for x in unknown if x[0] == " " and x[1:].isalpha()]
        other = [x for x in unknown if not (x[0] == " " and x[1:].isalpha())]
        groups = [plain[k : k + TOGETHER] for k in range(0, len(plain), TOGETHER)]
        for group, e in zip(groups, encode(["".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            starts, ends = np.flatnonzero(self.opens[ids]), np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(group):
                starts = np.concatenate([[0], ends[:-1]])
            elif len(starts) == len(group) and starts[0] == 0:
                ends = np.append(starts[1:], len(ids))
            else:
                other += group
                continue
            raw = ids.tobytes()
            self.words.update((w, raw[4 * a : 4 * b]) for w, a, b in zip(group, starts.tolist(), ends.tolist()))
        self.words.update((w, array("I", e.ids).tobytes()) for w, e in zip(other, encode(other, add_special_tokens=False)))

    def _learn(self, hashes: np.ndarray, new: list[str]) -> None:
        if len(self.words) > WORDS:
            self.words = {w: self.words[w] for w in self.again} if len(self.again) <= WORDS // 2 else {}
            self.words[""], self.again = b"", set()
        halves = [self._split(x) for x in new]
        wanted = {x for half in halves for x in half}
        known = wanted & self.words.keys()
        self.again |= known
        self._encode(wanted - known)
        ids = [self.words[a] + self.words[b] for a, b in halves]
        sizes = np.array([len(x) for x in ids], np.int64) // 4
        codes = np.arange(len(self.hashes), len(self.hashes) + len(new))
        self.begin = np.concatenate([self.begin, len(self.flat) + np.cumsum(sizes) - sizes])
        self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), np.uint32)])
        self.hashes, self.sizes = np.concatenate([self.hashes, hashes]), np.concatenate([self.sizes, sizes])
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])
        self._place(codes)

    def _ids(self, codes: np.ndarray) -> np.ndarray:
        sizes = self.sizes[codes]
        after = np.cumsum(sizes)
        return self.flat[np.repeat(self.begin[codes] - (after - sizes), sizes) + np.arange(after[-1] if len(after) else 0)]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and for each text the number of ids before it (one more entry)."""
        data, at = utf8(texts)
        starts = cut_pieces(data, at)
        ends = np.append(starts[1:], len(data))
        hashes = range_hashes(data, starts, ends)
        codes = self._find(hashes)
        if (codes < 0).any():
            new, first = np.unique(hashes[codes < 0], return_index=True)
            where = np.flatnonzero(codes < 0)[first]
            raw = data.tobytes()
            self._learn(new, [raw[a:b].decode() for a, b in zip(starts[where].tolist(), ends[where].tolist())])
            codes = self._find(hashes)
        self.uses += np.bincount(codes, minlength=len(self.uses))
        before = np.concatenate([[0], np.cumsum(self.sizes[codes])])
        ids = self._ids(codes)
        if len(self.hashes) > PIECES:
            keep = np.flatnonzero(self.uses > 1)[: PIECES // 2]
            self._reset(self.hashes[keep], self.sizes[keep], self._ids(keep))
        return ids, before[np.searchsorted(starts, at)]


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded(batch: pa.RecordBatch, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a slice, each followed by ``end_id``, and the bounds of the texts."""
    ids, bounds = encoder(path)(batch.column(batch.schema.get_field_index("text")))
    n = len(bounds) - 1
    return np.insert(ids, bounds[1:], np.uint32(end_id)), bounds + np.arange(n + 1)
