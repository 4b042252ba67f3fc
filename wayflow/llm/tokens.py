"""Token ids of whole texts at the speed of distinct words.

Both vocabularies split a text into words before they merge, and no word ends in white space, so a text's ids are those
of its chunks (white space followed by other characters) in order.  Each task encodes a distinct chunk once with the
tokenizers library and gathers the ids.  Texts with white space beyond ASCII, or with the text of an added token (which the library
finds wherever it stands), are encoded whole.
"""

from __future__ import annotations

import os
import re
from itertools import repeat

import numpy as np
import pyarrow as pa

from .common import buffers

#: White space of Unicode beyond ASCII, also as controls: with these a chunk's ends may not be a word's.
ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
_ODD_BYTES = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe1\xa0\x8e", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80", b"\xef\xbb\xbf", b"\x1c", b"\x1d", b"\x1e", b"\x1f")
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[9, 10, 11, 12, 13]] = 32
_PLAIN[65:91] += 32
JOINED = 2048


class ChunkEncoder:
    """Encodes texts with one vocabulary; keeps the ids of at most ``most`` distinct chunks between calls.

    A chunk is white space and what follows, or what follows an ASCII letter and starts with another ASCII character:
    there too a word of either vocabulary ends.  ``plain`` is for a vocabulary that drops white space and case, and composes characters (NFC): its
    chunks are lower-cased ahead, but not a letter before a mark that it may compose with.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = self.tokenizer.normalizer is not None
        self.most = most
        self.added = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        names = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(names.values()) + 1, np.int64)
        for name, k in names.items():  # a byte-level vocabulary writes one character a byte
            self.bytes_of[k] = len(name.removesuffix("</w>") if self.plain else name)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.off = np.zeros(1, np.int64)

    def _whole(self, texts: list[str], chunks: bool = False) -> list[list[int]]:
        self.tokenizer.encode_special_tokens = chunks  # chunks of texts without an added token needn't be searched for one
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and their number for chunks that start with white space, encoded as one text; None if bytes don't tell them apart."""
        self.tokenizer.encode_special_tokens = True
        ids = np.array(self.tokenizer.encode_batch_fast([b"".join(chunks).decode()], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.cumsum([len(x) - (self.plain and len(x) - len(x.lstrip())) for x in chunks])
        total = np.cumsum(self.bytes_of[ids])
        if not len(ids) or total[-1] != ends[-1]:
            return None
        at = np.searchsorted(total, ends)
        return (ids, np.diff(at + 1, prepend=0)) if (total[at] == ends).all() else None

    def _learn(self, chunks: list[bytes]) -> None:
        if not chunks:
            return
        # Bytes tell where a chunk's ids end only if the vocabulary writes the chunk's own bytes: one that composes and lowers case does so for ASCII.
        spaced = [x for x in chunks if x[0] in b" \t\n\x0b\x0c\r" and x[-1] not in b" \t\n\x0b\x0c\r" and (not self.plain or x.isascii())]
        some = set(spaced)
        rest = [x for x in chunks if x not in some]
        ids, sizes = [], []
        for k in range(0, len(spaced), JOINED):
            got = self._joined(spaced[k : k + JOINED])
            if got is None:
                each = self._whole([x.decode() for x in spaced[k : k + JOINED]], True)
                got = np.array([i for x in each for i in x], np.uint32), np.array([len(x) for x in each], np.int64)
            ids.append(got[0])
            sizes.append(got[1])
        each = self._whole([x.decode() for x in rest], True)
        ids.append(np.array([i for x in each for i in x], np.uint32))
        sizes.append(np.array([len(x) for x in each], np.int64))
        for x in (*spaced, *rest):
            self.known[x] = len(self.known)
        self.off = np.concatenate([self.off, self.off[-1] + np.cumsum(np.concatenate(sizes))])
        self.ids = np.concatenate([self.ids, *ids])

    def encode(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (uint32) and n + 1 offsets."""
        data, off = buffers(text)
        n = len(off) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        white, letter = _WHITE[data], _LETTER[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = (white[1:] & ~white[:-1]) | (letter[:-1] & ~letter[1:] & ~white[1:] & (data[1:] < 128))
        cut[off] = True
        at = np.flatnonzero(cut)
        raw = data.tobytes()
        odd: dict[int, list[int]] = {}
        low = raw.lower()
        if any(x[:1] in raw and x in raw for x in _ODD_BYTES) or any(x.encode().lower() in low for x in self.added):
            texts = text.to_pylist()
            where = [i for i in range(n) if texts[i] and (ODD.search(texts[i]) or any(x in texts[i].lower() for x in self.added))]
            odd = dict(zip(where, self._whole([texts[i] for i in where]), strict=True))
        if self.plain:
            alone = np.append(data[1:] < 128, True)
            raw = np.where(alone, _PLAIN[data], data)
        chunks = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw)]).dictionary_encode()
        words, code = chunks.dictionary.to_numpy(zero_copy_only=False).tolist(), chunks.indices.to_numpy(zero_copy_only=False)
        place = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(place < 0)
        if len(self.known) + len(new) > self.most:
            self._clear()
            new = np.arange(len(words))
        fresh = [words[i] for i in new.tolist()]
        self._learn(fresh)
        place[new] = np.fromiter(map(self.known.__getitem__, fresh), np.int64, len(fresh))
        index = place[code]
        size = (self.off[1:] - self.off[:-1])[index]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(self.off[index] - total[:-1], size) + np.arange(total[-1])]
        out_off = total[np.searchsorted(at, off)]
        if odd:
            parts = [np.array(odd[i], np.uint32) if i in odd else ids[out_off[i] : out_off[i + 1]] for i in range(n)]
            return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, out_off


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder a worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def with_end(ids: np.ndarray, off: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same sequences with the id ``end`` after each."""
    n = len(off) - 1
    out = np.full(len(ids) + n, end, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(off))] = ids
    return out, off + np.arange(n + 1)
