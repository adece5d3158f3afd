"""Exact encoding of whole texts with the tokenizers library, each pre-token once.

A BPE tokenizer merges only inside a pre-token.  Texts of ASCII and Latin-1
letters are cut into pre-tokens by array operations on their bytes, equal
pre-tokens of a batch are found by hash, and only those that a bounded cache of
the Python worker does not hold go to the library.  Every other text, and every
text with an added token such as ``<|endoftext|>``, goes to the library as a
whole, so the ids are always those of the library by default.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from tokenizers import Tokenizer

from netloom.llm.spans import hash_spans

#: Pre-tokens in each of the cache's two generations.
CACHE_UNITS = 300_000
#: Units in one text for the library.
JOINED = 500
#: Bytes of text that are cut at a time.
SLICE_BYTES = 2 << 20
_END, _BLANK, _WHITE, _LETTER, _DIGIT, _MARK, _OTHER = range(7)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[0x21:0x7F] = _MARK
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3, *range(0x80, 0xC0)]] = _LETTER
_CLASS[[0x09, 0x0A, 0x0D]] = _WHITE
_CLASS[0x20] = _BLANK
_CLASS[0x00] = _END
#: Bytes of the texts that are cut here; the two signs among the Latin-1 letters are left out.
_PLAIN = bytes([0x09, 0x0A, 0x0D, *range(0x20, 0x7F), *range(0x80, 0xC0), 0xC3])


def _plain(raw: bytes) -> bool:
    if raw.translate(None, _PLAIN) or b"\xc3\x97" in raw or b"\xc3\xb7" in raw:
        return False
    return raw.isascii() or raw.count(b"\xc3") == len(raw) - len(raw.decode())


class PieceEncoder:
    """Turns texts into little-endian unsigned 32-bit ids, as bytes."""

    def __init__(self, path: str, cache_units: int = CACHE_UNITS):
        self.tokenizer = Tokenizer.from_file(path)
        self.lower = self.tokenizer.normalizer is not None
        added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = [t.lower() for t in added] if self.lower else added
        self.border = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.border[i] = token.endswith("</w>") if self.lower else token.startswith("\u0120")
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.cache_units = cache_units

    def _has_added(self, raw: bytes) -> bool:
        """Whether a text or, where the library lowers texts, its lower case has an added token."""
        raw = raw.lower() if self.lower else raw
        return any(t in raw for t in self.added)

    def _starts(self, data: bytes) -> np.ndarray:
        """Where a pre-token begins, for texts that end in a zero byte each."""
        kind = _CLASS[np.frombuffer(data, np.uint8)]
        before = np.concatenate(([np.uint8(_END)], kind[:-1]))
        white, was_white = (kind == _BLANK) | (kind == _WHITE), (before == _BLANK) | (before == _WHITE)
        start = (kind != before) & ~(white & was_white)
        if self.lower:
            start |= kind == _DIGIT
        else:
            held = np.concatenate((~white[1:] & (kind[1:] != _END), [False]))
            start |= white & was_white & held
            start &= ~((before == _BLANK) & ~white & (kind != _END))
        if b"'" in data:
            chunk = np.cumsum(was_white & ~white | (kind == _END), dtype=np.int32)
            torn = np.zeros(chunk[-1] + 1, bool)
            torn[chunk[np.frombuffer(data, np.uint8) == 0x27]] = True
            inner = ~white & ~was_white & (kind != _END) & (before != _END)
            start &= ~(torn[chunk] & inner)
        # Slices are far below 2 ** 31 bytes, single texts are too: half the memory of 64-bit places.
        return np.flatnonzero(start).astype(np.int32)

    def _learn(self, units: list[bytes]) -> None:
        """Let the library encode what the old generation does not hold.

        Units whose borders show in their tokens go to it many at a time: the
        word vocabulary marks a word's last token, the byte vocabulary a blank
        before a word.  Units with an apostrophe may be cut once more by the
        library's pattern and go one by one, like all the rest.
        """
        joined, single = [], []
        for u in units:
            if u in self.old:
                self.young[u] = self.old[u]
            elif b"'" in u or not (self.lower or u[0] == 0x20 and len(u) > 1 and u[1] > 0x20):
                single.append(u)
            else:
                joined.append(u)
        for u, found in zip(single, self.tokenizer.encode_batch_fast([u.decode() for u in single], add_special_tokens=False)):
            self.young[u] = np.array(found.ids, "<u4").tobytes()
        glue = b" " if self.lower else b""
        blocks = [joined[i : i + JOINED] for i in range(0, len(joined), JOINED)]
        texts = [glue.join(b).decode() for b in blocks]
        for block, found in zip(blocks, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(found.ids, "<u4")
            cuts = np.flatnonzero(self.border[ids])
            edges = np.concatenate(([0], cuts + 1)) if self.lower else np.append(cuts, len(ids))
            if len(edges) != len(block) + 1:
                raise ValueError("token borders do not match the units")
            raw, edges = ids.tobytes(), (edges * 4).tolist()
            self.young.update(zip(block, [raw[a:b] for a, b in zip(edges, edges[1:])]))

    def _encode_plain(self, texts: list[bytes]) -> list[bytes]:
        data = b"\0".join(texts) + b"\0"
        if self.lower:
            data = data.lower()
            if not data.isascii():
                raw = np.frombuffer(data, np.uint8).copy()
                after = np.concatenate(([False], raw[:-1] == 0xC3))
                raw[after & (raw >= 0x80) & (raw < 0x9F)] += 0x20
                data = raw.tobytes()
        starts = self._starts(data)
        ends = np.append(starts[1:], np.int32(len(data)))
        kind = _CLASS[np.frombuffer(data, np.uint8)[starts]]
        keep = kind != _END
        if self.lower:
            keep &= (kind != _BLANK) & (kind != _WHITE)
        stops = np.flatnonzero(np.frombuffer(data, np.uint8) == 0)
        starts, ends = starts[keep], ends[keep]
        codes, _ = pd.factorize(hash_spans(data + b"\0" * 8, starts, ends))
        first = np.zeros(codes.max(initial=-1) + 1, np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        units = [data[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        found = list(map(self.young.get, units))
        if None in found:
            self._learn([u for u, f in zip(units, found) if f is None])
            found = [self.young[u] for u in units]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        origin = np.cumsum(size) - size
        lengths = size[codes]
        until = np.cumsum(lengths)
        shift = np.repeat((origin[codes] - (until - lengths)).astype(np.int32), lengths)
        shift += np.arange(len(shift), dtype=np.int32)
        ids = flat[shift]
        del shift
        edge = np.concatenate(([0], until))[np.searchsorted(starts, stops)].tolist()
        if len(self.young) > self.cache_units:
            self.young, self.old = {}, {u: f for u, f in self.young.items() if len(u) <= 48}
        return [ids[a:b].tobytes() for a, b in zip([0, *edge], edge)]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; null counts as empty."""
        out: list[bytes] = [b""] * len(texts)
        batch, where, size = [], [], 0

        def flush():
            for i, ids in zip(where, self._encode_plain(batch)):
                out[i] = ids
            batch.clear(), where.clear()

        for i, text in enumerate(texts):
            if not text:
                continue
            raw = text.encode("utf-8", "surrogatepass")
            if _plain(raw) and not self._has_added(raw):
                batch.append(raw), where.append(i)
                size += len(raw)
                if size >= SLICE_BYTES:
                    flush()
                    size = 0
            else:
                out[i] = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()
        if batch:
            flush()
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> PieceEncoder:
    """The Python worker's own encoder for a vocabulary file."""
    return PieceEncoder(path)
