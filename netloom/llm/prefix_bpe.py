"""Byte-level BPE by dynamic programming over prefixes, and its inverse.

The encoding of every prefix of a pre-token ends in exactly one token: among the
vocabulary's tokens that are suffixes of the prefix, the one that fits behind the
last token of what is left of it.  An automaton over the vocabulary yields those
suffixes, a walk down two merge trees tells whether merging would have kept the
border between two tokens, and going back from the whole pre-token emits the ids.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.encoding import SLICE_BYTES, PieceEncoder, _plain
from netloom.llm.spans import lean

#: Rank of a token that is a byte, which no merge makes.
BYTE = -1


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary.

    Printable characters of Latin-1 stand for themselves, the other bytes in order for the characters from 256 on.
    """
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(c): b for c, b in [*zip(own, own), *((256 + k, b) for k, b in enumerate(rest))]}


class PrefixTable:
    """Tokens, merges and suffix automaton of a byte-level vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if model.get("type", "BPE") != "BPE" or not plain or spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space"):
            raise ValueError(f"{path} is no plain byte-level BPE")
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path} has added tokens that take in what is around them")
        alphabet, vocab = byte_alphabet(), model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        count = max([*vocab.values(), *self.added.values()]) + 1
        #: Bytes of each token, by its id; how many; its merge's rank; its two halves.
        self.content = [b""] * count
        for token, i in vocab.items():
            self.content[i] = bytes(map(alphabet.__getitem__, token))
        for token, i in self.added.items():
            self.content[i] = token.encode()
        self.rank, self.halves, self.merge = [BYTE] * count, [(0, 0)] * count, {}
        made = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            # A token that two merges make is formed by the first of them, whatever the text.
            if self.rank[whole] == BYTE and len(self.content[whole]) > 1:
                self.rank[whole], self.halves[whole] = rank, (a, b)
                made.append(whole)
            self.merge.setdefault((a, b), rank)
        reached = {i for i in vocab.values() if len(self.content[i]) == 1}
        if len(reached) != 256:
            raise ValueError(f"{path} does not hold all bytes")
        self.automaton = ahocorasick.Automaton()
        for i in made:
            a, b = self.halves[i]
            # Only a token that its own bytes are merged into ever ends an encoding.
            if a in reached and b in reached and self.fits(a, b, self.rank[i]):
                reached.add(i)
        for i in reached:
            self.automaton.add_word(self.content[i].decode("latin-1"), (i, len(self.content[i])))
        self.automaton.make_automaton()

    def fits(self, left: int, right: int, limit: int = 1 << 62) -> bool:
        """Whether merges below ``limit`` keep the border between two tokens.

        Both trees are undone from the latest merge back.  The two tokens at the
        border at any time stay apart unless their own merge comes before that
        which makes one of them part of a larger token; of equal merges the
        one further left comes first.
        """
        rank, halves, merge = self.rank, self.halves, self.merge
        while True:
            own = merge.get((left, right))
            if own is not None and own < limit:
                return False
            a, b = rank[left], rank[right]
            if a > b:
                limit, left = a, halves[left][1]
            elif b != BYTE:
                limit, right = b + 1, halves[right][0]
            else:
                return True

    def encode(self, unit: bytes) -> list[int]:
        """Ids of one pre-token."""
        last = [-1] * (len(unit) + 1)
        for end, (token, size) in self.automaton.iter(unit.decode("latin-1")):
            if last[end + 1] < 0:
                begin = end + 1 - size
                if not begin or self.fits(last[begin], token):
                    last[end + 1] = token
        ids, at = [], len(unit)
        while at:
            ids.append(last[at])
            at -= len(self.content[last[at]])
        return ids[::-1]

    def decode(self, ids: list[int]) -> bytes:
        """Bytes that ids stand for; an id outside the vocabulary stands for none."""
        content, count = self.content, len(self.content)
        try:
            return b"".join([content[i] for i in ids])
        except IndexError:
            return b"".join([content[i] for i in ids if i < count])


class PrefixEncoder(PieceEncoder):
    """Cuts texts into pre-tokens as :class:`PieceEncoder` does and encodes each by its prefixes.

    Texts outside ASCII and Latin-1 are cut by the library's own pattern.
    """

    def __init__(self, path: str):
        super().__init__(path)
        self.table = PrefixTable(path)
        self.letters = {ord(c): b for c, b in byte_alphabet().items()}

    def _learn(self, units: list[bytes]) -> None:
        for u in units:
            if u in self.old:
                self.young[u] = self.old[u]
            elif b"'" in u and len(u) > 1:
                # What is joined by an apostrophe may be several pre-tokens, such as a word and 's.
                self.young[u] = b"".join(np.array(self.table.encode(x), "<u4").tobytes() for x in self._cut(u.decode()))
            else:
                self.young[u] = np.array(self.table.encode(u), "<u4").tobytes()

    def _cut(self, text: str) -> list[bytes]:
        """Pre-tokens of a text by the library's pattern."""
        return [letters.translate(self.letters).encode("latin-1") for letters, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def _unit(self, unit: bytes) -> bytes:
        """Ids of one pre-token."""
        if unit not in self.young:
            self.young[unit] = self.old.get(unit) or np.array(self.table.encode(unit), "<u4").tobytes()
        return self.young[unit]

    def _pieces(self, text: str) -> Iterator[bytes]:
        """Ids of what lies between added tokens, and those of the tokens; of two that begin together the longer counts."""
        at = 0
        while True:
            found = [(low, -len(t), t) for t in self.table.added if (low := text.find(t, at)) >= 0]
            low, _, token = min(found, default=(len(text), 0, ""))
            if low > at:
                yield from map(self._unit, self._cut(text[at:low]))
            if not token:
                return
            yield np.array([self.table.added[token]], "<u4").tobytes()
            at = low + len(token)

    def encode_bytes(self, texts: list[bytes | None]) -> list[bytes]:
        """Ids of each UTF-8 text as little-endian unsigned 32-bit integers; null counts as empty."""
        out, batch, where, size = [b""] * len(texts), [], [], 0
        for i, raw in enumerate(texts):
            if raw and _plain(raw) and not self._has_added(raw):
                batch.append(raw), where.append(i)
                size += len(raw)
            elif raw:
                out[i] = b"".join(self._pieces(raw.decode("utf-8", "replace")))
                if len(self.young) > self.cache_units:
                    self.young, self.old = {}, {u: f for u, f in self.young.items() if len(u) <= 48}
            if batch and (size >= SLICE_BYTES or i + 1 == len(texts)):
                for k, ids in zip(where, self._encode_plain(batch)):
                    out[k] = ids
                batch, where, size = [], [], 0
        return out


@lru_cache(maxsize=2)
def prefix_encoder(path: str) -> PrefixEncoder:
    """The Python worker's own encoder for a vocabulary file."""
    return PrefixEncoder(path)


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``SLICE_BYTES`` together; a longer text goes alone."""
    low = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > SLICE_BYTES:
            yield low, i
            low, total = i, 0
        total += n
    if low < len(sizes):
        yield low, len(sizes)


def encode_and_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exact ids of every whole text, as the library gives them without special tokens, and the text they decode to.

    Returns ``doc_id, ids array<int>, decoded string`` for every row; nothing is
    shuffled.  Null and empty texts have no ids and decode to an empty text,
    added tokens in a text count as such and are kept in decoding, bytes that
    are no UTF-8 become U+FFFD, repeated rows and ids each give a row, an empty
    table an empty one.  Time and memory for a pre-token grow with its length, so
    a text without any blank is no special case.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = prefix_encoder(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for low, high in _slices([len(t or b"") for t in texts]):
                found = worker.encode_bytes(texts[low:high])
                decoded = [worker.table.decode(np.frombuffer(f, "<u4").tolist()).decode("utf-8", "replace") for f in found]
                offsets = np.concatenate(([0], np.cumsum([len(f) // 4 for f in found]))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(found), "<i4")))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), ids, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"doc_id {kind}, ids array<int>, decoded string")
