"""Induced suffix sorting with common-prefix values, in bulk and beyond memory.

Suffixes move through one first-in-first-out queue for each character: popping
the queues in character order is popping a priority queue keyed by (character,
order of insertion), which is the order of induced sorting.  Queues move blocks
of tuples (position, common prefix with the tuple before) and spill to disk
when the tuples in memory exceed a limit.  The common prefix of two suffixes
that follow each other in a queue is one more than the least value between the
suffixes that induced them.  Values are capped, as callers ask for repeats of a
fixed length only.
"""

from __future__ import annotations

import tempfile

import numpy as np

from netloom.llm.spans import hash_spans

#: Bytes of tuples that the queues of one sort hold in memory; tuples scanned at a time.
MEMORY_BYTES, BLOCK = 96 << 20, 1 << 18


class Budget:
    """Memory that the queues of one sort share."""

    def __init__(self, limit: int = MEMORY_BYTES):
        self.limit, self.used = limit, 0


class BlockQueue:
    """First-in-first-out queue of (position, common prefix) blocks, on disk past the budget."""

    def __init__(self, budget: Budget):
        self.budget, self.blocks, self.file = budget, [], None

    def push(self, at: np.ndarray, common: np.ndarray) -> None:
        if not len(at):
            return
        size = at.nbytes + common.nbytes
        if self.budget.used + size > self.budget.limit:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            self.file.seek(0, 2)
            start = self.file.tell()
            self.file.write(at.tobytes() + common.tobytes())
            self.blocks.append((start, len(at), at.dtype))
        else:
            self.budget.used += size
            self.blocks.append((at.copy(), common.copy()))

    def _load(self, block) -> tuple[np.ndarray, np.ndarray]:
        if len(block) == 2:
            return block
        start, n, kind = block
        self.file.seek(start)
        raw = self.file.read(n * (kind.itemsize + 1))
        return np.frombuffer(raw, kind, n), np.frombuffer(raw, np.uint8, n, n * kind.itemsize)

    def _joined(self, blocks: list) -> tuple[np.ndarray, np.ndarray]:
        loaded = [self._load(b) for b in blocks]
        return loaded[0] if len(loaded) == 1 else (np.concatenate([x for x, _ in loaded]), np.concatenate([c for _, c in loaded]))

    def read(self):
        """Tuples in order, many blocks at a time, also those that are pushed meanwhile."""
        first = 0
        while first < len(self.blocks):
            end = size = 0
            for end in range(first, len(self.blocks)):
                size += len(self.blocks[end][0]) if len(self.blocks[end]) == 2 else self.blocks[end][1]
                if size >= BLOCK:
                    break
            yield self._joined(self.blocks[first : end + 1])
            first = end + 1

    def backward(self):
        """Tuples in ascending order inside a group of blocks, groups from the last to the first."""
        end = len(self.blocks)
        while end:
            first, size = end, 0
            while first and size < BLOCK:
                first -= 1
                size += len(self.blocks[first][0]) if len(self.blocks[first]) == 2 else self.blocks[first][1]
            yield self._joined(self.blocks[first:end])
            end = first

    def close(self) -> None:
        for block in self.blocks:
            if len(block) == 2:
                self.budget.used -= block[0].nbytes + block[1].nbytes
        self.blocks = []
        if self.file is not None:
            self.file.close()
            self.file = None


def _least_between(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least of values[low..high] for each pair, by a table of powers of two."""
    width = high - low + 1
    level = np.frexp(width.astype(np.float64))[1] - 1
    out = np.empty(len(low), np.uint8)
    table, k = values, 0
    top = int(level.max(initial=0))
    while True:
        mine = np.flatnonzero(level == k)
        if len(mine):
            out[mine] = np.minimum(table[low[mine]], table[high[mine] - (1 << k) + 1])
        if k == top:
            return out
        table = np.minimum(table[: len(table) - (1 << k)], table[1 << k :])
        k += 1


class InducedSorter:
    """Suffix order and capped common prefixes of a byte string.

    The string must end in a zero byte; zero bytes part it, and suffixes are
    told apart at least within the first ``cap`` bytes.
    """

    def __init__(self, text: np.ndarray, cap: int, memory: int = MEMORY_BYTES, block: int = BLOCK):
        self.text, self.cap, self.block = text, cap, block
        self.kind = np.int32 if len(text) < 1 << 31 else np.int64
        self.budget = Budget(memory)
        n = len(text)
        step = np.sign(text[1:].astype(np.int16) - text[:-1]).astype(np.int8)
        known = np.flatnonzero(step)
        self.small = np.zeros(n, bool)
        self.small[n - 1] = True
        if len(known):
            self.small[:-1] = np.repeat(step[known] > 0, np.diff(np.concatenate(([-1], known))))[: n - 1] if known[-1] == n - 2 else False
        self.starts = np.flatnonzero(self.small[1:] & ~self.small[:-1]) + 1
        self.padded = text.tobytes() + b"\0" * 16
        self.words = np.ndarray((n + 9,), ">u8", self.padded, 0, (1,))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Capped common prefix of suffix pairs, eight bytes at a time."""
        out = np.zeros(len(a), np.int64)
        open_pairs = np.arange(len(a))
        limit = len(self.words) - 1
        for at in range(0, self.cap, 8):
            differ = self.words[np.minimum(a[open_pairs] + at, limit)].astype(np.uint64) ^ self.words[np.minimum(b[open_pairs] + at, limit)].astype(np.uint64)
            equal = differ == 0
            high, low = (differ[~equal] >> np.uint64(32)).astype(np.float64), (differ[~equal] & np.uint64(0xFFFFFFFF)).astype(np.float64)
            lead = np.where(high > 0, 32 - np.frexp(high)[1], 64 - np.frexp(low)[1])
            out[open_pairs[~equal]] = at + lead // 8
            open_pairs = open_pairs[equal]
            out[open_pairs] = at + 8
            if not len(open_pairs):
                break
        return np.minimum(out, self.cap).astype(np.uint8)

    def _scan(self, at: np.ndarray, common: np.ndarray, smaller: bool, queues: list[BlockQueue], least: np.ndarray, seen: np.ndarray) -> None:
        """Induce from one scanned block into the queues."""
        for low in range(0, len(at), self.block):
            x, c = at[low : low + self.block], common[low : low + self.block]
            before = x - 1
            ok = np.flatnonzero((x > 0) & (self.small[before] == smaller))
            if not len(ok):
                np.minimum(least, c.min(), out=least)
                continue
            y = before[ok]
            target = self.text[y]
            order = np.argsort(target, kind="stable")
            sorted_target, index = target[order], ok[order]
            first = np.concatenate(([True], sorted_target[1:] != sorted_target[:-1]))
            previous = np.where(first, 0, np.concatenate(([0], index[:-1] + 1)))
            value = _least_between(c, previous, index)
            heads = np.flatnonzero(first)
            t = sorted_target[heads]
            value[heads] = np.minimum(value[heads], least[t])
            value = np.minimum(value.astype(np.int64) + 1, self.cap).astype(np.uint8)
            value[heads[~seen[t]]] = 0
            seen[t] = True
            tails = np.append(heads[1:], len(order)) - 1
            least_all = c.min()
            np.minimum(least, least_all, out=least)
            rest = index[tails] + 1
            inside = rest < len(c)
            least[t] = 255
            if inside.any():
                least[t[inside]] = _least_between(c, rest[inside], np.full(int(inside.sum()), len(c) - 1))
            y = y[order].astype(self.kind)
            for d, a, b in zip(t.tolist(), heads.tolist(), (tails + 1).tolist()):
                queues[d].push(y[a:b], value[a:b])

    def _induce(self, stars: list[tuple[np.ndarray, np.ndarray]], exact: bool) -> tuple[list[BlockQueue], list[BlockQueue]]:
        """Queues of the larger suffixes, ascending, and of the smaller ones, descending."""
        large = [BlockQueue(self.budget) for _ in range(256)]
        least, seen = np.full(256, 255, np.uint8), np.zeros(256, bool)
        for c in range(256):
            tail = None
            for at, common in large[c].read():
                self._scan(at, common, False, large, least, seen)
                tail = at[-1:]
            at, common = stars[c]
            if len(at):
                if tail is not None and exact:
                    common = common.copy()
                    common[0] = self.common(tail.astype(np.int64), at[:1].astype(np.int64))[0]
                self._scan(at, common, False, large, least, seen)
        small = [BlockQueue(self.budget) for _ in range(256)]
        least, seen = np.full(256, 255, np.uint8), np.zeros(256, bool)
        last = np.array([len(self.text) - 1], self.kind)
        small[0].push(last, np.zeros(1, np.uint8))
        seen[0] = True
        for c in range(255, -1, -1):
            tail = None
            for at, common in small[c].read():
                self._scan(at, common, True, small, least, seen)
                tail = at[-1:]
            carried = None
            for at, common in large[c].backward():
                down, shifted = at[::-1], np.concatenate((common[:1] * 0, common[:0:-1]))
                if carried is not None:
                    shifted[0] = carried
                elif tail is not None and exact:
                    shifted[0] = self.common(tail.astype(np.int64), down[:1].astype(np.int64))[0]
                carried = common[0]
                self._scan(down, shifted, True, small, least, seen)
        return large, small

    def _by_character(self, at: np.ndarray, common: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        head = self.text[at]
        edge = np.searchsorted(head, np.arange(257))
        out = []
        for c in range(256):
            x, v = at[edge[c] : edge[c + 1]].astype(self.kind), common[edge[c] : edge[c + 1]].copy()
            if len(v):
                v[0] = 0
            out.append((x, v))
        return out

    def _order_stars(self) -> np.ndarray:
        """Starts in suffix order: name the pieces between starts, then sort the string of names."""
        stars = self.starts
        loose = stars[np.argsort(self.text[stars], kind="stable")]
        large, small = self._induce(self._by_character(loose, np.zeros(len(loose), np.uint8)), False)
        is_star = np.zeros(len(self.text), bool)
        is_star[stars] = True
        pieces = []
        for c in range(256):
            mine = [at[is_star[at]] for at, _ in small[c].read()]
            if mine:
                pieces.append(np.concatenate(mine)[::-1])
        for q in (*large, *small):
            q.close()
        ordered = np.concatenate(pieces).astype(np.int64)
        number = np.zeros(len(self.text), self.kind)
        number[stars] = np.arange(len(stars))
        mine = number[ordered]
        ends = np.append(stars[1:] + 1, len(self.text))
        h = hash_spans(self.padded, stars, ends)[mine]
        rank = np.zeros(len(stars) + 1, np.int64)
        rank[mine] = np.cumsum(np.concatenate(([1], (h[1:] != h[:-1]).astype(np.int64))))
        return stars[self._sort_names(rank)]

    def _sort_names(self, rank: np.ndarray) -> np.ndarray:
        """Suffix order of the string of names, as far as ``cap`` bytes can reach.

        Names have an alphabet of their own size, so queues by character give
        way to doubling of ranks; suffixes whose rank is final are left alone.
        """
        n, reach = len(rank) - 1, 1
        order = np.argsort(rank[:n], kind="stable")
        ordered = rank[order]
        open_at = np.flatnonzero(np.concatenate((ordered[1:] == ordered[:-1], [False])) | np.concatenate(([False], ordered[1:] == ordered[:-1])))
        # Final numbers leave room: a group's rank is the place of its first member.
        place = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        rank[order] = np.repeat(place + 1, np.diff(np.append(place, n)))
        while len(open_at) and reach * 2 <= self.cap + 2:
            who = order[open_at]
            key = rank[np.minimum(who + reach, n)]
            own = rank[who]
            by = np.argsort(own * np.int64(n + 2) + key, kind="stable")
            who, key, own = who[by], key[by], own[by]
            order[open_at] = who
            new_group = np.concatenate(([True], own[1:] != own[:-1]))
            new = new_group | np.concatenate(([True], key[1:] != key[:-1]))
            place = np.flatnonzero(new)
            rank[who] = np.repeat(open_at[place] + 1, np.diff(np.append(place, len(who))))
            single = np.diff(np.append(place, len(who))) == 1
            open_at = open_at[~np.repeat(single, np.diff(np.append(place, len(who))))]
            reach *= 2
        return order

    def sort(self):
        """Yield blocks (positions, common prefix with the suffix before) in ascending order."""
        if len(self.starts):
            stars = self._order_stars()
            common = np.concatenate((np.zeros(1, np.uint8), self.common(stars[:-1], stars[1:])))
            lists = self._by_character(stars, common)
        else:
            lists = [(np.zeros(0, self.kind), np.zeros(0, np.uint8))] * 256
        large, small = self._induce(lists, True)
        for c in range(256):
            tail = None
            for at, common in large[c].read():
                yield at, common
                tail = at[-1:]
            large[c].close()
            carried = None
            for at, common in small[c].backward():
                up, shifted = at[::-1], np.concatenate((common[:1] * 0, common[:0:-1]))
                if carried is not None:
                    shifted[0] = carried
                elif tail is not None:
                    shifted[0] = self.common(tail.astype(np.int64), up[:1].astype(np.int64))[0]
                carried = common[0]
                yield up, shifted
            small[c].close()
