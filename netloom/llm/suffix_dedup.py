"""Exact removal of repeated byte strings across a corpus, by sharded suffix arrays.

A window is ``length`` bytes of one document.  Each window has an anchor, the
position of its least gram hash (the last of equals), which depends on the
window's bytes alone.  Consecutive windows with one anchor form a run; runs are
dealt to shards by the hash of the anchor's gram, so equal windows always meet
in one shard.  Runs whose gram occurs once in the corpus cannot repeat and are
never sent.  A shard sorts the suffixes of its runs by induced sorting; windows
whose neighbours share ``length`` bytes are one class, all but its earliest
window are removed.

A gram of very many parts would make one shard hot, for at the edges of a
passage every document sends a run of its own.  The windows of such grams are
counted by their hash first, and runs are cut to the windows that occur again;
what is left ends where the passage ends, so equal runs combine in their parts.

Text is shuffled once to count grams and once for all later passes, which share
an exchange: texts are grouped into parts of bounded size, and each step returns
to the parts only what concerns them.
Before anything is sent, a part keeps the earliest of its own equal runs, and
equal documents other than the first take no part at all.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.spans import U, hash_spans, lean_group, lean_pair, mix
from netloom.llm.suffix_sort import InducedSorter
from netloom.plans.shared import materialize, plan_bytes, quoted, steady

#: Bytes of a repeat, of an anchor's gram.
LENGTH, GRAM = 100, 24
#: Plan bytes for each part, parts for each shard, text bytes looked at together.
PART_BYTES, PARTS_A_SHARD, SLICE_BYTES = 3 << 20, 1, 1 << 20
#: Parts that hold a gram before its windows are counted one by one.
HOT_PARTS = 256
_BASE = 0x9E3779B97F4A7C15
_POSITION_BITS = 21
#: Key of a null document id: it counts as the smallest.
_NULL = -(1 << 63)


def _power(n: int) -> np.uint64:
    return U(pow(_BASE, n, 1 << 64))


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` bytes, put together from runs of powers of two."""
    part, size, out, done = data.astype(U) + U(1), 1, None, 0
    while True:
        if k & 1:
            if out is None:
                out, done = part, size
            else:
                m = len(data) - done - size + 1
                out, done = out[:m] * _power(size) + part[done : done + m], done + size
        k >>= 1
        if not k:
            return mix(out)
        m = len(data) - 2 * size + 1
        if m <= 0:
            return np.zeros(0, U)
        part, size = part[:m] * _power(size) + part[size : size + m], size * 2


def _least(values: np.ndarray, width: int) -> np.ndarray:
    size, m = 1, len(values) - width + 1
    while size * 2 <= width:
        values, size = np.minimum(values[:-size], values[size:]), size * 2
    return np.minimum(values[:m], values[width - size : width - size + m])


def anchor_runs(texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """Runs of windows with one anchor over all texts.

    Returns text number, first byte, windows, and 64-bit gram hash of each run.
    """
    found = []
    batch: list[tuple[int, int, bytes]] = []
    size = 0

    def look() -> None:
        data = np.frombuffer(b"".join(b for _, _, b in batch), np.uint8)
        if len(data) < length:
            return
        g = gram_hashes(data, gram)
        place = np.arange(len(g), dtype=U)
        low = U((1 << _POSITION_BITS) - 1)
        key = _least((g & ~low) | (low - place), length - gram + 1)
        sizes = np.array([len(b) for _, _, b in batch])
        ends = np.cumsum(sizes)
        begins = ends - sizes
        owner = np.repeat(np.arange(len(batch)), sizes)[: len(key)]
        valid = np.arange(len(key)) + length <= ends[owner]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])))
        start = np.flatnonzero(new & valid)
        until = np.append(np.flatnonzero(new)[1:], len(key))[np.searchsorted(np.flatnonzero(new), start)]
        windows = np.minimum(until, ends[owner[start]] - length + 1) - start
        at = (low - (key[start] & low)).astype(np.int64)
        numbers, offsets = np.array([n for n, _, _ in batch]), np.array([o for _, o, _ in batch])
        found.append((numbers[owner[start]], start - begins[owner[start]] + offsets[owner[start]], windows, g[at]))

    step = SLICE_BYTES
    for number, text in enumerate(texts):
        for low in range(0, max(len(text) - length + 1, 0), step):
            piece = text[low : low + step + length - 1]
            batch.append((number, low, piece))
            size += len(piece)
            if size >= step // 2:
                look()
                batch, size = [], 0
    if batch:
        look()
    if not found:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U),)
    return tuple(np.concatenate(x) for x in zip(*found))


def window_hashes(data: bytes, origin: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """Hash of each window of runs that begin at ``origin`` in ``data``, run after run."""
    if not len(origin):
        return np.zeros(0, U)
    sizes = windows + length - 1
    out, low = [], 0
    until = np.cumsum(sizes)
    while low < len(origin):
        high = max(low + 1, int(np.searchsorted(until, until[low] - sizes[low] + SLICE_BYTES, side="right")))
        own, count = sizes[low:high], windows[low:high]
        flat = b"".join([data[o : o + n] for o, n in zip(origin[low:high].tolist(), own.tolist())])
        begin = np.cumsum(own) - own
        inside = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        out.append(gram_hashes(np.frombuffer(flat, np.uint8), length)[np.repeat(begin, count) + inside])
        low = high
    return np.concatenate(out)


def _bucketed(hashes: np.ndarray, shards: int, part: int) -> pa.Table:
    """Distinct hashes by bucket; only buckets that get something, so never more of them than hashes."""
    hashes = np.unique(hashes)
    bucket = (hashes % U(shards)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    mine, edge = np.unique(bucket[order], return_index=True)
    blobs = [hashes[order[a:b]].tobytes() for a, b in zip(edge, [*edge[1:], len(order)])]
    return pa.table({"bucket": pa.array(mine, pa.int32()), "part": pa.array([part] * len(mine), pa.int32()), "blob": pa.array(blobs, pa.binary())})


def _again(kind: int, hot: int | None = None):
    """Return to the parts their hashes that other parts have too, as notes ``kind``, and those of very many as ``hot``."""

    def again(table: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(b, U) for b in table.column("blob").to_pylist()]
        every, count = np.unique(np.concatenate(blobs), return_counts=True)
        parts, kinds, out = [], [], []
        for k, least in ((kind, 2), (hot, HOT_PARTS + 1)):
            known = every[count >= least]
            for part, blob in zip(table.column("part").to_pylist(), blobs) if k is not None else ():
                if len(own := blob[np.isin(blob, known, assume_unique=True)]):
                    parts.append(part), kinds.append(k), out.append(own.tobytes())
        return pa.table({"part": pa.array(parts, pa.int32()), "kind": pa.array(kinds, pa.int32()), "row": pa.nulls(len(out), pa.int64()), "blob": pa.array(out, pa.binary())})

    return again


class _Part:
    """Texts of one part without the copies, in order of (document id, row)."""

    def __init__(self, texts: pa.Table, notes: pa.Table):
        doc, row = texts.column("doc").to_numpy(), texts.column("row").to_numpy()
        order = np.lexsort((row, doc))
        self.order, self.doc, self.row = order, doc[order], row[order]
        column = texts.column("body").combine_chunks()
        self.texts = [column[i].as_buffer().to_pybytes() if column[i].is_valid else b"" for i in order.tolist()]
        self.notes = [r for r in notes.to_pylist()] if notes is not None else []
        copies = {r["row"] for r in self.notes if r["kind"] == 0}
        self.copy = np.array([r in copies for r in self.row.tolist()], bool)

    def noted(self, kind: int) -> np.ndarray:
        """Sorted hashes of the notes of a kind."""
        blobs = [np.frombuffer(r["blob"], U) for r in self.notes if r["kind"] == kind and r["blob"]]
        return np.sort(np.concatenate(blobs)) if blobs else np.zeros(0, U)

    def joined(self) -> tuple[bytes, np.ndarray]:
        """All texts in one, and where each begins."""
        sizes = np.fromiter(map(len, self.texts), np.int64, len(self.texts))
        return b"".join(self.texts) + b"\0" * 8, np.cumsum(sizes) - sizes

    def runs(self, length: int, gram: int):
        return anchor_runs([b"" if c else t for t, c in zip(self.texts, self.copy.tolist())], length, gram)


def _merge(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals that are sorted by start; those that touch become one."""
    if not len(start):
        return start, end
    reach = np.maximum.accumulate(end)
    new = np.concatenate(([True], start[1:] > reach[:-1]))
    return start[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)]


_NOTE = "part int, kind int, row long, blob binary"


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, prefix: str = "repeats_") -> DataFrame:
    """Remove each byte that a ``length``-byte string covers which also starts earlier.

    Texts are UTF-8 bytes, null is empty, matches stay inside documents, and
    earlier means a smaller id, or the same document and an earlier start; null
    ids come first, rows with equal ids follow each other in row order.  Every
    string is judged on the input.  Returns ``doc_id, n_bytes, n_removed,
    n_spans, kept_sha256`` and ``kept_text``, the remaining bytes, decoded with
    bytes that no longer form a character left out, for every row.  With ``keep``,
    these columns of ``docs`` come first, and the names of the others get a
    ``prefix``, which should make them differ from the names kept.
    """
    keep = keep or []
    # Rows are numbered where they are read, so every reading must give the same.
    docs = steady(docs.select(*[F.col(quoted(c)) for c in dict.fromkeys([id_col, text_col, *keep])]), "texts")
    parts = max(8, -(-plan_bytes(docs, text_col) // PART_BYTES))
    shards = max(4, parts // PARTS_A_SHARD)
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), body.alias("body"), *[F.col(quoted(c)).alias(f"kept_{i}") for i, c in enumerate(keep)]).withColumn("row", F.monotonically_increasing_id())
    base = base.withColumn("doc", F.coalesce("doc_id", F.lit(_NULL))).withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    digest = base.select("part", "row", "doc", F.octet_length("body").alias("n"), F.xxhash64("body").alias("h1"), F.xxhash64(F.lit(3), "body", F.lit(5)).alias("h2")).where(F.col("n") >= length)
    first = digest.groupBy("n", "h1", "h2").agg(F.min(F.struct("doc", "row")).alias("first"), F.count("*").alias("m")).where("m > 1")
    # Written first: a join of two exchanges can split a group of very many copies.
    copies = digest.join(materialize(first, "firsts"), ["n", "h1", "h2"]).where("first.row <> row")
    copies = materialize(copies.select("part", F.lit(0).alias("kind"), "row", F.lit(None).cast("binary").alias("blob")), "copies")
    texts = base.groupBy("part")

    def keys(left: pa.Table, right: pa.Table) -> pa.Table:
        part = left.column("part")[0].as_py() if left.num_rows else -1
        return _bucketed(_Part(left, right).runs(length, gram)[3] if left.num_rows else np.zeros(0, U), shards, part)

    bucketed = "bucket int, part int, blob binary"
    grams = texts.cogroup(copies.groupBy("part")).applyInArrow(lean_pair(keys), bucketed).groupBy("bucket").applyInArrow(lean_group(_again(1, 3)), _NOTE)
    # Written, so that the passes over the texts are not all held by one job.
    grams = materialize(grams, "grams")

    def hot_windows(left: pa.Table, right: pa.Table) -> pa.Table:
        hashes, me = np.zeros(0, U), left.column("part")[0].as_py() if left.num_rows else -1
        if left.num_rows:
            part = _Part(left, right)
            if len(hot := part.noted(3)):
                number, start, windows, gram_of = part.runs(length, gram)
                at = np.flatnonzero(np.isin(gram_of, hot))
                data, begin = part.joined()
                hashes = window_hashes(data, begin[number[at]] + start[at], windows[at], length)
        return _bucketed(hashes, shards, me)

    notes = copies.unionAll(grams)
    hot = texts.cogroup(notes.where("kind in (0, 3)").groupBy("part")).applyInArrow(lean_pair(hot_windows), bucketed).groupBy("bucket").applyInArrow(lean_group(_again(4)), _NOTE)

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("heads", pa.binary()), ("bytes", pa.binary()), ("marks", pa.binary())])
        if not left.num_rows:
            return schema.empty_table()
        part = _Part(left, right)
        number, start, windows, hashes = part.runs(length, gram)
        elsewhere = part.noted(1)
        own, back, count = np.unique(hashes, return_inverse=True, return_counts=True)
        wanted = np.isin(own, elsewhere, assume_unique=True) | (count > 1)
        at = np.flatnonzero(wanted[back])
        number, start, windows, hashes = number[at], start[at], windows[at], hashes[at]
        data, begin = part.joined()
        if len(hot_grams := part.noted(3)):
            is_hot = np.isin(hashes, hot_grams)
            n, s, w, h = (x[is_hot] for x in (number, start, windows, hashes))
            each = window_hashes(data, begin[n] + s, w, length)
            _, place, times = np.unique(each, return_inverse=True, return_counts=True)
            stays = (times[place] > 1) | np.isin(each, part.noted(4))
            run = np.repeat(np.arange(len(n)), w)
            first = np.flatnonzero(stays & np.concatenate(([True], ~stays[:-1] | (run[1:] != run[:-1])))) if len(stays) else np.zeros(0, np.int64)
            last = np.flatnonzero(stays & np.concatenate((~stays[1:] | (run[1:] != run[:-1]), [True]))) if len(stays) else first
            offset = first - (np.cumsum(w) - w)[run[first]]
            cut = (n[run[first]], s[run[first]] + offset, last - first + 1, h[run[first]])
            number, start, windows, hashes = (np.concatenate((x[~is_hot], y)) for x, y in zip((number, start, windows, hashes), cut))
            order = np.lexsort((start, number))
            number, start, windows, hashes = number[order], start[order], windows[order], hashes[order]
        origin = begin[number] + start
        content = hash_spans(data, origin, origin + windows + length - 1)
        # Runs come in document order, so the first of equal runs is the earliest.
        order = np.lexsort((np.arange(len(hashes)), content, hashes))
        same = np.concatenate(([False], (hashes[order][1:] == hashes[order][:-1]) & (content[order][1:] == content[order][:-1]))) if len(hashes) else np.zeros(0, bool)
        covered, sent = order[same], np.sort(order[~same])
        marks = np.stack([part.row[number[covered]], start[covered], start[covered] + windows[covered] + length - 1], 1).astype("<i8").tobytes() if len(covered) else b""
        # Grams that occur in this part alone, once after combining, cannot repeat elsewhere.
        left_over, inverse, times = np.unique(hashes[sent], return_inverse=True, return_counts=True)
        sent = sent[(times[inverse] > 1) | np.isin(left_over, elsewhere, assume_unique=True)[inverse]]
        shard = (mix(hashes[sent]) % U(shards)).astype(np.int64)
        by = np.argsort(shard, kind="stable")
        me = left.column("part")[0].as_py()
        rows = [{"shard": me % shards, "part": me, "heads": b"", "bytes": b"", "marks": marks}] if marks else []
        found, edge = np.unique(shard[by], return_index=True)
        for s, a, b in zip(found.tolist(), edge, [*edge[1:], len(by)]):
            mine = sent[by[a:b]]
            heads = np.stack([part.doc[number[mine]], part.row[number[mine]], start[mine], windows[mine]], 1).astype("<i8").tobytes()
            body = b"".join([data[o : o + w + length - 1] for o, w in zip(origin[mine].tolist(), windows[mine].tolist())])
            rows.append({"shard": s, "part": me, "heads": heads, "bytes": body, "marks": b""})
        return pa.Table.from_pylist(rows, schema=schema)

    runs = texts.cogroup(notes.unionAll(hot).groupBy("part")).applyInArrow(lean_pair(send), "shard int, part int, heads binary, bytes binary, marks binary")

    def sort_shard(table: pa.Table) -> pa.Table:
        part_of = table.column("part").to_pylist()
        heads = [np.frombuffer(h, "<i8").reshape(-1, 4) for h in table.column("heads").to_pylist()]
        out = [(p, m) for p, m in zip(part_of, table.column("marks").to_pylist()) if m]
        source = np.repeat(np.arange(len(heads)), [len(h) for h in heads])
        head = np.concatenate(heads)
        if len(head):
            sizes = head[:, 3] + length - 1
            raw = np.frombuffer(b"".join(table.column("bytes").to_pylist()), np.uint8)
            del table
            begin = np.cumsum(sizes + 1) - sizes - 1
            text = np.zeros(len(raw) + len(head), np.uint8)
            inside = np.ones(len(text), bool)
            inside[begin + sizes] = False
            text[inside] = raw + np.uint8(1)
            repeated = np.zeros(len(text), bool)
            is_window = np.zeros(len(text) + 1, np.int8)
            np.add.at(is_window, begin, 1)
            np.add.at(is_window, begin + head[:, 3], -1)
            is_window = np.cumsum(is_window[:-1], dtype=np.int8) > 0
            rank = np.zeros(len(head), np.int64)
            rank[np.lexsort((head[:, 2], head[:, 1], head[:, 0]))] = np.arange(len(head))

            def order_of(at: np.ndarray) -> np.ndarray:
                run = np.searchsorted(begin, at, side="right") - 1
                return rank[run] * (1 << 24) + np.minimum(at - begin[run], (1 << 24) - 1)

            held: list[tuple[np.ndarray, np.ndarray]] = []

            def settle(at: np.ndarray, common: np.ndarray) -> None:
                """Mark all but the earliest window of each class of neighbours."""
                new = np.concatenate(([True], common[1:] < length))
                starts = np.flatnonzero(new)
                several = np.diff(np.append(starts, len(at))) > 1
                if not several.any():
                    return
                pick = np.repeat(several, np.diff(np.append(starts, len(at))))
                at, group = at[pick], np.cumsum(new)[pick]
                place = order_of(at)
                by = np.lexsort((place, group))
                later = np.concatenate(([False], group[by][1:] == group[by][:-1]))
                repeated[at[by[later]]] = True

            for at, common in InducedSorter(text, length).sort():
                # A suffix that starts no window differs from its neighbours before ``length`` bytes.
                at = at.astype(np.int64)
                ok = is_window[at]
                if not ok.any():
                    continue
                held.append((at[ok], np.where(ok, common, 0)[ok]))
                first = np.flatnonzero(held[-1][1] < length)
                if len(first) and first[-1] > 0 or len(first) and len(held) > 1:
                    cut = first[-1]
                    settle(np.concatenate([*(h[0] for h in held[:-1]), held[-1][0][:cut]]), np.concatenate([*(h[1] for h in held[:-1]), held[-1][1][:cut]]))
                    held = [(held[-1][0][cut:], held[-1][1][cut:])]
            if held:
                settle(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            at = np.flatnonzero(repeated)
            run = np.searchsorted(begin, at, side="right") - 1
            new = np.concatenate(([True], (at[1:] != at[:-1] + 1) | (run[1:] != run[:-1]))) if len(at) else np.zeros(0, bool)
            f = np.flatnonzero(new)
            l = np.append(f[1:] - 1, len(at) - 1) if len(f) else f
            start = head[run[f], 2] + at[f] - begin[run[f]]
            end = head[run[f], 2] + at[l] - begin[run[f]] + length
            marks = np.stack([head[run[f], 1], start, end], 1).astype("<i8")
            owner = source[run[f]] if len(f) else np.zeros(0, np.int64)
            for k in np.unique(owner).tolist():
                out.append((part_of[k], marks[owner == k].tobytes()))
        n = len(out)
        return pa.table({"part": pa.array([o[0] for o in out], pa.int32()), "kind": pa.array([2] * n, pa.int32()), "row": pa.array([None] * n, pa.int64()), "blob": pa.array([o[1] for o in out], pa.binary())})

    marks = runs.groupBy("shard").applyInArrow(lean_group(sort_shard), _NOTE)

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])
        schema = pa.schema([*[left.schema.field(f"kept_{i}") for i in range(len(keep))], *schema])
        if not left.num_rows:
            return schema.empty_table()
        part = _Part(left, right)
        blobs = [r["blob"] for r in part.notes if r["kind"] == 2 and r["blob"]]
        spans = np.frombuffer(b"".join(blobs), "<i8").reshape(-1, 3)
        spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
        removed, n_spans, sha, kept_text = [], [], [], []
        low, high = np.searchsorted(spans[:, 0], part.row), np.searchsorted(spans[:, 0], part.row, side="right")
        for i, text in enumerate(part.texts):
            if part.copy[i]:
                start, end = np.array([0]), np.array([len(text)])
            else:
                start, end = _merge(spans[low[i] : high[i], 1], spans[low[i] : high[i], 2])
            kept, at = [], 0
            for a, b in zip(start.tolist(), end.tolist()):
                kept.append(text[at:a])
                at = b
            kept = b"".join([*kept, text[at:]])
            removed.append(len(text) - len(kept)), n_spans.append(len(start))
            sha.append(hashlib.sha256(kept).hexdigest()), kept_text.append(kept.decode("utf-8", "ignore"))
        ids = pa.array(part.doc, mask=part.doc == _NULL)
        others = left.select([f"kept_{i}" for i in range(len(keep))]).take(pa.array(part.order)).columns
        return pa.table([*others, pa.array(part.row), ids, pa.array([len(t) for t in part.texts], pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(sha), pa.array(kept_text)], schema=schema)

    final = texts.cogroup(copies.unionAll(marks).groupBy("part"))
    kinds = "".join(f"kept_{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep))
    found = final.applyInArrow(lean_pair(cut), f"{kinds}row long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    own = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
    if not keep:
        return found.select(*own)
    return found.select(*[F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)], *[F.col(c).alias(prefix + c) for c in own])
