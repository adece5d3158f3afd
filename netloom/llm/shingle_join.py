"""N-gram Jaccard join: grouped prefix join over distinct word shingles.

Order: shingles go by the number of documents that have them, rare ones first,
then by hash.  A set of n shingles has the prefix of its first n - ceil(t n) + 1;
two sets with Jaccard t share a shingle of both prefixes.  A shingle of one
document links nothing, so a set needs t n shared shingles to link at all; all
other sets are done once the counts are known.

Counting: texts are cut into chunks of bounded size.  A chunk sends its distinct
shingles, packed, to shards by hash; a shingle that the chunk holds several times
is sent once, with its count.  Shards return the shared ones with their counts to
the chunks, which have the shared shingles of each set in the end.  Nothing is
broadcast, and no key gets more than one entry from each chunk.

Documents with equal sets are one class, classes with equal prefix and size one
group.  Lists of groups by prefix shingle give pairs in the same way at any
length: each group meets one leader of its list and size band (a star, not all
pairs); pairs that size and position allow are verified and give components.
Then lists are expanded to members, which meet in blocks of bounded size: first
each member outside its list's largest component has its nearest one of another
component verified, by a parity sketch; at last all pairs across components that
size, position and sketch allow are.  Hence no link between components is lost.

Sketch: in a bitmap of the parity of shingles per bit, each differing bit needs
a shingle that only one of both sets has.  Its width grows with the set.  A list
entry has the sketch of the shingles that follow in the set's order, for in the
list of the first common shingle all that stand before differ; in other lists of
the same pair common ones count as different, so most pairs come from few lists.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.spans import U, lean, lean_group, mix, shingle_sets
from netloom.operators.components import connected_components
from netloom.plans.shared import discard, materialize, plan_bytes, steady

WIDTH = 5
#: Similarity in hundredths: the tests are exact in integers.
LEAST = 80
#: Bits of a shingle's hash.
HASH_BITS = 56
#: Shingles and documents of a chunk; text bytes that are cut at a time.
CHUNK, CHUNK_DOCS, SLICE_BYTES = 1 << 20, 60_000, 2 << 20
#: Plan bytes for each partition of shards; shards for each, so that partitions are much of a size.
PART_BYTES, PART_SHARDS = 4 << 20, 8
#: Bits of the fixed-size filter of documents that pairs ask for (8 MB).
FILTER_BITS = 26
#: Members of a list, or pairs of one document, that meet in one task.
LIST_BLOCK, PAIR_BLOCK = 2048, 256
#: Fewest and most bits of a set's parity sketch; between, it has four for each shingle, up to the next power of two.
SKETCH_BITS, MOST_SKETCH_BITS = 512, 8192
#: Kinds of rows between chunks and shards; owner of a shingle that several sets of a chunk have.
_META, _SEVERAL, _SHINGLES = 0, 1, 2
_MANY = 0xFFFF


def _slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches cut so that each holds a bounded number of text bytes; null texts are empty."""
    for batch in batches:
        column = batch.column(text).cast(pa.large_binary())
        ends = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
        low = 0
        while low < len(column):
            high = max(low + 1, int(np.searchsorted(ends, ends[low] + SLICE_BYTES, side="right")) - 1)
            yield batch.slice(low, high - low), [t or b"" for t in column.slice(low, high - low).to_pylist()]
            low = high


def pack(values: np.ndarray) -> bytes:
    """Sorted numbers as a width and differences of that many bytes."""
    steps = np.diff(values, prepend=U(0))
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(blob: bytes | pa.Buffer) -> np.ndarray:
    """The numbers of :func:`pack`."""
    raw = np.frombuffer(blob, np.uint8)
    width = int(raw[0])
    steps = np.zeros(((len(raw) - 1) // width, 8), np.uint8)
    steps[:, :width] = raw[1:].reshape(-1, width)
    return np.cumsum(steps.view("<u8").ravel(), dtype=U)


def _runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin."""
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)


def _by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """Rows of each key of batches in key order; their blobs are views of the batch."""
    held: list[dict] = []
    for batch in batches:
        numbers = {c: batch.column(c).to_pylist() for c in ("shard", "chunk", "kind")}
        blobs = [(c, batch.column(c)) for c in ("tokens", "owners", "more")]
        for i in range(batch.num_rows):
            row = {c: v[i] for c, v in numbers.items()} | {c: v[i].as_buffer() for c, v in blobs}
            if held and row[key] != held[-1][key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


class _Chunk:
    """Sets of some documents, equal ones once."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        ids, absent, begins, values = zip(*parts)
        self.ids, self.absent = np.concatenate(ids), np.concatenate(absent)
        size = np.concatenate([np.diff(b) for b in begins])
        flat = np.concatenate(values)
        ends = np.cumsum(size)

        def folded(salt: int) -> np.ndarray:
            run = np.zeros(len(flat) + 1, U)
            np.cumsum(mix(flat + U(salt)), out=run[1:])
            return mix(run[ends] - run[ends - size] + U(salt)).view(np.int64)

        self.keys = np.stack([size, folded(11), folded(29)])
        order = np.lexsort(self.keys)
        new = np.concatenate(([True], (np.diff(self.keys[:, order], axis=1) != 0).any(axis=0)))
        self.owner = np.zeros(len(size), np.int64)
        self.owner[order] = np.cumsum(new) - 1
        first = np.zeros(len(size), bool)
        first[order[new]] = True
        kept = np.repeat(first, size)
        self.tokens = flat[kept] >> U(64 - HASH_BITS)
        self.owners = np.repeat(self.owner, size)[kept].astype(np.uint16)

    def rows(self, chunk: int, shards: int) -> Iterator[tuple]:
        order = np.argsort(self.tokens, kind="stable")
        tokens, owners = self.tokens[order], self.owners[order]
        begin = _runs(tokens)
        count = np.diff(np.append(begin, len(tokens)))
        yield chunk % shards, chunk, _META, self.ids.tobytes(), np.concatenate((self.owner, self.absent.astype(np.int64))).tobytes(), self.keys.tobytes()
        several = count > 1
        if several.any():
            yield chunk % shards, chunk, _SEVERAL, pack(tokens[begin[several]]), owners[np.repeat(several, count)].tobytes(), count[several].astype(np.uint32).tobytes()
        tokens, owners = tokens[begin], np.where(several, _MANY, owners[begin]).astype(np.uint16)
        # Ranges of the hash: shingles of one shard stand together.
        shard = ((tokens >> U(HASH_BITS - 32)) * U(shards) >> U(32)).astype(np.int64)
        for low, high in zip(edges := _runs(shard), [*edges[1:], len(shard)]):
            yield int(shard[low]), chunk, _SHINGLES, pack(tokens[low:high]), owners[low:high].tobytes(), count[low:high][several[low:high]].astype(np.uint32).tobytes()


_ROW = "shard long, chunk long, kind int, tokens binary, owners binary, more binary"


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(names), kinds)], names)


def _row_batch(rows: list[tuple]) -> pa.RecordBatch:
    return _batch(rows, ["shard", "chunk", "kind", "tokens", "owners", "more"], [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 3])


def _cut(width: int, shards: int) -> Callable:
    """From documents to rows of their chunks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size, docs = TaskContext.get().partitionId() << 32, [], 0, 0
        for part, raw in _slices(batches, 1):
            if held and (size >= CHUNK or docs + len(raw) > CHUNK_DOCS):
                yield _row_batch(list(_Chunk(held).rows(number, shards)))
                number, held, size, docs = number + 1, [], 0, 0
            for low in range(0, len(raw), CHUNK_DOCS):
                ids = part.column(0).slice(low, CHUNK_DOCS)
                values, begin = shingle_sets(raw[low : low + CHUNK_DOCS], width)
                held.append((ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), begin, values))
                size, docs = size + len(values), docs + len(ids)
                if docs >= CHUNK_DOCS:
                    yield _row_batch(list(_Chunk(held).rows(number, shards)))
                    number, held, size, docs = number + 1, [], 0, 0
        if held:
            yield _row_batch(list(_Chunk(held).rows(number, shards)))

    return cut


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Return to each chunk its shingles that other sets have too, with a code of how many."""
    for group in _by_key(batches, "shard"):
        out = [tuple(x.to_pybytes() if isinstance(x, pa.Buffer) else x for x in r.values()) for r in group if r["kind"] != _SHINGLES]
        rows = [r for r in group if r["kind"] == _SHINGLES]
        if rows:
            tokens = [unpack(r["tokens"]) for r in rows]
            source = np.repeat(np.arange(len(rows), dtype=np.int32), [len(t) for t in tokens])
            tokens = np.concatenate(tokens)
            owners = np.concatenate([np.frombuffer(r["owners"], np.uint16) for r in rows])
            times = np.ones(len(tokens), np.int64)
            times[owners == _MANY] = np.concatenate([np.frombuffer(r["more"], np.uint32) for r in rows])
            order = np.argsort(tokens, kind="stable")
            begin = _runs(tokens[order])
            total = np.add.reduceat(times[order], begin) if len(begin) else times
            code = np.minimum(8 * np.log2(np.maximum(total, 1)), 255).astype(np.uint8)
            of = np.empty(len(tokens), np.uint8)
            of[order] = np.repeat(code, np.diff(np.append(begin, len(tokens))))
            shared = np.flatnonzero(of)
            # Entries stand by source, and by shingle within each.
            for low, high in zip(edges := _runs(source[shared]), [*edges[1:], len(shared)]):
                at = shared[low:high]
                out.append((0, rows[source[at[0]]]["chunk"], _SHINGLES, pack(tokens[at]), owners[at].tobytes(), of[at].tobytes()))
        yield _row_batch(out)


def _sketch(tokens: np.ndarray, n: int) -> bytes:
    bits = min(max(SKETCH_BITS, 4 << (n - 1).bit_length()), MOST_SKETCH_BITS)
    parity = np.bincount((tokens & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From a set's prefix, sketch and wanted shingles to an entry for each of these, with the sketch of what follows."""
    names = ["token", "rep", "n", "c", "pos", "sketch"]
    kinds = [*[pa.int64()] * 5, pa.binary()]
    for batch in batches:
        out, size = [], 0
        for rep, n, alone, c, wanted, prefix, sketch in zip(*(batch.column(i).to_pylist() for i in range(7))):
            order = {t: at for at, t in enumerate(prefix)}
            bits = np.frombuffer(sketch, np.uint8).copy()
            done, mask = 0, 8 * len(bits) - 1
            for at in sorted(order[t] for t in wanted):
                for t in prefix[done:at]:
                    bits[(t & mask) >> 3] ^= 1 << (t & 7)
                done = at
                out.append((prefix[at], rep, n, c, alone + at, bits.tobytes()))
                size += len(bits)
            if size >= SLICE_BYTES:
                yield _batch(out, names, kinds)
                out, size = [], 0
        yield _batch(out, names, kinds)


def _gather(least: int) -> Callable:
    """From what a chunk got back to a row for each document."""

    def sets(rows: list[dict]) -> pa.RecordBatch:
        meta = next(r for r in rows if r["kind"] == _META)
        ids = np.frombuffer(meta["tokens"], np.int64)
        owner, absent = np.frombuffer(meta["owners"], np.int64).reshape(2, -1)
        keys = np.frombuffer(meta["more"], np.int64).reshape(3, -1)
        found = [r for r in rows if r["kind"] == _SHINGLES]
        tokens = np.concatenate([unpack(r["tokens"]) for r in found] or [np.zeros(0, U)])
        owners = np.concatenate([np.frombuffer(r["owners"], np.uint16) for r in found] or [np.zeros(0, np.uint16)])
        codes = np.concatenate([np.frombuffer(r["more"], np.uint8) for r in found] or [np.zeros(0, np.uint8)])
        for r in rows:
            if r["kind"] == _SEVERAL:
                own, times = unpack(r["tokens"]), np.frombuffer(r["more"], np.uint32)
                many = owners == _MANY
                order = np.argsort(tokens[many])
                known = codes[many][order]
                tokens = np.concatenate((tokens[~many], np.repeat(own, times)))
                owners = np.concatenate((owners[~many], np.frombuffer(r["owners"], np.uint16)))
                codes = np.concatenate((codes[~many], np.repeat(known, times)))
        order = np.lexsort((tokens, codes, owners))
        tokens = tokens[order]
        classes = int(owner.max(initial=-1)) + 1
        end = np.cumsum(np.bincount(owners, minlength=classes))
        begin = np.concatenate(([0], end))
        carrier = np.full(classes, -1)
        real = np.flatnonzero(absent == 0)
        real = real[np.lexsort((ids[real], owner[real]))]
        carrier[owner[real][_runs(owner[real])]] = real[_runs(owner[real])]
        out = []
        for i, (o, n, none) in enumerate(zip(owner.tolist(), keys[0].tolist(), absent.tolist())):
            prefix = blob = sketch = None
            if n and carrier[o] == i and end[o] - begin[o] >= -(-least * n // 100):
                own = tokens[begin[o] : end[o]]
                # Shingles of this set alone stand first in its order; they link nothing.
                prefix = own[: len(own) - -(-least * n // 100) + 1].view(np.int64)
                blob, sketch = own.tobytes(), _sketch(own, n)
            out.append((None if none else int(ids[i]), n, int(keys[1, i]), int(keys[2, i]), prefix, blob, sketch))
        return _batch(out, ["doc_id", "n", "h1", "h2", "prefix", "shingles", "sketch"], [*[pa.int64()] * 4, pa.list_(pa.int64()), pa.binary(), pa.binary()])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(batches, "chunk"):
            yield sets(rows)

    return gather


def shared_shingles(docs: DataFrame, width: int, least: int) -> DataFrame:
    """A row ``doc_id, n, h1, h2, prefix, shingles, sketch`` for each row ``doc_id, text`` of ``docs``.

    ``n, h1, h2`` stand for the set of all shingles.  The rest is given for one
    document of each set and chunk, and only where enough of its shingles occur in
    other documents for a link: those shingles, rare ones first, the part of the
    prefix that they make up, and their sketch.
    """
    docs = steady(docs, "texts")
    parts = max(8, -(-plan_bytes(docs, "text") // PART_BYTES))
    cut = docs.mapInArrow(lean(_cut(width, parts * PART_SHARDS)), _ROW)
    counted = cut.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(lean(_count), _ROW)
    back = counted.repartition(parts, "chunk").sortWithinPartitions("chunk")
    return back.mapInArrow(lean(_gather(least)), "doc_id long, n long, h1 long, h2 long, prefix array<long>, shingles binary, sketch binary")


def _band(n: Column, least: int) -> Column:
    """Number of the size band of a set: sizes of one band reach the similarity's ratio."""
    return F.floor(F.log(n.cast("double")) / float(np.log(100 / least)) + 1e-9)


def _meets(n: Column, pos: Column, other_n: Column, other_pos: Column, least: int) -> Column:
    """Whether two sets whose first common shingle has these positions can link."""
    return least * (n + other_n) <= (100 + least) * F.least(n - pos, other_n - other_pos)


def _stars(lists: DataFrame, least: int) -> DataFrame:
    """Pairs of a leader and another group for each list and band; lists of much the same groups have the same leader.

    Leaders are written first: a join of two exchanges can split a long list.
    """
    banded = lists.withColumn("band", _band(F.col("n"), least))
    leaders = banded.groupBy("token", "band").agg(F.min_by(F.struct("gid", "n", "pos"), F.xxhash64("gid")).alias("l"))
    leaders = materialize(leaders, "leaders")
    met = banded.join(leaders, ["token", "band"]).where(F.col("gid") != F.col("l.gid"))
    fits = 100 * F.least("n", "l.n") >= least * F.greatest("n", "l.n")
    return met.where(fits & _meets(F.col("n"), F.col("pos"), F.col("l.n"), F.col("l.pos"), least)).select(F.col("l.gid").alias("a"), F.col("gid").alias("b")).distinct()


def verify_pairs(sets: DataFrame, pairs: DataFrame, least: int) -> DataFrame:
    """Pairs ``a, b`` of document ids whose shingle sets reach the similarity.

    A filter of fixed size, built from all ids that occur in a pair, keeps other
    sets out of the shuffle; what it lets through by chance only costs time.  The
    set of ``a`` is sent once for each block of its pairs, so it should be the
    side with many.
    """
    spark = sets.sparkSession
    spot = F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_BITS))
    asked = pairs.select(F.col("a").alias("id")).unionAll(pairs.select(F.col("b").alias("id"))).select(spot.alias("spot"))
    # The bitmap functions count positions from 1 in buckets from 1.
    place = F.col("spot") + 1
    maps = asked.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    bits = np.zeros((1 << FILTER_BITS) // 8 + 4096, np.uint8)
    # At most 2 ** FILTER_BITS bits in all, whatever the number of pairs.
    for r in maps.collect():
        chunk = np.frombuffer(bytes(r["bits"]), np.uint8)
        at = (r["bucket"] - 1) * 4096
        bits[at : at + len(chunk)] = chunk
    shared = spark.sparkContext.broadcast(bits)

    def asked_for(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            spots = batch.column(3).to_numpy()
            yield batch.filter(pa.array((table[spots >> 3] >> (spots & 7).astype(np.uint8) & 1).astype(bool)))

    known = sets.where("shingles is not null").select(F.col("doc_id").alias("id"), "n", "shingles", F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS)).alias("spot"))
    found = known.mapInArrow(lean(asked_for), "id long, n long, shingles binary, spot long").drop("spot")
    # Both joins read one exchange of the sets.
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIR_BLOCK).cast("int").alias("blocks"))
    one = blocks.join(found, blocks["a"] == found["id"]).select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("long").alias("b"), "n", "shingles")
    two = pairs.join(found, pairs["b"] == found["id"]).join(blocks, "a").select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"), "b", "n", "shingles")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, []
        for batch in batches:
            linked = []
            for a, block, b, n, blob in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4)):
                values = np.sort(np.frombuffer(blob.as_buffer(), U))
                if (a, block) != key:
                    key, own = (a, block), []
                if b is None:
                    own.append((n, values))
                    linked.append(False)
                    continue
                link = False
                for m, others in own:
                    short, long = (values, others) if len(values) < len(others) else (others, values)
                    common = int((long[np.minimum(np.searchsorted(long, short), len(long) - 1)] == short).sum())
                    link |= 100 * common >= least * (n + m - common)
                linked.append(link)
            yield batch.select([0, 2]).filter(pa.array(linked, pa.bool_()))

    met = one.unionAll(two).repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())
    return met.mapInArrow(lean(check), "a long, b long")


def _folded(sketches: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By width in bytes: rows of a sketch of that width, or of twice that width folded, and the sketches."""
    width = np.array([len(s) for s in sketches])
    out = {}
    for w in np.unique(width).tolist():
        for to in {w, max(w // 2, SKETCH_BITS // 8)}:
            at = np.flatnonzero(width == w)
            rows = np.frombuffer(b"".join([sketches[i] for i in at.tolist()]), U).reshape(len(at), -1)
            if to < w:
                rows = rows[:, : to // 8] ^ rows[:, to // 8 :]
            out.setdefault(to, []).append((at, rows))
    return {w: (np.concatenate([a for a, _ in x]), np.concatenate([r for _, r in x])) for w, x in out.items()}


def _across(lists: DataFrame, least: int, nearest: bool) -> DataFrame:
    """Pairs of list members of different components that size, position and sketch let link, in blocks.

    A list's members of its largest component go to one block each, the others
    to all.  With ``nearest``, only one pair for each of the others in a block.
    """

    def cross(table: pa.Table) -> pa.Table:
        rep, n, pos, c, home = (table.column(x).to_numpy() for x in ("rep", "n", "pos", "c", "home"))
        sketches = table.column("sketch").to_pylist()
        width = np.array([len(s) for s in sketches])
        folded = _folded(sketches)
        row = {}
        for w, (at, _) in folded.items():
            row[w] = np.full(len(rep), -1)
            row[w][at] = np.arange(len(at))
        left = np.flatnonzero(home)
        other = table.column("c").to_numpy() != table.column("largest").to_numpy()
        best, mate = np.full(len(rep), np.iinfo(np.int64).max), np.zeros(len(rep), np.int64)
        out = [np.zeros((2, 0), np.int64)]
        for at in range(0, len(left), 256):
            i = left[at : at + 256]
            fits = (c[i][:, None] != c) & (least * (n[i][:, None] + n) <= (100 + least) * np.minimum((n - pos)[i][:, None], n - pos))
            # Two members at home meet once.
            fits &= ~home | (i[:, None] < np.arange(len(rep)))
            x, y = np.nonzero(fits)
            for cut in range(0, len(x), 1 << 13):
                s, t = i[x[cut : cut + (1 << 13)]], y[cut : cut + (1 << 13)]
                both = n[s] + n[t]
                apart = pos[s] + pos[t]
                narrow = np.minimum(width[s], width[t])
                for w in np.unique(narrow).tolist():
                    k = np.flatnonzero(narrow == w)
                    bits = folded[w][1]
                    apart[k] += np.bitwise_count(bits[row[w][s[k]]] ^ bits[row[w][t[k]]]).sum(axis=1, dtype=np.int64)
                near = apart <= both + 2 * (-least * both // (100 + least))
                s, t, apart = s[near], t[near], apart[near]
                if not nearest:
                    out.append(np.stack((rep[t], rep[s])))
                    continue
                own, partner, far = np.concatenate((s, t)), np.concatenate((t, s)), np.concatenate((apart, apart))
                order = np.lexsort((rep[partner], far, own))
                first = order[_runs(own[order])]
                first = first[other[own[first]] & (far[first] < best[own[first]])]
                best[own[first]], mate[own[first]] = far[first], partner[first]
        if nearest:
            has = np.flatnonzero(best < np.iinfo(np.int64).max)
            out.append(np.stack((rep[has], rep[mate[has]])))
        found = np.concatenate(out, axis=1)
        return pa.table({"a": pa.array(found[0]), "b": pa.array(found[1])})

    sizes = lists.groupBy("token", "c").count()
    facts = sizes.groupBy("token").agg(F.ceil(F.sum("count") / LIST_BLOCK).cast("int").alias("blocks"), F.max_by("c", F.struct("count", "c")).alias("largest"))
    facts = materialize(facts, "facts")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    to = F.when(F.col("c") == F.col("largest"), F.array(own)).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = lists.join(facts, "token").withColumn("own", own).withColumn("block", F.explode(to)).withColumn("home", F.col("own") == F.col("block"))
    return spread.groupBy("token", "block").applyInArrow(lean_group(cross), "a long, b long").distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: int = LEAST) -> DataFrame:
    """Return ``doc_id, n_shingles, component_id`` for every row of ``docs``.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased.  Two
    documents link when 100 * intersection >= ``least`` * union of their sets of
    ``width``-word shingles; a shorter text has its whole sequence as its one
    shingle; null, empty and blank texts have none, link with nothing and are
    their own component.  Other rows with equal ids are one document; rows with a
    null id link with nothing and have no component.  An empty table gives an empty result; other
    columns of ``docs`` are not read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = materialize(shared_shingles(source, width, least), "sets")
    same = ["n", "h1", "h2"]
    rows = sets.select("doc_id", *same)
    classes = rows.where("n > 0 and doc_id is not null").groupBy(*same).agg(F.min("doc_id").alias("rep"))
    able = sets.where("shingles is not null").select("doc_id", *same, "prefix", (F.col("n") - F.octet_length("shingles") / 8).cast("long").alias("alone"), "sketch")
    members = able.join(classes, same).where("doc_id = rep").dropDuplicates(same).withColumn("p", F.xxhash64("prefix"))
    members = materialize(members.select("rep", "n", "alone", "p", "prefix", "sketch"), "members")
    keys = ["n", "alone", "p"]
    groups = members.groupBy(*keys).agg(F.min("rep").alias("gid"))
    grouped = members.select("rep", *keys).join(groups, keys).select("gid", "rep", "n", "alone")
    grouped = materialize(grouped, "groups")
    leads = members.join(groups.select(*keys, F.col("gid").alias("rep")), [*keys, "rep"], "left_semi").dropDuplicates([*keys, "rep"])
    entries = leads.select(F.posexplode("prefix").alias("at", "token"), F.col("rep").alias("gid"), "n", "alone")
    entries = entries.select("token", "gid", "n", (F.col("alone") + F.col("at")).alias("pos"))
    several = entries.groupBy("token").agg(F.count("*").alias("m")).where("m > 1").select("token")
    lists = materialize(entries.join(several, "token", "left_semi"), "lists")
    pairs = _stars(lists, least).unionAll(grouped.where("gid <> rep").select(F.col("gid").alias("a"), F.col("rep").alias("b")))
    # Ids that stand for several sets join those sets.
    twice = rows.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.countDistinct(*same).alias("m")).where("m > 1").select("doc_id")
    links = rows.where("n > 0").join(twice, "doc_id", "left_semi").join(classes, same).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    expanded = lists.select("token", "gid", "pos").join(grouped, "gid").select("token", "rep", "n", "alone", "pos")
    # Of a linked pair the smaller set has its first common shingle early.
    early = _meets(F.col("n"), F.col("pos"), F.col("n"), F.col("pos"), least)
    # A set's own prefix bounds what is gathered for it; an id's other sets may lack some of these shingles.
    own = members.select("rep", "n", "alone", "prefix", "sketch")
    for step in ("stars", "nearest", "all"):
        asked = materialize(pairs, "pairs")
        parts = connected_components(links.unionAll(verify_pairs(sets, asked, least)), "a", "b")
        discard(asked)
        if step == "all":
            break
        links = parts.select(F.col("vertex").alias("a"), F.col("component").alias("b"))
        known = parts.select(F.col("vertex").alias("rep"), "component")
        labelled = materialize(expanded.join(known, "rep", "left").withColumn("c", F.coalesce("component", "rep")).drop("component"), "labelled")
        mixed = labelled.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.max(early).alias("early")).where("low <> high and early").select("token")
        mixed = materialize(mixed, "mixed")
        wanted = labelled.join(mixed, "token", "left_semi").groupBy("rep", "n", "alone", "c").agg(F.collect_set("token").alias("wanted"))
        both = wanted.join(own, ["rep", "n", "alone"]).withColumn("wanted", F.array_intersect("wanted", "prefix"))
        left_over = both.select("rep", "n", "alone", "c", "wanted", "prefix", "sketch").mapInArrow(lean(_later), "token long, rep long, n long, c long, pos long, sketch binary")
        pairs = _across(materialize(left_over, "left-over"), least, step == "stars")
    for table in (lists, grouped, members):
        discard(table)
    roots = classes.join(parts.select(F.col("vertex").alias("rep"), "component"), "rep", "left")
    roots = roots.select(*[F.col(c).alias(f"c_{c}") for c in same], F.coalesce("component", "rep").alias("component"))
    joined = rows.join(roots, (rows["n"] == roots["c_n"]) & (rows["h1"] == roots["c_h1"]) & (rows["h2"] == roots["c_h2"]) & rows["doc_id"].isNotNull(), "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
