"""Token-id shards with a minimal perfect hash index.

Shard file, little-endian: magic, header length, JSON header, then the sections
named in the header: ``keys`` (64-bit, in document order), ``displace`` (one
32-bit displacement for each hash bucket), ``finger`` (32-bit fingerprint by
slot), ``rank`` (document number by slot), ``begin`` (64-bit id offset by
document, one more at the end) and ``ids``, the raw payload.  A key is found by
one hash: bucket, displacement, slot, fingerprint, offset.
"""

from __future__ import annotations

import json
import math
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.llm.encoding import encoder
from netloom.llm.spans import U, lean, mix
from netloom.plans.shared import materialize, new_path, plan_bytes

MAGIC = b"NLTOK001"
#: Keys for each hash bucket of the index, and ids at which a shard is closed.
BUCKET_KEYS, SHARD_IDS = 4, 8 << 20
#: Plan bytes for each of the first ranges of documents, and the power of the size by which their number grows.
RANGE_BYTES, RANGE_POWER = 4 << 20, 0.75
_DIRECT = 1 << 31


def key_hash(keys: np.ndarray, repeats: np.ndarray, seed: int) -> np.ndarray:
    """Hash of a document key and its occurrence number in the shard."""
    return mix(mix(keys.astype(np.int64).view(U) + U(seed) * U(0x9E3779B97F4A7C15)) ^ repeats.astype(U))


def _slots(h: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    return (mix(h ^ (d.astype(U) * U(0xD6E8FEB86659FD93))) % U(n)).astype(np.int64)


def build_index(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacements by bucket and slot by key: a minimal perfect hash of distinct hashes.

    Buckets are placed from the largest down; a bucket with one key names its
    slot directly, with the top bit set.
    """
    n = len(h)
    buckets = max(1, -(-n // BUCKET_KEYS))
    of = ((h >> U(33)) % U(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    size = np.bincount(of, minlength=buckets)
    begin = np.cumsum(size) - size
    displace, slot, taken = np.zeros(buckets, np.uint32), np.zeros(n, np.int64), np.zeros(n, bool)
    by_size = np.argsort(-size, kind="stable")
    tries = np.arange(1, 65)
    for b in by_size[: int((size > 1).sum())].tolist():
        own = order[begin[b] : begin[b] + size[b]]
        at = 0
        while True:
            s = _slots(h[own][None, :], (tries + at)[:, None], n)
            free = ~taken[s].any(1)
            if size[b] > 1:
                sorted_s = np.sort(s, 1)
                free &= (sorted_s[:, 1:] != sorted_s[:, :-1]).all(1)
            if free.any():
                k = int(free.argmax())
                displace[b] = tries[k] + at
                slot[own] = s[k]
                taken[s[k]] = True
                break
            at += 64
            if at > 1 << 24:
                raise ValueError("equal key hashes")
    single = by_size[int((size > 1).sum()) : int((size > 0).sum())]
    left = np.flatnonzero(~taken)[: len(single)]
    displace[single] = _DIRECT | left
    slot[order[begin[single]]] = left
    return displace, slot


def shard_bytes(keys: np.ndarray, payloads: list[bytes], width: int) -> bytes:
    """A whole shard file from document keys and their ids as 32-bit bytes."""
    n = len(keys)
    sizes = np.fromiter(map(len, payloads), np.int64, n) // 4
    begin = np.concatenate(([0], np.cumsum(sizes))).astype("<i8")
    change = np.concatenate(([True], keys[1:] != keys[:-1])) if n else np.zeros(0, bool)
    run = np.maximum.accumulate(np.where(change, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    repeats = np.arange(n) - run
    seed = 1
    while len(np.unique(h := key_hash(keys, repeats, seed))) < n:
        seed += 1
    displace, slot = build_index(h)
    finger, rank = np.zeros(n, "<u4"), np.zeros(n, "<u4")
    finger[slot] = (h & U(0xFFFFFFFF)).astype("<u4")
    rank[slot] = np.arange(n)
    ids = np.frombuffer(b"".join(payloads), "<u4").astype(f"<u{width}")
    parts = {"keys": keys.astype("<i8"), "displace": displace.astype("<u4"), "finger": finger, "rank": rank, "begin": begin, "ids": ids}
    at, sections = 0, {}
    for name, x in parts.items():
        sections[name] = [at, x.nbytes]
        at += x.nbytes
    header = json.dumps({"n": n, "seed": seed, "width": width, "sections": sections}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(header)), header, *(x.tobytes() for x in parts.values())])


class ShardFile:
    """Keyed access to the ids of one shard file, of which it reads a few bytes for each key."""

    def __init__(self, file: pa.NativeFile):
        self.file = file
        magic, (size,) = file.read(8), struct.unpack("<I", file.read(4))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.header, self.base = json.loads(file.read(size)), 12 + size

    def _at(self, name: str, kind: str, first: int, count: int = 1) -> np.ndarray:
        width = int(kind[2:])
        self.file.seek(self.base + self.header["sections"][name][0] + first * width)
        return np.frombuffer(self.file.read(count * width), kind)

    def number(self, key: int, repeat: int = 0) -> int | None:
        """Number of the document with this key, the ``repeat``-th of equal ones; None if there is none."""
        n = self.header["n"]
        if not n:
            return None
        h = key_hash(np.array([key], np.int64), np.array([repeat]), self.header["seed"])
        d = self._at("displace", "<u4", int((h[0] >> U(33)) % U(self.header["sections"]["displace"][1] // 4)))
        slot = int(d[0]) & (_DIRECT - 1) if int(d[0]) & _DIRECT else int(_slots(h, d, n)[0])
        if self._at("finger", "<u4", slot)[0] != h[0] & U(0xFFFFFFFF):
            return None
        number = int(self._at("rank", "<u4", slot)[0])
        return number if self._at("keys", "<i8", number)[0] == key else None

    def count(self, key: int) -> int:
        """Documents with this key, which stand together."""
        first = self.number(key)
        if first is None:
            return 0
        low, high = first, self.header["n"]
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self._at("keys", "<i8", middle)[0] == key else (low, middle)
        return low - first + 1

    def ids_of(self, number: int) -> np.ndarray:
        """Ids of a document as unsigned 32-bit integers."""
        begin, end = self._at("begin", "<i8", number, 2).tolist()
        return self._at("ids", f"<u{self.header['width']}", begin, end - begin).astype("<u4")


def ids_of_key(manifest: DataFrame, folder: str, key: int, repeat: int = 0) -> np.ndarray | None:
    """Ids of one document: the manifest's key ranges name its shard, the shard's index the place.

    Documents with equal keys may go on in the next shard.  None if there is no such document.
    """
    fs, root = _store(folder)
    named = manifest.where(F.lit(key).between(F.col("first_key"), F.col("last_key")))
    for row in named.orderBy("part", "seq").select("file").toLocalIterator():
        with fs.open_input_file(f"{root}/{row['file']}") as f:
            shard = ShardFile(f)
            if repeat < (count := shard.count(key)):
                return shard.ids_of(shard.number(key, repeat))
            repeat -= count
    return None


class TokenShard:
    """Keyed access to the raw ids of one shard that is in memory as a whole."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a token shard")
        (size,) = struct.unpack_from("<I", raw, 8)
        self.header = json.loads(raw[12 : 12 + size])
        kinds = {"keys": "<i8", "displace": "<u4", "finger": "<u4", "rank": "<u4", "begin": "<i8", "ids": f"<u{self.header['width']}"}
        for name, (at, length) in self.header["sections"].items():
            setattr(self, name, np.frombuffer(raw, kinds[name], length // int(kinds[name][2:]), 12 + size + at))

    def find(self, keys: np.ndarray, repeats: np.ndarray) -> np.ndarray:
        """Document numbers of keys in constant time each; -1 where the fingerprint differs."""
        if not self.header["n"]:
            return np.full(len(keys), -1, np.int64)
        h = key_hash(keys, repeats, self.header["seed"])
        d = self.displace[((h >> U(33)) % U(len(self.displace))).astype(np.int64)]
        slot = np.where(d & U(_DIRECT), (d & (_DIRECT - 1)).astype(np.int64), _slots(h, d, self.header["n"]))
        return np.where(self.finger[slot] == (h & U(0xFFFFFFFF)), self.rank[slot].astype(np.int64), -1)

    def ids_of(self, number: int) -> np.ndarray:
        """Ids of a document as unsigned 32-bit integers."""
        return self.ids[self.begin[number] : self.begin[number + 1]].astype("<u4")


def _store(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" in uri or uri.startswith("file:"):
        fs, path = pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri[5:]}")
        return fs, path
    return pafs.LocalFileSystem(), uri


def write_token_shards(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all rows and write shards in ascending key order; return the manifest.

    The manifest, ``part, seq, file, n_docs, n_ids, first_key, last_key, base``,
    names the files of the attempts that counted: a lost or repeated task leaves at most a file
    that no manifest names.  Null texts are empty, null keys come first as key
    -2**63, rows with equal keys follow each other by text and are found by
    occurrence number.  An empty table gives an empty manifest.
    """
    parts = max(8, math.ceil((plan_bytes(docs, text_col) / RANGE_BYTES) ** RANGE_POWER))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        width = 2 if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        tail = np.array([end_id], "<u4").tobytes()
        fs, root = _store(folder)
        fs.create_dir(root, recursive=True)
        keys: list[int] = []
        payloads: list[bytes] = []
        held, part, seq = 0, None, 0

        def close() -> pa.RecordBatch:
            name = f"shard-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.tok"
            raw = shard_bytes(np.array(keys, np.int64), payloads, width)
            with fs.open_output_stream(f"{root}/{name}") as out:
                out.write(raw)
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "file": name, "n_docs": len(keys), "n_ids": held, "first_key": keys[0], "last_key": keys[-1]}], schema=manifest)

        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                piece = batch.slice(low, 1000)
                part = piece.column(2)[0].as_py()
                for key, ids in zip(piece.column(0).to_pylist(), enc.encode(piece.column(1).to_pylist())):
                    keys.append(-(1 << 63) if key is None else key)
                    payloads.append(ids + tail)
                    held += len(ids) // 4 + 1
                if held >= SHARD_IDS:
                    yield close()
                    keys, payloads, held, seq = [], [], 0, seq + 1
        if keys:
            yield close()

    manifest = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), *[(c, pa.int64()) for c in ("n_docs", "n_ids", "first_key", "last_key")]])
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = source.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())
    written = materialize(ordered.mapInArrow(lean(write), "part int, seq int, file string, n_docs long, n_ids long, first_key long, last_key long"), "shards")
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumn("base", F.coalesce(F.sum("n_ids").over(order), F.lit(0)))


def read_token_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """Look every key of every shard up through its index and digest its ids.

    Returns ``doc_id, start, n_tokens, ids_crc32``.  A key that the index does
    not find, or finds at another place, is an error.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _store(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{root}/{row['file']}") as f:
                    shard = TokenShard(f.read())
                keys, n = shard.keys, shard.header["n"]
                run = np.maximum.accumulate(np.where(np.concatenate(([True], keys[1:] != keys[:-1])), np.arange(n), 0))
                number = shard.find(keys, np.arange(n) - run)
                if (number != np.arange(n)).any():
                    raise ValueError(f"index of {row['file']} is damaged")
                crc = [zlib.crc32(shard.ids_of(k).tobytes()) for k in number.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, mask=keys == -(1 << 63)), pa.array(shard.begin[number] + row["base"]), pa.array(shard.begin[number + 1] - shard.begin[number]), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    files = manifest.select("file", "base").repartition(max(8, math.ceil(manifest.count() ** RANGE_POWER * 2)))
    return files.mapInArrow(lean(read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_id_output(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all rows as token shards in the shared folder and read them back."""
    folder = new_path(spark, "token-ids")
    return read_token_shards(write_token_shards(docs, folder, tokenizer_path, end_id, id_col, text_col), folder)
