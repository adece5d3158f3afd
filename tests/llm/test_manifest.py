"""Merkle manifests, whitening and prefix encoding against plain Python, numpy and the library."""

from __future__ import annotations

import hashlib
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from netloom.llm import merkle, prefix_bpe, queries, whitening

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
ROWS = "doc_id long, source string, lang string, n_chars long, text string, place long, g string"
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree_of(row):
    out = [row]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(tree, at):
    out = []
    for level in tree[:-1]:
        other = at ^ 1
        out.append(("l" if at & 1 else "r") + level[other] if other < len(level) else "")
        at >>= 1
    return out


def leaf_of(row, more=0):
    row = [*row[:3], None if row[3] is None else row[3] + more, row[4]]
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[g] = tree_of([leaf_of(r) for r in groups[g]])
    last = tree_of([trees[g][-1][0] for g in order])
    return sorted((str(r[0]), leaf_of(r), trees[g][-1][0], last[-1][0], siblings(trees[g], i) + siblings(last, k)) for k, g in enumerate(order) for i, r in enumerate(groups[g]))


def awkward(rng, n, langs=("en", "en", "en", "de", None, "zz", "é")):
    """A third of the rows share one id, some of them wholly; ids, languages, counts and texts may be null."""
    return [(rng.choice([i, i, i, 7, 7, None]), "s", rng.choice(langs), rng.choice([None, 5]), rng.choice(["x", "", "é" * (i % 9), None]), 1, "g") for i in range(n)]


@pytest.mark.parametrize(("levels", "height", "n"), [(9, 3, 700), (2, 1, 60), (3, 2, 300), (9, 3, 1), (4, 3, 2)])
def test_manifest(spark, levels, height, n):
    rows = awkward(random.Random(levels), n)
    df = spark.createDataFrame(rows, ROWS)
    got = merkle.merkle_manifest(df, FIELDS, changes={"n_chars": F.col("n_chars") + 1}, changed=F.col("doc_id") % 7 == 0, levels=levels, height=height)
    got = got.withColumns({"kept": merkle.folded(F.col("leaf"), F.col("proof")), "other": merkle.folded(F.col("presented"), F.col("proof")), "sha": merkle.proof_digest(F.col("proof"))}).collect()
    assert sorted((str(r.id), r.leaf, r.subroot, r.root, r.proof) for r in got) == manifest([r[:5] for r in rows])
    assert all(r.kept == r.root for r in got) and all((r.other == r.root) == (r.presented == r.leaf) for r in got)
    assert all(r.sha == digest(*(s[1:] for s in r.proof)) for r in got)
    assert {r.presented for r in got if r.presented != r.leaf} == {leaf_of(r, 1) for r in rows if r[0] is not None and r[0] % 7 == 0 and r[3] is not None}


def test_manifest_of_many_groups(spark):
    """Each row its own group: the tree over the groups has several levels of blocks."""
    rows = [(i, None, f"g{i % 40}", i, "t") for i in range(45)]
    got = merkle.merkle_manifest(spark.createDataFrame([(*r, 1, "g") for r in rows], ROWS), FIELDS, levels=2, height=1).collect()
    assert sorted((str(r.id), r.leaf, r.subroot, r.root, r.proof) for r in got) == manifest(rows)
    assert all(r.presented == r.leaf for r in got)


def test_manifest_without_rows(spark):
    assert merkle.merkle_manifest(spark.createDataFrame([], ROWS), FIELDS).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 70), st.integers(1, 4))
def test_traversal(n, height):
    leaves = [digest(str(i)) for i in range(n)]
    tree = tree_of(leaves)
    got = list(merkle.authentication_paths([d.encode() for d in leaves], len(tree) - 1, height))
    assert [[s.decode() if s else None for s in path] for path in got] == [[s[1:] or None for s in siblings(tree, i)] for i in range(n)]


def test_traversal_holds_subtrees_only():
    """Memory beside the leaves is that of a few subtrees: far under the tree's 65,536 nodes of 97 bytes or more."""
    leaves = [digest(str(i)).encode() for i in range(1 << 15)]
    tracemalloc.start()
    paths = merkle.authentication_paths(leaves, 15, 3)
    next(paths), tracemalloc.reset_peak()
    for _ in paths:
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200_000


def test_manifest_query(spark):
    """The registered query against the whole small table."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*FIELDS).collect()
    want = {r[0]: r for r in manifest([tuple(r) for r in docs])}
    import zlib

    for r in queries.op11_merkle_manifest(spark, "/root/testdata/sf0.001").collect():
        _, leaf, subroot, root, path = want[str(r.doc_id)]
        assert (r.leaf, r.subroot, r.root, r.proof_sha256) == (leaf, subroot, root, digest(*(s[1:] for s in path)))
        assert r.verified == (r.folded_root == r.root) == (zlib.crc32(str(r.doc_id).encode()) % 7 != 0)


def whitened_by_numpy(vectors, most=32):
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors], np.int64)
    n, sums = len(x), x.sum(0)
    far = x * n - sums
    covariance = (far / n).T @ (far / n) / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    return n, (far * far).sum(1), far / n @ axes / np.sqrt(values), values / np.trace(covariance)


EMBEDDINGS = "vec_id long, embedding array<float>, label int, x int, id long, whitened double"


def embeddings(spark, vectors, ids=None):
    return spark.createDataFrame([(i, v, 1, 2, 3, 4.0) for i, v in zip(ids or range(len(vectors)), vectors)], EMBEDDINGS)


@pytest.mark.parametrize(("n", "width"), [(300, 6), (500, 40)])
def test_whitening(spark, n, width):
    rng = np.random.default_rng(n)
    # One direction far from the origin and of large spread, others small: products of what is not centred would cancel.
    vectors = (rng.normal(size=(n, width)) * np.linspace(0.5, 6, width) + np.array([900.0] + [0.0] * (width - 1))).astype(np.float32)
    listed = [*vectors.tolist(), None, [], [None, *[1.0] * (width - 1)], [float("nan")] * width, [float("inf")] * width]
    rows = whitening.whitened_vectors(embeddings(spark, listed)).orderBy("vec_id", "component").collect()
    count, deviation, white, explained = whitened_by_numpy(vectors)
    most = min(width, 32)
    assert [(r.vec_id, r.component) for r in rows] == [(i, c) for i in range(n) for c in range(1, most + 1)]
    assert {r.n for r in rows} == {count} and [r.deviation for r in rows[::most]] == deviation.tolist()
    got = np.array([r.whitened for r in rows]).reshape(n, most)
    signs = np.sign((got * white).sum(0))
    assert np.abs(got * signs - white).max() < 1e-9
    assert np.allclose([r.explained for r in rows[:most]], explained, rtol=1e-9) and {r.identity_error for r in rows if r.identity_error > 1e-9} == set()


def test_whitening_of_odd_tables(spark):
    assert whitening.whitened_vectors(embeddings(spark, [])).count() == 0 == whitening.whitened_vectors(embeddings(spark, [None, []])).count()
    # Equal vectors have no spread at all.
    rows = whitening.whitened_vectors(embeddings(spark, [[1.0, 2.0]] * 3, [5, 5, None])).collect()
    assert len(rows) == 6 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in rows} == {(3, 0, None, None, None)}
    # Two lengths are fitted apart; with fewer vectors than dimensions some components have no spread.
    rows = whitening.whitened_vectors(embeddings(spark, [[1.0, 2.0, 0.0], [2.0, 1.0, 0.0], [4.0], [6.0], [8.0]])).collect()
    short = sorted((r.vec_id, r.component, r.n, r.deviation, round(r.whitened, 9)) for r in rows if r.vec_id >= 2)
    assert short == [(2, 1, 3, 384**2, -1.224744871), (3, 1, 3, 0, 0.0), (4, 1, 3, 384**2, 1.224744871)]
    long = [r for r in rows if r.vec_id < 2]
    assert [r.whitened is None for r in sorted(long, key=lambda r: (r.vec_id, r.component))] == [False, True, True] * 2 and {r.identity_error < 1e-12 for r in long} == {True}


def test_whitening_of_large_numbers(spark):
    """Deviations beyond 64-bit products on the way are exact, those beyond 64 bits null."""
    rows = whitening.whitened_vectors(embeddings(spark, [[1e7], [3e7], [3e7]])).collect()
    x = [int(64 * c) for c in (1e7, 3e7, 3e7)]
    assert [r.deviation for r in sorted(rows, key=lambda r: r.vec_id)] == [d if d < 1 << 63 else None for d in ((3 * v - sum(x)) ** 2 for v in x)]
    rows = whitening.whitened_vectors(embeddings(spark, [[3e38], [-3e38]])).collect()
    assert {r.deviation for r in rows} == {None} and {abs(r.whitened) for r in rows} == {1.0}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE_BPE)


PARTS = ["a", "b", "e", "t", " ", "  ", "\n", "'s", "'", "'ve", "'ll", "1", "99", "é", "ß", "漢", "字", "😀", "<|endoftext|>", "<|endof", "\x1c", "​", "　", "\x85", "\xa0", "the", " the", "ing", "--", "====", "\t", "\r\n", "\0", "٣", "Ⅷ", "़", "́", "×"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=40))
def test_prefix_encoding_is_the_library(library, parts):
    text = "".join(parts)
    worker = prefix_bpe.prefix_encoder(BYTE_BPE)
    ids = np.frombuffer(worker.encode_bytes([text.encode()])[0], "<u4").tolist()
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert worker.table.decode(ids).decode() == library.decode(ids, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_prefix_encoding_of_any_text(library, text):
    worker = prefix_bpe.prefix_encoder(BYTE_BPE)
    assert np.frombuffer(worker.encode_bytes([text.encode()])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def merged(table, unit):
    """Ids of a pre-token by merging step by step, lowest rank and leftmost first."""
    ids = [table.content.index(bytes([b])) for b in unit]
    while True:
        pairs = [(table.merge.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(ids, ids[1:]))]
        rank, at = min(pairs, default=(1 << 60, 0))
        if rank == 1 << 60:
            return ids
        ids[at : at + 2] = [next(t for t in range(len(table.rank)) if table.rank[t] == rank)]


def test_every_prefix_ends_in_its_token():
    """The token stored for a prefix is the last of that prefix's own encoding."""
    table = prefix_bpe.prefix_encoder(BYTE_BPE).table
    for unit in (b" international", b"aaaaaaaaaaaa", b"======", "naïvetés".encode()):
        for end in range(1, len(unit) + 1):
            assert table.encode(unit[:end]) == merged(table, unit[:end])


def test_encode_and_decode(spark, library):
    rng = random.Random(2)
    long = "".join(rng.choice("etaoin shrdlu") for _ in range(300_000))
    texts = [None, "", " ", "x", "x" * 200_000, long, "a<|endoftext|>b", "é漢😀", "same", "same"]
    rows = [(None if i == 9 else i, t, "ids", "decoded") for i, t in enumerate(texts)]
    found = prefix_bpe.encode_and_decode(spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded string"), BYTE_BPE).collect()
    assert sorted(map(str, [(r.doc_id, r.ids, r.decoded) for r in found])) == sorted(str((i, library.encode(t or "", add_special_tokens=False).ids, t or "")) for i, t, _, _ in rows)
    assert prefix_bpe.encode_and_decode(spark.createDataFrame([], "doc_id string, text string"), BYTE_BPE).count() == 0
    raw = spark.sql("select 1 as doc_id, cast(x'61FF62' as string) as text")
    assert [r.decoded for r in prefix_bpe.encode_and_decode(raw, BYTE_BPE).collect()] == ["a�b"]
    with pytest.raises(ValueError):
        prefix_bpe.PrefixTable(public_tokenizers.path("word_bpe_49k.json"))


def test_encoding_query(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in queries.op13_bpe_encoding(spark, "/root/testdata/sf0.001").collect():
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False)))
