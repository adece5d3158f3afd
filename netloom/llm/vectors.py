"""Exact top-k search and exact near-duplicates on vectors, by pivots.

Pivots come from a bounded sample and only steer where rows go: every row is
assigned, every bound is computed from all rows, and results are exact for any
choice of pivots.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.spans import U, mix
from netloom.operators.components import connected_components
from netloom.plans.shared import materialize

#: Most pivots (a broadcast of at most 2 MB at 64 components), queries solved together, data rows in one block.
MOST_PIVOTS, QUERY_BLOCK, DATA_BLOCK = 4096, 1024, 8192
#: Classes of vectors for each pivot of the range join, and its fewest pivots.
PIVOT_ROWS, LEAST_PIVOTS = 2048, 8
#: Double sums of integers up to here are exact.
_EXACT = float(1 << 53)


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    n = len(column)
    flat = np.frombuffer(b"".join(column.to_pylist()), kind)
    return flat.reshape(n, -1) if n else flat.reshape(0, 1)


def usable(vector: str) -> str:
    """SQL condition: not null, not empty, no null and no non-finite component."""
    return f"{vector} is not null and size({vector}) > 0 and forall({vector}, x -> x is not null and not isnan(x) and abs(cast(x as double)) < double('Infinity'))"


def _pivots(rows: DataFrame, key: str, vector: str, kind: str, count: int) -> np.ndarray:
    """Vectors of the ``count`` rows with the smallest key hashes."""
    sample = rows.select(vector, F.xxhash64(key, F.lit(7)).alias("h")).orderBy("h").limit(count).collect()
    found = [np.frombuffer(bytes(r[vector]), kind).astype(float) for r in sample]
    return np.unique(np.stack(found), axis=0) if found else np.zeros((0, 1))


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def exact_top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int | None = None) -> DataFrame:
    """The ``k`` largest integer inner products of every query with all other rows.

    Components become floor(scale * x).  Queries are the rows whose id is
    divisible by ``every``, grouped by nearest pivot.  With q in group i,
    |q - p_i| <= R_i and any row x, the product lies within p_i.x +- R_i |x|.  Each
    task sums its rows up in the k + 1 largest lower bounds of each group; from
    all of them follows a bound that k products of every query in the group
    reach, and x goes to group i only if p_i.x + R_i |x| reaches it.  There is
    one pivot for each ``QUERY_BLOCK`` queries, so that what no bound can save
    is sent as often as there are blocks of queries.

    Returns ``query_id, rank, vec_id, score``, ties to the smaller id.  Rows with
    a null id and with null, empty or non-finite vectors take no part; vectors of
    different lengths have no product, so each length is searched on its own,
    those other than the queries' most frequent one without pivots.  A query never
    meets rows of its own id; rows with equal ids are candidates each, and as
    queries their products compete for one list; with fewer rows than ``k`` all are
    returned; an empty table gives an empty result.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id is not null").where(usable("v"))
    rows = rows.select("id", F.transform("v", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))

    def to_binary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.array(v, "<i8").tobytes() for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["id", "v"])

    ints = materialize(rows.mapInArrow(to_binary, "id long, v binary"), "topk")
    queries = ints.where(F.col("id") % every == 0)
    asked = {r["width"]: r["count"] for r in queries.groupBy(F.octet_length("v").alias("width")).count().collect()}
    width = max(asked, key=lambda w: (asked[w], -w), default=8)
    usual = F.octet_length("v") == width
    count = min(MOST_PIVOTS, -(-asked.get(width, 0) // QUERY_BLOCK)) if pivots is None else pivots
    p = _pivots(queries.where(usual), "id", "v", "<i8", count)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _distances(_matrix(batch.column(1), "<i8").astype(float), p)
            home = d.argmin(1)
            yield pa.RecordBatch.from_arrays([pa.array(home, pa.int32()), pa.array(d[np.arange(len(home)), home])], ["cell", "d"])

    groups = queries.where(usual).mapInArrow(measure, "cell int, d double").groupBy("cell").agg(F.max("d").alias("radius"), F.count("*").alias("n")).collect()
    radius = np.zeros(len(p))
    for r in groups:
        radius[r["cell"]] = r["radius"]

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((k + 1, len(p)), -np.inf)
        for batch in batches:
            x = _matrix(batch.column(1), "<i8").astype(float)
            best = np.sort(np.concatenate((best, x @ p.T - np.sqrt((x * x).sum(1))[:, None] * radius)), axis=0)[-k - 1 :]
        yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(len(p), dtype=np.int32), k + 1)), pa.array(best.ravel())], ["cell", "low"])

    least = np.full(len(p), -np.inf)
    # The query itself is one of the rows behind these bounds, so the one after the k-th counts.
    ranked = ints.where(usual).mapInArrow(bounds, "cell int, low double").withColumn("r", F.row_number().over(_window("cell", F.desc("low"))))
    for r in ranked.where(F.col("r") == k + 1).collect():
        least[r["cell"]] = r["low"] - 1e-6 * (1 + abs(r["low"]))
    blocks = {r["cell"]: -(-r["n"] // QUERY_BLOCK) for r in groups} | {-w: -(-n // QUERY_BLOCK) for w, n in asked.items() if w != width}
    chunks = max(1, -(-ints.count() // DATA_BLOCK))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["cell", "block", "chunk", "asks", "id", "v"]

        def rows_of(part: pa.RecordBatch, at: np.ndarray, cell: np.ndarray, block: np.ndarray, chunk: np.ndarray, asks: bool) -> pa.RecordBatch:
            taken = part.take(pa.array(at))
            return pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int32)) for x in (cell, block, chunk)), pa.array(np.full(len(at), asks)), *taken.columns], names)

        for batch in batches:
            sizes = np.fromiter(map(len, batch.column(1).to_pylist()), np.int64, batch.num_rows)
            for size in np.unique(sizes).tolist():
                part = batch.take(pa.array(np.flatnonzero(sizes == size)))
                ids = part.column(0).to_numpy()
                chunk = (mix(ids.view(U)) % U(chunks)).astype(np.int64)
                if size == width and len(p):
                    x = _matrix(part.column(1), "<i8").astype(float)
                    high = x @ p.T + np.sqrt((x * x).sum(1))[:, None] * radius
                    home, groups_of = _distances(x, p).argmin(1), [(c, np.flatnonzero(high[:, c] + 1e-6 * (1 + np.abs(high[:, c])) >= least[c])) for c in range(len(p)) if c in blocks]
                else:
                    home, groups_of = np.full(len(ids), -size), [(-size, np.arange(len(ids)))] if -size in blocks else []
                for c, at in groups_of:
                    for b in range(blocks[c]):
                        yield rows_of(part, at, np.full(len(at), c), np.full(len(at), b), chunk[at], False)
                at = np.flatnonzero(ids % every == 0)
                if len(at):
                    block = (mix(ids[at].view(U) + U(1)) % np.array([blocks[c] for c in home[at].tolist()], U)).astype(np.int64)
                    for c in range(chunks):
                        yield rows_of(part, at, home[at], block, np.full(len(at), c), True)

    def solve(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        ids, x = table.column("id").to_numpy(), _matrix(table.column("v").combine_chunks(), "<i8")
        q_ids, q, d_ids, d = ids[asks], x[asks], ids[~asks], x[~asks]
        out = []
        if len(q_ids) and len(d_ids):
            order = np.argsort(d_ids, kind="stable")
            d_ids, d = d_ids[order], d[order]
            small = float(abs(q).max()) * float(abs(d).max()) * q.shape[1] < _EXACT
            for low in range(0, len(q), 256):
                part = q[low : low + 256]
                scores = (part.astype(float) @ d.T.astype(float)).astype(np.int64) if small else part @ d.T
                for row, own in zip(scores, q_ids[low : low + 256].tolist()):
                    other = np.flatnonzero(d_ids != own)
                    s = row[other]
                    if len(s) > k:
                        lowest = np.partition(s, len(s) - k)[len(s) - k]
                        other, s = other[s >= lowest], s[s >= lowest]
                    best = np.argsort(-s, kind="stable")[:k]
                    out.extend((own, v, int(w)) for v, w in zip(d_ids[other[best]].tolist(), s[best].tolist()))
        return pa.table({"query_id": pa.array([o[0] for o in out], pa.int64()), "vec_id": pa.array([o[1] for o in out], pa.int64()), "score": pa.array([o[2] for o in out], pa.int64())})

    dealt = ints.mapInArrow(deal, "cell int, block int, chunk int, asks boolean, id long, v binary")
    local = dealt.groupBy("cell", "block", "chunk").applyInArrow(solve, "query_id long, vec_id long, score long")
    rank = F.row_number().over(_window("query_id", F.desc("score"), "vec_id"))
    return local.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _window(key: str, *order):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(*order)


def near_duplicate_vectors(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", pivots: int | None = None) -> DataFrame:
    """Exact metric range join: links of vectors with equal labels and cosine >= ``least``.

    Equal vectors of a label are one class with a count.  On unit vectors the
    cosine bound is a distance r.  A class belongs to the cell of its nearest
    pivot p_i, and is replicated to cell j < i only if it lies within r of the
    plane between both, d(x, p_j)^2 - d(x, p_i)^2 <= 2 r d(p_i, p_j), which by the
    triangle inequality holds for every pair across the two cells.  Cells are
    joined in blocks by matrix products; each gives counts and a spanning forest.

    Returns ``vec_id, n_links, component_id, kept`` for every row.  Rows with a
    null label, and null, empty, zero or non-finite vectors, link with nothing;
    vectors of different lengths never link; rows with equal ids and vectors
    are separate vectors that link with each other; rows with equal ids and other
    vectors share the links and the component of their id.  A row with a null id
    links with nothing, has no component and is kept.  An empty table gives an
    empty result.
    """
    reach = float(np.sqrt(max(2 - 2 * least, 0.0))) + 1e-9
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    good = f"label is not null and id is not null and {usable('v')} and exists(v, x -> x <> 0)"
    rows = rows.withColumn("good", F.coalesce(F.expr(good), F.lit(False)))
    kind = "array<double>"
    exact = F.col("v").cast(kind)
    rows = materialize(
        rows.select("id", "label", "good", exact.alias("v"), F.when(F.col("good"), F.xxhash64(exact)).alias("h1"), F.when(F.col("good"), F.xxhash64(F.lit(1), F.size("v"), exact)).alias("h2")), "near"
    )
    same = ["label", "h1", "h2"]
    classes = rows.where("good").groupBy(*same).agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v"))

    def to_binary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.array(v, "<f8").tobytes() for v in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(raw, pa.binary())], [*same, "rep", "copies", "raw"])

    def units(raw: np.ndarray) -> np.ndarray:
        """Rows of length 1; scaled by their largest component first, so squares neither overflow nor vanish."""
        scaled = raw / np.abs(raw).max(1, keepdims=True)
        return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))

    label_kind = rows.schema["label"].dataType.simpleString()
    vectors = materialize(classes.mapInArrow(to_binary, f"label {label_kind}, h1 long, h2 long, rep long, copies long, raw binary"), "near")
    length = F.length("raw")
    usual = vectors.groupBy(length.alias("n")).count().orderBy(F.desc("count"), "n").first()
    width = usual["n"] if usual else 8
    count = min(MOST_PIVOTS, max(LEAST_PIVOTS, -(-(usual["count"] if usual else 0) // PIVOT_ROWS))) if pivots is None else pivots
    centers = _pivots(vectors.where(length == width), "rep", "raw", "<f8", count)
    centers = units(centers) if len(centers) else centers
    apart = _distances(centers, centers)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["label", "cell", "home", "rep", "copies", "raw"]
        for batch in batches:
            sizes = np.fromiter(map(len, batch.column(5).to_pylist()), np.int64, batch.num_rows)
            for size in np.unique(sizes).tolist():
                part = batch.take(pa.array(np.flatnonzero(sizes == size)))
                n = part.num_rows
                if size == width:
                    d = _distances(units(_matrix(part.column(5), "<f8")), centers)
                    own = d.argmin(1)
                    near = d[np.arange(n), own]
                    sends = (d * d - (near * near)[:, None] <= 2 * reach * apart[own] + 1e-9) & (np.arange(len(centers))[None, :] <= own[:, None])
                    at, cell = np.nonzero(sends)
                    home = cell == own[at]
                else:
                    at, cell, home = np.arange(n), np.full(n, -size), np.ones(n, bool)
                t = pa.array(at)
                yield pa.RecordBatch.from_arrays([part.column(0).take(t), pa.array(cell, pa.int32()), pa.array(home), *(part.column(c).take(t) for c in (3, 4, 5))], names)

    dealt = vectors.mapInArrow(deal, f"label {label_kind}, cell int, home boolean, rep long, copies long, raw binary")
    dealt = materialize(dealt, "near")
    filled = dealt.groupBy("label", "cell").agg(F.count("*").alias("n"), F.sum(F.col("home").cast("int")).alias("homes")).where("homes > 0")
    filled = filled.select("label", "cell", F.ceil(F.col("n") / DATA_BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    spread = (
        dealt.join(filled, ["label", "cell"])
        .withColumn("own", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("own", "other"))
        .withColumn("high", F.greatest("own", "other"))
    )

    def solve(table: pa.Table) -> pa.Table:
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        rep, copies, home = (table.column(c).to_numpy() for c in ("rep", "copies", "home"))
        raw = _matrix(table.column("raw").combine_chunks(), "<f8")
        unit = units(raw)
        own = table.column("own").to_numpy()
        left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
        links = np.zeros(len(rep), np.int64)
        label = np.arange(len(rep))

        def join(x: np.ndarray, y: np.ndarray) -> None:
            """Give linked rows one label, the smallest of their components so far."""
            nonlocal label
            while len(x):
                a, b = label[x], label[y]
                open_ = a != b
                x, y, a, b = x[open_], y[open_], a[open_], b[open_]
                np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
                while (label[label] != label).any():
                    label = label[label]

        for at in range(0, len(left), 512):
            a = left[at : at + 512]
            cosine = unit[a] @ unit[right].T
            allowed = home[a][:, None] | home[right][None, :]
            if low == high:
                allowed &= a[:, None] < right[None, :]
            x, y = np.nonzero((cosine >= least - 1e-9) & allowed)
            x_at, y_at, c = a[x], right[y], cosine[x, y]
            for e in np.flatnonzero(c < least + 1e-9).tolist():
                u, v = raw[x_at[e]], raw[y_at[e]]
                c[e] = np.dot(u, v) / (np.sqrt(np.dot(u, u)) * np.sqrt(np.dot(v, v)))
            linked = c >= least
            x_at, y_at = x_at[linked], y_at[linked]
            np.add.at(links, x_at, copies[y_at])
            np.add.at(links, y_at, copies[x_at])
            join(x_at, y_at)
        some, moved = np.flatnonzero(links), np.flatnonzero(label != np.arange(len(rep)))
        src, dst = rep[moved].tolist(), rep[label[moved]].tolist()
        return pa.table(
            {
                "rep": pa.array([*rep[some].tolist(), *src], pa.int64()),
                "links": pa.array([*links[some].tolist(), *[None] * len(src)], pa.int64()),
                "other": pa.array([None] * len(some) + dst, pa.int64()),
            }
        )

    solved = materialize(spread.groupBy("label", "cell", "low", "high").applyInArrow(solve, "rep long, links long, other long"), "near")
    parts = connected_components(solved.where("other is not null"), "rep", "other")
    counts = solved.where("links is not null").groupBy("rep").agg(F.sum("links").alias("links"))
    members = vectors.select(*same, "rep", "copies").join(counts, "rep", "left").join(parts.withColumnRenamed("vertex", "rep"), "rep", "left")
    members = members.select(*[F.col(c).alias(f"m_{c}") for c in same], F.coalesce("links", F.lit(0)).alias("links"), "copies", F.coalesce("component", "rep").alias("component"))
    joined = rows.drop("v").join(members, (F.col("label") == F.col("m_label")) & (F.col("h1") == F.col("m_h1")) & (F.col("h2") == F.col("m_h2")), "left")
    component = F.coalesce("component", "id")
    return joined.select(
        F.col("id").alias("vec_id"), F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )
