"""Language identification with hyperdimensional profiles.

Each letter symbol has a random vector of -1 and 1.  A trigram's vector binds
(multiplies) its letters' vectors, each permuted once more for every place to
the right that follows it; a text's profile bundles (sums) the vectors of its
trigrams.  A prototype is the bundle of a language's training texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from netloom.llm.spans import lean
from netloom.plans.shared import quoted

#: Symbols (0 is every run of non-letters), dimensions, seed of the letter vectors.
SYMBOLS, DIMENSIONS, SEED = 64, 1024, 20_011
UNDETERMINED = "und"
#: Texts whose profiles are made together.
BLOCK_TEXTS = 256
#: Languages whose counts (2 MB each) a task holds at a time.
HELD_LANGUAGES = 32


def _symbol_table() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        if ch.isalpha():
            low = ord(ch.lower()[0])
            table[c] = low - 96 if 97 <= low <= 122 else 27 + low % (SYMBOLS - 27)
    return table


_TABLE: list[np.ndarray] = []


def _symbols(text: str) -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_symbol_table())
    return _TABLE[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]


def trigram_codes(text: str | None) -> np.ndarray:
    """Codes of the trigrams of a text, blanks at both ends, runs of non-letters as one."""
    if not text:
        return np.zeros(0, np.int64)
    s = _symbols(text)
    s = np.concatenate((np.zeros(1, np.uint8), s, np.zeros(1, np.uint8)))
    s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))].astype(np.int64)
    if len(s) < 3:
        return np.zeros(0, np.int64)
    return (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]


def letter_vectors(dimensions: int = DIMENSIONS) -> np.ndarray:
    """The three permuted copies of the letter vectors, by place and symbol."""
    rng = np.random.default_rng(SEED)
    base = rng.integers(0, 2, (SYMBOLS, dimensions), np.int8) * 2 - 1
    step = rng.permutation(dimensions)
    return np.stack([base[:, step][:, step], base[:, step], base])


def trigram_vectors(codes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Bound vectors of trigram codes."""
    a, b, c = codes // (SYMBOLS * SYMBOLS), codes // SYMBOLS % SYMBOLS, codes % SYMBOLS
    return letters[0][a] * letters[1][b] * letters[2][c]


def profiles(texts: list[str | None], letters: np.ndarray) -> np.ndarray:
    """Bundles of the texts, one row each; zero for texts without letters."""
    codes = [trigram_codes(t) for t in texts]
    sizes = np.fromiter(map(len, codes), np.int64, len(codes))
    out = np.zeros((len(texts), letters.shape[2]), np.float32)
    if not sizes.sum():
        return out
    flat = np.concatenate(codes)
    seen = np.bincount(flat, minlength=SYMBOLS**3) > 0
    known = np.flatnonzero(seen)
    number = np.cumsum(seen) - 1
    for low in range(0, len(known), 4096):
        part = known[low : low + 4096]
        mine = np.repeat(np.arange(len(texts)), sizes) * len(part) + number[flat] - low
        inside = (number[flat] >= low) & (number[flat] < low + len(part))
        counts = np.bincount(mine[inside], minlength=len(texts) * len(part)).reshape(len(texts), len(part))
        out += counts.astype(np.float32) @ trigram_vectors(part, letters).astype(np.float32)
    return out


def train_prototypes(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text") -> dict[str, np.ndarray]:
    """Prototype of each language from all rows of ``labelled``.

    Tasks count trigrams, and the counts of each language are summed by
    trigram; a language then has at most one row for each of the 2 ** 18
    trigrams, whatever its share of the texts, and one vector of it goes to the
    driver.  Rows with a null language or text teach nothing.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}

        def rows() -> pa.RecordBatch:
            at = [np.flatnonzero(t) for t in totals.values()]
            langs = pa.array(list(totals), pa.string()).take(pa.array(np.repeat(np.arange(len(at)), list(map(len, at)))))
            codes = np.concatenate(at or [np.zeros(0, np.int64)]).astype(np.int32)
            counts = np.concatenate([t[a] for t, a in zip(totals.values(), at)] or [np.zeros(0, np.int64)])
            return pa.RecordBatch.from_arrays([langs, pa.array(codes), pa.array(counts)], ["lang", "code", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                codes = trigram_codes(text.as_py())
                if lang not in totals:
                    if len(totals) == HELD_LANGUAGES:
                        yield rows()
                        totals.clear()
                    totals[lang] = np.zeros(SYMBOLS**3, np.int64)
                if len(codes) > 20_000:
                    totals[lang] += np.bincount(codes, minlength=SYMBOLS**3)
                elif len(codes):
                    np.add.at(totals[lang], codes, 1)
        yield rows()

    def bundle(table: pa.Table) -> pa.Table:
        codes, counts = table.column("code").to_numpy(), table.column("n").to_numpy()
        letters, out = letter_vectors(), np.zeros(DIMENSIONS)
        # In one order, so that sums of doubles do not depend on the shuffle.
        order = np.argsort(codes)
        for low in range(0, len(order), 4096):
            part = order[low : low + 4096]
            out += counts[part].astype(float) @ trigram_vectors(codes[part], letters).astype(float)
        return pa.table({"lang": [table.column("lang")[0].as_py()], "vector": [out.tobytes()]})

    source = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    sums = source.mapInArrow(lean(count), "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    vectors = {r["lang"]: np.frombuffer(bytes(r["vector"])) for r in sums.groupBy("lang").applyInArrow(bundle, "lang string, vector binary").collect()}
    return {k: v / n for k, v in sorted(vectors.items()) if (n := np.linalg.norm(v))}


def identify_language(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Add ``lang_pred`` and ``score``, or columns of other ``names``, to ``docs`` (or to its columns ``keep``).

    The prediction is the language whose prototype has the largest cosine with
    the text's profile, ties to the smaller name; ``score`` is that cosine, 0
    at least.  A null text, one without letters, and every text when there are
    no prototypes are ``und`` with score 0.  Columns that have the new names
    already give way to them.  Nothing is shuffled.
    """
    known_as = list(prototypes)
    matrix = np.stack([prototypes[n] for n in known_as]).astype(np.float32) if known_as else np.zeros((0, DIMENSIONS), np.float32)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_vectors()
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK_TEXTS):
                part = batch.slice(low, BLOCK_TEXTS)
                bundles = profiles(part.column(part.num_columns - 1).to_pylist(), letters)
                norms = np.linalg.norm(bundles, axis=1)
                known = (norms > 0) & bool(known_as)
                cosine = bundles @ matrix.T / np.maximum(norms, 1e-9)[:, None]
                best = cosine.argmax(1) if known_as else np.zeros(len(norms), np.int64)
                lang = [known_as[b] if k else UNDETERMINED for b, k in zip(best.tolist(), known.tolist())]
                top = cosine.max(1) if known_as else np.zeros(len(norms))
                score = np.where(known, np.clip(top, 0, 1), 0.0).astype(float)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(lang, pa.string()), pa.array(score)], plain)

    # Plain names on the way through, whatever the columns are called.
    plain = [f"c{i}" for i in range(len(keep) + 2)]
    schema = StructType([StructField(n, k) for n, k in zip(plain, [*(docs.schema[c].dataType for c in keep), StringType(), DoubleType()])])
    rows = docs.select(*[F.col(quoted(c)).alias(n) for c, n in zip(keep, plain)], F.col(quoted(text_col)).alias("text"))
    return rows.mapInArrow(lean(predict), schema).toDF(*keep, *names)


def held_out(id_col: str = "doc_id"):
    """Rows that never teach: crc32 of the key's text modulo 4 is 2; a null key is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
