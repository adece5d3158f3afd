"""License scan: Aho-Corasick for tags and phrases, shunting-yard for expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Base phrases and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Notice phrases of the method, by the label that they add.
NOTICE_PHRASES = {
    "permission is hereby granted free of charge": "notice:mit",
    "licensed under the apache license version 2 0": "notice:apache-2.0",
    "gnu general public license": "notice:gpl",
    "gnu lesser general public license": "notice:lgpl",
    "gnu affero general public license": "notice:agpl",
    "mozilla public license": "notice:mpl",
    "redistribution and use in source and binary forms": "notice:bsd",
    "creative commons attribution": "notice:cc-by",
    "released into the public domain": "notice:public-domain",
    "all rights reserved": "notice:all-rights-reserved",
}
# How freely text under a licence may be used, by the start of its identifier.
FREEDOM = {
    "0bsd": 1.0, "unlicense": 1.0, "cc0": 1.0, "mit": 1.0, "isc": 1.0, "bsd": 1.0, "apache": 1.0, "zlib": 1.0, "cc-by": 0.8,
    "mpl": 0.6, "epl": 0.6, "lgpl": 0.5, "cc-by-sa": 0.5, "gpl": 0.3, "agpl": 0.2, "cc-by-nc": 0.1,
}
UNKNOWN, RESERVED, NOTICED = 0.4, 0.0, 0.9
TAG = "spdx-license-identifier:"
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.+:-]*")
_RANK = {"or": 1, "and": 2, "with": 3}


def freedom(name: str) -> float:
    """Score of one identifier: that of the longest known start."""
    known = [k for k in FREEDOM if name == k or name.startswith(k + "-")]
    return FREEDOM[max(known, key=len)] if known else UNKNOWN


def evaluate(text: str, begin: int = 0, end: int | None = None) -> tuple[set[str], float] | None:
    """Licences that a lower-case expression at ``text[begin:end]`` names, and its score.

    ``or`` lets the user choose and takes the larger score, ``and`` binds to
    both and takes the smaller, ``with`` keeps that of the licence.  Reading
    stops where no expression can go on; None if there is none.  Time is linear in the
    text: operands are joined as ranges, and a name's parts when all is read.
    """
    # Operands in order; a value is a range of them, its score, and whether it is one licence, so joining two is cheap.
    names: list[list[str] | None] = []
    output: list[tuple[int, int, float, bool]] = []
    stack: list[str] = []
    open_brackets = 0

    def reduce_top() -> None:
        kind, (middle, high, r, _), (low, _, x, one) = stack.pop(), output.pop(), output.pop()
        if kind == "with" and one:
            names[low].append(min("-with-".join(n) for n in names[middle:high] if n is not None))
            names[middle:high] = [None] * (high - middle)
            output.append((low, high, x, True))
        else:
            output.append((low, high, max(x, r) if kind == "or" else min(x, r), False))

    operand, at, complete = True, begin, None
    for m in _TOKEN.finditer(text, begin, len(text) if end is None else end):
        if text[at : m.start()].strip(" \t"):
            break
        token, at = m.group(), m.end()
        if operand and token == "(":
            stack.append(token)
            open_brackets += 1
        elif operand and token not in _RANK and token != ")":
            names.append([token.rstrip(".")])
            output.append((len(names) - 1, len(names), freedom(token.rstrip("+.")), True))
            operand = False
        elif not operand and token in _RANK:
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[token]:
                reduce_top()
            stack.append(token)
            operand = True
        elif not operand and token == ")" and open_brackets:
            while stack[-1] != "(":
                reduce_top()
            stack.pop()
            open_brackets -= 1
        else:
            break
        if not operand and not stack:
            complete = output[-1]
    if not operand and not open_brackets:
        while stack:
            reduce_top()
        complete = output[-1]
    return ({"-with-".join(n) for n in names[complete[0] : complete[1]] if n is not None}, complete[2]) if complete else None


@lru_cache(maxsize=1)
def _automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for kind, table in (("base", BASE_PHRASES), ("notice", NOTICE_PHRASES)):
        for phrase, label in table.items():
            phrases.add_word(f" {phrase} ", (kind, label, len(phrase.split())))
    tags.add_word(TAG, len(TAG))
    phrases.make_automaton(), tags.make_automaton()
    return phrases, tags


def scan_text(text: str | None) -> tuple[int, int, int | None, int | None, str, str, float]:
    """Scan one whole text; see :func:`license_scan` for the fields."""
    phrases, tags = _automata()
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.translate(_WORDS).split()
    clean = f" {b' '.join(words).decode('latin-1')} "
    n_base, first, last, base, more, scores = 0, None, None, set(), set(), []
    at = blanks = 0
    for end, (kind, label, size) in phrases.iter(clean):
        # Matches come by their ends, so blanks are counted once; the last one of a match ends its last word.
        blanks, at = blanks + clean.count(" ", at, end), end
        if kind == "base":
            start = blanks - size
            n_base += 1
            first = start if first is None else min(first, start)
            last = start if last is None else max(last, start)
            base.add(label)
            scores.append(freedom(label))
        else:
            more.add(label)
            scores.append(RESERVED if label.endswith("reserved") else freedom(label.removeprefix("notice:")) * NOTICED)
    if b":" in raw:
        plain, line = raw.lower().decode("latin-1"), -1
        ends = [end for end, _ in tags.iter(plain)]
        # An expression goes up to the next tag at most, so no part of a line is read twice.
        for end, following in zip(ends, [*(e + 1 - len(TAG) for e in ends[1:]), len(plain)]):
            if line <= end:
                line = plain.find("\n", end)
                line = len(plain) if line < 0 else line
            if found := evaluate(plain, end + 1, min(line, following)):
                more.update(f"spdx:{name}" for name in found[0])
                scores.append(found[1])
    return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(base | more)), min(scores, default=0.0)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scan every whole text; one row for each row of ``docs``, nothing is shuffled.

    Words are runs of ASCII letters and digits and of all non-ASCII characters,
    A-Z lower-cased.  ``n_base`` counts all places of the base phrases,
    ``first_word`` and ``last_word`` are their smallest and largest starts or
    null, ``base_labels`` and ``labels`` are sorted and comma-joined.  The
    method adds ``spdx:`` labels from evaluated identifier tags and ``notice:``
    labels from notice phrases.  ``score`` is how freely the text may be used,
    the least of all that was found; 0 where nothing was found.  Null and empty
    texts have no words; repeated rows each give a row.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
        for batch in batches:
            found = [scan_text(t.as_py()) for t in batch.column(1)]
            columns = list(zip(*found)) if found else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names)

    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(scan, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
