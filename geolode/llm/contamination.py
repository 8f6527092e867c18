"""Benchmark decontamination: exact hits of pieces of test items, verified by bit-parallel edit distance."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolode.llm.common import documents

ERRORS = 0.05
LEAST_CHARS = 20
BLOCK_BYTES = 8 << 20


def plain(text: str | None) -> str:
    """Lower case, with one blank for every run of white space."""
    return " ".join((text or "").lower().split())


def budget(size: int, errors: float = ERRORS) -> int:
    return int(size * errors)


def pieces(item: str, errors: float = ERRORS) -> list[tuple[int, str]]:
    """The item cut into one more piece than its error budget: edits within the budget leave one piece whole."""
    n = budget(len(item), errors) + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """The least edit distance of ``pattern`` to a substring of ``text``, and where the first such substring ends.

    Myers' bit-vector recurrence with one machine-independent integer as the column.
    """
    m = len(pattern)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    equal: dict[str, int] = {}
    for i, c in enumerate(pattern):
        equal[c] = equal.get(c, 0) | 1 << i
    plus, minus, score = mask, 0, m
    best, at = m, 0
    for j, c in enumerate(text, 1):
        eq = equal.get(c, 0)
        x = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | ~(x | plus) & mask, plus & x
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = up << 1 & mask, down << 1 & mask
        y = eq | minus
        plus, minus = down | ~(y | up) & mask, up & y
        if score < best:
            best, at = score, j
    return best, at


class Finder:
    """All pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int, str]], errors: float, least: int):
        self.items, self.errors, self.least = items, errors, least
        self.automaton = ahocorasick.Automaton()
        for k, (_, item) in enumerate(items):
            for at, piece in pieces(item, errors) if len(item) >= least else [(0, item)]:
                known = self.automaton.get(piece, [])
                known.append((k, at, len(piece)))
                self.automaton.add_word(piece, known)
        if items:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item number, distance, start bound, end) of the best place of each item within its budget."""
        best: dict[int, tuple[int, int, int]] = {}
        tried: set[tuple[int, int]] = set()
        for end, hits in self.automaton.iter(text):
            for k, at, size in hits:
                start = end + 1 - size - at
                if (k, start) in tried or (k in best and best[k][0] == 0):
                    continue
                tried.add((k, start))
                item = self.items[k][1]
                if size == len(item):
                    if size >= self.least or not (text[max(0, start - 1) : start].isalnum() or text[end + 1 : end + 2].isalnum()):
                        best[k] = (0, start, end + 1)
                    continue
                limit = budget(len(item), self.errors)
                low = max(0, start - limit)
                distance, to = myers(item, text[low : max(0, start + len(item) + limit)])
                if distance <= limit and (k not in best or distance < best[k][0]):
                    best[k] = (distance, low, low + to)
        return [(k, *v) for k, v in best.items()]


_finders: dict[str, Finder] = {}


def _finder(token: str, items: list[tuple[int, str]], errors: float, least: int) -> Finder:
    """The automaton of a block, built once in each worker."""
    if token not in _finders:
        _finders.clear()
        _finders[token] = Finder(items, errors, least)
    return _finders[token]


def _search(token: str, items: list[tuple[int, str]], errors: float, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder(token, items, errors, least)
        names = ["doc_id", "item_id", "n_errors", "from_char", "to_char"]
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if items and (value := text.as_py()):
                    out += [(doc, finder.items[k][0], d, a, b) for k, d, a, b in finder.find(plain(value))]
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS, least: int = LEAST_CHARS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Rows (doc_id, item_id, n_errors, from_char, to_char): whole test items that stand in a text but for a few edits.

    Texts and items are compared in lower case with white space as single blanks. An item of n characters may differ by
    floor(n * ``errors``) insertions, deletions or substitutions; its best place in a document is reported, as a window's start and the match's end. Items under ``least``
    characters match without an edit, as whole words; null and empty items and null or empty texts match nothing; an item without an id is reported as -1. Repeated rows and items are each reported.
    Items reach the tasks in blocks of BLOCK_BYTES at most, one pass over the documents for each, so what is sent is bounded
    whatever the size of the benchmark. Empty tables give an empty result.
    """
    schema = "doc_id bigint, item_id bigint, n_errors bigint, from_char bigint, to_char bigint"
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for token, kept in _blocks(benchmark, item_col, item_text_col):
        found = rows.mapInArrow(_search(f"{token}/{errors}/{least}", kept, errors, least), schema)
        out = found if out is None else out.unionByName(found)
    return out


def _blocks(benchmark: DataFrame, item_col: str, item_text_col: str) -> Iterator[tuple[str, list[tuple[int, str]]]]:
    """The items in blocks of bounded size, each with a name that tells it from others."""
    items = benchmark.select(F.col(item_col).cast("bigint").alias("item_id"), F.col(item_text_col).alias("text")).filter("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first().b
    blocks = max(1, -(-2 * size // BLOCK_BYTES))
    for block in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        kept = sorted(((-1 if r.item_id is None else r.item_id), p) for r in own if (p := plain(r.text)))
        yield f"{block}/{blocks}/{hash(tuple(kept))}", kept


def without_leaks(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS, least: int = LEAST_CHARS, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` less the rows in which a test item stands, by the rule of ``leaks``; all columns stay as they are."""
    at = docs.columns.index(text_col)

    def keeping(token: str, items: list[tuple[int, str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = _finder(token, items, errors, least)
            for batch in batches:
                clean = [not (items and (value := t.as_py()) and finder.find(plain(value))) for t in batch.column(at)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    for token, items in _blocks(benchmark, item_col, item_text_col):
        docs = docs.mapInArrow(keeping(f"{token}/{errors}/{least}", items), docs.schema)
    return docs


def op9_pigeonhole_leaks(spark, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))
