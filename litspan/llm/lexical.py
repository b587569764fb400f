"""Ranked lexical search: every document scored for every item, by sorting instead of by accumulators.

The items' terms are numbered and each term lists its items. A task turns its documents into (document, term, occurrences), the impact of each is one
integer, and each is repeated for the term's items. The keys item and document, packed into one number, are radix sorted, ``reduceat`` adds
the impacts of equal keys, and a selection by heap keeps the best of each item. The kept ones, at most k of an item from each task, are dealt by ranges of items,
where the heaps' remains meet.

Two passes read the texts: one counts documents, terms and document frequencies, the other scores. Items are taken in blocks of at most BLOCK pairs
of item and term (an item with more is a block of its own), so what is broadcast is bounded; every block takes a pass.

Items are told by their id: rows that share one are one item with the terms of all their texts; null is an id. Null texts have no terms. Documents are rows: repeated ones
are ranked each, equal scores by ascending id, null ids first, with ids of any ordered type but binary. Items without a term that some document holds have no rows. Documents' other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litspan.llm.common import shuffle_width, slices, texts

BEST = 10
BLOCK = 1 << 20  # pairs of item and term that are broadcast at once
ITEMS = 1 << 16  # and items, so that an item is one digit of the packed key
SLICE = 1 << 21  # characters of documents that are scored at once,
ENTRIES = 1 << 21  # and entries that are sorted at once
DIGIT = 16
#: Bytes outside 0-9, A-Z, a-z and beyond ASCII become blanks; A-Z become a-z.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str) -> list[bytes]:
    """A text's terms in order."""
    return text.encode().translate(WORDS).split()


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of unsigned keys, by 16-bit digits from the lowest; a digit in order already is passed over."""
    order = np.arange(len(keys))
    for shift in range(0, keys.dtype.itemsize * 8, DIGIT):
        digit = (keys >> np.array(shift, keys.dtype)).astype(np.uint16)[order]
        if len(digit) and (digit[1:] < digit[:-1]).any():
            order = order[np.argsort(digit, kind="stable")]
    return order


class Index:
    """A block's terms by number, and each term's items."""

    def __init__(self, pairs: list[tuple[int, str]]):
        names = sorted({t for _, t in pairs})
        self.number = {t.encode(): k for k, t in enumerate(names)}
        term = np.array([self.number[t.encode()] for _, t in pairs], np.int64)
        item = np.array([i for i, _ in pairs], np.int64)
        order = np.lexsort((item, term))
        self.items = item[order]
        self.edges = np.searchsorted(term[order], np.arange(len(names) + 1))

    def matched(self, rows: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of terms of each text, and (text, term, occurrences) of those in the index, in order of texts."""
        sizes, found, width = [], [], len(self.number)
        for k, text in enumerate(rows):
            words = terms(text)
            sizes.append(len(words))
            found.append(np.fromiter((x for x in map(self.number.get, words) if x is not None), np.int64) + k * width)
        keys, times = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
        return np.array(sizes, np.int64), keys // max(width, 1), keys % max(width, 1), times


def _counts(batches: Iterator[pa.RecordBatch], index) -> Iterator[pa.RecordBatch]:
    """Rows (number, n): a task's documents that hold each term; -1 tells its documents with terms, -2 their terms."""
    total, documents, held = 0, 0, np.zeros(len(index.value.number), np.int64)
    for batch in batches:
        rows = texts(batch.column(0))
        for lo, hi in slices(batch, [len(t) for t in rows], SLICE):
            sizes, _, term, _ = index.value.matched(rows[lo:hi])
            documents += int((sizes > 0).sum())
            total += int(sizes.sum())
            held += np.bincount(term, minlength=len(held))
    some = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *some.tolist()], pa.int64()), pa.array([documents, total, *held[some].tolist()], pa.int64())], names=["number", "n"])


class Best:
    """The k best documents of each item; a score below the k-th so far is passed over at once."""

    def __init__(self, items: int, k: int):
        self.k, self.held = k, [[] for _ in range(items)]
        self.least = np.ones(items, np.int64)

    def offer(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray, ids: list) -> None:
        able = np.flatnonzero(score >= self.least[item])
        for i, s, d in zip(item[able].tolist(), score[able].tolist(), doc[able].tolist(), strict=True):
            self.held[i].append((-s, ids[d] is not None, ids[d]))
            if len(self.held[i]) >= 8 * self.k:
                self._select(i)

    def _select(self, i: int) -> None:
        self.held[i] = heapq.nsmallest(self.k, self.held[i], key=_order)
        if len(self.held[i]) == self.k:
            self.least[i] = -self.held[i][-1][0]

    def settle(self) -> None:
        """Select wherever more than k are held: the thresholds rise."""
        for i, held in enumerate(self.held):
            if len(held) > self.k or len(held) == self.k and self.least[i] == 1:
                self._select(i)

    def rows(self) -> Iterator[tuple[int, int, object]]:
        for i in range(len(self.held)):
            self._select(i)
            for s, _, d in self.held[i]:
                yield i, -s, d


def _order(x: tuple) -> tuple:
    return x if x[1] else x[:2]


def _scores(batches: Iterator[pa.RecordBatch], index, items: int, weight: np.ndarray, documents: int, total: int, k: int) -> Iterator[pa.RecordBatch]:
    """Rows (place, score, id): the best of each item among a task's documents."""
    best, at, repeats, kind = Best(items, k), index.value, np.diff(index.value.edges), pa.null()
    for batch in batches:
        rows, kind = texts(batch.column(1)), batch.schema.field(0).type
        for lo, hi in slices(batch, [len(t) for t in rows], SLICE):
            ids = batch.column(0).slice(lo, hi - lo).to_pylist()
            for a in range(lo, hi, 1 << DIGIT):  # a text is one digit, too
                sizes, doc, term, times = at.matched(rows[a : min(hi, a + (1 << DIGIT))])
                if not len(doc):
                    continue
                m = np.array([10 + 90 * n * documents // total for n in sizes.tolist()], np.int64)
                impact = weight[term] * (1_000_000_000 * times // (1000 * times + 8 * m[doc]))
                ends = np.cumsum(repeats[term])
                cut = 0
                while cut < len(doc):  # whole documents, of about ENTRIES entries
                    before = int(ends[cut - 1]) if cut else 0
                    stop = max(int(np.searchsorted(ends, before + ENTRIES, "right")), cut + 1)
                    stop = int(np.searchsorted(doc, doc[stop - 1], "right")) if stop < len(doc) else stop
                    part = slice(cut, stop)
                    times_each, first = repeats[term[part]], at.edges[term[part]]
                    start = np.cumsum(times_each) - times_each
                    entry = np.arange(times_each.sum()) + np.repeat(first - start, times_each)
                    keys = (at.items[entry].astype(np.uint32) << np.uint32(DIGIT)) | np.repeat(doc[part], times_each).astype(np.uint32)
                    order = radix_order(keys)
                    keys = keys[order]
                    edge = np.flatnonzero(np.diff(keys, prepend=~keys[:1])) if len(keys) else np.zeros(0, np.intp)
                    if len(edge):
                        sums = np.add.reduceat(np.repeat(impact[part], times_each)[order], edge)
                        best.offer((keys[edge] >> np.uint32(DIGIT)).astype(np.int64), sums, (keys[edge] & np.uint32(0xFFFF)).astype(np.int64), ids[a - lo :])
                    cut = stop
                best.settle()
    if found := list(best.rows()):
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in found], t) for j, t in enumerate((pa.int64(), pa.int64(), kind))], names=["place", "score", "id"])


def weights(documents: int, held: np.ndarray) -> np.ndarray:
    """A term's weight by the number of documents that hold it, in doubles."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in held.tolist()], np.int64)


def _blocks(items: DataFrame, id_column: str, text_column: str, most: int) -> Iterator[list[tuple]]:
    """Lists of (item id, term), each of about ``most`` pairs of whole items."""
    kind = items.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(texts(batch.column(1))):
                own = sorted(set(terms(text)))
                yield pa.RecordBatch.from_arrays([pa.array(batch.column(0).slice(k, 1).to_pylist() * len(own), batch.schema.field(0).type), pa.array([t.decode() for t in own], pa.string())], names=["item", "term"])

    pairs = items.select(id_column, text_column).mapInArrow(run, f"item {kind}, term string").distinct()
    sizes = pairs.agg(F.count("*"), F.approx_count_distinct("item")).first()
    count = max(1, -(-sizes[0] // most), -(-2 * sizes[1] // ITEMS))
    for b in range(count):
        part = pairs if count == 1 else pairs.where(F.pmod(F.xxhash64("item"), F.lit(count)) == b)
        rows = [tuple(r) for r in part.collect()]
        if rows:
            yield rows


def search(docs: DataFrame, items: DataFrame, k: int = BEST, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text", most: int = BLOCK) -> DataFrame:
    """Each item's k best documents: columns item, rank int, the documents' id, score long."""
    spark = docs.sparkSession
    ids, kind = docs.schema[id_column].dataType, items.schema[item_column].dataType.simpleString()
    parts = []
    for rows in _blocks(items, item_column, item_text, most):
        names = sorted({i for i, _ in rows}, key=lambda x: (x is not None, x) if x is not None else (False,))
        place = {i: n for n, i in enumerate(names)}
        index = Index([(place[i], t) for i, t in rows])
        shared = spark.sparkContext.broadcast(index)
        counts = {r[0]: r[1] for r in docs.select(text_column).mapInArrow(partial(_counts, index=shared), "number bigint, n bigint").groupBy("number").agg(F.sum("n")).collect()}
        documents, total = counts.get(-1, 0), counts.get(-2, 0)
        weight = weights(documents, np.array([counts.get(n, 0) for n in range(len(index.number))], np.int64))
        found = docs.select(id_column, text_column).mapInArrow(
            partial(_scores, index=shared, items=len(names), weight=weight, documents=documents, total=max(total, 1), k=k), f"place bigint, score bigint, id {ids.simpleString()}"
        )
        width = min(shuffle_width(docs), len(names))
        dealt = found.withColumn("span", F.expr(f"place * {width} div {len(names)}")).repartition(width, "span")
        best = Window.partitionBy("span", "place").orderBy(F.desc("score"), "id")
        kept = dealt.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        told = spark.createDataFrame([(n, i) for n, i in enumerate(names)], f"place bigint, item {kind}")
        parts.append(kept.join(F.broadcast(told), "place").select(F.col("item").alias(item_column), "rank", F.col("id").alias(id_column), "score"))
    if not parts:
        return spark.createDataFrame([], f"`{item_column}` {kind}, rank int, `{id_column}` {ids.simpleString()}, score bigint")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    return whole
