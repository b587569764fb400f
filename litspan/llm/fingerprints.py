"""Document fingerprints: a Merkle tree over sections, paragraphs and sentences.

A paragraph is a line, its sentences end with a full stop and a blank; every sentence is cut further,
after words whose checksum is a multiple of ``WORDS``. No length decides how a text is cut, so near
copies share their leaves whatever their lengths. A section is a run of
paragraphs that ends with one whose hash is a multiple of ``SECTION`` (so an edit moves the borders
near it only). Every node's hash covers its children's; the root tells whether two texts are
equal, and where roots differ the branches that differ locate the edits.

The fingerprint is a string: the root (32 hex digits), then for each section ``;`` and its paragraphs
separated by ``,``, a paragraph being the short hashes (8 hex digits) of its sentences' leaves. Likeness is
1 for equal roots, else the shared leaf hashes, counted as a multiset, as Dice's share of both
texts' (below 1 at most 0.999999, so that 1 means equal).

Defined cases: a null text counts as empty and has a root; two empty texts are alike by 1. Repeated
rows keep one result each. Rows without id come last in descending order, rows of one id follow each other by a hash of their texts, descending.
Ids are integers (any other type is a TypeError); other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspan.llm.common import measured

SECTION = 8
WORDS = 4
ROOT = 32  # hex digits of the root
_LOWEST = -(1 << 63)


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _parts(sentence: str) -> list[str]:
    """Runs of words, cut by content; joined by blanks they are the sentence again."""
    out, run = [], []
    for word in sentence.split(" "):
        run.append(word)
        if zlib.crc32(word.encode()) % WORDS == 0:
            out.append(" ".join(run))
            run = []
    if run:
        out.append(" ".join(run))
    return out


def fingerprint(text: str) -> str:
    """The serialised tree of a text."""
    sections: list[list[str]] = [[]]
    nodes: list[bytes] = []
    inner: list[bytes] = []
    for paragraph in text.split("\n"):
        sentences = [[_digest(p.encode()) for p in _parts(s)] for s in paragraph.split(". ")]
        leaves = [x for s in sentences for x in s]
        node = _digest(b".".join([b"".join(s) for s in sentences]))
        inner.append(node)
        sections[-1].append("".join([x[:4].hex() for x in leaves]))
        if node[0] % SECTION == 0:
            nodes.append(_digest(b"".join(inner)))
            inner = []
            sections.append([])
    nodes.append(_digest(b"".join(inner)))
    body = ";".join([",".join(s) for s in sections])
    return f"{_digest(b''.join(nodes)).hex()};{body}"


def leaves(mark: str) -> Counter:
    """The multiset of leaf hashes of a fingerprint."""
    found: Counter = Counter()
    for paragraph in mark[ROOT + 1 :].replace(";", ",").split(","):
        found.update([paragraph[i : i + 8] for i in range(0, len(paragraph), 8)])
    return found


def likeness(a: str, b: str) -> float:
    """How alike two fingerprints are, from 0 to 1; 1 if and only if the roots are equal."""
    if a[:ROOT] == b[:ROOT]:
        return 1.0
    x, y = leaves(a), leaves(b)
    shared = sum(min(n, y[k]) for k, n in x.items() if k in y)
    return min(2 * shared / (x.total() + y.total()), 0.999999)


def differing_paragraphs(a: str, b: str) -> tuple[list[int], list[int]]:
    """Numbers (from 0) of the paragraphs of either fingerprint that lie in no equal branch of the other.

    Whole sections that both have are skipped at once; within the others paragraphs are compared.
    """
    trees = [[s.split(",") if s else [] for s in m[ROOT + 1 :].split(";")] for m in (a, b)]
    if a[:ROOT] == b[:ROOT]:
        return [], []
    known = [Counter(tuple(s) for s in t) for t in trees]
    out: list[list[int]] = []
    for own, other in ((0, 1), (1, 0)):
        shared = known[own] & known[other]
        rest = Counter(p for s in trees[other] if not shared[tuple(s)] for p in s)
        number, found, left = 0, [], Counter(shared)
        for section in trees[own]:
            if left[tuple(section)]:
                left[tuple(section)] -= 1
                number += len(section)
                continue
            for p in section:
                if rest[p]:
                    rest[p] -= 1
                else:
                    found.append(number)
                number += 1
        out.append(found)
    return out[0], out[1]


def edited_text(text: str, other: str) -> str:
    """The last third (rounded down) of ``text`` replaced by as many leading code points of ``other``."""
    n = len(text) // 3
    return text[: len(text) - n] + other[:n]


def with_successor(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", buckets: int | None = None) -> DataFrame:
    """Rows dealt into ranges of descending id, each range sorted and followed by the document after it.

    Columns: ``bucket``, ``follows`` (0 for a document of the range, 1 for the next range's
    first, 2 for a row that repeats another one, which it follows), ``id``, ``tie`` (a hash of the text), ``text``. The text is shuffled once. The driver holds
    only the range borders and tops (one for each bucket), the ids' quantiles. An id that fills several ranges is cut by ``tie``; of rows that repeat an id and a text
    each task sends one to its range and deals the others out evenly.
    """
    _, width = measured(docs, text_column)
    buckets = buckets or 8 * width
    kind = docs.schema[id_column].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"ids must be integers, not {kind}")
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_column).cast("long"), F.lit(_LOWEST)).alias("id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    cuts = rows.approxQuantile("id", [i / buckets for i in range(1, buckets)], 0.2 / buckets) if buckets > 1 else []
    border_ids, repeats = np.unique(np.array(cuts, float).astype(np.int64), return_counts=True)
    # an id that is several borders has so many ranges, of equal widths of the hash
    inner = {i: np.array([k * ((1 << 64) // n) - (1 << 63) for k in range(1, n)], np.int64) for i, n in zip(border_ids.tolist(), repeats.tolist(), strict=True) if n > 1}
    shift = np.concatenate([[0], np.cumsum(repeats)])

    def bucket_of(ids: np.ndarray, ties: np.ndarray) -> np.ndarray:
        bucket = shift[np.searchsorted(border_ids, ids)]
        for i in set(np.unique(ids).tolist()) & inner.keys():
            own = ids == i
            bucket[own] += np.searchsorted(inner[i], ties[own])
        return bucket

    def first_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ties = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            order = np.lexsort((ties, ids))
            ids, ties = ids[order], ties[order]
            bucket = bucket_of(ids, ties)
            last = np.flatnonzero(np.diff(bucket, append=-1))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[last], pa.int64()), pa.array(ids[last]), pa.array(ties[last])], names=["bucket", "id", "tie"])

    tops = rows.select("id", "tie").mapInArrow(first_of, "bucket long, id long, tie long").groupBy("bucket").agg(F.max(F.struct("id", "tie")).alias("top")).collect()
    tops = sorted((r.bucket, r.top.id, r.top.tie) for r in tops)
    follower_of = {(i, t): tops[(k + 1) % len(tops)][0] for k, (_, i, t) in enumerate(tops)}  # the range that the top follows
    names = ["bucket", "follows", "id", "tie", "text"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        repeated = 0
        for batch in batches:
            if len(seen) > 1 << 18:
                seen.clear()
            ids, ties = (c.to_numpy(zero_copy_only=False) for c in batch.columns[:2])
            bucket, follows = bucket_of(ids, ties), np.zeros(len(ids), np.int32)
            copied, to = [], []
            for k, key in enumerate(zip(ids.tolist(), ties.tolist(), strict=True)):
                if key in seen:
                    bucket[k], follows[k] = repeated % buckets, 2
                    repeated += 1
                    continue
                seen.add(key)
                if key in follower_of:
                    copied.append(k)
                    to.append(follower_of[key])
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(follows), *batch.columns], names=names)
            if copied:
                part = batch.take(pa.array(copied))
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(np.ones(len(copied), np.int32)), *part.columns], names=names)

    dealt = rows.mapInArrow(deal, "bucket long, follows int, id long, tie long, text string").repartition(width, "bucket")
    return dealt.sortWithinPartitions("bucket", "follows", F.desc("id"), F.desc("tie"), "text")


def fingerprint_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprint every whole text and its edited text, and compare with both and with the next document.

    Columns: the id, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited``, ``near_next``. A task holds two texts beside its batch.
    """

    def result(i: int, text: str, mark: str, following: str, follower: str) -> tuple:
        changed = edited_text(text, following)
        edited = fingerprint(changed)
        return (None if i == _LOWEST else i, len(text), hashlib.sha256(changed.encode()).hexdigest(), mark, edited, likeness(mark, edited), likeness(mark, follower))

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        last = None  # id, text, fingerprint of a document that waits for the next one
        same = None  # the last repeated row's text and result
        for batch in batches:
            for _, follows, i, _, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if follows == 2:
                    if same is None or same[0] != text:
                        mark = fingerprint(text)
                        same = text, result(i, text, mark, text, mark)
                    rows.append((None if i == _LOWEST else i, *same[1][1:]))
                elif last is not None or not follows:  # else one more copy of the one that closed the range
                    mark = fingerprint(text)
                    if last is not None:
                        rows.append(result(*last, text, mark))
                    last = None if follows else (i, text, mark)
                if len(rows) >= 512:
                    yield pack(rows)
                    rows = []
        if rows:
            yield pack(rows)

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    names = [id_column, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = f"`{id_column}` bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_successor(docs, id_column, text_column).mapInArrow(results, schema)
