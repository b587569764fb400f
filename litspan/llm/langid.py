"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts come from every labelled training row. Each partition sums its own counts into dense
blocks, blocks are added up by (language, block), and the driver receives only the finished matrix,
whose size is fixed by ``buckets`` and ``most_languages``. That matrix of log probabilities is
broadcast; texts are scored in batches with numpy.

Defined cases: a null text, or one without any letter, is ``und`` with score 0. Rows with a null
language teach nothing. A null id counts as the empty text where its checksum decides the fold.
Without any training row every text is ``und``. Equal scores go to the language first in order of
name. Repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litspan.llm.bpe import LETTER, _classes
from litspan.llm.common import fresh, shuffle_width, slices, texts

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
BLOCK = 1 << 11  # buckets of a block of counts
CHUNK = 1 << 21  # code points handled at once
UNKNOWN = "und"
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def held_out(id_column: str | Column) -> Column:
    """Whether the row is kept for testing: crc32 of the id's text leaves 1 when divided by 3."""
    text = F.coalesce(F.col(id_column).cast("string") if isinstance(id_column, str) else id_column.cast("string"), F.lit(""))
    return F.crc32(text) % 3 == 1


def _grams(batch: list[str], buckets: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Code points, one array of bucket numbers for each order (``buckets`` where a gram would cross
    the end of its text), and where each text begins (with the total at the end)."""
    lengths = np.array([len(t) for t in batch], np.intp)
    points = np.frombuffer("".join(batch).encode("utf-32-le"), np.uint32)
    begin = np.concatenate([[0], np.cumsum(lengths)])
    n = len(points)
    room = np.repeat(begin[1:], lengths) - np.arange(n)  # code points from here to the end of the text
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    mixed, out = np.zeros(n, np.uint32), []
    for order in ORDERS:
        k = order - 1
        if n > k:
            mixed[: n - k] += points[k:] * _FACTORS[k]
            mixed ^= mixed >> np.uint32(15)
            mixed *= np.uint32(0x2C1B3C6D)
        hashed = (mixed >> shift).astype(np.intp)
        if k:
            hashed[room < order] = buckets
        out.append(hashed)
    return points, out, begin


def count_grams(labelled: DataFrame, text_column: str, label_column: str, buckets: int = BUCKETS) -> DataFrame:
    """Counts by (label, block): ``counts`` binary (int64), and ``docs`` in block 0. Reads all rows."""
    blocks = buckets // min(BLOCK, buckets)

    def rows(kept: dict[tuple[str, int], np.ndarray], docs: dict[str, int]) -> pa.RecordBatch:
        keys = sorted(kept)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in keys], pa.string()),
                pa.array([k[1] for k in keys], pa.int32()),
                pa.array([kept[k].tobytes() for k in keys], pa.binary()),
                pa.array([docs.get(k[0], 0) if k[1] == 0 else 0 for k in keys], pa.int64()),
            ],
            names=["label", "block", "counts", "docs"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            words, labels = texts(batch.column(0)), batch.column(1).to_pylist()
            for lo, hi in slices(batch, [len(t) for t in words], CHUNK):
                names = sorted(set(labels[lo:hi]))
                _, grams, begin = _grams([t.lower() for t in words[lo:hi]], buckets)
                own = np.repeat(np.searchsorted(names, labels[lo:hi]) * (buckets + 1), np.diff(begin))
                found = sum(np.bincount(g + own, minlength=len(names) * (buckets + 1)) for g in grams)
                for i, name in enumerate(names):
                    part = found[i * (buckets + 1) :][:buckets]
                    total[name] = total[name] + part if name in total else part
                for name in labels[lo:hi]:
                    docs[name] = docs.get(name, 0) + 1
        if total:
            yield rows({(name, b): x for name, all_ in total.items() for b, x in enumerate(np.split(all_, blocks))}, docs)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[str, int], np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            for label, block, counts, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = np.frombuffer(counts, np.int64)
                kept[label, block] = kept[label, block] + x if (label, block) in kept else x
                docs[label] = docs.get(label, 0) + n
        if kept:
            yield rows(kept, docs)

    schema = "label string, block int, counts binary, docs bigint"
    used = labelled.where(F.col(label_column).isNotNull() & F.col(text_column).isNotNull())
    return (
        used.select(F.col(text_column), F.col(label_column).cast("string"))
        .mapInArrow(count, schema)
        .repartition(min(blocks * 4, shuffle_width(labelled)), "label", "block")
        .mapInArrow(add, schema)
    )


def fit(labelled: DataFrame, text_column: str = "text", label_column: str = "lang", buckets: int = BUCKETS, smoothing: float = 0.5, most_languages: int = 400) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language names, log priors, and log probabilities (languages x buckets, then a column of zeros).

    More than ``most_languages`` labels is an error: the matrix that is broadcast has a fixed bound.
    """
    counted = count_grams(labelled, text_column, label_column, buckets)
    counts: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for row in counted.toLocalIterator():
        if row.label not in counts and len(counts) == most_languages:
            raise ValueError(f"more than {most_languages} languages")
        part = np.frombuffer(row.counts, np.int64)
        counts.setdefault(row.label, np.zeros(buckets, np.int64))[row.block * len(part) :][: len(part)] = part
        docs[row.label] = docs.get(row.label, 0) + row.docs
    names = sorted(counts)
    if not names:
        return [], np.zeros(0), np.zeros((0, buckets + 1))
    table = np.array([counts[n] for n in names], float) + smoothing
    logs = np.zeros((len(names), buckets + 1))
    logs[:, :-1] = np.log(table / table.sum(axis=1, keepdims=True))
    prior = np.array([docs[n] for n in names], float)
    return names, np.log(prior / prior.sum()), logs


def score_texts(batch: list[str], names: list[str], prior: np.ndarray, logs: np.ndarray) -> tuple[list[str], list[float]]:
    """The likeliest language of each text and its posterior probability."""
    if not names:
        return [UNKNOWN] * len(batch), [0.0] * len(batch)
    points, grams, begin = _grams([t.lower() for t in batch], logs.shape[1] - 1)
    full = np.flatnonzero(np.diff(begin))
    likely = np.tile(prior, (len(batch), 1))
    has_letter = np.zeros(len(batch), bool)
    if len(full):
        starts = begin[:-1][full]
        for k, row in enumerate(logs):
            found = row.take(grams[0])
            for g in grams[1:]:
                found += row.take(g)
            likely[full, k] += np.add.reduceat(found, starts)
        has_letter[full] = np.logical_or.reduceat(_classes()[points] == LETTER, starts)
    best = likely.argmax(axis=1)
    sure = 1 / np.exp(likely - likely.max(axis=1, keepdims=True)).sum(axis=1)
    return (
        [names[b] if ok else UNKNOWN for b, ok in zip(best, has_letter, strict=True)],
        [float(s) if ok else 0.0 for s, ok in zip(sure, has_letter, strict=True)],
    )


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], text_column: str = "text", carry: list[str] | None = None, out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Add the columns ``out`` (language and posterior), from the text alone, to the columns ``carry`` (all by default).

    A column that has one of those names already is replaced. One pass over the scan; the model is broadcast (see ``fit`` for its bound).
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c not in out]
    frame = docs.select(*carry, F.col(text_column).alias(fresh(carry, "words")))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            words = texts(batch.column(batch.num_columns - 1))
            for lo, hi in slices(batch, [len(t) for t in words], CHUNK):
                found, sure = score_texts(words[lo:hi], *model)
                kept = batch.slice(lo, hi - lo).columns[:-1]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.string()), pa.array(sure, pa.float64())], names=[*carry, *out])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields[:-1]]
    return frame.mapInArrow(run, ", ".join([*fields, f"`{out[0]}` string", f"`{out[1]}` double"]))


def identify(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang", carry: list[str] | None = None, out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Fit on the training fold, predict every row; adds the columns ``out``."""
    model = fit(docs.where(~held_out(id_column)), text_column, label_column)
    return predict(docs, model, text_column, carry, out)
