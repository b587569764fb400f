"""An index of vectors: cells by distributed k-means, compact codes in blocks, and exact scores of the few chunks that codes can't rule out.

Rows are stored by cell. A question probes the cells nearest to it, which are whole partitions of the table. Within them it reads codes, one
byte a dimension, in blocks that multiply as matrices; a code's error is stored, so each score has a lower and an upper bound, and
only chunks whose upper bound reaches the k-th lower one are read in full. What a question misses is what lies in other cells; with all
cells probed the result equals the exact scan. ``calibrated`` measures how many probes a recall takes on the data at hand.

Keys and number name a chunk. Vectors that are null, empty, zero, of another length than the cells', or hold null or non-finite components have no score: they come last, as with an exact scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litspan.operators.blocks import groups, listed
from litspan.operators.retrieval import dot, unit

CELLS, STEPS = 50, 8
BLOCK, ASKED = 1024, 64  # chunks and questions of a block
HELD = 1 << 18  # candidates that a task holds before it passes them on
LOST = -4.0  # stands below every score: a vector without one
SLACK = 1e-5  # for products in single precision


@dataclass(frozen=True)
class Cells:
    """Unit centroids, one a row. Bounded by cells times dimensions, so tasks get them as they are."""

    centroids: np.ndarray

    def order(self, vectors: np.ndarray) -> np.ndarray:
        """All cells of each vector, nearest first."""
        return np.argsort(-(vectors @ self.centroids.T), axis=1, kind="stable")


def matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, and which rows have one (the others are zero)."""
    n = len(column)
    if not size:
        return np.zeros((n, 0)), np.zeros(n, bool)
    out, right = np.zeros((n, size)), np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), size), False))
    flat = pc.list_flatten(column.filter(pa.array(right)))
    if right.any():
        out[right] = np.asarray(flat.cast(pa.float64()).to_numpy(zero_copy_only=False)).reshape(-1, size)
    norm = np.linalg.norm(out, axis=1)
    fine = right & np.isfinite(norm) & (norm > 0)
    out[~fine] = 0
    out[fine] /= norm[fine, None]
    return out, fine


def fit_cells(chunks: DataFrame, cells: int = CELLS, steps: int = STEPS, embedding: str = "embedding") -> Cells:
    """Centroids by Lloyd's steps over all rows. Each step sums within tasks, then by cell; the driver sees one row of each cell.

    The first ones are the vectors with the smallest hashes, so the same rows give the same cells. Fewer rows than cells give fewer cells, no vectors one cell.
    """
    some = chunks.where(unit(F.col(embedding)).isNotNull()).select(F.col(embedding).alias("v"))
    first = some.distinct().orderBy(F.xxhash64("v"), "v").limit(cells).collect()
    if not first:
        return Cells(np.zeros((1, 0)))
    size = len(first[0].v)
    at = matrix(pa.array([r.v for r in first], pa.list_(pa.float64())), size)
    centroids = at[0][at[1]]
    for _ in range(steps):
        sums = some.mapInArrow(partial(_cell_sums, centroids=centroids), "cell int, n bigint, total binary")
        rows = sums.repartition(max(1, min(cells, 64)), "cell").mapInArrow(_merged, "cell int, n bigint, total binary").collect()
        moved = centroids.copy()
        for r in rows:
            total = np.frombuffer(r.total)
            if (norm := np.linalg.norm(total)) > 0:
                moved[r.cell] = total / norm
        if np.allclose(moved, centroids, atol=1e-9):
            break
        centroids = moved
    return Cells(centroids)


def _cell_sums(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    k, size = centroids.shape
    total, n = np.zeros((k, size)), np.zeros(k, np.int64)
    for batch in batches:
        vectors, fine = matrix(batch.column(0), size)
        vectors = vectors[fine]
        own = (vectors @ centroids.T).argmax(1)
        n += np.bincount(own, minlength=k)
        order = np.argsort(own, kind="stable")
        edge = np.flatnonzero(np.diff(own[order], prepend=-1))
        if len(edge):
            total[own[order][edge]] += np.add.reduceat(vectors[order], edge)
    yield from _sum_rows({c: (int(n[c]), total[c]) for c in np.flatnonzero(n)})


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        for c, n, total in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            before = held.get(c, (0, 0.0))
            held[c] = before[0] + n, before[1] + np.frombuffer(total)
    yield from _sum_rows(held)


def _sum_rows(held: dict) -> Iterator[pa.RecordBatch]:
    columns = [pa.array(list(held), pa.int32()), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([t.tobytes() for _, t in held.values()], pa.binary())]
    yield pa.RecordBatch.from_arrays(columns, names=["cell", "n", "total"])


def coded(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One signed byte a dimension, the scale that makes it a vector again, and the length of what that loses."""
    scale = np.abs(vectors).max(axis=1, initial=0) / 127
    codes = np.rint(vectors / np.where(scale > 0, scale, 1)[:, None]).astype(np.int8)
    lost = np.linalg.norm(vectors - codes * scale[:, None], axis=1)
    return codes, scale.astype(np.float32), (lost + SLACK).astype(np.float32)


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def build(chunks: DataFrame, cells: Cells, keys: list[str], embedding: str = "embedding", order: str = "chunk_index") -> DataFrame:
    """The index as blocks of up to BLOCK chunks of one cell and one value of ``keys``: keys, cell, ids, codes, scales, losts.

    One exchange by ranges, so a paper with most of the rows is cut; the chunks of a block are in order.
    """
    frame = chunks.select(*keys, order, embedding)
    size = cells.centroids.shape[1]
    names = [*keys, order, "cell", "code", "scale", "lost"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, fine = matrix(batch.column(len(keys) + 1), size)
            codes, scale, lost = coded(vectors)
            own = (vectors @ cells.centroids.T).argmax(1)
            columns = [pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale), pa.array(np.where(fine, lost, np.float32(LOST)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys) + 1], *columns], names=names)

    kinds = [f"`{c}` {_kind(chunks, c)}" for c in (*keys, order)]
    rows = frame.mapInArrow(run, ", ".join([*kinds, "cell int, code binary, scale float, lost float"]))
    dealt = rows.repartitionByRange(*keys, "cell", order).sortWithinPartitions(*keys, "cell", order)
    schema = ", ".join([*kinds[:-1], f"cell int, ids array<{_kind(chunks, order)}>, codes binary, scales binary, losts binary"])
    return dealt.mapInArrow(partial(_chunk_blocks, keys=len(keys)), schema)


def _chunk_blocks(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    for group in groups(batches, [*range(keys), keys + 1], BLOCK):
        whole = [pa.array([b"".join(group.column("code").to_pylist())], pa.binary())]
        whole += [pa.array([group.column(c).to_numpy().astype(np.float32).tobytes()], pa.binary()) for c in ("scale", "lost")]
        heads = [group.column(k).slice(0, 1).combine_chunks() for k in range(keys)]
        columns = [*heads, group.column("cell").slice(0, 1).combine_chunks(), listed(group.column(keys)), *whole]
        yield pa.RecordBatch.from_arrays(columns, names=[*group.schema.names[:keys], "cell", "ids", "codes", "scales", "losts"])


def save(blocks: DataFrame, path: str) -> DataFrame:
    """Write the blocks by cell, and read them again: a filter or a join on ``cell`` prunes partitions."""
    blocks.write.partitionBy("cell").mode("overwrite").parquet(path)
    return blocks.sparkSession.read.schema(blocks.schema).parquet(path)


def asked(questions: DataFrame, cells: Cells, keys: list[str], probes: int | None, question: str = "question_id", vector: str = "vector") -> DataFrame:
    """Questions by the cells they probe, in blocks of up to ASKED: keys, cell, asked (ids), vectors. One without a vector probes all cells."""
    count, size = cells.centroids.shape
    frame = questions.select(*keys, question, vector)
    names = [*keys, question, "cell", "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, fine = matrix(batch.column(len(keys) + 1), size)
            times = np.where(fine, count if probes is None else min(probes, count), count)
            row = np.repeat(np.arange(batch.num_rows), times)
            place = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            cell = cells.order(vectors)[row, place] if len(row) else np.zeros(0, np.int64)
            flat = [v.astype(np.float32).tobytes() for v in vectors]
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[: len(keys) + 1]), pa.array(cell, pa.int32()), pa.array([flat[r] for r in row], pa.binary())], names=names)

    kinds = [f"`{c}` {_kind(questions, c)}" for c in (*keys, question)]
    rows = frame.mapInArrow(run, ", ".join([*kinds, "cell int, v binary"])).repartition(*keys, "cell").sortWithinPartitions(*keys, "cell", question)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, [*range(len(keys)), len(keys) + 1], ASKED):
            heads = [group.column(k).slice(0, 1).combine_chunks() for k in (*range(len(keys)), len(keys) + 1)]
            yield pa.RecordBatch.from_arrays([*heads, listed(group.column(len(keys))), pa.array([b"".join(group.column("v").to_pylist())], pa.binary())], names=[*keys, "cell", "asked", "vectors"])

    return rows.mapInArrow(pack, ", ".join([*kinds[:-1], f"cell int, asked array<{_kind(questions, question)}>, vectors binary"]))


class Bounded:
    """For each question the candidates whose upper bound reaches its k-th lower bound so far."""

    def __init__(self, k: int):
        self.k, self.size = k, 0
        self.held: dict = {}
        self.least: dict = {}

    def offer(self, question, ids: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        able = high >= self.least.get(question, -np.inf)
        parts = self.held.setdefault(question, [])
        parts.append((ids[able], low[able], high[able]))
        self.size += int(able.sum())
        if sum(len(p[0]) for p in parts) > 8 * self.k:
            self._prune(question)

    def _prune(self, question) -> None:
        ids, low, high = (np.concatenate(x) for x in zip(*self.held[question], strict=True))
        if len(low) >= self.k:
            self.least[question] = max(self.least.get(question, -np.inf), np.partition(low, len(low) - self.k)[len(low) - self.k])
        able = high >= self.least.get(question, -np.inf)
        self.size -= int((~able).sum())
        self.held[question] = [(ids[able], low[able], high[able])]

    def rows(self) -> Iterator[tuple]:
        for question in self.held:
            self._prune(question)
            yield question, *self.held[question][0]
        self.held, self.size = {}, 0


def _bounds(batches: Iterator[pa.RecordBatch], k: int, size: int) -> Iterator[pa.RecordBatch]:
    """Rows (question, id, low, high) of joined blocks of questions and chunks."""
    held, kinds = Bounded(k), None
    for batch in batches:
        col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        kinds = col["asked"].type.value_type, col["ids"].type.value_type
        for i in range(batch.num_rows):
            ids = np.array(col["ids"][i].values.to_pylist(), object)
            codes = np.frombuffer(col["codes"][i].as_py(), np.int8).reshape(len(ids), size).astype(np.float32)
            scale, lost = (np.frombuffer(col[c][i].as_py(), np.float32) for c in ("scales", "losts"))
            wanted = col["asked"][i].values.to_pylist()
            vectors = np.frombuffer(col["vectors"][i].as_py(), np.float32).reshape(len(wanted), size)
            none = lost == np.float32(LOST)
            score = np.where(none, np.float32(LOST), vectors @ codes.T * scale)
            error = np.where(none, 0, lost)
            for q, v, s in zip(wanted, vectors, score, strict=True):
                s = s if v.any() else np.full(len(ids), np.float32(LOST))
                held.offer(q, ids, s - error, s + error)
            if held.size > HELD:
                yield from _candidate_rows(held, kinds)
    if kinds:
        yield from _candidate_rows(held, kinds)


def _candidate_rows(held: Bounded, kinds: tuple) -> Iterator[pa.RecordBatch]:
    for q, ids, low, high in held.rows():
        columns = [pa.array([q] * len(ids), kinds[0]), pa.array(ids.tolist(), kinds[1]), pa.array(low, pa.float32()), pa.array(high, pa.float32())]
        yield pa.RecordBatch.from_arrays(columns, names=["question", "id", "low", "high"])


def candidates(questions: DataFrame, blocks: DataFrame, cells: Cells, k: int, keys: list[str], probes: int | None = None, question: str = "question_id", vector: str = "vector", order: str = "chunk_index") -> DataFrame:
    """The chunks that have to be read in full for each question: question, id."""
    wanted = asked(questions, cells, keys, probes, question, vector)
    kinds = f"question {_kind(questions, question)}, id {blocks.schema['ids'].dataType.elementType.simpleString()}, low float, high float"
    met = wanted.join(blocks, [*keys, "cell"]).select("asked", "vectors", "ids", "codes", "scales", "losts")
    found = met.mapInArrow(partial(_bounds, k=k, size=cells.centroids.shape[1]), kinds)
    by = Window.partitionBy("question")
    ranked = found.withColumn("__r", F.row_number().over(by.orderBy(F.desc("low"), "id")))
    least = F.max(F.when(F.col("__r") == k, F.col("low"))).over(by)
    return ranked.withColumn("__l", least).where(F.col("__l").isNull() | (F.col("high") >= F.col("__l"))).select(F.col("question").alias(question), F.col("id").alias(order))


def nearest(questions: DataFrame, blocks: DataFrame, chunks: DataFrame, cells: Cells, k: int, keys: list[str], probes: int | None = None, question: str = "question_id", vector: str = "vector", embedding: str = "embedding", order: str = "chunk_index") -> DataFrame:
    """For each question (question_id, the keys, vector) its k nearest chunks: question, keys, chunk, rank, score. Scores are exact; ``probes`` of None takes all cells."""
    told = candidates(questions, blocks, cells, k, keys, probes, question, vector, order)
    both = told.join(questions.select(question, *keys, unit(F.col(vector)).alias("__q")), question)
    read = both.join(chunks.select(*keys, order, unit(F.col(embedding)).alias("__v")), [*keys, order])
    scored = read.withColumn("score", dot(F.col("__v"), F.col("__q"))).drop("__v", "__q")
    ranked = Window.partitionBy(question).orderBy(F.desc_nulls_last("score"), order)
    return scored.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select(question, *keys, order, "rank", "score")


def calibrated(questions: DataFrame, blocks: DataFrame, chunks: DataFrame, cells: Cells, k: int, keys: list[str], target: float = 0.95, question: str = "question_id", vector: str = "vector", order: str = "chunk_index") -> tuple[int, float]:
    """The fewest probes with which these questions find the share ``target`` of their exact k nearest chunks, and the share found.

    Exact answers say in which of its cells a question finds a chunk; the driver sees one count for each number of probes.
    """
    true = nearest(questions, blocks, chunks, cells, k, keys, None, question, vector, order=order).select(question, *keys, order)
    where = blocks.select(*keys, "cell", F.explode("ids").alias(order))
    kind = _kind(questions, question)
    size = cells.centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranks = cells.order(matrix(batch.column(1), size)[0])
            n, count = ranks.shape
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(n), count))), pa.array(ranks.ravel(), pa.int32()), pa.array(np.tile(np.arange(1, count + 1), n), pa.int32())], names=["q", "cell", "place"])

    places = questions.select(question, vector).mapInArrow(run, f"q {kind}, cell int, place int").withColumnRenamed("q", question)
    counts = dict(true.join(where, [*keys, order]).join(places, [question, "cell"]).groupBy("place").count().collect())
    whole, so_far = sum(counts.values()), 0
    for p in range(1, len(cells.centroids) + 1):
        so_far += counts.get(p, 0)
        if so_far >= target * whole:
            return p, so_far / max(whole, 1)
    return len(cells.centroids), 1.0

