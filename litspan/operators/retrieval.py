"""Vector retrieval and context packing for many questions at once.

Scores are exact cosines in double precision. A single question is an ordered limit, which each partition cuts to k rows before
anything is shuffled; many questions rank within their own group, cut the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litspan.functions import text as T

#: Hits and characters of context by kind of question.
MODES = {"specific": (12, 12_000), "structural": (50, 20_000), "references": (80, 40_000), "section": (None, 80_000)}
TAIL = 30
BETWEEN = "\n\n---\n\n"
BLOCK = (1 << 12, 1 << 14)  # questions and chunks of a paper that are compared at once
SLICE, PAIRS = 256, 1 << 18  # of those, questions in one matrix product and pairs in one sum
LEAST_PART = 200  # a hit that overflows the budget gives its beginning only if more than so much room is left


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """1 minus the cosine distance; null where a vector is null, empty or zero."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def unit(v: Column) -> Column:
    """The vector with norm 1, in double precision; null where it is null, empty or zero."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm))


def section_like(heading: Column, fragment: str) -> Column:
    """Whether a heading contains the fragment in any case; ``%`` and ``_`` in it are wildcards, a lone ``\\`` is itself."""
    pattern, k = [], 0
    while k < len(fragment):
        c = fragment[k]
        if c == "\\" and fragment[k + 1 : k + 2] not in ("%", "_", "\\"):
            pattern.append("\\\\")
        elif c == "\\":
            pattern.append(fragment[k : k + 2])
            k += 1
        else:
            pattern.append(c)
        k += 1
    return heading.ilike("%" + "".join(pattern) + "%")


def heading_like(heading: Column, fragment: Column) -> Column:
    """As ``section_like``, with a fragment for each row."""
    plain = F.regexp_replace(fragment, r"(?<!\\)\\(?![%_\\])", r"\\\\")
    return F.ilike(heading, F.concat(F.lit("%"), plain, F.lit("%")))


def top_k(chunks: DataFrame, vector: list[float] | Column, k: int, embedding: str = "embedding", order: str = "chunk_index") -> DataFrame:
    """The k chunks nearest to one question, by score and then by number. ``vector`` is a list or a column, such as a scalar subquery."""
    asked = vector if isinstance(vector, Column) else F.array(*[F.lit(float(x)) for x in vector])
    scored = chunks.withColumn("__q", asked).withColumn("score", cosine(F.col(embedding), F.col("__q"))).drop("__q")
    return scored.orderBy(F.desc_nulls_last("score"), order).limit(k)


def top_k_batch(questions: DataFrame, chunks: DataFrame, k: int, on: list[str], embedding: str = "embedding", order: str = "chunk_index") -> DataFrame:
    """For each question (question_id, the keys ``on``, vector) the k nearest chunks of its paper; ``order`` tells a paper's chunks apart.

    Blocks of bounded size of a paper's questions and chunks meet, which gives at most k rows for each question and block; pairs are never rows. Other columns are joined to the hits.
    Scores are sums of double products in order, as in ``dot``; a matrix product with its error bound tells which pairs need one.
    """
    some, most = BLOCK
    counts = questions.groupBy(*on).agg(F.ceil(F.count("*") / some).alias("__nq")).join(chunks.groupBy(*on).agg(F.ceil(F.count("*") / most).alias("__nc")), on)
    block = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = [F.col(c).alias(c) for c in on]  # new columns: questions may come from the chunks
    asked = questions.select(*on, "question_id", "vector").join(counts, on).select(*own, "question_id", "vector", block("question_id", "__nq").alias("__q"), each("__nc").alias("__c"))
    held = chunks.select(*on, order, embedding).join(counts, on).select(*own, order, embedding, block(order, "__nc").alias("__c"), each("__nq").alias("__q"))
    kinds = {f.name: f.dataType.simpleString() for f in [*chunks.schema.fields, *questions.schema.fields]}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (*on, "question_id", order)), "score double"])
    keys = [*on, "__q", "__c"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by(order)
        row, at, score = nearest_of_block(left.column("vector"), right.column(embedding), k)
        columns = {c: left.column(c).take(row) for c in (*on, "question_id")}
        return pa.table({**columns, order: right.column(order).take(at), "score": score})

    near = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(run, schema)
    ranked = Window.partitionBy("question_id").orderBy(F.desc_nulls_last("score"), order)
    found = near.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    of_question = [c for c in questions.columns if c not in (*on, "question_id", "vector")]
    of_chunk = [c for c in chunks.columns if c not in (*on, order, embedding)]
    if of_question:
        found = found.join(questions.select("question_id", *of_question), "question_id")
    if of_chunk:
        found = found.join(chunks.select(*on, order, *of_chunk), [*on, order])
    return found.select(*on, *[c for c in questions.columns if c not in (*on, "vector")], *[c for c in chunks.columns if c not in (*on, embedding)], "score", "rank")


def _units(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors with norm 1 by their length: rows and a matrix. Vectors that are null, empty or zero, or hold a null, are left out."""
    lists = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    length = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    values, nulls = flat.cast(pa.float64()).to_numpy(zero_copy_only=False), flat.is_null().to_numpy(zero_copy_only=False)
    start, out = np.cumsum(length) - length, {}
    for d in np.unique(length[length > 0]).tolist():
        rows = np.flatnonzero(length == d)
        at = start[rows][:, None] + np.arange(d)
        rows, m = rows[keep := ~nulls[at].any(axis=1)], values[at[keep]]
        with np.errstate(all="ignore"):
            norm = np.sqrt(_summed(m, m))
            some = (norm > 0) | np.isnan(norm)
            out[d] = rows[some], m[some] / norm[some][:, None]
    return out


def _summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, summed from the first component to the last: the same for equal rows wherever they stand."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def nearest_of_block(questions: pa.ChunkedArray, chunks: pa.ChunkedArray, k: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Of each question's vector the k nearest vectors of a block, earlier ones first of equals: places in both, and scores.

    NaN comes first and null last, as where Spark sorts downwards; a score is null if a vector has no unit form or another length.
    """
    asked, held = _units(questions), _units(chunks)
    parts, rest = [], np.arange(len(questions))
    for d, (rows, q) in asked.items():
        rest = np.setdiff1d(rest, rows)
        places, c = held.get(d, (np.zeros(0, np.int64), np.zeros((0, d))))
        others = np.setdiff1d(np.arange(len(chunks)), places)[: max(0, k - len(places))]
        for i in range(0, len(rows), SLICE):
            with np.errstate(all="ignore"):
                r, at, score = _ranked(q[i : i + SLICE], c, k)
            parts.append((rows[i + r], places[at], score, np.zeros(len(r), bool)))
        parts.append(_without_score(rows, others))
    parts.append(_without_score(rest, np.arange(min(k, len(chunks)))))
    row, at, score, null = (np.concatenate(x) for x in zip(*parts, strict=True))
    return pa.array(row, pa.int64()), pa.array(at, pa.int64()), pa.array(score, pa.float64(), mask=null)


def _without_score(rows: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(rows) * len(places)
    return np.repeat(rows, len(places)), np.tile(places, len(rows)), np.zeros(n), np.ones(n, bool)


def _ranked(q: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of two matrices, and their products, that are among the k greatest of their row of ``q``."""
    if not len(c):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    near = q @ c.T
    near[np.isnan(near)] = np.inf
    if len(c) > k:
        # both ways of summing are within d roundings of the products' absolute sum
        most = np.nanmax(np.abs(q).sum(axis=1)) * np.nanmax(np.abs(c), initial=0.0) if np.isfinite(q).any() else 0.0
        least = np.partition(near, len(c) - k, axis=1)[:, len(c) - k] - 8 * q.shape[1] * np.finfo(float).eps * most
        row, at = np.nonzero(near >= least[:, None])
    else:
        row, at = (x.ravel() for x in np.indices(near.shape))
    score = np.concatenate([_summed(q[row[i : i + PAIRS]], c[at[i : i + PAIRS]]) for i in range(0, len(row), PAIRS)])
    by = np.lexsort((at, -np.where(np.isnan(score), np.inf, score), row))
    row, at, score = row[by], at[by], score[by]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], at[kept], score[kept]


def tail(chunks: DataFrame, paper: str, n: int = TAIL, order: str = "chunk_index") -> DataFrame:
    """The last n chunks of each paper, with score 0; none for n of 0 or less."""
    last = Window.partitionBy(paper).orderBy(F.desc(order))
    return chunks.withColumn("__r", F.row_number().over(last)).where(F.col("__r") <= max(0, n)).drop("__r").withColumn("score", F.lit(0.0))


def merge_tail(hits: DataFrame, tails: DataFrame, keys: list[str]) -> DataFrame:
    """Vector hits and the tail chunks that aren't among them."""
    return hits.unionByName(tails.join(hits.select(*keys).distinct(), keys, "left_anti").select(*hits.columns))


def section_scan(chunks: DataFrame, fragment: str, heading: str = "section_heading") -> DataFrame:
    """All chunks under a heading that contains the fragment."""
    return chunks.where(section_like(F.col(heading), fragment))


def within_budget(hits: DataFrame, group: str, order: list[Column], size: Column, budget: Column) -> DataFrame:
    """A partial result that merges: of each group the first hits of every task, up to the one that reaches the budget.

    Hits before a given one can only grow in number when tasks are put together, so what overflows within a task overflows in the whole. Sorted in place, no exchange.
    """
    columns = hits.columns
    sized = hits.withColumns({"__size": F.coalesce(size, F.lit(0)).cast("long"), "__budget": budget.cast("long")}).where("__size > 0")
    ordered = sized.sortWithinPartitions(F.col(group), *order)
    at = columns.index(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, -1
        for batch in batches:
            keep = []
            for g, n, most in zip(batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist(), batch.column(len(columns) + 1).to_pylist(), strict=True):
                if total < 0 or g != last:
                    last, total = g, 0
                keep.append(most is None or total <= most)
                total += n
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays(kept.columns[: len(columns)], names=columns)

    return ordered.mapInArrow(run, hits.schema)


def pack_sizes(hits: DataFrame, group: str, order: list[Column], size: Column, budget: int | Column, least: int = LEAST_PART) -> DataFrame:
    """Hits of each group while they fit the budget of characters; the first that overflows gives its beginning if enough room is left.

    Adds ``take`` (how many characters go in) by sizes alone, so texts needn't be there yet. Hits that their own task already knows to be beyond the budget aren't sent on; then one
    exchange by group and one running sum.
    """
    budget = F.lit(budget) if isinstance(budget, int) else budget
    hits = within_budget(hits, group, order, size, budget)
    first = Window.partitionBy(group).orderBy(*order)
    total = F.sum(size).over(first.rowsBetween(Window.unboundedPreceding, 0))
    summed = hits.where(size > 0).withColumn("__sum", total).withColumn("__before", F.col("__sum") - size)
    fits = F.col("__sum") <= budget
    partly = (F.col("__before") <= budget) & (budget - F.col("__before") > least)
    return summed.where(fits | partly).withColumn("take", F.when(fits, size).otherwise(budget - F.col("__before")).cast("int")).drop("__sum", "__before")


def pack_context(hits: DataFrame, group: str, order: list[Column], body: str, budget: int | Column, least: int = LEAST_PART) -> DataFrame:
    """``pack_sizes`` of hits with their texts: adds ``packed`` (the text that goes in)."""
    return pack_sizes(hits, group, order, F.length(T.text(body)), budget, least).withColumn("packed", F.substring(F.col(body), F.lit(1), F.col("take"))).drop("take")


def prompt(title: Column, parts: Column, question: Column) -> Column:
    """Title, excerpts and question as one text."""
    head = F.when(T.text(title) != "", F.concat(F.lit("Paper: "), title, F.lit("\n\n"))).otherwise("")
    return F.concat(head, F.lit("Excerpts from the paper:\n\n"), F.array_join(parts, BETWEEN), F.lit(f"{BETWEEN}Question: "), question)


def hit_order(hits: DataFrame, mode: str, tail_first: bool = False) -> list[Column]:
    """The order in which a mode's hits are packed: by score for specific questions, else as in the document.

    With ``tail_first`` references take tail chunks (score 0) before the others by score, an order that document order otherwise overrides.
    """
    if mode == "specific":
        return [F.desc("score"), F.asc("chunk_index")]
    if mode == "references" and tail_first:
        return [F.asc((F.col("score") != 0).cast("int")), F.desc("score"), F.asc("chunk_index")]
    return [F.asc("chunk_index")]
