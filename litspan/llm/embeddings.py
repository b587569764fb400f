"""Near-duplicate vectors: random-hyperplane signs in several tables, exact cosine, components.

Equal vectors are one class with a count, keyed by a digest and numbered. A class's key in a table is the signs of its products with the
table's hyperplanes. The number of bits follows the number of classes, the number of tables follows
from the bits, so that a pair at the threshold meets in some table, and passes its sketches, with probability ``recall``.

First the classes meet by their keys with sketches only, the signs to ``SKETCH`` more hyperplanes: those without any partner within
``SLACK`` standard deviations of the threshold link with nothing. (In a crowded bucket all count as having one.) The others meet
again with their vectors and are compared by their exact cosine in double precision, as blocks of matrix
products; a pair is counted in the first table in which it meets, so counts need no list of
pairs. A crowded bucket is cut into blocks and each pair of blocks is a task of its own: no
bucket is capped or sampled. Only link counts and each group's spanning links leave a task, and
components are found over those.

Defined cases: a vector that is null, empty, of norm zero, or with a null or non-finite component
links with nothing, and so does a row with a null id (component null, kept). Vectors of different
lengths never meet. Repeated rows are copies of each other and have a row each; one id may stand for several vectors, each with its own links.
Ids may be of any ordered type; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspan.llm.common import checkpointed, join_told, shuffle_width, sorted_groups
from litspan.llm.components import connected_components

THRESHOLD = 0.9
RECALL = 0.998
BUCKET = 256  # classes that a bucket has on average, over all sign patterns
CROWD = 4096  # members of a bucket whose sketches are compared
BLOCK_BYTES = 32 << 20  # doubles of a block of a crowded bucket
SKETCH = 128  # signs of a sketch
SLACK = 4.5  # standard deviations of a sketch's estimate that a partner may be off
FEW_KEYS = 1 << 16  # crowded keys that are broadcast at most


def most_apart(threshold: float = THRESHOLD) -> int:
    """Signs in which the sketches of a candidate pair may differ."""
    p = math.acos(threshold) / math.pi
    return math.floor(SKETCH * p + SLACK * math.sqrt(SKETCH * p * (1 - p)))


def plan_tables(classes: int, threshold: float = THRESHOLD, recall: float = RECALL, bucket: int = BUCKET) -> tuple[int, int]:
    """Bits of a key, and tables needed for the recall of a pair exactly at the threshold."""
    bits = min(30, max(6, math.ceil(math.log2(max(classes, 1) / bucket))))
    p = math.acos(threshold) / math.pi
    lost = 1 - sum(math.comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k) for k in range(most_apart(threshold) + 1))
    missed = max(1 - recall - lost, (1 - recall) / 2)
    return bits, math.ceil(math.log(missed) / math.log(1 - (1 - p) ** bits))


#: Whether a row can link: SQL over columns id and v.
FINE = "id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(v, x -> x <> 0)"


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of norm 1 in double precision, scaled by the largest component first so that no square overflows."""
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def sign_rows(classes: DataFrame, bits: int, tables: int, seed: int = 7) -> DataFrame:
    """For each class (node, v): ``keys``, one for each table (with the table's number and the vector's length in it), and ``sketch``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        powers = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                sizes = part.column(1).value_lengths().to_numpy()
                for dims in map(int, np.unique(sizes)):
                    chosen = part.take(pa.array(np.flatnonzero(sizes == dims)))
                    if dims not in planes:
                        planes[dims] = np.random.default_rng([seed, dims]).standard_normal((dims, bits * tables + SKETCH))
                    signs = matrix(chosen.column(1)) @ planes[dims] > 0
                    keys = signs[:, SKETCH:].reshape(len(signs), tables, bits) @ powers + (np.arange(tables, dtype=np.int64) << 50) + (dims << 30)
                    ends = pa.array(np.arange(0, keys.size + 1, tables, dtype=np.int32))
                    sketches = [x.tobytes() for x in np.packbits(signs[:, :SKETCH], axis=1)]
                    yield pa.RecordBatch.from_arrays([chosen.column(0), pa.ListArray.from_arrays(ends, pa.array(keys.ravel())), pa.array(sketches, pa.binary())], names=["node", "keys", "sketch"])

    return classes.select("node", "v").mapInArrow(run, "node long, keys array<long>, sketch binary")


def with_crowds(rows: DataFrame, most: int) -> DataFrame:
    """``rows`` with ``crowd``, the size of their key's bucket if that is over ``most``, else null."""
    counts = checkpointed(rows.groupBy("key").agg(F.count("*").alias("crowd")).where(F.col("crowd") > most))
    many = counts.count()
    if many <= FEW_KEYS:
        return rows.join(F.broadcast(counts), "key", "left")
    return join_told(rows, counts, "key", "crowd", rows.count())


def partnered(signs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The nodes with a partner, by sketches, in some bucket. Only keys, nodes and sketches are shuffled."""
    apart = most_apart(threshold)
    paths = with_crowds(signs.select(F.explode("keys").alias("key"), "node", "sketch"), CROWD)
    # a crowded bucket isn't compared here, so its rows may go anywhere
    salt = F.when(F.col("crowd").isNotNull(), F.pmod(F.xxhash64("node"), F.lit(1 << 20))).otherwise(F.lit(-1))
    dealt = paths.select("key", salt.alias("salt"), "node", "sketch").repartition(shuffle_width(signs), "key", "salt").sortWithinPartitions("key", "salt")

    def near(sketches: np.ndarray) -> np.ndarray:
        found = np.zeros(len(sketches), bool)
        for lo in range(0, len(sketches), 256):
            part = sketches[lo : lo + 256]
            off = np.bitwise_count(part[:, None, 0] ^ sketches[None, lo:, 0])
            for k in range(1, sketches.shape[1]):
                off += np.bitwise_count(part[:, None, k] ^ sketches[None, lo:, k])
            close = off <= apart
            np.fill_diagonal(close, False)
            found[lo : lo + 256] |= close.any(axis=1)
            found[lo:] |= close.any(axis=0)
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["key", "salt"]):
            nodes = group.column("node").combine_chunks()
            if group.column("salt")[0].as_py() < 0:
                if len(nodes) < 2:
                    continue
                nodes = nodes.filter(pa.array(near(np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint64).reshape(len(nodes), -1))))
            yield pa.RecordBatch.from_arrays([nodes], names=["node"])

    return dealt.mapInArrow(run, "node long").distinct()


def compare(left: tuple, right: tuple | None, slot: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with a cosine of at least the threshold that first meet in this table.

    Each side is (units, keys); without a right side the pairs within the left one, i < j.
    """
    units, keys = left
    other, other_keys = right or left
    found_i, found_j = [], []
    for lo in range(0, len(units), 256):
        near = units[lo : lo + 256] @ other.T >= threshold
        if right is None:
            near &= np.arange(len(other)) > np.arange(lo, lo + len(near))[:, None]
        i, j = np.nonzero(near)
        i += lo
        new = np.ones(len(i), bool)
        for t in range(slot):
            new &= keys[i, t] != other_keys[j, t]
        found_i.append(i[new])
        found_j.append(j[new])
    return np.concatenate(found_i), np.concatenate(found_j)


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n members the smallest index it is linked to through the pairs."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        apart = low != high
        if not apart.any():
            break
        i, j = i[apart], j[apart]
        np.minimum.at(root, high[apart], low[apart])
        while True:
            jumped = root[root]
            if (jumped == root).all():
                break
            root = jumped
    return root


def linked(members: DataFrame, threshold: float = THRESHOLD, block: int | None = None) -> DataFrame:
    """For each class and bucket in which it has links: ``node``, ``links`` (counted once), ``parent``. ``members``: node, copies, v, keys.

    ``block`` is the number of vectors of a block; by default so many that all members in one bucket would make as many pairs of blocks as there are
    partitions, but 256 at least and BLOCK_BYTES at most.
    """
    spread = math.ceil(members.count() / math.sqrt(2 * shuffle_width(members)))
    room = F.lit(block) if block else F.greatest(F.lit(256), F.least(F.floor(F.lit(BLOCK_BYTES / 8) / F.size("v")), F.lit(spread)))
    rows = with_crowds(members.select(F.explode("keys").alias("key"), "node", "copies", "v", "keys"), block or 256)
    rows = rows.withColumn("blocks", F.coalesce(F.ceil(F.col("crowd") / room).cast("int"), F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # the tasks of a block: itself with each block, the lower number first
    tasks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: F.struct(F.least(b, F.col("own")).alias("p"), F.greatest(b, F.col("own")).alias("q")))
    columns = ["own", "node", "copies", "v", "keys"]
    dealt = rows.withColumn("own", own).select("key", F.explode(tasks).alias("task"), *columns).select("key", F.col("task.p").alias("p"), F.col("task.q").alias("q"), *columns)
    dealt = dealt.repartition(shuffle_width(members), "key", "p", "q").sortWithinPartitions("key", "p", "q", "own", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["key", "p", "q"]):
            if group.num_rows < 2:
                continue
            key, p, q = (group.column(c)[0].as_py() for c in ("key", "p", "q"))
            nodes, copies = group.column("node").to_numpy(), group.column("copies").to_numpy()
            units = matrix(group.column("v").combine_chunks())
            keys = group.column("keys").combine_chunks().flatten().to_numpy().reshape(len(nodes), -1)
            if p == q:
                i, j = compare((units, keys), None, key >> 50, threshold)
            else:
                cut = int((group.column("own").to_numpy() == p).sum())
                if cut in (0, len(nodes)):
                    continue
                i, j = compare((units[:cut], keys[:cut]), (units[cut:], keys[cut:]), key >> 50, threshold)
                j = j + cut
            if not len(i):
                continue
            links = np.bincount(i, copies[j], len(nodes)) + np.bincount(j, copies[i], len(nodes))
            order = np.argsort(np.argsort(nodes))  # so that the smallest index is the smallest node
            parent = np.sort(nodes)[spanning(len(nodes), order[i], order[j])[order]]
            on = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[on]), pa.array(links[on].astype(np.int64)), pa.array(parent[on])], names=["node", "links", "parent"])

    return dealt.mapInArrow(run, "node long, links long, parent long")


def near_duplicates(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL, block: int | None = None) -> DataFrame:
    """One row for each vector: the id, n_links, component_id, kept."""
    single = vectors.schema[vector_column].dataType.simpleString() == "array<float>"
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<float>" if single else "array<double>").alias("v"))
    # 128 bits of hashes, in which both zeros are equal
    marked = rows.withColumn("mark", F.when(F.expr(FINE), F.struct(F.xxhash64(F.lit(1), "v").alias("a"), F.xxhash64(F.lit(2), "v").alias("b"))))
    valid = marked.where(F.col("mark").isNotNull())
    classes = valid.groupBy("mark").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("v").alias("v"))
    # numbered and written at once, so the numbers stay
    classes = checkpointed(classes.select(F.monotonically_increasing_id().alias("node"), "mark", "id", "copies", "v"))
    bits, tables = plan_tables(classes.count(), threshold, recall)
    signs = checkpointed(sign_rows(classes, bits, tables))
    members = classes.select("node", "copies", "v").join(partnered(signs, threshold), "node").join(signs.select("node", "keys"), "node")
    found = checkpointed(linked(checkpointed(members), threshold, block))
    links = found.groupBy("node").agg(F.sum("links").alias("more"))
    groups = connected_components(found.select(F.col("node").alias("a"), F.col("parent").alias("b")))
    named = checkpointed(groups.join(classes.select("node", "id"), "node"))
    first = named.groupBy("component").agg(F.min("id").alias("component_id"), F.count("*").alias("n"))
    grouped = join_told(named.select("component", "node"), first, "component", "n", named.count(), "inner").select("node", "component_id")
    told = classes.select("node", "mark", "copies", F.col("id").alias("class")).join(links, "node", "left").join(grouped, "node", "left")
    told = told.select("mark", "copies", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component_id", "class").alias("component_id"))
    # only classes of copies or links are joined back; other vectors stand alone
    out = join_told(marked.select("id", "mark"), checkpointed(told.where("n_links > 0")), "mark", "copies", marked.count())
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
