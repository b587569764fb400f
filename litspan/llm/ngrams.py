"""Similarity join of word n-gram sets by chosen paths.

Every set has a signature of ``COORDINATES`` minima; each is a token of the set, sampled alike for
all sets, so two sets share a given one with a probability equal to their Jaccard similarity. A run starts
a path by splitting all sets on one sampled token. A bucket that is still large and whose members
are not alike is split again, on ``BRANCHES`` more sampled tokens; small buckets, and buckets
whose members are alike on average, are brute-forced. As many runs are made as the recall of a pair
at the threshold needs.

Brute force within a bucket compares sketches (a byte of each of ``SKETCH`` minima) of all its members,
in blocks if it is crowded, each pair of blocks being a task. A pair is a candidate if its estimate is within ``SLACK`` standard
deviations of the threshold; what leaves a task is a spanning forest of its candidates, no pairs.

Candidate components get their whole sets back, and every pair in them whose sizes can be alike is verified by the exact size of
its intersection: a component too large for one task is cut into levels of size, of which only neighbours meet, and those into blocks; a task returns link
counts and a spanning forest, no pairs. Equal sets are one class with a count, whatever the number of copies. Classes are keyed by a digest of 128 bits and numbered.

Words are runs of letters, numbers, combining marks and low lines of the lower-cased text, as in the SQL. A text of one to four words has one
n-gram, of all its words. Defined cases: a null or empty text, or one without words, has no n-gram, links
with nothing and is kept. Rows with one id and text are copies. Rows with a null id follow their class;
a class without any id is linked like others, and of a component without any id the smallest hash of a text is kept.
Ids may be of any ordered type.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litspan.llm import bpe
from litspan.llm.common import checkpointed, join_told, shuffle_width, slices, sorted_groups, texts
from litspan.llm.components import connected_components
from litspan.llm.embeddings import spanning

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
COORDINATES = 32  # minima kept whole, as tokens of paths
SKETCH = 128  # minima of which a byte is kept
BRANCHES = 2
SMALL = 512  # sets of a bucket that is brute-forced without a look at its similarity
DEPTH = 5  # splits of a path; what is still large then is brute-forced
ALIKE = 0.5  # mean similarity from which a bucket is not split further
BLOCK = 2048  # sets of a block
BLOCK_BYTES = 16 << 20  # and bytes of their n-grams
SLACK = 4.5  # standard deviations of a signature's estimate that a candidate may be off
_MIX = np.uint64(0x9E3779B97F4A7C15)


def least_agreement(threshold: float) -> int:
    """Bytes of two sketches that agree at least, for a candidate."""
    return math.floor(SKETCH * (threshold - SLACK * math.sqrt(threshold * (1 - threshold) / SKETCH)))


def sketch_miss(threshold: float) -> float:
    """The probability that the sketches of a pair at the threshold agree too little."""
    p = threshold + (1 - threshold) / 256
    return sum(math.comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k) for k in range(least_agreement(threshold)))


def plan_runs(threshold: float = THRESHOLD, recall: float = RECALL, branches: int = BRANCHES, depth: int = DEPTH + 1) -> int:
    """Runs after which a pair at the threshold has met, at the full depth, and passed the sketches with the probability ``recall``."""
    meets = threshold * (1 - (1 - threshold) ** branches) ** (depth - 1)
    missed = max(1 - recall - sketch_miss(threshold), (1 - recall) / 2)
    return math.ceil(math.log(missed) / math.log(1 - meets))


class Words(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 18:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


@cache
def _in_words() -> np.ndarray:
    """Whether a code point is part of a word."""
    table = np.zeros(0x110000, bool)
    table[bpe.members(r"[\p{L}\p{N}\p{M}_]")] = True
    return table


def ngram_sets(batch: list[str], words: Words, n: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's word n-grams."""
    lower = [t.lower() for t in batch]
    whole = "\n".join(["", *lower, ""])  # no word crosses a line
    inside = _in_words()[np.frombuffer(whole.encode("utf-32-le"), np.uint32)]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    hashes = np.fromiter(map(words.__getitem__, map(whole.__getitem__, map(slice, starts.tolist(), ends.tolist()))), np.uint64, len(starts))
    borders = np.searchsorted(starts, np.cumsum([1, *(len(t) + 1 for t in lower)]))
    out = []
    for lo, hi in zip(borders, borders[1:], strict=False):
        size = min(n, hi - lo)
        if not size:
            out.append(np.zeros(0, np.uint64))
            continue
        mixed = np.full(hi - lo - size + 1, size, np.uint64)
        for k in range(lo, lo + size):
            mixed = (mixed ^ hashes[k : k + len(mixed)]) * _MIX
            mixed ^= mixed >> np.uint64(29)
        out.append(np.unique(mixed))
    return out


def _factors(count: int = SKETCH, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).integers(1 << 30, 1 << 31, count, np.uint32) * np.uint32(2) + np.uint32(1)


def minima(grams: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Minima of the set under one hash function for each factor, as unsigned 32-bit."""
    short = (grams >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(factors), np.iinfo(np.uint32).max, np.uint32)
    for k in range(0, len(short), 512):
        part = short[k : k + 512]
        for i in range(0, len(factors), 16):
            np.minimum(least[i : i + 16], (factors[i : i + 16, None] * part).min(axis=1), out=least[i : i + 16])
    # the smallest products lie close to 0; mixing spreads them over the bytes that are kept
    least ^= least >> np.uint32(15)
    least *= np.uint32(0x2C1B3C6D)
    return least ^ (least >> np.uint32(12))


def signatures(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", n: int = WORDS) -> DataFrame:
    """Columns id, row_key (hash of the text), digest (of the set, null if empty), size, tokens, sketch."""
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("row_key"), F.col(text_column).alias("text"))
    factors = _factors()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            whole = texts(batch.column(2))
            for lo, hi in slices(batch, [len(t) for t in whole], 1 << 20):
                sets = ngram_sets(whole[lo:hi], words, n)
                digests = [hashlib.blake2b(s, digest_size=16).digest() if len(s) else None for s in sets]
                least = [minima(s, factors) if len(s) else None for s in sets]
                tokens = [m[:COORDINATES].astype("<u4").tobytes() if m is not None else None for m in least]
                marks = [m.astype(np.uint8).tobytes() if m is not None else None for m in least]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(digests, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(tokens, pa.binary()), pa.array(marks, pa.binary())],
                    names=["id", "row_key", "digest", "size", "tokens", "sketch"],
                )

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, row_key long, digest binary, size long, tokens binary, sketch binary")


def _token(at: str) -> str:
    """SQL: the minimum at a coordinate (4 bytes, as hex digits)."""
    return f"hex(substring(tokens, 4 * ({at}) + 1, 4))"


def buckets(classes: DataFrame, runs: int) -> DataFrame:
    """Final buckets of all runs with two members or more: key, node, blocks (over 1 if crowded).

    Only keys and nodes are dealt out; tokens travel where a large bucket is split.
    """
    starts = ", ".join(f"xxhash64({r}, {_token(str(r))})" for r in range(runs))
    paths = classes.select(F.expr(f"explode(array({starts}))").alias("key"), "node")
    crowd = F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")
    done: DataFrame | None = None
    for depth in range(DEPTH + 1):
        paths = checkpointed(paths)
        counts = paths.groupBy("key").count().where("count > 1")
        sized = checkpointed(join_told(paths, counts, "key", "count", paths.count(), "inner"))
        if depth == DEPTH:
            return done.union(sized.select("key", "node", crowd))
        small = sized.where(F.col("count") <= SMALL).select("key", "node", F.lit(1).alias("blocks"))
        done = small if done is None else done.union(small)
        large = sized.where(F.col("count") > SMALL)
        if large.isEmpty():
            return done
        members = checkpointed(large.join(classes.select("node", "tokens"), "node"))
        # the mean similarity of a bucket: how often two members share one of four sampled tokens
        probes = members.select("key", "count", F.expr(f"explode(transform(sequence(0, 3), j -> xxhash64(j, {_token(f'pmod(hash(key, j, -1), {COORDINATES})')})))").alias("token"))
        shares = probes.groupBy("key", "token").agg(F.count("*").alias("n"), F.first("count").alias("count"))
        alike = shares.groupBy("key").agg((F.sum(F.col("n") * F.col("n")) / F.first(4.0 * F.col("count") * F.col("count"))).alias("mean"), F.first("count").alias("many"))
        alike = checkpointed(alike.select("key", "many", (F.col("mean") >= ALIKE).alias("alike")))  # joined in parts, so probed once before that
        judged = checkpointed(join_told(members, alike, "key", "many", members.count(), "inner"))
        done = done.union(judged.where("alike").select("key", "node", crowd))
        split = judged.where("NOT alike")
        branch = f"explode(transform(sequence(1, {BRANCHES}), j -> xxhash64(key, j, {_token(f'pmod(hash(key, j), {COORDINATES})')})))"
        paths = split.select(F.expr(branch).alias("key"), "node")
    return done


def in_pairs_of_blocks(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Deal rows (key, node, ``blocks``) out to every task in which their block takes part: key, p, q, own, columns; sorted.

    A bucket of one block is one task; others have one for each pair of blocks p <= q. With columns ``level``, ``below`` and
    ``above`` (blocks of the neighbouring levels) the blocks are those of a level, and pairs are made within it and with its neighbours only.
    """
    level, below, above = (F.col(c) if c in rows.columns else F.lit(0) for c in ("level", "below", "above"))
    name = lambda at, b: (at.cast("long") * (1 << 32) + b)
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    own = name(level, mine)
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    pair = lambda p, q: F.struct(p.alias("p"), q.alias("q"))
    tasks = F.concat(
        F.transform(upto(F.col("blocks")), lambda b: pair(name(level, F.least(b, mine)), name(level, F.greatest(b, mine)))),
        F.transform(upto(above), lambda b: pair(own, name(level + 1, b))),
        F.transform(upto(below), lambda b: pair(name(level - 1, b), own)),
    )
    dealt = rows.select(key, F.explode(tasks).alias("task"), own.alias("own"), *columns)
    dealt = dealt.select(key, F.col("task.p").alias("p"), F.col("task.q").alias("q"), "own", *columns)
    return dealt.repartition(shuffle_width(rows), key, "p", "q").sortWithinPartitions(key, "p", "q", "own", "node")


def forest(nodes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each node the smallest one it is linked to through pairs of row numbers."""
    order = np.argsort(np.argsort(nodes))
    return np.sort(nodes)[spanning(len(nodes), order[i], order[j])[order]]


def alike_pairs(left: np.ndarray, right: np.ndarray | None, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of sketches that agree in ``least`` bytes or more; without a right side those with i < j."""
    found_i, found_j = [], []
    other = left if right is None else right
    for lo in range(0, len(left), 64):
        for at in range(lo if right is None else 0, len(other), 1024):
            same = (left[lo : lo + 64, None, :] == other[None, at : at + 1024, :]).sum(axis=2, dtype=np.uint8)
            i, j = np.nonzero(same >= least)
            i, j = i + lo, j + at
            kept = i < j if right is None else slice(None)
            found_i.append(i[kept])
            found_j.append(j[kept])
    return np.concatenate(found_i), np.concatenate(found_j)


def candidates(paths: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Candidate links (a, b: nodes) that span the candidates of each bucket."""
    least = least_agreement(threshold)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["key", "p", "q"]):
            if group.num_rows < 2:
                continue
            nodes = group.column("node").to_numpy()
            sketches = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(len(nodes), -1)
            if group.column("p")[0].as_py() == group.column("q")[0].as_py():
                i, j = alike_pairs(sketches, None, least)
            else:
                cut = int((group.column("own").to_numpy() == group.column("p")[0].as_py()).sum())
                if cut in (0, len(nodes)):
                    continue
                i, j = alike_pairs(sketches[:cut], sketches[cut:], least)
                j = j + cut
            if len(i):
                roots = forest(nodes, i, j)
                on = np.flatnonzero(roots != nodes)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[on]), pa.array(roots[on])], names=["a", "b"])

    full = paths.join(classes.select("node", "sketch"), "node")
    return in_pairs_of_blocks(full, "key", ["node", "sketch"]).mapInArrow(link, "a long, b long")


def intersections(sets: list[np.ndarray], cut: int | None = None) -> np.ndarray:
    """Sizes of the pairwise intersections: rows are the first ``cut`` sets and columns the others, or
    both are all sets. N-grams held by few sets are counted pair by pair, others by matrix
    products in which n-grams held by the same sets are one weighted column."""
    n = len(sets)
    rows = np.repeat(np.arange(n), [len(s) for s in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    rows, values = rows[order], values[order]
    begin = np.flatnonzero(np.diff(values, prepend=values[0] ^ np.uint64(1)))
    count = np.diff(begin, append=len(values))
    total = np.zeros((n, n), np.float32)
    few = np.repeat((count > 1) & (count <= 24), count)
    group, held = np.repeat(np.arange(len(count)), count)[few], rows[few]
    for off in range(1, 24):
        same = np.flatnonzero(group[off:] == group[:-off])
        if not len(same):
            break
        np.add.at(total.ravel(), held[same] * n + held[same + off], 1)
    many = np.flatnonzero(count > 24)
    if len(many):
        names = np.random.default_rng(5).integers(0, 1 << 63, n, np.uint64)
        marks = np.add.reduceat(names[rows], begin)[many]
        _, first, weight = np.unique(marks, return_index=True, return_counts=True)
        for k in range(0, len(first), 2048):
            chosen = many[first[k : k + 2048]]
            x = np.zeros((n, len(chosen)), np.float32)
            for c, g in enumerate(chosen):
                x[rows[begin[g] : begin[g] + count[g]], c] = 1
            w = weight[k : k + 2048].astype(np.float32)
            if cut is None:
                total += np.triu((x * w) @ x.T, 1)
            else:
                total[:cut, cut:] += (x[:cut] * w) @ x[cut:].T
    return total if cut is None else total[:cut, cut:]


def verified(docs: DataFrame, members: DataFrame, threshold: float, n: int = WORDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """For each class with exact links: node, links, parent.

    ``members`` has component, node, id, row_key, copies, size. Every pair of a component whose sizes can be alike is
    compared; the texts of candidates are shuffled once.
    """
    blocks = F.greatest(F.ceil(F.col("sets") / BLOCK), F.ceil(F.col("grams") * 8 / BLOCK_BYTES)).cast("int")
    graded = members.withColumn("level", F.floor(F.log("size") / -math.log(threshold)).cast("int"))
    levels = graded.groupBy("component", "level").agg(F.count("*").alias("sets"), F.sum("size").alias("grams"))
    whole = Window.partitionBy("component")
    order = whole.orderBy("level")
    beside = lambda f, by: F.coalesce(F.when(f("level").over(order) == F.col("level") + by, f("blocks").over(order)), F.lit(0))
    levels = levels.withColumn("blocks", blocks).withColumns({"all_sets": F.sum("sets").over(whole), "all_grams": F.sum("grams").over(whole), "below": beside(F.lag, -1), "above": beside(F.lead, 1)})
    one = (F.col("all_sets") <= BLOCK) & (F.col("all_grams") * 8 <= BLOCK_BYTES)  # of the whole component: no levels
    levels = levels.select(F.struct("component", "level").alias("at"), "sets", one.alias("one"), *[F.when(one, other).otherwise(F.col(c)).alias(c) for c, other in (("blocks", 1), ("below", 0), ("above", 0))])
    wanted = join_told(graded.withColumn("at", F.struct("component", "level")), levels, "at", "sets", members.count(), "inner")
    wanted = wanted.withColumn("level", F.when(F.col("one"), 0).otherwise(F.col("level")))
    columns = ["component", "blocks", "level", "below", "above", "node", "copies"]
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("row_key"), F.col(text_column).alias("text"))
    wanted = wanted.select(*columns, F.col("id").alias("wanted_id"), F.col("row_key").alias("wanted_key"))
    whole = rows.join(wanted, F.col("id").eqNullSafe(F.col("wanted_id")) & (F.col("row_key") == F.col("wanted_key"))).select(*columns, "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        seen: set[int] = set()  # rows that repeat an id and a text come back for one class
        for batch in batches:
            fresh = [n not in seen and not seen.add(n) for n in batch.column(5).to_pylist()]
            batch = batch.filter(pa.array(fresh))
            whole = texts(batch.column(7))
            for lo, hi in slices(batch, [len(t) for t in whole], 1 << 20):
                found = [s.tobytes() for s in ngram_sets(whole[lo:hi], words, n)]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[:7], pa.array(found, pa.binary())], names=[*columns, "grams"])

    grams = whole.mapInArrow(sets, "component long, blocks int, level int, below int, above int, node long, copies long, grams binary")
    dealt = in_pairs_of_blocks(grams, "component", ["node", "copies", "grams"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, ["component", "p", "q"]):
            _, first = np.unique(group.column("node").to_numpy(), return_index=True)  # a class may come back from several equal rows
            if len(first) < 2:
                continue
            group = group.take(pa.array(np.sort(first)))
            p, q = group.column("p")[0].as_py(), group.column("q")[0].as_py()
            nodes, copies = group.column("node").to_numpy(), group.column("copies").to_numpy()
            held = [np.frombuffer(x, np.uint64) for x in group.column("grams").to_pylist()]
            size = np.array([len(s) for s in held], float)
            cut = None if p == q else int((group.column("own").to_numpy() == p).sum())
            if cut in (0, len(nodes)):
                continue
            shared = intersections(held, cut)
            union = (size[:, None] if cut is None else size[:cut, None]) + (size if cut is None else size[cut:]) - shared
            near = shared >= threshold * union - 1e-9
            if cut is None:
                near = np.triu(near, 1)
            i, j = np.nonzero(near)
            if not len(i):
                continue
            j = j if cut is None else j + cut
            links = np.bincount(i, copies[j], len(nodes)) + np.bincount(j, copies[i], len(nodes))
            parent = forest(nodes, i, j)
            on = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(nodes[on]), pa.array(links[on].astype(np.int64)), pa.array(parent[on])], names=["node", "links", "parent"])

    return dealt.mapInArrow(compare, "node long, links long, parent long")


def jaccard_join(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, n: int = WORDS) -> DataFrame:
    """One row for each document: the id, ``row_key`` (hash of the text), ``class_id`` (smallest id with an equal
    set), ``n_links`` (other documents linked directly), ``component_id`` (smallest id reachable), ``kept``."""
    rows = checkpointed(signatures(docs, id_column, text_column, n))
    full = rows.where(F.col("digest").isNotNull())
    named = F.coalesce(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "row_key"))), F.min(F.struct("id", "row_key"))).alias("name")
    classes = full.groupBy("digest").agg(named, F.count("*").alias("copies"), F.first("size").alias("size"), F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch"))
    # numbered and written at once, so the numbers stay
    classes = checkpointed(classes.select(F.monotonically_increasing_id().alias("node"), "digest", "name.id", "name.row_key", "copies", "size", "tokens", "sketch"))
    pairs = candidates(buckets(classes, plan_runs(threshold, recall)), classes, threshold)
    loose = connected_components(pairs)
    members = classes.drop("digest", "tokens", "sketch").join(loose, "node")
    found = checkpointed(verified(docs, checkpointed(members), threshold, n, id_column, text_column))
    links = found.groupBy("node").agg(F.sum("links").alias("more"))
    groups = connected_components(found.select(F.col("node").alias("a"), F.col("parent").alias("b")))
    named = checkpointed(groups.join(classes.select("node", "id", "row_key"), "node"))
    first = named.groupBy("component").agg(F.min("id").alias("component_id"), F.min("row_key").alias("least_key"), F.count("*").alias("n"))
    grouped = join_told(named.select("component", "node"), first, "component", "n", named.count(), "inner").select("node", "component_id", "least_key")
    told = classes.select("node", "digest", F.col("id").alias("class_id"), F.col("row_key").alias("class_key"), "copies").join(links, "node", "left").join(grouped, "node", "left")
    told = told.select("digest", "copies", "class_id", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), F.coalesce("component_id", "class_id").alias("component_id"), F.coalesce("least_key", "class_key").alias("least_key"))
    # only classes of copies or links are joined back; other documents stand alone
    out = join_told(rows.select("id", "row_key", "digest"), checkpointed(told.where("n_links > 0")), "digest", "copies", rows.count())
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_column), "row_key", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.when(component.isNull(), F.coalesce(F.col("row_key") == F.col("least_key"), F.lit(True))).otherwise(F.coalesce(F.col("id") == component, F.lit(False))).alias("kept"),
    )
