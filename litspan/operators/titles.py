"""Requests against titles: contained ones by one automaton, similar ones by bounds that leave few pairs to compare.

The titles are scanned once for each block of requests and stay where they are; a block is bounded in rows and in characters, and each task gets it as it is. What is
shuffled is results: matches, or at most the wanted number of suggestions for each request from each task; and, for ratios, the titles themselves, of which equal ones are compared once.

The ratio of two titles is twice the characters in their matching blocks over all characters. Such characters are a common subsequence, and of
common characters: pairs are left out by lengths, then by the overlap of their characters (unary counts as bits, so that a
pair takes four words), then by the longest common subsequence of a few of their characters with all others they have in common, then by that of all their characters (a word of bits for
each title, all pairs at once). Only what passes is compared in full, many pairs at once, too.

Of a request with an accepted title only the best one counts, of others no more than the wanted number. So a few titles that share a seed (a run of characters) with a request are compared first: the
best ratio among them, if it is accepted, is the least that any other title must reach, and the bounds leave next to nothing at that height; without one, what the wanted number of them reach is.
Seeds only raise bounds; every title still meets every request's bounds.
"""

from __future__ import annotations

import bisect
import difflib
import math
from collections.abc import Iterator
from functools import partial

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from litspan.functions import text as T
from litspan.sources.scratch import stored

ACCEPT, SUGGEST = 0.82, 0.72
ROWS, CHARS = 1 << 14, 1 << 22  # requests of a block
TASKS = 4  # for each core: of the titles
PAIRS, COLUMN = 1 << 16, 1 << 11  # pairs that wait for being compared, and those whose subsequences are made at once
FULL, LONG = 512, 200  # pairs compared in full at once; length from which difflib leaves out frequent characters of a title
WORD, ALL = 64, np.uint64(0xFFFFFFFFFFFFFFFF)
GRAM, SEEDS = 12, 8  # characters of a seed, and seeds of a title: its runs of least hash
#: Characters of a title key and how many of each have a bit. The order of the first ones, a third of a text whose bits are the first word, rules out most pairs that have enough characters in common.
ALPHABET = "insrhdl" + "etao bcfgjkmpquvwxyz0123456789"
LEVELS = np.array([12] * 4 + [5, 5, 6] + [12] * 5 + [5] * 25)
CHOSEN = np.arange(len(ALPHABET) + 1) < 7
EDGE = 1e-9


def keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    """Columns ``key`` and ``__t``: the normal form of non-blank titles."""
    return df.select(key, T.title_key(F.col(text)).alias("__t")).where(F.col("__t") != "")


def blocks(requests: DataFrame) -> Iterator[list[tuple]]:
    """Requests (key, normal form, and what else they have) in lists of bounded size; the driver holds one at a time."""
    held, size = [], 0
    for r in requests.toLocalIterator():
        held.append(tuple(r))
        size += len(r[1])
        if len(held) == ROWS or size > CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _union(parts: list[DataFrame], empty: DataFrame) -> DataFrame:
    for part in parts:
        empty = empty.unionByName(part)
    return empty


def title_matches(requests: DataFrame, papers: DataFrame, request: str = "request_id", query: str = "query", paper: str = "paper_id", title: str = "title") -> DataFrame:
    """Exact matches of each request (the first paper), else all titles that contain it: request, paper, ``match``.

    Equal titles meet in a join; the other requests become an automaton that reads every title once.
    """
    r, p = keyed(requests, request, query), keyed(papers, paper, title)
    exact = r.join(p, "__t").groupBy(request).agg(F.min(paper).alias(paper)).withColumn("match", F.lit("exact"))
    rest = r.join(exact.select(request), request, "left_anti")
    schema = f"`{request}` {r.schema[request].dataType.simpleString()}, `{paper}` {p.schema[paper].dataType.simpleString()}"
    kind = to_arrow_type(r.schema[request].dataType)
    parts = [p.mapInArrow(partial(_contained, asked=block, kind=kind, columns=[request, paper]), schema).withColumn("match", F.lit("substring")) for block in blocks(rest)]
    return _union(parts, exact)


def _contained(batches: Iterator[pa.RecordBatch], asked: list[tuple], kind: pa.DataType, columns: list[str]) -> Iterator[pa.RecordBatch]:
    by: dict[str, list[int]] = {}
    for k, (_, t) in enumerate(asked):
        by.setdefault(t, []).append(k)
    machine = ahocorasick.Automaton()
    for t, rows in by.items():
        machine.add_word(t, rows)
    machine.make_automaton()
    names = [k for k, _ in asked]
    for batch in batches:
        found, at = [], []
        for i, t in enumerate(batch.column(1).to_pylist()):
            own = {k for _, rows in machine.iter(t) for k in rows}
            found += own
            at += [i] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in found], kind), batch.column(0).take(pa.array(at, pa.int64()))], names=columns)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of title keys: lengths, unary counts as four words of bits, characters beyond those bits, and the codes of all characters in a padded matrix."""
    texts = column.to_pylist()
    length = np.array([len(t) for t in texts], np.int64)
    table = np.zeros(256, np.uint8)
    table[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))
    flat = table[np.frombuffer("".join(texts).encode("ascii"), np.uint8)]
    row = np.repeat(np.arange(len(texts)), length)
    counts = np.bincount(row * len(ALPHABET) + flat, minlength=len(texts) * len(ALPHABET)).reshape(-1, len(ALPHABET))
    level = np.concatenate([np.arange(n) for n in LEVELS])
    bits = np.zeros((len(texts), 4 * WORD), bool)
    bits[:, : len(level)] = np.repeat(counts, LEVELS, axis=1) > level
    packed = np.packbits(bits, axis=1).view(np.uint64)
    beyond = np.maximum(counts - LEVELS, 0).sum(axis=1)
    codes = np.full((len(texts), int(length.max(initial=0))), len(ALPHABET), np.uint8)
    codes[row, np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat
    return length, packed, beyond, codes


class Asked:
    """A block of requests (key, normal form and, if known, the least ratio that counts), and the bounds of titles against them."""

    def __init__(self, asked: list[tuple]):
        self.names, self.texts = [x[0] for x in asked], [x[1] for x in asked]
        self.least = np.array([x[2] if len(x) > 2 else SUGGEST for x in asked], float)
        self.length, self.bits, self.beyond, codes = features(pa.array(self.texts, pa.string()))
        #: For requests of one word: at which places each character stands.
        self.places = np.zeros((len(asked), len(ALPHABET) + 1), np.uint64)
        for j in range(min(codes.shape[1], WORD)):
            np.bitwise_or.at(self.places, (np.arange(len(asked)), codes[:, j]), np.uint64(1 << j))
        self.places[:, len(ALPHABET)] = 0

    def able(self, length: np.ndarray, bits: np.ndarray, beyond: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (request, title) that lengths and common characters leave; titles are in order of length."""
        for request, title, _ in self.counted(length, bits, beyond):
            yield request, title

    def counted(self, length: np.ndarray, bits: np.ndarray, beyond: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The pairs of ``able``, and how many characters they have in common at most."""
        words = np.ascontiguousarray(bits.T)
        sizes, first, many = np.unique(length, return_index=True, return_counts=True)
        first = np.append(first, len(length))
        # what two texts have in common is no longer than either of them
        kind = np.min_scalar_type(int(length.max(initial=0)))
        more, most = beyond.astype(kind), self.beyond.clip(max=np.iinfo(kind).max).astype(kind)
        hit, count, all_in = np.empty(len(length), np.uint64), np.empty(len(length), np.uint8), np.empty(len(length), kind)
        low = np.searchsorted(sizes, self.length * self.least / (2 - self.least) - EDGE, "left")
        high = np.searchsorted(sizes, self.length * (2 - self.least) / self.least + EDGE, "right")
        for r, (u, v) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
            lo, hi = first[u], first[v]
            if lo >= hi:
                continue
            common, both, one = all_in[: hi - lo], hit[: hi - lo], count[: hi - lo]
            np.minimum(more[lo:hi], most[r : r + 1], out=common)
            for k in range(len(words)):
                np.bitwise_and(words[k, lo:hi], self.bits[r, k : k + 1], out=both)
                np.add(common, np.bitwise_count(both, out=one), out=common)
            need = np.ceil((self.least[r] * (sizes[u:v] + self.length[r]) - EDGE) / 2).clip(max=np.iinfo(kind).max).astype(kind)
            found = np.flatnonzero(common >= np.repeat(need, many[u:v])) + lo
            if len(found):
                yield np.full(len(found), r), found, common[found - lo]

    def subsequence(self, request: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Upper bounds of the longest common subsequences of pairs: exact for requests of at most a word, their length beyond."""
        out = np.empty(len(request), np.int64)
        flat = self.places.ravel()
        for k in range(0, len(request), COLUMN):
            own = request[k : k + COLUMN]
            at = codes[k : k + COLUMN].T.astype(np.intp, order="C")
            if own[0] == own[-1] and (own == own[0]).all():
                each = np.take(self.places[own[0]], at, mode="clip")
            else:
                at += own * self.places.shape[1]
                each = np.take(flat, at, mode="clip")
            free, hit, more = np.full(len(own), ALL), np.empty(len(own), np.uint64), np.empty(len(own), np.uint64)
            for places in each:
                np.bitwise_and(free, places, out=hit)
                np.add(free, hit, out=more)
                np.subtract(free, hit, out=free)
                np.bitwise_or(free, more, out=free)
            out[k : k + COLUMN] = np.bitwise_count(~free)
        m = self.length[request]
        return np.where(m <= WORD, out, m)

    def matching(self, request: np.ndarray, codes: np.ndarray, need: np.ndarray) -> np.ndarray:
        """Characters in the matching blocks of pairs, of requests of at most a word: as ``difflib`` finds them, or less than ``need`` where they can't be so many.

        The longest common run is a block (of equal ones the first in the request, then in the title); what stands before it in both and what stands after it in both goes on for itself.
        """
        out, pair = np.zeros(len(request), np.int64), np.arange(len(request))
        at = codes.T.astype(np.intp, order="C")
        at += request * self.places.shape[1]
        same = np.take(self.places.ravel(), at, mode="clip")  # of each place of a title, the places of the request with its character
        column, one = np.arange(len(same))[:, None], np.uint64(1)
        while True:
            left = np.minimum(np.count_nonzero(same, axis=0), np.bitwise_count(np.bitwise_or.reduce(same, axis=0, initial=0)))
            going = (left > 0) & (out[pair] + left >= need[pair])
            if not going.any():
                return out
            if not going.all():
                pair, same = pair[going], same[:, going]
            # where runs of a length end, until there are none
            run, ends, size, which = same, same.copy(), np.ones(len(pair), np.int64), np.arange(len(pair))
            while True:
                longer = np.zeros_like(run)
                np.bitwise_and(run[:-1] << one, same[1:, which] if len(which) < len(pair) else same[1:], out=longer[1:])
                some = longer.any(axis=0)
                if not some.any():
                    break
                which, run = which[some], longer[:, some]
                ends[:, which] = run
                size[which] += 1
            every = np.bitwise_or.reduce(ends, axis=0)
            last = every & (~every + one)
            end = ((ends & last) != 0).argmax(axis=0)
            before, after = (last >> (size - 1).astype(np.uint64)) - one, ~((last << one) - one)
            same = same & np.where(column <= end - size, before, np.where(column > end, after, np.uint64(0)))
            out[pair] += size


class Titles:
    """A batch of titles (key, normal form) in order of length, with what bounds need of them."""

    def __init__(self, batch: pa.RecordBatch):
        order = np.argsort(pc.utf8_length(batch.column(1)).to_numpy(zero_copy_only=False), kind="stable")
        self.papers, texts = (batch.column(k).take(pa.array(order)) for k in range(2))
        self.papers, self.texts = self.papers.to_pylist(), texts.to_pylist()
        self.length, self.bits, self.beyond, self.codes = features(texts)
        kept = CHOSEN[self.codes]
        self.chosen = kept.sum(axis=1).astype(np.min_scalar_type(kept.shape[1]))
        #: Their chosen characters only, padded.
        self.part = np.full((len(kept), int(self.chosen.max(initial=0))), len(ALPHABET), np.uint8)
        row = np.repeat(np.arange(len(kept)), self.chosen)
        self.part[row, np.arange(len(row)) - np.repeat(np.cumsum(self.chosen, dtype=np.int64) - self.chosen, self.chosen)] = self.codes[kept]


def in_order(own: Asked, titles: Titles, request: np.ndarray, title: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (with so many characters in common, sorted by request) that the order of their chosen characters leaves, with all others they have in common."""
    most = common - np.bitwise_count(own.bits[request, 0] & titles.bits[title, 0]).astype(np.int64)
    chosen = titles.chosen[title]
    starts = np.append(np.flatnonzero(np.diff(request, prepend=-1)), len(request))
    many = np.diff(starts) >= COLUMN // 4
    groups = [np.arange(starts[k], starts[k + 1]) for k in np.flatnonzero(many)]
    groups.append(np.flatnonzero(~np.repeat(many, np.diff(starts))))
    for group in groups:
        group = group[np.argsort(chosen[group], kind="stable")]  # pairs of few such characters end early
        for k in range(0, len(group), COLUMN):
            some = group[k : k + COLUMN]
            most[some] += own.subsequence(request[some], titles.part[title[some], : chosen[some[-1]]])
    fit = 2 * most >= own.least[request] * (own.length[request] + titles.length[title]) - EDGE
    return request[fit], title[fit]


def _similar(batches: Iterator[pa.RecordBatch], asked: list[tuple], most: int, kind: pa.DataType, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows (request, paper, ratio): of each request the likeliest titles of a task."""
    own = Asked(asked)
    best: list[list[tuple]] = [[] for _ in asked]
    papers_kind = pa.null()
    for batch in batches:
        papers_kind = batch.schema.field(0).type
        titles = Titles(batch)
        waiting, n = [], 0
        for pair in own.counted(titles.length, titles.bits, titles.beyond):
            waiting.append(pair)
            n += len(pair[0])
            if n >= PAIRS:
                _compare(own, waiting, titles, best, most)
                waiting, n = [], 0
        _compare(own, waiting, titles, best, most)
    rows = [(own.names[r], p, -s) for r, held in enumerate(best) for s, p in held]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], kind), pa.array([x[1] for x in rows], papers_kind), pa.array([x[2] for x in rows], pa.float64())], names=columns)


def _compare(own: Asked, waiting: list, titles: Titles, best: list, most: int) -> None:
    if not waiting:
        return
    request, title, common = (np.concatenate(x) for x in zip(*waiting, strict=True))
    for at in range(0, len(request), PAIRS):
        r, t = in_order(own, titles, request[at : at + PAIRS], title[at : at + PAIRS], common[at : at + PAIRS])
        most_common, both = 2 * own.subsequence(r, titles.codes[t]), own.length[r] + titles.length[t]
        fit = most_common >= own.least[r] * both - EDGE
        r, t, bound = r[fit], t[fit], (most_common[fit] + EDGE) / both[fit]
        # the likeliest first: what they reach is the least for the others
        order = np.argsort(-bound, kind="stable")
        for k in range(0, len(order), FULL):
            some = order[k : k + FULL]
            some = some[bound[some] >= own.least[r[some]]]
            for i, j, ratio in zip(r[some].tolist(), t[some].tolist(), _ratios(own, titles, r[some], t[some]).tolist(), strict=True):
                if ratio >= own.least[i]:
                    bisect.insort(best[i], (-ratio, titles.papers[j]))
                    del best[i][most:]
                    if ratio >= ACCEPT:
                        own.least[i] = ratio
                    elif len(best[i]) == most:
                        own.least[i] = max(own.least[i], -best[i][-1][0])


def _ratios(own: Asked, titles: Titles, request: np.ndarray, title: np.ndarray) -> np.ndarray:
    """The ratios of pairs, or a smaller one where it is below the least that counts. Long ones are compared one by one."""
    both = own.length[request] + titles.length[title]
    short = (own.length[request] <= WORD) & (titles.length[title] < LONG)
    size = np.zeros(len(request), np.int64)
    if short.any():
        r, t = request[short], title[short]
        size[short] = own.matching(r, titles.codes[t, : titles.length[t].max()], np.ceil((own.least[r] * both[short] - EDGE) / 2))
    matcher = difflib.SequenceMatcher()
    for k in np.flatnonzero(~short):
        matcher.set_seqs(own.texts[request[k]], titles.texts[title[k]])
        size[k] = sum(b.size for b in matcher.get_matching_blocks())
    return 2.0 * size / both


def _seeded(rows: DataFrame) -> DataFrame:
    """Each row of titles with its seeds, as ``__g``."""
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("__t") - (GRAM - 1)))
    hashes = F.transform(at, lambda i: F.xxhash64(F.substr(F.col("__t"), i, F.lit(GRAM))))
    return rows.select("*", F.explode(F.slice(F.sort_array(F.array_distinct(hashes)), 1, SEEDS)).alias("__g"))


def _ratio(asked: Column, title: Column) -> Column:
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(a=x, b=y).ratio() for x, y in zip(a, b, strict=True)], dtype=float)

    return run(asked, title)


def leasts(requests: DataFrame, papers: DataFrame, request: str, most: int = 1) -> DataFrame:
    """Requests in normal form with ``__least``: an accepted ratio that one of the titles has, else, if so many titles are that like it, the ratio that ``most`` of them reach, else SUGGEST.

    Of the titles with a seed ``most`` are compared, so a request meets ``SEEDS * most`` titles at most; titles are distinct.
    """
    tasks = TASKS * requests.sparkSession.sparkContext.defaultParallelism
    asked = _seeded(requests).repartition(tasks, "__g")
    order = Window.partitionBy("__g").orderBy("__t")
    some = _seeded(papers.select("__t")).join(asked.select("__g").distinct(), "__g").withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most).repartition(tasks, "__g")
    near = asked.join(some.select("__g", F.col("__t").alias("__u")), "__g").select(request, "__t", "__u").distinct()
    near = near.repartition(tasks).select(request, _ratio(F.col("__t"), F.col("__u")).alias("__ratio"))
    ratios = near.where(F.col("__ratio") >= SUGGEST).groupBy(request).agg(F.sort_array(F.collect_list("__ratio"), asc=False).alias("__ratios"))
    highest = F.get("__ratios", F.lit(0))
    best = ratios.select(request, F.when(highest >= ACCEPT, highest).otherwise(F.get("__ratios", F.lit(most - 1))).alias("__ratio"))
    return requests.join(best, request, "left").select(request, "__t", F.coalesce("__ratio", F.lit(SUGGEST)).alias("__least"))


def fuzzy_titles(requests: DataFrame, papers: DataFrame, most: int = 10, request: str = "request_id", query: str = "query", paper: str = "paper_id", title: str = "title") -> DataFrame:
    """The likeliest titles of requests: a best one that is accepted stands alone, else at most ``most`` suggestions: request, paper, ``ratio``, ``accepted``.

    Equal ratios are ordered by paper. Equal titles, and equal requests, are compared once. Blank requests and titles match nothing; keys aren't null.
    """
    r, p = keyed(requests, request, query), keyed(papers, paper, title)
    schema = f"`{request}` {r.schema[request].dataType.simpleString()}, `{paper}` {p.schema[paper].dataType.simpleString()}, ratio double"
    # of equal titles the first stands for all, and no more than ``most`` can be wanted
    equal = Window.partitionBy("__t")
    titled = p.withColumns({"__n": F.row_number().over(equal.orderBy(paper)), "__first": F.min(paper).over(equal)}).where(F.col("__n") <= most)
    # short rows that take long: more files, and more tasks, than their size would make
    tasks = TASKS * requests.sparkSession.sparkContext.defaultParallelism
    titled = stored(titled.repartition(tasks), "title-papers")
    texts = titled.where("__n = 1").select(paper, "__t")
    alike = r.groupBy("__t").agg(F.min(request).alias("__same"))
    asked = stored(leasts(alike.select(F.col("__same").alias(request), "__t"), texts, request, most), "title-requests")
    # each with titles of all lengths
    dealt = texts.repartition(tasks).sortWithinPartitions(F.length("__t"))
    shape = {"most": most, "kind": to_arrow_type(r.schema[request].dataType), "columns": [request, paper, "ratio"]}
    parts = [dealt.mapInArrow(partial(_similar, asked=block, **shape), schema) for block in blocks(asked)]
    near = _union(parts, requests.sparkSession.createDataFrame([], schema))

    def ranked(rows: DataFrame) -> DataFrame:
        order = Window.partitionBy(request)
        told = rows.withColumns({"__r": F.row_number().over(order.orderBy(F.desc("ratio"), paper)), "accepted": F.max("ratio").over(order) >= ACCEPT})
        return told.where(F.when(F.col("accepted"), F.col("__r") == 1).otherwise(F.col("__r") <= most)).select(request, paper, "ratio", "accepted")

    others = titled.select(F.col("__first").alias(paper), F.col(paper).alias("__paper"))
    every = ranked(ranked(near).join(others, paper).select(request, F.col("__paper").alias(paper), "ratio"))
    same = r.join(alike, "__t").select("__same", F.col(request).alias("__request"))
    return every.withColumnRenamed(request, "__same").join(same, "__same").select(F.col("__request").alias(request), paper, "ratio", "accepted")
