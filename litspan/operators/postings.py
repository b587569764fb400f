"""Topic search by an inverted index: many requests at once, the best papers of each without reading every text.

A topic is found as a substring of the lower-cased title or abstract, and ranked by its occurrences, in the title twice. The index lists each word's
papers, one segment of them after the other, in blocks by falling weight (occurrences, in the title twice), and each block tells its largest. A topic's words are runs of letters and
digits; those inside it stand in a text as they are, the first and the last may be ends of longer words. So a topic's rarest word gives candidates
and an upper bound of each one's rank; a first look at the best blocks gives the k-th best rank so far, and only blocks that can reach it are
read. Candidates are checked in their texts, so the rows are those of a scan.

Topics without a word are sought by scanning, with one automaton. Blank topics find nothing. Papers and requests have one row for each id.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from itertools import count

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from litspan.functions import text as T
from litspan.sources.scratch import stored

#: Runs of ASCII letters and digits and of all that is beyond ASCII, in lower case: a class that every library sees alike.
WORD = re.compile(r"[0-9a-z\u0080-\U0010ffff]+")
BLOCK = 256  # papers of a block
BUCKETS = 64  # partitions of the stored index, by hash of the word
LOOK = 4  # times k candidates are checked at the first look
PATTERNS = 1 << 14  # topics whose words are sought in the index's words at once
FEW = 256  # texts that a task has as Python strings at once
SEGMENT = 1 << 21  # words of papers after which a segment ends
SENT = 1 << 14  # blocks that leave a task at once
BLOCKS = "word string, first boolean, most int, ids array<{kind}>, weights array<int>"


def occurrences(text: Column, wanted: Column) -> Column:
    """How often a text holds a non-empty one, counted from the left without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, wanted, F.lit("")))) / F.length(wanted)).cast("int")


def relevance(title: Column, body: Column, topic: Column) -> Column:
    """Occurrences of a topic (in lower case), in the title twice."""
    return occurrences(F.lower(T.text(title)), topic) * 2 + occurrences(F.lower(T.text(body)), topic)


def build(papers: DataFrame, paper: str = "paper_id", title: str = "title", body: str = "abstract", block: int = BLOCK) -> DataFrame:
    """The index as blocks: bucket, word, first (whether a segment's first of the word), most, ids, weights.

    Each task cuts its papers into segments of bounded size and turns them over where they are: what leaves it are blocks, not a row for each word of each paper.
    """
    kind = papers.schema[paper].dataType.simpleString()
    texts = papers.select(paper, F.lower(T.text(title)).alias("title"), F.lower(T.text(body)).alias("body"))
    blocks = texts.mapInArrow(partial(_segments, most=block), BLOCKS.format(kind=kind))
    return blocks.select(bucket().alias("bucket"), "*")


def bucket() -> Column:
    """The partition of a row's word."""
    return F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int")


def _segments(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Papers (id, title, body) as blocks of their words, segment by segment."""
    codes, weights, sizes, ids = array("i"), array("i"), array("i"), []
    numbers: defaultdict = defaultdict(count().__next__)
    for rows in _few(batches):
        ids.append(rows.column(0).take(pa.array(np.arange(rows.num_rows))))  # a copy: a slice would hold its batch's texts
        for t, b in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True):
            own = Counter(WORD.findall(b))
            for w in WORD.findall(t):
                own[w] += 2
            codes.extend(map(numbers.__getitem__, own))
            weights.extend(own.values())
            sizes.append(len(own))
        if len(codes) >= SEGMENT:
            yield from _cut_blocks(numbers, codes, weights, sizes, ids, most)
            codes, weights, sizes, ids = array("i"), array("i"), array("i"), []
            numbers = defaultdict(count().__next__)
    if codes:
        yield from _cut_blocks(numbers, codes, weights, sizes, ids, most)


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches' rows, FEW at a time: so many texts are Python's at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, FEW):
            yield batch.slice(k, FEW)


def _cut_blocks(numbers: dict[str, int], codes: array, weights: array, sizes: array, ids: list[pa.Array], most: int) -> Iterator[pa.RecordBatch]:
    """A segment's blocks. ``numbers`` are the words' codes, counted up; ``codes`` and ``weights`` are listed paper by paper, ``sizes`` tells how many each paper has."""
    code, weight = np.frombuffer(codes, np.int32).astype(np.int64), np.frombuffer(weights, np.int32)
    order = np.argsort((code << 32) - weight, kind="stable")
    code, weight, at = code[order], weight[order], np.arange(len(order))
    papers = pa.chunked_array(ids).combine_chunks().take(pa.array(np.repeat(np.arange(len(sizes)), sizes)[order]))
    place = at - np.maximum.accumulate(np.where(np.diff(code, prepend=-1) != 0, at, 0))
    edges = np.flatnonzero(place % most == 0)
    words, weight, ends = pa.array(list(numbers), pa.string()), pa.array(weight), np.append(edges, len(order))
    for k in range(0, len(edges), SENT):
        own, cut = edges[k : k + SENT], ends[k : k + SENT + 1]
        lists = [pa.ListArray.from_arrays(pa.array(cut - cut[0], pa.int32()), x.slice(cut[0], cut[-1] - cut[0])) for x in (papers, weight)]
        yield pa.RecordBatch.from_arrays([words.take(pa.array(code[own])), pa.array(place[own] == 0), weight.take(pa.array(own)), *lists], names=["word", "first", "most", "ids", "weights"])


def save(index: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Write the index by bucket, and its words, and read both again: a join on bucket and word reads the buckets of the words asked for. A large bucket is written by several tasks."""
    index.hint("rebalance", "bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{path}/blocks")
    blocks = index.sparkSession.read.schema(index.schema).parquet(f"{path}/blocks")
    words = dictionary(blocks)
    words.write.mode("overwrite").parquet(f"{path}/words")
    return blocks, index.sparkSession.read.schema(words.schema).parquet(f"{path}/words")


def dictionary(index: DataFrame) -> DataFrame:
    """The index's words: word, papers (how many have it), most."""
    return index.groupBy("word").agg(F.sum(F.size("ids")).alias("papers"), F.max("most").alias("most"))


def parts(topic: str) -> list[tuple[str, bool, bool]]:
    """A topic's words, and whether more may stand to the left and to the right of each in its text's word."""
    return [(m.group(), m.start() == 0, m.end() == len(topic)) for m in WORD.finditer(topic)]


def expanded(rows: list[tuple], words: DataFrame, request: str, kind: DataType) -> DataFrame:
    """For each topic of ``rows`` (request, topic) the index's words that its rarest part can stand for: request, word, bucket, times, others.

    ``times`` is how often the part can stand in one word, ``others`` the weight that a paper can gain from the part's other words. The words are read twice: each distinct part's sums
    tell the rarest (the driver has them as it has the topics), then only the rarest parts give rows. A topic with a part that no word can hold has none.
    """
    own = [(r, parts(topic)) for r, topic in rows]
    pieces = list(dict.fromkeys(p for _, ps in own for p in ps))
    found = words.select("word", "papers", "most")
    sums = found.mapInArrow(partial(_summed, pieces=pieces), "piece int, papers bigint, whole bigint").groupBy("piece").agg(F.sum("papers"), F.sum("whole")).collect()
    told = {pieces[n]: (papers, whole) for n, papers, whole in sums}
    asked: dict[tuple, list] = {}
    for r, ps in own:
        if all(p in told for p in ps):
            asked.setdefault(min(ps, key=lambda p: told[p][0]), []).append(r)
    rarest = [(p, told[p][1], rs) for p, rs in asked.items()]
    met = found.mapInArrow(partial(_sought, rarest=rarest, kind=to_arrow_type(kind), request=request), f"`{request}` {kind.simpleString()}, word string, times int, others bigint")
    return met.select(request, "word", bucket().alias("bucket"), "times", "others")


def _finder(pieces: list[tuple[str, bool, bool]]) -> Callable[[str], Iterable[tuple[int, int]]]:
    """A function from a word to the parts that can stand in it, by their places in ``pieces``, and how often: one with both ends open several times, any other once."""
    whole, heads, tails, inner = {}, {}, {}, {}
    for n, (word, left, right) in enumerate(pieces):
        ((inner if right else tails) if left else heads if right else whole)[word] = n
    short, long = sorted({len(w) for w in heads}), sorted({len(w) for w in tails})
    machine = ahocorasick.Automaton()
    for word, n in inner.items():
        machine.add_word(word, n)
    machine.make_automaton()

    def find(word: str) -> Iterable[tuple[int, int]]:
        out = [(whole[word], 1)] if word in whole else []
        for k in short:
            if k > len(word):
                break
            if (n := heads.get(word[:k])) is not None:
                out.append((n, 1))
        for k in long:
            if k > len(word):
                break
            if (n := tails.get(word[-k:])) is not None:
                out.append((n, 1))
        if inner:
            out += Counter(n for _, n in machine.iter(word)).items()
        return out

    return find


def _summed(batches: Iterator[pa.RecordBatch], pieces: list[tuple[str, bool, bool]]) -> Iterator[pa.RecordBatch]:
    """For each part that stands in a task's words: how many papers these have, and the weight that a paper can gain from all."""
    find, papers, whole = _finder(pieces), [0] * len(pieces), [0] * len(pieces)
    for batch in batches:
        for word, have, most in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for n, times in find(word):
                papers[n] += have
                whole[n] += most * times
    own = [n for n, have in enumerate(papers) if have]
    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *(pa.array([x[n] for n in own], pa.int64()) for x in (papers, whole))], names=["piece", "papers", "whole"])


def _sought(batches: Iterator[pa.RecordBatch], rarest: list[tuple], kind: pa.DataType, request: str) -> Iterator[pa.RecordBatch]:
    """Words that the rarest parts (part, weight of all its words, requests) can stand for."""
    find = _finder([p for p, _, _ in rarest])
    for batch in batches:
        out = [(r, word, times, rarest[n][1] - most * times) for word, _, most in zip(*(c.to_pylist() for c in batch.columns), strict=True) for n, times in find(word) for r in rarest[n][2]]
        types = [kind, pa.string(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=[request, "word", "times", "others"])


def _scanned(batches: Iterator[pa.RecordBatch], rows: list[tuple], kind: pa.DataType, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Papers that hold topics without words."""
    by: dict[str, list] = {}
    for r, topic in rows:
        by.setdefault(topic, []).append(r)
    machine = ahocorasick.Automaton()
    for topic, wanted in by.items():
        machine.add_word(topic, wanted)
    machine.make_automaton()
    for batch in batches:
        found, at = [], []
        for i, both in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
            own = {r for text in both for _, wanted in machine.iter(text) for r in wanted}
            found += own
            at += [i] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(found, kind), batch.column(0).take(pa.array(at, pa.int64()))], names=columns)


def top(requests: DataFrame, index: tuple[DataFrame, DataFrame], papers: DataFrame, k: int, request: str = "request_id", topic: str = "topic", paper: str = "paper_id", title: str = "title", body: str = "abstract") -> DataFrame:
    """Each request's k most relevant papers, equal ones by id: request, rank, paper, relevance. ``index`` is what ``save`` gives; topics come in blocks of PATTERNS."""
    asked = requests.select(request, F.lower(T.strip(F.col(topic))).alias("topic")).where(F.col("topic") != "")
    kind = asked.schema[request].dataType
    texts = papers.select(paper, F.lower(T.text(title)).alias("__t"), F.lower(T.text(body)).alias("__b"))
    found = requests.sparkSession.createDataFrame([], f"`{request}` {kind.simpleString()}, `{paper}` {papers.schema[paper].dataType.simpleString()}, relevance int")
    names, wordy, odd = [request, paper], [], []

    def sought() -> DataFrame:
        out = found
        if wordy:
            out = out.unionByName(_looked_up(asked, expanded(list(wordy), index[1], request, kind), index[0], texts, k, request, paper))
        if odd:
            shape = f"`{request}` {kind.simpleString()}, `{paper}` {papers.schema[paper].dataType.simpleString()}"
            met = texts.mapInArrow(partial(_scanned, rows=list(odd), kind=to_arrow_type(kind), columns=names), shape)
            out = out.unionByName(_checked(met, asked, texts, request, paper))
        return out

    for r in asked.toLocalIterator():
        (wordy if parts(r[1]) else odd).append((r[0], r[1]))
        if len(wordy) + len(odd) == PATTERNS:
            found = sought()
            wordy.clear()
            odd.clear()
    best = Window.partitionBy(request).orderBy(F.desc("relevance"), paper)
    return sought().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(request, "rank", paper, "relevance")


def _checked(candidates: DataFrame, asked: DataFrame, texts: DataFrame, request: str, paper: str) -> DataFrame:
    """request, paper, relevance (above 0) of candidates: all topics that a paper is a candidate for meet its text once."""
    wanted = candidates.join(asked, request).groupBy(paper).agg(F.collect_list(F.struct(request, "topic")).alias("__asked"))
    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema}
    met = wanted.join(texts, paper).select(paper, "__t", "__b", "__asked")
    return met.mapInArrow(partial(_counted, names=[request, paper, "relevance"]), f"`{request}` {kinds[request]}, `{paper}` {kinds[paper]}, relevance int")


def _counted(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Occurrences of each paper's topics, in the title twice, counted from the left without overlaps."""
    for rows in _few(batches):
        requests, topics = rows.column(3).flatten().flatten()
        at, texts = np.repeat(np.arange(rows.num_rows), pc.list_value_length(rows.column(3))), list(zip(rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True))
        times = [2 * texts[i][0].count(w) + texts[i][1].count(w) for i, w in zip(at.tolist(), topics.to_pylist(), strict=True)]
        kept = pa.array(np.flatnonzero(times))
        yield pa.RecordBatch.from_arrays([requests.take(kept), rows.column(0).take(pa.array(at).take(kept)), pa.array(times, pa.int32()).take(kept)], names=names)


def asked_blocks(blocks: DataFrame, told: DataFrame) -> DataFrame:
    """The blocks of the words in ``told``; of a stored index only their buckets (at most BUCKETS numbers, which the driver sees) are read."""
    buckets = [r[0] for r in told.select("bucket").distinct().collect()]
    return blocks.where(F.col("bucket").isin(buckets)).join(told, ["bucket", "word"])


def _looked_up(asked: DataFrame, told: DataFrame, blocks: DataFrame, texts: DataFrame, k: int, request: str, paper: str) -> DataFrame:
    """request, paper, relevance of all papers that can be among a request's k best: a look at the best blocks, then the blocks that can still reach the k-th."""

    def bounds(some: DataFrame) -> DataFrame:
        one = some.select(request, "times", F.explode(F.arrays_zip("ids", "weights")).alias("p"))
        return one.groupBy(request, F.col("p.ids").alias(paper)).agg(F.sum(F.col("p.weights") * F.col("times")).alias("bound"))

    told = stored(told, "topic-words")
    met, by = asked_blocks(blocks, told), Window.partitionBy(request)
    first = bounds(met.where("first")).withColumn("__r", F.row_number().over(by.orderBy(F.desc("bound"), paper))).where(F.col("__r") <= LOOK * k)
    looked = stored(first.select(request, paper), "topic-look")
    seen = _checked(looked, asked, texts, request, paper).withColumn("__r", F.row_number().over(by.orderBy(F.desc("relevance"), paper)))
    least = stored(seen.where(F.col("__r") == k).select(request, F.col("relevance").alias("least"), F.col(paper).alias("__last")), "topic-borders")
    reach = F.coalesce("least", F.lit(1))
    able = met.join(least, request, "left").where(F.col("most") * F.col("times") + F.col("others") >= reach)
    # with the bound of the k-th, only papers up to it by id can stand before it
    ahead = (F.col("bound") > reach) | F.col("__last").isNull() | (F.col(paper) <= F.col("__last"))
    candidates = bounds(able).join(least, request, "left").where((F.col("bound") >= reach) & ahead)
    return _checked(candidates.select(request, paper), asked, texts, request, paper)
