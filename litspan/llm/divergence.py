"""How far the sources of a language stand apart in their words, by an inverted index of corrections to a baseline.

A pair of sources begins at V times the distance of two zero counts, V being the language's number of kept terms. A term that only one of them
has corrects that by an amount which depends on its count there alone, so such corrections are summed over each source's histogram of
counts. Only terms that both have are met in the index: a posting is a term's sources with their counts, and a task sums the
corrections of its postings in tiles of sources by sources before anything is sent on. All numbers are integers.

Null language, source and text count as empty. Groups without terms, and languages without kept terms, are there, with values of 0 for the latter's pairs.
Repeated rows are documents each, ids aren't read, ties are ordered by the item's UTF-8 bytes, an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litspan.llm.common import checkpointed, shuffle_width

SCALE = 1_000_000_000  # parts of a share
LEAST_DOCS = 10  # documents of its language that hold a kept term
TERMS = 10  # ranks of part ``term``
HELD = 1 << 18  # counts that a task holds before it passes them on
TILE = 512  # sources of a language on each side of a tile
TILES = 48  # tiles that a task holds before it passes their sums on
#: Bytes outside A-Z, a-z and beyond ASCII become blanks; A-Z become a-z.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def counted(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", most: int = HELD) -> DataFrame:
    """Partial sums (lang, source, term, n, docs) of the terms' occurrences and documents: one pass, summed within each task."""
    frame = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0
        for batch in batches:
            for l, s, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):  # noqa: E741
                n, d = held.setdefault((l, s), (Counter(), Counter()))
                words = t.encode().translate(LETTERS).split()
                size -= len(n)
                n.update(words)
                d.update(set(words))
                size += len(n)
                if size > most:
                    yield from _partials(held)
                    held, size = {}, 0
        yield from _partials(held)

    return frame.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")


def _partials(held: dict) -> Iterator[pa.RecordBatch]:
    names = ["lang", "source", "term", "n", "docs"]
    for (l, s), (n, d) in held.items():  # noqa: E741
        terms = list(n)
        for k in range(0, len(terms), 1 << 16):
            part = terms[k : k + (1 << 16)]
            columns = [[l] * len(part), [s] * len(part), [t.decode() for t in part], [n[t] for t in part], [d[t] for t in part]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string()] * 3 + [pa.int64()] * 2, strict=True)], names=names)


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), three digits at a time so that no product overflows."""
    rest, whole = f"({count} + 2)", f"({total} + 2 * {terms})"
    digits = []
    for _ in range(3):
        digits.append(f"(({rest} * 1000) div {whole})")
        rest = f"(({rest} * 1000) % {whole})"
    return F.expr(f"1 + {digits[0]} * 1000000 + {digits[1]} * 1000 + {digits[2]}")


def apart(p: str, q: str) -> str:
    """floor((p - q)^2 / (p + q))."""
    return f"((({p}) - ({q})) * (({p}) - ({q}))) div (({p}) + ({q}))"


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", most: int = HELD, tile: int = TILE) -> DataFrame:
    """Columns lang, source, part (pair or term), item, value, rank.

    The texts are read once; what is shuffled is each task's sums. The kept terms' counts are written, then joined to the groups' totals; the last exchanges carry pairs of sources and ranked terms.
    """
    counts = counted(docs, lang, source, text, most).repartition(shuffle_width(docs), "lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    posting = F.collect_list(F.struct("source", "n")).alias("posting")
    postings = counts.groupBy("lang", "term").agg(F.sum("docs").alias("held"), F.sum("n").alias("all"), posting).where(F.col("held") >= LEAST_DOCS).drop("held")
    # everything else comes from the kept terms' counts, which are few beside the texts
    rows = checkpointed(postings.select("lang", "term", "all", F.explode("posting").alias("p")).select("lang", "term", "all", "p.source", "p.n"))

    sizes = rows.select("lang", "term", "all").distinct().groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all").alias("total"))
    totals = rows.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    names = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source")))).distinct()
    groups = names.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["own", "terms", "total"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = groups.withColumn("place", place).withColumn("zero", F.when(F.col("terms") > 0, share("0L", "own", "terms")).otherwise(F.lit(0)))

    ranked = rows.join(groups, ["lang", "source"]).select("lang", "source", "term", share("n", "own", "terms").alias("p"), share("all", "total", "terms").alias("q")).where("p > q")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = ranked.select("lang", "source", F.col("term").alias("item"), F.expr(apart("p", "q")).alias("value")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= TERMS)

    pairs = _pairs(rows, groups, tile).withColumn("rank", F.row_number().over(best))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(*columns).union(terms.withColumn("part", F.lit("term")).select(*columns))


def _pairs(rows: DataFrame, groups: DataFrame, tile: int) -> DataFrame:
    """lang, source, item, value of every ordered pair of sources of a language."""
    a = groups.select("lang", F.col("source").alias("a"), F.col("place").alias("i"), F.col("zero").alias("x"), "terms")
    b = groups.select("lang", F.col("source").alias("b"), F.col("place").alias("j"), F.col("zero").alias("y"))
    every = a.join(b, "lang").where("i != j")  # the result's own rows
    baseline = every.select("lang", "i", "j", F.expr(f"CASE WHEN terms > 0 THEN terms * ({apart('x', 'y')}) ELSE 0 END").alias("value"))

    # terms that one of the two has: by its histogram of counts
    shares = rows.join(groups, ["lang", "source"]).select("lang", "term", "place", "zero", share("n", "own", "terms").alias("p"))
    histogram = shares.groupBy("lang", "place", "zero", "p").agg(F.count("*").alias("times"))
    alone = histogram.join(b, "lang").where("place != j").select("lang", F.col("place").alias("i"), "j", F.expr(f"times * (({apart('p', 'y')}) - ({apart('zero', 'y')}))").alias("value"))
    alone = alone.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    mirrored = alone.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "value")

    index = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("place", "p", "zero")).alias("posting")).where(F.size("posting") > 1).select("lang", "posting")
    both = index.mapInArrow(partial(corrections, tile=tile), "lang string, i int, j int, value bigint")
    summed = baseline.union(alone).union(mirrored).union(both).groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    named = summed.join(a.select("lang", "a", "i"), ["lang", "i"]).join(b.select("lang", "b", "j"), ["lang", "j"])
    return named.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value")


def corrections(batches: Iterator[pa.RecordBatch], tile: int) -> Iterator[pa.RecordBatch]:
    """Sums over a task's postings of what a term that both sources have adds to the two corrections of a term that one has."""
    tiles: dict[tuple[str, int, int], np.ndarray] = {}
    for batch in batches:
        langs, postings = batch.column(0).to_pylist(), batch.column(1)
        flat, edges = postings.flatten(), postings.offsets.to_numpy() - postings.offsets[0].as_py()
        place, p, zero = (flat.field(k).to_numpy() for k in range(3))
        for k, lang in enumerate(langs):
            span = slice(edges[k], edges[k + 1])
            order = np.argsort(place[span], kind="stable")
            at, own, none = place[span][order], p[span][order], zero[span][order]
            blocks = np.flatnonzero(np.diff(at // tile, prepend=-1))
            parts = [slice(s, e) for s, e in zip(blocks, [*blocks[1:], len(at)], strict=True)]
            for r in parts:
                for c in parts:
                    key = lang, int(at[r.start]) // tile, int(at[c.start]) // tile
                    if key not in tiles:
                        if len(tiles) >= TILES:
                            yield from _sums(tiles, tile)
                            tiles = {}
                        tiles[key] = np.zeros((tile, tile), np.int64)
                    x, y, x0, y0 = own[r, None], own[None, c], none[r, None], none[None, c]
                    tiles[key][np.ix_(at[r] % tile, at[c] % tile)] += _apart(x, y) - _apart(x, y0) - _apart(x0, y) + _apart(x0, y0)
    yield from _sums(tiles, tile)


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _sums(tiles: dict, tile: int) -> Iterator[pa.RecordBatch]:
    for (lang, r, c), sums in tiles.items():
        i, j = np.nonzero(sums)
        off = (i + r * tile) != (j + c * tile)
        i, j = i[off], j[off]
        columns = [pa.array([lang] * len(i), pa.string()), pa.array(i + r * tile, pa.int32()), pa.array(j + c * tile, pa.int32()), pa.array(sums[i, j])]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "i", "j", "value"])
