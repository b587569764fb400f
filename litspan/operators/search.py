"""Structured search: predicates, ordering and pages.

A request becomes one boolean column, so the reader gets what can be pushed down, and a page is an ordered limit.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litspan.functions import text as T

ORDERS = ("relevance", "lastUpdatedDate", "submittedDate")
PAGE_MOST = 500


@dataclass(frozen=True)
class Request:
    """A search request; ``check`` raises where the service would refuse it."""

    topic: str = ""
    author: str = ""
    from_year: int | None = None
    to_year: int | None = None
    categories: tuple[str, ...] = field(default=())
    start: int = 0
    max_results: int = 10
    sort_by: str = "relevance"
    sort_order: str = "descending"

    def check(self) -> Request:
        if not (self.topic.strip() or self.author.strip() or self.from_year is not None or self.to_year is not None or any(c.strip() for c in self.categories)):
            raise ValueError("a search needs a topic, an author, a year or a category")
        for year in (self.from_year, self.to_year):
            if year is not None and not 1900 <= year <= 2100:
                raise ValueError(f"year {year} is not between 1900 and 2100")
        if not 1 <= self.max_results <= PAGE_MOST or self.start < 0:
            raise ValueError("max_results is 1 to 500 and start 0 or more")
        if self.sort_by not in ORDERS or self.sort_order not in ("ascending", "descending"):
            raise ValueError("unknown order")
        return self


def refusal(topic: Column, author: Column, from_year: Column, to_year: Column, categories: Column, size: Column, start: Column, by: Column, order: Column) -> Column:
    """Why a request of a table is refused, as ``Request.check`` does it one at a time; null where it isn't."""
    some = (T.strip(topic) != "") | (T.strip(author) != "") | from_year.isNotNull() | to_year.isNotNull() | F.exists(F.coalesce(categories, F.array().cast("array<string>")), lambda c: T.strip(c) != "")
    year = F.coalesce(F.when(~from_year.between(1900, 2100), from_year), F.when(~to_year.between(1900, 2100), to_year))
    return (
        F.when(~some, "a search needs a topic, an author, a year or a category").when(year.isNotNull(), F.concat(F.lit("year "), year.cast("string"), F.lit(" is not between 1900 and 2100")))
        .when(~size.between(1, PAGE_MOST) | (start < 0), "max_results is 1 to 500 and start 0 or more").when(~by.isin(*ORDERS) | ~order.isin("ascending", "descending"), "unknown order")
    )


def query_text(r: Request) -> str:
    """The request as the catalogue's query string; empty without any part."""
    plain = lambda s: s.strip().replace('"', "").replace("'", "")
    parts = []
    if plain(r.topic):
        parts.append(f'(ti:"{plain(r.topic)}" OR abs:"{plain(r.topic)}")')
    if plain(r.author):
        parts.append(f'au:"{plain(r.author)}"')
    if r.from_year is not None or r.to_year is not None:
        low, high = year_bounds(r.from_year, r.to_year)
        parts.append(f"submittedDate:[{low}01010000 TO {high}12312359]")
    kept = [c.strip() for c in r.categories if c.strip()]
    if kept:
        parts.append("(" + " OR ".join(f"cat:{c}" for c in kept) + ")")
    return " AND ".join(parts)


def year_bounds(low: int | None, high: int | None) -> tuple[int, int]:
    """Both ends, 1900 and 2100 if missing, in ascending order."""
    a, b = 1900 if low is None else low, 2100 if high is None else high
    return min(a, b), max(a, b)


def predicate(r: Request, title: Column, abstract: Column, authors: Column, stamp: Column, categories: Column) -> Column:
    """All constraints of a request at the source: substrings, an inclusive range of years (swapped if reversed), any of the categories."""
    parts = []
    topic, author = r.topic.replace('"', "").replace("'", "").strip().lower(), r.author.replace('"', "").replace("'", "").strip().lower()
    if topic:
        parts.append(F.contains(F.lower(T.text(title)), F.lit(topic)) | F.contains(F.lower(T.text(abstract)), F.lit(topic)))
    if author:
        parts.append(F.contains(F.lower(T.text(authors)), F.lit(author)))
    if r.from_year is not None or r.to_year is not None:
        low, high = year_bounds(r.from_year, r.to_year)
        parts.append(F.date_format(stamp, "yyyyMMddHHmm").between(f"{low}01010000", f"{high}12312359"))
    kept = [c.strip() for c in r.categories if c.strip()]
    if kept:
        parts.append(categories.isin(*kept))
    return reduce(lambda a, b: a & b, parts)


def author_match(authors: Column, wanted: str) -> Column:
    """Whether the joined authors contain the wanted one; a blank one matches all."""
    w = wanted.strip().lower()
    return F.contains(F.lower(T.text(authors)), F.lit(w)) if w else F.lit(True)


def topic_match(title: Column, abstract: Column, wanted: str) -> Column:
    w = wanted.strip().lower()
    return F.contains(F.lower(T.text(title)), F.lit(w)) | F.contains(F.lower(T.text(abstract)), F.lit(w)) if w else F.lit(True)


def year_match(year: Column, low: int | None, high: int | None) -> Column:
    """No bounds match all; an unknown year matches none; reversed bounds aren't swapped here."""
    if low is None and high is None:
        return F.lit(True)
    inside = (year >= low if low is not None else F.lit(True)) & (year <= high if high is not None else F.lit(True))
    return F.coalesce(inside, F.lit(False)) & year.isNotNull()


def relevance(topic: str, title: Column, body: Column) -> Column:
    """Occurrences of the topic, in the title twice. The catalogue's own relevance is unknown; this one is the engine's."""
    w = topic.strip().lower()
    times = lambda c: F.regexp_count(F.lower(T.text(c)), F.lit(_quoted(w)))
    return times(title) * 2 + times(body)


def _quoted(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != " " else c for c in s)


def page(df: DataFrame, order: list[Column], start: int, size: int) -> DataFrame:
    """Rows ``start`` to ``start + size`` in the order, numbered from 1 in ``position``: a top-k with an offset.

    The number comes from the limited rows alone, so the whole result is never sorted in one task.
    """
    top = df.orderBy(*order).offset(start).limit(size)
    return top.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) + start)


def seek(df: DataFrame, order: list[tuple[str, bool]], last: tuple, size: int) -> DataFrame:
    """The ``size`` rows after the one with the values ``last`` of the columns of ``order`` (name, whether descending).

    A deep page without an offset: a predicate that can be pushed down, and a top-k of one page whatever its depth. The columns hold no null and end with a unique one.
    """
    past, equal = F.lit(False), F.lit(True)
    for (name, down), value in zip(order, last, strict=True):
        c, v = F.col(name), F.lit(value)
        past, equal = past | (equal & ((c < v) if down else (c > v))), equal & (c == v)
    return df.where(past).orderBy(*[F.desc(n) if down else F.asc(n) for n, down in order]).limit(size)


def chunk_plan(start: int, needed: int, chunk: int = 200, most: int = 5000, total: int | None = None) -> list[tuple[int, int]]:
    """Offsets and sizes with which a session loads up to ``needed`` rows."""
    end = min(needed, most, total if total is not None else most)
    return [(at, min(chunk, most - at, (total if total is not None else most) - at)) for at in range(start, end, chunk)]


def chunk_plans(totals: DataFrame, needed: int, total: str = "total", chunk: int = 200, most: int = 5000) -> DataFrame:
    """As ``chunk_plan`` from 0 for each row with a total: start_at, size."""
    end = F.least(F.lit(needed), F.lit(most), F.col(total))
    starts = F.explode(F.when(end > 0, F.sequence(F.lit(0), end - 1, F.lit(chunk))).otherwise(F.array().cast("array<int>"))).alias("start_at")
    return totals.select("*", starts).withColumn("size", F.least(F.lit(chunk), F.lit(most) - F.col("start_at"), F.col(total) - F.col("start_at")))


def search(papers: DataFrame, r: Request) -> tuple[DataFrame, DataFrame]:
    """A page of the papers (title, abstract, authors, published, updated, categories as one code) that fit a request, and their total.

    Sorted by the request's order; equal ones by id. The page is a top-k with an offset, the total one aggregate over the same pushed filter.
    """
    r = r.check()
    found = papers.where(predicate(r, F.col("title"), F.col("abstract"), F.col("authors"), F.col("published"), F.col("category")))
    by = {"relevance": relevance(r.topic, F.col("title"), F.col("abstract")) if r.topic.strip() else F.lit(0), "submittedDate": F.col("published"), "lastUpdatedDate": F.col("updated")}[r.sort_by]
    ordered = found.withColumn("__by", by)
    first = F.desc("__by") if r.sort_order == "descending" else F.asc("__by")
    return page(ordered, [first, F.asc("paper_id")], r.start, min(r.max_results, PAGE_MOST)).drop("__by"), found.agg(F.count("*").alias("total"))


def session_meta(loaded: DataFrame, session: str, size: int = 10) -> DataFrame:
    """What accompanies each reply: rows loaded, pages shown in full, whether there is more than one page."""
    n = F.count("*")
    return loaded.groupBy(session).agg(n.alias("loaded"), F.floor(n / size).cast("long").alias("full_pages"), (n > size).alias("has_more"))
