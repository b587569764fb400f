"""Section headings: merging detections, anchoring on pages, gaps, numbering scheme, confidence.

Headings are rows keyed by paper, so every step is a join or window within papers; ranges of pages are exploded into equal
keys, so joins stay hash joins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litspan.functions import text as T

KEEP = 0.62
#: Weights of the confidence, and words that hint at a section.
WEIGHTS = {"prior": 0.20, "text": 0.22, "typography": 0.20, "position": 0.14, "scheme": 0.16, "semantics": 0.08}
HINTS = ("introduction", "method", "result", "discussion", "conclusion", "reference")
#: A number before a heading; headings without one that are sought, with the first or the last so many pages.
ROMAN, ARABIC = r"^\s*([IVXivx]+)[.)]\s+", r"^\s*(\d+)[.)]\s+"
UNNUMBERED = (("abstract", 5), ("acknowledgements", -10), ("acknowledgments", -10))
BATCH, SHARED = 10, 2  # pages of a detection batch, and pages that two batches share


def page_batches(papers: DataFrame, total: str = "total_pages", batch: int = BATCH, shared: int = SHARED) -> DataFrame:
    """Batches of pages: batch_start, batch_end; the last ends with the paper."""
    step = batch - shared
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col(total) - shared), F.lit(step))).alias("batch_start")
    return papers.where(F.col(total) > 0).select(*papers.columns, starts).withColumn("batch_end", F.least(F.col("batch_start") + batch - 1, F.col(total)))


def valid_detections(rows: DataFrame) -> DataFrame:
    """Detections with a heading that isn't blank and a page that is a number within its batch."""
    page = F.try_to_number(F.col("page"), F.lit("999999")).cast("int") if dict(rows.dtypes)["page"] == "string" else F.col("page").cast("int")
    return rows.withColumn("page", page).where((T.strip(F.col("heading")) != "") & F.col("page").between(F.col("batch_start"), F.col("batch_end")))


def merge_detections(rows: DataFrame, paper: str = "paper") -> DataFrame:
    """One row for each heading: that of its smallest page (first batch and place of equals); subsections go."""
    main = rows.where(~T.heading_kind(F.col("heading")).isin(*T.SUBSECTIONS)).withColumn("key", T.heading_norm(T.strip_prefix(F.col("heading"))))
    first = main.groupBy(paper, "key").agg(F.min_by(F.struct("heading", "page"), F.struct("page", "batch", "pos")).alias("h"))
    return first.select(paper, F.col("h.heading").alias("heading"), F.col("h.page").alias("page_start"))


def page_ends(rows: DataFrame, paper: str = "paper", total: str | Column = "total_pages") -> DataFrame:
    """A section ends on the page where the next starts, the last with the paper."""
    order = Window.partitionBy(paper).orderBy("page_start", T.heading_norm(F.col("heading")))
    return rows.withColumn("page_end", F.coalesce(F.lead("page_start").over(order), F.col(total) if isinstance(total, str) else total))


def dominant_scheme(rows: DataFrame, paper: str = "paper", order: str = "pos", least: int = 2, kinds: tuple[str, ...] = ("roman", "arabic", "appendix")) -> DataFrame:
    """Each paper's most frequent numbering (the first seen of equals), ``unknown`` below ``least``."""
    typed = rows.withColumn("kind", T.heading_kind(F.col("heading"))).where(F.col("kind").isin(*kinds))
    counted = typed.groupBy(paper, "kind").agg(F.count("*").alias("n"), F.min(order).alias("p"))
    best = counted.groupBy(paper).agg(F.max_by(F.struct("kind", "n"), F.struct("n", -F.col("p"))).alias("b"))
    found = best.select(paper, F.when(F.col("b.n") >= least, F.col("b.kind")).otherwise("unknown").alias("scheme"))
    return rows.select(paper).distinct().join(found, paper, "left").select(paper, F.coalesce("scheme", F.lit("unknown")).alias("scheme"))


def fits_scheme(kind: Column, norm: Column, scheme: Column) -> Column:
    """Whether a heading belongs to the top level under its paper's numbering."""
    usual = (kind == "unnumbered") & norm.isin(*T.COMMON)
    numbered = F.when(scheme.isin("roman", "arabic"), (kind == scheme) | usual).otherwise(kind.isin("roman", "arabic", "unnumbered"))
    return ~kind.isin(*T.SUBSECTIONS) & (kind.isin("mandatory-unnumbered", "appendix") | numbered)


def scheme_filter(rows: DataFrame, paper: str = "paper", order: str = "pos") -> DataFrame:
    """Headings that fit their paper's scheme, one for each name and page."""
    both = rows.join(dominant_scheme(rows, paper, order), paper)
    heading = F.col("heading")
    kept = both.where(fits_scheme(T.heading_kind(heading), T.heading_norm(T.strip_prefix(heading)), F.col("scheme")))
    same = Window.partitionBy(paper, T.heading_norm(T.strip_prefix(heading)), "page_start").orderBy(T.heading_norm(heading), order)
    return kept.withColumn("__r", F.row_number().over(same)).where("__r = 1").drop("__r")


def numbered(heading: Column) -> Column:
    """Whether a heading begins with a roman or an arabic number."""
    return F.rlike(heading, F.lit(ROMAN)) | F.rlike(heading, F.lit(ARABIC))


def number_gaps(rows: DataFrame, paper: str = "paper", number: str = "n", page: str = "page") -> DataFrame:
    """Numbers missing below each paper's largest, with the pages of the numbers before and after."""
    seen = rows.groupBy(paper, number).agg(F.min(page).alias("__page"))
    full = seen.groupBy(paper).agg(F.max(number).alias("__m")).select(paper, F.explode(F.sequence(F.lit(1), F.col("__m"))).alias(number))
    missing = full.join(seen, [paper, number], "left_anti")
    low = seen.select(paper, (F.col(number) + 1).alias(number), F.col("__page").alias("page_lo"))
    high = seen.select(paper, (F.col(number) - 1).alias(number), F.col("__page").alias("page_hi"))
    return missing.join(low, [paper, number], "left").join(high, [paper, number], "left")


def looks_like_top_heading(line: Column, size: Column, body_size: Column) -> Column:
    """Whether a line can be a top-level heading by its length, its form and its size."""
    s, norm = T.strip(line), T.heading_norm(line)
    words = F.size(F.split(norm, " "))
    match = lambda p, c: F.rlike(c, F.lit(p))
    no = match(r"^(figure|fig\.|table)\s+\d+", norm) | match(r"^[A-Z]\.\s*$", s) | match(r"^\d+\.\d+", s) | (match(r"^[A-Z]\.", s) & (words <= 3))
    return (norm != "") & (F.length(norm) <= 120) & (words <= 18) & ~F.endswith(s, F.lit(".")) & ~no & (size >= body_size * 0.98)


@dataclass(frozen=True)
class Searches:
    """``wanted``: paper, n, prefix, lo, hi (pages); ``known``: paper, name of each of the papers' headings, once."""

    wanted: DataFrame
    known: DataFrame


def searches(merged: DataFrame, totals: DataFrame, paper: str = "paper") -> Searches:
    """What is missing from papers whose numbering has gaps, and where it may stand.

    Only the paper's dominant numbering counts (the first seen of equals). A gap lies between its neighbours' pages; without the one before it begins at the nearest
    heading before the one after, without the one after it ends with the paper. Papers with a gap also miss what ``UNNUMBERED`` names, if they have no such heading.
    Numbers and starts are rows, each beside its neighbour, so a paper may have many of them.
    """
    h = F.col("heading")
    order = F.struct("page_start", T.heading_norm(h), "heading")
    roman = T.roman_to_int(F.regexp_extract(h, ROMAN, 1))
    kind = F.when(F.rlike(h, F.lit(ROMAN)), F.when(roman.isNotNull(), "roman")).when(F.rlike(h, F.lit(ARABIC)), "arabic")
    n = F.when(kind == "roman", roman).otherwise(F.try_to_number(F.regexp_extract(h, ARABIC, 1), F.lit("999999999")).cast("int"))
    typed = merged.select(paper, "page_start", kind.alias("kind"), n.alias("n"), order.alias("o")).where("kind IS NOT NULL AND n IS NOT NULL")
    counts = typed.groupBy(paper, "kind").agg(F.struct(-F.count("*"), F.min("o")).alias("r"))
    dominant = counts.groupBy(paper).agg(F.min_by("kind", "r").alias("kind"))
    total = totals.select(paper, "total_pages")
    seen = typed.join(dominant, [paper, "kind"]).groupBy(paper, "kind", "n").agg(F.max("page_start").alias("page"))
    ordered = Window.partitionBy(paper, "kind").orderBy("n")
    beside = seen.select("*", F.lag("n").over(ordered).alias("__n"), F.lag("page").over(ordered).alias("__page"))
    first, last = F.coalesce("__n", F.lit(0)) + 1, F.col("n") - 1
    gaps = beside.withColumns({"__first": F.greatest(first, F.lit(1)), "__last": last}).where("__first <= __last")
    # the nearest start before each start, and before the paper's end
    starts = merged.select(paper, F.col("page_start").alias("page")).where("page IS NOT NULL").distinct()
    nearest = starts.select(paper, "page", F.lag("page").over(Window.partitionBy(paper).orderBy("page")).alias("__near"))
    ends = starts.join(total, paper).where(F.col("page") < F.col("total_pages")).groupBy(paper).agg(F.max("page").alias("__end"))
    at = gaps.join(total, paper).join(nearest, [paper, "page"], "left").join(ends, paper, "left")
    at = at.select("*", F.explode(F.sequence("__first", "__last")).alias("i"))
    closed = (F.col("i") == F.col("__last")) & F.col("page").isNotNull()
    before = F.coalesce(F.when(F.col("i") - 1 == F.col("__n"), F.col("__page")), F.when(closed, F.col("__near")).otherwise(F.col("__end")), F.lit(1))
    prefix = F.concat(F.when(F.col("kind") == "roman", T.int_to_roman(F.col("i"))).otherwise(F.col("i").cast("string")), F.lit("."))
    hi = F.when(closed, F.least("total_pages", "page")).otherwise(F.col("total_pages"))
    numbers = at.select(paper, F.col("i").alias("n"), prefix.alias("prefix"), F.greatest(F.lit(1), before).alias("lo"), hi.alias("hi"))
    clean = T.strip(F.regexp_replace(F.lower(h), r"^[ivx]+[.)]\s*|^\d+[.)]\s*", ""))
    labels = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(pages).alias("pages")) for name, pages in UNNUMBERED])
    named = merged.select(paper, clean.alias("name")).where(F.col("name").isin(*[name for name, _ in UNNUMBERED])).groupBy(paper).agg(F.collect_set("name").alias("named"))
    lacking = gaps.select(paper).distinct().join(total, paper).join(named, paper, "left")
    others = lacking.select("*", F.explode(F.filter(labels, lambda x: ~F.array_contains(F.coalesce("named", F.array().cast("array<string>")), x["name"]))).alias("l"))
    lo = F.when(F.col("l.pages") > 0, 1).otherwise(F.greatest(F.lit(1), F.col("total_pages") + F.col("l.pages")))
    hi = F.when(F.col("l.pages") > 0, F.least("l.pages", "total_pages")).otherwise(F.col("total_pages"))
    wanted = numbers.unionByName(others.select(paper, F.lit(None).cast("int").alias("n"), F.col("l.name").alias("prefix"), lo.alias("lo"), hi.alias("hi"))).where("lo <= hi")
    return Searches(wanted, merged.select(paper, T.heading_norm(T.strip_prefix(h)).alias("name")).distinct())


def recovered(sought: Searches, lines: DataFrame, paper: str = "paper") -> DataFrame:
    """The headings that ``searches`` finds on ``lines`` (paper, page, line_no, line, size, body_size, mid_y, page_height): paper, n, heading, page_start.

    The first line that begins with the prefix, else (for numbers) of the first page with any the largest line that looks like a heading, isn't known and has no number; it gets the prefix.
    """
    pages = sought.wanted.select(paper, "n", "prefix", F.explode(F.sequence("lo", "hi")).alias("page"))
    line = T.strip(F.col("line"))
    likely = lines.withColumn("line", line).where(~in_margin(F.col("mid_y"), F.col("page_height")) & looks_like_top_heading(F.col("line"), F.col("size"), F.col("body_size")))
    both = pages.join(likely.select(paper, "page", "line_no", "line", "size"), [paper, "page"])
    named = T.heading_norm(T.strip_prefix(F.col("line")))
    both = both.withColumns({"name": named, "exact": F.startswith(T.heading_norm(F.col("line")), T.heading_norm(F.col("prefix")))})
    free = F.col("n").isNotNull() & ~numbered(F.col("line")) & (F.col("name") != "") & (F.size(F.split("name", " ")) <= 12)
    both = both.withColumn("free", F.coalesce(free, F.lit(False))).where("exact OR free").join(sought.known.withColumn("__known", F.lit(True)), [paper, "name"], "left")
    free = F.col("free") & F.col("__known").isNull()
    at, hit = F.struct("page", "line_no", "line"), F.struct("page", "line")
    best = both.groupBy(paper, "n", "prefix").agg(
        F.min_by(F.when(F.col("exact"), hit), F.when(F.col("exact"), at)).alias("a"),
        F.min_by(F.when(free, hit), F.when(free, F.struct("page", 0.01 * F.length("name") - F.col("size"), "line_no", "line"))).alias("b"),
    )
    heading = F.coalesce("a.line", F.concat(F.col("prefix"), F.lit(" "), F.col("b.line")))
    return best.select(paper, "n", heading.alias("heading"), F.coalesce("a.page", "b.page").alias("page_start")).where("heading IS NOT NULL")


def typography(ratio: Column) -> Column:
    return F.when(ratio >= 1.15, 1.0).when(ratio >= 1.05, 0.8).when(ratio >= 0.95, 0.55).when(ratio.isNotNull(), 0.2).otherwise(0.0)


def position(relative: Column) -> Column:
    return F.when(relative <= 0.22, 1.0).when(relative <= 0.35, 0.7).when(relative <= 0.55, 0.4).when(relative.isNotNull(), 0.15).otherwise(0.0)


def scheme_score(kind: Column, norm: Column, scheme: Column) -> Column:
    usual = (kind == "unnumbered") & norm.isin(*T.COMMON)
    roman = F.when(kind == "roman", 1.0).when(kind == "arabic", 0.1).when(usual, 0.8).otherwise(0.25)
    arabic = F.when(kind == "arabic", 1.0).when(kind == "roman", 0.2).when(usual, 0.8).otherwise(0.3)
    other = F.when(kind.isin("roman", "arabic") | usual, 0.8).otherwise(0.45)
    return F.when(kind.isin(*T.SUBSECTIONS), 0.0).when(kind.isin("mandatory-unnumbered", "appendix"), 1.0).when(scheme == "roman", roman).when(scheme == "arabic", arabic).otherwise(other)


def semantics(norm: Column) -> Column:
    return F.when(norm.isin(*T.COMMON, *T.MANDATORY), 1.0).when(T.contains_any(norm, HINTS), 0.7).otherwise(0.3)


def confidence(text: Column, typo: Column, place: Column, scheme: Column, sense: Column) -> Column:
    """The weighed sum of the components; the prior is 1."""
    w = WEIGHTS
    return F.lit(w["prior"]) + w["text"] * text + w["typography"] * typo + w["position"] * place + w["scheme"] * scheme + w["semantics"] * sense


def score(rows: DataFrame, lines: DataFrame, paper: str = "paper", order: str = "pos") -> DataFrame:
    """Confidence of each heading by the first line of its page that holds it; adds ``confidence`` and ``keep``.

    ``lines`` has paper, page, line_no, line, size, mid_y, page_height, body_size; header and footer lines count for nothing.
    """
    norm = T.heading_norm(T.strip_prefix(F.col("heading")))
    typed = rows.join(dominant_scheme(rows, paper, order), paper).withColumns({"__n": norm, "__kind": T.heading_kind(F.col("heading"))})
    body = lines.where(~in_margin(F.col("mid_y"), F.col("page_height"))).select(paper, F.col("page").alias("page_start"), "line_no", "size", "mid_y", "page_height", "body_size", T.heading_norm(T.strip_prefix(F.col("line"))).alias("__l"))
    hit = typed.join(body, [paper, "page_start"]).where((F.col("__n") != "") & F.contains(F.col("__l"), F.col("__n")))
    first = hit.groupBy(paper, order).agg(F.min_by(F.struct((F.col("size") / F.col("body_size")).alias("ratio"), (F.col("mid_y") / F.col("page_height")).alias("rel")), F.col("line_no")).alias("f"))
    both = typed.join(first, [paper, order], "left")
    c = confidence(F.col("f").isNotNull().cast("double"), typography(F.col("f.ratio")), position(F.col("f.rel")), scheme_score(F.col("__kind"), F.col("__n"), F.col("scheme")), semantics(F.col("__n")))
    odd = (F.col("scheme") == "roman") & (F.col("__kind") == "arabic")
    return both.withColumn("confidence", c).withColumn("keep", (F.round("confidence", 12) >= KEEP) & ~odd).drop("__n", "f").withColumnRenamed("__kind", "kind")


def in_margin(mid_y: Column, height: Column) -> Column:
    """Within the upper or lower 8 % of the page."""
    return (mid_y < height * 0.08) | (mid_y > height * 0.92)
