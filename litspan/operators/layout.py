"""Page layout: font sizes, two-column detection, reading order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litspan.functions import text as T
from litspan.operators.sections import join_ordered

FULL, GAP, LEFT, RIGHT = 0.80, 0.20, 0.25, 0.75  # of the page's width
LEAST_BLOCKS, LEAST_SIDE = 4, 2


def modal_size(spans: DataFrame, by: list[str], order: list[str], size: str = "size", text: str = "text", default: float = 10.0) -> DataFrame:
    """The most frequent size, rounded to a tenth, of spans that aren't blank; the first seen of equals."""
    rounded = F.round(F.col(size), 1)
    counted = spans.where(T.strip(F.col(text)) != "").groupBy(*by, rounded.alias("__s")).agg(F.count("*").alias("__n"), F.min(F.struct(*order)).alias("__first"))
    top = Window.partitionBy(*by).orderBy(F.desc("__n"), "__first")
    best = counted.withColumn("__r", F.row_number().over(top)).where("__r = 1").select(*by, F.col("__s").alias("body_size"))
    return spans.select(*by).distinct().join(best, by, "left").select(*by, F.coalesce("body_size", F.lit(default)).alias("body_size"))


def median_size(spans: DataFrame, by: list[str], size: str = "size", default: float = 12.0) -> DataFrame:
    """The median of sizes above 4."""
    return spans.groupBy(*by).agg(F.coalesce(F.median(F.when(F.col(size) > 4, F.col(size))), F.lit(default)).alias("median_size"))


def is_heading_span(text: Column, size: Column, flags: Column, median: Column) -> Column:
    """Larger than the body, and bold or in capitals."""
    capitals = (F.upper(text) == text) & (F.lower(text) != text)
    return (T.strip(text) != "") & (size >= median * 1.15) & ((flags.bitwiseAND(16) != 0) | capitals)


def columns(blocks: DataFrame, by: list[str]) -> DataFrame:
    """Whether a page has two columns, and where they part: ``two_columns``, ``divider`` (half the width without).

    The widest gap between left edges (the first of equals) parts them if it is wide, in the middle, and has blocks on both sides.
    """
    narrow = (F.col("x1") - F.col("x0")) <= F.col("page_w") * FULL
    edges = blocks.where(narrow).select(*by, "page_w", F.bround("x0").alias("__x")).distinct()
    order = Window.partitionBy(*by).orderBy("__x")
    gaps = edges.withColumn("__next", F.lead("__x").over(order)).where("__next IS NOT NULL").select(*by, "page_w", (F.col("__next") - F.col("__x")).alias("__gap"), ((F.col("__next") + F.col("__x")) / 2).alias("__mid"))
    best = gaps.groupBy(*by).agg(F.max_by(F.struct("__gap", "__mid"), F.struct("__gap", -F.col("__mid"))).alias("b"))
    both = blocks.join(best, by, "left").withColumn("__n", narrow)
    parted = both.groupBy(*by).agg(
        F.first("page_w").alias("page_w"), F.first("b").alias("b"), F.count_if("__n").alias("n"),
        F.count_if(F.col("__n") & (F.col("x0") < F.col("b.__mid"))).alias("left"), F.count_if(F.col("__n") & (F.col("x0") >= F.col("b.__mid"))).alias("right"),
    )
    two = (F.col("n") >= LEAST_BLOCKS) & (F.col("b.__gap") > F.col("page_w") * GAP) & F.col("b.__mid").between(F.col("page_w") * LEFT, F.col("page_w") * RIGHT) & (F.col("left") >= LEAST_SIDE) & (F.col("right") >= LEAST_SIDE)
    told = F.coalesce(two, F.lit(False))
    return parted.select(*by, told.alias("two_columns"), F.when(told, F.col("b.__mid")).otherwise(F.col("page_w") / 2).alias("divider"))


def reading_order(blocks: DataFrame, by: list[str]) -> DataFrame:
    """Blocks numbered as read: full-width ones, the left column, the right one; by place on pages with one column."""
    both = blocks.join(columns(blocks, by), by)
    full = (F.col("x1") - F.col("x0")) > F.col("page_w") * FULL
    side = F.when(~F.col("two_columns") | full, 0).when(F.col("x0") < F.col("divider"), 1).otherwise(2)
    across = F.when(F.col("two_columns"), F.lit(0.0)).otherwise(F.col("x0"))
    return both.withColumn("reading", F.row_number().over(Window.partitionBy(*by).orderBy(side, "y0", across, "block")))


def page_texts(blocks: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """Each page's text in reading order, with its layout."""
    ordered = reading_order(blocks.where(T.strip(F.col(text)) != ""), by)
    return ordered.groupBy(*by).agg(T.strip(join_ordered(F.col("reading"), T.strip(F.col(text)), "\n")).alias("text"), F.first("two_columns").alias("two_columns"))


def paper_layout(pages: DataFrame, paper: str = "paper") -> DataFrame:
    """``two-column`` where more than 30 % of the pages are."""
    return pages.groupBy(paper).agg(F.when(F.avg(F.col("two_columns").cast("int")) > 0.3, "two-column").otherwise("single-column").alias("layout"))
