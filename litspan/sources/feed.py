"""Feed entries of a catalogue as papers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litspan.functions import text as T

#: A paper's columns, in order.
PAPER = ("paper_id", "title", "abstract", "authors", "categories", "published_date", "updated_date", "pdf_url", "abs_url", "source")


def pdf_link(links: Column, entry: Column, link: Column) -> Column:
    """The first link that is a PDF by type or name and has a target, else the abstract's url rewritten, else the link."""
    fits = F.filter(F.coalesce(links, F.array().cast("array<struct<type:string,href:string>>")), lambda x: (T.text(x["href"]) != "") & ((x["type"] == "application/pdf") | F.contains(F.lower(T.text(x["href"])), F.lit("pdf"))))
    rewritten = F.when(F.contains(T.text(entry), F.lit("/abs/")), F.concat(F.replace(entry, F.lit("/abs/"), F.lit("/pdf/")), F.lit(".pdf")))
    return F.coalesce(F.get(fits, 0)["href"], rewritten, T.text(link))


def papers(entries: DataFrame, source: str = "catalogue") -> DataFrame:
    """Entries (id, title, summary, published, updated, link, authors, links, tags) as papers; the entry's id stays."""
    line = lambda c: F.translate(T.strip(F.col(c)), "\n", " ")
    names = F.filter(F.transform("authors", lambda a: T.strip(a["name"])), lambda n: n != "")
    terms = F.array_distinct(F.filter(F.transform("tags", lambda t: T.text(t["term"])), lambda t: t != ""))
    return entries.select(
        "id", T.entry_id(F.col("id")).alias("paper_id"), line("title").alias("title"), line("summary").alias("abstract"), names.alias("authors"), terms.alias("categories"),
        T.text("published").alias("published_date"), T.text("updated").alias("updated_date"), pdf_link(F.col("links"), F.col("id"), F.col("link")).alias("pdf_url"), T.text("id").alias("abs_url"), F.lit(source).alias("source"),
    )


def pdf_url(paper: DataFrame, names: tuple[str, ...] = ("pdf_url", "pdf", "pdfLink", "pdf_link"), key: str = "paper_id", template: str = "https://catalogue.example/pdf/{}.pdf") -> DataFrame:
    """Add ``resolved_pdf_url``: the first of the columns that isn't empty, else the template with the paper's id, else empty."""
    head, tail = template.split("{}")
    own = F.when(T.text(key) != "", F.concat(F.lit(head), F.col(key), F.lit(tail)))
    return paper.withColumn("resolved_pdf_url", T.first_true(*[T.strip(F.col(c)) for c in names if c in paper.columns], F.coalesce(own, F.lit(""))))
