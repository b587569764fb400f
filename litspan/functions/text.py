"""Text functions on columns. Null counts as the empty string throughout, as in the services' records.

All are built from Spark's own functions, so they run in the JVM and are pushed or folded as usual.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points that count as white space.
BLANK_POINTS = (
    0x9, 0xA, 0xB, 0xC, 0xD, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004,
    0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
BLANK = "".join(map(chr, BLANK_POINTS))


def _ranges(points: tuple[int, ...]) -> str:
    """Sorted code points as ranges of a character class: few comparisons for each character."""
    out: list[list[int]] = []
    for p in points:
        if out and p == out[-1][1] + 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out)


SPACES = f"[{_ranges(BLANK_POINTS)}]+"


#: Ligatures and what they stand for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ĳ": "ij", "Ĳ": "IJ"}

#: Headings that stand without a number.
MANDATORY = ("abstract", "acknowledgements", "acknowledgments", "references", "reference", "bibliography", "appendix", "appendices", "conclusion", "conclusions")
#: Usual section names.
COMMON = (
    "abstract", "introduction", "background", "related work", "prior research", "research methodology", "methodology", "method", "approach",
    "experiments", "experimental setup", "evaluation", "results", "discussion", "conclusion", "conclusions", "future work", "limitations",
    "references", "reference", "bibliography", "appendix", "appendices", "acknowledgements", "acknowledgments",
)

#: The kinds of a heading's prefix, in the order in which they are tried.
PREFIX_KINDS = (
    ("decimal-subsection", r"^\s*\d+\.\d+"),
    ("roman-hyphen-subsection", r"^\s*[IVXivx]+[-–—][A-Z0-9]+"),
    ("appendix", r"(?i)^\s*appendix(?:\s+[A-Z0-9]+)?\b"),
    ("roman", r"^\s*[IVXivx]+[.)]\s+"),
    ("arabic", r"^\s*\d+[.)]\s+"),
    ("alpha-subsection", r"^\s*[A-Z][.)]\s+"),
)
SUBSECTIONS = ("decimal-subsection", "roman-hyphen-subsection", "alpha-subsection")


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(text(c), F.lit(BLANK))


def collapse(c: Column) -> Column:
    """Every run of white space as one blank."""
    return F.regexp_replace(text(c), SPACES, " ")


def first_true(*options: Column) -> Column:
    """The first option that is neither null nor empty, else the empty string."""
    return F.coalesce(*[F.nullif(o, F.lit("")) for o in options], F.lit(""))


def contains_any(c: Column, cues: tuple[str, ...]) -> Column:
    """Whether any of the cues is a substring."""
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(cue)) for cue in cues])


# keys of requests


def topic_key(c: Column) -> Column:
    """Stripped, lower-cased, without quotes, white space collapsed (stripped before quotes go)."""
    return collapse(F.translate(F.lower(strip(c)), "\"'", ""))


author_key = topic_key


def category_key(c: Column) -> Column:
    """Distinct categories that aren't blank, sorted, comma-joined."""
    kept = F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), strip), lambda x: x != "")
    return F.array_join(F.array_sort(F.array_distinct(kept)), ",")


def year_key(first: Column, last: Column) -> Column:
    """``from-to``, either side empty if missing; empty without both."""
    low, high = F.coalesce(first.cast("string"), F.lit("")), F.coalesce(last.cast("string"), F.lit(""))
    return F.when((low == "") & (high == ""), "").otherwise(F.concat(low, F.lit("-"), high))


def paper_id_key(c: Column) -> Column:
    """Lower case, after the last ``/abs/``, without the scheme prefix, cut at the first ``v`` if a version follows the last."""
    s = F.lower(strip(c))
    s = F.when(F.contains(s, F.lit("/abs/")), F.substring_index(s, "/abs/", -1)).otherwise(s)
    s = F.regexp_replace(s, "^arxiv:", "")
    return strip(F.when(F.rlike(F.substring_index(s, "v", -1), F.lit(r"^\d+$")) & F.contains(s, F.lit("v")), F.substring_index(s, "v", 1)).otherwise(s))


def entry_id(c: Column) -> Column:
    """The id of a feed entry: after ``/abs/``, up to the first ``v``."""
    return F.substring_index(F.substring_index(text(c), "/abs/", -1), "v", 1)


# titles, dates, authors


def title_key(c: Column) -> Column:
    """Lower case, only ASCII letters, digits and single blanks."""
    return strip(collapse(F.regexp_replace(collapse(F.lower(text(c))), r"[^a-z0-9\s]", " ")))


def published_date(c: Column) -> Column:
    """What precedes the first ``T``, else the first ten characters."""
    s = text(c)
    return F.when(F.contains(s, F.lit("T")), F.substring_index(s, "T", 1)).otherwise(F.substring(s, 1, 10))


def published_year(c: Column) -> Column:
    """The year of a published date, null without four leading digits."""
    head = F.substring(published_date(c), 1, 4)
    return F.when(F.rlike(head, F.lit(r"^\d{4}$")), head.cast("int"))


def author_preview(authors: Column, most: int = 6, prefer: str | Column = "") -> Column:
    """The first authors and ``, et al.``; an author that equals (else holds) ``prefer`` comes first."""
    bound = lambda c, f: F.get(F.transform(F.array(c), f), 0)
    clean = F.filter(F.transform(F.coalesce(authors, F.array().cast("array<string>")), strip), lambda a: a != "")

    # names, the one wanted and its place are bound by lambdas: each is made once, not once for every author
    def told(names: Column, wanted: Column) -> Column:
        exact = F.array_position(F.transform(names, F.lower), wanted)
        within = F.array_position(F.transform(names, lambda a: F.contains(F.lower(a), wanted)), F.lit(True))
        return bound(F.when(wanted == "", F.lit(0)).when(exact > 0, exact).otherwise(within).cast("int"), lambda at: shown(names, at))

    def shown(names: Column, at: Column) -> Column:
        first = F.slice(names, 1, most)
        rest = F.filter(first, lambda a, i: i + 1 != at)
        moved = F.when(at > 1, F.slice(F.concat(F.array(F.get(names, at - 1)), rest), 1, most)).otherwise(first)
        return F.concat(F.array_join(moved, ", "), F.when(F.size(names) > most, ", et al.").otherwise(""))

    return bound(clean, lambda names: bound(F.lower(strip(F.lit(prefer) if isinstance(prefer, str) else prefer)), lambda wanted: told(names, wanted)))


def join_authors(authors: Column) -> Column:
    """Authors that aren't blank, comma-joined, for storage."""
    return F.array_join(F.filter(F.transform(F.coalesce(authors, F.array().cast("array<string>")), strip), lambda a: a != ""), ", ")


def clip_summary(c: Column, most: int = 900) -> Column:
    """A longer summary is cut, right-stripped and ends in three dots."""
    s = strip(c)
    return F.when(F.length(s) > most, F.concat(F.rtrim(F.substring(s, 1, most), F.lit(BLANK)), F.lit("..."))).otherwise(s)


def clip_error(c: Column) -> Column:
    return F.substring(text(c), 1, 1000)


def describe_search(topic: Column, author: Column, first: Column, last: Column, categories: Column) -> Column:
    """A search in words; ``(search)`` without any part."""
    years = (
        F.when(first.isNotNull() & last.isNotNull(), F.concat(F.lit("between "), first.cast("string"), F.lit(" and "), last.cast("string")))
        .when(first.isNotNull(), F.concat(F.lit("from "), first.cast("string")))
        .when(last.isNotNull(), F.concat(F.lit("until "), last.cast("string")))
    )
    found = strip(F.concat_ws(" ", F.nullif(text(topic), F.lit("")), F.when(text(author) != "", F.concat(F.lit("by "), author)), years, F.when(F.size(F.coalesce(categories, F.array().cast("array<string>"))) > 0, F.concat(F.lit("in "), F.array_join(categories, ", ")))))
    return F.when(found == "", "(search)").otherwise(found)


# headings


def expand_ligatures(c: Column) -> Column:
    return reduce(lambda s, p: F.replace(s, F.lit(p[0]), F.lit(p[1])), LIGATURES.items(), text(c))


def heading_norm(c: Column) -> Column:
    """Lower case, ligatures expanded, white space collapsed, stripped."""
    return strip(collapse(expand_ligatures(F.lower(text(c)))))


def strip_prefix(c: Column) -> Column:
    """Without a roman number and then without an arabic one (both may go)."""
    return strip(F.regexp_replace(F.regexp_replace(text(c), r"^\s*[IVXivx]+[.)]\s*", ""), r"^\s*\d+[.)]\s*", ""))


def heading_kind(c: Column) -> Column:
    """The kind of a heading's prefix."""
    s = strip(c)
    kind = F.when(heading_norm(strip_prefix(s)).isin(*MANDATORY), "mandatory-unnumbered").otherwise("unnumbered")
    for name, pattern in reversed(PREFIX_KINDS):
        kind = F.when(F.rlike(s, F.lit(pattern)), name).otherwise(kind)
    return kind


def roman_to_int(c: Column) -> Column:
    """I to XX, in either case; null otherwise."""
    return F.nullif(F.array_position(F.array(*[F.lit(r) for r in ROMANS]), F.upper(text(c))), F.lit(0)).cast("int")


def int_to_roman(c: Column) -> Column:
    return F.get(F.array(*[F.lit(r) for r in ROMANS]), c.cast("int") - 1)


#: Roman numbers from 1 to 20, by rule.
ROMANS = [tens + ones for tens in ("", "X") for ones in ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X")]


def headings_json(tree: Column) -> Column:
    """An array of level, text, page as JSON."""
    return F.to_json(tree)


def headings_from_json(c: Column) -> Column:
    """The tree without blank texts; null where the JSON can't be read."""
    found = F.from_json(c, "array<struct<level:int,text:string,page:int>>")
    return F.filter(found, lambda h: strip(h["text"]) != "")


def outline(tree: Column) -> Column:
    """A line for each heading, indented by two blanks a level."""
    return F.array_join(F.transform(tree, lambda h: F.concat(F.repeat(F.lit("  "), h["level"] - 1), F.lit("- "), h["text"], F.lit("  (page "), h["page"].cast("string"), F.lit(")"))), "\n")


def display_outline(tree: Column) -> Column:
    """Only the two upper levels."""
    return F.filter(tree, lambda h: h["level"] <= 2)


# model output and terminal


def strip_fences(c: Column) -> Column:
    """JSON without the code fence around it."""
    return strip(F.regexp_replace(text(c), r"(?m)^```(?:json)?\s*|\s*```$", ""))


def safe_json(c: Column, schema: str) -> Column:
    """The whole text as JSON, else its widest part in braces, else null."""
    s = text(c)
    return F.coalesce(F.from_json(F.when(F.rlike(s, F.lit(r"(?s)^\s*\{.*\}\s*$")), s), schema), F.from_json(F.nullif(F.regexp_extract(s, r"(?s)\{.*\}", 0), F.lit("")), schema))


#: Markdown marks and what stays of them, in order.
MARKDOWN = (
    (r"(?s)```[^\n]*\n(.*?)```", "$1"), (r"(?s)\*{3}(.+?)\*{3}", "$1"), (r"(?s)\*{2}(.+?)\*{2}", "$1"), (r"(?s)_{2}(.+?)_{2}", "$1"),
    (r"(?s)(?<!\s)\*(.+?)\*(?!\s)", "$1"), (r"(?s)(?<!\s)_(.+?)_(?!\s)", "$1"), (r"`([^`]+)`", "$1"), (r"(?m)^#{1,6}\s+", ""),
    (r"(?m)^\s*>\s?", ""), (r"(?m)^[-*_]{3,}\s*$", ""), (r"!\[(.+?)\]\(.*?\)", "$1"), (r"\[(.+?)\]\(.*?\)", "$1"), (r"~~(.+?)~~", "$1"),
)


def strip_markdown(c: Column) -> Column:
    """Plain text for a terminal."""
    return reduce(lambda s, p: F.regexp_replace(s, p[0], p[1]), MARKDOWN, text(c))


def lines(c: Column) -> Column:
    """The lines that aren't blank, white space collapsed."""
    unix = F.regexp_replace(text(c), r"\r\n?", "\n")
    return F.filter(F.transform(F.split(unix, "\n"), lambda x: strip(collapse(x))), lambda x: x != "")
