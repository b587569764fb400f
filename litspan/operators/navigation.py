"""Sessions: cues in messages, routing of intents, titles and attributes against the loaded list, pages of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litspan.functions import text as T
from litspan.operators.sections import join_ordered

#: Cues and answers.
OPEN_CUES = ("open", "read", "show me", "show", "details", "summarize", "summary", "explain", "tell me about")
PDF_CUES = ("pdf", "download", "download link", "pdf link", "link", "url", "view pdf", "open pdf")
SHOW_ALL = ("show all", "list all", "all matches")
CHOOSE_ONE = ("choose one", "pick one", "you choose", "just choose")
#: No letter, number or underscore of any script follows: said in full, as ``\\b`` differs between engines and versions.
ENDED = r"(?![\p{L}\p{N}_])"
YES = r"(?i)^(?:y|yes|yeah|yep|ok|okay|sure|do it|go ahead|new search|yes its a new search|yes it's a new search)" + ENDED
NO = r"(?i)^(?:n|no|nope|nah)" + ENDED
CANCEL = r"(?i)^(?:forget it|never mind|nevermind|cancel|drop it|ignore that)" + ENDED
RESET_WORDS = ("reset", "clear", "start over", "restart")
ACTIONS = ("search", "next", "open", "summary", "paper", "ask", "help", "reset", "chat")
#: The help text, and replies that need no data, by handler.
HELP = """Actions allowed:
- `help`
- `reset`
- `search <topic>` (or just type a topic)
- `search ... by <author>`
- `search ... between <YYYY> and <YYYY>`
- `search ... in <category>` (e.g., cs.AI, cs.LG, stat.ML)
- `next`
- `summary <n>` (shows abstract/details for nth paper on current page)
- `open <n>` (downloads paper into DB and enables Q&A)
- `open <title>` (downloads best matching paper from current search)
- `paper <arxiv_id>` (shows details)
- After opening a paper, ask any question about its content:
  e.g. `what methodology did they use?`
       `what datasets were used?`
       `what are the main findings?`

Examples:
- ai in healthcare
- papers by Andrew Ng
- ai in healthcare between 2020 and 2022
- cs.AI papers between 2020 and 2022
"""
REPLIES = {
    "help": HELP,
    "reset": "Reset done. You can `search <topic>` again.",
    "search-usage": "Please provide at least one search constraint. Examples:\n- `ai in healthcare`\n- `papers by Andrew Ng`\n- `ai in healthcare between 2020 and 2022`\n- `cs.AI papers between 2020 and 2022`",
    "no-search": "No active search yet. Use: `search <topic>` (example: `search transformers in nlp`).",
    "open-usage": "Usage: `open 5` / `summary 5` or `open <title>`",
}


def wants(message: Column, cues: tuple[str, ...]) -> Column:
    """Whether a message has any of the cues, as plain substrings."""
    return T.contains_any(F.lower(T.strip(message)), cues)


def answer_kind(message: Column) -> Column:
    m = F.lower(T.strip(message))
    return F.when(F.rlike(m, F.lit(YES)), "yes").when(F.rlike(m, F.lit(NO)), "no").when(F.rlike(m, F.lit(CANCEL)), "cancel").otherwise("other")


def guarded_action(action: Column, message: Column, has_paper: Column) -> Column:
    """Unknown actions are chat; a reset needs its word, a question an open paper."""
    known = F.when(F.lower(T.strip(action)).isin(*ACTIONS), F.lower(T.strip(action))).otherwise("chat")
    return F.when((known == "reset") & ~wants(message, RESET_WORDS), "chat").when((known == "ask") & ~has_paper, "chat").otherwise(known)


def route(rows: DataFrame) -> DataFrame:
    """The handler of each message, in the order in which the rules apply.

    Columns: message, action, topic, author, title, paper_id, index, from_year, to_year, categories (array), has_list, has_search, pending. Adds ``handler``, ``mode``.
    """
    m, a = F.col("message"), F.col("action")
    some = lambda c: T.strip(F.col(c)) != ""
    years = F.col("from_year").isNotNull() | F.col("to_year").isNotNull()
    cats = F.size(F.coalesce("categories", F.array().cast("array<string>"))) > 0
    selector = some("topic") | some("author") | years | cats
    blind = F.col("index").isNull() & ~some("title") & ~some("paper_id")
    opening = a.isin("open", "summary")
    handler = (
        F.when(T.strip(m) == "", "nudge")
        .when(F.col("pending") & (answer_kind(m) == "yes"), "run-pending")
        .when(F.col("pending") & answer_kind(m).isin("no", "cancel"), "drop-pending")
        .when(F.col("has_list") & (a == "search") & wants(m, OPEN_CUES), "open-from-context")
        .when(F.col("has_list") & opening & blind & selector, "open-from-context")
        .when(a.isin("help", "reset"), a)
        .when((a == "search") & selector, "search")
        .when(a == "search", "search-usage")
        .when(a.isin("next", "open", "summary", "paper") & ~F.col("has_search"), "no-search")
        .when(a == "next", "next")
        .when(opening & F.col("index").isNotNull(), "open-index")
        .when(opening & some("title"), "open-title")
        .when(opening & (selector | some("paper_id")), "open-from-context")
        .when(opening, "open-usage")
        .when(a.isin("paper", "ask"), a)
        .otherwise("chat")
    )
    mode = F.when((a == "open") | wants(m, PDF_CUES), "pdf").otherwise("summary")
    return rows.withColumns({"handler": handler, "mode": mode})


def fixed_reply(handler: Column) -> Column:
    """The reply of a handler that needs no data, else null."""
    return F.coalesce(*[F.when(handler == name, F.lit(text)) for name, text in REPLIES.items()])


def candidate_index(candidates: DataFrame, page: DataFrame, loaded: DataFrame, key: str = "paper_id") -> DataFrame:
    """A candidate's number: its place on the page, else in the loaded list, else 0. Both lists have key and ``position``."""
    first = lambda df, name: df.groupBy(key).agg(F.min("position").alias(name))
    both = candidates.join(first(page, "__p"), key, "left").join(first(loaded, "__g"), key, "left")
    return both.withColumn("position", F.coalesce("__p", "__g", F.lit(0))).drop("__p", "__g")


def open_index(requests: DataFrame, page: DataFrame, loaded: DataFrame) -> DataFrame:
    """The paper an index names: on the page shown, else in the loaded list (both with session, position, paper_id)."""
    p = page.select("session", F.col("position").alias("index"), F.col("paper_id").alias("__p"))
    g = loaded.select("session", F.col("position").alias("index"), F.col("paper_id").alias("__g"))
    both = requests.join(p, ["session", "index"], "left").join(g, ["session", "index"], "left")
    return both.withColumn("paper_id", F.coalesce("__p", "__g")).drop("__p", "__g")


def page_slice(loaded: DataFrame, start: int, size: int) -> DataFrame:
    """Rows of a session's list from ``start`` (0-based), by their position."""
    return loaded.where(F.col("position").between(start + 1, start + size))


def next_start(cursor: Column, size: Column, total: Column, loaded: Column) -> Column:
    """Where the next page starts; null at the end of the results or of what is loaded."""
    start = cursor + size
    return F.when(total.isNotNull() & (start >= total), None).when(start >= loaded, None).otherwise(start)


#: How many candidates are shown, by where they were found and whether all were asked for, and how the reply begins.
SHOWN = {
    ("title", "page", True): (15, "Matches in the current page (reply `open <number>`):"),
    ("title", "loaded", True): (20, "Matches in the current loaded results (reply `open <number>`):"),
    ("title", "page", False): (10, "I found multiple close matches in the current page. Which one should I open? Reply `open <number>`:"),
    ("title", "loaded", False): (10, "I found multiple close matches in the current results. Which one should I open? Reply `open <number>`:"),
    ("filter", "page", True): (20, "Multiple matches in the current page (reply `open <number>`):"),
    ("filter", "loaded", True): (30, "Multiple matches in your current results (reply `open <number>`):"),
    ("filter", "page", False): (10, "I found multiple matches in the current page. Which one should I open? Reply `open <number>`:"),
    ("filter", "loaded", False): (10, "I found multiple matches in your current results. Which one should I open? Reply `open <number>`:"),
}


def candidate_choices(rows: DataFrame, session: str) -> DataFrame:
    """The reply that lists candidates: session, ``shown``, ``reply``.

    ``rows`` has session, kind (title or filter), place (page or loaded), all (whether all were asked for), rank (from 1), position (0: none), title, authors, published. Rows beyond the limit go before they are joined.
    """
    key = F.struct("kind", "place", "all")
    pick = lambda i: F.coalesce(*[F.when((F.col("kind") == k) & (F.col("place") == p) & (F.col("all") == a), F.lit(v[i])) for (k, p, a), v in SHOWN.items()])
    kept = rows.where(F.col("rank") <= pick(0))
    bits = F.concat_ws(" | ", F.when(T.text("authors") != "", F.concat(F.lit("Authors: "), "authors")), F.when(T.text("published") != "", F.concat(F.lit("Published: "), "published")))
    number = F.when(F.col("position") > 0, F.concat(F.col("position").cast("string"), F.lit(") "))).otherwise("- ")
    line = F.concat(number, T.strip(F.col("title")), F.when(bits != "", F.concat(F.lit("\n   "), bits)).otherwise(""))
    told = kept.withColumn("__head", pick(1)).groupBy(session, key.alias("__k"), "__head").agg(join_ordered(F.col("rank"), line, "\n").alias("__body"), F.count("*").alias("shown"))
    return told.select(session, "shown", F.concat("__head", F.lit("\n"), "__body").alias("reply"))


def render_list(rows: DataFrame, session: str, order: str = "position") -> DataFrame:
    """Numbered lines of a page: title, then authors and date if there are any."""
    bits = F.concat_ws(" | ", F.when(T.text("authors") != "", F.concat(F.lit("Authors: "), "authors")), F.when(T.text("published") != "", F.concat(F.lit("Published: "), "published")))
    title = T.first_true(T.strip(F.col("title")), F.lit("Untitled"))
    line = F.concat(F.col(order).cast("string"), F.lit(") "), title, F.when(bits != "", F.concat(F.lit("\n   "), bits)).otherwise(""))
    return rows.groupBy(session).agg(join_ordered(F.col(order), line, "\n").alias("reply"))
