"""A session's handlers as one keyed state: the list of a search, how much of it is loaded, the page shown, and a search that waits for a yes.

Each turn is a step from state to state. What a search finds comes with the turn that asks for it, as its first ``most`` rows at most, so a session's state is
bounded; it is appended to as ``next``, an index or a title needs more (in chunks, up to the cap), and pages and candidates are read from it. Sessions are dealt by key and
their turns streamed in order, one session's state held at a time, so a session with a third of all turns costs time but no memory.
"""

from __future__ import annotations

import difflib
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspan.operators.folds import fold
from litspan.operators.titles import ACCEPT, SUGGEST
from litspan.settings import Settings

ROUNDS = 5  # loads after which a title is given up
CHOICES = 5  # candidates of a title that are shown
LISTED = 10  # candidates of other selectors
OUTCOME = "outcome string, paper string, start int, shown int, loaded int, waiting string"


@dataclass
class Session:
    """``rows`` is what the search has found, of which ``loaded`` are; ``page`` is what is shown."""

    query: str | None = None
    rows: list = field(default_factory=list)
    total: int = 0
    loaded: int = 0
    cursor: int = 0
    page: list = field(default_factory=list)
    pending: tuple | None = None


def key_of(title: str | None) -> str:
    return " ".join(re.sub(r"[^a-z0-9\s]", " ", (title or "").lower()).split())


class Handlers:
    """The steps, with the settings' sizes."""

    def __init__(self, settings: Settings | None = None):
        self.s = settings or Settings()

    def ensure(self, state: Session, needed: int) -> None:
        """Load in chunks until so many rows are there, or all."""
        end = min(state.total, self.s.loaded_most)
        while state.loaded < needed and state.loaded < end:
            state.loaded = min(end, state.loaded + self.s.prefetch)

    def search(self, state: Session, query: str, rows: list, total: int) -> tuple:
        state.query, state.rows, state.total, state.cursor = query, rows, total, 0
        state.loaded = min(self.s.prefetch, self.s.loaded_most, total)
        return self.show(state, 0)

    def show(self, state: Session, start: int) -> tuple:
        state.cursor = start
        state.page = state.rows[start : min(start + self.s.page_size, state.loaded)]
        return "list", None, start, len(state.page)

    def next(self, state: Session) -> tuple:
        start = state.cursor + self.s.page_size
        if start >= state.total:
            return "no-more", None, None, 0
        self.ensure(state, start + self.s.page_size)
        return self.show(state, start) if start < state.loaded else ("no-more", None, None, 0)

    def open_index(self, state: Session, index: int) -> tuple:
        """A number of the page, else of the whole list."""
        if index <= 0:
            return "bad-index", None, None, 0
        if index <= len(state.page):
            return "open", state.page[index - 1]["paper"], None, 1
        self.ensure(state, index)
        return ("open", state.rows[index - 1]["paper"], None, 1) if index <= state.loaded else ("beyond", None, None, 0)

    def best_title(self, rows: list, wanted: str) -> tuple[dict | None, list]:
        """An equal title, the only one that holds the request, or the likeliest if it is accepted; else candidates."""
        keys = [(key_of(r["title"]), r) for r in rows]
        for k, r in keys:
            if k == wanted:
                return r, []
        within = [r for k, r in keys if k and wanted in k]
        if within:
            return (within[0], []) if len(within) == 1 else (None, within)
        ratios = sorted(((-difflib.SequenceMatcher(a=wanted, b=k).ratio(), n) for n, (k, _) in enumerate(keys) if k))
        if ratios and -ratios[0][0] >= ACCEPT:
            return rows[ratios[0][1]], []
        return None, [rows[n] for s, n in ratios[:10] if -s >= SUGGEST]

    def open_title(self, state: Session, title: str) -> tuple:
        wanted = key_of(title)
        if not wanted:
            return "usage", None, None, 0
        for _ in range(ROUNDS):
            best, some = self.best_title(state.rows[: state.loaded], wanted)
            if best is not None:
                return "open", best["paper"], None, 1
            if some:
                return "choices", None, None, min(CHOICES, len(some))
            if state.loaded >= min(state.total, self.s.loaded_most):
                break
            self.ensure(state, state.loaded + self.s.prefetch)
        return "no-title", None, None, 0

    def from_context(self, state: Session, author: str, search: tuple) -> tuple:
        """A paper of the page by its author, else of what is loaded; without any, the search is asked about."""
        for rows in (state.page, state.rows[: state.loaded]):
            some = [r for r in rows if author.strip().lower() in (r["authors"] or "").lower()]
            if len(some) == 1:
                return "open", some[0]["paper"], None, 1
            if some:
                return "choices", None, None, min(LISTED, len(some))
        state.pending = search
        return "ask-new", None, None, 0

    def step(self, state: Session, value: tuple) -> tuple[Session, tuple]:
        answer, action, query, author, index, title, found, total = value
        search = (query, [r.asDict() if hasattr(r, "asDict") else r for r in found or []], total or 0)
        if state.pending is not None:
            waiting, state.pending = state.pending, None
            if answer == "yes":
                return self.told(state, self.search(state, *waiting))
            if answer in ("no", "cancel"):
                return self.told(state, ("stay", None, None, 0))
        here = state.query is not None and state.loaded > 0
        if action == "search":
            out = self.search(state, *search) if query else ("search-usage", None, None, 0)
        elif action in ("next", "open") and state.query is None:
            out = "no-search", None, None, 0
        elif action == "next":
            out = self.next(state)
        elif action == "open" and index is not None:
            out = self.open_index(state, index)
        elif action == "open" and title:
            out = self.open_title(state, title)
        elif action == "open" and author and here:
            out = self.from_context(state, author, search)
        elif action == "open":
            out = "usage", None, None, 0
        else:
            out = "chat", None, None, 0
        return self.told(state, out)

    def told(self, state: Session, out: tuple) -> tuple[Session, tuple]:
        outcome, paper, start, shown = out
        return state, (outcome, paper, start, shown, state.loaded, state.pending[0] if state.pending else None)


def lists(papers: DataFrame, most: int, query: str = "query") -> DataFrame:
    """Each query's first rows: query, ``found`` (array of paper, title, authors in order), ``total``. ``papers`` has query, position (from 1), paper, title, authors.

    Rows beyond ``most`` go before any are put together; the total is counted on its own.
    """
    row = F.struct("position", F.struct(F.col("paper").cast("string").alias("paper"), "title", "authors").alias("r"))
    kept = papers.where(F.col("position") <= most).groupBy(query).agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["r"]).alias("found"))
    return papers.groupBy(query).agg(F.count("*").cast("int").alias("total")).join(kept, query)


def replay(turns: DataFrame, found: DataFrame, session: str = "session", turn: str = "turn", settings: Settings | None = None) -> DataFrame:
    """What each turn comes to: session, turn, outcome, paper (the one that is opened), start and shown (of a page, or candidates), loaded, waiting (the query that waits for a yes).

    ``turns`` has session, turn, answer (yes, no, cancel or other), action, query (what a search would be for: also one that an author suggests), author, index, title. ``found`` is what ``lists`` gives.
    """
    both = turns.join(found, "query", "left")
    handlers = Handlers(settings)
    return fold(both, [session], [turn], ["answer", "action", "query", "author", "index", "title", "found", "total"], Session, handlers.step, OUTCOME)
