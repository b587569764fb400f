"""Personal data: fixed patterns, and contextual extraction bootstrapped from what they find.

Base spans come from four patterns (email, ip, card, phone). Their matches, and identifier-like tokens assigned to a name that
tells a secret, are the seeds. Every seed and every identifier-like token is an instance, what stands around it are lexical patterns: the name it is assigned
to, the two and the three words before it, the two words after it, and the pair of words beside it. For each kind of seed a pattern scores the mean
confidence of its distinct instances, if ``SUPPORT`` of them are confident, and an instance the best score of its patterns; seeds keep confidence 1, base spans in their own kind only. Spark joins
the pattern-instance graph in rounds. Discovered instances count like seeds in the next round, so scores only grow, and rounds go on until
they grow by less than ``SETTLED`` in all. What base spans say of a pattern is the same in each round, so it is summed once, and rounds join only the edges of other instances. Instances that reach the threshold are unseen identifiers; their places are spans of kind ``id`` (``secret`` if that is
what they are like), beside the base ones.

Defined cases: a null text is empty and has no span. Repeated rows have the same result each, rows of one id too, each by its own text. Matches that fail a check (an address
part above 255, Luhn, the number of digits) are dropped without a retry. Spans are code points, the end exclusive. Ids may be of any type.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litspan.llm.common import checkpointed, fresh, join_told, narrowed, slices, texts

KINDS = ("email", "ip", "card", "phone")
SECRET, FOUND = "secret", "id"
ROUNDS = 30  # at most; scores that still grow then are taken as they are
SETTLED = 0.1  # growth of all scores together, for each thousand of them, at which rounds end
SUPPORT = 3  # distinct confident instances that a pattern needs
CONFIDENT = 0.6  # from which an instance counts as an identifier
CONTEXT = 96  # code points around an instance in which patterns are sought

#: Names to which secrets are assigned (the last part of a name counts, as in api_token).
SECRET_NAMES = frozenset("token secret password passwd passphrase pwd apikey credential credentials".split())

#: The base patterns. An address' local part is the whole run before its "@", and digits are tried at the
#: start of their run only, which finds the same matches without going over a run again and again.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: An identifier-like token: eight characters or more with three digits or more, or groups of capitals and digits that make one.
_TOKEN = re.compile(r"[^\s;,|&<>()\[\]{}\"'=]+")
_GROUPS = re.compile(r"(?<![^\s:=\"'])[A-Z0-9]{2,6}(?:[ -][A-Z0-9]{1,6}){1,9}(?![^\s.,;:!?\"')\]])")
_CORE = re.compile(r"[^\W_](?:.*[^\W_])?", re.S)
_KEY = re.compile(r"[^\W\d_]{2,32}(?:[-_.][^\W\d_]{1,32}){0,3}:")
_WORD = re.compile(r"\w+")
_NAME = re.compile(r"([^\W\d_]\w*)\s?(?:[=:]|=>|:=)\s?$")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[^\W\d_A-Za-z]+")
_DIGITS = re.compile(r"\d")


def luhn(digits: str) -> bool:
    """Whether the checksum of a card number holds."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            last = m.end()
        # without a match the run before the next "@" can't reach back over this one
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base spans of a text, by kind as listed and then by start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() <= 37 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def candidates(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Places of identifier-like tokens beside the ``taken`` spans (sorted), in order."""
    out: list[tuple[int, int]] = []
    k = 0
    groups = [m.span() for m in _GROUPS.finditer(text)]
    for first, last in sorted([*groups, *(m.span() for m in _TOKEN.finditer(text) if len(m[0]) >= 8)]):
        while k < len(taken) and taken[k][1] <= first:
            k += 1
        holes, at = [], k
        while at < len(taken) and taken[at][0] < last:
            holes.append(taken[at])
            at += 1
        edges = [first, *(x for hole in holes for x in hole), last]
        for start, end in zip(edges[::2], edges[1::2], strict=True):
            if end - start < 8 or sum(map(text[start:end].count, "0123456789")) < 3:
                continue
            if key := _KEY.match(text, start, end):
                start = key.end()
            core = _CORE.search(text, start, end)
            if not core or len(core[0]) < 8 or sum(map(core[0].count, "0123456789")) < 3:
                continue
            start, end = core.span()
            if not out or start >= out[-1][1]:
                out.append((start, end))
            elif end - start > out[-1][1] - out[-1][0]:
                out[-1] = start, end
    return out


def named(text: str, start: int) -> str:
    """The last part of the name to which what starts there is assigned, in lower case; empty if there is none."""
    found = _NAME.search(text[max(0, start - CONTEXT) : start].rstrip("\"'([{<`"))
    parts = _PART.findall(found[1]) if found else []
    return parts[-1].lower() if parts else ""


def patterns(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around a place; digits in them are alike."""
    before = _WORD.findall(_DIGITS.sub("0", text[max(0, start - CONTEXT) : start].lower()))[-3:]
    after = _WORD.findall(_DIGITS.sub("0", text[end : end + CONTEXT].lower()))[:2]
    out = [f"= {name}"] if (name := named(text, start)) else []
    out += [f"< {' '.join(before[-n:])}" for n in (2, 3) if len(before) >= n]
    if len(after) == 2:
        out.append(f"> {' '.join(after)}")
    return [*out, f"<> {before[-1] if before else '^'} {after[0] if after else '$'}"]


def contexts(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, list[str], str | None, int, int]]:
    """Instances: text, patterns, the kind of seed (null if none), start, end."""
    places = [(a, b, kind) for kind, a, b in spans]
    if _DIGIT.search(text):
        for a, b in candidates(text, sorted((a, b) for _, a, b in spans)):
            places.append((a, b, SECRET if named(text, a) in SECRET_NAMES else None))
    return [(text[a:b], patterns(text, a, b), kind, a, b) for a, b, kind in places]


_SCAN = "base array<struct<kind:string,start:bigint,stop:bigint>>, places array<struct<instance:bigint,patterns:array<bigint>,kind:string,start:bigint,stop:bigint>>"


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One pass over the texts: id, row_key, ``base`` spans, and ``places`` (instances with hashed patterns)."""
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("row_key"), F.col(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
    place = pa.list_(pa.struct([("instance", pa.int64()), ("patterns", pa.list_(pa.int64())), ("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def h(x: str) -> int:
        n = xxhash.xxh3_64_intdigest(x)
        return n - (1 << 64) if n >> 63 else n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = texts(batch.column(2))
            for lo, hi in slices(batch, [len(t) for t in whole], 1 << 22):
                base, places = [], []
                for t in whole[lo:hi]:
                    spans = base_spans(t)
                    base.append([{"kind": k, "start": a, "stop": b} for k, a, b in spans])
                    places.append([{"instance": h(x), "patterns": [h(p) for p in around], "kind": k, "start": a, "stop": b} for x, around, k, a, b in contexts(t, spans)])
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(base, span), pa.array(places, place)], names=["id", "row_key", "base", "places"])

    return rows.mapInArrow(run, f"id {kind}, row_key bigint, {_SCAN}")


def discovered(scanned: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confident: float = CONFIDENT) -> DataFrame:
    """Instances (hashes) that are no base spans and reach the threshold, with ``kind``.

    Every edge carries the numbers of edges of its pattern and of its instance, so means need no further join, and ends with a large share of all edges are
    met by broadcast. The driver sees two numbers of a round.
    """
    first = lambda name: F.first(name).alias(name)
    places = scanned.select(F.explode("places").alias("p")).select("p.*")
    plain = checkpointed(places.select(F.explode("patterns").alias("pattern"), "instance").distinct())
    total = plain.count()
    edges = join_told(plain, plain.groupBy("pattern").agg(F.count("*").alias("of_pattern")), "pattern", "of_pattern", total, "inner")
    edges = checkpointed(join_told(edges, plain.groupBy("instance").agg(F.count("*").alias("of_instance")), "instance", "of_instance", total, "inner"))
    kinds = places.where("kind IS NOT NULL").select("instance", "kind").distinct()
    seeds = checkpointed(kinds.join(edges.groupBy("instance").agg(F.count("*").alias("n")), "instance"))
    base = seeds.where(F.col("kind") != SECRET)
    told = join_told(edges, base.groupBy("instance").agg(first("n"), F.lit(True).alias("based")), "instance", "n", total)
    free = checkpointed(told.where("based IS NULL").select("pattern", "instance", "of_pattern", "of_instance"))
    left = free.count()
    patterns = free.groupBy("pattern").agg(F.count("*").alias("in_free"))
    said = join_told(edges.select("pattern", "instance", "of_pattern"), base, "instance", "n", total, "inner").groupBy("pattern", "kind").agg(F.count("*").cast("double").alias("sum"), F.count("*").alias("n"), first("of_pattern"))
    said = checkpointed(narrowed(said.join(patterns, "pattern"), left))
    free = checkpointed(narrowed(join_told(free, patterns, "pattern", "in_free", left, "inner"), left))
    fixed = checkpointed(narrowed(seeds.where(F.col("kind") == SECRET).join(base.select("instance"), "instance", "left_anti").select("instance", "kind", F.lit(1.0).alias("sure"), F.col("n").alias("of_instance")), left))
    known, before = fixed, float(fixed.count())
    for _ in range(rounds if left else 0):
        met = join_told(free.drop("of_instance"), known, "instance", "of_instance", left, "inner")
        met = met.groupBy("pattern", "kind").agg(F.sum("sure").alias("sum"), F.sum((F.col("sure") >= confident).cast("long")).alias("n"), first("of_pattern"), first("in_free"))
        scored = said.unionByName(met).groupBy("pattern", "kind").agg((F.sum("sum") / F.first("of_pattern")).alias("sure"), F.sum("n").alias("n"), first("in_free"))
        good = checkpointed(narrowed(scored.where(F.col("n") >= support).drop("n"), left))
        best = join_told(free.select("pattern", "instance", "of_instance"), good, "pattern", "in_free", left, "inner").select("instance", "kind", "sure", "of_instance")
        known = checkpointed(narrowed(fixed.unionByName(best).groupBy("instance", "kind").agg(F.max("sure").alias("sure"), first("of_instance")), left))
        count, after = known.agg(F.count("*"), F.coalesce(F.sum("sure"), F.lit(0.0))).first()
        if after - before <= SETTLED * count / 1000:
            break
        before = after
    sure = known.where(F.col("sure") >= confident).groupBy("instance").agg(F.max_by("kind", F.struct("sure", "kind")).alias("like"))
    return sure.select("instance", F.when(F.col("like") == SECRET, SECRET).otherwise(FOUND).alias("kind"))


def find(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each document: the id, row_key, ``base`` and ``more`` (arrays of kind, start, stop).

    The texts are read once and not shuffled; spans are. Rows are numbered, so that rows of one id don't meet.
    """
    scanned = checkpointed(scan(docs, id_column, text_column).withColumn("row", F.monotonically_increasing_id()))
    unseen = scanned.select("row", F.explode("places").alias("p")).select("row", "p.instance", "p.start", "p.stop", F.col("p.kind").alias("seed")).where(f"seed IS NULL OR seed = '{SECRET}'")
    told = discovered(scanned).join(unseen.groupBy("instance").agg(F.count("*").alias("n")), "instance")
    spans = join_told(unseen.drop("seed"), checkpointed(told), "instance", "n", unseen.count(), "inner")
    more = spans.groupBy("row").agg(F.sort_array(F.collect_set(F.struct("start", "stop", "kind"))).alias("m"))
    shaped = F.expr("transform(coalesce(m, array()), s -> named_struct('kind', s.kind, 'start', s.start, 'stop', s.stop))")
    return scanned.select("row", "id", "row_key", "base").join(more, "row", "left").select(F.col("id").alias(id_column), "row_key", "base", shaped.alias("more"))


def joined(spans: str) -> str:
    """SQL for kind:start:stop of a column of spans, comma-joined."""
    return f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.stop)), ',')"


def redact(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length_column: str = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, and the length set anew.

    Overlapping spans become one, named by the first. Documents without a span are passed on as they are.
    """
    mark, held = fresh(docs.columns, "mark"), fresh(docs.columns, "spans")
    found = find(docs, id_column, text_column).select(F.struct(F.col(id_column).alias("id"), "row_key").alias(mark), F.concat("base", "more").alias("s")).where(F.size("s") > 0)
    spans = found.groupBy(mark).agg(F.first("s").alias(held), F.count("*").alias("n"))  # equal texts have equal spans
    keyed = docs.withColumn(mark, F.struct(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("row_key")))
    count = fresh([*docs.columns, mark, held], "n")
    both = join_told(keyed, spans.withColumnRenamed("n", count), mark, count, docs.count()).select(*docs.columns, held)
    at = docs.columns.index(text_column)
    long = docs.columns.index(length_column) if length_column in docs.columns else -1
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                whole = part.column(at).to_pylist()
                found = part.column(part.num_columns - 1).to_pylist()
                changed = [masked(t, s) if s else t for t, s in zip(whole, found, strict=True)]
                columns = list(part.columns[:-1])
                columns[at] = pa.array(changed, pa.string())
                if long >= 0:
                    old = part.column(long).to_pylist()
                    columns[long] = pa.array([len(t) if s else n for t, s, n in zip(changed, found, old, strict=True)], part.schema.field(long).type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return both.mapInArrow(run, fields)


def masked(text: str, spans: list[dict]) -> str:
    """The text with its spans replaced by their kind in brackets."""
    out, last = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["stop"])):
        if s["start"] >= last:
            out += [text[last : s["start"]], f"[{s['kind'].upper()}]"]
        last = max(last, s["stop"])
    return "".join([*out, text[last:]])
