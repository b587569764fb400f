"""The source audit against plain counting, on odd rows and with tiles, blocks and held counts of the smallest sizes."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from litspan.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def slow(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    held, own, total = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source, found = lang or "", source or "", TERM.findall((text or "").translate(lower))
        held[lang].update(set(found))
        own[lang, source].update(found)
        total[lang].update(found)
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, source in own:
        kept = [t for t, n in held[lang].items() if n >= divergence.LEAST_DOCS]

        def shares(counts, kept=kept):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p = shares(own[lang, source])
        pairs = [(sum(f(p[t], q[t]) for t in kept), other.encode()) for l, other in own if l == lang and other != source for q in [shares(own[l, other])]]
        q = shares(total[lang])
        terms = [(f(p[t], q[t]), t.encode()) for t in kept if own[lang, source][t] and p[t] > q[t]]
        for part, found in (("pair", pairs), ("term", terms)):
            found = sorted(found, key=lambda x: (-x[0], x[1]))
            out += [(lang, source, part, item.decode(), value, k) for k, (value, item) in enumerate(found, 1) if part == "pair" or k <= 10]
    return sorted(out)


def generated(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{chr(97 + a)}{chr(97 + b)}" for a in range(8) for b in range(8)] + ["É", "é", "Zebra", "漢字", "x1y", "ß"]
    rows = []
    for _ in range(n):
        source = rng.choice(["hot"] * 5 + [f"s{k}" for k in range(9)])
        rows.append((rng.choice(["en", "de", None]), source, " ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randint(0, 60)))))
    return rows


ODD = [("en", None, None), (None, None, ""), ("fr", "a", "tous seuls"), ("fr", "b", ""), ("en", "", "123 _ -"), ("es", "alone", " ".join(["uno"] * 5)), ("en", "hot", "waa " * 30_000)] + [("it", "one", "ciao ciao")] * 12


@pytest.mark.parametrize("tile, held", [(512, 1 << 18), (2, 5), (1, 100)])
def test_equals_plain_counting(spark, tile, held):
    rows = generated(700) + ODD
    df = spark.createDataFrame([(*r, k, "clash") for k, r in enumerate(rows)], "lang string, source string, text string, n long, term string").repartition(3)
    got = sorted(tuple(r) for r in divergence.audit(df, most=held, tile=tile).collect())
    assert got == slow(rows)


def test_shares_are_exact_for_huge_counts(spark):
    rows = [(0, 0, 1), (7, 7, 1), (9 * 10**14, 9 * 10**14 + 12345, 10**6), (123456789012345, 987654321098765, 54321)]
    df = spark.createDataFrame(rows, "n long, total long, terms long").select("n", "total", "terms", divergence.share("n", "total", "terms").alias("p"))
    for r in df.collect():
        assert r.p == 1 + 10**9 * (r.n + 2) // (r.total + 2 * r.terms)


def test_empty_table(spark):
    df = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.audit(df).collect() == []
