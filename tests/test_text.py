from __future__ import annotations

import re
import time

import pytest
from pyspark.sql import functions as F

from litspan.functions import text as T


def values(spark, column, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in df.select("i", column(F.col("t")).alias("x")).orderBy("i").collect()]


def test_heading_kinds(spark):
    cases = {
        "1.1 Data": "decimal-subsection", "III-A Setup": "roman-hyphen-subsection", "Appendix B Proofs": "appendix", "I. Introduction": "roman", "2. Method": "arabic",
        "A. Models": "alpha-subsection", "References": "mandatory-unnumbered", "Related Work": "unnumbered", "2 Method": "unnumbered", "": "unnumbered",
    }
    assert values(spark, T.heading_kind, list(cases)) == list(cases.values())
    assert values(spark, T.heading_kind, [None]) == ["unnumbered"]


def test_keys_of_ids(spark):
    assert values(spark, T.paper_id_key, ["arxiv:2308.01234v2", "2003.10303", "solv-int/9901001v2", None]) == ["2308.01234", "2003.10303", "sol", ""]


def test_topic_keeps_a_blank_that_quotes_hid(spark):
    assert values(spark, T.topic_key, ["\"' x\"", " A\tB ", None]) == [" x", "a b", ""]


def test_romans(spark):
    assert values(spark, T.roman_to_int, ["I", "iv", "XX", "XXI", ""]) == [1, 4, 20, None, None]


def test_markdown_like_the_substitutions(spark):
    text = "# Head\n**bold** and *it* `code`\n> quote\n---\n![a](b) [c](d) ~~x~~ ```py\nz\n```"
    python = text
    for pattern, to in T.MARKDOWN:
        python = re.sub(pattern, to.replace("$1", r"\1"), python)
    assert values(spark, T.strip_markdown, [text]) == [python]


def test_author_preview(spark):
    df = spark.createDataFrame([(["Ann B", " ", "Cy D", "Ed"],), (None,)], "a array<string>")
    shown = [r.x for r in df.select(T.author_preview(F.col("a"), 2, "cy").alias("x")).collect()]
    assert shown == ["Cy D, Ann B, et al.", ""]


def test_json_in_words(spark):
    got = values(spark, lambda c: T.safe_json(c, "a int").getField("a"), ['{"a": 1}', 'well {"a": 2} ok', "none", None])
    assert got == [1, 2, None, None]


@pytest.mark.parametrize("bad", ["[", "{}", ""])
def test_broken_heading_json(spark, bad):
    assert values(spark, T.headings_from_json, [bad]) in ([None], [[]])


def test_summary_and_error_clips(spark):
    assert values(spark, T.clip_summary, ["x" * 900, "y" * 901]) == ["x" * 900, "y" * 900 + "..."]
    assert values(spark, T.clip_error, ["e" * 2000]) == ["e" * 1000]


def test_bibliographies_are_read_in_two_passes(spark):
    """Runs by windows are those of ``longest_run``, repeats and gaps included; entries of all styles come from one pass over lines and one over brackets."""
    from litspan.operators import references as B

    rows = [(p, k, (k * (p + 3) // 4 + k * k % (p + 2)) % 9) for p in range(12) for k in range(30)]
    numbers = spark.createDataFrame(rows, "paper int, pos int, n int")
    plain = {(r.paper, r.run_start, r.run_length, r.run_end) for r in B.longest_run(numbers, "paper").collect()}
    told = B.with_run(numbers, "paper").collect()
    assert {(r.paper, r.run_start, r.run_length, r.run_end) for r in told} == plain and len(told) == len(rows) and {r.every for r in told} == {30}
    for found in B.parse(spark.createDataFrame([(1, "1. a b\n2. c d")], "paper_id int, text string")):
        assert found._jdf.queryExecution().analyzed().toString().count("Generate posexplode") <= 2


def test_author_preview_of_many_authors(spark):
    """The place of the author wanted is sought once, not once for every author: a hundred thousand take seconds."""
    many = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(100_000)), lambda i: F.concat(F.lit("Ann "), i)).alias("a"))
    last = F.upper(F.element_at("a", -1))
    began = time.time()
    got = many.select(T.author_preview(F.col("a"), 3, last).alias("x"), T.author_preview(F.col("a"), 3, "nobody").alias("y"), T.author_preview(F.col("a"), 3, "ann 2").alias("z")).first()
    assert (got.x, got.y, got.z) == ("Ann 100000, Ann 0, Ann 1, et al.", "Ann 0, Ann 1, Ann 2, et al.", "Ann 2, Ann 0, Ann 1, et al.")
    assert time.time() - began < 60
