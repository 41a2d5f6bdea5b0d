"""Names and terms of dictionaries against patterns and plain search."""

import random
import re
import tracemalloc

import pytest
from pyspark.sql import functions as F

from loomspark.functions.text import brand_pattern
from loomspark.operators import dictionary

PARTS = ["a", "b", "ab", "Ab", "ñ", "c++", ".net", "x.y", "&", "a&b", "9", "b9", "_", "a_b", "-", "日本"]


def drawn(draw, n, most):
    return ["".join(draw.choice(PARTS) + draw.choice([" ", "  ", "", "\n", " "]) for _ in range(draw.randint(1, most))).strip() for _ in range(n)]


def told(name, text):
    """Whether the pattern of a name is in a text."""
    parts = [re.escape(p) for p in name.split()]
    return re.search(r"(?i)(?<![^\W_])" + r"\s+".join(parts) + r"(?![^\W_])", text) is not None


def test_automaton_finds_what_patterns_find():
    draw = random.Random(1)
    for _ in range(300):
        names = list(dict.fromkeys(drawn(draw, 25, 3)))
        automaton = dictionary.Automaton(names)
        for text in drawn(draw, 10, 30):
            assert {names[i] for i in automaton.find(text)} == {n for n in names if told(n, text)}
    assert brand_pattern("a b").endswith(r"a\s+b(?![\p{L}\p{N}])")


@pytest.mark.parametrize("most", [0, 10**6])
def test_names_by_both_ways(spark, most):
    """One automaton in every task, or texts and names that meet by the rarest word."""
    draw = random.Random(2)
    names, texts = list(dict.fromkeys(drawn(draw, 60, 3))), [*drawn(draw, 80, 25), "", "  ", None, "the end of a b " * 3_000]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(3, "ab", "a key twice"), (None, "ab", "no key")]
    docs = spark.createDataFrame(rows, "id long, text string, name string").repartition(3)
    known = spark.createDataFrame([(n, 1) for n in [*names, *names[:5], " ", None]], "name string, key int")
    got = [tuple(r) for r in dictionary.mentions_of(docs, "id", "text", known, most=most).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(i, n) for i, t, _ in rows if t and i is not None for n in names if told(n, t)}
    assert dictionary.mentions_of(docs, "id", "text", known.where("false"), most=most).isEmpty()
    assert dictionary.mentions_of(docs.where("false"), "id", "text", known, most=most).isEmpty()


def test_a_hundred_thousand_names(spark):
    names = spark.range(100_000).select(F.concat(F.lit("Name "), F.col("id"), F.lit(" Co."), F.col("id") % 7).alias("name"))
    docs = spark.createDataFrame([(1, "buy from name  77 CO.0 now, not Name 78 Co.0"), (2, "name 99999 co.4")], "id long, text string")
    want = {(1, "Name 77 Co.0"), (2, "Name 99999 Co.4")}
    assert {tuple(r) for r in dictionary.mentions_of(docs, "id", "text", names).collect()} == want
    assert {tuple(r) for r in dictionary.mentions_of(docs, "id", "text", names, most=1_000).collect()} == want


@pytest.mark.parametrize("most", [0, 10**4])
def test_terms_by_both_ways(spark, most):
    draw = random.Random(3)
    needles = [*dict.fromkeys(drawn(draw, 50, 2)), "", "+", "C+", "nothing like it", "É"]
    texts = [*drawn(draw, 60, 20), "", "ÉÉ"]
    docs = spark.createDataFrame([*enumerate(texts), (10_000, None)], "id long, text string")
    terms = spark.createDataFrame([("g", f"t{i % 40}", i, n) for i, n in enumerate([*needles, needles[0], None])], "group string, term string, ord int, needle string")
    got = sorted(tuple(r) for r in dictionary.contains_terms(docs, "id", "text", terms, most=most).collect())
    want = sorted((i, "g", f"t{k % 40}", k) for i, t in enumerate(texts) for k, n in enumerate([*needles, needles[0]]) if n.lower() in t.lower())
    assert got == want


@pytest.mark.parametrize("characters", [0, 10**6])
def test_many_terms_by_both_ways(spark, characters):
    """Terms carried to every task, or terms that meet the texts by their rarest characters; a key twice lists a term once."""
    draw = random.Random(4)
    needles = [*dict.fromkeys(drawn(draw, 50, 2)), "", "+", "C+", "nothing like it", "É"]
    texts = [*enumerate([*drawn(draw, 100, 20), "", "ÉÉ"]), (10_000, None), (None, "a b"), (3, "ÉÉ a b"), (3, "ab")]
    docs = spark.createDataFrame(texts, "id long, text string").repartition(3)
    terms = spark.createDataFrame([("g", f"t{i % 40}", i, n) for i, n in enumerate([*needles, needles[0], None])], "group string, term string, ord int, needle string")
    got = [tuple(r) for r in dictionary.contains_terms(docs, "id", "text", terms, most=0, characters=characters).collect()]
    want = {(i, "g", f"t{k % 40}", k) for i, t in texts if t is not None and i is not None for k, n in enumerate([*needles, needles[0]]) if n.lower() in t.lower()}
    assert len(got) == len(set(got)) and set(got) == want


def test_a_carried_dictionary_meets_no_shuffle_of_units(spark):
    """What is shuffled for a text is the numbers of its terms, in one row, and nothing of the text."""
    docs = spark.range(10).select("id", F.lit("some words").alias("text"))
    terms = spark.range(2_000).select(F.lit("g").alias("group"), F.concat(F.lit("t"), "id").alias("term"), F.concat(F.lit("w"), "id").alias("needle"), F.lit(0).alias("ord"))
    plan = dictionary.contains_terms(docs, "id", "text", terms)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "broadcast" in plan and "Contains" not in plan


def test_an_automaton_is_small(spark):
    """It takes a third less than lists and tuples for each name and state."""
    names = [f"Supplier#{i:09d}" for i in range(20_000)]
    tracemalloc.start()
    automaton = dictionary.Automaton(names)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert automaton.find("supplier#000000077, supplier#20000") == {77}
    assert peak / len(names) < 600
