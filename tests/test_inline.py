"""Runs of inline marks: what opens and closes, nesting, raw parts; runs tile the words, and drawn places lead back."""

import random

import pytest
from pyspark.sql import functions as F

from foliant.sources import inline
from foliant.sources.inline import runs_of


def short(text):
    return [(r["text"], *r["styles"]) for r in runs_of(text)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("She went down anyway.", [("She went down anyway.",)]),
        ("a **firm** answer", [("a ",), ("firm", "bold"), (" answer",)]),
        ("an *aside* here", [("an ",), ("aside", "italic"), (" here",)]),
        ("call `npm run check` first", [("call ",), ("npm run check", "code"), (" first",)]),
        ("==this== ~~no~~", [("this", "mark"), (" ",), ("no", "strike")]),
        ("2 * 3 = 6", [("2 * 3 = 6",)]),
        ("so $x^2$ grows, let $a$ be", [("so ",), ("x^2", "math"), (" grows, let ",), ("a", "math"), (" be",)]),
        ("costs $5 and $10", [("costs $5 and $10",)]),
        ("**bold _and italic_**", [("bold ", "bold"), ("and italic", "bold", "italic")]),
        ("***both***", [("both", "bold", "italic")]),
        ("snake_case_name", [("snake_case_name",)]),
        ("C++ and C++/CLI", [("C++ and C++/CLI",)]),
        ("a ++b++", [("a ",), ("b", "underline")]),
        ("`**x**`", [("**x**", "code")]),
        ("`a\nb` `c`", [("`a\nb",), (" ", "code"), ("c`",)]),
        ("**a ** b**", [("a ** b", "bold")]),
        ("__a__ ___b___", [("a", "bold"), (" ",), ("b", "bold", "italic")]),
        ("****", [("****",)]),
        ("*a **b** c*", [("a **b", "italic"), ("* c*",)]),
        ("_a **b** c_", [("a ", "italic"), ("b", "bold", "italic"), (" c", "italic")]),
        ("", []),
        (None, []),
    ],
)
def test_runs(text, want):
    assert short(text) == want


def test_runs_lie_in_the_text():
    pick = random.Random(2)
    for _ in range(3000):
        text = "".join(pick.choice(["*", "**", "_", "`", "$", "==", "++", "~~", "a", "é", " ", "b c", "\n"]) for _ in range(pick.randrange(25)))
        at = 0
        for r in runs_of(text):
            assert r["from"] >= at and r["text"] and text[r["from"] : r["from"] + len(r["text"])] == r["text"]
            assert all(c in "*_`$=+~" for c in text[at : r["from"]])
            at = r["from"] + len(r["text"])
        assert all(c in "*_`$=+~" for c in text[at:])


def test_many_open_signs_take_no_square_time():
    assert len(runs_of("**a " * 20_000)) == 1 and len(runs_of("_a " * 20_000)) == 1 and len(runs_of("$a $ " * 20_000)) == 1


def test_drawn_places_lead_back(spark):
    texts = ["a **firm** `x` end", "plain", "", "**b** _c_", "`code` $t$", "~~gone~~ é😀 ==m=="]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string").withColumn("r", inline.runs(F.col("t")))
    rows = df.select("id", "t", inline.drawn_text(F.col("r")).alias("d"), inline.places(F.col("r")).alias("p"))
    at = rows.select("*", F.explode(F.sequence(F.lit(0), F.length("d"))).alias("at")).withColumn("s", inline.source_of(F.col("p"), F.col("at"), F.length("t"))).withColumn("back", inline.drawn_of(F.col("p"), F.col("s")))
    seen = 0
    for r in at.collect():
        if r.at < len(r.d) and r.d[r.at] != inline.PAD:
            assert r.t[r.s] == r.d[r.at] and r.back == r.at
            seen += 1
        elif r.at == len(r.d):
            assert (r.s, r.back) == (len(r.t), len(r.d))
    assert seen > 30


def test_signs_that_open(spark):
    said = ["Von.*** Keit", "a $5 b", "a $ b", "a_b", "_b", "2 * 3 ** 4", "`a", "`a`", "== b", "==b", "", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in said], "t string").select(F.col("t").rlike(inline.OPENING)).collect()]
    assert got == [True, True, False, False, True, False, False, True, False, True, False, None]
