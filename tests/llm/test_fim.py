"""Fill-in-middle: the query against SQL, exact round trips of every form, units of several kinds, odd rows."""

import hashlib

import duckdb
import regex
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.llm import fim, queries

SF = "/root/testdata/sf0.001"
PIECES = st.lists(st.sampled_from(["<", "<P", "S>", ">", "M", "é", "😀", " ", "\n", "a", "<P>", "<M>"]), max_size=12).map("".join)


@given(PIECES, st.integers(0, 10**6), st.sampled_from([fim.CODE_POINT, r"\S+\s*", r"[^\n]*\n"]))
def test_round_trip(text, doc, unit):
    n, form, before, middle, output = fim.cut(str(doc), text, regex.compile(unit), 1, 10, 20)
    assert fim.restored(output, form) == text
    assert n == sum(1 for _ in regex.finditer(unit, text))
    if form == "plain":
        assert output == text and before is middle is None
    else:
        assert sorted(output) == sorted(text + "<P><S><M>") and before + middle <= len(text)
        assert output.endswith("<M>" + text[before : before + middle])


def test_ends_tile_the_text():
    assert list(fim.unit_ends("ab  c d", regex.compile(r"\w+"))) == [0, 2, 5, 7]
    assert list(fim.unit_ends("", regex.compile(fim.CODE_POINT))) == [0]
    assert fim.unit_ends("a\r\n😀", regex.compile(fim.CODE_POINT)).tolist() == [0, 1, 2, 3, 4]


def plain_rows(docs):
    """The contract by slices, without offsets."""
    out = []
    for doc, text in docs:
        text = text or ""
        h = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
        h = [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]
        a, b = sorted(x % (len(text) + 1) for x in h[:2])
        if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
            form, made = "plain", text
        elif h[3] % 100 < 20:
            form, made = "spm", "<S>" + text[b:] + "<P>" + text[:a] + "<M>" + text[a:b]
        else:
            form, made = "psm", "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b]
        cut = (None, None) if form == "plain" else (a, b - a)
        out.append((doc, len(text), form, *cut, hashlib.sha256(made.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), made))
    return out


def test_odd_rows(spark):
    rows = [(i, "žluťoučký kůň 😀\n" * (i % 7)) for i in range(60)]
    rows += [(None, "no id"), (None, None), (3, None), (5, ""), (8, "a <S> in it"), (9, "twice"), (9, "twice"), (2**53 + 1, "a large id"), (-4, "x"), (11, "long " * 200_000)]
    docs = spark.createDataFrame([(d, t, "c", 1) for d, t in rows], "doc_id long, text string, n string, output long")
    got = [tuple(r) for r in fim.fill_in_middle(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output").collect()]
    assert sorted(got, key=str) == sorted(plain_rows(rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = fim.fill_in_middle(docs).withColumn("back", fim.restore(F.col("output"), F.col("form")))
    assert sorted(r.back for r in back.collect()) == sorted(t or "" for _, t in rows)
    assert fim.fill_in_middle(docs.limit(0)).collect() == []


def test_other_units_and_shares(spark):
    docs = spark.createDataFrame([(i, "one two  three\nfour " * 5) for i in range(50)], "doc_id long, text string")
    got = fim.fill_in_middle(docs, unit=r"\S+\s*", plain_percent=0, spm_percent=100).collect()
    assert {(r.n, r.form) for r in got} == {(20, "spm")}
    starts = {0} | {m.end() for m in regex.finditer(r"\S+\s*", "one two  three\nfour " * 5)}
    assert all(r.prefix_chars in starts and r.prefix_chars + r.middle_chars in starts for r in got)
    assert fim.fill_in_middle(docs, plain_percent=100).where("form <> 'plain'").count() == 0


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet' UNION ALL SELECT NULL, 'no id', '', '', 0 UNION ALL SELECT 7, NULL, '', '', 0")
    want = con.sql(queries.OP12_SQL)
    extra = spark.createDataFrame([(None, "no id"), (7, None)], "doc_id long, text string")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(extra)
    got = fim.fill_in_middle(docs, texts=False)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
    assert sorted(map(tuple, queries.op12_fill_in_middle(spark, SF).collect())) == sorted(r for r in want.fetchall() if r[0] is not None and not (r[0] == 7 and r[1] == 0))
