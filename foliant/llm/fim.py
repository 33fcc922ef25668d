"""Fill-in-middle transformation: a document's units are cut in three by its seeds, and the middle is moved to the end.

An Arrow-batched pandas UDF does the work where a text lies, without a shuffle. The regex library's finditer gives the
units, whose ends are held in an array of four or eight bytes a unit; two lookups in it give the three slices. The seeds
are the first four groups of eight digits in the hex SHA-256 of `seed:id`, so that a document is cut alike in every run.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One code point.
CODE_POINT = "(?s:.)"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred documents, those that stay plain, and of the others those that begin with the suffix.
PLAIN_PERCENT, SPM_PERCENT = 10, 20

CUT = "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def seeds(doc: str, seed: int) -> list[int]:
    """Four unsigned numbers of 32 bits."""
    digest = hashlib.sha256(f"{seed}:{doc}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def unit_ends(text: str, unit: regex.Pattern) -> array:
    """0, and the end of each unit from left to right. What lies between two units belongs to the second."""
    ends = array("I" if len(text) < 1 << 32 else "Q", [0])
    ends.extend(map(regex.Match.end, unit.finditer(text, concurrent=False)))
    return ends


def joined(form: str, prefix: str, middle: str, suffix: str) -> str:
    if form == "spm":
        return f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text that was cut, from the output and its form. No sign's end begins another, so each is found where it was put."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    at = output.index(second, len(first))
    to = output.index(MIDDLE, at + len(second))
    a, b, middle = output[len(first) : at], output[at + len(second) : to], output[to + len(MIDDLE) :]
    return b + middle + a if form == "spm" else a + middle + b


def cut(doc: str, text: str, unit: regex.Pattern, seed: int, plain_percent: int, spm_percent: int) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of a text."""
    h1, h2, h3, h4 = seeds(doc, seed)
    ends = unit_ends(text, unit)
    n = len(ends) - 1
    if not text or h3 % 100 >= 100 - plain_percent or any(sign in text for sign in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = ends[a], ends[b]
    form = "spm" if h4 % 100 < spm_percent else "psm"
    return n, form, a, b - a, joined(form, text[:a], text[a:b], text[b:])


def _cutter(unit: str, seed: int, plain_percent: int, spm_percent: int, texts: bool):
    @F.pandas_udf(CUT + (", output string" if texts else ""))
    def cutter(docs: pd.Series, bodies: pd.Series) -> pd.DataFrame:
        units, digest = regex.compile(unit), lambda x: hashlib.sha256(x.encode()).hexdigest()
        rows = []
        for doc, body in zip(docs, bodies):
            n, form, before, middle, output = cut(doc, body, units, seed, plain_percent, spm_percent)
            rows.append((n, form, before, middle, digest(output), digest(restored(output, form)), *([output] if texts else [])))
        names = [c.split()[0] for c in CUT.split(", ")] + (["output"] if texts else [])
        out = pd.DataFrame(rows, columns=names)
        return out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    return cutter


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    unit: str = CODE_POINT,
    seed: int = 1,
    plain_percent: int = PLAIN_PERCENT,
    spm_percent: int = SPM_PERCENT,
    texts: bool = True,
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256, output) of every row of docs.

    n counts the text's units, those that `unit` matches from left to right. The prefix ends after the smaller of two
    seeds' units, the middle after the larger, each from 0 to n; signs after the last unit are the suffix's. form is plain
    (the text itself), psm or spm; a text that holds one of the three signs, or is null or empty, is plain, and what is
    cut has its lengths in code points. restored_sha256 is of the text rebuilt from output and form.

    Rows without an id are cut alike, as by an empty id; repeated rows are kept, an empty table gives no rows, and other
    columns of docs are left out, whatever their names. Without `texts` the output stays in the worker, and only its
    digest comes back. A text takes four bytes a unit besides itself, however long it is.
    """
    doc, body = F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    made = _cutter(unit, seed, plain_percent, spm_percent, texts)(doc, body)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), made.alias("cut")).select("doc_id", "cut.*")


def restore(output: Column, form: Column) -> Column:
    """The texts that were cut."""

    @F.pandas_udf("string")
    def back(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([restored(o, f) for o, f in zip(outputs, forms)], dtype=object)

    return back(output, form)
