"""Inline marks of a text as runs of words with their styles, and the way from the words as drawn to the text and back.

Marks may stand in marks, so a stack holds what is still to be cut; runs don't overlap, and what lies between them are the
marks themselves. Offsets of runs count code points of the text. Places on drawn lines are found in Spark's own functions
over the runs of a row: two piecewise linear maps, each the other's inverse on the words.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.operators.spans import once

#: Around inline code, as drawn, stands a thin space on either side.
PAD = " "


@dataclass(frozen=True)
class Mark:
    """A sign that opens and closes a style. Words begin and end right at it, and not with one of the letters in `off`."""

    sign: str
    styles: tuple[str, ...]
    off: str = ""
    apart: str = ""  # no word sign, and none of these, stands outside of it
    raw: bool = False  # what is within is taken as written
    none_within: str = ""


#: Signs in the order in which they are tried.
MARKS = (
    Mark("***", ("bold", "italic")),
    Mark("___", ("bold", "italic"), apart="_"),
    Mark("**", ("bold",)),
    Mark("__", ("bold",), apart="_"),
    Mark("*", ("italic",), off="*"),
    Mark("_", ("italic",), off="_", apart="_"),
    Mark("`", ("code",), raw=True, none_within="`\n"),
    Mark("~~", ("strike",)),
    Mark("++", ("underline",), off="+", apart="+"),
    Mark("==", ("mark",)),
    Mark("$", ("math",), off="$", raw=True, none_within="$\n"),
)
SIGNS = {m.sign[0] for m in MARKS}
#: A sign that may open a mark: code that closes, or another sign right before what it would mark.
OPENING = r"`[^`\n]+`|\$[^ \t\n\f\r$]|\*\*[^ \t\n\f\r]|==[^ \t\n\f\r]|~~[^ \t\n\f\r]|[+][+][^ \t\n\f\r+]|\*[^ \t\n\f\r*]|(^|[^A-Za-z0-9_])_+[^ \t\n\f\r_]"
RUNS = "array<struct<from: long, text: string, styles: array<string>>>"


def _word(c: str) -> bool:
    return c.isascii() and (c.isalnum() or c == "_")


def _opens(m: Mark, text: str, at: int, end: int) -> bool:
    inner = at + len(m.sign)
    if not text.startswith(m.sign, at) or inner >= end:
        return False
    if m.sign != "`" and (text[inner].isspace() or text[inner] in m.off):
        return False
    before = text[at - 1] if at else ""
    return not (m.apart and before and (_word(before) or before in m.apart))


def _closes(m: Mark, text: str, at: int, end: int) -> bool:
    last, after = text[at - 1], text[at + len(m.sign)] if at + len(m.sign) < len(text) else ""
    if m.sign != "`" and (last.isspace() or last in m.off):
        return False
    if m.sign == "$":
        return last != "\\" and not (after.isascii() and after.isdigit())
    return not (m.apart and after and (_word(after) or after in m.apart))


def _close(m: Mark, text: str, inner: int, end: int) -> int:
    """Where the first sign that closes m stands after at least one letter, or -1."""
    at = inner + 1
    while 0 <= (at := text.find(m.sign, at, end)):
        if _closes(m, text, at, end):
            return -1 if any(text.find(c, inner, at) >= 0 for c in m.none_within) else at
        if m.none_within:  # the sign itself is among these
            return -1
        at += 1
    return -1


def runs_of(text: str | None) -> list[dict]:
    """Runs (from, text, styles) of a text, empty ones left out; styles are sorted."""
    out: list[dict] = []
    text = text or ""
    open_ = [(0, len(text), frozenset())]
    while open_:
        start, end, styles = open_.pop()
        plain = at = start
        gone: set[str] = set()  # signs that nothing closes from here on
        while at < end:
            found = None
            if text[at] in SIGNS:
                for m in MARKS:
                    # what is raw ends at a sign or line end of its own, so that a later one may still close
                    if m.sign not in gone and _opens(m, text, at, end):
                        if (to := _close(m, text, at + len(m.sign), end)) >= 0:
                            found = m, to
                            break
                        if not m.none_within:
                            gone.add(m.sign)
            if found is None:
                at += 1
                continue
            m, to = found
            inner = at + len(m.sign)
            if at > plain:
                out.append({"from": plain, "text": text[plain:at], "styles": sorted(styles)})
            within = styles | set(m.styles)
            if to + len(m.sign) < end:
                open_.append((to + len(m.sign), end, styles))
            if m.raw:
                out.append({"from": inner, "text": text[inner:to], "styles": sorted(within)})
            else:
                open_.append((inner, to, within))
            plain = at = end  # the rest waits on the stack
        if plain < end:
            out.append({"from": plain, "text": text[plain:end], "styles": sorted(styles)})
    return out


def runs(text: Column) -> Column:
    """The runs of a Markdown text, as RUNS; a null text has none."""

    @F.pandas_udf(RUNS)
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([runs_of(t) for t in texts], dtype=object)

    return found(text)


def drawn_text(runs: Column) -> Column:
    """The words of runs as they are drawn."""
    pad = lambda r: F.when(F.array_contains(r["styles"], "code"), PAD).otherwise("")
    return F.array_join(F.transform(runs, lambda r: F.concat(pad(r), r["text"], pad(r))), "")


def places(runs: Column) -> Column:
    """array<struct<from, to, shown, end, pad>>: where each run's words lie in the text, and the run as it is drawn."""
    pad = lambda r: F.when(F.array_contains(r["styles"], "code"), len(PAD)).otherwise(0).cast("long")
    kind = "array<struct<from: bigint, to: bigint, shown: bigint, end: bigint, pad: bigint>>"

    def step(acc: Column, r: Column) -> Column:
        at = F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0).cast("long"))
        n = F.length(r["text"]).cast("long")
        return F.array_append(acc, F.struct(r["from"].alias("from"), (r["from"] + n).alias("to"), at.alias("shown"), (at + n + 2 * pad(r)).alias("end"), pad(r).alias("pad")))

    return F.aggregate(runs, F.array().cast(kind), step)


def source_of(places: Column, at: Column, length: Column) -> Column:
    """Where the sign drawn at `at` stands in the text, whose length is given; a thin space counts for the sign next to it."""
    first = lambda p: F.get(F.filter(p, lambda x: x["end"] > at), F.lit(0))
    found = once(first(places), lambda x: x["from"] + F.least(x["to"] - x["from"] - 1, F.greatest(F.lit(0).cast("long"), at - x["shown"] - x["pad"])))
    return F.coalesce(found, length.cast("long"))


def drawn_of(places: Column, at: Column) -> Column:
    """Where the sign at `at` of the text is drawn; a mark's sign counts for the first word after it."""
    first = lambda p: F.get(F.filter(p, lambda x: x["to"] > at), F.lit(0))
    found = once(first(places), lambda x: x["shown"] + x["pad"] + F.greatest(F.lit(0).cast("long"), at - x["from"]))
    return F.coalesce(found, F.try_element_at(places, F.lit(-1))["end"], F.lit(0).cast("long"))
