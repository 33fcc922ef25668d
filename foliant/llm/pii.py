"""Operator 6: personal data by anchor expansion.

An Aho-Corasick automaton finds at-signs, plus signs, digits, scheme separators and identifier cues in one pass. Each
anchor is expanded by a local parser that settles the boundaries and validates the value; no pattern is ever searched
for over the whole text. The parsers for e-mail addresses, IP addresses, cards and phone numbers find exactly the
leftmost non-overlapping matches of their patterns; those for IBANs, account numbers, secrets and logins in URLs add
further spans.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import sliced

#: In the order in which spans of one start are listed.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "account", "secret", "login")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGITS = re.compile(r"[0-9]+")
IP_REST = re.compile(r"\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"[\s:.#-]*([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
ACCOUNT = re.compile(r"(?:\s?(?:number|no|nr|num|id))?[\s.:#=-]+([0-9](?:[ -]?[0-9]){5,})(?![0-9])", re.I)
SECRET = re.compile(r"\s*[:=]\s*[\"']?([A-Za-z0-9_+/.=-]{12,})")
LOGIN = re.compile(r"[^\s/@:?#]+:[^\s/@?#]+@")
#: No length is bounded but by the kinds' own definitions: an IBAN has 15 to 34 signs, an account number 6 digits or more,
#: a secret 12 signs or more. A cue's value follows it, with white space and : . # = - between them.
#: Identifier cues and the parser each one starts.
CUES = {"iban": "iban", "account": "account", "acct": "account", "konto": "account", "compte": "account", "cuenta": "account", "token": "secret", "secret": "secret", "password": "secret", "api_key": "secret"}


#: Signs of an IBAN by country; one of another country ends with a word.
IBAN_SIGNS = {
    x[:2]: int(x[2:])
    for x in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 "
        "GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 "
        "MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 TN24 TR26 UA29 VA22 VG24 XK20"
    ).split()
}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        total += x if k % 2 == 0 else 2 * x - 9 * (x > 4)
    return total % 10 == 0


def _iban_valid(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _iban_end(s: str) -> int | None:
    """The end of the valid number that s starts with: words in capitals may follow it."""
    size, signs = IBAN_SIGNS.get(s[:2]), 0
    for end, c in enumerate(s, 1):
        signs += c != " "
        whole = signs == size if size else signs >= 15 and not s[end : end + 1].isalnum()
        if whole and c != " " and _iban_valid(s[:end]):
            return end
    return None


def automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    for word, kind in {"@": "at", "://": "scheme", "+": "plus"}.items():
        out.add_word(word, kind)
    for d in "0123456789":
        out.add_word(d, "digit")
    for cue, kind in CUES.items():
        for form in (cue, cue.capitalize(), cue.upper()):
            out.add_word(form, kind)
    out.make_automaton()
    return out


def spans(text: str | None, anchors) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, end exclusive, by start and then by kind."""
    if not text:
        return []
    out = []
    mail_end = ip_end = card_end = phone_end = 0
    for last, kind in anchors.iter(text):
        if kind == "digit":
            at = last
            if at >= card_end and (m := CARD.match(text, at)):
                card_end = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", at, card_end))
            if at >= ip_end:  # what follows a run of digits decides for every start within it
                run_end = DIGITS.match(text, at).end()
                if m := IP_REST.match(text, run_end):
                    ip_end = m.end()
                    if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in text[at:ip_end].split(".")):
                        out.append(("ip", at, ip_end))
                else:
                    ip_end = run_end
        elif kind == "at":
            start = last
            while start > mail_end and text[start - 1] in LOCAL:
                start -= 1
            if start < last and (m := DOMAIN.match(text, last + 1)):
                mail_end = m.end()
                out.append(("email", start, mail_end))
        elif kind == "plus":
            if last >= phone_end and (m := PHONE.match(text, last)):
                phone_end = m.end()
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append(("phone", last, phone_end))
        elif kind == "iban":
            if (m := IBAN.match(text, last + 1)) and (end := _iban_end(m[1])):
                out.append(("iban", m.start(1), m.start(1) + end))
        elif kind == "account":
            if m := ACCOUNT.match(text, last + 1):
                out.append(("account", m.start(1), m.end(1)))
        elif kind == "secret":
            if m := SECRET.match(text, last + 1):
                out.append(("secret", m.start(1), m.end(1)))
        elif m := LOGIN.match(text, last + 1):
            out.append(("login", m.start(), m.end() - 1))
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted(set(out), key=lambda s: (s[1], rank[s[0]], s[2]))


SPANS = "array<struct<kind: string, start: long, end: long>>"


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) of every row: where personal data lies in the whole text; a null or empty text has none.

    Repeated rows and rows without an id are kept, an empty table gives no rows, and other columns of docs are left out,
    whatever their names. Spans of one start are listed in the order of KINDS, equal ones once. No shuffle: each text,
    however long, is read once, where it lies.
    """
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        anchors = automaton()
        for batch in sliced(batches):
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in spans(t, anchors)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, struct)], ["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, f"doc_id long, spans {SPANS}")


def listed(found: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_base_kinds(found: Column) -> Column:
    return F.filter(found, lambda s: s["kind"].isin(*BASE_KINDS))


def count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind))


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each span of personal data in the text replaced by <kind>; of overlapping spans the first counts."""

    @F.pandas_udf("string")
    def masked(texts):
        import pandas as pd

        anchors, out = automaton(), []
        for text in texts:
            if text is None:
                out.append(None)
                continue
            parts, at = [], 0
            for kind, a, b in spans(text, anchors):
                if a >= at:
                    parts += [text[at:a], f"<{kind}>"]
                    at = b
            out.append("".join([*parts, text[at:]]))
        return pd.Series(out, dtype=object)

    return docs.withColumn(text_col, masked(text_col))
