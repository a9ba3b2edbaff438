"""Several values packed in one field: a parsing expression grammar, one row per value with its position.

    field    <- list end
    list     <- (marks / separator / value)*
    value    <- quoted &stop / group &stop / bare      ordered: where a quote or bracket doesn't close, the parser goes back
    quoted   <- Q (Q Q / '\\' any / !Q any)* Q          Q: " or ', or “ closed by ”
    group    <- open list close                        open and close: [ ] or { } or ( )
    bare     <- (held / !separator any)+ tail?
    held     <- open any* close                        separators in a bracket inside a value are part of it
    tail     <- blank open ('and' / 'or') blank list close     as in 'CS 115 (or CS 135)'
    stop     <- separator / close / end
    separator<- [,;；|/&+•\n\r\t] / blank 'and' blank / blank 'or' blank
    marks    <- a bullet - * • at the start of a line

The alternatives are tried in order at each place. A quote that never closes, or is followed by more than blanks before the
next stop, is read again as part of a bare value and sets the error flag, as does a bracket without its partner. What a failed
quote has shown about the places behind it is kept, so a field takes time in proportion to its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters that separate values, pairs that enclose a list, and pairs that quote a value.
SEPARATORS = ",;；|/&+•\n\r\t"
BRACKETS = {"[": "]", "{": "}", "(": ")"}
QUOTES = {'"': '"', "'": "'", "“": "”"}
_CLOSING = set(BRACKETS.values())

_WORD = re.compile(r"\s(?:and|or)(?=\s)", re.IGNORECASE)
_JOINED = re.compile(r"\s*(?:and|or)\s", re.IGNORECASE)
_BULLET = re.compile(r"\s*[-*•](?=\s)\s*")
_CODE = re.compile(r"([A-Za-z]{2,6})\s*(\d{3}[A-Za-z]*)\s*\Z")
_NUMBER = re.compile(r"\d{3}[A-Za-z]*\Z")
_BLANKS = re.compile(r"[^\S\n\r\t]*")


def _separator(text: str, at: int, end: int) -> int:
    """Where the separator at this place ends, or -1 if there is none."""
    if text[at] in SEPARATORS:
        return at + 1
    word = _WORD.match(text, at, end) if text[at].isspace() else None
    return word.end() if word else -1


def _quoted(text: str, at: int, end: int, lost: set[tuple[str, int]]) -> tuple[str, int] | None:
    """The value quoted from here and the place behind it; None if the quote doesn't close before a stop.

    lost: (quote, place) pairs from which no quote of the kind closes; what is read in vain is added.
    """
    quote = text[at]
    close = QUOTES[quote]
    twice = close == quote
    out: list[str] = []
    i = at + 1
    while i < end and (quote, i) not in lost:
        c = text[i]
        if c == "\\" and i + 1 < end and text[i + 1] in (close, quote, "\\"):
            out.append(text[i + 1])
            i += 2
        elif c == close:
            if twice and i + 1 < end and text[i + 1] == close:
                out.append(c)
                i += 2
            elif _stops(text, i + 1, end):
                return "".join(out), i + 1
            elif not twice or close == '"':
                return None
            else:
                out.append(c)
                i += 1
        else:
            out.append(c)
            i += 1
    lost.update((quote, j) for j in range(at + 1, min(i, end)))
    return None


def _stops(text: str, at: int, end: int) -> bool:
    """Whether only blanks lie between this place and a separator, a closing bracket or the end."""
    if at >= end:
        return True
    if _separator(text, at, end) >= 0:
        return True
    i = _BLANKS.match(text, at, end).end()
    return i >= end or text[i] in SEPARATORS or text[i] in _CLOSING


def _partners(text: str, at: int, end: int, lost: set[tuple[str, int]]) -> dict[int, int]:
    """The place of the closing bracket of each opening one that has one; brackets inside quoted values are none."""
    found: dict[int, int] = {}
    open_: list[int] = []
    i = at
    while i < end:
        c = text[i]
        if c in QUOTES and (i == at or text[i - 1].isspace() or text[i - 1] in SEPARATORS or text[i - 1] in BRACKETS):
            if got := _quoted(text, i, end, lost):
                i = got[1]
                continue
        elif c in BRACKETS:
            open_.append(i)
        elif c in _CLOSING and open_ and BRACKETS[text[open_[-1]]] == c:
            found[open_.pop()] = i
        i += 1
    return found


def _list(text: str, at: int, end: int) -> list[tuple[str, bool]]:
    """(value, malformed) of each value from here to end."""
    values: list[tuple[str, bool]] = []
    lost: set[tuple[str, int]] = set()
    partner = _partners(text, at, end, lost) if any(c in BRACKETS for c in text) else {}
    paired = partner.keys() | set(partner.values())
    closing: set[int] = set()
    line_start = True
    while at < end:
        if line_start and (bullet := _BULLET.match(text, at, end)):
            at = bullet.end()
            line_start = False
            continue
        c = text[at]
        past = _separator(text, at, end)
        if past >= 0:
            line_start = c in "\n\r"
            at = past
            continue
        if c.isspace() or at in closing:
            at += 1
            continue
        if at in partner and _stops(text, partner[at] + 1, end):
            closing.add(partner[at])
            line_start = True
            at += 1
            continue
        line_start = False
        bad = c in QUOTES
        if bad and (got := _quoted(text, at, end, lost)):
            values.append((got[0], False))
            at = got[1]
            continue
        i = at
        while i < end and i not in closing and _separator(text, i, end) < 0:
            if i in partner:
                if i > at and (word := _JOINED.match(text, i + 1, partner[i])) and _stops(text, partner[i] + 1, end):
                    closing.add(partner[i])
                    break
                i = partner[i] + 1
                continue
            bad |= (text[i] in BRACKETS or text[i] in _CLOSING) and i not in paired
            i += 1
        values.append((text[at:i], bad))
        at = word.end() if i in partner else i
    return values


def parse_field(text: str | None) -> list[tuple[str, bool]]:
    """(item, malformed) of each value packed in the text, in order; none for null, empty and blank texts."""
    if text is None:
        return []
    at, end = len(text) - len(text.lstrip()), len(text.rstrip())
    if at >= end:
        return []
    out: list[tuple[str, bool]] = []
    subject = ""
    for value, bad in _list(text, at, end):
        value = value.strip()
        if not value:
            continue
        if m := _CODE.match(value):
            subject = m[1].upper()
            code = subject + m[2].upper()
            out.append(("MSE" + code[4:] if code.startswith("MSCI") else code, bad))
        elif subject and _NUMBER.match(value):
            code = subject + value.upper()
            out.append(("MSE" + code[4:] if code.startswith("MSCI") else code, bad))
        else:
            out.append((value, bad))
    return out


def split_packed(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field_name, pos, item, malformed): one row per value packed in the named string columns.

    pos counts the values of a field from 1; empty values take none. Null, empty and blank fields give no rows, equal rows of
    df count once, columns not named are ignored. A row is read whole, by one Arrow batch, without a shuffle of its values.
    """
    rows = df.select(F.col(key).cast("bigint").alias("key"), *fields).distinct()
    names = list(fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, where, pos, items, flags = [], [], [], [], []
            for name in names:
                for key_, text in zip(batch["key"], batch[name]):
                    for n, (item, bad) in enumerate(parse_field(text if isinstance(text, str) else None), 1):
                        keys.append(key_)
                        where.append(name)
                        pos.append(n)
                        items.append(item)
                        flags.append(bad)
            yield pd.DataFrame({"key": keys, "field_name": where, "pos": pos, "item": items, "malformed": flags})

    return rows.mapInPandas(run, "key bigint, field_name string, pos int, item string, malformed boolean")
