"""Several values packed in one field: a parsing expression grammar with ordered alternatives.

    field     <- blanks open list close blanks END / list END
    list      <- slot (divider slot)*
    slot      <- blanks (quoted / bracketed / bare) blanks / blanks
    quoted    <- '"' (doubled '"' / '\\' any / other)* '"' &(blanks (divider / END))    and the same with "'"
    bracketed <- open (bracketed / any)* close &(blanks (divider / END))    where asked for; inside, nothing divides
    bare      <- (!divider any)+
    divider   <- ',' / ';' / '|' / TAB / CR LF / LF / CR / (after a value) blanks &(mark)

A quoted or bracketed value that isn't closed before a divider or the end makes the parser back up and read the slot as bare, with an
error flag. Each alternative is one compiled pattern, so a field costs time in proportion to its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "[({<", "])}>"
OK, UNCLOSED_QUOTE, UNCLOSED_BRACKET, STRAY_QUOTE = "", "unclosed quote", "unclosed bracket", "stray quote"


class Grammar:
    """Patterns for one choice of dividers; ``mark`` is the letter that begins a value after bare blanks.

    With ``brackets`` a value in brackets is one value, brackets included, whatever divides inside.
    """

    def __init__(self, dividers: str = ",;|\t\r\n", mark: str = "@", brackets: bool = False) -> None:
        self.brackets = brackets
        d, m = re.escape(dividers), re.escape(mark)
        start = f"""(?:[{m}]|["'][{m}])""" if mark else "(?!)"
        ahead = rf"(?= *(?:[{d}]|\Z)| +{start})"
        self.ahead = re.compile(ahead)
        self.quoted = {q: re.compile(rf"{q}((?:[^{q}\\]|{q}{q}|\\.)*+){q}{ahead}|{q}((?:[^{q}\\]|{q}{q}|\\.)*?){q}{ahead}", re.S) for q in "\"'"}
        self.bare = re.compile(rf"(?:[^{d} ]++| ++(?!{start}))+")
        self.between = re.compile(rf" +(?={start})")
        self.divider = re.compile(rf"\r\n|[{d}]" if "\r" in dividers and "\n" in dividers else rf"[{d}]")
        self.blanks = re.compile(" *")
        self.escaped = {q: re.compile(rf"{q}({q})|\\(.)", re.S) for q in "\"'"}

    def slots(self, text: str) -> Iterator[tuple[str, str]]:
        """Value and error flag of every slot, empty slots included; nothing for an empty field."""
        body, flag = self.unwrap(text)
        if not body.strip(" "):
            return
        at, end = 0, len(body)
        closes = self.partners(body) if self.brackets else {}
        while True:
            at = self.blanks.match(body, at).end()
            value, error, filled = "", flag, False
            if at < end:
                c = body[at]
                found = self.quoted[c].match(body, at) if c in self.quoted else None
                if found:
                    inner = found[1] if found[1] is not None else found[2]
                    value = self.escaped[c].sub(lambda m: m[1] or m[2], inner) if c in inner or "\\" in inner else inner
                    at, filled = found.end(), True
                elif at in closes and self.ahead.match(body, closes[at] + 1):
                    value, at, filled = body[at : closes[at] + 1], closes[at] + 1, True
                elif found := self.bare.match(body, at):
                    value = found[0].rstrip(" ")
                    at, filled = found.end(), True
                    if c in self.quoted:
                        error = UNCLOSED_QUOTE if value.count(c) == 1 else STRAY_QUOTE
                    elif self.brackets and c in OPEN and at - len(found[0]) not in closes:
                        error = UNCLOSED_BRACKET
            yield value, error
            if filled and (gap := self.between.match(body, at)):
                at = gap.end()
                continue
            at = self.blanks.match(body, at).end()
            if at >= end:
                return
            at = self.divider.match(body, at).end()

    def partners(self, body: str) -> dict[int, int]:
        """Where each bracket that is closed is closed; a bracket of another kind in between stays open."""
        out, open_ = {}, []
        for i, c in enumerate(body):
            if c in OPEN:
                open_.append(i)
            elif c in CLOSE:
                for k in range(len(open_) - 1, max(-1, len(open_) - 17), -1):
                    if OPEN.index(body[open_[k]]) == CLOSE.index(c):
                        out[open_[k]] = i
                        del open_[k:]
                        break
        return out

    def unwrap(self, text: str) -> tuple[str, str]:
        body = text.strip(" ")
        if body[:1] in OPEN and body:
            if body[-1] == CLOSE[OPEN.index(body[0])] and len(body) > 1:
                return body[1:-1], OK
            return text, UNCLOSED_BRACKET
        return text, OK


def split_batches(batches: Iterable[pa.RecordBatch], grammar: Grammar) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.string()]
    for batch in batches:
        rows = [(rid, n, value, error) for rid, text in zip(batch.column("rid").to_pylist(), batch.column("text").to_pylist()) for n, (value, error) in enumerate(grammar.slots(text), 1)]
        for i in range(0, len(rows), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows[i : i + (1 << 16)]), kinds)], ["rid", "slot", "value", "error"])


def split_packed(df: DataFrame, rid: str, text: str, dividers: str = ",;|\t\r\n", mark: str = "@", brackets: bool = False) -> DataFrame:
    """One row per slot of the packed field: ``rid``, ``slot`` from 1, ``value`` ('' if empty), ``error`` ('' if none).

    Null ids, null fields and fields of blanks give no rows. A row is parsed on its own, whatever its length; nothing
    is shuffled. Brackets count around the whole field, if both are there, and with ``brackets`` also around a value (looking up to 16
    unclosed brackets back for a partner).
    """
    rows = df.where(F.col(rid).isNotNull() & F.col(text).isNotNull()).select(F.col(rid).cast("bigint").alias("rid"), F.col(text).alias("text"))
    return rows.mapInArrow(lambda it: split_batches(it, Grammar(dividers, mark, brackets)), "rid bigint, slot int, value string, error string")
