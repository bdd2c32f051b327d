"""Several values packed in one field.

A finite-state tokenizer walks the field once. Outside quotes letters, digits
and ``. _ + - ' @`` make up values and everything else separates; quoted text
is taken whole, a doubled quote inside stands for one, and the nesting depth of
brackets tells whether one pair encloses the whole field.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from gregaria.sources.workers import on_workers

# The signs that belong to values, and the brackets.
PLAIN = re.compile(r"(?:[^\W]|[.+\-'@])+")
SPACE = re.compile(r"\s*")
QUOTED = {'"': re.compile(r'"((?:[^"]|"")*)"(?!")'), "'": re.compile(r"'((?:[^']|'')*)'(?!')")}
CLOSING = {"[": "]", "(": ")", "{": "}", "<": ">"}


def _unwrapped(field: str) -> str:
    """Without white space around and brackets that enclose the whole field, any number of pairs."""
    field = field.strip()
    while len(field) > 1 and CLOSING.get(field[0]) == field[-1]:
        depth, at, opened, closed = 0, 0, field[0], field[-1]
        while at < len(field):
            sign = field[at]
            if sign in QUOTED and (m := QUOTED[sign].match(field, at)) and not (sign == "'" and at and PLAIN.match(field[at - 1])):
                at = m.end()
                continue
            depth += (sign == opened) - (sign == closed)
            at += 1
            if not depth:
                break
        if at < len(field) or depth:
            return field
        field = field[1:-1].strip()
    return field


def split_packed(field: str | None) -> list[tuple[int, str]]:
    """Positions (from 1) and values of a packed field.

    White space around the whole field, and inside brackets around it, is no
    separator. A run of white space elsewhere is one and joins a separator beside it.
    Between two separators, before a leading and after a trailing one lies an
    empty value, which takes a position but is not returned. Quotes around a
    whole value are dropped, around a part of one they stay; a quote without
    its partner separates if double and is an ordinary sign if single. Null,
    empty and blank fields, and fields of separators only, give no value.
    """
    if not field:
        return []
    if PLAIN.fullmatch(field) and field[0] != "'":
        return [(1, field)]
    field = _unwrapped(field)
    out: list[tuple[int, str]] = []
    at, end, pos = 0, len(field), 1
    while at < end:
        # state: at the start of a value
        start, value = at, None
        sign = field[at]
        if sign in QUOTED and (m := QUOTED[sign].match(field, at)):
            after = m.end()
            if after == end or not (PLAIN.match(field, after) or field[after] in QUOTED):
                value, at = m[1].replace(sign * 2, sign), after
        if value is None:
            # state: inside a value, of plain signs and quoted parts
            while at < end:
                sign = field[at]
                m = QUOTED[sign].match(field, at) if sign in QUOTED else None
                if m and (sign == '"' or field[m.end() : m.end() + 1] == "@" and at == start):
                    at = m.end()
                elif m := PLAIN.match(field, at):
                    text = m[0]
                    # a single quote that opens a quoted part is met at the start only, so a run of signs is taken whole
                    at += len(text)
                else:
                    break
            value = field[start:at]
        if value:
            out.append((pos, value))
        # state: between values
        if at < end:
            at = SPACE.match(field, at).end()
            if at < end and not _opens_value(field, at):
                at = SPACE.match(field, at + 1).end()
            pos += 1
    return out


def _opens_value(field: str, at: int) -> bool:
    sign = field[at]
    return bool(PLAIN.match(field, at)) or sign == '"' and bool(QUOTED[sign].match(field, at))


def unpack_fields(records: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row for each value in ``fields``: ``key, field_name, pos, item``.

    Other columns of ``records`` are not read. Work is done batch by batch on
    Arrow columns without a shuffle; a batch holds as many rows as Spark hands
    over, so memory does not grow with the table.
    """
    kind = records.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            names: list[str] = []
            positions: list[int] = []
            items: list[str] = []
            for name in fields:
                for row, field in enumerate(batch.column(name).to_pylist()):
                    for pos, item in split_packed(field):
                        at.append(row)
                        names.append(name)
                        positions.append(pos)
                        items.append(item)
            keys = batch.column(key).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(names, pa.string()), pa.array(positions, pa.int64()), pa.array(items, pa.string())],
                names=[key, "field_name", "pos", "item"],
            )

    return on_workers(records.select(key, *fields)).mapInArrow(run, f"`{key}` {kind}, field_name string, pos bigint, item string")
