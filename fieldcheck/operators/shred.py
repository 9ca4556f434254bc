"""Deeply nested records into related flat tables.

Each record is read token by token into path-value-ordinal triples, without building its tree; the triples are grouped by their nearest repeated
ancestor, and each group is pivoted into one table whose rows name their parent by its ordinals.
All triples of a record come from one record, so grouping needs no shuffle.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Triple = tuple[str, tuple[int, ...], str | None, str | None]


#: A token of JSON: a mark, a string, a number, or a word; and a whole array of numbers and nulls, the bulk of most records.
TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)|(true|false|null))')
NUMBERS = re.compile(r"[-+0-9.eE,nul \t\n\r]*\]")
BLANK = re.compile(r"[ \t\n\r]*")


def triples(text: str, repeated: frozenset[str], heads: frozenset[str] = frozenset()) -> Iterator[Triple]:
    """(repeated ancestor, ordinals, leaf name, value) of everything in a JSON object, in the order of the text; ValueError where it isn't one.

    An item of an array yields a marker without leaf name, so that empty items are kept. Scalars in arrays belong
    to the ancestor ``<path>#``, in which parallel arrays of one parent meet by position; an array in an array is a repeated ancestor of its own, ``<path>[][]``. A key named in
    ``repeated`` is an array of one if it holds an object. Objects named in ``heads`` at the top belong to the record itself.
    Only the open containers are held, whatever the depth.
    """
    token, numbers, at = TOKEN.match, NUMBERS.match, 0
    # Open containers: (True, path, ordinals, prefix of leaf names) for objects, [False, path, ordinals, key, path of items, next ordinal] for arrays.
    stack: list = []
    key, want = "", "value"  # what may come: value, first (value or end), key, begin (key or end), colon, next (comma or end)
    while True:
        m = token(text, at)
        if m is None:
            raise ValueError("no JSON")
        at, kind = m.end(), m.lastindex
        mark = m.group(1) if kind == 1 else ""
        if want == "colon":
            if mark != ":":
                raise ValueError("no colon")
            want = "value"
            continue
        if want in ("key", "begin") and kind == 2:
            key = m.group(2)
            key = json.loads(key) if "\\" in key else key[1:-1]
            want = "colon"
            continue
        if mark in ("}", "]") and mark:
            if want not in ("next", "begin" if mark == "}" else "first") or stack[-1][0] != (mark == "}"):
                raise ValueError("unexpected end")
            stack.pop()
            if not stack:
                break
            want = "next"
            continue
        if want == "next":
            if mark != ",":
                raise ValueError("no comma")
            want = "key" if stack[-1][0] else "value"
            continue
        if want not in ("value", "first") or mark in (",", ":") and mark:
            raise ValueError("unexpected token")
        top = stack[-1] if stack else None
        if top is None:
            if mark != "{":
                raise ValueError("no object")
            stack.append((True, "", (), ""))
            want = "begin"
            continue
        if top[0]:
            _, path, ordinals, prefix = top
            name, inner, items = key, (f"{path}.{key}[]" if path else f"{key}[]"), ordinals
            single = key in repeated
        else:
            _, path, up, name, inner, i = top
            top[5] = i + 1
            items, prefix, single = (*up, i), "", True
        if mark == "{":
            if top[0] and len(stack) == 1 and key in heads:
                stack.append((True, path, ordinals, ""))
            elif single:
                where = (*items, 0) if top[0] else items
                yield inner, where, None, None
                stack.append((True, inner, where, ""))
            else:
                stack.append((True, path, ordinals, f"{prefix}{key}."))
            want = "begin"
            continue
        if mark == "[":
            base, below = (path, inner) if top[0] else (inner, inner + "[]")
            n = numbers(text, at)
            if n:
                values = json.loads(text[at - 1 : n.end()])
                for i, v in enumerate(values):
                    if v is not None or name not in repeated:
                        yield f"{base}#", (*items, i), name, None if v is None else str(v)
                at, want = n.end(), "next"
            else:
                stack.append([False, base, items, name, below, 0])
                want = "first"
            continue
        value = m.group(kind)
        if kind == 2:
            value = json.loads(value) if "\\" in value else value[1:-1]
        elif value == "null":
            value = None
        if top[0]:
            yield path, ordinals, prefix + key, value
        elif value is not None or name not in repeated:
            yield f"{path}#", items, name, value
        want = "next"
    if BLANK.match(text, at).end() != len(text):
        raise ValueError("more than one value")


def shred(df: DataFrame, record: str, payload: str, repeated: tuple[str, ...] = (), heads: tuple[str, ...] = ()) -> DataFrame:
    """Rows ``record_id, ancestor, ordinals array<int>, leaves map<string,string>``, one for each item of each repeated path.

    ``payload`` is JSON text. ``heads`` names top-level objects whose content belongs to the record itself. The
    record's own leaves have the ancestor ''. Null, blank, cut or otherwise unreadable payloads and payloads that
    aren't objects give no row; an object without leaves gives one record row without leaves. The number of items is what is there, not what
    any count says. Of a key that comes twice in one object the last value holds. Memory is bounded by one batch of records.
    """
    rep, top = frozenset(repeated), frozenset(heads)
    kind = pa.schema([("record_id", pa.int64()), ("ancestor", pa.string()), ("ordinals", pa.list_(pa.int32())), ("leaves", pa.map_(pa.string(), pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for begin in range(0, len(ids), 500):
                out: tuple[list, list, list, list, list, list, list] = ([], [], [0], [], [0], [], [])
                rid, anc, o_off, o_val, m_off, m_key, m_val = out
                for i, text in zip(ids[begin : begin + 500], texts.slice(begin, 500).to_pylist(), strict=True):
                    if not text:
                        continue
                    rows: dict[tuple[str, tuple[int, ...]], dict[str, str | None]] = {("", ()): {}}
                    try:
                        for a, o, name, value in triples(text, rep, top):
                            row = rows.setdefault((a, o), {})
                            if name is not None:
                                row[name] = value
                    except ValueError:
                        continue
                    for (a, o), row in rows.items():
                        rid.append(i)
                        anc.append(a)
                        o_val.extend(o)
                        o_off.append(len(o_val))
                        m_key.extend(row)
                        m_val.extend(row.values())
                        m_off.append(len(m_key))
                lists = pa.ListArray.from_arrays(pa.array(o_off, pa.int32()), pa.array(o_val, pa.int32()))
                maps = pa.MapArray.from_arrays(pa.array(m_off, pa.int32()), pa.array(m_key, pa.string()), pa.array(m_val, pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(anc, pa.string()), lists, maps], schema=kind)

    return df.select(F.col(record).cast("long"), F.col(payload).cast("string")).mapInArrow(run, "record_id long, ancestor string, ordinals array<int>, leaves map<string,string>")


def pivoted(shredded: DataFrame, ancestors: list[str], names: list[str], columns: dict[str, str]) -> DataFrame:
    """One table of the shredded rows of some ancestors: ``record_id``, a column of ``names`` for each ordinal, and typed leaves.

    ``columns``: leaf name to Spark type; text that isn't of the type and missing leaves are null.
    """
    return shredded.where(F.col("ancestor").isin(ancestors)).select(
        "record_id", *(F.get("ordinals", F.lit(i)).alias(n) for i, n in enumerate(names)), *(F.col("leaves")[c].try_cast(t).alias(c) for c, t in columns.items())
    )


def any_leaf(names: list[str]) -> Column:
    """True if a shredded row has any of the leaves."""
    return F.exists(F.map_keys("leaves"), lambda k: k.isin(names))
