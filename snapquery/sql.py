"""SQL over one snapshot: Spark's parser, with checks and a normal form before it.

Statements are single SELECTs; the name after FROM stands for the snapshot, whatever it is.  Column
names are case-sensitive.  LIMIT and OFFSET come in either order.  Aggregates without an alias are
called ``FUNC_column``.
"""

from __future__ import annotations

import re
import uuid
from typing import TYPE_CHECKING

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame

from snapquery.errors import ColumnNotFound
from snapquery.operators.rows import known, quoted, shown

if TYPE_CHECKING:
    from snapquery.snapshot import Snapshot

QUOTED = re.compile(r"'(?:[^'\\]|''|\\.)*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", re.S)
FROM = re.compile(r"\bFROM\s+([A-Za-z_][\w.]*)", re.I)
TAIL = re.compile(r"\bOFFSET\s+(\d+)\s+LIMIT\s+(\d+)\s*$", re.I)
GROUP = re.compile(r"\bGROUP\s+BY\s+([A-Za-z_]\w*)\s*(?=$|\bHAVING\b|\bORDER\b|\bLIMIT\b|\bOFFSET\b)", re.I)
AGGREGATE = re.compile(r"^\s*(COUNT|SUM|AVG|MIN|MAX)\s*\(\s*(\*|[A-Za-z_]\w*)\s*\)\s*$", re.I)


def _masked(text: str) -> str:
    """Quoted parts and comments blanked, so that places stay."""
    return QUOTED.sub(lambda m: " " * len(m[0]) if m[0][0] in "-/" else "\0" * len(m[0]), text)


def _depth(masked: str, at: int) -> int:
    """Parentheses open at a place."""
    return masked.count("(", 0, at) - masked.count(")", 0, at)


def _items(text: str) -> list[str]:
    """Comma-separated items outside parentheses and quotes."""
    out, depth, start, masked = [], 0, 0, _masked(text)
    for i, ch in enumerate(masked):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]


def normal(text: str, columns: list[str], view: str, parity: bool = False) -> tuple[str, str | None]:
    """The statement for Spark, and the only grouping column, if there is one."""
    if not text or not text.strip():
        raise ValueError("the statement is empty")
    text = text.strip().rstrip(";").rstrip()
    masked = _masked(text)
    if not re.match(r"\s*SELECT\b", masked, re.I):
        raise ValueError("the statement must be a SELECT")
    if ";" in masked:
        raise ValueError("one statement at a time")
    origin = next((m for m in FROM.finditer(masked) if not _depth(masked, m.start())), None)  # not that of EXTRACT(.. FROM ..)
    if not origin:
        raise ValueError("the statement has no FROM")
    folded = {c.lower(): c for c in columns}
    for word in re.finditer(r"(?<![\w.])[A-Za-z_]\w*", masked):
        if word[0] not in columns and word[0].lower() in folded and word.span() != origin.span(1) and not re.match(r"\s*(\(|\0)", masked[word.end() :]) and not re.search(r"\bAS\s+$", masked[: word.start()], re.I):
            raise ColumnNotFound(f"no column {word[0]!r}; there is {folded[word[0].lower()]!r}")
    group = GROUP.search(masked)
    head = re.match(r"\s*SELECT\b(\s+DISTINCT\b)?", masked, re.I).end()
    listed = []
    for item in _items(text[head : origin.start()]):
        if m := AGGREGATE.match(item):
            call = f"{m[1]}({m[2]})"
            item = f" {f'COALESCE({call}, 0)' if parity and m[1].upper() == 'SUM' else call} AS `{m[1].upper()}_{m[2]}`"
        listed.append(item)
    rest = text[origin.end() :]
    if m := TAIL.search(_masked(rest)):
        rest = f"{rest[: m.start()]}LIMIT {m[2]} OFFSET {m[1]}"
    return f"{text[:head]}{','.join(listed)} FROM {view}{rest}", group[1] if group else None


def run(snapshot: Snapshot, text: str, parity: bool = False) -> DataFrame:
    """``parity`` drops null keys of a single grouping column and makes unnamed sums of nothing zero."""
    df = snapshot.query()._frame()
    view = f"snapshot_{uuid.uuid4().hex}"
    statement, key = normal(text, list(known(df)), view, parity)
    rows = shown(df).where(quoted(key).isNotNull()) if parity and key in known(df) else shown(df)
    rows.createOrReplaceTempView(view)
    try:
        return snapshot.spark.sql(statement)
    except ParseException as e:
        raise ValueError(str(e)) from e
    except AnalysisException as e:
        if "UNRESOLVED_COLUMN" in str(e):
            raise ColumnNotFound(str(e)) from e
        raise ValueError(str(e)) from e
    finally:
        snapshot.spark.catalog.dropTempView(view)


