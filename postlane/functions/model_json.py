"""The JSON value inside a scorer's raw answer."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from postlane.functions.text import or_blank

# Marks of a fenced block around an answer.
FENCE_OPEN = r"^```[a-zA-Z]*\s*\n"
FENCE_CLOSE = r"\n```\s*$"
# One token of JSON behind white space: a string, another scalar, or a mark.
TOKEN = re.compile(
    r'[ \t\n\r]*(?:("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")'
    r"|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)|([\[\]{},:]))"
)
OPENING = re.compile(r"[\[{]")
# What an open array or object waits for.
FIRST, MORE, NEXT, COLON, VALUE = range(5)


def _scan(body: str, at: int, ends: dict[int, int], dead: set[int]) -> None:
    """Read from an opening bracket as far as JSON goes, with a stack of open brackets.

    Every bracket that was closed on the way gets its end; those still open are dead, as
    their values would have to go on in the same way.
    """
    stack: list[list] = []  # place of the bracket, whether an object, what it waits for, its keys
    while token := TOKEN.match(body, at):
        at = token.end()
        top = stack[-1] if stack else None
        takes_value = top is None or (top[2] == VALUE if top[1] else top[2] in (FIRST, NEXT))
        mark = token[3]
        if mark in ("[", "{"):
            if not takes_value:
                break
            stack.append([at - 1, mark == "{", FIRST, set()])
        elif mark in ("]", "}"):
            if top[1] != (mark == "}") or top[2] not in (FIRST, MORE):
                break
            ends[stack.pop()[0]] = at
            if not stack:
                return
            stack[-1][2] = MORE
        elif mark == "," and top[2] == MORE:
            top[2] = NEXT
        elif mark == ":" and top[2] == COLON:
            top[2] = VALUE
        elif mark:
            break
        elif takes_value:
            top[2] = MORE
        elif token[1] and top[1] and top[2] in (FIRST, NEXT) and token[1] not in top[3]:
            top[3].add(token[1])
            top[2] = COLON
        else:
            break
    dead.update(frame[0] for frame in stack)


def first_value(body: str) -> str | None:
    """The first array or object that begins at some bracket of the text, as it stands there.

    A reader starts at a bracket and stops where no JSON value could go on, in prose at
    once. What it finds out about the brackets that it has passed as values is kept, so
    nested brackets are not read again; no text is copied but the value. Objects with a
    repeated key are no values.
    """
    ends: dict[int, int] = {}
    dead: set[int] = set()
    for opening in OPENING.finditer(body):
        start = opening.start()
        if start not in ends and start not in dead:
            _scan(body, start, ends, dead)
        if start in ends:
            return body[start : ends[start]]
    return None


@F.pandas_udf(StringType())
def _buried(bodies: pd.Series) -> pd.Series:
    return bodies.map(first_value, na_action="ignore")


def model_json(raw: Column) -> Column:
    """JSON text of the answer's first array or object that parses, NULL if it holds none.

    Fences are dropped. An answer that starts with its value, as nearly all do, is read at
    once, whatever follows the value; the parser stops behind it. Other answers with a
    bracket, and only they, go through an Arrow batch UDF that looks for the value.
    """
    text = or_blank(raw)
    unfenced = F.regexp_replace(F.regexp_replace(text, FENCE_OPEN, ""), FENCE_CLOSE, "")
    body = F.ltrim(F.when(text.startswith("```"), unfenced).otherwise(text))
    starts = body.rlike(r"^[\[{]")
    some = F.contains(body, F.lit("{")) | F.contains(body, F.lit("["))
    leads = starts & F.try_parse_json(body).isNotNull()
    found = _buried(F.when(some & ~leads, body))
    return F.get_json_object(F.coalesce(found, F.when(starts, body)), "$")
