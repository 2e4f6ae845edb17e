"""Conditions on morphemes, compiled from text to columns.

Blanks separate alternatives, commas what must hold together; ! negates; parentheses group; attr:val holds if the blank-separated
list attr has val; attr:null if it has none; attr:Xother if it has the value of the attribute other. cp(id) and cf(id) stand for the condition that another
morpheme sets for what comes before or after it. A plus joins the steps of a sequence and lets every order through, as nothing is known of
the other steps where a condition is tested.

Of a compound, a condition may hold for its last part instead: columns of that part stand beside those of the whole, with a prefix.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(c[pf])\(([^()]*)\)|([(),!+])|([A-Za-z_][A-Za-z0-9_]*):([^\s(),!+]+))|(\s+)")


class ConditionError(ValueError):
    """The text isn't a condition."""


def compiled(text: str, attributes: Sequence[str], others: Mapping[str, str] | None = None, last_part: str | None = None) -> Column:
    """The condition as a column that is never null. An empty text always holds; attributes are the columns that it may name. others has the conditions of
    other morphemes by kind and id, such as "cp abc/1v". With last_part, the prefix of the last part's columns, a condition that fails for a whole
    may hold for its last part, if there is one (the column prefix + id isn't null).
    """
    out = _compiled(text, attributes, others or {}, "", frozenset())
    if last_part is None:
        return out
    return out | F.col(f"{last_part}id").isNotNull() & _compiled(text, attributes, others or {}, last_part, frozenset())


def _compiled(text: str, attributes: Sequence[str], others: Mapping[str, str], prefix: str, seen: frozenset[str]) -> Column:
    tokens = _tokens(text)
    if not tokens:
        return F.lit(True)
    if "+" in tokens:
        return F.lit(True)
    resolved = []
    for t in tokens:
        if isinstance(t, tuple) and t[0] in ("cp", "cf") and len(t) == 3:
            name = f"{t[0]} {t[1]}"
            if name in seen:
                raise ConditionError(f"{name} refers to itself")
            if name not in others:
                raise ConditionError(f"no condition {name}")
            resolved.append(("=", _compiled(others[name], attributes, others, prefix, seen | {name})))
        else:
            resolved.append((t[0], t[1], prefix) if isinstance(t, tuple) else t)
    out, rest = _either(resolved, attributes)
    if rest:
        raise ConditionError(f"unexpected {rest[0]!r} in {text!r}")
    return out


def _tokens(text: str) -> list:
    out, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise ConditionError(f"can't read {text[at:]!r}")
        blank = text[at].isspace()
        if blank and out and out[-1] not in ("(", ",", "!", "|", "+") and (m[4] or m[1] or m[3] in ("(", "!")):
            out.append("|")
        if m[1]:
            out.append((m[1], m[2].strip(), None))
        elif m[3]:
            out.append(m[3])
        elif m[4]:
            out.append((m[4], m[5]))
        at = m.end()
    return out


def _either(tokens: list, attributes: Sequence[str]) -> tuple[Column, list]:
    out, rest = _both(tokens, attributes)
    while rest and rest[0] == "|":
        more, rest = _both(rest[1:], attributes)
        out = out | more
    return out, rest


def _both(tokens: list, attributes: Sequence[str]) -> tuple[Column, list]:
    out, rest = _one(tokens, attributes)
    while rest and rest[0] == ",":
        more, rest = _one(rest[1:], attributes)
        out = out & more
    return out, rest


def _one(tokens: list, attributes: Sequence[str]) -> tuple[Column, list]:
    if not tokens:
        raise ConditionError("a condition is missing")
    head, rest = tokens[0], tokens[1:]
    if head == "!":
        out, rest = _one(rest, attributes)
        return ~out, rest
    if head == "(":
        out, rest = _either(rest, attributes)
        if not rest or rest[0] != ")":
            raise ConditionError("a parenthesis isn't closed")
        return out, rest[1:]
    if not isinstance(head, tuple):
        raise ConditionError(f"unexpected {head!r}")
    if head[0] == "=":
        return head[1], rest
    name, value, prefix = head
    if name not in attributes:
        raise ConditionError(f"no attribute {name}")
    column = F.col(prefix + name)
    if value == "null":
        return column.isNull(), rest
    wanted = F.col(prefix + value[1:]) if value[0] == "X" and value[1:] in attributes else F.lit(value)
    return F.coalesce(F.array_contains(F.split(column, " "), wanted), F.lit(False)), rest
