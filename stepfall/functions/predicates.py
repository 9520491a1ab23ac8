"""Checks on cohort predicates, which arrive as untrusted text.

Two ways in: :func:`checked_predicate` vets one text, and the column expressions below turn a whole table
of flat texts into clause rows inside Spark (``normal_form`` does so for all other texts).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from stepfall.constants import REFUSED_SUBSTRINGS, TEXT_ATTRIBUTES, USER_ATTRIBUTES

_TOKEN = re.compile(
    r"\s*('(?:[^']|'')*'|[A-Za-z_]\w*|\d+(?:\.\d+)?|<>|!=|<=|>=|==|[=<>(),])")
_WORDS = {"AND", "OR", "NOT", "IN", "BETWEEN", "IS", "NULL", "LIKE", "TRUE", "FALSE"}
_COMPARE = {"=", "==", "<>", "!=", "<", "<=", ">", ">="}


def column_kind(name: str) -> str:
    if name == "device_age_months":
        return "number"
    return "flag" if name in ("is_returning", "is_crash") else "text"


def tokens_of(text: str) -> list[str] | None:
    out, at, text = [], 0, text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            return None
        out.append(m.group(1))
        at = m.end()
    return out


def _literal_for(kind: str, token: str) -> str | None:
    """SQL literal of ``token`` fit for a column of ``kind``; None when it cannot be one."""
    quoted = token.startswith("'")
    body = token[1:-1].replace("''", "'") if quoted else token
    if kind == "text":
        return "'" + body.replace("\\", "\\\\").replace("'", "\\'") + "'" if quoted else None
    if kind == "number":
        return body.strip() if re.fullmatch(r"\s*-?\d+(\.\d+)?\s*", body) else None
    return {"true": "TRUE", "1": "TRUE", "false": "FALSE", "0": "FALSE"}.get(body.lower())


def checked_predicate(text: str | None, columns=USER_ATTRIBUTES) -> str | None:
    """Rewrite ``text`` as Spark SQL over ``columns``, or None when it is not acceptable.

    Only listed columns, literals that fit the column they are compared with, comparison and
    boolean words pass.  Function calls, subqueries, double quotes and unknown names do not.
    """
    if not text or not text.strip():
        return None
    if any(bad in text.lower() for bad in REFUSED_SUBSTRINGS):
        return None
    tokens = tokens_of(text)
    if not tokens:
        return None

    depth = 0
    for token in tokens:
        depth += (token == "(") - (token == ")")
        if depth < 0:
            return None
    if depth:
        return None

    known = {c.lower(): c for c in columns}
    out: list[str] = []
    kind = None                    # kind of the column last named
    for i, token in enumerate(tokens):
        upper, after = token.upper(), tokens[i + 1] if i + 1 < len(tokens) else ""
        if token[0].isalpha() or token[0] == "_":
            if token.lower() in known:
                if after == "(":
                    return None
                kind = column_kind(known[token.lower()])
                out.append("`" + known[token.lower()] + "`")
            elif upper in ("TRUE", "FALSE") and i and tokens[i - 1] in _COMPARE | {"(", ","}:
                if kind != "flag":
                    return None
                out.append(upper)
            elif upper in _WORDS:
                if after == "(" and upper not in ("IN", "AND", "OR", "NOT"):
                    return None
                out.append(upper)
            else:
                return None
        elif token[0] == "'" or token[0].isdigit():
            near = kind
            if after in _COMPARE:          # literal on the left of its column
                right = tokens[i + 2].lower() if i + 2 < len(tokens) else ""
                near = column_kind(known[right]) if right in known else None
            fitted = _literal_for(near, token) if near else None
            if fitted is None:
                return None
            out.append(fitted)
        else:
            out.append(token)
    return "(" + " ".join(out) + ")"


# --- the same vetting as column expressions, for many predicates at once ---------------

_LITERAL = r"(?:'(?:[^']|'')*'|\d+(?:\.\d+)?|TRUE|FALSE)"
_LIST = rf"\(\s*{_LITERAL}(?:\s*,\s*{_LITERAL})*\s*\)"
_NAME = "(?:" + "|".join(USER_ATTRIBUTES) + ")"
_CLAUSE = rf"{_NAME}\s*(?:(?:==|=|<>|!=|<=|>=|<|>)\s*{_LITERAL}|IN\s*{_LIST})"
FLAT = rf"(?i)^\s*{_CLAUSE}(?:\s+(?:AND|OR)\s+{_CLAUSE})*\s*$"
PIECES = (rf"(?i)(?:\s+(AND|OR)\s+|^\s*)({_NAME})\s*"
          rf"(?:(==|=|<>|!=|<=|>=|<|>)\s*({_LITERAL})|(IN)\s*({_LIST}))")
LITERALS = rf"(?i){_LITERAL}"
OP_NAMES = {"=": "eq", "==": "eq", "<>": "ne", "!=": "ne", "<": "lt", "<=": "le", ">": "gt", ">=": "ge"}


def is_refused(text: Column) -> Column:
    """True for a blank text or one that holds a refused substring."""
    low = F.lower(text)
    bad = F.trim(F.coalesce(text, F.lit(""))) == ""
    for piece in REFUSED_SUBSTRINGS:
        bad = bad | F.contains(low, F.lit(piece))
    return bad


def is_flat(text: Column) -> Column:
    """True when the text is comparisons joined by AND / OR, without grouping or NOT."""
    return text.rlike(FLAT)


def flat_pieces(text: Column) -> Column:
    """``array<struct<disjunct_id, column, op, raw>>`` of a flat text.

    AND binds tighter than OR, so a flat text already is a disjunction of conjunctions and
    the disjunct number is the count of ORs so far.
    """
    def part(group: int) -> Column:
        return F.regexp_extract_all(text, F.lit(PIECES), F.lit(group))

    joins, ops, ins = part(1), part(3), part(5)

    def piece(name: Column, i: Column) -> Column:
        before = F.slice(joins, F.lit(1), i + 1)
        at = i + 1
        return F.struct(
            F.size(F.filter(before, lambda j: F.upper(j) == "OR")).alias("disjunct_id"),
            F.lower(name).alias("column"),
            F.when(F.element_at(ins, at) != "", F.lit("in"))
            .otherwise(_op_name(F.element_at(ops, at))).alias("op"),
            F.concat(F.element_at(part(4), at), F.element_at(part(6), at)).alias("raw"),
        )

    return F.transform(part(2), piece)


def _op_name(symbol: Column) -> Column:
    out = F.lit(None).cast("string")
    for sign, name in OP_NAMES.items():
        out = F.when(symbol == sign, F.lit(name)).otherwise(out)
    return out


def literal_values(raw: Column) -> Column:
    return F.regexp_extract_all(raw, F.lit(LITERALS), F.lit(0))


def text_value(column: Column, literal: Column) -> Column:
    """String side of a clause value: quoted texts for text columns, true/false for flags."""
    quoted = literal.startswith("'")
    body = F.replace(F.substring(literal, F.lit(2), F.length(literal) - 2),
                     F.lit("''"), F.lit("'"))
    plain = F.lower(F.when(quoted, body).otherwise(literal))
    return (
        F.when(column.isin(*TEXT_ATTRIBUTES), F.when(quoted, body))
        .when(column == "is_returning",
              F.when(plain.isin("true", "1"), F.lit("true"))
              .when(plain.isin("false", "0"), F.lit("false")))
    )


def number_value(column: Column, literal: Column) -> Column:
    bare = F.replace(literal, F.lit("'"), F.lit(""))
    return F.when(column == "device_age_months", bare.try_cast("double"))
