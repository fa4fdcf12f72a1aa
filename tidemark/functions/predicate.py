"""Participation predicates of partial keys: a small tree, compiled to columns with SQL's three-valued logic.

A tree is a nested tuple: ``("and" | "or", left, right)``, ``("not", tree)``, ``("is_null" |
"not_null", column)``, ``(comparison, column, literal)`` or ``("in" | "not_in", column, literals)``.
"""

from __future__ import annotations

import re
import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.placing import running

#: Fixed value: nodes a predicate may have.
MOST_NODES = 256
COMPARISONS = ("=", "<>", "<=", ">=", "<", ">")


def nodes(tree: tuple) -> int:
    return 1 + sum(nodes(part) for part in tree[1:] if isinstance(part, tuple) and tree[0] in ("and", "or", "not"))


def compile(tree: tuple) -> Column:  # noqa: A001
    """The tree as a boolean column that is null where SQL says unknown."""
    if nodes(tree) > MOST_NODES:
        raise ValueError("predicate has too many nodes")
    return _column(tree)


def _column(tree: tuple) -> Column:
    kind = tree[0]
    if kind in ("and", "or"):
        left, right = map(_column, tree[1:])
        return left & right if kind == "and" else left | right
    if kind == "not":
        return ~_column(tree[1])
    column = F.col(tree[1])
    if kind in ("is_null", "not_null"):
        return column.isNull() if kind == "is_null" else column.isNotNull()
    if kind in ("in", "not_in"):
        if not tree[2]:  # in nothing, whatever the value
            return F.lit(kind == "not_in")
        # spelled out, so that a null literal makes a miss unknown
        found = reduce(lambda a, b: a | b, (column == F.lit(v) for v in tree[2]))
        return found if kind == "in" else ~found
    value = F.lit(tree[2])
    return {"=": column == value, "<>": column != value, "<": column < value, "<=": column <= value, ">": column > value, ">=": column >= value}[kind]


def participating(df: DataFrame, tree: tuple) -> DataFrame:
    """Rows for which the predicate is true; unknown does not participate."""
    return df.filter(compile(tree))


def _literal(value) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(value)


def render(tree: tuple) -> str:
    """The tree as SQL text that both engines read."""
    kind = tree[0]
    if kind in ("and", "or"):
        return f"({render(tree[1])} {kind.upper()} {render(tree[2])})"
    if kind == "not":
        return f"(NOT {render(tree[1])})"
    if kind in ("is_null", "not_null"):
        return f"{tree[1]} IS {'NOT ' * (kind == 'not_null')}NULL"
    if kind in ("in", "not_in"):
        return f"{tree[1]} {'NOT ' * (kind == 'not_in')}IN ({', '.join(map(_literal, tree[2]))})"
    return f"{tree[1]} {kind} {_literal(tree[2])}"


_TOKENS = re.compile(r"\s*(?:(<>|<=|>=|[=<>(),])|('(?:[^']|'')*')|(-?\d+(?:\.\d+)?)|([A-Za-z_]\w*))")


def parse(text: str) -> tuple:
    """The tree of a WHERE text of this grammar; anything else is refused."""
    tokens, at = [], 0
    while text[at:].strip():
        found = _TOKENS.match(text, at)
        if not found:
            raise ValueError(f"cannot read {text[at:]!r}")
        tokens.append(found)
        at = found.end()
    place = 0

    def word(*options: str) -> str | None:
        nonlocal place
        if place < len(tokens) and (said := tokens[place][0].strip().upper()) in options:
            place += 1
            return said
        return None

    def need(*options: str) -> str:
        if (said := word(*options)) is None:
            raise ValueError(f"expected {' or '.join(options)}")
        return said

    def value():
        nonlocal place
        if place >= len(tokens):
            raise ValueError("expected a literal")
        found = tokens[place]
        place += 1
        if found[2]:
            return found[2][1:-1].replace("''", "'")
        if found[3]:
            return float(found[3]) if "." in found[3] else int(found[3])
        if found[4] and found[4].upper() == "NULL":
            return None
        raise ValueError(f"not a literal: {found[0].strip()}")

    def single() -> tuple:
        nonlocal place
        if word("NOT"):
            return ("not", single())
        if word("("):
            inner = either()
            need(")")
            return inner
        if place >= len(tokens) or not tokens[place][4]:
            raise ValueError("expected a column")
        column = tokens[place][4]
        place += 1
        if word("IS"):
            kind = "not_null" if word("NOT") else "is_null"
            need("NULL")
            return (kind, column)
        negated = word("NOT")
        if word("IN"):
            need("(")
            values = [value()]
            while word(","):
                values.append(value())
            need(")")
            return ("not_in" if negated else "in", column, tuple(values))
        return (need(*COMPARISONS), column, value())

    def chain(operator: str, part) -> tuple:
        tree = part()
        while word(operator.upper()):
            tree = (operator, tree, part())
        return tree

    def both() -> tuple:
        return chain("and", single)

    def either() -> tuple:
        return chain("or", both)

    tree = either()
    if place != len(tokens):
        raise ValueError("text behind the predicate")
    if nodes(tree) > MOST_NODES:
        raise ValueError("predicate has too many nodes")
    return tree


def collate(column: Column, name: str) -> Column:
    """A form of a text whose equality and order are those of the collation (NOCASE: ASCII only)."""
    if name == "NOCASE":
        return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)
    if name == "RTRIM":
        return F.regexp_replace(column, " +$", "")
    if name == "BINARY":
        return column
    raise ValueError(f"collation {name} is not replicated")


def ranked(df: DataFrame, tag: str, number: str, text: str, tie: str) -> DataFrame:
    """Adds place: values of mixed classes in order, numbers before text before blobs."""
    rank = F.when(F.col(tag).isin(1, 2), 1).when(F.col(tag) == 3, 2).when(F.col(tag) == 4, 3).otherwise(0)
    return running(df, [rank, F.col(number).asc_nulls_first(), F.col(text).asc_nulls_first(), tie])


def affinity(declared: Column) -> Column:
    """Storage class a declared type asks for, by the substrings in it, in this order."""
    up = F.upper(declared)
    has = lambda *words: reduce(lambda a, b: a | b, (up.contains(w) for w in words))
    return F.when(has("INT"), "INTEGER").when(has("CHAR", "CLOB", "TEXT"), "TEXT").when(has("BLOB") | (up == ""), "BLOB").when(has("REAL", "FLOA", "DOUB"), "REAL").otherwise("NUMERIC")


def project(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns by identity under their current names."""
    return df.select(*(F.col(column).alias(name) for column, name in names.items()))
