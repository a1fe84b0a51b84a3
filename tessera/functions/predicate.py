"""The predicate language: parenthesised disjunctions of comparisons, joined by AND."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import ParseError, TypeMismatch
from tessera.functions.lexer import Reader
from tessera.functions.names import kind_of, quoted, resolve


@dataclass(frozen=True)
class Operand:
    kind: str  # name, int, float, string
    value: object

    def __str__(self) -> str:
        return f"'{self.value}'" if self.kind == "string" else str(self.value)


@dataclass(frozen=True)
class Comparison:
    left: Operand
    op: str
    right: Operand

    def __str__(self) -> str:
        return f"{self.left} {self.op} {self.right}"

    def names(self) -> list[str]:
        return [x.value for x in (self.left, self.right) if x.kind == "name"]


Clause = tuple[Comparison, ...]
Cnf = tuple[Clause, ...]


def read_operand(r: Reader) -> Operand:
    minus = r.mode != "compat" and r.take("-")
    t = r.next()
    if t.kind in ("int", "float"):
        return Operand(t.kind, -t.value if minus else t.value)
    if minus or t.kind not in ("name", "string"):
        raise ParseError(f"operand expected at {t.at}")
    return Operand(t.kind, t.value)


def read_cnf(r: Reader, bare: bool = True) -> Cnf:
    """bare: a name alone stands for its comparison with itself, as sort keys are written."""
    clauses = []
    while True:
        r.need("(")
        terms = []
        while True:
            left = read_operand(r)
            if r.ahead.kind in ("<", ">", "="):
                terms.append(Comparison(left, r.next().kind, read_operand(r)))
            elif bare and left.kind == "name":
                terms.append(Comparison(left, "=", left))
            else:
                raise ParseError(f"comparison expected at {r.ahead.at}")
            if not r.take("keyword", "OR"):
                break
        r.need(")")
        clauses.append(tuple(terms))
        if not r.take("keyword", "AND"):
            return tuple(clauses)


def parse_cnf(text: str, mode: str = "ansi") -> Cnf:
    r = Reader(text, mode)
    out = read_cnf(r)
    r.need("end")
    return out


def sort_keys(text: str, mode: str = "ansi") -> list[str]:
    """Names of a sort specification: bare names, one per clause."""
    cnf = parse_cnf(text, mode)
    if any(len(c) != 1 or c[0].left != c[0].right or c[0].left.kind != "name" for c in cnf):
        raise ParseError("a sort key is a single name in each clause")
    return [c[0].left.value for c in cnf]


def bind_operand(x: Operand, schemas: tuple[T.StructType, ...]) -> tuple[Column, str]:
    if x.kind == "name":
        f = resolve(x.value, *schemas)
        return F.col(quoted(f.name)), kind_of(f.dataType)
    return F.lit(x.value), {"int": "int", "float": "double", "string": "string"}[x.kind]


def bind_comparison(c: Comparison, schemas: tuple[T.StructType, ...], mode: str) -> Column:
    (a, ka), (b, kb) = bind_operand(c.left, schemas), bind_operand(c.right, schemas)
    if ka != kb and (mode == "compat" or "string" in (ka, kb)):
        raise TypeMismatch(f"{c}: {ka} against {kb}")
    return {"<": a < b, ">": a > b, "=": a == b}[c.op]


def bind(cnf: Cnf, *schemas: T.StructType, mode: str = "ansi") -> Column:
    """The predicate as a Column over the first schema that has each name.

    "ansi" compares numbers across kinds; "compat" wants equal kinds on both sides.
    """
    clauses = [reduce(lambda x, y: x | y, [bind_comparison(c, schemas, mode) for c in clause]) for clause in cnf]
    return reduce(lambda x, y: x & y, clauses)


def text_of(cnf: Cnf) -> str:
    return " AND ".join("(" + " OR ".join(map(str, clause)) + ")" for clause in cnf)
