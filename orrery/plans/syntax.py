"""The syntax tree: expressions, queries and statements."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

Name = tuple[str, ...]


# expressions
@dataclass
class Literal:
    kind: str  # int, decimal, double, string, null
    value: Any


@dataclass
class Column:
    name: Name


@dataclass
class Variable:
    name: str


@dataclass
class Unary:
    op: str
    operand: Any


@dataclass
class Binary:
    op: str
    left: Any
    right: Any


@dataclass
class Call:
    name: str
    args: list
    distinct: bool = False
    star: bool = False
    within: list = field(default_factory=list)  # WITHIN GROUP: (expression, descending)


@dataclass
class Windowed:
    call: Call
    partition: list
    order: list  # of (expression, descending)
    frame: str = ""


@dataclass
class Case:
    operand: Any
    branches: list
    otherwise: Any


@dataclass
class Cast:
    operand: Any
    type: TypeName
    lenient: bool = False


@dataclass
class Subquery:
    query: Any


# predicates
@dataclass
class Compare:
    op: str
    left: Any
    right: Any


@dataclass
class IsNull:
    operand: Any
    negated: bool


@dataclass
class Between:
    operand: Any
    low: Any
    high: Any
    negated: bool


@dataclass
class InList:
    operand: Any
    items: list | None
    query: Any
    negated: bool


@dataclass
class Like:
    operand: Any
    pattern: Any
    escape: str | None
    negated: bool


@dataclass
class Exists:
    query: Any


@dataclass
class Logic:
    op: str  # and, or, not
    args: list


@dataclass
class TypeName:
    name: str
    args: list[int] = field(default_factory=list)


# queries
@dataclass
class Item:
    expr: Any  # None for a star
    alias: str | None = None
    star: Name | None = None


@dataclass
class Table:
    name: Name
    alias: str | None = None


@dataclass
class Derived:
    query: Any
    alias: str
    columns: list[str] | None = None


@dataclass
class ValuesTable:
    rows: list[list]
    alias: str
    columns: list[str] | None = None


@dataclass
class Join:
    kind: str  # inner, left, right, full, cross
    left: Any
    right: Any
    on: Any = None


@dataclass
class Grouping:
    kind: str  # plain, rollup, cube, sets
    exprs: list


@dataclass
class Select:
    items: list[Item]
    sources: list
    where: Any = None
    group: Grouping | None = None
    having: Any = None
    distinct: bool = False
    top: Any = None
    order: list = field(default_factory=list)
    offset: Any = None
    fetch: Any = None
    ties: bool = False
    into: Name | None = None


@dataclass
class SetOp:
    op: str  # union all, union, except, intersect
    left: Any
    right: Any
    order: list = field(default_factory=list)
    offset: Any = None
    fetch: Any = None


@dataclass
class Cte:
    name: str
    columns: list[str] | None
    query: Any


@dataclass
class With:
    ctes: list[Cte]
    body: Any


# statements
@dataclass
class Statement:
    text: str = field(default="", init=False)


@dataclass
class SelectStatement(Statement):
    query: Any


@dataclass
class CreateDatabase(Statement):
    name: str


@dataclass
class Use(Statement):
    name: str


@dataclass
class CreateSchema(Statement):
    name: str
    owner: str | None


@dataclass
class ColumnDef:
    name: str
    type: TypeName | None
    nullable: bool = True
    identity: tuple[int, int] | None = None
    default: str | None = None
    computed: str | None = None


@dataclass
class CreateTable(Statement):
    name: Name
    columns: list[ColumnDef]


@dataclass
class Insert(Statement):
    name: Name
    columns: list[str] | None
    rows: list[list] | None
    query: Any
    ctes: list[Cte] = field(default_factory=list)


@dataclass
class Update(Statement):
    target: Name
    sets: list  # of (column, op, expression)
    sources: list
    where: Any
    ctes: list[Cte] = field(default_factory=list)


@dataclass
class Delete(Statement):
    target: Name
    where: Any
    alias: str | None = None
    ctes: list[Cte] = field(default_factory=list)


@dataclass
class Declare(Statement):
    items: list  # of (name, type, expression)


@dataclass
class SetVariable(Statement):
    name: str
    value: Any


@dataclass
class NoOp(Statement):
    what: str


@dataclass
class Parameter:
    name: str
    type: TypeName
    default: Any = None
    has_default: bool = False
    output: bool = False


@dataclass
class CreateProcedure(Statement):
    name: Name
    params: list[Parameter]
    body: str
    mode: str  # create, alter, either


@dataclass
class DropProcedure(Statement):
    names: list[Name]
    if_exists: bool


@dataclass
class Execute(Statement):
    name: Name
    args: list  # of (parameter or None, expression, output)


@dataclass
class Block(Statement):
    statements: list


@dataclass
class Security(Statement):
    action: str
    args: dict
