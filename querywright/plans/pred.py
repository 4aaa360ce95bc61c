"""Predicates over rows, and how they become filters and semi-joins.

A predicate is a boolean Column, an existence test against the keys of another
DataFrame, or a group of predicates.  Existence tests on an AND spine become
left-semi and left-anti joins.  Under OR, XOR or NOT they become a left join with
the distinct keys and a flag that is true or false, never null.  Neither repeats a
row of the left side.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querywright.operators.comparison import all_of
from querywright.operators.logic import combine

_serial = itertools.count()


@dataclass(frozen=True)
class Expr:
    column: Column


@dataclass(frozen=True)
class Exists:
    """A row passes if ``keys`` has a row equal in every pair (left column, key column); null never equals."""

    keys: DataFrame
    on: tuple[tuple[str, str], ...]
    negate: bool = False


@dataclass(frozen=True)
class Group:
    op: str
    items: tuple[Pred, ...]
    negate: bool = False


Pred = Expr | Exists | Group



def never() -> Expr:
    """Matches no row: what a refused filter becomes, so that it cannot widen a result."""
    return Expr(F.lit(False))


def group(op: str, items: Sequence[Pred | None], negate: bool = False) -> Pred | None:
    """A group of those items that say something; None if none does."""
    kept = tuple(i for i in items if i is not None)
    if not kept:
        return None
    if len(kept) == 1 and not negate:
        return kept[0]
    return Group(op, kept, negate)


def has_exists(pred: Pred) -> bool:
    return isinstance(pred, Exists) or (isinstance(pred, Group) and any(map(has_exists, pred.items)))


def spine(pred: Pred) -> Iterator[Pred]:
    """The members of an AND, nested ones included."""
    if isinstance(pred, Group) and pred.op == "AND" and not pred.negate:
        for item in pred.items:
            yield from spine(item)
    else:
        yield pred


def apply(df: DataFrame, pred: Pred | None) -> DataFrame:
    """The rows of ``df`` that pass: plain filters first, so that they reach the scan."""
    if pred is None:
        return df
    parts = list(spine(pred))
    for part in parts:
        if isinstance(part, Expr):
            df = df.filter(part.column)
    for part in parts:
        if isinstance(part, Exists):
            df = _joined(df, part)
        elif isinstance(part, Group):
            df = _flagged(df, part)
    return df


def _renamed(exists: Exists) -> tuple[DataFrame, list[str]]:
    """The key side under names that clash with nothing."""
    n = next(_serial)
    names = [f"_qw_key_{n}_{i}" for i in range(len(exists.on))]
    return exists.keys.select(*[F.col(k).alias(a) for (_, k), a in zip(exists.on, names, strict=True)]), names


def _joined(df: DataFrame, exists: Exists) -> DataFrame:
    keys, names = _renamed(exists)
    same = all_of([df[left] == keys[name] for (left, _), name in zip(exists.on, names, strict=True)])
    return df.join(keys, same, "left_anti" if exists.negate else "left_semi")


def _flagged(df: DataFrame, pred: Group) -> DataFrame:
    columns = df.columns
    flags: list[str] = []

    def column_of(p: Pred) -> Column:
        nonlocal df
        if isinstance(p, Expr):
            return p.column
        if isinstance(p, Exists):
            keys, names = _renamed(p)
            flag = f"_qw_flag_{next(_serial)}"
            keys = keys.distinct().withColumn(flag, F.lit(True))
            df = df.join(keys, all_of([df[left] == keys[name] for (left, _), name in zip(p.on, names, strict=True)]), "left")
            flags.append(flag)
            return F.col(flag).isNull() if p.negate else F.col(flag).isNotNull()
        return combine(p.op, [column_of(i) for i in p.items], p.negate)

    condition = column_of(pred)
    return df.filter(condition).select(*columns)
