"""Structured operands: columns, functions, values, lists, ranges, tuples, arithmetic, intervals.

An operand is a dictionary with an ``operand`` kind.  What cannot be resolved is
refused, so that its clause matches nothing.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from querywright.functions.casts import cast_to, literal
from querywright.functions.scalar import FUNCTIONS, PLAIN
from querywright.model.schema import FLOAT_LITERAL, INTEGER_LITERAL, NUMERIC, STRING, TEXT_LITERAL, cast_category, cast_literal, clean_cast
from querywright.operators.arithmetic import ARITHMETIC, compute
from querywright.operators.comparison import Comparison, all_of, any_of, is_scalar
from querywright.plans.context import Context, Refused, requested_cast, typed_column

READINGS = {"%s": TEXT_LITERAL, "%d": INTEGER_LITERAL, "%f": FLOAT_LITERAL}
UNITS = {"SECOND": "secs", "MINUTE": "mins", "HOUR": "hours", "DAY": "days", "WEEK": "weeks", "MONTH": "months", "YEAR": "years"}
SCALAR_KINDS = ("column", "func", "value", "math")


@dataclass(frozen=True)
class Operand:
    """A resolved operand.  ``members`` are the parts of a list, range or tuple."""

    kind: str
    column: Column | None = None
    category: str = STRING
    literal: str = TEXT_LITERAL
    members: tuple[Operand, ...] = ()

    @property
    def width(self) -> int:
        if self.kind == "tuple":
            return len(self.members)
        if self.kind in ("list", "range"):
            return self.members[0].width
        return 1

    @property
    def scalar(self) -> bool:
        return self.kind in SCALAR_KINDS

    @property
    def left(self) -> bool:
        """May stand left of a comparison."""
        return self.kind in ("column", "func", "math", "tuple")


def is_operand(value: Any) -> bool:
    return isinstance(value, Mapping) and isinstance(value.get("operand"), str)


def resolve(ctx: Context, spec: Any, kinds: tuple[str, ...] | None = None) -> Operand:
    """An operand from its dictionary; a bare scalar is a value where values are allowed."""
    if not is_operand(spec):
        if is_scalar(spec) and (kinds is None or "value" in kinds):
            return _value(spec)
        raise Refused("not an operand")
    kind = spec["operand"].lower()
    if kinds is not None and kind not in kinds:
        raise Refused(f"operand {kind!r} is not allowed here")
    build = _BUILDERS.get(kind)
    if build is None:
        raise Refused(f"unknown operand {kind!r}")
    found = build(ctx, spec)
    return found if kind == "column" else _cast(found, spec.get("cast"))


def _cast(found: Operand, request: Any) -> Operand:
    if request in (None, False, ""):
        return found
    target = clean_cast(request) if isinstance(request, str) else None
    if target is None or not found.scalar:
        raise Refused("a cast needs an allowed target and a scalar operand")
    return Operand("func", cast_to(found.column, target, found.category), cast_category(target), cast_literal(target))


def _value(value: Any, reading: str | None = None) -> Operand:
    kind = reading or (INTEGER_LITERAL if isinstance(value, bool | int) else FLOAT_LITERAL if isinstance(value, float) else TEXT_LITERAL)
    return Operand("value", literal(value, kind), STRING if kind == TEXT_LITERAL else NUMERIC, kind)


def _column(ctx: Context, spec: Mapping) -> Operand:
    column = ctx.column(spec.get("name"))
    x, category, reading = typed_column(ctx, column, requested_cast(column, spec.get("cast")))
    return Operand("column", x, category, reading)


def _value_spec(ctx: Context, spec: Mapping) -> Operand:
    if not is_scalar(spec.get("value")):
        raise Refused("a value operand needs a scalar")
    # Without a pattern a value is text, as a prepared string would be.
    return _value(spec["value"], READINGS.get(spec.get("pattern"), TEXT_LITERAL))


def _func(ctx: Context, spec: Mapping) -> Operand:
    name = spec.get("name")
    fn = FUNCTIONS.get(name.upper()) if isinstance(name, str) else None
    args = spec.get("args", [])
    if fn is None or not isinstance(args, list | tuple) or len(args) < fn.least or (fn.most is not None and len(args) > fn.most):
        raise Refused(f"function {name!r} is unknown or has a wrong number of arguments")
    found: list[Operand] = []
    given: list[tuple[Any, str]] = []
    for k, arg in enumerate(args):
        kinds = fn.kinds_at(k)
        if kinds == ("value",):
            raw = arg.get("value") if is_operand(arg) and arg["operand"] == "value" else arg
            if not is_scalar(raw):
                raise Refused(f"argument {k + 1} of {name} must be a plain value")
            given.append((_plain_argument(name, raw), STRING))
            continue
        one = resolve(ctx, arg, kinds)
        # Only columns and casts have a type that can be known to be wrong.
        if is_operand(arg) and (one.kind == "column" or arg.get("cast")) and one.category not in fn.accepts:
            raise Refused(f"{name} does not take {one.category}")
        found.append(one)
        given.append((one.column, one.category))
    reading, category = (fn.literal, fn.category) if fn.literal else _derived(found)
    return Operand("func", fn.build(given, ctx.options.now), category, reading)


def _plain_argument(name: str, raw: Any) -> Any:
    if name.upper() != "WEEK":
        return str(raw)
    try:
        mode = int(raw)
    except ValueError:
        raise Refused("WEEK needs a mode") from None
    if mode not in (0, 1):
        raise Refused(f"week mode {mode} is not supported")
    return mode


def _derived(args: list[Operand]) -> tuple[str, str]:
    """The reading of a result that has its arguments' type: common, floats over integers, else text."""
    readings = {a.literal for a in args}
    categories = {a.category for a in args}
    category = categories.pop() if len(categories) == 1 else STRING
    if len(readings) == 1:
        return readings.pop(), category
    return (FLOAT_LITERAL, NUMERIC) if readings == {INTEGER_LITERAL, FLOAT_LITERAL} else (TEXT_LITERAL, category)


def _members(ctx: Context, spec: Mapping, key: str, kinds: tuple[str, ...]) -> tuple[Operand, ...]:
    raw = spec.get(key)
    if not isinstance(raw, list | tuple) or not raw:
        raise Refused(f"{key} must be a list that is not empty")
    return tuple(resolve(ctx, m, kinds) for m in raw)


def _list(ctx: Context, spec: Mapping) -> Operand:
    members = _members(ctx, spec, "values", (*PLAIN, "tuple"))
    if len({m.width for m in members}) != 1:
        raise Refused("a list's members must have equal widths")
    return Operand("list", members=members)


def _range(ctx: Context, spec: Mapping) -> Operand:
    members = _members(ctx, spec, "bounds", PLAIN)
    if len(members) != 2:
        raise Refused("a range has two bounds")
    return Operand("range", members=members)


def _tuple(ctx: Context, spec: Mapping) -> Operand:
    members = _members(ctx, spec, "values", PLAIN)
    if len(members) < 2:
        raise Refused("a tuple has two members at least")
    return Operand("tuple", members=members)


def _math(ctx: Context, spec: Mapping) -> Operand:
    sign = spec.get("operator")
    members = _members(ctx, spec, "values", SCALAR_KINDS)
    if sign not in ARITHMETIC or len(members) < 2:
        raise Refused("arithmetic needs + - * or / and two members")
    numbers = [m.column if m.category == NUMERIC else m.column.cast("string").try_cast("double") for m in members]
    whole = sign != "/" and all(m.literal == INTEGER_LITERAL for m in members)
    return Operand("math", compute(sign, numbers), NUMERIC, INTEGER_LITERAL if whole else FLOAT_LITERAL)


def _interval(ctx: Context, spec: Mapping) -> Operand:
    unit, amount = spec.get("unit"), spec.get("amount")
    if not isinstance(unit, str) or unit.upper() not in UNITS or isinstance(amount, bool) or not isinstance(amount, int):
        raise Refused("an interval needs a unit and a whole amount")
    if not -(1 << 31) < amount < 1 << 31:
        # No date is that far from another: whatever it is added to becomes null.
        return Operand("interval", F.lit(None).cast("interval"))
    return Operand("interval", F.try_make_interval(**{UNITS[unit.upper()]: F.lit(amount)}))


_BUILDERS = {
    "column": _column,
    "value": _value_spec,
    "func": _func,
    "list": _list,
    "range": _range,
    "tuple": _tuple,
    "math": _math,
    "interval": _interval,
}


def _aligned(ctx: Context, a: Operand, b: Operand) -> tuple[Column, Column]:
    """Two scalars in a type they can be compared in."""
    x, y = a.column, b.column
    if a.category == b.category:
        return ctx.folded(x, a.category), ctx.folded(y, b.category)
    for p, q, flip in ((a, b, False), (b, a, True)):
        if p.category == NUMERIC:
            other = q.column.cast("string").try_cast("double")
            return (other, p.column) if flip else (p.column, other)
    for p, q, flip in ((a, b, False), (b, a, True)):
        if p.category == "date":
            other = q.column.cast("string").try_cast("timestamp_ntz")
            return (other, p.column) if flip else (p.column, other)
    return x.cast("string"), y.cast("string")


def _equal(ctx: Context, a: Operand, b: Operand) -> Column:
    if a.kind == "tuple":
        return all_of([_equal(ctx, x, y) for x, y in zip(a.members, b.members, strict=True)])
    x, y = _aligned(ctx, a, b)
    return x == y


def _ordered(ctx: Context, op: Comparison, a: Operand, b: Operand) -> Column:
    """Tuples compare by their first unequal members; scalars as they are."""
    if a.kind != "tuple":
        return op.pair(*_aligned(ctx, a, b))
    strict = op.name[0]
    pairs = [_aligned(ctx, x, y) for x, y in zip(a.members, b.members, strict=True)]
    steps = []
    for k, (x, y) in enumerate(pairs):
        before = [p == q for p, q in pairs[:k]]
        last = op.name if k == len(pairs) - 1 else strict
        here = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[last]
        steps.append(all_of([*before, here]))
    return any_of(steps)


def compare_operands(ctx: Context, left: Operand, op: Comparison, right: Operand) -> Column:
    """A comparison of two operands; shapes that do not go together are refused."""
    if not left.left:
        raise Refused(f"{left.kind} cannot stand on the left")
    if right.kind == "interval" or right.width != left.width:
        raise Refused("operands differ in width")
    if op.many:
        if right.kind != "list":
            raise Refused(f"{op.name} needs a list")
        found = any_of([_equal(ctx, left, m) for m in right.members])
        return ~found if op.negative else found
    if op.ranged:
        if right.kind != "range":
            raise Refused(f"{op.name} needs a range")
        x, lo = _aligned(ctx, left, right.members[0])
        z, hi = _aligned(ctx, left, right.members[1])
        found = (x >= lo) & (z <= hi)
        return ~found if op.negative else found
    if not op.expression or not (right.scalar or right.kind == "tuple"):
        raise Refused(f"{op.name} does not take a {right.kind}")
    if op.name in ("=", "!="):
        found = _equal(ctx, left, right)
        return ~found if op.negative else found
    return _ordered(ctx, op, left, right)
