"""Metadata queries: conditions on the key/value side table of a table."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querywright.functions.casts import cast_to, signed
from querywright.model.schema import STRING, TEXT_LITERAL, cast_category, cast_literal, clean_cast
from querywright.operators.logic import connective
from querywright.plans.context import Context, Refused, clauses_of, is_group
from querywright.plans.pred import Exists, Pred, group, never

#: What the simple variables stand for in a clause.
SIMPLE = {"meta_key": "key", "meta_value": "value", "meta_compare": "compare", "meta_type": "type", "meta_compare_key": "compare_key", "meta_type_key": "type_key"}
CLAUSE_KEYS = {"key", "value"}


def meta_cast(name: Any) -> str:
    """A value type as a cast target; an unknown one is CHAR."""
    text = re.sub(r"\s+", "", str(name or "")).upper()
    return "SIGNED" if text == "NUMERIC" else clean_cast(text) or "CHAR"


def query_of(spec: Mapping[str, Any]) -> Any:
    """``meta_query`` with the simple variables folded in as one more clause."""
    simple = {field: spec[var] for var, field in SIMPLE.items() if spec.get(var) not in (None, "")}
    tree = spec.get("meta_query")
    if not {"key", "value"} & simple.keys():
        return tree
    return [simple, tree] if tree else simple


def is_clause(node: Any) -> bool:
    return isinstance(node, Mapping) and bool(CLAUSE_KEYS & node.keys())


class Meta:
    """Builds predicates and orders against the metadata of one table."""

    def __init__(self, ctx: Context):
        self.ctx, self.spec = ctx, ctx.table.meta
        if self.spec is None or len(ctx.table.primary) != 1:
            raise Refused(f"{ctx.table.name} has no metadata store")
        self.rows: DataFrame = ctx.catalog.frame(self.spec.table)
        self.on = ((ctx.table.primary[0], self.spec.object_id),)

    def _exists(self, condition: Column | None, negate: bool = False) -> Exists:
        return Exists(self.rows if condition is None else self.rows.filter(condition), self.on, negate)

    def _compare(self, x: Column, cast: str | None, name: str, value: Any, binary: bool = False) -> Column:
        category, kind = (cast_category(cast), cast_literal(cast)) if cast else (STRING, TEXT_LITERAL)
        left = cast_to(x, cast, STRING) if cast and cast != "CHAR" else x
        found = self.ctx.compare(left, category, kind, self.ctx.options.comparisons.named_or_equal(name), value, binary or cast == "BINARY")
        if found is None:
            raise Refused(f"{name} without a usable value")
        return found

    def key_condition(self, clause: Mapping[str, Any]) -> tuple[Column | None, bool]:
        """(condition on the key, negated): a negative operator means that no such key is there."""
        if clause.get("key") in (None, "", []):
            return None, False
        ops = self.ctx.options.comparisons
        name = clause.get("compare_key") or ("IN" if isinstance(clause["key"], list | tuple) else "=")
        op = ops.named_or_equal(name)
        if op.unary:
            raise Refused(f"{op.name} is not for keys")
        positive = ops.named_or_equal("=" if op.name in ("EXISTS", "NOT EXISTS") else op.opposite) if op.negative or op.name == "EXISTS" else op
        binary = str(clause.get("type_key", "")).upper() == "BINARY"
        return self._compare(F.col(self.spec.key), None, positive.name, clause["key"], binary), op.negative

    def clause(self, clause: Mapping[str, Any]) -> Pred:
        """One clause.  Value conditions need a row with the key; only key conditions can ask for absence."""
        op = self.ctx.options.comparisons.named_or_equal(clause.get("compare") or ("IN" if isinstance(clause.get("value"), list | tuple) else "="))
        key, absent = self.key_condition(clause)
        given = clause.get("value") not in (None, "", []) or (isinstance(clause.get("value"), int | float))
        if op.name == "NOT EXISTS":
            if key is None or absent:
                raise Refused("NOT EXISTS needs a plain key")
            return self._exists(key, negate=True)
        if absent:
            if given or op.unary:
                raise Refused("a negative key with a value condition")
            return self._exists(key, negate=True)
        value = F.col(self.spec.value)
        if op.unary:
            wanted = value.isNull() if op.name == "IS NULL" else value.isNotNull()
            return self._exists(wanted if key is None else key & wanted)
        if op.name == "EXISTS" or not given:
            if key is None:
                raise Refused("a clause without key and value")
            return self._exists(key)
        wanted = self._compare(value, meta_cast(clause.get("type")), op.name, clause["value"])
        return self._exists(wanted if key is None else key & wanted)

    def tree(self, node: Any) -> Pred | None:
        if is_clause(node):
            return self.clause(node)
        if not is_group(node):
            raise Refused("a metadata query needs clauses")
        relation, members = clauses_of(node)
        return group(connective(relation), [self.tree(m) for _, m in members])

    def ordered(self, df: DataFrame, clause: Mapping[str, Any], numeric: bool, alias: str) -> DataFrame:
        """``df`` with the value that orders it: of several rows of a key, the one with the smallest id."""
        key, absent = self.key_condition(clause)
        rows = self.rows if key is None or absent else self.rows.filter(key)
        first = rows.groupBy(F.col(self.spec.object_id).alias("_qw_object")).agg(F.min_by(self.spec.value, self.spec.id).alias(alias))
        x = F.col(alias)
        kind = meta_cast(clause.get("type"))
        x = signed(x, STRING) if numeric else cast_to(x, kind, STRING) if kind != "CHAR" else x
        joined = df.join(first, df[self.on[0][0]] == first["_qw_object"], "left").drop("_qw_object")
        return joined.withColumn(alias, x)


def clauses(node: Any, name: str | None = None) -> Iterator[tuple[str | None, Mapping[str, Any]]]:
    """Every clause of a tree with its name."""
    if is_clause(node):
        yield name, node
    elif is_group(node):
        for inner, member in clauses_of(node)[1]:
            yield from clauses(member, inner)


def meta_filters(ctx: Context, spec: Mapping[str, Any]) -> tuple[Pred | None, bool]:
    """(predicate, refused): a malformed query empties the whole result."""
    tree = query_of(spec)
    if not tree:
        return None, False
    try:
        return Meta(ctx).tree(tree), False
    except Refused as reason:
        ctx.warn("meta", str(reason))
        return never(), True


def order_clause(spec: Mapping[str, Any], name: str) -> tuple[Mapping[str, Any], bool] | None:
    """The clause that ``meta_value``, ``meta_value_num`` or a clause's name orders by, and whether as numbers."""
    found = list(clauses(query_of(spec) or []))
    if name in ("meta_value", "meta_value_num"):
        keyed = next((c for _, c in found if c.get("key")), None)
        return (keyed, name == "meta_value_num") if keyed else None
    return next(((c, False) for n, c in found if n == name), None)
