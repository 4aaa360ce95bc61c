"""Relationship filters: does a row have, or lack, related rows that meet conditions.

Both strategies of the specification language become semi- and anti-joins on
distinct-free key tables; they differ in what they accept, and in whether they
count as joining, which matters under OR and NOT.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querywright.model.schema import RelationSpec, TableSpec
from querywright.operators.logic import connective
from querywright.plans.columns import compare_clause
from querywright.plans.context import Context, Refused, clauses_of, is_group
from querywright.plans.operands import is_operand
from querywright.plans.pred import Exists, Expr, Pred, apply, group, never

#: Filters the remote side by a whole specification; given by the query module.
RemoteQuery = Callable[[TableSpec, Mapping[str, Any]], DataFrame]


@dataclass(frozen=True)
class Related:
    """A relation filter and whether the reference form of it would join."""

    pred: Pred
    joins: bool = False


def conditions(ctx: Context, where: Any) -> Pred | None:
    """Conditions on the remote table: ``{column: value}``, ``{column: {compare, value}}``, or nested groups."""
    if isinstance(where, Mapping) and "clauses" not in where:
        if "key" in where:
            return _strict(compare_clause(ctx, where))
        found = []
        for name, value in where.items():
            if name == "relation":
                continue
            column = ctx.column(name)
            if is_operand(value):
                clause = {"key": column.name, "value": value}
            elif isinstance(value, Mapping):
                clause = {"key": column.name, **value}
            else:
                clause = {"key": column.name, "value": value, "compare": "IN" if isinstance(value, list | tuple) else "="}
            found.append(_strict(compare_clause(ctx, clause)))
        return group(connective(where.get("relation")), found)
    if is_group(where):
        relation, members = clauses_of(where)
        return group(connective(relation), [conditions(ctx, m) for _, m in members])
    raise Refused("conditions must be a dictionary or a list of them")


def _strict(pred: Pred | None) -> Pred:
    """On the remote side a condition that says nothing is refused, not dropped."""
    if pred is None:
        raise Refused("a condition without a usable value")
    return pred


def _remote(ctx: Context, relation: RelationSpec) -> Context:
    if relation.errors():
        raise Refused(f"relation {relation.name} is not well declared")
    table = ctx.catalog.tables.get(relation.table)
    if table is None:
        raise Refused(f"relation {relation.name}: no table {relation.table}")
    for c in relation.columns:
        ctx.column(c)
    far = ctx.of(table)
    for r in relation.references:
        far.column(r)
    return far


def _relation(ctx: Context, clause: Any) -> RelationSpec:
    if not isinstance(clause, Mapping) or not isinstance(clause.get("name"), str):
        raise Refused("a relation clause needs a name")
    found = ctx.table.relation(clause["name"])
    if found is None:
        raise Refused(f"unknown relation {clause['name']!r}")
    return found


def _scoped(ctx: Context, far: Context, relation: RelationSpec, where: Any) -> DataFrame:
    """The remote rows that the relation's own condition and the clause's let through."""
    df = ctx.catalog.frame(far.table.name)
    if relation.condition:
        df = apply(df, conditions(far, dict(relation.condition)))
    return apply(df, conditions(far, where)) if where else df


def _wants(clause: Mapping[str, Any]) -> bool:
    return bool(clause.get("exists", True))


def build(ctx: Context, clause: Any, nested: bool = False) -> Related:
    """One relation clause of the joining strategy."""
    relation = _relation(ctx, clause)
    far = _remote(ctx, relation)
    if relation.type == "many_to_many":
        if nested:
            raise Refused("many_to_many cannot stand inside a chain")
        if "relation" in clause and not isinstance(clause["relation"], str):
            raise Refused("many_to_many takes no nested relation")
        return Related(_many_to_many(ctx, far, relation, clause))
    inner = clause.get("relation")
    df = _scoped(ctx, far, relation, clause.get("where"))
    chained = isinstance(inner, Mapping | list | tuple)
    if chained:
        members = [inner] if isinstance(inner, Mapping) else list(inner)
        if not members:
            raise Refused("an empty list of nested relations")
        for m in members:
            df = apply(df, build(far, m, nested=True).pred)
    pairs = tuple(zip(relation.columns, relation.references, strict=True))
    positive = _wants(clause)
    joins = relation.type == "belongs_to" and positive and not chained and not nested
    if joins and str(clause.get("join", "")).lower() == "left" and not clause.get("where") and not relation.condition:
        # A left join without conditions keeps every row.
        return Related(Expr(F.lit(True)), joins=True)
    return Related(Exists(df, pairs, negate=not positive), joins)


def _many_to_many(ctx: Context, far: Context, relation: RelationSpec, clause: Mapping[str, Any]) -> Pred:
    pivot = ctx.catalog.tables.get(relation.through)
    if pivot is None:
        raise Refused(f"no table {relation.through}")
    between = ctx.of(pivot)
    for c in (*relation.through_columns, *relation.through_references):
        between.column(c)
    targets = _scoped(ctx, far, relation, clause.get("where"))
    links = apply(ctx.catalog.frame(pivot.name), Exists(targets, tuple(zip(relation.through_references, relation.references, strict=True))))
    return Exists(links, tuple(zip(relation.columns, relation.through_columns, strict=True)), negate=not _wants(clause))


def build_in(ctx: Context, clause: Mapping[str, Any], remote_query: RemoteQuery) -> Pred:
    """The ``in`` strategy: membership of a foreign key in the keys of a remote query.

    It takes belongs_to relations of one column that refer to the remote primary key,
    without a condition, whose key column allows ``in``.
    """
    relation = _relation(ctx, clause)
    if relation.condition:
        raise Refused("the in strategy takes no conditioned relation")
    if relation.type != "belongs_to" or len(relation.columns) != 1 or len(relation.references) != 1:
        raise Refused("the in strategy takes belongs_to relations of one column")
    if not ctx.column(relation.columns[0]).in_:
        raise Refused(f"{relation.columns[0]} must allow in")
    far = _remote(ctx, relation)
    if far.table.primary != relation.references:
        raise Refused("the in strategy must refer to the remote primary key")
    where = clause.get("where") or {}
    df = remote_query(far.table, {**where, "number": 0, "orderby": "none"}) if isinstance(where, Mapping) else ctx.catalog.frame(far.table.name)
    return Exists(df, ((relation.columns[0], relation.references[0]),))


def strategy_of(ctx: Context, clause: Mapping[str, Any]) -> str:
    """``in`` or ``join``: as asked, else by what the relation needs.

    A clause that asks for absence or for a left join needs the joining strategy too.
    """
    asked = str(clause.get("strategy") or "").lower()
    inner = isinstance(clause.get("relation"), Mapping | list | tuple)
    if asked == "in":
        if inner:
            raise Refused("the in strategy cannot express a nested relation")
        return "in"
    if asked == "join" or inner or "exists" in clause or "join" in clause:
        return "join"
    relation = ctx.table.relation(clause.get("name"))
    if relation is not None and (relation.type == "many_to_many" or len(relation.columns) > 1 or relation.condition):
        return "join"
    return "in"


def relation_tree(ctx: Context, node: Any, root: bool = True) -> Related | None:
    """``relation_query``: a clause or groups of clauses.

    A clause of the joining form stands at the root's AND only; elsewhere its whole
    group is refused.
    """
    if isinstance(node, Mapping) and "name" in node:
        return build(ctx, node)
    if not is_group(node):
        raise Refused("a relation query needs clauses")
    relation, members = clauses_of(node)
    op = connective(relation)
    found = [relation_tree(ctx, m, root and op == "AND") for _, m in members]
    kept = [f for f in found if f is not None]
    if any(f.joins for f in kept) and not (root and op == "AND"):
        raise Refused("a joining relation can stand at the root's AND only")
    pred = group(op, [f.pred for f in kept])
    return Related(pred, any(f.joins for f in kept)) if pred is not None else None


def relation_filters(ctx: Context, spec: Mapping[str, Any], remote_query: RemoteQuery) -> tuple[Pred | None, Pred | None, bool, bool]:
    """(relation bucket, in bucket, joins, refused) from ``relation`` and ``relation_query``.

    ``refused`` is a directive that empties the whole query, whatever else it asks for.
    """
    directive = spec.get("relation")
    joined, members = [], []
    if directive:
        clauses = [directive] if isinstance(directive, Mapping) and "name" in directive else directive
        try:
            if not isinstance(clauses, list | tuple):
                raise Refused("relation must be a clause or a list of clauses")
            for clause in clauses:
                if not isinstance(clause, Mapping) or not isinstance(clause.get("name"), str):
                    raise Refused("a relation clause needs a name")
                if strategy_of(ctx, clause) == "in":
                    members.append(build_in(ctx, clause, remote_query))
                else:
                    joined.append(clause)
        except Refused as reason:
            ctx.warn("relation", str(reason))
            return never(), None, False, True
    query = spec.get("relation_query")
    nodes = ([query] if query else []) + joined
    if not nodes:
        return None, group("AND", members), False, False
    try:
        found = relation_tree(ctx, nodes if len(nodes) > 1 else nodes[0])
    except Refused as reason:
        ctx.warn("relation", str(reason))
        return never(), group("AND", members), False, False
    return (found.pred if found else None), group("AND", members), bool(found and found.joins), False


def related(ctx: Context, df: DataFrame, name: str) -> DataFrame:
    """The remote rows related to the rows of ``df``, each with the base key as ``_base_{key}``.

    A many_to_many relation gives each pair once; rows with a null in a key part have
    no relations; a conditioned many_to_many gives nothing.
    """
    relation = ctx.table.relation(name)
    if relation is None:
        raise KeyError(f"unknown relation {name!r}")
    far = ctx.catalog.tables[relation.table]
    rows = ctx.catalog.frame(relation.table)
    if relation.type == "many_to_many" and relation.condition:
        return rows.limit(0)
    if relation.condition:
        rows = apply(rows, conditions(ctx.of(far), dict(relation.condition)))
    base_names = list(dict.fromkeys((*ctx.table.primary, *relation.columns)))
    base = df.select(*[F.col(c).alias(f"_base_{c}") for c in base_names])
    if relation.type != "many_to_many":
        on = [F.col(f"_base_{a}") == rows[b] for a, b in zip(relation.columns, relation.references, strict=True)]
        return base.join(rows, on)
    pivot = ctx.catalog.frame(relation.through)
    names = [f"_qw_t{i}" for i in range(len(relation.references))]
    links = base.join(pivot, [F.col(f"_base_{a}") == pivot[b] for a, b in zip(relation.columns, relation.through_columns, strict=True)])
    links = links.select(*base.columns, *[pivot[c].alias(n) for c, n in zip(relation.through_references, names, strict=True)]).distinct()
    return links.join(rows, [F.col(n) == rows[r] for n, r in zip(names, relation.references, strict=True)]).drop(*names)


def prefetch(ctx: Context, df: DataFrame, name: str, most: int | None = None, shown: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """``df`` with the related rows of each row as an array of structs in a column named like the relation.

    Remote rows are gathered by key before the join; ``most`` bounds how many a row
    takes (the smallest by primary key).  Without it a row holds all of its relations,
    so where one key may have more than a row can hold, ask for ``most`` or read
    ``related``, which gives them as rows.  ``shown`` leaves out remote columns that may
    not be read.
    """
    relation = ctx.table.relation(name)
    keys = list(dict.fromkeys((*ctx.table.primary, *relation.columns)))
    pairs = related(ctx, df.select(*keys).distinct(), name)
    base = [f"_base_{k}" for k in keys]
    remote = [c for c in pairs.columns if c not in base]
    item = F.struct(*(shown(pairs.select(*remote), relation.table).columns if shown else remote))
    if most is None:
        gathered = pairs.groupBy(*base).agg(F.sort_array(F.collect_list(item)).alias(name))
    else:
        from pyspark.sql import Window

        order = ctx.catalog.tables[relation.table].primary or tuple(remote)
        ranked = pairs.withColumn("_qw_rank", F.row_number().over(Window.partitionBy(*base).orderBy(*order))).where(F.col("_qw_rank") <= most)
        gathered = ranked.groupBy(*base).agg(F.sort_array(F.collect_list(item)).alias(name))
    same = [df[k].eqNullSafe(gathered[f"_base_{k}"]) for k in keys]
    kind = gathered.schema[name].dataType
    return df.join(gathered, same, "left").drop(*base).withColumn(name, F.coalesce(F.col(name), F.array().cast(kind)))


def integrity(ctx: Context, name: str, rows: DataFrame | None = None) -> DataFrame:
    """Rows whose foreign key refers to nothing; a null key refers to nothing by right and is left out."""
    relation = ctx.table.relation(name)
    df = ctx.catalog.frame(ctx.table.name) if rows is None else rows
    for c in relation.columns:
        df = df.where(F.col(c).isNotNull())
    remote = ctx.catalog.frame(relation.table)
    return apply(df, Exists(remote, tuple(zip(relation.columns, relation.references, strict=True)), negate=True))


