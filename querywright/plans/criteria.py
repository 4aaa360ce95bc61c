"""Boolean algebra over the buckets that the filter families of a query fill."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from querywright.plans.context import Context, Refused
from querywright.plans.pred import Pred, group, never

BUCKETS = ("by", "in", "not_in", "search", "date", "meta", "compare", "relation")
ALIASES = {"columns": "by"}


@dataclass
class Bucket:
    pred: Pred | None = None
    joins: bool = False


def combine_buckets(ctx: Context, buckets: Mapping[str, Bucket], tree: Any) -> Pred | None:
    """All buckets by AND, or as ``criteria`` says; buckets it does not name are joined on by AND.

    Groups are ``{"relation": .., "not": .., "items": [..]}``; items are bucket names and
    groups.  A tree that is malformed, or that puts a joining bucket under OR, XOR or
    NOT, matches nothing.
    """
    if tree is None or tree == []:
        return group("AND", [b.pred for b in buckets.values()])
    named: set[str] = set()

    def build(node: Any, unsafe: bool) -> Pred | None:
        if isinstance(node, list | tuple):
            node = {"items": list(node)}
        if not isinstance(node, Mapping):
            raise Refused("a criteria group must be a dictionary or a list")
        op = node.get("relation", "AND")
        if not isinstance(op, str) or op.upper() not in ("AND", "OR", "XOR"):
            raise Refused(f"criteria relation {op!r}")
        negate = bool(node.get("not"))
        unsafe = unsafe or op.upper() != "AND" or negate
        items = node.get("items", [])
        if not isinstance(items, list | tuple) or not items:
            raise Refused("a criteria group without items")
        parts = []
        for item in items:
            if isinstance(item, str):
                name = ALIASES.get(item, item)
                if name not in buckets:
                    raise Refused(f"criteria name an unknown bucket {item!r}")
                if unsafe and buckets[name].joins:
                    raise Refused(f"criteria cannot combine the joining bucket {item!r} so")
                named.add(name)
                parts.append(buckets[name].pred)
            elif isinstance(item, Mapping | list | tuple):
                parts.append(build(item, unsafe))
            else:
                raise Refused("a criteria item must be a bucket's name or a group")
        return group(op.upper(), parts, negate)

    try:
        whole = build(tree, False)
    except Refused as reason:
        ctx.warn("criteria", str(reason))
        return never()
    return group("AND", [whole, *(b.pred for n, b in buckets.items() if n not in named)])
