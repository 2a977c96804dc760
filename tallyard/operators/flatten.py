"""Nested records as related flat tables.

The schema is read as paths; a path belongs to its nearest repeated ancestor (array or
map). One pass over a record turns it into path-value-ordinal triples: for every element
of every repeated ancestor (a node) the ordinals that lead to it and the pairs of path and
value below it. Nodes are grouped by ancestor, and the pairs of a group are pivoted into
the columns of its table. All triples of one row stand in one node, so the pivot needs no
shuffle, however large one record or one array is, and however many tables are asked for
the records are scanned once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyard.durable import materialise

ROOT = ""


@dataclass
class Group:
    """A repeated ancestor: its path, the repeated ancestors above it, and the scalar paths below it."""

    path: str
    above: tuple[str, ...]
    leaves: list[tuple[str, ...]] = field(default_factory=list)
    scalar: bool = False


def path_groups(schema: T.StructType) -> dict[str, Group]:
    """Scalar paths of ``schema`` grouped by repeated ancestor; the record itself is group ''."""
    groups = {ROOT: Group(ROOT, ())}

    def visit(kind: T.DataType, group: str, within: tuple[str, ...]) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                visit(f.dataType, group, (*within, f.name))
        elif isinstance(kind, (T.ArrayType, T.MapType)):
            child = ".".join([*filter(None, [group]), *within]) or group + "[]"
            if child in groups:
                child += "[]"
            groups[child] = Group(child, (*groups[group].above, group), scalar=not isinstance(getattr(kind, "elementType", None), T.StructType) and isinstance(kind, T.ArrayType))
            groups[child].within = within  # type: ignore[attr-defined]
            if isinstance(kind, T.MapType):
                visit(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)]), child, ())
            else:
                visit(kind.elementType, child, ())
        else:
            groups[group].leaves.append(within)

    visit(schema, ROOT, ())
    return groups


def _get(base: Column | None, within: tuple[str, ...]) -> Column:
    if base is None:
        return reduce(lambda c, f: c.getField(f), within[1:], F.col(f"`{within[0]}`"))
    return reduce(lambda c, f: c.getField(f), within, base)


def _unique(names: list[str]) -> list[str]:
    seen: set[str] = set()
    out = []
    for n in names:
        while n.lower() in seen:
            n += "_"
        seen.add(n.lower())
        out.append(n)
    return out


_CELL = "array<struct<path:string,value:string>>"
_NODE = f"array<struct<group:string,ordinals:array<int>,cells:{_CELL}>>"


def _text(c: Column, kind: T.DataType) -> Column:
    return F.base64(c) if isinstance(kind, T.BinaryType) else c.cast("string")


def _typed(c: Column, kind: T.DataType) -> Column:
    return F.unbase64(c) if isinstance(kind, T.BinaryType) else c.cast(kind)


def _cell(path: str) -> Column:
    return F.get(F.filter("cells", lambda c: c["path"] == path), 0)["value"]


def _element(schema: T.StructType, groups: dict[str, Group], g: Group) -> T.DataType:
    """The type of one element of a repeated ancestor; the record's own for the root."""
    if g.path == ROOT:
        return schema
    kind = _source_type(schema, groups, g)
    return kind.elementType if isinstance(kind, T.ArrayType) else T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])  # type: ignore[attr-defined]


def _leaf_type(kind: T.DataType, leaf: tuple[str, ...]) -> T.DataType:
    for f in leaf:
        kind = kind[f].dataType  # type: ignore[index]
    return kind


def nodes(df: DataFrame, key: list[str], ordinal_from: dict[str, str] | None = None, only: set[str] | None = None, columns: dict[str, list[str]] | None = None) -> DataFrame:
    """``key``, group, ordinals (array<int>), cells (array of path and value): one row per node, from one pass over ``df``.

    The record itself is a node of group ''. ``only`` restricts the groups, ``columns`` the
    paths of a group (names with ``__``). Null and empty arrays have no nodes; a null
    element is a node of nulls. ``ordinal_from`` as in ``unnest``.
    """
    schema, groups, ordinal_from = df.schema, path_groups(df.schema), ordinal_from or {}
    wanted = {p for p in groups if only is None or p in only}
    children = {p: [c for c in groups.values() if c.path != ROOT and c.above[-1] == p] for p in groups}
    leads = {p for p in groups if p in wanted or any(p in groups[w].above for w in wanted)}

    def step(child: Group, ordinals: list[Column]) -> Callable[[Column, Column], Column]:
        def one(x: Column, pos: Column) -> Column:
            place = F.coalesce(x.getField(ordinal_from[child.path]), pos) if child.path in ordinal_from else pos
            return below(child, x, [*ordinals, place.cast("int")])

        return one

    def below(g: Group, el: Column | None, ordinals: list[Column]) -> Column:
        kind, parts = _element(schema, groups, g), []
        if g.path in wanted:
            allowed = None if columns is None else columns.get(g.path, [])
            leaves = [x for x in g.leaves if not (g.path == ROOT and len(x) == 1 and x[0] in key) and (allowed is None or "__".join(x) in allowed)]
            cells = [F.struct(F.lit("__".join(x) or "value").alias("path"), _text(_get(el, x) if x else el, _leaf_type(kind, x)).alias("value")) for x in leaves]
            at = F.array(*ordinals) if ordinals else F.array().cast("array<int>")
            own = F.struct(F.lit(g.path).alias("group"), at.alias("ordinals"), (F.array(*cells) if cells else F.array().cast(_CELL)).alias("cells"))
            parts.append(F.array(own))
        for child in children[g.path]:
            if child.path not in leads:
                continue
            arr = _get(el, child.within)  # type: ignore[attr-defined]
            if isinstance(_source_type(schema, groups, child), T.MapType):
                arr = F.map_entries(arr)

            parts.append(F.coalesce(F.flatten(F.transform(arr, step(child, ordinals))), F.array().cast(_NODE)))
        return parts[0] if len(parts) == 1 else F.concat(*parts)

    return df.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(key)], F.inline(below(groups[ROOT], None, [])))


def unnest(df: DataFrame, key: list[str], path: str, ordinal_from: dict[str, str] | None = None, columns: list[str] | None = None, of: DataFrame | None = None) -> DataFrame:
    """The flat table of the repeated ancestor ``path``, pivoted from its nodes (``of``, or a pass of its own).

    Columns: ``key``, one zero-based ``<ancestor>#`` ordinal per repeated ancestor,
    then the scalars below it, named by their path with ``__`` (a clash gets a
    trailing ``_``). ``ordinal_from`` names, per ancestor, an integer field that
    replaces the place in the array where it isn't null. Null and empty arrays give
    no rows; a null element gives a row of nulls. ``columns`` prunes the scalars.
    """
    groups = path_groups(df.schema)
    g = groups[path]
    leaves = [x for x in g.leaves if (columns is None or "__".join(x) in columns) and not (path == ROOT and len(x) == 1 and x[0] in key)]
    if of is None:
        of = nodes(df, key, ordinal_from, {path}, {path: ["__".join(x) for x in leaves]})
    chain = [p for p in (*g.above, path) if p != ROOT]
    names = _unique([*key, *[f"{p}#" for p in chain], *["__".join(x) or "value" for x in leaves]])
    kind = _element(df.schema, groups, g)
    pivoted = [_typed(_cell("__".join(x) or "value"), _leaf_type(kind, x)) for x in leaves]
    out = [*[F.col(f"k{i}") for i in range(len(key))], *[F.get("ordinals", F.lit(i)) for i in range(len(chain))], *pivoted]
    return of.where(F.col("group") == path).select(*[c.alias(n) for c, n in zip(out, names)])


def skeleton(schema: T.StructType, key: list[str], ordinal_from: dict[str, str] | None = None, columns: dict[str, list[str]] | None = None) -> T.StructType:
    """``schema`` with only what the nodes need: keys, repeated ancestors, ordinals, the named paths, and one narrow scalar where a group has no other.

    A scan with this schema reads no other column, also below arrays.
    """
    columns, ordinal_from = columns or {}, ordinal_from or {}
    groups = path_groups(schema)
    wide = (T.StringType, T.BinaryType)

    def keep(kind: T.DataType, group: str, within: tuple[str, ...]) -> T.DataType | None:
        if isinstance(kind, T.StructType):
            fields = [(f, keep(f.dataType, group, (*within, f.name))) for f in kind.fields]
            held = [T.StructField(f.name, k, f.nullable) for f, k in fields if k is not None]
            return T.StructType(held) if held else None
        if isinstance(kind, (T.ArrayType, T.MapType)):
            child = next(g for g in groups.values() if g.path != ROOT and g.above[-1] == group and g.within == within)  # type: ignore[attr-defined]
            if isinstance(kind, T.MapType):
                return kind
            inner = keep(kind.elementType, child.path, ())
            if inner is None and isinstance(kind.elementType, T.StructType):
                narrow = [x for x in child.leaves if not isinstance(_leaf_type(kind.elementType, x), wide)] or child.leaves
                inner = T.StructType([T.StructField(narrow[0][0], _only(kind.elementType[narrow[0][0]].dataType, narrow[0][1:]))]) if narrow else kind.elementType
            return T.ArrayType(inner or kind.elementType, kind.containsNull)
        named = group == ROOT and len(within) == 1 and within[0] in key
        return kind if named or "__".join(within) in columns.get(group, ()) or within == (ordinal_from.get(group),) else None

    return keep(schema, ROOT, ())  # type: ignore[return-value]


def _only(kind: T.DataType, path: tuple[str, ...]) -> T.DataType:
    """``kind`` with nothing but one path below it."""
    return T.StructType([T.StructField(path[0], _only(kind[path[0]].dataType, path[1:]))]) if path else kind  # type: ignore[index]


def _source_type(schema: T.StructType, groups: dict[str, Group], g: Group) -> T.DataType:
    kind: T.DataType = schema
    for p in (*g.above, g.path):
        if p == ROOT:
            continue
        for f in groups[p].within:  # type: ignore[attr-defined]
            kind = kind[f].dataType  # type: ignore[index]
        if p == g.path:
            return kind
        kind = kind.elementType if isinstance(kind, T.ArrayType) else T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])  # type: ignore[attr-defined]
    return kind


def shred(df: DataFrame, key: list[str], ordinal_from: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """All flat tables of ``df`` by repeated ancestor, '' for the records; the nodes are made in one pass and written."""
    of = materialise(nodes(df, key, ordinal_from), "nodes")
    return {p: unnest(df, key, p, ordinal_from, of=of) for p in path_groups(df.schema)}


def triples(df: DataFrame, key: list[str], ordinal_from: dict[str, str] | None = None) -> DataFrame:
    """Long form: ``key``, group, ordinals (array<int>), path, value (string); one row per scalar, nulls included."""
    return nodes(df, key, ordinal_from).select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(key)], "group", "ordinals", F.inline("cells"))
