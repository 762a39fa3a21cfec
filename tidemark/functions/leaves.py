"""Flattening JSON payloads into scalar leaves, entirely inside one row.

The payload is parsed once to VARIANT and unfolded level by level with array
functions, so no shuffle, join or Python is needed; de-duplication and caps per
event are array functions too. Object keys come in sorted order, which makes
the order of leaves (and thus the caps) deterministic.

Paths: nested keys join with dots; a scalar inside an array repeats the array's
path; an object or array inside an array adds ``[]``. Leaves below an object in
an array carry the array's path and the element's index as their scope.

The builders give SQL text in which every intermediate array is named once, by
a lambda variable. Plain column references would let the optimizer repeat the
whole computation wherever a column is used twice.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Levels unfolded by the expression itself; deeper rows go on in a loop.
UNROLLED = 10

_NODE = "struct<path:string,slot:int,scope_path:string,scope_index:int,value:variant,open:boolean>"


def bind(value: str, name: str, body: str) -> str:
    """SQL that evaluates ``value`` once and uses it as ``name`` in ``body``."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _unfold(n: str) -> str:
    """SQL for the children of node ``n``, or the node itself when it is a leaf.

    ``slot`` is the index within the enclosing array (-1 for object members); the
    ``[]`` is added once the element turns out to be a container.
    """
    base = f"concat({n}.path, if({n}.slot >= 0, '[]', ''))"
    scope_path = f"if({n}.slot >= 0, {n}.path, {n}.scope_path)"
    scope_index = f"if({n}.slot >= 0, {n}.slot, {n}.scope_index)"
    members = f"try_variant_get({n}.value, '$', 'map<string,variant>')"
    elements = f"try_variant_get({n}.value, '$', 'array<variant>')"
    prefix = f"if({n}.path = '', '', concat({base}, '.'))"
    as_member = (
        f"named_struct('path', concat({prefix}, e.key), 'slot', -1, 'scope_path', {scope_path},"
        f" 'scope_index', {scope_index}, 'value', e.value, 'open', true)"
    )
    as_element = (
        f"named_struct('path', {base}, 'slot', i, 'scope_path', {n}.scope_path,"
        f" 'scope_index', {n}.scope_index, 'value', v, 'open', true)"
    )
    leaf = (
        f"array(named_struct('path', {n}.path, 'slot', {n}.slot, 'scope_path', {n}.scope_path,"
        f" 'scope_index', {n}.scope_index, 'value', {n}.value, 'open', false))"
    )
    return (
        f"if(not {n}.open, array({n}), coalesce("
        f"transform(map_entries({members}), e -> {as_member}),"
        f"transform({elements}, (v, i) -> {as_element}),"
        f"{leaf}))"
    )


_VALUE_TYPE = (
    "case when n.kind = 'STRING' then 'string' when n.kind = 'VOID' then 'null'"
    " when n.kind = 'BOOLEAN' then 'bool' when startswith(n.kind, 'OBJECT') then 'object'"
    " when startswith(n.kind, 'ARRAY') then 'array' else 'number' end"
)
_STRING_VALUE = "if(n.kind = 'STRING', cast(n.value as string), '')"
_INDEX_ROW = (
    f"named_struct('path', n.path, 'value_type', {_VALUE_TYPE}, 'string_value', {_STRING_VALUE},"
    " 'number_value', if(n.kind in ('VOID', 'STRING', 'BOOLEAN'), cast(null as double),"
    " try_cast(n.value as double)),"
    " 'bool_value', if(n.kind = 'BOOLEAN', cast(n.value as boolean), cast(null as boolean)),"
    " 'scope_path', n.scope_path, 'scope_index', n.scope_index)"
)
_TEXT_ROW = (
    "named_struct('path', n.path, 'text', if(n.kind = 'VOID', 'null', cast(n.value as string)))"
)
_PATH_ROW = (
    f"named_struct('path', n.path, 'value_type', {_VALUE_TYPE}, 'blank', {_STRING_VALUE} = ''"
    " and n.kind = 'STRING', 'in_array', n.slot >= 0 or contains(n.path, '[]'))"
)
_CONTAINER = "(startswith(n.kind, 'OBJECT') or startswith(n.kind, 'ARRAY'))"


_NODES = f"array<{_NODE}>"


def depth_sql(payload: str) -> str:
    """SQL for how deep a payload may be nested, at least 1.

    A payload with few opening brackets is no deeper than their number; of others the
    brackets outside of strings are walked once, so a wide payload is not taken for a deep one.
    """
    count = f"length(`{payload}`) - length(translate(`{payload}`, '{{[', ''))"
    strings = r"""'"(?:[^"\\\\]|\\\\.)*+"'"""
    only = rf"regexp_replace(regexp_replace(`{payload}`, {strings}, ''), '[^\\[\\]{{}}]+', '')"
    walked = (
        f"aggregate(split({only}, ''), named_struct('now', 0, 'most', 0), (d, c) -> if(c in ('{{', '['),"
        " named_struct('now', d.now + 1, 'most', greatest(d.most, d.now + 1)),"
        " named_struct('now', d.now - 1, 'most', d.most))).most"
    )
    return f"greatest(if({count} <= {2 * UNROLLED}, {count}, {walked}), 1)"


def _open(nodes: str) -> str:
    return f"exists({nodes}, n -> n.open)"


def _opened(nodes: str) -> str:
    return f"cast(flatten(transform({nodes}, n -> {_unfold('n')})) as {_NODES})"


def _kinds_sql(payload: str, depth: int | None) -> str:
    """SQL for the unfolded nodes with their type names, of all levels without ``depth``."""
    nodes = (
        f"if(`{payload}` is null, cast(array() as {_NODES}),"
        f" array(cast(struct('', -1, '', -1, try_parse_json(`{payload}`), true) as {_NODE})))"
    )
    for level in range(UNROLLED if depth is None else min(depth, UNROLLED)):
        # One more level only for the rows that still have open containers.
        s = f"s{level}"
        nodes = bind(nodes, s, f"if({_open(s)}, {_opened(s)}, {s})")
    if depth is None or depth > UNROLLED:
        # Further levels in a loop, as many rounds as the row is deep, so that no other row need
        # be looked at.
        work = f"struct<nodes:{_NODES},more:boolean>"
        rounds = depth_sql(payload) if depth is None else str(int(depth) - UNROLLED)
        step = bind(_opened("w.nodes"), "u", f"cast(struct(u, {_open('u')}) as {work})")
        loop = f"aggregate(sequence(1, {rounds}), cast(struct(deep, true) as {work}), (w, level) -> if(w.more, {step}, w))"
        nodes = bind(nodes, "deep", f"if({_open('deep')}, {loop}.nodes, deep)")
    return (
        f"transform({nodes}, n -> named_struct('path', n.path, 'slot', n.slot,"
        " 'scope_path', n.scope_path, 'scope_index', n.scope_index, 'value', n.value,"
        " 'kind', coalesce(schema_of_variant(n.value), 'VOID')))"
    )


def _scalars_sql(payload: str, depth: int | None, row: str, where: str = "true") -> str:
    kept = f"n -> n.path <> '' and not {_CONTAINER} and {where}"
    return f"transform(filter({_kinds_sql(payload, depth)}, {kept}), n -> {row})"


def index_rows(
    max_rows: int | None = None,
    max_string: int | None = None,
    payload: str = "data",
    depth: int | None = None,
) -> Column:
    """Leaves as rows of the scalar index, repeats removed; all of them unless the caller
    skips strings over ``max_string`` bytes or keeps ``max_rows`` in key order.

    Structs (path, value_type, string_value, number_value, bool_value, scope_path,
    scope_index).
    """
    fits = "true"
    if max_string is not None:
        fits = f"(n.kind <> 'STRING' or octet_length(cast(n.value as string)) <= {int(max_string)})"
    rows = f"array_distinct({_scalars_sql(payload, depth, _INDEX_ROW, fits)})"
    return F.expr(rows if max_rows is None else f"slice({rows}, 1, {int(max_rows)})")


def text_terms(payload: str = "data", depth: int | None = None) -> Column:
    """Leaves as (path, text) in key order, repeats included."""
    return F.expr(_scalars_sql(payload, depth, _TEXT_ROW))


def scalar_paths(payload: str = "data", depth: int | None = None) -> Column:
    """Leaves as (path, value_type, blank, in_array)."""
    return F.expr(_scalars_sql(payload, depth, _PATH_ROW))


def containers_left(payload: str = "data", depth: int = UNROLLED) -> Column:
    """Number of non-empty containers nested deeper than ``depth``."""
    left = f"n -> {_CONTAINER} and n.kind not in ('OBJECT<>', 'ARRAY<VOID>')"
    return F.expr(f"size(filter({_kinds_sql(payload, depth)}, {left}))")


def first_of_each(rows: str, keys: str) -> str:
    """SQL for the elements of an array that are the first of theirs by ``keys`` (of ``r``).

    Sorted with their places, equal ones are neighbours: no element meets all others.
    """
    placed = f"array_sort(transform({rows}, (r, i) -> struct(struct({keys}) as key, i as place, r as row)))"
    kept = bind(placed, "q", "filter(q, (x, i) -> coalesce(get(q, i - 1).key <> x.key, true))")
    return f"transform({kept}, x -> x.row)"
