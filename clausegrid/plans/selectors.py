"""Selectors: which sections, or which nodes of a JSON document, a rule looks at.

JSONPath subset: ``$ .field [n] [*] [?(@.a.b op literal)]`` with one comparison in a filter
(``== != < <= > >= =~``). A field that is missing fails every comparison; what is no number
sorts below all numbers; ``=~`` is an unanchored, case-sensitive search in strings.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEP = re.compile(r"\.(?P<field>[A-Za-z_]\w*)|\[(?P<index>\d+)\]|(?P<all>\[\*\])|\[\?\((?P<filter>.*?)\)\]")
_FILTER = re.compile(r"^\s*@\.(?P<path>[A-Za-z_][\w.]*)\s*(?P<op>==|!=|<=|>=|=~|<|>)\s*(?P<lit>.+?)\s*$")
_NUMERIC = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT", "DECIMAL")


@dataclass(frozen=True)
class Compare:
    path: str
    op: str
    value: object


def parse_literal(text: str):
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    if text in ("true", "false", "null"):
        return {"true": True, "false": False, "null": None}[text]
    try:
        return int(text)
    except ValueError:
        return float(text)


def parse_filter(text: str) -> Compare:
    m = _FILTER.match(text)
    if not m:
        raise ValueError(f"cannot read filter {text!r}")
    return Compare(m["path"], m["op"], parse_literal(m["lit"]))


def parse_path(path: str) -> list[tuple[str, object]]:
    if not path.startswith("$"):
        raise ValueError(f"path {path!r} does not start with $")
    out, at = [], 1
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            raise ValueError(f"cannot read {path[at:]!r}")
        kind = m.lastgroup
        out.append((kind, int(m[kind]) if kind == "index" else parse_filter(m[kind]) if kind == "filter" else m[kind]))
        at = m.end()
    return out


def _ordered(op: str, left: Column, right: Column) -> Column:
    """Comparison of doubles in which NaN (no number) is below all numbers and equal to itself."""
    below = F.isnan(left) & ~F.isnan(right)
    same = (left == right) | (F.isnan(left) & F.isnan(right))
    above = ~below & ~same & (F.isnan(right) | (left > right))
    less = below | (~F.isnan(left) & ~F.isnan(right) & (left < right))
    return {"<": less, "<=": less | same, ">": above, ">=": above | same}[op]


def compare_json(value: Column, c: Compare) -> Column:
    """``value``: a variant, null where the field is missing."""
    kind = F.schema_of_variant(value)
    present = value.isNotNull()
    is_null = F.is_variant_null(value)
    number = F.when(kind.rlike("^(" + "|".join(_NUMERIC) + ")"), F.try_variant_get(value, "$", "double")).otherwise(F.lit(float("nan")))
    text = F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))
    if c.op == "=~":
        return present & F.coalesce(F.regexp_like(text, F.lit(str(c.value))), F.lit(False))
    if c.op in ("==", "!="):
        if c.value is None:
            same = is_null
        elif isinstance(c.value, bool):
            same = (kind == "BOOLEAN") & F.coalesce(F.try_variant_get(value, "$", "boolean") == c.value, F.lit(False))
        elif isinstance(c.value, str):
            same = F.coalesce(text == c.value, F.lit(False))
        else:
            same = F.coalesce(number == float(c.value), F.lit(False))
        return F.coalesce(present & (same if c.op == "==" else ~same), F.lit(False))
    right = F.lit(float(c.value)) if isinstance(c.value, (int, float)) and not isinstance(c.value, bool) else F.lit(float("nan"))
    return F.coalesce(present & _ordered(c.op, number, right), F.lit(False))


def _node(path: Column, node: Column) -> Column:
    return F.struct(path.alias("path"), node.alias("node"))


_NONE = "array<struct<path:string,node:variant>>"


def _spread(at: Column) -> Column:
    """The items of array nodes, each with its index in its path."""
    item = lambda x: lambda v, i: _node(F.concat(x["path"], F.lit("["), i.cast("string"), F.lit("]")), v)
    own = lambda x: F.coalesce(F.transform(F.try_variant_get(x["node"], "$", "array<variant>"), item(x)), F.array().cast(_NONE))
    return F.flatten(F.transform(at, own))


def _take(at: Column, kind: str, what) -> Column:
    """One step of a path. The lambdas take one argument each: a second one would be an index."""
    if kind == "field":
        return F.transform(at, lambda x: _node(F.concat(x["path"], F.lit(f".{what}")), F.try_variant_get(x["node"], f"$.{what}", "variant")))
    items = _spread(at)
    if kind == "index":
        return F.filter(items, lambda x: F.endswith(x["path"], F.lit(f"[{what}]")))
    if kind == "filter":
        return F.filter(items, lambda x: compare_json(F.try_variant_get(x["node"], f"$.{what.path}", "variant"), what))
    return items


def in_order(nodes: Column) -> Column:
    """Nodes by the order of their paths as texts: ``[10]`` stands before ``[2]``."""
    return F.array_sort(nodes, lambda a, b: F.when(a["path"] < b["path"], -1).when(a["path"] > b["path"], 1).otherwise(0))


def json_matches(doc: Column, path: str) -> Column:
    """array<struct<path, node variant>> of the non-null nodes that a path selects in a variant, in order."""
    at = F.array(_node(F.lit("$"), doc))
    for kind, what in parse_path(path):
        at = F.filter(_take(at, kind, what), lambda x: x["node"].isNotNull())
    return in_order(F.filter(at, lambda x: ~F.is_variant_null(x["node"])))


#: Levels of a document that ``leaves`` goes into; a deeper one stops the job.
DEEPEST = 64


def leaves(doc: Column) -> Column:
    """array<struct<path, node variant>> of all values that are neither objects nor arrays nor null, in order."""
    item = lambda path, node, done: F.struct(path.alias("path"), node.alias("node"), F.lit(done).alias("done"))
    there = lambda nodes: F.filter(nodes, lambda k: k["node"].isNotNull() & ~F.coalesce(F.is_variant_null(k["node"]), F.lit(True)))

    def opened(x: Column) -> Column:
        fields, items = F.try_variant_get(x["node"], "$", "map<string,variant>"), F.try_variant_get(x["node"], "$", "array<variant>")
        of_fields = F.transform(F.map_entries(fields), lambda e: item(F.concat(x["path"], F.lit("."), e["key"]), e["value"], False))
        of_items = F.transform(items, lambda v, i: item(F.concat(x["path"], F.lit("["), i.cast("string"), F.lit("]")), v, False))
        return F.when(x["done"], F.array(x)).when(fields.isNotNull(), there(of_fields)).when(items.isNotNull(), there(of_items)).otherwise(F.array(item(x["path"], x["node"], True)))

    found = F.aggregate(F.sequence(F.lit(0), F.lit(DEEPEST)), there(F.array(item(F.lit("$"), doc, False))), lambda at, _: F.flatten(F.transform(at, opened)))
    plain = F.transform(found, lambda x: F.when(x["done"], _node(x["path"], x["node"])).otherwise(F.raise_error(F.lit(f"nested deeper than {DEEPEST} levels")).cast("struct<path:string,node:variant>")))
    return in_order(plain)


def has_field(doc: Column, path: str, name: str) -> Column:
    """Nodes of ``path`` that have the key, a null under it included."""
    return F.filter(json_matches(doc, path), lambda x: F.try_variant_get(x["node"], f"$.{name}", "variant").isNotNull())


def value_in(doc: Column, path: str, values: list) -> Column:
    """Nodes of ``path`` equal to one of the values."""
    def one(x):
        hit = F.lit(False)
        for v in values:
            hit = hit | compare_json(x["node"], Compare("", "==", v))
        return hit

    return F.filter(json_matches(doc, path), one)


def regex_nodes(doc: Column, path: str | None, pattern: str) -> Column:
    """String nodes of ``path``, or string leaves anywhere without one, in which the pattern is found."""
    return F.filter(json_matches(doc, path) if path else leaves(doc), lambda x: compare_json(x["node"], Compare("", "=~", pattern)))


def _has_path(nodes: Column, path: Column) -> Column:
    return F.exists(nodes, lambda y: y["path"] == path)


def _shared(a: Column, b: Column, wanted: bool) -> Column:
    return F.filter(a, lambda x: _has_path(b, x["path"]) == F.lit(wanted))


def select_all(*parts: Column) -> Column:
    """Nodes, as the first part has them, whose paths all parts select; none without parts."""
    out = parts[0] if parts else F.array().cast(_NONE)
    for p in parts[1:]:
        out = _shared(out, p, True)
    return out


def select_any(*parts: Column) -> Column:
    """Nodes of all parts in order, each path once, the first part's node winning."""
    out = parts[0] if parts else F.array().cast(_NONE)
    for p in parts[1:]:
        out = F.concat(out, _shared(p, out, False))
    return in_order(out)


def select_not(doc: Column, excluded: Column) -> Column:
    """The document's leaves whose paths ``excluded`` does not hold: for use inside ``select_all``."""
    return _shared(leaves(doc), excluded, False)


def span_of(path: Column, spans: Column) -> Column:
    """The value of the nearest path upwards that ``spans`` (map<path, span>) holds, the root's at last; else null."""
    steps = F.regexp_extract_all(path, F.lit(r"(^\$|\.[^.\[]+|\[[0-9]+\])"), F.lit(1))
    above = F.transform(F.sequence(F.lit(0), F.greatest(F.size(steps) - 1, F.lit(0))), lambda k: F.array_join(F.slice(steps, F.lit(1), F.size(steps) - k), ""))
    return F.get(F.filter(F.transform(above, lambda p: F.try_element_at(spans, p)), lambda v: v.isNotNull()), F.lit(0))


# ---- sections: the same language on typed rows, one row a section ----


def compare_column(value: Column, c: Compare) -> Column:
    """One filter comparison on a typed column; null is missing."""
    if c.op == "=~":
        made = F.regexp_like(value.cast("string"), F.lit(str(c.value)))
    elif c.op in ("==", "!="):
        made = (value == F.lit(c.value)) if c.op == "==" else (value != F.lit(c.value))
    elif isinstance(c.value, (int, float)):
        number = F.coalesce(value.try_cast("double") if hasattr(value, "try_cast") else value.cast("double"), F.lit(float("nan")))
        made = value.isNotNull() & _ordered(c.op, number, F.lit(float(c.value)))
    else:
        made = value.isNotNull() & _ordered(c.op, F.lit(float("nan")), F.lit(float("nan")))
    return F.coalesce(made, F.lit(False))


def section_selector(selector: dict | None, member, ord_col: Column) -> Column:
    """Whether a section row is selected. ``member`` gives a section's column by dotted path.

    ``not`` selects leaves and never a section, so under ``all`` with a section path it leaves nothing."""
    if not selector:
        return F.lit(True)
    kind = selector["kind"]
    if kind in ("all", "any"):
        parts = [section_selector(s, member, ord_col) for s in selector.get("of", ())]
        out = F.lit(kind == "all" and bool(parts))
        for p in parts:
            out = (out & p) if kind == "all" else (out | p)
        return out
    if kind == "not":
        return F.lit(False)
    steps = parse_path(selector.get("path") or "$.sections[*]")
    if not steps or steps[0] != ("field", "sections") or len(steps) < 2:
        return F.lit(False)
    pick, what = steps[1]
    out = {"all": lambda: F.lit(True), "index": lambda: ord_col == what, "filter": lambda: compare_column(member(what.path), what)}[pick]()
    rest = ".".join(str(w) for k, w in steps[2:] if k == "field")
    value = member(rest) if rest else None
    if kind == "path":
        return out if value is None else out & value.isNotNull()
    if kind == "regex":
        hay = value if value is not None else member("text")
        return out & F.coalesce(F.regexp_like(hay, F.lit(selector["pattern"])), F.lit(False))
    if kind == "hasField":
        return out & F.lit(member(selector["field"]) is not None)
    if kind == "valueIn":
        return out & F.coalesce((value if value is not None else member("text")).isin(*selector["values"]), F.lit(False))
    raise ValueError(f"unknown selector {kind!r}")
