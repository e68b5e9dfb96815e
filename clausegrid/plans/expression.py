"""The rule language: parsed once, then printed as a Catalyst column, as SQL, or run on one Python value.

    expr   := or ;  or := and ('||' and)* ;  and := not ('&&' not)*
    cmp    := unary (('=='|'!='|'<='|'>='|'<'|'>') unary)?
    unary  := '!' unary | '-' unary | postfix
    postfix:= primary ('.' name ['(' args ')'])*
    primary:= literal | name | Name '(' args ')' | '(' expr ')'

A comparison with something missing is false (``!= null`` asks whether it is there), so that
every predicate is true or false; ``Contains`` is a substring test on text and membership on
arrays. Functions are looked up in the environment, which is where errors of a rule (an
unknown function, a bad pattern) surface, before any data is read.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


class RuleError(ValueError):
    """The rule's text is at fault, not the data."""


@dataclass(frozen=True)
class Lit:
    value: object


@dataclass(frozen=True)
class Path:
    names: tuple[str, ...]


@dataclass(frozen=True)
class Call:
    name: str
    target: object | None
    args: tuple


@dataclass(frozen=True)
class Op:
    name: str
    parts: tuple


_TOKEN = re.compile(r'\s*(?:(?P<num>\d+(?:\.\d+)?)|(?P<str>"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_]\w*)|(?P<op>&&|\|\||==|!=|<=|>=|[<>!().,\-]))')
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise RuleError(f"cannot read {text[at:at + 20]!r} at {at}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Parser:
    def __init__(self, text: str):
        self.toks, self.at = tokens(text), 0

    def peek(self) -> str | None:
        return self.toks[self.at][1] if self.at < len(self.toks) and self.toks[self.at][0] == "op" else None

    def take(self, *ops: str) -> str | None:
        if self.peek() in ops and self.peek() is not None:
            self.at += 1
            return self.toks[self.at - 1][1]
        return None

    def need(self, op: str) -> None:
        if not self.take(op):
            raise RuleError(f"expected {op!r}")

    def chain(self, below: Callable, op: str):
        parts = [below()]
        while self.take(op):
            parts.append(below())
        return parts[0] if len(parts) == 1 else Op(op, tuple(parts))

    def expr(self):
        return self.chain(lambda: self.chain(self.comparison, "&&"), "||")

    def comparison(self):
        left = self.unary()
        op = self.take("==", "!=", "<=", ">=", "<", ">")
        return Op(op, (left, self.unary())) if op else left

    def unary(self):
        if self.take("!"):
            return Op("!", (self.unary(),))
        if self.take("-"):
            return Op("-", (self.unary(),))
        return self.postfix()

    def args(self) -> tuple:
        self.need("(")
        out = []
        if not self.take(")"):
            out.append(self.expr())
            while self.take(","):
                out.append(self.expr())
            self.need(")")
        return tuple(out)

    def postfix(self):
        node = self.primary()
        while self.take("."):
            kind, name = self.toks[self.at] if self.at < len(self.toks) else ("", "")
            if kind != "name":
                raise RuleError("expected a member name after '.'")
            self.at += 1
            if self.peek() == "(":
                node = Call(name, node, self.args())
            elif isinstance(node, Path):
                if name in ("Count", "Length"):
                    node = Call(name, node, ())
                elif node.names[0][:1].isupper():  # a static class qualifies a function
                    node = Path((*node.names, name))
                else:
                    node = Path((*node.names, name))
            else:
                node = Call(name, node, ())
        return node

    def primary(self):
        if self.take("("):
            inner = self.expr()
            self.need(")")
            return inner
        if self.at >= len(self.toks):
            raise RuleError("expression ends early")
        kind, text = self.toks[self.at]
        self.at += 1
        if kind == "num":
            return Lit(float(text) if "." in text else int(text))
        if kind == "str":
            return Lit(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1]))
        if kind == "name":
            if text in ("true", "false", "null"):
                return Lit({"true": True, "false": False, "null": None}[text])
            if self.peek() == "(":
                return Call(text, None, self.args())
            return Path((text,))
        raise RuleError(f"unexpected {text!r}")


def parse(text: str):
    p = _Parser(text or "true")
    tree = p.expr()
    if p.at != len(p.toks):
        raise RuleError(f"cannot read on from {p.toks[p.at][1]!r}")
    return _statics(tree)


def _statics(node):
    """``Class.Function(x)`` is the function itself."""
    if isinstance(node, Call):
        target = node.target
        if isinstance(target, Path) and len(target.names) == 1 and target.names[0][:1].isupper():
            target = None
        return Call(node.name, _statics(target) if target is not None else None, tuple(map(_statics, node.args)))
    if isinstance(node, Op):
        return Op(node.name, tuple(map(_statics, node.parts)))
    return node


@dataclass
class Env:
    """What names mean: ``member`` gives the column of a path behind its root; ``arrays`` are the paths that hold
    arrays; ``functions`` take the environment and the argument trees."""

    member: Callable[[tuple[str, ...]], Column | None]
    arrays: frozenset[str] = frozenset()
    functions: dict[str, Callable] = field(default_factory=dict)
    #: What functions report of single rows: a message, null where all is well.
    noted: list[Column] = field(default_factory=list)


def literals(node, method: str = "Contains") -> list[str]:
    """String literals given to ``method``, in order: what a rule looks for in a text."""
    if isinstance(node, Call):
        own = [a.value for a in node.args if node.name == method and isinstance(a, Lit) and isinstance(a.value, str)]
        return (literals(node.target, method) if node.target is not None else []) + own + [x for a in node.args for x in literals(a, method)]
    if isinstance(node, Op):
        return [x for p in node.parts for x in literals(p, method)]
    return []


def calls(node) -> list[Call]:
    """All calls in an expression, outer ones first."""
    if isinstance(node, Call):
        return [node, *(calls(node.target) if node.target is not None else []), *(x for a in node.args for x in calls(a))]
    return [x for p in node.parts for x in calls(p)] if isinstance(node, Op) else []


#: Functions that give an array, and members of what functions give: field by function and name.
LISTS = frozenset({"SemanticBindings"})
MEMBERS = {("ResolveAnchorSpan", name): of for name, of in (("Text", "text"), ("Cosine", "similarity"), ("CharStart", "char_start"), ("CharLength", "char_length"))}


SECONDS = {"TotalSeconds": 1, "TotalMinutes": 60, "TotalHours": 3600, "TotalDays": 86400}


def is_array(node, env: Env) -> bool:
    return isinstance(node, Path) and ".".join(node.names[1:]) in env.arrays or isinstance(node, Call) and node.name in LISTS


def column(node, env: Env) -> Column:
    if isinstance(node, Lit):
        return F.lit(node.value)
    if isinstance(node, Path):
        found = env.member(node.names)
        return F.lit(None) if found is None else found
    if isinstance(node, Call):
        return _call(node, env)
    if node.name in ("&&", "||"):
        out = truth(node.parts[0], env)
        for p in node.parts[1:]:
            out = (out & truth(p, env)) if node.name == "&&" else (out | truth(p, env))
        return out
    if node.name == "!":
        return ~truth(node.parts[0], env)
    if node.name == "-":
        return -column(node.parts[0], env)
    return compare(node.name, *node.parts, env)


def truth(node, env: Env) -> Column:
    """The node as true or false; something missing is false."""
    return F.coalesce(column(node, env).cast("boolean"), F.lit(False))


def checked(node, env: Env) -> tuple[Column, Column | None]:
    """(truth, error): the first message of a function that is reached at all, as ``&&`` and ``||`` stop early; None if no
    function can report one."""
    if isinstance(node, Op) and node.name in ("&&", "||"):
        out, error = checked(node.parts[0], env)
        for p in node.parts[1:]:
            more, own = checked(p, env)
            if own is not None:
                reached = F.when(out if node.name == "&&" else ~out, own)
                error = reached if error is None else F.coalesce(error, reached)
            out = (out & more) if node.name == "&&" else (out | more)
        return out, error
    if isinstance(node, Op) and node.name == "!":
        out, error = checked(node.parts[0], env)
        return ~out, error
    before = len(env.noted)
    out, own = truth(node, env), env.noted[before:]
    return out, F.coalesce(*own) if own else None


def compare(op: str, left, right, env: Env) -> Column:
    nulls = [isinstance(x, Lit) and x.value is None for x in (left, right)]
    if any(nulls):
        other = right if nulls[0] else left
        there = F.lit(False) if all(nulls) else column(other, env).isNotNull()
        return there if op == "!=" else ~there if op == "==" else F.lit(False)
    a, b = column(left, env), column(right, env)
    made = {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]
    return F.coalesce(made, F.lit(False))


def _call(node: Call, env: Env) -> Column:
    if node.target is None:
        if node.name not in env.functions:
            raise RuleError(f"unknown function {node.name}")
        return env.functions[node.name](env, *node.args)
    if node.name in ("Count", "Length"):
        c = column(node.target, env)
        return F.coalesce(F.size(c) if is_array(node.target, env) else F.char_length(c), F.lit(0))
    if isinstance(node.target, Call) and not node.args and (node.target.name, node.name) in MEMBERS:
        return column(node.target, env)[MEMBERS[node.target.name, node.name]]
    if node.name in ("Value", "HasValue") and not node.args:
        c = column(node.target, env)
        return c if node.name == "Value" else c.isNotNull()
    if node.name in SECONDS and not node.args:  # of a duration, which is a number of seconds
        return column(node.target, env) / float(SECONDS[node.name])
    a = [column(x, env) for x in node.args]
    c = column(node.target, env)
    if node.name == "Contains":
        return F.coalesce(F.array_contains(c, a[0]) if is_array(node.target, env) else F.contains(c, a[0]), F.lit(False))
    if node.name in ("ToLower", "ToLowerInvariant"):
        return F.lower(c)
    if node.name in ("ToUpper", "ToUpperInvariant"):
        return F.upper(c)
    if node.name == "StartsWith":
        return F.coalesce(F.startswith(c, a[0]), F.lit(False))
    if node.name == "EndsWith":
        return F.coalesce(F.endswith(c, a[0]), F.lit(False))
    if node.name == "Trim":
        return F.trim(c)
    raise RuleError(f"unknown method {node.name}")


def sql(node, name: Callable[[tuple[str, ...]], str], arrays: frozenset[str] = frozenset()) -> str:
    """The same expression as SQL text, printed on its own and not from the column."""
    if isinstance(node, Lit):
        if node.value is None:
            return "NULL"
        if isinstance(node.value, bool):
            return str(node.value).upper()
        return "'" + node.value.replace("'", "''") + "'" if isinstance(node.value, str) else repr(node.value)
    if isinstance(node, Path):
        return name(node.names)
    sub = lambda n: sql(n, name, arrays)
    if isinstance(node, Call):
        is_list = isinstance(node.target, Path) and ".".join(node.target.names[1:]) in arrays
        if node.name == "Contains":
            f = "list_contains" if is_list else "contains"
            return f"coalesce({f}({sub(node.target)}, {sub(node.args[0])}), FALSE)"
        if node.name in ("Count", "Length"):
            return f"coalesce(len({sub(node.target)}), 0)"
        if node.name in ("ToLower", "ToLowerInvariant"):
            return f"lower({sub(node.target)})"
        if node.name == "StartsWith":
            return f"coalesce(starts_with({sub(node.target)}, {sub(node.args[0])}), FALSE)"
        raise RuleError(f"no SQL for {node.name}")
    if node.name in ("&&", "||"):
        return "(" + (" AND " if node.name == "&&" else " OR ").join(map(sub, node.parts)) + ")"
    if node.name == "!":
        return f"(NOT {sub(node.parts[0])})"
    if node.name == "-":
        return f"(-{sub(node.parts[0])})"
    a, b = node.parts
    for x, y in ((a, b), (b, a)):
        if isinstance(y, Lit) and y.value is None:
            return f"({sub(x)} IS {'NOT ' if node.name == '!=' else ''}NULL)"
    op = {"==": "=", "!=": "<>"}.get(node.name, node.name)
    return f"coalesce({sub(a)} {op} {sub(b)}, FALSE)"


def run(node, value: dict, functions: dict[str, Callable] | None = None):
    """The expression on one Python value: what the tests hold the columns against."""
    go = lambda n: run(n, value, functions)
    if isinstance(node, Lit):
        return node.value
    if isinstance(node, Path):
        for n in node.names[1:]:
            value = value.get(n) if isinstance(value, dict) else None
        return value
    if isinstance(node, Call):
        if node.target is None:
            return functions[node.name](*map(go, node.args))
        t, a = go(node.target), [go(x) for x in node.args]
        if node.name in ("Count", "Length"):
            return len(t or ())
        if t is None:
            return None if node.name.startswith(("ToL", "ToU", "Trim")) else False
        return {"Contains": lambda: a[0] is not None and a[0] in t, "ToLower": lambda: t.lower(), "ToUpper": lambda: t.upper(), "Trim": lambda: t.strip(" "),
                "StartsWith": lambda: t.startswith(a[0]), "EndsWith": lambda: t.endswith(a[0])}[node.name.removesuffix("Invariant")]()
    if node.name == "&&":
        return all(bool(go(p)) for p in node.parts)
    if node.name == "||":
        return any(bool(go(p)) for p in node.parts)
    if node.name == "!":
        return not go(node.parts[0])
    if node.name == "-":
        return -go(node.parts[0])
    a, b = map(go, node.parts)
    if node.name in ("==", "!=") and (a is None or b is None):
        literal_null = any(isinstance(p, Lit) and p.value is None for p in node.parts)
        return ((a is None) and (b is None)) == (node.name == "==") if literal_null else False
    if a is None or b is None:
        return False
    return {"==": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[node.name]


class Build:
    """Fluent construction of rule texts: ``Build.section().text_contains("x").and_(Build.field("category").equals("y"))``."""

    def __init__(self, text: str):
        self.text = text

    @staticmethod
    def _quote(value) -> str:
        if isinstance(value, bool):
            return str(value).lower()
        return '"' + value.replace("\\", "\\\\").replace('"', '\\"') + '"' if isinstance(value, str) else str(value)

    @classmethod
    def section(cls) -> "Build":
        return cls("input1")

    @classmethod
    def field(cls, path: str) -> "Build":
        return cls(f"input1.{path}")

    def text_contains(self, value: str) -> "Build":
        return Build(f"{self.text}.text.Contains({self._quote(value)})")

    def contains_meaning(self, concept: str, least: float) -> "Build":
        return Build(f"ContainsMeaning({self.text}.id, {self._quote(concept)}, {least})")

    def matches_any(self, concepts: list[str], least: float) -> "Build":
        return Build(f"MatchesAnyMeaning({self.text}.id, {self._quote('|'.join(concepts))}, {least})")

    def _than(self, op: str, value) -> "Build":
        return Build(f"{self.text} {op} {self._quote(value)}")

    def equals(self, value) -> "Build":
        return self._than("==", value)

    def less_than(self, value) -> "Build":
        return self._than("<", value)

    def at_most(self, value) -> "Build":
        return self._than("<=", value)

    def greater_than(self, value) -> "Build":
        return self._than(">", value)

    def at_least(self, value) -> "Build":
        return self._than(">=", value)

    def and_(self, other: "Build") -> "Build":
        return Build(f"({self.text} && {other.text})")

    def or_(self, other: "Build") -> "Build":
        return Build(f"({self.text} || {other.text})")

    def not_(self) -> "Build":
        return Build(f"!({self.text})")

    def __str__(self) -> str:
        return self.text
