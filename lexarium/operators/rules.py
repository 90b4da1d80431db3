"""Rules as data: IF condition THEN value [ELSE value], parsed on the driver and compiled to one Column.

Evaluation is three-valued in its own way: a rule whose condition reads any unknown variable is unknown, even where one
arm of an OR is true.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(?:(?P<num>\d+(?:\.\d+)?)|(?P<str>'[^']*')|(?P<op>>=|<=|<>|=|<|>|\(|\))|(?P<word>[^\W\d]\w*))")
_OPS = {">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, "<>": lambda a, b: a != b, "=": lambda a, b: a == b, "<": lambda a, b: a < b, ">": lambda a, b: a > b}


@dataclass(frozen=True)
class Compare:
    name: str
    op: str
    value: float | str


@dataclass(frozen=True)
class Logic:
    kind: str
    parts: tuple


@dataclass(frozen=True)
class Rule:
    when: Compare | Logic
    then: float | str
    otherwise: float | str | None


class _Reader:
    def __init__(self, text: str):
        self.tokens, pos = [], 0
        while pos < len(text.rstrip()):
            m = _TOKEN.match(text, pos)
            if not m:
                raise ValueError(f"unexpected {text[pos:]!r}")
            kind = m.lastgroup
            self.tokens.append((kind, m[kind].upper() if kind == "word" and m[kind].upper() in ("IF", "THEN", "ELSE", "AND", "OR", "NOT") else m[kind]))
            pos = m.end()
        self.at = 0

    def take(self, *wanted: str):
        if self.at < len(self.tokens) and self.tokens[self.at][1] in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, *wanted: str) -> str:
        got = self.take(*wanted)
        if got is None:
            raise ValueError(f"expected {' or '.join(wanted)} at token {self.at}")
        return got

    def value(self) -> float | str:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        if kind not in ("num", "str"):
            raise ValueError(f"expected a value at token {self.at}")
        self.at += 1
        return float(text) if kind == "num" else text[1:-1]

    def many(self, word: str, part):
        parts = [part()]
        while self.take(word):
            parts.append(part())
        return parts[0] if len(parts) == 1 else Logic(word, tuple(parts))

    def condition(self):
        return self.many("OR", lambda: self.many("AND", self.term))

    def term(self):
        if self.take("NOT"):
            return Logic("NOT", (self.term(),))
        if self.take("("):
            inner = self.condition()
            self.need(")")
            return inner
        kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        if kind != "word":
            raise ValueError(f"expected a name at token {self.at}")
        self.at += 1
        return Compare(name, self.need(*_OPS), self.value())


def parse(text: str) -> Rule:
    r = _Reader(text)
    r.need("IF")
    when = r.condition()
    r.need("THEN")
    then = r.value()
    rule = Rule(when, then, r.value() if r.take("ELSE") else None)
    if r.at != len(r.tokens):
        raise ValueError(f"unread tokens from {r.at}")
    return rule


def _names(c) -> set[str]:
    return {c.name} if isinstance(c, Compare) else set().union(*map(_names, c.parts))


def _column(c, names: dict[str, Column]) -> Column:
    if isinstance(c, Compare):
        return _OPS[c.op](names[c.name], F.lit(c.value))
    parts = [_column(p, names) for p in c.parts]
    if c.kind == "NOT":
        return ~parts[0]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if c.kind == "AND" else out | p
    return out


def compile_rule(rule: Rule, names: dict[str, Column]) -> Column:
    """The rule's value; null where a variable of the condition is null."""
    unknown = F.lit(False)
    for n in sorted(_names(rule.when)):
        unknown = unknown | names[n].isNull()
    return F.when(unknown, None).when(_column(rule.when, names), F.lit(rule.then)).otherwise(F.lit(rule.otherwise))


def render(rule: Rule) -> str:
    """The rule as text that parses back to it."""

    def v(x):
        return f"'{x}'" if isinstance(x, str) else f"{x:g}"

    def c(x) -> str:
        if isinstance(x, Compare):
            return f"{x.name} {x.op} {v(x.value)}"
        return f"NOT ({c(x.parts[0])})" if x.kind == "NOT" else "(" + f" {x.kind} ".join(map(c, x.parts)) + ")"

    return f"IF {c(rule.when)} THEN {v(rule.then)}" + (f" ELSE {v(rule.otherwise)}" if rule.otherwise is not None else "")

