"""Spreadsheet formulas read into small trees, by operator precedence.

Loosest first: comparisons, &, + and -, * and /, ^, then the sign, and % tightest. A tree is ("num", 1.5),
("text", "a"), ("bool", True), ("cell", table or None, column, whole) for structured references, ("name", word),
("call", NAME, [arguments]), ("op", sign, left, right), ("neg", x) and ("pct", x). A missing argument is ("empty",).
"""

from __future__ import annotations

import re

_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|(?P<text>"(?:[^"]|"")*")|(?P<cell>(?:[A-Za-z_][\w.]*)?\[(?:[^\[\]]|\[[^\[\]]*\])*\])|(?P<name>[A-Za-z_][\w.]*)|(?P<op><=|>=|<>|[-+*/^&=<>%(),;{}]))""")
_LOOSE = {"=": 1, "<>": 1, "<": 1, ">": 1, "<=": 1, ">=": 1, "&": 2, "+": 3, "-": 3, "*": 4, "/": 4, "^": 5}


class FormulaError(ValueError):
    pass


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise FormulaError(f"cannot read {text[at:at + 20]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


def _cell(text: str) -> tuple:
    table, _, inner = text.partition("[")
    inner = inner[:-1]
    whole = not inner.startswith("@")
    if m := re.fullmatch(r"\[#This Row\],\s*\[(.*)\]", inner, re.I):
        inner, whole = m[1], False
    inner = inner.lstrip("@").strip()
    if inner.startswith("[") and inner.endswith("]"):
        inner = inner[1:-1]
    return ("cell", table or None, inner, whole)


class _Reader:
    def __init__(self, text: str):
        self.tokens, self.at = tokens(text.lstrip().removeprefix("=")), 0

    def peek(self) -> tuple[str | None, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else (None, "")

    def take(self, op: str | None = None) -> tuple[str | None, str]:
        found = self.peek()
        if op and found != ("op", op):
            raise FormulaError(f"{op} is missing before {found[1]!r}")
        self.at += 1
        return found

    def expression(self, least: int = 1) -> tuple:
        left = self.unary()
        while self.peek()[0] == "op" and (p := _LOOSE.get(self.peek()[1], 0)) >= least:
            sign = self.take()[1]
            left = ("op", sign, left, self.expression(p + 1))
        return left

    def unary(self) -> tuple:
        kind, word = self.peek()
        if kind == "op" and word in "+-":
            self.take()
            x = self.unary()
            return ("neg", x) if word == "-" else x
        x = self.primary()
        while self.peek() == ("op", "%"):
            self.take()
            x = ("pct", x)
        return x

    def primary(self) -> tuple:
        kind, word = self.take()
        match kind:
            case "num":
                return ("num", float(word) if "." in word or "e" in word.lower() else int(word))
            case "text":
                return ("text", word[1:-1].replace('""', '"'))
            case "cell":
                return _cell(word)
            case "name":
                if self.peek() == ("op", "("):
                    self.take()
                    return ("call", word.upper().removeprefix("_XLFN."), self.arguments())
                return ("bool", word.upper() == "TRUE") if word.upper() in ("TRUE", "FALSE") else ("name", word)
        if (kind, word) == ("op", "("):
            x = self.expression()
            self.take(")")
            return x
        raise FormulaError(f"a value is missing before {word!r}")

    def arguments(self) -> list[tuple]:
        out: list[tuple] = []
        if self.peek() == ("op", ")"):
            self.take()
            return out
        while True:
            out.append(("empty",) if self.peek() in (("op", ","), ("op", ")")) else self.expression())
            if self.take()[1] == ")":
                return out
            if self.tokens[self.at - 1] != ("op", ","):
                raise FormulaError("an argument does not end")


def parse(text: str) -> tuple:
    r = _Reader(text)
    tree = r.expression()
    if r.at < len(r.tokens):
        raise FormulaError(f"{r.peek()[1]!r} is left over")
    return tree
