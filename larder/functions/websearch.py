"""Reads a web-style search text into clauses: words AND, "phrase", or, -not.

Runs once per query (never over product texts), so a plain helper is enough.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from larder.functions.text import analyse

OPERAND = re.compile(r'(-*)"([^"]*)"?|(-*)([^\s"]+)')

PARSED = (
    "struct<clauses: array<struct<required: array<array<struct<lexeme: string, offset: int>>>, "
    "excluded: array<array<struct<lexeme: string, offset: int>>>, anchor: string>>, "
    "lexemes: array<string>, together: boolean>"
)


@dataclass(frozen=True)
class Clause:
    required: list = field(default_factory=list)
    excluded: list = field(default_factory=list)

    @property
    def anchor(self) -> str:
        """The lexeme to look candidates up by: the longest required one, as the likely rarest.

        ``''`` stands for "every text" and serves clauses that only exclude.
        """
        return max((w for p in self.required for w, _ in p), key=lambda w: (len(w), w), default="")


@dataclass(frozen=True)
class WebQuery:
    clauses: list[Clause]

    @property
    def lexemes(self) -> list[str]:
        return sorted({w for c in self.clauses for p in c.required + c.excluded for w, _ in p})

    @property
    def together(self) -> bool:
        """One clause whose top operator is AND or a phrase."""
        if len(self.clauses) != 1:
            return False
        c = self.clauses[0]
        return len(c.required) + len(c.excluded) > 1 or any(len(p) > 1 for p in c.required)

    def as_row(self):
        clauses = [(c.required, c.excluded, c.anchor) for c in self.clauses]
        return (clauses, self.lexemes, self.together)


def _phrase(text: str, config: str, stops: frozenset[str]) -> list[tuple[str, int]]:
    found = [(w, i) for i, w in enumerate(analyse(text, config, stops)) if w]
    return [(w, i - found[0][1]) for w, i in found]


def read_query(text: str | None, config: str = "simple", stops: frozenset[str] = frozenset()) -> WebQuery:
    operands = [
        (m[1] is not None, bool(m[1] or m[3]), m[2] if m[1] is not None else m[4])
        for m in OPERAND.finditer(text or "")
    ]
    clauses, after_operand = [Clause()], False
    for n, (quoted, negated, body) in enumerate(operands):
        is_or = not quoted and not negated and body.lower() == "or"
        if is_or and after_operand and n < len(operands) - 1:
            clauses.append(Clause())
            after_operand = False
            continue
        after_operand = True
        phrase = _phrase(body, config, stops)
        if phrase:
            (clauses[-1].excluded if negated else clauses[-1].required).append(phrase)
    return WebQuery([c for c in clauses if c.required or c.excluded])
