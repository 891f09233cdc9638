"""Tokens of the Cypher subset."""

from __future__ import annotations

import re
from dataclasses import dataclass

from tessera.plans.errors import CypherError

# Reserved words, in any case, and the two-word keywords built from them.
KEYWORDS = frozenset(
    "MATCH OPTIONAL WHERE WITH RETURN AS AND OR IN IS NOT NULL CONTAINS STARTS ENDS DISTINCT ORDER BY ASC DESC SKIP LIMIT COUNT TRUE FALSE".split()
)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_TOKEN = re.compile(
    r"""(?P<space>\s+)
    |(?P<number>\d+(?:\.\d+)?)
    |(?P<word>[A-Za-z_$][A-Za-z0-9_$]*)
    |(?P<string>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')
    |(?P<sign><-|->|[()\[\],.:*=<>-])""",
    re.X | re.S,
)


@dataclass(frozen=True)
class Token:
    """``kind``: keyword, name, string, number, sign or end."""

    kind: str
    value: str | float
    column: int

    def says(self, *words: str) -> bool:
        return self.kind == "keyword" and self.value in words

    def signs(self, *signs: str) -> bool:
        return self.kind == "sign" and self.value in signs


def tokenize(text: str) -> list[Token]:
    tokens, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            what = "Unterminated string" if text[at] in "'\"" else f"Unexpected character {text[at]!r}"
            raise CypherError(what, at + 1)
        kind, value = m.lastgroup, m[0]
        if kind == "word":
            upper = value.upper()
            tokens.append(Token("keyword", upper, at + 1) if upper in KEYWORDS else Token("name", value, at + 1))
        elif kind == "string":
            body = re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), value[1:-1], flags=re.S)
            tokens.append(Token("string", body, at + 1))
        elif kind == "number":
            tokens.append(Token("number", float(value) if "." in value else int(value), at + 1))
        elif kind == "sign":
            tokens.append(Token("sign", value, at + 1))
        at = m.end()
    return [*tokens, Token("end", "", len(text) + 1)]
