"""Texts that whatever a rule matches must hold: an index of them, or a quick test, tells which rules can match a call."""

from __future__ import annotations

import re

from .rules import Condition, Rule

SHORT = 3  # characters that a required text has at least
FOLD = ("İıſ\u212a", "iisk")  # what patterns take for ASCII letters, whatever the case
_FOLD = str.maketrans(*FOLD)
_PLAIN = frozenset(" !\"#%&',-/:;<=>@_`~") | frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


def folded(text: str) -> str:
    return text.translate(_FOLD).lower()


def _better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
    """Of two sets, one of which a text must hold a member of, the one that says more."""
    return max((x for x in (a, b) if x), key=lambda s: min(map(len, s)), default=None)


def required(pattern: str) -> frozenset[str] | None:
    """Texts (folded) of which everything that a pattern matches holds one; None where the pattern names none.

    Only what surely stands there counts: plain characters that are not optional, and groups of alternatives that each
    have such a text. Anything else ends a text.
    """
    found, end = _alternatives(pattern, 0)
    return found if end == len(pattern) else None


def _alternatives(p: str, i: int) -> tuple[frozenset[str] | None, int]:
    every, whole = frozenset(), True
    while True:
        best, i = _sequence(p, i)
        whole &= best is not None
        every |= best or frozenset()
        if i >= len(p) or p[i] != "|":
            return (every if whole else None), i
        i += 1


def _sequence(p: str, i: int) -> tuple[frozenset[str] | None, int]:
    best, run = None, ""

    def close() -> None:
        nonlocal best, run
        if len(run) >= SHORT:
            best = _better(best, frozenset([folded(run)]))
        run = ""

    while i < len(p) and p[i] not in "|)":
        start, literal, inner = i, None, None
        if p[i] == "\\":
            c = p[i + 1 : i + 2]
            literal = c if c and not c.isalnum() else None
            i += 2
            if c in ("x", "u", "c", "p", "P", "k"):  # more of the escape follows: read nothing of it
                close()
                return best, _skip(p, i)
        elif p[i] == "(":
            look = p.startswith(("(?=", "(?!", "(?<"), i)
            at = i + (3 if p.startswith("(?:", i) else 1)
            if p.startswith("(?", i) and at == i + 1:
                inner, i = None, _closing(p, i)
            else:
                inner, end = _alternatives(p, at)
                i = end + 1
            inner = None if look else inner
        elif p[i] == "[":
            i = _class_end(p, i)
        else:
            literal = p[i] if p[i] in _PLAIN else None
            i += 1
        optional, many, i = _quantifier(p, i)
        if literal is not None and not optional:
            run += literal
            if many:
                close()
        else:
            zero_width = p[start] in "^$"
            if not zero_width:
                close()
            elif run:
                close()
            if inner and not optional:
                best = _better(best, inner)
    close()
    return best, i


_REPEAT = re.compile(r"\{(\d+)(?:,\d*)?\}")


def _quantifier(p: str, i: int) -> tuple[bool, bool, int]:
    """Whether what stands before is optional, whether it may repeat, and where the quantifier ends."""
    if p[i : i + 1] in ("*", "+", "?"):
        optional, end = p[i] != "+", i + 1
    elif m := _REPEAT.match(p, i):
        optional, end = int(m[1]) == 0, m.end()
    else:
        return False, False, i
    return optional, True, end + (p[end : end + 1] == "?")


def _class_end(p: str, i: int) -> int:
    i += 1
    if i < len(p) and p[i] == "^":
        i += 1
    while i < len(p) and p[i] != "]":
        i += 2 if p[i] == "\\" else 1
    return i + 1


def _closing(p: str, i: int) -> int:
    """Behind the parenthesis that closes the one at i."""
    depth = 0
    while i < len(p):
        if p[i] == "[":
            i = _class_end(p, i)
            continue
        depth += (p[i] == "(") - (p[i] == ")")
        i += 2 if p[i] == "\\" else 1
        if not depth:
            return i
    return len(p)


def _skip(p: str, i: int) -> int:
    """The end of the sequence that i is in."""
    while i < len(p) and p[i] not in "|)":
        i = _closing(p, i) if p[i] == "(" else _class_end(p, i) if p[i] == "[" else i + (2 if p[i] == "\\" else 1)
    return i


def needed_by(rule: Rule) -> frozenset[str] | None:
    """Texts (folded) of which the detail or input of each call that the rule matches holds one; None if there are none such."""

    def of(c: Condition) -> frozenset[str] | None:
        plain = [folded(x) for x in c.detail_contains if len(x) >= SHORT and x.isascii()]
        best = frozenset([max(plain, key=len)]) if plain else None
        parts = [required(x) for x in c.detail_matches]
        return _better(best, frozenset().union(*parts) if parts and all(parts) else None)

    best = None
    for c in rule.match.all_of:
        best = _better(best, of(c))
    arms = [of(c) for c in rule.match.any_of]
    return _better(best, frozenset().union(*arms) if arms and all(arms) else None)
