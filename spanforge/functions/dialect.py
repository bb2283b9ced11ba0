"""Patterns of the rule language as Java regular expressions for rlike().

Rules carry ECMAScript patterns and path globs. Both are translated once, on the driver, when a rule is compiled.
"""

from __future__ import annotations

import re

#: What ECMAScript's \\s and \\b mean, spelled out, since Java's differ beyond ASCII.
JS_SPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
WORD_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
NO_WORD_EDGE = r"(?:(?<=[A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<![A-Za-z0-9_])(?![A-Za-z0-9_]))"


class PatternError(ValueError):
    """A pattern that the rule language does not accept."""


def js_to_java(pattern: str, ignore_case: bool = True) -> str:
    """An ECMAScript pattern (no flags but i) as a Java one of the same meaning."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if i + 1 == len(pattern):
                raise PatternError("pattern ends with a backslash")
            n = pattern[i + 1]
            if n == "s":
                out.append(JS_SPACE if in_class else f"[{JS_SPACE}]")
            elif n == "S":
                out.append(f"&&[^{JS_SPACE}]" if in_class and out[-1] == "[" else f"[^{JS_SPACE}]")
            elif n == "b":
                out.append(r"\x08" if in_class else WORD_EDGE)
            elif n == "B" and not in_class:
                out.append(NO_WORD_EDGE)
            elif n == "/" or n in "-'\"`@#%&=:;,<>~! ":
                out.append("\\" + n if not n.isalnum() else n)
            else:
                out.append("\\" + n)
            i += 2
            continue
        if in_class:
            if c == "]":
                in_class = False
                out.append(c)
            elif c == "[" or (c == "&" and pattern[i : i + 2] == "&&"):
                out.append("\\" + c)
            else:
                out.append(c)
        elif c == "[":
            if pattern.startswith("[^]", i):
                out.append(r"[\s\S]")
                i += 3
                continue
            if pattern.startswith("[]", i):
                out.append("(?!)")
                i += 2
                continue
            in_class = True
            out.append(c)
            if i + 1 < len(pattern) and pattern[i + 1] == "^":
                out.append("^")
                i += 1
        elif c == "$":
            out.append(r"\z")
        elif c == ".":
            out.append(r"[^\n\r\u2028\u2029]")
        else:
            out.append(c)
        i += 1
    if in_class:
        raise PatternError("unterminated character class")
    return ("(?iu)" if ignore_case else "") + "".join(out)


def nested_quantifier(pattern: str) -> bool:
    """Whether an unbounded quantifier stands on a group that holds another: such patterns are refused."""
    stack, last = [], False  # for each open group: does it hold an unbounded quantifier?
    i = 0
    held = False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 2
            last = False
            continue
        if c == "[":
            j = i + 1
            while j < len(pattern) and pattern[j] != "]":
                j += 2 if pattern[j] == "\\" else 1
            i, last = j + 1, False
            continue
        if c == "(":
            stack.append(held)
            held, last = False, False
        elif c == ")":
            last, outer = held, stack.pop() if stack else False
            held = outer or held
        elif c in "*+" or (c == "{" and re.match(r"\{\d+,\}", pattern[i:])):
            if last:
                return True
            held, last = True, False
        else:
            last = False
        i += 1
    return False


# -- globs -------------------------------------------------------------------------------------------------------


def _split_top(body: str, sep: str) -> list[str]:
    """body cut at sep outside braces, brackets and parentheses."""
    out, depth, start, i = [], 0, 0, 0
    while i < len(body):
        c = body[i]
        if c == "\\":
            i += 2
            continue
        if c in "{([":
            depth += 1
        elif c in "})]":
            depth -= 1
        elif c == sep and depth == 0:
            out.append(body[start:i])
            start = i + 1
        i += 1
    out.append(body[start:])
    return out


def _closing(glob: str, i: int, opened: str, closed: str) -> int:
    depth = 0
    while i < len(glob):
        if glob[i] == "\\":
            i += 1
        elif glob[i] == opened:
            depth += 1
        elif glob[i] == closed:
            depth -= 1
            if not depth:
                return i
        i += 1
    return -1


def _glob_body(glob: str, ends: str = "") -> str:
    """ends: what may follow, for negated groups."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "\\" and i + 1 < len(glob):
            out.append(re.escape(glob[i + 1]))
            i += 2
        elif c in "@?*+!" and glob[i + 1 : i + 2] == "(" and (end := _closing(glob, i + 1, "(", ")")) > 0:
            inside = "|".join(_glob_body(x) for x in _split_top(glob[i + 2 : end], "|"))
            if c == "!":
                rest = _glob_body(glob[end + 1 :]) + ends
                out.append(f"(?!(?:{inside}){rest}\\z)[^/]*?")
            else:
                out.append(f"(?:{inside}){'' if c == '@' else c}")
            i = end + 1
        elif c == "*":
            j = i
            while j < len(glob) and glob[j] == "*":
                j += 1
            alone = (i == 0 or glob[i - 1] == "/") and (j == len(glob) or glob[j] == "/")
            if j - i >= 2 and alone:
                if j == len(glob):
                    out.append(".*")
                    i = j
                else:
                    out.append("(?:.*/)?")
                    i = j + 1
            else:
                out.append("[^/]*")
                i = j
        elif c == "?":
            out.append("[^/]")
            i += 1
        elif c == "[" and (end := _closing(glob, i, "[", "]")) > i + 1:
            body = glob[i + 1 : end]
            negated = body[:1] in "!^"
            body = body[1:] if negated else body
            out.append(f"[{'^/' if negated else ''}{body.replace('[', chr(92) + '[').replace('&&', chr(92) + '&&')}]")
            i = end + 1
        elif c == "{" and (end := _closing(glob, i, "{", "}")) > 0:
            body = glob[i + 1 : end]
            arms = _split_top(body, ",")
            span = re.fullmatch(r"(-?\d+)\.\.(-?\d+)", body)
            if span:
                a, b = int(span[1]), int(span[2])
                out.append("(?:" + "|".join(str(x) for x in range(min(a, b), max(a, b) + 1)) + ")")
            elif len(arms) > 1:
                out.append("(?:" + "|".join(_glob_body(a) for a in arms) + ")")
            else:  # a brace with one arm is no alternation: its signs stand for themselves
                out.append(r"\{" + _glob_body(body) + r"\}")
            i = end + 1
        else:
            out.append(re.escape(c))
            i += 1
    return "".join(out)


def glob_to_java(glob: str, ignore_case: bool = True) -> str:
    """A path glob as an anchored Java pattern; names that begin with a dot match like others.

    * and ? stay within a path segment, ** crosses them, {a,b} and @(a|b) are alternations, ?( ), *( ), +( ) and !( )
    extended groups, [ ] classes. A leading ./ is dropped.
    """
    if not glob:
        raise PatternError("empty glob")
    negated = glob.startswith("!") and not glob.startswith("!(")
    body = _glob_body((glob[1:] if negated else glob).removeprefix("./"))
    if body.endswith("/.*"):  # a/** also is a itself
        body = body[:-3] + "(?:/.*)?"
    whole = rf"(?s)\A(?:{body})\z"
    if negated:
        whole = rf"(?s)\A(?!(?:{body})\z).*\z"
    return ("(?iu)" if ignore_case else "") + whole
