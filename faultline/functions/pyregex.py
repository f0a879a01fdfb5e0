"""Python regex text to the Java dialect Spark evaluates."""

from __future__ import annotations

import re

from faultline.functions.clock import UnsupportedFormat


def translate(pattern: str) -> str:
    """The same pattern in Java syntax; group numbers do not change.

    Raises ``re.error`` for a pattern Python refuses, and :class:`UnsupportedFormat` for the few
    constructs Java lacks.
    """
    names = re.compile(pattern).groupindex
    out: list[str] = []
    i, in_class, class_start = 0, False, 0
    while i < len(pattern):
        rest = pattern[i:]
        char = pattern[i]
        if char == "\\":
            pair = pattern[i : i + 2]
            if in_class and pair == r"\b":
                pair = r"\x08"
            out.append(r"\z" if pair == r"\Z" and not in_class else pair)
            i += 2
        elif in_class:
            first = i == class_start
            if char == "]" and not first:
                in_class = False
                out.append(char)
            else:
                out.append("\\" + char if char in "[]&" else char)
            i += 1
        elif char == "[":
            in_class = True
            negated = rest.startswith("[^")
            out.append("[^" if negated else "[")
            i += 2 if negated else 1
            class_start = i
        elif named := re.match(r"\(\?P<\w+>", rest):
            out.append("(")
            i += named.end()
        elif back := re.match(r"\(\?P=(\w+)\)", rest):
            out.append(rf"(?:\{names[back[1]]})")
            i += back.end()
        elif re.match(r"\(\?(?:\(|#|[A-Za-z]*[aL])", rest):
            raise UnsupportedFormat(f"regex construct {rest[:4]!r} in {pattern!r} is not supported")
        elif upto := re.match(r"\{,(\d+)\}", rest):
            out.append(f"{{0,{upto[1]}}}")
            i += upto.end()
        else:
            out.append(char)
            i += 1
    return "".join(out)


def group_count(pattern: str) -> int:
    return re.compile(pattern).groups


def optional_groups(pattern: str) -> frozenset[int]:
    """Groups that may take no part in a match: those under ``?``, ``*``, ``{0,n}`` or ``|``."""
    optional: set[int] = set()
    number = 0
    # One frame per open parenthesis: its own group number (or None), the groups in it, and
    # whether it holds alternatives. The first frame is the whole pattern.
    frames: list[list] = [[None, [], False]]
    tokens = re.compile(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|\((\?(?!P<))?|\)([?*]|\{0?,|\{0\})?|\||.", re.S)
    for token in tokens.finditer(pattern):
        text = token[0]
        if text.startswith("("):
            own = None
            if token[1] is None:
                number += 1
                own = number
            frames.append([own, [], False])
        elif text == "|":
            frames[-1][2] = True
        elif text.startswith(")") and len(frames) > 1:
            own, inside, branched = frames.pop()
            if branched:
                optional.update(inside)
            if own is not None:
                inside = [own, *inside]
            if token[2]:
                optional.update(inside)
            frames[-1][1].extend(inside)
    if frames[0][2]:
        optional.update(frames[0][1])
    return frozenset(optional)
