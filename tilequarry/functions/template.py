"""Expansion of $V, ${V}, ${V:-default}, $$ and \\$ in configuration text."""

from __future__ import annotations

import re

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def expand(text: str, values: dict[str, str]) -> str:
    """``text`` with placeholders replaced; unknown ones without a default stay as written. Defaults may nest."""
    out, at = [], 0
    while at < len(text):
        c = text[at]
        if c == "\\" and text[at + 1 : at + 2] == "$":
            out.append("$")
            at += 2
        elif c == "$" and text[at + 1 : at + 2] == "$":
            out.append("$")
            at += 2
        elif c == "$" and text[at + 1 : at + 2] == "{":
            end = _closing(text, at + 2)
            if end < 0:
                out.append(text[at:])
                break
            name, mark, default = text[at + 2 : end].partition(":-")
            found = values.get(name)
            out.append(found if found else expand(default, values) if mark else found if found is not None else text[at : end + 1])
            at = end + 1
        elif c == "$" and (m := _NAME.match(text, at + 1)):
            out.append(values.get(m.group(), m.group(0) and text[at : m.end()]))
            at = m.end()
        else:
            out.append(c)
            at += 1
    return "".join(out)


def _closing(text: str, at: int) -> int:
    depth = 1
    while at < len(text):
        depth += (text[at : at + 2] == "${") - (text[at] == "}")
        if not depth:
            return at
        at += 1
    return -1
