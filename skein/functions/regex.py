"""RE2 patterns for Java's engine."""

from __future__ import annotations

import re


# POSIX classes, Java's names for them and their ASCII members.
POSIX = {"alpha": "Alpha", "digit": "Digit", "alnum": "Alnum", "upper": "Upper", "lower": "Lower", "space": "Space", "punct": "Punct", "print": "Print", "graph": "Graph", "cntrl": "Cntrl", "xdigit": "XDigit", "blank": "Blank"}
ASCII = {"alpha": "a-zA-Z", "digit": "0-9", "alnum": "0-9a-zA-Z", "upper": "A-Z", "lower": "a-z", "space": r"\t-\r ", "punct": r"!-/:-@\[-`{-~", "print": " -~", "graph": "!-~", "cntrl": r"\x00-\x1f\x7f", "xdigit": "0-9A-Fa-f", "blank": r"\t "}


def _translated(pattern: str, end: str, group: str, posix) -> str:
    """Walks a pattern: $ becomes ``end`` (but in multi-line patterns), named groups ``group``, classes don't nest."""
    if re.search(r"(?<!\\)(?:\\\\)*\(\?(?:[=!]|<[=!]|>)", pattern) or re.search(r"(?<!\\)(?:\\\\)*\\[1-9]", pattern):
        raise ValueError(f"look-around and back references are not supported: {pattern!r}")
    lines = re.search(r"\(\?[a-zA-Z]*m", pattern) is not None
    out, i, inside, opened = [], 0, False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out.append(end if pattern[i + 1] == "z" else pattern[i : i + 2])
            i += 2
            continue
        if inside:
            if m := re.match(r"\[:(\^?)(\w+):\]", pattern[i:]):
                out.append(posix(m[2], bool(m[1])))
                i += len(m[0])
                continue
            if c == "]" and i > opened:
                inside = False
            elif c in "[&":
                c = "\\" + c
        elif c == "[":
            inside, opened = True, i + (2 if pattern[i + 1 : i + 2] == "^" else 1)
            if pattern[opened : opened + 1] == "]":  # a bracket that comes first is a member
                out.append(pattern[i:opened] + "\\]")
                i = opened + 1
                continue
        elif c == "$" and not lines:
            c = end
        elif m := re.match(r"\(\?P?<(?=\w)", pattern[i:]):
            out.append(group)
            i += len(m[0])
            continue
        out.append(c)
        i += 1
    return "".join(out)


def to_java(pattern: str) -> str:
    """Java form of an RE2 pattern; what RE2 refuses (look-around, back references, possessive) is refused.

    Only a line feed ends a line, and $ is the end of the text.
    """
    return "(?d)" + _translated(pattern, r"\z", "(?<", lambda name, no: ("\\P{" if no else "\\p{") + POSIX.get(name, "Alpha") + "}")


def to_python(pattern: str) -> str:
    """Python form of an RE2 pattern, for stages that run in Arrow batches."""
    return _translated(pattern, r"\Z", "(?P<", lambda name, no: "" if no else ASCII.get(name, "a-zA-Z"))


def anchored(pattern: str) -> str:
    return rf"\A(?s:{to_java(pattern)})\z"


def like(glob: str) -> str:
    """Anchored regular expression of a glob with * ? and [] classes."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body) + "]")
            i = end
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return r"\A(?s:" + "".join(out) + r")\z"
