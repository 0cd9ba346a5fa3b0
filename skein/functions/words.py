"""Words of a text for full-text search."""

from __future__ import annotations

import re

#: Web addresses and e-mail addresses stay whole; otherwise runs of letters and digits, with inner ' . _ as in words.
WORD = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^\s\"'<>]+|[\w.+-]+@[\w-]+(?:\.[\w-]+)+|\d+(?:[.,]\d+)+|(?:\w+['’.:])*\w*[^\W_]|\w+")


def analyse(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]
