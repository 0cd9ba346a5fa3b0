"""The level of a log entry as a column: metadata first, then labels, then the line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein import labels as lab
from skein.functions.logtokens import LEVELS, LETTERS

# Names of fields that hold a level, and how much of a line is searched for one.
FIELDS = ["detected_level", "level", "LEVEL", "Level", "severity", "SEVERITY", "Severity", "severity_text", "lvl", "LVL", "Lvl"]
SCANNED = 512


def known(word: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), F.lower(word))


def detected_level(line: Column, metadata: Column, labels: Column) -> Column:
    """trace, debug, info, warn, error, critical, fatal or unknown."""
    head = F.substring(line, 1, SCANNED)
    names = "level|lvl|severity"
    json_level = F.regexp_extract(head, rf'(?i)"(?:{names})"\s*:\s*"(\w+)"', 1)
    pair_level = F.regexp_extract(head, rf'(?i)(?:^|\s)(?:{names})="?(\w+)', 1)
    letter = F.element_at(F.create_map(*[F.lit(x) for kv in LETTERS.items() for x in kv]), F.regexp_extract(head, r"^([TVDINWECF])\d{4} \d\d:", 1))
    keyword = F.regexp_extract(head, r"(?i)\b(trace|debug|info|warn(?:ing)?|error|err|critical|fatal)\b", 1)
    return F.coalesce(
        *[known(F.try_element_at(metadata, F.lit(n))) for n in FIELDS], *[known(lab.get(labels, n)) for n in FIELDS], known(json_level), known(pair_level), letter, known(keyword), F.lit("unknown")
    )
