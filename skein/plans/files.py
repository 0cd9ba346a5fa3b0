"""Glob and grep over a table of files: tenant, path, kind ('file' or 'dir'), size, content (binary)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions.regex import to_java

GLOB_LIMIT, GREP_LIMIT = 1000, 100
#: Files above this size, with a NUL in the first bytes, or with such an ending, aren't searched; nor what follows a longer line.
MOST_BYTES, SNIFF, LONGEST_LINE = 16 << 20, 8192, 1 << 20
# Endings and first bytes (hex) of binary files.
ENDINGS = "png jpg jpeg gif bmp ico webp pdf zip gz bz2 xz zst 7z tar rar jar class so dll exe bin o a wasm mp3 mp4 mov avi woff woff2 ttf parquet".split()
SIGNATURES = ["89504e47", "ffd8ff", "47494638", "25504446", "504b0304", "1f8b", "425a68", "fd377a58", "7f454c46", "28b52ffd", "50415231"]


def glob_regex(pattern: str) -> str:
    """Per component * ? [] and {a,b}; ** any number of components."""
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out.append("(?:[^/]+/)*")
            i += 3
            continue
        if pattern.startswith("**", i):
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out.append("[" + ("^/" + body[1:] if body[0] in "!^" else body) + "]")
            i = end
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + ("" if not depth else ")" * depth) + "$"


def glob(files: DataFrame, pattern: str, limit: int | None = GLOB_LIMIT) -> DataFrame:
    """Entries whose path matches, depth first: a directory before what lies in it. Without a limit there is no order."""
    hit = files.filter(F.col("path").rlike(glob_regex(pattern)))
    return hit if limit is None else hit.orderBy("tenant", F.split("path", "/")).limit(limit)


def is_binary() -> Column:
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*ENDINGS)
    head = F.lower(F.hex(F.substring("content", 1, 8)))
    out = ending
    for s in SIGNATURES:
        out = out | head.startswith(s)
    return out | (F.locate("\0", F.decode(F.substring("content", 1, SNIFF), "ISO-8859-1")) > 0)


def lines(files: DataFrame) -> DataFrame:
    """tenant, path, line_number, line of the searchable files; a file ends before its first overlong line."""
    plain = files.filter((F.col("kind") == "file") & (F.octet_length("content") <= MOST_BYTES) & ~is_binary())
    text = F.decode("content", "UTF-8")
    split = F.split(F.regexp_replace(text, r"\n\z", ""), r"\r?\n")
    rows = plain.filter(F.octet_length("content") > 0).withColumn("_l", split)
    longest = F.array_position(F.transform("_l", lambda x: F.octet_length(x) > LONGEST_LINE), F.lit(True))
    kept = F.when(longest > 0, F.slice("_l", F.lit(1), F.greatest(longest.cast("int") - 1, F.lit(0)))).otherwise(F.col("_l"))
    return rows.select("tenant", "path", F.posexplode(kept).alias("n", "line")).select("tenant", "path", (F.col("n") + 1).alias("line_number"), "line")


def grep(files: DataFrame, pattern: str, fixed: bool = False, ignore_case: bool = False, before: int = 0, after: int = 0, under: str | None = None, limit: int | None = GREP_LIMIT) -> DataFrame:
    """tenant, path, line_number, line, before, after: matching lines with their context, in path and line order; without
    a limit there is no order."""
    rows = lines(files if under is None else files.filter(F.col("path").rlike(glob_regex(under))))
    expr = ("(?i)" if ignore_case else "") + (re.escape(pattern) if fixed else to_java(pattern))
    if before or after:
        w = Window.partitionBy("tenant", "path").orderBy("line_number")
        empty = F.array().cast("array<string>")
        rows = rows.withColumns({
            "before": F.collect_list("line").over(w.rowsBetween(-before, -1)) if before else empty,
            "after": F.collect_list("line").over(w.rowsBetween(1, after)) if after else empty,
        })
    else:
        rows = rows.withColumns({"before": F.array().cast("array<string>"), "after": F.array().cast("array<string>")})
    hit = rows.filter(F.col("line").rlike(expr))
    return hit if limit is None else hit.orderBy("tenant", "path", "line_number").limit(limit)


def stat(files: DataFrame, path: str) -> DataFrame:
    return files.filter(F.col("path") == path).select("tenant", "path", "kind", "size")


def mkdir(files: DataFrame, tenant: str, path: str) -> DataFrame:
    """Adds a directory unless it is there."""
    new = files.sparkSession.createDataFrame([(tenant, path)], "tenant string, path string").join(files.select("tenant", "path"), ["tenant", "path"], "left_anti")
    return files.unionByName(new.withColumns({"kind": F.lit("dir"), "size": F.lit(0).cast("bigint"), "content": F.lit(None).cast("binary")}), allowMissingColumns=True)


def iterdir(files: DataFrame, path: str) -> DataFrame:
    return glob(files, re.sub(r"([*?\[\]{}])", r"[\1]", path.rstrip("/")) + "/*", limit=None)


def read(files: DataFrame, path: str, offset: int = 0, length: int | None = None) -> DataFrame:
    content = F.expr(f"substring(content, {offset + 1}" + (f", {length})" if length is not None else ")"))
    return files.filter((F.col("path") == path) & (F.col("kind") == "file")).select("tenant", "path", content.alias("content"))


def write(files: DataFrame, new: DataFrame) -> DataFrame:
    """The table with files of ``new`` (same columns) put in the place of those of equal tenant and path."""
    return files.join(new.select("tenant", "path"), ["tenant", "path"], "left_anti").unionByName(new)


def append(files: DataFrame, path: str, data: bytes) -> DataFrame:
    """Adds bytes to the end of a file."""
    hit = (F.col("path") == path) & (F.col("kind") == "file")
    return files.withColumns({"content": F.when(hit, F.concat("content", F.lit(data))).otherwise(F.col("content")), "size": F.when(hit, F.col("size") + len(data)).otherwise(F.col("size"))})


def rename(files: DataFrame, old: str, new: str) -> DataFrame:
    """Moves a file, or a directory with all below it; what lay at the new place is gone."""
    mine = (F.col("path") == old) | F.startswith("path", F.lit(old + "/"))
    kept = files.filter(mine | ~((F.col("path") == new) | F.startswith("path", F.lit(new + "/"))))
    return kept.withColumn("path", F.when(mine, F.concat(F.lit(new), F.expr(f"substring(path, {len(old) + 1})"))).otherwise(F.col("path")))


def unlink(files: DataFrame, path: str) -> DataFrame:
    return files.filter((F.col("path") != path) | (F.col("kind") != "file"))


def rmdir(files: DataFrame, path: str) -> DataFrame:
    """Removes an empty directory; one that holds something makes the query fail."""
    inside = files.filter(F.startswith("path", F.lit(path + "/"))).select("tenant", F.lit(path).alias("path"), F.lit(True).alias("_full")).distinct()
    full = (F.col("path") == path) & F.coalesce("_full", F.lit(False))
    failing = F.when(full, F.raise_error(F.lit("directory not empty")).cast("boolean")).otherwise(F.col("path") != path)
    return files.join(inside, ["tenant", "path"], "left").filter(failing).select(*files.columns)
