"""Pipeline stages as a row program, run in Arrow batches; leading line filters become JVM columns instead."""

from __future__ import annotations

import ipaddress
import json
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions import templates
from skein.functions.logtokens import COLOUR
from skein.functions.numbers import parse_bytes, parse_duration, parse_float
from skein.functions.regex import to_java, to_python
from skein.functions.words import analyse

ERRORS = ("__error__", "__error_details__", "__preserve_error__")


_capture = re.compile(r"<([^<>]*)>")


def pattern_regex(pattern: str, end: str = r"\z") -> str:
    """The pattern filter as a regular expression that Java and Python read alike.

    A literal binds at its first occurrence, hence the atomic groups; a capture before a literal, or at the end, holds
    at least one character; without a capture at the end the line ends with the last literal.
    """
    literals = _capture.split(pattern)[::2]
    if len(literals) == 1 and not pattern:
        return r"\A" + end
    out = [r"\A(?s:", f"(?>.*?{re.escape(literals[0])})" if literals[0] else ""]
    out += [f"(?>(?!{re.escape(x)}).+?{re.escape(x)})" for x in literals[1:] if x]
    return "".join(out) + (".+" if not literals[-1] else "") + ")" + end


@lru_cache(256)
def pattern_captures(pattern: str) -> tuple[re.Pattern, list[str]]:
    """The pattern stage as a regular expression, with the name of each of its groups.

    A capture runs to the first occurrence of the literal behind it. Where that is missing, the capture's second group
    takes the rest of the line and nothing follows.
    """
    lead, *rest = _capture.split(pattern)
    names: list[str] = []
    out = ""
    for name, literal in reversed(list(zip(rest[::2], rest[1::2], strict=True))):
        names[:0] = [name, name] if literal else [name]
        out = f"(?:(?>(.*?){re.escape(literal)}){out}|(.*))" if literal else "(.*)"
        if literal:  # group order: the capture, those behind it, its second form
            names.append(names.pop(1))
        else:
            del names[1:]
    return re.compile(r"\A(?s:" + re.escape(lead) + out + ")"), names


def pattern_fields(pattern: str, line: str) -> dict[str, str]:
    expr, names = pattern_captures(pattern)
    found = expr.match(line)
    return {n: v for n, v in zip(names, found.groups(), strict=True) if v is not None and n not in ("", "_")} if found else {}


_address = re.compile(r"[0-9A-Fa-f:.]{2,}")


def ip_in(text: str, spec: str) -> bool:
    """Whether an address of ``text`` is the address, in the network or in the range a-b of ``spec``."""
    if "-" in spec:
        low, high = (ipaddress.ip_address(x.strip()) for x in spec.split("-", 1))
        inside = lambda a: a.version == low.version and low <= a <= high
    else:
        net = ipaddress.ip_network(spec, strict=False)
        inside = lambda a: a.version == net.version and a in net
    for m in _address.finditer(text):
        for candidate in {m[0], m[0].rstrip(".:")}:
            try:
                if inside(ipaddress.ip_address(candidate)):
                    return True
            except ValueError:
                continue
    return False


def clean(name: str) -> str:
    name = re.sub(r"[^A-Za-z0-9_]", "_", name.strip())
    return "_" + name if name[:1].isdigit() else name


def number_text(v) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float) and v.is_integer() and abs(v) < 1e21:
        return str(int(v))
    return str(v)


def flatten(value: dict, prefix: str = "") -> dict[str, str]:
    out: dict[str, str] = {}
    for k, v in value.items():
        name = f"{prefix}_{clean(k)}" if prefix else clean(k)
        if isinstance(v, dict):
            out.update(flatten(v, name))
        elif v is not None and not isinstance(v, list):
            out[name] = v if isinstance(v, str) else number_text(v)
    return out


def json_path(value, path: str) -> str:
    for m in re.finditer(r'\["((?:[^"\\]|\\.)*)"\]|\[(\d+)\]|([A-Za-z_][\w-]*)', path):
        try:
            value = value[int(m[2])] if m[2] is not None else value[m[1] if m[1] is not None else m[3]]
        except (KeyError, IndexError, TypeError):
            return ""
    if value is None:
        return ""
    return value if isinstance(value, str) else json.dumps(value, separators=(",", ":"), ensure_ascii=False) if isinstance(value, (dict, list)) else number_text(value)


_pair = re.compile(r'\s*([^\s="]+)(?:=(?:"((?:[^"\\]|\\.)*)"|([^\s"]*)))?(?=\s|\Z)|\s*(\S+)')


def logfmt_pairs(text: str) -> dict[str, str]:
    """Keys as they are written, with their values."""
    return {m[1]: m[3] or "" if m[2] is None else _unescaped(m[2]) for m in _pair.finditer(text) if m[4] is None}


def logfmt(line: str, strict: bool, keep_empty: bool) -> tuple[dict[str, str], str | None]:
    out: dict[str, str] = {}
    for m in _pair.finditer(line):
        if m[4] is not None:
            if strict:
                return out, f"logfmt syntax error at pos {m.start(4) + 1} : invalid key"
            continue
        has_value = m[2] is not None or m[3] is not None
        if not has_value and strict:
            return out, f"logfmt syntax error at pos {m.end(1) + 1} : unexpected end of key"
        value = m[3] or "" if m[2] is None else _unescaped(m[2])
        if value or keep_empty:
            out[clean(m[1])] = value
    return out, None


def _unescaped(text: str) -> str:
    if "\\" not in text:
        return text
    try:
        return json.loads(f'"{text}"')
    except ValueError:
        return text


# --- label filters -----------------------------------------------------------------------------------------------


def loose_regex(pattern: str):
    """Test of | label =~ "...": simple patterns lose their anchors.

    "" matches everything, .+ what isn't empty, .* everything; text with .* before or after it becomes a substring
    test, as does an alternation of words with a common beginning; plain text stays an equality; the rest is anchored.
    """
    if pattern in ("", ".*"):
        return lambda v: True
    if pattern == ".+":
        return lambda v: v != ""
    body = pattern[1:-1] if pattern.startswith("(") and pattern.endswith(")") and pattern.count("(") == 1 and not pattern.startswith("(?") else pattern
    options = body.split("|")
    if all(re.fullmatch(r"(?:\.\*)?[\w\-/ :=,@#%&~]+(?:\.\*)?", o) for o in options):
        tests, words = [], [o for o in options if ".*" not in o]
        shared = len(words) > 1 and len({w[0] for w in words}) == 1 and len(words) == len(options) and all(len(w) > 1 for w in words)
        for o in options:
            text = o.removeprefix(".*").removesuffix(".*")
            tests.append((text, text != o or shared))
        return lambda v: any(t in v if part else t == v for t, part in tests)
    compiled = re.compile(to_python(pattern))
    return lambda v: compiled.fullmatch(v) is not None


COMPARE = {"=": lambda a, b: a == b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}


class Row:
    __slots__ = ("line", "labels", "meta", "value", "ts")

    def __init__(self, line: str, labels: dict, meta: dict, ts: int):
        self.line, self.labels, self.meta, self.value, self.ts = line, labels, meta, None, ts

    def get(self, name: str) -> str | None:
        if name == "__line__":
            return self.line
        return self.labels.get(name, self.meta.get(name))

    def fail(self, kind: str, details: str) -> None:
        self.labels["__error__"], self.labels["__error_details__"] = kind, details

    def merge(self, found: dict[str, str]) -> None:
        """Clashing names get the suffix _extracted; an empty value never takes the place of such a copy."""
        taken = {n for n in found if n in self.labels or n in self.meta}
        for name, value in sorted(found.items()):
            if name in taken:
                if value == "":
                    continue
                name += "_extracted"
            self.labels[name] = value


def condition(tree):
    """A label filter as a function of the row. 'and' runs both sides, so that either can report an error."""
    if tree[0] == "and":
        a, b = condition(tree[1]), condition(tree[2])
        return lambda r: bool(a(r) & b(r))
    if tree[0] == "or":
        a, b = condition(tree[1]), condition(tree[2])
        return lambda r: a(r) or b(r)
    _, name, op, kind, text = tree
    if kind == "string":
        if op in ("=~", "!~"):
            test = loose_regex(text)
            return (lambda r: test(r.get(name) or "")) if op == "=~" else (lambda r: not test(r.get(name) or ""))
        return lambda r: COMPARE[op](r.get(name) or "", text)
    if kind == "ip":

        def ip(r: Row) -> bool:
            if "__error__" in r.labels:
                return True
            have = r.get(name)
            return have is not None and ip_in(have, text) == (op in ("=", "=="))

        return ip
    parse = {"number": parse_float, "bytes": parse_bytes, "duration": parse_duration}[kind]
    want = parse(text)

    def typed(r: Row) -> bool:
        have = r.get(name)
        if have is None:
            return False
        value = parse(have)
        if value is None:
            if "__error__" not in r.labels:
                r.fail("LabelFilterErr", f"cannot parse {have!r} as {kind}")
            return True
        return COMPARE[op](value, want)

    return typed


def selected(name: str, items, row: Row) -> bool:
    for n, op, value in items:
        if n == name:
            if op is None:
                return True
            have = row.get(name) or ""
            hit = re.fullmatch(to_python(value), have) is not None if op in ("=~", "!~") else have == value
            if hit == (op in ("=", "=~")):
                return True
    return False


def compiled(stage: tuple):
    """A stage as function(row) -> keep?"""
    kind = stage[0]
    if kind == "line":
        _, op, terms = stage
        tests = []
        for k, text in terms:
            if k == "ip":
                tests.append(lambda s, t=text: ip_in(s, t))
            elif op in ("|=", "!="):
                tests.append(lambda s, t=text: t in s)
            elif op in ("|~", "!~"):
                tests.append(lambda s, c=re.compile(to_python(text)): c.search(s) is not None)
            else:
                tests.append(lambda s, c=re.compile(pattern_regex(text, r"\Z")): c.search(s) is not None)
        positive = op[0] == "|"
        return lambda r: any(t(r.line) for t in tests) == positive
    if kind == "json":
        wanted = stage[1]

        def parse_json(r: Row) -> bool:
            try:
                value = json.loads(r.line)
                if not isinstance(value, dict):
                    raise ValueError("not an object")
            except ValueError as e:
                r.fail("JSONParserErr", str(e))
                return True
            r.merge({label: json_path(value, path) for label, path in wanted} if wanted else flatten(value))
            return True

        return parse_json
    if kind == "logfmt":
        _, strict, keep_empty, wanted = stage

        def parse_logfmt(r: Row) -> bool:
            found, error = logfmt(r.line, strict, keep_empty or bool(wanted))
            r.merge({label: found.get(clean(path), "") for label, path in wanted} if wanted else found)
            if error:
                r.fail("LogfmtParserErr", error)
            return True

        return parse_logfmt
    if kind == "regexp":
        c = re.compile(to_python(stage[1]))
        return lambda r: [r.merge({k: v for k, v in m.groupdict().items() if v is not None}) for m in [c.search(r.line)] if m] is not None
    if kind == "pattern":
        return lambda r: r.merge(pattern_fields(stage[1], r.line)) is None
    if kind == "unpack":

        def unpack(r: Row) -> bool:
            try:
                value = json.loads(r.line)
                if not isinstance(value, dict):
                    raise ValueError("not an object")
            except ValueError as e:
                r.fail("JSONParserErr", str(e))
                return True
            r.merge({clean(k): v for k, v in value.items() if isinstance(v, str) and k != "_entry"})
            if isinstance(value.get("_entry"), str):
                r.line = value["_entry"]
            return True

        return unpack
    if kind == "decolorize":
        c = re.compile(COLOUR)

        def decolorize(r: Row) -> bool:
            r.line = c.sub("", r.line)
            return True

        return decolorize
    if kind in ("drop", "keep"):
        items = stage[1]

        def choose(r: Row) -> bool:
            gone = lambda n: selected(n, items, r) if kind == "drop" else not selected(n, items, r) and n not in ERRORS
            out = [n for n in r.labels if gone(n)], [n for n in r.meta if gone(n)]
            for names, part in zip(out, (r.labels, r.meta), strict=True):
                for n in names:
                    del part[n]
            return True

        return choose
    if kind == "filter":
        return condition(stage[1])
    if kind == "line_format":

        def line_format(r: Row) -> bool:
            try:
                r.line = templates.render(stage[1], r.meta | r.labels, r.line, r.ts)
            except templates.TemplateError as e:
                r.fail("TemplateFormatErr", str(e))
            return True

        return line_format
    if kind == "label_format":

        def label_format(r: Row) -> bool:
            for name, how, source in stage[1]:
                if name in ERRORS[:2] and "__error__" in r.labels:
                    continue
                if how == "rename":
                    value = r.labels.pop(source, None)
                    value = r.meta.pop(source, "") if value is None else value
                else:
                    try:
                        value = templates.render(source, r.meta | r.labels, r.line, r.ts)
                    except templates.TemplateError as e:
                        r.fail("TemplateFormatErr", str(e))
                        continue
                if value:
                    r.labels[name] = value
                else:
                    r.labels.pop(name, None)
            return True

        return label_format
    if kind == "unwrap":
        _, name, conversion = stage
        parse = {None: parse_float, "bytes": parse_bytes}.get(conversion, parse_duration)

        def unwrap(r: Row) -> bool:
            text = r.get(name)
            if text is None:
                return False
            r.value = parse(text)
            if r.value is None:
                r.fail("SampleExtractionErr", f"unable to convert unwrap value {text!r}")
            return True

        return unwrap
    if kind == "match":
        terms = set(analyse(stage[1]))
        return lambda r: terms <= set(analyse(r.line))
    raise ValueError(f"unknown stage {kind}")


def run_stages(stages: list[tuple], drop_value_label: str | None):
    """mapInArrow function over (labels, ts_ns, line, metadata, entry_id)."""

    def run(batches):
        steps = [compiled(s) for s in stages]
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(b.num_columns)]
            out = [[] for _ in range(7)]
            for labels, ts, line, meta, eid in zip(*cols, strict=True):
                row = Row(line, {x["name"]: x["value"] for x in labels}, dict(meta or []), ts)
                if all(step(row) for step in steps):
                    error = row.labels.get("__error__")
                    if drop_value_label:
                        row.labels.pop(drop_value_label, None)
                    pairs = [{"name": n, "value": v} for n, v in sorted(row.labels.items()) if v != "" or n in ERRORS]
                    for column, v in zip(out, (pairs, ts, row.line, list(row.meta.items()), eid, row.value, error), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, TYPES, strict=True)], NAMES)

    return run


PAIRS = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
TYPES = [PAIRS, pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.int64(), pa.float64(), pa.string()]
NAMES = ["labels", "ts_ns", "line", "metadata", "entry_id", "value", "error"]
SCHEMA = "labels array<struct<name:string,value:string>>, ts_ns long, line string, metadata map<string,string>, entry_id long, value double, error string"


def column_filter(stage: tuple) -> Column | None:
    """A line filter as a JVM predicate, or None if it needs Python."""
    if stage[0] != "line":
        return None
    _, op, terms = stage
    if any(k == "ip" for k, _ in terms):
        return None
    hit = F.lit(False)
    for _, text in terms:
        hit = hit | (F.contains("line", F.lit(text)) if op in ("|=", "!=") else F.col("line").rlike(pattern_regex(text) if op in ("|>", "!>") else to_java(text)))
    return hit if op[0] == "|" else ~hit
