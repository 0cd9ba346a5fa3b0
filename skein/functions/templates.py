"""Line and label templates: Go's text/template with its usual helper functions, and a small Jinja subset.

A template is parsed once on the driver into plain nested tuples, which travel to the workers, and is evaluated per
row inside an Arrow UDF.
"""

from __future__ import annotations

import base64
import datetime as dt
import html
import json
import math
import re
import urllib.parse

from skein.functions.numbers import format_float, parse_bytes, parse_duration


class TemplateError(ValueError):
    pass


def text_of(v) -> str:
    if v is None:
        return "<no value>"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return format_float(v) if abs(v) < 1e21 and (abs(v) >= 1e-4 or v == 0) else repr(v).replace("e-0", "e-").replace("e+0", "e+")
    if isinstance(v, list):
        return "[" + " ".join(map(text_of, v)) + "]"
    if isinstance(v, dict):
        return "map[" + " ".join(f"{k}:{text_of(x)}" for k, x in sorted(v.items())) + "]"
    return str(v)


def truth(v) -> bool:
    return bool(v) if not isinstance(v, float) else v != 0


#: Bounds of one rendering: nodes run, characters put out, templates within templates.
MOST_STEPS, MOST_OUTPUT, MOST_DEPTH = 100_000, 1 << 20, 100


def _int(v) -> int:
    if isinstance(v, (int, float)):
        return int(v)
    try:
        return int(v)
    except (TypeError, ValueError):
        f = _float(v)
        return int(f) if math.isfinite(f) else 0


def _float(v) -> float:
    try:
        return float(v)
    except (TypeError, ValueError):
        return 0.0


_EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.UTC)


class Instant(dt.datetime):
    """A time in UTC that keeps its nanoseconds."""

    nanos = 0

    @classmethod
    def of(cls, nanos: int) -> Instant:
        t = _EPOCH + dt.timedelta(seconds=nanos // 10**9, microseconds=nanos % 10**9 // 1000)
        out = cls(t.year, t.month, t.day, t.hour, t.minute, t.second, t.microsecond, tzinfo=dt.UTC)
        out.nanos = nanos
        return out


def nanos_of(t: dt.datetime) -> int:
    if isinstance(t, Instant):
        return t.nanos
    d = t - _EPOCH
    return ((d.days * 86_400 + d.seconds) * 10**6 + d.microseconds) * 1000


def _repeat(n, s: str) -> str:
    n = max(0, _int(n))
    if n * len(s) > MOST_OUTPUT:
        raise TemplateError("output limit exceeded")
    return s * n


def _div(a: int, b: int) -> int:
    if b == 0:
        raise TemplateError("division by zero")
    return abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)


def _mod(a: int, b: int) -> int:
    if b == 0:
        raise TemplateError("division by zero")
    return abs(a) % abs(b) * (-1 if a < 0 else 1)


def _re(pattern: str) -> re.Pattern:
    try:
        return re.compile(pattern.replace("(?<", "(?P<") if "(?P<" not in pattern else pattern)
    except re.error as e:
        raise TemplateError(str(e)) from e


def _expand(template: str) -> str:
    return re.sub(r"\$(?:\{(\w+)\}|(\d+))", lambda m: rf"\g<{m[1] or m[2]}>", template.replace("\\", "\\\\"))


def printf(form: str, *args) -> str:
    rest = list(args)

    def one(m: re.Match) -> str:
        flags, width, precision, verb = m[1], m[2], m[3], m[4]
        if verb == "%":
            return "%"
        if not rest:
            return f"%!{verb}(MISSING)"
        v = rest.pop(0)
        spec = "%" + flags + width + (precision or "")
        if verb in "dxXobc":
            n = _int(v)
            if verb == "b":
                return (("%" + flags.replace("0", "") + width + "s") % format(n, "b"))
            return (spec + verb) % n
        if verb in "feEgG":
            return (spec + verb) % _float(v)
        if verb == "q":
            return json.dumps(text_of(v), ensure_ascii=False)
        if verb == "t":
            return text_of(bool(v))
        if verb == "T":
            return {str: "string", int: "int", float: "float64", bool: "bool"}.get(type(v), "interface {}")
        return (spec.replace("0" if not width else "\0", "") + "s") % text_of(v)

    return re.sub(r"%([-+# 0]*)(\d*)(\.\d+)?([a-zA-Z%])", one, form)


LAYOUT = [("2006", "%Y"), ("January", "%B"), ("Jan", "%b"), ("01", "%m"), ("Monday", "%A"), ("Mon", "%a"), ("02", "%d"), ("15", "%H"), ("03", "%I"), ("04", "%M"), ("05", "%S"), ("PM", "%p"), ("06", "%y"), ("MST", "%Z"), ("-0700", "%z"), ("Z07:00", "%z")]


def go_date(layout: str, t: dt.datetime) -> str:
    out, i = [], 0
    while i < len(layout):
        if m := re.match(r"\.(0+|9+)", layout[i:]):
            digits = f"{nanos_of(t) % 10**9:09d}"[: len(m[1])]
            digits = digits.rstrip("0") if m[1][0] == "9" else digits
            out.append("." + digits if digits else "")
            i += len(m[0])
            continue
        for name, code in LAYOUT:
            if layout.startswith(name, i):
                out.append("Z" if name == "Z07:00" and not t.utcoffset() else t.strftime(code))
                i += len(name)
                break
        else:
            out.append(layout[i])
            i += 1
    return "".join(out)


def to_date(layout: str, text: str, zone: str = "UTC") -> dt.datetime:
    from zoneinfo import ZoneInfo

    form = re.sub(r"\.(0+|9+)", ".%f", layout)
    for name, code in LAYOUT:
        form = form.replace(name, code) if "%" + name not in form else form
    try:
        t = dt.datetime.strptime(text, form)
    except ValueError as e:
        raise TemplateError(str(e)) from e
    return t if t.tzinfo else t.replace(tzinfo=ZoneInfo(zone))


def _epoch(v) -> dt.datetime:
    n = _int(v)
    digits = len(str(abs(n)))
    return dt.datetime.fromtimestamp(n / (1 if digits <= 10 else 1e3 if digits <= 13 else 1e6 if digits <= 16 else 1e9), dt.UTC)


def _compare(a, b) -> int:
    if isinstance(a, str) != isinstance(b, str):
        raise TemplateError("incompatible types for comparison")
    return (a > b) - (a < b)


def _align(v: str, n: int, right: bool) -> str:
    n = max(0, _int(n))
    return (v[-n:] if right and n else v[:n]).rjust(n) if right else v[:n].ljust(n)


def _cut(n, v: str) -> str:
    n = _int(n)
    return v[:n] if n >= 0 else v[n:]


def _substr(a, b, v: str) -> str:
    a, b = _int(a), _int(b)
    a, b = max(a, 0), len(v) if b < 0 or b > len(v) else b
    return v[a:b] if a <= b else ""


def _from_json(v: str):
    try:
        return json.loads(v)
    except ValueError as e:
        raise TemplateError(str(e)) from e


def _need(value, what: str):
    if value is None:
        raise TemplateError(f"bad {what}")
    return value


S = text_of
FUNCTIONS = {
    "Replace": lambda s, a, b, n: s.replace(a, b, _int(n)), "replace": lambda a, b, s: s.replace(a, b), "ToLower": lambda s: s.lower(), "lower": lambda s: s.lower(),
    "ToUpper": lambda s: s.upper(), "upper": lambda s: s.upper(), "Trim": lambda s, c: s.strip(c), "TrimLeft": lambda s, c: s.lstrip(c), "TrimRight": lambda s, c: s.rstrip(c),
    "TrimPrefix": lambda s, p: s.removeprefix(p), "TrimSuffix": lambda s, p: s.removesuffix(p), "TrimSpace": lambda s: s.strip(), "trim": lambda s: s.strip(),
    "trimPrefix": lambda p, s: s.removeprefix(p), "trimSuffix": lambda p, s: s.removesuffix(p), "trimAll": lambda c, s: s.strip(c), "title": lambda s: re.sub(r"\b\w", lambda m: m[0].upper(), s),
    "contains": lambda p, s: p in s, "hasPrefix": lambda p, s: s.startswith(p), "hasSuffix": lambda p, s: s.endswith(p), "repeat": _repeat, "trunc": _cut, "substr": _substr,
    "indent": lambda n, s: " " * _int(n) + s.replace("\n", "\n" + " " * _int(n)), "nindent": lambda n, s: "\n" + " " * _int(n) + s.replace("\n", "\n" + " " * _int(n)),
    "alignLeft": lambda n, s: _align(s, n, False), "alignRight": lambda n, s: _align(s, n, True), "default": lambda d, v="": v if truth(v) else d, "count": lambda p, s: len(_re(p).findall(s)),
    "regexReplaceAll": lambda p, s, r: _re(p).sub(_expand(r), s), "regexReplaceAllLiteral": lambda p, s, r: _re(p).sub(lambda _: r, s), "fromJson": _from_json,
    "int": _int, "float64": _float, "add": lambda *a: sum(map(_int, a)), "sub": lambda a, b: _int(a) - _int(b), "mul": lambda *a: math.prod(map(_int, a)), "div": lambda a, b: _div(_int(a), _int(b)),
    "mod": lambda a, b: _mod(_int(a), _int(b)), "max": lambda *a: max(map(_int, a)), "min": lambda *a: min(map(_int, a)), "addf": lambda *a: sum(map(_float, a)), "subf": lambda a, *b: _float(a) - sum(map(_float, b)),
    "mulf": lambda *a: math.prod(map(_float, a)), "divf": lambda a, *b: _float(a) / math.prod(map(_float, b)) if math.prod(map(_float, b)) else math.inf * (1 if _float(a) > 0 else -1) if _float(a) else math.nan,
    "maxf": lambda *a: max(map(_float, a)), "minf": lambda *a: min(map(_float, a)), "ceil": lambda a: float(math.ceil(_float(a))), "floor": lambda a: float(math.floor(_float(a))),
    "round": lambda a, n, *_: math.floor(_float(a) * 10 ** _int(n) + 0.5) / 10 ** _int(n), "bytes": lambda s: _need(parse_bytes(s), "bytes"), "duration": lambda s: _need(parse_duration(s), "duration"),
    "duration_seconds": lambda s: _need(parse_duration(s), "duration"), "b64enc": lambda s: base64.b64encode(s.encode()).decode(), "b64dec": lambda s: base64.b64decode(s).decode(errors="replace"),
    "urlencode": lambda s: urllib.parse.quote_plus(s), "urldecode": lambda s: urllib.parse.unquote_plus(s), "now": lambda: dt.datetime.now(dt.UTC), "unixEpoch": lambda t: str(nanos_of(t) // 10**9),
    "unixEpochMillis": lambda t: str(nanos_of(t) // 10**6), "unixEpochNanos": lambda t: str(nanos_of(t)), "unixToTime": _epoch, "date": lambda f, t: go_date(f, t),
    "toDate": lambda f, s: to_date(f, s), "toDateInZone": lambda f, z, s: to_date(f, s, z),
    "not": lambda a: not truth(a), "eq": lambda a, *b: any(a == x for x in b), "ne": lambda a, b: a != b, "lt": lambda a, b: _compare(a, b) < 0, "le": lambda a, b: _compare(a, b) <= 0,
    "gt": lambda a, b: _compare(a, b) > 0, "ge": lambda a, b: _compare(a, b) >= 0, "len": lambda a: len(a.encode()) if isinstance(a, str) else len(a), "print": lambda *a: "".join(map(S, a)),
    "println": lambda *a: " ".join(map(S, a)) + "\n", "printf": printf, "html": lambda *a: html.escape("".join(map(S, a))).replace("&quot;", "&#34;").replace("&#x27;", "&#39;"), "js": lambda *a: json.dumps("".join(map(S, a)))[1:-1], "urlquery": lambda *a: urllib.parse.quote_plus("".join(map(S, a))),
    "slice": lambda v, *i: v[slice(*map(_int, i))] if len(i) != 1 else v[_int(i[0]) :],
}


def _index(v, *keys):
    for k in keys:
        try:
            v = v.get(k) if isinstance(v, dict) else v[_int(k)]
        except (IndexError, TypeError, AttributeError) as e:
            raise TemplateError(str(e)) from e
    return v


FUNCTIONS["index"] = _index

_ITEM = re.compile(r'\s+|("(?:[^"\\]|\\.)*"|`[^`]*`|\'(?:[^\'\\]|\\.)*\')|(-?\d+\.?\d*(?:[eE][+-]?\d+)?)|(\$?[\w]*(?:\.[\w]+)+|\$[\w]*|\.)|(:=|=|,|\||\(|\))|([A-Za-z_]\w*)')


def _unquote(q: str) -> str:
    if q[0] == "`":
        return q[1:-1]
    try:
        return json.loads('"' + q[1:-1].replace("\\'", "'").replace('"' if q[0] == "'" else "\0", '\\"') + '"')
    except ValueError as e:
        raise TemplateError(f"bad string {q}") from e


def _tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _ITEM.match(text, at)
        if not m or m.end() == at:
            raise TemplateError(f"unexpected {text[at:]!r} in template")
        for kind, value in zip(("str", "num", "ref", "op", "word"), m.groups(), strict=True):
            if value is not None:
                out.append((kind, value))
        at = m.end()
    return out


class _Pipe:
    """Parses one action's pipeline into ('call', name, args), ('ref', ...), ('lit', ...) tuples."""

    def __init__(self, text: str):
        self.t, self.i = _tokens(text), 0

    def at(self, text: str) -> bool:
        return self.i < len(self.t) and self.t[self.i] == ("op", text)

    def parse(self):
        target = None
        if len(self.t) > 1 and self.t[0][0] == "ref" and self.t[0][1].startswith("$") and self.t[1][1] in (":=", "="):
            target = self.t[0][1]
            self.i = 2
        node = self.pipe()
        if self.i != len(self.t):
            raise TemplateError("unexpected token in template")
        return ("set", target, node) if target else node

    def pipe(self):
        node = self.command(None)
        while self.at("|"):
            self.i += 1
            node = self.command(node)
        return node

    def command(self, last):
        args = []
        while self.i < len(self.t) and not self.at("|") and not self.at(")"):
            args.append(self.operand())
        if not args:
            raise TemplateError("missing value for command")
        head = args[0]
        if head[0] == "name":
            if head[1] not in FUNCTIONS and head[1] not in ("and", "or", "__line__", "__timestamp__"):
                raise TemplateError(f'function "{head[1]}" not defined')
            return ("call", head[1], tuple(args[1:]) + ((last,) if last is not None else ()))
        if len(args) > 1 or last is not None:
            raise TemplateError("can't give argument to non-function")
        return head

    def operand(self):
        kind, text = self.t[self.i]
        self.i += 1
        if kind == "str":
            return ("lit", _unquote(text))
        if kind == "num":
            return ("lit", float(text) if re.search(r"[.eE]", text) else int(text))
        if kind == "ref":
            root, *path = text.split(".")
            return ("ref", root, tuple(p for p in path if p))
        if kind == "word":
            return ("lit", {"true": True, "false": False, "nil": None}[text]) if text in ("true", "false", "nil") else ("name", text) if not self._argument() else ("call", text, ())
        if text == "(":
            node = self.pipe()
            if not self.at(")"):
                raise TemplateError("unclosed left paren")
            self.i += 1
            return node
        raise TemplateError(f"unexpected {text!r} in template")

    def _argument(self) -> bool:
        before = self.t[self.i - 2] if self.i > 1 else ("op", "|")
        return before[0] != "op"


def parse_go(source: str):
    """Nested tuples: ('text', s), ('out', pipe), ('if' | 'with' | 'range', pipe, body, else, names), ('break',), ('continue',)."""
    parts = re.split(r"(\{\{-?\s.*?\s-?\}\}|\{\{.*?\}\})", source, flags=re.S)
    trim, items = False, []
    for i, part in enumerate(parts):
        if i % 2 == 0:
            text = part.lstrip() if trim else part
            if i + 1 < len(parts) and re.match(r"\{\{-\s", parts[i + 1]):
                text = text.rstrip()
            if text:
                if "{{" in text:
                    raise TemplateError("unclosed action")
                items.append(("text", text))
        else:
            trim = bool(re.search(r"\s-\}\}$", part))
            body = re.sub(r"^\{\{(?:-\s)?|(?:\s-)?\}\}$", "", part).strip()
            if not (body.startswith("/*") and body.endswith("*/")):
                items.append(("action", body))
    defined: dict[str, tuple] = {}
    position = 0

    def block(*ends: str):
        nonlocal position
        out = []
        while position < len(items):
            kind, body = items[position]
            position += 1
            if kind == "text":
                out.append(("text", body))
                continue
            word = body.split(None, 1)[0] if body else ""
            rest = body[len(word) :].strip()
            if word in ("end", "else") and word in ends:
                return tuple(out), word, rest
            if word in ("if", "with", "range"):
                out.append(control(word, rest))
            elif word in ("break", "continue"):
                out.append((word,))
            elif word in ("define", "block"):
                name, _, pipe = rest.partition(" ")
                inner, _, _ = block("end")
                defined[_unquote(name)] = inner
                if word == "block":
                    out.append(("template", _unquote(name), _Pipe(pipe or ".").parse()))
            elif word == "template":
                name, _, pipe = rest.partition(" ")
                out.append(("template", _unquote(name), _Pipe(pipe).parse() if pipe.strip() else ("lit", None)))
            elif word in ("end", "else"):
                raise TemplateError(f"unexpected {{{{{word}}}}}")
            else:
                out.append(("out", _Pipe(body).parse()))
        if ends:
            raise TemplateError("unexpected EOF")
        return tuple(out), "", ""

    def control(word: str, text: str):
        names: tuple = ()
        if word == "range" and (m := re.match(r"(\$\w+)(?:\s*,\s*(\$\w+))?\s*:=\s*(.*)", text, re.S)):
            names, text = tuple(n for n in m.groups()[:2] if n), m[3]
        pipe = _Pipe(text).parse()
        body, ended, rest = block("else", "end")
        other: tuple = ()
        if ended == "else":
            if rest.startswith(("if", "with")):
                again, _, more = rest.partition(" ")
                other = (control(again, more),)
            else:
                other, _, _ = block("end")
        return (word, pipe, body, other, names)

    nodes, _, _ = block()
    return ("go", nodes, defined)


class _Break(Exception):
    pass


class _Continue(Exception):
    pass


def render_go(program, labels: dict[str, str], line: str, ts_ns: int) -> str:
    _, nodes, defined = program
    out: list[str] = []
    variables: dict[str, object] = {"$": labels}
    spent = {"steps": 0, "output": 0, "depth": 0}

    def charge(what: str, amount: int, most: int) -> None:
        spent[what] += amount
        if spent[what] > most:
            raise TemplateError(f"{what} limit exceeded")

    def put(text: str) -> None:
        charge("output", len(text), MOST_OUTPUT)
        out.append(text)

    def value(node, dot):
        kind = node[0]
        if kind == "lit":
            return node[1]
        if kind == "set":
            variables[node[1]] = value(node[2], dot)
            return None
        if kind == "ref":
            v = dot if node[1] == "" else variables.get(node[1], labels if node[1] == "$" else None)
            for p in node[2]:
                v = v.get(p, "" if v is labels else None) if isinstance(v, dict) else None
            return v
        name, args = node[1], node[2]
        if name == "__line__":
            return line
        if name == "__timestamp__":
            return Instant.of(ts_ns)
        if name in ("and", "or"):
            v = None
            for a in args:
                v = value(a, dot)
                if truth(v) == (name == "or"):
                    return v
            return v
        try:
            return FUNCTIONS[name](*[value(a, dot) for a in args])
        except (TypeError, AttributeError, ValueError, OverflowError) as e:
            raise TemplateError(f"error calling {name}: {e}") from e

    def run(body, dot) -> None:
        for node in body:
            charge("steps", 1, MOST_STEPS)
            kind = node[0]
            if kind == "text":
                put(node[1])
            elif kind == "out":
                v = value(node[1], dot)
                if node[1][0] != "set":
                    put(text_of(v))
            elif kind == "if":
                run(node[2] if truth(value(node[1], dot)) else node[3], dot)
            elif kind == "with":
                v = value(node[1], dot)
                run(node[2], v) if truth(v) else run(node[3], dot)
            elif kind == "range":
                v = value(node[1], dot)
                pairs = sorted(v.items()) if isinstance(v, dict) else list(enumerate(range(v) if isinstance(v, int) else v or []))
                if not pairs:
                    run(node[3], dot)
                for k, x in pairs:
                    for n, y in zip(node[4], (k, x) if len(node[4]) == 2 else (x,), strict=False):
                        variables[n] = y
                    try:
                        run(node[2], x)
                    except _Continue:
                        continue
                    except _Break:
                        break
            elif kind == "template":
                if node[1] not in defined:
                    raise TemplateError(f"template {node[1]!r} not defined")
                charge("depth", 1, MOST_DEPTH)
                run(defined[node[1]], value(node[2], dot))
                spent["depth"] -= 1
            else:
                raise _Break if kind == "break" else _Continue

    run(nodes, labels)
    return "".join(out)


# Filters of the Jinja subset.
FILTERS = {
    "upper": lambda v: S(v).upper(), "lower": lambda v: S(v).lower(), "trim": lambda v: S(v).strip(), "length": len, "title": lambda v: S(v).title(), "capitalize": lambda v: S(v).capitalize(),
    "default": lambda v, d="": v if v else d, "replace": lambda v, a, b: S(v).replace(a, b), "int": lambda v: _int(v), "float": lambda v: _float(v), "string": S, "abs": lambda v: abs(v),
    "round": lambda v, n=0: round(_float(v), n), "tojson": lambda v: json.dumps(v), "urlencode": lambda v: urllib.parse.quote(S(v)), "first": lambda v: v[0] if v else "", "last": lambda v: v[-1] if v else "",
    "join": lambda v, s="": s.join(map(S, v)), "reverse": lambda v: v[::-1], "list": list,
}


def parse_jinja(source: str):
    """('jinja', nodes): text, {{ expr | filter(args) }}, {% if %} {% elif %} {% else %} and {% for x in expr %}."""
    parts = re.split(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", source, flags=re.S)
    position = 0

    def expr(text: str) -> str:
        text = text.strip()
        try:
            compile(_python(text), "<template>", "eval")
        except SyntaxError as e:
            raise TemplateError(f"bad expression {text!r}") from e
        return text

    def block(*ends: str):
        nonlocal position
        out = []
        while position < len(parts):
            part = parts[position]
            position += 1
            if part.startswith("{{"):
                out.append(("out", expr(part[2:-2].strip("-"))))
            elif part.startswith("{%"):
                body = part[2:-2].strip("-").strip()
                word, _, rest = body.partition(" ")
                if word in ends:
                    return tuple(out), word, rest
                if word == "if":
                    branches, test = [], expr(rest)
                    while True:
                        inner, ended, more = block("elif", "else", "endif")
                        branches.append((test, inner))
                        if ended == "endif":
                            break
                        test = expr(more) if ended == "elif" else "true"
                    out.append(("if", tuple(branches)))
                elif word == "for":
                    name, _, seq = rest.partition(" in ")
                    inner, _, _ = block("endfor")
                    out.append(("for", name.strip(), expr(seq), inner))
                else:
                    raise TemplateError(f"unknown tag {word!r}")
            elif part and not part.startswith("{#"):
                out.append(("text", part))
        if ends:
            raise TemplateError("unexpected end of template")
        return tuple(out), "", ""

    return ("jinja", block()[0])


def _python(text: str) -> str:
    """The expression with filters as nested calls of f('name', value, args)."""
    pieces = re.split(r"""\|(?=(?:[^"']|"[^"]*"|'[^']*')*$)""", text)
    out = pieces[0].strip()
    for piece in pieces[1:]:
        m = re.fullmatch(r"\s*(\w+)\s*(?:\((.*)\))?\s*", piece, re.S)
        if not m or m[1] not in FILTERS:
            raise TemplateError(f"unknown filter {piece.strip()!r}")
        out = f"f_('{m[1]}', {out}" + (f", {m[2]}" if m[2] else "") + ")"
    return out



def render_jinja(program, labels: dict[str, str], line: str, ts_ns: int) -> str:
    import ast

    scope = dict(labels) | {"__line__": line, "__timestamp__": ts_ns, "__labels__": labels, "true": True, "false": False, "none": None}

    def walk(n):
        """Evaluates the few node kinds of an expression; nothing else of Python is reachable."""
        if isinstance(n, ast.Expression):
            return walk(n.body)
        if isinstance(n, ast.Constant):
            return n.value
        if isinstance(n, ast.Name):
            return scope.get(n.id, "")
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id == "f_":
            name, *args = map(walk, n.args)
            return FILTERS[name](*args)
        if isinstance(n, ast.Subscript):
            return _index(walk(n.value), walk(n.slice))
        if isinstance(n, ast.Attribute):
            return _index(walk(n.value), n.attr)
        if isinstance(n, ast.List):
            return [walk(x) for x in n.elts]
        if isinstance(n, ast.BoolOp):
            v = None
            for x in n.values:
                v = walk(x)
                if truth(v) == isinstance(n.op, ast.Or):
                    return v
            return v
        if isinstance(n, ast.UnaryOp):
            v = walk(n.operand)
            return not truth(v) if isinstance(n.op, ast.Not) else -v
        if isinstance(n, ast.BinOp):
            a, b = walk(n.left), walk(n.right)
            f = {ast.Add: lambda: a + b, ast.Sub: lambda: a - b, ast.Mult: lambda: a * b, ast.Div: lambda: a / b, ast.Mod: lambda: a % b, ast.FloorDiv: lambda: a // b}.get(type(n.op))
            if f:
                return f()
        if isinstance(n, ast.Compare) and len(n.ops) == 1:
            a, b = walk(n.left), walk(n.comparators[0])
            f = {ast.Eq: lambda: a == b, ast.NotEq: lambda: a != b, ast.Lt: lambda: a < b, ast.LtE: lambda: a <= b, ast.Gt: lambda: a > b, ast.GtE: lambda: a >= b, ast.In: lambda: a in b, ast.NotIn: lambda: a not in b}.get(type(n.ops[0]))
            if f:
                return f()
        raise TemplateError("unsupported expression")

    def value(text: str):
        try:
            return walk(ast.parse(_python(text), mode="eval"))
        except (TypeError, ValueError, ZeroDivisionError, KeyError) as e:
            raise TemplateError(str(e)) from e

    out: list[str] = []

    def run(nodes) -> None:
        for n in nodes:
            if n[0] == "text":
                out.append(n[1])
            elif n[0] == "out":
                v = value(n[1])
                out.append("" if v is None else text_of(v))
            elif n[0] == "if":
                for test, body in n[1]:
                    if truth(value(test)):
                        run(body)
                        break
            else:
                for x in value(n[2]) or []:
                    scope[n[1]] = x
                    run(n[3])

    run(program[1])
    return "".join(out)


def parse(source: str, jinja: bool = False):
    return parse_jinja(source) if jinja else parse_go(source)


def render(program, labels: dict[str, str], line: str, ts_ns: int) -> str:
    return (render_go if program[0] == "go" else render_jinja)(program, labels, line, ts_ns)
