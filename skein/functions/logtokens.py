"""Tokens, masks and field values of single log lines; pure Python, used inside Arrow UDFs."""

from __future__ import annotations

import datetime as dt
import re
from functools import lru_cache
from itertools import islice

# Level names and their usual spellings.
LEVELS = {
    "trace": "trace", "trc": "trace", "tracing": "trace", "finest": "trace", "verbose": "trace",
    "debug": "debug", "dbg": "debug", "deb": "debug", "dbug": "debug", "fine": "debug",
    "info": "info", "inf": "info", "information": "info", "informational": "info", "notice": "info", "note": "info",
    "warn": "warn", "warning": "warn", "wrn": "warn", "warnning": "warn",
    "error": "error", "err": "error", "eror": "error", "severe": "error",
    "critical": "critical", "crit": "critical", "crt": "critical", "emerg": "critical", "emergency": "critical", "alert": "critical",
    "fatal": "fatal", "ftl": "fatal", "panic": "fatal",
}
# Letters of severity headers, syslog severities 0 to 7.
LETTERS = {"T": "trace", "V": "trace", "D": "debug", "I": "info", "N": "info", "W": "warn", "E": "error", "C": "critical", "F": "fatal"}
SYSLOG = ["critical", "critical", "critical", "error", "warn", "info", "info", "debug"]
# Keys of fields that state a time, a level or a component, in order of preference.
TIME_KEYS = ["timestamp", "ts", "time", "@timestamp", "datetime", "date", "t", "eventtime"]
LEVEL_KEYS = ["level", "lvl", "severity", "loglevel", "log.level", "levelname"]
NAME_KEYS = ["logger", "target", "component", "name", "module", "process", "caller", "file", "source", "logger_name"]
FILE_KEYS = {"caller", "file", "source"}
MONTHS = {m: i + 1 for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split())}

MONTH = "(?:" + "|".join(MONTHS) + ")"
CLOCK = r"\d{1,2}:\d\d:\d\d(?:[.,]\d+)?"
STAMP = rf"(?:\d{{4}}[-/]\d\d[-/]\d\d[T ]{CLOCK}(?: ?(?:Z|[+-]\d\d:?\d\d)(?![\d:]))?|\d{{1,2}}[ /-]{MONTH}[ /-]\d{{4}}[ :]{CLOCK}(?: ?[+-]\d{{4}})?|{MONTH} +\d{{1,2}} (?:\d{{4}} )?{CLOCK})"
COLOUR = r"\x1b\[[0-9;:?]*[A-Za-z]"
WORDS = "|".join(sorted(LEVELS, key=lambda w: (-len(w), w)))
#: What opens an entry: stamp, plain number as stamp, severity letter or word, priority, JSON object, key=value.
OPENS = rf"^(?:[\[(]?{STAMP}|[\[(]?\d{{10}}(?:\.\d+|\d{{3}}|\d{{6}}|\d{{9}})?[\])]?\s|[TVDINWECF]\d{{4}} \d\d:|<\d{{1,3}}>|\[(?i:{WORDS})\]|(?-i:{WORDS.upper()})[: ]|\{{|[A-Za-z_@][\w.@/-]*=)"

_colour = re.compile(COLOUR)
_token = re.compile(rf"<\d{{1,3}}>(?:\d(?= ))?|[\[(]?{STAMP}[\])]?|\S+")
_stamp = re.compile(STAMP)
_stamp_shape = re.compile(rf"^[\[(]?{STAMP}[\])]?$")
_klog = re.compile(r"^([TVDINWECF])(\d\d)(\d\d)$")
_pair = re.compile(r'([A-Za-z_@][\w.@/-]*)=(?:"((?:[^"\\]|\\.)*)"?|(\S*))\s*')
_json_pair = re.compile(r'"((?:[^"\\]|\\.)*)"\s*:\s*(?:"((?:[^"\\]|\\.)*)("?)|([-+\d.eE]+|true|false|null)|([{\[]))|([}\]])')
_word = re.compile(r"^[A-Za-z_]")
_hex = re.compile(r"^(?=\w*\d)[0-9a-fA-F]{6,}$")
_iso = re.compile(r"(\d{4})[-/](\d\d)[-/](\d\d)[T ](\d{1,2}):(\d\d):(\d\d)(?:[.,](\d+))?(?: ?(Z|[+-]\d\d:?\d\d))?")
_day_first = re.compile(rf"(\d{{1,2}})[ /-]({MONTH})[ /-](\d{{4}})[ :](\d{{1,2}}):(\d\d):(\d\d)(?:[.,](\d+))?(?: ?([+-]\d{{4}}))?")
_month_first = re.compile(rf"({MONTH}) +(\d{{1,2}}) (?:(\d{{4}}) )?(\d{{1,2}}):(\d\d):(\d\d)(?:[.,](\d+))?")
_clock = re.compile(r"(\d{1,2}):(\d\d):(\d\d)(?:[.,](\d+))?")
_epoch = dt.datetime(1970, 1, 1)


def plain(line: str) -> str:
    """The line without colour codes and without a carriage return at its end."""
    return _colour.sub("", line).rstrip("\r\n")


def level_of(word: str) -> str | None:
    return LEVELS.get(word.strip("[]()<>:,|").lower())


def layout(line: str) -> str:
    """'json', 'pairs' or 'words'."""
    if line.startswith("{"):
        return "json"
    m = _pair.match(line)
    return "pairs" if m and m.start() == 0 and not _stamp.match(line) else "words"


def json_pairs(text: str) -> list[tuple[str, object]]:
    """(dotted path, value) of every scalar, also of an object that is cut off; arrays are not entered by name."""
    out, stack, key = [], [], ""
    for m in _json_pair.finditer(text):
        if m[6]:
            if stack:
                stack.pop()
            continue
        key = ".".join([*stack, m[1]])
        if m[5]:
            stack.append(m[1])
        elif m[2] is not None:
            out.append((key, _unescape(m[2])))
        else:
            out.append((key, m[4]))
    return out


def _unescape(s: str) -> str:
    if "\\" not in s:
        return s
    import json

    try:
        return json.loads('"' + s.replace("\n", "\\n").replace("\t", "\\t") + '"')
    except ValueError:
        return s


def fields(line: str, kind: str) -> list[tuple[str, str]]:
    """Token list of a line: (key or '', text). Keyed layouts have a token per field, others one per word or stamp."""
    if kind == "json":
        return [(k, "" if v is None else str(v)) for k, v in json_pairs(line)]
    if kind == "pairs":
        out, at = [], 0
        while m := _pair.match(line, at):
            out.append((m[1], (m[2].replace('\\"', '"') if m[2] is not None else m[3] or "")))
            at = m.end()
        return out + [("", w) for w in line[at:].split()]
    return [("", w) for w in _token.findall(line.split("\n", 1)[0])]


def mask(key: str, text: str) -> str:
    """A token's constant part: keys stay, stamps, levels, numbers and ids become classes with their punctuation."""
    return key + "=" if key else _mask(text)


@lru_cache(1 << 16)
def _mask(text: str) -> str:
    if _stamp_shape.match(text):
        return text[0] + "<ts>]" if text[0] in "[(" else "<ts>"
    if _klog.match(text):
        return "<sev>"
    if text[0] == "<" and text[1:2].isdigit():
        return "<pri>" + text[text.index(">") + 1 :]
    if LEVELS.get(text.strip("[]()<>:,|").lower()):
        return "[<lvl>]" if text[0] == "[" else "<lvl>"
    if _hex.match(text):
        return "<hex>"
    return re.sub(r"\d+", "0", text) if any(c.isdigit() for c in text) else text


@lru_cache(1 << 16)
def shape(masked: str) -> str:
    """What a slot must look like for the header grammar: class names and punctuation, without the words."""
    if masked.startswith("<") or masked in ("[<lvl>]", "[-]", "-", "---", "[<ts>]", "(<ts>]"):
        return masked
    if masked.endswith("="):
        return masked
    if masked[0] == "[" and masked[-1] == "]":
        return "[w]"
    if re.fullmatch(r"0#0:", masked):
        return "0#0:"
    if re.fullmatch(r"\d+", masked):
        return "0"
    if re.fullmatch(r"0:0:0[.,]0|0:0:0", masked):
        return "clock"
    if re.fullmatch(r"[\w.\-/]+:0\]", masked):
        return "file:0]"
    if re.fullmatch(r"[\w.\-/]+(?:\[\w*\])?:", masked) and masked.count(":") == 1 and "[" in masked:
        return "proc[0]:"
    if masked[-1] == ":":
        return "w:"
    if masked == ":":
        return ":"
    return "w"


def roles(shapes: list[str], kind: str) -> dict[str, int]:
    """Slots of a template: which token states time, level and component, and where the message begins.

    Keyed layouts: by the name of the key, the first in order of preference, nearest to the top of the object.
    Others: by the order of classes at the head of the line; what stands in the message is never looked at.
    """
    if kind != "words":
        last = [s[:-1].rsplit(".", 1)[-1].lower() if s.endswith("=") else "" for s in shapes]
        depth = [s.count(".") for s in shapes]
        out = {}
        for role, names in (("time", TIME_KEYS), ("level", LEVEL_KEYS), ("name", NAME_KEYS)):
            best = sorted((names.index(k), depth[i], i) for i, k in enumerate(last) if k in names and depth[i] == 0)
            if best:
                out[role] = best[0][2]
        for i, k in enumerate(last):
            if k in ("msg", "message") and "message" not in out:
                out["message"] = i
        return out
    n, out, i = len(shapes), {}, 0
    at = lambda k: shapes[k] if k < n else ""
    if at(0) == "<sev>":  # severity letter with month and day, clock, thread, file:line]
        out = {"level": 0, "time": 1}
        i = 2 + (at(2) == "0")
        if at(i) == "file:0]":
            out["name"] = i
            i += 1
        return out | {"message": i}
    if at(0).startswith("<pri>"):
        out["level"] = 0
        if at(0) != "<pri>":  # version, stamp, host, app, process, message id, data
            return out | {"time": 1, "name": 3, "message": 7} if n > 3 else out | {"time": 1}
        out["time"] = 1
        if at(3) in ("proc[0]:", "w:"):
            out["name"] = 3
        return out | {"message": 4}
    if "ts>" in at(0):
        out["time"] = 0
        i = 1
    if at(i) in ("<lvl>", "[<lvl>]", "[-]") or (at(i) == "[w]" and at(i + 1) == "<lvl>"):
        thread_first = at(i) == "[w]"
        out["level"] = i + thread_first
        i = out["level"] + 1
        if thread_first:  # [thread] LEVEL logger - message
            if at(i) in ("w", "w:") and at(i + 1) == "-":
                return out | {"name": i, "message": i + 2}
            return out | {"message": i}
        if shapes[out["level"]] == "[<lvl>]" and at(i) == "0#0:":  # process#thread: *connection
            return out | {"message": i + 2}
        if at(i) == "0" and at(i + 1) == "---":  # process --- [thread] logger :
            j = i + 2 + at(i + 2).startswith("[")
            while at(j).endswith("]"):
                j += 1
            return out | {"name": j, "message": j + 2}
        if at(i) == "[w]":
            return out | {"name": i, "message": i + 1}
        if at(i) in ("w:", "proc[0]:"):
            return out | {"name": i, "message": i + 1}
        return out | {"message": i}
    if at(i) == "-":  # - logger - LEVEL -
        if at(i + 2) == "-" and at(i + 3) == "<lvl>":
            return out | {"name": i + 1, "level": i + 3, "message": i + 5}
        return out | {"message": i + 1}
    return out | {"message": i}


@lru_cache(1 << 16)
def roles_of(shapes: tuple[str, ...], kind: str) -> dict[str, int]:
    return roles(list(shapes), kind)


@lru_cache(1 << 16)
def fits(own: tuple[str, ...], template: tuple[str, ...], kind: str) -> bool:
    """Whether a line of these shapes belongs to the template: equal keys, or an equal header but for one word of no
    known class that the template takes for the time or the level. The header ends where the grammar looks no further: with the
    second token of the message."""
    if kind != "words" or len(own) != len(template):
        return own == template
    role = roles_of(template, kind)
    end = min(max(role.values(), default=0) + 2, len(template))
    other = [i for i in range(end) if own[i] != template[i]]
    return not other or (len(other) == 1 and other[0] in (role.get("time"), role.get("level")) and own[other[0]] in ("w", "[w]"))


def head(line: str, count: int) -> list[tuple[str, str]]:
    """The first ``count`` tokens of a line of words."""
    return [("", m[0]) for m in islice(_token.finditer(line.split("\n", 1)[0]), count)]


def _ms(year, month, day, hour, minute, second, fraction, zone) -> int | None:
    try:
        when = dt.datetime(int(year), int(month), int(day), int(hour), int(minute), min(int(second), 59))
    except ValueError:
        return None
    ms = ((when - _epoch).days * 86_400 + (when - _epoch).seconds) * 1000 + int(((fraction or "") + "000")[:3])
    if zone and zone != "Z":
        digits = zone[1:].replace(":", "")
        off = (int(digits[:2]) * 60 + int(digits[2:])) * 60_000
        ms -= off if zone[0] == "+" else -off
    return ms


def time_of(text: str, year: int) -> int | None:
    """UTC epoch milliseconds of a stamp, cut; ``year`` for stamps without one."""
    if m := _iso.search(text):
        return _ms(*m.groups())
    if m := _day_first.search(text):
        return _ms(m[3], MONTHS[m[2]], m[1], m[4], m[5], m[6], m[7], m[8])
    if m := _month_first.search(text):
        return _ms(m[3] or year, MONTHS[m[1]], m[2], m[4], m[5], m[6], m[7], None)
    if m := re.fullmatch(r"[\[(]?(\d+)(?:\.(\d*))?[\])]?", text.strip()):
        whole = int(m[1])
        for size, per_ms in ((10**17, 10**6), (10**14, 10**3), (10**11, 1)):
            if whole >= size:
                return whole // per_ms
        return whole * 1000 + int(((m[2] or "") + "000")[:3])
    return None


def component_of(text: str, key: str = "") -> str | None:
    """A name as written, without process or line number, brackets, thread or, of a source file, extension."""
    name = text.strip().strip("[]()")
    name = re.sub(r"\[[^\]]*\]?:?$", "", name).rstrip(":").strip()
    name = re.sub(r":\d+\]?$", "", name)
    if (key in FILE_KEYS or text.endswith("]") and ":" in text) and "." in name:
        name = name.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return name or None


def extract(line: str, tokens: list[tuple[str, str]], role: dict[str, int], year: int) -> tuple[int | None, str | None, str | None, str]:
    """(event_ms, level, component, message) by a template's slots; None where a slot has no such value."""
    n = len(tokens)
    slot = lambda r: tokens[role[r]] if r in role and role[r] < n else None
    event = level = name = None
    if (t := slot("time")) and t[1]:
        if "level" in role and role["level"] == 0 and (m := _klog.match(tokens[0][1])) and (c := _clock.match(t[1])):
            event = _ms(year, m[2], m[3], c[1], c[2], c[3], c[4], None)
        else:
            event = time_of(t[1], year)
    if (t := slot("level")) and t[1]:
        if m := _klog.match(t[1]):
            level = LETTERS[m[1]]
        elif not t[0] and t[1][0] == "<" and t[1][1].isdigit():
            level = SYSLOG[int(t[1][1 : t[1].index(">")]) % 8]
        elif t[1].isdigit() and t[0] == "severity" and len(t[1]) == 1:
            level = SYSLOG[int(t[1]) % 8]
        else:
            level = level_of(t[1])
    if (t := slot("name")) and t[1]:
        name = component_of(t[1], t[0].rsplit(".", 1)[-1])
        if name == "-":
            name = None
    if role.get("message", n) < n and tokens[role["message"]][0]:
        message = tokens[role["message"]][1]
    elif not any(k for k, _ in tokens):
        head, at = role.get("message", 0), 0
        for _, w in tokens[:head]:
            at = line.index(w, at) + len(w)
        message = line[at:].strip()
    else:
        message = line
    return event, level, name, message
