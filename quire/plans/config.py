"""Settings files: nested sections of keys and values, with defaults beneath.

The notation is that of common configuration files: "key = value", "key: value"
and "section { ... }", dotted keys, # and // comments, quoted strings, lists in
brackets, ${key} for a value set before, and include "file" for another file's
keys. A key that no job knows is an error, so that a slip of the pen does not
fall back to a default in silence.
"""

from __future__ import annotations

import os
import re

DEFAULTS = {
    "views.keepRedirects": False, "views.minDailyVisits": 100, "views.minDailyVisitsHourlySplit": 0,
    "peaks.burstRate": 5.0, "peaks.burstCount": 3, "peaks.activityZScore": False, "peaks.pearsonCorrelation": False,
    "peaks.includeCategories": False, "peaks.zscore.lag": 72, "peaks.zscore.threshold": 3.0, "peaks.zscore.influence": 0.01,
    "peaks.zscore.activityThreshold": 5, "peaks.zscore.saveOutput": False, "peaks.minEdgeWeight": 1.0, "peaks.dailyMinThreshold": 200,
    "store.keyspace": "pages", "store.tableVisits": "page_visits", "store.tableMeta": "pagecount_metadata",
}
#: Keys without a default.
OPTIONAL = {
    "peaks.startDate", "peaks.endDate", "peaks.useTableStats", "store.tableStats", "store.host", "store.port", "store.username", "store.password",
    "graph.url", "graph.user", "graph.password", "graph.database",
}
#: Other names of the sections.
SECTIONS = {"pagecountProcessor": "views", "peakfinder": "peaks", "cassandra.db": "store", "neo4j": "graph"}
_TOKEN = re.compile(r'\s*(?:(#|//)[^\n]*|("(?:[^"\\]|\\.)*")|(\$\{[^}]*\})|([{}\[\]=:,\n])|([^\s{}\[\]=:,#"$]+))|[^\S\n]+')


def _tokens(text: str) -> list[tuple[str, str]]:
    """(kind, text): quoted, reference, mark or word; line ends are marks."""
    out, at, text = [], 0, text + "\n"
    while at < len(text):
        if text[at] in " \t\r":
            at += 1
            continue
        if text[at] == "\n":
            out.append(("mark", "\n"))
            at += 1
            continue
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"cannot read {text[at : at + 20]!r}")
        comment, quoted, reference, mark, word = m.groups()
        if not comment:
            out.append(next((k, v) for k, v in (("quoted", quoted), ("reference", reference), ("mark", mark), ("word", word)) if v))
        at = m.end()
    return out


def _value(kind: str, text: str, known: dict):
    if kind == "quoted":
        return re.sub(r"\\(.)", r"\1", text[1:-1])
    if kind == "reference":
        if (key := _named(text[2:-1].strip())) not in known:
            raise ValueError(f"{text} is not set")
        return known[key]
    if text in ("true", "false"):
        return text == "true"
    for number in (int, float):
        try:
            return number(text)
        except ValueError:
            continue
    return text


def _named(key: str) -> str:
    for other, own in SECTIONS.items():
        if key == other or key.startswith(f"{other}."):
            return own + key[len(other) :]
    return key


def parse(text: str, base: str = ".") -> dict:
    """Dotted keys of nested sections, on top of DEFAULTS; base: the folder that included files lie in."""
    out = dict(DEFAULTS)
    _read(text, base, out)
    return out


def _read(text: str, base: str, out: dict) -> None:
    tokens, at, path = _tokens(text), 0, []
    peek = lambda: tokens[at] if at < len(tokens) else ("mark", "")
    while at < len(tokens):
        kind, word = tokens[at]
        at += 1
        if kind == "mark" and word in "\n,":
            continue
        if (kind, word) == ("mark", "}"):
            if not path:
                raise ValueError("a section ends that has not begun")
            path.pop()
            continue
        if kind == "mark" or kind == "reference":
            raise ValueError(f"{word!r} where a key should be")
        if word == "include" and peek()[0] == "quoted":
            with open(os.path.join(base, tokens[at][1][1:-1]), encoding="utf-8") as f:
                _read(f.read(), base, out)
            at += 1
            continue
        name = word[1:-1] if kind == "quoted" else word
        while peek() == ("mark", "\n"):
            at += 1
        if peek() in (("mark", "="), ("mark", ":")):
            at += 1
        if peek() == ("mark", "{"):
            at += 1
            path.append(name)
            continue
        if peek() == ("mark", "["):
            at += 1
            value = []
            while peek() != ("mark", "]"):
                if at >= len(tokens):
                    raise ValueError(f"the list of {name} has no end")
                if peek()[0] != "mark":
                    value.append(_value(*peek(), out))
                at += 1
            at += 1
        else:
            # Colons and commas inside an unquoted value belong to it up to the end of the line.
            parts = []
            while peek() not in (("mark", "\n"), ("mark", "}"), ("mark", ",")) and at < len(tokens):
                parts.append(peek())
                at += 1
            if not parts:
                raise ValueError(f"{name} has no value")
            value = _value(*parts[0], out) if len(parts) == 1 else "".join(str(_value(k, v, out)) for k, v in parts)
        key = _named(".".join([*path, name]))
        if key not in DEFAULTS and key not in OPTIONAL:
            raise ValueError(f"no job knows the key {key}")
        out[key] = value
    if path:
        raise ValueError(f"section {path[-1]} has no end")


def load(path: str | None) -> dict:
    if not path:
        return dict(DEFAULTS)
    with open(path, encoding="utf-8") as f:
        return parse(f.read(), os.path.dirname(path))


def connection(cfg: dict) -> dict[str, str]:
    """Session settings of the store's connection, as far as the file has them."""
    names = {"store.host": "spark.cassandra.connection.host", "store.port": "spark.cassandra.connection.port", "store.username": "spark.cassandra.auth.username", "store.password": "spark.cassandra.auth.password"}
    return {setting: str(cfg[key]) for key, setting in names.items() if key in cfg}
