"""Reading SQL statements as token lists: canonical form, and whether the end is missing.

Plain functions on strings, for use inside Arrow batches. They never raise: a text that
is no statement is a list of tokens like any other.
"""

from __future__ import annotations

import re

TOKEN = re.compile(r"'(?:[^']|'')*(?:'|$)|\"(?:[^\"]|\"\")*(?:\"|$)|--|[^\W]+|[<>=!]+|[^\s`;]")
QUOTES = str.maketrans("", "", "'\"`")
CLAUSES = frozenset(("from", "where", "group", "order", "having", "limit", "set", "values", "on", "union"))
AGGREGATES = frozenset(("count", "sum", "avg", "min", "max", "group_concat", "std", "stddev", "variance"))
CONSTANTS = frozenset(("current_date", "current_time", "current_timestamp", "null", "true", "false"))
#: A statement can't end with one of these.
OPEN_WORDS = frozenset(
    ("and", "or", "where", "by", "from", "in", "between", "not", "is", "set", "values", "into", "group", "order", "like", "select",
     "having", "limit", "on", "join", "insert", "delete", "update", "load", "data", "infile", "fields", "terminated", "as", "distinct", "union")
)
OPEN_MARKS = frozenset(",.(=<>!+-*/|&")
MARKER = re.compile(r"(?:\.\.\.+|…|�|(?:\[|\(|<)\s*(?:truncated|cut|snip|more|etc)[^\])>]*(?:\]|\)|>)|(?:\[|\(|<)(?:\.\.\.+|…)(?:\]|\)|>))\s*$", re.I)


def tokens(text: str) -> list[str]:
    """Lower-case tokens; literals keep their quotes, backticks and semicolons are gone, split operators are joined."""
    out = TOKEN.findall(text.lower())
    for i in range(len(out) - 1, 0, -1):
        if out[i][0] in "<>=!" and out[i - 1][0] in "<>=!":
            out[i - 1] += out.pop(i)
    return out


def _plain(t: list[str]) -> str:
    """Tokens as text, without quote marks."""
    return " ".join([" ".join(x.translate(QUOTES).split()) if x[0] in "'\"" else x for x in t])


def _split(t: list[str], on: str) -> list[list[str]]:
    """Parts between the separators outside brackets; the AND of a BETWEEN is none."""
    parts, depth, begin, between = [], 0, 0, 0
    for i, x in enumerate(t):
        if x == "(":
            depth += 1
        elif x == ")":
            depth -= 1
        elif depth == 0:
            if x == "between":
                between += 1
            elif x == on:
                if on == "and" and between:
                    between -= 1
                else:
                    parts.append(t[begin:i])
                    begin = i + 1
    parts.append(t[begin:])
    return parts


def _wrapped(t: list[str]) -> bool:
    """Whether one pair of brackets goes around all of it."""
    if len(t) < 2 or t[0] != "(" or t[-1] != ")":
        return False
    depth = 0
    for i, x in enumerate(t):
        depth += (x == "(") - (x == ")")
        if depth == 0:
            return i == len(t) - 1
    return False


def _has_or(t: list[str]) -> bool:
    depth = 0
    for x in t:
        depth += (x == "(") - (x == ")")
        if depth == 0 and x in ("or", "xor"):
            return True
    return False


def _condition(t: list[str]) -> list[str]:
    """The conditions joined by AND, without brackets around each, as sorted texts."""
    while _wrapped(t) and t[1] != "select":
        t = t[1:-1]
    if _has_or(t):
        return ["( " + _nested(t) + " )"]
    parts = _split(t, "and")
    if len(parts) == 1:
        return [_nested(t)]
    return sorted(y for p in parts for y in _condition(p))


def _nested(t: list[str]) -> str:
    """Text of tokens; sub-queries in brackets are in their canonical form."""
    if "select" not in t:
        return _plain(t)
    out, i = [], 0
    while i < len(t):
        if t[i] == "(" and i + 1 < len(t) and t[i + 1] == "select":
            depth, j = 0, i
            while j < len(t):
                depth += (t[j] == "(") - (t[j] == ")")
                if depth == 0:
                    break
                j += 1
            out.append("( " + _statement(t[i + 1 : j]) + (" )" if j < len(t) else ""))
            i = j + 1
        else:
            out.append(_plain(t[i : i + 1]))
            i += 1
    return " ".join(out)


def _clauses(t: list[str]) -> list[tuple[str, list[str]]]:
    """The statement cut at its clause words outside brackets; the first part's word is ''."""
    out, depth, begin, word = [], 0, 0, ""
    for i, x in enumerate(t):
        if x == "(":
            depth += 1
        elif x == ")":
            depth -= 1
        elif depth == 0 and x in CLAUSES:
            out.append((word, t[begin:i]))
            word, begin = x, i + 1
    out.append((word, t[begin:]))
    return out


def _statement(t: list[str]) -> str:
    if not t:
        return ""
    head = t[0]
    out: list[str] = []
    parts = _clauses(t)
    for word, body in parts:
        if word:
            out.append(word)
        if word == "" and head == "select":
            k = 2 if body[1:2] in (["distinct"], ["all"]) else 1
            out.append(_plain(body[:k]))
            out.append(" , ".join(sorted(_nested(p) for p in _split(body[k:], ","))))
        elif word == "set":
            out.append(" , ".join(sorted(_nested(p) for p in _split(body, ","))))
        elif word in ("where", "having", "on"):
            out.append(" and ".join(_condition(body)))
        else:
            out.append(_nested(body))
    if head in ("insert", "replace") and len(parts) == 2 and parts[1][0] == "values":
        first, body = parts[0][1], parts[1][1]
        at = first.index("(") if "(" in first else -1
        if at >= 0 and _wrapped(first[at:]):
            names = _split(first[at + 1 : -1], ",")
            rows = _split(body, ",")
            if all(_wrapped(r) for r in rows):
                values = [_split(r[1:-1], ",") for r in rows]
                if all(len(v) == len(names) for v in values):
                    n = [_plain(x) for x in names]
                    v = [[_nested(x) for x in r] for r in values]
                    order = sorted(range(len(n)), key=lambda i: (n[i], [r[i] for r in v]))
                    return " ".join([_plain(first[:at]), "(", " , ".join(n[i] for i in order), ") values", " , ".join("( " + " , ".join(r[i] for i in order) + " )" for r in v)])
    return " ".join(out)


def canonical(text: str) -> str:
    """The same text for all writings of a statement that count as equal."""
    t = tokens(text)
    note = ""
    if "--" in t:
        i = t.index("--")
        note = " " + _plain(t[i:])
        t = t[:i]
    return _statement(t) + note


def strip_marker(text: str) -> tuple[str, bool]:
    """The text without what was put in the place of its end, and whether there was any."""
    m = MARKER.search(text)
    return (text[: m.start()], True) if m else (text, False)


def _value_ends(t: list[str], aliases: frozenset[str] | set[str]) -> bool:
    """Whether tokens are one whole value: literals, numbers, columns and calls joined by arithmetic, nothing left over."""
    i, n = 0, len(t)
    while True:
        while i < n and t[i] in ("+", "-"):
            i += 1
        if i >= n:
            return False
        if t[i] == "(":
            depth = 0
            while i < n:
                depth += (t[i] == "(") - (t[i] == ")")
                i += 1
                if depth == 0:
                    break
        else:
            first = i
            i += 1
            while i + 1 < n and t[i] == ".":
                i += 2
            if i < n and t[i] == "(":
                continue
            if i == n and i - first == 1 and t[first] in aliases:
                return False  # an alias without its column
        if i >= n:
            return True
        if t[i] not in ("+", "-", "*", "/", "%"):
            return False
        i += 1


def _condition_ends(t: list[str], aliases: frozenset[str] | set[str] = frozenset()) -> bool:
    """Whether the last condition is whole: a column, an operator and what it needs."""
    while _wrapped(t):
        t = t[1:-1]
    if _has_or(t):
        return _condition_ends(_split(t, "or")[-1], aliases)
    parts = _split(t, "and")
    if len(parts) > 1:
        return _condition_ends(parts[-1], aliases)
    for i, x in enumerate(t):
        if x[0] in "<>=!" or x in ("like", "rlike", "regexp"):
            return _value_ends(t[i + 1 :], aliases)
        if x == "between":
            return "and" in t[i:] and _value_ends(t[t.index("and", i) + 1 :], aliases)
        if x == "in":
            return t[i + 1 : i + 2] == ["("] and t[-1] == ")"
        if x == "is":
            return t[-1] == "null"
    return "(" in t or "exists" in t


def _aliases(body: list[str]) -> set[str]:
    """Short names given to tables in a FROM list."""
    return {x[-1] for x in _split(body, ",") if len(x) > 1 and x[-2] not in (".", ")") and x[-1] not in CLAUSES}


def tail_word(t: list[str]) -> str | None:
    """The word that tokens end with, if they do: it may be a part of a longer one."""
    return t[-1] if t and t[-1][0].isalpha() and "--" not in t else None


def end_missing(text: str, t: list[str] | None = None) -> bool:
    """Whether a statement's text (its tokens are ``t``) stops before its end, as far as its grammar tells.

    Open quotes and brackets, a last word that needs another, an unfinished last condition,
    plain select items without GROUP BY beside aggregates or missing in it, an ORDER BY column
    that is nowhere selected, an INSERT without as many values as columns.
    """
    t = tokens(text) if t is None else t
    if not t:
        return False
    if text.count("`") % 2:
        return True
    if "--" in t:
        return t[-1] == "--"
    if t[-1][0] in "'\"" and (len(t[-1]) == 1 or t[-1][-1] != t[-1][0]):
        return True
    if t.count("(") > t.count(")"):
        return True
    if t[-1] in OPEN_WORDS or t[-1][-1] in OPEN_MARKS and not (t[-1] == "*" and t[-2:-1] in (["select"], ["."], [","])):
        return True
    head = t[0]
    parts = _clauses(t)
    words = [w for w, _ in parts]
    last, body = parts[-1]
    aliases = next((_aliases(x) for w, x in parts if w == "from"), set())
    if head == "select":
        select = parts[0][1][1:]
        if select[:1] in (["distinct"], ["all"]):
            select = select[1:]
        items = _split(select, ",")
        called = [x for x in items if "(" in x]
        plain = [x for x in items if "(" not in x]
        if "from" not in words:
            return any(x and not x[0][0].isdigit() and x[0][0] not in "'\"@" and x[0] not in CONSTANTS for x in plain)
        aggregate = any(x[0] in AGGREGATES for x in called)
        if last == "where":
            if not _condition_ends(body, aliases):
                return True
        if aggregate and plain:
            if "group" not in words:
                return True
        if last in ("group", "order"):
            if body[0] != "by":
                return True
            listed = _split(body[1:], ",")
            names = {_plain(x) for x in items}
            if last == "group":
                keys = {_plain(x) for x in listed}
                if aggregate and any(_plain(x) not in keys for x in plain):
                    return True
            tail = [x for x in listed[-1] if x not in ("asc", "desc")]
            if listed[-1] and listed[-1][-1] not in ("asc", "desc") and len(tail) > 1 and tail[1] != "." and "(" not in tail:
                return True  # a cut ASC, DESC, ORDER or LIMIT
            if not tail:
                return True
            if "(" not in tail and not tail[0].isdigit() and _plain(tail) not in names and "*" not in names and (tail[-1] not in {y for x in called for y in x} or last == "group"):
                return True
        return False
    if head in ("update", "delete"):
        if head == "update" and "set" not in words:
            return True
        if last == "where":
            return not _condition_ends(body)
        if last == "set":
            item = _split(body, ",")[-1]
            return len(item) > 1 and len(item) != 3 and "(" not in item
        return False
    if head in ("insert", "replace"):
        if "values" not in words and "select" not in t:
            return True
        if last == "values":
            first = parts[0][1]
            at = first.index("(") if "(" in first else -1
            if at >= 0 and _wrapped(first[at:]):
                return any(len(_split(r[1:-1], ",")) != len(_split(first[at + 1 : -1], ",")) for r in _split(body, ","))
        return False
    if head == "load":
        return not ("table" in t and t[-1][0] in "'\"")
    return False
