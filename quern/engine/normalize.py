"""Rewrites the MySQL spellings that Spark SQL reads differently; works on tokens, never inside literals.

LIMIT m, n            -> LIMIT n OFFSET m
a / b, a % b, a DIV b -> NULL for a zero divisor
[NOT] LIKE 'x'        -> [NOT] ILIKE 'x', backslashes taken literally
INTERVAL '9' DAY (3)  -> INTERVAL '9' DAY
"text", ''            -> string literals; `name` stays a name
CONCAT, CAST to text  -> booleans as 1 or 0, timestamps as microseconds
CAST to integer       -> fractions round half away from zero, text is trimmed
CAST to boolean       -> numbers by being non-zero, text only 1, 0, true, false
SUBSTRING(s, a, n)    -> nothing for a = 0 or n < 1, from the end for a < 0
DATE(x)               -> midnight of a day, as a timestamp
UCASE, LCASE, IFNULL stay; LENGTH counts bytes; X'41' stays

Calls whose meaning depends on a type hold a CASE over typeof(), which is constant when a plan is optimised.
"""

from __future__ import annotations

import re

TOKEN = re.compile(r"""\s+|--[^\n]*|/\*.*?\*/|[xX]'(?:[^'])*'|'(?:[^'\\]|''|\\.)*'|"(?:[^"\\]|""|\\.)*"|`[^`]*`|@{0,2}[A-Za-z_][A-Za-z0-9_$]*|\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+|<=>|<=|>=|<>|!=|\|\||.""", re.S)


class SqlError(ValueError):
    """A statement that the engine does not accept."""


def tokens(sql: str) -> list[str]:
    """Tokens without white space and comments."""
    return [t for t in TOKEN.findall(sql) if not t.isspace() and not t.startswith(("--", "/*"))]


def split_statements(sql: str) -> list[str]:
    """The statements of a batch."""
    out, part = [], []
    for t in TOKEN.findall(sql):
        if t == ";":
            out.append("".join(part))
            part = []
        else:
            part.append(t)
    return [s.strip() for s in [*out, "".join(part)] if s.strip()]


def closing(ts: list[str], at: int) -> int:
    """The place of the parenthesis that closes the one at ``at``."""
    depth = 0
    for i in range(at, len(ts)):
        depth += (ts[i] == "(") - (ts[i] == ")")
        if not depth:
            return i
    raise SqlError("unbalanced parenthesis")


def primary_end(ts: list[str], at: int) -> int:
    """One past the primary expression that starts at ``at``."""
    while ts[at] in "+-":
        at += 1
    if ts[at] == "(":
        return closing(ts, at) + 1
    if ts[at].upper() == "CASE":
        depth = 0
        for i in range(at, len(ts)):
            depth += (ts[i].upper() == "CASE") - (ts[i].upper() == "END")
            if not depth:
                return i + 1
        raise SqlError("CASE without END")
    end = at + 1
    while end + 1 < len(ts) and ts[end] == ".":
        end += 2
    return closing(ts, end) + 1 if end < len(ts) and ts[end] == "(" and re.match(r"[A-Za-z_`]", ts[at]) else end


def quoted(text: str) -> str:
    """A token with double quotes as a string literal."""
    inner = text[1:-1].replace('""', '"').replace("\\", "\\\\").replace("'", "\\'")
    return f"'{inner}'"


def arguments(ts: list[str], at: int, mark: str = ",") -> list[list[str]]:
    """The parts, cut at a mark, of what stands in the parenthesis at ``at``."""
    end, depth, out = closing(ts, at), 0, [[]]
    for t in ts[at + 1 : end]:
        depth += (t == "(") - (t == ")")
        if not depth and t.upper() == mark:
            out.append([])
        else:
            out[-1].append(t)
    return out


def shown_as_text(x: str) -> str:
    flag = f"CASE CAST({x} AS STRING) WHEN 'true' THEN '1' WHEN 'false' THEN '0' END"
    micros = f"CAST(unix_micros(try_cast(CAST({x} AS STRING) AS TIMESTAMP)) AS STRING)"
    return f"CASE WHEN typeof({x}) = 'boolean' THEN {flag} WHEN typeof({x}) IN ('timestamp', 'timestamp_ntz') THEN {micros} ELSE CAST({x} AS STRING) END"


def as_integer(x: str) -> str:
    fraction = f"CAST(round(CAST(CAST({x} AS STRING) AS DECIMAL(38,18)), 0) AS BIGINT)"
    return f"CASE WHEN typeof({x}) = 'string' THEN CAST(trim(CAST({x} AS STRING)) AS BIGINT) WHEN typeof({x}) IN ('double', 'float') OR typeof({x}) LIKE 'decimal%' THEN {fraction} ELSE CAST({x} AS BIGINT) END"


def as_boolean(x: str) -> str:
    text = f"CASE lower(trim(CAST({x} AS STRING))) WHEN '1' THEN TRUE WHEN 'true' THEN TRUE WHEN '0' THEN FALSE WHEN 'false' THEN FALSE END"
    return f"CASE WHEN typeof({x}) IN ('string', 'boolean') THEN {text} ELSE try_cast(CAST({x} AS STRING) AS DOUBLE) <> 0 END"


def part_of_text(s: str, a: str, n: str | None) -> str:
    start = f"CASE WHEN {a} > 0 THEN {a} ELSE greatest(1, char_length({s}) + ({a}) + 1) END"
    none = f"{a} = 0" + (f" OR {n} <= 0" if n else "")
    return f"CASE WHEN {' OR '.join(f'({x}) IS NULL' for x in (s, a, n) if x)} THEN NULL WHEN {none} THEN '' ELSE substring({s}, CAST({start} AS INT){f', CAST({n} AS INT)' if n else ''}) END"


def call(ts: list[str], at: int) -> str | None:
    """A call, at its name, whose meaning differs from Spark's; None if it doesn't."""
    name, inner = ts[at].upper(), lambda part: "(" + spaced(rewrite(part)) + ")"
    if name == "CONCAT":
        return "concat(" + ", ".join(shown_as_text(inner(p)) for p in arguments(ts, at + 1)) + ")"
    if name == "CAST":
        x, kind = (*arguments(ts, at + 1, "AS"), [])[:2]
        word = kind[0].upper() if kind else ""
        if word in ("CHAR", "VARCHAR", "TEXT", "STRING"):
            return shown_as_text(inner(x))
        if word in ("SIGNED", "BIGINT", "INT", "INTEGER"):
            return f"CAST({as_integer(inner(x))} AS {'INT' if word in ('INT', 'INTEGER') else 'BIGINT'})"
        return as_boolean(inner(x)) if word in ("BOOLEAN", "BOOL") else None
    if name in ("SUBSTRING", "SUBSTR"):
        parts = arguments(ts, at + 1)
        if len(parts) == 1:  # SUBSTRING(s FROM a FOR n)
            s, rest = (*arguments(ts, at + 1, "FROM"), [])[:2]
            parts = [s, *arguments(["(", *rest, ")"], 0, "FOR")] if rest else parts
        return part_of_text(*map(inner, parts), *[None] * (3 - len(parts))) if 2 <= len(parts) <= 3 else None
    if name == "DATE":
        x = spaced(rewrite(ts[at + 2 : closing(ts, at + 1)]))
        return f"to_timestamp_ntz({x}, 'yyyy-MM-dd')" if x[:1] == "'" else f"CAST(CAST({x} AS DATE) AS TIMESTAMP_NTZ)"
    return None


def rewrite(ts: list[str]) -> list[str]:
    out: list[str] = []
    i = 0
    while i < len(ts):
        t, up = ts[i], ts[i].upper()
        if t[0] == '"':
            out.append(quoted(t))
        elif up in ("/", "%", "DIV", "MOD") and out and (up in "/%" or i + 1 < len(ts) and ts[i + 1] != "(" or up == "DIV"):
            end = primary_end(ts, i + 1)
            out += ["%" if up == "MOD" else t, "nullif", "(", *rewrite(ts[i + 1 : end]), ",", "0", ")"]
            i = end - 1
        elif up in CALLS and i + 1 < len(ts) and ts[i + 1] == "(" and (new := call(ts, i)) is not None:
            out.append(new)
            i = closing(ts, i + 1)
        elif up == "LIKE":
            out.append("ILIKE")
            if i + 1 < len(ts) and ts[i + 1][0] in "'\"":
                i += 1
                out.append("'" + ts[i][1:-1].replace("\\", "\\\\\\\\") + "'")
        elif up == "LENGTH" and i + 1 < len(ts) and ts[i + 1] == "(":
            out.append("octet_length")
        elif up == "LIMIT" and i + 3 < len(ts) and ts[i + 2] == ",":
            out += [t, ts[i + 3], "OFFSET", ts[i + 1]]
            i += 3
        elif up in ("DAY", "MONTH", "YEAR") and i >= 2 and ts[i - 2].upper() == "INTERVAL" and i + 1 < len(ts) and ts[i + 1] == "(":
            out.append(t)
            i = closing(ts, i + 1)
        else:
            out.append(t)
        i += 1
    return out


def spaced(ts: list[str]) -> str:
    """Tokens as text: no blank around dots, nor between a name and its parenthesis."""
    out = ""
    for i, t in enumerate(ts):
        tight = not out or t in ".,)" or ts[i - 1] in ".(" or t == "(" and re.match(r"[A-Za-z_]", ts[i - 1]) and ts[i - 1].upper() not in KEEP_SPACE
        out += t if tight else " " + t
    return out


CALLS = {"CONCAT", "CAST", "SUBSTRING", "SUBSTR", "DATE"}
KEEP_SPACE = {"IN", "AND", "OR", "NOT", "EXISTS", "FROM", "JOIN", "WHERE", "SELECT", "ON", "AS", "WHEN", "THEN", "ELSE", "BY", "ALL", "UNION", "EXCEPT", "INTERSECT", "VALUES", "USING", "OVER", "HAVING", "LIMIT", "DISTINCT", "LIKE", "ILIKE", "BETWEEN", "CASE"}


def normalize(sql: str) -> str:
    """A query as Spark SQL."""
    return spaced(rewrite(tokens(sql)))
