"""One declarative text for two engines.

Operators are written once as SQL with macros, ``@name(arguments)``. Spark runs
them; the same text, rendered for the checking engine, is the oracle.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

Macro = Callable[..., str]


def _quoted(pattern: str) -> str:
    return f"r{pattern.strip()}"


#: White space that becomes a single space, and of that what isn't one already.
_BLANKS, _LONE_BLANKS = "'[\\s\\x{00A0}]+'", "'[\\s\\x{00A0}]{2,}|[\\t\\n\\x0B\\f\\r\\x{00A0}]'"


def _runs(pattern: str, replacement: str) -> str:
    """A class whose characters are taken out one by one takes whole runs out: the same text by far fewer matches."""
    if (pattern.strip(), replacement.strip()) == (_BLANKS, "' '"):
        return _LONE_BLANKS
    one = replacement.strip() == "''" and re.fullmatch(r"'\[[^\[\]]+\]'", pattern.strip())
    return pattern.strip()[:-1] + "+'" if one else pattern


SPARK: dict[str, Macro] = {
    "pct": lambda x, p: f"percentile({x}, {p})",
    "like": lambda x, p: f"({x} RLIKE {_quoted(p)})",
    "extract": lambda x, p, g="0": f"regexp_extract({x}, {_quoted(p)}, {g})",
    "extract_all": lambda x, p: f"regexp_extract_all({x}, {_quoted(p)}, 0)",
    "replace": lambda x, p, r: f"regexp_replace({x}, {_quoted(_runs(p, r))}, {r})",
    "split": lambda x, s: f"split({x}, {_literal(s)})",
    "map": lambda a, v, e: f"transform({a}, {v} -> {e})",
    "keep": lambda a, v, e: f"filter({a}, {v} -> {e})",
    "size": lambda a: f"size({a})",
    "join": lambda a, s: f"array_join({a}, {s})",
    "slice": lambda a, i, n: f"slice({a}, {i}, {n})",
    "at": lambda a, i: f"element_at({a}, {i})",
    "list": lambda *x: f"array({', '.join(x)})",
    "explode": lambda src, arr, i, v: f"{src} LATERAL VIEW posexplode({arr}) exploded_{i} AS {i}, {v}",
    "series": lambda src, n, i: f"{src} LATERAL VIEW explode(sequence(0, {n} - 1)) exploded_{i} AS {i}",
    "argmax": lambda v, *k: f"max_by({v}, struct({', '.join(k)}))",
    "last": lambda x: f"last_value({x}) IGNORE NULLS",
    "string_list": lambda x, s, o: f"array_join(transform(array_sort(collect_list(struct({o} AS o, {x} AS v))), e -> e.v), {s})",
    "bucket": lambda t, n: f"(CAST(conv(substr(md5({t}), 1, 8), 16, 10) AS BIGINT) % {n})",
    "bit": lambda t: f"(CAST(conv(substr(md5({t}), 9, 1), 16, 10) AS BIGINT) % 2)",
    "distinct": lambda a: f"array_distinct({a})",
    "same": lambda a, b: f"({a} <=> {b})",
    "int": lambda x: f"CAST(floor({x}) AS BIGINT)",
    "round": lambda x, n="4": _rounded(x, n),
    "filtered": lambda f, c: f"{f} FILTER (WHERE {c})",
    "starts": lambda x, p: f"startswith({x}, {p})",
    "has": lambda a, x: f"array_contains({a}, {x})",
    "dealt_by": lambda k: f"/*+ REPARTITION({k}) */",
    "kept": lambda x, p: f"regexp_replace({x}, {_quoted(p)}, '$2')",
    "split_at": lambda x, p: f"split({x}, {_quoted(p)})",
    "upto": lambda n, v, e: f"transform(sequence(1, CAST({n} AS INT)), {v} -> {e})",
    "maybe_at": lambda a, i: f"try_element_at({a}, CAST({i} AS INT))",
    "list_of": lambda x, o: f"transform(array_sort(collect_list(struct({o} AS o, {x} AS v))), e -> e.v)",
    "total": lambda a: f"aggregate({a}, CAST(0 AS DOUBLE), (s, v) -> s + v)",
    "dot": lambda a, b: f"aggregate(zip_with({a}, {b}, (x, y) -> x * y), CAST(0 AS DOUBLE), (s, v) -> s + v)",
    "peak": lambda a: f"array_max({a})",
    "fold": lambda a, e: f"aggregate({a}, CAST('' AS STRING), (acc, nxt) -> {e})",
    "ends": lambda x, p: f"endswith({x}, {p})",
    "padded": lambda x, n: f"lpad(CAST({x} AS STRING), {n}, '0')",
    "casefold": lambda x: f"lower({x})",
    "common": lambda a, b: f"array_intersect({a}, {b})",
}

CHECK: dict[str, Macro] = {
    "pct": lambda x, p: f"quantile_cont(CAST({x} AS DOUBLE), {p})",
    "like": lambda x, p: f"regexp_matches({x}, {p})",
    "extract": lambda x, p, g="0": f"regexp_extract({x}, {p}, {g})",
    "extract_all": lambda x, p: f"regexp_extract_all({x}, {p})",
    "replace": lambda x, p, r: f"regexp_replace({x}, {p}, {r}, 'g')",
    "split": lambda x, s: f"string_split({x}, {_plain(s)})",
    "map": lambda a, v, e: f"list_transform({a}, lambda {v}: {e})",
    "keep": lambda a, v, e: f"list_filter({a}, lambda {v}: {e})",
    "size": lambda a: f"len({a})",
    "join": lambda a, s: f"array_to_string({a}, {s})",
    "slice": lambda a, i, n: f"({a})[{i}:{i} + {n} - 1]",
    "at": lambda a, i: f"({a})[{i}]",
    "list": lambda *x: f"[{', '.join(x)}]",
    "explode": lambda src, arr, i, v: f"(SELECT *, generate_subscripts({arr}, 1) - 1 AS {i}, unnest({arr}) AS {v} FROM {src})",
    "series": lambda src, n, i: f"(SELECT *, unnest(range(0, {n})) AS {i} FROM {src})",
    "argmax": lambda v, *k: f"arg_max({v}, row({', '.join(k)}))",
    "last": lambda x: f"last_value({x} IGNORE NULLS)",
    "string_list": lambda x, s, o: f"string_agg({x}, {s} ORDER BY {o})",
    "bucket": lambda t, n: f"(CAST(concat('0x', substr(md5({t}), 1, 8)) AS BIGINT) % {n})",
    "bit": lambda t: f"(CAST(concat('0x', substr(md5({t}), 9, 1)) AS BIGINT) % 2)",
    "distinct": lambda a: f"list_distinct({a})",
    "same": lambda a, b: f"({a} IS NOT DISTINCT FROM {b})",
    "int": lambda x: f"CAST(floor({x}) AS BIGINT)",
    "round": lambda x, n="4": _rounded(x, n),
    "filtered": lambda f, c: f"{f} FILTER (WHERE {c})",
    "starts": lambda x, p: f"starts_with({x}, {p})",
    "has": lambda a, x: f"list_contains({a}, {x})",
    "dealt_by": lambda k: "",
    "kept": lambda x, p: f"regexp_replace({x}, {p}, '\\2', 'g')",
    "split_at": lambda x, p: f"string_split_regex({x}, {p})",
    "upto": lambda n, v, e: f"list_transform(range(1, CAST({n} AS BIGINT) + 1), lambda {v}: {e})",
    "maybe_at": lambda a, i: f"({a})[{i}]",
    "list_of": lambda x, o: f"list({x} ORDER BY {o})",
    "total": lambda a: f"list_sum({a})",
    "dot": lambda a, b: f"list_dot_product({a}, {b})",
    "peak": lambda a: f"list_max({a})",
    "fold": lambda a, e: f"list_reduce(list_concat([''], {a}), lambda acc, nxt: {e})",
    "ends": lambda x, p: f"ends_with({x}, {p})",
    "padded": lambda x, n: f"lpad(CAST({x} AS STRING), {n}, '0')",
    "casefold": lambda x: f"lower({x})",
    "common": lambda a, b: f"list_intersect({a}, {b})",
}


def _rounded(x: str, n: str) -> str:
    """Half up at n digits, alike in both engines: a sum's last bits, which depend on its order, don't decide."""
    return f"(floor(CAST({x} AS DOUBLE) * 1e{n} + 0.5000001) / 1e{n})"


def _literal(separator: str) -> str:
    """A separator as a regular expression that matches just it."""
    s = separator.strip()
    return {"'\\n'": "'\\n'", "'|'": "r'\\|'"}.get(s, s)


def _plain(separator: str) -> str:
    s = separator.strip()
    return {"'\\n'": "chr(10)"}.get(s, s)


def _arguments(text: str, start: int) -> tuple[list[str], int]:
    """Top-level arguments after an opening parenthesis, and the place after the closing one."""
    depth, quoted, parts, at = 1, False, [""], start
    while depth:
        c = text[at]
        if c == "'":
            quoted = not quoted
        elif not quoted and c in "([":
            depth += 1
        elif not quoted and c in ")]":
            depth -= 1
            if not depth:
                break
        if c == "," and depth == 1 and not quoted:
            parts.append("")
        else:
            parts[-1] += c
        at += 1
    return [p.strip() for p in parts], at + 1


def render(text: str, macros: dict[str, Macro]) -> str:
    """The text with all macros expanded, inner ones first."""
    out, at = [], 0
    while at < len(text):
        if text[at] == "@" and text[at + 1].isalpha():
            end = text.index("(", at)
            name = text[at + 1 : end]
            arguments, at = _arguments(text, end + 1)
            out.append(macros[name](*(render(a, macros) for a in arguments)))
        else:
            out.append(text[at])
            at += 1
    return "".join(out)


Step = tuple[str, str]


def run(steps: list[Step], **frames: DataFrame) -> DataFrame:
    """The last of the named steps, each of which may read those before it and the frames by name."""
    spark = next(iter(frames.values())).sparkSession
    views = {name: f"{name}_{id(df):x}" for name, df in frames.items()}
    for name, df in frames.items():
        df.createOrReplaceTempView(views[name])
    sources = [(name, f"SELECT * FROM {view}") for name, view in views.items()]
    return spark.sql(statement(sources + steps, SPARK))


def statement(steps: list[Step], macros: dict[str, Macro]) -> str:
    """One WITH statement of the steps; the last is the result."""
    head = ",\n".join(f"{name} AS ({render(text, macros)})" for name, text in steps[:-1])
    return f"WITH {head}\n{render(steps[-1][1], macros)}" if head else render(steps[-1][1], macros)
