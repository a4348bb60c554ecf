"""Extraction and validation as SQL functions of a session, for queries in SQL.

``ll_fields(text, kind)`` and ``ll_validated(text, proposals)`` are table functions, for lateral joins:

    SELECT d.doc_id, f.field, f.value FROM docs d, LATERAL ll_fields(d.text, d.kind) f

``ll_field_array`` and ``ll_validated_array`` give the same rows as one array. Bodies are SQL over arrays of the one row, so
they are planned like built-in functions: no Python, no shuffle. SQL functions can't be called inside lambdas, so the bodies
are put together here; ``let`` binds what a lambda would otherwise work out again for each use.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import SparkSession

from ledgerlight.functions import constants as K

FIELD = "STRUCT<field: STRING, value: STRING, quote: STRING, page: INT>"
PROPOSAL = "STRUCT<key: STRING, value: STRING, quote: STRING, page: INT>"
_names = itertools.count()


def _text(x: str) -> str:
    """A literal; characters that SQL could take for something else are written as escapes."""
    return "'" + "".join(c if c.isascii() and c.isprintable() and c not in "\\'" else f"\\u{ord(c):04x}" for c in x) + "'"


def _list(items) -> str:
    return ", ".join(map(_text, items))


def let(value: str, body: Callable[[str], str]) -> str:
    name = f"v{next(_names)}"
    return f"transform(array({value}), {name} -> {body(name)})[0]"


def each(rows: str, body: Callable[[str], str], what: str = "transform") -> str:
    name = f"x{next(_names)}"
    return f"{what}({rows}, {name} -> {body(name)})"


def numbered(rows: str, body: Callable[[str, str], str]) -> str:
    name, place = f"x{next(_names)}", f"i{next(_names)}"
    return f"transform({rows}, ({name}, {place}) -> {body(name, place)})"


def struct(**parts: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in parts.items()) + ")"


def strip(x: str) -> str:
    return f"btrim({x}, {_text(K.BLANK_CHARACTERS)})"


def cents(x: str) -> str:
    amount = lambda r: f"if(length({r}) <= {K.MONEY_CHARS} AND rlike({r}, {_text(K.MONEY)}), cast(try_cast(replace({r}, ',', '') AS decimal(20,2)) * 100 AS decimal(38,0)), NULL)"
    return let(strip(x), lambda g: let(strip(f"if(startswith({g}, '$'), substring({g}, 2), {g})"), amount))


def day(x: str) -> str:
    forms = ((r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\z", "yyyy-M-d"), (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\z", "M/d/yyyy"), (r"^[A-Za-z]+ [0-9]{1,2}, [0-9]{4}\z", "MMMM d, yyyy"), (r"^[A-Za-z]+ [0-9]{1,2}, [0-9]{4}\z", "MMM d, yyyy"))
    found = "coalesce(" + ", ".join(f"if(rlike({x}, {_text(p)}), try_to_date(initcap({x}), {_text(f)}), NULL)" for p, f in forms) + ")"
    return f"date_format({found}, 'yyyy-MM-dd')"


def normalised(key: str, value: str) -> str:
    shown = lambda v: f"if(rlike({v}, {_text(K.CANONICAL_MONEY)}), replace({v}, '$', ''), cast(cast(cast({cents(v)} AS decimal(30,0)) / 100 AS decimal(32,2)) AS string))"
    dated = lambda v: f"if(rlike({v}, {_text(K.CANONICAL_DATE)}), {v}, {day(v)})"
    return let(value, lambda v: f"CASE WHEN {key} IN ({_list(K.MONEY_FIELDS)}) THEN {shown(v)} WHEN {key} IN ({_list(K.DATE_FIELDS)}) THEN {dated(v)} WHEN length({v}) <= {K.FIELD_CHARS} THEN {v} END")


def labelled(text: str, kind: str) -> str:
    """Array of (pos, page, quote, field, value): lines that name a field and have text behind it; null values can't be one.
    Plain text is cut at line feeds and stripped of spaces, all that it has of either."""
    names = {a: k for k, labels in K.ALIASES.items() for a in labels} | {k.replace("_", " "): k for k in K.FIELD_LABELS}
    # by the length of names: a map is searched from end to end
    some = lambda n: f"map({', '.join(f'{_text(a)}, {_text(k)}' for a, k in ({'': ''} | {a: k for a, k in names.items() if len(a) == n}).items())})"
    known = f"array({', '.join(map(some, range(max(map(len, names)) + 1)))})"

    def found(lines: str, bare: Callable[[str], str]) -> str:
        def parse(x: str) -> str:
            head = let(f"substring_index(substring_index({x}.quote, ':', 1), '=', 1)", lambda h: struct(label=f"lower({bare(h)})", given=f"if(length({h}) < length({x}.quote), {bare(f'substring({x}.quote, length({h}) + 2)')}, '')"))
            field = lambda h: f"if({h}.given = '', NULL, if({kind} = 'eob' AND {h}.label = 'amount due', 'patient_responsibility', nullif(try_element_at(get({known}, length({h}.label)), {h}.label), '')))"
            return let(head, lambda h: struct(pos=f"{x}.pos", page=f"{x}.page", quote=f"{x}.quote", field=field(h), given=f"{h}.given"))

        return each(each(lines, parse), lambda x: f"{x}.field IS NOT NULL", "filter")

    plain = found(numbered(f"split({text}, '\\n')", lambda x, i: struct(pos=i, page="1", quote=x)), lambda x: f"trim({x})")
    pages = numbered(f"split({text}, {_text(chr(12))})", lambda p, i: each(f"split({p}, {_text(K.LINE_END)})", lambda x: struct(page=f"{i} + 1", quote=x)))
    paged = found(numbered(f"flatten({pages})", lambda x, i: struct(pos=i, page=f"{x}.page", quote=f"{x}.quote")), strip)
    rows = f"if(rlike({text}, {_text(K.PLAIN)}), {plain}, {paged})"
    return each(rows, lambda x: struct(pos=f"{x}.pos", page=f"{x}.page", quote=f"{x}.quote", field=f"{x}.field", value=normalised(f"{x}.field", f"{x}.given")))


def proposed(text: str, proposals: str) -> str:
    """Array of (pos, page, quote, field, value): proposals for known fields; null values have no quote that bears them out."""

    def held(key: str, value: str, quote: str) -> str:
        right = lambda n, w: each(n, lambda y: f"coalesce({y} = {w}, false)")
        before = lambda n, at: each(f"slice({n}, 1, greatest({at} - 1, 0))", lambda y: f"{y} IS NULL", "exists")
        numbers = each(f"regexp_extract_all({quote}, {_text(K.QUOTED_NUMBER)}, 0)", cents)
        money = let(numbers, lambda n: let(cents(value), lambda w: let(f"cast(array_position({right(n, w)}, true) AS int)", lambda at: f"({at} > 0 AND NOT {before(n, at)})")))
        dates = each(f"regexp_extract_all({quote}, {_text(K.QUOTED_DATE)}, 0)", lambda d: f"coalesce({day(d)} = {value}, false)", "exists")
        return f"CASE WHEN {key} IN ({_list(K.MONEY_FIELDS)}) THEN {money} WHEN {key} IN ({_list(K.DATE_FIELDS)}) THEN {dates} ELSE contains(lower({quote}), lower({value})) END"

    def sure(key: str, value: str, quote: str) -> str:
        """A quote that ends with its value, in canonical form, and has no digit before: for amounts and dates."""
        before = f"substring({quote}, 1, length({quote}) - length({value}))"
        return f"coalesce({key} IN ({_list((*K.MONEY_FIELDS, *K.DATE_FIELDS))}) AND (rlike({value}, {_text(K.CANONICAL_MONEY)}) OR rlike({value}, {_text(K.CANONICAL_DATE)})) AND endswith({quote}, concat(' ', {value})) AND NOT rlike({before}, '[0-9$]') AND NOT rlike({before}, {_text(K.NOT_PLAIN)}), false)"

    def judge(x: str) -> str:
        found = f"{x}.quote <> '' AND {x}.page >= 1 AND contains(get(split({text}, {_text(chr(12))}), {x}.page - 1), {x}.quote)"
        return f"if(coalesce({found}, false) AND coalesce({x}.value IS NOT NULL AND ({sure(f'{x}.field', f'{x}.value', f'{x}.quote')} OR {held(f'{x}.field', f'{x}.value', f'{x}.quote')}), false), {x}.value, NULL)"

    known = each(proposals, lambda x: f"{x}.key IN ({_list(K.FIELD_LABELS)})", "filter")
    read = numbered(known, lambda x, i: struct(pos=i, page=f"{x}.page", quote=strip(f"{x}.quote"), field=f"{x}.key", value=normalised(f"{x}.key", strip(f"{x}.value"))))
    return each(read, lambda x: struct(pos=f"{x}.pos", page=f"{x}.page", quote=f"{x}.quote", field=f"{x}.field", value=judge(x)))


def settled(entries: str) -> str:
    """The fact of each field: its value, and its last quote; none for a field that is given two values."""

    def facts(rows: str) -> str:
        named = f"array_intersect(array({_list(K.FIELD_LABELS)}), {each(rows, lambda x: f'{x}.field')})"
        own = each(f"coalesce({named}, cast(array() AS array<string>))", lambda k: struct(field=k, own=each(rows, lambda x: f"{x}.field = {k} AND {x}.value IS NOT NULL", "filter")))
        one = each(own, lambda h: f"size({h}.own) > 0 AND {each(f'{h}.own', lambda x: f'{x}.value = {h}.own[0].value', 'forall')}", "filter")
        return each(one, lambda h: struct(field=f"{h}.field", value=f"{h}.own[0].value", quote=f"element_at({h}.own, -1).quote", page=f"element_at({h}.own, -1).page"))

    return let(entries, facts)


def register(spark: SparkSession) -> list[str]:
    """Create the functions in a session; their names."""
    table, columns = "TABLE(field STRING, value STRING, quote STRING, page INT)", "f.field, f.value, f.quote, f.page"
    for name, parameters, body in (
        ("ll_field_array", "text STRING, kind STRING", settled(labelled("text", "kind"))),
        ("ll_validated_array", f"text STRING, proposals ARRAY<{PROPOSAL}>", settled(proposed("text", "proposals"))),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS ARRAY<{FIELD}> RETURN {body}")
        rows = name.removesuffix("_array") + "s" * (name == "ll_field_array")
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {rows}({parameters}) RETURNS {table} RETURN SELECT {columns} FROM explode({body}) AS t(f)")
    return ["ll_fields", "ll_validated", "ll_field_array", "ll_validated_array"]
