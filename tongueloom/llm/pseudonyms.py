"""Format-preserving pseudonyms for numbers and dates in texts, in SQL expressions only.

A value that passes its check is read as a rank within its format (all dates of 400 years, all card payloads of a length, ...), the rank is
permuted by a keyed Feistel network on two residues, and the new rank is written in the same format. The permutation
depends on the key, the format and the value alone, so equal values stay equal wherever they occur, and different values stay different.

| kind | found as | checked by | permuted |
|-|-|-|-|
| date | 2024-01-31, 2024/01/31, 31.01.2024, 01/31/2024, years 1700-2099 | calendar | the day among 146,097 |
| ip | four octets | each at most 255 | all 32 bits |
| ssn | 123-45-6789 | no reserved area, group or serial | all valid ones |
| phone | ten digits as (319) 555-5132 or 319-555-5132, a country code before it | shape | the ten digits; the code stays |
| card | 13 to 19 digits, or groups of four (4-6-5 for fifteen) | Luhn | all but the first and the check digit, which is made anew |
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

ROUNDS = 8
KINDS = ("date", "ip", "ssn", "phone", "card")

_FOUND = {
    "date": r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})",
    "ip": r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.[0-9])",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}",
    "card": r"(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})",
}
#: No digit, letter or joined digit stands at either side.
PATTERN = r"(?<![0-9A-Za-z])(?<![0-9][.\-/])(?:" + "|".join(_FOUND[k] for k in KINDS) + r")(?![0-9A-Za-z]|[\-/][0-9])"


def _sql(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _feistel(kind: str, key: str, a: str, b: str, a_mod: str, b_mod: str) -> str:
    """The permuted pair of residues, as a struct; each round adds a keyed hash of one to the other."""

    def noise(x: str, mod: str) -> str:
        seed = f"concat_ws('|', {_sql(key)}, '{kind}', {a_mod}, r, {x})"
        return f"(cast(conv(substring(sha2({seed}, 256), 1, 15), 16, 10) as bigint) % {mod})"

    start = f"named_struct('a', cast({a} as bigint), 'b', cast({b} as bigint))"
    odd = f"named_struct('a', (s.a + {noise('s.b', a_mod)}) % {a_mod}, 'b', s.b)"
    even = f"named_struct('a', s.a, 'b', (s.b + {noise('s.a', b_mod)}) % {b_mod})"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (s, r) -> if(r % 2 = 1, {odd}, {even}))"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


_DIGITS = "regexp_replace(m, '[^0-9]', '')"


def _put(digits: str) -> str:
    """The match with its digits replaced in order; all other characters stay."""
    place = "length(regexp_replace(substring(m, 1, i), '[^0-9]', ''))"
    return _let(digits, "n", "array_join(transform(sequence(1, length(m)), i -> "
                f"if(substring(m, i, 1) rlike '[0-9]', substring(n, {place}, 1), substring(m, i, 1))), '')")


def _date(key: str) -> str:
    form = ("case when m like '____-__-__' then 'yyyy-MM-dd' when m like '____/__/__' then 'yyyy/MM/dd' "
            "when m like '__.__.____' then 'dd.MM.yyyy' else 'MM/dd/yyyy' end")
    day = "datediff(cast(try_to_timestamp(m, f) as date), date'1700-01-01')"
    moved = _feistel("date", key, "(d div 773)", "d % 773", "189", "773")
    new = "date_format(date_add(date'1700-01-01', cast(p.a * 773 + p.b as int)), f)"
    return _let(form, "f", _let(day, "d", f"if(d between 0 and 146096, {_let(moved, 'p', new)}, null)"))


def _ip(key: str) -> str:
    octets = "transform(split(m, '[.]'), x -> cast(x as int))"
    new = "concat_ws('.', p.a div 256, p.a % 256, p.b div 256, p.b % 256)"
    moved = _feistel("ip", key, "o[0] * 256 + o[1]", "o[2] * 256 + o[3]", "65536", "65536")
    return _let(octets, "o", f"if(array_max(o) <= 255, {_let(moved, 'p', new)}, null)")


def _ssn(key: str) -> str:
    area, group, serial = "cast(substring(m, 1, 3) as int)", "cast(substring(m, 5, 2) as int)", "cast(substring(m, 8, 4) as int)"
    valid = f"{area} between 1 and 899 and {area} <> 666 and {group} > 0 and {serial} > 0"
    rank = f"({area} - if({area} > 666, 2, 1)) * 99 + {group} - 1"
    at = "(p.a div 99)"
    new = f"concat(lpad({at} + if({at} >= 665, 2, 1), 3, '0'), '-', lpad(p.a % 99 + 1, 2, '0'), '-', lpad(p.b + 1, 4, '0'))"
    return f"if({valid}, {_let(_feistel('ssn', key, rank, f'{serial} - 1', '88902', '9999'), 'p', new)}, null)"


def _phone(key: str) -> str:
    moved = _feistel("phone", key, "cast(substring(d, -10, 5) as bigint)", "cast(substring(d, -5, 5) as bigint)", "100000", "100000")
    new = "concat(substring(d, 1, length(d) - 10), lpad(p.a, 5, '0'), lpad(p.b, 5, '0'))"
    return _let(_DIGITS, "d", _put(_let(moved, "p", new)))


def _card(key: str) -> str:
    n = "(length(d) - 2)"
    a_len, b_len = f"({n} div 2)", f"({n} - {n} div 2)"
    a_mod, b_mod = (f"cast(rpad('1', cast({x} + 1 as int), '0') as bigint)" for x in (a_len, b_len))
    moved = _feistel("card", key, f"cast(substring(d, 2, cast({a_len} as int)) as bigint)",
                     f"cast(substring(d, cast(2 + {a_len} as int), cast({b_len} as int)) as bigint)", a_mod, b_mod)
    payload = f"concat(substring(d, 1, 1), lpad(p.a, cast({a_len} as int), '0'), lpad(p.b, cast({b_len} as int), '0'))"
    whole = _let(payload, "y", "concat(y, filter(sequence(0, 9), c -> luhn_check(concat(y, c)))[0])")
    return _let(_DIGITS, "d", f"if(length(d) between 13 and 19 and luhn_check(d), {_put(_let(moved, 'p', whole))}, null)")


def _checked(key: str) -> str:
    """``array<struct<kind, value, pseudonym>>`` of the candidates; one that fails its check keeps its value and has no kind."""
    make = {"date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone, "card": _card}
    named = " ".join(
        f"when m rlike {_sql('^(?:' + _FOUND[k] + ')$')} then named_struct('kind', '{k}', 'value', m, 'pseudonym', {make[k](key)})" for k in KINDS)
    kept = "named_struct('kind', if(v.pseudonym is null, null, v.kind), 'value', v.value, 'pseudonym', coalesce(v.pseudonym, v.value))"
    return f"transform(transform(_candidates, m -> case {named} end), v -> {kept})"


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with every valid number and date of ``text`` replaced, and ``found array<struct<kind, value, pseudonym>>``.

    Values that fail their check stay as they are and are not listed. A null text stays null with no values; an empty text has none.
    All rows and columns stay, repeated rows and null ids too; a column named ``found`` is replaced. No Python runs on the rows.
    """
    columns = [c for c in docs.columns if c != "found"]
    candidates = F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))
    rows = docs.select(*columns, candidates.alias("_candidates"))
    rows = rows.select(*columns, F.when(F.size("_candidates") > 0, F.expr(_checked(key))).alias("_values"))
    pieces = F.split("text", PATTERN, -1)
    filled = F.concat(F.transform("_values", lambda v: v["pseudonym"]), F.array(F.lit("")))
    text = F.array_join(F.zip_with(pieces, filled, lambda p, v: F.concat(p, v)), "")
    none = F.array().cast("array<struct<kind:string,value:string,pseudonym:string>>")
    return rows.select(
        *[F.when(F.col("_values").isNotNull(), text).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in columns],
        F.coalesce(F.filter("_values", lambda v: v["kind"].isNotNull()), none).alias("found"))
