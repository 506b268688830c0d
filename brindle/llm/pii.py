"""Personal data in documents, replaced by format-preserving Feistel pseudonyms; DataFrame and SQL functions only.

Found and validated: payment cards (13 to 19 digits, Luhn), social security numbers (no area 000, 666 or 9xx, no group 00, no
serial 0000), phone numbers (a leading + and 8 to 15 digits, or ten digits in a usual grouping), IPv4 addresses (four octets up
to 255), calendar dates (year-month-day, day.month.year, day/month/year, and month/day/year where that alone is a date, from
1600 to 2399) and e-mail addresses. What fails its check stays.

Numbers and dates are permuted by an eight-round Feistel network, keyed by SHA-256, over two residues whose product is exactly
the number of valid values: 10**u and 10**(n-u) for n digits, 898*99 and 9999 for social security numbers, 2**16 and 2**16 for
addresses, and the dates of a date's own century that can be spelled in its format. The format of a date is its order, its
separators and the numbers of digits of day and month (``DATE_CLASSES``); month-first dates are those whose day is over 12. So a
pseudonym is valid again (a card's check digit is computed anew), keeps separators, padding and country codes, two values of
one format never share a pseudonym, and equal values stay linked across documents. Phone numbers are known by their digits,
however they are grouped: the country code is split off by the world's numbering plan and the rest is permuted. An e-mail
address becomes user-<20 hex digits of a keyed hash>@example.invalid.

Edge cases: a null text stays null with no findings, an empty one stays empty; nothing in a pattern backtracks over a long run
of characters, so very long texts take time in proportion; other columns are kept, also those named like the outputs of
``find``; repeated rows are treated alike; an empty table gives an empty result.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ipv4", "date", "ssn", "card", "phone")
ROUNDS = 8

#: Candidates, first alternative first. Runs are possessive or bounded.
_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){1,8}"
_IPV4 = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)"
_DATE = r"(?<![\w/.-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\w/-]|\.\d)"
_SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
_CARD = r"(?<![\w-])(?:\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5}|\d{13,19})(?![\w-])"
_PHONE = r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<![\w+(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w+.-])\d{3}([ .-])\d{3}\3\d{4}(?![\w-])"
#: Country codes of one and two digits in the international numbering plan; all others have three.
_COUNTRY = "^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"

#: Formats that cannot spell every date, with digits of the first and the second number: what they can spell, and two factors of
#: the number of these dates in a century without and with a leap day in its first year.
DATE_CLASSES = {
    "d11": (lambda m, d: m < 10 and d < 10, (100, 81), (100, 81)),
    "d12": (lambda m, d: d < 10, (100, 108), (100, 108)),
    "d21": (lambda m, d: m < 10, (108, 253), (25, 1093)),
    "m12": (lambda m, d: m < 10 and d > 12, (108, 153), (25, 661)),
    "m22": (lambda m, d: d > 12, (4, 5531), (125, 177)),
}
CANDIDATE = "|".join((_EMAIL, _IPV4, _DATE, _SSN, _CARD, _PHONE))


def _q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    """Luhn sum of digits without a check digit, the last one doubled."""
    d = f"cast(substring({digits}, length({digits}) - i, 1) as int)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (t, i) -> t + if(i % 2 = 0, {d} * 2 - if({d} > 4, 9, 0), {d}))"


def _date(value: str) -> str:
    """The date that value spells, or null."""
    part = lambda k, sep: f"cast(split({value}, '{sep}')[{k}] as int)"
    day = lambda y, m, d: f"try_cast(concat_ws('-', {y}, {m}, {d}) as date)"
    slash = f"coalesce({day(part(2, '/'), part(1, '/'), part(0, '/'))}, {day(part(2, '/'), part(0, '/'), part(1, '/'))})"
    return (
        f"case when {value} rlike '^[0-9]{{4}}-' then {day(part(0, '-'), part(1, '-'), part(2, '-'))}"
        f" when {value} rlike '^[0-9]{{4}}/' then {day(part(0, '/'), part(1, '/'), part(2, '/'))}"
        f" when {value} like '%/%' then {slash} when {value} like '%.%' then {day(part(2, '[.]'), part(1, '[.]'), part(0, '[.]'))} end"
    )


def _kind(v: str) -> str:
    """The kind of a candidate that passes its check, else null."""
    n = f"length({_digits(v)})"
    octets = f"forall(split({v}, '[.]'), o -> cast(o as int) < 256)"
    body = f"substring({_digits(v)}, 1, {n} - 1)"
    return f"""case
      when {v} like '%@%' then if({v} rlike '[.][A-Za-z]{{2,}}$', 'email', null)
      when {v} rlike '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$' then if({octets}, 'ipv4', null)
      when {v} rlike '^[0-9]{{1,4}}[/.-][0-9]{{1,2}}[/.-][0-9]{{2,4}}$' and not {v} rlike '^[0-9]{{3}}-[0-9]{{2}}-'
        then if(year({_date(v)}) between 1600 and 2399, 'date', null)
      when {v} rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' then if({v} rlike '^(?!000|666|9)[0-9]{{3}}-(?!00)[0-9]{{2}}-(?!0000)', 'ssn', null)
      when {v} like '+%' then if({n} between 8 and 15, 'phone', null)
      when {n} = 10 then 'phone'
      when {n} between 13 and 19 then if((10 - {_luhn(body)} % 10) % 10 = cast(right({v}, 1) as int), 'card', null) end"""


def _feistel(key: str, tag: str, left: str, right: str, a: str, b: str, finish: str) -> str:
    """SQL of a keyed permutation of the pair (left mod a, right mod b), then finish over the pair s."""
    f = lambda x: f"cast(conv(substring(sha2(concat_ws('|', {_q(key)}, {tag}, r, {x}), 256), 1, 15), 16, 10) as bigint)"
    pair = lambda x, y: f"named_struct('l', cast({x} as bigint), 'r', cast({y} as bigint))"
    step = f"if(r % 2 = 0, {pair(f'pmod(s.l + {f("s.r")}, {a})', 's.r')}, {pair('s.l', f'pmod(s.r + {f("s.l")}, {b})')})"
    return f"aggregate(sequence(0, {ROUNDS - 1}), {pair(left, right)}, (s, r) -> {step}, s -> {finish})"


def _permuted(key: str, tag: str, d: str) -> str:
    """SQL of the digit string d (2 to 18 digits), permuted among those of its length."""
    n = f"length({d})"
    u, w = f"({n} div 2)", f"({n} - {n} div 2)"
    power = lambda x: f"cast(pow(10, {x}) as bigint)"
    finish = f"concat(lpad(cast(s.l as string), {u}, '0'), lpad(cast(s.r as string), {w}, '0'))"
    return _feistel(key, f"concat({tag}, {n})", f"substring({d}, 1, {u})", f"substring({d}, {u} + 1, {w})", power(u), power(w), finish)


def _filled(value: str, digits: str) -> str:
    """value with its digits replaced in order by those of the string digits."""
    place = f"length(regexp_replace(substring({value}, 1, k), '[^0-9]', ''))"
    return f"array_join(transform(sequence(1, length({value})), k -> if(substring({value}, k, 1) rlike '[0-9]', substring({digits}, {place}, 1), substring({value}, k, 1))), '')"


def _days(cls: str) -> list[str]:
    """Month and day of the dates of a common year that a format can spell."""
    year = [datetime.date(2001, 1, 1) + datetime.timedelta(k) for k in range(365)]
    return [f"{d:%m%d}" for d in year if DATE_CLASSES[cls][0](d.month, d.day)]


def _choice(cls: str, values: dict[str, object]) -> str:
    return f"case {cls} {' '.join(f'when {_q(c)} then {_q(x) if isinstance(x, str) else x}' for c, x in values.items())} end"


def _spelled(key: str, v: str) -> str:
    """SQL of the pseudonym of the date d that v spells in the format cls, whose days of a common year are t.

    Dates are numbered by year and day; the leap days of the century, where the format can spell them, come last.
    """
    a, b = (f"if(leap, {_choice('cls', {c: f[2][k] for c, f in DATE_CLASSES.items()})}, {_choice('cls', {c: f[1][k] for c, f in DATE_CLASSES.items()})})" for k in (0, 1))
    spare = "if(leap, 0, 1)"
    number = f"if(date_format(d, 'MMdd') = '0229', 100 * size(t) + year(d) % 100 div 4 - {spare}, year(d) % 100 * size(t) + array_position(t, date_format(d, 'MMdd')) - 1)"
    moved = f"s.l * {b} + s.r"
    plain = f"{moved} < 100 * size(t)"
    year = f"cast(year(d) div 100 * 100 + if({plain}, ({moved}) div size(t), 4 * ({moved} - 100 * size(t) + {spare})) as string)"
    day = f"if({plain}, t[cast(({moved}) % size(t) as int)], '0229')"
    number_of = lambda at, digits: f"if(substring(cls, {digits}, 1) = '1', substring({day}, {at} + 1, 1), substring({day}, {at}, 2))"
    ordered = f"if(cls like 'd%', concat_ws(sep, {number_of(3, 2)}, {number_of(1, 3)}, {year}), concat_ws(sep, {number_of(1, 2)}, {number_of(3, 3)}, {year}))"
    finish = f"transform(array(if({v} like '%.%', '.', '/')), sep -> {ordered})[0]"
    mixed = _feistel(key, "concat('date', cls, year(d) div 100)", f"n div ({b})", f"n % ({b})", f"({a})", f"({b})", finish)
    return f"transform(array({number}), n -> {mixed})[0]"


def _pseudonym(v: str, kind: str, key: str) -> str:
    """SQL of the pseudonym of a candidate whose kind is known; without a kind the candidate itself."""
    let = lambda bound, name, body: f"transform(array({bound}), {name} -> {body})[0]"
    email = f"concat('user-', substring(sha2(concat_ws('|', {_q(key)}, 'email', lower({v})), 256), 1, 20), '@example.invalid')"
    octet = lambda k: f"cast(split({v}, '[.]')[{k}] as int)"
    ipv4 = _feistel(
        key, "'ipv4'", f"{octet(0)} * 256 + {octet(1)}", f"{octet(2)} * 256 + {octet(3)}", "65536", "65536",
        "concat_ws('.', s.l div 256, s.l % 256, s.r div 256, s.r % 256)",
    )
    start, b = "make_date(year(d) div 100 * 100, 1, 1)", "if(leap, 487, 397)"
    moved = f"date_add({start}, cast(s.l * {b} + s.r as int))"
    shape = f"""case when {v} rlike '^[0-9]{{4}}-' then date_format({moved}, 'yyyy-MM-dd') when {v} rlike '^[0-9]{{4}}/' then date_format({moved}, 'yyyy/MM/dd')
      when {v} like '%.%' then date_format({moved}, 'dd.MM.yyyy') else date_format({moved}, 'dd/MM/yyyy') end"""
    every = _feistel(key, "concat('date', year(d) div 100)", f"datediff(d, {start}) div {b}", f"datediff(d, {start}) % {b}", "if(leap, 75, 92)", b, shape)
    century = f"if(cls in ({', '.join(map(_q, DATE_CLASSES))}), {let('split(' + _choice('cls', {c: ','.join(_days(c)) for c in DATE_CLASSES}) + ', \',\')', 't', _spelled(key, v))}, {every})"
    parts = f"split({v}, '[./]')"
    day_first = f"{v} like '%.%' or try_cast(concat_ws('-', {parts}[2], {parts}[1], {parts}[0]) as date) is not null"
    cls = f"if({v} rlike '^[0-9]{{4}}', '', concat(if({day_first}, 'd', 'm'), length({parts}[0]), length({parts}[1])))"
    date = let(_date(v), "d", let(cls, "cls", let("year(d) div 100 % 4 = 0", "leap", century)))
    area = f"cast(substring({v}, 1, 3) as int)"
    ssn = _feistel(
        key, "'ssn'", f"({area} - if({area} > 666, 2, 1)) * 99 + cast(substring({v}, 5, 2) as int) - 1", f"cast(right({v}, 4) as int) - 1", "88902", "9999",
        "concat_ws('-', lpad(cast(s.l div 99 + if(s.l div 99 >= 665, 2, 1) as string), 3, '0'), lpad(cast(s.l % 99 + 1 as string), 2, '0'), lpad(cast(s.r + 1 as string), 4, '0'))",
    )
    whole = _digits(v)
    body = _permuted(key, "'card'", f"substring({whole}, 1, length({whole}) - 1)")
    card = let(body, "p", _filled(v, f"concat(p, cast((10 - {_luhn('p')} % 10) % 10 as string))"))
    code = f"if({v} like '+%', regexp_extract({whole}, {_q(_COUNTRY)}, 1), '')"
    rest = let(f"substring({whole}, length(c) + 1)", "w", _permuted(key, _q("phone"), "w"))
    phone = let(code, "c", let(f"concat(c, {rest})", "p", _filled(v, "p")))
    return f"case {kind} when 'email' then {email} when 'ipv4' then {ipv4} when 'date' then {date} when 'ssn' then {ssn} when 'card' then {card} when 'phone' then {phone} else {v} end"


def find(text: Column, key: str) -> tuple[Column, Column]:
    """Two columns: the candidates in text, and from a column named candidates__ their (kind, value, pseudonym) in order."""
    candidates = F.coalesce(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), F.array().cast("array<string>"))
    kinds = f"transform(candidates__, v -> named_struct('kind', {_kind('v')}, 'value', v))"
    found = F.expr(f"transform({kinds}, x -> named_struct('kind', x.kind, 'value', x.value, 'pseudonym', {_pseudonym('x.value', 'x.kind', key)}))")
    return candidates, found


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", findings: bool = False) -> DataFrame:
    """docs with pseudonyms in their texts; findings adds the array ``findings`` of (kind, value, pseudonym), in text order."""
    text = F.col("row__")[text_col]
    candidates, found = find(text, key)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row__"))
    rows = rows.withColumn("candidates__", candidates).withColumn("found__", F.when(F.size("candidates__") > 0, found))
    pieces = F.zip_with(F.split(text, CANDIDATE, -1), "found__", lambda p, f: F.concat(p, F.coalesce(f["pseudonym"], F.lit(""))))
    rows = rows.withColumn("text__", F.when(F.size("found__") > 0, F.array_join(pieces, "")).otherwise(text))
    columns = [F.col("text__").alias(c) if c == text_col else F.col("row__")[c].alias(c) for c in docs.columns]
    if findings:
        columns.append(F.filter(F.coalesce("found__", F.array().cast("array<struct<kind:string,value:string,pseudonym:string>>")), lambda f: f["kind"].isNotNull()).alias("findings"))
    return rows.select(*columns)
