"""PII pseudonyms by keyed Feistel permutations within each value's own format.

Numbers and dates are found by one pattern, validated (Luhn, mod 97, calendar, ranges) and
permuted among the valid values of their format, so a card stays a card and equal values
get equal pseudonyms in every document.  Whoever has the key can restore them.  The main
path is DataFrame functions only.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ROUNDS = 8
#: Lengths of IBANs by country (fixed values of ISO 13616).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}


def _iban_pattern() -> str:
    """An unbroken IBAN of any country, or one in groups of four of its country's length: what follows it isn't part of it."""
    grouped = [rf"(?:{codes.replace(' ', '|')})[0-9]{{2}}(?: [A-Z0-9]{{4}}){{{n // 4 - 1}}}{f' [A-Z0-9]{{{n % 4}}}' if n % 4 else ''}" for n, codes in IBAN_LENGTHS.items()]
    return rf"(?<![0-9A-Za-z])(?:[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}|{'|'.join(grouped)})(?![0-9A-Za-z])"


#: What is looked for, in order of preference where values overlap.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "iban": _iban_pattern(),
    "secret": r"(?<![0-9A-Za-z])[0-9a-f]{32,64}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9+])\+(?:1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}|[0-9](?:[ .-](?![0-9]{4}(?<in>[ -])[0-9]{4}\k<in>[0-9]{4}\k<in>[0-9]{1,7}(?![0-9]))[0-9]|[0-9]){7,14})(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?<by>[ -])[0-9]{4}\k<by>[0-9]{4}\k<by>[0-9]{1,7}|[0-9]{4}(?<of>[ -])[0-9]{6}\k<of>[0-9]{5})(?![0-9])",
    "date": r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}(?<mark>[/.])[0-9]{1,2}\k<mark>[0-9]{4})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local": r"(?<![0-9(])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
}
_ANY = "|".join(PATTERNS.values())
_ISO, _SLASHED = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$", r"^[0-9]{1,2}([/.])[0-9]{1,2}\1[0-9]{4}$"
_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_HEX = "0123456789abcdef"
#: Days are counted in the 400 years from here: 146,097 = 189 * 773, and 88,497 = 9 * 9,833 from the 13th of a month on.
_ORIGIN = "date'1700-01-01'"
#: The number of days from the 13th on, in all months before month m from the origin.
_LATE_DAYS = f"(datediff(add_months({_ORIGIN}, m), {_ORIGIN}) - 12 * m)"


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _luhn(d: str, odd: int) -> str:
    """Luhn sum of a digit string; odd = 1: the last digit is doubled and every second before it, 0: the last but one."""
    x = f"cast(substr({d}, length({d}) - i + 1, 1) as int)"
    return f"aggregate(sequence(1, length({d})), 0, (a, i) -> a + if(i % 2 = {odd}, {x} * 2 - if({x} > 4, 9, 0), {x}))"


def _mod97(s: str) -> str:
    v = f"(instr('{_ALPHABETS[0]}{_ALPHABETS[2]}', substr({s}, i, 1)) - 1)"
    return f"aggregate(sequence(1, length({s})), 0, (a, i) -> (a * if({v} > 9, 100, 10) + {v}) % 97)"


def _let(name: str, value: str, body: str) -> str:
    return f"try_element_at(transform(array({value}), {name} -> {body}), 1)"


def _cipher_pair(key: str, sign: int) -> str:
    """A keyed permutation of all pairs with 0 <= l < a, 0 <= r < b, of the fields of s: 8 Feistel rounds."""

    def moved(side: str, own: str, other: str, modulus: str) -> str:
        message = f"concat_ws('|', {key}, s.tweak, '{side}', i, {other})"
        return f"pmod({own} + {sign} * cast(conv(substr(sha2(concat_ws('|', {key}, sha2({message}, 256)), 256), 1, 13), 16, 10) as bigint), {modulus})"

    first, second = (("l", "r"), ("r", "l"))[sign < 0]
    size = {"l": "s.a", "r": "s.b"}
    one = moved(first, f"t.{first}", f"t.{second}", size[first])
    two = moved(second, f"t.{second}", "x", size[second])
    new = {first: "x", second: two}
    step = _let("x", one, f"named_struct('l', {new['l']}, 'r', {new['r']})")
    return f"if(s.a is null, null, aggregate({_rounds(sign)}, named_struct('l', s.l, 'r', s.r), (t, i) -> {step}))"


def _rounds(sign: int) -> str:
    return f"sequence(1, {_ROUNDS})" if sign > 0 else f"sequence({_ROUNDS}, 1, -1)"


def _cipher_word(key: str, sign: int) -> str:
    """A keyed permutation of strings; each character stays within its alphabet, others stay as they are."""

    def moved(alphabet: str) -> str:
        return f"substr('{alphabet}', pmod(instr('{alphabet}', c) - 1 + {sign} * cast(conv(substr(h, 1 + 4 * ((p div 2) % 32), 4), 16, 10) as int), {len(alphabet)}) + 1, 1)"

    plain = " ".join(f"when instr('{x}', c) > 0 then {moved(x)}" for x in _ALPHABETS)
    char = _let("c", "substr(w, p, 1)", f"case when p % 2 <> i % 2 then c when s.kind = 'secret' then {moved(_HEX)} {plain} else c end")
    other = "array_join(transform(sequence(1, length(w)), p -> if(p % 2 <> i % 2, substr(w, p, 1), '')), '')"
    h = f"sha2(concat_ws('|', {key}, sha2(concat_ws('|', {key}, s.kind, i, length(w), {other}), 512)), 512)"
    step = _let("h", h, f"array_join(transform(sequence(1, length(w)), p -> {char}), '')")
    return f"if(s.word = '', '', aggregate({_rounds(sign)}, s.word, (w, i) -> {step}))"


def _ymd(y: int, m: int, d: int) -> str:
    return f"try_cast(concat_ws('-', s.cut[{y}], lpad(s.cut[{m}], 2, '0'), lpad(s.cut[{d}], 2, '0')) as date)"


def _stages(key: str, sign: int) -> list[str]:
    """Each stage turns the array of found values into one of structs with more fields, as SQL over s.

    A stage refers to the array once, so nothing is computed twice however often a field is used.
    """

    def more(**fields: str) -> str:
        return ", ".join(f"'{k}', {v}" for k, v in fields.items())

    fits = lambda x: f"coalesce(year({x}) between 1700 and 2099, false)"
    kind = f"""case
        when contains(s.m, '@') then 'email'
        when s.m rlike '^[A-Z]' then if(length(s.c) between 15 and 34 and {_mod97("(substr(s.c, 5) || substr(s.c, 1, 4))")} = 1, 'iban', null)
        when s.m rlike '^[0-9a-f]{{32,}}$' then if(s.m rlike '[a-f]' and s.m rlike '[0-9]', 'secret', null)
        when startswith(s.m, '+') then case when s.d rlike '^1[2-9][0-9][0-9][2-9][0-9]{{6}}$' then 'nanp' when length(s.d) between 8 and 15 then 'phone' end
        when s.m rlike {_quoted(_ISO)} then if({fits(_ymd(0, 1, 2))}, 'iso', null)
        when s.m rlike {_quoted(_SLASHED)} then case when {fits(_ymd(2, 1, 0))} then 'dmy' when {fits(_ymd(2, 0, 1))} then 'mdy' end
        when s.m rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' then if(s.d rlike '^(?!000|666|9)...(?!00)..(?!0000)', 'ssn', null)
        when s.m rlike {_quoted(r"^[0-9]{1,3}([.][0-9]{1,3}){3}$")} then if(exists(s.cut, x -> cast(x as int) > 255), null, 'ip')
        when length(s.d) = 10 then if(s.d rlike '^[2-9]..[2-9]', 'nanp', null)
        when length(s.d) between 13 and 19 and s.d rlike '[1-9]' then if({_luhn("s.d", 0)} % 10 = 0, 'card', null)
        end"""
    body = """case s.kind when 'card' then substr(s.d, 1, length(s.d) - 1) when 'phone' then substr(s.d, 3) when 'nanp' then right(s.d, 10) when 'ssn' then s.d else '' end"""
    day = f"datediff(case s.kind when 'iso' then {_ymd(0, 1, 2)} when 'dmy' then {_ymd(2, 1, 0)} when 'mdy' then {_ymd(2, 0, 1)} end, {_ORIGIN}) - if(s.kind = 'mdy', 12 * ((cast(s.cut[2] as int) - 1700) * 12 + cast(s.cut[0] as int)), 0)"
    word = "case s.kind when 'email' then regexp_replace(s.m, '[.][A-Za-z]+$', '') when 'iban' then substr(s.c, 5) when 'secret' then s.m else '' end"
    part = lambda x, i, n: f"cast(substr({x}, {i}, {n}) as bigint)"
    half = "length(s.body) div 2"
    by_kind = lambda digits, nanp, ssn, ip, date: f"case when s.kind in ('card', 'phone') then {digits} when s.kind = 'nanp' then {nanp} when s.kind = 'ssn' then {ssn} when s.kind = 'ip' then {ip} when s.day is not null then {date} end"
    area = part("s.body", 1, 3)
    le = by_kind(f"cast(substr(s.body, 1, cast({half} as int)) as bigint)", f"{area} - 200", f"{area} - 1 - if({area} > 666, 1, 0)", "cast(s.cut[0] as bigint) * 256 + cast(s.cut[1] as bigint)", "cast(s.day div if(s.kind = 'mdy', 9833, 773) as bigint)")
    ri = by_kind(f"cast(substr(s.body, cast({half} as int) + 1) as bigint)", f"{part('s.body', 4, 7)} - 2000000", f"({part('s.body', 4, 2)} - 1) * 9999 + {part('s.body', 6, 4)} - 1", "cast(s.cut[2] as bigint) * 256 + cast(s.cut[3] as bigint)", "cast(s.day % if(s.kind = 'mdy', 9833, 773) as bigint)")
    power = lambda n: f"cast(rpad('1', cast({n} as int) + 1, '0') as bigint)"
    a = by_kind(power(half), "800L", "898L", "65536L", "if(s.kind = 'mdy', 9L, 189L)")
    b = by_kind(power(f"length(s.body) - {half}"), "8000000L", "989901L", "65536L", "if(s.kind = 'mdy', 9833L, 773L)")
    tweak = "case when s.kind in ('iso', 'dmy') then 'date' when s.kind in ('card', 'phone') then concat(s.kind, length(s.body)) else s.kind end"
    left = f"cast({half} as int)"
    digits = f"""case s.kind
        when 'nanp' then concat(left(s.d, length(s.d) - 10), s.p.l + 200, s.p.r + 2000000)
        when 'ssn' then concat(lpad(s.p.l + 1 + if(s.p.l >= 665, 1, 0), 3, '0'), lpad(s.p.r div 9999 + 1, 2, '0'), lpad(s.p.r % 9999 + 1, 4, '0'))
        when 'phone' then concat(left(s.d, 2), lpad(s.p.l, {left}, '0'), lpad(s.p.r, length(s.body) - {left}, '0'))
        when 'card' then concat(lpad(s.p.l, {left}, '0'), lpad(s.p.r, length(s.body) - {left}, '0')) end"""
    late = "cast(s.p.l * 9833 + s.p.r as int)"
    months = f"filter(sequence(greatest({late} * 4800 div 88497 - 3, 0), {late} * 4800 div 88497 + 3), m -> {late} >= {_LATE_DAYS} and {late} < {_LATE_DAYS.replace('m)', 'm + 1)').replace('* m', '* (m + 1)')})"
    late_date = _let("m", f"cast({months}[0] as int)", f"date_add(add_months({_ORIGIN}, m), 12 + {late} - {_LATE_DAYS})")
    date = f"if(s.kind = 'mdy', {late_date}, date_add({_ORIGIN}, cast(s.p.l * 773 + s.p.r as int)))"
    checked = f"if(s.kind = 'card', concat(s.new, (10 - {_luhn('s.new', 1)} % 10) % 10), s.new)"
    mark = "regexp_extract(s.m, '[/.]', 0)"
    bare = f"concat(substr(s.m, 1, 2), lpad(98 - {_mod97("(s.w || substr(s.m, 1, 2) || '00')")}, 2, '0'), s.w)"
    iban = f"if(contains(s.m, ' '), trim(regexp_replace({bare}, '(.{{4}})', '$1 ')), {bare})"
    slashed = lambda x, y: f"if(length(s.m) = 10, date_format(s.date, concat('{x}', {mark}, '{y}', {mark}, 'yyyy')), concat_ws({mark}, cast(date_format(s.date, '{x}') as int), cast(date_format(s.date, '{y}') as int), date_format(s.date, 'yyyy')))"
    out = f"""case s.kind
        when 'email' then concat(s.w, regexp_extract(s.m, '[.][A-Za-z]+$', 0))
        when 'secret' then s.w
        when 'iban' then {iban}
        when 'ip' then concat_ws('.', s.p.l div 256, s.p.l % 256, s.p.r div 256, s.p.r % 256)
        when 'iso' then date_format(s.date, 'yyyy-MM-dd')
        when 'dmy' then {slashed("dd", "MM")}
        when 'mdy' then {slashed("MM", "dd")}
        else case when s.kind is null then s.m else
            array_join(zip_with(split(s.m, '[0-9]', -1), transform(sequence(1, length(s.new)), i -> substr(s.new, i, 1)), (x, y) -> x || coalesce(y, '')), '') end
        end"""
    name = "case when s.kind in ('iso', 'dmy', 'mdy') then 'date' when s.kind = 'nanp' then 'phone' else s.kind end"
    return [
        more(m="s", c="replace(s, ' ', '')", d="regexp_replace(s, '[^0-9]', '')", cut="split(s, '[-/.]')"),
        more(m="s.m", c="s.c", d="s.d", cut="s.cut", kind=kind),
        more(m="s.m", d="s.d", cut="s.cut", kind="s.kind", body=body, day=day, word=word),
        more(m="s.m", d="s.d", kind="s.kind", body="s.body", word="s.word", tweak=tweak, l=le, r=ri, a=a, b=b),
        more(m="s.m", d="s.d", kind="s.kind", body="s.body", p=_cipher_pair(key, sign), w=_cipher_word(key, sign)),
        more(m="s.m", kind="s.kind", p="s.p", w="s.w", new=digits, date=f"case when s.kind in ('iso', 'dmy', 'mdy') then {date} end"),
        more(m="s.m", kind="s.kind", p="s.p", w="s.w", date="s.date", new=checked),
        more(kind=name, out=out),
    ]


def pseudonymize(docs: DataFrame, key: str | Column, text_col: str = "text", restore: bool = False) -> DataFrame:
    """docs with text_col pseudonymized, and pii_kinds: the kinds of what was replaced, in order.

    Kinds: email, iban, secret (32 to 64 hex digits), phone, card, date, ssn, ip.  What fails
    its validation stays as it is, with all that lies in it.  IBANs in groups of four have the length of their country.  Slashed dates are read day first where that is a date,
    and are then linked with the same day in other formats; those that can only be read month
    first are permuted among themselves.  Dates outside 1700 to 2099 stay.  restore=True undoes it with the same
    key.  A key given as text stands in the plan; one given as a Column, such as
    spark.read.text(path).scalar(), does not.  Null text: null, with no kinds.  Empty text: empty.  All other columns stay; one
    of the name pii_kinds is replaced.  Rows are neither dropped nor merged.
    """
    text = F.col(f"`{text_col}`").cast("string")
    taken = {c.lower() for c in docs.columns}
    mark = next(m for m in (f"pii{k}_" for k in count()) if not any(c.startswith(m) for c in taken))
    names = [f"{mark}{i}" for i in range(9)]  # dropped again
    if isinstance(key, Column):
        docs, secret = docs.withColumn(f"{mark}key", key), f"{mark}key"
    else:
        secret = _quoted(key)
    none = F.expr("cast(array() as array<string>)")
    out = docs.withColumn(names[0], F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(_ANY), F.lit(0))).otherwise(none))
    for i, fields in enumerate(_stages(secret, -1 if restore else 1)):
        out = out.withColumn(names[i + 1], F.expr(f"transform({names[i]}, s -> named_struct({fields}))"))
    found = F.col(names[8])
    new = F.when(F.size(found) > 0, F.array_join(F.zip_with(F.split(text, _ANY, -1), found, lambda s, x: F.concat(s, F.coalesce(x["out"], F.lit("")))), "")).otherwise(text)
    kinds = F.transform(F.filter(found, lambda x: x["kind"].isNotNull()), lambda x: x["kind"])
    return out.withColumns({text_col: new, "pii_kinds": F.coalesce(kinds, none)}).drop(*names, f"{mark}key")


#: The key of the registered query; a deployment passes its own.
QUERY_KEY = "factorweave-demo-key"


def op4_pii(spark, sf_dir: str) -> DataFrame:
    out = pseudonymize(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), QUERY_KEY)
    return out.select("doc_id", "text", F.size("pii_kinds").cast("long").alias("n_replaced"), F.array_join("pii_kinds", ",").alias("kinds"))


QUERIES = {"op4_pii": op4_pii}
ORACLE_SQL: dict[str, str] = {}
