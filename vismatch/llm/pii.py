"""Personal data: format-preserving Feistel pseudonyms. DataFrame and SQL functions only.

Found in whole texts: e-mail addresses, ISO dates, US social security numbers, telephone numbers, IPv4 addresses,
card numbers of 13 to 19 digits, and secrets in hexadecimal of 32 to 64 digits. Dates, addresses, security and card
numbers are validated (calendar, octets without leading zeros, reserved areas, Luhn); what fails stays as it is. Telephone numbers have no
check digit, so their form decides.

Each value is permuted inside its own format by a keyed balanced Feistel network whose round function is SHA-256, so
equal values get equal pseudonyms in all documents and different values different ones:
  * digits: two halves of the number, added modulo a power of ten; separators and a telephone's country code stay.
    A country code has the digits that the numbering plan gives it, 1 to 3, and fewer where less than two would follow;
  * cards: all digits but the last; the last keeps its distance to the Luhn digit, so valid numbers stay valid;
  * dates: days from 1900 to 2099, on 271 x 271 numbers, walked on until inside; addresses: two halves of 16 bits;
  * security numbers: (area, group) by serial over the valid ones; e-mail names and secrets: the characters of each half
    are moved inside their class (lower, upper, digit) by a key stream made from the other half.

The main path is one scan of the texts; those without a match end there. A text is split at its matches and joined
again with their pseudonyms. Nothing is shuffled. The key is the one value of a scalar subquery, so it stands in no plan.

Defined cases: null and empty texts have no matches; only documents with a validated match are returned by
``find_private``, each row for itself; ``pseudonymise`` returns all rows and all columns, of any names, null texts as
null. An empty key is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The patterns, tried in this order at each place.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){1,126}"  # a host has 127 labels at most; without a bound each would deepen the stack
DATE = r"(?<![0-9-])(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}(?![0-9-])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = (
    r"\+[0-9]{1,3}(?:[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})){2,5}(?![0-9])"
    r"|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])"
)
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
CARD = r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9A-Za-z])"
SECRET = r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])"
PATTERN = f"{EMAIL}|(?=[0-9(+])(?:{DATE}|{SSN}|{PHONE}|{IP}|{CARD})|{SECRET}"  # letters skip what begins otherwise

#: A country code with at least two digits after it, which every match of PHONE that begins with a plus has.
COUNTRY = r"^[+](?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{1,3})(?=(?:[^0-9]*[0-9]){2})"

KINDS = ("email", "date", "ssn", "phone", "ip", "card", "secret")
ROUNDS = 8
_DAYS, _SIDE = 73049, 271  # days from 1900-01-01 to 2099-12-31; 271 * 271 is just above


def _let(name: str, value: str, body: str) -> str:
    """body with name bound to value, evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _round(key: str, kind: str, number: str, other: str) -> str:
    """The round function: 48 bits of a keyed SHA-256."""
    return f"cast(conv(substr(sha2(concat_ws('|', {key}, '{kind}', {number}, {other}), 256), 1, 12), 16, 10) as bigint)"


def _feistel(key: str, kind: str, left: str, right: str, m_left: str, m_right: str) -> str:
    """struct(l, r): a permutation of [0, m_left) x [0, m_right)."""
    even = f"named_struct('l', pmod(a.l + {_round(key, kind, 'i', 'a.r')}, {m_left}), 'r', a.r)"
    odd = f"named_struct('l', a.l, 'r', pmod(a.r + {_round(key, kind, 'i', 'a.l')}, {m_right}))"
    start = f"named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint))"
    return f"aggregate(sequence(0, {ROUNDS - 1}), {start}, (a, i) -> if(i % 2 = 0, {even}, {odd}))"


def _power(n: str) -> str:
    return f"cast(rpad('1', {n} + 1, '0') as bigint)"


def _digits(key: str, kind: str, digits: str) -> str:
    """A string of at least two digits, permuted."""
    half = "cast(length(d) div 2 as int)"
    rest = f"(length(d) - {half})"
    network = _feistel(key, kind, f"substr(d, 1, {half})", f"substr(d, {half} + 1)", _power(half), _power(rest))
    # the number of digits is part of the key, so that lengths do not share a permutation
    joined = _let("p", network, f"concat(lpad(cast(p.l as string), {half}, '0'), lpad(cast(p.r as string), {rest}, '0'))")
    return _let("d", digits, joined)


def _refill(template: str, digits: str) -> str:
    """template with its digits replaced in order."""
    step = "if(c rlike '[0-9]', named_struct('o', concat(a.o, substr(g, a.k + 1, 1)), 'k', a.k + 1), named_struct('o', concat(a.o, c), 'k', a.k))"
    return _let("g", digits, f"aggregate(split({template}, ''), named_struct('o', '', 'k', 0), (a, c) -> {step}, a -> a.o)")


def _only_digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    """The check digit of a string of digits."""
    own = "cast(substr(w, i, 1) as int)"
    value = f"if((length(w) - i) % 2 = 0, 2 * {own} - if({own} > 4, 9, 0), {own})"
    return _let("w", digits, f"(10 - aggregate(sequence(1, length(w)), 0, (s, i) -> s + {value}) % 10) % 10")


def _valid_card(m: str) -> str:
    return _let("n", _only_digits(m), f"{_luhn('substr(n, 1, length(n) - 1)')} = cast(substr(n, -1) as int)")


def _card(key: str, m: str) -> str:
    body = f"substr(n, 1, length(n) - 1)"
    check = f"pmod({_luhn('b')} + cast(substr(n, -1) as int) - {_luhn(body)}, 10)"
    digits = _let("n", _only_digits(m), _let("b", _digits(key, "card", body), f"concat(b, cast({check} as string))"))
    return _refill(m, digits)


def _phone(key: str, m: str) -> str:
    return _let("z", f"regexp_extract({m}, '{COUNTRY}', 0)", f"concat(z, {_refill(f'substr({m}, length(z) + 1)', _digits(key, 'phone', _only_digits(f'substr({m}, length(z) + 1)')))})")


def _ip(key: str, m: str) -> str:
    network = _feistel(key, "ip", "cast(o[0] as int) * 256 + cast(o[1] as int)", "cast(o[2] as int) * 256 + cast(o[3] as int)", "65536", "65536")
    return _let("o", f"split({m}, '[.]')", _let("p", network, "concat_ws('.', cast(p.l div 256 as string), cast(p.l % 256 as string), cast(p.r div 256 as string), cast(p.r % 256 as string))"))


def _date(key: str, m: str) -> str:
    once = _let("p", _feistel(key, "date", f"x div {_SIDE}", f"x % {_SIDE}", str(_SIDE), str(_SIDE)), f"p.l * {_SIDE} + p.r")
    start = f"cast(datediff(cast({m} as date), date'1900-01-01') as bigint)"
    walk = f"aggregate(sequence(1, 20), {start}, (x, j) -> if(j = 1 or x >= {_DAYS}, {once}, x))"
    return f"date_format(date_add(date'1900-01-01', cast({walk} as int)), 'yyyy-MM-dd')"


def _ssn(key: str, m: str) -> str:
    area, group, serial = f"cast(substr({m}, 1, 3) as int)", f"cast(substr({m}, 5, 2) as int)", f"cast(substr({m}, 8, 4) as int)"
    network = _feistel(key, "ssn", f"({area} - if({area} > 666, 2, 1)) * 99 + {group} - 1", f"{serial} - 1", str(898 * 99), "9999")
    new_area = "(p.l div 99 + if(p.l div 99 >= 665, 2, 1))"
    return _let("p", network, f"concat(lpad(cast({new_area} as string), 3, '0'), '-', lpad(cast(p.l % 99 + 1 as string), 2, '0'), '-', lpad(cast(p.r + 1 as string), 4, '0'))")


def _characters(key: str, kind: str, s: str, letters: int) -> str:
    """A string whose characters move inside their class; letters: how many of the alphabet the class has."""

    def moved(half: str, other: str) -> str:
        stream = f"sha2(concat_ws('|', {key}, '{kind}', i, length(t), {other}), 256)"
        by = "cast(conv(substr(h, 2 * (j % 32) + 1, 2), 16, 10) as int)"
        of = lambda first, size: f"char({first} + (ascii(c) - {first} + {by}) % {size})"
        one = f"case when c rlike '[0-9]' then {of(48, 10)} when c rlike '[a-z]' then {of(97, letters)} when c rlike '[A-Z]' then {of(65, letters)} else c end"
        return _let("h", stream, f"array_join(transform(split({half}, ''), (c, j) -> {one}), '')")

    half = "cast(length(t) div 2 as int)"
    even = f"named_struct('l', {moved('a.l', 'a.r')}, 'r', a.r)"
    odd = f"named_struct('l', a.l, 'r', {moved('a.r', 'a.l')})"
    start = f"named_struct('l', substr(t, 1, {half}), 'r', substr(t, {half} + 1))"
    return _let("t", s, f"aggregate(sequence(0, {ROUNDS - 1}), {start}, (a, i) -> if(i % 2 = 0, {even}, {odd}), a -> concat(a.l, a.r))")


def _email(key: str, m: str) -> str:
    return f"concat({_characters(key, 'email', f'substring_index({m}, chr(64), 1)', 26)}, '@', substring_index({m}, chr(64), -1))"


def _kind(m: str) -> str:
    """Kind of a match, null if it fails its validation."""
    area = f"substr({m}, 1, 3)"
    return (
        f"case when {m} like '%@%' then 'email'"
        f" when {m} rlike '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$' then if(try_to_date({m}, 'yyyy-MM-dd') is not null, 'date', null)"
        f" when {m} rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' then if({area} not in ('000', '666') and {area} < '900' and substr({m}, 5, 2) <> '00' and substr({m}, 8) <> '0000', 'ssn', null)"
        f" when {m} rlike '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$' then if(forall(split({m}, '[.]'), o -> cast(o as int) < 256 and (o = '0' or o not like '0%')), 'ip', null)"
        f" when {m} rlike '^[+(]|^[0-9]{{3}}-' then 'phone'"
        f" when length({m}) >= 32 then 'secret'"
        f" else if({_valid_card(m)}, 'card', null) end"
    )


def _pseudonym(key: str, m: str, kind: str) -> str:
    made = {"email": _email(key, m), "date": _date(key, m), "ssn": _ssn(key, m), "phone": _phone(key, m), "ip": _ip(key, m), "card": _card(key, m), "secret": _characters(key, "secret", m, 6)}
    return f"case {kind} " + " ".join(f"when '{k}' then {made[k]}" for k in KINDS) + f" else {m} end"


def _secret(spark: SparkSession, key: str) -> Column:
    """The key as a scalar subquery, whose value no plan shows."""
    if not key:
        raise ValueError("pseudonyms need a key")
    return spark.sql("select k from values (:key) as t(k)", {"key": key}).scalar()


def _marked(rows: DataFrame, text: Column, key: str) -> DataFrame:
    """rows, whose columns are the caller's, with _key, _found (the matches; null without any), _kinds and _text."""
    found = F.when(F.rlike(text, F.lit(PATTERN)), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    kinds = rows.withColumn("_key", _secret(rows.sparkSession, key)).withColumn("_found", found).withColumn("_kinds", F.expr(f"transform(_found, m -> {_kind('m')})"))
    new = F.expr(f"zip_with(_found, _kinds, (m, y) -> {_pseudonym('_key', 'm', 'y')})")
    joined = F.array_join(F.zip_with(F.split(text, PATTERN, -1), new, lambda p, q: F.concat(p, F.coalesce(q, F.lit("")))), "")
    return kinds.withColumn("_text", F.when(F.expr("exists(_kinds, y -> y is not null)"), joined).otherwise(text))


def find_private(docs: DataFrame, key: str) -> DataFrame:
    """Documents with personal data: doc_id, the number of values of each kind, and the pseudonymised text."""
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.rlike("text", F.lit(PATTERN)))
    found = _marked(columns, F.col("text"), key).filter("exists(_kinds, y -> y is not null)")
    counts = [F.expr(f"size(filter(_kinds, y -> y = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.col("_text").alias("text"))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """All rows and columns of docs, with personal data in the texts replaced."""
    packed = docs.select(F.struct("*").alias("_row"))  # no name of its own can clash
    marked = _marked(packed, F.col("_row.text"), key)
    return marked.select(*[F.col("_text").alias(c) if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns])
