"""Format-preserving pseudonyms for personal data, by DataFrame functions only (operator 2).

One pattern finds candidates in whole texts; each is validated by its kind and replaced by a value of the same format, so that
equal values stay equal in every document. Numbers and dates go through a keyed Feistel network: the value's rank in its format is
a pair (l, r) from Z_a x Z_b, and ROUNDS rounds add keyed digests of one half to the other, which permutes the format's values.

* card: 13 to 19 digits with a right Luhn sum, in one, in fours or as 4-6-5 and 4-6-4; the first digit stays, the check digit is made anew, separators stay.
* phone: North American numbers within (area, exchange, line), with or without +1; other international ones keep two digits.
* ssn: valid area, group and serial. ipv4: four octets. date: yyyy-mm-dd, dd/mm/yyyy, dd.mm.yyyy, or mm/dd/yyyy where it can't be
  dd/mm/yyyy, 1900 to 2099; each written form is permuted in itself.
* email: keyed digests for name and host. secret: access keys and values given to password, token, secret or api_key, by keyed
  digests of the same length.

What fails validation stays as it is. Nulls and ties: a null text stays null with zero counts, an empty one stays empty; repeated
rows are treated alike. Extra columns pass through unless they bear an output's name, in which case they are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ROUNDS = 8
KINDS = ("card", "date", "email", "ipv4", "phone", "secret", "ssn")

_ADDRESS = "\\p{L}\\p{M}\\p{N}._%+\\-"
_HOST = "[\\p{L}\\p{M}\\p{N}\\-]++"
PATTERN = "|".join([
    f"(?<![{_ADDRESS}])[{_ADDRESS}]{{1,64}}+@{_HOST}(?:\\.{_HOST})*\\.\\p{{L}}{{2,24}}",
    "(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "(?i:password|passwd|pwd|token|secret|api[_\\-]?key)[\"']?[ \\t]{0,3}[=:][ \\t]{0,3}[\"']?(?=[A-Za-z_\\-]{0,60}[0-9])[A-Za-z0-9_\\-]{8,}+",
    "(?<![0-9.])(?:[0-9]{1,3}\\.){3}[0-9]{1,3}(?![0-9]|\\.[0-9])",
    "(?<![0-9A-Za-z\\-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9\\-])",
    "(?<![0-9A-Za-z/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9/])",
    "(?<![0-9A-Za-z.])[0-9]{2}\\.[0-9]{2}\\.[0-9]{4}(?![0-9])",
    "(?<![0-9A-Za-z+])(?:\\+1[ .\\-]?)?\\([0-9]{3}\\)[ .\\-]?[0-9]{3}[ .\\-]?[0-9]{4}(?![0-9])",
    "(?<![0-9A-Za-z+])\\+1[ .\\-]?[0-9]{3}[ .\\-]?[0-9]{3}[ .\\-]?[0-9]{4}(?![0-9])",
    "(?<![0-9A-Za-z+])\\+[2-9][0-9]{0,2}(?:[ \\-]?[0-9]{2,4}){2,4}(?![0-9])",
    "(?<![0-9A-Za-z\\-])[0-9]{3}[.\\-][0-9]{3}[.\\-][0-9]{4}(?![0-9\\-])",
    "(?<![0-9A-Za-z\\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\\-])",
    "(?<![0-9A-Za-z])[0-9]{4}([ \\-])[0-9]{4}[ \\-][0-9]{4}[ \\-][0-9]{1,7}(?![0-9A-Za-z])",
    "(?<![0-9A-Za-z])[0-9]{4}([ \\-])[0-9]{6}[ \\-][0-9]{4,5}(?![0-9A-Za-z])",
    "(?<![0-9A-Za-z])[0-9]{13,19}(?![0-9A-Za-z])",
])
#: What every candidate holds at least; texts without it are not searched.
HINT = "[0-9@]|AKIA|ASIA"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _feistel(kind: str, l: str, r: str, a: str, b: str, key: str) -> str:
    """A struct (l, r): the pair permuted within Z_a x Z_b. The halves take turns; each turn adds a keyed digest of the other."""
    digest = lambda half: f"cast(conv(substr(sha2(concat({key}, '|{kind}|', n, '|', cast(s.{half} as string), '|', {key}), 256), 1, 12), 16, 10) as bigint)"
    return (
        f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', cast({l} as bigint), 'r', cast({r} as bigint)), (s, n) -> named_struct("
        f"'l', if(n % 2 = 0, pmod(s.l + {digest('r')}, cast({a} as bigint)), s.l), 'r', if(n % 2 = 1, pmod(s.r + {digest('l')}, cast({b} as bigint)), s.r)))"
    )


def _padded(value: str, n: str) -> str:
    return f"lpad(cast({value} as string), {n}, '0')"


def _refill(m: str, digits: str) -> str:
    """The match with its digits replaced, in order; separators stay."""
    return f"array_join(transform(sequence(1, length({m})), i -> if(substr({m}, i, 1) between '0' and '9', substr({digits}, length(regexp_replace(substr({m}, 1, i), '[^0-9]', '')), 1), substr({m}, i, 1))), '')"


def _luhn(digits: str, doubled: int) -> str:
    """The Luhn sum, the last digit counted as place 1 and places with that parity doubled."""
    d = f"cast(substr({digits}, length({digits}) - i + 1, 1) as int)"
    return f"aggregate(sequence(1, length({digits})), 0L, (t, i) -> t + if(i % 2 = {doubled}, ({d} * 2) div 10 + ({d} * 2) % 10, {d}))"


def _let(value: str, name: str, body: str) -> str:
    """body with a name for a value that it uses several times."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _pow10(n: str) -> str:
    return f"cast(rpad('1', 1 + {n}, '0') as bigint)"


def pseudonym_sql(key: str) -> str:
    """SQL for a struct (kind, value) of the match ``m``; kind is null where validation fails."""
    k = _quoted(key)
    none = "named_struct('kind', cast(null as string), 'value', m)"
    answer = lambda kind, value: f"named_struct('kind', '{kind}', 'value', {value})"
    digits = "regexp_replace(m, '[^0-9]', '')"
    keyed = lambda kind, value: f"sha2(concat({k}, '|{kind}|', {value}, '|', {k}), 256)"

    email = f"concat('u', substr({keyed('user', 'lower(m)')}, 1, 12), '@h', substr({keyed('host', 'lower(substring_index(m, \"@\", -1))')}, 1, 8), '.example')"
    access = f"concat(substr(m, 1, 4), upper(substr({keyed('access', 'm')}, 1, 16)))"
    tail = "regexp_extract(m, '([A-Za-z0-9_\\\\-]+)$', 1)"
    secret = _let(tail, "v", f"concat(substr(m, 1, length(m) - length(v)), substr(repeat({keyed('secret', 'v')}, 1 + length(v) div 64), 1, length(v)))")
    part = lambda n: f"cast(split(m, '[.]')[{n}] as bigint)"
    ip = f"if(exists(split(m, '[.]'), o -> cast(o as int) > 255), {none}, " + _let(_feistel("ipv4", f"{part(0)} * 256 + {part(1)}", f"{part(2)} * 256 + {part(3)}", "65536", "65536", k), "p", answer("ipv4", "concat_ws('.', cast(p.l div 256 as string), cast(p.l % 256 as string), cast(p.r div 256 as string), cast(p.r % 256 as string))")) + ")"

    # The 73,049 days from 1900-01-01 to 2099-12-31 are all but two of the ranks in Z_319 x Z_229: a rank beyond them is permuted
    # again. mm/dd/yyyy is read only where the day is over 12, as dd/mm/yyyy goes first; such days are permuted again until they come
    # to one of their own, so that they stay apart from all that dd/mm/yyyy can be (a walk of over 64 steps has odds under 1e-25).
    def date(form: str, otherwise: str, own: str = "") -> str:
        day = f"datediff(cast(try_to_timestamp(m, '{form}') as date), date'1900-01-01')"
        once = _let(_feistel("date", "v div 229", "v % 229", "319", "229", k), "p", "p.l * 229 + p.r")
        moved = f"aggregate(sequence(1, {64 if own else 3}), cast(t as bigint), (v, i) -> if(i > 1 and v < 73049{own}, v, {once}))"
        return _let(day, "t", f"if(t between 0 and 73048, {answer('date', f"date_format(date_add(date'1900-01-01', cast({moved} as int)), '{form}')")}, {otherwise})")

    american_day = date("MM/dd/yyyy", none, " and day(date_add(date'1900-01-01', cast(v as int))) > 12")
    dates = f"case when m like '____-__-__' then {date('yyyy-MM-dd', none)} when m like '__/__/____' then {date('dd/MM/yyyy', american_day)} else {date('dd.MM.yyyy', none)} end"

    ten = "right(d, 10)"
    area, rest = f"cast(substr({ten}, 1, 3) as bigint)", f"(cast(substr({ten}, 4, 3) as bigint) - 200) * 10000 + cast(substr({ten}, 7, 4) as bigint)"
    american = _let(_feistel("phone", f"{area} - 200", rest, "800", "8000000", k), "p", _let(f"concat(substr(d, 1, length(d) - 10), cast(p.l + 200 as string), {_padded('p.r + 2000000', '7')})", "w", answer("phone", _refill("m", "w"))))
    half = "((length(d) - x) div 2)"
    other = lambda kind, kept: _let(f"{kept}", "x", _let(_feistel(kind, f"cast(substr(d, x + 1, {half}) as bigint)", f"cast(substr(d, x + 1 + {half}) as bigint)", _pow10(half), _pow10(f"length(d) - x - {half}"), k), "p", _let(f"concat(substr(d, 1, x), {_padded('p.l', half)}, {_padded('p.r', f'length(d) - x - {half}')})", "w", answer(kind, _refill("m", "w")))))
    phone = _let(digits, "d", f"case when (length(d) = 10 or length(d) = 11 and d like '1%') and substr({ten}, 1, 1) >= '2' and substr({ten}, 4, 1) >= '2' then {american} when m like '+%' or m like '(%' then {other('phone', '2')} else {none} end")
    serial = "cast(substr(d, 4, 2) as bigint) between 1 and 99 and cast(substr(d, 6) as bigint) between 1 and 9999 and substr(d, 1, 3) not in ('000', '666') and d < '9'"
    rank = "cast(substr(d, 1, 3) as bigint) - if(substr(d, 1, 3) > '666', 2, 1)"
    ssn = _let(digits, "d", f"if({serial}, " + _let(_feistel("ssn", rank, "(cast(substr(d, 4, 2) as bigint) - 1) * 9999 + cast(substr(d, 6) as bigint) - 1", "898", "989901", k), "p", answer("ssn", f"concat({_padded('p.l + if(p.l >= 665, 2, 1)', '3')}, '-', {_padded('p.r div 9999 + 1', '2')}, '-', {_padded('p.r % 9999 + 1', '4')})")) + f", {none})")
    u = "((length(d) - 2) div 2)"
    card_digits = _let(_feistel("card", f"cast(substr(d, 2, {u}) as bigint)", f"cast(substr(d, 2 + {u}, length(d) - 2 - {u}) as bigint)", _pow10(u), _pow10(f"length(d) - 2 - {u}"), k), "p", f"concat(substr(d, 1, 1), {_padded('p.l', u)}, {_padded('p.r', f'length(d) - 2 - {u}')})")
    card = _let(digits, "d", f"if(length(d) between 13 and 19 and {_luhn('d', 0)} % 10 = 0, " + _let(card_digits, "w", _let(f"concat(w, cast(pmod(10 - {_luhn('w', 1)} % 10, 10) as string))", "c", answer("card", _refill("m", "c")))) + f", {none})")
    return (
        f"case when m like '%@%' then {answer('email', email)} when m rlike '^A[KS]IA[A-Z0-9]+$' then {answer('secret', access)} when m rlike '[=:]' then {answer('secret', secret)}"
        f" when m rlike '^[0-9]+([.][0-9]+){{3}}$' then {ip} when m rlike '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{2}}[/.][0-9]{{2}}[/.][0-9]{{4}})$' then {dates}"
        f" when m rlike '^[+(]|^[0-9]{{3}}[.\\\\-][0-9]{{3}}[.\\\\-][0-9]{{4}}$' then {phone} when m rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' then {ssn} else {card} end"
    )


def _is(kind: str):
    return lambda k: k == kind


def pseudonymise(docs: DataFrame, key: str, counts: bool = True) -> DataFrame:
    """docs with personal data in ``text`` replaced; with counts, n_values and n_<kind> for each kind as well."""
    pattern = F.lit(PATTERN)
    columns = [c for c in docs.columns if c != "text" and not (counts and (c == "n_values" or c in [f"n_{x}" for x in KINDS]))]
    taken = {c.lower() for c in docs.columns}
    found, values = ("_" * next(i for i in range(1, len(taken) + 3) if "_" * i + x not in taken) + x for x in ("found", "values"))
    has = F.col("text").rlike(HINT)
    rows = docs.select(*columns, "text", F.when(has, F.regexp_extract_all("text", pattern, F.lit(0))).alias(found))
    some = F.size(F.coalesce(found, F.array())) > 0
    rows = rows.withColumn(values, F.when(some, F.expr(f"transform({found}, m -> {pseudonym_sql(key)})")))
    gaps = F.split("text", PATTERN, -1)
    # one gap more than values: text = gap, value, gap, value, ..., gap
    filled = F.concat(F.array_join(F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), F.col(f"{values}.value"), lambda g, v: F.concat(g, v)), ""), F.element_at(gaps, -1))
    out = [*columns, F.when(some, filled).otherwise(F.col("text")).alias("text")]
    if counts:
        kinds = F.coalesce(F.col(f"{values}.kind"), F.array().cast("array<string>"))
        out.append(F.size(F.filter(kinds, lambda k: k.isNotNull())).cast("long").alias("n_values"))
        out += [F.size(F.filter(kinds, _is(x))).cast("long").alias(f"n_{x}") for x in KINDS]
    return rows.select(*out)


#: Key of the registered query; a production key comes from the caller.
KEY = "corduroy-example-key"


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and the pseudonymised text of every document, with counts by kind."""
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)
