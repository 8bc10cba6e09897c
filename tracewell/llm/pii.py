"""Format-preserving pseudonyms for personal data (operator 3), in SQL expressions only.

Found and validated: e-mail addresses, telephone numbers, IPv4 addresses (octets
up to 255), payment card numbers (issuer range and Luhn), social security numbers (issued ranges)
and calendar dates. Each value is permuted by a keyed Feistel network inside its
own format, so equal values get equal pseudonyms in every document and different
values different ones:

- numbers are one integer of a domain a*b, cut into halves modulo a and b that
  take turns adding a keyed hash of the other (an alternating network over mixed
  radices is a permutation of the domain for any a and b);
- cards keep their first two digits and get a fresh check digit;
- telephone numbers keep country code and punctuation, which don't matter to the
  digits; ten digits after no code or +1 are permuted among those that begin with 0 or 1, or among the others;
- dates move within 1800 to 2199, those up to the 12th of a month and those after it
  each among themselves, so no order of day and month makes two dates look alike, and
  the same day in two notations stays the same day;
- the local part of an e-mail address is a Feistel network over its characters,
  each moved inside its class (digit, small or capital letter); a single such character
  gets its place in a keyed order of its class. The domain stays, and is hashed with the rest.

The key is a secret of the caller: the pseudonyms of who knows it can be undone. The
query and the pipeline read it from ``spark.tracewell.pii.key``; where that is unset,
a random one is made and kept there for the session, so values are linked within one
application and not between two.

What looks like such a value and fails its check is left as it is, as is every
text without a value. Results for odd input: null text stays null with count 0;
texts of any length are worked through whole; repeated rows give equal results; no rows give no rows;
other columns are carried along, whatever their names, and the new count replaces one of the same name.
"""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

ROUNDS = 8
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
DATE = r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?!\d|[./-]\d)"
IPV4 = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d)"
PHONE = r"(?<![\w+])(?:\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}|\+[2-9]\d{0,2}(?:[ .-]?\(?\d{2,4}\)?){2,4}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d|[.-]\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<![\d-])\d(?:[ -]?\d){12,18}(?!\d)"
#: Country codes of one and two digits; all others have three.
CODES = "^(1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: First two digits of the card networks.
ISSUERS = "^(4[0-9]|5[1-5]|2[2-7]|30|3[4-9]|6[0245])"
PATTERN = "|".join((EMAIL, DATE, IPV4, PHONE, SSN, CARD))


def q(text: str) -> str:
    """A raw SQL literal."""
    return "r'" + text.replace("'", "\\x27") + "'"


def _hash(key: str, kind: str, i: str, x: str) -> str:
    return f"sha2(concat({q(key)}, '|{kind}|', {i}, '|', {x}), 256)"


def feistel(value: str, a: str, b: str, key: str, kind: str) -> str:
    """SQL of the keyed permutation of a whole number in [0, a*b)."""
    part = lambda x, m: f"pmod(cast(conv(substr({_hash(key, kind, 'i', x)}, 1, 14), 16, 10) as bigint), {m})"
    start = f"named_struct('l', cast(({value}) div ({b}) as bigint), 'r', cast(pmod({value}, {b}) as bigint))"
    even = f"named_struct('l', pmod(s.l + {part('s.r', a)}, {a}), 'r', s.r)"
    odd = f"named_struct('l', s.l, 'r', pmod(s.r + {part('s.l', b)}, {b}))"
    return f"aggregate(sequence(0, {ROUNDS - 1}), {start}, (s, i) -> if(i % 2 = 0, {even}, {odd}), s -> s.l * ({b}) + s.r)"


def digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def power(n: str) -> str:
    return f"cast(rpad('1', {n} + 1, '0') as bigint)"


def permuted_digits(d: str, key: str, kind: str) -> str:
    """A digit string of up to 18 digits, permuted among those of its length."""
    n = f"length({d})"
    value = feistel(f"cast({d} as bigint)", power(f"cast({n} div 2 as int)"), power(f"cast({n} - {n} div 2 as int)"), key, kind)
    return f"if({n} = 0, '', lpad(cast({value} as string), {n}, '0'))"


def fill(m: str, d: str) -> str:
    """``m`` with its digits replaced by those of ``d``, in order."""
    return f"array_join(transform(split({m}, ''), (c, j) -> if(c rlike '[0-9]', substr({d}, length({digits(f'substr({m}, 1, j + 1)')}), 1), c)), '')"


def let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def luhn_sum(d: str) -> str:
    """Luhn sum of a digit string whose last digit counts once."""
    one = f"cast(substr({d}, length({d}) - k, 1) as int)"
    return f"aggregate(sequence(0, length({d}) - 1), 0, (t, k) -> t + if(k % 2 = 0, {one}, if({one} > 4, {one} * 2 - 9, {one} * 2)))"


def card(m: str, key: str) -> str:
    middle = permuted_digits("substr(d, 3, length(d) - 3)", key, "card")
    done = let(f"concat(substr(d, 1, 2), {middle}, '0')", "e", f"concat(substr(e, 1, length(e) - 1), cast(pmod(10 - pmod({luhn_sum('e')}, 10), 10) as string))")
    return let(digits(m), "d", f"if(d rlike '{ISSUERS}' and pmod({luhn_sum('d')}, 10) = 0, {let(done, 'f', fill(m, 'f'))}, {m})")


def ssn(m: str, key: str) -> str:
    d = digits(m)
    sound = f"not ({m} rlike '^(000|666|9)|-00-|-0000$')"
    area = f"cast(substr({d}, 1, 3) as bigint)"
    value = f"(({area} - if({area} > 666, 2, 1)) * 99 + cast(substr({d}, 4, 2) as bigint) - 1) * 9999 + cast(substr({d}, 6, 4) as bigint) - 1"
    back = let(feistel(value, "88902L", "9999L", key, "ssn"), "v", let("v div 989901L + 1", "g", "concat(lpad(cast(g + if(g >= 666, 1, 0) as string), 3, '0'), '-', lpad(cast(pmod(v div 9999L, 99L) + 1 as string), 2, '0'), '-', lpad(cast(pmod(v, 9999L) + 1 as string), 4, '0'))"))
    return f"if({sound}, {back}, {m})"


def ipv4(m: str, key: str) -> str:
    octet = lambda i: f"cast(split_part({m}, '.', {i}) as bigint)"
    value = f"(({octet(1)} * 256 + {octet(2)}) * 256 + {octet(3)}) * 256 + {octet(4)}"
    return let(feistel(f"({value})", "65536L", "65536L", key, "ip"), "v", "concat_ws('.', v div 16777216, pmod(v div 65536, 256), pmod(v div 256, 256), pmod(v, 256))")


def phone(m: str, key: str) -> str:
    def ten(first: int, a: str, kind: str) -> str:
        value = feistel(f"((cast(substr(r, 1, 1) as bigint) - {first}) * 1000000000L + cast(substr(r, 2) as bigint))", a, "100000L", key, kind)
        return let(value, "v", f"concat(cast(v div 1000000000L + {first} as string), lpad(cast(pmod(v, 1000000000L) as string), 9, '0'))")

    plain = f"case when length(r) <> 10 or length(h) > 1 or h = '7' then {permuted_digits('r', key, 'phone')} when r < '2' then {ten(0, '20000L', 'phone01')} else {ten(2, '80000L', 'phone')} end"
    return let(digits(m), "d", let(f"if({m} like '+%', regexp_extract(d, {q(CODES)}, 1), '')", "h", let("substr(d, length(h) + 1)", "r", let(f"concat(h, {plain})", "f", fill(m, "f")))))


#: The first day of the 400 years.
START = "date'1800-01-01'"


def moved_date(y: str, key: str) -> str:
    """SQL of the pseudonym of a date: of the 57,600 up to the 12th of a month, or of the 88,497 after it."""
    months = f"((year({y}) - 1800) * 12 + month({y}) - 1)"
    early = let(feistel(f"cast({months} * 12 + day({y}) - 1 as bigint)", "240L", "240L", key, "date12"), "v", f"date_add(add_months({START}, cast(v div 12 as int)), cast(pmod(v, 12) as int))")
    before = f"datediff(add_months({START}, k), {START}) - 12 * k"  # of the later days, those before month k
    month = f"array_max(filter(sequence(greatest(cast(v * 4800 div 88497 as int) - 4, 0), least(cast(v * 4800 div 88497 as int) + 4, 4799)), k -> {before} <= v))"
    late = let(feistel(f"cast(datediff({y}, {START}) - 12 * {months} - 12 as bigint)", "9L", "9833L", key, "date"), "v", let(month, "k", f"date_add(add_months({START}, k), cast(12 + v - ({before}) as int))"))
    return f"if(day({y}) <= 12, {early}, {late})"


def date(m: str, key: str) -> str:
    shape = f"case when {m} rlike '^[0-9]{{4}}-' then 'yyyy-MM-dd' when {m} rlike '^[0-9]{{4}}/' then 'yyyy/MM/dd' when {m} like '%.%' then 'dd.MM.yyyy' when cast(substr({m}, 1, 2) as int) > 12 then 'dd/MM/yyyy' else 'MM/dd/yyyy' end"
    return let(shape, "p", let(f"cast(try_to_timestamp({m}, p) as date)", "y", f"if(y >= {START} and y < date'2200-01-01', date_format({moved_date('y', key)}, p), {m})"))


def email(m: str, key: str) -> str:
    def moved(half: str, other: str) -> str:
        code = "ascii(c)"
        k = "cast(conv(substr(z, j % 32 * 2 + 1, 2), 16, 10) as int)"
        one = lambda base, size: f"chr({base} + pmod({code} - {base} + {k}, {size}))"
        body = f"array_join(transform(split({half}, ''), (c, j) -> case when c between '0' and '9' then {one(48, 10)} when c between 'a' and 'z' then {one(97, 26)} when c between 'A' and 'Z' then {one(65, 26)} else c end), '')"
        return let(_hash(key, "email", "i", f"concat({other}, '@', o)"), "z", body)

    single = "regexp_extract(w, '[0-9A-Za-z]', 0)"
    first = "case when s between '0' and '9' then 48 when s between 'a' and 'z' then 97 else 65 end"
    ranked = f"array_sort(transform(sequence(b, b + if(b = 48, 9, 25)), x -> named_struct('h', {_hash(key, 'letter', 'x', 'o')}, 'x', x)))"
    alone = let(single, "s", let(first, "b", f"replace(w, s, chr(element_at({ranked}, ascii(s) - b + 1).x))"))
    start = "named_struct('l', substr(w, 1, cast(length(w) div 2 as int)), 'r', substr(w, cast(length(w) div 2 as int) + 1))"
    step = f"if(i % 2 = 0, named_struct('l', {moved('s.l', 's.r')}, 'r', s.r), named_struct('l', s.l, 'r', {moved('s.r', 's.l')}))"
    whole = f"aggregate(sequence(1, {ROUNDS}), {start}, (s, i) -> {step}, s -> concat(s.l, s.r))"
    new = f"case length(regexp_replace(w, '[^0-9A-Za-z]', '')) when 0 then w when 1 then {alone} else {whole} end"
    return let(f"substring_index({m}, '@', 1)", "w", let(f"substr({m}, length(w) + 2)", "o", f"concat({new}, '@', o)"))


def pseudonym(m: str, key: str) -> str:
    """SQL of the pseudonym of a match, or the match where its check fails."""
    whole = lambda p: f"{m} rlike {q('^(?:' + p + ')$')}"
    return f"case when contains({m}, '@') then {email(m, key)} when {whole(DATE)} then {date(m, key)} when {whole(IPV4)} then {ipv4(m, key)} when {whole(PHONE)} then {phone(m, key)} when {whole(SSN)} then {ssn(m, key)} else {card(m, key)} end"


def secret(spark: SparkSession) -> str:
    """The session's key, made at random where none is set."""
    name = "spark.tracewell.pii.key"
    if not spark.conf.get(name, ""):
        spark.conf.set(name, secrets.token_hex(16))
    return spark.conf.get(name)


def pseudonymise(docs: DataFrame, key: str, text: str = "text", count: str = "n_pii") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, and how many values were."""
    if not key:
        raise ValueError("pseudonyms need a key")
    taken = {c.lower() for c in docs.columns}
    found_in, new_in = (next(n for n in (f"__{name}{i or ''}" for i in range(len(taken) + 1)) if n not in taken) for name in ("found", "new"))
    p, t = q(PATTERN), f"`{text}`"
    found = f"if({t} rlike '@|[0-9]{{2}}|[0-9][.]', regexp_extract_all({t}, {p}, 0), array())"
    out = docs.withColumn(found_in, F.expr(found)).withColumn(new_in, F.expr(f"transform({found_in}, m -> {pseudonym('m', key)})"))
    joined = f"if(size({found_in}) > 0, array_join(flatten(transform(split({t}, {p}, -1), (g, i) -> if(i = 0, array(g), array({new_in}[i - 1], g)))), ''), {t})"
    changed = f"if({found_in} is null, 0L, cast(size(filter(zip_with({found_in}, {new_in}, (x, y) -> x <> y), z -> z)) as bigint))"
    return out.withColumns({text: F.expr(joined), count: F.expr(changed)}).drop(found_in, new_in)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(read(spark, sf_dir, "documents").select("doc_id", "text"), secret(spark))
