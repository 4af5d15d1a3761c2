"""Format-preserving pseudonyms for personal data, by column functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Days from 1900-01-01 to 2099-12-31, and two factors whose product is just above.
FIRST_DAY, DAYS, DAY_A, DAY_B = "1900-01-01", 73049, 271, 270

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Names of secrets (after a part of a name, too: access_token, clientSecret, secret_key), and what a value has no part in.
_NAME = r"(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z]))(?i:token|secret|password|passwd|pwd|(?:api|access|secret|private|auth)[_\- ]?key)"
_STOP = r"\s\"'`<>"
#: A value stands after `=` or `:`; the short tests go first, since Java tries a lookbehind of any length at every position.
_AFTER = rf"(?<=[=:\s\"'`])(?<=[=:]\s{{0,3}}[\"'`]{{0,1}})(?<={_NAME}[\"'`]{{0,1}}\s{{0,3}}[=:]\s{{0,3}}[\"'`]{{0,1}})"
_QUOTED = rf"(?<=[\"'`])[^{_STOP}]{{8,}}(?=[\"'`])"
_MIXED = rf"(?=[^{_STOP}]*\d)[^{_STOP}]{{7,}}[^{_STOP}.,;:)\]}}]"
_LONG = r"[A-Za-z0-9_\-/+=]{16,}"
PATTERNS = {
    "secret": rf"{_AFTER}(?:{_QUOTED}|{_MIXED}|{_LONG})"
    r"|(?<=\s)(?<=(?<![A-Za-z])(?i:bearer)\s{1,3})(?=[A-Za-z0-9._~+/\-]*\d)[A-Za-z0-9._~+/\-]{16,}=*"
    r"|(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])",
    "email": r"(?<![\p{L}\p{N}._+\-])[\p{L}\p{N}._+\-]++@[\p{L}\p{N}\-]+(?:\.[\p{L}\p{N}\-]+)+",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)",
    "phone": r"\+\d{1,3}[ .\-]?(?:\(\d{3}\)|\d{3})[ .\-]?\d{3}[ .\-]?\d{4}(?!\d)|(?<!\d)(?:\(\d{3}\) ?|\d{3}[.\-])\d{3}[.\-]\d{4}(?!\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "date": r"(?<![\d\-])\d{4}-\d{2}-\d{2}(?![\d\-])|(?<![\d/])\d{2}/\d{2}/\d{4}(?![\d/])",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4}(?:[ \-]\d{4}){3}|\d{4}[ \-]\d{6}[ \-]\d{5})(?!\d)",
}
#: What a text must have for any pattern to match.
_ANY = r"[0-9@]|(?i:token|secret|passw|pwd|key)"
#: All patterns; group 1 is a secret, which its context tells and not its characters.
_ALL = "|".join(f"({v})" if k == "secret" else v for k, v in PATTERNS.items())


def _q(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _feistel(key: str, tag: str, left: str, right: str, a: str, b: str) -> str:
    """SQL of a Feistel permutation of the numbers below a * b, as struct<l, r> (l < a, r < b)."""
    f = lambda x: f"cast(conv(substr(sha2(concat({_q(f'{key}|{tag}|')}, cast(i as string), '|', cast({x} as string)), 256), 1, 13), 16, 10) as bigint)"
    start = f"named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint))"
    return (
        f"aggregate(sequence(1, {ROUNDS}), {start}, (s, i) -> if(i % 2 = 1, "
        f"named_struct('l', (s.l + {f('s.r')}) % {a}, 'r', s.r), named_struct('l', s.l, 'r', (s.r + {f('s.l')}) % {b})))"
    )


def _walked(key: str, tag: str, left: str, right: str, a: str, b: str, inside, steps: int = 200) -> str:
    """Cycle-walking: permute until the value is inside again; inside is SQL over a struct.

    At least a third of each domain used here is inside, so `steps` are too few with a
    probability under 1e-35; a value that is found earlier stays as it is.
    """
    step = _feistel(key, tag, "w.l", "w.r", a, b)
    start = f"named_struct('v', named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint)), 'done', false)"
    again = f"transform(array(w0.v), w -> {step})[0]"
    return f"aggregate(sequence(1, {steps}), {start}, (w0, n) -> if(w0.done, w0, transform(array({again}), x -> named_struct('v', x, 'done', {inside('x')}))[0])).v"


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _laid_out(m: str, new: str) -> str:
    """The digits `new` in the places of the digits of m."""
    return f"array_join(transform(split({m}, ''), (c, p) -> if(c between '0' and '9', substr({new}, length(regexp_replace(substr({m}, 1, p + 1), '[^0-9]', '')), 1), c)), '')"


def _luhn_sum(d: str, first_doubled: int) -> str:
    """Luhn sum of a digit string; first_doubled 1: its last digit is doubled."""
    v = f"cast(substr({d}, length({d}) - k, 1) as int)"
    return f"aggregate(sequence(0, length({d}) - 1), 0, (t, k) -> t + if((k + {first_doubled}) % 2 = 1, if({v} > 4, 2 * {v} - 9, 2 * {v}), {v}))"


def _bind(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _pad(value: str, width: str) -> str:
    return f"lpad(cast({value} as string), {width}, '0')"


def _pow10(n: str) -> str:
    return f"cast(rpad('1', {n} + 1, '0') as bigint)"


def _card(key: str) -> str:
    """First digit and length stay, the check digit is made anew; without a right one nothing changes."""
    half, rest = "((length(d) - 2) div 2)", "(length(d) - 2 - (length(d) - 2) div 2)"
    body = _feistel(key, "card", f"substr(d, 2, {half})", f"substr(d, 2 + {half}, {rest})", _pow10(half), _pow10(rest))
    payload = f"concat(substr(d, 1, 1), {_pad('v.l', half)}, {_pad('v.r', rest)})"
    whole = _bind(payload, "p", f"concat(p, cast((10 - {_luhn_sum('p', 1)} % 10) % 10 as string))")
    made = _bind(body, "v", _bind(whole, "e", _laid_out("m", "e")))
    return _bind(_digits("m"), "d", f"if({_luhn_sum('d', 0)} % 10 = 0 and d not rlike '^0+$', {made}, m)")


def _phone(key: str) -> str:
    """The last ten digits; area and exchange stay valid numbers, or not valid ones, as they were."""
    ok = lambda v: f"({v}.l div 10000 >= 2 and ({v}.l div 10) % 10 >= 2)"
    at = "named_struct('l', cast(substr(d, length(d) - 9, 5) as bigint), 'r', cast(substr(d, length(d) - 4, 5) as bigint))"
    walked = _walked(key, "phone", "o.l", "o.r", "100000", "100000", lambda x: f"{ok(x)} = {ok('o')}")
    new = f"concat(substr(d, 1, length(d) - 10), {_pad('v.l', '5')}, {_pad('v.r', '5')})"
    return _bind(_digits("m"), "d", _bind(at, "o", _bind(walked, "v", _bind(new, "e", _laid_out("m", "e")))))


def _ssn(key: str) -> str:
    ok = lambda v: f"({v}.l div 100 not in (0, 666) and {v}.l div 100 < 900 and {v}.l % 100 <> 0 and {v}.r <> 0)"
    at = "named_struct('l', cast(substr(d, 1, 5) as bigint), 'r', cast(substr(d, 6, 4) as bigint))"
    walked = _walked(key, "ssn", "o.l", "o.r", "100000", "10000", ok)
    new = f"concat({_pad('v.l', '5')}, {_pad('v.r', '4')})"
    return _bind(_digits("m"), "d", _bind(at, "o", f"if({ok('o')}, {_bind(walked, 'v', _bind(new, 'e', _laid_out('m', 'e')))}, m)"))


def _ip(key: str) -> str:
    body = _feistel(key, "ip", "int(q[0]) * 256 + int(q[1])", "int(q[2]) * 256 + int(q[3])", "65536", "65536")
    return _bind("split(m, '[.]')", "q", _bind(body, "v", "concat_ws('.', cast(v.l div 256 as string), cast(v.l % 256 as string), cast(v.r div 256 as string), cast(v.r % 256 as string))"))


def _date(key: str) -> str:
    """A valid day of 1900 to 2099 becomes another in its format.

    With slashes a date that can be day/month is, and those that can only be month/day stay such
    ones, so that no two dates of one text form come out equal.
    """

    def of(fmt: str, otherwise: str, only_month_first: bool = False) -> str:
        n = f"datediff(x, date'{FIRST_DAY}')"
        day = lambda v: f"date_add(date'{FIRST_DAY}', cast({v}.l * {DAY_B} + {v}.r as int))"
        inside = lambda v: f"({v}.l * {DAY_B} + {v}.r < {DAYS}" + (f" and day({day(v)}) > 12)" if only_month_first else ")")
        walked = _walked(key, "date", "n div " + str(DAY_B), "n % " + str(DAY_B), str(DAY_A), str(DAY_B), inside)
        made = _bind(walked, "v", f"date_format({day('v')}, '{fmt}')")
        return _bind(f"cast(try_to_timestamp(m, '{fmt}') as date)", "x", f"if(x is null, {otherwise}, {_bind(n, 'n', f'if(n >= 0 and n < {DAYS}, {made}, m)')})")

    return f"if(m like '%-%', {of('yyyy-MM-dd', 'm')}, {of('dd/MM/yyyy', of('MM/dd/yyyy', 'm', True))})"


def _email(key: str) -> str:
    """Addresses have no fixed alphabet: a keyed digest under a reserved domain."""
    return f"concat('u', substr(sha2(concat({_q(key + '|email|')}, lower(m)), 256), 1, 20), '@example.invalid')"


def _secret(key: str) -> str:
    """As long as it was: digits of a keyed digest, repeated."""
    return f"rpad(sha2(concat({_q(key + '|secret|')}, m), 256), length(m), sha2(concat({_q(key + '|secret2|')}, m), 256))"


def kind_of(m: str, secret: str) -> str:
    """SQL: which pattern a match is of; `secret` is its first group."""
    full = lambda name: f"{m} rlike {_q('^(?:' + PATTERNS[name] + ')$')}"
    others = "email ip ssn date phone".split()
    return f"case when {secret} <> '' then 'secret' " + " ".join(f"when {full(k)} then '{k}'" for k in others) + " else 'card' end"


def pseudonym(key: str) -> str:
    """SQL of the pseudonym of a match `m` of kind `kind`."""
    made = {"email": _email, "ip": _ip, "phone": _phone, "ssn": _ssn, "date": _date, "card": _card, "secret": _secret}
    return "case kind " + " ".join(f"when '{k}' then {f(key)}" for k, f in made.items()) + " else m end"


def pseudonymise(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """Replace personal data in `column` by keyed pseudonyms of the same format.

    Card numbers with a right check digit, phone numbers, IPv4 addresses, social security numbers
    and dates are permuted by Feistel networks within their format (cycle-walking keeps them
    valid), so equal values stay equal over all documents and different ones of a format
    different. E-mail addresses and secrets, of digits only, too, become keyed digests. Numbers
    that do not validate stay, and so do telephone numbers in other layouts than the North American
    ones (ten digits without separators, +49 30 12345678) and IPv6 addresses. Adds n_pii, the number
    of replaced values; all other columns stay.

    A secret is what follows a name such as `token =`, `"client_secret": "` or `accessKey:` in any
    case, up to the closing quote or white space: in quotes from 8 characters on, without them from
    8 if there is a digit, from 16 of a key's alphabet without one; plain words stay. Also what
    follows `Bearer` (16 characters with a digit), and access key ids (AKIA, ASIA).

    Null texts stay null with 0; empty texts stay empty; rows are treated one by one, so ties,
    repeated rows and hot values move nothing; no shuffle at all. An older n_pii column is replaced.
    """
    found, new = (_unused(docs, name) for name in ("found", "new"))
    text = F.col(column).cast("string")
    gaps = F.split(text, _ALL, -1)
    matches = F.arrays_zip(F.regexp_extract_all(text, F.lit(_ALL), F.lit(0)).alias("m"), F.regexp_extract_all(text, F.lit(_ALL), F.lit(1)).alias("s"))

    none = F.array().cast("array<struct<m:string,s:string>>")
    out = docs.drop("n_pii").withColumn(found, F.when(text.rlike(_ANY), matches).otherwise(none))
    made = F.expr(f"transform(transform(`{found}`, x -> named_struct('m', x.m, 'kind', {kind_of('x.m', 'x.s')})), t -> {_bind('t.m', 'm', _bind('t.kind', 'kind', pseudonym(key)))})")
    out = out.withColumn(new, made)
    joined = F.array_join(F.flatten(F.zip_with(gaps, new, lambda g, n: F.array(g, F.coalesce(n, F.lit(""))))), "")
    count = F.size(F.filter(F.zip_with(found, new, lambda a, b: a["m"] != b), lambda x: x)).cast("long")
    done = out.withColumn("n_pii", F.coalesce(count, F.lit(0).cast("long"))).withColumn(column, F.when(F.size(found) > 0, joined).otherwise(text))
    return done.drop(found, new)


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that `docs` does not have."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name
