"""PII pseudonyms: validated numbers, dates and addresses are permuted within their format by a keyed Feistel.

A value always gets the same pseudonym under one key, in every document, and different values of a format get
different ones, so links survive; the key undoes it. All of it is DataFrame functions: a text is split at its
candidates and joined again with each candidate replaced, so what lies between stays as it is.

Formats, each with its own tweak of the key:

* card: 13 to 19 digits that pass the Luhn check, plain or in the usual groups by blanks or dashes; all but the check digit
  are permuted and the check digit is set anew. Other long numbers are left alone.
* phone: ``+`` with 8 to 15 digits, or ten digits written as ``(ddd) ddd-dddd`` or ``ddd-ddd-dddd``; a country
  code of ``+`` and up to three digits set off by a blank or mark stays, the other digits are permuted.
* ip: four numbers of 0 to 255 with dots; the 32 bits are permuted.
* date: a valid ``yyyy-mm-dd``, ``yyyy/mm/dd``, ``dd.mm.yyyy`` or ``dd/mm/yyyy`` of 1900 to 2099; the day number is
  permuted among all days of that time.
* mail: letters and digits of the local part are permuted (as one number to base 36); the domain stays.

Marks, grouping and letter case stay as they were. Null text stays null; a text without candidates stays as it is.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import put, shielded

ROUNDS = 8
CARD = r"(?<![\d.])\d{13,19}(?!\d)|(?<!\d)\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}(?!\d)|(?<!\d)\d{4}[ -]\d{6}[ -]\d{5}(?!\d)"
PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{3}\) ?\d{3}[-. ]\d{4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d){7,12}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])"
IP = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)"
DATE = r"(?<!\d)(?:(?:19|20)\d\d-\d\d-\d\d|(?:19|20)\d\d/\d\d/\d\d|\d\d\.\d\d\.(?:19|20)\d\d|\d\d/\d\d/(?:19|20)\d\d)(?!\d)"
MAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,254}+@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,}"
CANDIDATE = "|".join((MAIL, DATE, IP, PHONE, CARD))

#: Days from 1900-01-01 to 2099-12-31, as a product of two numbers: the halves of the day permutation.
DAYS_A, DAYS_B = 17, 4297


@dataclass(frozen=True)
class Key:
    """A column that holds the key: a literal, or a column of the table, so that a key need not stand in the plan."""

    column: Column
    undo: bool = False


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _number(key: Key, tweak: Column, i: int, other: Column, modulus: Column) -> Column:
    """A number below ``modulus`` from the key, the round and the other half."""
    digest = F.sha2(F.concat_ws("|", key.column, tweak, F.lit(str(i)), other.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), modulus)


def feistel(key: Key, tweak: Column, left: Column, right: Column, a: Column, b: Column) -> Column:
    """Permute pairs (left < a, right < b) into a struct ``l``, ``r``; the halves add to each other by turns, so any a and b will do."""
    order = range(ROUNDS - 1, -1, -1) if key.undo else range(ROUNDS)

    def step(i: int, pair: Column) -> Column:
        l, r = pair["l"], pair["r"]  # noqa: E741
        if i % 2:
            x = _number(key, tweak, i, l, b)
            return F.struct(l.alias("l"), F.pmod(r - x if key.undo else r + x, b).alias("r"))
        x = _number(key, tweak, i, r, a)
        return F.struct(F.pmod(l - x if key.undo else l + x, a).alias("l"), r.alias("r"))

    # each round binds the pair to a name, so that the halves are computed once
    pair = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    for i in order:
        pair = _let(pair, partial(step, i))
    return pair


def _power(base: int, n: Column) -> Column:
    return F.pow(F.lit(float(base)), n).cast("long")  # exact up to base ** n < 2 ** 53


def permute_digits(key: Key, tweak: Column, digits: Column) -> Column:
    """Another string of as many digits (2 to 30); one digit alone is shifted."""
    def body(d: Column) -> Column:
        n = F.length(d)
        m = F.floor(n / 2).cast("int")
        left, right = F.substring(d, F.lit(1), m), F.substring(d, m + 1, n - m)
        a, b = _power(10, m), _power(10, n - m)
        tag = F.concat_ws(":", tweak, n.cast("string"))
        pair = feistel(key, tag, F.when(m == 0, F.lit("0")).otherwise(left).cast("long"), right.cast("long"), a, b)
        return _let(pair, lambda p: F.concat(F.when(m == 0, F.lit("")).otherwise(F.lpad(p["l"].cast("string"), m, "0")), F.lpad(p["r"].cast("string"), n - m, "0")))

    return _let(digits, body)


def _sum_luhn(digits: Column, doubled_last: bool) -> Column:
    """Luhn sum; whether the last digit counts double (as in the digits before a check digit)."""
    def value(c: Column, i: Column) -> Column:
        x = c.cast("int") * F.when((i % 2 == 0) == F.lit(doubled_last), 2).otherwise(1)
        return x - F.when(x > 9, 9).otherwise(0)

    chars = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    return F.aggregate(F.transform(chars, value), F.lit(0), lambda s, x: s + x)


def luhn_valid(digits: Column) -> Column:
    return _sum_luhn(digits, False) % 10 == 0


def refill(shape: Column, chars: Column, slot: str) -> Column:
    """``shape`` with its characters that match ``slot`` replaced by ``chars`` in turn."""
    start = F.struct(F.lit(0).alias("i"), F.lit("").alias("out"))

    def step(state: Column, c: Column) -> Column:
        hit = c.rlike(slot)
        return F.struct(
            (state["i"] + F.when(hit, 1).otherwise(0)).alias("i"),
            F.concat(state["out"], F.when(hit, F.substring(chars, state["i"] + 1, F.lit(1))).otherwise(c)).alias("out"),
        )

    return F.aggregate(F.split(shape, ""), start, step, lambda s: s["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _card(key: Key, value: Column) -> Column:
    def body(d: Column) -> Column:
        front = permute_digits(key, F.lit("card"), F.substring(d, F.lit(1), F.length(d) - 1))
        new = _let(front, lambda f: F.concat(f, F.pmod(-_sum_luhn(f, True), F.lit(10)).cast("string")))
        return F.when(F.length(d).between(13, 19) & luhn_valid(d), refill(value, new, "[0-9]")).otherwise(value)

    return _let(_digits(value), body)


def _phone(key: Key, value: Column) -> Column:
    code = F.regexp_extract(value, r"^\+\d{1,3}(?=[ .-])", 0)
    rest = F.substring(value, F.length(code) + 1, F.length(value))
    return _let(rest, lambda r: F.concat(code, refill(r, permute_digits(key, F.lit("phone"), _digits(r)), "[0-9]")))


def _ip(key: Key, value: Column) -> Column:
    def body(p: Column) -> Column:
        n = F.transform(p, lambda x: x.cast("int"))
        new = _let(feistel(key, F.lit("ip"), n[0] * 256 + n[1], n[2] * 256 + n[3], F.lit(65536), F.lit(65536)), lambda s: F.concat_ws(
            ".", F.shiftright(s["l"], 8).cast("string"), (s["l"] % 256).cast("string"), F.shiftright(s["r"], 8).cast("string"), (s["r"] % 256).cast("string")
        ))
        plain = F.forall(p, lambda x: (x.cast("int") <= 255) & (x == x.cast("int").cast("string")))
        return F.when(plain, new).otherwise(value)

    return _let(F.split(value, r"\."), body)


def _date(key: Key, value: Column) -> Column:
    year_first = value.rlike(r"^\d{4}")
    mark = F.when(year_first, F.substring(value, 5, 1)).otherwise(F.substring(value, 3, 1))
    iso = F.when(year_first, F.translate(value, "/", "-")).otherwise(F.concat_ws("-", F.substring(value, 7, 4), F.substring(value, 4, 2), F.substring(value, 1, 2)))
    day = F.datediff(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date"), F.lit("1900-01-01").cast("date"))

    def body(n: Column) -> Column:
        def text(new: Column) -> Column:
            y, m, d = (F.date_format(new, p) for p in ("yyyy", "MM", "dd"))
            return F.when(year_first, F.concat_ws("", y, mark, m, mark, d)).otherwise(F.concat_ws("", d, mark, m, mark, y))

        pair = feistel(key, F.lit("date"), F.floor(n / DAYS_B), n % DAYS_B, F.lit(DAYS_A), F.lit(DAYS_B))
        new = _let(pair, lambda p: F.date_add(F.lit("1900-01-01").cast("date"), (p["l"] * DAYS_B + p["r"]).cast("int")))
        return F.when(n.isNotNull(), _let(new, text)).otherwise(value)

    return _let(day, body)


def _mail(key: Key, value: Column) -> Column:
    """Blocks of up to 16 letters and digits, each to base 36; letters outside a-z are first spelled as hex digits."""
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    capital = local == F.upper(local)
    plain = F.regexp_replace(F.lower(local), "[^a-z0-9]", "")

    def block(s: Column, i: Column) -> Column:
        n = F.length(s)
        m = F.floor(n / 2).cast("int")
        a, b = _power(36, m), _power(36, n - m)
        tag = F.concat_ws(":", F.lit("mail"), i.cast("string"), n.cast("string"))
        number = lambda x: F.conv(x, 36, 10).cast("long")
        pair = feistel(key, tag, F.when(m == 0, F.lit(0)).otherwise(number(F.substring(s, F.lit(1), m))), number(F.substring(s, m + 1, n - m)), a, b)
        spell = lambda x, k: F.lpad(F.lower(F.conv(x.cast("string"), 10, 36)), k, "0")
        return _let(pair, lambda p: F.concat(F.when(m == 0, F.lit("")).otherwise(spell(p["l"], m)), spell(p["r"], n - m)))

    blocks = lambda s: F.array_join(F.transform(
        F.sequence(F.lit(0), F.floor((F.length(s) - 1) / 16).cast("int")), lambda i: _let(F.substring(s, i * 16 + 1, F.lit(16)), lambda b: block(b, i))
    ), "")
    ascii_ = refill(F.lower(local), blocks(plain), "[a-z0-9]")
    # other scripts: a keyed name of hex digits, the same for equal names; it cannot be undone
    other = F.concat(F.lit("x"), F.substring(F.sha2(F.concat_ws("|", key.column, F.lit("mail"), F.lower(local)), 256), 1, 15))
    simple = F.lower(local).rlike(r"^[a-z0-9._%+-]+$")
    new = F.when(simple, ascii_).otherwise(other)
    return F.concat(F.when(capital & local.rlike("[A-Z]"), F.upper(new)).otherwise(new), F.lit("@"), domain)


def kind_of(value: Column) -> Column:
    """Format of a candidate."""
    whole = lambda p: value.rlike(rf"^(?:{p})$")
    return (
        F.when(value.contains("@"), "mail").when(whole(r"(?:\d{4}[-/]\d\d[-/]\d\d|\d\d[./]\d\d[./]\d{4})"), "date")
        .when(whole(r"\d{1,3}(?:\.\d{1,3}){3}"), "ip").when(value.rlike(r"^\+|^\(|^\d{3}-\d{3}-\d{4}$"), "phone").otherwise("card")
    )


def pseudonym(key: Key, value: Column) -> Column:
    """The pseudonym of a candidate; the candidate itself if its check fails."""
    return _let(F.struct(value.alias("v"), kind_of(value).alias("k")), lambda s: (
        F.when(s["k"] == "mail", _mail(key, s["v"])).when(s["k"] == "date", _date(key, s["v"])).when(s["k"] == "ip", _ip(key, s["v"]))
        .when(s["k"] == "phone", _phone(key, s["v"])).otherwise(_card(key, s["v"]))
    ))


@shielded
def pseudonymise(df: DataFrame, key: Column | str, text: str = "text", replaced: str | None = None, undo: bool = False) -> DataFrame:
    """``df`` with the personal values of ``text`` replaced; ``replaced`` names a column for their number.

    ``key`` is the secret: text, or a column (of the table or a SQL variable), which keeps it out of the plan.
    ``undo`` turns pseudonyms back, but for mail names of other scripts.
    """
    k = Key(F.lit(key) if isinstance(key, str) else key, undo)
    # every candidate has a digit or an @
    found = put(df, __pii_found=F.when(F.col(text).rlike("[0-9@]"), F.regexp_extract_all(F.col(text), F.lit(CANDIDATE), F.lit(0))))
    some = F.coalesce(F.size("__pii_found"), F.lit(0)) > 0
    new = put(found, __pii_new=F.when(some, F.transform("__pii_found", lambda v: pseudonym(k, v))))
    pieces = F.split(F.col(text), CANDIDATE, -1)
    joined = F.concat(F.array_join(F.zip_with(F.slice(pieces, F.lit(1), F.size("__pii_new")), "__pii_new", lambda p, v: F.concat(p, v)), ""), F.element_at(pieces, -1))
    out = {text: F.when(some, joined).otherwise(F.col(text))}
    if replaced:
        changed = F.size(F.filter(F.zip_with("__pii_found", "__pii_new", lambda a, b: a != b), lambda x: x))
        out[replaced] = F.when(some, changed).otherwise(F.lit(0)).cast("long")
    return put(new, **out).drop("__pii_found", "__pii_new").select(*df.columns, *([replaced] if replaced and replaced not in df.columns else []))
