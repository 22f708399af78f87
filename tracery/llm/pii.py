"""Format-preserving pseudonyms by a keyed Feistel permutation (DataFrame functions only).

One pattern finds the candidates of a text; the text is cut there and put together
again with each candidate replaced.  A candidate is validated by its own rules and
permuted within its format: a card number passes the Luhn test and so does its
pseudonym, an account number keeps valid check digits, a social number stays one that
can be given out, a date stays a valid date, an address an address.  What fails its
test stays, unless another format fits it.  Phones, mail names and secrets have no
check; their form is all there is to validate.  Cards and account numbers may be
written in groups, dates with the year first or last and with a time behind them,
phones with a country's number; a value has one pseudonym however it is grouped.

The permutation depends on the key and the format alone, so equal values get equal
pseudonyms in all documents, and different values of a format different ones.  Who has
the key can undo it: the caller has to give one, and it is part of the query's plan, so
plans and event logs of such jobs are to be kept like the key.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Formats, in the order in which they are tried at a place of the text.
FORMATS = {
    "mail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+)",
    "address": r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])",
    "date": r"(?<![0-9A-Za-z./-])[0-9]{4}(?:-[0-9]{2}-[0-9]{2}|/[0-9]{1,2}/[0-9]{1,2}|\.[0-9]{1,2}\.[0-9]{1,2})(?:(?=[Tt][0-9]{2})|(?![0-9A-Za-z-]|[./][0-9]))",
    "day": r"(?<![0-9A-Za-z./-])[0-9]{1,2}(?:\.[0-9]{1,2}\.|/[0-9]{1,2}/|-[0-9]{1,2}-)[0-9]{4}(?:(?=[Tt][0-9]{2})|(?![0-9A-Za-z]|[./-][0-9]))",
    "account": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:[ -][A-Z0-9]{4}){2,7}(?:[ -][A-Z0-9]{1,4})?)(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{4}(?:[ -][0-9]{4}){2,}(?:[ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}|[0-9]{6}[ -][0-9]{7,13})(?![0-9A-Za-z])",
    "social": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
    "abroad": r"(?<![0-9A-Za-z])\+[1-9](?:[ .()/-]{0,2}[0-9]){6,14}(?![0-9A-Za-z])",
    "number": r"(?<![0-9A-Za-z])[0-9]{13,19}(?![0-9A-Za-z])",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])",
}
#: A mail name is taken whole, with its ``@``, which no other candidate has, so a run of name characters is read once.
PATTERN = "|".join(FORMATS.values())
#: A text without any of this has no candidate.
GATE = "[0-9@]|[0-9a-f]{32}|[0-9A-F]{32}"
SECRET = "^([0-9a-f]{32,}|[0-9A-F]{32,})$"
FOURS = "^[0-9]{4}([ -][0-9]{4}){3}"
GROUPS = "^([0-9]{4}([ -][0-9]{4}){2,}([ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}|[0-9]{6}[ -][0-9]{7,13})$"
KEY_CONF = "spark.tracery.pseudonym.key"

ROUNDS = 10
#: Dates are permuted within so many days (250 * 292) from this day.
FIRST_DAY, DAYS_HIGH, DAYS_LOW = "1900-01-01", 250, 292


DIGITS = "0123456789"
LOWER = DIGITS + "abcdefghijklmnopqrstuvwxyz"
UPPER = DIGITS + "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def _at(text: Column, place: Column) -> Column:
    return F.substr(text, place, F.lit(1))


def _cut(text: Column, start: Column | int, length: Column | int) -> Column:
    return F.substr(text, *[x if isinstance(x, Column) else F.lit(x) for x in (start, length)])


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _permuted(x: Column, high: Column | int, low: Column | int, tweak: list[Column | str], key: str) -> Column:
    """Keyed permutation of the number x in 0 .. high * low - 1, by alternating Feistel rounds."""
    given = [t if isinstance(t, Column) else F.lit(t) for t in tweak]

    def f(half: Column, i: Column) -> Column:
        return F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(key), *given, i, half), 256), 1, 15), 16, 10).cast("bigint")

    def step(s: Column, i: Column) -> Column:
        left, right = s["l"], s["r"]
        odd = F.struct(((left + f(right, i)) % high).alias("l"), right.alias("r"))
        even = F.struct(left.alias("l"), ((right + f(left, i)) % low).alias("r"))
        return F.when(i % 2 == 1, odd).otherwise(even)

    start = F.struct(_div(x, low).cast("bigint").alias("l"), (x % low).cast("bigint").alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: s["l"] * low + s["r"])


def _power(base: int, n: Column) -> Column:
    return F.pow(F.lit(base), n).cast("bigint")


def _string(text: Column, alphabet: str, tweak: list[Column | str], key: str) -> Column:
    """The string permuted among those of its length over the alphabet, in pieces whose numbers a double holds exactly."""
    base, letters = len(alphabet), F.lit(alphabet)
    piece = next(n for n in range(15, 0, -1) if base**n < 2**53)

    def one(k: Column) -> Column:
        def coded(p: Column) -> Column:
            number = F.aggregate(F.sequence(F.lit(1), F.length(p)), F.lit(0).cast("bigint"), lambda v, c: v * base + F.call_function("instr", letters, _at(p, c)) - 1)
            high, low = _power(base, F.floor(F.length(p) / 2)), _power(base, F.ceil(F.length(p) / 2))

            def back(y: Column) -> Column:
                places = F.sequence(F.length(p) - 1, F.lit(0), F.lit(-1))
                return F.array_join(F.transform(places, lambda e: _at(letters, (_div(y, _power(base, e)) % base + 1).cast("int"))), "")

            return _let(_permuted(number, high, low, [*tweak, F.length(text), k], key), back)

        return _let(_cut(text, k * piece + 1, piece), coded)

    return F.array_join(F.transform(F.sequence(F.lit(0), _div(F.length(text) - 1, piece).cast("int")), one), "")


def _refilled(text: Column, digits: Column) -> Column:
    """The text with its digits replaced, in order, by those of another string."""

    def one(c: Column) -> Column:
        old = _at(text, c)
        return F.when(old.between("0", "9"), _at(digits, F.length(_digits(_cut(text, 1, c))))).otherwise(old)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), one), "")


def _luhn_sum(digits: Column, double_last: bool) -> Column:
    """Luhn sum; ``double_last`` for a number that still lacks its check digit."""

    def step(t: Column, j: Column) -> Column:
        d = _at(digits, F.length(digits) - j).cast("int")
        return t + F.when(j % 2 == (0 if double_last else 1), F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step)


def _mod97(text: Column) -> Column:
    """A string of digits and capitals, read as a number (A is 10), modulo 97."""

    def step(t: Column, j: Column) -> Column:
        ch = _at(text, j)
        return F.when(ch.between("0", "9"), (t * 10 + ch.cast("int")) % 97).otherwise((t * 100 + F.ascii(ch) - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), step)


def _is_card(g: Column) -> Column:
    return _luhn_sum(g, False) % 10 == 0


def _card(g: Column, key: str) -> Column:
    return _let(_string(_cut(g, 1, F.length(g) - 1), DIGITS, ["card"], key), lambda b: F.concat(b, ((F.lit(10) - _luhn_sum(b, True) % 10) % 10).cast("string")))


def _grouped_card(m: Column, key: str) -> Column:
    """A card in groups has the pseudonym of its digits; in a longer run of groups of four it is looked for at each of them."""
    return _let(_digits(m), lambda h: F.when(F.length(h).between(13, 19) & _is_card(h), _let(_card(h, key), lambda x: _refilled(m, x))).when(m.rlike(FOURS), _scanned(m, key)).otherwise(m))


def _scanned(g: Column, key: str) -> Column:
    def step(a: Column, o: Column) -> Column:
        part = _cut(g, o * 5 + 1, 19)
        new = _let(_digits(part), lambda w: F.when((F.length(w) == 16) & _is_card(w), _let(_card(w, key), lambda x: _refilled(part, x))).otherwise(""))

        def taken(r: Column) -> Column:
            found = F.struct(F.concat(a["o"], r, _cut(g, o * 5 + 20, 1)).alias("o"), (o + 4).alias("k"))
            return F.when(r != "", found).otherwise(F.struct(F.concat(a["o"], _cut(g, o * 5 + 1, 5)).alias("o"), (o + 1).alias("k")))

        return F.when(o < a["k"], a).otherwise(_let(new, taken))

    start = F.struct(F.lit("").alias("o"), F.lit(0).alias("k"))
    return F.aggregate(F.sequence(F.lit(0), _div(F.length(g) - 1, 5).cast("int")), start, step, lambda a: a["o"])


def _address(m: Column, key: str) -> Column:
    def swapped(q: Column) -> Column:
        value = F.aggregate(q, F.lit(0).cast("bigint"), lambda v, o: v * 256 + o)
        new = _let(_permuted(value, 65536, 65536, ["address"], key), lambda y: F.concat_ws(".", _div(y, 16777216), _div(y, 65536) % 256, _div(y, 256) % 256, y % 256))
        return F.when(F.forall(q, lambda o: o < 256), new).otherwise(m)

    return _let(F.transform(F.split(m, "[.]"), lambda o: o.cast("bigint")), swapped)


def _moved_day(text: Column, shown: Callable[[Column], Column], m: Column, key: str) -> Column:
    """``shown`` of the day that the ISO date in ``text`` is permuted to; m if it is no day or out of range."""
    first = F.lit(FIRST_DAY).cast("date")
    moved = lambda d: F.date_add(first, _permuted(d.cast("bigint"), DAYS_HIGH, DAYS_LOW, ["date"], key).cast("int"))
    return _let(F.datediff(text.try_cast("date"), first), lambda d: F.when(d.between(0, DAYS_HIGH * DAYS_LOW - 1), _let(moved(d), shown)).otherwise(m))


def _date(m: Column, key: str) -> Column:
    return _moved_day(F.regexp_replace(m, "[/.]", "-"), lambda z: F.replace(z.cast("string"), F.lit("-"), _cut(m, 5, 1)), m, key)


def _day_or_month_first(m: Column, key: str) -> Column:
    """The day comes first if written with dots, or if the first number can be no month."""

    def swapped(q: Column) -> Column:
        first, second = F.get(q, F.lit(0)), F.get(q, F.lit(1))
        day_first = m.contains(".") | (first.cast("int") > 12)
        two = lambda c: F.lpad(c.cast("string"), 2, "0")
        either = lambda a, b: F.when(day_first, two(a)).otherwise(two(b))
        iso = F.concat_ws("-", F.get(q, F.lit(2)), either(second, first), either(first, second))
        mark = _cut(m, F.length(first) + 1, 1)
        shown = lambda z: F.concat(either(F.day(z), F.month(z)), mark, either(F.month(z), F.day(z)), mark, F.lpad(F.year(z).cast("string"), 4, "0"))
        return _moved_day(iso, shown, m, key)

    return _let(F.split(m, "[./-]"), swapped)


def _account(m: Column, key: str) -> Column:
    """The longest beginning at the end of a group that has valid check digits is the account; what follows it is not."""
    squeezed = lambda o: F.regexp_replace(_cut(m, 1, o), "[ -]", "")
    fits = lambda o: _let(squeezed(o), lambda h: F.when(F.length(h) >= 15, _mod97(F.concat(_cut(h, 5, F.length(h)), _cut(h, 1, 4))) == 1).otherwise(False))
    ends = F.filter(F.sequence(F.length(m), F.lit(15), F.lit(-1)), lambda o: ((o == F.length(m)) | _at(m, o + 1).isin(" ", "-")))

    def new(h: Column) -> Column:
        rest = _cut(h, 5, F.length(h))
        tweak = ["account", F.regexp_replace(h, "[0-9]", "9")]
        filled = _let(_digits(rest), lambda g: F.when(g == "", rest).otherwise(_let(_string(g, DIGITS, tweak, key), lambda n: _refilled(rest, n))))
        check = lambda b: F.lpad((F.lit(98) - _mod97(F.concat(b, _cut(h, 1, 2), F.lit("00")))).cast("string"), 2, "0")
        return _let(filled, lambda b: F.concat(check(b), _digits(b)))

    swapped = lambda o: _let(new(squeezed(o)), lambda x: F.concat(_refilled(_cut(m, 1, o), x), _cut(m, o + 1, F.length(m))))
    # what only looks like an account may be a secret, or hold a card behind its first group
    behind = F.concat(_cut(m, 1, 5), _let(_cut(m, 6, F.length(m)), lambda u: _scanned(u, key)))
    other = F.when(m.rlike(SECRET), _secret(m, key)).when(m.rlike("^.{4}[ -][0-9]{4}([ -][0-9]{4}){3}"), behind).otherwise(m)
    return _let(F.filter(ends, fits), lambda z: F.when(F.size(z) == 0, other).otherwise(_let(F.get(z, F.lit(0)), swapped)))


def _social(m: Column, key: str) -> Column:
    area, middle, last = (_cut(m, *x).cast("bigint") for x in ((1, 3), (5, 2), (8, 4)))
    index = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + middle - 1) * 9999 + last - 1

    def drawn(y: Column) -> Column:
        k = _div(y, 99 * 9999)
        parts = ((k + F.when(k < 665, 1).otherwise(2), 3), (_div(y, 9999) % 99 + 1, 2), (y % 9999 + 1, 4))
        return F.concat_ws("-", *[F.lpad(c.cast("string"), n, "0") for c, n in parts])

    given_out = ~m.rlike("^(000|666|9..)|-00-|-0000$")
    return F.when(given_out, _let(_permuted(index, 898 * 99, 9999, ["social"], key), drawn)).otherwise(m)


def _secret(m: Column, key: str) -> Column:
    return F.when(m.rlike("[A-F]"), _string(m, DIGITS + "ABCDEF", ["secret"], key)).otherwise(_string(m, DIGITS + "abcdef", ["secret"], key))


def _mail(m: Column, key: str) -> Column:
    """A mail name with its ``@``: each run of letters and digits is permuted, the rest stays."""
    kinds = [(f"^[{x}]+$", letters) for x, letters in (("0-9", DIGITS), ("0-9a-z", LOWER), ("0-9A-Z", UPPER))]

    def run(r: Column) -> Column:
        out = F
        for pattern, letters in kinds:
            out = out.when(r.rlike(pattern), _string(r, letters, ["mail"], key))
        return out.otherwise(_string(r, LOWER + UPPER[10:], ["mail"], key))

    runs = F.transform(F.regexp_extract_all(m, F.lit("[A-Za-z0-9]+"), F.lit(0)), run)
    gaps = F.split(m, "[A-Za-z0-9]+", -1)
    return F.array_join(F.zip_with(gaps, runs, lambda g, r: F.concat(g, F.coalesce(r, F.lit("")))), "")


def _replacement(m: Column, key: str) -> Column:
    """The pseudonym of the candidate m; m itself where it is not valid."""
    phone = _let(_digits(m), lambda g: _let(_string(g, DIGITS, ["phone"], key), lambda n: _refilled(m, n)))
    return (
        F.when(m.endswith("@"), _mail(m, key))
        .when(m.rlike(r"^[0-9]+([.][0-9]+){3}$"), _address(m, key))
        .when(m.rlike("^[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}$"), _date(m, key))
        .when(m.rlike("^[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}$"), _day_or_month_first(m, key))
        .when(m.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9 -]+$"), _account(m, key))
        .when(m.rlike(GROUPS), _grouped_card(m, key))
        .when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), _social(m, key))
        .when(m.rlike("^[0-9]{13,19}$"), F.when(_is_card(m), _card(m, key)).otherwise(m))
        .when(m.rlike(SECRET), _secret(m, key))
        .otherwise(phone)
    )


def session_key(spark: SparkSession) -> str:
    """The key in the session's ``spark.tracery.pseudonym.key``; one drawn for this session where it is unset.

    Pseudonyms of different runs are linked only if the setting is given.
    """
    key = spark.conf.get(KEY_CONF, None)
    if key is None:
        key = secrets.token_hex(16)
        spark.conf.set(KEY_CONF, key)
    return key


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", counts: bool = True) -> DataFrame:
    """``docs`` with its text pseudonymised and, with ``counts``, n_found and n_replaced (longs) added.

    A candidate that fails its validation (an octet over 255, a day that does not
    exist, a number that fails the Luhn test) stays.  Null texts stay null with counts
    0; all other columns and all rows stay as they are; with ``counts``, columns named
    n_found or n_replaced are replaced.
    """
    if not key.isalnum():
        raise ValueError("the key has to be letters and digits")
    text = F.col(text_col)
    parts = F.struct(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)).alias("found"), F.split(text, PATTERN, -1).alias("gaps"))

    def filled(c: Column, new: Column) -> Column:
        whole = F.array_join(F.zip_with(c["gaps"], new, lambda g, r: F.concat(g, F.coalesce(r, F.lit("")))), "")
        changed = F.size(F.filter(F.zip_with(new, c["found"], lambda r, m: r != m), lambda x: x))
        return F.struct(whole.alias("text"), F.size(new).cast("bigint").alias("n_found"), changed.cast("bigint").alias("n_replaced"))

    cut = _let(parts, lambda c: _let(F.transform(c["found"], lambda m: _replacement(m, key)), lambda n: filled(c, n)))
    zero = F.lit(0).cast("bigint")
    keep = F.struct(text.alias("text"), zero.alias("n_found"), zero.alias("n_replaced"))
    taken = {c.lower() for c in docs.columns}
    name = next(x for x in ("_pii" + "_" * k for k in range(len(taken) + 1)) if x not in taken)
    # most texts have nothing that a format needs: they skip the long pattern
    done = docs.withColumn(name, F.when(text.rlike(GATE), cut).otherwise(keep))
    made_of = {text_col: F.col(f"{name}.text")}
    if counts:
        made_of |= {"n_found": F.col(f"{name}.n_found"), "n_replaced": F.col(f"{name}.n_replaced")}
    return done.withColumns(made_of).drop(name)
