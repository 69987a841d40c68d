"""Format-preserving pseudonyms for personal numbers, dates and addresses in text.

Every value is taken apart into positions with a radix each (a digit has 10, the
first digit of an area code 8, an IPv4 octet 256, a day of the 400-year calendar
cycle 189 x 773) and the positions go through a keyed Feistel network over their
product group. That is a permutation within the format: the result is again
valid, different values stay different, and equal values get the same pseudonym
in every document, so links survive. Built-in expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import bind, shielded

ROUNDS = 10
KEY = "plumbline-default-key"

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![A-Za-z0-9-])"
IPV4 = rf"(?<![0-9A-Za-z.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9A-Za-z]|\.[0-9])"
DATE = (
    r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}"
    r"|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9A-Za-z/-]|\.[0-9])"
)
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
PHONE = (
    r"(?<![0-9A-Za-z])(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\)[ .-]?|[2-9][0-9]{2}[ .-])"
    r"[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9A-Za-z])"
)
_OTHERS = rf"(?!{EMAIL}|{IPV4}|{DATE}|{SSN})"
#: No 16 digits before here that only a phone's separators part; loops are not allowed in a look-behind.
_FITS = "(?<!" + r"[ .()-]{0,3}".join(["[0-9]"] * 16) + r"\)?)"
# At most 15 digits, and from the third group on none that begins another value.
ABROAD = (
    r"(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,5}\)?){2}"
    rf"(?:[ .-]?{_OTHERS}\(?[0-9]{{2,5}}\)?){{0,3}}(?![0-9A-Za-z]){_FITS}"
)
# A number in one of a card's usual groupings is looked for wherever a group begins, as another
# number may stand before or behind it; any other grouping must be the whole run of digits.
GROUPED = "|".join(
    rf"[0-9]{{{n[0]}}}" + "".join(rf"{sep}[0-9]{{{k}}}" for k in n[1:])
    for n in ((4, 4, 4, 4, 3), (4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 3, 3, 3))
    for sep in " -"
)
CANDIDATE = rf"(?<![0-9A-Za-z])(?=((?:[0-9]{{13,19}}|{GROUPED})(?![0-9A-Za-z]|[._%+-]*[A-Za-z0-9._%+-]*@)))"
SHORTER = rf"(?<![0-9A-Za-z])(?=([0-9]{{4}}(?:(?: [0-9]{{4}}){{3}}|(?:-[0-9]{{4}}){{3}})(?![0-9A-Za-z])))"
CARD = rf"(?<![0-9A-Za-z])[0-9](?:(?:[ -]{_OTHERS}(?!{PHONE}))?[0-9]){{12,18}}(?![0-9A-Za-z])"
KINDS = {"email": EMAIL, "ip": IPV4, "date": DATE, "ssn": SSN, "phone": PHONE, "abroad": ABROAD, "card": CARD}
#: Stands around a card's number that has been replaced; a noncharacter of Unicode.
_MARK = "\ufdd0"
#: Noncharacters that stand for a mark of the input, with ``_ESCAPE`` before them.
_ESCAPE, _AS_MARK, _AS_ESCAPE = "\ufdd1", "\ufdd2", "\ufdd3"
DONE = rf"{_MARK}[0-9 -]{{13,24}}{_MARK}"
ANY = "|".join([DONE, *KINDS.values()])

#: Days of the calendar's 400-year cycle: 146097 = 189 * 773.
CYCLE, HIGH, LOW = 146097, 189, 773
_FORMATS = {
    r"^[0-9]{4}-": "yyyy-MM-dd",
    r"^[0-9]{4}/": "yyyy/MM/dd",
    r"^[0-9]{2}/": "MM/dd/yyyy",
    r"^[0-9]{2}\.": "dd.MM.yyyy",
}


def _permuted(values: Column, radixes: Column, kind: str, key: str) -> Column:
    """The keyed Feistel permutation of an array of numbers, each below its radix."""

    def shifted(st: Column, k: Column) -> Column:
        other = F.array_join(st["b"].cast("array<string>"), ",")
        part = lambda i: F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), k, i, other), 256)
        noise = lambda i: F.conv(F.substring(part(i), 1, 14), 16, 10).cast("long")
        return F.transform(st["a"], lambda v, i: (v + noise(i)) % F.get(st["ra"], i))

    def halves(v: Column, n: Column) -> tuple[Column, Column]:
        cut = F.floor(n / 2).cast("int")
        return F.slice(v, F.lit(1), cut), F.slice(v, cut + 1, n)

    n = F.size(values)
    (a, b), (ra, rb) = halves(values, n), halves(radixes, n)
    start = F.struct(a.alias("a"), b.alias("b"), ra.alias("ra"), rb.alias("rb"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        start,
        lambda st, k: F.struct(
            st["b"].alias("a"), shifted(st, k).alias("b"), st["rb"].alias("ra"), st["ra"].alias("rb")
        ),
        lambda st: F.concat(st["a"], st["b"]),
    )


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _numbers(text: Column) -> Column:
    """The digits of a digit string as an array of longs."""
    return F.transform(F.regexp_extract_all(text, F.lit("[0-9]"), F.lit(0)), lambda c: c.cast("long"))


def _joined(numbers: Column) -> Column:
    return F.array_join(numbers.cast("array<string>"), "")


def _refilled(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced, in order, by those of ``digits``; what separates them stays."""
    return F.array_join(
        F.transform(
            F.split(value, ""),
            lambda c, i: F.when(
                c.rlike("[0-9]"), F.substring(digits, F.length(_digits(F.substring(value, F.lit(1), i + 1))), F.lit(1))
            ).otherwise(c),
        ),
        "",
    )


def _ranged(numbers: Column, lows: Column, sizes: Column, kind: str, key: str) -> Column:
    """Permutes numbers that lie in [low, low + size), position by position."""
    moved = F.zip_with(numbers, lows, lambda x, low: x - low)
    return F.zip_with(_permuted(moved, sizes, kind, key), lows, lambda x, low: x + low)


def _luhn_sum(numbers: Column) -> Column:
    """The Luhn sum where the last number has weight one."""
    doubled = F.transform(
        F.reverse(numbers), lambda d, i: F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, F.lit(9)).otherwise(0))
    )
    return F.aggregate(doubled, F.lit(0).cast("long"), lambda s, x: s + x)


def _card(value: Column, key: str) -> Column:
    """The first digit stays, the last is the check digit of the rest; null unless valid."""

    def of(ds: Column) -> Column:
        n = F.size(ds)
        inner = F.slice(ds, F.lit(2), n - 2)
        moved = _permuted(inner, F.transform(inner, lambda _: F.lit(10).cast("long")), "card", key)
        body = F.concat(F.slice(ds, 1, 1), moved)
        return bind(
            body,
            lambda b: F.concat(_joined(b), ((10 - _luhn_sum(F.concat(b, F.array(F.lit(0).cast("long")))) % 10) % 10).cast("string")),
        )

    return bind(
        _numbers(value), lambda ds: F.when(_luhn_sum(ds) % 10 == 0, _refilled(value, of(ds)))
    )


def _longs(*values: int) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


def _phone(value: Column, key: str) -> Column:
    """The ten national digits; area and exchange codes keep beginning with 2 to 9."""

    def of(text: Column) -> Column:
        n = F.length(text)
        last = _numbers(F.substring(text, n - 9, F.lit(10)))
        lows, sizes = _longs(2, 0, 0, 2, 0, 0, 0, 0, 0, 0), _longs(8, 10, 10, 8, 10, 10, 10, 10, 10, 10)
        return F.concat(F.substring(text, F.lit(1), n - 10), _joined(_ranged(last, lows, sizes, "phone", key)))

    return bind(_digits(value), lambda text: _refilled(value, of(text)))


def _abroad(value: Column, key: str) -> Column:
    """All but the first two digits of a number of 8 to 15 digits; null for others."""

    def of(text: Column) -> Column:
        rest = _numbers(F.substring(text, F.lit(3), F.length(text)))
        moved = _permuted(rest, F.transform(rest, lambda _: F.lit(10).cast("long")), "abroad", key)
        return F.concat(F.substring(text, 1, 2), _joined(moved))

    return bind(
        _digits(value), lambda text: F.when(F.length(text).between(8, 15), _refilled(value, of(text)))
    )


def _ssn(value: Column, key: str) -> Column:
    """Area 001-665 or 667-899, group 01-99, serial 0001-9999; null unless valid."""

    def of(p: Column) -> Column:
        area, group, serial = p[0], p[1], p[2]
        valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        at = F.array(area - F.when(area > 666, F.lit(2)).otherwise(F.lit(1)), group - 1, serial - 1)
        moved = _permuted(at, _longs(898, 99, 9999), "ssn", key)
        back = bind(
            moved,
            lambda m: F.format_string(
                "%03d-%02d-%04d", m[0] + F.when(m[0] > 664, F.lit(2)).otherwise(F.lit(1)), m[1] + 1, m[2] + 1
            ),
        )
        return F.when(valid, back)

    return bind(F.transform(F.split(value, "-"), lambda x: x.cast("long")), of)


def _ipv4(value: Column, key: str) -> Column:
    octets = F.transform(F.split(value, r"\."), lambda x: x.cast("long"))
    return F.array_join(_permuted(octets, _longs(256, 256, 256, 256), "ip", key).cast("array<string>"), ".")


def _date(value: Column, key: str) -> Column:
    """Another day of the same 400-year cycle, counted from 1800-01-01; null unless a day of the calendar."""

    def of(fmt: str) -> Column:
        day = F.date_diff(F.try_to_date(value, fmt), F.lit("1800-01-01").cast("date")).cast("long")

        def moved(d: Column) -> Column:
            at = F.pmod(d, F.lit(CYCLE))
            put = _permuted(F.array(F.floor(at / LOW), at % LOW), _longs(HIGH, LOW), "date", key)
            new = bind(put, lambda p: d - F.pmod(d, F.lit(CYCLE)) + p[0] * LOW + p[1])
            return F.date_format(F.date_add(F.lit("1800-01-01").cast("date"), new.cast("int")), fmt)

        return bind(day, lambda d: F.when(d.isNotNull(), moved(d)))

    out = F.lit(None).cast("string")
    for head, fmt in _FORMATS.items():
        out = F.when(value.rlike(head), of(fmt)).otherwise(out)
    return out


def _email(value: Column, key: str) -> Column:
    """Letters stay letters of their case and digits digits before the @; the domain stays."""
    local = F.substring_index(value, "@", 1)
    codes = F.transform(F.split(local, ""), lambda c: F.ascii(c).cast("long"))

    def placed(c: Column) -> Column:
        low = F.when(c.between(97, 122), 97).when(c.between(65, 90), 65).when(c.between(48, 57), 48).otherwise(c)
        size = F.when(c.between(97, 122) | c.between(65, 90), 26).when(c.between(48, 57), 10).otherwise(1)
        return F.struct(low.cast("long").alias("low"), size.cast("long").alias("size"))

    moved = bind(
        codes,
        lambda cs: bind(F.transform(cs, placed), lambda ks: _ranged(cs, ks["low"], ks["size"], "email", key)),
    )
    return F.concat(F.array_join(F.transform(moved, lambda c: F.char(c)), ""), F.lit("@"), F.substring_index(value, "@", -1))


_PSEUDONYM = {
    "email": _email, "ip": _ipv4, "date": _date, "ssn": _ssn, "phone": _phone, "abroad": _abroad, "card": _card,
}


def _found(value: Column, key: str) -> Column:
    """The kind and pseudonym of a matched value, both null where it fails its validation."""
    def named(kind: str) -> Column:
        return bind(
            _PSEUDONYM[kind](value, key),
            lambda p: F.struct(F.when(p.isNotNull(), F.lit(kind)).alias("kind"), p.alias("to")),
        )

    done = F.struct(F.lit("card").alias("kind"), F.translate(value, _MARK, "").alias("to"))
    out = F.when(value.startswith(_MARK), done)
    for kind, pattern in KINDS.items():
        out = out.when(value.rlike(f"^(?:{pattern})$"), named(kind))
    return out


def _cards_replaced(text: Column, key: str) -> Column:
    """``text`` with the valid numbers in a card's grouping replaced, between marks."""
    candidates = F.array_distinct(
        F.concat(*[F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) for pattern in (CANDIDATE, SHORTER)])
    )
    valid = F.filter(
        F.transform(candidates, lambda v: F.struct(v.alias("value"), _card(v, key).alias("to"))),
        lambda c: c["to"].isNotNull(),
    )

    def replaced(cards: Column) -> Column:
        return F.aggregate(
            cards,
            text,
            lambda t, c: F.regexp_replace(
                t,
                F.concat(F.lit(f"(?<![0-9A-Za-z{_MARK}])"), c["value"], F.lit("(?![0-9A-Za-z])")),
                F.concat(F.lit(_MARK), c["to"], F.lit(_MARK)),
            ),
        )

    return bind(valid, lambda cards: F.when(F.size(cards) > 0, replaced(cards)).otherwise(text))


def _count_of(kind: str) -> Column:
    return F.size(F.filter("_found", lambda f: f["hit"]["kind"] == kind)).cast("long")


def _escaped(text: Column) -> Column:
    """``text`` without ``_MARK``, so that a mark always is one of ours."""
    whole = F.replace(F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPE + _AS_ESCAPE)), F.lit(_MARK), F.lit(_ESCAPE + _AS_MARK))
    return F.when(text.contains(_MARK) | text.contains(_ESCAPE), whole).otherwise(text)


def _unescaped(text: Column) -> Column:
    whole = F.replace(F.replace(text, F.lit(_ESCAPE + _AS_MARK), F.lit(_MARK)), F.lit(_ESCAPE + _AS_ESCAPE), F.lit(_ESCAPE))
    return F.when(text.contains(_ESCAPE), whole).otherwise(text)


def pseudonymise(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with ``text`` rewritten and a count ``n_<kind>`` of the values replaced.

    A projection without a shuffle, over whole texts. Values that fail their
    validation (Luhn sum, calendar, ranges) stay. A null text stays null with
    counts of zero, repeated rows are treated alike, and other columns stay, but
    for columns named as the counts, which are replaced. ``key`` decides the
    permutation: keep it secret, and the same for texts that are to stay linked.
    """
    return shielded(docs, ("_marked", "_found"), lambda rows: _pseudonymised(rows, key))


def _pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    found = F.transform(
        F.regexp_extract_all(F.coalesce(F.col("_marked"), F.lit("")), F.lit(ANY), F.lit(0)),
        lambda v: F.struct(v.alias("value"), _found(v, key).alias("hit")),
    )
    new = F.zip_with(
        F.split("_marked", ANY, -1),
        F.concat(F.transform("_found", lambda f: F.coalesce(f["hit"]["to"], f["value"])), F.array(F.lit(""))),
        lambda piece, to: F.concat(piece, to),
    )
    counts = {f"n_{kind}": _count_of(kind) for kind in KINDS}
    rows = docs.withColumn("_marked", _cards_replaced(_escaped(F.col("text")), key)).withColumn("_found", found)
    changed = _unescaped(F.array_join(new, ""))
    return rows.withColumns({"text": F.when(F.size("_found") > 0, changed).otherwise(F.col("text")), **counts}).drop(
        "_found", "_marked"
    )


def rewritten(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with ``text`` rewritten and nothing added: columns named as the counts stay as they are."""
    names = tuple(f"n_{kind}" for kind in KINDS)
    return shielded(docs, names, lambda rows: pseudonymise(rows, key).select(rows.columns))


def pseudonym_rows(docs: DataFrame) -> DataFrame:
    return pseudonymise(docs.select("doc_id", "text"))
