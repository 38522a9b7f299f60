"""Format-preserving Feistel pseudonyms for personal data, in DataFrame functions only.

Validated values are replaced by a keyed permutation of their own format, so
equal values get equal pseudonyms in every document and the format (digit
groups, check digit, calendar date, address range) survives. One combined
pattern cuts a text into gaps and hits; a hit is permuted in an eight-round
Feistel network whose two halves are residues modulo ``a`` and ``b``; a value
domain is a product of the two, so the permutation never leaves it:

* phone numbers (grouped 3-3-4, ten digits in a run that a national number can
  have, or ``+`` and 8 to 15 digits in any groups): their digits without the
  country code,
* social security numbers that can be issued: their digits,
* card numbers (13 to 19 digits in a run, 4-4-4-4, 4-6-5 or 4-6-4; valid check
  digit): all digits but the last, which is computed anew,
* IPv4 addresses: two 16-bit halves,
* dates of 1900-01-01 to 2100-01-01: the day number, 73,050 = 150 x 487 days;
  NN/NN/NNNN and NN.NN.NNNN are read day first, or month first if only that is
  a date, and written back in the same order,
* e-mail addresses: no numeric format, so a keyed name at a reserved domain.

Made values are valid again: where a permutation leaves the values that can be
issued (social security numbers) or dialled (ten-digit phone numbers, which
keep being one or keep being none), it is applied again until it doesn't, which
is a permutation of those values; ``WALK`` bounds the steps, far beyond what
any value takes (a chance below 10^-15).

Left as they are: numbers in the form of a card without its check digit, ten
digits in a run that no national number can have (so times in seconds), 13
digits and more without a check digit (times in milliseconds); dates with
one-digit days or months, two-digit years, dashes (NN-NN-NNNN) or month names,
and dates outside the range; national phone numbers in groups other than
3-3-4, local ones, and ``00`` for ``+``; cards in other groups; IPv6 addresses;
social security numbers without dashes or that cannot be issued.

Repeated groups in the patterns are possessive: a chain of a million labels or
digits is matched in a loop, without recursion, and as a whole.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
FIRST_DAY, DAYS_A, DAYS_B = "1900-01-01", 150, 487

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
DATE_YMD = r"(?<![0-9.-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9])"
IPV4 = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])"
PHONE = r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
GROUPED = r"(?<![0-9A-Za-z])[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9A-Za-z])"
# 15 and 14 digit cards
GROUPED_6 = r"(?<![0-9A-Za-z])[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}(?![0-9A-Za-z])"
LONG_NUMBER = r"(?<![0-9A-Za-z])[0-9]{13,19}(?![0-9A-Za-z])"
DATE_DMY = r"(?<![0-9./])[0-9]{2}(?:\.[0-9]{2}\.|/[0-9]{2}/)[0-9]{4}(?![0-9])"
# a plus before one of the other forms is no part of it
PHONE_PLUS = (r"(?<![0-9A-Za-z+])\+(?!" + "|".join((DATE_YMD, DATE_DMY, IPV4, SSN, GROUPED, GROUPED_6)) +
              r")[1-9](?:[ .()-]{0,2}[0-9]){7,14}(?![0-9])")
# fixed value: area code and exchange of the national numbering plan
NATIONAL = r"[2-9][0-8][0-9][2-9][0-9]{6}"
PHONE_RUN = rf"(?<![0-9A-Za-z_])(?<![0-9]\.){NATIONAL}(?![0-9A-Za-z_]|\.[0-9])"
COUNTRY = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
COMBINED = "|".join((EMAIL, DATE_YMD, DATE_DMY, IPV4, SSN, PHONE, PHONE_PLUS, GROUPED, GROUPED_6, LONG_NUMBER, PHONE_RUN))
# the order in which a hit takes its kind
KINDS = ("email", "date", "ip", "ssn", "phone", "card")
WALK = 64


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("bigint")


def _feistel(left: Column, right: Column, a: Column, b: Column, key: str, domain: Column) -> Column:
    """Struct ``l, r``: the permuted pair of residues (``left`` modulo ``a``, ``right`` modulo ``b``)."""
    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))

    def step(state: Column, i: Column) -> Column:
        said = F.concat_ws("|", F.lit(key), domain, i.cast("string"), state["r"].cast("string"))
        mixed = F.conv(F.substring(F.sha2(said, 256), 1, 15), 16, 10).cast("bigint")
        size = F.when(i % 2 == 1, a.cast("bigint")).otherwise(b.cast("bigint"))
        return F.struct(state["r"].alias("l"), F.pmod(state["l"] + mixed % size, size).alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def permute_digits(digits: Column, key: str, domain: str) -> Column:
    """Keyed permutation of the strings of that many digits (2 to 36)."""
    half = F.floor(F.char_length(digits) / 2).cast("int")
    rest = F.char_length(digits) - half
    left, right = F.substr(digits, F.lit(1), half), F.substr(digits, half + 1, rest)
    tag = F.concat(F.lit(domain + "/"), F.char_length(digits).cast("string"))
    out = _feistel(left, right, _power(half), _power(rest), key, tag)
    # evaluated once, then read twice
    pair = F.transform(F.array(out), lambda s: F.concat(
        F.lpad(s["l"].cast("string"), half, "0"), F.lpad(s["r"].cast("string"), rest, "0")))
    return pair[0]


def _walked(value: Column, step: Callable[[Column], Column], fits: Callable[[Column], Column]) -> Column:
    """``step`` applied once, and again while the value doesn't fit."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), step(value), lambda v, _: F.when(fits(v), v).otherwise(step(v)))


def issuable(digits: Column) -> Column:
    """Social security numbers that can be issued."""
    return digits.rlike("^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$")


def _luhn_sum(digits: Column, shift: int) -> Column:
    """Luhn sum; ``shift`` 0: the last digit counts once, 1: doubled (a check digit will follow)."""
    def add(total: Column, i: Column) -> Column:
        d = F.substr(F.reverse(digits), i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when((i + shift) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.char_length(digits) - 1), F.lit(0), add)


def _regroup(digits: Column, hit: Column) -> Column:
    """``digits`` in the places of the digits of ``hit``."""
    pairs = F.arrays_zip(F.split(hit, "[0-9]", -1).alias("gap"), F.split(digits, "").alias("digit"))
    return F.array_join(F.transform(pairs, lambda x: F.concat(x["gap"], F.coalesce(x["digit"], F.lit("")))), "")


def _bare(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _day_first(hit: Column) -> Column:
    return F.try_to_timestamp(F.concat_ws("-", F.substr(hit, F.lit(7), F.lit(4)), F.substr(hit, F.lit(4), F.lit(2)),
                                          F.substr(hit, F.lit(1), F.lit(2))), F.lit("yyyy-MM-dd")).cast("date")


def _month_first(hit: Column) -> Column:
    return F.try_to_timestamp(F.concat_ws("-", F.substr(hit, F.lit(7), F.lit(4)), F.substr(hit, F.lit(1), F.lit(2)),
                                          F.substr(hit, F.lit(4), F.lit(2))), F.lit("yyyy-MM-dd")).cast("date")


def _date_of(hit: Column) -> Column:
    return F.when(hit.rlike("^[0-9]{4}-"), F.try_to_timestamp(hit, F.lit("yyyy-MM-dd")).cast("date")).otherwise(
        F.coalesce(_day_first(hit), _month_first(hit)))


def kind_of(hit: Column) -> Column:
    """Kind of a hit of ``COMBINED``; null if it fails its validation (it then stays as it is)."""
    day = F.datediff(_date_of(hit), F.to_date(F.lit(FIRST_DAY)))
    octets = F.transform(F.split(hit, r"\."), lambda o: o.cast("int"))
    return (F.when(hit.contains("@"), "email")
            .when(hit.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$|^[0-9]{2}([./])[0-9]{2}\1[0-9]{4}$"),
                  F.when(day.between(0, DAYS_A * DAYS_B - 1), "date"))
            .when(hit.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), F.when(F.forall(octets, lambda o: o <= 255), "ip"))
            .when(hit.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.when(issuable(_bare(hit)), "ssn"))
            .when(hit.rlike("^[0-9]{13,19}$|^[0-9]{4}([ -][0-9]{4}){3}$|^[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}$"),
                  F.when(_luhn_sum(_bare(hit), 0) % 10 == 0, "card"))
            .otherwise("phone"))


def _pseudonym(hit: Column, kind: Column, key: str) -> Column:
    digits = _bare(hit)
    body = F.substr(digits, F.lit(1), F.char_length(digits) - 1)
    card = F.transform(F.array(permute_digits(body, key, "card")), lambda p: F.concat(
        p, F.pmod(-_luhn_sum(p, 1), F.lit(10)).cast("string")))[0]
    issued = _walked(digits, lambda d: permute_digits(d, key, "ssn"), issuable)
    ssn = F.transform(F.array(issued), lambda p: F.concat_ws(
        "-", F.substr(p, F.lit(1), F.lit(3)), F.substr(p, F.lit(4), F.lit(2)), F.substr(p, F.lit(6), F.lit(4))))[0]
    # a phone number keeps its country code and separators
    kept = F.when(hit.rlike(f"^(?:{PHONE})$"), F.char_length(digits) - 10).when(
        hit.startswith("+"), F.char_length(F.regexp_extract(hit, COUNTRY, 0)) - 1).otherwise(F.lit(0))
    dialled = F.transform(F.array(F.substr(digits, kept + 1)), lambda own: _walked(
        own, lambda d: permute_digits(d, key, "phone"),
        lambda d: (F.char_length(d) != 10) | (d.rlike(f"^{NATIONAL}$") == own.rlike(f"^{NATIONAL}$"))))[0]
    phone = _regroup(F.concat(F.substr(digits, F.lit(1), kept), dialled), hit)
    octet = F.transform(F.split(hit, r"\."), lambda o: o.cast("bigint"))
    wide = F.lit(65536)
    ip = F.transform(F.array(_feistel(octet[0] * 256 + octet[1], octet[2] * 256 + octet[3], wide, wide, key, F.lit("ip"))),
                     lambda s: F.concat_ws(".", F.floor(s["l"] / 256).cast("string"), (s["l"] % 256).cast("string"),
                                           F.floor(s["r"] / 256).cast("string"), (s["r"] % 256).cast("string")))[0]
    day = F.datediff(_date_of(hit), F.to_date(F.lit(FIRST_DAY)))
    moved = F.transform(F.array(_feistel(F.floor(day / DAYS_B), day % DAYS_B, F.lit(DAYS_A), F.lit(DAYS_B), key,
                                         F.lit("date"))),
                        lambda s: F.date_add(F.to_date(F.lit(FIRST_DAY)), (s["l"] * DAYS_B + s["r"]).cast("int")))[0]
    date = (F.when(hit.rlike("^[0-9]{4}-"), F.date_format(moved, "yyyy-MM-dd"))
            .when(_day_first(hit).isNull(), F.when(hit.contains("/"), F.date_format(moved, "MM/dd/yyyy")).otherwise(
                F.date_format(moved, "MM.dd.yyyy")))
            .when(hit.contains("/"), F.date_format(moved, "dd/MM/yyyy")).otherwise(F.date_format(moved, "dd.MM.yyyy")))
    name = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(hit)), 256)
    email = F.concat(F.lit("user-"), F.substring(name, 1, 16), F.lit("@example.invalid"))
    made = {"email": email, "date": date, "ip": ip, "ssn": ssn, "phone": phone, "card": _regroup(card, hit)}
    return reduce(lambda c, k: c.when(kind == k, made[k]), KINDS[1:], F.when(kind == KINDS[0], made[KINDS[0]])
                  ).otherwise(hit)


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, text, n_<kind> ..., n_private``; row-local, no shuffle.

    ``text`` has every validated value replaced. A null text stays null with
    zero counts; an empty one stays empty. Repeated rows give equal rows, a
    null id stays null, extra columns are ignored. Hits are leftmost and do
    not overlap; at one place the first alternative of ``COMBINED`` wins.
    Equal digits in different separators get equal pseudonym digits.
    """
    text = F.col("text")
    hits = F.regexp_extract_all(text, F.lit(COMBINED), F.lit(0))
    tagged = F.transform(hits, lambda h: F.struct(h.alias("hit"), kind_of(h).alias("kind")))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("hits", F.when(text.rlike(COMBINED), tagged).otherwise(F.array().cast(
        "array<struct<hit:string,kind:string>>")))
    made = F.transform("hits", lambda x: F.struct(
        _pseudonym(x["hit"], x["kind"], key).alias("made"), x["kind"].alias("kind")))
    rows = rows.withColumn("made", made)
    pairs = F.arrays_zip(F.split(text, COMBINED, -1).alias("gap"),
                         F.concat(F.transform("made", lambda x: x["made"]), F.array(F.lit(""))).alias("made"))
    done = F.when(F.size("made") > 0, F.array_join(F.transform(pairs, lambda x: F.concat(x["gap"], x["made"])), "")
                  ).otherwise(text)

    def count(kind: str) -> Column:
        return F.coalesce(F.size(F.filter("made", lambda x: x["kind"] == kind)), F.lit(0)).cast("bigint")

    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    return rows.select("doc_id", done.alias("text"), *counts).withColumn(
        "n_private", reduce(lambda a, b: a + b, [F.col(f"n_{k}") for k in KINDS]))
