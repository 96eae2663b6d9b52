"""Named value validators, each Column -> boolean Column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, r"\D", "")


def ssn_range(v: Column) -> Column:
    d = F.replace(v, F.lit("-"), F.lit(""))
    area, group, serial = (F.substring(d, a, n).try_cast("int") for a, n in ((1, 3), (4, 2), (6, 4)))
    return F.coalesce(
        d.rlike(r"\A\d{9}\z") & (area != 0) & (area != 666) & (area < 900) & (group != 0) & (serial != 0), F.lit(False)
    )


def luhn(v: Column) -> Column:
    d = _digits(v)
    return F.length(d).between(13, 19) & F.call_function("luhn_check", d)


def public_ipv4(v: Column) -> Column:
    p = F.split(v, r"\.")
    o = [F.try_element_at(p, F.lit(i)).try_cast("int") for i in (1, 2, 3, 4)]
    in_range = o[0].between(0, 255) & o[1].between(0, 255) & o[2].between(0, 255) & o[3].between(0, 255)
    private = (
        o[0].isin(0, 10, 127)
        | ((o[0] == 172) & o[1].between(16, 31))
        | ((o[0] == 192) & (o[1] == 168))
        | ((o[0] == 169) & (o[1] == 254))
    )
    return F.coalesce((F.size(p) == 4) & in_range & ~private, F.lit(False))


def iban_mod97(v: Column) -> Column:
    c = F.upper(F.replace(v, F.lit(" "), F.lit("")))
    moved = F.concat(F.substr(c, F.lit(5)), F.substring(c, 1, 4))

    def step(acc: Column, ch: Column) -> Column:
        code = F.ascii(ch)
        return (
            F.when(ch.rlike("[0-9]"), (acc * 10 + code - 48) % 97)
            .when(ch.rlike("[A-Z]"), (acc * 100 + code - 55) % 97)
            .otherwise(acc)
        )

    rest = F.aggregate(F.filter(F.split(moved, ""), lambda x: x != ""), F.lit(0), step)
    return F.length(c).between(5, 34) & c.rlike(r"\A[0-9A-Z]+\z") & (rest == 1)


def phone_us(v: Column) -> Column:
    """NANPA shape: area and exchange start 2-9, are not N11, and not one repeated digit.

    The reference consults a phone-number library; this is the rule its own notes sketch.
    """
    d = _digits(v)
    ten = F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, 2, 10)).otherwise(d)
    return ten.rlike(r"\A[2-9](?!11)\d{2}[2-9](?!11)\d{2}\d{4}\z") & ~ten.rlike(r"\A(\d)\1{9}\z")


# --- fixed values: ITU calling-code zones, as a pattern over the digits after '+' -----
CALLING_CODE = (
    r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
    r"|2[1-69]\d|3[578]\d|42\d|50\d|59\d|6[7-9]\d|8[058]\d|9[679]\d"
)


def phone_intl(v: Column) -> Column:
    """E.164 shape: a known calling code, 7 to 15 digits, at least 6 after the code."""
    d = _digits(v)
    return v.startswith("+") & F.length(d).between(7, 15) & d.rlike(rf"\A(?:{CALLING_CODE})\d{{6,}}\z")


#: Validators by the name rules use; a job may add entries.
VALIDATORS: dict[str, Callable[[Column], Column]] = {
    "ssn_range": ssn_range,
    "luhn": luhn,
    "exclude_private_ips": public_ipv4,
    "iban_mod97": iban_mod97,
    "phone_us": phone_us,
    "phone_intl": phone_intl,
}


def register_validator(name: str, fn: Callable[[Column], Column]) -> None:
    """Add or replace a named validator (a Column function, or a pandas UDF)."""
    VALIDATORS[name] = fn


def passes(validator: Column, value: Column, names: list[str] | None = None) -> Column:
    """Apply the validator named in ``validator``; no or unknown name accepts."""
    out = F.lit(True)
    for name in names if names is not None else list(VALIDATORS):
        if name in VALIDATORS:
            out = F.when(validator == name, VALIDATORS[name](value)).otherwise(out)
    return out
