"""Normalizers of personal attributes, as column expressions."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mail domains that count as popular.
POPULAR_DOMAINS = ("gmail.com", "orange.fr", "hotmail.fr", "free.fr", "yahoo.fr", "outlook.fr", "laposte.net", "sfr.fr")


@cache
def ascii_forms() -> tuple[dict[str, str], dict[str, str]]:
    """All non-ASCII characters whose compatibility decomposition holds ASCII characters: those with one (a letter
    under its accents), and those with several (ligatures, fractions). Built from Python's Unicode tables."""
    single, several = {}, {}
    for code in [*range(0x80, 0xD800), *range(0xE000, 0x110000)]:
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode()
        if plain:
            (single if len(plain) == 1 else several)[chr(code)] = plain
    return single, several


def strip_accents(c: Column) -> Column:
    """Compatibility decomposition without its non-ASCII characters. Characters decompose one by one, so a table for
    each gives the whole. ASCII values, nearly all, pass untouched."""
    single, several = ascii_forms()
    table = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    one = F.translate(c, "".join(single), "".join(single.values()))
    many = F.array_join(F.transform(F.split(one, ""), lambda ch: F.when(F.octet_length(ch) == 1, ch).otherwise(F.coalesce(F.try_element_at(table, ch), F.lit("")))), "")
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(F.when(F.octet_length(one) == F.length(one), one).otherwise(many))


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def norm_plain(c: Column) -> Column:
    return F.lower(trimmed(c))


def norm_phone(c: Column) -> Column:
    d = digits(c)
    return F.when(d.startswith("33"), F.concat(F.lit("+"), d)).when(d.startswith("0"), F.concat(F.lit("+33"), F.substring(d, 2, 1 << 20))).otherwise(F.concat(F.lit("+"), d))


def norm_address(c: Column) -> Column:
    """Marks become spaces."""
    return trimmed(F.regexp_replace(F.regexp_replace(F.lower(strip_accents(c)), "[^a-z0-9 ]", " "), r"\s+", " "))


def norm_name(c: Column) -> Column:
    """Hyphens become spaces, other marks go."""
    return trimmed(F.regexp_replace(F.regexp_replace(F.translate(F.lower(strip_accents(c)), "-", " "), "[^a-z ]", ""), r"\s+", " "))


#: Attribute type to normalizer; add a type here to normalize it.
NORMALIZERS = {"phone": norm_phone, "email": norm_plain, "address": norm_address, "nid": digits, "device": norm_plain, "ip": norm_plain, "employer": norm_address}


def normalized(kind: Column, value: Column) -> Column:
    """The value by its type's normalizer; a value of another type is only trimmed and lower-cased."""
    out = norm_plain(value)
    for k, f in NORMALIZERS.items():
        out = F.when(kind == k, f(value)).otherwise(out)
    return out


def identity_key(first: Column, last: Column, dob: Column) -> Column:
    return F.concat(norm_name(first), F.lit(" "), norm_name(last), F.lit("|"), dob)


def email_domain(c: Column) -> Column:
    return F.try_element_at(F.split(c, "@"), F.lit(2))


def popular_domain(c: Column) -> Column:
    """Whether an address is at one of the popular domains; false without a domain."""
    return F.coalesce(email_domain(c).isin(*POPULAR_DOMAINS), F.lit(False))


def bank_prefix(person_id: Column) -> Column:
    """The bank of an account number ``<bank>-<number>``."""
    return F.substring_index(person_id.cast("string"), "-", 1)
