"""Deterministic identifiers and normalised keys, as column expressions."""

from __future__ import annotations

import sys
import unicodedata
import uuid
from collections.abc import Mapping

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a company name may carry or not.
GENERIC_WORDS = ("coffee", "coffees", "roaster", "roasters", "roastery", "roasteries", "roasting", "company", "co", "lab", "labs", "specialty")
# Country-code domains and the currency of shops there.
TLD_CURRENCY = {
    "us": "USD", "ca": "CAD", "uk": "GBP", "ie": "EUR", "de": "EUR", "fr": "EUR", "nl": "EUR", "be": "EUR", "at": "EUR", "es": "EUR", "it": "EUR",
    "pt": "EUR", "fi": "EUR", "no": "NOK", "se": "SEK", "dk": "DKK", "ch": "CHF", "il": "ILS", "jp": "JPY", "au": "AUD", "nz": "NZD",
}


def text(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def uuid5(namespace: uuid.UUID, *parts: Column | str) -> Column:
    """UUID version 5 over the lower-cased, trimmed parts joined by ':'; empty and null parts are left out."""
    cleaned = [F.lower(F.trim(text(p).cast("string"))) for p in parts]
    name = F.concat_ws(":", *(F.when(c != "", c) for c in cleaned))
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") + 1, F.lit(1))
    return F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12))


def edge_id(prefix: str, *cols: Column | str) -> Column:
    return F.concat_ws(":", F.lit(prefix), *(text(c).cast("string") for c in cols))


def squash_ws(c: Column | str) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(text(c), r"(?U)\s+", " "))


def dedupe_key(c: Column | str) -> Column:
    return F.lower(squash_ws(c))


def null_tokens(c: Column | str) -> Column:
    """Trimmed text, with blanks and words for missing values turned to null."""
    trimmed = F.trim(text(c))
    return F.when(F.lower(trimmed).isin("", "nan", "none", "n/a", "na"), None).otherwise(trimmed)


def parse_int(c: Column | str) -> Column:
    """Whole part of a number in text; null if it is none."""
    number = text(c).try_cast("double")
    return F.when(F.isnan(number) | (F.abs(number) > 2147483647), None).otherwise(number).cast("int")


def _host(url: Column) -> Column:
    """Lower-cased host[:port] after an optional scheme and user."""
    rest = F.regexp_replace(F.lower(F.trim(url)), "^[a-z][a-z0-9+.-]*://", "")
    return F.regexp_replace(F.regexp_extract(rest, "^([^/?#]*)", 1), "^.*@", "")


def site_host(c: Column | str) -> Column:
    """Host for matching: no port, no www; null unless it has a dot."""
    host = F.regexp_replace(F.regexp_replace(_host(text(c)), ":[0-9]*$", ""), r"^www\.", "")
    return F.when(host.contains("."), host)


def site_root(c: Column | str) -> Column:
    """Scheme and host of a site, https by default."""
    url = F.trim(text(c))
    scheme = F.when(F.lower(url).startswith("http://"), "http://").otherwise("https://")
    return F.when(_host(url) != "", F.concat(scheme, _host(url)))


def join_domain(c: Column | str) -> Column:
    """Domain for joining sites: scheme and www cut off, then at the first slash and question mark; a port stays."""
    return F.split_part(F.split_part(F.regexp_replace(F.lower(text(c)), r"^https?://(www\.)?", ""), F.lit("/"), F.lit(1)), F.lit("?"), F.lit(1))


def chain_domain(c: Column | str) -> Column:
    """Host name without port, user and www; empty for blanks."""
    host = F.regexp_replace(F.regexp_replace(_host(F.coalesce(text(c), F.lit(""))), ":[0-9]*$", ""), r"^www\.", "")
    return F.coalesce(host, F.lit(""))


def location_country(c: Column | str, default: str = "Other") -> Column:
    """What follows the last comma."""
    last = F.trim(F.split_part(text(c), F.lit(","), F.lit(-1)))
    return F.when(last != "", last).otherwise(default)


def location_city(c: Column | str) -> Column:
    """What comes before the last comma; null without one."""
    city = F.trim(F.regexp_extract(text(c), r"^(.*),[^,]*$", 1))
    return F.when(city != "", city)


def lookup(c: Column, values: Mapping[str, str]) -> Column:
    """Value of a small dictionary, null if absent."""
    if not values:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), c)


def currency_for(declared: Column | str, site: Column | str, price: Column | str) -> Column:
    """The declared currency, else that of the site's country domain; null without a price."""
    tld = F.regexp_extract(chain_domain(site), r"([a-z]+)$", 1)
    known = F.coalesce(F.when(text(declared) != "", text(declared)), lookup(tld, TLD_CURRENCY))
    return F.when(text(price).isNotNull(), known)


def canon_name(c: Column | str, generic: tuple[str, ...] = GENERIC_WORDS) -> Column:
    """Identity key of a company name: plain words without a leading 'the' and trailing generic words, but never empty."""
    words = F.trim(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", " "))
    bare = F.when(words.rlike("^the( |$)"), F.trim(F.substr(words, F.lit(4)))).otherwise(words)
    short = F.regexp_replace(bare, f"^(\\S+(?: \\S+)*?)(?: (?:{'|'.join(generic)}))+$", "$1")
    return F.when(short != "", short).otherwise(dedupe_key(c))


def _folded(names: pd.Series) -> pd.Series:
    def fold(name: str | None) -> str | None:
        if name is None:
            return None
        plain = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode().casefold().replace("'", "")
        return " ".join("".join(ch if ch.isalnum() else " " for ch in plain).split())

    return names.map(fold, na_action=None)


def fold_name(c: Column | str) -> Column:
    """Accents folded to ASCII, lower case, no apostrophes, other signs to spaces (Unicode decomposition has no built-in)."""
    return F.pandas_udf(_folded, "string")(text(c))


def embed_text(name: Column | str, description: Column | str) -> Column:
    return F.concat(text(name), F.lit(" — "), F.coalesce(text(description), F.lit("")))


def category_of(c: Column | str, values: Mapping[str, str], default: str = "other") -> Column:
    return F.coalesce(lookup(F.lower(text(c)), values), F.lit(default))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
