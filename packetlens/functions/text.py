"""Text functions of the audit, as Spark expressions (and one Arrow function for NFKD)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: fixed values: what counts as a URL in a text, and the resolver in front of a DOI
_URL = r"(?i)https?\s*:\s*//[\w./?=&%#~:+-]+"
_RESOLVER = r"^https?://(?:dx\.)?doi\.org/"
_WWW = r"(?i)\bwww\.[\w./?=&%#~:+-]+"


@F.pandas_udf(StringType())
def nfkd(text: pd.Series) -> pd.Series:
    """Compatibility decomposition; Spark has no built-in one."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKD", t))


def normalize_text(text: Column) -> Column:
    """Without URLs, decomposed, lower case; only a-z, 0-9, '+', '.', '-' and single blanks."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), _URL, " "), _WWW, " ")
    return F.trim(F.regexp_replace(F.lower(nfkd(bare)), r"[^a-z0-9+.-]+", " "))


def normalized_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", " "))


def strip_uri(value: Column) -> Column:
    return F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), r"^<|>$", "")


def clean_doi(value: Column) -> Column:
    """Lower case, without resolver prefix and trailing question marks."""
    bare = F.regexp_replace(F.lower(strip_uri(value)), _RESOLVER, "")
    return F.trim(F.regexp_replace(bare, r"\?+$", ""))


def dedup_key(doi: Column, title: Column, venue: Column, year: Column) -> Column:
    """``doi:`` where there is one, else title, venue and year."""
    d = clean_doi(doi)
    other = F.concat(
        F.lit("title:"), normalized_title(title), F.lit("|venue:"), F.coalesce(venue, F.lit("")),
        F.lit("|year:"), F.coalesce(year.cast("string"), F.lit("")),
    )
    return F.when(d != "", F.concat(F.lit("doi:"), d)).otherwise(other)


#: fixed values: last part of a stream's URI -> venue and prefix of its main proceedings
VENUES = {
    "sp": ("IEEE S&P", "sp"),
    "ccs": ("ACM CCS", "ccs"),
    "uss": ("USENIX Security", "uss"),
    "ndss": ("NDSS", "ndss"),
    "sigcomm": ("SIGCOMM", "sigcomm"),
    "nsdi": ("NSDI", "nsdi"),
    "sigmetrics": ("SIGMETRICS", "sigmetrics"),
    "aaai": ("AAAI", "aaai"),
    "nips": ("NeurIPS", "neurips"),
    "www": ("The Web Conference (WWW)", "www"),
    "asiaccs": ("AsiaCCS", "asiaccs"),
    "raid": ("RAID", "raid"),
    "dsn": ("DSN", "dsn"),
    "popets": ("PETS/PoPETs", "popets"),
    "conext": ("CoNEXT", "conext"),
    "imc": ("IMC", "imc"),
}


def canonical_venue(stream: Column) -> Column:
    """Venue named by the last part of a stream's URI; NULL for an unknown one (a violation
    that the caller reports)."""
    key = F.element_at(F.split(F.regexp_replace(strip_uri(stream), "/+$", ""), "/"), -1)
    return F.try_element_at(F.create_map(*[F.lit(x) for k, (v, _) in VENUES.items() for x in (k, v)]), key)


def main_toc(venue: Column, year: Column) -> Column:
    """Key of a venue's main proceedings of a year."""
    prefix = F.try_element_at(F.create_map(*[F.lit(x) for v, t in VENUES.values() for x in (v, t)]), venue)
    return F.concat(prefix, year.cast("string"))


def literal_year(value: Column) -> Column:
    """The year of an RDF literal such as ``"2020"^^xsd:gYear``."""
    return F.regexp_replace(F.split(F.trim(value), r"\^")[0], '"', "").try_cast("int")


def split_ids(value: Column) -> Column:
    """Ids of a pipe list: trimmed, empty places dropped."""
    parts = F.transform(F.split(F.coalesce(value, F.lit("")), r"\|"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def join_ids(ids: Column) -> Column:
    """Sorted distinct ids with `` | `` between them."""
    return F.array_join(F.array_sort(F.array_distinct(ids)), " | ")


def truth(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value)) == "true", F.lit(False))


#: fixed values: TCP flag names by ascending bit, in the order of their canonical spelling
FLAG_NAMES = ("FIN", "SYN", "RST", "PSH", "ACK", "URG", "ECE", "CWR")


def flag_mask(pattern: Column) -> Column:
    """Bit mask of a flag spelling; ``NONE`` is 0, an unknown name gives NULL."""
    bit = F.create_map(*[F.lit(x) for i, n in enumerate(FLAG_NAMES) for x in (n, 1 << i)])
    bits = F.transform(F.split(pattern, r"\|"), lambda n: F.try_element_at(bit, n))
    return F.when(pattern == "NONE", F.lit(0)).otherwise(F.aggregate(bits, F.lit(0), lambda a, b: a + b))


def flag_pattern(mask: Column) -> Column:
    names = F.array_compact(F.array(*[F.when(mask.bitwiseAND(1 << i) != 0, n) for i, n in enumerate(FLAG_NAMES)]))
    return F.when(mask == 0, "NONE").otherwise(F.array_join(names, "|"))


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts with a NUL between them, in hexadecimal."""
    return F.sha2(F.concat_ws("\x00", *[p.cast("string") for p in parts]), 256)


def unordered_key(a: Column, b: Column) -> Column:
    return F.array_join(F.array_sort(F.array(a, b)), "|")


_LABEL = r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"


@F.pandas_udf(StringType())
def _idna(host: pd.Series) -> pd.Series:
    def one(h):
        if h is None or h.isascii():
            return h
        try:
            return h.encode("idna").decode("ascii")
        except UnicodeError:
            return None

    return host.map(one)


def normalize_host(host: Column) -> Column:
    """ASCII host name in lower case without trailing dots; NULL where it is not valid."""
    h = _idna(F.lower(F.regexp_replace(F.trim(host), r"\.+$", "")))
    return F.when(h.rlike(rf"^{_LABEL}(?:\.{_LABEL})*$") & (F.length(h) <= 253), h)


def https_url(url: Column) -> Column:
    """Whether a URL is https with a host, without user information and fragment."""
    return F.coalesce(
        (F.try_parse_url(url, F.lit("PROTOCOL")) == "https")
        & (F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")) != "")
        & F.try_parse_url(url, F.lit("USERINFO")).isNull()
        & F.try_parse_url(url, F.lit("REF")).isNull(),
        F.lit(False),
    )


def safe_component(value: Column) -> Column:
    """Whether a text is a safe path component of at most 128 characters."""
    return F.coalesce(value.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"), F.lit(False))


def is_sha256(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9a-f]{64}$"), F.lit(False))


@F.pandas_udf(StringType())
def twelve_digits(value: pd.Series) -> pd.Series:
    """A number with 12 significant digits; NULL gives '', a non-finite number raises."""

    def one(v):
        if v is None or pd.isna(v):
            return ""
        if v in (float("inf"), float("-inf")):
            raise ValueError("non-finite number")
        return format(v, ".12g")

    return value.map(one)


#: fixed values: words that stand for "no value" in a key that relates records
UNKNOWN_WORDS = (
    "", "-", "--", "?", "n/a", "na", "nan", "nil", "none", "null", "pending", "tbd", "undefined", "unknown", "missing",
)


def relation_key(column: Column) -> Column:
    """A relating value without outer blanks and letter case; words, and digests (32 digits or
    more) all of zeros, that stand for "unknown" give NULL.  Short values are values."""
    text = F.lower(F.regexp_replace(column.cast("string"), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(~text.isin(*UNKNOWN_WORDS) & ~text.rlike("^0{32,}$"), text)
