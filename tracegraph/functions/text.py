"""Column functions on strings: indicators, hosts, URLs, titles, timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TITLE_TOKEN = "[A-Za-z0-9]+"
ASN = r"(?i)^AS(\d+)\s*(.*)$"


def shannon_entropy(c: Column) -> Column:
    """Bits per character of a string; empty or null gives 0. Sorted, each character is one run, and the runs' lengths are the counts."""
    runs = F.regexp_extract_all(F.array_join(F.sort_array(F.split(c, "")), ""), F.lit(r"(?s)(.)\1*"), F.lit(0))
    n = F.length(c).cast("double")
    weighed = F.aggregate(runs, F.lit(0.0), lambda a, x: a + F.length(x) * F.log2(F.length(x).cast("double")))
    return F.when(n > 0, F.log2(n) - weighed / n).otherwise(F.lit(0.0))


def refang(c: Column, kind: str) -> Column:
    """Undoes the usual masking of indicators: [.] and (.) everywhere, hxxp in URLs; domains are trimmed and lower-cased."""
    plain = F.lower(F.trim(c)) if kind == "domain" else F.replace(F.trim(c), F.lit("hxxp"), F.lit("http"))
    return F.replace(F.replace(plain, F.lit("[.]"), F.lit(".")), F.lit("(.)"), F.lit("."))


def with_scheme(url: Column) -> Column:
    return F.when(url.contains("://"), url).otherwise(F.concat(F.lit("http://"), url))


def url_host(url: Column) -> Column:
    """Lower-case host without port, user and brackets; null if there is none. Falls back on a pattern where the URL does not parse."""
    full = with_scheme(url)
    host = F.coalesce(F.try_parse_url(full, F.lit("HOST")), F.regexp_extract(full, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.nullif(F.lower(F.btrim(host, F.lit("[]"))), F.lit(""))


def url_path(url: Column) -> Column:
    return F.regexp_extract(with_scheme(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def url_query(url: Column) -> Column:
    return F.regexp_extract(with_scheme(url), r"^[^?#]*\?([^#]*)", 1)


def url_fragment(url: Column) -> Column:
    return F.regexp_extract(with_scheme(url), r"^[^#]*#(.*)$", 1)


def is_ipv4_like(host: Column) -> Column:
    """Only digits once dots are removed."""
    return F.replace(host, F.lit("."), F.lit("")).rlike("^[0-9]+$")


def file_extension(path: Column, strict: bool = False) -> Column:
    """What follows the last dot of a path, lower-cased, if it has at most 10 characters; with ``strict`` only within the last segment."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]*)$" if strict else r"\.([^.]*)$", 1))
    return F.when(F.length(ext) <= 10, ext).otherwise(F.lit(""))


def title_tokens(c: Column) -> Column:
    """Set of lower-case letter and digit runs of three characters at least."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(TITLE_TOKEN), F.lit(0))
    return F.array_distinct(F.transform(F.filter(found, lambda x: F.length(x) >= 3), F.lower))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(shared, F.size(a) + F.size(b) - shared), F.lit(0.0))


def asn_number(c: Column) -> Column:
    return F.regexp_extract(c, ASN, 1).try_cast("int")


def asn_name(c: Column) -> Column:
    return F.when(asn_number(c).isNotNull(), F.trim(F.regexp_extract(c, ASN, 2))).otherwise(F.lit(""))


def parse_ts(c: Column) -> Column:
    """ISO timestamp with or without fraction, Z or offset, in UTC; null if it does not parse."""
    t = F.trim(c)
    iso = t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?$")
    return F.when(iso, F.try_to_timestamp(F.regexp_replace(t, r"([+-]\d{2})(\d{2})$", "$1:$2")))


def domain_lexical(c: Column) -> dict[str, Column]:
    return {"length": F.length(c), "digit_count": F.regexp_count(c, F.lit("[0-9]")), "period_count": F.regexp_count(c, F.lit(r"\.")), "entropy": F.round(shannon_entropy(c), 4)}


def domain_lexical_v2(c: Column) -> dict[str, Column]:
    parts = F.split(c, r"\.")
    return {"subdomains": F.greatest(F.size(parts) - 2, F.lit(0)), "last_label": F.upper(F.element_at(parts, -1)), "domain_length": F.length(c), "num_digits": F.regexp_count(c, F.lit("[0-9]"))}


def url_lexical(c: Column) -> dict[str, Column]:
    """Counts on the raw string, path, query and fragment of the refanged one."""
    clean = refang(c, "url")
    return {
        "length": F.length(c),
        "digit_count": F.regexp_count(c, F.lit("[0-9]")),
        "special_char_count": F.regexp_count(c, F.lit(r"[^\p{L}\p{N}._/:?-]")),
        "path_depth": F.size(F.filter(F.split(url_path(clean), "/"), lambda x: x != "")),
        "has_query": url_query(clean) != "",
        "has_fragment": url_fragment(clean) != "",
        "entropy": F.round(shannon_entropy(c), 4),
    }


def url_lexical_v2(c: Column) -> dict[str, Column]:
    path, host = url_path(c), F.coalesce(url_host(c), F.lit(""))
    return {
        "url_entropy": F.round(shannon_entropy(c), 4),
        "url_path_entropy": F.round(shannon_entropy(path), 4),
        "url_length": F.length(c),
        "num_periods": F.regexp_count(c, F.lit(r"\.")),
        "num_subdir": F.regexp_count(path, F.lit("/")),
        "num_digits": F.regexp_count(c, F.lit("[0-9]")),
        "num_frag": (url_fragment(c) != "").cast("int"),
        "num_params": F.regexp_count(c, F.lit("&")) + (url_query(c) != "").cast("int"),
        "url_path_length": F.length(path),
        "url_host_length": F.length(host),
        "has_port": with_scheme(c).rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*:[0-9]*[1-9][0-9]*([/?#]|$)"),
        "host_label": F.upper(F.element_at(F.split(host, r"\."), -1)),
    }


def confidence_band(p: Column, high: float = 0.45, middle: float = 0.30) -> Column:
    return F.when(p >= high, "high_confidence").when(p >= middle, "moderate_confidence").otherwise("low_confidence")


def decay_weight(age_days: Column, tau: float) -> Column:
    return F.exp(-age_days / F.lit(float(tau)))


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(8.64e10)
