"""URL keys and shapes, from the parts that ``try_parse_url`` gives."""

from __future__ import annotations

from functools import reduce
import re
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Compound public suffixes that take three labels for a registrable domain.
COMPOUND_SUFFIXES = ["co.uk", "co.jp", "co.kr", "co.nz", "co.za", "co.in", "com.au", "com.br", "com.mx", "com.tr", "com.sg", "com.ar", "org.uk", "net.au", "ac.uk", "gov.uk"]
# Query keys that never tell two variants of a page apart.
NOISE_KEYS = (
    r"(?i)^(utm_|gclid$|fbclid$|msclkid$|ref$|referrer$|source$|campaign$|_ga$|_gl$|page$|sort$|q$|search$|lang$|locale$|currency$|srsltid$|_pos$|_sid$|_ss$|_kx$"
    r"|mc_|pr_|cm_|icid$|irclickid$|ranmid$|view$|gad_source$|gbraid$|wbraid$|dclid$|ttclid$|twclid$|igshid$|mkt_tok$|_hsenc$|_hsmi$|hsa_|si$|trk$|spm$|_branch_match_id$|clickid$)"
)


def part(url: Column, name: str) -> Column:
    return F.try_parse_url(url, F.lit(name))


def host(url: Column) -> Column:
    return F.lower(part(url, "HOST"))


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def path(url: Column) -> Column:
    return F.coalesce(part(url, "PATH"), F.lit(""))


def http_url(url: Column, base: Column | None = None) -> Column:
    """Absolute http(s) address without fragment and with a lower-case host; null for anything else, a bare
    fragment or dot segment included. Relative addresses are resolved against ``base`` where one is given."""
    tidy = F.trim(url)
    address = F.regexp_replace(tidy if base is None else absolute(tidy, base), FRAGMENT, "")
    return _http(tidy, address, F.regexp_extract(address, HTTP, 1), F.regexp_extract(address, HTTP_REST, 1))


def http_urls(urls: Column, joined: Column | None = None) -> Column:
    """``http_url`` of each of an array's addresses, in their order; ``joined`` has each as it is joined with its page's."""
    # a transform binds what several tests of the next one read
    whole = urls if joined is None else joined
    bound = F.zip_with(urls, whole, lambda u, w: F.struct(F.trim(u).alias("tidy"), F.regexp_replace(F.trim(w) if joined is None else w, FRAGMENT, "").alias("address")))
    bound = F.transform(bound, lambda x: F.struct(x["tidy"].alias("tidy"), x["address"].alias("address"), F.regexp_extract(x["address"], HTTP, 1).alias("head"), F.regexp_extract(x["address"], HTTP_REST, 1).alias("rest")))
    return F.transform(bound, lambda x: _http(x["tidy"], x["address"], x["head"], x["rest"]))


FRAGMENT, HTTP, HTTP_REST = r"#.*$", r"(?i)^(https?://[^/?#]+)", r"(?i)^https?://[^/?#]+(.*)$"


def _http(tidy: Column, address: Column, head: Column, rest: Column) -> Column:
    names_page = tidy.rlike(r"^(#|\.{1,2}/?$)") | (tidy == "")
    slashed = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(~names_page & address.rlike(r"(?i)^https?://[^/?#\s]+") & host(address).isNotNull(), F.concat(F.lower(head), slashed))


def absolute(url: Column, base: Column) -> Column:
    """Join of a relative address with its page's; batches visit Python."""

    @F.pandas_udf("string")
    def joined(urls: pd.Series, bases: pd.Series) -> pd.Series:
        return pd.Series([joined_url(u, b) for u, b in zip(urls, bases)], dtype=object)

    return joined(url, base)


# addresses from the root that are joined as they are written: no dot, query, parameter or second slash
_ROOTED = re.compile(r"/(?:[\w%+-][\w%+/-]*)?(?:#[\w-]*)?", re.A)
_ORIGIN = re.compile(r"(https?://[\w.:-]+)/[\w%./+-]*", re.A)


def joined_url(url: str | None, base: str | None) -> str | None:
    """``urljoin``; null for what it can't read."""
    if url is None:
        return None
    if _ROOTED.fullmatch(url) and (origin := _ORIGIN.fullmatch(base or "")):
        return origin[1] + url.removesuffix("#")
    try:
        return urljoin(base or "", url)
    except ValueError:
        return None


def image_key(url: Column) -> Column:
    """Two renditions of one image share host and path."""
    return F.coalesce(F.concat(host(url), path(url)), url)


def root_domain(host_name: Column) -> Column:
    """Registrable domain: two labels, three under a compound suffix; addresses of numbers stay whole."""
    labels = F.split(F.lower(host_name), r"\.")
    last = lambda n: F.array_join(F.slice(labels, -n, n), ".")
    count = F.size(labels)
    return (
        F.when(host_name.rlike(r"^\d+(\.\d+){3}$") | (count < 3), F.lower(host_name))
        .when(last(2).isin(COMPOUND_SUFFIXES), last(3))
        .otherwise(last(2))
    )


def brand(host_name: Column) -> Column:
    """First label of the registrable domain."""
    return F.split_part(root_domain(F.regexp_replace(host_name, r"^www\.", "")), F.lit("."), F.lit(1))


def subdomain_prefix(host_name: Column) -> Column:
    """Labels before the registrable domain, without www; null if none."""
    full = F.regexp_replace(F.lower(host_name), r"^www\.", "")
    cut = F.length(full) - F.length(root_domain(full)) - 1
    return F.when(cut > 0, F.substring(full, F.lit(1), cut))


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def segment_shape(segment: Column) -> Column:
    """``*`` for a segment with a digit, hyphen or underscore or of 12 or more characters; its extension stays."""
    extension = F.regexp_extract(segment, r"(\.[A-Za-z]{2,5})$", 1)
    stem = F.substring(segment, F.lit(1), F.length(segment) - F.length(extension))
    varies = stem.rlike(r"[0-9_-]") | (F.length(stem) >= 12)
    return F.when(varies, F.concat(F.lit("*"), extension)).otherwise(segment)


def path_shape(url: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(F.transform(segments(url), segment_shape), "/"))


def address_pattern(url: Column) -> Column:
    """Path with digit runs as ``n`` and the sorted names of the query's keys."""
    keys = F.array_sort(F.array_distinct(F.transform(query_pairs(url), lambda p: p["key"])))
    digits = F.regexp_replace(path(url), r"\d+", "n")
    return F.when(F.size(keys) > 0, F.concat(digits, F.lit("?"), F.array_join(keys, "&"))).otherwise(digits)


def query_pairs(url: Column) -> Column:
    """Query parameters in order as struct<key, value>; empty array without a query."""
    query = F.coalesce(part(url, "QUERY"), F.lit(""))
    pieces = F.filter(F.split(query, "&"), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("key"), F.regexp_replace(p, r"^[^=]*=?", "").alias("value")))


# Parameter names that name a product, in any case, and the camel-case form; server scripts.
ID_PARAMETER = r"(?i:^(?:id|pid|sku|item|product|code|route)$|[_-]id$|^id[_-]|^(?:products?|items?|articles?|goods|prod)id$)|[a-z](?:Id|ID)$"
SCRIPT = r"(?i)\.(?:php|aspx?|jsp|cfm|cgi|pl)$"


def url_shape(url: Column) -> Column:
    """Host without www and path shape; null unless http(s)."""
    return F.when(part(url, "PROTOCOL").rlike("(?i)^https?$"), F.concat(bare_host(url), path_shape(url)))


def fits_shape(shape: Column, own: Column) -> Column:
    """A URL's own shape fits a group's: as many segments, each equal or ``*`` in the group's (never the host)."""
    a, b = F.split(shape, "/"), F.split(own, "/")
    pairs = F.zip_with(a, b, lambda x, y: F.coalesce((x == y) | (x == "*"), F.lit(False)))
    return (F.size(a) == F.size(b)) & (a[0] == b[0]) & F.forall(pairs, lambda ok: ok)


def product_key(url: Column) -> Column:
    """Host without www plus path without its closing slash. Where the last segment is literal, names a server script
    or is missing, the id-like parameters follow, sorted; any other path drops the query."""
    ids = F.filter(query_pairs(url), lambda p: p["key"].rlike(ID_PARAMETER))
    suffix = F.array_join(F.array_sort(F.transform(ids, lambda p: F.concat(p["key"], F.lit("="), p["value"]))), "&")
    trimmed = F.regexp_replace(path(url), r"/+$", "")
    last = F.element_at(F.split(trimmed, "/"), -1)
    slug = (trimmed != "") & F.contains(segment_shape(last), F.lit("*")) & ~last.rlike(SCRIPT)
    base = F.concat(bare_host(url), trimmed)
    keyed = F.when(~slug & (suffix != ""), F.concat(base, F.lit("?"), suffix)).otherwise(base)
    return F.when(part(url, "PROTOCOL").rlike("(?i)^https?$"), keyed)


def last_identifier(url: Column, least: int = 6) -> Column:
    """The last path segment, null if shorter than ``least``. Addresses without a host are read as paths."""
    own = F.coalesce(part(url, "PATH"), F.regexp_replace(url, r"[?#].*$", ""))
    last = F.try_element_at(F.filter(F.split(own, "/"), lambda s: s != ""), F.lit(-1))
    return F.when(F.length(last) >= least, last)


def response_key(url: Column) -> Column:
    """Scheme, host and path: one recorded endpoint whatever its query."""
    return F.concat(F.lower(part(url, "PROTOCOL")), F.lit("://"), host(url), path(url))


def id_pattern(url: Column) -> Column:
    """Scheme, host and path with long hexadecimal or dashed runs as ``{id}``."""
    pattern = F.regexp_replace(path(url), r"(?i)/[0-9a-f-]{8,}", "/{id}")
    return F.coalesce(F.concat(F.lower(part(url, "PROTOCOL")), F.lit("://"), host(url), pattern), url)


def url_words(url: Column) -> Column:
    """Distinct lower-case words of the path, camel case split."""
    split = F.regexp_replace(path(url), r"([a-z0-9])([A-Z])", "$1 $2")
    return F.array_distinct(F.filter(F.split(F.lower(split), r"[^a-z0-9]+"), lambda w: w != ""))


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def variant_pairs(url: Column) -> Column:
    """Query and fragment key-value pairs that may name a variant: all but the noise keys, as a map (last one wins)."""
    fragment = F.coalesce(part(url, "REF"), F.lit(""))
    loose = F.when(is_key_value_fragment(fragment), F.split(fragment, "&")).otherwise(F.array().cast("array<string>"))
    from_fragment = F.transform(loose, lambda p: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("key"), F.regexp_replace(p, r"^[^=]*=?", "").alias("value")))
    pairs = F.filter(F.concat(query_pairs(url), from_fragment), lambda p: (F.trim(p["key"]) != "") & (F.trim(p["value"]) != "") & ~p["key"].rlike(NOISE_KEYS))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    last = lambda k: F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"]
    return F.map_from_arrays(keys, F.transform(keys, last))


def is_key_value_fragment(fragment: Column) -> Column:
    """A fragment names a variant only when each of its parts is a key=value pair."""
    return F.regexp_replace(fragment, "^#", "").rlike(r"^[A-Za-z_][\w.-]*=[^&]*(&[A-Za-z_][\w.-]*=[^&]*)*$")


def percent_encode(text: Column) -> Column:
    """Percent-encoding of a URL component: blanks as %20; - _ . ! ~ * ' ( ) stay."""
    encoded = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, mark in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(code), F.lit(mark))
    return encoded


# Hosts of consent, analytics, testing, replay and payment services, matched with their subdomains.
NOISE_HOSTS = [
    "cookielaw.org", "onetrust.com", "cookiebot.com", "trustarc.com", "didomi.io", "usercentrics.eu",
    "googletagmanager.com", "google-analytics.com", "segment.io", "segment.com", "mixpanel.com", "amplitude.com", "heap.io", "scorecardresearch.com",
    "optimizely.com", "launchdarkly.com", "split.io",
    "hotjar.com", "fullstory.com", "mouseflow.com", "logrocket.com",
    "affirm.com", "klarna.com", "afterpay.com", "clearpay.co.uk", "sezzle.com", "zip.co", "paypal.com",
]
# Paths of the same services on a page's own host.
NOISE_PATHS = r"/optimizely/|(?i:/otFlat\.json$)|(?i:/otPcPanel\.json$)"


def is_third_party_noise(url: Column) -> Column:
    """Requests of trackers: a known host or its subdomain, or a tracker's path. What cannot be read is no noise."""
    # a list of one binds the host, so that the address is read once and not once a tracker
    by_host = F.exists(F.array(host(url)), lambda name: reduce(lambda a, b: a | b, [(name == h) | name.endswith("." + h) for h in NOISE_HOSTS]))
    return F.coalesce(by_host | path(url).rlike(NOISE_PATHS), F.lit(False))
