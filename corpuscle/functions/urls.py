"""Column functions on URLs: canonical form, dedupe key, domain, scope. Null marks a rejected value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARTS = r"^(?i:(https?))://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
# Query keys that canonical URLs and dedupe keys drop, and the pattern of a public host name.
_TRACKING = "^(?:utm_.*|gclid|fbclid)$"
_DEDUPE = "^(?:utm_.*|fbclid|gclid|msclkid|spm|ref|ref_src|source|from)$"
HOSTNAME = r"^[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?(\.[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?)+$"


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, _PARTS, i)


def _form(c: Column) -> Column:
    """Decoded and encoded again form-style: plus for space, upper-case escapes, ~ kept, * escaped."""
    return F.replace(F.replace(F.url_encode(F.coalesce(F.try_url_decode(c), c)), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _query(query: Column, dropped: str) -> Column:
    """Pairs whose decoded lower-case key doesn't match ``dropped``, blank values kept."""
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    key = lambda p: F.substring_index(p, "=", 1)
    value = lambda p: F.when(p.contains("="), F.substring(p, F.length(key(p)) + 2, F.length(p))).otherwise(F.lit(""))
    kept = F.filter(pairs, lambda p: ~F.lower(F.coalesce(F.try_url_decode(key(p)), key(p))).rlike(dropped))
    return F.array_join(F.transform(kept, lambda p: F.concat(_form(key(p)), F.lit("="), _form(value(p)))), "&")


def canonical_url(url: Column) -> Column:
    scheme, net = F.lower(_part(url, 1)), _part(url, 2)
    host = F.lower(F.regexp_extract(net, r"^(.*?)(?::(\d*))?$", 1))
    port = F.regexp_extract(net, r"^(.*?)(?::(\d*))?$", 2)
    default = F.when(scheme == "https", "443").otherwise("80")
    shown = F.when((port == "") | (port.cast("int") == default.cast("int")), "").otherwise(F.concat(F.lit(":"), port.cast("int").cast("string")))
    path = F.when(_part(url, 3) == "", "/").otherwise(_part(url, 3))
    query = _query(_part(url, 4), _TRACKING)
    out = F.concat(scheme, F.lit("://"), host, shown, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(url.rlike(_PARTS) & (host != "") & ~net.contains("@"), out)


def dedupe_key(url: Column) -> Column:
    scheme, net = F.lower(_part(url, 1)), F.regexp_replace(_part(url, 2), "^.*@", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(net, r"^(.*?)(?::(\d*))?$", 1)), r"^www\.", "")
    port = F.regexp_extract(net, r"^(.*?)(?::(\d*))?$", 2)
    path = F.regexp_replace(_part(url, 3), "/+$", "")
    query = _query(_part(url, 4), _DEDUPE)
    out = F.concat(
        scheme, F.lit("://"), host, F.when(port == "", "").otherwise(F.concat(F.lit(":"), port.cast("int").cast("string"))), F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))
    )
    return F.when(url.rlike(_PARTS) & (host != ""), out).otherwise(F.lower(url))


def domain(value: Column) -> Column:
    """Public host name of a URL or bare domain, without www.; null if it isn't one."""
    raw = F.trim(F.regexp_replace(F.trim(value), "^[<>\"']+|[<>\"']+$", ""))
    target = F.when(raw.contains("//") | raw.startswith("http"), raw).otherwise(F.concat(F.lit("//"), raw))
    net = F.regexp_extract(target, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(net), r"\.+$", ""), r"^www\.", "")
    good = ~net.contains("@") & ~net.contains(":") & host.rlike(HOSTNAME) & host.rlike(r"\.[a-z]+$") & (F.length(host) <= 253) & ~host.rlike(r"\.(local|internal|localhost)$")
    return F.when(good, host)


def origin(canonical: Column) -> Column:
    return F.regexp_extract(canonical, r"^(https?://[^/?#]*)", 1)


def path(canonical: Column) -> Column:
    return F.regexp_extract(canonical, r"^https?://[^/?#]*([^?#]*)", 1)


def scope_prefix(canonical: Column) -> Column:
    """The entry's path, bounded as a directory: /docs doesn't take in /docs-other."""
    p = path(canonical)
    return F.when(p.endswith("/"), p).otherwise(F.concat(p, F.lit("/")))


def in_scope(link: Column, entry: Column) -> Column:
    """Same scheme and host, and the link's path is the entry's directory or below; both canonical."""
    prefix = scope_prefix(entry)
    below = (path(link) == F.regexp_replace(prefix, "/+$", "")) | path(link).startswith(prefix)
    return (origin(link) == origin(entry)) & below


def resolve(href: Column, base: Column) -> Column:
    """href against a base URL: absolute, scheme-relative, host-relative, query, fragment or relative; null for other schemes."""
    root, here = F.regexp_extract(base, r"^((?i:https?)://[^/?#]*)", 1), F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.when(here == root, F.concat(root, F.lit("/"))).otherwise(F.regexp_replace(here, "[^/]*$", ""))
    return (
        F.when(href.rlike("^(?i:https?)://"), href)
        .when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(href.startswith("//"), F.concat(F.substring_index(base, "//", 1), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?"), F.concat(here, href))
        .when((href == "") | href.startswith("#"), F.concat(F.regexp_extract(base, "^([^#]*)", 1), href))
        .otherwise(F.concat(folder, href))
    )
