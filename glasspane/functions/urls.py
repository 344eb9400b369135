"""SQL expressions for addresses and hosts."""

from __future__ import annotations

from .text import let, quote

_HOST = quote(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")


def normalise_url(url: str) -> str:
    """With a scheme, without slashes at the end."""
    return (f"regexp_replace(if({url} rlike '^https?://', {url}, concat('https://', regexp_replace({url}, '^/+', ''))), "
            f"'/+$', '')")


def host(url: str) -> str:
    """Lower-cased host without "www.", null for a relative address."""
    return f"nullif(regexp_replace(lower(regexp_extract({url}, {_HOST}, 1)), '^www[.]', ''), '')"


def is_valid(url: str) -> str:
    return f"(regexp_extract({normalise_url(url)}, {_HOST}, 1) <> '')"


def site(url: str) -> str:
    """Domain that identifies a site."""
    return host(normalise_url(url))


def base(url: str) -> str:
    """Scheme and authority."""
    return f"regexp_extract({normalise_url(url)}, '^(https?://[^/?#]*)', 1)"


def third_party(resource_host: str, domain: str) -> str:
    """A known host that is neither the page's own nor one below it."""
    return (f"coalesce({resource_host} <> {domain} AND NOT endswith({resource_host}, concat('.', {domain})), false)")


def suffixes(host_name: str) -> str:
    """A host and its parents, longest first."""
    return let(f"split({host_name}, '[.]')", lambda p: f"transform(sequence(size({p}), 1, -1), "
               f"k -> array_join(slice({p}, size({p}) - k + 1, k), '.'))")


def without_dots(url: str) -> str:
    """An address whose path has no "." and ".." segments any more: ".." takes the segment before it away."""
    step = "CASE WHEN s = '..' THEN slice(a, 1, greatest(size(a) - 1, 0)) WHEN s = '.' THEN a ELSE concat(a, array(s)) END"

    def resolved(u: str) -> str:
        path = f"regexp_extract({u}, '^https?://[^/?#]*([^?#]*)', 1)"
        kept = let(f"split({path}, '/')", lambda p: f"aggregate(slice({p}, 2, size({p})), cast(array() AS array<string>), (a, s) -> {step})")
        return let(kept, lambda k: (
            f"concat(regexp_extract({u}, '^(https?://[^/?#]*)', 1), '/', array_join({k}, '/'), "
            f"if({path} rlike '(?:^|/)[.][.]?$' AND size({k}) > 0, '/', ''), substring({u}, length(regexp_extract({u}, '^(https?://[^?#]*)', 1)) + 1))"))
    return let(url, lambda u: f"if({u} rlike '^https?://[^?#]*/[.][.]?(?:[/?#]|$)', {resolved(u)}, {u})")


def absolute(href: str, base_url: str, page_url: str) -> str:
    """A link resolved against its page."""
    plain = f"regexp_replace({page_url}, '[?#].*$', '')"
    folder = f"nullif(regexp_extract({plain}, '^(https?://[^/]+(?:/.*)?/)[^/]*$', 1), '')"
    return without_dots(
        f"CASE WHEN {href} rlike '^[a-zA-Z][a-zA-Z0-9+.-]*:' THEN {href} "
        f"WHEN startswith({href}, '//') THEN concat(regexp_extract({page_url}, '^([a-z]+:)', 1), {href}) "
        f"WHEN startswith({href}, '/') THEN concat({base_url}, {href}) "
        f"WHEN startswith({href}, '?') THEN concat({plain}, {href}) "
        f"ELSE concat(coalesce({folder}, concat({base_url}, '/')), {href}) END")
