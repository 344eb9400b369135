"""SQL expressions over Set-Cookie headers."""

from __future__ import annotations

from ..rules import pages as R
from .text import each, let, quote, struct


def _attribute(parts: str, name: str) -> str:
    """Last value of an attribute; "" when it stands without a value, null when it is absent."""
    last = f"try_element_at(filter({parts}, p -> lower(trim(substring_index(p, '=', 1))) = '{name}'), -1)"
    return let(last, lambda a: f"CASE WHEN contains({a}, '=') THEN trim(regexp_extract({a}, '(?s)^[^=]*=(.*)$', 1)) "
                               f"WHEN {a} IS NOT NULL THEN '' END")


def category(name: str, domain: str) -> str:
    """Category by name prefix, then by cookie domain."""
    domains, cases = dict(R.COOKIE_DOMAINS), []
    for label, prefixes in R.COOKIE_PREFIXES:
        cases.append((" OR ".join(f"startswith(lower({name}), {quote(p)})" for p in prefixes), label))
        if label in domains:
            cases.append((" OR ".join(f"contains(lower(coalesce({domain}, '')), {quote(d)})" for d in domains[label]),
                          label))
    return "CASE " + " ".join(f"WHEN {c} THEN '{label}'" for c, label in cases) + " ELSE 'unknown' END"


def duration(max_age: str) -> str:
    cases = " ".join(f"WHEN {max_age} <= {upto} THEN {quote(label)}" for upto, label in R.DURATIONS)
    return (f"CASE WHEN {max_age} IS NULL THEN 'session' {cases} "
            f"ELSE concat({max_age} div {R.YEAR_SECONDS}, '+ years') END")


def parse(header: str) -> str:
    """One header as a struct."""
    def fields(p: str) -> str:
        first, rest = f"element_at({p}, 1)", f"slice({p}, 2, size({p}))"
        return struct(name=f"trim(substring_index({first}, '=', 1))",
                      value=f"regexp_extract({first}, '(?s)^[^=]*=(.*)$', 1)",
                      httponly=f"{_attribute(rest, 'httponly')} IS NOT NULL",
                      secure=f"{_attribute(rest, 'secure')} IS NOT NULL", same=_attribute(rest, "samesite"),
                      path=_attribute(rest, "path"), domain=_attribute(rest, "domain"),
                      age=_attribute(rest, "max-age"))

    def finish(f: str) -> str:
        age = f"if({f}.age rlike '^-*[0-9]+$', try_cast({f}.age as bigint), NULL)"
        return struct(
            name=f"{f}.name", value_preview=f"if({f}.value <> '', concat(substring({f}.value, 1, {R.VALUE_PREVIEW}), "
                                            f"'…'), '')",
            httponly=f"{f}.httponly", secure=f"{f}.secure", samesite=f"if({f}.same = '', 'Lax', {f}.same)",
            path=f"coalesce({f}.path, '/')", domain=f"nullif({f}.domain, '')", max_age=age,
            category=category(f"{f}.name", f"nullif({f}.domain, '')"), duration_label=duration(age))

    return let(f"transform(split({header}, ';'), p -> trim(p))", lambda p: let(fields(p), finish))


def parse_all(headers: str) -> str:
    return each(headers, parse)


def flag_share(cookies: str, test: str) -> str:
    """Share of cookies c with a flag, in percent with one decimal; 0 without cookies."""
    return (f"coalesce(round(try_divide(size(filter({cookies}, c -> {test})) * 100D, "
            f"cast(size({cookies}) as double)), 1), 0D)")
