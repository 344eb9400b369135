"""SQL expressions over page markup. Tags are found left to right, so a comment hides the tags inside it."""

from __future__ import annotations

from html.entities import html5

from .text import let, quote

COMMENT = r"<!--[\s\S]*?-->"
SCRIPT = r"<script\b[^>]*>[\s\S]*?</script\s*>"

# Character references that stand for plain characters here; all other names are those of HTML 5.
PLAIN = {"nbsp": " "}
SPACE_CODE = 160
NAMED = {**{name[:-1]: chars for name, chars in html5.items() if name.endswith(";")}, **PLAIN}
REPLACEMENT = "�"
NAME_RULE, DECIMAL_RULE, HEX_RULE = "^([A-Za-z][A-Za-z0-9]{1,31});", "^#0*([0-9]{1,7});", "^#[xX]0*([0-9a-fA-F]{1,6});"


def elements(html: str, *tags: str) -> str:
    """Scripts as a whole plus the opening tags named, in page order."""
    rule = rf"(?i){COMMENT}|{SCRIPT}" + (rf"|<(?:{'|'.join(tags)})\b[^>]*>" if tags else "")
    return f"filter(regexp_extract_all({html}, {quote(rule)}, 0), e -> NOT startswith(e, '<!--'))"


# Tags as the check queries state them.
TAG = r"""</?[a-zA-Z](?:[^>"']|"[^"]*"|'[^']*')*>"""


def tags(html: str) -> str:
    """Opening and closing tags in page order; a ">" inside a quoted value does not end a tag."""
    return f"regexp_extract_all({html}, {quote(_POSSESSIVE)}, 0)"


def pieces(html: str) -> str:
    """Text before, between and behind the tags."""
    return f"split({html}, {quote(_POSSESSIVE)}, -1)"


# The same tags without going back over a long one.
_POSSESSIVE = r"""</?[a-zA-Z][^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+>"""


def any_tag_name(element: str) -> str:
    """Name of an opening or closing tag."""
    return f"lower(regexp_extract({element}, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1))"


def closing(names: str, at: str) -> str:
    """Index of the tag that closes the element opened at index `at`: where its name is as often closed as opened, else behind the last tag.

    names: array<struct<name, step>> of all tags, step 1 for an opening and -1 for a closing tag. One fold with a depth, so elements of the
    same kind may be nested as deep as they like.
    """
    rest = f"slice({names}, {at} + 2, size({names}))"
    own = f"element_at({names}, {at} + 1).name"
    moved = ("named_struct('at', s.at + 1, 'depth', s.depth + if(x.name = s.name, x.step, 0), 'name', s.name, "
             "'stop', if(s.stop IS NULL AND s.depth + if(x.name = s.name, x.step, 0) = 0, s.at, s.stop))")
    return (f"aggregate({rest}, named_struct('at', int({at} + 1), 'depth', 1, 'name', {own}, 'stop', cast(NULL AS int)), "
            f"(s, x) -> if(s.stop IS NOT NULL, s, {moved}), s -> coalesce(s.stop, int(size({names}))))")


def named_steps(tags: str) -> str:
    """name and step of all tags, for closing()."""
    return (f"transform({tags}, t -> named_struct('name', {any_tag_name('t')}, 'step', "
            f"CASE WHEN startswith(t, '</') THEN -1 WHEN endswith(t, '/>') THEN 0 ELSE 1 END))")


def between(tags: str, pieces: str, at: str, stop: str) -> str:
    """Markup from the tag at index `at` up to the one at index `stop`."""
    cut = [f"slice({x}, {at} + {n}, {stop} - {at})" for x, n in ((tags, 1), (pieces, 2))]
    return f"array_join(flatten(zip_with({cut[0]}, {cut[1]}, (t, p) -> array(t, p))), '')"


def text_lines(nodes: str, least: int) -> str:
    """Lines of text nodes; lines of up to `least` characters are left out."""
    split = f"split({unescape(f'array_join({nodes}, {quote(chr(10))})')}, {quote(chr(10))})"
    trimmed = f"transform({split}, n -> regexp_replace(n, {quote(r'^\s+|\s+$')}, ''))"
    return f"array_join(filter({trimmed}, n -> length(n) > {least}), {quote(chr(10))})"


def tag_name(element: str) -> str:
    return f"lower(regexp_extract({element}, '^<([a-zA-Z][a-zA-Z0-9]*)', 1))"


def opening(element: str) -> str:
    return f"regexp_extract({element}, '^<[^>]*>', 0)"


def attribute(element: str, name: str) -> str:
    """Value of an attribute of the opening tag, null when it is absent."""
    rule = quote(rf"""(?i)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")
    tag = opening(element)
    value = ", ".join(f"regexp_extract({tag}, {rule}, {i})" for i in (1, 2, 3))
    return f"if({tag} rlike {rule}, replace(trim(concat({value})), '&amp;', '&'), NULL)"


def has_attribute(element: str, name: str) -> str:
    rule = quote(rf"(?i)[\s\"'/]{name}(?:[\s=/>]|$)")
    return f"({opening(element)} rlike {rule})"


def script_body(element: str) -> str:
    return f"regexp_extract({element}, {quote(r'(?i)^<script\b[^>]*>([\s\S]*?)</script\s*>$')}, 1)"


def unescape(text: str) -> str:
    """Text with its character references decoded once: every HTML 5 name that ends in ";", and decimal and hexadecimal numbers.

    One pass: the text is cut at every "&", and the start of each piece is looked up. Names that are unknown stay as they are; numbers that
    are no character become the replacement character.
    """
    names = f"str_to_map({quote(chr(1).join(k + chr(2) + v for k, v in NAMED.items()))}, {quote(chr(1))}, {quote(chr(2))})"

    def number(code: str, x: str) -> str:
        bad = f"{code} = 0 OR {code} > 1114111 OR {code} BETWEEN 55296 AND 57343"
        char = f"decode(unhex(lpad(hex({code}), 8, '0')), 'UTF-32')"
        return f"concat(CASE WHEN {bad} THEN '{REPLACEMENT}' WHEN {code} = {SPACE_CODE} THEN ' ' ELSE {char} END, substring({x}, instr({x}, ';') + 1))"

    def piece(x: str) -> str:
        name, decimal, hexa = (f"regexp_extract({x}, {quote(r)}, 1)" for r in (NAME_RULE, DECIMAL_RULE, HEX_RULE))
        named = let(f"try_element_at({names}, {name})", lambda c: f"if({c} IS NULL, concat('&', {x}), concat({c}, substring({x}, instr({x}, ';') + 1)))")
        counted = let(f"CASE WHEN {decimal} <> '' THEN int({decimal}) WHEN {hexa} <> '' THEN int(conv({hexa}, 16, 10)) END",
                      lambda c: f"if({c} IS NULL, concat('&', {x}), {number(c, x)})")
        return f"if(startswith({x}, '#'), {counted}, {named})"

    def decoded(t: str) -> str:
        return let(f"split({t}, '&', -1)", lambda p: f"concat({p}[0], array_join(transform(slice({p}, 2, size({p})), r -> {piece('r')}), ''))")
    return let(text, lambda t: f"if(contains({t}, '&'), {decoded(t)}, {t})")


def without(html: str, tags) -> str:
    """Markup without comments, scripts and other whole elements."""
    out = f"regexp_replace({html}, {quote(rf'(?i){COMMENT}|{SCRIPT}')}, '')"
    for tag in tags:
        if tag != "script":
            out = f"regexp_replace({out}, {quote(rf'(?i)<{tag}\b[^>]*>[\s\S]*?</{tag}\s*>')}, '')"
    return out


def lines(html: str, least: int) -> str:
    """Text lines of markup, one per text node; lines of up to `least` characters are left out."""
    nodes = f"split({unescape(f'regexp_replace({html}, {quote('<[^>]*>')}, {quote(chr(10))})')}, {quote(chr(10))})"
    trimmed = f"transform({nodes}, n -> regexp_replace(n, {quote(r'^\s+|\s+$')}, ''))"
    return f"array_join(filter({trimmed}, n -> length(n) > {least}), {quote(chr(10))})"


def visible_text(html: str, dropped, least: int) -> str:
    return lines(without(html, dropped), least)
