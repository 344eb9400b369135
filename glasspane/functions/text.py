"""SQL expressions that find rules in a text column and cut out the evidence.

The rules are native Spark SQL expressions, and a document never leaves its row. The
builders take and give SQL text, because a family of rules holds thousands of nodes and one parse is far cheaper than a
call into the JVM per node. A regular expression is only tried where the literals that every match must contain are
present: all literals of a text are found in one scan of the Arrow batch (scan.py), a regular expression decodes the whole text first.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from functools import lru_cache
from re import _constants as rc
from re import _parser as rp
from weakref import WeakKeyDictionary

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scan

# White space beyond ASCII. It becomes a tab in the searched copy, so "\s" means the same as in the rules.
WIDE_SPACES = ("\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
               "\u2028\u2029\u202f\u205f\u3000")
_UNIX = "(?d)"  # "." stops at "\n" only
_META = re.compile(r"[\\.^$*+?{}\[\]|()]")
_names = itertools.count()


def searchable(text: Column) -> Column:
    """Lower-cased copy of a text with the same character positions (the one letter whose small form is longer, U+0130, becomes "i")."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(
        F.lower(F.translate(text, WIDE_SPACES + "\u0130", "\t" * len(WIDE_SPACES) + "i")))


def quote(value) -> str:
    """A Python value as an SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def array(items) -> str:
    items = list(items)
    return f"array({', '.join(items)})" if items else "cast(array() as array<string>)"


def literals(items) -> str:
    return array(quote(x) for x in items)


def struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def let(value: str, body) -> str:
    """Value of body(x) where x stands for a value computed once per row.

    The optimizer copies a projected expression into every place that uses it when it merges projections or pushes a
    filter down. A lambda variable cannot be copied, so the scan of a text behind it runs exactly once, and the large
    rule expressions are not compiled to Java for every query.
    """
    x = f"x{next(_names)}"
    return f"element_at(transform(array({value}), {x} -> {body(x)}), 1)"


def each(items: str, body) -> str:
    x = f"x{next(_names)}"
    return f"transform({items}, {x} -> {body(x)})"


def keep(items: str, test) -> str:
    x = f"x{next(_names)}"
    return f"filter({items}, {x} -> {test(x)})"


def some(items: str, test) -> str:
    x = f"x{next(_names)}"
    return f"exists({items}, {x} -> {test(x)})"


cloudpickle.register_pickle_by_value(scan)  # executors need not have this package
_FEW = 8  # literals that are cheaper to look for one by one
_registered: WeakKeyDictionary = WeakKeyDictionary()


def _scan(found: tuple, text: str, low: str) -> str:
    """Call of the scan for some tests, registered in the session once."""
    name = "glasspane_scan_" + hashlib.sha1(repr(found).encode()).hexdigest()[:16]
    session = SparkSession.active()
    names = _registered.setdefault(session, set())
    if name not in names:
        session.udf.register(name, F.arrow_udf(scan.scanner(*found), scan.TYPE))
        names.add(name)
    return f"{name}({text}, {low})"


_GROUP = re.compile("\\((\ue000\\d+\ue001(?: (?:AND|OR) \ue000\\d+\ue001)*)\\)")
_TOKEN = re.compile("\ue000(\\d+)\ue001")


def _share_guards(r: str, expressions: list[str]) -> tuple[list[str], tuple]:
    """Replaces every test of the whole text for literals by a look at one bit of the scan, which also counts words.

    Tests joined by AND or OR become one test, so a rule that cannot fire costs one look. Gives the expressions and what the scan has to know.
    """
    found: dict[str, dict[str, int]] = {"low": {}, "text": {}}
    tests: list = []  # (column, literal), or ("and" or "or", numbers of tests)
    numbers: dict = {}

    def token(test) -> str:
        if test not in numbers:
            numbers[test] = len(tests)
            tests.append(test)
        return f"\ue000{numbers[test]}\ue001"

    def literal(m: re.Match) -> str:
        plain = re.sub(r"\\(.)", r"\1", m[2])
        return token((m[1], plain)) if len(plain.encode()) >= scan.LEAST else m[0]

    def group(m: re.Match) -> str:
        inside, parts = m[1], tuple(dict.fromkeys(int(n) for n in _TOKEN.findall(m[1])))
        if len(parts) == 1:
            return f"\ue000{parts[0]}\ue001"
        if " AND " in inside and " OR " in inside:
            return m[0].replace("(", "\ue002", 1)
        return token(("and" if " AND " in inside else "or", parts))

    single = re.compile(r"contains\(" + re.escape(r) + r"\.(low|text), '((?:[^'\\]|\\.)*)'\)")
    counts = {words(f"{r}.text"): "words", plain_words(f"{r}.text"): "plain", sentences(f"{r}.text"): "sentences"}
    if sum(len(set(single.findall(e))) for e in expressions) < _FEW and not any(c in e for c in counts for e in expressions):
        return expressions, ()
    expressions = [single.sub(literal, e) for e in expressions]
    for i, e in enumerate(expressions):
        while (folded := _GROUP.sub(group, e)) != e:
            e = folded
        expressions[i] = e.replace("\ue002", "(")
    used = {n: k for k, n in enumerate(dict.fromkeys(int(n) for e in expressions for n in _TOKEN.findall(e)))}

    def collect(n: int):
        kind, parts = tests[n]
        if kind in found:
            found[kind].setdefault(parts, len(found[kind]))
        else:
            for p in parts:
                collect(p)

    def built(n: int):
        kind, parts = tests[n]
        if kind in found:
            return found[kind][parts] + (len(found["low"]) if kind == "text" else 0)
        return kind, [built(p) for p in parts]

    for n in used:
        collect(n)
    wanted = (list(found["low"]), list(found["text"]), [built(n) for n in used])
    expressions = [_TOKEN.sub(lambda m: f"(getbit(get({r}.found.bits, {used[int(m[1])] // 63}), {used[int(m[1])] % 63}) = 1)", e) for e in expressions]
    for c, field in counts.items():
        expressions = [e.replace(c, f"{r}.found.{field}") for e in expressions]
    return expressions, wanted


def _whole(low: str) -> bool:
    """Whether a test looks at a whole text bound by over_text, for which any number of literals costs one scan."""
    return re.fullmatch(r"x[0-9]+\.low", low) is not None


def gate(low: str, patterns, terms=()) -> str | None:
    """Test that is false only where no term and no match of a pattern can occur in a whole text; None where that is not known."""
    guards = [f"contains({low}, {quote(p)})" if is_literal(p) else guard(low, p) for p in patterns]
    guards += [f"contains({low}, {quote(t)})" for t in terms]
    return either(guards) if _whole(low) and len(guards) > 1 and all(guards) else None


def _bound(r: str, value: str, fields: dict) -> Column:
    return F.expr(f"element_at(transform(array({struct(**fields)}), {r} -> {value}), 1)")


def over_text(body, text: str = "text", low: str = "low") -> Column:
    """Column with the value of body(text, low), both bound once per row."""
    r = f"x{next(_names)}"
    (value,), found = _share_guards(r, [body(f"{r}.text", f"{r}.low")])
    return _bound(r, value, {"text": text, "low": low} | ({"found": _scan(found, text, low)} if found else {}))


def over_texts(docs: DataFrame, bodies: dict) -> DataFrame:
    """Adds a column per body, all on one scan of the columns `text` and `low`."""
    r = f"x{next(_names)}"
    values, found = _share_guards(r, [b(f"{r}.text", f"{r}.low") for b in bodies.values()])
    fields = {"text": "text", "low": "low"}
    if found:
        docs = docs.withColumn("_found", F.expr(_scan(found, "text", "low")))
        fields["found"] = "_found"
    return docs.withColumns({name: _bound(r, v, fields) for name, v in zip(bodies, values)}).drop("_found")


def dealt(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Texts dealt out over all cores by their key, for an analysis that costs far more than the shuffle.

    One row group of a file is read by one task, however large it is, and everything behind the scan would run there. The searchable
    copy `low` is not sent but made again.
    """
    return docs.drop("low").repartition(key).withColumn("low", searchable(F.col("text"))).select(docs.columns)


def distinct_by(items: str, field: str) -> str:
    """The first item of each value of a field, in order: equal values meet by sorting, so a long array costs little more than a short one."""
    def firsts(xs: str) -> str:
        tagged = f"array_sort(transform({xs}, (x, i) -> named_struct('k', x.{field}, 'i', i)))"
        return let(tagged, lambda s: (f"transform(array_sort(transform(filter({s}, (e, j) -> j = 0 OR NOT (get({s}, j - 1).k <=> e.k)), e -> e.i)), "
                                      f"i -> get({xs}, i))"))
    return let(items, firsts)


def explode_rows(df: DataFrame, items: str, name: str) -> DataFrame:
    """One row per array item.

    The outer form keeps the optimizer from pushing a "not empty" filter, and with it the whole computation of the
    array, below the projection that makes it.
    """
    return df.withColumn(name, F.explode_outer(items)).where(F.col(name).isNotNull())


def _needles(tree) -> tuple[str, ...]:
    """Literals of which every match of a parsed pattern contains at least one; empty when there are none."""
    offers, run = [], ""
    for op, arg in tree:
        if op is rc.LITERAL:
            run += chr(arg)
            continue
        offers.append((run,))
        run = ""
        if op is rc.SUBPATTERN:
            offers.append(_needles(arg[3]))
        elif op is rc.BRANCH:
            parts = [_needles(p) for p in arg[1]]
            offers.append(tuple(dict.fromkeys(x for p in parts for x in p)) if all(parts) else ())
        elif op is rc.MAX_REPEAT and arg[0] > 0:
            offers.append(_needles(arg[2]))
    offers.append((run,))
    return max(offers, key=lambda o: min(map(len, o)) - 2 * (len(o) - 1) if o and all(o) else -9)


@lru_cache(maxsize=None)
def needles(pattern: str) -> tuple[str, ...]:
    """Literal guard of a pattern, or nothing when a guard would not pay."""
    found = _needles(rp.parse(pattern))
    return found if found and len(found) <= 3 and min(map(len, found)) >= 3 else ()


def is_literal(pattern: str) -> bool:
    return not _META.search(pattern)


def _starts(tree) -> tuple[set[str], bool] | None:
    """Characters with which a match can begin, and whether it can be empty; None when they are not few and plain."""
    out: set[str] = set()
    for op, arg in tree:
        if op is rc.AT:
            continue
        if op is rc.LITERAL:
            return out | {chr(arg)}, False
        if op is rc.SUBPATTERN:
            part = _starts(arg[3])
        elif op is rc.BRANCH:
            parts = [_starts(p) for p in arg[1]]
            part = None if None in parts else (set().union(*(p[0] for p in parts)), any(p[1] for p in parts))
        elif op is rc.MAX_REPEAT:
            part = _starts(arg[2])
            part = part and (part[0], part[1] or arg[0] == 0)
        elif op is rc.IN and all(k is rc.LITERAL for k, _ in arg):
            part = {chr(v) for _, v in arg}, False
        else:
            return None
        if part is None:
            return None
        out |= part[0]
        if not part[1]:
            return out, False
    return out, True


@lru_cache(maxsize=None)
def _ahead(pattern: str) -> str:
    """One test of the first character in front of a pattern that begins with alternatives."""
    tree = rp.parse(pattern)
    if not tree or tree[0][0] is rc.LITERAL:
        return pattern
    found = _starts(tree)
    if not found or found[1] or not all(c.isalnum() for c in found[0]):
        return pattern
    return f"(?=[{''.join(sorted(found[0]))}])(?:{pattern})"


def rule(pattern: str) -> str:
    """A pattern as an SQL literal."""
    return quote(_UNIX + _ahead(pattern))


def either(conditions) -> str:
    conditions = list(conditions)
    return "(" + " OR ".join(conditions) + ")" if conditions else "false"


def _formula(tree):
    """What every match of a parsed pattern contains: a literal, ("and", parts), ("or", parts), or None where nothing is known."""
    parts, run = [], ""
    for op, arg in [*tree, (None, None)]:
        if op is rc.LITERAL:
            run += chr(arg)
            continue
        if len(run.encode()) >= scan.LEAST:
            parts.append(run)
        run = ""
        part = None
        if op is rc.SUBPATTERN:
            part = _formula(arg[3])
        elif op is rc.BRANCH:
            options = [_formula(p) for p in arg[1]]
            part = ("or", options) if all(options) else None
        elif op is rc.MAX_REPEAT and arg[0] > 0:
            part = _formula(arg[2])
        if part:
            parts.append(part)
    return parts[0] if len(parts) == 1 else ("and", parts) if parts else None


@lru_cache(maxsize=None)
def formula(pattern: str):
    tree = rp.parse(pattern)
    return None if tree.state.flags & re.IGNORECASE else _formula(tree)


def guard(low: str, pattern: str) -> str | None:
    """Test of the literals that every match of a pattern contains."""
    def test(f) -> str:
        if isinstance(f, str):
            return f"contains({low}, {quote(f)})"
        kind, parts = f
        tests = dict.fromkeys(test(p) for p in (sorted(parts, key=lambda p: -len(p) if isinstance(p, str) else 0) if kind == "and" else parts))
        return "(" + (" AND " if kind == "and" else " OR ").join(tests) + ")"
    found = formula(pattern)
    return test(found) if found else None


def matches(low: str, pattern: str) -> str:
    """True where the pattern occurs."""
    if is_literal(pattern):
        return f"contains({low}, {quote(pattern)})"
    hit, first = f"({low} rlike {rule(pattern)})", guard(low, pattern)
    return f"({first} AND {hit})" if first else hit


def any_match(low: str, patterns) -> str:
    patterns = list(patterns)
    hit, first = either(matches(low, p) for p in patterns), gate(low, patterns)
    return f"({first} AND {hit})" if first else hit


def guarded(low: str, pattern: str, value: str, empty: str) -> str:
    """A value that is only computed where the guard of the pattern allows a match."""
    first = guard(low, pattern)
    return f"if({first}, {value}, {empty})" if first else value


def count_matches(low: str, pattern: str) -> str:
    """Number of non-overlapping matches."""
    if is_literal(pattern):
        return (f"if(contains({low}, {quote(pattern)}), cast((length({low}) - length(replace({low}, "
                f"{quote(pattern)}, ''))) / {len(pattern)} as int), 0)")
    return guarded(low, pattern, f"regexp_count({low}, {rule(pattern)})", "0")


def count_all(low: str, patterns) -> str:
    return "(" + " + ".join(count_matches(low, p) for p in patterns) + ")"


def all_matches(low: str, pattern: str, group: int = 0) -> str:
    """Texts of all matches, in order."""
    return guarded(low, pattern, f"regexp_extract_all({low}, {rule(pattern)}, {group})",
                   "cast(array() as array<string>)")


def span(start: str, stop: str) -> str:
    """Half-open character range, counted from 0."""
    return struct(start=f"cast({start} as int)", stop=f"cast({stop} as int)")


def first_span(low: str, pattern: str) -> str:
    """Range of the first match. Only meaningful where the pattern occurs.

    The two pieces around the first match give its range in characters after a single search.
    """
    if is_literal(pattern):
        return let(f"instr({low}, {quote(pattern)}) - 1", lambda at: span(at, f"{at} + {len(pattern)}"))
    return let(f"split({low}, {rule(pattern)}, 2)", lambda pieces: span(
        f"length(get({pieces}, 0))", f"length({low}) - length(get({pieces}, 1))"))


def first_of(low: str, patterns) -> str:
    """Range of the first match of the first pattern that occurs at all, else null."""
    cases = " ".join(f"WHEN {matches(low, p)} THEN {first_span(low, p)}" for p in patterns)
    first = gate(low, patterns)
    return f"CASE WHEN NOT {first} THEN NULL {cases} END" if first else f"CASE {cases} END"


_RUN = 256


def all_spans(low: str, pattern: str, limit: int | None = None) -> str:
    """Ranges of all matches (or of the first few), from the pieces between them and the matched texts."""
    none = "cast(array() as array<struct<start:int,stop:int>>)"
    found = f"regexp_extract_all({low}, {rule(pattern)}, 0)"
    if limit is not None:
        found = f"slice({found}, 1, {limit})"
    pieces = f"split({low}, {rule(pattern)}, {-1 if limit is None else limit + 1})"
    acc, step = f"x{next(_names)}", f"x{next(_names)}"

    def build(m: str) -> str:
        steps = f"zip_with(slice({pieces}, 1, size({m})), {m}, (p, f) -> " \
                f"named_struct('gap', length(p), 'len', length(f)))"
        spans = let(steps, lambda all_: let(
            f"transform(sequence(0, greatest(size({all_}) - 1, 0) div {_RUN}), c -> slice({all_}, c * {_RUN} + 1, {_RUN}))", in_runs))
        return f"if(size({m}) = 0, {none}, {spans})"

    def in_runs(runs: str) -> str:
        """Running sums within runs of matches, and over the sums of the runs, so that no array is copied once per match."""
        item = span(f"{acc}.at + {step}.gap", f"{acc}.at + {step}.gap + {step}.len")
        inner = (f"aggregate(r, named_struct('at', o, 'out', {none}), ({acc}, {step}) -> named_struct('at', {acc}.at + {step}.gap + {step}.len, "
                 f"'out', concat({acc}.out, array({item}))), {acc} -> {acc}.out)")
        total = "aggregate(r, 0, (t, s) -> t + s.gap + s.len)"
        offsets = (f"aggregate(transform({runs}, r -> {total}), named_struct('at', 0, 'out', cast(array() AS array<int>)), "
                   f"(t, s) -> named_struct('at', t.at + s, 'out', concat(t.out, array(t.at))), t -> t.out)")
        return f"flatten(zip_with({runs}, {offsets}, (r, o) -> {inner}))"

    return guarded(low, pattern, let(found, build), none)


def squeeze(text: str) -> str:
    """White space runs to one blank, none at the ends."""
    plain = f"translate({text}, {quote(WIDE_SPACES)}, '{' ' * len(WIDE_SPACES)}')"
    return f"trim(regexp_replace({plain}, '\\\\s+', ' '))"


def cut(text: str, start: str, stop: str) -> str:
    """Characters start (from 0) up to stop, with start clipped at 0."""
    return let(f"greatest({start}, 0)", lambda a: f"substring({text}, {a} + 1, greatest({stop} - {a}, 0))")


def snippet(text: str, where: str, before: int, after: int) -> str:
    """Evidence: the range with some context on both sides, in an ellipsis."""
    return f"concat('…', {squeeze(cut(text, f'{where}.start - {before}', f'{where}.stop + {after}'))}, '…')"


def word_pattern(term: str) -> str:
    """Pattern of a term as a whole word, in singular or plural. The term leads, so the search can skip ahead."""
    return (f"concat('\\\\Q', {term}, '\\\\E(?<![\\\\p{{L}}\\\\p{{N}}_]\\\\Q', {term}, "
            f"'\\\\E)(?:e?s)?(?![\\\\p{{L}}\\\\p{{N}}_])')")


def _gated(low: str, terms, value: str) -> str:
    first = gate(low, (), terms)
    return f"if({first}, {value}, {no_strings()})" if first else value


def words_in(low: str, terms) -> str:
    """The terms that occur as whole words, in list order. Each has a pattern of its own, which is compiled once."""
    def whole(t: str) -> str:
        return rf"\Q{t}\E(?<![\p{{L}}\p{{N}}_]\Q{t}\E)(?:e?s)?(?![\p{{L}}\p{{N}}_])"
    return _gated(low, terms, strings(f"if(contains({low}, {quote(t)}) AND {low} rlike {quote(whole(t))}, {quote(t)}, NULL)" for t in terms))


def literals_in(low: str, terms) -> str:
    """The terms that occur anywhere, in list order."""
    return _gated(low, terms, strings(f"if(contains({low}, {quote(t)}), {quote(t)}, NULL)" for t in terms))


def word_start(low: str, term: str) -> str:
    """Position (from 0) of a whole-word term. Only meaningful where it occurs."""
    return f"length(get(split({low}, {word_pattern(term)}, 2), 0))"


def counted_literals(low: str, terms) -> str:
    """The terms that occur anywhere with their numbers of occurrences: array<struct<term, n>>."""
    return each(literals_in(low, terms), lambda t: struct(
        term=t, n=f"cast((length({low}) - length(replace({low}, {t}, ''))) / length({t}) as int)"))


def _spaced(text: str) -> str:
    return f"translate({text}, {quote(WIDE_SPACES)}, {quote(' ' * len(WIDE_SPACES))})"


def words(text: str) -> str:
    """Number of words; wide spaces part words too."""
    return f"regexp_count({_spaced(text)}, {quote(chr(92) + 'S+')})"


def plain_words(text: str) -> str:
    """Number of runs without space or the stop of a sentence."""
    return f"regexp_count({_spaced(text)}, '[^\\\\s.!?]+')"


def sentences(text: str) -> str:
    """Number of pieces between stops that hold more than space."""
    return f"regexp_count({_spaced(text)}, '[^.!?\\\\s][^.!?]*')"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.translate(text, WIDE_SPACES, " " * len(WIDE_SPACES)), F.lit(r"\S+"))


def scale(value: str, cuts, rest: str) -> str:
    """Label of the first cut that the value reaches."""
    cases = " ".join(f"WHEN {value} >= {least} THEN {quote(label)}" for least, label in cuts)
    return f"CASE {cases} ELSE {quote(rest)} END"


def lookup(table: dict, key: str, rest=None) -> str:
    """Value of a small fixed table."""
    cases = " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in table.items())
    return f"CASE {key} {cases} ELSE {quote(rest)} END"


def strings(items) -> str:
    """Array of the non-null strings."""
    items = list(items)
    return f"array_compact({array(items)})" if items else "cast(array() as array<string>)"


def no_strings() -> str:
    return "cast(array() as array<string>)"
