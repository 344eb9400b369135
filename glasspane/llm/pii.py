"""Personal data by bootstrapped contextual extraction, in SQL expressions and joins.

Patterns of fixed form (e-mail, IPv4, payment card, phone) give the base spans and the seeds. Every word that looks like an
identifier (six characters or more, three digits at least, or an "@") stands in two lexical patterns: the two words before it, and the
word before it with its own shape. Words, their patterns and the seeds' kinds form a graph that is scored in rounds:

* a pattern's confidence for a kind is the mean belief in that kind over the different words seen in it, with one doubtful
  word added; a pattern counts from `support` different believed words and a confidence of `least` on,
* the belief in a word is the noisy-or of its confident patterns; with two of them and a belief of `least` or more it is a
  new identifier of that kind and takes part in the next round.

Words found so that no base span overlaps are reported as found_email, found_ip, found_card or found_phone. Texts are read once;
afterwards only spans and words move, with partial aggregation. Null texts count as empty, ids may be null or repeated,
every row gives one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from . import common as C

KINDS = ("email", "ip", "card", "phone")
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
# Same matches as the plain forms, without going back over long runs.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": r"[0-9](?:[\\x20-]?[0-9])++",
    "phone": r"\\+[0-9][\\x20().0-9-]+[0-9]",
}
_GAP = r"\\x20\\x09-\\x0D"
_WORD = rf"(?<![^{_GAP}])[^{_GAP}0-9@]*+[0-9@][^{_GAP}]*+"
_PIECE = 256


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    return let(digits, lambda d: (
        f"(aggregate(sequence(1, length({d})), 0, (t, i) -> t + "
        f"CASE WHEN pmod(length({d}) - i, 2) = 0 THEN cast(substring({d}, i, 1) AS int) "
        f"ELSE element_at(array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9), cast(substring({d}, i, 1) AS int) + 1) END) % 10 = 0)"))


def _valid(kind: str, m: str) -> str:
    if kind == "ip":
        return f"{m} rlike '^{_PART}(?:\\\\.{_PART}){{3}}$'"
    if kind == "card":
        return let(_digits(m), lambda d: f"CASE WHEN length({d}) BETWEEN 14 AND 19 THEN {_luhn(d)} ELSE false END")
    if kind == "phone":
        return f"length({_digits(m)}) BETWEEN 10 AND 15"
    return "true"


def _placed(text: str, pattern: str, found: str) -> str:
    """start, m and gap (the text before it, from the last match on) of each match, by running sums in pieces of _PIECE matches."""
    def sums(matched: str) -> str:
        def pieces(parts: str) -> str:
            def starts(rows: str) -> str:
                total = f"aggregate({rows}, 0L, (t, x) -> t + length(x.gap) + length(x.m))"
                inner = (f"aggregate({rows}, named_struct('at', o, 'out', cast(array() AS array<struct<start: bigint, m: string, gap: string>>)), "
                         f"(s, x) -> named_struct('at', s.at + length(x.gap) + length(x.m), "
                         f"'out', concat(s.out, array(named_struct('start', s.at + length(x.gap), 'm', x.m, 'gap', x.gap)))), s -> s.out)")
                return total, inner
            total, inner = starts("p")
            offsets = (f"aggregate(transform({parts}, p -> {total}), named_struct('at', 0L, 'out', cast(array() AS array<bigint>)), "
                       f"(s, x) -> named_struct('at', s.at + x, 'out', concat(s.out, array(s.at))), s -> s.out)")
            return f"flatten(zip_with({parts}, {offsets}, (p, o) -> {inner}))"
        rows = f"zip_with(slice(split({text}, '{pattern}', -1), 1, size({matched})), {matched}, (g, m) -> named_struct('gap', g, 'm', m))"
        return let(rows, lambda r: let(
            f"transform(sequence(0, (size({r}) - 1) div {_PIECE}), c -> slice({r}, c * {_PIECE} + 1, {_PIECE}))", pieces))
    return let(found, lambda f: (
        f"CASE WHEN size({f}) = 0 THEN cast(array() AS array<struct<start: bigint, m: string, gap: string>>) ELSE {sums(f)} END"))


def _base(text: str) -> str:
    """Base spans of a text: start, ord (of the kind), kind, stop."""
    each = []
    for i, kind in enumerate(KINDS):
        found = f"regexp_extract_all({text}, '{PATTERNS[kind]}', 0)"
        if kind in ("email", "phone"):
            found = f"CASE WHEN instr({text}, '{'@' if kind == 'email' else '+'}') > 0 THEN {found} ELSE cast(array() AS array<string>) END"
        placed = _placed(text, PATTERNS[kind], found)
        good = f"filter({placed}, x -> {_valid(kind, 'x.m')})"
        each.append(f"transform({good}, x -> named_struct('start', x.start, 'ord', {i}, 'kind', '{kind}', 'stop', x.start + length(x.m)))")
    return f"array_sort(concat({', '.join(each)}))"


def _words(text: str) -> str:
    """Identifier-like words of a text: start, stop, word, two (the two words before it), one (the last of them)."""
    found = f"regexp_extract_all({text}, '{_WORD}', 0)"
    placed = _placed(text, _WORD, found)
    shaped = f"filter({placed}, x -> instr(x.m, '@') > 0 OR (length(x.m) >= 6 AND length({_digits('x.m')}) >= 3))"
    before = "lower(substring(x.gap, greatest(1, length(x.gap) - 99)))"
    two = f"regexp_extract({before}, '([^{_GAP}]+[{_GAP}]+[^{_GAP}]+)[{_GAP}]+$', 1)"
    one = f"regexp_extract({before}, '([^{_GAP}]+)[{_GAP}]+$', 1)"
    return (f"transform({shaped}, x -> named_struct('start', x.start, 'stop', x.start + length(x.m), 'word', x.m, "
            f"'two', {two}, 'one', {one}))")


def _kind(word: str) -> str:
    """Kind of a word that is a seed."""
    tests = [f"WHEN {word} rlike '^[(<\"]*{PATTERNS['email'].split('G)', 1)[1]}[.,;:)>\"]*$' THEN 'email'",
             f"WHEN {word} rlike '^[(<\"]*{_PART}(?:\\\\.{_PART}){{3}}[.,;:)>\"]*$' THEN 'ip'",
             f"WHEN {word} rlike '^\\\\+[0-9][().0-9-]+[0-9][.,;:]*$' AND length({_digits(word)}) BETWEEN 10 AND 15 THEN 'phone'",
             f"WHEN {word} rlike '^[0-9]+(?:-[0-9]+)*[.,;:]*$' AND {_valid('card', word)} THEN 'card'"]
    return f"CASE {' '.join(tests)} END"


def extracted(docs: DataFrame) -> DataFrame:
    """row, doc_id, key (digest of the text), base (spans) and words (identifier-like words and those before), kept durably."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Two expressions, not one nested deeper: the parser keeps what it learns from an expression, over 10 MB of the driver for both in one.
    return C.durable(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.unhex(F.md5("text")).alias("key"),
                                 F.expr(_base("text")).alias("base"), F.expr(_words("text")).alias("words")))


def _confident(edges: DataFrame, support: int, least: float) -> DataFrame:
    """pattern, kind, trust of the patterns that count."""
    sums = edges.groupBy("pattern").agg(F.count("*").alias("n"), *[F.sum(k).alias(k) for k in KINDS],
                                        *[F.sum(F.expr(f"int({k} >= {least})")).alias(f"n_{k}") for k in KINDS])
    best = F.greatest(*[F.struct((F.col(k) / (F.col("n") + 1)).alias("trust"), F.lit(k).alias("kind"), F.col(f"n_{k}").alias("n"))
                        for k in KINDS])
    return sums.select("pattern", best.alias("x")).where((F.col("x.n") >= support) & (F.col("x.trust") >= least)).select(
        "pattern", "x.kind", "x.trust")


def learned(words: DataFrame, rounds: int = 3, support: int = 5, least: float = 0.8) -> DataFrame:
    """word, kind of the identifiers that the patterns find. words: word, two, one of every identifier-like word."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace("word", "[0-9]", "9"), "[A-Z]+", "A"), "[a-z]+", "a")
    pattern = F.explode(F.array(F.concat(F.lit("2 "), F.col("two")), F.concat(F.lit("1 "), F.col("one"), F.lit(" "), shape)))
    edges = words.where("one <> ''").select("word", F.expr(_kind("word")).alias("seed"), pattern.alias("pattern")).distinct()
    edges = C.durable(edges.where("pattern <> '2 '"))
    now = edges.select("*", *[F.expr(f"double(seed <=> '{k}')").alias(k) for k in KINDS])
    for _ in range(rounds):
        votes = edges.where("seed IS NULL").join(_confident(now, support, least), "pattern")
        belief = votes.groupBy("word", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-9)))))).alias("belief"),
                                                   F.count("*").alias("n"))
        new = C.durable(belief.where((F.col("n") >= 2) & (F.col("belief") >= least)).groupBy("word").agg(
            F.max(F.struct("belief", "kind")).alias("x")).select("word", "x.kind", "x.belief"))
        now = edges.join(new, "word", "left").select(
            "word", "seed", "pattern", *[F.expr(f"CASE WHEN seed = '{k}' THEN 1D WHEN kind = '{k}' THEN belief ELSE 0D END").alias(k) for k in KINDS])
    return new.select("word", "kind")


def _new_spans(rows: DataFrame, by: str, **how) -> DataFrame:
    """by, found: spans of the identifiers that the patterns find, for each row or each text."""
    words = rows.select(by, F.explode("words").alias("x")).select(by, "x.*")
    order = F.expr("CASE kind " + " ".join(f"WHEN '{k}' THEN {i + len(KINDS)}" for i, k in enumerate(KINDS)) + " END")
    return words.join(learned(words, **how), "word").groupBy(by).agg(F.collect_set(F.struct(
        "start", order.alias("ord"), F.concat(F.lit("found_"), "kind").alias("kind"), "stop")).alias("found"))


def _all_spans(base: Column, found: Column) -> Column:
    """Base spans and those found that no base span overlaps, in order."""
    free = F.filter(found, lambda x: ~F.exists(base, lambda b: (b["start"] < x["stop"]) & (x["start"] < b["stop"])))
    return F.when(found.isNull(), base).otherwise(F.array_sort(F.concat(base, free)))


def find(docs: DataFrame, **how) -> DataFrame:
    """doc_id, base and spans of every row: sorted arrays of start, ord, kind, stop (code points, stop exclusive)."""
    rows = extracted(docs)
    found = _new_spans(rows, "row", **how)
    return rows.join(found, "row", "left").select("doc_id", "base", _all_spans(F.col("base"), F.col("found")).alias("spans"))


def masked(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs with all their columns; in text, each span is replaced by its kind in angle brackets, like <EMAIL>.

    Spans that overlap become one mark, named after the first. A text without spans stays as it is, null too; of a masked one, n_chars follows.
    """
    own = "pii"
    while any(c.startswith(f"{own}__") for c in docs.columns):
        own += "_"
    key, base, new, spans = (f"{own}__{k}" for k in ("key", "base", "new", "spans"))
    found = _new_spans(extracted(docs), "key", **how).select(F.col("key").alias(key), F.col("found").alias(new))
    rows = docs.withColumn(key, F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    rows = rows.join(found, key, "left").withColumn(base, F.expr(let("coalesce(text, '')", _base)))
    rows = rows.withColumn(spans, _all_spans(F.col(base), F.col(new)))
    text = F.expr(f"""aggregate({spans}, named_struct('at', 0L, 'out', ''), (s, x) -> named_struct('at', greatest(s.at, x.stop), 'out',
        CASE WHEN x.start < s.at THEN s.out ELSE concat(s.out, substring(text, int(s.at) + 1, int(x.start - s.at)), '<',
        upper(replace(x.kind, 'found_', '')), '>') END), s -> concat(s.out, substring(text, int(s.at) + 1)))""")
    rows = rows.withColumn("text", F.when(F.size(spans) > 0, text).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)
