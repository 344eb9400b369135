import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glasspane.functions import cookies as C
from glasspane.functions import text as T
from glasspane.functions import urls as U
from glasspane.operators import retention, rights, scoring, trackers
from glasspane.operators.recipients import trust_label
from glasspane.sources import dims


def test_hosts(values):
    assert values(U.site("x"), "https://www.shop.example/x", "https://web.example.com", "a.b.c:80/x", "//") == [
        "shop.example", "web.example.com", "a.b.c", None]
    assert values(U.host("x"), "/js/app.js", "//cdn.a.test/x", "https://u@h.test?y") == [None, "cdn.a.test", "h.test"]
    assert values(U.normalise_url("x"), "shop.example/", "//shop.example") == ["https://shop.example"] * 2


def test_period_days(values):
    assert values(retention.days("x"), "6 months", "1.5 months", "three years", "two weeks", "ninety days", "soon",
                  "99999999999999999999 years") == [180, 45, 1095, 14, 90, None, None]


def test_period_rating(values):
    days = (30, 31, 180, 365, 366, 730, 731, None)
    assert values(retention.rating("x"), *days, kind="bigint") == [
        "excellent", "good", "good", "fair", "poor", "poor", "very_poor", "unknown"]
    assert values(retention.rating_label("x"), 731, 1095, kind="bigint") == [">2 years", ">3 years"]


def test_cookies(values):
    got = values(C.parse("x"), "sid=abc; Path=/; HttpOnly; Secure; SameSite; Max-Age=86400", "_ga=1; Max-Age=63072000",
                 "x=1; Expires=Wed, 01 Jan 2031 00:00:00 GMT", "a=" + "v" * 30 + "; Domain=.hotjar.com")
    assert (got[0].category, got[0].samesite, got[0].httponly, got[0].secure, got[0].duration_label) == (
        "advertising", "Lax", True, True, "≤1 day")
    assert (got[1].category, got[1].duration_label) == ("analytics", "2+ years")
    assert (got[2].category, got[2].duration_label) == ("unknown", "session")
    assert (got[3].category, got[3].value_preview) == ("analytics", "v" * 20 + "…")


def test_grades(values):
    assert values(scoring.grade("x"), 85, 84, 70, 50, 30, 29, kind="int") == ["A", "B", "B", "C", "D", "F"]
    assert values(scoring.risk_level("x"), 75, 50, 30, 29, kind="int") == ["low", "medium", "high", "critical"]
    assert values(rights.grade("x"), 90, 75, 55, 35, 34, kind="int") == ["A", "B", "C", "D", "F"]
    assert values(trust_label("x"), 70, 50, 30, 29, kind="int") == ["trusted", "moderate", "concerning", "unknown"]
    assert values(trackers.badge("x"), 0, 5, 6, 15, 16, kind="int") == ["yellow", "yellow", "orange", "orange", "red"]


def test_sharing_score(values):
    score = scoring.sharing_score("x", "0", "false", "false", "0")
    assert values(score, 0, 5, 6, 15, 16, kind="int") == [100, 85, 81, 45, 43]


def test_spans_count_characters_not_units(values):
    assert values(T.first_span("x", r"b\d"), "😀😀 b1", "b2") == [(3, 5), (0, 2)]
    assert values(T.all_spans("x", r"b\d"), "b1 b2", "none", "éb3") == [[(0, 2), (3, 5)], [], [(1, 3)]]
    assert values(T.snippet("x", T.first_span("x", "mid"), 2, 2), "ab  mid\n\ncd") == ["…mid…"]


def test_words_are_whole(values):
    assert values(T.words_in("x", ("ein", "age")), "being and page", "ein age", "ages", "éin eine") == [
        [], ["ein", "age"], ["age"], []]


def test_wide_spaces_count_as_space(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([("Right\xa0to  access",)], "t string").select(T.searchable(F.col("t")).alias("low"))
    assert df.selectExpr(T.matches("low", r"right\s+to\s+access") + " AS m").first().m


RULES = [r for r in dims.rule_rows() if r[3] == "regex"]


@pytest.mark.parametrize("pattern", sorted({r[4] for r in RULES}))
def test_guard_is_part_of_every_match(pattern):
    """A text that matches contains one of the guards (checked on matches made from the pattern itself)."""
    found = T.needles(pattern)
    if found:
        example = st.from_regex(pattern, alphabet=st.characters(max_codepoint=127))

        @settings(max_examples=15, deadline=None, database=None)
        @given(example)
        def check(text):
            m = re.search(pattern, text)
            assert m is None or any(g in m.group(0) for g in found)
        check()


def test_first_character_test_changes_no_match():
    for pattern in {r[4] for r in RULES}:
        ahead = T._ahead(pattern)
        if ahead != pattern:
            for text in ("we keep your data for 6 months", "delete account", "by using it you agree", "to opt-out mail us",
                         "retain for up to three years", "privacy by design", "data may be shared", "erase your data on request"):
                a, b = re.search(pattern, text), re.search(ahead, text)
                assert (a and a.span()) == (b and b.span())


def test_character_references_are_decoded_once(values):
    import html
    from glasspane.functions import html as H
    texts = ["Gr&uuml;&szlig;e", "&#252;&#xFC;&#X00fc;", "&amp;lt; &amp;amp;", "&#0; &#xD800; &#9999999;", "&NotEqualTilde;&hellip;", "a &nosuch; b & c && d;",
             "&", "", "&#;&#x;&;", "&#128512;\n&quot;&#39;&apos;&lt;p&gt;", "&nbsp;&#160;", "no reference; at all", "&bsol;&NewLine;|&Tab;|&comma;" + "x" * 9000 + "&copy;"]
    assert values(H.unescape("x"), *texts) == [html.unescape(t).replace(" ", " ") for t in texts]
    assert values(H.unescape("x"), "&" + "a" * 50_000 + ";" + "&#65;" * 20_000) == ["&" + "a" * 50_000 + ";" + "A" * 20_000]
