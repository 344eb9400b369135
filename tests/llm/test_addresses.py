import re

from glasspane.llm import queries as Q
from glasspane.llm import urlrules as U


def plain(url, rules):
    host, path = "", ""
    if url and "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
        host, path = re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]
    fits = [(len(t), t, say) for say, t in rules for at, start in [t.split("/", 1)]
            if (host == at or host.endswith("." + at)) and path.startswith("/" + start)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_written_rules_of_every_page(spark, sf, table):
    rows = {r["page_id"]: r for r in Q.judge_addresses(spark, sf).collect()}
    pages = table("SELECT page_id, url FROM pages", "pages")
    assert len(rows) == len(pages)
    for i, url in pages:
        r, (host, path, rule, verdict) = rows[i], plain(url, Q.ADDRESS_RULES)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] == (verdict or r["verdict"])
        assert r["verdict"] in ("allow", "block") and (r["mined"] is None or rule is None)


def test_odd_addresses(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.NET", "x://a.NET/", "http://net?x/", "http://É.Net/#/en", "a://b://c.org/fr/x", "http://fr.org/fr",
            "http://u@h.example.com/de/?a=b&c&=#", "http://net/\nen", "http://net/", "http://net/"]
    df = spark.createDataFrame([(i if i else None, u, "own") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = sorted(((r["page_id"] or 0, r["host"], r["path"], r["rule"]) for r in U.judge(df, Q.ADDRESS_RULES).collect()), key=lambda x: x[0])
    assert got == [(i, *plain(u, Q.ADDRESS_RULES)[:3]) for i, u in enumerate(urls)]
    assert U.judge(df.limit(0), Q.ADDRESS_RULES).count() == 0
    assert {r["verdict"] for r in U.judge(df.where("url IS NULL"), Q.ADDRESS_RULES).collect()} == {"allow"}


def test_mined_rules(spark):
    """Labels: pills with a campaign are blocked. Every rule must hold on the labelled addresses as often as it says."""
    urls = [f"http://{h}-{t}.site{i % 9}.org/{i}?{q}={i}" for i in range(300) for h in ("cheap", "best") for t in ("pills", "books") for q in ("campaign", "page")]
    def label(u):
        return "block" if "pills" in u and "campaign" in u else "allow"
    df = spark.createDataFrame([(u, label(u)) for u in urls], "url string, verdict string")
    rules = U.mined(df.union(df.limit(500)), 0.02, 0.9, 12, 2000)
    said = [(set(r["need"]), r["verdict"]) for r in rules]
    assert ({"word:pills", "key:campaign"}, "block") in said and ({"word:books"}, "allow") in said and ({"key:page"}, "allow") in said
    tokens = {r["url"]: set(r["t"]) for r in df.select("url", U.tokens(df["url"]).alias("t")).collect()}
    for r in rules:
        held = [u for u in urls if set(r["need"]) <= tokens[u]]
        assert abs(sum(label(u) == r["verdict"] for u in held) / len(held) - r["confidence"]) < 1e-9
        assert not any(set(x["need"]) < set(r["need"]) and x["verdict"] == r["verdict"] and x["confidence"] >= r["confidence"] for x in rules)
    got = df.select("url", U._surest(rules, U.tokens(df["url"])).alias("x")).collect()
    for row in got:
        fits = [(r["confidence"], r["support"], r["size"], r["verdict"], r["need"]) for r in rules if set(r["need"]) <= tokens[row["url"]]]
        assert tuple(row["x"]) == max(fits)
    assert len(U.mined(df, 0.02, 0.9, 12, 1)) <= 1


def test_more_rules_than_the_literal_holds(spark):
    """With one rule allowed in the literal, the rules meet the pages as a table, and nothing changes."""
    urls = [f"http://{h}-{t}.{s}/{i % 4}/x?{q}={i}" for i in range(80) for h in ("cheap", "best") for t in ("pills", "books") for q in ("campaign", "page")
            for s in ("net", "org/fr", "shop.org", "example.com")]
    df = spark.createDataFrame([(i, u) for i, u in enumerate([*urls, *urls[:50], None, ""])], "page_id long, url string")
    rules = [("block", "net/"), ("allow", "org/fr")]
    few, many = (sorted(map(str, U.judge(df, rules, support=0.02, confidence=0.5, most_rules=n).collect())) for n in (2000, 1))
    assert few == many and len(few) == len(urls) + 52
    assert any(r["mined"] for r in U.judge(df, rules, support=0.02, confidence=0.5, most_rules=1).collect())
