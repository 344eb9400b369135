from pyspark.sql import functions as F

from glasspane.functions import urls as U
from glasspane.operators import discovery, extraction, trackers
from glasspane.sources import dims


def test_longest_host_wins(spark, homepages):
    pages = homepages('<script src="https://stats.g.doubleclick.net/a.js"></script><script src="//static.hotjar.com/h.js"></script>'
                      '<script src="https://example.org/x.js"></script><script src="https://cdn.shop.example/y.js"></script>'
                      '<script src="/js/app.js"></script><!-- <script src="https://criteo.com/c.js"></script> -->')
    rows = trackers.match_hosts(trackers.resources(pages), dims.tracker_table(spark), dims.tracker_rows()).collect()
    assert {r.host: r.tracker and r.tracker.domain for r in rows} == {
        "stats.g.doubleclick.net": "doubleclick.net", "static.hotjar.com": "static.hotjar.com", "example.org": None}


def test_page_facts(homepages):
    pages = homepages('<img src="https://a.unknown.test/p.gif" width="1" height="0"><script>canvas.toDataURL()</script>'
                      '<script src="https://www.linkedin.com/in.js"></script><script src="https://www.linkedin.com/in2.js"></script>'
                      "<p>onetrust</p>", cookies=["a=1; Secure", "b=2"])
    t = trackers.detect(pages).select("tracking.*").first()
    assert t.total_tracker_count == 2 and t.by_category == {"Advertising / Analytics": 3}
    assert [x.name for x in t.trackers] == ["LinkedIn Insight Tag", "Unknown pixel (a.unknown.test)"]
    assert t.fingerprinting_detected and not t.session_recording_detected and t.cmp_detected == "OneTrust"
    assert (t.secure_pct, t.httponly_pct, t.n_cookies) == (50.0, 0.0, 2)
    none = trackers.detect(homepages("<p>x</p>")).select("tracking.*").first()
    assert (none.secure_pct, none.total_tracker_count, none.cmp_detected) == (0.0, 0, None)


def test_signals(homepages):
    s = trackers.page_signals(homepages('<button>Accept all</button><input type="checkbox" name="consent" checked>',
                                        '<div class="x cookie-consent"><a href="/">I agree</a><button>Decline</button></div>')).orderBy("page_id").collect()
    assert (s[0].no_reject_option, s[0].pre_ticked_boxes, s[0].has_consent_banner) == (True, 1, False)
    assert (s[1].no_reject_option, s[1].pre_ticked_boxes, s[1].has_consent_banner) == (False, 0, True)


def test_links(homepages):
    pages = homepages('<a href="/a">One</a><footer><a href="mailto:x">M</a><a href="/legal/privacy">Privacy <b>Policy</b></a></footer>'
                      '<a href="b">Two</a><a href="/a">Again</a>')
    assert [(r.href, r.full) for r in discovery.links(pages).orderBy("pos").collect()] == [
        ("/a", "https://shop.example/a"), ("/legal/privacy", "https://shop.example/legal/privacy"), ("b", "https://shop.example/b")]
    assert [r.href for r in discovery.preferred_links(pages).collect()] == ["/legal/privacy"]
    assert discovery.link_choice(pages).first().text == "Privacy Policy"


def test_one_label_per_link(homepages):
    from glasspane.rules import trust
    pages = homepages('<a href="/privacy-security">Privacy and security</a><a href="/privacy2">Privacy, security</a>')
    rows = discovery.label_links(pages, trust.LABEL_WORDS, trust.PAGE_LABELS).collect()
    assert {(r.label, r.url) for r in rows} == {("privacy", "https://shop.example/privacy-security"),
                                                ("security", "https://shop.example/privacy2")}


def test_texts(homepages):
    pages = homepages("<body><nav>skip me</nav><main><p>Kept &amp; read</p><script>var t='<p>no</p>'</script></main><div>Outside</div></body>",
                      '<script type="application/ld+json">{"a": "%s", "b": "short", "c": ["%s"]}</script>' % ("x" * 60, "y" * 60))
    native = {r.page_id: r.text for r in extraction.main_text(pages).collect()}
    assert native[0] == "Kept & read\nOutside"
    container = {r.page_id: r.text for r in extraction.container_text(pages).collect()}
    assert container[0] == "Kept & read"
    nested = homepages('<p>Before</p><div class="main" title="a > b"><div>One<br>Two</div><div><div>Three</div></div></div><div>After</div>', '<p>Alone</p>',
                       '<body>Never <i>closed</i>', '')
    assert [r.text for r in extraction.container_text(nested).orderBy("page_id").collect()] == ["One\nTwo\nThree", "Alone", "Never\nclosed", ""]
    embedded = {r.page_id: r.embedded for r in extraction.embedded_text(pages).collect()}
    assert embedded == {0: "", 1: "x" * 60 + "\n" + "y" * 60}


def test_many_links_on_one_page(homepages):
    import time
    pages = homepages("".join(f'<a href="/p{i % 15000}">Link</a>' for i in range(20000)))
    began = time.time()
    assert discovery.links(pages).count() == 15000 and discovery.preferred_links(pages).count() == 15000
    assert time.time() - began < 20


def test_regions_are_whole_elements(homepages):
    """Links behind a nested element of the same kind, regions that are never closed, quoted ">" and words of a class."""
    page = ('<a href="/first">First</a><div class="x legal"><div><div>Inner</div><a href="/a">A</a></div><a href="/b">B</a></div><a href="/out">Out</a>'
            '<section id="footer" title="a > b"><section/><section><a href="/c">C</a></section><a href="/d">D</a></section>'
            '<p class="illegal"><a href="/no">No</a></p><ul role="navigation"><li><a href="/e">E</a>')
    got = {r["page_id"]: r["h"] for r in discovery.preferred_links(homepages(page, '<a href="/only">Only</a>', "", '<footer><a href="/f">F</a>')).groupBy("page_id").agg(
        F.sort_array(F.collect_list(F.struct("pos", "href"))).alias("h")).collect()}
    assert [[x["href"] for x in got.get(i, [])] for i in range(4)] == [["/c", "/d", "/a", "/b", "/e"], ["/only"], [], ["/f"]]


def test_addresses_are_resolved(values):
    from urllib.parse import urljoin
    page = "https://shop.example/a/b/page?x=1"
    for href in ("../privacy", "../../../privacy", "./x", ".", "..", "/a/./b/../c/..", "/..", "?q=../x", "c/../../d?e=/../f#/../g", "x..y/.z"):
        got, = values(U.absolute("x", "'https://shop.example'", f"'{page}'"), href)
        assert got == urljoin(page, href), href
    assert values(U.absolute("x", "'https://shop.example'", f"'{page}'"), "//h.example/a/../b", "https://h.example/./c?a=/../b") == [
        "https://h.example/b", "https://h.example/c?a=/../b"]
