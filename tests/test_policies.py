from pyspark.sql import functions as F

from glasspane.functions import text as T
from glasspane.operators import dark_patterns, data_types, history, recipients, retention, rights, scoring, wording
from glasspane.sources import dims


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_rights(policies):
    r = one(rights.detect(policies("You have the right to access your data and the right to erasure.")).select("rights.*"))
    assert r.gdpr_score == 22 and r.gdpr_grade == "F"
    assert [x.right_id for x in r.gdpr if x.covered] == ["access", "erasure"]
    assert "right to access" in r.gdpr[0].evidence


def test_upper_case_marks_are_found(policies):
    r = one(rights.detect(policies("The ICO and HIPAA; we honor DNT and GPC. CCPA applies.")).select("rights.*"))
    assert r.dnt_honored and r.global_privacy_control and r.frameworks_mentioned == ["HIPAA (Health Data US)"]
    assert [x.right_id for x in r.ccpa if x.covered] == ["right_to_opt_out"]


def test_data_categories(policies):
    d = {r.category_id: r for r in data_types.rows(policies(
        "We collect medical history and biometric data and share your personal data with partners.")).collect()}
    assert d["health"].sensitivity == "critical" and d["health"].shared and len(d["health"].evidence) == 3
    assert d["biometric"].gdpr_special_category
    assert not data_types.rows(policies("The weather was calm and the garden was green.")).collect()
    assert not data_types.rows(policies("Being on this page.")).collect()
    assert {r.category_id for r in data_types.rows(policies("Being on this page."), "substring").collect()} == {
        "government_id", "identity"}


def test_retention(policies):
    r = retention.items(policies("We keep for 6 months and for up to three years. Kept as long as necessary and upon account "
                                 "deletion. We store for 6 months.")).orderBy("ord").collect()
    assert [(x.period_text, x.period_days) for x in r] == [
        ("6 months", 180), ("6 months", 180), ("three years", 1095), ("Until account deletion", None), ("Vague / Unspecified", None)]
    vague = one(retention.detect(policies("Kept as long as necessary.")).select("retention.*"))
    nothing = one(retention.detect(policies("Hello.")).select("retention.*"))
    assert vague.overall_rating == nothing.overall_rating == "very_poor"
    mean = one(retention.detect(policies("We keep for 30 days. Kept as long as necessary.")).select("retention.*"))
    assert mean.overall_rating == "fair" and mean.shortest_days == mean.longest_days == 30


def test_dark_patterns(policies):
    d = one(dark_patterns.rows(policies("By using our service you agree to this policy.")))
    assert d.pattern_type == "bundled_consent" and d.confidence == 0.7
    risks = [r.overall_risk for r in dark_patterns.detect(policies(
        "Boxes are pre-selected. By using it you agree.", "By using it you agree.", "We may remind you again. Relevant ads.",
        "Click agree to continue.", "Nothing.")).select("doc_id", "dark_patterns.overall_risk").orderBy("doc_id").collect()]
    assert risks == ["critical", "high", "medium", "low", "none"]


def test_wording(policies):
    w = one(wording.detect(policies("We share it. Google Analytics and Acme Widgets GmbH and Acme Widgets GmbH get it. Some other."))
            .select("wording.*"))
    assert w.active_voice_count == 2 and w.passive_voice_ratio == 0.0
    assert w.named_third_parties == ["Google Analytics", "Acme Widgets GmbH"]
    assert w.vague_term_examples == ['"some" (×1)', '"other" (×1)']
    assert w.avg_sentence_length == 5.7


def test_recipients(spark, policies):
    docs = policies("We share your data with Google, Criteo and Stripe Inc. for targeted ads. Vendors and affiliates too. "
                    "We rely on standard contractual clauses. We never sell data.")
    found = {p.name: p for p in recipients.parties(docs, dims.trust_table(spark), 37).collect()}
    assert set(found) == {"Google", "Criteo", "Stripe Inc"}
    assert found["Stripe Inc"].trust_score == 80 and found["Criteo"].is_data_broker
    assert "advertising" in found["Google"].purposes
    s = one(recipients.detect(docs).select("sharing.*"))
    assert (s.named_count, s.unnamed_count, s.risk_level, s.data_sold) == (3, 0, "critical", True)
    assert s.transfer_safeguards == ["Standard Contractual Clauses (SCCs)"] and s.cross_border_transfers


def _facts(docs, pages):
    return scoring.score(scoring.site_facts(docs, pages))


def test_score_of_an_empty_finding(policies, homepages):
    silent = "The weather was calm and the garden was green. " * 4
    s = one(_facts(policies(silent), homepages().limit(0)))
    assert [s[f"{d}_score"] for d in ("data_collection", "sharing", "retention", "rights", "transparency", "dark_patterns",
                                      "technical")] == [100, 100, 5, 0, 20, 100, 100]
    assert (s.overall, s.grade, s.risk_level) == (61, "C", "medium")


def test_score_without_a_policy_or_its_text(policies, homepages):
    docs = policies("", "short").withColumn("policy_found", F.col("doc_id") == 1)
    rows = {r.doc_id: r for r in _facts(docs, homepages().limit(0)).collect()}
    assert (rows[0].overall, rows[0].grade, rows[0].risk_level, rows[0].technical_score) == (5, "F", "critical", 0)
    assert (rows[1].overall, rows[1].technical_score, rows[1].state) == (48, 50, "unreadable")


def test_ledger_explains_without_changing(policies, homepages):
    s = one(_facts(policies("We sell your personal data. By using our site you agree. Genetic data. " * 3), homepages().limit(0)))
    reasons = [p.reason for p in s.penalties]
    assert "GDPR special category data: Genetic Data" in reasons and "Personal data is sold to third parties" in reasons
    assert all(0 <= s[f"{d}_score"] <= 100 for d in ("data_collection", "sharing", "technical"))


def _fetches(spark, *texts):
    rows = [(i, "a.example", f"2024-01-0{i + 1} 00:00:00", "u", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "fetch_id long, domain string, fetched_at string, policy_url string, text string").withColumn(
        "fetched_at", F.to_timestamp("fetched_at"))


def test_versions(spark):
    v = history.versions(_fetches(spark, "A", "A", "B", "A")).orderBy("version_id").collect()
    assert [(x.version_id, x.is_current) for x in v] == [(0, False), (2, True)]


def test_line_changes(spark):
    f = _fetches(spark, "a\nb\nc\nd", "a\nx\nc\nd\ne")
    p = history.pairs(history.versions(f))
    texts = one(history.paired_texts(p, f))
    assert (texts.old_text, texts.new_text) == ("a\nb\nc\nd", "a\nx\nc\nd\ne")
    free = one(history.line_changes(f, p))
    assert (free.added_lines, free.removed_lines, free.similarity_ratio) == (2, 1, 0.6667)


def test_positions_stay(spark):
    """The searched copy is as long as the text, over the whole of Unicode."""
    every = "".join(chr(c) for c in range(1, 0x11000) if not 0xD800 <= c < 0xE000)
    df = spark.createDataFrame([(x,) for x in [every[i:i + 97] for i in range(0, len(every), 97)]], "text string")
    assert df.where(F.length(T.searchable(F.col("text"))) != F.length("text")).count() == 0


def test_same_domain_twice_in_recent(spark):
    r = spark.createDataFrame([(1, "a", 10, "F"), (2, "a", 20, "F"), (3, "b", 30, "D")], "result_id long, domain string, overall_score int, grade string").withColumn(
        "analyzed_at", F.timestamp_seconds(F.col("result_id")))
    assert [x.domain for x in history.recent(r, 3).collect()] == ["b", "a", "a"]
    c = {x.domain: x for x in history.compare(r).collect()}
    assert c["a"].score_delta == 10 and c["b"].message == "Not enough history for comparison"


def test_names_equal_a_plain_search(policies):
    """Entities and brands as a backtracking search finds them, on random arrangements of telling words."""
    import random
    import re

    from glasspane.rules.wording import LEGAL_ENTITY
    words = ["Acme", "Blue", "Inc", "Inc.", "LLC", "Ltd", "Ltd.,", "GmbH", "S.A.", "S.A.Blue", "Google", "Stripe", "PayPal", "Constant", "Contact",
             "we", "X", "comScore", "AG", "SE,", "Mc-Neil", "\n", "Corp", "UPS", "Incorporated", "Google."]
    rng = random.Random(7)
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(400)]
    docs = policies(*texts)
    got = docs.select("doc_id", recipients.T.over_text(lambda text, _: recipients.names(text)).alias("n"),
                      wording.T.over_text(lambda text, _: wording.entities(text)).alias("e")).collect()
    for r in got:
        text = texts[r.doc_id]
        assert r.n == sorted({m.group(0) for m in re.finditer(recipients.NAMED, text)}), text
        assert r.e == [m.group(0) for m in re.finditer(LEGAL_ENTITY, text)], text


def test_long_lists_of_names_do_not_exhaust_the_stack(policies):
    docs = policies("Anna Bert " * 50_000 + "Acme Inc. and Google")
    assert one(recipients.mentioned(docs).select("name").where("name = 'Google'")).name == "Google"
    found = one(wording.detect(docs).select("wording.named_third_parties")).named_third_parties
    assert found[-1].endswith("Acme Inc")


def test_many_periods_in_one_policy(policies):
    import time
    docs = policies(" ".join(f"We keep data for {i % 900 + 1} days." for i in range(5000)))
    began = time.time()
    assert retention.items(docs).count() > 800 and time.time() - began < 30


def test_wide_spaces_part_words_of_sentences(values):
    from glasspane.operators import wording
    text = "One\u00a0two\u2003three. Four\u3000five! \u00a0 ?"
    got, = values(wording.sentence_length("x"), text)
    parts = [p.strip() for p in __import__("re").split(r"[.!?]+", text) if p.strip()]
    assert got == sum(len(p.split()) for p in parts) / len(parts) == 2.5


def test_unreadable_answers_fall_back(spark):
    from glasspane.operators import context
    rows = [(1, '{"tldr": "fine", "red_flags": [{"issue": "x"}]}'), (1, "no json"), (2, None), (9, '{"tldr": "cut'), (None, '```json\n{"data_story": "d"}\n```')]
    sites = spark.createDataFrame([(1, "a.example", "B", 71), (2, "b.example", "F", 5)], "site_id long, domain string, grade string, overall int")
    got = context.analyses(spark.createDataFrame(rows, "site_id long, response string"), sites).collect()
    by = {(r["site_id"], r["response"]): r for r in got}
    assert len(got) == 5 and [by[k]["ai_available"] for k in rows] == [True, False, False, False, True]
    assert by[rows[0]]["tldr"] == "fine" and by[rows[0]]["data_story"] == "" and by[rows[0]]["red_flags"][0]["issue"] == "x" and by[rows[0]]["headline_risks"] == []
    assert by[rows[1]]["plain_summary"] == "a.example has a privacy grade of B (71/100)." and by[rows[1]]["headline_risks"] == ["AI analysis unavailable"]
    assert by[rows[2]]["ai_score_commentary"] == "Score of 5/100 based on automated analysis only." and by[rows[2]]["red_flags"] == []
    assert by[rows[3]]["tldr"] is None and by[rows[3]]["data_story"] == "AI analysis unavailable." and by[rows[4]]["data_story"] == "d"
