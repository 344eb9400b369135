"""Dossiers of companies, joins with hot names, stored results."""

import datetime as dt

from glasspane.operators import hot, parties
from glasspane.sources import dims, store


def test_rows_of_a_hot_name_are_split_and_whole(spark):
    rows = spark.createDataFrame([(i, "big" if i % 3 else f"n{i}" if i % 2 else None) for i in range(3000)], "site_id long, name_lc string")
    once = spark.createDataFrame([("big", 1), ("n3", 2), ("n9", 3), ("absent", 4), (None, 5)], "name_lc string, v int")
    out = hot.attach(rows, once, "name_lc", share=10)
    got = {(r["site_id"], r["name_lc"], r["v"]) for r in out.collect()}
    known = {"big": 1, "n3": 2, "n9": 3}
    assert out.count() == 3000 and out.columns == ["name_lc", "site_id", "v"]
    assert got == {(r["site_id"], r["name_lc"], known.get(r["name_lc"])) for r in rows.collect()}
    # "big" holds two thirds of the rows, so more than six of ten shares: it is joined in seven parts.
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "part" in plan and "Cartesian" not in plan


def test_clashing_names_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, "a", 7, 8, 9)], "site_id long, name_lc string, part int, hot_key int, parts int")
    once = spark.createDataFrame([("a", 5)], "name_lc string, v int")
    assert hot.attach(rows, once, "name_lc").collect()[0].asDict() == {"name_lc": "a", "site_id": 1, "part": 7, "hot_key": 8, "parts": 9, "v": 5}
    assert hot.attach(rows.limit(0), once, "name_lc").count() == 0
    assert hot.attach(rows, once.where("false"), "name_lc").collect()[0]["v"] is None


def test_names_lead_to_domains(values):
    got = values(parties.company_domain("x"), "acme widgets gmbh", "site.example ", "a, b")
    assert got == ["acmewidgetsgmbh.com", "site.example", "ab.com"]


def test_one_dossier_per_company(spark):
    queue = spark.createDataFrame(
        [(s, 0, "criteo", "Criteo", "Ads", None) for s in (1, 2)] + [(1, 1, "acme co", "Acme Co", "Shop", "https://o"), (2, 1, "odd", "Odd", "X", None),
         (2, 2, None, None, "X", None)], "site_id long, pos int, name_lc string, name string, category string, opt_out string")
    found = spark.createDataFrame([("acmeco.com", "privacy", "https://acmeco.com/p"), ("odd.com", "privacy", "https://odd.com/p"),
                                   ("odd.com", "trust", "https://odd.com/t")], "company_domain string, label string, url string")
    fetches = spark.createDataFrame([("https://acmeco.com/p", 1, "old"), ("https://acmeco.com/p", 2, "new text"), ("https://odd.com/p", 1, "")],
                                    "url string, at long, text string")
    answers = spark.createDataFrame([("acme co", 1, "no"), ("acme co", 2, '```json\n{"gdpr_role": "Controller", "risk_flags": ["Fingerprints"]}```'),
                                     ("odd", 1, '{"gdpr_role": "Processor"}')], "name_lc string, at long, response string")
    made = parties.research(queue, dims.company_page_table(spark), found, fetches, answers, chars=3)
    by = {r["name_lc"]: r for r in made.collect()}
    assert set(by) == {"criteo", "acme co", "odd"}
    assert by["acme co"]["context"] == "=== PRIVACY PAGE (https://acmeco.com/p) ===\nnew" and by["acme co"]["research"] == "answered"
    assert (by["odd"]["pages_found"], by["odd"]["pages_read"], by["odd"]["gdpr_role"], by["odd"]["trust_score_ai"]) == (1, 0, "Unknown", 30)
    rows = {(r["site_id"], r["pos"]): r for r in parties.dossiers(queue, made).collect()}
    assert len(rows) == 5 and rows[1, 1]["risk_flags"] == ["Fingerprints"] and rows[1, 1]["opt_out_url"] == "https://o"
    assert rows[2, 1]["summary"] == "No pages could be fetched for Odd." and rows[2, 2]["research"] is None
    acts = parties.actions(parties.dossiers(queue, made)).where("site_id = 1").orderBy("pos").collect()
    assert [a["action"] for a in acts][-3:] == [parties.SAR, parties.BLOCK, parties.REVIEW]


def test_a_repeated_run_replaces_itself(spark, tmp_path):
    rows = spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 9)), (2, dt.datetime(2024, 1, 2, 9)), (3, None)], "result_id long, analyzed_at timestamp")
    path = str(tmp_path / "results")
    for run in ("a", "b", "a", "a"):
        store.save_results(rows.where("result_id <> 2") if run == "b" else rows, path, run)
    assert sorted((r["run"], r["result_id"]) for r in store.read_results(spark, path).collect()) == [
        ("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 3)]
    day = store.read_results(spark, path, since="2024-01-02", until="2024-01-02")
    assert [r["result_id"] for r in day.collect()] == [2]
    assert "analyzed_date" in day._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:200]


def test_most_common_names_per_level(spark):
    from glasspane.operators import reports
    rows = [("full", "en", "s1", ["a", "b"], ["p"]), ("full", "en", "s2", ["a", "a"], None), ("full", None, "s1", ["b"], []),
            ("unreadable", "en", "s1", ["c"], ["q"]), ("full", "de", "s1", None, ["p"])]
    facts = spark.createDataFrame(rows, "state string, lang string, domain string, c array<string>, d array<string>").selectExpr(
        "state", "lang", "domain", "transform(c, x -> struct(x AS name)) AS data_types", "struct(transform(d, x -> struct(x AS name)) AS detected) AS dark_patterns")
    got = {tuple(r) for r in reports.fleet_common(facts, "lang", "domain", n=1).collect()}
    assert {r for r in got if r[0] < 2} == {
        (0, None, None, "category", 1, "a", 2), (0, None, None, "dark_pattern", 1, "p", 2), (1, "en", None, "category", 1, "a", 2),
        (1, "en", None, "dark_pattern", 1, "p", 1), (1, None, None, "category", 1, "b", 1), (1, "de", None, "dark_pattern", 1, "p", 1)}
    assert (2, "en", "s2", "category", 1, "a", 1) in got and not any(r[5] in "cq" for r in got)
    assert reports.fleet_common(facts.limit(0), "lang", "domain").count() == 0


def test_a_label_document_without_a_crawl_names_its_fields(spark):
    from glasspane.operators import context, scoring
    from glasspane.sources import tables
    import json
    path = "/root/testdata/sf0.001"
    docs, pages = tables.policies(spark, path).where("doc_id < 2"), tables.homepages(spark, path).where("page_id < 2")
    row = json.loads(context.label_json(scoring.score(scoring.site_facts(docs, pages))).first()["result_json"])
    assert row["url"] is None and row["policy_discovery_method"] is None and row["score_breakdown"]["weights"]["technical"] == 0.08
