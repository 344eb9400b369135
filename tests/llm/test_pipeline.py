import corpus_pipeline as P

import __spark_entry__ as entry
from glasspane.llm import contamination, neardup
from glasspane.llm import queries as Q


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "benchmark", "personal_data", "mix"]


def test_stages(spark, sf, table):
    docs = Q.read(spark, sf, "documents")
    quality = {d: y for d, y in table("SELECT doc_id, quality FROM labels", "labels")}
    good = P.good_quality(spark, docs, sf).cache()
    kept = {r["doc_id"] for r in good.select("doc_id").collect()}
    assert good.columns == docs.columns and sum((d in kept) != (y == 1) for d, y in quality.items()) < 0.05 * len(quality)
    one = P.one_of_each(spark, good, sf).cache()
    assert one.count() == neardup.label(good).select("class_id").distinct().count()
    clean = P.without_benchmark(spark, one, sf).cache()
    held = {r["doc_id"] for r in contamination.find(one, Q.read(spark, sf, "benchmark")).collect()}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in one.collect()} - held and held
    masked = P.without_personal_data(spark, clean, sf).cache()
    assert masked.count() == clean.count() and masked.where("text LIKE '%<EMAIL>%'").count() > 0
    mixed = P.mixed(spark, masked, sf)
    assert set(docs.columns) < set(mixed.columns) and sorted(r["mix_position"] for r in mixed.select("mix_position").collect()) == list(range(masked.count()))


def test_run(spark, sf):
    out = P.run(spark, sf)
    assert out.count() > 500 and "text" in out.columns
