"""The pipeline on planted documents, stage by stage, and the registered queries."""

import corpus_pipeline
import __spark_entry__ as entry
from shelfmark.llm import quality
from shelfmark.llm.queries import ORACLE, QUERIES
from shelfmark.llm.tables import read, ready
from tests.compare import connect, differences

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert [sum(k.startswith(f"op{n}_") for k in entry.queries()) for n in range(1, 14)] == [1] * 13
    assert "pipeline" in entry.queries() and set(ORACLE) <= set(QUERIES)


def test_sql_twins(spark):
    con = connect(SF)
    for name, sql in ORACLE.items():
        assert differences(QUERIES[name](spark, SF), con.sql(sql)) is None


def test_stages(spark):
    ready(spark)
    docs = read(spark, SF, "documents")
    text = read(spark, SF, "documents").orderBy("doc_id").first().text
    item = read(spark, SF, "benchmark").orderBy("item_id").first().text
    base = docs.where("length(text) between 900 and 3000").orderBy("doc_id").select("text").limit(4).collect()
    planted = [
        (9001, base[0].text + " unique ending"), (9002, base[0].text + " unique ending"),
        (9003, base[1].text + " " + item + " " + base[2].text),
        (9004, base[3].text[::-1] + ' token = "9233a8ecf7c5b09fe5949719b6b82bc439e9329b" done'),
        (9005, "*** ### " * 100),
    ]
    rows = docs.unionByName(
        spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in planted], docs.schema)
    )
    steps = dict(corpus_pipeline.STAGES)
    assert 4 <= len(steps) <= 5
    good = steps["quality classifier"](spark, rows, SF)
    assert good.schema == rows.schema
    ids = {r.doc_id for r in good.collect()}
    machine = quality.train(rows, read(spark, SF, "labels"))
    assert ids == {r.doc_id for r in rows.collect() if machine.score(r.text) >= quality.THRESHOLD}
    assert 9005 not in ids
    single = steps["simhash near-dedup"](spark, rows, SF)
    assert single.schema == rows.schema
    ids = {r.doc_id for r in single.collect()}
    assert len(ids & {9001, 9002}) <= 1 and {9003, 9004, 9005} <= ids
    clean = steps["benchmark decontamination"](spark, rows, SF)
    ids = {r.doc_id for r in clean.collect()}
    assert clean.schema == rows.schema and 9003 not in ids and {9001, 9002, 9004, 9005} <= ids
    masked = steps["secret scan"](spark, rows, SF)
    assert masked.columns == rows.columns
    by = {r.doc_id: r for r in masked.collect()}
    assert len(by) == rows.count() and "9233a8ec" not in by[9004].text and by[9004].n_chars == len(by[9004].text)
    assert by[0].text == text or "[SECRET]" in by[0].text
    tokens = steps["byte-level bpe"](spark, rows, SF)
    assert tokens.count() == rows.count() and tokens.where("length(ids) <> 4 * n_tokens").count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert 100 < out.count() < 200 and "ids" in out.columns
