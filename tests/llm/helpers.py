"""Small tables with the cases that every operator has to stand."""

from shelfmark.llm.tables import ready

DOCS = "doc_id long, text string, row string, `fp` int, `ids` string, `a.b` string"


def table(spark, rows, schema):
    ready(spark)
    return spark.createDataFrame(rows, schema)


def documents(spark, texts):
    """Texts, with extra columns whose names the operators use themselves."""
    return table(spark, [(i, t, f"r{i}", 7, "x", "y") for i, t in texts], DOCS)


def empty(spark):
    return table(spark, [], DOCS)


def by_id(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}
