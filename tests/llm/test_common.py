from pyspark.sql import functions as F

from emberline.llm.common import without


def test_columns_of_the_documents_stay(spark):
    """Names that the join uses inside may be columns of the documents."""
    names = "doc_id long, text string, h long, __h long, __h_ long, __doc_id long, __gone_h long"
    docs = spark.createDataFrame([(1, "a", 1, 2, 3, 4, 5), (2, "b", 1, 2, 3, 4, 5), (None, "c", 1, 2, 3, 4, 5), (1, "d", 1, 2, 3, 4, 5)], names)
    value = F.xxhash64("text")
    gone = docs.filter("text IN ('a', 'c')").select("doc_id", value.alias("h"))
    kept = without(docs, "doc_id", value, gone)
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect()) == [(1, "d", 1, 2, 3, 4, 5), (2, "b", 1, 2, 3, 4, 5)]
