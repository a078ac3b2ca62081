import corpus_pipeline


def test_documents_without_any_lang_stay(spark):
    rows = [(1, "some words", None, "s", 10), (2, "123 --", None, "s", 6), (3, None, None, "s", 0), (4, "é", None, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(tuple(r) for r in corpus_pipeline.language_id(spark, docs, "").collect()) == [rows[0], rows[3]]
