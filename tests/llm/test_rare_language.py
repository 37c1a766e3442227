from groundline.llm import language_id


def test_a_rare_language_is_learned(spark):
    rows = [(i, "the and of with that " * 5, "en") for i in range(6000)] + [(10000 + i, "ja nein und der das " * 5, "de") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    usable = docs.where("lang = 'de'").where(~language_id.held_out()).count()
    assert usable > 0
    # of 20 rows drawn over all, none would be of the rare language
    assert set(language_id.train(docs, 20).languages) == {"de", "en"}
