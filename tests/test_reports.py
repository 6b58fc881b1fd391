from scriptorium.operators import quality, writer


def test_keywords_without_punctuation_at_all_white_space(spark):
    docs = spark.createDataFrame([(1, "Kafka.\nkafka\tStream, the stream kafka! an ox"), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, writer.keywords(docs, "doc_id", "text").collect())) == [(1, "kafka", 3), (1, "stream", 2)]


def test_citation_counts(spark):
    docs = spark.createDataFrame([("[a](https://x) [b](https://x) [](ftp://y) [c]() [d](#e)",), ("none",)], "text string")
    got = docs.select(*quality.citation_counts(docs.text)).collect()
    assert sorted(map(tuple, got)) == [(0, 0, 0, 0), (5, 4, 1, 2)]
