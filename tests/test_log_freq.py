"""Word frequencies where the dictionary is larger than what is broadcast."""

from trajecta.operators import aggregates as A


def test_frequent_words_up_to_the_bytes_are_not_dealt(spark):
    words = [f"w{i}" for i in range(600) for _ in range(8)] + [f"r{i}" for i in range(300)] + ["", None]  # no word has one in 500 rows
    df = spark.createDataFrame([(w,) for w in words], "word string")
    whole = sorted(map(tuple, A.with_log_freq(df, "word").collect()), key=str)
    split = A.with_log_freq(df, "word", most=600 * 30)
    assert sorted(map(tuple, split.collect()), key=str) == whole
    assert "LOG2" in split._jdf.queryExecution().optimizedPlan().toString().upper()  # cut by size, not by a share of the rows
