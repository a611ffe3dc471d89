from tanglaw.llm import p6_quality


def test_common_words_of_a_rare_language(spark):
    rows = [(k, "tagalog", "ang bata ay nasa bahay at ang aso ay nasa puno") for k in range(300)] + [(900, " English", "the dog and the cat sat by the tree"), (901, "???", "zzz"), (902, " ", "yyy"), (903, None, "xxx")]
    df = spark.createDataFrame(rows, "doc_id bigint, language string, text string")
    names = spark.createDataFrame([("tagalog",), ("english",)], "language string")
    assert {"ang", "the", "and"} <= set(p6_quality.common_words(df))
    assert set(p6_quality.common_words(df, names)) == {"ang", "bata", "ay", "nasa", "bahay", "at", "aso", "puno", "the", "dog", "and", "cat", "sat", "by", "tree"}
    assert p6_quality.common_words(df, names, most=1) in (["ang", "the"], ["ay", "the"], ["nasa", "the"])
