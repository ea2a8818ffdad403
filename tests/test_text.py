import pytest
from pyspark.sql import functions as F

from gullwatch.functions import text
from gullwatch.functions.fixed import ATTACK_TERMS


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("o")).first().o


# expected number words
NUMBERS = {
    "0": "zero",
    "007": "seven",
    "16": "sixteen",
    "100": "one hundred",
    "118": "one hundred eighteen",
    "219": "two hundred nineteen",
    "801": "eight hundred one",
    "1316": "one thousand three hundred sixteen",
    "2014": "two thousand fourteen",
    "700000": "seven hundred thousand",
    "1000000": "one million",
    "3000200": "three million two hundred",
    "9001000": "nine million one thousand",
    "123456789": "one hundred twenty three million four hundred fifty six thousand seven hundred eighty nine",
    "2147483647": "two billion one hundred forty seven million four hundred eighty three thousand six hundred forty seven",
    "3000000010": "three billion ten",
    "1234567890123": "one trillion two hundred thirty four billion five hundred sixty seven million eight hundred ninety thousand one hundred twenty three",
    "1 12": "one twelve",
    "a1b": "aone b",
}


def test_numbers(spark):
    rows = spark.createDataFrame(list(NUMBERS.items()), "t string, want string")
    got = rows.select("t", "want", text.squeeze_spaces(text.numbers_to_words(F.col("t"))).alias("got")).collect()
    assert [(r.t, r.got) for r in got] == [(r.t, r.want) for r in got]


@pytest.mark.parametrize(
    "value, want",
    [
        ("a^b-c", "a^b hyphen c"),
        ("x \\u2026 y", "x thousand twenty six y"),
        ("v1.2", "vone point two"),
        ("the, the cat", "the cat"),
        ("THE Cat", "cat"),
        ("the the", ""),
        ("café\tau\nlait", "caf au lait"),
    ],
)
def test_chain(spark, value, want):
    assert one(spark, value, lambda c: text.normalised(c, stopwords=["the"])) == want


def test_url_class_is_a_range(spark):
    assert one(spark, "see http://a.b/c?x=1,y<2;z-q!r end", text.strip_urls) == "see !r end"
    assert one(spark, "file:\\\\x y", text.strip_urls) == " y"


def test_keep_numbers_keeps_everything_else(spark):
    assert one(spark, "A1, b-2!", lambda c: text.normalised(c, numbers=False)) == "a1, b hyphen 2!"


def test_stopwords_keep_repeats_and_inner_blanks(spark):
    assert one(spark, "a the  b a the", lambda c: text.remove_stopwords(c, ["the"])) == "a  b a"


def test_signature_clean_drops_upper_case(spark):
    assert one(spark, "Big cat. it-is the", lambda c: text.clean_for_signature(c, ["the"])) == "ig cat itis"
    assert one(spark, "b a c", text.token_signature) == "a b c"


def test_signature_line(spark):
    line = "2016-04-02\t7\tb a"
    assert one(spark, line, text.signature_line) == "2016-04-02\t7\ta b\t2016-04-02\t7\tb a"


def test_keyword_is_a_substring(spark):
    assert one(spark, "debugging", text.keyword_score) == 1.0
    assert one(spark, "weather", text.keyword_score) == -1.0
    assert len(ATTACK_TERMS) == 43 and ATTACK_TERMS == sorted(ATTACK_TERMS)


def test_filter_does_not_copy_the_chain(spark):
    rows = text.normalise(spark.range(3).select(F.lit("an exploit").alias("tweet")))
    kept = rows.filter(text.keyword_score(F.col("processedTweet")) > 0)
    plan = kept._sc._jvm.PythonSQLUtils.explainString(kept._jdf.queryExecution(), "simple")
    condition = [line for line in plan.split("\n") if "Filter" in line]
    assert kept.count() == 3
    assert not any("regexp_replace" in line for line in condition)


def test_tokens_match_ml_tokenizer(spark):
    from pyspark.ml.feature import Tokenizer

    rows = spark.createDataFrame([("A b  c ",), (" x\ty",), ("q",)], "t string")
    ours = rows.withColumn("ours", text.tokenise(F.col("t")))
    both = Tokenizer(inputCol="t", outputCol="ml").transform(ours)
    assert all(r.ours == r.ml for r in both.collect())
