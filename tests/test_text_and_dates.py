import pytest
from pyspark.sql import functions as F

from notegraph.functions import dates, text


def one(spark, expression, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "t string").select(expression).collect()]


@pytest.mark.parametrize("written, day", [
    ("2026-08-31", "2026-08-31"), ("31-08-2026", "2026-08-31"), ("31.08.2026", "2026-08-31"), ("31-08-26", "2026-08-31"), ("31.08.26", "2026-08-31"), ("2026-08-31 Standup", "2026-08-31"),
    ("Meeting_31.08.26", "2026-08-31"), ("2026-08-31-Retro", "2026-08-31"), ("1.2.98", "1998-02-01"), ("39-01-2020 01-02-2020", "2020-02-01"), ("29-02-2024", "2024-02-29"), ("x 5.6.39", "2039-06-05"),
    ("v1.2.26", None), ("Note-1.2.26", None), ("31-08.2026", None), ("32-13-2026", None), ("29-02-2025", None), ("0000-01-01", None), ("", None), (None, None),
])
def test_find_date(spark, written, day):
    assert one(spark, dates.find_date(F.col("t")).cast("string"), written) == [day]


def test_parse_bound():
    assert str(dates.parse_bound(" 31.01.26 ")) == "2026-01-31" and str(dates.parse_bound("2024-02-29")) == "2024-02-29"
    with pytest.raises(ValueError):
        dates.parse_bound("29-02-2025")


def test_query_terms(spark):
    got = one(spark, text.query_terms(F.col("t")), "What about the API?", "and OR and", "O'Brien’s snake_case", "?!", "Ünïcode x2")
    assert got == [["what", "about", "the", "api"], ["and", "or"], ["o'brien’s", "snake", "case"], [], ["ünïcode", "x2"]]
    assert len(one(spark, text.query_terms(F.col("t")), " ".join(f"w{i}" for i in range(50)))[0]) == 32


def test_match_string(spark):
    assert one(spark, text.match_string(F.col("t")), "find -this NOT", "") == ['"find" OR "this" OR "not"', ""]


def test_folding_keeps_what_does_not_decompose(spark):
    assert one(spark, F.array_join(text.index_tokens(F.col("t")), " "), "Éñ ß ø Đ ΣΑΣ ǽ ï", None) == ["en ß ø đ σασ ǽ i", ""]


def test_estimate_tokens(spark):
    assert one(spark, text.estimate_tokens(F.col("t")), "", "a" * 7, "é" * 8) == [1, 3, 6]


def test_snippet(spark):
    df = spark.createDataFrame([("a " * 50 + "needle " + "b " * 50, ["needle"]), ("short", ["x"]), ("c " * 100, ["zzz"])], "b string, t array<string>")
    got = [r[0] for r in df.select(text.snippet(F.col("b"), F.col("t"), 30)).collect()]
    assert got == ["... a a a a a needle b b b b b b b ...", "short", "c c c c c c c c c c c c c c c  ..."]


def test_dates_behind_white_space_beyond_ascii(spark):
    texts = ["Meeting\u00a02026-08-31", "x\u20033.4.2023\u2003y", "no2026-08-31"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [str(r[0]) for r in df.select(dates.find_date(F.col("t"))).collect()] == ["2026-08-31", "2023-04-03", "None"]
    df = spark.createDataFrame([("a/b.md", {"date": ["\u00a02024-05-06\u2003"]})], "p string, f map<string, array<string>>")
    assert str(df.select(dates.note_date(F.col("p"), F.col("f"))["date"]).first()[0]) == "2024-05-06"
