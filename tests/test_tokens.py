"""Tokens that tasks make of texts are those of the column expression."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from notegraph.functions import text as T

TEXTS = [
    "", None, " ", "One two_three 4x", "'tis\t\n-a", "Straße ÉCOLE éáb á ́́", "ΣΑΣ σας ΑΣ.", "İstanbul ıI ŉ ǅ ﬁ ﬀx", "日本語 テスト x1", "😀a😀b 𝒳y ½ ² x²y", "Ấ ǖ ḹ ṩx", "привет МИР-ёж",
    "a​b—c €5 ₿x", "مرحبا ١٢ x", "end", "start", "नमस्ते कि", "ⅷ Ⅷ ① aำb", "x y\u0085z", "K Å ſ",
]


def test_split_tokens_gives_index_tokens(spark):
    rng = random.Random(5)
    letters = [*"aZ09_'- éÉñßσςΣ½ёЖ́ͅ€—日\U0001f600İ"]
    texts = TEXTS + ["".join(rng.choices(letters, k=rng.randrange(12))) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.index_tokens(F.col("t")).alias("want"), T.token_source(F.col("t")).alias("source"))
    rows = df.orderBy("i").collect()
    source = pa.array([r.source for r in rows])
    for begin, end in ((0, len(rows)), (3, 4), (7, 300), (0, 1)):
        tokens, sizes = T.split_tokens(source.slice(begin, end - begin))
        got, at = tokens.to_pylist(), 0
        for r, n in zip(rows[begin:end], sizes):
            assert got[at : at + n] == list(r.want), (r.i, texts[r.i])
            at += n
        assert at == len(got)
    plain = pa.array(["ab c", "", "d", "e f"])
    tokens, sizes = T.split_tokens(plain)
    assert tokens.to_pylist() == ["ab", "c", "d", "e", "f"] and sizes.tolist() == [2, 0, 1, 2]
