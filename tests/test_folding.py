"""Folding of names and queries, and aliases of any length."""

from pyspark.sql import functions as F

from lumenledger.functions import folding
from lumenledger.operators import retrieval


def test_folding(spark):
    cases = {
        "ﬁne Ｆｕｌｌ－Ｗｉｄｔｈ": "fine full width", "STRASSE straße": "strasse strasse", "a b—c…d": "a b c d", "①²": "12", "x+y=$": "x+y=$", "!?": None, "": None, "é": "é", "a​b": None, "ͅ": "ι",
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    got = {r.t: r.f for r in df.select("t", folding.fold_alias(F.col("t")).alias("f")).collect()}
    assert got == cases | {None: None}
    two = spark.createDataFrame([("a\tb\n C\x1cd",)], "t string").select(folding.fold_query(F.col("t")), folding.fold_alias(F.col("t"))).first()
    assert tuple(two) == ("a b c d", None)


def test_query_digests_compose(spark):
    df = spark.createDataFrame([("é\r\nx",), ("é\nx",), ("É\nx",), (" \n",), (None,)], "t string")
    a, b, c, d, e = (r[0] for r in df.select(folding.query_digest(F.col("t"))).collect())
    assert a == b != c and d is None and e is None


def test_aliases_of_any_length(spark):
    long = " ".join(f"w{i}" for i in range(12))
    aliases = spark.createDataFrame([(long, 1), ("w3 w4", 2), ("w3 w4", 3), ("zz", 4)], "phrase string, concept long")
    asked = spark.createDataFrame([(1, f"so {long.upper()}."), (2, "w3, w4"), (3, None)], "q long, text string")
    got = retrieval.recognise(asked, aliases, "q", words=F.split(folding.fold_query(F.col("text")), " "))
    assert sorted((r.q, r.phrase, r.concepts, r.concept) for r in got.collect()) == [(1, long, 1, 1), (1, "w3 w4", 2, None), (2, "w3 w4", 2, None)]
