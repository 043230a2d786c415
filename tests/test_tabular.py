"""The table function: columns by kind, errors before any row, and the same rows as the operators give."""

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import tabular
from tallyloom.operators import documents as D


def test_rows_equal_the_operators(spark):
    tabular.register(spark)
    texts = ["", None, "Art. 1\nx\n\n art. 2.\r  Punctul IV) abc\ny", "La articolul 5 alin. (2)\nș\nAnexa\nANEXA NR. 3 și atât\n", "\n \nfără nimic\nCapitolul II\nTitlul 3 x", "Articol unic\nArticol unic", "art. 1\tb"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    same = lambda a, b: sorted(map(repr, a.select(*sorted(a.columns)).collect())) == sorted(map(repr, b.select(*sorted(b.columns)).collect()))
    got = spark.sql("select d.doc_id, p.* from {df} d, lateral bill_text(d.text, 'parts') p", df=df)
    want = D.bill_parts(df).drop("slug").withColumns({c: F.col(c).cast("int") for c in ("place", "starts", "ends")})
    assert same(got, want) and got.count() == 10
    got = spark.sql("select d.doc_id, s.* from {df} d, lateral bill_text(d.text, 'sections') s", df=df.where("text is not null"))
    assert same(got, D.sections(df.where("text is not null")))


def test_wrong_calls_fail_before_they_run(spark):
    tabular.register(spark)
    for call in ("bill_text('x', 'chapters')", "bill_text(1, 'parts')", "bill_text('x', 'parts', 'y')"):
        with pytest.raises(Exception, match="bill_text|heading"):
            spark.sql(f"select * from {call}").schema  # noqa: B018
