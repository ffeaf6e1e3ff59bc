"""G3_shuffle_some equals its SQL where texts are null or hold white space only: such a document has no row."""

import duckdb
import pytest

from corpusloom.functions import text as T
from corpusloom.plans import catalog

from test_queries import rows_of

NAME = "G3_shuffle_some"
BLANK = [" ", "\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x1f", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u2029", "\u202f", "\u3000"]
OTHER = ["\0", "\x01", "\x1b", "\x7f", "\u180e", "\u200b", "\ufeff", "\U0001f600"]


def test_equals_its_sql(spark, tmp_path):
    texts = [None, "", " \n\t ", "".join(BLANK), "a", " a ", "a b c d e f g h", *BLANK, *OTHER, *(f"{x}a{x}" for x in BLANK)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    df = catalog.queries()[NAME](spark, str(tmp_path))
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = duck.sql(catalog.oracle_sql()[NAME])
    got = rows_of(df.columns, df.collect())
    assert got == rows_of(want.columns, want.fetchall())
    assert len(got) == 3 + len(OTHER) + len(BLANK)


@pytest.mark.parametrize("chars, has", [(BLANK, False), (OTHER, True)])
def test_has_words(spark, chars, has):
    rows = spark.createDataFrame([(x,) for x in chars], "text string")
    assert {tuple(r) for r in rows.select(T.has_words("text"), T.n_words("text") > 0).collect()} == {(has, has)}


def test_has_words_of_null(spark):
    assert spark.sql("select cast(null as string) as text").select(T.has_words("text")).first()[0] is None
