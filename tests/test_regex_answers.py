"""F14 in regex mode over accented texts, as its SQL reads them: a dot is a character of the text."""

import duckdb

from corpusloom.plans import texts

DOCS = [(1, "xx un éch Un"), (2, "yy la. Éèai La"), (3, "zz un êçch Un"), (4, "nothing of it")]
ITEMS = [(1, "Un êçch aa bb cc dd ee"), (2, "La. Éai aa bb cc dd ee")]


def test_query_matches_its_sql(spark, tmp_path):
    con = duckdb.connect()
    for name, key, rows in (("documents", "doc_id", DOCS), ("benchmark", "item_id", ITEMS)):
        spark.createDataFrame(rows, f"{key} bigint, text string").write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    got = texts.QUERIES["F14_regex_answer"](spark, str(tmp_path)).select("qid", "doc_id", "has_answer").collect()
    want = con.execute(f"select qid, doc_id, has_answer from ({texts.SQL['F14_regex_answer']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
    assert {(q, d) for q, d, hit in want if hit} == {(1, 3), (2, 2)} and {(1, 1), (2, 2)} <= {(q, d) for q, d, _ in want}
