"""Queries on what their first form cut off or let pass."""

import numpy as np
import pytest

from corpusloom.operators import search
from corpusloom.plans import dense


@pytest.mark.parametrize("name", sorted(dense.INDEXES))
def test_indexes_find_the_exact_neighbours(name, spark):
    sf = "/root/testdata/sf0.1"
    assert dense.measured_recall(dense.INDEXES[name], spark, sf).first()["recall"] >= 0.9
    rows = dense.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    assert sum(r["found"] for r in rows) >= 0.9 * sum(r["wanted"] for r in rows)


def test_caption_ranks_count_every_query(spark):
    sf = "/root/testdata/sf0.001"
    q, c = dense.split(spark, sf)
    qs, cs = q.collect(), c.collect()
    x, y = (np.array([r["embedding"] for r in rows], np.float64) for rows in (qs, cs))
    s = np.round((x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T, 9)
    want = {}
    for i, r in enumerate(qs):
        order = sorted((j for j in range(len(cs)) if cs[j]["doc_id"] != r["qid"]), key=lambda j: (-s[i, j], cs[j]["doc_id"]))
        want[r["qid"]] = 1 + next(n for n, j in enumerate(order) if cs[j]["doc_id"] - r["qid"] in (1, 2, 3))
    assert {r["qid"]: r["r"] for r in search.own_ranks(q, c, dense._own(q)).collect()} == want
    got = dense.QUERIES["A34_caption_ranks_whole"](spark, sf).first()
    assert max(want.values()) > 100
    assert got["median_rank"] == int(np.floor(np.median(list(want.values())) - 1)) + 1 and got["r10"] == pytest.approx(100 * np.mean([w <= 10 for w in want.values()]))
    assert search.own_ranks(q, c.where("doc_id > 100"), dense._own(q)).count() == len(qs)
