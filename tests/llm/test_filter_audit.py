"""The filter audit against plain loops on odd rows, and against its SQL on driver tables."""

from __future__ import annotations

import os
import re
from itertools import permutations

import duckdb
import pytest

from reelgrid.llm import filter_audit, queries

DIR = "/root/testdata/sf0.001"


def _plain(rows, labels):
    docs = [(i, text or "", lang or "") for i, text, lang in rows]
    marked = []
    for i, text, lang in docs:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        failed = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and any(j is not None and j < i and other == text for j, other, _ in docs),
        }
        mine = [x for x in labels if x[0] == i and i is not None]
        marked.append((lang, {f for f in failed if failed[f]}, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out, shapley = [], {}
    for part in {m[0] for m in marked}:
        own = [m for m in marked if m[0] == part]
        for order in permutations("ABCDE"):
            alive = own
            for step, f in enumerate(order, 1):
                gone = [m for m in alive if f in m[1]]
                redundant = sum(f in m[1] for m in own) - len(gone)
                alive = [m for m in alive if f not in m[1]]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                out.append([part, "".join(order), step, len(alive), len(gone), redundant, sum(m[1] == {f} for m in own), sum(m[2] for m in gone), sum(m[3] for m in gone)])
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def test_against_plain_loops(spark, documents, odd_documents):
    more = [(600, "A B C", "en"), (601, " ".join(f"w{i}" for i in range(120)), "en"), (602, "a | b " * 60, None), (603, " ".join(f"w{i}" for i in range(120)), ""), (604, "X" * 100_000, "fr")]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (602, 1, 1), (603, None, 1), (None, 1, 1), (600, 1, None)]
    table = documents.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string"), allowMissingColumns=True)
    got = filter_audit.audit(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(map(tuple, got.collect())) == _plain([r[:3] for r in odd_documents] + more, labels)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert filter_audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables")
def test_against_sql(spark):
    got = queries.queries()["op11_filter_interaction_audit"](spark, DIR)
    duck = duckdb.connect()
    for t in ("documents", "labels"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    res = duck.execute(queries.oracle_sql()["op11_filter_interaction_audit"])
    assert [d[0] for d in res.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(res.fetchall())
