import hashlib

import pytest

from readprep.llm.exact_dedup import exact_dedup

UP = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute(rows, keep):
    pick = max if keep == "largest" else min
    groups = {}
    for doc, text in rows:
        groups.setdefault((text or "").translate(UP), []).append(doc)
    out = []
    for body, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = pick(known) if known else None
        for n, i in enumerate(sorted(ids, key=lambda i: i != best)):
            out.append((i, best, len(ids), n == 0, hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = [(1, "A b"), (2, "a B"), (3, "É"), (4, "é"), (5, None), (6, ""), (7, "x" * 300_000), (8, "X" * 300_000), (9, "x" * 300_001), (None, "a b"), (None, None), (9, "x" * 300_001), (None, "lone"), (None, "LONE")] + [(100 + i, "hot text " + "same " * 20) for i in range(40)]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("hot", [1000, 5, 2])
def test_matches_brute_force(spark, keep, hot):
    df = spark.createDataFrame([(*r, 1, "x") for r in ROWS], "doc_id long, text string, salt int, `Body` string").repartition(3)
    got = sorted((tuple(r) for r in exact_dedup(df, keep=keep, hot_rows=hot, salts=4).collect()), key=repr)
    assert got == brute(ROWS, keep)


def test_carry_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", "p"), (2, "A", "q")], "doc_id long, text string, x string").toDF("doc_id", "text", "text")
    got = exact_dedup(df, carry=True).where("kept").collect()
    assert [tuple(r)[-3:] for r in got] == [(1, "a", "p")]


def test_empty_table(spark):
    assert exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
