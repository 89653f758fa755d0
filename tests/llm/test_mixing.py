import random

import numpy as np
import pytest

from readprep.llm.mixing import mix, round_block


def targets(sizes, weights=(1, 2, 3), most=3.0):
    """Water filling by the letter: share, cap, share what is over again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    cap = {s: most * sizes[s] for s in names}
    got, rest, free = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while free and rest > 1e-9:
        unit = rest / sum(weight[s] for s in free)
        rest = 0.0
        for s in list(free):
            got[s] += unit * weight[s]
            if got[s] >= cap[s]:
                rest += got[s] - cap[s]
                got[s] = cap[s]
                free.discard(s)
    return got


@pytest.mark.parametrize("block", [2000, 40])
def test_targets_rates_and_copies(spark, block):
    r = random.Random(3)
    rows = []
    for d in range(900):
        source = r.choices([None, "a", "b", "é", "z", "big"], [1, 2, 1, 3, 1, 12])[0]
        rows.append((d, source, " ".join("w" * r.randrange(1, 4) for _ in range(int(r.expovariate(0.02))))))
    rows += [(None, "a", "x y"), (5, "a", "x y"), (5, "a", "x y"), (2000, "zero", None), (2001, "zero", " \t")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, source string, text string, size int").repartition(3)
    got = mix(df, block_rows=block).collect()
    assert sorted((x.doc_id is None, x.doc_id or 0) for x in got) == sorted((x[0] is None, x[0] or 0) for x in rows)
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").encode().split())
    want = targets(sizes)
    taken = dict.fromkeys(sizes, 0)
    for x in got:
        assert x.source_size == sizes[x.source] and abs(x.target - want[x.source]) <= 1e-6 * max(1, want[x.source])
        assert x.taken == x.copies * x.size and 0 <= x.copies <= 3
        taken[x.source] += x.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(0.02 * want[s], 3 * 900 / block), s
    again = mix(df.repartition(5), block_rows=block).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_one_source_and_empty_table(spark):
    one = mix(spark.createDataFrame([(i, "s", "a b c") for i in range(20)], "doc_id long, source string, text string")).collect()
    assert sum(x.taken for x in one) == 60
    assert mix(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0
    none = mix(spark.createDataFrame([(1, "s", ""), (2, None, None)], "doc_id long, source string, text string")).collect()
    assert [x.taken for x in none] == [0, 0]


def test_round_block_is_close_and_capped():
    rng = np.random.default_rng(0)
    for _ in range(200):
        size = rng.integers(0, 300, rng.integers(1, 60))
        rate = float(rng.uniform(0, 3))
        copies = round_block(size, rng.integers(-(2**62), 2**62, len(size)), rate)
        assert copies.min() >= 0 and copies.max() <= 3
        assert abs((copies * size).sum() - rate * size.sum()) <= max(150, size.max() / 2)
