import collections
import random
import re
from itertools import groupby

import pytest

from readprep.llm import quotes
from readprep.llm.quotes import link_quotes

ROWS = [
    (1, 0, "a", "Shall we meet?\nAt noon or later."),
    (1, 1, "b", "> Shall we  MEET?\n> At noon or later.\nNoon is fine."),
    (1, 2, "c", "An aside."),
    (1, 3, "a", ">> Shall we meet?\n>> At noon or later.\n> Noon is fine.\nGood."),
    (1, 4, "c", "> At noon or later.\n\n> nobody said this\nLater for me."),
    (1, 5, "b", "> > Shall we meet?\nOnly the old one."),
    (2, 0, "a", "> An aside.\nother conversation"),
    (2, 1, "a", None),
    (2, 2, "b", ""),
    (2, 3, "b", "same"),
    (2, 4, "b", "same"),
    (2, 5, "a", "> same"),
    (None, 1, "a", "x"),
    (None, 2, "a", "> x"),
    (3, None, "a", "no turn"),
    (3, 1, "a", "one"),
    (3, 1, "a", "one"),
]


def test_links_threads_and_bodies(spark):
    df = spark.createDataFrame([(*r, 7) for r in ROWS], "conv_id long, turn long, role string, text string, root int").repartition(3)
    got = {(r.conv_id, r.turn): r for r in link_quotes(df).collect()}
    assert len(got) == len(set(ROWS))
    reply = {k: r.reply_to for k, r in got.items()}
    assert reply[1, 1] == 0 and reply[1, 3] == 1 and reply[1, 4] == 0 and reply[1, 5] == 0
    assert reply[1, 0] is None and reply[1, 2] is None and reply[2, 0] is None and reply[None, 2] is None
    assert reply[2, 5] == 4
    assert [got[1, t].depth for t in range(6)] == [0, 1, 0, 2, 1, 1]
    assert [got[1, t].root for t in range(6)] == [0, 0, 2, 0, 0, 0]
    order = sorted((r.place, r.turn) for k, r in got.items() if r.conv_id == 1)
    assert order == [(1, 0), (2, 1), (3, 3), (4, 4), (5, 5), (6, 2)]
    assert got[1, 3].body == "Good." and got[1, 3].n_quoted == 3 and got[1, 3].n_passages == 2 and got[1, 3].n_linked == 2
    assert got[1, 4].n_passages == 2 and got[1, 4].n_linked == 1 and got[1, 4].body == "\nLater for me."
    assert got[2, 1].body == "" and got[2, 5].body == ""
    assert (got[3, 1].place, got[3, None].place) == (1, 2)


def test_origins_across_blocks_of_turns(spark):
    rows = [(1, 5, "a", "far away"), (1, 5000, "b", "> far away"), (1, 5001, "a", "far away"), (1, 9000, "b", "> far away\nyes")]
    got = {r.turn: r.reply_to for r in link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {5: None, 5000: 5, 5001: None, 9000: 5001}


def test_long_chain_of_replies(spark):
    rows = [(1, 0, "a", "m0")] + [(1, i, "a", f"> m{i - 1}\nm{i}") for i in range(1, 70)]
    got = {r.turn: (r.root, r.depth) for r in link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {i: (0, i) for i in range(70)}


def test_empty_table(spark):
    assert link_quotes(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def brute(rows):
    """The same for conversations of one row a turn, message by message."""
    said, replies, out = {}, {}, {}
    parsed = {}
    for conv, turn, role, text in rows:
        lines = []
        for line in re.split(r"\r\n|\n|\r", text or ""):
            marks = re.match(r"(?:[ \t]{0,3}>)*", line)[0]
            rest = line[len(marks) :]
            lines.append((marks.count(">"), rest, re.sub(r"\s+", " ", rest).strip().lower()))
        runs = []
        for blank, group in groupby(lines, key=lambda x: (x[2] == "", x[0])):
            if not blank[0]:
                runs.append((blank[1], [x[2] for x in group]))
        parsed[conv, turn] = lines, runs
        for level, norms in runs:
            if not level:
                for norm in {" ".join(norms), *norms}:
                    said.setdefault((conv, norm), set()).add(turn)
    for (conv, turn), (_, runs) in parsed.items():
        latest = lambda norm: max((t for t in said.get((conv, norm), ()) if t < turn), default=None)  # noqa: E731, B023
        linked = []
        for level, norms in runs:
            if level:
                whole, sizes = latest(" ".join(norms)), collections.Counter()
                for norm in norms:
                    sizes[latest(norm)] += len(norm)
                found = [(t == whole, sizes[t], t) for t in {whole, *sizes} if t is not None]
                if found:
                    linked.append((level, *max(found)[1:]))
        weight = collections.Counter()
        for level, size, origin in linked:
            weight[level, origin] += size
        best = max(((-level, size, origin) for (level, origin), size in weight.items()), default=None)
        replies[conv, turn] = best and best[2]
        out[conv, turn] = [sum(x[0] > 0 for x in parsed[conv, turn][0]), sum(level > 0 for level, _ in runs), len(linked)]
    for (conv, turn), (lines, _) in parsed.items():
        root, depth = turn, 0
        while replies[conv, root] is not None:
            root, depth = replies[conv, root], depth + 1
        out[conv, turn] = (replies[conv, turn], root, depth, *out[conv, turn], "\n".join(x[1] for x in lines if not x[0]).rstrip(" "))
    places = {}
    for conv in {c for c, _ in out}:
        order = sorted((out[k][1], k[1]) for k in out if k[0] == conv)
        places |= {(conv, turn): i for i, (_, turn) in enumerate(order, 1)}
    return {k: (places[k], *v) for k, v in out.items()}


@pytest.mark.parametrize("block", [1024, 3])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(quotes, "BLOCK", block)
    r = random.Random(block)
    rows, phrases = [], [f"phrase number {i} of some length {'x' * (i % 5)}" for i in range(12)]
    for conv in range(12):
        texts: list[str] = []
        for turn in range(r.randrange(1, 14)):
            lines = []
            for _ in range(r.randrange(0, 4)):
                if texts and r.random() < 0.6:  # part of an earlier message, one level deeper
                    old = r.choice(texts).split("\n")
                    a = r.randrange(len(old))
                    lines += [r.choice(["> ", ">", " > "]) + x for x in old[a : a + r.randrange(1, 4)]]
                lines += r.choices([*phrases, "", "  Phrase  NUMBER 3 of some length xxx", "> never said"], k=r.randrange(0, 3))
            texts.append("\n".join(lines))
            rows.append((conv, turn * 2, r.choice("ab"), texts[-1]))
    rows.append((99, 0, "a", "word " * 30_000 + "\nend"))
    rows.append((99, 1, "b", "> end\n> " + "word " * 30_000))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = {(x.conv_id, x.turn): (x.place, x.reply_to, x.root, x.depth, x.n_quoted, x.n_passages, x.n_linked, x.body) for x in link_quotes(df).collect()}
    want = brute(rows)
    assert got == want and sum(v[1] is not None for v in want.values()) > 20
