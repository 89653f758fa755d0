import os
import random

import numpy as np
import pyarrow as pa
import pytest

from readprep.llm import sentencepiece as S

TEXTS = ["", None, " ", "  two  spaces ", "a\nb\tc", "é😀 中文字符", "naïve café", "x" * 700, "0123456789 " * 50, "日本語" * 100, "The quick brown fox.", "\x00\x7f", "a▁b"]


def toy(splits=True):
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, S.BYTE) for b in range(256)]
    pieces += [("▁", -3.0, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("ab", -3.0, 1), ("▁a", -3.5, 1), ("▁ab", -4.0, 1), ("ba", -3.2, 1), ("bab", -4.4, 1), ("é", -5.0, 1), ("abab", -6.6, 1)]
    return S.make_pieces(pieces if splits else [*pieces, ("a▁b", -2.0, 1)])


def brute(text: str, m: S.Pieces) -> float:
    """The best total score, by every way of cutting."""
    raw = (" " + text).encode() if text else b""
    pieces = {m.data[m.first[i] : m.first[i + 1]].tobytes(): m.score[i] for i in range(258, len(m.first) - 1)}
    chars = (" " + text) if text else ""
    best = {0: 0.0}
    at = 0
    for c in chars:
        if at in best:
            for n in range(1, 12):
                p = raw[at : at + n]
                if len(p) == n and p in pieces:
                    best[at + n] = max(best.get(at + n, -1e18), best[at] + pieces[p])
            n = len(c.encode())
            if raw[at : at + n] not in pieces:
                best[at + n] = max(best.get(at + n, -1e18), best[at] + m.unknown_score)
        at += len(c.encode())
    return best[len(raw)]


def value(ids, m):
    """The score of an encoding, its bytes counted as whole characters."""
    total, raw = 0.0, b""
    byte = {int(b): i for i, b in enumerate(m.byte_id)}
    for i in ids:
        if int(i) in byte:
            raw += bytes([byte[int(i)]])
            try:
                raw.decode()
                total, raw = total + m.unknown_score, b""
            except UnicodeDecodeError:
                pass
        else:
            total += m.score[i]
    return total


@pytest.mark.parametrize("splits", [True, False])
def test_best_score_and_round_trip(splits):
    m = toy(splits)
    assert m.splits == splits
    r = random.Random(4)
    texts = ["".join(r.choice("ab  éz") for _ in range(r.randrange(0, 14))) for _ in range(300)]
    ids, first = S.encode(pa.array(texts), m)
    data, ends = S.decode(ids, first, m)
    for i, t in enumerate(texts):
        assert data[ends[i] : ends[i + 1]].tobytes().decode() == t
        assert abs(value(ids[first[i] : first[i + 1]], m) - brute(t, m)) < 1e-9, t


def test_long_stretches_equal_short_ones(monkeypatch):
    m = toy()
    texts = ["ab" * 40 + "é" * 9 + "ba" * 30, "b" * 50, "ab ab"]
    a = S.encode(pa.array(texts), m)
    monkeypatch.setattr(S, "LONG", 10)
    b = S.encode(pa.array(texts), m)
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


needs_model = pytest.mark.skipif(not os.path.exists(S.MODEL), reason="no tokenizer file")


@needs_model
def test_equals_the_library():
    """The same pieces as a unigram model of the library, which sums in single precision: scores are kept small for it."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(S.MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:
        if p.score < -1e6:
            p.score = -40000.0
        p.score /= 4096  # exact, and sums stay exact too
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    m = S.make_pieces([(p.piece, p.score, p.type) for p in proto.pieces])
    r = random.Random(1)
    texts = [t for t in TEXTS if t and "\x00" not in t] + [" ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(1, 9))) for _ in range(40)) for _ in range(50)]
    ids, first = S.encode(pa.array(texts), m)
    for i, t in enumerate(texts):
        assert ids[first[i] : first[i + 1]].tolist() == library.encode(t), t


@needs_model
def test_queries_round_trip(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "no id", 1), (3, "again", 1)], "doc_id long, text string, ids int")
    enc = S.encode_texts(df)
    rows = enc.collect()
    assert len(rows) == len(TEXTS) + 2
    assert all(r.round_trip == (r.doc_id != TEXTS.index("a▁b")) for r in rows)
    assert {r.n_pieces for r in rows if r.doc_id in (0, 1)} == {0}
    back = {(r.doc_id, r.text) for r in S.decode_ids(enc).collect()}
    want = {(i, (t or "").replace("▁", " ")) for i, t in enumerate(TEXTS)} | {(None, "no id"), (3, "again")}
    assert back == want
    assert S.encode_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_double_array_holds_exactly_its_keys():
    r = random.Random(9)
    keys = {bytes(r.choice(b"abc\xe9\x00") for _ in range(r.randrange(1, 6))): i for i in range(500)}
    base, check, value_ = S.double_array(keys)

    def look(key):
        s = 0
        for b in key:
            t = base[s] + b
            if check[t] != s:
                return -1
            s = t
        return value_[s]

    assert all(look(k) == v for k, v in keys.items())
    others = [bytes(r.choice(b"abcd\xe9\x00") for _ in range(r.randrange(1, 7))) for _ in range(2000)]
    assert all(look(o) == keys.get(o, -1) for o in others)
    assert np.iinfo(np.int32).max > base.max()


def test_ranks_become_log_probabilities():
    got = S.log_scores([0.0, -1.0, -2.0, -1e9, -7.0])
    assert np.isclose(np.exp(got).sum(), 1) and got[0] > got[1] > got[2] > got[4] > got[3]
    m = S.load()
    assert -25 < m.score.min() and m.score.max() <= 0 and m.unknown_score == m.score[m.score < 0].min() - S.UNKNOWN_PENALTY


def test_equal_hashes_are_told_apart(monkeypatch):
    m = S.load()
    column = pa.array(["one two three", "ab cd  ef", None, "", "two one"])
    want = [x.tolist() for x in S.encode(column, m)]
    monkeypatch.setattr(S, "_hashes", lambda stream, start, length: (np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)))
    assert [x.tolist() for x in S.encode(column, m)] == want
