"""Piece ids, resampling and hard negatives against plain versions."""
import hashlib
import importlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from glasspane.llm import negatives, pieces, resample
from glasspane.llm import queries as Q

from .conftest import LONG, ODD

# --- pieces


@pytest.fixture(scope="session")
def model():
    return importlib.import_module("public_tokenizers").path("piece_bpe_32k.model")


@pytest.fixture(scope="session")
def library(model):
    return sentencepiece.SentencePieceProcessor(model_file=model)


def test_pieces_of_every_document(spark, sf, table, library):
    got = {r["doc_id"]: r for r in Q.piece_ids(spark, sf).collect()}
    rows = table("SELECT doc_id, text FROM documents")
    assert len(got) == len(rows)
    for d, t in rows:
        ids = library.encode(t or "")
        assert got[d]["agrees"] and got[d]["n_tokens"] == len(ids)
        assert got[d]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[d]["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_pieces_of_made_texts(model):
    v, r = pieces.Vocabulary(pieces.model_bytes(model)), random.Random(3)
    parts = list(" ▁ab\n\t\0é日本\U0001f600́�xyz") + ["the", "ing", " in", "   ", "a" * 40, "=" * 70, "ab" * 50]
    for _ in range(3000):
        texts = ["".join(r.choice(parts) for _ in range(r.randrange(20))) for _ in range(2)]
        assert v.encode(texts) == v.library.encode(texts)
        ids = [r.randrange(300) if r.random() < 0.5 else r.randrange(32000) for _ in range(r.randrange(12))]
        assert v.decode(ids) == v.library.decode(ids)
    texts = ["a" * 300_000, "=" * 300_000, "word " * 50_000]
    assert v.encode(texts) == v.library.encode(texts)
    assert max(map(len, v.known)) <= pieces.LONG


def field(number, value):
    if isinstance(value, int):
        return bytes([number << 3 & 127 | 128, number >> 4]) + bytes([value])
    if isinstance(value, float):
        return bytes([number << 3 | 5]) + struct.pack("<f", value)
    return bytes([number << 3 | 2]) + varint(len(value)) + value


def varint(n):
    return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)


def made_model(words, scores, kind=2, front=1, squeeze=0, types=None):
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(w, s, (types or {}).get(w, 1)) for w, s in zip(words, scores)]
    body = b"".join(field(1, field(1, w.encode()) + field(2, float(s)) + field(3, k)) for w, s, k in rows)
    return body + field(2, field(3, kind)) + field(3, field(1, b"identity") + field(3, front) + field(4, squeeze) + field(5, 1))


@pytest.mark.parametrize("front, squeeze", [(0, 0), (1, 0), (0, 1), (1, 1)])
def test_pieces_of_made_vocabularies(front, squeeze):
    """Equal scores, unknown symbols, pieces with spaces inside."""
    r = random.Random(front * 2 + squeeze)
    for _ in range(60):
        words = list(dict.fromkeys([*"ab▁", *("".join(r.choice("abc▁") for _ in range(r.randrange(2, 5))) for _ in range(25))]))
        v = pieces.Vocabulary(made_model(words, [-float(r.randrange(6)) for _ in words], front=front, squeeze=squeeze))
        for _ in range(40):
            t = "".join(r.choice("aabbcd  ") for _ in range(r.randrange(80)))
            ids = v.library.encode(t)
            assert v.encode([t]) == [ids], (words, t)
            assert v.decode(ids) == v.library.decode(ids), (words, t)


def test_other_vocabularies_are_refused():
    for m in (made_model("ab", [0, 0], kind=1), made_model("ab", [0, 0], types={"a": 4}), made_model("ab", [0, 0], types={"b": 5})):
        with pytest.raises(ValueError):
            pieces.Vocabulary(m)


def test_pieces_of_odd_rows(spark, odd, none, model, library):
    rows = pieces.encode(odd, model)
    assert rows.columns == ["doc_id", "ids", "agrees"] and pieces.encode(none, model).count() == 0
    want = Counter((d, tuple(library.encode(t or ""))) for d, t, *_ in ODD)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows.collect()) == want
    assert Counter((r["doc_id"], r["text"]) for r in pieces.decode(rows, model).collect()) == Counter((d, t or "") for d, t, *_ in ODD)
    ids = spark.createDataFrame([(1, None), (2, []), (3, [1, 259, None]), (4, [40000, 259]), (None, [-5])], "doc_id long, ids array<int>")
    assert {(r["doc_id"], r["text"], r["agrees"]) for r in pieces.decode(ids.withColumn("text", F.lit("own")), model).collect()} == {
        (1, "", True), (2, "", True), (3, " ", False), (4, " ", False), (None, "", False)}


# --- resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(t, buckets, longest):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return len(w), [zlib.crc32(" ".join(w[i:i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def plain_resample(rows, target, percent, seed, buckets=10000, longest=1, least_words=20):
    feats = [(d, *plain_features(t, buckets, longest)) for d, t in rows]
    s, t = Counter(b for _, _, f in feats for b in f), Counter(b for x in target for b in plain_features(x, buckets, longest)[1])
    ss, tt = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets)))) for b in s}
    out = []
    for d, n, f in feats:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((x for x in out if x[5] >= least_words), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
    for k, x in enumerate(able[:percent * len(able) // 100]):
        x[4] = k + 1
    return Counter(tuple(x[:5]) for x in out)


def as_counter(df):
    return Counter(tuple(r) for r in df.collect())


def test_drawn_documents(spark, sf, table):
    want = plain_resample(table("SELECT doc_id, text FROM documents"), [x for x, in table("SELECT text FROM benchmark", "benchmark")], 10, 2024)
    assert as_counter(Q.draw_like_benchmark(spark, sf)) == want


def test_drawn_odd_rows_with_longer_runs(spark, odd, none):
    wide = [(10, "wörd " * 30 + "x" * 5000 + " É É", "en", "s", 1), (11, "= ! \x00\x7f", "en", "s", 1), (12, ("y" * 70 + " b-c ") * 9, "en", "s", 1)]
    more = spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, n_chars long")
    docs, target = odd.select("doc_id", "text", "label", "score").unionByName(more.select("doc_id", "text", F.lit(0).alias("label"), F.lit(0).alias("score"))), ["same words here", None, "x0 y0 y1 w1"]
    goal = spark.createDataFrame([(x,) for x in target], "text string").withColumn("doc_id", F.lit("own"))
    rows = [(d, t) for d, t, *_ in ODD + wide]
    for buckets, longest, least in ((50, 3, 3), (7, 1, 0)):
        assert as_counter(resample.resample(docs, goal, 50, 7, buckets, longest, least)) == plain_resample(rows, target, 50, 7, buckets, longest, least)
    assert as_counter(resample.resample(docs, goal.limit(0), 100, 7)) == plain_resample(rows, [], 100, 7)
    assert resample.resample(none, goal, 10, 7).count() == 0


@pytest.mark.parametrize("chunk", [4, 1 << 14])
def test_radix_order(spark, monkeypatch, chunk):
    monkeypatch.setattr(resample, "CHUNK", chunk)
    r, top = random.Random(chunk), 2**63 - 1
    for pick, bits in ((lambda: r.choice([-3, -2, 0, 0, 0, 900]), 5), (lambda: r.choice([None, -top - 1, top, 0, 5]), 11), (lambda: None, 5)):
        monkeypatch.setattr(resample, "DIGIT", bits)
        rows = [(pick(), pick(), i) for i in range(150)]
        got = resample.radix_ranked(spark.createDataFrame(rows, "a long, b long, tag long").repartition(5, "tag"), ["a", "b"]).collect()
        assert sorted(x["position"] for x in got) == list(range(150))
        order = [(x["a"], x["b"]) for x in sorted(got, key=lambda x: x["position"])]
        assert order == sorted(((a, b) for a, b, _ in rows), key=lambda x: [(v is None, v or 0) for v in x])


def test_one_frequent_digit_is_split(spark):
    """A third and more of equal keys: no chunk of positions is larger than CHUNK."""
    rows = spark.range(60_000).selectExpr("if(id % 3 = 0, 7L, id) AS a", "id AS b")
    got = resample.radix_ranked(rows, ["a", "b"]).selectExpr("count(distinct position) AS n", "max(position) AS top").first()
    assert tuple(got) == (60_000, 59_999)


# --- hard negatives

def plain_mine(rows, is_anchor, low, high, positives, negatives_, scale=256):
    rows = [(i, lab, [math.floor(scale * float(x)) for x in v]) for i, v, lab in rows
            if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    after = lambda x: (-x[0], x[1] is None, x[1] or 0)
    clip = lambda s: max(1 - 2**63, min(2**63 - 1, s))
    out = Counter()
    for k, (a, lab, v) in enumerate(rows):
        if not is_anchor(a):
            continue
        every = [(clip(sum(x * y for x, y in zip(v, w))), i, m == lab) for j, (i, m, w) in enumerate(rows) if j != k]
        for ps, p, _ in sorted((x for x in every if x[2]), key=after)[:positives]:
            inside = sorted((x for x in every if not x[2] and low * ps <= 100 * x[0] <= high * ps), key=after)
            out.update((a, p, n + 1, x[1], ps, x[0]) for n, x in enumerate(inside[:negatives_]))
    return out


TYPE = "vec_id long, embedding array<float>, label int"


def test_negatives_of_random_vectors(spark, monkeypatch):
    """Many ties, repeated rows and ids, hot labels; small blocks and tiles."""
    monkeypatch.setattr(negatives, "ROWS", 64)
    monkeypatch.setattr(negatives, "ANCHORS", 4)
    monkeypatch.setattr(negatives, "TILE", 50)
    r = np.random.default_rng(5)
    rows = [(int(i) if i % 31 else None, [float(x) for x in r.integers(-1, 3, 4) / 64], int(0 if i % 3 == 0 else r.integers(4))) for i in range(200)]
    rows += rows[:40] + [(5, rows[7][1], 2), (5, rows[7][1], 3)]
    df = spark.createDataFrame(rows, TYPE).withColumns({k: F.lit("own") for k in ("anchor", "slot", "score", "number", "a", "r", "vec", "own", "place")})
    got = negatives.mine(df, F.col("vec_id") % 5 == 0, F.col("label"), 30, 90, 3, 4)
    want = plain_mine(rows, lambda i: i is not None and i % 5 == 0, 30, 90, 3, 4)
    assert len(want) > 100 and as_counter(got) == want
    got = negatives.mine(df, F.col("vec_id") % 5 == 0, F.col("label"), -50, 100, 3, 4)
    assert as_counter(got) == plain_mine(rows, lambda i: i is not None and i % 5 == 0, -50, 100, 3, 4)


def test_negatives_of_odd_rows(spark):
    big, inf = 3e38, float("inf")
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [0.5, 1.0], 2), (3, None, 1), (4, [1.0, None], 1), (5, [1.0, inf], 2),
            (6, [1.0, float("nan")], 2), (7, [1.0, 1.0], None), (8, [], 1), (9, [0.9], 3), (10, [big, -big], 1), (11, [big, big], 2), (None, [0.8, 1.1], 2),
            (12, [1e7, 1e7], 2), (13, [0.5, 1.0], 2)]
    for scale in (256, 1):
        got = negatives.mine(spark.createDataFrame(rows, TYPE), F.lit(True), F.col("label"), 30, 90, scale=float(scale))
        want = plain_mine(rows, lambda i: True, 30, 90, 5, 10, scale)
        assert want and as_counter(got) == want
    none = spark.createDataFrame([], TYPE)
    assert negatives.mine(none, F.lit(True), F.col("label"), 30, 90).count() == 0
    some = spark.createDataFrame(rows, TYPE)
    assert negatives.mine(some, F.lit(False), F.col("label"), 30, 90).count() == 0
    assert negatives.mine(some.withColumn("embedding", F.col("embedding").cast("array<double>")), F.col("vec_id") == 1, F.col("label"), 30, 90).count() > 0


def test_long_text_in_all(spark, model):
    """Texts of one character without a space, and of many words."""
    docs = spark.createDataFrame([(1, "a" * 200_000), (2, "=" * 200_000), (3, LONG)], "doc_id long, text string")
    assert {(r["doc_id"], len(r["ids"]) > 0, r["agrees"]) for r in pieces.encode(docs, model).collect()} == {(1, True, True), (2, True, True), (3, True, True)}
    assert {(r["doc_id"], r["n_features"]) for r in resample.resample(docs, docs, 100, 1).collect()} == {(1, 1), (2, 0), (3, 60_000)}
