"""Operators that judge each text, against plain versions."""
import base64
import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glasspane.llm import common as C
from glasspane.llm import contamination, hmm, pii, quality, repetition, secrets, toxicity
from glasspane.llm import queries as Q


def listed(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)


# --- secrets

def plain_secrets(t):
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(
        r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t, re.I | re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(out)


def test_secrets_of_every_document(spark, sf, table):
    got = {r["doc_id"]: r for r in Q.find_secrets(spark, sf).collect()}
    rows = table("SELECT doc_id, text FROM documents")
    assert len(got) == len(rows)
    for d, t in rows:
        base = plain_secrets(t)
        assert got[d]["base_sha256"] == hashlib.sha256(listed(base).encode()).hexdigest()
        assert [got[d][f"n_{k}"] for k in secrets.BASE] == [sum(x[2] == k for x in base) for k in secrets.BASE]
        assert set(listed(base).split(",")) <= set(got[d]["spans"].split(","))


def test_secrets_of_made_texts():
    r = random.Random(2)
    parts = ["password", "Secret", "tok", "token", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abc123", "AKIA", "ABCDEFGH12345678", "deadbeef",
             "0123456789abcdef", "é", "\n", "passwd", "ſecret", "\N{KELVIN SIGN}ey"]
    for _ in range(2000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(1, 25)))
        assert [(a, secrets.KINDS[k], b) for a, k, b in secrets.spans(t.encode()) if k < 3] == [(a, k, b) for a, _, k, b in plain_secrets(t)]


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else (lambda b: bytes([0x80 | len(b)]) + b)(n.to_bytes((n.bit_length() + 7) // 8, "big"))
    return bytes([tag]) + size + body


def number(n):
    return der(2, n.to_bytes(n.bit_length() // 8 + 1, "big"))


RSA = der(0x30, number(0), *[number(random.Random(i).getrandbits(500) | 1) for i in range(8)])
PKCS8 = der(0x30, number(0), der(0x30, der(6, b"\x2b\x65\x70")), der(4, der(4, bytes(range(32)))))
SEC1 = der(0x30, number(1), der(4, bytes(range(32))), der(0xA0, der(6, b"\x2a\x86\x48")))


def field(b):
    return len(b).to_bytes(4, "big") + b


SSH = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + (1).to_bytes(4, "big") + field(b"public" * 9) + field(b"private" * 20)


def b64url(x):
    return base64.urlsafe_b64encode(x).decode().rstrip("=")


def test_structure_is_confirmed():
    for key in (RSA, PKCS8, SEC1, SSH):
        assert secrets.is_key(key) and not secrets.is_key(key[:-1]) and not secrets.is_key(key + b"\0")
    block = "-----BEGIN PRIVATE KEY-----\n" + base64.encodebytes(RSA).decode() + "-----END PRIVATE KEY-----"
    token = ".".join((b64url(json.dumps({"alg": "HS256", "typ": "JWT"}).encode()), b64url(b'{"sub":"1"}'), b64url(bytes(32))))
    cases = [(f"ü {block} x", ["key_block"]), (f"x {token} y", ["signed_token"]), (f"k {base64.b64encode(PKCS8).decode()} .", ["encoded_key"]),
             (f"k {SSH.hex()} .", ["hex", "hex_key"]), (f"x {base64.b64encode(bytes(range(90))).decode()} y", []),
             (block.replace("M", "N", 3), []), (f"{b64url(b'[1]')}.{b64url(b'{}')}.abc", []), ("eyJhbGciOiJI.eyJ.x", [])]
    for text, kinds in cases:
        found = secrets.spans(text.encode())
        assert [secrets.KINDS[k] for _, k, _ in found] == kinds, text
        for a, _, b in found:
            assert text[a:b] in (block, token, base64.b64encode(PKCS8).decode(), SSH.hex())


def test_forms_of_keys_in_files():
    oid = bytes.fromhex("2a864886f70d01050d")
    locked = der(0x30, der(0x30, der(6, oid), der(0x30, der(4, bytes(8)))), der(4, bytes(range(48))))
    digest = der(0x30, der(0x30, der(6, bytes.fromhex("608648016503040201")), der(5)), der(4, bytes(range(32))))

    def lines(data, width=64):
        text = base64.b64encode(data).decode()
        return [text[i:i + width] for i in range(0, len(text), width)]

    def pem(data, kind="RSA PRIVATE KEY", head=()):
        return [f"-----BEGIN {kind}-----", *head, *lines(data), f"-----END {kind}-----"]

    dek = ("Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC," + "0A" * 16, "")
    made = {  # text of the span -> kind, and whether a changed byte breaks it
        "\\n".join(pem(RSA)): "key_block", "\\r\\n".join(pem(SSH, "OPENSSH PRIVATE KEY")): "key_block", "\n".join(pem(RSA)): "key_block",
        "\n".join(pem(locked, "ENCRYPTED PRIVATE KEY")): "key_block", "\n".join(pem(bytes(range(64)), head=dek)): "key_block",
        "\\n".join(pem(bytes(range(64)), head=dek)): "key_block", "\n".join(lines(RSA)): "encoded_key", "\r\n".join(lines(RSA, 76)): "encoded_key",
        "\n    ".join(lines(PKCS8, 48)): "encoded_key", "\\n".join(lines(locked)): "encoded_key", "\n".join(lines(SSH)): "encoded_key",
        base64.b64encode(locked).decode(): "encoded_key", PKCS8.hex().upper(): "hex_key", locked.hex().upper(): "hex_key"}
    for text, kind in made.items():
        for before, after in (("ü ", " z"), ("", ""), ('"', '"'), ("x\n", "\nword")):
            whole = before + text + after
            found = [(a, secrets.KINDS[k], b) for a, k, b in secrets.spans(whole.encode()) if k > 2]
            assert found == [(len(before), kind, len(before) + len(text))], (kind, before, whole)
    two = "\n".join(lines(RSA)) + "\n\n" + "\n".join(lines(SEC1, 40))
    assert [k for _, k, _ in secrets.spans(two.encode())] == [5, 5]
    refused = ["\\n".join(pem(RSA[:-1])), "\n".join(pem(locked[:-1] , "ENCRYPTED PRIVATE KEY")), "\n".join(pem(bytes(63), head=dek)),
               "\n".join(pem(bytes(64), head=(dek[0], "DEK-Info: AES-128-CBC,0A0A"))), "\n".join(lines(RSA[:-1])), "\n".join(lines(digest, 40)),
               "\n".join(reversed(lines(RSA))), "\n".join(lines(SSH[:-1])), "\n".join(lines(bytes(300))), RSA.hex().upper()[:-2], digest.hex().upper()]
    for text in refused:
        assert not [x for x in secrets.spans(text.encode()) if x[1] > 2], text


def test_long_texts_without_keys_take_linear_time():
    import time
    began = time.time()
    for unit in (b"a", b"=", b"-----BEGIN PRIVATE KEY-----\n", base64.b64encode(bytes(48)) + b"\n", _SSH_LINE, b"MIIEpAIBAAKCAQEA" * 4 + b"\n", b"\\n"):
        assert [x for x in secrets.spans(unit * (1_000_000 // len(unit))) if x[1] > 2] == []
    assert time.time() - began < 60


_SSH_LINE = base64.b64encode(SSH[:48]) + b"\n"


def test_secrets_of_odd_rows(odd, none):
    assert secrets.find(odd).count() == odd.count() and secrets.find(none).count() == 0


# --- personal data

def plain_personal(t):
    out = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), 2, "card", m.end()))
    out += [(m.start(), 3, "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def test_personal_data_of_every_document(spark, sf, table):
    got = {r["doc_id"]: r for r in Q.find_personal_data(spark, sf).collect()}
    rows = table("SELECT doc_id, text FROM documents")
    assert len(got) == len(rows)
    for d, t in rows:
        base = plain_personal(t)
        assert got[d]["base_sha256"] == hashlib.sha256(listed(base).encode()).hexdigest()
        assert [got[d][f"n_{k}"] for k in pii.KINDS] == [sum(x[2] == k for x in base) for k in pii.KINDS]


def test_personal_data_of_made_texts(spark):
    r = random.Random(4)
    parts = ["a@b.c", "_x@y-z.de", "@", ".", "1.2.3.4", "255.255", ".256", "4111 1111", " 1111-1111", "+1 (555)", " 123-4567", "+", "-", " ", "é", "\n",
             "00012", "4", "4111111111111111", "x", "%"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(1, 20))) for _ in range(1500)]
    texts += ["7 " * 3000, "1.2.3.4 " * 700, "a" * 30000 + "@", "9" * 20000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in pii.find(df).collect():
        assert [(s["start"], s["kind"], s["stop"]) for s in x["base"]] == [(a, k, b) for a, _, k, b in plain_personal(texts[x["doc_id"]])]


def bootstrap_texts():
    """Account numbers stand where cards stand; order numbers do not."""
    r, out = random.Random(6), []
    for i in range(60):
        x = f"{r.randrange(10**15):015d}"
        digit = next(d for d in "0123456789" if sum(sum(divmod(int(c) * (1 + j % 2), 10)) for j, c in enumerate(reversed(x + d))) % 10 == 0)
        out.append(f"we charged the payment card {x}{digit} today and shipped order number 77{i:04d}1234 by mail")
    bad = f"{out[0][28:43]}{(int(out[0][43]) + 1) % 10}"
    return [*out, f"we charged the payment card {bad} today", "see order number 7700009999 by mail"], bad


def test_contexts_find_new_identifiers(spark):
    texts, bad = bootstrap_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.find(df).collect()}
    new = {d: [s["kind"] for s in r["spans"] if s["kind"].startswith("found_")] for d, r in rows.items()}
    assert new.pop(60) == ["found_card"] and not any(new.values())
    masked = {r["doc_id"]: r["text"] for r in pii.masked(df).collect()}
    assert masked[60] == "we charged the payment card <CARD> today" and masked[61] == texts[61]
    assert masked[0].startswith("we charged the payment card <CARD> today and shipped order number 77")


def test_personal_data_of_odd_rows(odd, none):
    assert pii.find(odd).count() == odd.count() and pii.find(none).count() == 0
    out = pii.masked(odd)
    assert sorted(map(str, out.collect())) == sorted(map(str, odd.collect())) and out.columns == odd.columns


# --- repetition

def plain_repetition(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    n, lines = len(w), 0
    windows = Counter(tuple(w[i:i + 3]) for i in range(n - 2))
    three, five, seen, longest = [False] * n, [False] * n, set(), 0
    for i in range(n - 2):
        if windows[tuple(w[i:i + 3])] > 1:
            three[i:i + 3] = [True] * 3
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    for i in range(n):
        for j in range(i + 1, n):
            k = 0
            while j + k < n and w[i + k] == w[j + k]:
                k += 1
            if k >= 5:
                longest = max(longest, k)
                five[i:i + k], five[j:j + k] = [True] * k, [True] * k
    chars = sum(map(len, w))
    return (n, chars, len(re.findall(r"[#*$%&|<>]", t)), lines, sum(three), longest,
            round(sum(len(a) for a, b in zip(w, five) if b) / max(1, chars), 9))


def test_repetition_against_all_pairs_of_positions(table):
    r = random.Random(1)
    texts = ["", "a", " \n ", "a b c a b c a b c a b c d", "é ü é ü é ü é ü é ü é ü", "x " * 40]
    texts += [" ".join(r.choice("abcd") for _ in range(r.randrange(60))) + r.choice(["", "\nab\nab"]) for _ in range(200)]
    texts += [t for t, in table("SELECT text FROM documents WHERE length(text) < 1500 LIMIT 100")]
    out = repetition._measure(5)([t.encode() for t in texts], {"doc_id": pa.array(range(len(texts)))})
    for i, t in enumerate(texts):
        assert (*[int(out[k][i]) for k in repetition.NUMBERS], round(float(out["covered"][i]), 9)) == plain_repetition(t)


def test_repetition_keeps_prose(spark, sf, odd, none, table):
    rows = {r["doc_id"]: r for r in Q.repetition_rules(spark, sf).collect()}
    good = [d for d, in table("SELECT doc_id FROM labels WHERE quality = 1", "labels")]
    assert len(rows) == 1000 and all(rows[d]["kept"] for d in good if rows[d]["n_words"] >= 50)
    assert sum(not r["kept"] and not r["base_failed"] for r in rows.values()) < 30
    assert repetition.judge(odd).count() == odd.count() and repetition.judge(none).count() == 0


# --- benchmark items

def grams(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_benchmark_items_of_every_document(spark, sf, table):
    items, holders = {}, {}
    for i, t in sorted(table("SELECT item_id, text FROM benchmark", "benchmark")):
        items.setdefault(b" ".join((t or "").encode().lower().split()), (i, grams(t)))
    for i, s in items.values():
        for x in s:
            holders.setdefault(x, []).append(i)
    size, want = {i: len(s) for i, s in items.values()}, set()
    for d, t in table("SELECT doc_id, text FROM documents"):
        shared = Counter(i for x in grams(t) for i in holders.get(x, ()))
        want |= {(d, i, size[i], n) for i, n in shared.items() if n >= 0.8 * size[i]}
    got = {(r["doc_id"], r["item_id"], r["n_shingles"], r["n_shared"]) for r in Q.benchmark_leaks(spark, sf).collect()}
    assert want and got == want
    docs, bench = Q.read(spark, sf, "documents"), Q.read(spark, sf, "benchmark")
    blocks = contamination.find(docs, bench, block=1500).collect()
    assert {(r["doc_id"], r["item_id"], r["n_shingles"], r["n_shared"]) for r in blocks} == want
    clean = contamination.without(docs, bench, block=4000)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == set(range(1000)) - {d for d, *_ in want}


def test_short_items_and_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "two three"), (2, "ONE two  three"), (3, "one two three"), (4, None), (5, "  "), (None, "words here again")],
                                  "item_id long, text string")
    got = sorted((r["doc_id"] or 0, r["item_id"] or 0) for r in contamination.find(odd, bench).collect())
    assert got == [(5, 1), (5, 1), (5, 2), (5, 2), (6, 0), (7, 0)]
    assert contamination.find(none, bench).count() == 0 and contamination.find(odd, bench.limit(0)).count() == 0
    assert contamination.without(odd, bench).count() == odd.count() - 4 and contamination.without(none, bench).count() == 0


# --- classifiers

def area(score, truth):
    rank = np.argsort(np.argsort(score))
    n = truth.sum()
    return (rank[truth == 1].sum() - n * (n - 1) / 2) / (n * (len(truth) - n))


@pytest.mark.parametrize("query, kind, parts, out, least", [
    (Q.quality_scores, "quality", 3, 1, 0.97), (Q.toxicity_scores, "toxic", 5, 0, 0.8)])
def test_held_out_rows(spark, sf, table, query, kind, parts, out, least):
    rows = {r["doc_id"]: r for r in query(spark, sf).collect()}
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows.values())
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % parts == out) for d, r in rows.items())
    truth = [(d, y) for d, y in table(f"SELECT doc_id, {kind} FROM labels", "labels") if rows[d]["held_out"]]
    assert area(np.array([rows[d]["score"] for d, _ in truth]), np.array([y for _, y in truth])) > least


@pytest.mark.parametrize("model, kind", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_on_odd_rows(odd, none, marks, model, kind):
    held_out = C.fold("doc_id", 3) == 1
    for labels in (marks, marks.limit(0), marks.where(f"{kind} = 1")):
        fitted = model.train(odd, labels, held_out)
        assert model.score(odd, fitted, held_out).count() == odd.count()
        assert model.score(none, fitted, held_out).count() == 0
    assert {r["score"] for r in model.score(odd, model.train(odd, marks.limit(0), held_out), held_out).collect()} == {0.5}


def test_texts_of_a_block_do_not_touch():
    net = quality.Network.fresh(3)
    bodies = [b"", b"a", b"The end.", b"x" * 700, "é".encode() * 999, b"one two three " * 100, b"1234567"]
    assert np.allclose(net.scores(bodies), [net.scores([b])[0] for b in bodies], atol=1e-6)


def test_gradient_of_the_network_fits(spark):
    bodies = [b"good words in a row " * 9, b"BAD!! WORDS!! " * 9] * 30
    truth = np.array([1, 0] * 30)
    assert ((quality.fit(bodies, truth, rounds=6, batch=10).scores(bodies) > 0.5) == truth).all()


# --- language model

def test_counts_and_base_score(spark, sf, table):
    got = {r["doc_id"]: r for r in Q.language_model(spark, sf).collect()}
    rows, c = table("SELECT doc_id, text FROM documents"), Counter()
    tokens = {d: [*t.encode().lower().split(), b"\n"] for d, t in rows}
    for d in tokens:
        if zlib.crc32(str(d).encode()) % 10:
            c.update(tokens[d])
    n, v = sum(c.values()), len(c)
    for d, words in tokens.items():
        r = got[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(w in c for w in words), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words), rel_tol=1e-9)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_likelihood_is_the_sum_over_all_paths(spark):
    import itertools
    rows = [(i, t) for i, t in enumerate(["a b a", "b b c", "a c", "q a b", "", "a b a b"] * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    trained = hmm.train(df, F.col("doc_id") == 3, states=3, symbols=4, rounds=3, top=2)
    m, lex, got = trained.model, trained.lexicon, {r["doc_id"]: r["score"] for r in hmm.score(trained).collect()}
    counts = {bytes(r["word"]): r["n"] for r in trained.counts.collect()}
    for d, t in rows[:6]:
        symbols, rare = [], 0.0
        for w in [*t.encode().split(), hmm.END]:
            k = lex.known if w == hmm.END else lex.place.get(w, 99)
            symbols.append(k if k <= lex.known else lex.known + 1)
            if symbols[-1] == lex.known + 1:
                rare += math.log10((counts.get(w, 0) + 0.1) / lex.rare_mass(trained.end))
        total = 0.0
        for states in itertools.product(range(3), repeat=len(symbols)):
            p = m.start[states[0]] * m.emit[symbols[0], states[0]]
            for a, b, s in zip(states, states[1:], symbols[1:]):
                p *= m.move[a, b] * m.emit[s, b]
            total += p
        assert math.isclose(got[d], math.log10(total) + rare, rel_tol=1e-9)


def test_training_raises_the_likelihood(spark, sf):
    df = Q.read(spark, sf, "documents")
    score = [hmm.score(hmm.train(df, C.fold("doc_id", 10) == 0, rounds=n)).where("NOT held_out").agg(F.sum("score")).first()[0] for n in (1, 3)]
    assert score[1] > score[0]


def test_language_model_of_odd_rows(odd, none):
    out = hmm.score(hmm.train(odd, C.fold("doc_id", 10) == 0)).collect()
    assert len(out) == odd.count() and all(r["score"] < 0 and r["base_score"] <= 0 for r in out)
    assert hmm.score(hmm.train(none, C.fold("doc_id", 10) == 0)).count() == 0
    assert hmm.score(hmm.train(odd, F.lit(True))).count() == odd.count()


def test_items_of_few_shingles_in_long_texts():
    r = random.Random(2)
    items = [(i, " ".join(f"k{r.randrange(10**6)}" for _ in range(5 + i % 8)).encode()) for i in range(400)]
    bodies = []
    for _, item in items:
        words = [f"w{r.randrange(10**6)}".encode() for _ in range(600)]
        words[300:300] = [item]
        bodies.append(b" ".join(words))
    found = contamination.Index(items).search(bodies, 0.8)
    assert sorted((d, k) for d, k, _, _ in found) == [(i, i) for i in range(400)]


def test_long_runs_of_punctuation_take_no_longer():
    """A megabyte of one sign beside many words: edges are found in one pass."""
    import time
    began = time.time()
    steps, doc, n = toxicity.chains([b"=" * 1_000_000 + b"x! " + b"(some) words, " * 50_000, b"...", b"", b"--a-b--"])
    assert time.time() - began < 20 and n.tolist() == [100_001, 0, 0, 1] and len(doc) == 100_002
    plain, _, _ = toxicity.chains([b"x some words", b"a-b"])
    assert [s[[0, 1, 2, 100_001]].tolist() for s in steps] == [s.tolist() for s in plain]
