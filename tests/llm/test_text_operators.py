"""PII, quality, BPE, media and toxicity: against plain versions, on odd rows, and on held-out labels."""

import hashlib
import io
import random
import re
import time
import wave
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from plumbline.llm import bpe, media, pii, quality, queries, toxicity

SF = "/root/testdata/sf0.01"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((*m.span(), kind))
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_are_the_patterns():
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice("0123459a@.+- ()%é\n") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("1" * 100_000 + "a" * 100_000 + "@") == []


@pytest.fixture(scope="module")
def field(documents):
    return pii.fit(documents)


def test_pii_adds_spans_and_keeps_base(spark, odd, nothing, field):
    rows = pii.detect(odd, field).collect()
    assert len(rows) == odd.count() and pii.detect(nothing, field).count() == 0
    by = {r.doc_id: r for r in rows}
    assert by[1].spans == by[2].spans == "" and by[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert by[None].n_email == by[None].n_phone == 1 and by[7].n_card == 1 and by[7].n_phone == 2 and by[5].n_ip == 1
    base, every = pii.find("call +1 (663) 555-6869. Later (663) 555-6869 again", field)
    assert set(base) <= set(every)
    assert pii.redacted("to a@b.co.uk, bye", field) == "to <EMAIL>, bye"


def test_skip_edges_carry_labels():
    """A token that looks like nothing takes the label of its equals; alone it does not."""
    model = pii.Model(np.zeros((pii.BUCKETS, len(pii.LABELS))), np.zeros((2, 5, 5)))
    model.edge[1] = 3 * np.eye(5)
    g = pii.Graph([(0, 4), (9, 13)], [{"card"}, set()], [[0], [0]], [(0, 1, 1)])
    with_edge = pii.marginals(g, model)[1]
    g.edges = []
    alone = pii.marginals(g, model)[1]
    assert with_edge[pii.LABELS.index("card")] > 0.5 > alone[pii.LABELS.index("card")]


def test_equal_tokens_with_prose_between_share_a_skip_edge():
    token, prose = "663-555-6869", " and nothing but plain words for a while " * 20
    assert pii.graph(token + prose + token, []).edges == [(0, 1, 1)]
    assert pii.graph(f"{token} {token}", []).edges == [(0, 1, 0)]
    assert pii.graph(f"{token}  {token}{prose}{token} 7 {token}", []).edges == [(0, 1, 1), (1, 2, 1), (2, 3, 0), (3, 4, 0), (2, 4, 1)]


def test_features_see_whole_tokens_and_whole_words_before():
    token = "a1" * 40
    assert pii._shape(token + "-") != pii._shape(token + "+")
    rng = np.random.default_rng(5)
    for _ in range(200):
        text = "".join(rng.choice(["a", "Bc", " ", "  ", "\n", "x" * 70, "7"], size=30))
        for at in range(len(text) + 1):
            assert pii.words_before(text, at) == text[:at].lower().split()[-2:]
    began = time.monotonic()
    g = pii.graph("word " * 100_000 + "x" * 500_000 + " 1 2 3" * 20_000, [])
    assert len(g.spans) == 60_000 and time.monotonic() - began < 20


def test_messages_are_exact_on_a_chain():
    rng = np.random.default_rng(1)
    model = pii.Model(rng.normal(size=(pii.BUCKETS, 5)), rng.normal(size=(2, 5, 5)))
    g = pii.Graph([(0, 1), (2, 3), (4, 5)], [set(), set(), set()], [[1], [2], [3]], [(0, 1, 0), (1, 2, 0)])
    unary = np.array([model.node[b].sum(axis=0) for b in g.buckets])
    joint = np.exp(unary[0][:, None, None] + unary[1][None, :, None] + unary[2][None, None, :] + model.edge[0][:, :, None] + model.edge[0][None, :, :])
    joint /= joint.sum()
    got = pii.marginals(g, model, rounds=60)
    assert np.allclose(got, [joint.sum((1, 2)), joint.sum((0, 2)), joint.sum((0, 1))], atol=1e-6)


def test_messages_cross_a_long_group():
    """Evidence at the first of 300 mentions reaches the last, as much as it should."""
    n, w = 300, 8.0
    model = pii.Model(np.zeros((pii.BUCKETS, 5)), np.stack([np.zeros((5, 5)), w * np.eye(5)]))
    g = pii.Graph([(9 * i, 9 * i + 4) for i in range(n)], [{"card"}, *(set() for _ in range(n - 1))], [[0]] * n, [(i, i + 1, 1) for i in range(n - 1)])
    first, share = np.exp(8) / (np.exp(8) + 4), (np.exp(w) - 1) / (np.exp(w) + 4)
    got = pii.marginals(g, model)[:, pii.LABELS.index("card")]
    assert got[-1] > 0.6 and np.allclose(got, 0.2 + (first - 0.2) * share ** np.arange(n), atol=1e-5)


def auc(rows):
    rows = sorted(rows)
    ranks = {k: i for i, k in enumerate(range(len(rows)))}
    good = [ranks[i] for i, (_, y) in enumerate(rows) if y]
    return (sum(good) - len(good) * (len(good) - 1) / 2) / (len(good) * (len(rows) - len(good)))


@pytest.mark.parametrize(("query", "label", "modulus", "out"), [("op4_subword_quality", "quality", 4, 2), ("op10_noisy_or_toxicity", "toxic", 3, 1)])
def test_classifiers_on_held_out_labels(spark, query, label, modulus, out):
    scored = queries.QUERIES[query](spark, SF)
    assert scored.count() == 1000
    rows = scored.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    held = [(r.score, r[label]) for r in rows if zlib.crc32(str(r.doc_id).encode()) % modulus == out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == out) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    assert auc(held) > (0.99 if label == "quality" else 0.8)


def test_classifiers_on_odd_rows(odd, nothing):
    q = quality.train([("good words here", 1), ("bad!! bad!!", 0)] * 5)
    t = toxicity.train([("You idiot. Fine day", 1), ("Fine day. You are well", 0)] * 20, least=2)
    for module, model in ((quality, q), (toxicity, t)):
        rows = module.score(odd, model).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows) and module.score(nothing, model).count() == 0
        same = [r.score for r in rows if r.doc_id == 4]
        assert same[0] == same[1] and not next(r for r in rows if r.doc_id is None).held_out
    assert t.score("You idiot. Fine day.") > t.score("Fine day.")
    assert [x[:2] for x in t.locate("Fine day. You idiot. Fine day.", 0.3)] == [(10, 20)]
    assert quality.train([]).score("x") == 0.5 and toxicity.train([]).score("x") < 0.5
    kept = quality.keep(odd, q)
    assert kept.columns == odd.columns


def test_quality_reads_words_to_their_end():
    """Text without white space: n-grams from the first to the last character, in blocks too, and alike in training."""
    long = "".join(random.Random(4).choices("abcdefgh", k=13_000))
    for word in ("a" * 41 + "zq", "中文" * 70 + "好書", long):
        w = f"<{word}>"
        want = sorted(quality._hash(p.encode()) for p in ["\x00" + word, *(w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1))])
        found = quality.features(word, {})
        found[quality._DOCUMENT] -= 1
        assert sorted(found.elements()) == want
        margins = np.random.default_rng(3).normal(size=quality.BUCKETS).astype(np.float32)
        z = (float(margins[want].sum(dtype=np.float64)) + float(margins[quality._DOCUMENT])) / (len(want) + 1)
        assert quality.Model(margins).score(word) == pytest.approx(1 / (1 + np.exp(-z)), rel=1e-6)
    start = "無" * 45
    m = quality.train([(start + "好書" * 20, 1), (start + "壞字" * 20, 0)] * 5)
    assert m.score(start + "好書" * 9) > 0.5 > m.score(start + "壞字" * 9)


def test_noisy_or_is_the_product():
    m = toxicity.Model(-2.0, {b: 3.0 for b in toxicity.buckets("bad")[:1]})
    p = [1 / (1 + np.exp(-z)) for z in (1.0, -2.0, -2.0)]
    assert m.score("bad. fine. ok!") == pytest.approx(1 - (1 - p[0]) * (1 - p[1]) * (1 - p[2]))


def test_offending_sentences_are_those_of_the_plain_reading(spark, odd):
    """Sentence by sentence, character by character, against the operator's column."""
    rng = random.Random(7)
    m = toxicity.Model(-3.0, {toxicity.buckets(w)[0]: v for w, v in (("idiot", 5.0), ("bad", 2.0), ("kind", -4.0), ("fool", 3.1))})
    texts = ["".join(rng.choice(("idiot", "bad", "kind", "fool", "İx", " ", " ", "\n", ".", "!", "?", "é")) for _ in range(rng.randint(0, 30))) for _ in range(300)] + [None, "", "idiot " * 30_000 + "."]
    want = {}
    for i, text in enumerate(texts):
        found, start = [], 0
        for end in range(1, len(text or "") + 1):
            if text[end - 1] in ".!?\n" or end == len(text):
                body = text[start:end]
                found_words = {w for w in re.findall(r"\w+", body.lower())}
                p = 1 / (1 + np.exp(-(m.bias + sum(m.weights.get(b, 0.0) for w in found_words for b in toxicity.buckets(w)))))
                if found_words and p >= 0.5:
                    found.append((start + len(body) - len(body.lstrip()), end, pytest.approx(p)))
                start = end
        want[i] = found
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, sentences string")
    rows = toxicity.score(df, m).collect()
    assert len(rows) == len(texts) and any(want.values())
    for r in rows:
        assert [tuple(x) for x in r.sentences] == want[r.doc_id]
    assert all(r.sentences == [] for r in toxicity.score(odd, m).collect() if r.doc_id in (1, 2, 3))


def test_quality_margins_are_averaged_vectors_and_softmax(spark):
    """Vectors averaged for each document, then the softmax of the output rows."""
    rows = [("clean plain words of a text", 1), ("BUY!!! now now now !!", 0), ("another plain text", 1), ("cheap cheap offer !!", 0)] * 4
    model = quality.train(rows)
    rng = np.random.default_rng(3)
    vectors, output = rng.normal(size=(quality.BUCKETS, 8)).astype(np.float32), rng.normal(size=(2, 8)).astype(np.float32)
    plain = quality.Model((vectors @ (output[1] - output[0])).astype(np.float32))
    for text in ("", "one", "one two two two", "a " * 50 + "é" * 300, "clean plain words", "x" * 9000):
        words = text.split()
        buckets = [quality._DOCUMENT] + [b for w in words for b in quality.word_buckets(w)] + [quality._REPEAT] * (8 * sum(a == b for a, b in zip(words, words[1:], strict=False)))
        z = output @ vectors[buckets].astype(np.float64).mean(axis=0)
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert plain.score(text) == pytest.approx(p[1], abs=1e-5)
    assert model.score("plain words") > 0.5 > model.score("BUY!!! now now")


def test_messages_on_a_loop_are_those_of_plain_loops():
    """A cycle of chain and skip edges: sum-product written out edge by edge, and labels that agree with the exact ones."""
    rng = np.random.default_rng(5)
    model = pii.Model(rng.normal(size=(pii.BUCKETS, 5)), 0.6 * rng.normal(size=(2, 5, 5)))
    edges = [(0, 1, 0), (1, 2, 0), (2, 3, 0), (0, 3, 1), (1, 3, 1)]
    g = pii.Graph([(9 * i, 9 * i + 4) for i in range(4)], [set(), {"card"}, set(), set()], [[1, 7], [2], [3], [4]], edges)
    unary = np.array([model.node[b].sum(axis=0) for b in g.buckets])
    unary[1, pii.LABELS.index("card")] += 8
    messages = {(i, j): np.ones(5) / 5 for a, b, _ in edges for i, j in ((a, b), (b, a))}
    pot = {(i, j): np.exp(model.edge[k] if (i, j) == (a, b) else model.edge[k].T) for a, b, k in edges for i, j in ((a, b), (b, a))}
    for _ in range(2000):
        new = {}
        for i, j in messages:
            into = np.exp(unary[i])
            for (x, y), m in messages.items():
                if y == i and x != j:
                    into = into * m
            new[i, j] = into @ pot[i, j]
            new[i, j] /= new[i, j].sum()
        messages = {e: 0.5 * messages[e] + 0.5 * new[e] for e in messages}
    want = []
    for i in range(4):
        b = np.exp(unary[i])
        for (_, y), m in messages.items():
            if y == i:
                b = b * m
        want.append(b / b.sum())
    got = pii.marginals(g, model)
    assert np.allclose(got, want, atol=1e-5)
    joint = np.zeros((5,) * 4)
    for y in np.ndindex(*joint.shape):
        joint[y] = sum(unary[i, y[i]] for i in range(4)) + sum(model.edge[k][y[a], y[b]] for a, b, k in edges)
    joint = np.exp(joint - joint.max())
    exact = [joint.sum(axis=tuple(k for k in range(4) if k != i)) / joint.sum() for i in range(4)]
    assert [int(e.argmax()) for e in exact] == [int(b.argmax()) for b in got]


def test_filters_of_stages_on_odd_rows(odd, nothing, field):
    """redact and keep on null, empty, repeated and very long texts."""
    rows = pii.redact(odd, field).collect()
    by = {r.doc_id: r.text for r in rows}
    assert len(rows) == odd.count() and by[1] is None and by[2] == "" and by[3] == " \n\t" and "<EMAIL>" in by[None] and by[7].startswith("Call <PHONE> now, or <CARD>") and by[5].endswith("<IP>") and len(by[5]) == 30_005
    assert [r.text for r in rows if r.doc_id == 4] == ["one two three four five"] * 2 and pii.redact(nothing, field).count() == 0
    m = quality.train([("one two three four five", 1), ("x x x x", 0)] * 10)
    kept = quality.keep(odd, m, 0.5).collect()
    assert sum(r.doc_id == 4 for r in kept) == 2 and not any(r.doc_id == 6 for r in kept) and quality.keep(nothing, m).count() == 0


def plain_peaks(samples):
    """Frame by frame and bin by bin, by the transform's definition."""
    x = [b - 128.0 for b in samples]
    out, start, frame = [], 0, 0
    n = media.FRAME
    k = np.arange(n)
    while frame == 0 or start + n - media.HOP < len(x):
        part = (x[start : start + n] + [127.0] * n)[:n]
        part = np.array(part) - np.mean(part)
        part = part * (0.5 - 0.5 * np.cos(2 * np.pi * k / (n - 1)))
        power = [abs(np.sum(part * np.exp(-2j * np.pi * b * k / n))) for b in range(n // 2 + 1)]
        floor = np.mean(power[media.BANDS[0] : media.BANDS[-1]]) + 1e-3
        for low, high in zip(media.BANDS, media.BANDS[1:], strict=False):
            best = max(range(low, high), key=lambda b: (power[b], -b))
            if power[best] > 1.5 * floor and power[best] >= power[best - 1] and power[best] >= power[best + 1]:
                out.append((frame, best))
        start, frame = start + media.HOP, frame + 1
    return sorted(out)


def test_peaks_are_those_of_the_plain_transform():
    rng = np.random.default_rng(9)
    for n in (576, 1152, 4608, 12_096):
        t = np.arange(n)
        tone = (128 + 50 * np.sin(t / 5) + 20 * np.sin(t / 1.7 + n) + rng.integers(-9, 10, n)).astype(np.uint8).tobytes()
        at, bins = media.peaks(tone)
        assert list(zip(at.tolist(), bins.tolist(), strict=True)) == plain_peaks(tone)
    words = ("plain words of a document, " * 200).encode()[: 576 * 8]
    assert list(zip(*(a.tolist() for a in media.peaks(words)), strict=True)) == plain_peaks(words)


@pytest.fixture(scope="module")
def coder():
    ranks = bpe.read_ranks(RANKS)
    return bpe.Codec(ranks, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_tiktoken(coder, documents):
    codec, theirs = coder
    rng = random.Random(5)
    tokens = list(theirs._mergeable_ranks)
    texts = [r.text for r in documents.collect()] + ["", " ", "<|endoftext|>", "日本語 𝄞 é" * 50, "a" * 3000, "\x1c \x85 \u2028x"]
    for _ in range(5000):
        k = rng.random()
        texts.append("".join(rng.choice("abcdehilnorst") for _ in range(rng.randint(1, 14))) if k < 0.4 else b"".join(rng.choice(tokens) for _ in range(rng.randint(1, 6))).decode("utf-8", "ignore") if k < 0.8 else rng.choice("ab 0!=-\n日é") * rng.randint(1, 90))
    for text in texts:
        ids, shown = codec.encode(text)
        assert ids == theirs.encode_ordinary(text), text
        assert shown == " ".join(map(str, ids)) and codec.decode(ids) == text
    small = bpe.Codec(theirs._mergeable_ranks, public_tokenizers.PATTERN)
    small.fst.most_states, small.fst.most_pieces = 50, 20  # tables that are dropped all the time change nothing
    assert all(small.encode(t)[0] == codec.encode(t)[0] for t in texts[:60])


def test_streaming_decode_of_any_bytes(coder):
    codec, _ = coder
    rng = random.Random(6)
    for _ in range(3000):
        ids = [rng.randrange(50256) for _ in range(rng.randint(1, 8))]
        whole = b"".join(codec.fst.bytes_of[i] for i in ids).decode("utf-8", "replace")
        cut = rng.randint(0, len(ids))
        stream = bpe.Utf8Stream(codec.fst.bytes_of)
        assert stream.feed(ids[:cut]) + stream.feed(ids[cut:]) + stream.end() == whole


def test_bpe_rows(odd, nothing):
    rows = bpe.digests(odd, RANKS, public_tokenizers.PATTERN).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(rows) == odd.count() and all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == (0, empty, empty) for r in rows if r.doc_id in (1, 2))
    assert bpe.digests(nothing, RANKS, public_tokenizers.PATTERN).count() == 0
    whole = {r.doc_id: r for r in bpe.encode(odd, RANKS, public_tokenizers.PATTERN).collect()}
    assert whole[8].decoded == "You idiot. Fine day." and len(whole[8].ids) == next(r.n_tokens for r in rows if r.doc_id == 8)


def test_media_round_trip(odd, nothing):
    stored = {r.doc_id: r for r in media.encode(odd).collect()}
    rows = {r.doc_id: r for r in media.features(media.encode(odd)).collect()}
    assert media.features(media.encode(nothing)).count() == 0
    for doc_id, s in stored.items():
        with wave.open(io.BytesIO(bytes(s.media))) as w:
            assert (w.getnchannels(), w.getsampwidth()) == (1, 1)
            payload = w.readframes(w.getnframes())
        r = rows[doc_id]
        assert r.payload_bytes == len(payload) and len(payload) % 576 == 0 and len(payload) > 0 and set(payload[r.n_bytes :]) <= {255}
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-32:]) and r.media_sha256 == hashlib.sha256(s.media).hexdigest()
    assert rows[1].feature == rows[2].feature == [] and rows[1].payload_bytes == 576


def test_fingerprint_is_the_plain_one():
    rng = np.random.default_rng(2)
    t = np.arange(60_000)
    tone = (128 + 60 * np.sin(t / 7) + 30 * np.sin(t / 2.3) + rng.integers(-4, 5, len(t))).astype(np.uint8).tobytes()
    at, bins = media.peaks(tone)
    want = [(int(at[i]) << 40) | (int(bins[i]) << 24) | (int(bins[j]) << 8) | int(at[j] - at[i]) for i in range(len(at)) for j in [j for j in range(len(at)) if at[j] > at[i]][: media.FAN] if at[j] - at[i] <= media.MAX_GAP]
    assert media.fingerprint(tone).tolist() == want and len(want) > 100
