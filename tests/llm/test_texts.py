"""Operators on texts against plain versions of the same definitions."""

import bisect
import hashlib
import random
import re
import time
import weakref
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seekwell.llm import (
    best_fit, near_dedup, personal_data, pieces, pseudo_likelihood, quality, token_counts,
)
from seekwell.llm.chunk_table import ChunkTable, worker_table
from seekwell.llm.components import connected_components
from seekwell.llm.minhash import Pruner, Signer, shingle_sets, word_hashes
from seekwell.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, rank int, score double, spans string"
ODD = list("ab é\n\t  '.,1中　\x01\x1c\x85\xa0​́Σ😀İ") + [
    "<|endoftext|>", "'s ", "  ", "word", "ing", "▁", "</s>", " a", "\n "
]


def odd_texts(n, seed=1, size=14):
    rng = random.Random(seed)
    texts = ["".join(rng.choices(ODD, k=rng.randint(0, size))) for _ in range(n)]
    return [*texts, "", " ", "a ", "  ", "x" * 3000, "word " * 2000, " \n" * 500]


@pytest.fixture
def docs(spark):
    """Documents with clashing further columns from a list of texts."""

    def make(texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        return spark.createDataFrame([(i, t, "en", 1, 0.5, "s") for i, t in zip(ids, texts)], SCHEMA)

    return make


def test_pieces_are_the_librarys(docs):
    model = tokenizer_path("piece_bpe_32k.model")
    sp = pieces.processor(model)
    texts = odd_texts(4000)
    for text, ids in zip(texts, pieces.encode_texts(texts, model)):
        assert np.frombuffer(ids, "<u4").tolist() == sp.encode(text, add_bos=True, add_eos=True)
    rows = pieces.digests(docs([None, "a  b", "a  b"], [7, 8, 8]), model).collect()
    want = np.array(sp.encode("a  b", add_bos=True, add_eos=True), "<u4").tobytes()
    assert [r["n_tokens"] for r in sorted(rows)] == [2, len(want) // 4, len(want) // 4]
    assert sorted(rows)[1]["ids_sha256"] == hashlib.sha256(want).hexdigest()
    assert sorted(rows)[1]["decoded_sha256"] == hashlib.sha256(b"a  b").hexdigest()
    assert pieces.encoded(docs([None, "a b"]), model).orderBy("doc_id").collect()[1]["decoded"] == "a b"
    assert pieces.digests(docs(["x"]).limit(0), model).count() == 0


def test_token_counts_are_the_librarys(docs):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    texts = odd_texts(3000)
    assert token_counts.counts(texts, path) == [count(t) for t in texts]
    long = odd_texts(150, 2, 900)
    narrow = token_counts.Windows(window=64, overlap=16, agreement=3)
    assert token_counts.counts(long, path, narrow) == [count(t) for t in long]
    rows = token_counts.token_counts(docs([None, "é b", "w " * 3000]), path).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == [(0, 0, 0, False), (1, 4, 2, False), (2, 6000, 3000, True)]
    assert token_counts.token_counts(docs(["x"]).limit(0), path).count() == 0


def test_a_word_is_encoded_once_whatever_follows():
    path = tokenizer_path("byte_bpe_50k.json")
    after = [".", ",", ".\nNext", "'s", "'ll.", "$$", "9x", "-a", "<|endoftext|>b", "\t.", "ª", "\u0301b", "²", "_c"]
    words = ["word", "éoulech", "Слово", "λόγος", "Ǆungla", "\u0294a", "中文", "a\u0301b"]
    text = "start " + " ".join(w + a for w in words for a in ["", *after])
    encoder, batches = best_fit._Encoder(path), []
    library = encoder._tokenizer
    assert [np.frombuffer(i, "<u4").tolist() for i in best_fit.byte_level_ids([text], path)] == [
        library.encode(text, add_special_tokens=False).ids
    ]
    joined = encoder._joined
    encoder._words._encode = lambda chunks: batches.extend(chunks) or joined(chunks)
    encoder.of_chunks(["éoulech" + a for a in after[:9]])
    assert batches == ["éoulech"]


def test_a_slice_looks_up_each_chunk_once(monkeypatch):
    path = tokenizer_path("byte_bpe_50k.json")
    library, seen, distinct = best_fit._Encoder(path)._tokenizer, [], ChunkTable.distinct
    monkeypatch.setattr(best_fit, "_SLICE", 3000)
    monkeypatch.setattr(ChunkTable, "distinct", lambda self, c: seen.append(c) or distinct(self, c))
    texts = odd_texts(500, 7) + ["one", "a b a b a", "a b. a b.\nb", "  a b  a"] * 20
    for text, ids in zip(texts, best_fit.byte_level_ids(texts, path), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(seen) > 3 and all(len(set(c)) == len(c) for c in seen)
    assert best_fit.byte_level_ids(["", ""], path) == [b"", b""]


def test_a_memo_of_distinct_chunks():
    encoded = []
    memo = ChunkTable(lambda chunks: encoded.extend(chunks) or [c.upper() for c in chunks], 8)
    for chunks in [["a", "b", "x" * 49], ["c", "a"], ["d", "e"], ["a", "f", "x" * 49], []]:
        assert memo.distinct(chunks) == [c.upper() for c in chunks]
    assert encoded == ["a", "b", "x" * 49, "c", "d", "e", "f", "x" * 49]
    assert len(memo._known) + len(memo._older) <= 8


def test_best_fit_equals_one_by_one():
    rng = random.Random(3)
    for _ in range(200):
        capacity = rng.choice([5, 10, 32, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 300))]
        room, bins = [], 0
        for n in sorted(lengths, reverse=True):
            at = bisect.bisect_left(room, n)
            left = room.pop(at) if at < len(room) else capacity
            bins += left == capacity
            if left > n:
                bisect.insort(room, left - n)
        spots = {}
        for p in best_fit.best_fit(dict(Counter(lengths)), capacity):
            for k in range(p.count):
                at = p.offset + k % p.per_bin * p.length
                spots.setdefault(p.first_bin + k // p.per_bin, []).append((at, p.length))
        assert len(spots) == bins
        assert Counter(n for s in spots.values() for _, n in s) == Counter(lengths)
        for s in spots.values():
            ends = np.cumsum([n for _, n in sorted(s)])
            assert [a for a, _ in sorted(s)] == [0, *ends[:-1]] and ends[-1] <= capacity
    with pytest.raises(ValueError):
        best_fit.best_fit({11: 1}, 10)


def test_packing(docs):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = odd_texts(300, 5) + ["word " * 300, None, None]
    whole = {i: library.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    rows = best_fit.pack(docs(texts).repartition(5), path, 64, 2).collect()
    places = {}
    for r in rows:
        ids = whole[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(ids) == r["length"] and r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in places.values():
        ends = np.cumsum([n for _, n in sorted(s)])
        assert [a for a, _ in sorted(s)] == [0, *ends[:-1]] and ends[-1] <= 64
    for i, ids in whole.items():
        own = sorted((r["piece"], r["start"], r["length"]) for r in rows if r["doc_id"] == i)
        assert sum(n for *_, n in own) == len(ids) and [p for p, *_ in own] == list(range(len(own)))
        assert all(n == 64 for *_, n in own[1:])
    assert best_fit.pack(docs(["x"]).limit(0), path, 64, 2).count() == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    doubled = [int(c) * 2 - 9 * (int(c) > 4) if i % 2 else int(c) for i, c in enumerate(reversed(digits))]
    return {
        "email": True, "ip": all(int(p) <= 255 for p in value.split(".")) if kind == "ip" else False,
        "card": 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0, "phone": 9 <= len(digits) <= 15,
    }[kind]


def test_personal_data(docs):
    parts = [
        "a@b.c", "@", ".", "1", "2.3", "4.5", "+1 ", "+49(0)", "4111 1111 1111 1111", "0", "-", " ", "é",
        "😀", "255", "256.1", "GB82 WEST 1234 5698 7654 32", "_", "%", "ssn 123-45-6789", "00", "\n",
    ]
    rng = random.Random(4)
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(1500)]
    texts += ["1" * 30_000, "a" * 30_000 + "@x.y", "1 " * 10_000, "+1" + " " * 30_000 + "2", "1.2.3.4 " * 2000, "", None]
    rows = {r["doc_id"]: r for r in personal_data.digests(docs(texts).repartition(8)).collect()}
    for i, text in enumerate(texts):
        found = sorted(
            (m.start(), place, m.end(), kind) for place, (kind, p) in enumerate(PATTERNS.items())
            for m in re.finditer(p, text or "") if _valid(kind, m[0])
        )
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in found)
        assert rows[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [rows[i][f"n_{k}"] for k in PATTERNS] == [sum(f[3] == k for f in found) for k in PATTERNS]
        spans = rows[i]["spans"].split(",")
        assert not joined or set(joined.split(",")) <= set(spans)
    assert any("account:" in r["spans"] for r in rows.values())
    masked = personal_data.redacted(docs(["mail a@b.cc or +49 (030) 123-4567!", None, "no ssn 123-45-6789", "123-45-6789"]))
    assert [r["text"] for r in masked.orderBy("doc_id").collect()] == [
        "mail [EMAIL] or [PHONE]!", None, "no ssn [NATIONAL_ID]", "123-45-6789"
    ]
    assert masked.columns == docs(["x"]).columns
    assert personal_data.digests(docs(["x"]).limit(0)).count() == 0


def test_accounts_before_capitals_and_ids_in_a_row(docs):
    texts = [
        "DE89370400440532013000 Please pay", "DE89370400440532013000 12 May", "GB82 WEST 1234 5698 7654 32 Thanks",
        "DE89 3704 0044 0532 0130 00 BIC COBADEFF", "DE89370400440532013000 GB82 WEST 1234 5698 7654 32 A",
        "ZZ33 1234 5678 9012 345 OK", "AB12 DE89370400440532013000", "DE88370400440532013000 Please",
        "SSN: 123-45-6789, 234-56-7890", "SSN: " + "123-45-6789 " * 3 + "." * 48 + "234-56-7890",
    ]
    rows = personal_data.redacted(docs(texts)).orderBy("doc_id").collect()
    assert [r["text"] for r in rows] == [
        "[ACCOUNT] Please pay", "[ACCOUNT] 12 May", "[ACCOUNT] Thanks", "[ACCOUNT] BIC COBADEFF",
        "[ACCOUNT] [ACCOUNT] A", "[ACCOUNT] OK", "AB12 [ACCOUNT]", "DE88370400440532013000 Please",
        "SSN: [NATIONAL_ID], [NATIONAL_ID]", "SSN: " + "[NATIONAL_ID] " * 3 + "." * 48 + "234-56-7890",
    ]


def test_accounts_inside_runs_that_are_none(docs):
    iban = "DE89 3704 0044 0532 0130 00"
    texts = [
        f"AT61 1904 3002 3457 {iban} ok", f"{iban} {iban}", f"x {iban}", f"XX00 {iban} AB12",
        "DE88 3704 0044 0532 0130 00 GB82 WEST 1234 5698 7654 32", " ".join([iban] * 400), f"AT61 1904 3002 3457 {iban[:-1]} ok",
    ]
    rows = personal_data.digests(docs(texts)).orderBy("doc_id").collect()
    places = [[tuple(map(int, x.split(":")[1:])) for x in r["spans"].split(",") if "account" in x] for r in rows]
    assert places == [
        [(20, 47)], [(0, 27), (28, 55)], [(2, 29)], [(5, 32)], [(28, 55)],
        [(28 * i, 28 * i + 27) for i in range(400)], [],
    ]


def _brute_components(sets, percent):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [i for i in sets if sets[i]]
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in sets}


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _shingles(text, width):
    w = _words(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def _near_texts():
    rng = random.Random(6)
    base = [f"w{rng.randint(0, 400)}" for _ in range(120)]
    texts = [" ".join(base).upper()]
    for _ in range(70):  # a large group of copies of all degrees
        copy = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8])):
            copy[rng.randrange(len(copy))] = f"x{rng.randint(0, 10**6)}"
        texts.append("\n".join(copy))
    texts += [" ".join(f"u{rng.randint(0, 10**6)}" for _ in range(rng.randint(1, 60))) for _ in range(40)]
    return texts + ["one two", "ONE  two", "one two three", "", None, " \t"]


@pytest.mark.parametrize("width, percent, block", [(3, 85, 512), (5, 80, 8)])
def test_near_duplicates(docs, width, percent, block):
    texts = _near_texts()
    settings = near_dedup.NearDedup(width, percent, block=block)
    rows = near_dedup.near_duplicates(docs(texts).repartition(4), settings).collect()
    sets = {i: _shingles(t, width) for i, t in enumerate(texts)}
    want = _brute_components(sets, percent)
    assert {r["doc_id"]: r["component_id"] for r in rows} == want
    assert {r["doc_id"]: r["n_shingles"] for r in rows} == {i: len(s) for i, s in sets.items()}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_near_duplicates_odd_rows(docs):
    rows = near_dedup.near_duplicates(docs(["a b c d", "a b c d", "a b c d", None], [5, 5, None, 2])).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in rows) == [
        (-1, -1, True), (2, 2, True), (5, 5, True), (5, 5, True)
    ]
    assert near_dedup.near_duplicates(docs(["x"]).limit(0)).count() == 0


def test_near_duplicates_of_clashing_ids(docs):
    """Both texts of one id count, whichever row comes first."""
    one, two = ("a b c d e f g h i j", "k l m n o p q r s t")
    for texts, ids in (([one, two, f"{one} x", f"{two} x"], [5, 5, 7, 8]), ([two, one, f"{two} x", f"{one} x"], [5, 5, 8, 7])):
        rows = near_dedup.near_duplicates(docs(texts, ids).repartition(3)).collect()
        assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in rows) == [
            (5, 5, True), (5, 5, True), (7, 5, False), (8, 5, False)
        ]


def test_shingle_sets_of_odd_texts():
    texts = [*odd_texts(500), None, "A b\x0bC\x0cd", "word" * 10]
    for text, found in zip(texts, shingle_sets(pa.array(texts), 3)):
        assert len(found) == len(_shingles(text, 3)) and np.all(np.diff(found.astype(object)) > 0)
    big = ["a" * 3_000_000 + " b c d", "x y z " * 500_000]
    assert [len(s) for s in shingle_sets(pa.array(big), 3)] == [2, 3]


def test_pruner_keeps_what_can_be_similar():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    sets = [np.unique(base), np.unique(np.concatenate([base[:3700], rng.integers(0, 2**63, 300, dtype=np.uint64)])),
            np.unique(rng.integers(0, 2**63, 4000, dtype=np.uint64))]
    sig = Signer(20, 5).sign(sets)
    alive, share = Pruner(0.8, 100).survivors(sig[:1], sig[1:])
    assert alive.tolist() == [0] and abs(share[0] - 3700 / 4300) < 0.15


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 7), (50, 51), (51, 50), (60, 60), (None, 3)]
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(frame, "a", "b", "test").collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 1, 50: 50, 51: 50}
    assert connected_components(frame.limit(0), "a", "b", "none").count() == 0


def _good_and_bad():
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("aeioulnrst", k=rng.randint(2, 8)))
    texts, labels = [], []
    for _ in range(600):
        words = [word() for _ in range(rng.randint(20, 80))]
        good = rng.random() < 0.7
        if not good:
            words = [w + rng.choice(["###", " | ", "!!!", "$$"]) for w in words]
        texts.append(" ".join(words) + ".")
        labels.append(int(good))
    return texts, labels


def test_quality(spark, docs):
    texts, marks = _good_and_bad()
    labels = spark.createDataFrame([(i, m, 0) for i, m in enumerate(marks) if i % 2 == 0] + [(None, 1, 0), (10**9, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    frame = docs([*texts, None, ""])
    rows = {r["doc_id"]: r for r in quality.classified(frame, labels).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows.values())
    held = [i for i in range(len(texts)) if rows[i]["held_out"]]
    assert np.mean([rows[i]["predicted"] == marks[i] for i in held]) > 0.95
    kept = quality.kept(frame, labels)
    assert kept.columns == frame.columns and kept.count() == sum(r["predicted"] for r in rows.values())
    none = labels.filter("quality = 5")
    assert {r["score"] for r in quality.classified(frame, none).collect()} == {0.5}
    assert quality.classified(frame.limit(0), labels).count() == 0


def _plain_risk(weights, p, u, prior):
    """The two parts of the non-negative risk, one row after the other."""
    w1, b1, w2, b2 = weights
    good = lambda x: 1 / (1 + np.exp(-(np.tanh(x @ w1 + b1) @ w2 + b2[0])))
    bad_p, bad_u = np.mean([good(x) for x in p]), np.mean([good(x) for x in u])
    return prior * (1 - bad_p), bad_u - prior * bad_p


@pytest.mark.parametrize("prior", [0.01, 0.95])
def test_risk_gradients_are_the_plain_ones(prior):
    model = quality.started(np.zeros(5), np.ones(5), hidden=4)
    rows = np.random.default_rng(7).normal(0, 2, (150, 5))
    rows = rows[np.argsort(model.margin(rows))]
    p, u = rows[90:], rows[:90]
    negative, grads = quality.risk_gradients(model.weights, p, u, prior)
    parts = _plain_risk(model.weights, p, u, prior)
    assert abs(negative - parts[1]) < 1e-12
    assert (negative >= 0) == (prior == 0.01)
    for k, grad in enumerate(grads):
        for place in range(grad.size):
            moved = []
            for step in (1e-5, -1e-5):
                other = [w.copy() for w in model.weights]
                other[k].ravel()[place] += step
                first, second = _plain_risk(other, p, u, prior)
                moved.append(first + second if negative >= 0 else -second)
            assert abs((moved[0] - moved[1]) / 2e-5 - grad.ravel()[place]) < 1e-7


def test_all_unlabelled_rows_teach(spark, docs, monkeypatch):
    """Every learnable document is among the rows of the rounds, also in several tasks."""
    texts, marks = _good_and_bad()
    labels = spark.createDataFrame([(i, m) for i, m in enumerate(marks) if i % 2 == 0], "doc_id long, quality int")
    frame = docs([*texts, None, ""]).repartition(5)
    rows = quality._learnable(frame).collect()
    wanted = [i for i in range(len(texts) + 2) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert sorted(r["doc_id"] for r in rows) == wanted
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in rows]).astype(np.float64)
    mean, deviation = quality._moments(quality._learnable(frame))
    assert np.allclose(mean, x.mean(0)) and np.allclose(deviation, x.std(0), atol=1e-5)
    monkeypatch.setattr(quality, "_ROWS_A_TASK", 100)
    found = {r["doc_id"]: r["predicted"] for r in quality.classified(frame, labels).collect()}
    held = [i for i in range(len(texts)) if i not in wanted]
    assert np.mean([found[i] == marks[i] for i in held]) > 0.95


def test_non_negative_risk_separates():
    rng = np.random.default_rng(2)
    good, bad = rng.normal(1.5, 1, (500, 3)), rng.normal(-1.5, 1, (300, 3))
    model = quality.fit(good[:200], np.concatenate([good[200:], bad[:200]]), 0.6, epochs=30, batch=128)
    assert (model.score(bad[200:]) < 0.5).mean() > 0.9 and (model.score(good) >= 0.5).mean() > 0.9


def test_pseudo_likelihood(docs):
    shape = pseudo_likelihood.Shape(words=24, classes=4, per_class=8, stride=1, batch=64)
    rng = random.Random(9)
    rows = [" ".join(["the cat sat on the mat", "a dog ran in the park"][rng.random() < 0.5] for _ in range(20)) for _ in range(80)]
    shuffled = " ".join(rng.sample(rows[0].split(), len(rows[0].split())))
    got = {r["doc_id"]: r for r in pseudo_likelihood.scored(docs([*rows, shuffled, None, " "]).repartition(3), shape).collect()}
    assert got[0]["n_tokens"] == 120 and got[0]["log_likelihood"] < 0
    assert got[0]["mean_log_likelihood"] > got[80]["mean_log_likelihood"] + 0.3
    assert [tuple(got[i])[1:] for i in (81, 82)] == [(0, 0.0, None)] * 2
    assert pseudo_likelihood.scored(docs(["x"]).limit(0), shape).count() == 0
    assert pseudo_likelihood.scored(docs([None]), shape).count() == 1


def test_every_position_teaches():
    for count, seen, round_ in ((5, 0, 0), (5, 7, 1), (1000, 13, 1)):
        at = pseudo_likelihood.lessons(count, seen, round_, pseudo_likelihood.Shape())
        assert sorted(at) == list(range(count))


def _plain_likelihood(weights, context, target, shape):
    """One token after the other, in double precision."""
    emb, w1, b1, wc, bc, wt, bt = (np.asarray(w, np.float64) for w in weights)
    out = []
    for c, t in zip(context, target):
        h = np.tanh(np.concatenate([emb[i] for i in c]) @ w1 + b1)
        outer = h @ wc + bc
        k, place = divmod(int(t), shape.per_class)
        inner = h @ wt[k] + bt[k]
        out.append(outer[k] - np.log(np.exp(outer).sum()) + inner[place] - np.log(np.exp(inner).sum()))
    return np.array(out)


def test_likelihood_and_gradients_are_the_plain_ones():
    shape = pseudo_likelihood.Shape()
    rng = np.random.default_rng(4)
    weights = pseudo_likelihood.initial(shape, rng.integers(0, 50, shape.ids))
    context, target = rng.integers(0, shape.ids + 1, (300, 4)), rng.integers(0, shape.ids, 300)
    plain = _plain_likelihood(weights, context, target, shape)
    assert np.allclose(pseudo_likelihood.log_probabilities(weights, context, target, shape), plain, atol=1e-4)
    trainer = pseudo_likelihood.Trainer(weights, shape)
    for k, grad in enumerate(trainer.gradients(context, target)):
        assert grad.shape == weights[k].shape
        places = np.argsort(-np.abs(grad).ravel())[:3]
        for place in places:
            moved = []
            for step in (1e-4, -1e-4):
                other = [np.asarray(w, np.float64).copy() for w in weights]
                other[k].ravel()[place] += step
                moved.append(-_plain_likelihood(other, context, target, shape).mean())
            assert abs((moved[0] - moved[1]) / 2e-4 - grad.ravel()[place]) < 2e-4
    before = -plain.mean()
    for _ in range(20):
        trainer.step(context, target)
    assert -_plain_likelihood(trainer.weights, context, target, shape).mean() < before


@pytest.mark.parametrize("sent", [1 << 20, 30, 0])
def test_words_have_their_share_of_an_id(docs, sent):
    shape = pseudo_likelihood.Shape(words=24, classes=4, per_class=8, batch=64, sent_bytes=sent)
    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(3000)]
    texts = [" ".join(words[i : i + 30]) for i in range(0, 3000, 30)]
    frame = docs([*texts, None, ""]).repartition(3)
    found = pseudo_likelihood.words_of(frame.select("text"), shape)
    counts = Counter(words)
    hashes, sizes = next(word_hashes(pa.array([" ".join(counts)])))
    ids = pseudo_likelihood.token_ids(hashes, found.own, shape)
    n = np.array(list(counts.values()))
    assert (np.bincount(ids, n, shape.ids) == found.totals).all()
    shares = np.exp(found.shares(hashes, ids))
    assert (shares[ids < 24] == 1).all()
    if sent == 1 << 20:
        rare = ids >= 24
        assert np.allclose(shares[rare], n[rare] / found.totals[ids[rare]])
        assert np.allclose(np.bincount(ids, shares, shape.ids)[found.totals > 0], 1)
    stored = {r["doc_id"]: r for r in pseudo_likelihood.stored_ids(frame, found, shape).collect()}
    of_word = dict(zip(counts, zip(ids.tolist(), np.log(shares))))
    for i, text in enumerate(texts):
        assert np.frombuffer(stored[i]["ids"], "<u4").tolist() == [of_word[w][0] for w in text.split()]
        assert abs(stored[i]["shares"] - sum(of_word[w][1] for w in text.split())) < 1e-5
    assert [stored[i]["ids"] for i in (100, 101)] == [b"", b""]


def test_scores_do_not_depend_on_what_is_sent(docs):
    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.5))}" for _ in range(900)] + [f"x{i % 70}" for i in range(300)]
    texts = [" ".join(words[i : i + 30]) for i in range(0, 1200, 30)]
    frame = docs([*texts, texts[0], None, "", "w1"]).coalesce(1)
    frame = frame.union(frame)  # ids come twice
    scores = []
    for sent in (1 << 20, 160, 0):
        shape = pseudo_likelihood.Shape(words=24, classes=4, per_class=8, batch=64, sent_bytes=sent)
        scores.append(sorted(map(tuple, pseudo_likelihood.scored(frame, shape).collect()), key=str))
    assert len(scores[0]) == 88 and scores[0][0][1] is not None
    for other in scores[1:]:
        for a, b in zip(scores[0], other, strict=True):
            assert a[:2] == b[:2] and (a[3] is None) == (b[3] is None)
            assert a[2] == pytest.approx(b[2], rel=1e-9) and (a[3] or 0) == pytest.approx(b[3] or 0, rel=1e-9)


def test_windows_of_a_part_are_those_of_the_whole():
    ids, sizes = np.arange(9), np.array([0, 4, 0, 1, 4, 0])
    whole = pseudo_likelihood.windows(ids, sizes, 99)
    parts = [pseudo_likelihood.windows(ids, sizes, 99, a, b) for a, b in ((0, 3), (3, 8), (8, 9))]
    assert np.concatenate(parts).tolist() == whole.tolist()
    assert whole[3].tolist() == [1, 2, 99, 99] and whole[4].tolist() == [99] * 4


def test_window_network_sums_to_one():
    shape = pseudo_likelihood.Shape(words=24, classes=4, per_class=8)
    weights = pseudo_likelihood.initial(shape, np.ones(32))
    ids = np.arange(32)
    context = np.repeat(pseudo_likelihood.windows(np.array([3, 9, 1, 30, 2]), np.array([5]), 32)[2:3], 32, axis=0)
    assert abs(np.exp(pseudo_likelihood.log_probabilities(weights, context, ids, shape)).sum() - 1) < 1e-5
    assert pseudo_likelihood.windows(np.array([5, 6, 7]), np.array([1, 2]), 9).tolist() == [[9] * 4, [9, 9, 7, 9], [9, 6, 9, 9]]


class _Task:
    """Stands for documents, and gives what a task would run."""

    def __init__(self, spark):
        self.sparkSession = spark

    def select(self, *columns):
        return self

    def mapInArrow(self, function, schema):
        return function


def test_tasks_of_other_work_free_the_tables(spark):
    vocabulary = tokenizer_path("byte_bpe_50k.json")
    ids = best_fit.byte_level_ids(["some words and more words, once"], vocabulary)
    held = [
        weakref.ref(x) for x in (best_fit._encoder(vocabulary), worker_table(("bytes", vocabulary, best_fit._KNOWN), lambda: None))
    ]
    task = near_dedup.signed(_Task(spark), near_dedup.NearDedup())
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2]), "text": ["a few words", None]})
    assert [b.num_rows for b in task(iter([batch]))] == [2]
    assert [x() for x in held] == [None, None]
    assert best_fit.byte_level_ids(["some words and more words, once"], vocabulary) == ids


def test_a_training_step_takes_less_time():
    """Sums of columns and windows by what numpy does at once, and no digit changed."""
    rng = np.random.default_rng(8)
    for n in (1, 2, 7, 9, 130, 4096):
        x = rng.normal(size=(n, 24)).astype(np.float32)
        assert pseudo_likelihood._sums(x).tolist() == x.sum(axis=0).tolist()
    x = rng.normal(size=(4096, 24)).astype(np.float32)

    def best(f):
        times = []
        for _ in range(50):
            began = time.thread_time()
            f()
            times.append(time.thread_time() - began)
        return min(times)

    assert best(lambda: pseudo_likelihood._sums(x)) < best(lambda: x.sum(axis=0))


def test_windows_lay_out_only_their_part():
    sizes = np.array([3, 0, 2, 1, 0, 4, 300, 0])
    ids = np.random.default_rng(4).integers(0, 90, sizes.sum())
    document = np.repeat(np.arange(len(sizes)), sizes)
    plain = [
        [int(ids[p]) if 0 <= p < len(ids) and document[p] == document[at] else 99 for p in (at - 2, at - 1, at + 1, at + 2)]
        for at in range(len(ids))
    ]
    for first, last in ((0, 310), (0, 1), (2, 7), (5, 10), (9, 309), (309, 310)):
        assert pseudo_likelihood.windows(ids, sizes, 99, first, last).tolist() == plain[first:last]
