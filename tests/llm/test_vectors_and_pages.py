"""Operators on vectors and pages, and the pipeline, against plain versions."""

import os
import time

import numpy as np
import pandas as pd
import pytest

from seekwell import session
from seekwell.llm import cross_polytope, tree_forest, url_filter
from seekwell.llm.queries import ORACLES, QUERIES, RULES

VECTORS = "vec_id long, embedding array<float>, label int, id long, node long"


def _rows(n=600, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(20, 24))
    out = []
    for i in range(n):
        v = centre[i % 20] + rng.normal(size=24) * rng.choice([0.1, 0.4, 2.0]) if i % 3 else rng.normal(size=24)
        out.append((i, [float(x) for x in v], 1, 0, 0))
    out += [(n + i, out[7][1], 1, 0, 0) for i in range(40)]  # copies of one vector
    bad = [None, [0.0] * 24, [float("nan")] + [1.0] * 23, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23]
    out += [(n + 100 * (k + 1), v, 1, 0, 0) for k, v in enumerate(bad)]
    return out + [out[5], out[5]]  # repeated rows


def _good(rows):
    ok = {i: v for i, v, *_ in rows if v and None not in v and np.isfinite(v).all() and np.any(v)}
    ids = np.array(sorted(ok))
    return ids, np.array([ok[i] for i in ids], np.float32).astype(float)


def test_neighbours(spark):
    rows = _rows()
    frame = spark.createDataFrame(rows, VECTORS)
    got = cross_polytope.neighbours(frame, frame.filter("vec_id % 10 = 0"), 10, cross_polytope.Index(block=64)).collect()
    ids, vectors = _good(rows)
    hits = total = 0
    for q in [i for i in ids if i % 10 == 0]:
        dist = np.sqrt(((vectors - vectors[ids == q]) ** 2).sum(1))
        order = np.lexsort((ids, dist))
        best = [ids[k] for k in order if ids[k] != q][:10]
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, *_ in own] == list(range(1, 11))
        assert [s for *_, s in own] == pytest.approx([dist[ids == v][0] for _, v, _ in own], abs=0)
        assert [(s, v) for _, v, s in own] == sorted((s, v) for _, v, s in own)
        hits += len({v for _, v, _ in own} & set(best))
        total += 10
    assert hits / total > 0.95
    assert {r["query_id"] for r in got} == {i for i in ids if i % 10 == 0}
    few = spark.createDataFrame(rows[:3], VECTORS)
    every = cross_polytope.neighbours(few, few, 10, cross_polytope.Index(probes=64)).collect()
    assert len(every) == 6
    assert cross_polytope.neighbours(few.limit(0), few.limit(0)).count() == 0
    rng = np.random.default_rng(4)  # eleven of 64 dimensions: most share no probed axis
    eleven = [(i, [float(x) for x in rng.normal(size=64)], 1, 0, 0) for i in range(11)]
    frame = spark.createDataFrame(eleven, VECTORS)
    every = cross_polytope.neighbours(frame, frame, 20).collect()
    assert sorted((r["query_id"], r["vec_id"]) for r in every) == [(a, b) for a in range(11) for b in range(11) if a != b]
    assert all(sorted(r["rank"] for r in every if r["query_id"] == q) == list(range(1, 11)) for q in range(11))


@pytest.mark.parametrize("leaf", [1024, 24])
def test_near_vectors(spark, leaf):
    rows = _rows()
    forest = tree_forest.Forest(leaf=leaf, trees=8)
    got = tree_forest.near_vectors(spark.createDataFrame(rows, VECTORS), forest).collect()
    assert len(got) == len(rows)
    ids, vectors = _good(rows)
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    label = ids.copy()
    while True:
        after = np.where(near, label[None, :], 10**9).min(1)
        if (after == label).all():
            break
        label = after
    links = dict(zip(ids, near.sum(1) - 1))
    wrong = {r["vec_id"] for r in got if r["n_links"] != links.get(r["vec_id"], 0)}
    assert len(wrong) <= (0 if leaf > len(rows) else 2)
    assert all(r["n_links"] <= links.get(r["vec_id"], 0) for r in got)
    if not wrong:
        component = dict(zip(ids, label))
        assert all(r["component_id"] == component.get(r["vec_id"], r["vec_id"]) for r in got)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_near_vectors_in_one_dense_group(spark):
    """Cosines about 0.9 on both sides of the threshold, in a group of many leaves."""
    rng = np.random.default_rng(5)
    n, noise = 40_000, rng.normal(size=(40_000, 64))
    vectors = np.eye(64)[0] + noise / np.linalg.norm(noise, axis=1)[:, None] / 3
    rows = pd.DataFrame({"vec_id": np.arange(n), "embedding": list(vectors)})
    got = tree_forest.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(8))
    got = got.toPandas().sort_values("vec_id")
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    want = np.concatenate([(unit[k : k + 1000] @ unit.T >= 0.9).sum(1) - 1 for k in range(0, n, 1000)])
    assert 0.1 * n * n < want.sum() < 0.9 * n * n
    assert got["n_links"].sum() > 0.999 * want.sum() and (got["n_links"].to_numpy() <= want).all()
    assert (got["component_id"][want > 0] == got["vec_id"][want > 0].min()).all()


def test_a_vector_is_one_row_in_every_round(spark, monkeypatch):
    """However many nodes it is in; also where splits are joined, not sent."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=16)]) for i in range(900)]
    rows += [(7, [float(x) for x in rng.normal(size=16)])]  # an id with two vectors
    frame, stored = spark.createDataFrame(rows, "vec_id long, embedding array<double>"), []
    written = tree_forest.materialize

    def watched(df, label):
        out = written(df, label)
        stored.extend([out.count()] if label == "forest-rows" else [])
        return out

    monkeypatch.setattr(tree_forest, "materialize", watched)
    forest = tree_forest.Forest(threshold=0.6, leaf=64, trees=5, levels=2)
    found = sorted(tree_forest.near_vectors(frame, forest).collect())
    assert len(stored) > 1 and set(stored) == {901}
    monkeypatch.setattr(tree_forest, "_SENT_BYTES", -1)
    assert sorted(tree_forest.near_vectors(frame, forest).collect()) == found
    assert sum(r["n_links"] for r in found) > 0


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(k).getName() for k in range(files.length())) if n.startswith("shuffle_")}


def test_rows_are_dealt_to_a_portion_of_the_leaves_at_a_time(spark, monkeypatch, tmp_path):
    """Also to a part of the blocks of one large leaf. What is done with leaves the disk."""
    rng = np.random.default_rng(12)
    vectors = np.concatenate([rng.normal(size=(80, 16)), np.eye(16)[0] + rng.normal(size=(120, 16)) / 50])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    forest = tree_forest.Forest(threshold=0.8, leaf=8, trees=1)
    want = sorted(tree_forest.near_vectors(frame, forest).collect())
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    near = (unit @ unit.T >= 0.8).sum(1) - 1
    assert sum(r["n_links"] for r in want) > 0.9 * near.sum() and all(r["n_links"] <= near[r["vec_id"]] for r in want)

    dealt, written = {}, tree_forest.materialize_all

    def watched(parts, label):
        parts = list(parts)
        dealt.setdefault(label, []).append(len(parts))
        return written(parts, label)

    monkeypatch.setattr(tree_forest, "materialize_all", watched)
    monkeypatch.setattr(tree_forest, "_DEALT_BYTES", 1)
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path))
    files = _shuffle_files(spark)
    found = tree_forest.near_vectors(frame, forest)
    for _ in range(100):  # they go in the background
        left = {n for n in _shuffle_files(spark) - files if n.endswith(".data")}
        if len(left) < 20:  # of what was only counted or collected
            break
        time.sleep(0.1)
    kept = {p.name.rpartition("-")[0] for p in tmp_path.iterdir()}
    assert sorted(found.collect()) == want
    assert dealt["forest-links"][0] > 10
    assert not kept & {"forest-usable", "forest-rows", "forest-large", "forest-subtrees", "forest-edges"}
    assert len(left) < 20


def test_pairs_at_the_threshold_are_taken_in_double():
    rng = np.random.default_rng(3)
    group = rng.normal(size=(300, 64)) + 2
    group /= np.linalg.norm(group, axis=1)[:, None]
    cosine = np.einsum("id,jd->ij", group, group)
    rows = np.arange(300)
    for threshold in np.sort(cosine, axis=None)[[100, 45_000, 89_000]]:
        hit = tree_forest._linked(group, group.astype(np.float32), rows, rows, threshold)
        want = np.array([np.einsum("ij,ij->i", np.broadcast_to(v, group.shape), group) >= threshold for v in group])
        assert (hit == want).all()
    assert tree_forest._linked(group, group.astype(np.float32), rows[:9], rows[9:], 1.1) is None


def test_near_vectors_of_nothing(spark):
    frame = spark.createDataFrame([(1, None, 1, 0, 0)], VECTORS)
    assert [tuple(r) for r in tree_forest.near_vectors(frame).collect()] == [(1, 0, 1, True)]
    assert tree_forest.near_vectors(frame.limit(0)).count() == 0


PAGES = "page_id long, url string, html string, host string, allow boolean"


def _page(i, url, html=None):
    return (i, url, html, "h", True)


def _scores(hosts, edges, good, bad, damping=0.85):
    """(trust, distrust) of every host in plain numpy."""
    at = {h: k for k, h in enumerate(hosts)}
    share = np.zeros((len(hosts), len(hosts)))
    for a, b in edges:
        share[at[a], at[b]] += 1
    share /= np.maximum(share.sum(1, keepdims=True), 1)
    seed, blocked = (np.array([s.get(h, 0.0) for h in hosts]) for s in (good, bad))
    settled = np.array([h in good or h in bad for h in hosts])
    mass, rank, distrust = np.zeros(len(hosts)), np.zeros(len(hosts)), np.zeros(len(hosts))
    for _ in range(200):
        mass = (1 - damping) * seed + damping * (share.T @ mass)
        rank = (1 - damping) + damping * (share.T @ rank)
        distrust = np.where(settled, blocked, damping * (share @ distrust))
    return dict(zip(hosts, zip(mass / rank, distrust)))


def test_urls(spark):
    rows = [
        _page(1, "http://good.org/a", '<a href="http://x.net/1"><a href=//x.net/2>'), _page(2, "http://x.net/p", '<a href="//y.net/q">'),
        _page(3, "http://y.net/z?a#b"), _page(4, "http://bad.com/de/1", "<a href='/in'>"), _page(5, "http://evil.net/1", "<A HREF=http://bad.com/de/1>"),
        _page(6, None), _page(7, "nothing", ""), _page(8, "HTTP://Ü.ORG/Es/?x"), _page(9, "http://example.org/es/1"), _page(10, "http://a.Example.org/en/12"),
        _page(11, "http://example.org"), _page(12, "http://notorg/x"), _page(12, "http://notorg/x"), _page(13, "a://b://c/d"),
    ]
    got = {r["page_id"]: r for r in url_filter.judged(spark.createDataFrame(rows, PAGES), RULES).collect()}
    parts = {i: (r["host"], r["path"], r["rule"], r["verdict"]) for i, r in got.items()}
    assert parts == {
        1: ("good.org", "/a", "org/", "allow"), 2: ("x.net", "/p", None, "allow"), 3: ("y.net", "/z", None, "allow"),
        4: ("bad.com", "/de/1", "com/de/", "block"), 5: ("evil.net", "/1", None, "block"), 6: ("", "", None, "allow"),
        7: ("", "", None, "allow"), 8: ("Ü.org", "/Es/", "org/", "allow"), 9: ("example.org", "/es/1", "example.org/es/", "block"),
        10: ("a.example.org", "/en/12", "example.org/en/1", "block"), 11: ("example.org", "", None, "block"),
        12: ("notorg", "/x", None, "allow"), 13: ("b:", "//c/d", None, "allow"),
    }
    hosts = ["good.org", "x.net", "y.net", "bad.com", "evil.net", "Ü.org", "example.org", "a.example.org", "notorg", "b:"]
    edges = [("good.org", "x.net"), ("good.org", "x.net"), ("x.net", "y.net"), ("evil.net", "bad.com")]
    want = _scores(hosts, edges, {"good.org": 1, "Ü.org": 1}, {"bad.com": 1, "example.org": 1, "a.example.org": 1})
    for r in got.values():
        assert (r["trust"], r["distrust"]) == pytest.approx(want.get(r["host"], (0, 0)), abs=1e-5)
    assert url_filter.judged(spark.createDataFrame(rows, PAGES).limit(0), RULES).count() == 0


def _verdicts(spark, links, others=()):
    """Verdicts by host where each host of `links` links to the hosts named."""
    hosts = sorted({*links, *(h for out in links.values() for h in out), *others})
    html = {h: "".join(f"<a href=http://{x}/de/1>" for x in links.get(h, ())) for h in hosts}
    rows = [_page(i, f"http://{h}/de/1", html[h]) for i, h in enumerate(hosts)]
    return {r["host"]: r["verdict"] for r in url_filter.judged(spark.createDataFrame(rows, PAGES), RULES).collect()}


def test_urls_of_many_that_link_to_a_blocked_host(spark):
    links = {f"l{i}.net": ["bad.com"] for i in range(300)}
    got = _verdicts(spark, links | {"good.org": ["l0.net"]}, ["other.net"])
    assert {h for h, v in got.items() if v == "allow"} == {"good.org", "other.net"}


def test_urls_far_from_a_blocked_host(spark):
    chain = {f"h{i}.net": [f"h{i - 1}.net"] for i in range(2, 8)} | {"h1.net": ["bad.com"]}
    thin = {"thin.net": ["bad.com"] + [f"clean{i}.net" for i in range(200)], "half.net": ["bad.com", "clean1.net"]}
    more = {f"seed{i}.com": ["clean2.net"] for i in range(30)} | {"clean2.net": ["good.org"]}
    got = _verdicts(spark, chain | thin | more)
    blocked = {h for h, v in got.items() if v == "block"}
    assert blocked == {"bad.com", "h1.net", "h2.net", "h3.net"} | {f"seed{i}.com" for i in range(30)}


SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_registered(spark):
    from compare import database, difference

    tables = database(SF_DIR)
    for name, sql in ORACLES.items():
        assert difference(QUERIES[name](spark, SF_DIR), tables, sql) is None
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_pipeline(spark):
    """Every stage's rows against its operator's own result on the stage's input."""
    import corpus_pipeline
    from seekwell.llm import near_dedup, personal_data, quality

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    (_, first), (_, second), (_, third), (_, last) = corpus_pipeline.STAGES
    good = first(spark, docs, SF_DIR).cache()
    assert good.columns == docs.columns
    want = {r["doc_id"] for r in quality.classified(docs, labels).filter("predicted = 1").collect()}
    assert {r["doc_id"] for r in good.collect()} == want
    once = second(spark, good.unionByName(good.limit(3)), SF_DIR).cache()
    kept = near_dedup.near_duplicates(good, corpus_pipeline.NEAR).filter("kept").collect()
    assert sorted(r["doc_id"] for r in once.collect()) == sorted(r["doc_id"] for r in kept)
    masked = third(spark, once, SF_DIR).cache()
    assert masked.columns == docs.columns and masked.count() == once.count()
    assert all(r["n_chars"] == len(r["text"]) for r in masked.collect())
    assert personal_data.digests(masked).filter("n_email + n_ip + n_card + n_phone > 0").count() == 0
    rows = last(spark, masked, SF_DIR).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in masked.collect()}
    assert corpus_pipeline.ORACLE_SQL is None
