"""Life cycle of an index over changing snapshots."""

import json
import os
import re
import time
import zlib
from collections import Counter
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seekwell import (
    CellIndex,
    FunctionEmbedder,
    HashedWords,
    RequestBudget,
    SearchIndex,
    search,
    search_batch,
    session,
)
from seekwell.functions.text import words
from seekwell.operators import diff
from seekwell.operators.embedding import calls, embed, hashed_words_sparse
from seekwell.plans import FileRules, answers, line_settings, search_with_snippets, token_settings
from seekwell.schemas import REQUESTS
from seekwell.sources import list_directory, pattern_lines, scan_directory, scan_visible
from seekwell.streaming import file_changes, latest, start_refresh

LONG = "\n".join(f"alpha line {i}" for i in range(120))
V1 = {
    ("r", "same.md"): "alpha beta gamma", ("r", "long.md"): LONG, ("r", "gone.md"): "delta alpha",
    ("r", "blank.md"): "something", ("r", "old.md"): "moved words here", ("r", "skip.bin"): "alpha",
    ("s", "same.md"): "other folder alpha", ("r", "x.log"): "alpha",
}
V2 = {
    ("r", "same.md"): "alpha beta gamma", ("r", "long.md"): "short now", ("r", "blank.md"): " \n ",
    ("r", "new.md"): "moved words here", ("s", "same.md"): "other folder alpha",
    ("r", "added.py"): "epsilon", ("r", "x.log"): "alpha",
}
V3 = {**V1, ("r", "same.md"): "alpha beta gamma again"}


@pytest.fixture
def index(spark, tmp_path):
    return SearchIndex(spark, str(tmp_path / "index"), HashedWords(32))


def chunk_rows(index, as_of=None):
    columns = ["folder", "path", "hash", "chunk_index", "chunk_id", "text", "vector"]
    return sorted(map(tuple, index.live_chunks(as_of).select(*columns).collect()))


def fresh(spark, tmp_path, files, name):
    other = SearchIndex(spark, str(tmp_path / name), HashedWords(32))
    other.build(files)
    return other


def test_refresh_equals_build(spark, tmp_path, index, make_files):
    assert index.build(make_files(V1))["added"] == 6
    one = chunk_rows(index)
    commit = index.refresh(make_files(V2))
    assert (commit["added"], commit["modified"], commit["deleted"]) == (2, 1, 3)
    assert chunk_rows(index) == chunk_rows(fresh(spark, tmp_path, make_files(V2), "two"))
    index.refresh(make_files(V3))
    assert chunk_rows(index) == chunk_rows(fresh(spark, tmp_path, make_files(V3), "three"))
    # older versions stay readable
    assert chunk_rows(index, as_of=1) == one
    stats = index.inspect().filter("folder = 'r'").first()
    assert (stats["files"], stats["files_without_chunks"], stats["orphan_chunks"], stats["wrong_dim"]) == (5, 0, 0, 0)
    live = {(r["folder"], r["path"]) for r in index.live_files().collect()}
    assert live == {k for k in V3 if k[1] not in ("skip.bin", "x.log")}


def test_nothing_changed(index, make_files):
    index.build(make_files(V1))
    before = chunk_rows(index)
    commit = index.refresh(make_files(V1))
    assert commit["version"] == 2
    assert commit["added"] == commit["modified"] == commit["deleted"] == 0
    assert chunk_rows(index) == before


def test_shorter_file_leaves_no_tail(index, make_files):
    index.build(make_files(V1))
    assert index.live_chunks().filter("path = 'long.md'").count() == 3
    index.refresh(make_files(V2))
    assert [r["text"] for r in index.live_chunks().filter("path = 'long.md'").collect()] == ["short now"]


def test_unfinished_version_is_invisible(index, make_files, monkeypatch):
    index.build(make_files(V1))
    before = chunk_rows(index)

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(index, "_write_chunks", fail)
        with pytest.raises(RuntimeError):
            index.refresh(make_files(V2))
    assert index.versions() == [1]
    assert chunk_rows(index) == before
    index.refresh(make_files(V2))  # takes the place of the unfinished one
    assert index.versions() == [1, 2]
    assert {r["path"] for r in index.live_files().collect()} == {"same.md", "long.md", "new.md", "added.py"}


def test_compaction(index, make_files):
    index.build(make_files(V1))
    index.refresh(make_files(V2))
    before = chunk_rows(index)
    index.compact()
    assert chunk_rows(index) == before
    plan = index.live_chunks()._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan
    index.refresh(make_files(V3))
    assert {r["path"] for r in index.live_files().filter("folder = 'r'").collect()} == {
        "same.md", "long.md", "gone.md", "blank.md", "old.md",
    }
    assert index.run_stats().count() == 4


def test_one_folder_at_a_time(index, make_files):
    index.build(make_files(V1))
    only_s = {("s", "same.md"): "changed"}
    commit = index.refresh(make_files(only_s), folders=["s"])
    assert (commit["modified"], commit["deleted"]) == (1, 0)


def test_newly_ignored_leaves(spark, tmp_path, make_files):
    root = str(tmp_path / "i")
    SearchIndex(spark, root, HashedWords(32)).build(make_files(V1))
    stricter = SearchIndex(spark, root, HashedWords(32), rules=FileRules(patterns=("g*.md",)))
    assert stricter.refresh(make_files(V1))["deleted"] == 1


def test_duplicate_and_conflicting_rows(spark, index, make_files):
    twice = make_files(V1).unionByName(make_files(V1))
    index.build(twice)
    assert index.live_chunks().count() == 8
    clash = make_files(V1).unionByName(make_files({("r", "same.md"): "different"}))
    with pytest.raises(ValueError, match="different contents"):
        index.refresh(clash)
    assert index.versions() == [1]


def test_settings_are_checked(spark, tmp_path):
    root = str(tmp_path / "i")
    SearchIndex(spark, root, HashedWords(32))
    with pytest.raises(ValueError, match="made with"):
        SearchIndex(spark, root, HashedWords(64))
    with pytest.raises(ValueError, match="dimensions"):
        SearchIndex(spark, root, HashedWords(64), line_settings(HashedWords(32)))


def test_missing_column(spark, index):
    with pytest.raises(ValueError, match="missing"):
        index.build(spark.createDataFrame([("a", "b")], "folder string, path string"))


def test_search(spark, index, make_files):
    index.build(make_files(V1))
    found = search(index, " delta alpha ", "r", 0.1).orderBy("rank").collect()
    assert found[0]["path"] == "gone.md" and found[0]["score"] == 1.0
    assert {r["folder"] for r in found} == {"r"}
    assert search(index, "  ", "r").count() == 0
    assert search(index, "delta", "nowhere", 0.0).count() == 0
    assert "gone.md" not in {
        r["path"] for r in search(index, "delta", "r", 0.1, patterns=["gone*"]).collect()
    }
    index.refresh(make_files(V2))
    assert "gone.md" not in {r["path"] for r in search(index, "delta alpha", "r", 0.0).collect()}


def test_answers_and_snippets(spark, index, make_files):
    index.build(make_files(V1))
    rows = [(1, "delta", "r", 0.5), (2, "nothing alike zzz", "s", 0.99), (3, None, "r", None), (4, "x", None, None)]
    requests = spark.createDataFrame(rows, REQUESTS)
    told = {r["query_id"]: json.loads(r["answer"]) for r in answers(index, requests).collect()}
    assert set(told) == {1, 2}
    assert told[1]["files_by_relevance"][0]["file"] == "gone.md"
    assert told[2] == {"query": "nothing alike zzz", "cutoff": 0.99, "files_by_relevance": []}
    snippets = search_with_snippets(index, requests).collect()
    assert {(r["path"], r["content"]) for r in snippets} == {("gone.md", "delta alpha")}


def test_pattern_files_hide_answers(spark, index, make_files):
    """Each folder's own patterns hold on every way to an answer, for its files only."""
    index.build(make_files(V1))
    cells = CellIndex(index)
    cells.build(3)
    requests = spark.createDataFrame([(1, "delta alpha", "r", 0.0)], REQUESTS)
    before = {r["path"] for r in search_batch(index, requests).collect()}
    assert "gone.md" in before
    for folder, hidden in (("r", {"gone.md"}), ("other", set())):
        rules = spark.createDataFrame([(folder, ".gitignore", "gone*")], "folder string, path string, content string")
        told = answers(index, requests, pattern_files=rules).first()
        listed = {f["file"] for f in json.loads(told["answer"])["files_by_relevance"]}
        snippets = search_with_snippets(index, requests, pattern_files=rules).collect()
        celled = cells.search_batch(requests, 3, pattern_files=rules).collect()
        assert listed == before - hidden
        assert {r["path"] for r in snippets} == {r["path"] for r in celled} == before - hidden


def test_run_stats_of_an_empty_index(index):
    assert index.run_stats().count() == 0


def test_cells_follow_refreshes(spark, index, make_files):
    index.build(make_files(V1))
    cells = CellIndex(index)
    cells.build(3)
    requests = spark.createDataFrame(
        [(1, "alpha beta", "r", 0.0), (2, "moved words", "r", 0.0), (3, "alpha", "s", 0.0)], REQUESTS
    )
    for state in (V1, V2, V3):
        index.refresh(make_files(state))
        exact = sorted(map(tuple, search_batch(index, requests).collect()))
        assert sorted(map(tuple, cells.search_batch(requests, 3).collect())) == exact
        assert sorted(map(tuple, cells.search_batch(requests, 1, exact=True).collect())) == exact
    index.compact()
    with pytest.raises(ValueError, match="build them"):
        cells.search_batch(requests, 3)


def test_token_index_and_plugged_model(spark, tmp_path, make_files):
    def lengths(series):
        for texts in series:
            yield np.stack([[len(t), 1.0] for t in pd.Series(texts)])

    model = FunctionEmbedder(lengths, 2, "lengths")
    index = SearchIndex(spark, str(tmp_path / "t"), model, token_settings(model, "l2sim", size=2))
    index.build(make_files({("r", "a.md"): "one two three"}))
    rows = index.live_chunks().orderBy("chunk_index").collect()
    assert [r["text"] for r in rows] == ["one two", " three"]
    expected = np.array([[7, 1], [6, 1]]) / np.linalg.norm([[7, 1], [6, 1]], axis=1)[:, None]
    assert np.allclose([r["vector"] for r in rows], expected, atol=1e-6)
    assert search(index, "1234567", "r", 0.9).first()["score"] == 1.0


def test_calls_keep_to_the_budget(spark):
    seen = spark.sparkContext.accumulator(0)

    def fn(series):
        for texts in series:
            assert len(texts) <= 2 and (len(texts) == 1 or texts.str.len().sum() <= 6)
            seen.add(1)
            yield np.ones((len(texts), 2))

    model = FunctionEmbedder(fn, 2, budget=RequestBudget(len, max_texts=2, max_tokens=6))
    rows = spark.createDataFrame([(t,) for t in ("aaa", "bbb", "c", "dddddddd", "e", "f", "g")], "t string")
    vectors = rows.coalesce(1).select(embed(F.col("t"), model).alias("v")).collect()
    assert len(vectors) == 7 and seen.value == 5
    assert calls([], None, 3) == []
    assert calls(list("abcd"), None, 3) == [["a", "b", "c"], ["d"]]


def test_compaction_is_due(index, make_files):
    assert not index.should_compact()
    index.build(make_files(V1))
    index.refresh(make_files(V2))
    assert index.should_compact(max_versions=1) and not index.should_compact()
    index.compact()
    assert not index.should_compact(max_versions=1)


def test_model_with_wrong_shape(spark, tmp_path, make_files):
    def bad(series):
        for texts in series:
            yield np.zeros((len(texts), 3))

    index = SearchIndex(spark, str(tmp_path / "b"), FunctionEmbedder(bad, 2, "bad"))
    with pytest.raises(Exception, match="expected"):
        index.build(make_files(V1))
    assert index.versions() == []


def test_default_model_matches_its_sql(spark):
    texts = ["Alpha beta alpha", "", "Ünï Ünï x_1 2", "one\ntwo"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    dense = {r["id"]: r["v"] for r in rows.select("id", embed(F.col("t"), HashedWords(16)).alias("v")).collect()}
    sparse = np.zeros((len(texts), 16))
    for r in hashed_words_sparse(rows, "id", "t", 16).collect():
        sparse[r["id"], r["bucket"]] = r["n"]
    norms = np.linalg.norm(sparse, axis=1, keepdims=True)
    assert np.allclose([dense[i] for i in range(4)], sparse / np.where(norms > 0, norms, 1), atol=1e-7)
    assert rows.select(words(F.col("t")).alias("w")).first()["w"] == ["alpha", "beta", "alpha"]


def test_changes_by_delta(spark, index, make_files):
    index.build(make_files(V1))
    rows = [
        ("r", "same.md", "first", "U", 1), ("r", "same.md", "second", "U", 2),
        ("r", "gone.md", None, "D", 1), ("r", "never.md", None, "D", 1),
        ("r", "back.md", "here", "U", 1), ("r", "back.md", None, "D", 2), ("r", "back.md", "again", "U", 3),
        ("r", "blank.md", "  ", "U", 1), ("s", "same.md", "other folder alpha", "U", 1),
    ]
    delta = spark.createDataFrame(rows, "folder string, path string, content string, op string, seq long")
    commit = index.apply_changes(delta, "feed", 0)
    assert (commit["added"], commit["modified"], commit["deleted"]) == (1, 1, 2)
    texts = {r["path"]: r["text"] for r in index.live_chunks().filter("folder = 'r' and path <> 'long.md'").collect()}
    assert texts == {"same.md": "second", "back.md": "again", "old.md": "moved words here"}
    # the same batch again changes nothing, the next one does
    assert index.apply_changes(delta, "feed", 0) == commit
    assert index.is_applied("feed", 0) and not index.is_applied("feed", 1)
    assert index.versions() == [1, 2]
    index.apply_changes(delta.limit(0), "feed", 1)
    assert index.versions() == [1, 2, 3]
    clash = [("r", "p.md", "a", "U", 1), ("r", "p.md", "b", "U", 1)]
    with pytest.raises(ValueError, match="different contents"):
        index.apply_changes(spark.createDataFrame(clash, delta.schema), "feed", 2)


_DELTA = "folder string, path string, content string, op string, seq long"


def test_older_changes_in_later_batches(spark, index, make_files):
    def apply(batch, *rows):
        index.apply_changes(spark.createDataFrame(list(rows), _DELTA), "feed", batch)

    def texts():
        return {r["path"]: r["text"] for r in index.live_chunks().collect()}

    apply(0, ("r", "a.md", "five", "U", 5), ("r", "b.md", "gone", "U", 3))
    apply(1, ("r", "a.md", "two", "U", 2), ("r", "b.md", None, "D", 4))
    assert texts() == {"a.md": "five"}
    apply(2, ("r", "b.md", "old", "U", 3), ("r", "a.md", "five", "U", 7))
    index.compact()
    apply(3, ("r", "a.md", "six", "U", 6), ("r", "b.md", "new", "U", 5))
    assert texts() == {"a.md": "five", "b.md": "new"}


@pytest.mark.parametrize("rows, said", [
    ([("r", "a.md", "x", "u", 1)], "op 'u'"), ([("r", "a.md", "x", None, 1)], "op None"),
    ([("r", "a.md", "x", "U", None)], "seq None"),
    ([("r", "a.md", "x", "U", 1), ("r", "a.md", None, "D", 1)], "one seq"),
])
def test_wrong_changes_raise(spark, index, rows, said):
    with pytest.raises(ValueError, match=said):
        index.apply_changes(spark.createDataFrame(rows, _DELTA))


def test_new_checkpoint_loses_nothing(spark, tmp_path, make_files):
    index = SearchIndex(spark, f"{tmp_path}/index", HashedWords(32))
    for k, name in enumerate(("a.md", "b.md")):
        row = [("r", name, f"text {k}", "U", k)]
        spark.createDataFrame(row, _DELTA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        changes = file_changes(spark, f"{tmp_path}/in")
        start_refresh(index, changes, f"{tmp_path}/ck{k}", "s").awaitTermination()
    assert {r["path"] for r in index.live_files().collect()} == {"a.md", "b.md"}


def test_unreadable_files_stay(spark, tmp_path):
    home = tmp_path / "with space"
    home.mkdir()
    (home / "a #1.md").write_text("first")
    (home / "b%20.md").write_text("second")
    (home / "skip.md").write_text("ignored")
    (home / ".gitignore").write_text("skip*\n")
    index = SearchIndex(spark, f"{tmp_path}/index", HashedWords(32), rules=FileRules(pattern_files=True))
    found = scan_directory(spark, f"file://{home}", folder="r")
    index.refresh(found)
    assert {r["path"] for r in index.live_files().collect()} == {"a #1.md", "b%20.md"}
    failed = F.when(F.col("path") == "b%20.md", "throttled")
    index.refresh(found.withColumn("error", failed).filter("path <> 'a #1.md'"))
    assert {r["path"] for r in index.live_files().collect()} == {"b%20.md"}
    left_out = {r["path"]: r["reason"] for r in index.rejects(2).collect()}
    assert left_out == {"b%20.md": "unreadable", ".gitignore": "name"}


def test_stream_equals_refresh(spark, tmp_path, make_files):
    root = str(tmp_path)
    index = SearchIndex(spark, f"{root}/streamed", HashedWords(32))
    states = [V1, V2, V3]
    for seq, state in enumerate(states):
        new = make_files(state).select("folder", "path", "content", F.lit("U").alias("op"), F.lit(seq).cast("long").alias("seq"))
        if seq:
            gone = make_files({k: "" for k in states[seq - 1] if k not in state} or {("r", "none"): ""})
            new = new.unionByName(gone.select(
                "folder", "path", F.lit(None).cast("string").alias("content"), F.lit("D").alias("op"),
                F.lit(seq).cast("long").alias("seq"),
            ))
        new.coalesce(1).write.mode("append").parquet(f"{root}/in")
        start_refresh(index, file_changes(spark, f"{root}/in"), f"{root}/ck", "s").awaitTermination()
    assert chunk_rows(index) == chunk_rows(fresh(spark, tmp_path, make_files(V3), "whole"))
    assert index.versions() == [1, 2, 3]


def _feed(spark, root, *rows):
    spark.createDataFrame(list(rows), _DELTA).coalesce(1).write.mode("append").parquet(f"{root}/in")


def test_stream_reads_nothing_stored(spark, tmp_path, make_files, monkeypatch):
    """Older changes, replaced and removed files are known from the stream's state."""
    root = str(tmp_path)
    index = SearchIndex(spark, f"{root}/streamed", HashedWords(32))
    index.build(make_files({("r", "a.md"): "from the build", ("r", "b.md"): "stays"}))
    read = []
    stored = index._stored
    monkeypatch.setattr(index, "_stored", lambda table, versions: read.append((table, versions)) or stored(table, versions))

    def step(*rows):
        _feed(spark, root, *rows)
        start_refresh(index, file_changes(spark, f"{root}/in"), f"{root}/ck", "s").awaitTermination()
        return index.commit_info(index.last_version())

    def texts():
        return {r["path"]: r["text"] for r in index.live_chunks().collect()}

    first = step(("r", "a.md", "one", "U", 5), ("r", "new.md", "fresh", "U", 5), ("r", "x.bin", "no", "U", 5))
    assert (first["added"], first["modified"], first["deleted"]) == (1, 1, 0)
    read.clear()
    second = step(
        ("r", "a.md", "too old", "U", 4), ("r", "new.md", None, "D", 6), ("r", "x.bin", None, "D", 6),
        ("r", "c.md", "first", "U", 1), ("r", "c.md", "last", "U", 3), ("r", "c.md", "middle", "U", 2),
    )
    assert (second["added"], second["modified"], second["deleted"]) == (1, 0, 1)
    assert {tuple(v) for _, v in read} == {(3,)}  # only what the batch wrote itself
    assert texts() == {"a.md": "one", "b.md": "stays", "c.md": "last"}
    third = step(("r", "a.md", "one", "U", 7), ("r", "c.md", "  ", "U", 4), ("r", "new.md", "older", "U", 5))
    assert (third["added"], third["modified"], third["deleted"]) == (0, 0, 1)
    assert texts() == {"a.md": "one", "b.md": "stays"}
    # another writer: the state no longer tells what is stored, so the manifest does
    index.refresh(make_files({("r", "a.md"): "one", ("r", "d.md"): "between"}))
    fourth = step(("r", "d.md", None, "D", 8), ("r", "a.md", "two", "U", 8))
    assert (fourth["modified"], fourth["deleted"]) == (1, 1)
    assert texts() == {"a.md": "two"}
    with pytest.raises(Exception, match="stored and removed"):
        step(("r", "z.md", "z", "U", 9), ("r", "z.md", None, "D", 9))


def test_stream_state_is_few_values(spark, tmp_path, make_files, monkeypatch):
    """Files share the values of the state, also those that the index had before."""
    root, rows = str(tmp_path), []
    index = SearchIndex(spark, f"{root}/streamed", HashedWords(32))
    index.build(make_files({("r", f"f{i}.md"): f"built {i}" for i in range(0, 120, 2)}))
    for i in range(120):
        rows += [("r", f"f{i}.md", f"old {i}", "U", 2**60 + 1), ("r", f"f{i}.md", f"new {i}", "U", 2**60 + 2)]
    _feed(spark, root, *rows, ("r", "f7.md", None, "D", 2**60 + 3))
    monkeypatch.setattr(latest.last_changes, "__defaults__", (8,))
    for _ in range(2):
        query = start_refresh(index, file_changes(spark, f"{root}/in"), f"{root}/ck", "s")
        query.awaitTermination()
        assert {s.numRowsTotal for p in query.recentProgress for s in p.stateOperators} <= {0, 8}
        found = {r["path"]: r["text"] for r in index.live_chunks().collect()}
        assert found == {f"f{i}.md": f"new {i}" for i in range(120) if i != 7}
        commit = index.commit_info(2)
        assert (commit["added"], commit["modified"], commit["deleted"]) == (59, 60, 0)
        _feed(spark, root, ("r", "f7.md", "late", "U", 2**60 + 2), ("r", "f9.md", "old 9", "U", 2**60 + 1))


@pytest.mark.parametrize("keyed", [True, False])
def test_a_stream_leaves_only_the_index(spark, tmp_path, monkeypatch, keyed):
    """What a batch read and wrote aside is gone when it is done."""
    root = str(tmp_path)
    monkeypatch.setattr(session, "shared_dir", lambda spark: f"{root}/shared")
    index = SearchIndex(spark, f"{root}/streamed", HashedWords(32))
    rows = [[("r", f"f{i}.md", f"{seq} {i}", "U", seq) for i in range(40)] for seq in range(4)]
    for some in rows:
        _feed(spark, root, *some, ("r", "x.md", None, "D", some[0][4]))
    given = {f for f in os.listdir(f"{root}/in") if f.endswith(".parquet")}
    changes = file_changes(spark, f"{root}/in", 1, consume=True)
    start_refresh(index, changes, f"{root}/ck", "s", keyed=keyed).awaitTermination()
    assert {r["path"]: r["text"] for r in index.live_chunks().collect()} == {f"f{i}.md": f"3 {i}" for i in range(40)}
    assert len(index.versions()) == 4
    assert os.listdir(f"{root}/shared") == []
    left = {f for f in os.listdir(f"{root}/in") if f.endswith(".parquet")}
    assert len(given) == 4 and len(left) <= 2  # the last batch has no later one that would remove its file


def test_shuffles_go_once_their_rows_are_stored(spark):
    """Of what is written, and of what stands behind the batch of a stream."""
    named = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def gone(files):
        for _ in range(100):  # they go in the background
            if not files & data():
                return True
            time.sleep(0.1)

    def data():
        return {n for n in named.getAllFiles().mkString("\n").split("\n") if n.endswith(".data")}

    rows, before = spark.range(1000).repartition(3, "id"), data()
    found = session.materialize(rows, "freed")
    assert gone(data() - before) and found.count() == 1000
    session.discard(found)
    before, batch = data(), spark.createDataFrame(rows.rdd, rows.schema)
    found = session.materialize(batch, "stored")
    assert (files := data() - before)
    session.free_shuffles(batch)
    assert gone(files) and found.count() == batch.count() == 1000


def test_writers_follow_what_is_stored(spark, tmp_path, make_files, monkeypatch):
    """A bucket of many chunks is written by several tasks, and still read as one."""
    import seekwell.plans.index as module

    files = make_files({("r", f"f{i}.md"): f"alpha {i} " * 50 for i in range(200)})
    plain = fresh(spark, tmp_path, files, "plain")
    size = sum(len(f"alpha {i} " * 50) for i in range(200))
    monkeypatch.setattr(module, "_SORTED_BYTES", size // 8 // 2)
    parted = fresh(spark, tmp_path, files, "parted")
    assert chunk_rows(parted) == chunk_rows(plain)

    def per_bucket(index):
        names = index._stored("chunks", [1]).inputFiles()
        return Counter(re.search(r"_(\d{5})\.", n)[1] for n in names)

    assert len(per_bucket(parted)) == len(per_bucket(plain)) == 8
    assert max(per_bucket(plain).values()) == 1 and min(per_bucket(parted).values()) > 2


def test_directory(spark, tmp_path):
    home = tmp_path / "src"
    (home / "a/target").mkdir(parents=True)
    (home / "a/b.py").write_text("print('é')")
    (home / "a/__init__.py").write_text("start")
    (home / ".github").mkdir()
    (home / ".github/ci.yml").write_text("on: push")
    (home / ".git").mkdir()
    (home / ".git/x.md").write_text("object")
    (home / "loop").symlink_to(home)
    (home / "a/target/c.py").write_text("built")
    (home / "d.md").write_bytes(b"\xff\xfebinary")
    (home / "big.md").write_text("x" * 1_000_001)
    (home / "full.md").write_text("x" * 1_000_000)
    (home / "empty.md").write_text(" \n")
    (home / ".gitignore").write_text("skip*\n# note\n")
    (home / ".seekwellignore").write_text("!skipnot.md\n")
    (home / "skip.md").write_text("s")
    (home / "skipnot.md").write_text("s")
    rules = FileRules(patterns=tuple(pattern_lines(spark, str(home))))
    assert rules.patterns == ("skip*", "# note", "!skipnot.md")
    listed = {r["relative"] for r in list_directory(spark, str(home), rules.patterns).collect()}
    assert "a/__init__.py" in listed and "a/target/c.py" not in listed
    assert not any(p.startswith((".git/", "loop/")) for p in listed)
    files = scan_directory(spark, str(home), folder="repo", patterns=rules.patterns)
    index = SearchIndex(spark, os.path.join(str(tmp_path), "i"), HashedWords(32), rules=rules)
    index.build(files)
    rows = index.live_files().collect()
    visible = {"a/b.py", "full.md", "skipnot.md"}
    assert {r["path"] for r in rows} == visible | {"a/__init__.py", ".github/ci.yml"}
    assert {r["folder"] for r in rows} == {"repo"}
    other = scan_visible(spark, str(home), "repo")
    assert {r["path"] for r in other.collect()} >= visible
    plan = other._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,1000000)" in plan


def keyed(spark, rows):
    return spark.createDataFrame(rows, "folder string, path string, hash string")


def test_diff_edges(spark):
    none, some = keyed(spark, []), keyed(spark, [("f", "a", "1"), ("f", "b", "2"), ("g", "a", "1")])
    count = lambda old, new: diff.change_stats(diff.snapshot_diff(old, new)).first().asDict()
    assert count(none, some)["added"] == 3
    assert count(some, none)["deleted"] == 3
    assert count(some, some)["same"] == 3
    assert count(none, none)["files"] == 0
    later = keyed(spark, [("f", "a", "9"), ("f", "c", "2")])
    pairs = diff.rename_pairs(diff.snapshot_diff(some, later)).collect()
    assert [(r["old_path"], r["new_path"]) for r in pairs] == [("b", "c")]


def test_rename_pairs_with_many_copies(spark):
    """Half of all files share one content; each is paired at most once."""
    old = keyed(spark, [("f", f"o{i}", "copy") for i in range(500)] + [("f", f"x{i}", f"{i}") for i in range(300)])
    new = keyed(spark, [("f", f"n{i}", "copy") for i in range(420)] + [("f", f"y{i}", f"{i}") for i in range(300)])
    pairs = diff.rename_pairs(diff.snapshot_diff(old, new)).collect()
    assert len(pairs) == 720
    assert len({p["old_path"] for p in pairs}) == len({p["new_path"] for p in pairs}) == 720
    assert all(p["old_path"][1:] == p["new_path"][1:] for p in pairs if p["hash"] != "copy")


def _executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("limit", [0, 40])
def test_live_view_without_exchange(spark, index, make_files, monkeypatch, limit):
    """Replaced keys beyond the broadcast limit are joined bucket by bucket."""
    import seekwell.plans.index as module

    index.build(make_files(V1))
    index.refresh(make_files(V2))
    index.refresh(make_files(V3))
    before = chunk_rows(index), sorted(map(tuple, index.live_files().collect()))
    assert "Broadcast" in _executed(index.live_chunks())
    monkeypatch.setattr(module, "MAX_BROADCAST_BYTES", limit)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for live in (index.live_chunks(), index.live_files()):
            plan = _executed(live)
            assert "Exchange" not in plan and plan.count("Bucketed: true") == 2
            assert ("ShuffledHashJoin" if limit else "SortMergeJoin") in plan
        assert (chunk_rows(index), sorted(map(tuple, index.live_files().collect()))) == before
        index.compact()
        assert chunk_rows(index) == before[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_folder_search_reads_its_partitions(spark, index, make_files):
    """Straight after a refresh, without compaction."""
    from seekwell.operators import scoring
    from seekwell.plans.search import embed_requests

    names = [f"folder {i}" for i in range(12)]
    index.build(make_files({(n, "a.md"): f"words of {n}" for n in names}))
    index.refresh(make_files({(n, "a.md"): f"other words of {n}" for n in names}))
    asked = spark.createDataFrame([(1, "words", names[3], 0.0)], REQUESTS)
    stored = scoring.store_requests(embed_requests(asked, index.embedder), 32)
    chunks = index.live_chunks(parts=stored.parts)
    plan = _executed(chunks)
    place = zlib.crc32(names[3].encode()) % 8
    assert re.search(rf"PartitionFilters: \[[^]]*folder_part#\d+ = {place}\)", plan)
    seen = {r["folder"] for r in chunks.collect()}
    assert seen == {n for n in names if zlib.crc32(n.encode()) % 8 == place}
    found = search_batch(index, asked).collect()
    assert [(r["folder"], r["path"]) for r in found] == [(names[3], "a.md")]


def test_index_written_by_another_session(spark, tmp_path, index, make_files):
    index.build(make_files(V1))
    reader = SearchIndex(spark, str(tmp_path / "index"), HashedWords(32))
    first = chunk_rows(reader)
    index.refresh(make_files(V2))
    assert chunk_rows(reader) == chunk_rows(index) != first
    for name in ("chunks", "manifest"):  # a session that has never seen the tables
        spark.sql(f"DROP TABLE {index._table(name).name}")
    other = SearchIndex(spark, str(tmp_path / "index"), HashedWords(32))
    assert chunk_rows(other) == chunk_rows(reader)
    assert chunk_rows(other, as_of=1) == first


@pytest.mark.parametrize("limit, opened", [(None, 7), (0, 14)])
def test_every_file_is_opened_once(spark, index, make_files, monkeypatch, limit, opened):
    """The build and a refresh each go through the snapshot once; a refresh twice if the
    live keys are too many to be sent."""
    import seekwell.plans.index as module

    count = spark.sparkContext.accumulator(0)

    def tally(batches):
        for batch in batches:
            count.add(batch.num_rows)
            yield batch

    def counted(contents):
        files = make_files(contents)
        return files.mapInArrow(tally, files.schema)

    index.build(counted(V1))
    assert count.value == len(V1)
    before = count.value
    if limit is not None:
        monkeypatch.setattr(module, "MAX_BROADCAST_BYTES", limit)
    index.refresh(counted(V2))
    assert count.value - before == opened
    texts = {(r["folder"], r["path"]): r["text"] for r in index.live_chunks().collect()}
    assert texts == {k: v for k, v in V2.items() if v.strip() and not k[1].endswith(".log")}


def test_rejects(spark, index, tmp_path, make_files):
    index.build(make_files(V1))
    index.refresh(make_files({**V2, ("r", "wide.md"): "é" * 600_000}))
    index.refresh(make_files({("r", "same.md"): "alpha beta gamma"}))
    delta = spark.createDataFrame(
        [("r", "z.bin", "z", "U", 1), ("r", "y.md", "\t", "U", 1), ("r", "a.md", "a", "U", 1)],
        "folder string, path string, content string, op string, seq long",
    )
    index.apply_changes(delta)
    index.compact()
    assert sorted(map(tuple, index.rejects().collect())) == [
        ("r", "blank.md", 3, "blank", 2), ("r", "skip.bin", 5, "name", 1), ("r", "wide.md", 1_200_000, "size", 2),
        ("r", "y.md", 1, "blank", 4), ("r", "z.bin", 1, "name", 4),
    ]
    assert [r["reason"] for r in index.rejects(1).collect()] == ["name"]
    assert [index.commit_info(v)["rejected"] for v in index.versions()] == [1, 2, 0, 2, 0]
    # more tokens than one request may hold: rejected by token chunks, not by lines
    many = {("r", "many.md"): "x " * 200_001, ("r", "few.md"): "x " * 10}
    by_tokens = SearchIndex(spark, f"{tmp_path}/tokens", HashedWords(32), token_settings(HashedWords(32)))
    by_tokens.build(make_files(many))
    assert [(r["path"], r["reason"]) for r in by_tokens.rejects().collect()] == [("many.md", "tokens")]
    assert {r["path"] for r in by_tokens.live_files().collect()} == {"few.md"}
    bad = by_tokens.inspect().first()
    assert bad["files_without_chunks"] == 0


def test_buckets_follow_the_first_snapshot(spark, tmp_path, index, make_files):
    index.build(make_files(V1))
    assert index.buckets() == 8
    settings = replace(line_settings(HashedWords(32)), buckets=3)
    few = SearchIndex(spark, str(tmp_path / "few"), HashedWords(32), settings)
    few.build(make_files(V1))
    assert few.buckets() == 3 and chunk_rows(few) == chunk_rows(index)


def test_known_vectors_are_kept(spark, tmp_path, make_files):
    """An edit at the end and a move embed only what is new; the rows are the same."""
    lines = [f"line {i} of a long file" for i in range(120)]
    first = {("r", "a.md"): "\n".join(lines), ("r", "b.md"): "to be moved", ("r", "c.md"): "stays"}
    second = {("r", "a.md"): "\n".join([*lines, "one more"]), ("r", "d/b.md"): "to be moved", ("r", "c.md"): "stays"}
    index = SearchIndex(spark, str(tmp_path / "kept"), HashedWords(32), reuse_vectors=True)
    index.build(make_files(first))
    commit = index.refresh(make_files(second))
    assert (commit["added"], commit["modified"], commit["deleted"]) == (1, 1, 1)
    assert commit["embedded"] == 1  # the last window of a.md
    assert chunk_rows(index) == chunk_rows(fresh(spark, tmp_path, make_files(second), "whole"))
    assert [r["embedded"] for r in index.run_stats().orderBy("version").collect()] == [5, 1]


def test_large_directories_are_listed_in_parts(spark, tmp_path):
    """Directories above a page, at the top and below, give each entry once, from many tasks."""
    home = tmp_path / "tree"
    sizes = {}
    for folder, count in (("", 300), ("a", 250), ("a/b", 40), ("c", 0), ("target", 200)):
        (home / folder).mkdir(parents=True, exist_ok=True)
        for i in range(count):
            name = f"{folder}/.f é{i}.md".lstrip("/") if i % 5 == 0 else f"{folder}/f{i}.md".lstrip("/")
            (home / name).write_text("x" * (i % 7))
            sizes[name] = i % 7
    (home / "loop").symlink_to(home, target_is_directory=True)
    (home / "broken.md").symlink_to(home / "nowhere")
    (home / "link.md").symlink_to(home / "f1.md")
    sizes["link.md"] = 1
    wanted = sorted((k, v) for k, v in sizes.items() if not k.startswith("target/"))
    for page in (16, 40, 299, 10_000):
        listed = list_directory(spark, str(home), ["target/"], page=page)
        assert sorted((r["relative"], r["size"]) for r in listed.collect()) == wanted
        below = listed.filter("relative LIKE 'a/%' AND relative NOT LIKE 'a/b/%'")
        tasks = below.select(F.input_file_name()).distinct().count()
        assert tasks == 1 if page > 251 else tasks > 3
