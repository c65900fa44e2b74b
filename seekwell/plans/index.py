"""The search index: versions of two tables.

    meta.json          dimension, metric, chunker: fixed at creation
    layout.json        number of buckets: fixed by the first version
    manifest           files touched by each version
    chunks             chunks of the files that each version added or modified
    rejects            files that each version left out, with the reason
    commits/k.json     written last; a version without it does not exist

A manifest row names the version whose rows it replaces (`prev_version`). The
live view is therefore the stored rows minus those of replaced keys: an anti-join
whose right side grows with the changes since the last compaction, not with the
corpus. Commit files record how many keys that is and how large, so the size is
known before a join is planned: up to a limit the keys are broadcast, beyond it
both tables are joined bucket by bucket. Chunks are never shuffled to be searched.

One writer at a time is assumed.
"""

from dataclasses import asdict, dataclass
from math import ceil
from typing import Callable, Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..constants import (
    LINE_OVERLAP,
    LINES_PER_CHUNK,
    MAX_BROADCAST_BYTES,
    MAX_FILE_BYTES,
    MAX_TOKENS_PER_REQUEST,
    TOKENS_PER_CHUNK,
)
from ..functions import ids, paths
from ..functions.ids import FOLDER_PARTS
from ..operators import chunking, diff, filters, ignore
from ..operators.embedding import Embedder, HashedWords, embed
from ..schemas import CHUNKS, DELTA, FILES, MANIFEST, REJECTS, require
from ..session import broadcast_if_small, discard, input_bytes, materialize
from ..storage import Storage
from .tables import KEY, VersionedTable, table_schema

_BUCKET_BYTES = 512 * 1024 * 1024  # of a first snapshot, as the planner knows it
_MIN_BUCKETS, _MAX_BUCKETS = 8, 65_536
_SORTED_BYTES = 256 * 1024 * 1024  # of chunks that a task puts in order to write them
_LINE_BYTES, _TOKEN_BYTES = 20, 4  # about, at the least
_SCHEMAS = {"manifest": MANIFEST, "chunks": CHUNKS, "rejects": REJECTS}


@dataclass(frozen=True)
class IndexSettings:
    """What a stored index depends on. Opening it with other values fails."""

    dim: int
    embedder: str
    metric: str = "cosine"
    chunker: str = "lines"  # or "tokens"
    chunk_size: int = LINES_PER_CHUNK
    overlap: int = LINE_OVERLAP
    buckets: int | None = None  # taken from the first snapshot if not given


@dataclass(frozen=True)
class FileRules:
    """Which files of a snapshot are indexed."""

    by_name: bool = True
    max_bytes: int | None = MAX_FILE_BYTES
    patterns: tuple[str, ...] = ()
    defaults: bool = True
    pattern_files: bool = False  # read the pattern files inside the snapshot


def line_settings(embedder: Embedder, metric: str = "cosine") -> IndexSettings:
    return IndexSettings(dim=embedder.dim, embedder=embedder.name, metric=metric)


def token_settings(
    embedder: Embedder, metric: str = "cosine", size: int = TOKENS_PER_CHUNK
) -> IndexSettings:
    return IndexSettings(embedder.dim, embedder.name, metric, "tokens", size, 0)


@dataclass(frozen=True)
class View:
    """The versions that make up a state, and how many keys among them are
    replaced."""

    versions: list[int]
    replaced: int
    replaced_bytes: int


def _is_change() -> Column:
    """Rows to write: changes, and conflicts even where one side is as before."""
    return (F.col("status") != "same") | (F.col("conflict") == 1)


@dataclass(frozen=True)
class Reading:
    """A snapshot as one pass over it left it: `judged(folder, path, content, size, hash,
    reason)`, and how many files have a reason to be left out. Contents are there where
    they may be needed, or nowhere if `whole` is false."""

    judged: DataFrame
    rejected: int
    whole: bool
    files: int  # that are needed
    size: int  # of these, in bytes

    @property
    def kept(self) -> DataFrame:
        return self.judged.filter("reason IS NULL")


class SearchIndex:
    def __init__(
        self,
        spark: SparkSession,
        root: str,
        embedder: Embedder | None = None,
        settings: IndexSettings | None = None,
        rules: FileRules = FileRules(),
        chunk: Callable[[DataFrame], DataFrame] | None = None,
        reuse_vectors: bool = False,
    ):
        """Open the index at `root`, creating it if missing. `chunk` replaces the
        built-in chunkers; it adds `chunk_texts`. With `reuse_vectors` a changed or moved
        file keeps the vectors of texts that the version before had in any changed file:
        worth it where the model costs more than a join of the changed chunks."""
        self.spark = spark
        self.embedder = embedder or HashedWords()
        self.settings = settings or line_settings(self.embedder)
        self.rules = rules
        self._chunk = chunk or self._built_in_chunks
        self._reuse = reuse_vectors
        self._store = Storage(spark, root)
        self.root = self._store.root
        self._tables: dict[str, VersionedTable] = {}
        self._create_or_check()

    # -- creation and versions -------------------------------------------------

    def _create_or_check(self) -> None:
        wanted = asdict(self.settings)
        del wanted["buckets"]
        if self.embedder.dim != self.settings.dim:
            raise ValueError(
                f"model gives {self.embedder.dim} dimensions, index has {self.settings.dim}"
            )
        if not self._store.exists("meta.json"):
            self._store.write_json("meta.json", wanted)
            return
        have = self._store.read_json("meta.json")
        if have != wanted:
            raise ValueError(f"index at {self.root} was made with {have}, not {wanted}")

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        names = self._store.names("commits")
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def commit_info(self, version: int) -> dict:
        return self._store.read_json(f"commits/{version}.json")

    def last_version(self) -> int | None:
        found = self.versions()
        return found[-1] if found else None

    def _view(self, as_of: int | None = None) -> View:
        """What makes up the state at `as_of`, from one commit file."""
        versions = [v for v in self.versions() if as_of is None or v <= as_of]
        if not versions:
            return View([], 0, 0)
        last = self.commit_info(versions[-1])
        return View(
            [v for v in versions if v >= last["base_version"]],
            last["replaced_since_base"],
            last["replaced_bytes_since_base"],
        )

    def _commit(self, version: int, base: bool, stats: dict, stream=None, batch=None) -> dict:
        """Make a version visible. Totals since the last compaction and the last
        batch of each stream are carried along, so that one file tells all."""
        last = self.last_version()
        before = self.commit_info(last) if last else {}
        start = base or not before
        commit = {
            "version": version,
            "base": start,
            "base_version": version if start else before["base_version"],
            "streams": dict(before.get("streams", {})),
            **stats,
        }
        for name in ("replaced", "replaced_bytes"):
            earlier = 0 if start else before[f"{name}_since_base"]
            commit[f"{name}_since_base"] = earlier + stats[name]
        if stream is not None:
            commit["streams"][stream] = batch
            if batch == 0 or before.get("alone") == stream:
                commit["alone"] = stream
        self._store.write_json(f"commits/{version}.json", commit)
        return commit

    def should_compact(self, max_versions: int = 200) -> bool:
        """Whether replaced keys no longer fit a broadcast, or versions are many."""
        view = self._view()
        return view.replaced_bytes > MAX_BROADCAST_BYTES or len(view.versions) > max_versions

    def is_applied(self, stream: str, batch: int) -> bool:
        last = self.last_version()
        done = self.commit_info(last)["streams"].get(stream) if last else None
        return done is not None and done >= batch

    # -- stored tables and live views ------------------------------------------

    def _lay_out(self, files: DataFrame) -> int:
        """The number of buckets, chosen before the first version is written."""
        if not self._store.exists("layout.json"):
            size = input_bytes(files)
            wanted = ceil(size / _BUCKET_BYTES) if size < 2**60 else _MIN_BUCKETS  # unknown sizes are huge
            buckets = self.settings.buckets or min(max(wanted, _MIN_BUCKETS), _MAX_BUCKETS)
            self._store.write_json("layout.json", {"buckets": buckets})
        return self.buckets()

    def buckets(self) -> int:
        return self._store.read_json("layout.json")["buckets"]

    def _folder_parts(self) -> int:
        """As many as buckets, but a power of two, so that files do not get tiny."""
        return min(FOLDER_PARTS, 1 << (self.buckets().bit_length() - 1))

    def _table(self, name: str) -> VersionedTable:
        if name not in self._tables:
            parts = self._folder_parts() if name == "chunks" else 0
            self._tables[name] = VersionedTable(
                self.spark, self._store, name, _SCHEMAS[name], self.buckets(), parts
            )
        return self._tables[name]

    def _stored(self, table: str, versions: list[int]) -> DataFrame:
        """Rows with `version`, chunks also with `folder_part`."""
        if not versions:
            return self.spark.createDataFrame([], table_schema(_SCHEMAS[table], table == "chunks"))
        return self._table(table).read(versions)

    def _live(
        self, rows: DataFrame, view: View, among: DataFrame | None = None, send: bool = True
    ) -> DataFrame:
        """Rows not replaced by a later version of the view. `among` limits the
        work to some keys; without `send` the join is bucket by bucket at any size."""
        if among is not None:
            rows = rows.join(among, KEY, "left_semi")
        if not view.replaced:
            return rows
        gone = (
            self._stored("manifest", view.versions)
            .filter(F.col("prev_version") >= view.versions[0])
            .select(*KEY, F.col("prev_version").alias("_gone"))
        )
        if among is not None:
            gone = gone.join(among, KEY, "left_semi")
        gone = gone.select(F.col("folder").alias("_folder"), F.col("path").alias("_path"), "_gone")
        if send and view.replaced_bytes <= MAX_BROADCAST_BYTES:
            gone = F.broadcast(gone)  # size recorded by the commits
        elif view.replaced_bytes <= self.buckets() * MAX_BROADCAST_BYTES:
            gone = gone.hint("shuffle_hash")  # bucket by bucket, in memory
        # a file's rows of the replaced version and of all before it are gone
        same = (F.col("folder") == F.col("_folder")) & (F.col("path") == F.col("_path"))
        return rows.join(gone, same & (F.col("version") <= F.col("_gone")), "left_anti")

    def live_files(self, as_of: int | None = None, among: DataFrame | None = None) -> DataFrame:
        """`(folder, path, hash, version)` of every indexed file."""
        view = self._view(as_of)
        rows = self._stored("manifest", view.versions).filter(F.col("op") == "U")
        return self._live(rows.select(*KEY, "hash", "version"), view, among)

    def live_chunks(
        self, as_of: int | None = None, newer_than: int | None = None, parts: Iterable[int] | None = None
    ) -> DataFrame:
        """Chunks of every indexed file. `parts` (of `FOLDER_PARTS`) limits the partitions
        that are read, to those that hold the folders of these parts; `newer_than` leaves out the chunks that
        were written by that version or before."""
        view = self._view(as_of)
        wanted = [v for v in view.versions if newer_than is None or v > newer_than]
        rows = self._stored("chunks", wanted)
        if parts is not None and wanted:
            places = {p % self._folder_parts() for p in parts}
            rows = rows.filter(F.col("folder_part").isin(sorted(places)))
        return self._live(rows, view)

    def base_version(self) -> int | None:
        """The version the current view starts at."""
        versions = self._view().versions
        return versions[0] if versions else None

    def only_live(self, rows: DataFrame) -> DataFrame:
        """Rows of a table with folder, path and version that are still valid."""
        return self._live(rows, self._view())

    # -- building and refreshing -----------------------------------------------

    def _not_ignored(self, files: DataFrame) -> DataFrame:
        rules = self.rules
        if rules.pattern_files:
            files = ignore.filter_ignored_by_folder(files, rules.defaults)
        if rules.patterns or rules.defaults and not rules.pattern_files:
            files = ignore.filter_ignored(files, rules.patterns, rules.defaults)
        return files

    def _judged(self, files: DataFrame, *carried: str) -> DataFrame:
        """The files that no pattern hides, with `hash` or the `reason` why they are not
        indexed."""
        require(files, FILES, "files")
        failed = F.col("error").isNotNull() if "error" in files.columns else F.lit(False)
        rows = self._not_ignored(files.select(*[f.name for f in FILES.fields], *carried, failed.alias("_failed")))
        by_tokens = self.settings.chunker == "tokens" and self._chunk == self._built_in_chunks
        reason = filters.reject_reason(
            F.col("_failed"), self.rules.by_name, self.rules.max_bytes,
            MAX_TOKENS_PER_REQUEST if by_tokens else None,
        )
        rows = rows.select(*KEY, "content", "size", *carried, reason.alias("reason"))
        return rows.withColumn("hash", F.when(F.col("reason").isNull(), ids.content_hash(F.col("content"))))

    def prepared(self, files: DataFrame, *carried: str) -> DataFrame:
        """The files to index, with their content hash. Columns named by `carried` are
        kept."""
        judged = self._judged(files, *carried)
        return judged.filter("reason IS NULL").drop("reason")

    def _read(self, files: DataFrame, live: DataFrame | None = None) -> Reading:
        """Go through a snapshot once: every file is opened, judged and hashed, and its
        content kept in the shared folder if `live` has not the same. If the live keys
        are too many to be sent to the tasks, no content is kept, as it would have to be
        shuffled; contents of changed files are then read again."""
        judged = self._judged(files)
        needed, whole = F.col("reason").isNull(), True
        if live is not None:
            known = live.select(*KEY, F.col("hash").alias("_known"))
            sizes = sum((F.octet_length(c) for c in (*KEY, "_known")), F.lit(16))
            whole = known.agg(F.coalesce(F.sum(sizes), F.lit(0)).alias("n")).first()["n"] <= MAX_BROADCAST_BYTES
        if live is not None and whole:
            judged = judged.join(F.broadcast(known), KEY, "left")
            needed &= ~F.col("hash").eqNullSafe(F.col("_known"))
        if not whole:
            needed = F.lit(False)
        seen = Observation()
        rows = judged.select(*KEY, F.when(needed, F.col("content")).alias("content"), "size", "hash", "reason")
        counted = F.col("content").isNotNull() if whole else F.col("reason").isNull()
        rows = rows.observe(
            seen, F.count("reason").alias("rejected"), F.count_if(counted).alias("files"),
            F.coalesce(F.sum(F.when(counted, F.col("size"))), F.lit(0)).alias("size"),
        )
        judged = materialize(rows, "judged")
        return Reading(judged, seen.get["rejected"], whole, seen.get["files"], seen.get["size"])

    def _built_in_chunks(self, files: DataFrame) -> DataFrame:
        if self.settings.chunker == "lines":
            return chunking.with_line_chunks(
                files, self.settings.chunk_size, self.settings.overlap
            )
        return chunking.with_token_chunks(files, self.settings.chunk_size)

    def build(self, files: DataFrame) -> dict:
        """First indexing of a snapshot. Same as `refresh` on an empty index."""
        if self.versions():
            raise ValueError(f"index at {self.root} is not empty, use refresh")
        return self.refresh(files)

    def refresh(self, files: DataFrame, folders: Iterable[str] | None = None) -> dict:
        """Bring the index to a full snapshot: files that are gone, blank or newly
        ignored leave it. `folders` limits the comparison to those folders, for a
        snapshot that holds only them. Files whose `error` says that they could not be
        read stay as they are in the index. Returns the commit."""
        version = (self.last_version() or 0) + 1
        live = self.live_files()
        if folders is not None:
            names = list(folders)
            files = files.filter(F.col("folder").isin(names))
            live = live.filter(F.col("folder").isin(names))
        reading = self._read(files, None if version == 1 else live)
        prepared = reading.kept
        if "error" in files.columns:
            failed = reading.judged.filter("reason = 'unreadable'").select(*KEY)
            live = live.join(failed, KEY, "left_anti")
        keys = diff.snapshot_keys(prepared)
        if version == 1:
            changed = keys.select(
                "*", F.lit("added").alias("status"), F.lit(None).cast("string").alias("old_hash"),
                F.lit(None).cast("int").alias("prev_version"),
            )
        else:
            found = diff.snapshot_diff(live.withColumnRenamed("version", "prev_version"), keys)
            changed = found.filter(_is_change()).withColumnRenamed("new_hash", "hash")
        contents = prepared if reading.whole else self.prepared(files)
        return self._apply(version, changed, contents, reading, every=version == 1)

    def apply_changes(
        self, delta: DataFrame, stream: str | None = None, batch: int | None = None
    ) -> dict:
        """Apply rows `(folder, path, content, op, seq)`: `U` stores a file, `D`
        removes it; the highest `seq` of a path wins, also over changes that were
        applied before. Files not named stay. A file whose new content may not be
        indexed is removed. Unknown `op`s, null `seq`s and a path that is both stored
        and removed under one `seq` raise.

        With `stream` and `batch` a replayed batch is recognized and skipped."""
        if stream is not None and self.is_applied(stream, batch):
            return self.commit_info(self.last_version())
        version = (self.last_version() or 0) + 1
        delta = require(delta, DELTA, "changes")
        known = F.col("op").isin("U", "D") & F.col("seq").isNotNull()
        other = delta.filter(~F.coalesce(known, F.lit(False)))
        wrong = other.agg(F.first(F.struct("op", "seq")).alias("row")).first()["row"]
        if wrong:
            raise ValueError(f"change with op {wrong['op']!r} and seq {wrong['seq']!r}")
        every = delta.groupBy(*KEY, "seq").agg(F.min("op").alias("op"), F.max("op").alias("other"))
        last = every.groupBy(*KEY).agg(
            F.max("seq").alias("seq"), F.max_by("op", "seq").alias("op"),
            F.max_by("other", "seq").alias("other"),
        )
        noted = last = materialize(last, "last-changes")  # read several times, and few beside the contents
        if last.agg(F.count_if(F.col("op") != F.col("other")).alias("n")).first()["n"]:
            raise ValueError("a file is both stored and removed under one seq")
        named = broadcast_if_small(last.select(*KEY))
        last = self._newer(last.select(*KEY, "op", "seq"), named)
        upserts = delta.filter(F.col("op") == "U").join(
            last.filter(F.col("op") == "U").select(*KEY, "seq"), [*KEY, "seq"], "left_semi"
        )
        # a small batch is sent to the stored manifest, which then stays in place
        live = self.live_files(among=named).select(
            *KEY, F.col("hash").alias("old_hash"), F.col("version").alias("prev_version")
        )
        changed = last.select(*KEY, "seq").join(live, KEY, "left")
        reading = self._read(upserts.select(*KEY, "content", F.octet_length("content").cast("long").alias("size")))
        commit = self._apply_named(version, changed, reading, stream, batch)
        discard(noted)
        return commit

    def apply_last_changes(self, heads: DataFrame, stream: str, batch: int) -> dict:
        """Apply stored rows like `streaming.latest.HEADS`, one per file, which tell what the
        index held before; so nothing stored is read. Their contents were judged in the
        stream and are taken from where they are. Only for a stream that `follows` the
        index or starts."""
        if self.is_applied(stream, batch):
            return self.commit_info(self.last_version())
        version = (self.last_version() or 0) + 1
        # whichever version holds a file's rows, all up to the last one are replaced
        named = heads.select(
            *KEY, "seq", "old_hash",
            F.when(F.col("old_hash").isNotNull(), F.lit(version - 1)).alias("prev_version"),
        )
        size = F.octet_length("content").cast("long")
        judged = heads.filter("hash IS NOT NULL").select(
            *KEY, "content", size.alias("size"), "hash", F.lit(None).cast("string").alias("reason")
        )
        sums = judged.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
        reading = Reading(judged, 0, True, sums["files"], sums["size"])
        return self._apply_named(version, named, reading, stream, batch)

    def follows(self, stream: str) -> bool:
        """Whether this stream alone wrote all versions since it started, so that its
        state tells what the index holds."""
        last = self.last_version()
        return bool(last) and self.commit_info(last).get("alone") == stream

    def heads(self) -> DataFrame:
        """`(folder, path, seq, hash)`: what is indexed, and the last change applied to
        each file that came with a number."""
        numbered = self._stored("manifest", self._view().versions).filter("seq IS NOT NULL")
        numbered = numbered.groupBy(*KEY).agg(F.max("seq").alias("seq"))
        return self.live_files().select(*KEY, "hash").join(numbered, KEY, "full_outer")

    def _apply_named(
        self, version: int, named: DataFrame, reading: Reading, stream: str | None, batch: int | None
    ) -> dict:
        """Apply changes of the files `named(folder, path, seq, old_hash, prev_version)`;
        those that `reading` keeps are stored, the others leave."""
        prepared = reading.kept
        status = (
            F.when(F.col("hash").isNull() & F.col("old_hash").isNull(), "same")
            .when(F.col("hash").isNull(), "deleted")
            .when(F.col("old_hash").isNull(), "added")
            .when(F.col("hash") != F.col("old_hash"), "modified")
            .otherwise("same")
        )
        changed = named.join(diff.snapshot_keys(prepared), KEY, "left").withColumn("status", status)
        return self._apply(version, changed, prepared, reading, stream=stream, batch=batch)

    def _newer(self, last: DataFrame, named: DataFrame) -> DataFrame:
        """The changes of the files `named` that no applied change of the same file comes
        after."""
        versions = self._view().versions
        if not versions:
            return last
        seen = self._stored("manifest", versions).filter(F.col("seq").isNotNull())
        seen = seen.join(named, KEY, "left_semi")
        seen = seen.groupBy(*KEY).agg(F.max("seq").alias("applied"))
        joined = last.join(seen, KEY, "left")
        return joined.filter("applied IS NULL OR seq >= applied").drop("applied")

    def _apply(
        self,
        version: int,
        changed: DataFrame,
        prepared: DataFrame,
        reading: Reading,
        every: bool = False,
        stream: str | None = None,
        batch: int | None = None,
    ) -> dict:
        """Write rejects and manifest, then the chunks of changed files, then commit.
        What was read for it is removed."""
        buckets = self._lay_out(prepared)
        if reading.rejected:
            left_out = reading.judged.filter("reason IS NOT NULL").select(*KEY, "size", "reason")
            self._table("rejects").write(left_out.repartition(buckets, *KEY), version)
        else:
            self._table("rejects").clear(version)
        deleted = F.col("status") == "deleted"
        # A change that alters nothing is only noted, so that its seq is known.
        noted = (F.col("status") == "same") & (F.coalesce("conflict", F.lit(0)) == 0)
        op = F.when(deleted, "D").when(noted, "S").otherwise("U")
        rows = changed.select(
            *KEY, "hash", op.alias("op"), "status", "old_hash",
            F.when(~noted, F.col("prev_version")).alias("prev_version"), F.coalesce("copies", F.lit(0)).alias("copies"),
            F.coalesce("conflict", F.lit(0)).alias("conflict"),
            (F.col("seq") if "seq" in changed.columns else F.lit(None).cast("long")).alias("seq"),
        )
        self._table("manifest").write(rows.repartition(buckets, *KEY), version)
        manifest = self._stored("manifest", [version])

        key_bytes = F.octet_length("folder") + F.octet_length("path") + F.lit(16)
        replaces = F.col("prev_version").isNotNull()
        stats = manifest.agg(
            *[F.count_if(F.col("status") == s).alias(s) for s in ("added", "modified", "deleted")],
            F.count_if(replaces).alias("replaced"),
            F.coalesce(F.sum(F.when(replaces, key_bytes)), F.lit(0)).alias("replaced_bytes"),
            F.coalesce(F.sum(key_bytes + 64), F.lit(0)).alias("key_bytes"),
            F.coalesce(F.max("copies"), F.lit(0)).alias("copies"),
            F.coalesce(F.sum("conflict"), F.lit(0)).alias("conflicts"),
        ).first().asDict()
        conflicts = stats.pop("conflicts")
        if conflicts:
            raise ValueError(f"{conflicts} files were given with different contents")

        fresh = manifest.filter(F.col("op") == "U").select(*KEY, "hash")
        contents = prepared.select(*KEY, "content", "hash")
        if not every:
            small = stats["key_bytes"] <= MAX_BROADCAST_BYTES
            contents = contents.join(
                F.broadcast(fresh) if small else fresh, [*KEY, "hash"], "left_semi"
            )
        if stats.pop("copies") > 1:
            contents = contents.dropDuplicates(KEY)
        stats.pop("key_bytes")
        known = None
        if self._reuse and stats["replaced"]:
            small = stats["replaced_bytes"] <= MAX_BROADCAST_BYTES
            known = self._known_vectors(manifest.filter(replaces).select(*KEY), small)
        stats["rejected"] = reading.rejected
        stats["embedded"] = self._write_chunks(version, contents, reading, known)
        commit = self._commit(version, False, stats, stream, batch)
        discard(reading.judged)
        return commit

    def _known_vectors(self, replaced: DataFrame, small: bool) -> DataFrame:
        """`(text_key, vector)` of the chunks that the files `replaced` still have, so
        that neither what an edit left alone nor what moved is embedded again."""
        old = self.live_chunks().select(*KEY, "text", "vector")
        old = old.join(F.broadcast(replaced) if small else replaced, KEY, "left_semi")
        return old.select(F.sha2("text", 256).alias("text_key"), "vector").dropDuplicates(["text_key"])

    def _write_parts(self, reading: Reading) -> int:
        """How many tasks write the chunks of a snapshot: a multiple of the buckets, so that
        each task has files of one bucket, and so many that none sorts much at once."""
        lines = self.settings.chunker == "lines"
        step = max(1, self.settings.chunk_size - self.settings.overlap)
        chunks = reading.files + reading.size // (step * (_LINE_BYTES if lines else _TOKEN_BYTES))
        size = 2 * reading.size + chunks * 4 * self.settings.dim
        return self.buckets() * max(1, ceil(size / (self.buckets() * _SORTED_BYTES)))

    def _write_chunks(
        self, version: int, contents: DataFrame, reading: Reading, known: DataFrame | None = None
    ) -> int:
        """Chunk, embed and store; returns how many chunks were embedded."""
        chunked = self._chunk(contents.repartition(self._write_parts(reading), *KEY))
        rows = chunking.explode_chunks(chunked, *KEY, "hash")
        absolute = paths.join_path(F.col("folder"), F.col("path"))
        rows = rows.select(
            *KEY,
            "hash",
            "chunk_index",
            ids.chunk_id(absolute, F.col("chunk_index")).alias("chunk_id"),
            "text",
        )
        if known is not None:
            keyed = rows.withColumn("text_key", F.sha2("text", 256)).join(known, "text_key", "left")
            rows = materialize(keyed.drop("text_key"), "chunks-known")
        seen = Observation()
        whole = rows
        new = rows if known is None else rows.filter("vector IS NULL").drop("vector")
        new = new.withColumn("vector", embed(F.col("text"), self.embedder))
        new = new.observe(seen, F.count(F.lit(1)).alias("embedded"))
        if known is not None:
            new = new.unionByName(rows.filter("vector IS NOT NULL"))
        self._table("chunks").write(new, version)
        discard(whole)
        return seen.get["embedded"]

    # -- upkeep ----------------------------------------------------------------

    def compact(self) -> dict:
        """Rewrite the live view as one version, so that later reads need no
        anti-join. Chunks are not shuffled: what was read bucket by bucket is written
        so again. Old versions stay on disk until their owner removes them."""
        version, view = (self.last_version() or 0) + 1, self._view()
        live = self.live_files()
        chunks = self._live(self._stored("chunks", view.versions), view, send=False)
        noted = (
            self._stored("manifest", view.versions).filter("seq IS NOT NULL")
            .groupBy(*KEY).agg(F.max("seq").alias("seq"))
        )
        self._table("chunks").write(chunks, version)
        rest = [
            F.lit("compacted").alias("status"), F.lit(None).cast("string").alias("old_hash"),
            F.lit(None).cast("int").alias("prev_version"),
            F.lit(1).cast("long").alias("copies"), F.lit(0).alias("conflict"),
        ]
        kept = live.select(
            *KEY, "hash", F.lit("U").alias("op"), *rest, F.lit(None).cast("long").alias("seq")
        )
        marks = noted.select(
            *KEY, F.lit(None).cast("string").alias("hash"), F.lit("S").alias("op"), *rest, "seq"
        )
        rows = kept.unionByName(marks).repartition(self.buckets(), *KEY)
        self._table("manifest").write(rows, version)
        names = ("added", "modified", "deleted", "replaced", "replaced_bytes", "embedded", "rejected")
        nothing = dict.fromkeys(names, 0)
        return self._commit(version, True, nothing)

    def inspect(self) -> DataFrame:
        """Per folder: live files, chunks, files without chunks, chunks whose file
        is unknown, chunks with a wrong dimension."""
        counted = (
            self.live_chunks()
            .groupBy(*KEY)
            .agg(
                F.count("*").alias("chunks"),
                F.count_if(F.size("vector") != self.settings.dim).alias("wrong_dim"),
            )
        )
        both = self.live_files().select(*KEY, F.lit(1).alias("known")).join(
            counted, KEY, "full_outer"
        )
        return both.groupBy("folder").agg(
            F.count("known").alias("files"),
            F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"),
            F.count_if(F.col("chunks").isNull()).alias("files_without_chunks"),
            F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("chunks"))), F.lit(0)).alias(
                "orphan_chunks"
            ),
            F.coalesce(F.sum("wrong_dim"), F.lit(0)).alias("wrong_dim"),
        )

    def rejects(self, version: int | None = None) -> DataFrame:
        """`(folder, path, size, reason, version)` of the files that a version, or any,
        left out. Files hidden by patterns are not part of a snapshot and not listed;
        those of a keyed stream are judged in the stream and are not either."""
        wanted = [v for v in self.versions() if version is None or v == version]
        return self._stored("rejects", wanted)

    def run_stats(self) -> DataFrame:
        """What each committed version changed."""
        schema = "version int, base boolean, added long, modified long, deleted long, replaced long, embedded long"
        commits = [f"{self.root}/commits/{v}.json" for v in self.versions()]
        if not commits:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("multiLine", True).json(commits)
