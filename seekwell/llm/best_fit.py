"""Best-fit packing of tokenised documents into sequences of a fixed length.

Best-fit decreasing only sees lengths, and there are at most `capacity` of them. So
documents are tokenised and their lengths counted in tasks; the fitting runs once
over the counts, with a segment tree over remaining capacities that finds the
tightest open bin in logarithmic time, and treats documents of one length and bins
of one kind as a run. It gives the same bins as placing the documents one by one,
in memory bounded by `capacity`. Its placements, a bounded table, go back to the
documents by length and rank.

A document's rank among those of its length is its rank in its task plus the number
in earlier tasks; tokenised pieces are stored before ranks are used, so that a
repeated task cannot change them. Only documents longer than `capacity` are cut:
the first piece takes the remainder, the others are full.

Null texts count as empty: one end token. Repeated rows are packed each by itself.
An empty table gives an empty result; extra columns are not read."""

import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .chunk_table import ChunkTable, kept, slices, worker_table
from .common import small_batches, text_of


class CapacityTree:
    """Numbers of open bins by remaining capacity, as a segment tree of flags."""

    def __init__(self, capacity: int):
        self._size = 1 << capacity.bit_length()
        self._count = [0] * (2 * self._size)

    def add(self, remaining: int, bins: int) -> None:
        at = self._size + remaining
        while at:
            self._count[at] += bins
            at //= 2

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of at least `length` with an open bin."""
        at = self._size + length
        if self._count[at]:
            return length
        while at > 1 and (at % 2 or not self._count[at + 1]):  # climb to a right sibling
            at //= 2
        if at <= 1:
            return None
        at += 1
        while at < self._size:
            at = 2 * at if self._count[2 * at] else 2 * at + 1
        return at - self._size


@dataclass
class _Bins:
    """A run of bins with the same filling: ids first..first+count-1."""

    first: int
    count: int
    used: int


@dataclass(frozen=True)
class Placement:
    """Documents of `length` with ranks from `rank` on, `per_bin` to a bin."""

    length: int
    rank: int
    count: int
    per_bin: int
    first_bin: int
    offset: int


def best_fit(counts: dict[int, int], capacity: int) -> list[Placement]:
    """Best-fit decreasing over a histogram of lengths from 1 to `capacity`."""
    tree, runs, out, bins = CapacityTree(capacity), {}, [], 0

    def put(run: _Bins) -> None:
        if run.count and run.used < capacity:
            runs.setdefault(capacity - run.used, []).append(run)
            tree.add(capacity - run.used, run.count)

    for length in sorted(counts, reverse=True):
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is outside 1..{capacity}")
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, whole = capacity, -(-left // (capacity // length))
                run = _Bins(bins, whole, 0)
                bins += whole
            else:
                run = runs[room].pop()
                tree.add(room, -run.count)
            per_bin = room // length
            full = min(run.count, left // per_bin)
            if full:
                out.append(Placement(length, rank, full * per_bin, per_bin, run.first, run.used))
                rank, left = rank + full * per_bin, left - full * per_bin
                put(_Bins(run.first, full, run.used + per_bin * length))
            rest = run.count - full
            if rest and left:  # fewer than per_bin documents remain: one bin takes them
                at = run.first + full
                out.append(Placement(length, rank, left, left, at, run.used))
                put(_Bins(at, 1, run.used + left * length))
                left, rest, full = 0, rest - 1, full + 1
            put(_Bins(run.first + full, rest, run.used))
    return out


#: White space other than a space or a line end.
_RARE = re.compile("[\t\v\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Letters, and what comes after them; the ranges hold nothing but letters, and the rest
#: begins with ASCII that is none. A byte-level pre-tokenizer always parts the two.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af\u0400-\u0481\u048a-\u052f"
_WORD = re.compile(f"([{_LETTERS}]+)([\0-@\\[-`{{-\x7f].*)", re.DOTALL)


#: Chunks that are encoded as one text. No token crosses the space between two.
_JOINED = 512
#: Characters of texts that are cut at a time.
_SLICE = 4_000_000
#: Chunks, and words, that a worker remembers, unless it is told of fewer.
_KNOWN = 1_120_000


class _Encoder:
    """Ids by the tokenizers library, as little-endian 32-bit integers."""

    def __init__(self, vocabulary: str, known: int = _KNOWN):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(vocabulary)
        words = self._tokenizer.get_vocab(with_added_tokens=True)
        added = {i: t.content for i, t in self._tokenizer.get_added_tokens_decoder().items()}
        self._widths = np.zeros(max(words.values()) + 1, np.int64)
        for token, i in words.items():  # a byte-level token has one character for each byte
            self._widths[i] = len(added[i].encode()) if i in added else len(token)
        self._words = ChunkTable(self._joined, known)
        [letter] = self._joined(["x"])
        self._rests = ChunkTable(
            lambda rests: [i[len(letter):] for i in self._joined(["x" + r for r in rests])], 140_000
        )

    def ids(self, texts: list[str], at_once: int = 16) -> Iterator[np.ndarray]:
        """Few texts at once, as the library's encodings are much larger than the ids."""
        for at in range(0, len(texts), at_once):
            found = self._tokenizer.encode_batch_fast(texts[at : at + at_once], add_special_tokens=False)
            yield from [np.array(e.ids, "<u4") for e in found]

    def of_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk with a space before it. What comes after a word, like the full
        stop, is encoded by itself, so that the word is encoded once whatever follows."""
        words, rests = list(chunks), {}
        for at, chunk in enumerate(chunks):
            if not chunk.isalpha() and (parted := _WORD.fullmatch(chunk)):
                words[at], rests[at] = parted.groups()
        [out] = self._words.columns([words])
        [found] = self._rests.columns([list(rests.values())])
        for at, ids in zip(rests, found):
            out[at] += ids
        return out

    def _joined(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk with a space before it. Many are encoded at a time, and the
        ids are parted by the bytes that they stand for."""
        groups = [chunks[at : at + _JOINED] for at in range(0, len(chunks), _JOINED)]
        texts = [" " + " ".join(g) for g in groups]
        out: list[bytes] = []
        for group, text, ids in zip(groups, texts, self.ids(texts)):
            written = text.encode()
            starts = np.flatnonzero(np.frombuffer(written, np.uint8) == 32)
            if len(starts) == len(group):
                ends = np.append(starts[1:], len(written))
            else:  # spaces inside chunks
                ends = np.cumsum([1 + len(c.encode()) for c in group])
            reached = np.cumsum(self._widths[ids])
            cuts = np.searchsorted(reached, ends)
            if reached[-1] != ends[-1] or (reached[cuts] != ends).any():
                raise ValueError("tokens do not part at spaces")
            data, stops = ids.tobytes(), (4 * (cuts + 1)).tolist()
            out += [data[lo:hi] for lo, hi in zip([0, *stops], stops)]
        return out


def _encoder(vocabulary: str, known: int = _KNOWN) -> _Encoder:
    return kept(("encoder", vocabulary, known), lambda: _Encoder(vocabulary, known))


def _head_and_rest(text: str) -> tuple[str, str | list[str] | None]:
    """The first piece of a text, and the others: None if there are none, joined by
    single spaces if those are all to cut at. Texts are cut at single spaces between two
    other characters. A byte-level pre-tokenizer joins such a space with what follows and
    never looks across it. The space is left out; only the first piece has none before it."""
    plain = not (
        "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " "
        or _RARE.search(text)
    )
    if plain:
        head, _, rest = text.partition(" ")
        return head, rest or None
    head, *chunks = _CUT.split(text)
    return head, chunks or None


def byte_level_ids(texts: list[str], vocabulary: str, known: int = _KNOWN) -> list[bytes]:
    """Ids of whole texts, each distinct chunk encoded once per worker. Arrow cuts the
    texts, numbers the chunks and puts their ids in a row, so that Python only handles
    the distinct chunks of a slice."""
    encoder = _encoder(vocabulary, known)
    table = worker_table(("bytes", vocabulary, known), lambda: encoder.of_chunks, known)
    out = []
    for part in slices(texts, _SLICE):
        heads, rests = zip(*map(_head_and_rest, part))
        plain = pa.array([r if isinstance(r, str) else None for r in rests], pa.large_string())
        lists = pc.split_pattern(plain, " ")
        odd = {at: r for at, r in enumerate(rests) if isinstance(r, list)}
        flat = [lists.flatten(), pa.array(list(chain.from_iterable(odd.values())), pa.large_string())]
        coded = pa.concat_arrays(flat).dictionary_encode()
        found = table.distinct(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids = pa.array(found, pa.large_binary()).take(coded.indices)
        _, places, data = ids.buffers()
        places = np.frombuffer(places, np.int64)[ids.offset :] if len(ids) else np.zeros(1, np.int64)
        data = memoryview(data) if data is not None else memoryview(b"")
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        firsts = (np.cumsum(counts) - counts).astype(np.int64)
        lasts = firsts + counts
        at_odd = int(counts.sum())
        for at, chunks in odd.items():
            firsts[at], lasts[at] = at_odd, at_odd + len(chunks)
            at_odd += len(chunks)
        bounds = zip(places[firsts].tolist(), places[lasts].tolist())
        before = encoder.ids(list(heads), 1000)
        out += [h.tobytes() + data[lo:hi] for h, (lo, hi) in zip(before, bounds)]
    return out


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[str]]]:
    """Ids and texts of consecutive batches, of about `_SLICE` characters or of one batch."""
    doc_ids, texts, size = [], [], 0
    for batch in batches:
        doc_ids += batch.column("doc_id").to_pylist()
        texts += batch.column("text").to_pylist()
        size += batch.nbytes
        if size >= _SLICE:
            yield doc_ids, texts
            doc_ids, texts, size = [], [], 0
    if texts:
        yield doc_ids, texts


def pieces(
    docs: DataFrame, vocabulary: str, capacity: int, end_id: int, known: int = _KNOWN
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, rank): rank counts, inside
    the task, the pieces of one length; full pieces have the length `capacity`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        ranks = np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        for doc_ids, texts in _together(batches):
            rows = []
            for doc, ids in zip(doc_ids, byte_level_ids(texts, vocabulary, known)):
                ids += end
                n = len(ids) // 4
                first = n % capacity or min(n, capacity)
                bounds = [0, *range(first, n + 1, capacity)]
                for k, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:])):
                    length = hi - lo
                    crc = zlib.crc32(memoryview(ids)[4 * lo : 4 * hi])
                    rows.append((doc, k, lo, length, crc, task, int(ranks[length])))
                    ranks[length] += 1
            columns = list(zip(*rows))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"]
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64()]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds)], names
                )

    small_batches(docs.sparkSession, 500)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return source.mapInArrow(
        run,
        "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long",
    )


def pack(
    docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, known: int = _KNOWN
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    spark = docs.sparkSession
    stored = materialize(pieces(docs, vocabulary, capacity, end_id, known), "pack-pieces")
    per_task = stored.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = per_task.select(
        "length", "task", "n",
        (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"),
    )
    before = materialize(before, "pack-counts")
    totals = before.groupBy("length").agg(F.sum("n").alias("n")).collect()  # <= capacity rows
    placed = best_fit({r["length"]: r["n"] for r in totals}, capacity)
    spots = spark.createDataFrame(
        [(p.length, p.rank, p.rank + p.count, p.per_bin, p.first_bin, p.offset) for p in placed],
        "length long, rank_from long, rank_to long, per_bin long, first_bin long, base long",
    )
    ranked = stored.join(before.select("length", "task", "before"), ["length", "task"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before"))
    # At most a few runs of bins per length: bounded by the capacity, not by the data.
    at = F.col("rank") - F.col("rank_from")
    found = ranked.join(F.broadcast(spots), "length").filter(
        (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    )
    return found.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_bin") + F.floor(at / F.col("per_bin"))).cast("long").alias("sequence_id"),
        (F.col("base") + F.pmod(at, "per_bin") * F.col("length")).cast("long").alias("offset"),
    )
