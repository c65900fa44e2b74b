"""Token counts of whole texts, huge ones by overlapping chunks.

A text of up to `window` characters is encoded in one piece. A longer one is cut
into chunks of `window` characters that overlap by `overlap`; each chunk is encoded
with offsets, and two neighbours are spliced in the middle of the longest run of
tokens that both give at the same places. A run counts as stable only if it has
`agreement` tokens and covers a white-space boundary, which the pre-tokenizer never
crosses, so that what lies before the overlap cannot reach behind it. Where no such
run is found, the overlap is doubled, up to the whole rest of the text.

The tokenizer drops white space, so the words between it are encoded by themselves, each
distinct one once per worker, and joined back by position. In an overlap they come with
their offsets. Elsewhere their numbers of tokens will do, and unknown words are encoded
many at a time, with a special token between two, which the tokenizer takes out before
anything else. Capitals are folded before, where that is what the tokenizer
does as well (up to Latin letters; not where a special token may be meant).

Null texts count as empty: no bytes, no tokens. Repeated rows give repeated results,
an empty table an empty one; extra columns are not read."""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunk_table import ChunkTable, slices, worker_table
from .common import small_batches, text_of

#: Unicode's White_Space characters: what the tokenizer drops.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORD = re.compile(f"[^{_WHITE}]+")
_OTHER_WHITE = re.compile("[\x1c-\x1f]")  # white space to str.split only


@dataclass(frozen=True)
class Windows:
    window: int = 16_384
    overlap: int = 512
    agreement: int = 8


def _encoder(vocabulary: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)

    def encode(words: list[str]) -> list[bytes]:
        """(id, start, end) of each token, as little-endian 32-bit integers."""
        out = []
        for e in tokenizer.encode_batch(words, add_special_tokens=False):
            ids = e.ids
            rows = np.empty((len(ids), 3), "<i4")
            rows[:, 0] = ids
            rows[:, 1:] = e.offsets if ids else 0
            out.append(rows.tobytes())
        return out

    return encode


#: Words that are encoded as one text.
_JOINED = 512


def _counter(vocabulary: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    between, token = max((i, t.content) for i, t in tokenizer.get_added_tokens_decoder().items() if t.special)

    def joined(words: list[str]) -> list[int]:
        parts = [words[at : at + _JOINED] for at in range(0, len(words), _JOINED)]
        out: list[int] = []
        for at in range(0, len(parts), 16):
            texts = [token.join(part) for part in parts[at : at + 16]]
            for found in tokenizer.encode_batch_fast(texts, add_special_tokens=False):
                ids = np.array(found.ids)
                ends = np.concatenate([[-1], np.flatnonzero(ids == between), [len(ids)]])
                out += (np.diff(ends) - 1).tolist()
        return out

    def count(words: list[str]) -> list[int]:
        """Tokens of each word."""
        odd = [w for w in words if "<|" in w or "|>" in w]
        alone = tokenizer.encode_batch_fast(odd, add_special_tokens=False) if odd else []
        known = dict(zip(odd, (len(e.ids) for e in alone)))
        plain = [w for w in words if w not in known]
        known.update(zip(plain, joined(plain)))
        return [known[w] for w in words]

    return count


_WIDTH = 12  # bytes of a token in the table


#: Letters whose lower case depends on more than the letter, or might.
_NO_FOLDING = re.compile("[\u0130\u0250-\U0010ffff]|<\\|")


def _words(text: str) -> list[str]:
    if not _NO_FOLDING.search(text):
        text = text.lower()
    return _WORD.findall(text) if _OTHER_WHITE.search(text) else text.split()


def encode_chunk(text: str, start: int, end: int, table: ChunkTable) -> np.ndarray:
    """(id, start, end) of the tokens of text[start:end], at places in the text."""
    found = [(m[0], m.start()) for m in _WORD.finditer(text, start, end)]
    if not found:
        return np.empty((0, 3), np.int32)
    words, places = zip(*found)
    values = table.columns([list(words)])[0]
    rows = np.frombuffer(b"".join(values), "<i4").reshape(-1, 3).copy()
    counts = np.array([len(v) // _WIDTH for v in values])
    rows[:, 1:] += np.repeat(np.array(places, np.int32), counts)[:, None]
    return rows


def splice_point(
    text: str, left: np.ndarray, right: np.ndarray, agreement: int
) -> tuple[int, int] | None:
    """(tokens of `left`, tokens of `right`) before the place to splice at: a white
    space inside the longest common run; None if no run is stable."""
    here = {(int(i), int(s), int(e)): k for k, (i, s, e) in enumerate(left)}
    best, run = (0, 0), []
    for k, (i, s, e) in enumerate(right):
        at = here.get((int(i), int(s), int(e)))
        if at is not None and run and at == run[-1][0] + 1 and k == run[-1][1] + 1:
            run.append((at, k))
        else:
            run = [(at, k)] if at is not None else []
        if len(run) > best[0]:
            best = (len(run), run[0][0] + 1_000_000_007 * run[0][1])
    size = best[0]
    if size < agreement:
        return None
    first_left, first_right = best[1] % 1_000_000_007, best[1] // 1_000_000_007
    order = sorted(range(1, size), key=lambda d: abs(2 * d - size))
    for d in order:  # nearest to the middle first
        end, start = int(left[first_left + d - 1, 2]), int(left[first_left + d, 1])
        if end < start and not _WORD.fullmatch(text, end, start):
            return first_left + d, first_right + d
    return None


def _tokens(text: str, numbers: ChunkTable) -> int:
    return sum(numbers.columns([_words(text)])[0])


def _whole_word(text: str, at: int, limit: int, step: int) -> int:
    """The place nearest to `at`, going by `step` up to `limit`, that parts no word."""
    while at != limit and _WORD.match(text, at - 1, at) and _WORD.match(text, at, at + 1):
        at += step
    return at


def count_long(text: str, table: ChunkTable, numbers: ChunkTable, settings: Windows) -> int:
    """Tokens of a text by overlapping chunks. Only the overlaps need offsets."""
    total, at, skip = 0, 0, 0  # skip: tokens of the chunk that were counted before
    end = min(len(text), settings.window)
    while end < len(text):
        overlap = settings.overlap
        while True:
            begin = max(at, end - overlap)
            stop = min(len(text), begin + max(settings.window, 2 * overlap))
            edge = _whole_word(text, begin, at, -1)
            left = encode_chunk(text, edge, end, table)
            right = encode_chunk(text, begin, _whole_word(text, end, stop, 1), table)
            after = left[:, 2] > begin
            cut = splice_point(text, left[after], right[right[:, 1] < end], settings.agreement)
            if cut is not None:
                before = _tokens(text[at:edge], numbers) + int((~after).sum())
                total += before + cut[0] - skip
                at, end, skip = begin, stop, cut[1]
                break
            if begin == at:  # no stable boundary in the whole chunk: make it longer
                end = min(len(text), end + settings.window + overlap)
                if end == len(text):
                    break
            overlap *= 2
    return total + _tokens(text[at:], numbers) - skip


def counts(texts: list[str], vocabulary: str, settings: Windows = Windows()) -> list[int]:
    table = worker_table(("words", vocabulary), lambda: _encoder(vocabulary))
    numbers = worker_table(("counts", vocabulary), lambda: _counter(vocabulary), 1_500_000)
    out = []
    for part in slices(texts):
        whole = [_words(t) if len(t) <= settings.window else [] for t in part]
        for text, values in zip(part, numbers.columns(whole)):
            if len(text) <= settings.window:
                out.append(sum(values))
            else:
                out.append(count_long(text, table, numbers, settings))
    return out


def token_counts(
    docs: DataFrame, vocabulary: str, limit: int = 2048, settings: Windows = Windows()
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            texts = batch.column("text")
            n = np.array(counts(texts.to_pylist(), vocabulary, settings), np.int64)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_bytes": pc.binary_length(texts).cast(pa.int64()),
                    "n_tokens": pa.array(n),
                    "over_limit": pa.array(n > limit),
                }
            )

    small_batches(docs.sparkSession, 500)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return source.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
