"""SentencePiece encoding and decoding by distinct chunks.

White space becomes the marker character, and no piece of the vocabulary holds a
marker after another character (checked when the model is loaded, as are the
normalisation settings that this needs). So no merge crosses the start of a run of
markers: a text is cut there, each distinct marked word is segmented once per
worker by the library, and the ids are joined back by position. Decoding is the
library's own, on the whole list of ids.

Null texts count as empty. Texts of any length are encoded whole. Repeated rows give
repeated results, an empty table an empty one; extra columns are not read."""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunk_table import slices, worker_table
from .common import small_batches, text_of

#: A run of spaces and the word behind it. The first word has the marker that the
#: library puts before every text.
_WORDS = re.compile(r" +[^ ]*")
_processors: dict = {}


def processor(model: str):
    import sentencepiece

    if model not in _processors:
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        marker = "▁"
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        crossing = [p for p in pieces if marker in p.lstrip(marker)]
        plain = sp.encode("  a\t b", out_type=str) == sp.encode("  a\t b ", out_type=str)[:-1]
        if crossing or not plain or sp.decode(sp.encode(" a  b")) != " a  b":
            raise ValueError(f"{model}: pieces may cross markers, or spaces are normalised")
        _processors[model] = sp
    return _processors[model]


def _encoder(model: str):
    sp = processor(model)

    def encode(chunks: list[str]) -> list[bytes]:
        found = sp.encode(chunks, num_threads=1)
        return [np.array(ids, "<u4").tobytes() for ids in found]

    return encode


def _chunks(text: str) -> list[str]:
    """The marked words of a text, each without its first marker, as the library puts
    one before whatever it encodes. A marker in the text itself is a space to it."""
    text = text.replace("▁", " ")
    if "  " in text or text[:1] == " " or text[-1:] == " ":
        return [c[1:] for c in _WORDS.findall(" " + text)]
    return text.split(" ") if text else []


def encode_texts(texts: list[str], model: str) -> list[bytes]:
    """Ids of each text as little-endian 32-bit integers, begin and end ids included."""
    sp = processor(model)
    table = worker_table(("pieces", model), lambda: _encoder(model))
    begin, end = (np.array([i], "<u4").tobytes() for i in (sp.bos_id(), sp.eos_id()))
    out = []
    for part in slices(texts):
        split = [_chunks(t) for t in part]
        # A single space at the end is a chunk that the library would take for an
        # empty text; such a text is encoded as a whole.
        alone = [i for i, c in enumerate(split) if c and not c[-1]]
        bodies = [b"".join(v) for v in table.columns([[] if c and not c[-1] else c for c in split])]
        for i in alone:
            bodies[i] = np.array(sp.encode(part[i]), "<u4").tobytes()
        out += [begin + b + end for b in bodies]
    return out


def decode_ids(ids: bytes, model: str) -> str:
    return processor(model).decode(np.frombuffer(ids, "<u4").tolist())


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids, decoded): ids as an array, the text that they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = encode_texts(batch.column("text").to_pylist(), model)
            flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
            offsets = np.cumsum([0] + [len(i) // 4 for i in ids]).astype(np.int32)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)),
                    "decoded": pa.array([decode_ids(i, model) for i in ids], pa.string()),
                }
            )

    small_batches(docs.sparkSession, 500)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return source.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), taken inside the tasks, so
    that no list of ids is moved."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = encode_texts(batch.column("text").to_pylist(), model)
            back = (decode_ids(i, model).encode("utf-8") for i in ids)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_tokens": pa.array([len(i) // 4 for i in ids], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(i).hexdigest() for i in ids]),
                    "decoded_sha256": pa.array([hashlib.sha256(b).hexdigest() for b in back]),
                }
            )

    small_batches(docs.sparkSession, 500)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return source.mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
