"""Tables of distinct chunks: each distinct piece of text is encoded once and the
results are joined back by position.

The table lives in the Python worker and so outlasts a task, until tasks of other work
let it go. It is a memo of two
generations: when the younger one is full, it becomes the older one, whose chunks come
back when they are met again. So memory is bounded, frequent chunks stay, and results
are not affected. Long chunks are encoded but not kept."""

import gc
from collections.abc import Callable

_LONG = 48


class ChunkTable:
    def __init__(self, encode: Callable[[list[str]], list], limit: int = 560_000):
        self._encode = encode
        self._limit = limit
        self._known: dict[str, object] = {}
        self._older: dict[str, object] = {}

    def columns(self, documents: list[list[str]]) -> list[list]:
        """For each list of chunks the list of their encoded values."""
        known, older = self._known, self._older
        missing = set().union(*documents).difference(known)
        again = {c for c in missing if c in older}  # looks up the few, not through all of `older`
        known.update((c, older[c]) for c in again)
        fresh = list(missing - again)
        if fresh:
            known.update(zip(fresh, self._encode(fresh)))
        out = [list(map(known.__getitem__, chunks)) for chunks in documents]
        self._forget(fresh)
        return out

    def distinct(self, chunks: list[str]) -> list:
        """The encoded value of each of some chunks that are all different. Most are known,
        so each is looked up once and no set is made of them."""
        known, older = self._known, self._older
        out = list(map(known.get, chunks))
        missing = [at for at, value in enumerate(out) if value is None]
        found = [older.get(chunks[at]) for at in missing]
        fresh = [chunks[at] for at, value in zip(missing, found) if value is None]
        encoded = iter(self._encode(fresh) if fresh else ())
        for at, value in zip(missing, found):
            known[chunks[at]] = out[at] = next(encoded) if value is None else value
        self._forget(fresh)
        return out

    def _forget(self, fresh: list[str]) -> None:
        """Keep no long chunks, and two generations of the others."""
        known = self._known
        for chunk in fresh:
            if len(chunk) > _LONG:
                del known[chunk]
        if 2 * len(known) > self._limit:
            self._older, self._known = known, {}


#: What this worker keeps between tasks: tables, and encoders with tables of their own.
_kept: dict[tuple, object] = {}


def kept(key: tuple, make: Callable[[], object]) -> object:
    """What this worker keeps for `key`, made at its first use."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def worker_table(
    key: tuple, make: Callable[[], Callable[[list[str]], list]], limit: int = 560_000
) -> ChunkTable:
    """The table of this worker for `key`, made at its first use."""
    return kept(("table", *key), lambda: ChunkTable(make(), limit))


def let_go() -> None:
    """Free what is kept. Workers outlive a stage and take tasks of other work, beside
    which full tables, some hundreds of MB, are not to lie; tasks that use no table call
    this when they begin."""
    if _kept:
        _kept.clear()
        gc.collect()  # encoders and their tables refer to each other


def slices(texts: list[str], characters: int = 1_000_000) -> list[list[str]]:
    """Consecutive texts, cut so that each slice holds about so many characters."""
    out, size = [[]], 0
    for t in texts:
        if out[-1] and size + len(t) > characters:
            out.append([])
            size = 0
        out[-1].append(t)
        size += len(t)
    return out
