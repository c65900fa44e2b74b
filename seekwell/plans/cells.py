"""Cells over a search index: approximate search that follows refreshes.

Cells are built from the live chunks of one version. Later versions stay valid
without a rebuild: replaced chunks are dropped by the index's own anti-join,
and chunks written since are searched in full next to the probed cells.
"""

from typing import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType, StructField, StructType

from ..constants import SEARCH_DEPTH
from ..operators import ann, scoring
from ..schemas import CHUNKS
from .index import SearchIndex
from .search import embed_requests, without_ignored
from ..storage import Storage

_CENTROIDS = "cell int, center array<double>, width double"
_COLUMNS = ["folder", "path", "chunk_id", "chunk_index", "vector", "version"]


class CellIndex:
    def __init__(self, index: SearchIndex):
        self.index = index
        self._store = Storage(index.spark, index.root)

    def build(self, n_cells: int, seed: int = 17) -> int:
        """Train and store cells for the current version; returns it."""
        version = self.index.last_version()
        if version is None:
            raise ValueError("the index is empty")
        chunks = self.index.live_chunks().select(*_COLUMNS)
        centroids = ann.train_cells(chunks, n_cells, seed)
        root = f"{self.index.root}/cells/as_of={version}"
        assigned = ann.assign_cells(chunks, centroids).hint("rebalance", "cell")
        assigned.write.mode("overwrite").partitionBy("cell").parquet(f"{root}/chunks")
        widths = ann.cell_widths(self._celled(root), centroids)
        rows = [(i, [float(x) for x in c], float(w)) for i, (c, w) in enumerate(zip(centroids, widths))]
        self.index.spark.createDataFrame(rows, _CENTROIDS).coalesce(1).write.mode(
            "overwrite"
        ).parquet(f"{root}/centroids")
        self._store.write_json(f"cells/as_of={version}/done.json", {"n_cells": n_cells})
        return version

    def _celled(self, root: str) -> DataFrame:
        by_name = {f.name: f for f in CHUNKS.fields}
        fields = [by_name.get(c, StructField(c, IntegerType())) for c in [*_COLUMNS, "cell"]]
        return self.index.spark.read.schema(StructType(fields)).parquet(f"{root}/chunks")

    def current(self) -> int:
        """The newest version with cells that the index can still build on."""
        first = self.index.base_version() or 0
        names = [n for n in self._store.names("cells") if n.startswith("as_of=")]
        usable = sorted(
            v for v in (int(n.split("=")[1]) for n in names)
            if v >= first and self._store.exists(f"cells/as_of={v}/done.json")
        )
        if not usable:
            raise ValueError("no cells for the current index; build them")
        return usable[-1]

    def search_batch(
        self,
        requests: DataFrame,
        n_probe: int,
        k: int = SEARCH_DEPTH,
        patterns: Iterable[str] = (),
        pattern_files: DataFrame | None = None,
        exact: bool = False,
    ) -> DataFrame:
        """Ranked files as `plans.search_batch`, looking into `n_probe` cells. With
        `exact` also into every other cell that may change the result: chunks only leave
        a cell after it was built, so its width still holds."""
        version = self.current()
        spark, root = self.index.spark, f"{self.index.root}/cells/as_of={version}"
        stored = spark.read.schema(_CENTROIDS).parquet(f"{root}/centroids").orderBy("cell").collect()
        centroids = np.array([row["center"] for row in stored])
        newer = None
        if self.index.last_version() > version:
            newer = self.index.live_chunks(newer_than=version)
        asked = embed_requests(requests, self.index.embedder)
        rows = self.index.only_live(self._celled(root))
        metric = self.index.settings.metric
        if exact:
            widths = np.array([row["width"] for row in stored])
            top = ann.top_chunks_bounded(rows, asked, centroids, widths, n_probe, metric, k, uncelled=newer)
        else:
            top = ann.top_chunks_in_cells(rows, asked, centroids, n_probe, metric, k, uncelled=newer)
        return scoring.best_files(without_ignored(top, patterns, pattern_files))
