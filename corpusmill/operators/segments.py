"""A neighbour index that stays laid out by cell while vectors keep arriving.

New vectors are written as a segment, a folder with one folder per cell. Segments of a level are merged into one of
the next level when there are FANOUT of them, so a vector is rewritten once a level. A cell that has grown too large
is split in two, and only its own rows move. A search lists the folders of the cells it probes and no others.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusmill.functions.vectors import normalise
from corpusmill.operators.ann import ROUND, InvertedLists, _rounds, inverted_index
from corpusmill.operators.snapshots import SnapshotLog
from corpusmill.operators.topk import named, rank, scan_top_k
from corpusmill.operators.upsert import latest_per_key
from corpusmill.session import scratch_path

#: Segments of one level that are merged into one.
FANOUT = 4
#: Rows of a cell from which it is split, and rows at most that the split learns from.
CELL_ROWS, LEARNT = 1_000_000, 50_000
_DIR, _DATA, _MODELS, _GONE = "at", "data", "models", "gone"


class CellIndex:
    """Rows ``id, embedding, cell, codes`` in segments; of an id that came several times the latest row counts.

    A generation of the log names the segments with the rows of each of their cells, the table of centres, and the
    ids that came again. One writer at a time; readers keep the generation that they started with.
    """

    def __init__(self, spark: SparkSession, path: str, *, id_type: str = "bigint", fanout: int = FANOUT, cell_rows: int = CELL_ROWS) -> None:
        self.spark, self.path, self.fanout, self.cell_rows = spark, path.rstrip("/"), fanout, cell_rows
        self.schema = StructType.fromDDL(f"id {id_type}, embedding array<float>, cell int, codes binary, seq long")
        self.gone = StructType.fromDDL(f"id {id_type}, until long")
        self.log = SnapshotLog(spark, self.path)

    # --- what a generation holds ------------------------------------------------------------

    def create(self, lists: InvertedLists) -> None:
        """An empty index with these centres and code words."""
        if not self.log.commit(0, {"model": self._write_model(lists), "segments": [], "gone": [], "seq": 0, "batch": -1}):
            raise ValueError(f"{self.path} exists already")

    def _write_model(self, lists: InvertedLists) -> str:
        folder = f"{_MODELS}/{uuid.uuid4().hex}"
        rows = [(-1, at, [float(x) for x in row]) for at, row in enumerate(lists.centres)]
        rows += [(part, at, [float(x) for x in row]) for part, words in enumerate(lists.words) for at, row in enumerate(words)]
        self.spark.createDataFrame(rows, "part int, number int, centre array<double>").coalesce(1).write.parquet(f"{self.path}/{folder}")
        return folder

    def lists(self, parts: dict) -> InvertedLists:
        """Centres and code words, at most MAX_CELLS and 256 rows a sub-vector at first, and one more row a split."""
        rows = self.spark.read.parquet(f"{self.path}/{parts['model']}").collect()
        tables: dict[int, dict[int, list]] = {}
        for row in rows:
            tables.setdefault(row["part"], {})[row["number"]] = row["centre"]
        arrays = {part: np.array([held[at] for at in range(len(held))]) for part, held in tables.items()}
        return InvertedLists(arrays[-1], tuple(arrays[part] for part in range(len(arrays) - 1)))

    def _parts(self) -> dict:
        found = self.log.read()
        if found is None:
            raise ValueError(f"{self.path} is no index yet")
        return found.parts

    def _commit(self, parts: dict) -> None:
        if not self.log.commit(self.log.numbers()[-1] + 1, parts):
            raise RuntimeError(f"{self.path}: another writer was first")

    def _rows(self, parts: dict, segments: list[dict], cells: set[int] | None = None) -> DataFrame:
        """Live rows of segments, or of some of their cells; nothing else is listed."""
        paths = [f"{self.path}/{segment['folder']}/{_DIR}={cell}" for segment in segments for cell in segment["cells"] if cells is None or int(cell) in cells]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*paths)
        if not parts["gone"]:
            return rows
        gone = self.spark.read.schema(self.gone).parquet(*[f"{self.path}/{one['folder']}" for one in parts["gone"]])
        gone = gone.groupBy("id").agg(F.max("until").alias("until"))
        return rows.join(gone, "id", "left").where(F.col("until").isNull() | (F.col("seq") >= F.col("until"))).drop("until")

    def read(self) -> DataFrame:
        parts = self._parts()
        return self._rows(parts, parts["segments"]).drop("seq")

    def _write(self, rows: DataFrame, level: int, applied: int, first: int) -> dict | None:
        folder = f"{_DATA}/{uuid.uuid4().hex}"
        rows.withColumn(_DIR, F.col("cell")).hint("rebalance", _DIR).write.partitionBy(_DIR).parquet(f"{self.path}/{folder}")
        written = self.spark.read.schema(StructType(list(self.schema.fields)).add(_DIR, "integer")).parquet(f"{self.path}/{folder}") if rows.take(1) else None
        if written is None:
            return None
        cells = {str(row["cell"]): row["n"] for row in written.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # one row a cell
        return {"folder": folder, "level": level, "cells": cells, "applied": applied, "first": first}

    # --- writing ----------------------------------------------------------------------------

    def add(self, vectors: DataFrame, batch: int | None = None, *, vector_id: str = "id", embedding: str = "embedding") -> None:
        """Index new rows as a segment, merge full levels and split large cells.

        A ``batch`` number that is in already changes nothing, so a batch that runs again is harmless. Of rows with one
        id in a batch one stays, chosen by their hash; vectors of another dimension are left out.
        """
        parts = self._parts()
        if batch is not None and batch <= parts["batch"]:
            return
        seq = parts["seq"] + 1
        one = latest_per_key(vectors.select(F.col(vector_id).alias("id"), F.col(embedding).cast("array<float>").alias("embedding")).where("id IS NOT NULL"), ["id"])
        placed = inverted_index(one, self.lists(parts), vector_id="id").withColumn("seq", F.lit(seq).cast("long"))
        segment = self._write(placed.select(*self.schema.fieldNames()), 0, 0, seq)
        parts = {**parts, "seq": seq, "batch": parts["batch"] if batch is None else batch}
        if segment:
            known = self._rows(parts, parts["segments"]).select("id")
            fresh = self._rows(parts, [segment]).select("id")
            again = f"{_GONE}/{uuid.uuid4().hex}"
            known.join(fresh, "id", "left_semi").distinct().withColumn("until", F.lit(seq).cast("long")).write.parquet(f"{self.path}/{again}")
            if self.spark.read.schema(self.gone).parquet(f"{self.path}/{again}").take(1):
                parts["gone"] = [*parts["gone"], {"folder": again, "until": seq}]
            parts["segments"] = [*parts["segments"], segment]
        self._commit(parts)
        self._merge_full_levels()
        self._split_large_cells()

    def _merge_full_levels(self) -> None:
        level = 0
        while any(segment["level"] >= level for segment in self._parts()["segments"]):
            parts = self._parts()
            full = [segment for segment in parts["segments"] if segment["level"] == level]
            if len(full) >= self.fanout:
                made = self._write(self._rows(parts, full), level + 1, parts["seq"], min(segment["first"] for segment in full))
                left = [segment for segment in parts["segments"] if segment not in full]
                self._commit(self._without_spent({**parts, "segments": left + ([made] if made else [])}))
            level += 1

    @staticmethod
    def _without_spent(parts: dict) -> dict:
        """Lists of ids that came again are needed while a segment has older rows and was not cleaned of them."""
        needed = [one for one in parts["gone"] if any(s["first"] < one["until"] and s["applied"] < one["until"] for s in parts["segments"])]
        return {**parts, "gone": needed}

    def _split_large_cells(self) -> None:
        parts = self._parts()
        sizes: dict[str, int] = {}
        for segment in parts["segments"]:
            for cell, rows in segment["cells"].items():
                sizes[cell] = sizes.get(cell, 0) + rows
        for cell in sorted((cell for cell, rows in sizes.items() if rows > self.cell_rows), key=int):
            self._split(int(cell), sizes[cell])

    def _split(self, cell: int, size: int) -> None:
        """Two centres in place of one. Equal vectors cannot be parted: their cell stays, as rows in several files."""
        parts = self._parts()
        lists, rows = self.lists(parts), self._rows(parts, parts["segments"], {cell})
        learning = rows if size <= LEARNT else rows.sample(LEARNT / size, 7)
        points = learning.select(array_to_vector(normalise(F.col("embedding"))).alias("features"))
        centres = np.asarray(KMeans(k=2, seed=7, maxIter=10).fit(points).clusterCenters(), dtype=np.float64)
        if len(centres) < 2 or np.allclose(centres[0], centres[1]):
            return
        grown = np.vstack([lists.centres, centres[1:]])
        grown[cell] = centres[0]
        grown = replace(lists, centres=grown)
        # Its rows go to the nearest of all centres, which the split may have made another cell's.
        placed = inverted_index(rows.select("id", "embedding"), grown, vector_id="id").select("id", F.col("cell").alias("to"))
        moved = rows.join(placed, "id").select("id", "embedding", F.col("to").alias("cell"), "codes", "seq")
        top = max(segment["level"] for segment in parts["segments"])
        made = self._write(moved, top, parts["seq"], min(segment["first"] for segment in parts["segments"]))
        if not made or len(made["cells"]) < 2:
            return
        kept = [{**segment, "cells": {at: n for at, n in segment["cells"].items() if int(at) != cell}} for segment in parts["segments"]]
        self._commit({**parts, "model": self._write_model(grown), "segments": [s for s in kept if s["cells"]] + [made]})

    # --- searching --------------------------------------------------------------------------

    def probed(self, parts: dict, lists: InvertedLists, matrix: np.ndarray, nprobe: int) -> tuple[DataFrame, dict[int, np.ndarray]]:
        """Rows of the cells that some query probes, and the queries of each cell."""
        members: dict[int, list[int]] = {}
        for number, cells in enumerate(lists.probes(matrix, nprobe).tolist()):
            for cell in cells:
                members.setdefault(cell, []).append(number)
        return self._rows(parts, parts["segments"], set(members)), {cell: np.array(numbers) for cell, numbers in members.items()}

    def search(self, queries: DataFrame, k: int, *, nprobe: int = 8, query_id: str = "query_id", query_embedding: str = "query_embedding", round_size: int = ROUND) -> DataFrame:
        """``query_id, id, score, rank`` by exact ranking inside the ``nprobe`` nearest cells of each query; rounds are written one by one."""
        parts = self._parts()
        lists, query_type = self.lists(parts), queries.schema[query_id].dataType.simpleString()
        id_type = self.schema["id"].dataType.simpleString()
        found = self.spark.createDataFrame([], f"{query_id} {query_type}, id {id_type}, score double, rank int")
        for names, matrix in _rounds(queries, query_id, query_embedding, round_size):
            rows, members = self.probed(parts, lists, matrix, nprobe)
            partial = scan_top_k(rows, matrix, k, vector_id="id", embedding="embedding", group="cell", members=members)
            answers = named(rank(partial, k, "query_no", "id"), names, query_id, query_type, "id")
            path = scratch_path(self.spark, "answers")
            answers.write.parquet(path)
            found = found.unionByName(self.spark.read.schema(answers.schema).parquet(path))
        return found
