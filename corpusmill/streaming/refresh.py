"""Keep a neighbour index current: only new vector files are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from corpusmill.operators.ann import InvertedLists
from corpusmill.operators.segments import CELL_ROWS, FANOUT, CellIndex


class IndexRefresh:
    """Files that arrive below ``source`` become segments of an index that stays laid out by cell, and searchable.

    The stream's checkpoint remembers which files are in, the index which batches; a run without new files does
    nothing, and a batch that runs again changes nothing.
    """

    def __init__(self, spark: SparkSession, source: str, target: str, lists: InvertedLists, *, vector_id: str = "vec_id",
                 id_type: str = "bigint", fanout: int = FANOUT, cell_rows: int = CELL_ROWS) -> None:
        self.spark, self.source, self.vector_id, self.id_type = spark, source, vector_id, id_type
        self.index = CellIndex(spark, target, id_type=id_type, fanout=fanout, cell_rows=cell_rows)
        if not self.index.log.numbers():
            self.index.create(lists)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        self.index.add(batch, batch_id, vector_id=self.vector_id)

    def start(self, checkpoint: str) -> StreamingQuery:
        files = self.spark.readStream.schema(f"{self.vector_id} {self.id_type}, embedding array<float>").parquet(self.source)
        return (
            files.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
