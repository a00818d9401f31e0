"""Generation runs that keep what they have: finished chunks are committed while the job runs.

The prompts are staged once as files of bounded size, the chunks. A stream reads a number of chunks a
step and appends their answers through a file sink, whose log commits a step as a whole and once; the
checkpoint remembers the step. A run that is started again with the same folder goes on behind the
last committed step, so at most the chunks of one step are asked for twice and no answer is written twice.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from footfall.operators.enrich import map_texts
from footfall.sources.tables import kept_path, reuse_or_build

#: Prompts of a chunk, and chunks of a step.
CHUNK_ROWS, STEP_CHUNKS = 200, 1000


def generate_durably(
    prompts: DataFrame, column: str, out: str, out_type: T.DataType, batch: Callable[[list[str]], list], folder: str,
    name: str = "prompts", parameters: Mapping[str, object] | None = None, chunk_rows: int = CHUNK_ROWS, step_chunks: int = STEP_CHUNKS, **options: object,
) -> DataFrame:
    """``prompts`` with ``out``, as :func:`footfall.operators.enrich.map_texts` makes it, read from the committed chunks in ``folder``.

    ``folder`` is durable and belongs to this run; ``name`` and ``parameters`` name the prompts in it. Prompts that were
    staged under them are taken as they were, whatever ``prompts`` holds now: for more prompts take a new
    name and :func:`footfall.streaming.incremental.todo`. A generator that fails ends the run with its error; calling
    again resumes it. ``options`` go to ``map_texts``.
    """
    spark = prompts.sparkSession
    keyed = {"columns": prompts.schema.json(), "chunk_rows": chunk_rows, **(parameters or {})}
    staged = reuse_or_build(spark, folder, name, keyed, lambda: prompts, rows_per_file=chunk_rows)
    path = kept_path(folder, name, keyed)
    stream = spark.readStream.schema(prompts.schema).option("maxFilesPerTrigger", step_chunks).parquet(path)
    answered = map_texts(stream, column, out, out_type, batch, batch_rows=min(chunk_rows, options.pop("batch_rows", chunk_rows)), **options)
    sink = answered.writeStream.format("parquet").option("path", f"{path}-answers").option("checkpointLocation", f"{path}-steps")
    run = sink.trigger(availableNow=True).start()
    try:
        run.awaitTermination()
    finally:
        run.stop()
    return committed(staged, f"{path}-answers", out, out_type)


def committed(prompts: DataFrame, path: str, out: str, out_type: T.DataType) -> DataFrame:
    """The answers of all committed steps; empty before the first one."""
    spark = prompts.sparkSession
    schema = T.StructType([*[f for f in prompts.schema.fields if f.name != out], T.StructField(out, out_type)])
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)
