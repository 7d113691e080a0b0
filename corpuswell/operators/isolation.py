"""Work on rows one by one, in which a row that fails becomes a row of a quarantine and the others go on."""

from __future__ import annotations

import traceback
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from corpuswell.staging import staged

#: Characters of an error that are kept.
ERROR_CHARS = 2000


def isolated(rows: DataFrame, keys: list[str], work: Callable[[dict], dict], made: str) -> tuple[DataFrame, DataFrame]:
    """(done, quarantine). done has the columns of rows and those of `made` (DDL), which `work` gives for a row; quarantine has the keys of rows for which it
    raised an error, or gave what is not of its types, with error (its type and message) and where (the last line that it came from).

    work runs once for each row, in tasks on Arrow batches; what it gives is staged, so that done and quarantine are of one run. An error of `work` is an
    answer; a lost executor, a full disk or an error elsewhere in the job fails the job, as ever.
    """
    taken = sorted({f.name for f in StructType.fromDDL(made)} & {*rows.columns, "_error", "_where"})
    if taken:
        raise ValueError(f"columns {taken} are in rows already")
    schema = to_arrow_schema(StructType.fromDDL(made))

    def run(batches):
        for batch in batches:
            given, errors = [], []
            for row in batch.to_pylist():
                try:
                    own = work(row)
                    one = pa.RecordBatch.from_pylist([{f.name: own[f.name] for f in schema}], schema)  # of the right types, or an error of this row
                    given.append(one.to_pylist()[0])
                    errors.append((None, None))
                except Exception as error:
                    given.append(dict.fromkeys(schema.names))
                    last = traceback.extract_tb(error.__traceback__)[-1]
                    errors.append((f"{type(error).__name__}: {error}"[:ERROR_CHARS], f"{last.name}:{last.lineno}"))
            added = pa.RecordBatch.from_pylist(given, schema).columns if given else [pa.array([], f.type) for f in schema]
            told = [pa.array([e[k] for e in errors], pa.string()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added, *told], names=[*batch.schema.names, *schema.names, "_error", "_where"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    every = staged(rows.mapInArrow(run, f"{fields}, {made}, _error string, _where string"), "isolated")
    done = every.where("_error IS NULL").drop("_error", "_where")
    return done, every.where("_error IS NOT NULL").select(*keys, F.col("_error").alias("error"), F.col("_where").alias("where"))
