"""Sinks (W1-W3)."""

from __future__ import annotations

import json
import zipfile

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.exprs import np_round
from ledgerlens.operators._common import q

#: Times are written to the microsecond, as Spark keeps them.
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
#: Bytes of a document's line, about; rows that are larger have lines of their own.
LINE_BYTES = 1 << 16
CURRENCY = "₹"  # fixed value: the default currency symbol of the KPI sheet


def write_csv(df: DataFrame, path: str, single_file: bool = False, sep: str = ",") -> str:
    """CSV with a header, UTF-8, no index; ``single_file`` coalesces to one part (small outputs only)."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", True).option("sep", sep).option("escape", '"').option("encoding", "UTF-8").options(**TIMES).csv(path)
    return path


def write_json(df: DataFrame, path: str) -> str:
    """JSON records, one per line."""
    df.write.mode("overwrite").options(**TIMES).json(path)
    return path


def write_json_documents(df: DataFrame, path: str, key: str) -> str:
    """One JSON document per partition: an object whose ``key`` holds the rows, many on a line."""
    def wrap(batches):
        head, first = f"{{{json.dumps(key)}:[", True
        for rows in batches:
            if not rows.num_rows:
                continue
            size = np.cumsum(pc.binary_length(rows.column(0)).to_numpy(zero_copy_only=False), dtype=np.int64)
            edges = np.r_[0, np.flatnonzero(np.diff(size // LINE_BYTES)) + 1, len(size)]
            lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), rows.column(0)), ",")
            text = pc.binary_join_element_wise("", lines, ",")
            if first:
                text = pa.concat_arrays([pa.array([head + lines[0].as_py()], text.type), text.slice(1)])
            first = False
            yield pa.RecordBatch.from_arrays([text], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array([head + "]}" if first else "]}"])], names=["value"])

    rows = df.select(F.to_json(F.struct(*[F.col(q(c)) for c in df.columns]), {"ignoreNullFields": "false", **TIMES}).alias("value"))
    rows.mapInArrow(wrap, "value STRING").write.mode("overwrite").text(path)
    return path


def write_archives(df: DataFrame, folder: str, member: str) -> DataFrame:
    """Write each partition of ``df`` as a zip archive with one CSV ``member``, batch by batch; returns the archives' paths when run.

    ``folder`` is a URI that every executor reaches.  An archive appears under its name once it is whole, so a task that
    is run again replaces what it left.
    """
    def write(batches):
        path, zf = f"{folder}/part-{TaskContext.get().partitionId():05d}.zip", None
        fs, local = FileSystem.from_uri(path if ":" in path else f"file://{path}")
        for rows in batches:
            if not len(rows):
                continue
            if zf is None:
                fs.create_dir(local.rsplit("/", 1)[0], recursive=True)
                unfinished = f"{local}.{TaskContext.get().taskAttemptId()}.part"
                out = fs.open_output_stream(unfinished)
                zf = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                text = zf.open(member, "w", force_zip64=True)
                rows.head(0).to_csv(text, index=False)
            rows.to_csv(text, index=False, header=False)
        if zf is not None:
            for part in (text, zf, out):
                part.close()
            fs.move(unfinished, local)
            yield pd.DataFrame({"path": [path]})

    return df.mapInPandas(write, "path STRING")


def kpi_sheet(kpis: DataFrame, currency: str = CURRENCY) -> DataFrame:
    """(kpi, value, change_pct) with the value formatted as %, currency or count; NULL values left out."""
    v = F.col("value")
    name = F.col("name")
    money = name.contains("Revenue") | name.contains("Profit") | name.contains("Value")
    formatted = (F.when(name.contains("%"), F.concat(F.format_number(v, 1), F.lit("%")))
                  .when(money, F.concat(F.lit(currency), F.format_number(v, 0)))
                  .when(v == F.floor(v), F.format_number(v, 0))
                  .otherwise(F.format_number(v, 2)))
    return kpis.where(v.isNotNull()).select(name.alias("kpi"), formatted.alias("value"),
                                            np_round(F.col("delta_pct"), 2).alias("change_pct"))
