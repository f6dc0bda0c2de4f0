"""Extractor output (a JSON array of per-file objects) -> one row per file.

Values are kept as raw JSON text so they can be stored verbatim.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tags import json_string_value, parse_raw_objects
from ..session import ensure_checkpoint_dir
from .json_arrays import RANGE_BYTES, file_ranges, parsed, placed_ranges

TAG_ROWS = T.StructType([
    T.StructField("ordinal", T.StructType([T.StructField("doc", T.StringType()), T.StructField("pos", T.LongType())])), T.StructField("source_file", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType())),
    T.StructField("parse_error", T.StringType()),
])

_ORDINAL = pa.struct([("doc", pa.string()), ("pos", pa.int64())])
_ARROW = pa.schema([("ordinal", _ORDINAL), ("source_file", pa.string()), ("error", pa.string()),
                    ("tags", pa.map_(pa.string(), pa.string())), ("parse_error", pa.string())])


def parse_tag_batches(docs: DataFrame, text_col: str = "value", id_col: str | None = None) -> DataFrame:
    """One output row per object of each input JSON array.  A document that
    does not parse yields one row with ``parse_error`` set.  ``ordinal`` =
    (document id, position), used to let the last duplicate win; numeric
    document ids are compared as numbers."""
    ensure_checkpoint_dir(docs.sparkSession)
    cols = [text_col] + ([id_col] if id_col else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text_col).to_pylist()
            ids = b.column(id_col).to_pylist() if id_col else [0] * len(texts)
            ids = [f"{i:020d}" if isinstance(i, int) else i for i in ids]
            o, sf, er, tg, pe = [], [], [], [], []
            for doc_id, text in zip(ids, texts):
                try:
                    objs = parse_raw_objects(text or "")
                except ValueError as exc:
                    o.append({"doc": doc_id, "pos": 0}); sf.append(None); er.append(None); tg.append(None)
                    pe.append(str(exc))
                    continue
                for pos, obj in enumerate(objs):
                    obj = obj or {}
                    o.append({"doc": doc_id, "pos": pos})
                    sf.append(json_string_value(obj.get("SourceFile")))
                    er.append(json_string_value(obj.get("Error")))
                    tg.append(list(obj.items()))
                    pe.append(None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(o, _ORDINAL), pa.array(sf, pa.string()), pa.array(er, pa.string()),
                 pa.array(tg, pa.map_(pa.string(), pa.string())), pa.array(pe, pa.string())], schema=_ARROW)

    return docs.select(*cols).mapInArrow(run, TAG_ROWS)


def read_tags(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Read extractor output files (each one JSON array) from ``path``, in order of
    their names.  An array of any size is read by as many tasks as it has ranges; a
    file that does not parse is one row with ``parse_error``."""
    ensure_checkpoint_dir(spark)

    def row(obj: dict[str, str] | None) -> tuple:
        obj = obj or {}
        return json_string_value(obj.get("SourceFile")), json_string_value(obj.get("Error")), obj

    rows = parsed(placed_ranges(file_ranges(spark, path, range_bytes)), parse_raw_objects,
                  {"source_file": "string", "error": "string", "tags": "map<string,string>"}, row)
    return rows.select(F.struct(F.col("path").alias("doc"), "pos").alias("ordinal"), "source_file", "error", "tags", "parse_error")
