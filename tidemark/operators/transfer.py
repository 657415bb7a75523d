"""Object copy (S-09): only paths travel through Spark; bytes stream inside the tasks."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidemark.sources.files import open_input, replace_file

PART_BYTES = 16 * (1 << 20)


def local_put(dst_root: str, part_bytes: int = PART_BYTES):
    """A put function for a folder given by path or URI: stream ``src`` to ``dst_root/key`` in
    parts and store the user metadata beside it as ``<key>.meta.json``. A retried task writes
    the same object again."""
    base = dst_root.rstrip("/")

    def put(src: str, key: str, metadata: dict) -> int:
        dst = f"{base}/{key.lstrip('/')}"
        with open_input(src) as fin:
            written = replace_file(dst, iter(lambda: fin.read(part_bytes), b""))
        replace_file(dst + ".meta.json", [json.dumps(metadata).encode("utf-8")])
        return written

    return put


def copy_objects(plan: DataFrame, put, *, src_col: str = "src_path", partitions: int | None = None) -> DataFrame:
    """S-09: copy each planned file to its key with metadata ``checksum`` and
    ``drive_file_id``; one outcome row per file (bytes written, or the error)."""
    cols = ["source_name", "file_id", "object_key", "checksum", src_col]
    todo = plan.select(*cols)
    if partitions:
        todo = todo.repartition(partitions, "object_key")

    def run(batches):
        for pdf in batches:
            written, errors = [], []
            for src, key, ck, fid in zip(pdf[src_col], pdf["object_key"], pdf["checksum"], pdf["file_id"]):
                try:
                    written.append(put(src, key, {"checksum": ck or "", "drive_file_id": fid}))
                    errors.append(None)
                except Exception as exc:  # noqa: BLE001 - reported per file
                    written.append(None)
                    errors.append(f"{type(exc).__name__}: {exc}")
            yield pd.DataFrame({"source_name": pdf["source_name"], "file_id": pdf["file_id"],
                                "object_key": pdf["object_key"], "bytes_written": written, "error": errors})

    return todo.mapInPandas(run, "source_name string, file_id string, object_key string, bytes_written bigint, "
                                 "error string").withColumn("ok", F.col("error").isNull())
