"""Findings that are written whole or not at all, and read back only if they are what was written."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, Row, SparkSession, functions as F, types as T

from leakscan.errors import InputError
from leakscan.operators.fingerprint import fingerprint_of, fingerprint_sums, table_fingerprint

PARTS = ("summary", "row_matches", "group_overlap")
MANIFEST = "_findings.json"
MODES = ("errorifexists", "error", "overwrite", "ignore")


@dataclass(frozen=True)
class WrittenFindings:
    """What the writing jobs saw: the one row of the summary, and rows and fingerprint of each part."""

    summary: Row
    parts: dict[str, dict[str, object]]


@dataclass(frozen=True)
class Findings:
    summary: DataFrame
    row_matches: DataFrame
    group_overlap: DataFrame


def _files(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def write_findings(audit, path: str, mode: str = "errorifexists", fmt: str = "parquet") -> WrittenFindings | None:
    """Write ``summary``, ``row_matches`` and ``group_overlap`` below ``path``, with a manifest, and return what was written.

    The parts go to a folder beside ``path`` that is renamed once all are there, so a job that dies leaves no half result; renaming
    is one step on HDFS and local disks, on object stores the manifest is what tells a whole result. Rows, fingerprints and the
    verdict are observed by the writing jobs. Mode ``ignore`` returns None if there is something at ``path``.
    """
    if mode not in MODES:
        raise InputError(f"mode must be one of {', '.join(MODES)}, not {mode}")
    path = path.rstrip("/")
    spark = audit.summary.sparkSession
    files, target = _files(spark, path)
    if files.exists(target) and mode != "overwrite":
        if mode == "ignore":
            return None
        raise InputError(f"path exists already: {path}")
    staged = f"{path}.staging-{uuid.uuid4().hex}"
    _, folder = _files(spark, staged)
    try:
        written = _write_parts(audit, staged, fmt)
        _write_text(spark, f"{staged}/{MANIFEST}", json.dumps({"format": fmt, "parts": written.parts}))
        if files.exists(target):
            if mode != "overwrite":
                raise InputError(f"path exists already: {path}")
            files.delete(target, True)
        if not files.rename(folder, target):
            raise OSError(f"cannot rename {staged} to {path}")
    except BaseException:
        files.delete(folder, True)
        raise
    return written


def _write_parts(audit, staged: str, fmt: str) -> WrittenFindings:
    parts, summary = {}, None
    for name in PARTS:
        table, seen = getattr(audit, name), Observation()
        verdict = [F.max(F.struct("*")).alias("_row")] if name == "summary" else []
        table.observe(seen, *fingerprint_sums(table.schema), *verdict).write.format(fmt).save(f"{staged}/{name}")
        sums = seen.get
        parts[name] = {"rows": sums["_n"], "fingerprint": fingerprint_of(table.schema, sums), "schema": table.schema.jsonValue()}
        summary = sums["_row"] if verdict else summary
    return WrittenFindings(summary, parts)


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    files, place = _files(spark, path)
    out = files.create(place, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _read_text(spark: SparkSession, files, place) -> str:
    source = files.open(place)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def read_findings(spark: SparkSession, path: str, verify: bool = True) -> Findings:
    """The three parts that ``write_findings`` left at ``path``; ``InputError`` if a part isn't what the manifest says."""
    path = path.rstrip("/")
    files, place = _files(spark, f"{path}/{MANIFEST}")
    if not files.exists(place):
        raise InputError(f"no whole findings at {path}")
    manifest = json.loads(_read_text(spark, files, place))
    tables = {}
    for name in PARTS:
        told = manifest["parts"][name]
        tables[name] = spark.read.format(manifest["format"]).schema(T.StructType.fromJson(told["schema"])).load(f"{path}/{name}")
        if verify and table_fingerprint(tables[name]).first()["fingerprint"] != told["fingerprint"]:
            raise InputError(f"{name} at {path} is not what was written")
    return Findings(**tables)
