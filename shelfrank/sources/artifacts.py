"""Artifacts of several files that appear at once: a new version beside the old one, then one pointer to it.

``path/CURRENT`` names the folder of the version that readers take. It is replaced by a rename after everything else is
written, so a reader has the old version or the new one, whole, and a writer that fails leaves the old one in place. The
version before the current one stays for readers that still have it open.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

POINTER = "CURRENT"


def _path(spark: SparkSession, path: str) -> Any:
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _store(spark: SparkSession, path: str) -> Any:
    return _path(spark, path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    out = _store(spark, path).create(_path(spark, path), True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _replace(spark: SparkSession, old: str, new: str) -> None:
    """Rename over a file that may be there."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    how = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    source = _store(spark, old).makeQualified(_path(spark, old))
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), spark._jsparkSession.sessionState().newHadoopConf()).rename(source, _store(spark, new).makeQualified(_path(spark, new)), how)


def complete(spark: SparkSession, folder: str) -> bool:
    """Whether a table was written to ``folder`` to the end: the writer's commit marker is there."""
    return _store(spark, folder).exists(_path(spark, f"{folder}/_SUCCESS"))


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the current version and of the one before it, as far as there are any."""
    if not _store(spark, path).exists(_path(spark, f"{path}/{POINTER}")):
        return []
    said = spark.read.text(f"{path}/{POINTER}", wholetext=True).first()[0]
    return said.split()


def current(spark: SparkSession, path: str) -> str | None:
    """Folder of the current version, or None."""
    folder = next((f"{path}/{name}" for name in _versions(spark, path)), None)
    return folder if folder is not None and _store(spark, path).exists(_path(spark, folder)) else None


def publish(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """Have ``write(folder)`` fill a new version of ``path`` and make it the current one; its folder.

    Of two writers at once the later one's version is current; what another writer is still filling stays.
    """
    name = f"version-{uuid.uuid4().hex}"
    folder, store = f"{path}/{name}", _store(spark, path)
    try:
        write(folder)
    except BaseException:
        store.delete(_path(spark, folder), True)
        raise
    before, note = _versions(spark, path), f"{path}/.{name}"
    _write_text(spark, note, "\n".join([name, *before[:1]]) + "\n")
    _replace(spark, note, f"{path}/{POINTER}")
    for old in before[1:]:
        store.delete(_path(spark, f"{path}/{old}"), True)
    return folder


def build_if_missing(spark: SparkSession, path: str, build: Callable[[], DataFrame], rebuild: bool = False) -> DataFrame:
    """The table at ``path``; made and published first if there is no whole version of it or ``rebuild`` is set."""
    folder = None if rebuild else current(spark, path)
    if folder is None or not complete(spark, folder):
        folder = publish(spark, path, lambda at: build().write.parquet(at))
    return spark.read.parquet(folder)
