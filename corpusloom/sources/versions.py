"""Folders that make up the present state of a stored index, named by one small file that is renamed into place last.

A writer puts new data in folders of its own and then writes the list of folders that are valid from now on. A reader takes
the newest list; a writer that fails leaves folders that no list names, and the last list stands. There is one
writer at a time. A list has a line for each folder of each table and a few settings; its length is bounded by the number
of buckets or of levels, whatever the size of the data.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession

PREFIX = "current-"


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, none if it isn't there."""
    where, store = _folder(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(where)) if store.exists(where) else []


def delete(spark: SparkSession, path: str) -> None:
    where, store = _folder(spark, path)
    store.delete(where, True)


def _lists(spark: SparkSession, path: str) -> list[str]:
    return [n for n in names(spark, path) if n.startswith(PREFIX) and n.endswith(".json")]


def current(spark: SparkSession, path: str) -> dict[str, Any] | None:
    """The newest list, None if nothing was written yet."""
    found = _lists(spark, path)
    if not found:
        return None
    where, store = _folder(spark, f"{path}/{found[-1]}")
    stream = store.open(where)
    try:
        return json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, state: dict[str, Any]) -> None:
    """Make state the newest list. The one before it stays for readers that are at work; older ones go."""
    found = _lists(spark, path)
    number = int(found[-1][len(PREFIX) : -len(".json")]) + 1 if found else 0
    draft, store = _folder(spark, f"{path}/draft-{uuid.uuid4().hex}")
    out = store.create(draft, True)
    try:
        out.write(bytearray(json.dumps(state).encode()))
    finally:
        out.close()
    if not store.rename(draft, _folder(spark, f"{path}/{PREFIX}{number:09d}.json")[0]):
        raise OSError(f"{path}: the list of folders could not be put in place")
    for old in found[:-1]:
        delete(spark, f"{path}/{old}")


def new_folder(path: str, kind: str) -> str:
    """A folder that no list names yet."""
    return f"{path}/{kind}-{uuid.uuid4().hex}"
