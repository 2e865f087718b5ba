"""Versioned publication (A4, A11): a table, list or model is replaced as a whole.

A version is written to a folder of its own; only when it is complete does a
numbered manifest appear that names it. Readers take the highest manifest and
pin the folder it names: a reader during a write, or after one that failed
half-way, sees the version before, never a mixture, and a pinned version does not
change under it. A manifest is written aside and renamed, and a number that is
already there is not overwritten (a second writer takes the next one).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Version:
    number: int
    path: str
    meta: dict


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _manifests(spark: SparkSession, root: str) -> list[int]:
    fs, folder = _fs(spark, f"{root}/_versions")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _read(spark: SparkSession, root: str, number: int) -> Version:
    fs, path = _fs(spark, f"{root}/_versions/{number:012d}.json")
    stream = fs.open(path)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    found = json.loads(text)
    return Version(number, f"{root}/{found['folder']}", found["meta"])


def publish(spark: SparkSession, root: str, write: Callable[[str], None], meta: dict | None = None) -> Version:
    """``write(folder)`` fills a new folder; then, and only then, it becomes the current version."""
    root, name = root.rstrip("/"), f"v-{uuid.uuid4().hex[:16]}"
    write(f"{root}/{name}")
    body = json.dumps({"folder": name, "meta": meta or {}})
    fs, aside = _fs(spark, f"{root}/_versions/{name}.tmp")
    out = fs.create(aside, False)
    try:
        out.write(bytearray(body, "utf-8"))
    finally:
        out.close()
    number = max(_manifests(spark, root), default=0)
    while True:
        number += 1
        _, final = _fs(spark, f"{root}/_versions/{number:012d}.json")
        if not fs.exists(final) and fs.rename(aside, final):
            return Version(number, f"{root}/{name}", meta or {})


def versions(spark: SparkSession, root: str) -> list[Version]:
    """All published versions, oldest first."""
    root = root.rstrip("/")
    return [_read(spark, root, n) for n in _manifests(spark, root)]


def current(spark: SparkSession, root: str, number: int | None = None) -> Version | None:
    """The newest version, or the given one; None if nothing is published."""
    root, known = root.rstrip("/"), _manifests(spark, root.rstrip("/"))
    if number is None:
        return _read(spark, root, known[-1]) if known else None
    if number not in known:
        raise ValueError(f"no version {number} under {root}")
    return _read(spark, root, number)
