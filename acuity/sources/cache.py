"""Read-through tables that know what they were built from.

A cached table is a folder of versions. A build writes its rows to a new folder and then,
last of all, a small numbered manifest beside it: the folder's name, the parameters, and a
fingerprint of the source files. The manifest with the highest number counts. So a reader
sees the whole old table or the whole new one, a build that dies leaves the old one in
force, and readers of an old version keep their files until :func:`drop_old`.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from acuity.sources.storage import exists, file_system, remove, with_bloom

_PREFIX, _SUFFIX = "manifest-", ".json"


@dataclass
class Manifest:
    number: int
    data: str
    parameters: dict
    sources: dict = field(default_factory=dict)


def fingerprint(spark: SparkSession, sources: Iterable[str]) -> dict:
    """Number, bytes and digest of the files under ``sources``, from names, sizes and times.

    Contents are not read. A source that is not there is an error.
    """
    files, size, digest = 0, 0, hashlib.sha256()
    for source in sorted(sources):
        system, top = file_system(spark, source)
        found = system.listFiles(top, True)
        rows = []
        while found.hasNext():
            status = found.next()
            rows.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
        for row in sorted(rows):
            files, size = files + 1, size + row[1]
            digest.update(json.dumps(row).encode())
    return {"files": files, "bytes": size, "digest": digest.hexdigest()}


def _numbers(spark: SparkSession, path: str) -> list[int]:
    if not exists(spark, path):
        return []
    system, top = file_system(spark, path)
    names = [s.getPath().getName() for s in system.listStatus(top)]
    return sorted(int(n[len(_PREFIX) : -len(_SUFFIX)]) for n in names
                  if n.startswith(_PREFIX) and n.endswith(_SUFFIX))


def _file(path: str, number: int) -> str:
    return f"{path}/{_PREFIX}{number:012d}{_SUFFIX}"


def current(spark: SparkSession, path: str) -> Manifest | None:
    """The manifest in force; one that was cut off while it was written does not count."""
    path = path.rstrip("/")
    for number in reversed(_numbers(spark, path)):
        text = "".join(r[0] for r in spark.read.option("wholetext", True).text(_file(path, number)).collect())
        try:
            return Manifest(**json.loads(text))
        except (ValueError, TypeError):
            continue
    return None


def commit(spark: SparkSession, path: str, data: str, parameters: dict, sources: dict) -> Manifest:
    """Put a version in force. Of two builds that commit at once, the later one counts."""
    path = path.rstrip("/")
    number = max(_numbers(spark, path), default=0) + 1
    while True:
        made = Manifest(number, data, parameters, sources)
        system, target = file_system(spark, _file(path, number))
        try:
            out = system.create(target, False)  # an error where the number is taken
        except Py4JJavaError as error:
            if "AlreadyExists" not in error.java_exception.getClass().getName():
                raise
            number += 1
            continue
        out.write(bytearray(json.dumps(asdict(made)).encode()))
        out.close()
        return made


def read_version(spark: SparkSession, path: str, manifest: Manifest) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/{manifest.data}")


def read_through(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame],
    *,
    sources: Iterable[str] = (),
    refresh: bool = False,
    bloom: str | None = None,
    **parameters,
) -> DataFrame:
    """The table cached at ``path``; built and stored first if there is none that fits.

    A version fits if it was built with the same ``parameters`` from the same ``sources``,
    files or folders that ``build`` reads. These are looked at before the build, so what
    changes meanwhile is noticed by the next call. Row groups get a Bloom filter on the column
    ``bloom``, if it is given.
    """
    path = path.rstrip("/")
    wanted = json.loads(json.dumps(parameters))
    seen = fingerprint(spark, sources)
    held = current(spark, path)
    if refresh or held is None or (held.parameters, held.sources) != (wanted, seen):
        data = f"data-{uuid.uuid4().hex}"
        writer = build().write
        (with_bloom(writer, bloom) if bloom else writer).parquet(f"{path}/{data}")
        held = commit(spark, path, data, wanted, seen)
    return read_version(spark, path, held)


def version(spark: SparkSession, path: str) -> str | None:
    """Name of the version in force, which changes with every build; None without one."""
    held = current(spark, path)
    return held and held.data


def drop_old(spark: SparkSession, path: str) -> list[str]:
    """Delete all but the version in force, unfinished ones included; returns the folders' names.

    Not for a time when another session may be building the table or reading an old version.
    """
    path = path.rstrip("/")
    held = current(spark, path)
    if held is None:
        return []
    system, top = file_system(spark, path)
    names = [s.getPath().getName() for s in system.listStatus(top)]
    # manifests first: none may name a folder that has gone
    for number in _numbers(spark, path):
        if number != held.number:
            remove(spark, _file(path, number))
    gone = sorted(n for n in names if n.startswith("data-") and n != held.data)
    for name in gone:
        remove(spark, f"{path}/{name}")
    return gone
