"""Objects of lines that are seen whole or not at all: a transactional sink on any store that Arrow opens.

``write_objects`` deals lines by object, and each task writes its objects beside their places, under names that readers skip. Limits
are kept while writing: an object that grows beyond them is taken back at once and none of it stays. Only when all tasks are done does
the commit give objects their names, and never a name that is taken: an equal object there is reused, another one stays, and the new
one is refused or, if asked for, gets a name of its own content. A job that fails leaves nothing. Replays end with the same objects.

The commit reads each task's list of objects from the store, so that no message holds them, and leaves a row of outcome for each.
"""

from __future__ import annotations

import hashlib
import json
import os
import sys
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .. import schemas as S

#: Workers get these classes with the job, wherever the package is installed.
register_pickle_by_value(sys.modules[__name__])

STAGED, OUTCOMES = "_staged", "_outcomes"
OUTCOME_SCHEMA = "object string, outcome string, name string, bytes long, lines long, sha256 string"
#: Objects that a commit moves at a time.
MOVERS = 16


def fallback_name(name: str, sha256: str) -> str:
    """A name that follows from the content, for an object whose own name is taken by another."""
    stem, ext = os.path.splitext(name)
    return f"{stem}-{sha256[:16]}{ext}"


def _digest(store, place: str) -> str | None:
    """The digest of what is stored there; null if nothing is."""
    there = hashlib.sha256()
    try:
        with store.open_input_stream(place) as f:
            while part := f.read(1 << 20):
                there.update(part)
    except FileNotFoundError:
        return None
    return there.hexdigest()


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class TaskDone(WriterCommitMessage):
    """Where a task has listed its objects."""

    listed: str


class _Object:
    """One object while it is written: on its way to a file, or beyond the limits."""

    def __init__(self, store, name: str, place: str, most_bytes: int, most_lines: int):
        self.store, self.name, self.place = store, name, place
        self.most = (most_bytes, most_lines)
        self.bytes = self.lines = 0
        self.digest = hashlib.sha256()
        self.over = ""
        self.out = store.open_output_stream(place)

    def add(self, lines: list[str | None]) -> None:
        if self.over:
            return
        data = "".join((x or "") + "\n" for x in lines).encode()
        self.bytes, self.lines = self.bytes + len(data), self.lines + len(lines)
        self.over = "too_large" if self.bytes > self.most[0] else "too_many_lines" if self.lines > self.most[1] else ""
        if self.over:
            self.out.close()
            self.store.delete_file(self.place)
            return
        self.digest.update(data)
        self.out.write(data)

    def close(self, root: str, fallback: bool) -> dict:
        """What the commit has to know, with the digests of objects that have the names already: as they never change, tasks can read them."""
        there = {}
        if not self.over:
            self.out.close()
            for name in (self.name, fallback_name(self.name, self.digest.hexdigest()))[: 1 + fallback]:
                there[name] = _digest(self.store, f"{root}/{name}")
                if there[name] in (None, self.digest.hexdigest()):
                    break
        found = {"bytes": None, "lines": None, "sha256": None} if self.over else {"bytes": self.bytes, "lines": self.lines, "sha256": self.digest.hexdigest()}
        return {"object": self.name, "place": self.place, "outcome": self.over, "there": there, **found}


class ObjectWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")
        self.job = uuid.uuid4().hex
        self.most_bytes = int(options.get("most_bytes", S.MAX_FILE_BYTES))
        self.most_lines = int(options.get("most_lines", S.MAX_FILE_LINES))
        self.fallback = options.get("fallback", "false") == "true"

    def write(self, iterator: Iterator) -> TaskDone:
        """Rows come sorted by object, an object's in its order."""
        store, root = _store(self.root)
        top = f"{root}/{STAGED}/{self.job}/{uuid.uuid4().hex}"
        store.create_dir(top)
        done: list[dict] = []
        now: _Object | None = None
        for batch in iterator:
            names, lines = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at = 0
            while at < len(names):
                end = at
                while end < len(names) and names[end] == names[at]:
                    end += 1
                if now is None or now.name != names[at]:
                    if now is not None:
                        done.append(now.close(root, self.fallback))
                    now = _Object(store, names[at], f"{top}/{len(done)}", self.most_bytes, self.most_lines)
                now.add(lines[at:end])
                at = end
        if now is not None:
            done.append(now.close(root, self.fallback))
        with store.open_output_stream(f"{top}/listed") as out:
            for d in done:
                out.write(json.dumps(d).encode() + b"\n")
        return TaskDone(f"{top}/listed")

    def commit(self, messages: list) -> None:
        store, root = _store(self.root)
        with ThreadPoolExecutor(MOVERS) as pool:
            for k, m in enumerate(m for m in messages if m is not None):
                with store.open_input_stream(m.listed) as f:
                    listed = [json.loads(x) for x in f.read().splitlines()]
                rows = list(pool.map(lambda d: self._settle(store, root, d), listed))
                if rows:
                    store.create_dir(f"{root}/{OUTCOMES}/{self.job}")
                    with store.open_output_stream(f"{root}/{OUTCOMES}/{self.job}/{k}.json") as out:
                        out.write("".join(json.dumps(r) + "\n" for r in rows).encode())
        self._clear(store, root)

    def abort(self, messages: list) -> None:
        self._clear(*_store(self.root))

    def _clear(self, store, root: str) -> None:
        from pyarrow import fs

        if store.get_file_info(f"{root}/{STAGED}/{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{STAGED}/{self.job}")

    def _settle(self, store, root: str, d: dict) -> dict:
        outcome, name = d["outcome"], d["object"]
        if not outcome:
            outcome = self._claim(store, d, root, name)
            if outcome == "taken" and self.fallback:
                name = fallback_name(name, d["sha256"])
                outcome = "fallback" if self._claim(store, d, root, name) != "taken" else "taken"
        stored = outcome in ("created", "same", "fallback")
        return {"object": d["object"], "outcome": outcome, "name": name if stored else None, **{k: d[k] for k in ("bytes", "lines", "sha256")}}

    def _claim(self, store, d: dict, root: str, name: str) -> str:
        """created, same (an equal object has the name) or taken (another one has it, and keeps it)."""
        from pyarrow import fs

        there, place = d["there"].get(name), f"{root}/{name}"
        if there is None:
            store.create_dir(os.path.dirname(place))
            try:
                if isinstance(store, fs.LocalFileSystem):
                    os.link(d["place"], place)  # fails where the name is taken, whoever was first
                elif store.get_file_info(place).type != fs.FileType.NotFound:
                    raise FileExistsError(place)
                else:
                    store.move(d["place"], place)
                return "created"
            except FileExistsError:
                there = _digest(store, place)  # taken since its task was done
        return "same" if there == d["sha256"] else "taken"


class ObjectSink(DataSource):
    """Writes (object, line): options path, most_bytes, most_lines, fallback."""

    @classmethod
    def name(cls) -> str:
        return "batch_objects"

    def schema(self) -> str:
        return "object string, line string"

    def writer(self, schema: StructType, overwrite: bool) -> ObjectWriter:
        if overwrite:
            raise ValueError("objects are created, never overwritten")
        return ObjectWriter(self.options)


def write_objects(lines: DataFrame, path: str, order: str = "ordinal", most_bytes: int = S.MAX_FILE_BYTES, most_lines: int = S.MAX_FILE_LINES, fallback: bool = False, tasks: int | None = None) -> DataFrame:
    """Writes the objects of (object, ``order``, line) under ``path`` and returns ``outcomes``; rows without an object name are left out.

    An object is one task's work, as its lines follow each other in one file; its limits bound it. ``tasks`` deals the objects out.
    """
    spark = lines.sparkSession
    spark.dataSource.register(ObjectSink)
    rows = lines.filter("object is not null").repartition(*([tasks] if tasks else []), "object").sortWithinPartitions("object", order).select("object", F.col("line").cast("string").alias("line"))
    rows.write.format("batch_objects").mode("append").options(most_bytes=most_bytes, most_lines=most_lines, fallback=str(fallback).lower()).save(path)
    return outcomes(spark, path)


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    """(object, outcome, name, bytes, lines, sha256) of all objects that were ever offered: created, same, fallback, taken, too_large or too_many_lines."""
    return spark.read.schema(OUTCOME_SCHEMA).json(f"{path.rstrip('/')}/{OUTCOMES}/*")
