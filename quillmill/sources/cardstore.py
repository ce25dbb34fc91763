"""S10, S17, S18, S19 as a data source: ``spark.read.format("cards")`` and ``df.write.format("cards")`` over a card store.

A store is a folder with ``parts``, one folder of Markdown files for each task that committed, and ``versions``, one small
JSON file for each commit that names the parts which are its cards. A version is written by one rename after every task
has ended, so a reader sees all of a write or nothing of it: a job that fails or is killed half way leaves the former cards,
and what an attempt wrote that didn't commit belongs to no version. ``append`` keeps the former parts and ``overwrite``
leaves them to older versions, which can be read until :func:`vacuum`.

Only the names of parts, one a task, pass through the driver. A path that isn't below the store, or a null one, is an
error; a null content is an empty card.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePosixPath
from zlib import crc32

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from quillmill.sources.durable import open_uri, qualified

#: A part of more cards than this is read by several tasks.
CARDS_PER_TASK = 10_000


class StoreChanged(RuntimeError):
    """Another writer committed while this one wrote."""


class _Store:
    """The files of a store, by Arrow, on the driver and in tasks alike."""

    def __init__(self, uri: str):
        self.fs, base = open_uri(uri)
        self.base = base.rstrip("/")

    def names(self, folder: str) -> list[str]:
        from pyarrow import fs

        return [f.base_name for f in self.fs.get_file_info(fs.FileSelector(f"{self.base}/{folder}", allow_not_found=True))]

    def newest(self) -> int:
        """The last version; 0 before the first."""
        return max((int(n.removesuffix(".json")) for n in self.names("versions") if n.endswith(".json")), default=0)

    def parts(self, version: int) -> list[dict]:
        if version == 0:
            return []
        with self.fs.open_input_stream(f"{self.base}/versions/{version:08d}.json") as f:
            return json.loads(f.read())

    def publish(self, version: int, parts: list[dict]) -> None:
        folder = f"{self.base}/versions"
        self.fs.create_dir(folder, recursive=True)
        draft = f"{folder}/{uuid.uuid4().hex}.draft"
        with self.fs.open_output_stream(draft) as f:
            f.write(json.dumps(parts).encode())
        self.fs.move(draft, f"{folder}/{version:08d}.json")

    def drop(self, part: str) -> None:
        self.fs.delete_dir(f"{self.base}/parts/{part}")


@dataclass
class _Cards(InputPartition):
    """One of ``of`` shares of a part's cards."""

    part: str
    version: int
    share: int
    of: int


@dataclass
class _Written(WriterCommitMessage):
    part: str
    cards: int


class _Reader(DataSourceReader):
    def __init__(self, uri: str, version: int | None):
        self.uri, self.version = uri, version

    def partitions(self) -> list[InputPartition]:
        store = _Store(self.uri)
        found = store.parts(store.newest() if self.version is None else self.version)
        shares = [(p, max(1, -(-p["cards"] // CARDS_PER_TASK))) for p in found if p["cards"]]
        return [_Cards(p["part"], p["version"], k, of) for p, of in shares for k in range(of)] or [_Cards("", 0, 0, 1)]

    def read(self, partition: _Cards) -> Iterator[tuple]:
        from pyarrow import fs

        if not partition.part:
            return
        store = _Store(self.uri)
        base = f"{store.base}/parts/{partition.part}/"
        for f in store.fs.get_file_info(fs.FileSelector(base.rstrip("/"), recursive=True)):
            rel = f.path[len(base) :]
            if f.is_file and crc32(rel.encode()) % partition.of == partition.share:
                with store.fs.open_input_stream(f.path) as stream:
                    yield rel, stream.read().decode(), partition.version


class _Writer(DataSourceWriter):
    def __init__(self, uri: str, overwrite: bool):
        self.uri, self.overwrite = uri, overwrite
        self.job = uuid.uuid4().hex
        self.base = _Store(uri).newest()

    def write(self, iterator: Iterator[Row]) -> _Written:
        """An attempt has a folder of its own, so one that is tried again never meets the files of the first."""
        store, part, n = _Store(self.uri), f"{self.job}-{uuid.uuid4().hex}", 0
        made = set()
        for r in iterator:
            rel = r["rel_path"]
            if not rel or rel.startswith("/") or ".." in PurePosixPath(rel).parts:
                raise ValueError(f"not a path below the store: {rel!r}")
            path = PurePosixPath(store.base) / "parts" / part / rel
            if path.parent not in made:
                store.fs.create_dir(str(path.parent), recursive=True)
                made.add(path.parent)
            with store.fs.open_output_stream(str(path)) as f:
                f.write((r["content"] or "").encode())
            n += 1
        return _Written(part, n)

    def commit(self, messages: list[_Written | None]) -> None:
        store, version = _Store(self.uri), self.base + 1
        if store.newest() != self.base:
            self.abort(messages)
            raise StoreChanged(f"version {store.newest()} of {self.uri} was written meanwhile")
        done = {m.part: m.cards for m in messages if m is not None and m.cards}
        former = [] if self.overwrite else store.parts(self.base)
        store.publish(version, former + [{"part": p, "cards": n, "version": version} for p, n in sorted(done.items())])
        self._sweep(store, set(done))

    def abort(self, messages: list[_Written | None]) -> None:
        self._sweep(_Store(self.uri), set())

    def _sweep(self, store: _Store, kept: set[str]) -> None:
        """Delete what attempts of this job wrote that didn't commit."""
        for part in store.names("parts"):
            if part.startswith(self.job) and part not in kept:
                store.drop(part)


class CardSource(DataSource):
    """``rel_path, content, version``: the cards of the newest version, or of the one that the option ``version`` names,
    each with the version that wrote it."""

    @classmethod
    def name(cls) -> str:
        return "cards"

    def schema(self) -> str:
        return "rel_path string, content string, version int"

    def reader(self, schema) -> _Reader:
        at = self.options.get("version")
        return _Reader(self.options["path"], None if at is None else int(at))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite)


def save(cards: DataFrame, root: str, mode: str = "append") -> None:
    """Write ``rel_path, content`` as a new version. Of rows with one path the greatest content stays, so the version
    doesn't depend on the order of rows; an empty table makes a version too."""
    spark = cards.sparkSession
    spark.dataSource.register(CardSource)
    one = cards.groupBy("rel_path").agg(F.max("content").alias("content"))
    one.write.format("cards").mode(mode).save(qualified(spark, root))


def load(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """``rel_path, content, version`` of a store, of each path the card that was written last; empty where there is none."""
    spark.dataSource.register(CardSource)
    reader = spark.read.format("cards")
    rows = (reader if version is None else reader.option("version", version)).load(qualified(spark, root))
    last = F.max(F.struct("version", "content")).alias("last")
    return rows.groupBy("rel_path").agg(last).select("rel_path", "last.content", "last.version")


def export(spark: SparkSession, root: str, folder: str) -> None:
    """The newest cards as a plain tree of files, for people and tools that read one; safe to run again."""
    from quillmill.sources.io import write_cards

    write_cards(load(spark, root), folder, prune=True)


def vacuum(spark: SparkSession, root: str) -> int:
    """Delete older versions and every part that the newest doesn't name; the number of parts deleted. It must not run
    beside a writer or a reader of an older version."""
    store = _Store(qualified(spark, root))
    newest = store.newest()
    kept = {p["part"] for p in store.parts(newest)}
    for name in store.names("versions"):
        if name != f"{newest:08d}.json":
            store.fs.delete_file(f"{store.base}/versions/{name}")
    gone = [p for p in store.names("parts") if p not in kept]
    for part in gone:
        store.drop(part)
    return len(gone)
