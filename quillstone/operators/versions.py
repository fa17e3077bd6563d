"""Versions of an index: complete folders and a pointer that is replaced in one step."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from quillstone.operators.changefeed import apply_changes
from quillstone.session import Files

POINTER, MANIFEST = "CURRENT", "manifest.json"


class Versions:
    """A root folder with versions v1, v2, …; readers see the version that CURRENT names. The root is on any file system that Spark reads."""

    def __init__(self, root: str) -> None:
        self.root = root.rstrip("/")

    @property
    def files(self) -> Files:
        return Files(self.root)

    def all(self) -> list[int]:
        """Version numbers, complete or not."""
        return sorted(int(name[1:]) for name in self.files.names() if name[:1] == "v" and name[1:].isdigit())

    def path(self, version: int) -> str:
        return f"{self.root}/v{version}"

    def current(self) -> int | None:
        return int(self.files.read(POINTER).strip()[1:]) if self.files.exists(POINTER) else None

    def write(self, tables: dict[str, DataFrame], note: dict | None = None) -> int:
        """A new version; its manifest, written last, makes it complete."""
        version = max(self.all(), default=0) + 1
        counts = {}
        for name, df in tables.items():
            df.write.parquet(f"{self.path(version)}/{name}")
            counts[name] = df.sparkSession.read.parquet(f"{self.path(version)}/{name}").count()
        self.files.write(json.dumps({"version": version, "tables": counts, **(note or {})}, sort_keys=True), f"v{version}", MANIFEST)
        return version

    def verify(self, version: int) -> dict:
        """The manifest; an error if the version is missing or incomplete."""
        if not self.files.exists(f"v{version}", MANIFEST):
            raise ValueError(f"version {version} is missing or incomplete")
        found = json.loads(self.files.read(f"v{version}", MANIFEST))
        lost = [t for t in found["tables"] if not self.files.exists(f"v{version}", t, "_SUCCESS")]
        if lost:
            raise ValueError(f"version {version} lacks {', '.join(lost)}")
        return found

    def promote(self, version: int) -> None:
        """Points readers to a verified version."""
        self.verify(version)
        self.files.write(f"v{version}", POINTER)

    def rollback(self) -> int:
        """Points readers to the complete version before the current one."""
        now = self.current()
        for version in reversed([v for v in self.all() if now is not None and v < now]):
            try:
                self.promote(version)
            except ValueError:
                continue
            return version
        raise ValueError("there is no earlier version")

    def prune(self, keep: int) -> list[int]:
        """Removes all but the last keep versions and the current one."""
        gone = [v for v in self.all()[: -keep or None] if v != self.current()]
        for version in gone:
            self.files.remove(f"v{version}")
        return gone

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        """A table of the current version."""
        version = self.current()
        if version is None:
            raise ValueError("no version has been promoted")
        self.verify(version)
        return spark.read.parquet(f"{self.path(version)}/{table}")

    def advance(self, spark: SparkSession, changes: DataFrame, table: str = "catalog") -> int:
        """A new version with the changes applied to the current one, not yet promoted."""
        return self.write({table: apply_changes(self.read(spark, table), changes)}, {"base": self.current()})
