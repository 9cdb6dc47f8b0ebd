"""Tables whose keyed parts are replaced and deleted whole, generation by generation.

A table is a folder. A change claims a number by creating the empty file ``claims/g``, which nothing but its absence lets
it do, writes its rows beside the older ones (``data/<name>/generation=g``), then which keys it replaced or deleted
(``manifest/generation=g``), and last, in the same way, ``commits/n``, in which its number stands, and a note; n counts
commits, so of two changes that began at one commit the second is refused. A reader takes the last commit when it begins
and sees, for each key, the rows of the key's last generation up to it, whatever is committed meanwhile; rows of a change
that never came about are never read. ``vacuum`` deletes what the last commit doesn't show.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(RuntimeError):
    """Another commit came first; read again and try again."""


class Change:
    """A generation in the making."""

    def __init__(self, store: Versioned, based_on: int):
        self.store, self.based_on = store, based_on
        self.generation = based_on + 1
        while not store._create(f"claims/{self.generation}"):
            self.generation += 1

    def write(self, name: str, rows: DataFrame, by: list[str] | None = None) -> DataFrame:
        """Store rows of a table, and read them back. Every key among them must be in the manifest of the commit.

        ``by``: a column whose values are folders of their own, and columns by which rows are sorted there; Spark splits
        folders with many rows.
        """
        path = f"{self.store.path}/data/{name}/generation={self.generation}"
        if by:
            rows = rows.hint("rebalance", by[0]).sortWithinPartitions(*by)
        (rows.write.partitionBy(by[0]) if by else rows.write).mode("overwrite").parquet(path)
        return self.store.spark.read.schema(rows.schema).parquet(path)

    def commit(self, manifest: DataFrame, note: str = "") -> int:
        """Show the generation, with ``manifest`` (key, alive, more facts of a key), if no other one came first.

        ``note`` stands in the commit itself, so it is there if and only if the generation is shown.
        """
        manifest.write.mode("overwrite").parquet(f"{self.store.path}/manifest/generation={self.generation}")
        place = sum(g <= self.based_on for g in self.store.commits()) + 1
        if not self.store._create(f"commits/{place}", self.generation, note):
            raise Conflict(f"{self.store.path} has changed since generation {self.based_on}")
        return self.generation


class Versioned:
    """Tables under ``path`` that share their keys and their commits."""

    def __init__(self, spark: SparkSession, path: str, key: list[str]):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self._known: dict[int, str | None] = {}

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _numbers(self, folder: str, prefix: str = "") -> list[int]:
        """Of the files or folders there that are called ``prefix`` and a number: one for each change, not for each key."""
        fs, p = self._fs(f"{self.path}/{folder}")
        names = [f.getPath().getName().removeprefix(prefix) for f in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _create(self, name: str, content: int | None = None, note: str = "") -> bool:
        """Make a file that is not there yet."""
        fs, p = self._fs(f"{self.path}/{name}")
        try:
            out = fs.create(p, False)
        except Exception:  # noqa: BLE001  each file system has its own for a file that exists
            if fs.exists(p):
                return False
            raise
        if content is not None:
            out.writeInt(content)
            out.writeUTF(note)
        out.close()
        return True

    def _commit(self, n: int) -> tuple[int, str | None] | None:
        """The generation and the note, if there is a commit n; no note in one that was made before there were notes."""
        fs, p = self._fs(f"{self.path}/commits/{n}")
        if not fs.exists(p):
            return None
        noted = fs.getFileStatus(p).getLen() > 4
        file = fs.open(p)
        out = file.readInt(), file.readUTF() if noted else None
        file.close()
        return out

    def notes(self) -> dict[int, str | None]:
        """Each commit's generation and its note, in the order of commits, which is ascending.

        What stands in a commit never changes, and they are numbered without gaps: only those that came since are opened.
        """
        while found := self._commit(len(self._known) + 1):
            self._known[found[0]] = found[1]
        return dict(self._known)

    def commits(self) -> list[int]:
        """Generations in the order of their commits, which is ascending."""
        return list(self.notes())

    def generation(self) -> int:
        """The last commit's; 0 before the first."""
        return max(self.commits(), default=0)

    def change(self, based_on: int | None = None) -> Change:
        """Begin the next generation."""
        return Change(self, self.generation() if based_on is None else based_on)

    def manifest(self, at: int | None = None) -> DataFrame:
        """Each key's last row up to a generation, deleted ones (not alive) included."""
        at = self.generation() if at is None else at
        rows = self.spark.read.option("basePath", f"{self.path}/manifest").option("mergeSchema", True).parquet(*[f"{self.path}/manifest/generation={g}" for g in self._generations("manifest", at)])
        facts = [c for c in rows.columns if c not in self.key]
        last = rows.groupBy(*self.key).agg(F.max_by(F.struct(*facts), "generation").alias("_m"))
        return last.select(*self.key, *[F.col(f"_m.{c}").alias(c) for c in facts])

    def told(self, generation: int, schema: T.StructType) -> DataFrame:
        """The manifest's rows of one generation, as they were committed."""
        return self.spark.read.schema(schema).parquet(f"{self.path}/manifest/generation={generation}")

    def alive(self, at: int | None = None) -> DataFrame:
        return self.manifest(at).where("alive")

    def _generations(self, folder: str, at: int) -> list[int]:
        """Committed generations that have files there, up to one of them."""
        return sorted({g for g in self.commits() if g <= at} & set(self._numbers(folder, "generation=")))

    def read(self, name: str, *, at: int | None = None, keys: DataFrame | None = None, where: Column | None = None) -> DataFrame:
        """Rows of ``name`` that are alive at a generation; of the asked ``keys`` only, where they are given.

        Generations are folders, so Spark prunes those that hold none of the keys asked for.
        """
        at = self.generation() if at is None else at
        rows = self.everything(name, at)
        if where is not None:
            rows = rows.where(where)
        shown = self.alive(at).select(*self.key, "generation")
        if keys is not None:
            shown = shown.join(keys.select(*self.key).distinct(), self.key, "left_semi")
        return rows.join(shown, [*self.key, "generation"], "left_semi").drop("generation")

    def everything(self, name: str, at: int | None = None) -> DataFrame:
        """Rows of all committed generations, replaced ones too, with their ``generation``."""
        at = self.generation() if at is None else at
        folders = [f"{self.path}/data/{name}/generation={g}" for g in self._generations(f"data/{name}", at)]
        return self.spark.read.option("basePath", f"{self.path}/data/{name}").parquet(*folders)

    def vacuum(self, keep: tuple[str, ...] = ()) -> None:
        """Delete generations that show no key any more, and those of no commit, but for the tables of ``keep``.

        Readers of older commits must have ended, and no change may be under way.
        """
        at = self.generation()
        shown = {r["generation"] for r in self.alive(at).select("generation").distinct().collect()}  # at most one a commit
        fs, p = self._fs(f"{self.path}/data")
        for table in [f.getPath().getName() for f in fs.listStatus(p)]:
            for g in set(self._numbers(f"data/{table}", "generation=")) - shown:
                if table not in keep:
                    fs.delete(self._fs(f"{self.path}/data/{table}/generation={g}")[1], True)
