"""A catalogue of exported views: an allow-list, resolved when asked for, guarded while it is written."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from glyphstream.operators.retrieval import guard_sums
from glyphstream.sources.sinks import FORBIDDEN, safe_records


class UnsafeView(ValueError):
    """A view that holds what must not leave."""


@dataclass(frozen=True)
class Catalogue:
    """Views by name; none is computed before it is asked for.

    ``forbidden`` columns may not be in a view, string values may hold neither a symbol run of ``longest_run`` nor a FASTA header, and
    values of ``token_columns`` may have ``longest_token`` symbols at most.
    """

    views: dict[str, Callable[[], DataFrame]]
    forbidden: frozenset[str] = frozenset(FORBIDDEN)
    token_columns: frozenset[str] = field(default=frozenset({"token"}))
    longest_token: int = 6
    longest_run: int = 80
    schemas: dict[str, StructType] = field(default_factory=dict, init=False, compare=False, repr=False)  # of the views made so far

    def view(self, name: str) -> DataFrame:
        """The view of this name; KeyError for one that isn't listed, UnsafeView for forbidden columns."""
        if name not in self.views:
            raise KeyError(f"no such view: {name}; there are {', '.join(sorted(self.views))}")
        df = self.views[name]()
        if leaked := sorted(self.forbidden & set(df.columns)):
            raise UnsafeView(f"forbidden columns in {name}: {leaked}")
        self.schemas[name] = df.schema
        return df

    def export(self, path: str, names: Iterable[str] | None = None) -> list[tuple[str, int, int | None]]:
        """Write the views (all, or those named) as JSON, a folder each below ``path``; (name, rows, longest token) of each.

        All names are checked first. The guards are metrics of the write itself, so a view is computed once; it is written
        aside and takes its place, and that of an earlier export, only if they found nothing, else it is deleted and UnsafeView raised.
        """
        wanted = sorted(self.views) if names is None else list(names)
        for name in wanted:
            if name not in self.views:
                raise KeyError(f"no such view: {name}; there are {', '.join(sorted(self.views))}")
        return [self._write(name, self.view(name), path) for name in wanted]

    def _write(self, name: str, df: DataFrame, path: str) -> tuple[str, int, int | None]:
        tokens = [c for c in df.columns if c in self.token_columns]
        longest = F.greatest(*(F.max(F.length(c)) for c in tokens)) if len(tokens) > 1 else F.max(F.length(tokens[0])) if tokens else F.max(F.lit(None).cast("int"))
        sums = [s.alias(label) for label, s in guard_sums(df, self.longest_run).items()]
        found, aside, place = Observation(), f"{path}/_{name}-{uuid.uuid4().hex}", f"{path}/{name}"
        safe_records(df.observe(found, F.count(F.lit(1)).alias("__rows"), longest.alias("__longest"), *sums)).write.json(aside)
        seen = dict(found.get)
        rows, most = seen.pop("__rows"), seen.pop("__longest")
        bad = sorted(label for label, n in seen.items() if n)
        if most is not None and most > self.longest_token:
            bad.append(f"a token of {most} symbols")
        spark = df.sparkSession
        fs, at = _file_system(spark, path)
        if bad:
            fs.delete(at(aside), True)
            raise UnsafeView(f"unsafe values in {name}: {', '.join(bad)}")
        fs.delete(at(place), True)
        if not fs.rename(at(aside), at(place)):
            raise OSError(f"{place} could not be put in place")
        return name, rows, most

    def load(self, spark: SparkSession, path: str, name: str) -> DataFrame:
        """An exported view, with the columns of the view, which isn't made again for them; KeyError for a name that isn't listed, FileNotFoundError for one that wasn't exported."""
        schema = self.schemas[name] if name in self.schemas else self.view(name).schema
        fs, at = _file_system(spark, path)
        if not fs.exists(at(f"{path}/{name}")):
            raise FileNotFoundError(f"{name} isn't exported in {path}")
        return spark.read.schema(schema).json(f"{path}/{name}")


def _file_system(spark: SparkSession, path: str):  # noqa: ANN202  objects of the JVM
    """The file system of a path, which any store that Spark reads has, and a maker of its paths."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at
