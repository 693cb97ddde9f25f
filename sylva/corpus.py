"""What a user asks of a corpus, in one place: load, summarise, edit, commit, go back, compare."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import brief as B
from .operators import diff as D
from .operators import versions as H
from .sources.corpus import nodes as read_nodes
from .sources.corpus import nodes_of_lines

Action = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Corpus:
    """A node table and the batches that led to it from its snapshot.

    A corpus never changes: ``run`` and the others give a new one. ``snapshot`` is the last checkpoint; ``batches`` are
    what was committed since, ``labels`` all commits so far. Nothing is computed before an action asks for rows.
    """

    snapshot: DataFrame
    batches: tuple[tuple[Action, ...], ...] = ()
    labels: tuple[str, ...] = ("import",)
    redo_to: Corpus | None = field(default=None, compare=False)
    before: Corpus | None = field(default=None, compare=False)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Corpus:
        return cls(read_nodes(spark, path))

    @classmethod
    def of_texts(cls, docs: DataFrame) -> Corpus:
        return cls(nodes_of_lines(docs))

    @property
    def nodes(self) -> DataFrame:
        return H.materialise(self.snapshot, [list(b) for b in self.batches])

    def run(self, *actions: Action, label: str = "edit", checkpoint: str | None = None) -> Corpus:
        """The corpus after one more batch. Every tenth version is written to ``checkpoint``, if a folder is given, and
        read from there, which keeps plans short."""
        after = replace(self, batches=(*self.batches, actions), labels=(*self.labels, label[:60]), before=self, redo_to=None)
        if checkpoint and (len(after.labels) - 1) % H.EVERY == 0:
            where = f"{checkpoint}/version={len(after.labels) - 1}"
            rows = after.nodes
            rows.write.mode("overwrite").parquet(where)
            after = replace(after, snapshot=rows.sparkSession.read.schema(rows.schema).parquet(where), batches=())
        return after

    def undo(self) -> Corpus:
        return replace(self.before, redo_to=self) if self.before else self

    def redo(self) -> Corpus:
        return self.redo_to or self

    def history(self) -> list[tuple[int, str, bool]]:
        """(number, label, is it a checkpoint) of every version."""
        return [(i, label, i % H.EVERY == 0) for i, label in enumerate(self.labels)]

    def brief(self) -> DataFrame:
        return B.brief(self.nodes)

    def sections(self) -> DataFrame:
        return B.sections(self.nodes)

    def diff(self, other: Corpus) -> DataFrame:
        return D.compare(self.nodes, other.nodes)

    def views(self, prefix: str = "") -> None:
        """Temporary views for SQL: nodes, sections, inventory."""
        self.nodes.select("*", F.array_join(F.transform("sort_path", lambda x: x.cast("string")), ".").alias("path")).createOrReplaceTempView(f"{prefix}nodes")
        self.sections().createOrReplaceTempView(f"{prefix}sections")
        B.inventory(self.nodes).createOrReplaceTempView(f"{prefix}inventory")
