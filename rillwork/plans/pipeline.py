"""Runs a tree of stages: datum by datum, or all at once."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.errors import InvalidSinkType, PipelineFinished, PipelineNotReady, StageFailed
from rillwork.plans.stages import Stage


class Status(Enum):
    ITER_FIN = "IterFin"
    FINISHED = "Finished"


class Pipeline:
    """``init`` builds the plan, ``iter`` lets one datum of the source pass, ``run_all`` lets all pass in one job.

    A source of n datums gives n times ITER_FIN, once FINISHED, and then
    PipelineFinished is raised. Once a stage behind the source has stopped,
    StageFailed is raised at the next call. ``run_all`` is the way to work with
    data; ``iter`` runs a job for each datum and is for stepping through.
    """

    def __init__(self, head: Stage, spark: SparkSession):
        if head.taken is not None:
            raise InvalidSinkType(f"{type(head).__name__} is no source")
        self.head, self.spark = head, spark
        self._source: DataFrame | None = None
        self._orders: list[int] | None = None
        self._at = 0
        self._ended = self._failed = False

    def __enter__(self) -> Pipeline:
        self.init()
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def init(self) -> None:
        if self._source is not None:
            raise PipelineNotReady("it runs already")
        self._source = self.head.read(self.spark)

    def close(self) -> None:
        """Forget the source and let every stage clean up, the last of each branch first. Once is enough."""
        if self._source is not None:
            self._source = None
            self._clean(self.head)

    def _clean(self, stage: Stage) -> None:
        for child in stage.children.values():
            self._clean(child)
        try:
            stage.cleanup()
        except Exception as e:  # the other stages are to clean up too
            stage.log.error("Failed to drop: %s", e)

    def _pass(self, stage: Stage, df: DataFrame) -> None:
        if not stage.children:
            stage.consume(stage.apply(df) if stage.outputs and stage is not self.head else df)
            return
        for output, child in stage.children.items():
            self._pass(child, stage.branch(df, output) if stage is self.head else stage.apply(df))

    def _stops(self, stage: Stage, df: DataFrame) -> bool:
        if stage.failed_at(df) is not None or getattr(stage, "stopped", False):
            return True
        return any(
            self._stops(child, stage.branch(df, output) if stage is self.head else stage.apply(df))
            for output, child in stage.children.items()
        )

    def iter(self) -> Status:
        if self._source is None:
            raise PipelineNotReady
        if self._failed:
            raise StageFailed
        if self._ended:
            raise PipelineFinished
        order = self.head.order
        rows = self._source.filter(F.col(order) >= self._at).agg(F.min(order)).first()[0]
        if rows is None:
            self._ended = True
            return Status.FINISHED
        datum = self._source.filter(F.col(order) == rows)
        self._at = rows + 1
        self._pass(self.head, datum)
        self._failed = self._stops(self.head, datum)
        return Status.ITER_FIN

    def run_all(self) -> None:
        """Let what is left of the source pass in one go."""
        if self._source is None:
            raise PipelineNotReady
        if self._ended:
            raise PipelineFinished
        rest = self._source.filter(F.col(self.head.order) >= self._at) if self._at else self._source
        self._ended = True
        self._pass(self.head, rest)
