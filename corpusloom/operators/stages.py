"""Builds of several stages, each a function of frames: order follows from what they need."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from corpusloom.sources.tables import shared_folder


@dataclass(frozen=True)
class Stage:
    """Makes the frame ``name`` of the frames that it ``needs``, which are given to it in that order."""

    name: str
    needs: tuple[str, ...]
    run: Callable[..., DataFrame]


class Build:
    """Stages in any order, run by need.

    A frame that is given stands for its stage, which then doesn't run, nor do stages that
    only it needed.  A stage's frame that several others need is written to the shared folder
    once and read by all of them.
    """

    def __init__(self, stages: Sequence[Stage]):
        self.stages = {s.name: s for s in stages}
        if len(self.stages) < len(stages):
            raise ValueError("two stages have one name")

    def order(self, wanted: Sequence[str], given: Sequence[str]) -> list[str]:
        """The stages to run, each after what it needs."""
        out: list[str] = []
        open_: list[str] = []

        def visit(name: str, by: str | None) -> None:
            if name in given or name in out:
                return
            if name not in self.stages:
                raise ValueError(f"{by or 'the caller'} needs {name}, which no stage makes and nobody gave")
            if name in open_:
                raise ValueError(f"stages need each other: {' < '.join([*open_[open_.index(name) :], name])}")
            open_.append(name)
            for need in self.stages[name].needs:
                visit(need, name)
            open_.pop()
            out.append(name)

        for name in wanted:
            visit(name, None)
        return out

    def __call__(self, spark: SparkSession, wanted: Sequence[str], given: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
        frames = dict(given)
        order = self.order(wanted, list(given))
        uses = [n for name in order for n in self.stages[name].needs]
        for name in order:
            stage = self.stages[name]
            made = stage.run(*(frames[n] for n in stage.needs))
            if uses.count(name) + (name in wanted) > 1:
                at = shared_folder(spark, f"stage-{name}")
                made.write.parquet(at)
                made = spark.read.schema(made.schema).parquet(at)
            frames[name] = made
        return {name: frames[name] for name in wanted}
