"""Post-processing steps registered by name and run in a configured order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from scholia.session import cut_lineage

Step = Callable[[DataFrame], DataFrame]


@dataclass
class PostProcessing:
    """A registry of ``DataFrame -> DataFrame`` steps.

    A step gets the result of the last step that worked.  A failing step is
    recorded and does not stop the others.
    """

    steps: dict[str, Step] = field(default_factory=dict)

    def register(self, name: str) -> Callable[[Step], Step]:
        def keep(step: Step) -> Step:
            self.steps[name] = step
            return step

        return keep

    def run(
        self, df: DataFrame, order: list[str], subset: list[str] | None = None, disabled: tuple[str, ...] = ()
    ) -> tuple[DataFrame, DataFrame]:
        """The final frame and the outcome table ``(step, ok, error)``."""
        outcomes = []
        for name in order:
            if name in disabled or (subset and name not in subset):
                continue
            try:
                # kept at once, so that a failure belongs to the step that caused it
                df = cut_lineage(df.transform(self.steps[name]))
                outcomes.append((name, True, None))
            except Exception as error:  # recorded per step by contract
                outcomes.append((name, False, str(error)[:500]))
        return df, _outcome_table(df.sparkSession, outcomes)


def _outcome_table(spark: SparkSession, outcomes: list[tuple]) -> DataFrame:
    return spark.createDataFrame(outcomes, "step string, ok boolean, error string")
