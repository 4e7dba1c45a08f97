"""Several operations in a row."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

from quillgrid.session import materialize

Step = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Outcome:
    """``table`` is the input itself when a step failed."""

    table: DataFrame
    failed_step: int | None = None
    message: str = ""


def run_steps(df: DataFrame, steps: list[Step], run: bool = False) -> Outcome:
    """Each step gets the result of the one before; the first failing step stops
    the run and the input is kept. A step returns a plan; some look at the data
    while making it, but no result is computed before all steps are accepted.

    With ``run`` the result is computed and stored, so that errors in the data
    (a cast, a raised error) keep the input as well. Which step it was is then
    found by running one step more at a time."""
    out = df
    for number, step in enumerate(steps, 1):
        try:
            out = step(out)
        except (ValueError, PySparkException) as error:
            return Outcome(df, number, str(error))
    if not run:
        return Outcome(out)
    try:
        return Outcome(materialize(out, "steps"))
    except PySparkException as error:
        return Outcome(df, _failing(df, steps), str(error))


def _failing(df: DataFrame, steps: list[Step]) -> int:
    out = df
    for number, step in enumerate(steps, 1):
        out = step(out)
        try:
            out.write.format("noop").mode("overwrite").save()
        except PySparkException:
            return number
    return len(steps)
