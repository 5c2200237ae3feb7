"""Steps of a build in order: all of them, from one on, or by name.

    python -m hexalloc.run --list | --all | --from STEP | STEP...   --sf DIR --out DIR
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Steps in the order in which they build on one another: queries whose tables are written.
STEPS = ("indicator_table_join", "layer_missing_summary", "plausibility_gates", "composite_priority", "mc_rank_intervals", "weight_scenarios_spearman", "place_briefs", "greedy_plan", "exact_plan", "serving_rows")


def chosen(names: list[str], begin: str | None, everything: bool, steps=STEPS) -> list[str]:
    """The steps to run, in their order; an unknown name is an error."""
    if unknown := sorted({*names, *([begin] if begin else [])} - {*steps}):
        raise ValueError(f"unknown steps: {', '.join(unknown)}; known: {', '.join(steps)}")
    if everything:
        return list(steps)
    if begin:
        return list(steps[steps.index(begin) :])
    return [s for s in steps if s in names]


def run(spark: SparkSession, steps: list[str], sf_dir: str, out: str, queries: dict[str, Callable[[SparkSession, str], DataFrame]], say: Callable[[str], None] = print) -> dict[str, float]:
    """Writes a table for each step; stops at the first that fails, naming it."""
    took = {}
    for name in steps:
        began = time.time()
        try:
            queries[name](spark, sf_dir).write.mode("overwrite").parquet(f"{out}/{name}")
        except Exception as e:
            raise RuntimeError(f"step {name} failed; continue with --from {name}") from e
        took[name] = time.time() - began
        say(f"{name}: {took[name]:.1f} s")
    return took


def main(arguments: list[str] | None = None) -> list[str]:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("steps", nargs="*")
    parser.add_argument("--all", action="store_true")
    parser.add_argument("--list", action="store_true")
    parser.add_argument("--from", dest="begin")
    parser.add_argument("--sf")
    parser.add_argument("--out")
    a = parser.parse_args(arguments)
    steps = chosen(a.steps, a.begin, a.all)
    if a.list or not steps:
        print("\n".join(STEPS))
        return steps
    from .plans import catalog

    run(SparkSession.builder.getOrCreate(), steps, a.sf, a.out, catalog.QUERIES)
    return steps


if __name__ == "__main__":
    main()
