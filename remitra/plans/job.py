"""Steps that wait for each other, run as soon as they can, with their written tables removed once nobody needs them.

A step names the steps it reads. Each runs in a folder of its own: whatever it
stages on the way goes when its result is written, and the result goes when the
last step that reads it has ended. What a job is for is published by its last steps
outside that folder; when it ends, or fails, nothing staged is left.
"""

from __future__ import annotations

import contextvars
import uuid
from collections.abc import Callable, Mapping
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

from remitra.session import shared_dir, stage, staging


@dataclass(frozen=True)
class Step:
    """``run`` gets the results of ``needs`` by name; a DataFrame it returns is written for the steps that need it."""

    run: Callable[[Mapping[str, object]], object]
    needs: tuple[str, ...] = ()


def _order(steps: Mapping[str, Step]) -> None:
    """Raise unless every need is a step and none waits for itself."""
    unknown = sorted({need for step in steps.values() for need in step.needs} - set(steps))
    if unknown:
        raise ValueError(f"no step {', '.join(unknown)}")
    open_, done = dict(steps), set()
    while open_:
        ready = [name for name, step in open_.items() if done.issuperset(step.needs)]
        if not ready:
            raise ValueError(f"steps wait for each other: {', '.join(sorted(open_))}")
        done.update(ready)
        for name in ready:
            del open_[name]


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def run(spark: SparkSession, steps: Mapping[str, Step], at_once: int = 8) -> dict[str, object]:
    """Run all steps; returns what steps that nobody reads returned, which must not be staged tables."""
    _order(steps)
    root = f"{shared_dir(spark)}/job-{uuid.uuid4().hex}"
    readers = {name: sum(name in step.needs for step in steps.values()) for name in steps}
    results: dict[str, object] = {}

    def one(name: str) -> object:
        with staging(f"{root}/{name}/work"):
            found = steps[name].run({need: results[need] for need in steps[name].needs})
        if isinstance(found, DataFrame) and readers[name]:
            with staging(f"{root}/{name}/result"):
                found = stage(found, name)
        remove(spark, f"{root}/{name}/work")
        return found

    waiting, under_way = dict(steps), {}
    try:
        with ThreadPoolExecutor(max_workers=at_once) as pool:
            while waiting or under_way:
                for name in [n for n, step in waiting.items() if all(need in results for need in step.needs)]:
                    del waiting[name]
                    task = inheritable_thread_target(spark)(one)
                    under_way[pool.submit(contextvars.copy_context().run, task, name)] = name
                ended, _ = wait(under_way, return_when=FIRST_COMPLETED)
                for future in ended:
                    name = under_way.pop(future)
                    results[name] = future.result()
                    for need in steps[name].needs:
                        readers[need] -= 1
                        if not readers[need]:
                            results[need] = None
                            remove(spark, f"{root}/{need}")
    finally:
        remove(spark, root)
    return {name: found for name, found in results.items() if not any(name in step.needs for step in steps.values())}
