"""Channels side by side under a deadline, and stages that can be stopped (X4, ST7).

Each channel and each stage runs its own Spark jobs under a tag of its own, so one
can be interrupted while the others go on.  What a channel gives is a written table:
rows that are there stay there, whatever happens to another channel.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from py4j.protocol import Py4JError
from pyspark import InheritableThread
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from ..plugins import CallFailed
from ..storage import materialize
from . import retrieval

Channel = Callable[[DataFrame], DataFrame]
RESULT_SCHEMA = "query_id long, chunk_id long, score double, score_normalized double, rank int, source string"
#: Failures of a channel's source, model or jobs; anything else is a mistake in the program and is raised.
FAILURES = (OSError, CallFailed, PySparkException, Py4JError)
#: Seconds that an interrupted channel is given to end.
GRACE = 10.0


@dataclass
class Tagged:
    """A function on a thread of its own whose Spark jobs carry a tag."""

    spark: SparkSession
    name: str
    work: Callable[[], DataFrame]
    tag: str = ""
    result: DataFrame | None = None
    error: BaseException | None = None
    seconds: float | None = None
    thread: threading.Thread | None = None

    def start(self) -> Tagged:
        self.tag = f"quillgraph-{uuid.uuid4().hex}"
        self.thread = InheritableThread(target=self._run, session=self.spark)
        self.thread.daemon = True
        self.thread.start()
        return self

    def _run(self) -> None:
        began = time.monotonic()
        context = self.spark.sparkContext
        context.addJobTag(self.tag)
        try:
            self.result = self.work()
        except BaseException as error:  # noqa: BLE001  told to the caller, who raises what isn't a channel's failure
            self.error = error
        finally:
            self.seconds = time.monotonic() - began
            context.removeJobTag(self.tag)

    def running(self) -> bool:
        return self.thread is not None and self.thread.is_alive()

    def interrupt(self) -> None:
        """Cancel the jobs that run now and those that the function starts until its thread has ended."""
        until = time.monotonic() + GRACE
        while self.running() and time.monotonic() < until:
            self.spark.sparkContext.cancelJobsWithTag(self.tag)
            self.thread.join(0.2)


def _reason(error: BaseException) -> str:
    return f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}"


def fan_out(queries: DataFrame, channels: Mapping[str, Channel], enabled: Sequence[str] | None = None, failures: dict[str, str] | None = None, deadline: float | None = None) -> DataFrame:
    """The union of what all enabled channels give, each run at once with the others and written.

    A channel whose source, model or jobs fail gives no rows, nor does one that
    is not done ``deadline`` seconds after the start; it is interrupted then.
    ``failures`` takes the reasons by channel name, so a missing channel is never
    silent; without it the first failure is raised once all channels have ended.
    """
    spark = queries.sparkSession

    def work(name: str, channel: Channel) -> Callable[[], DataFrame]:
        return lambda: materialize(channel(queries).select(*retrieval.RESULT), f"channel-{name}")

    asked = [Tagged(spark, name, work(name, channel)).start() for name, channel in channels.items() if enabled is None or name in enabled]
    end = None if deadline is None else time.monotonic() + deadline
    for one in asked:
        one.thread.join(None if end is None else max(0.0, end - time.monotonic()))
    late = [one for one in asked if one.running()]
    for one in late:
        one.interrupt()
    told: dict[str, str] = {}
    for one in asked:
        if one in late:
            told[one.name] = f"TimeoutError: not done after {deadline:g} s"
        elif one.error is not None:
            if not isinstance(one.error, FAILURES):
                raise one.error
            told[one.name] = _reason(one.error)
    if told and failures is None:
        first = next(iter(told))
        raise CallFailed(f"{first}: {told[first]}")
    if failures is not None:
        failures.update(told)
    parts = [one.result for one in asked if one.name not in told]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], RESULT_SCHEMA)


class Cancelled(RuntimeError):
    """Raised by stages that were told to stop; ``stage`` is where, ``done`` are the stages before it."""

    def __init__(self, stage: str, done: list[str]):
        super().__init__(f"stopped in stage {stage}")
        self.stage, self.done = stage, done


@dataclass
class StopSignal:
    """ST7: may be set from any thread or signal handler; stages look at it and are interrupted by it."""

    event: threading.Event = field(default_factory=threading.Event)

    def request_stop(self, *_: object) -> None:
        self.event.set()

    def is_cancelled(self) -> bool:
        return self.event.is_set()

    def raise_if_cancelled(self, stage: str, done: Sequence[str] = ()) -> None:
        if self.is_cancelled():
            raise Cancelled(stage, list(done))


def run_stages(source: DataFrame, stages: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]], signal: StopSignal | None = None) -> DataFrame:
    """ST7: ``stages`` one after the other, each one's rows written before the next reads them.

    The signal is looked at before every stage; one that comes while a stage runs
    cancels its jobs.  Either way :class:`Cancelled` names the stage, and what
    earlier stages wrote is not touched.
    """
    signal = signal or StopSignal()
    rows, done = source, []
    for name, stage in stages:
        signal.raise_if_cancelled(name, done)
        one = Tagged(source.sparkSession, name, lambda rows=rows, stage=stage, name=name: materialize(stage(rows), f"stage-{name}")).start()
        while one.running():
            one.thread.join(0.1)
            if signal.is_cancelled():
                one.interrupt()
                break
        if one.error is not None or one.result is None:
            signal.raise_if_cancelled(name, done)
            raise one.error or RuntimeError(name)
        rows = one.result
        done.append(name)
    return rows
