"""Sources of verdicts: Column expressions, or user functions over batches of words with errors kept apart."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUTPUT = "word long, source string, valid boolean, text string, error string"
Batch = Callable[["np.ndarray"], tuple["np.ndarray", "list | None"]]  # noqa: F821


def sql_source(words: DataFrame, name: str, valid: Column, text: Column | None = None) -> DataFrame:
    """A source that is an expression over ``word``; the way to prefer, as it stays in the JVM."""
    shown = text if text is not None else F.lit(None).cast("string")
    return words.select("word", F.lit(name).alias("source"), F.coalesce(valid, F.lit(False)).alias("valid"), shown.alias("text"), F.lit(None).cast("string").alias("error"))


def interrupted(fn: Batch, seconds: float) -> Batch:
    """``fn`` with a time limit: after ``seconds`` it is interrupted by TimeoutError. Native code that never comes back to
    Python is not reached by this; ``in_process`` is for such."""

    def limited(words):
        import signal

        def stop(*_):
            raise TimeoutError(f"over {seconds:g} s")

        before = signal.signal(signal.SIGALRM, stop)
        signal.setitimer(signal.ITIMER_REAL, seconds)
        try:
            return fn(words)
        finally:
            signal.setitimer(signal.ITIMER_REAL, 0)
            signal.signal(signal.SIGALRM, before)

    return limited


def in_process(fn: Batch, seconds: float | None) -> Batch:
    """``fn`` in a process of its own for each batch, which is killed after ``seconds``. A batch that takes its process down,
    as native code can, is an error like any other, and the worker goes on."""

    def forked(words):
        import os
        import pickle
        import select
        import signal
        import time

        receive, send = os.pipe()
        child = os.fork()
        if not child:
            os.close(receive)
            try:
                said = pickle.dumps((True, fn(words)))
            except BaseException as e:
                said = pickle.dumps((False, f"{type(e).__name__}: {e}"))
            with os.fdopen(send, "wb") as out:
                out.write(said)
            os._exit(0)
        os.close(send)
        said, end = [], None if seconds is None else time.monotonic() + seconds
        try:
            while True:
                left = None if end is None else max(0.0, end - time.monotonic())
                if not select.select([receive], [], [], left)[0]:
                    raise TimeoutError(f"over {seconds:g} s")
                part = os.read(receive, 1 << 20)
                if not part:
                    break
                said.append(part)
        except TimeoutError:
            os.kill(child, signal.SIGKILL)
            raise
        finally:
            os.close(receive)
            status = os.waitpid(child, 0)[1]
        if not said or os.waitstatus_to_exitcode(status):
            raise ChildProcessError(f"ended with {os.waitstatus_to_exitcode(status)}")
        good, found = pickle.loads(b"".join(said))
        if not good:
            raise BatchError(found)
        return found

    return forked


class BatchError(Exception):
    """What a batch raised in its own process, as text."""

    def __str__(self) -> str:
        return self.args[0]


def udf_source(words: DataFrame, name: str, fn: Batch, seconds: float | None = None, own_process: bool = False) -> DataFrame:
    """A source that is ``fn(words) -> (valid, texts or None)``.

    A batch that raises is halved, one that takes longer than ``seconds`` is cut in as many parts as each then has words, until
    the words that do so stand alone: these become invalid with their error, all others keep their results. Halving
    would wait for a word that never ends as often as its batch can be halved; so it is waited for three times at most in
    a batch of up to 65,536 words. With ``own_process`` a batch runs in a process of its own, so
    code that hangs in native calls is killed and one that crashes costs its word alone; without it a crash of the whole
    worker is left to Spark's retry of the task.
    """
    run_batch = in_process(fn, seconds) if own_process else interrupted(fn, seconds) if seconds is not None else fn

    def isolated(batch) -> list[tuple]:
        import numpy as np

        todo, out = [batch], []
        while todo:
            part = todo.pop()
            try:
                valid, texts = run_batch(part)
                out.append((part, np.asarray(valid, bool), list(texts) if texts is not None else [None] * len(part), [None] * len(part)))
            except Exception as e:
                if len(part) == 1:
                    out.append((part, np.zeros(1, bool), [None], [str(e) if isinstance(e, BatchError) else f"{type(e).__name__}: {e}"]))
                else:
                    n = (len(part) + 1) // 2
                    if isinstance(e, TimeoutError) and seconds is not None:
                        n = 1 if len(part) <= 256 else math.isqrt(len(part))
                    todo += [part[i : i + n] for i in reversed(range(0, len(part), n))]
        return out

    def run(batches) -> Iterator:
        import pandas as pd

        for pdf in batches:
            if len(pdf):
                for part, valid, texts, errors in isolated(pdf["word"].to_numpy()):
                    yield pd.DataFrame({"word": part, "source": name, "valid": valid, "text": pd.Series(texts, dtype="object"), "error": pd.Series(errors, dtype="object")})

    return words.select("word").mapInPandas(run, OUTPUT)


class Registry:
    """Sources by name; an unknown name is an error."""

    def __init__(self) -> None:
        self.made: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def add(self, name: str, make: Callable[[DataFrame], DataFrame]) -> None:
        self.made[name] = make

    def rows(self, words: DataFrame, names: list[str]) -> DataFrame:
        unknown = [n for n in names if n not in self.made]
        if unknown:
            raise KeyError(f"unknown sources: {', '.join(unknown)}")
        out = self.made[names[0]](words)
        for n in names[1:]:
            out = out.unionByName(self.made[n](words))
        return out


def crashes(verdicts: DataFrame, triaged: DataFrame | None = None) -> DataFrame:
    """Words whose source raised, as records of category CRASH, and whether they are triaged (``word, source``)."""
    found = verdicts.where("error is not null").select("word", "source", "error", F.lit("CRASH").alias("category"))
    if triaged is None:
        return found.withColumn("triaged", F.lit(False))
    marks = triaged.select("word", "source").distinct().withColumn("triaged", F.lit(True))
    return found.join(marks, ["word", "source"], "left").withColumn("triaged", F.coalesce("triaged", F.lit(False)))
