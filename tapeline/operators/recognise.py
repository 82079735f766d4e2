"""Speech recognition as a pluggable function, run in batches with one model per Python worker."""

from __future__ import annotations

import traceback
import zlib
from collections.abc import Callable, Iterator, Sequence
from datetime import datetime, timezone
from typing import Protocol

import pandas as pd
from pyspark import TaskContext
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tapeline.schemas import RESULT, Settings


class Recogniser(Protocol):
    """Loaded once per worker; called once per file."""

    def __call__(self, path: str, language: str) -> dict: ...


class Stub:
    """A stand-in without a model: segments follow from a checksum of the path, so reruns agree."""

    def __call__(self, path: str, language: str) -> dict:
        seed = zlib.crc32(f"{language}:{path}".encode())
        segments = [{"start": 2.0 * i, "end": 2.0 * i + 1.5, "text": f" {language} segment {i} of {path} "} for i in range(1 + seed % 4)]
        return {"text": " ".join(s["text"].strip() for s in segments), "segments": segments}


def first_device(load: Callable[[str], Recogniser], devices: Sequence[str] = ("cpu",)) -> tuple[Recogniser, str]:
    """The model on the first device that takes it, and that device; the last one's error if none does."""
    error: Exception = LookupError("no device is left to try")
    for device in devices:
        try:
            return load(device), device
        except Exception as e:  # the next device may do
            error = e
    raise error


#: Models of this Python worker, which Spark keeps from task to task.
_held: dict[tuple, tuple[Recogniser, str]] = {}


def leased(devices: Sequence[str], resource: str = "gpu") -> list[str]:
    """`devices` with those named like `resource` (`gpu`) spelled with the addresses that Spark gave this task (`gpu:1`); without an
    address a device of that kind is left out."""
    context = TaskContext.get()
    given = context.resources().get(resource) if context is not None else None
    addresses = given.addresses if given is not None else []
    return [d for device in devices for d in ([f"{device}:{a}" for a in addresses] if device == resource else [device])]


def held(name: str, load: Callable[[str], Recogniser], devices: Sequence[str]) -> tuple[Recogniser, str]:
    """The worker's model of that name for these devices, loaded when first asked for. A load that fails is tried again by the
    next task."""
    key = name, tuple(devices)
    if key not in _held:
        _held[key] = first_device(load, devices)
    return _held[key]


def recognise(
    files: DataFrame, settings: Settings, load: Callable[[str], Recogniser] = lambda device: Stub(), devices: Sequence[str] = ("cpu",), profile: ResourceProfile | None = None, model: str | None = None
) -> DataFrame:
    """`files` with columns `result`, `error`, `device` and `created`, the time when the file was done. A file that fails has
    a null result, its message and trace in `error`; so have all files of a task whose model loads on no device.

    A worker keeps its model under the name `model` (of the settings, if none is given): runs whose `load` differs need different
    names. With a `profile` the stage asks Spark for its resources, and the device `gpu` becomes the addresses leased to the task."""
    language, name = settings.language, model or settings.model_name

    def failure(e: Exception) -> str:
        return f"{type(e).__name__}: {e}\n{''.join(traceback.format_exception(e))}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recogniser, device, broken = None, None, None
        try:
            recogniser, device = held(name, load, leased(devices))
        except Exception as e:
            broken = failure(e)
        for batch in batches:
            results, errors, times = [], [], []
            for path in batch["path"]:
                result, error = None, broken
                if broken is None:
                    try:
                        result = recogniser(path, language)
                    except Exception as e:  # a bad file must not end the batch
                        error = failure(e)
                results.append(result)
                errors.append(error)
                times.append(datetime.now(timezone.utc))
            yield batch.assign(result=results, error=errors, device=device, created=pd.to_datetime(times))

    schema = ", ".join(f"`{n}` {t}" for n, t in files.dtypes)
    return files.mapInPandas(run, f"{schema}, result {RESULT}, error string, device string, created timestamp", profile=profile)


def observed(results: DataFrame, name: str = "recognised") -> tuple[DataFrame, Observation]:
    """`results` and its progress figures, ready once an action has run: files, failed, segments."""
    seen = Observation(name)
    failed, segments = F.sum(F.col("error").isNotNull().cast("long")), F.sum(F.coalesce(F.size("result.segments"), F.lit(0)))
    return results.observe(seen, F.count(F.lit(1)).alias("files"), failed.alias("failed"), segments.alias("segments")), seen
