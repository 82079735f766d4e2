"""Keyed state of streams, on disk."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_STORE = "spark.sql.streaming.stateStore."
CONF = {
    _STORE + "providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    _STORE + "rocksdb.boundedMemoryUsage": "true",
    _STORE + "rocksdb.maxMemoryUsageMB": "256",
    _STORE + "rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def disk_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, with a bound on memory."""
    before = {k: spark.conf.get(k, None) for k in CONF}
    try:
        for k, v in CONF.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
