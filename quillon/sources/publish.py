"""Publishing: versioned directories with a pointer that is swapped last, in one step, and chunk manifests with digests."""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import constants as C
from quillon.operators.index import Index, load_index, save_index
from quillon.sources.scratch import file_system


POINTER = "generation string, schema int, built_at string, api_version string"


def guard(counts: dict[str, int], least: dict[str, int]) -> None:
    """Fails if a kind has fewer documents than it must have."""
    short = {k: counts.get(k, 0) for k, n in least.items() if counts.get(k, 0) < n}
    if short:
        raise ValueError(f"too few documents: {short}; nothing was written")


def point(spark: SparkSession, path: str, row: dict) -> None:
    """Replaces the pointer by one rename, so that a reader finds the old one or the new one, whenever it looks and
    whatever fails."""
    java = spark.sparkContext._jvm
    target, system = file_system(spark, f"{path}/current.json")
    fresh, _ = file_system(spark, f"{path}/.current-{row['generation']}.json")
    out = system.create(fresh, True)
    out.write(bytearray(json.dumps(row).encode()))
    out.close()
    rename = getattr(java.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context = java.org.apache.hadoop.fs.FileContext.getFileContext(system.makeQualified(target).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(system.makeQualified(fresh), system.makeQualified(target), options)


def publish(spark: SparkSession, index: Index, path: str, built_at: str, least: dict[str, int] | None = None, api_version: str = "") -> str:
    """Writes a new generation under path, swaps the pointer to it, then sweeps all other generations, those of failed
    jobs too; its name. One job publishes at a time."""
    if least:
        guard({r["kind"]: r["n"] for r in index.docs.groupBy("kind").agg(F.count("*").alias("n")).collect()}, least)
    name = uuid.uuid4().hex
    save_index(index, f"{path}/{name}")
    point(spark, path, {"generation": name, "schema": C.SCHEMA_VERSION, "built_at": built_at, "api_version": api_version})
    folder, system = file_system(spark, path)
    for status in system.listStatus(folder):
        if status.isDirectory() and re.fullmatch("[0-9a-f]{32}", status.getPath().getName()) and status.getPath().getName() != name:
            system.delete(status.getPath(), True)
    return name


def current(spark: SparkSession, path: str):
    """The pointer's row, or None."""
    target, system = file_system(spark, f"{path}/current.json")
    return spark.read.schema(POINTER).json(f"{path}/current.json").first() if system.exists(target) else None


def open_published(spark: SparkSession, path: str) -> Index:
    """The index that the pointer names; refuses another schema version."""
    row = current(spark, path)
    if row is None:
        raise ValueError(f"nothing is published under {path}")
    if row["schema"] != C.SCHEMA_VERSION:
        raise ValueError(f"schema {row['schema']}, not {C.SCHEMA_VERSION}: rebuild")
    return load_index(spark, f"{path}/{row['generation']}")


def changed(spark: SparkSession, path: str, generation: str) -> bool:
    """Whether another generation is published; a pointer that cannot be found is no change."""
    row = current(spark, path)
    return row is not None and row["generation"] != generation


def chunks(rows: DataFrame, key: str, data: str, size: int = C.CHUNK_BYTES) -> DataFrame:
    """key, chunk, data: each row's bytes cut to chunks of size bytes."""
    raw = F.encode(data, "UTF-8")
    count = F.greatest(F.ceil(F.octet_length(raw) / size), F.lit(1)).cast("int")
    cut = rows.select(key, raw.alias("raw"), F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk"))
    return cut.select(key, "chunk", F.substring("raw", F.col("chunk") * size + 1, F.lit(size)).alias("data"))


def manifest(rows: DataFrame, key: str, data: str, size: int = C.CHUNK_BYTES) -> DataFrame:
    """key, chunks, bytes, sha256 of each row's bytes."""
    raw = F.encode(data, "UTF-8")
    count = F.greatest(F.ceil(F.octet_length(raw) / size), F.lit(1)).cast("long")
    return rows.select(key, count.alias("chunks"), F.octet_length(raw).cast("long").alias("bytes"), F.sha2(raw, 256).alias("sha256"))


def assemble(parts: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """key, data (null if the chunks don't match the manifest in number, size and digest) and ok."""
    whole = parts.groupBy(key).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("chunk", "data"))).alias("parts"))
    joined = listed.join(whole, key, "left")
    text = F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["data"]))
    data = joined.select(key, "chunks", "bytes", "sha256", "n", text.alias("data"))
    ok = F.coalesce((F.col("n") == F.col("chunks")) & (F.octet_length("data") == F.col("bytes")) & (F.sha2("data", 256) == F.col("sha256")), F.lit(False))
    return data.select(key, F.when(ok, F.col("data")).alias("data"), ok.alias("ok"))


class Transient(Exception):
    """A failure that may go away, such as a connection that was never answered."""


def retry(send: Callable[[], object], attempts: int = 3, sleep: Callable[[float], None] = time.sleep, failed: Callable[[object], bool] = lambda answer: False, transient: tuple[type[Exception], ...] = (Transient, TimeoutError, ConnectionError)):
    """send(), tried again, later each time, after a transient exception or an answer that failed calls a failure of the
    other side. Other answers, a refusal among them, and other exceptions are final; so is the last attempt."""
    for attempt in range(1, attempts):
        try:
            answer = send()
            if not failed(answer):
                return answer
        except transient:
            pass
        sleep(float(attempt))
    return send()


def server_failed(answer: tuple[int, str]) -> bool:
    """Whether an answer (status, text) is a failure of the server, which may pass, and no refusal."""
    return answer[0] >= 500
