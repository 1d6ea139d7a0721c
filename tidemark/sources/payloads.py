"""Published JSON payloads, one document each, as immutable versions behind a pointer.

    out/versions/<version>/<name>.json   a document; never changed once written
    out/pointers/<version>.json          the manifest of a run: which version each payload has

The greatest pointer counts. It appears whole, by one rename to a name that was
free, and only after the documents it names; a run that dies at any step leaves
readers where they were.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_ROWS = 10_000  # of one payload, which a page loads whole; beyond it the payload fails


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A file that appears whole under a name that was free."""
    folder, name = path.rsplit("/", 1)
    fs, part = _fs(spark, f"{folder}/.{name}.{uuid.uuid4().hex}")
    stream = fs.create(part, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if not fs.rename(part, _fs(spark, path)[1]):
        raise OSError(f"could not move {path} into its place")


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, p = _fs(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(p)) if fs.exists(p) else []


def _pointers(spark: SparkSession, out: str) -> list[str]:
    return [n[: -len(".json")] for n in _names(spark, f"{out}/pointers") if re.fullmatch(r"\d{9}-.*\.json", n)]


def _manifest(spark: SparkSession, out: str, version: str) -> dict:
    text = spark.read.text(f"{out}/pointers/{version}.json", wholetext=True).first()["value"]
    return json.loads(text)


def _stamp(at: datetime) -> str:
    at = at if at.tzinfo is None else at.astimezone(timezone.utc)
    return at.strftime("%Y-%m-%dT%H:%M:%SZ")


def document(df: DataFrame, name: str, captured_at: datetime, commit: str, params=None) -> str:
    """The rows of a payload in the order of their columns, inside its envelope, as JSON.

    Fails beyond ``MAX_ROWS`` instead of leaving rows out.
    """
    envelope = F.struct(
        F.lit(name).alias("name"),
        F.lit(_stamp(captured_at)).alias("captured_at_utc"),
        F.lit(commit).alias("commit"),
        F.lit(json.dumps(params) if params is not None else None).alias("params"),
    )
    rows = F.array_sort(F.collect_list(F.struct(*df.columns)))
    # one row more than is allowed, so that the driver never holds more
    made = df.limit(MAX_ROWS + 1).agg(
        F.count(F.lit(1)).alias("n"),
        F.to_json(
            F.struct(envelope.alias("snapshot"), rows.alias("payload")), {"ignoreNullFields": "false"}
        ).alias("value"),
    ).first()
    if made["n"] > MAX_ROWS:
        raise ValueError(f"payload {name} has more than {MAX_ROWS} rows")
    return made["value"]


def publish_payloads(
    spark: SparkSession,
    builders: dict[str, Callable[[], DataFrame]],
    out: str,
    captured_at: datetime,
    commit: str = "unknown",
    params: dict[str, dict] | None = None,
) -> dict[str, str]:
    """Write a version of each payload, then the pointer to them; returns what became of each.

    A payload that fails keeps the version it had. The pointer lists the failures
    with what the error said, and is written even if all failed.
    """
    last = _pointers(spark, out)[-1:]
    files = _manifest(spark, out, last[0])["files"] if last else {}
    number = 1 + int(last[0].split("-")[0]) if last else 0
    version = f"{number:09d}-{captured_at:%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"
    results: dict[str, str] = {}
    for name, build in builders.items():
        try:
            text = document(build(), name, captured_at, commit, (params or {}).get(name))
            _put(spark, f"{out}/versions/{version}/{name}.json", text)
            files[name] = {"version": version, "captured_at_utc": _stamp(captured_at)}
            results[name] = "ok"
        except Exception as exc:  # noqa: BLE001 - one payload must not stop the others
            results[name] = f"{type(exc).__name__}: {str(exc)[:300]}"
    pointer = {
        "captured_at_utc": _stamp(captured_at),
        "commit": commit,
        "files": files,
        "failed": {n: r for n, r in results.items() if r != "ok"},
    }
    _put(spark, f"{out}/pointers/{version}.json", json.dumps(pointer, indent=1))
    return results


def current(spark: SparkSession, out: str) -> dict:
    """The manifest that counts; empty before the first run."""
    last = _pointers(spark, out)[-1:]
    return _manifest(spark, out, last[0]) if last else {"files": {}, "failed": {}}


def payload_path(spark: SparkSession, out: str, name: str) -> str:
    """The document of a payload that counts now."""
    files = current(spark, out)["files"]
    if name not in files:
        raise KeyError(f"{name} was never published")
    return f"{out}/versions/{files[name]['version']}/{name}.json"


def read_payload(spark: SparkSession, out: str, name: str, schema: str | None = None) -> DataFrame:
    """One row per row of a payload, with its envelope; ``schema`` is that of the document."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    doc = reader.json(payload_path(spark, out, name), multiLine=True)
    return doc.select("snapshot", F.explode("payload").alias("payload"))


def expire(spark: SparkSession, out: str, keep: int = 10) -> int:
    """Delete all but the newest pointers and the versions none of the rest names; returns how many.

    Pointers go first, so no pointer ever names a version that is gone.
    """
    pointers = _pointers(spark, out)
    kept = pointers[-max(keep, 1):]
    named = {f["version"] for p in kept for f in _manifest(spark, out, p)["files"].values()}
    for p in pointers[: len(pointers) - len(kept)]:
        fs, path = _fs(spark, f"{out}/pointers/{p}.json")
        fs.delete(path, False)
    # newer versions than the last pointer belong to a run that is under way
    old = [v for v in _names(spark, f"{out}/versions") if kept and v not in named and v < kept[-1]]
    for v in old:
        fs, path = _fs(spark, f"{out}/versions/{v}")
        fs.delete(path, True)
    return len(old)
