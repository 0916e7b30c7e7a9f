"""Getting files onto shared storage before the engine reads them: listing, downloads, paged services.

This is work for the driver and bound by the network; nothing here is needed
once the files are there.
"""

from __future__ import annotations

import json
import logging
import time
import urllib.parse
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger("slopewise")

RETRIES, FIRST_PAUSE, CHUNK, PAGE = 5, 2.0, 1 << 20, 1000


def list_files(spark: SparkSession, folder: str, suffix: str = "") -> DataFrame:
    """(path, bytes) of all files under a folder whose names end so, on any file system that Spark knows; listed page by page, not all at once in memory of the store."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, True)
    rows = []
    while files.hasNext():
        f = files.next()
        path = f.getPath().toString()
        if path.endswith(suffix):
            rows.append((path, f.getLen()))
    return spark.createDataFrame(sorted(rows), "path string, bytes long")


def download(url: str, target: str | Path, force: bool = False, retries: int = RETRIES, pause: float = FIRST_PAUSE, opener: Callable = urllib.request.urlopen, sleep: Callable[[float], None] = time.sleep) -> Path:
    """The target file, downloaded if it is missing or force is set.

    It appears under its name when it is whole: as many bytes as were announced.
    Failures are tried again after pauses that double; the last one is raised.
    """
    target = Path(target)
    if target.exists() and not force:
        return target
    target.parent.mkdir(parents=True, exist_ok=True)
    for attempt in range(retries):
        part = target.with_name(f"{target.name}.{uuid.uuid4().hex}.part")
        try:
            with opener(url) as answer, part.open("wb") as out:
                expected, size = answer.headers.get("Content-Length"), 0
                while data := answer.read(CHUNK):
                    size += out.write(data)
            if expected is not None and size != int(expected):
                raise OSError(f"{url}: {size} of {expected} bytes")
            part.replace(target)
            return target
        except OSError as failure:
            part.unlink(missing_ok=True)
            if attempt == retries - 1:
                raise
            log.warning("%s; trying again", failure)
            sleep(pause * 2**attempt)
    raise ValueError("retries must be at least one")


def features(page: Callable[[int, int], list[dict]], size: int = PAGE) -> Iterator[dict]:
    """All features of a service that gives them in pages, page(offset, size); a short page is the last."""
    offset = 0
    while True:
        rows = page(offset, size)
        yield from rows
        if len(rows) < size:
            return
        offset += size


def feature_page(layer: str, where: str = "1=1", fields: str = "*", opener: Callable = urllib.request.urlopen) -> Callable[[int, int], list[dict]]:
    """Pages of a feature layer as GeoJSON, in the order of its object ids."""

    def page(offset: int, size: int) -> list[dict]:
        asked = {"where": where, "outFields": fields, "outSR": 4326, "f": "geojson", "orderByFields": "OBJECTID", "resultOffset": offset, "resultRecordCount": size}
        with opener(f"{layer}/query?{urllib.parse.urlencode(asked)}") as answer:
            return json.load(answer)["features"]

    return page


def write_features(rows: Iterator[dict], target: str | Path) -> int:
    """Newline-delimited GeoJSON, which files.geojson_lines takes in parallel; returns the number of features."""
    target = Path(target)
    target.parent.mkdir(parents=True, exist_ok=True)
    part, n = target.with_name(f"{target.name}.{uuid.uuid4().hex}.part"), 0
    with part.open("w") as out:
        for row in rows:
            out.write(json.dumps(row) + "\n")
            n += 1
    part.replace(target)
    return n


def gather(required: dict[str, Callable[[], object]], optional: dict[str, Callable[[], object]] | None = None) -> dict[str, object]:
    """Runs every step by name; a required one that fails is raised, an optional one is logged and left out."""
    done = {name: step() for name, step in required.items()}
    for name, step in (optional or {}).items():
        try:
            done[name] = step()
        except (OSError, ValueError, KeyError) as failure:
            log.warning("left out %s: %s", name, failure)
    return done
