"""Single-use runs, vaults, provenance, fingerprints, checks and exports."""

from __future__ import annotations

import hashlib
import io
import json
import os
import re
import zipfile
from collections.abc import Callable
from datetime import datetime, timezone

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.grid import GridSpec


def now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="seconds")


def manifest(inputs: dict[str, bytes], sources: dict[str, bytes], parameters: dict, software: dict[str, str]) -> dict:
    """What a cached result depends on."""
    sha = lambda d: {k: hashlib.sha256(v).hexdigest() for k, v in sorted(d.items())}
    return {"schema_version": 1, "inputs_sha256": sha(inputs), "source_sha256": sha(sources), "parameters": parameters, "software": dict(sorted(software.items()))}


def save_bundle(df: DataFrame, path: str, fingerprint: dict) -> None:
    """Parquet first, the manifest last: a bundle without its manifest doesn't count."""
    df.write.mode("overwrite").parquet(f"{path}/data")
    spark = df.sparkSession
    spark.createDataFrame([(json.dumps(fingerprint, sort_keys=True),)], "m string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load_bundle(spark, path: str, fingerprint: dict) -> DataFrame | None:
    """The bundle, or None where it is missing or was made from anything else."""
    try:
        told = "".join(r.value for r in spark.read.text(f"{path}/manifest").collect())
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return spark.read.parquet(f"{path}/data") if told == json.dumps(fingerprint, sort_keys=True) else None


class SingleUseRun:
    """A ledger file created exclusively on entry: the run is consumed even where it fails."""

    def __init__(self, path: str, candidate: str, bindings: dict | None = None) -> None:
        self.path, self.record = path, {"schema_version": 1, "candidate_id": candidate, "bindings": bindings or {}}

    def _write(self, fd: int) -> None:
        with os.fdopen(fd, "w") as f:
            json.dump(self.record, f, indent=1, allow_nan=False)
            f.flush()
            os.fsync(f.fileno())

    def __enter__(self) -> SingleUseRun:
        self.record |= {"status": "consumed", "consumed_utc": now()}
        self._write(os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o644))
        return self

    def __exit__(self, kind, error, _) -> None:
        self.record |= {"status": "failed" if kind else "finished", "finished_utc": now()} | ({"error": f"{kind.__name__}: {error}"} if kind else {})
        temp = f"{self.path}.tmp"
        self._write(os.open(temp, os.O_CREAT | os.O_TRUNC | os.O_WRONLY, 0o644))
        os.replace(temp, self.path)


class Vault:
    """A holdout that one evaluation may touch."""

    def __init__(self, least_rows: int = 1) -> None:
        self.touched, self.least = 0, least_rows

    def evaluate_once(self, f: Callable, *args):
        if self.touched:
            raise RuntimeError("the vault was used already")
        self.touched += 1
        return f(*args)


def confirm(manifest_: dict, expected: dict[str, str], files: dict[str, bytes]) -> None:
    """Raises ValueError unless every expected file is there with its hash and the manifest names it so."""
    for name, want in expected.items():
        have = hashlib.sha256(files[name]).hexdigest() if name in files else None
        if have != want or manifest_.get(name) != want:
            raise ValueError(f"{name} is not the file that was agreed on")


def strict_json(report: dict) -> str:
    return json.dumps(report, indent=1, sort_keys=True, allow_nan=False)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def file_name(family: Column, hypothesis: Column, date: Column, content_id: Column, outside: str = "nan") -> Column:
    """family_hypothesis_date_id_outside.tif in lower case; null unless date is yyyymmdd and the id 8 hex digits."""
    ok = date.rlike("^[0-9]{8}$") & content_id.rlike("^[0-9a-f]{8}$")
    return F.when(ok, F.concat(F.concat_ws("_", slug(family), slug(hypothesis), date, content_id, F.lit(outside)), F.lit(".tif")))


def note(id_: Column, summary: Column, content_id: Column, most: int = 200) -> Column:
    """id, content id and summary on one line, white space collapsed, at most `most` characters."""
    return F.substring(F.trim(F.regexp_replace(F.concat_ws(" ", id_, F.concat(F.lit("["), content_id, F.lit("]")), summary), r"\s+", " ")), 1, most)


def zip_single(name: str, content: bytes) -> bytes:
    """One member with a fixed date; read back before it is returned."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content, zipfile.ZIP_DEFLATED)
    with zipfile.ZipFile(io.BytesIO(buffer.getvalue())) as z:
        if z.namelist() != [name] or z.read(name) != content:
            raise ValueError("the archive does not read back")
    return buffer.getvalue()


def fingerprint(cells: DataFrame, value: str = "p", block: int = 65536) -> str:
    """sha256 of the scores in order of cell_id: one byte each where all are 0 or 1, else little-endian float32 with
    -0 as 0. Executors order and pack blocks of cell ids; the driver hashes one block after the other."""
    v = F.col(value).cast("float")
    binary = cells.agg(F.coalesce(F.bool_and(v.isin(0.0, 1.0)), F.lit(True)).alias("b")).first().b
    packed = cells.groupBy(F.floor(F.col("cell_id") / block).alias("k")).agg(F.sort_array(F.collect_list(F.struct("cell_id", v.alias("v")))).alias("a"))
    h = hashlib.sha256(b"u1" if binary else b"f4")
    for row in packed.select("k", F.col("a.v").alias("v")).orderBy("k").toLocalIterator():
        x = np.array(row.v, dtype="<f4") + np.float32(0)
        h.update(x.astype("u1").tobytes() if binary else x.tobytes())
    return h.hexdigest()


def checks(cells: DataFrame, footprint: DataFrame, grid: GridSpec) -> DataFrame:
    """(check, pass, hard, detail) of a surface (r, c, p) against its footprint: hard checks must hold."""
    own = cells.select("r", "c", "p", F.lit(True).alias("a")).join(footprint.select("r", "c", F.lit(True).alias("f")), ["r", "c"], "full")
    p, bad = F.col("p"), lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    inside = F.col("f").isNotNull()
    n = own.agg(
        bad(inside & (p.isNull() | F.isnan("p"))).alias("missing_inside"), bad(inside & ~F.isnan("p") & ~p.between(0, 1)).alias("out_of_range"), bad(~inside & p.isNotNull() & ~F.isnan("p") & (p != 0)).alias("scores_outside"),
        bad(~(F.col("r").between(0, grid.height - 1) & F.col("c").between(0, grid.width - 1))).alias("off_grid"), bad(inside & (p > 0)).alias("positive"), F.count_distinct("p").alias("values"),
    )
    row = lambda name, ok, hard, of: F.struct(F.lit(name).alias("check"), ok.alias("pass"), F.lit(hard).alias("hard"), F.col(of).cast("string").alias("detail"))
    all_ = [row(x, F.col(x) == 0, True, x) for x in ("missing_inside", "out_of_range", "off_grid")] + [row("scores_outside", F.col("scores_outside") == 0, False, "scores_outside"), row("not_empty", F.col("positive") > 0, True, "positive"), row("not_constant", F.col("values") > 1, False, "values")]
    return n.select(F.inline(F.array(*all_)))


def export(cells: DataFrame, grid: GridSpec, path: str, value: str = "p", overwrite: bool = False) -> int:
    """Writes an uncompressed float32 TIFF, NaN where the table has no cell, through a temporary file.
    Rows come to the driver one at a time; the raster itself is held there.
    Raises ValueError for a score that is missing or outside [0, 1]; returns the number of cells."""
    bad = cells.where(F.col(value).isNull() | F.isnan(value) | ~F.col(value).between(0, 1)).count()
    if bad:
        raise ValueError(f"{bad} scores are not in [0, 1]")
    if os.path.exists(path) and not overwrite:
        raise FileExistsError(path)
    from gridloom.sources.tiff import write

    a, _, x0, _, _, y0 = grid.transform
    rows = cells.groupBy("r").agg(F.sort_array(F.collect_list(F.struct("c", F.col(value).cast("float").alias("v")))).alias("a")).orderBy("r")
    pixels, n = np.full((1, grid.height, grid.width), np.nan, "f4"), 0
    for row in rows.toLocalIterator():
        for x in row.a:
            pixels[0, row.r, x.c] = x.v
            n += 1
    with open(f"{path}.tmp", "wb") as f:
        f.write(write(pixels, (x0, y0), a))
        f.flush()
        os.fsync(f.fileno())
    os.replace(f"{path}.tmp", path)
    return n


def json_documents(raw: str) -> list:
    """The values of JSON texts that stand one after the other."""
    decoder, out, at = json.JSONDecoder(), [], 0
    while True:
        at = re.compile(r"\s*").match(raw, at).end()
        if at == len(raw):
            return out
        value, at = decoder.raw_decode(raw, at)
        out.append(value)
