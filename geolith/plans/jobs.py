"""The two batch jobs: ingest and aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolith.operators import aggregate, clean, enrich, sample
from geolith.sources import blocks, files


def ingest(raw: DataFrame, path: str, position: str | Column = "pos", cell: float = enrich.CELL_DEG, precision: int = enrich.PRECISION, replace: bool = False, sample_rows: int | None = None, block: str = "block", seed: int = 42, without: Sequence[str] = ()) -> dict[str, int]:
    """Cleans, enriches and stores a raw table; returns the counters of the rules, and ``stored`` and ``stored_before`` of the store.

    With ``sample_rows``, whole blocks (a column, such as ``sample.file_blocks`` adds) are taken in a seeded order until so many
    rows survive the cleaning; only they are counted and stored. That reads the whole source to choose; ``ingest_sample`` does
    not. With ``replace`` the new table is written beside the old one and then put in its place. Columns ``without`` are not stored.
    """
    if sample_rows is not None:
        raw = sample.block_sample(raw, block, sample_rows, seed, sizes=clean.kept(clean.tagged(raw, position)))
    rows = clean.tagged(raw, position)
    counters = clean.stats(rows).first().asDict()
    events = enrich.documents(enrich.enriched(clean.kept(rows), cell, precision)).drop(*without)
    if replace:
        return counters | {"stored": files.replace(events, path), "stored_before": 0}
    told = files.append_new(events, path, "accident_id")
    return counters | {"stored": told["appended"], "stored_before": told["skipped"]}


def ingest_sample(source: blocks.CsvBlocks, path: str, target_rows: int, wave: int = 24, **options) -> dict[str, int]:
    """``ingest`` of blocks of CSV files, ``wave`` at a time, until ``target_rows`` are stored or no block is left; no other block is read.

    The counters add up over the waves, and tell ``blocks`` and ``bytes`` that were read. An id that an earlier wave has stored counts as
    ``stored_before``.
    """
    total = dict.fromkeys([*clean.REASONS, "rows_in", "rows_out", "dropped_total", "stored", "stored_before", "blocks", "bytes"], 0)
    for chosen in source.waves(wave):
        if total["stored"] >= target_rows:
            break
        told = ingest(clean.renamed(source.read(chosen)), path, position=blocks.position(), without=("_file", "_offset"), **options)
        told |= {"blocks": len(chosen), "bytes": sum(b.length for b in chosen)}
        total = {k: v + told[k] for k, v in total.items()}
    return total | {"retention_pct": round(100.0 * total["rows_out"] / total["rows_in"], 2) if total["rows_in"] else 0.0}


def aggregates(events: DataFrame, cell: float = 0.1, precision: int = 5, top_n: int = 200, exact: bool = False) -> dict[str, DataFrame]:
    """The five aggregate tables of a table of events, lazily."""
    cells = aggregate.grid(events, cell, exact)
    return {"grid": cells, "geohash": aggregate.geohashes(events, precision, exact), "hotspots": aggregate.hotspots(cells, top_n), "temporal": aggregate.temporal(events), "state": aggregate.states(events, exact)}


def write_aggregates(events: DataFrame, folder: str, **options) -> dict[str, int]:
    """Writes all five below ``folder`` and returns their row counts.

    The columns that they need are kept once for all; hotspots come from the grid that was written.
    """
    needed = [c for c in ("accident_id", "lat", "lon", "severity", "start_time", "city", "distance_mi", "state") if c in events.columns]
    base = events.select(*needed).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        tables = aggregates(base, **options)
        counts = {"grid": files.overwrite(tables["grid"], f"{folder}/grid")}
        cells = events.sparkSession.read.parquet(f"{folder}/grid")
        tables["hotspots"] = aggregate.hotspots(cells, options.get("top_n", 200))
        for name in ("hotspots", "geohash", "temporal", "state"):
            counts[name] = files.overwrite(tables[name], f"{folder}/{name}")
        return counts
    finally:
        base.unpersist()
