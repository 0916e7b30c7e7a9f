"""How far the results depend on the settings: the whole analysis again, one setting changed at a time."""

from __future__ import annotations

import csv
import json
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from slopewise.config import Settings
from slopewise.plans import build

# The runs, each with the settings that it changes.
RUNS = {
    "baseline": {},
    "spacing_2.5m": {"sample_spacing": 2.5},
    "spacing_10m": {"sample_spacing": 10.0},
    "window_12.5m": {"smooth_window": 12.5},
    "window_50m": {"smooth_window": 50.0},
    "deadband_0.25m": {"deadband": 0.25},
    "deadband_1m": {"deadband": 1.0},
    "sigma_0m": {"dem_sigma": 0.0},
    "sigma_6m": {"dem_sigma": 6.0},
    "point_rank_1": {"point_rank": 1},
    "point_rank_2": {"point_rank": 2},
}
TOP = 12


def summarise(spark: SparkSession, sf_dir: str, tag: str, settings: Settings) -> dict:
    """One run in a few numbers: means of each objective, climbing of the network, corridors."""
    done = build.analyse(spark, sf_dir, settings)
    out: dict = {"tag": tag, "settings": asdict(settings)}
    means = done.trips.groupBy("objective").agg(F.avg("detour_ratio").alias("detour"), F.avg("saved_pct").alias("saved"), F.avg("gain").alias("gain"), F.avg("max_grade").alias("grade"), F.avg("distance").alias("distance"))
    for r in means.orderBy("objective").collect():
        out |= {f"{r.objective}_detour_pct": 100 * (r.detour - 1), f"{r.objective}_saved_pct": r.saved, f"{r.objective}_gain_m": r.gain / 100, f"{r.objective}_max_grade_pct": 100 * r.grade, f"{r.objective}_km": r.distance / 100_000}
    out["gain_per_km"] = done.arcs.where("direction = 'fwd'").agg(F.sum("gain") / F.sum("len") * 1000).first()[0]
    top = done.corridors.orderBy("rank").select("names", "length", "n_pieces").collect()
    out |= {"corridors": len(top), "top_corridors": [r.names for r in top[:TOP]], "top_corridor_km": top[0].length / 100_000 if top else None}
    return out


def sweep(spark: SparkSession, sf_dir: str, runs: dict[str, dict] | None = None, base: Settings = Settings()) -> list[dict]:
    """A summary of each run, with how many of the baseline's first streets its corridors share in percent."""
    rows = [summarise(spark, sf_dir, tag, base.overridden(json.dumps(changed))) for tag, changed in (RUNS if runs is None else runs).items()]
    lead = [{n.split(" - ")[0] for n in r["top_corridors"]} for r in rows]
    for r, own in zip(rows, lead, strict=True):
        r["lead_overlap_pct"] = 100 * len(own & lead[0]) / len(own | lead[0]) if own | lead[0] else 100.0
    return rows


def write(rows: list[dict], folder: str | Path) -> None:
    """summary.json, sensitivity.csv and sensitivity.md: every number of every run, and the range of each."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "summary.json").write_text(json.dumps(rows, indent=1))
    numbers = sorted({k for r in rows for k, v in r.items() if isinstance(v, (int, float))})
    with (folder / "sensitivity.csv").open("w", newline="") as out:
        table = csv.DictWriter(out, ["tag", *numbers], extrasaction="ignore")
        table.writeheader()
        table.writerows(rows)
    show = lambda v: "" if v is None else f"{v:.3f}"
    lines = ["# Sensitivity", "", "| figure | " + " | ".join(r["tag"] for r in rows) + " | least | most |", "| --- |" + " --- |" * (len(rows) + 2)]
    for k in numbers:
        held = [r[k] for r in rows if r.get(k) is not None]
        lines.append(f"| {k} | " + " | ".join(show(r.get(k)) for r in rows) + f" | {show(min(held))} | {show(max(held))} |")
    lines += ["", "## Corridors", ""] + [f"- {r['tag']}: " + "; ".join(r["top_corridors"]) for r in rows]
    (folder / "sensitivity.md").write_text("\n".join(lines) + "\n")
