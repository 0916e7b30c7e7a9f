import json
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry
from slopewise import cli

ROOT = Path(entry.__file__).resolve().parent


def test_entry_and_names(spark):
    rows = entry.entry(spark).collect()
    assert {r.objective for r in rows} == {"shortest", "min_climb", "grade_averse", "balanced"}
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rest_stands_without_the_training_data_parts(tmp_path):
    """Without the subpackage, whether the pipeline is there or not, the entry still offers everything else."""
    for p in ROOT.glob("slopewise/**/*.py"):
        if "llm" not in p.parts:
            to = tmp_path / p.relative_to(ROOT)
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(p.read_text())
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    (tmp_path / "bench.py").write_text((ROOT / "bench.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') or n == 'pipeline' for n in q), q; print(len(e.oracle_sql()))"
    for pipeline in (False, True):
        if pipeline:
            (tmp_path / "corpus_pipeline.py").write_text((ROOT / "corpus_pipeline.py").read_text())
        done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stderr


def test_command_line(spark, capsys):
    assert cli.main(["queries"], spark) == 0 and "pair_matrix" in capsys.readouterr().out
    assert cli.main(["run", "nothing"], spark) == 2
    assert cli.main(["route", "--from", "0", "--to", "77777"], spark) == 2
    assert cli.main(["route", "--from", "0", "--to", "505"], spark) in (0, 2)
    assert cli.main(["validate"], spark) == 0
    assert cli.main(["report"], spark) == 0
    told = capsys.readouterr().out
    assert "| balanced |" in told and all(f"## {t}" in told for t in ("Corridors", "Passes", "Barriers", "Steep streets", "Flat options of trips"))


def test_layers_are_geojson_in_longitude_and_latitude(spark, tmp_path, capsys):
    assert cli.main(["layers", "--to", str(tmp_path)], spark) == 0
    names = capsys.readouterr().out.split()
    assert names == ["streets", "hoods", "corridors", "barriers", "passes", "basins", "points"]
    for name in names:
        rows = [json.loads(line) for p in (tmp_path / name).glob("part-*") for line in p.read_text().splitlines()]
        assert rows or name in ("corridors", "basins"), name
        flat = [str(r["geometry"]["coordinates"]).replace("[", "").replace("]", "").split(", ") for r in rows]
        assert all(-123.1 < float(c[0]) < -121.0 and 47.0 < float(c[1]) < 48.5 for c in flat), name


def test_lines_merge_through_nodes_where_two_meet(spark):
    from slopewise.plans.layers import merge_lines

    place = {1: (0.0, 0.0), 2: (1.0, 0.0), 3: (2.0, 0.0), 4: (3.0, 0.0), 5: (2.0, 1.0), 6: (9.0, 9.0), 7: (9.0, 8.0), 8: (8.0, 8.0)}
    pairs = [("a", 1, 2), ("a", 3, 2), ("a", 3, 4), ("a", 3, 5), ("ring", 6, 7), ("ring", 7, 8), ("ring", 6, 8)]
    df = spark.createDataFrame([(k, u, v, [place[u], place[v]]) for k, u, v in pairs], "k string, u long, v long, line array<struct<x: double, y: double>>")
    got = {r.k: [[(p.x, p.y) for p in line] for line in r.lines] for r in merge_lines(df, "k").collect()}
    assert sorted(map(len, got["a"])) == [2, 2, 3] and [place[n] for n in (1, 2, 3)] in got["a"]
    assert got["ring"] == [[place[6], place[7], place[8], place[6]]]


def test_sensitivity_writes_its_tables(spark, tmp_path):
    assert cli.main(["sensitivity", "--to", str(tmp_path), "--runs", "baseline", "deadband_1m", "--settings", '{"corridor_quantile": 0.5, "corridor_length": 100, "unknown": 1}'], spark) == 0
    rows = json.loads((tmp_path / "summary.json").read_text())
    assert [r["tag"] for r in rows] == ["baseline", "deadband_1m"] and [r["settings"]["deadband"] for r in rows] == [0.5, 1.0]
    assert all(r["shortest_detour_pct"] == 0 and r["min_climb_gain_m"] <= r["shortest_gain_m"] and r["settings"]["corridor_length"] == 100 for r in rows)
    assert rows[1]["gain_per_km"] <= rows[0]["gain_per_km"] + 1e-9 and rows[0]["lead_overlap_pct"] == 100
    assert len((tmp_path / "sensitivity.csv").read_text().splitlines()) == 3 and "| gain_per_km |" in (tmp_path / "sensitivity.md").read_text()
