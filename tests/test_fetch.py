"""Listing, downloads that fail and start again, paged services, stores."""

import http.server
import json
import threading
import urllib.parse

import pytest

from slopewise.sources import fetch, files


class Server(http.server.BaseHTTPRequestHandler):
    failures = {"n": 0}

    def do_GET(self):
        parts = urllib.parse.urlparse(self.path)
        asked = dict(urllib.parse.parse_qsl(parts.query))
        if parts.path == "/layer/query":
            at, n = int(asked["resultOffset"]), int(asked["resultRecordCount"])
            body = json.dumps({"features": [{"type": "Feature", "properties": {"id": i}, "geometry": None} for i in range(at, min(at + n, 2300))]}).encode()
        elif self.failures["n"] > 0:
            self.failures["n"] -= 1
            body = b"short"
            self.send_response(200)
            self.send_header("Content-Length", "999")
            self.end_headers()
            self.wfile.write(body)
            return
        else:
            body = b"x" * 3_000_000
        self.send_response(200)
        self.send_header("Content-Length", str(len(body)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def url():
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}"
    server.shutdown()


def test_downloads_start_again_and_are_kept(url, tmp_path):
    pauses, target = [], tmp_path / "a/b.bin"
    Server.failures["n"] = 2
    assert fetch.download(f"{url}/file", target, sleep=pauses.append) == target
    assert target.stat().st_size == 3_000_000 and pauses == [2.0, 4.0]
    Server.failures["n"] = 99
    assert fetch.download(f"{url}/file", target, sleep=pauses.append) == target  # kept, not asked for
    with pytest.raises(OSError):
        fetch.download(f"{url}/file", target, force=True, retries=3, sleep=pauses.append)
    assert len(pauses) == 4 and [p.name for p in target.parent.iterdir()] == ["b.bin"] and target.stat().st_size == 3_000_000
    Server.failures["n"] = 0


def test_pages_until_a_short_one(url, tmp_path):
    assert [f["properties"]["id"] for f in fetch.features(fetch.feature_page(f"{url}/layer"))] == list(range(2300))
    assert fetch.write_features(fetch.features(fetch.feature_page(f"{url}/layer"), 500), tmp_path / "f.json") == 2300
    assert len((tmp_path / "f.json").read_text().splitlines()) == 2300


def test_optional_steps_may_fail():
    def broken():
        raise OSError("gone")

    assert fetch.gather({"a": lambda: 1}, {"b": broken, "c": lambda: 3}) == {"a": 1, "c": 3}
    with pytest.raises(OSError):
        fetch.gather({"a": broken})


def test_listing(spark, tmp_path):
    for name in ("x/a.parquet", "x/y/b.parquet", "x/c.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("12345")
    got = fetch.list_files(spark, f"file://{tmp_path}/x", ".parquet").collect()
    assert [(r.path.rsplit("/", 1)[1], r.bytes) for r in got] == [("a.parquet", 5), ("b.parquet", 5)]


def test_stores_of_profiles_and_routes_come_back(spark, tmp_path):
    profiles = spark.createDataFrame([(1, [0.0, 5.0], [1.0, 2.0]), (2, [0.0], [None])], "edge_id long, dist array<double>, z array<double>")
    routes = spark.createDataFrame([("shortest", 5, 1.5, [1, 2, 3]), ("balanced", 5, 2.5, [])], "objective string, request long, cost double, arcs array<long>")
    made = []

    def make(df):
        made.append(df)
        return df

    for name, df in (("profiles", profiles), ("routes", routes)):
        for _ in range(2):  # made once, then read
            got = files.cached(spark, f"{tmp_path}/{name}", lambda df=df: make(df))
            assert sorted(map(str, got.collect())) == sorted(map(str, df.collect()))
    assert len(made) == 2


def test_facilities_in_service_and_trails_are_one_table(spark):
    streets = spark.createDataFrame([("BKF-BL", "INSVC", 1), ("BKF-SHW", "PLNRECON", 2), ("BKF-BL", "REMOVED", 3)], "category string, status string, id int")
    trails = spark.createDataFrame([(9,)], "id int")
    assert sorted((r.category, r.id) for r in files.facility_union(streets, trails).collect()) == [("BKF-BL", 1), ("BKF-SHW", 2), ("TRAIL", 9)]
