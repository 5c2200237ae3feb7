"""What queries can't show: interactive sessions, addresses that fail, runs of steps, exact unions."""

import itertools
import math
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest

from hexalloc import config, run
from hexalloc.functions import geometry
from hexalloc.operators import normalise, pairwise
from hexalloc.sources import ingest, readers


def test_sessions_ask_again(spark):
    """The answer that stands out is asked for again, until the answers agree."""
    asked = []

    def ask(a, b):
        asked.append((a, b))
        good = {("x", "y"): 2.0, ("y", "z"): 2.0, ("x", "z"): 4.0}[a, b]
        return 1 / 9 if (a, b) == ("x", "z") and asked.count((a, b)) == 1 else good

    out = pairwise.session(spark, ["x", "y", "z"], ask)
    assert out["consistent"] and out["asked_again"] >= 1 and out["cr"] <= out["threshold"] == 0.05
    # Answers that never agree end with the rounds.
    out = pairwise.session(spark, ["x", "y", "z"], lambda a, b: 9.0 if (a, b) != ("x", "z") else 1 / 9, rounds=2)
    assert not out["consistent"] and out["asked_again"] == 2


def body(data):
    return lambda address: (200, {}, iter([data]))


def test_network_first(tmp_path):
    path, fresh = ingest.network_first("http://a/x", tmp_path, "x", open_=body(b"one"))
    assert fresh and path.read_bytes() == b"one"
    down = lambda address: (503, {}, iter(()))
    path, fresh = ingest.network_first("http://a/x", tmp_path, "x", open_=down, sleep=lambda s: None)
    assert not fresh and path.read_bytes() == b"one"
    with pytest.raises(ingest.FetchError):
        ingest.network_first("http://a/y", tmp_path, "y", open_=down, sleep=lambda s: None)


def test_fetch_all_side_by_side(tmp_path):
    gate, seen = threading.Barrier(2, timeout=20), []

    def open_(address):
        seen.append(address)
        gate.wait()  # both are under way before either ends
        return 200, {}, iter([address.encode()])

    wanted = {"a.json": "http://h/a", "b.json": "http://h/b"}
    got = ingest.fetch_all(wanted, tmp_path, "free", open_=open_)
    assert {k: p.read_bytes() for k, p in got.items()} == {"a.json": b"http://h/a", "b.json": b"http://h/b"}
    assert set(ingest.read_manifest(tmp_path)) == {"a.json", "b.json"}
    assert ingest.fetch_all(wanted, tmp_path, "free", open_=open_) == got and len(seen) == 2


def test_endpoints_take_turns(tmp_path):
    seen, waits = [], []

    def open_(address):
        seen.append(address.split("?")[0])
        return (200, {}, iter([b"{}"])) if len(seen) == 4 else (429, {}, iter(()))

    path = ingest.ask("[out:json];", ["http://a", "http://b", "http://c"], tmp_path, "roads", "odbl", open_=open_, sleep=waits.append)
    assert seen == ["http://a", "http://b", "http://c", "http://a"] and path.read_bytes() == b"{}" and sum(waits) == ingest.FIRST_WAIT
    assert ingest.ask("[out:json];", ["http://a"], tmp_path, "roads", "odbl", open_=open_) == path and len(seen) == 4
    with pytest.raises(ingest.FetchError):
        ingest.ask("other", ["http://a"], tmp_path, "roads", "odbl", open_=lambda a: (503, {}, iter(())), sleep=lambda s: None)


@pytest.fixture()
def served(tmp_path):
    """An archive behind an address that serves ranges, and how many bytes were asked for."""
    rng = np.random.default_rng(0)
    members = {f"tiles/m{k}.bin": rng.bytes(200_000) for k in range(5)} | {"notes.txt": b"text " * 1000, "empty": b""}
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    whole, sent = (tmp_path / "a.zip").read_bytes(), []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            a, b = self.headers["Range"].removeprefix("bytes=").split("-", 1)
            part = whole[int(a) : int(b) + 1] if a else whole[-int(b) :]
            sent.append(len(part))
            self.send_response(206)
            self.end_headers()
            self.wfile.write(part)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/a.zip", members, sent, len(whole)
    server.shutdown()


def test_members_of_a_remote_archive(spark, served):
    """One member comes without the others."""
    address, members, sent, size = served
    found = {m.name: m for m in readers.members_of(address)}
    assert set(found) == set(members)
    assert all(readers.extract(found[n]) == members[n] for n in ("notes.txt", "tiles/m3.bin", "empty"))
    assert sum(sent) < size / 2
    spark.dataSource.register(readers.ZipSource)
    got = spark.read.format("zip_members").option("contains", "m2").load(address).collect()
    assert [(r.name, bytes(r.content)) for r in got] == [("tiles/m2.bin", members["tiles/m2.bin"])]


def test_steps_in_order(spark, tmp_path):
    steps = ("a", "b", "c")
    assert run.chosen([], None, True, steps) == ["a", "b", "c"]
    assert run.chosen([], "b", False, steps) == ["b", "c"]
    assert run.chosen(["c", "a"], None, False, steps) == ["a", "c"]
    with pytest.raises(ValueError, match="unknown steps: z"):
        run.chosen(["z"], None, False, steps)
    done = []

    def step(name):
        def f(spark, sf_dir):
            if name == "c":
                raise ValueError("no")
            return spark.range(3)

        return f

    with pytest.raises(RuntimeError, match="step c failed; continue with --from c"):
        run.run(spark, ["a", "b", "c"], "", str(tmp_path), {k: step(k) for k in steps}, done.append)
    assert len(done) == 2 and spark.read.parquet(f"{tmp_path}/b").count() == 3
    assert run.main(["--list", "--all"]) == list(run.STEPS)


def test_union_areas():
    square = lambda x, y, s=1.0: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    assert geometry.union_area([]) == 0
    assert geometry.union_area([square(0, 0), square(0, 0)]) == pytest.approx(1)
    assert geometry.union_area([square(0, 0), square(0.5, 0.5), square(3, 3)]) == pytest.approx(2.75)
    # Two triangles: by rows, what neither covers is left out of a fine grid.
    two = [[(0.0, 0.0), (2.0, 0.0), (1.0, 2.0)], [(0.0, 1.5), (1.0, -0.5), (2.0, 1.5)]]
    y, x = (np.mgrid[0:2000, 0:2000] + 0.5) * (2.6 / 2000)
    y -= 0.55
    held = lambda t: np.all([(b[0] - a[0]) * (y - a[1]) - (b[1] - a[1]) * (x - a[0]) > 0 for a, b in zip(t, t[1:] + t[:1])], axis=0)
    assert geometry.union_area(two) == pytest.approx((held(two[0]) | held(two[1])).mean() * 2.6**2, abs=2e-3)
    # Inclusion and exclusion over discs of many corners that cross each other.
    rng = np.random.default_rng(1)
    rings = [[(float(x + math.cos(2 * math.pi * k / 40)), float(y + math.sin(2 * math.pi * k / 40))) for k in range(40)] for x, y in rng.uniform(0, 2, (4, 2))]

    def area(ring):
        return abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(ring, ring[1:] + ring[:1]))) / 2 if len(ring) > 2 else 0.0

    want = 0.0
    for n in range(1, 5):
        for some in itertools.combinations(rings, n):
            both = some[0]
            for other in some[1:]:
                both = geometry.clip_ring(both, other) if both else []
            want += (-1) ** (n + 1) * area(both)
    assert geometry.union_area(rings) == pytest.approx(want, rel=1e-9)


def test_scale_bars():
    assert geometry.scale_bar(2000.0, 120) == (5000, 90)
    assert geometry.scale_bar(1e-9, 10)[0] >= 1


def test_warnings_of_flat_columns(spark):
    df = spark.createDataFrame([(1.0, float(i == 0), None) for i in range(40)], "a double, b double, c double")
    assert {(r.column, r.warning) for r in normalise.warnings(df, ["a", "b", "c"]).collect()} == {("a", "constant"), ("b", "flat core"), ("c", "no value")}


CONFIG = """
method = "percentile_rank"
[solver]
max_distance = 5000.0
share = 0.25
[commodities]
unit = "litre"
[commodity.water]
rate = 3.0
[commodity.ice]
rate = 1.0
unit = "bag"
[[indicator]]
column = "heat"
dimension = "hazard"
phrase = "hot"
[[indicator]]
column = "people"
dimension = "exposure"
phrase = "many"
transform = "log1p"
structural_zero = true
[weights]
provisional = false
[weights.dimensions]
hazard = 0.5
exposure = 0.5
[weights.inside.hazard]
heat = 1.0
[weights.inside.exposure]
people = 1.0
"""


def test_configuration(tmp_path):
    (tmp_path / "c.toml").write_text(CONFIG)
    doc = config.load(str(tmp_path / "c.toml"))
    assert config.load(str(tmp_path / "c.toml")) is doc
    model = config.model_of(doc)
    assert model.method == "percentile_rank" and not model.weights.provisional and model.indicators[1].structural_zero
    assert config.settings_of(doc).share == 0.25
    assert config.commodity(doc, "ice") == {"unit": "bag", "rate": 1.0, "name": "ice"} and config.commodity(doc, "water")["unit"] == "litre"
    for bad in (lambda: config.commodity(doc, "sand"), lambda: config.settings_of({"solver": {"max_distance": 1.0, "speed": 1}}), lambda: config.settings_of({"solver": {"max_distance": -1.0}}), lambda: config.model_of(doc | {"weights": doc["weights"] | {"dimensions": {"hazard": 0.7, "exposure": 0.5}}}), lambda: config.model_of(doc | {"indicator": [{"column": "x", "dimension": "hazard", "phrase": "y"}]})):
        with pytest.raises(config.ConfigError):
            bad()
