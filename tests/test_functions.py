import pytest
from pyspark.sql import functions as F

from tessera.config import Thresholds
from tessera.functions import geometry, labels, plates
from tessera.operators import dataset, events, mutations
from tessera.sources import registry

SQUARE = "array(named_struct('x', 0.0D, 'y', 0.0D), named_struct('x', 1.0D, 'y', 0.0D), named_struct('x', 1.0D, 'y', 1.0D), named_struct('x', 0.0D, 'y', 1.0D))"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(("x", "y", "inside"), [(0.5, 0.5, True), (1.0, 0.5, True), (0.0, 0.0, True), (1.1, 0.5, False)])
def test_covers(spark, x, y, inside):
    assert one(spark, geometry.covers(F.lit(x), F.lit(y), F.expr(SQUARE))) is inside


@pytest.mark.parametrize(("x", "near"), [(1.01, True), (1.05, False), (0.5, True)])
def test_near_covers(spark, x, near):
    assert one(spark, geometry.near_covers(F.lit(x), F.lit(0.5), F.expr(SQUARE), 0.02)) is near


@pytest.mark.parametrize(
    ("raw", "plate"),
    [("15R15845", "15R-158.45"), ("29a-1234", "29A-1234"), ("lk12ard", "LK12 ARD"), ("L0E56WAA", "OE56 WAA"), ("XA02MN1826", "KA-02-MN-1826"), ("DL2HH7258", "DL-02-HH-7258"), ("ABC1234", "ABC1-234"), ("STOP123", None), ("12345", None), ("", None), (None, None)],
)
def test_plate_format(spark, raw, plate):
    assert one(spark, plates.plate_format(F.lit(raw).cast("string"))) == plate


@pytest.mark.parametrize(
    ("rule", "targets", "candidate", "status"),
    [
        ("PROHIBIT_SPECIFIED", ["Xe máy", "Xe đạp"], "xe máy ", "VIOLATION"),
        ("PROHIBIT_SPECIFIED", ["Xe máy", "Xe đạp"], "Xe tải", "ALLOWED"),
        ("ALLOW_SPECIFIED", ["Xe nâng"], "Xe nâng", "ALLOWED"),
        ("ALLOW_SPECIFIED", ["Xe nâng"], labels.UNKNOWN, "VIOLATION"),
        ("ELSE", ["Xe máy"], "Xe máy", "VIOLATION"),
    ],
)
def test_rule_status(spark, rule, targets, candidate, status):
    array = lambda xs: F.array(*map(F.lit, xs))
    assert one(spark, labels.rule_status(F.lit(rule), array(targets), array([candidate]))) == status


def test_candidates(spark):
    names = F.create_map(F.lit("motorcycle"), F.array(F.lit("Xe máy điện"), F.lit("Xe máy số")))
    find = lambda c, m=names: one(spark, labels.candidate_labels(F.lit(c), F.lit(""), m))
    assert find("motorcycle") == ["Xe máy điện", "Xe máy số"]
    assert find("truck") == [labels.UNKNOWN]
    none = F.create_map().cast("map<string, array<string>>")
    assert find("forklift", none) == ["Xe nâng", "Xe cẩu"]


def test_labels_once_and_color(spark):
    assert one(spark, labels.labels_once(F.array(*map(F.lit, ["Xe", " xe ", "B", ""])))) == ["Xe", "B"]
    h = 0
    for c in "zone-123456789":
        h = (h * 31 + ord(c) + 2**31) % 2**32 - 2**31
    assert one(spark, labels.hash_color(F.lit("zone-123456789"), 7)) == abs(h) % 7


def test_pages_refuse(spark):
    with pytest.raises(ValueError):
        events.page(spark.range(3), "id", 0)


def test_split_keeps_sources_together(spark):
    rows = spark.createDataFrame([(k, f"s{k % 10}") for k in range(100)], "id int, source_id string")
    split = dataset.split_sources(rows, test=True)
    assert dataset.leaks(split).count() == 0
    assert {r.split: r["count"] for r in split.groupBy("split").count().collect()} == {"test": 20, "val": 20, "train": 60}


def test_mutations(spark):
    table = spark.createDataFrame([(1, "OPEN"), (2, "QUEUED")], "id int, status string")
    changed, n = mutations.claim(table, 2, "QUEUED", "RUNNING")
    assert n == 1 and {r.id: r.status for r in changed.collect()} == {1: "OPEN", 2: "RUNNING"}
    assert mutations.claim(table, 2, "FAILED", "RUNNING")[1] == 0
    more = spark.createDataFrame([(2, "X"), (3, "Y")], "id int, status string")
    assert {r.id: r.status for r in mutations.insert_absent(table, more, "id").collect()} == {1: "OPEN", 2: "QUEUED", 3: "Y"}
    assert {r.id: r.status for r in mutations.upsert(table, more, "id").collect()} == {1: "OPEN", 2: "X", 3: "Y"}


def test_registry_and_labels(spark, tmp_path):
    assert registry.read_registry(spark, str(tmp_path / "none.json"), "id string").count() == 0
    (tmp_path / "r.json").write_text('[{"id": "a"}, {"id": "b"}]')
    assert registry.read_registry(spark, str(tmp_path / "r.json"), "id string").count() == 2
    (tmp_path / "l.txt").write_text("0 0.5 0.5 0.2 0.4\n\n1 0 0 1 0 1 1\nx\n")
    rows = {r.class_id: r for r in registry.read_label_texts(spark, str(tmp_path / "l.txt")).collect()}
    assert abs(rows[0].x1 - 0.4) < 1e-9 and rows[1].y2 == 1.0 and rows[None].x1 is None


def test_archive(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("ok.txt", "1")
        z.writestr("../out.txt", "2")
        z.writestr("/abs.txt", "3")
    entries = registry.archive_entries(spark, str(tmp_path / "a.zip"))
    assert {r.name: r.reason for r in registry.refused_entries(entries).collect()} == {"../out.txt": "path leads out", "/abs.txt": "absolute path"}


def test_views(spark):
    from tessera.operators import views

    cols = "id long, track_id long, frame_no long, px double, py double, class string, source string"
    still = [(k, 1, k, 0.5, 0.5, "crate", "primary") for k in range(45)]
    other = [(100 + k, t, k, 0.5, 0.5, c, s) for t, c, s in ((2, "Truck", "primary"), (3, "crate", "custom"), (None, "crate", "primary")) for k in range(45)]
    got = {r.id for r in views.moving(spark.createDataFrame(still + other, cols), Thresholds()).collect()}
    assert got == {r[0] for r in other} | set(range(39))
    row = spark.range(1).select(
        views.any_active(F.create_map(F.lit("a"), F.lit(None).cast("boolean"), F.lit("b"), F.lit(True))).alias("on"), views.any_active(F.lit(None).cast("map<string,boolean>")).alias("off"),
        views.class_names(F.array(F.lit(" a "), F.lit("b"))).alias("names"), views.in_unit(F.struct(F.lit(50.0).alias("x"), F.lit(1.0).alias("y"))).alias("p"), views.in_unit(F.struct(F.lit(0.5).alias("x"), F.lit(1.0).alias("y"))).alias("q"),
        views.zone_rule(views.zone_types(F.lit("PROHIBIT_SPECIFIED"), F.array(F.lit("A")), F.array(F.lit("a"), F.lit("b"), F.lit("c"))), F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("r"),
    ).first()
    assert (row.on, row.off, row.names, tuple(row.p), tuple(row.q)) == (True, False, {0: "a", 1: "b"}, (0.5, 0.01), (0.5, 1.0))
    assert tuple(row.r) == ("PROHIBIT_SPECIFIED", ["a"])
    with pytest.raises(Exception, match="empty one"):
        spark.range(1).select(views.class_names(F.array(F.lit("a"), F.lit(" ")))).collect()


def test_refusals(spark):
    from tessera.operators import events, lists, views

    df = spark.createDataFrame([(1, "BAI-KIEM", "x", "OPEN")], "id int, camera_id string, zone_id string, status string")
    for bad in ({"status": "open"}, {"zone_id": "7"}, {"zone_id": "00000000-0000-0000-8000-000000000002"}):
        with pytest.raises(ValueError, match="must be"):
            lists.area_events(df, **bad)
    assert lists.area_events(df, status="OPEN").count() == 1 and lists.area_events(df, camera="GATE").count() == 0
    with pytest.raises(ValueError, match="limit"):
        events.page(df, "id", 101)
    paths = spark.createDataFrame([("a/b.mp4",), ("..\\x",), ("\\x",), ("a/..b",), (None,)], "p string")
    assert [r[0] for r in paths.select(views.safe_path(F.col("p"))).collect()] == [True, False, False, True, False]
