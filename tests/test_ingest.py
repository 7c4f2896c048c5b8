import os

import pytest
from pyspark.sql import functions as F

from faultframe.functions.labels import decoded_fault_name, drone_id, file_labels
from faultframe.operators.windows import fault_type_ids
from faultframe.plans.prepare import prepare
from faultframe.sources import dataset, flights


def labels_of(spark, name):
    df = spark.createDataFrame([(name,)], "f string")
    return df.select(*[v.alias(k) for k, v in file_labels(F.col("f")).items()]).first().asDict()


@pytest.mark.parametrize(
    "name, healthy, kind, severity, trajectory, drone, speed",
    [
        ("F3_SV2_SP2_t5.mat", 0, "surface_cut", 2, 5, "Unknown", 2),
        ("D1_F0_SV3_SP1_t3.mat", 1, "none", 0, 3, "D1", 1),
        ("D2_F9_SV1_SP1_t1.mat", 0, "other", 1, 1, "D2", 1),
        ("notes.mat", 1, "none", 0, 0, "Unknown", 0),
        ("D3_D1_F1_SV1_SP1_t1.mat", 0, "crack", 1, 1, "D1", 1),
    ],
)
def test_file_names(spark, name, healthy, kind, severity, trajectory, drone, speed):
    found = labels_of(spark, name)
    assert found == {
        "healthy": healthy, "fault_type": kind, "severity": severity, "trajectory": trajectory, "drone_id": drone,
        "speed_case": speed,
    }


def test_decoded_names(spark, rows):
    df = spark.createDataFrame([("2",), ("7",), ("x",)], "c string")
    found = {r[0]: r[1] for r in df.select("c", decoded_fault_name(F.col("c"))).collect()}
    assert found == {"2": "edge_cut", "7": "Unknown (7)", "x": "Invalid (x)"}
    assert df.select(drone_id(F.lit("aD3D2"))).first()[0] == "D2"


def groups(spark):
    main = spark.createDataFrame(
        [("a", i, i / 10, float(i)) for i in range(4)] + [("b", i, i / 10, float(i)) for i in range(3)],
        "flight_id string, sample long, t double, q_1 double",
    )
    cmd = spark.createDataFrame(
        [("a", i, 2.0 * i) for i in range(4)] + [("b", i, 9.0) for i in range(2)],
        "flight_id string, sample long, cmd_1 double",
    )
    return main, cmd


def test_assembly_drops_groups_of_another_length(spark, rows):
    main, cmd = groups(spark)
    found = flights.assemble_flight(main, [cmd])
    assert rows(found.groupBy("flight_id", "channel").count()) == [("a", "cmd_1", 4), ("a", "q_1", 4), ("b", "q_1", 3)]
    assert rows(found.where("channel = 'cmd_1' and sample = 3"), "t", "value") == [(0.3, 6.0)]
    kept = flights.group_sizes(main, cmd)
    assert rows(kept, "flight_id", "kept") == [("a", True), ("b", False)]


def test_assembly_needs_the_main_group(spark):
    main, cmd = groups(spark)
    with pytest.raises(ValueError, match="main channel group missing"):
        flights.assemble_flight(main.where("flight_id = 'a'"), [cmd])


def test_assembly_turns_nan_into_null(spark):
    main = spark.createDataFrame([("a", 0, 0.0, float("nan"))], "flight_id string, sample long, t double, q_1 double")
    assert flights.assemble_flight(main).first()["value"] is None


def test_load_all_reads_labels_from_file_names(spark, rows, tmp_path):
    for name in ("D1_F1_SV2_SP1_t4", "D2_F0_SV1_SP1_t1"):
        target = tmp_path / "one"
        spark.createDataFrame([(0.0, 1.0), (0.1, 2.0)], "t double, q_1 double").coalesce(1).write.mode("overwrite").parquet(str(target))
        part = next(p for p in target.iterdir() if p.suffix == ".parquet")
        (tmp_path / "flights").mkdir(exist_ok=True)
        (tmp_path / "flights" / f"{name}.parquet").write_bytes(part.read_bytes())
    (tmp_path / "flights" / "readme.txt").write_text("x")
    loaded = flights.load_all(spark, str(tmp_path / "flights"))
    assert rows(loaded.groupBy("file_name", "fault_type", "severity").count()) == [
        ("D1_F1_SV2_SP1_t4.parquet", "crack", 2, 2), ("D2_F0_SV1_SP1_t1.parquet", "none", 0, 2),
    ]


def test_inventory(spark, tmp_path):
    (tmp_path / "a.json").write_bytes(b"x" * 10)
    (tmp_path / "b.npz").write_bytes(b"x" * 2048)
    found = flights.file_inventory(spark, str(tmp_path))
    assert [(r.file_name, r.extension, r.bytes) for r in found.collect()] == [("b.npz", ".npz", 2048), ("a.json", ".json", 10)]
    total = flights.inventory_totals(found).first()
    assert total.n_files == 2 and abs(total.total_mb - 2058 / 1048576) < 1e-12


def test_dataset_round_trip(spark, rows, tmp_path):
    samples = spark.createDataFrame(
        [(f, i / 100, float(i % 7)) for f in ("x", "y") for i in range(301)] + [("z", i / 100, 0.0) for i in range(20)],
        "flight_id string, t double, q_1 double",
    )
    files = spark.createDataFrame(
        [("x", "D1_F2_SV1_SP1_t1.mat"), ("y", "D1_F0_SV1_SP1_t1.mat"), ("z", "D1_F1_SV1_SP1_t1.mat")], "flight_id string, file_name string"
    )
    labels = files.select("*", *[v.alias(k) for k, v in file_labels(F.col("file_name")).items()])
    made = prepare(samples, labels, ["q_1"])
    folder = str(tmp_path / "set")
    dataset.write_dataset(made, folder)
    back = dataset.read_dataset(spark, folder)
    assert back.windows.count() == made.windows.count() > 0
    # The flight without windows gives no type id.
    assert rows(back.types) == [("edge_cut", 1), ("none", 0)]
    assert rows(back.labels.groupBy("flight_id", "y_fault", "y_type", "y_sev").count(), "flight_id", "y_fault", "y_type", "y_sev") == [
        ("x", 1, 1, 1), ("y", 0, 0, 0),
    ]
    assert os.path.isdir(f"{folder}/windows/flight_id=x")


def test_type_ids_follow_the_first_file(spark, rows):
    df = spark.createDataFrame([("crack", "b"), ("none", "a"), ("crack", "c"), ("other", "bb")], "fault_type string, file_name string")
    assert rows(fault_type_ids(df)) == [("crack", 1), ("none", 0), ("other", 2)]
