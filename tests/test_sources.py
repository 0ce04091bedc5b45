"""Published tables, text and binary sources, and the streaming operators, on small inputs."""

import struct

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from cairn.sources.adapters import BagAdapter, PoseFileAdapter, SourceConfig, TableAdapter, digest_of
from cairn.sources.artifacts import inventory, pose_lines, publish, unpack_points, verify
from cairn.sources.messages import MAGIC, decode, decode_image, decode_imu, read_bags
from cairn.sources.stores import index_problems, load_features, pack_masks, read_run, record_table, unpack_masks, with_offsets, write_features, write_run, write_sequence
from cairn.streaming.windows import first_seen, pairs_within, timed, windowed_summary


def test_published_once_and_verified(spark, tmp_path):
    path = str(tmp_path / "table")
    recorded = publish(spark.range(100).withColumn("k", F.col("id") % 3), path, partition_by=("k",), sort_by=("id",)).toPandas()
    listed = spark.createDataFrame(recorded)
    assert recorded["file"].str.startswith("k=").all() and verify(spark, path, listed).isEmpty()
    with pytest.raises(AnalysisException):
        publish(spark.range(1), path)
    assert inventory(spark, path).count() == len(recorded)
    target = next((tmp_path / "table").rglob("*.parquet"))
    target.write_bytes(target.read_bytes() + b"x")
    target.with_name(f".{target.name}.crc").unlink()  # else the file system tells before the digest does
    spark.range(1).write.mode("append").parquet(path + "/k=9")
    assert {r["problem"] for r in verify(spark, path, listed).collect()} == {"changed", "unexpected"}


def test_pose_lines_keep_bad_ones(spark, tmp_path):
    (tmp_path / "poses.txt").write_text("# t x y z qx qy qz qw\n0 1 2 3 0 0 0 1\n\n1 1 2 3\n2 a 2 3 0 0 0 1\n")
    rows = {r["line"]: r for r in pose_lines(spark, str(tmp_path / "poses.txt")).collect()}
    assert [r["problem"] for r in rows.values()] == [None, "field count", "not a number"]
    assert rows["0 1 2 3 0 0 0 1"]["z"] == 3.0 and rows["1 1 2 3"]["x"] is None


def test_packed_points(spark):
    packed = b"".join(struct.pack("<fh", x, i) for i, x in enumerate((1.5, -2.0)))
    layout = [("x", "<f4"), ("n", "<i2")]
    rows = spark.createDataFrame([(1, packed), (2, b""), (3, None)], "scan long, data binary")
    assert sorted(map(tuple, unpack_points(rows, layout).collect())) == [(1, 0, 1.5, 0.0), (1, 1, -2.0, 1.0)]
    with pytest.raises(Exception, match="no whole number"):
        unpack_points(spark.createDataFrame([(1, packed[:-1])], "scan long, data binary"), layout).collect()


def _stream(spark, tmp_path, name):
    rows = [(1, "a", 0, 1.0), (2, "b", 5, 2.0), (2, "b", 5, 2.0), (3, "a", 61, 4.0), (4, "b", 300, 8.0)]
    df = spark.createDataFrame(rows, "event_id long, modality string, s long, value double")
    df = df.select("event_id", "modality", F.timestamp_seconds(F.col("s") + 1_200_000).alias("ts"), "value", F.lit(1).alias("clock"))
    df.write.parquet(str(tmp_path / name))
    return timed(spark.readStream.schema(df.schema).parquet(str(tmp_path / name)), "1 minute")


def _all(df, tmp_path, name):
    query = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_windows_close_behind_the_watermark(spark, tmp_path):
    out = _all(windowed_summary(_stream(spark, tmp_path, "in"), "1 minute"), tmp_path, "windows")
    assert sorted((r["modality"], r["n"], r["most"]) for r in out) == [("a", 1, 1.0), ("a", 1, 4.0), ("b", 2, 2.0)]


def test_interval_join(spark, tmp_path):
    a, b = _stream(spark, tmp_path, "a").filter("modality = 'a'"), _stream(spark, tmp_path, "b").filter("modality = 'b'")
    assert [tuple(r) for r in _all(pairs_within(a, b, 5), tmp_path, "pairs")] == [(1, 1, 2, 5_000_000)] * 2


def test_repeats_go(spark, tmp_path):
    out = _all(first_seen(_stream(spark, tmp_path, "r")), tmp_path, "repeats")
    assert sorted(r["event_id"] for r in out) == [1, 2, 3, 4]


def ros_header(seq, t, frame, cdr=False):
    stamp = struct.pack("<II", *divmod(t, 1_000_000_000))
    return (b"" if cdr else struct.pack("<I", seq)) + stamp + struct.pack("<I", len(frame) + cdr) + frame.encode() + b"\0" * cdr


def image(t, width, height, step, pixels, encoding="mono8", big=0):
    return ros_header(1, t, "cam") + struct.pack("<III", height, width, len(encoding)) + encoding.encode() + struct.pack("<BII", big, step, len(pixels)) + pixels


def cloud_message(t, points, step=20, short=0):
    fields = b"".join(struct.pack("<I", 1) + n.encode() + struct.pack("<IBI", at, 7, 1) for n, at in (("x", 4), ("y", 8), ("z", 12)))
    body = b"".join(struct.pack("<4xfff4x", *p) for p in points)
    return ros_header(2, t, "lidar") + struct.pack("<III", 1, len(points), 3) + fields + struct.pack("<BIII", 0, step, step * len(points), len(body)) + body[: len(body) - short]


def odometry(t, cdr=False):
    head = ros_header(3, t, "odom", cdr) + (b"" if not cdr else b"\0" * (-len(ros_header(3, t, "odom", cdr)) % 4))
    child = struct.pack("<I", 4 + cdr) + b"body" + b"\0" * cdr
    out = head + child
    out += b"\0" * ((-len(out) % 8) if cdr else 0)
    return (b"\0\1\0\0" if cdr else b"") + out + struct.pack("<3d4d36d", 1, 2, 3, 0, 0, 0, 1, *range(36))


def bag_record(fields, data):
    header = b"".join(struct.pack("<I", len(k) + 1 + len(v)) + k.encode() + b"=" + v for k, v in fields.items())
    return struct.pack("<I", len(header)) + header + struct.pack("<I", len(data)) + data


def bag(messages, packing="none"):
    import bz2

    topics = sorted({m[0] for m in messages})
    body = b"".join(bag_record({"op": b"\7", "conn": struct.pack("<I", i), "topic": t.encode()}, b"".join(struct.pack("<I", len(x)) + x for x in (b"type=" + t.encode() + b"/Kind",))) for i, t in enumerate(topics))
    body += b"".join(bag_record({"op": b"\2", "conn": struct.pack("<I", topics.index(t)), "time": struct.pack("<II", *divmod(at, 1_000_000_000))}, data) for t, at, data in messages)
    body += bag_record({"op": b"\2", "conn": struct.pack("<I", 99), "time": struct.pack("<II", 0, 0)}, b"?")
    packed = bz2.compress(body) if packing == "bz2" else body
    return MAGIC + bag_record({"op": b"\3"}, b"") + bag_record({"op": b"\5", "compression": packing.encode(), "size": struct.pack("<I", len(body))}, packed) + bag_record({"op": b"\4"}, b"index")


S = 1_000_000_000
MESSAGES = [("/cam", 5 * S, image(5 * S + 7, 2, 2, 3, b"ab_cd_")), ("/odom", 6 * S, odometry(6 * S)), ("/lidar", 7 * S, cloud_message(7 * S, [(1, 2, 3), (4, 5, 6)])), ("/cam", 8 * S, image(8 * S, 2, 2, 3, b"ab")), ("/lidar", 9 * S, cloud_message(9 * S, [(1, 2, 3)], short=3))]


def test_bags_are_read_by_topic_and_window(spark, tmp_path):
    import sqlite3

    (tmp_path / "a.bag").write_bytes(bag(MESSAGES))
    (tmp_path / "b.bag").write_bytes(bag(MESSAGES[:2], "bz2"))
    (tmp_path / "c.bag").write_bytes(bag(MESSAGES[:1], "lz9"))
    (tmp_path / "d.bag").write_bytes(b"nothing")
    con = sqlite3.connect(tmp_path / "e.db3")
    con.executescript("CREATE TABLE topics(id INTEGER, name TEXT, type TEXT); CREATE TABLE messages(id INTEGER, topic_id INTEGER, timestamp INTEGER, data BLOB); INSERT INTO topics VALUES (1, '/odom', 'nav/Odometry')")
    con.execute("INSERT INTO messages VALUES (1, 1, ?, ?)", (6 * S, odometry(6 * S, True)))
    con.commit()
    con.close()
    name = F.regexp_extract("file", r"([^/]*)$", 1)
    got = read_bags(spark, str(tmp_path), topics={"/odom": False, "/cam": True}, start=5 * S, stop=8 * S).select(name.alias("f"), "topic", "t", "position", "warning").collect()
    assert sorted((r["f"], r["topic"], r["position"]) for r in got if not r["warning"]) == [("a.bag", "/cam", 0), ("a.bag", "/odom", 1), ("b.bag", "/cam", 0), ("b.bag", "/odom", 1), ("e.db3", "/odom", 0)]
    said = sorted((r["f"], r["warning"].split()[0]) for r in got if r["warning"])
    assert said == [("a.bag", "message"), ("b.bag", "message"), ("c.bag", "a"), ("c.bag", "a"), ("d.bag", "ValueError:"), ("d.bag", "a"), ("e.db3", "a")]
    everything = read_bags(spark, str(tmp_path / "a.bag"))
    images = decode(everything.filter("topic = '/cam'"), "image").orderBy("position").collect()
    assert bytes(images[0]["message"]["pixels"]) == b"abcd" and images[0]["message"]["t"] == 5 * S + 7 and images[1]["message"] is None and "bytes" in images[1]["warning"]
    clouds = decode(everything.filter("topic = '/lidar'"), "cloud").orderBy("position").collect()
    assert clouds[0]["message"]["x"] == [1, 4] and clouds[0]["message"]["n"] == 2 and clouds[1]["warning"]
    first = decode(everything.filter("topic = '/odom'"), "odometry").first()["message"]
    second = decode(read_bags(spark, str(tmp_path / "e.db3")), "odometry", cdr=True).first()["message"]
    assert first == second and first["position"] == [1, 2, 3] and first["child"] == "body"


def test_inertial_data_and_byte_orders():
    data = ros_header(1, 5, "imu") + struct.pack("<4d9d3d9d3d9d", 0, 0, 0, 1, -1, *[0] * 8, 1, 2, 3, *[0] * 9, 4, 5, 6, *[0] * 9)
    found = decode_imu(data)
    assert found["orientation"] is None and found["rate"] == [1, 2, 3] and found["acceleration"] == [4, 5, 6]
    assert decode_image(image(1, 1, 2, 4, b"\1\2__\3\4__", "mono16", 1))["pixels"] == b"\2\1\4\3"
    with pytest.raises(ValueError):
        decode_image(image(1, 1, 1, 1, b"a", "odd"))


def test_adapters_agree_on_what_they_give(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.bag").write_bytes(bag(MESSAGES))
    adapter = BagAdapter(SourceConfig(str(tmp_path / "in"), {"image": "/cam", "cloud": "/lidar", "imu": "/imu"}, ("imu",), 5 * S, 8 * S, "ros"))
    rows = adapter.observations(spark).orderBy("t").collect()
    assert [(r["observation"], r["modality"], r["clock"]) for r in rows] == [("a.bag:0", "image", "ros"), ("a.bag:2", "cloud", "ros")]
    assert adapter.warnings(spark).count() == 2 and adapter.decoded(spark, "cloud").first()["message"]["n"] == 2
    (tmp_path / "p.txt").write_text("1.5 1 2 3 0 0 0 1\n2.5 1 2 3 0 0 0 1\nbad\n")
    poses = PoseFileAdapter(SourceConfig(str(tmp_path / "p.txt"), start=2 * S))
    assert [r["t"] for r in poses.observations(spark).collect()] == [2_500_000_000] and poses.warnings(spark).count() == 1
    poses.observations(spark).write.parquet(str(tmp_path / "t"))
    table = TableAdapter(SourceConfig(str(tmp_path / "t"), {"pose": ""}, ("pose", "image")))
    assert table.observations(spark).count() == 1 and [r["subject"] for r in table.warnings(spark).collect()] == ["image"]
    assert digest_of(poses, spark) == digest_of(table, spark) != digest_of(adapter, spark)


def test_offsets_over_ranges_and_record_tables(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("n")).repartition(5)
    placed = {r["k"]: r["offset"] for r in with_offsets(df, ["k"], F.col("n")).collect()}
    assert placed == {k: sum(i % 7 for i in range(k)) for k in range(1000)}
    table = record_table(spark.createDataFrame([("b", 1, None), ("a", 2, "x")], "id string, v long, note string"), "id")
    lines = {r["key"]: r for r in table.collect()}
    assert lines["a"]["line"] == '{"id":"a","note":"x","v":2}' and lines["b"]["offset"] == lines["a"]["length"] + 1 and '"note":null' in lines["b"]["line"]
    assert index_problems(table).isEmpty() and with_offsets(df.limit(0), ["k"], F.lit(1)).count() == 0
    moved = table.withColumn("offset", F.col("offset") + F.when(F.col("key") == "b", 1).otherwise(0)).unionByName(table.filter("key = 'a'"))
    assert {(r["key"], r["problem"]) for r in index_problems(moved).collect()} >= {("a", "repeated"), ("b", "not contiguous")}


def test_sequences_are_written_once_and_read_in_parts(spark, tmp_path):
    rows = [(f"o{i}", "image" if i % 2 else "cloud", "c", 100 - i, bytes([i])) for i in range(10)]
    df = spark.createDataFrame(rows, "observation string, modality string, clock string, t long, payload binary")
    reader = write_sequence(df, str(tmp_path / "s"))
    assert [r["observation"] for r in reader.index().orderBy("position").collect()] == [f"o{i}" for i in range(9, -1, -1)] and "payload" not in reader.index().columns
    assert reader.at([0, 9]).count() == 2 and bytes(reader.get("o3").first()["payload"]) == b"\3" and reader.window("c", 95, 98).count() == 3 and reader.problems().isEmpty()
    assert spark.read.text(str(tmp_path / "s/lines")).count() == 10
    with pytest.raises(AnalysisException):
        write_sequence(df, str(tmp_path / "s"))
    spark.createDataFrame([("o3", "image", b"x")], "observation string, modality string, payload binary").write.partitionBy("modality").mode("append").parquet(str(tmp_path / "s/payload"))
    assert {r["problem"] for r in reader.problems().collect()} == {"unexpected", "another payload"}


def test_features_masks_and_runs(spark, tmp_path):
    features = spark.createDataFrame([(1, "s", [1.0, 2.0]), (2, "o", [3.0])], "feature long, space string, vector array<float>")
    write_features(features, str(tmp_path / "f"))
    assert load_features(spark, str(tmp_path / "f"), "s", 2).first()["vector"] == [1.0, 2.0]
    with pytest.raises(Exception, match="not the vector"):
        load_features(spark, str(tmp_path / "f"), "o", 2).collect()
    pixels = spark.createDataFrame([("m", 0, 6), ("m", 0, 7), ("m", 1, 0), ("m", 1, 0), ("m", 3, 3), ("n", 0, 0)], "mask string, row int, col int")
    packed = pack_masks(pixels, 8)
    assert {r["mask"]: [tuple(x) for x in r["runs"]] for r in packed.collect()} == {"m": [(6, 3), (27, 1)], "n": [(0, 1)]}
    assert sorted(map(tuple, unpack_masks(packed, 8).collect())) == sorted(set(map(tuple, pixels.collect())))
    tables = {"vectors": spark.createDataFrame([(1, "s", [1.0])], "centre bigint, space string, vector array<double>")}
    write_run(spark, str(tmp_path / "r"), "representation", tables)
    assert read_run(spark, str(tmp_path / "r"), "representation")["vectors"].count() == 1
    for wrong in ({}, {"vectors": tables["vectors"].drop("space")}):
        with pytest.raises(ValueError):
            write_run(spark, str(tmp_path / "q"), "representation", wrong)
    tables["vectors"].write.mode("append").parquet(str(tmp_path / "r/vectors"))
    with pytest.raises(ValueError):
        read_run(spark, str(tmp_path / "r"), "representation")
