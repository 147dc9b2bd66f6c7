import json

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from agora.sources import dumps, files, store
from agora.streaming import opinions as so
from agora.tables import profiles


def comment(i, **more):
    return {"id": f"c{i}", "author": "a", "body": "x", "subreddit": "s", "created_utc": 1_704_067_200 + i * 86_400 * 20, "score": "3", **more}


def test_zstd_lines_become_monthly_parquet(spark, tmp_path):
    lines = "\n".join([json.dumps(comment(0)), json.dumps(comment(1, body="[deleted]")), "{broken", json.dumps(comment(2, subreddit="t")), json.dumps(comment(3))])
    path = tmp_path / "RC_2024-01.zst"
    path.write_bytes(zstandard.ZstdCompressor().compress(lines.encode()))
    rows = dumps.read_zstd(spark, [str(path)])
    assert rows.count() == 4 and rows.first().score == 3
    dumps.write_monthly(dumps.in_scope(rows, ["s"]), str(tmp_path / "out"))
    found = files.scan_months(spark, str(tmp_path / "out"), "2024-01", "2024-02")
    assert {r.id for r in found.collect()} == {"c0"}
    assert {r.id for r in files.scan_months(spark, str(tmp_path / "out"), "2024-03", "2024-12", ["s"]).collect()} == {"c3"}


def lines_of(spark, path, split):
    spark.dataSource.register(dumps.ZstdLines)
    rows = spark.read.format("zstd_lines").option("path", str(path)).option("split", split).load()
    return rows.rdd.getNumPartitions(), sorted(r.line for r in rows.collect())


@pytest.mark.parametrize("cut", [0, 9])
def test_frames_are_read_by_several_tasks(spark, tmp_path, cut):
    """Lines over several frames, frames of half a line, frames without any, raw blocks that look like a beginning."""
    rnd = np.random.default_rng(2)
    lines = [f"{i} " + "x" * int(rnd.choice([0, 5, 40, 900, 30_000])) for i in range(400)]
    text = "\n".join(lines).encode()
    cuts = sorted({0, len(text), *rnd.integers(0, len(text), 150).tolist(), 5000, 5001, 5002})
    skipped = (0x184D2A53).to_bytes(4, "little") + (6).to_bytes(4, "little") + dumps.FRAME.to_bytes(4, "little") + b"\0\0"
    parts = [zstandard.ZstdCompressor(level=int(rnd.integers(1, 4)), write_checksum=bool(i % 2), write_content_size=bool(i % 3)).compress(text[a:b]) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    parts.insert(7, skipped)
    noise = rnd.integers(0, 256, 3000).astype(np.uint8).tobytes().replace(b"\n", b"_") + dumps.FRAME.to_bytes(4, "little") * 50
    parts.append(zstandard.ZstdCompressor().compress(b"\n" + noise))
    raw = b"".join(parts)
    path = tmp_path / "many.zst"
    path.write_bytes(raw[: len(raw) - cut])
    want = sorted([*lines, *([noise.decode("utf-8", "replace").rstrip("\r")] if not cut else [])])
    for split in (200, 1000, 7001, 10**9):
        tasks, got = lines_of(spark, path, split)
        assert tasks == -(-(len(raw) - cut) // split) or tasks == 1
        assert [x for x in got if x in set(lines)] == sorted(lines)
        assert cut or got == want


def test_sinks_show_whole_jobs_alone(spark, tmp_path):
    rows = spark.range(1000).repartition(4).selectExpr("cast(id as string) line")
    folder = tmp_path / "out"
    dumps.write_zstd(rows, f"file://{folder}", frame=500)
    assert len(list(folder.glob("*.zst"))) == 4 and not list(folder.glob("_*"))
    before = sorted(p.name for p in folder.rglob("*"))
    # A task that fails after others have written leaves nothing.
    broken = rows.withColumn("line", F.when(F.col("line") == "999", F.raise_error(F.lit("on purpose"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="on purpose"):
        dumps.write_zstd(broken, f"file://{folder}")
    assert sorted(p.name for p in folder.rglob("*")) == before
    (folder / "left-over.zst").write_bytes(b"no frame")  # of a job that never came to its end
    tasks, got = lines_of(spark, f"file://{folder}", 300)
    assert tasks > 4 and got == sorted(map(str, range(1000)))
    spark.range(5).selectExpr("cast(id as string) line").coalesce(1).write.format("zstd_lines").mode("overwrite").save(str(folder))
    assert lines_of(spark, folder, 10**9) == (1, ["0", "1", "2", "3", "4"])
    notes = spark.read.parquet(f"{folder}/manifest")
    assert [r["rows"] for r in notes.collect()] == [5] and not (folder / "left-over.zst").exists()


def test_arrays_keep_their_keys(spark, tmp_path):
    rows = spark.range(1000).repartition(3).select(F.concat(F.lit("k"), "id").alias("key"), F.array(F.col("id").cast("float"), F.lit(0.5).cast("float")).alias("v"))
    path = f"file://{tmp_path}/npy"
    files.write_npy(rows, "key", "v", path, size=100)
    got = files.read_npy(spark, path, split=300).join(files.npy_keys(spark, path, "key"), ["file", "row"])
    assert {(r.key, *r.embedding) for r in got.collect()} == {(f"k{i}", float(i), 0.5) for i in range(1000)}
    broken = rows.withColumn("v", F.when(F.col("key") == "k7", F.raise_error(F.lit("on purpose"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="on purpose"):
        files.write_npy(broken, "key", "v", path, size=100)
    assert files.read_npy(spark, path).count() == 1000 and not list((tmp_path / "npy").glob("_*"))


def test_each_file_is_read_once(spark, tmp_path):
    folder, out, place = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps(comment(i)) + "\n")
        dumps.stream_json(spark, folder, dumps.COMMENT, out, place)
    assert spark.read.parquet(out).count() == 2
    done = spark.createDataFrame([("2024-01",)], "year_month string")
    both = spark.createDataFrame([("2024-01",), ("2024-02",)], "year_month string")
    assert [r.year_month for r in dumps.unprocessed(both, done).collect()] == ["2024-02"]


def test_tables_come_back(spark, tmp_path):
    rows = spark.createDataFrame([("1e5", 'a "b"\nc', None), ("007", "", 1.5)], "id string, text string, x double")
    files.write_csv(rows, str(tmp_path / "csv"))
    assert {r.id for r in files.read_csv(spark, str(tmp_path / "csv"), "id string, text string, x double").collect()} == {"1e5", "007"}
    files.write_parquet(rows, str(tmp_path / "p"), "gzip")
    files.write_parquet(rows.withColumn("y", F.lit(1)), str(tmp_path / "q"))
    assert files.scan(spark, [str(tmp_path / "p"), str(tmp_path / "q")]).count() == 4
    with pytest.raises(Exception):
        files.scan(spark, [str(tmp_path / "p"), str(tmp_path / "q")], loose=False).count()
    np.save(tmp_path / "v.npy", np.arange(6.0).reshape(3, 2))
    assert [r.embedding for r in files.read_npy(spark, [str(tmp_path / "v.npy")], split=100).orderBy("row").collect()] == [[0, 1], [2, 3], [4, 5]]
    edges = spark.createDataFrame([("a", "b", "t")], "src string, dst string, type string")
    files.node_link(edges, spark.createDataFrame([("a",), ("b",)], "node string"), str(tmp_path / "g"))
    links, nodes = files.read_node_link(spark, str(tmp_path / "g"), "source string, target string, type string")
    assert links.first().asDict() == {"src": "a", "dst": "b", "type": "t"} and nodes.count() == 2


def test_cached_tables_are_made_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert store.cached(spark, "t", make, f"file://{tmp_path}", a=1).count() == 3
    assert len(made) == 1 and store.key(a=1, b=2) == store.key(b=2, a=1) != store.key(a=2, b=1)


def test_streams_agree_with_batches(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 3, (i % 5) % 3 - 1, i % 3) for i in range(60)], "t long, user_id long, value int, classifier_idx int")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    so.run_to(so.sums(stream, profiles(spark), ["user_id"]), str(tmp_path / "out"), str(tmp_path / "c1"))
    batch = so.sums(rows, profiles(spark), ["user_id"])
    near = lambda d: sorted((r.user_id, r.n, round(r["mean"], 9), round(r["var"], 9)) for r in so.opinion_of_sums(d).collect())
    assert near(spark.read.parquet(str(tmp_path / "out"))) == near(batch)
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    so.run_to(so.last_seen(stream), str(tmp_path / "live"), str(tmp_path / "c2"), "update")
    assert {(r.user_id, r.live) for r in spark.read.parquet(str(tmp_path / "live")).collect()} == {(0, 4), (1, 4), (2, 4)}


def files_of(spark, folder, rows, schema):
    """A stream of one file for each list of rows, in their order."""
    folder.mkdir()
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).withColumn("time", F.timestamp_seconds("t")).coalesce(1).write.mode("append").parquet(str(folder / f"{i:03}"))
    return spark.readStream.schema(f"{schema}, time timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def ran(stream, path, mode):
    """All batches to Parquet; the rows, and the number of rows in the state after each."""
    query = stream.writeStream.outputMode(mode).foreachBatch(lambda d, _: d.write.mode("append").parquet(f"{path}/out")).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in query.recentProgress]


def test_content_expires_from_the_state(spark, tmp_path):
    """Users who write no more are told when their content expires, and leave the state."""
    batches = [[(1, 100), (1, 100), (2, 105), (3, 109)], [(1, 112), (2, 90)], [(4, 200)], [(4, 201), (1, 195)], [(4, 400)]]
    stream = files_of(spark, tmp_path / "in", batches, "user_id long, t long")
    held = ran(so.live_content(stream, "user_id", "time", 30, "10 seconds"), tmp_path, "update")
    rows = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    last = {u: max((at, -live) for v, at, live in rows if v == u) for u, *_ in rows}
    assert {u: -live for u, (_, live) in last.items()} == {1: 0, 2: 0, 3: 0, 4: 1}
    assert (1, 100, 2) in rows and (1, 112, 3) in rows and (4, 201, 2) in rows and (2, 105, 2) in rows
    assert max(held) >= 3 and held[-1] == 1


def test_sessions_and_interval_joins_are_those_of_a_batch(spark, tmp_path):
    rnd = np.random.default_rng(4)
    times = np.sort(rnd.integers(0, 3000, 240))
    rows = [(int(rnd.integers(0, 4)), int(t), i) for i, t in enumerate(times)]
    parts = [rows[i : i + 40] for i in range(0, 240, 40)]
    parts = [sorted(p, key=lambda r: (r[2] * 7919) % 40) for p in parts] + [[(99, 100_000, 9999)]]
    stream = files_of(spark, tmp_path / "in", parts, "user_id long, t long, item long")
    held = ran(so.sessions(stream, "user_id", "time", "60 seconds", "5 minutes", F.sum("item").alias("items")), tmp_path / "s", "append")
    got = {(r.user_id, int(r.start.timestamp()), int(r.end.timestamp())): (r.n, r["items"]) for r in spark.read.parquet(f"{tmp_path}/s/out").collect()}
    want, open_ = {}, {}
    for u, t, i in rows:
        if u in open_ and t < open_[u][1]:
            a, b, n, s = open_[u]
            open_[u] = (a, t + 60, n + 1, s + i)
        else:
            if u in open_:
                a, b, n, s = open_[u]
                want[u, a, b] = (n, s)
            open_[u] = (t, t + 60, 1, i)
    want |= {(u, a, b): (n, s) for u, (a, b, n, s) in open_.items()}
    assert got == want and held[-1] <= 1
    content = stream.select("user_id", "item", "time")
    asks = stream.select("user_id", F.col("item").alias("ask"), F.col("time").alias("at")).where("ask % 3 = 0")
    held = ran(so.trailing(content, asks, ["user_id"], "time", "at", "100 seconds", "5 minutes"), tmp_path / "j", "append")
    got = {(r.ask, r["item"]) for r in spark.read.parquet(f"{tmp_path}/j/out").collect()}
    assert got == {(a, i) for u, at, a in rows if a % 3 == 0 for v, t, i in rows if u == v and at - 100 <= t <= at} | {(9999, 9999)}
    assert held[-1] < max(held) / 4
