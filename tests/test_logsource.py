"""The commit-log source: byte ranges, pushed filters, files that are not opened, streams that resume."""

import pytest
from pyspark.sql import functions as F

from weftline.sources import commits, logsource

RECORD = "---COMMIT---\n{}\nann\n{}\nfeat: x\n\n---FILES---\nM\t{}\n"


def record(sha, time, path="a"):
    return RECORD.format(sha, time, path)


@pytest.mark.parametrize("block", [7, 64, 1 << 20])
def test_ranges_lose_and_repeat_nothing(tmp_path, monkeypatch, block):
    monkeypatch.setattr(logsource, "BLOCK", block)
    path = tmp_path / "log"
    path.write_bytes(("noise\n" + "".join(record(f"s{i}", i, "é" * (i % 40)) for i in range(60)) + "---COMMIT---\n  \n").encode())
    size = path.stat().st_size
    for split in (1, 13, 100, 1000, size):
        found = [logsource.head(r) for part in logsource.ranges("", 0, size, split) for r in logsource.records(str(path), part, b"---COMMIT---")]
        assert [f for f in found if f] == [(f"s{i}", i) for i in range(60)]


def test_scan_equals_the_text_reader(spark, tmp_path):
    folder = tmp_path / "logs"
    (folder / "deep").mkdir(parents=True)
    (folder / "1.log").write_text("".join(record(f"s{i}", i) for i in range(40)))
    (folder / "deep" / "2.log").write_text("".join(record(f"t{i}", 100 + i, "b") for i in range(40)) + record("odd", "no time"))
    (folder / "_SUCCESS").write_text(record("never", 1))
    (folder / "empty.log").write_text("")
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    want = commits.parse_records(commits.read_log(spark, str(folder)).unionByName(commits.read_log(spark, str(folder / "deep"))))
    assert rows(logsource.commits_between(spark, str(folder), splitBytes=300)) == rows(want)
    assert rows(logsource.commits_between(spark, str(folder), after=20, until=110)) == rows(want.filter("timestamp > 20 and timestamp <= 110"))
    assert rows(logsource.commits_between(spark, str(folder), shas=["s3", "t4", "none"])) == rows(want.filter("sha in ('s3', 't4')"))
    assert rows(logsource.commits_after(spark, str(folder), "t37")) == rows(want.filter("timestamp > 137"))
    assert rows(logsource.commits_after(spark, str(folder), "none")) == []
    assert {r.sha for r in logsource.scan(spark, str(folder)).filter("timestamp = 5 or sha = 't1'").collect()} == {"s5", "t1"}
    assert logsource.scan(spark, str(folder)).filter("timestamp is null").count() == 1


def test_filters_are_in_the_plan_and_files_stay_closed(spark, tmp_path, capsys):
    path = str(tmp_path / "log")
    rows = spark.range(100).select((F.col("id") * 10).alias("timestamp"), F.concat(F.lit("s"), F.col("id"), F.lit("\nann\n"), F.col("id") * 10, F.lit("\nfix: y\n\n---FILES---\nA\tf")).alias("value"))
    logsource.write_log(rows, path, 250)
    late = logsource.scan(spark, path).filter("timestamp > 700 and timestamp <= 740 and length(value) > 3")
    late.explain("formatted")
    assert "timestamp" in capsys.readouterr().out.split("PushedFilters")[1].split("]")[0]
    reader = logsource.LogReader({"path": path})
    left = list(reader.pushFilters([logsource.GreaterThan(("timestamp",), 700), logsource.LessThanOrEqual(("timestamp",), 740), logsource.EqualTo(("value",), "x")]))
    assert left == [logsource.EqualTo(("value",), "x")]
    assert {p.name.split("/")[0] for p in reader.partitions()} == {"window=500-749"}
    for name, _ in logsource.files_of(path):
        if not name.startswith("window=500-749/"):
            (tmp_path / "log" / name).chmod(0)
            (tmp_path / "log" / name).write_bytes(record("wrong", 720).encode())  # would show up if it were opened
    assert {r.sha for r in late.collect()} == {"s71", "s72", "s73", "s74"}


def test_stream_reads_what_files_gain(spark, tmp_path):
    folder, seen = tmp_path / "logs", []
    folder.mkdir()

    def run():
        each = lambda batch, _: seen.extend(r.sha for r in commits.parse_records(batch).collect())
        logsource.stream(spark, str(folder)).writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "done")).trigger(availableNow=True).start().awaitTermination()

    (folder / "1.log").write_text(record("s1", 5) + record("s2", 6))
    run()
    with (folder / "1.log").open("a") as file:
        file.write(record("s3", 7))
    (folder / "2.log").write_text(record("s4", 8))
    run()
    run()
    assert sorted(seen) == ["s1", "s2", "s3", "s4"]
