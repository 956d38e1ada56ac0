from __future__ import annotations

import glob
import json

import pytest
from helpers import START, position, positions, report
from pyspark.sql import functions as F

from fairlead.operators.cleaning import clean_reports
from fairlead.params import CollisionRules, ReportRules, Rules
from fairlead.plans.pipeline import ingest, run
from fairlead.schema import RAW_COLUMNS
from fairlead.sources.reports import files_by_header, list_report_files, read_mixed_reports, read_reports
from fairlead.sources.sample import sample_reports
from fairlead.sources.daytable import DayConflict, DayTable
from fairlead.sources.tables import Staging, merge_positions, read_positions, shared_folder, write_positions
from fairlead.streaming.ingest import ingest_new_files

GLOBE = ReportRules(area=None)


def write_csv(path, rows, columns=RAW_COLUMNS, extra=()):
    lines = [",".join([*columns, *extra])]
    for row in rows:
        values = dict(zip(RAW_COLUMNS, row))
        lines.append(",".join([*(values[name] for name in columns), *("x" for _ in extra)]))
    path.write_text("\n".join(lines) + "\n")


def test_files_with_different_headers(spark, tmp_path):
    write_csv(tmp_path / "b.csv", [report(Latitude="55.3")])
    write_csv(tmp_path / "a.CSV", [report(Latitude="55.4")], columns=tuple(reversed(RAW_COLUMNS)), extra=("Cargo type",))
    (tmp_path / "notes.txt").write_text("not a report")
    assert [file.rsplit("/", 1)[1] for file in list_report_files(spark, str(tmp_path))] == ["a.CSV", "b.csv"]
    rows = clean_reports(read_mixed_reports(spark, str(tmp_path)), GLOBE).collect()
    assert sorted((row.latitude, row.longitude, row.mmsi) for row in rows) == [
        (55.3, 14.2, "219000001"),
        (55.4, 14.2, "219000001"),
    ]


def test_one_read_refuses_another_column_order(spark, tmp_path):
    write_csv(tmp_path / "a.csv", [report()])
    write_csv(tmp_path / "b.csv", [report()], columns=tuple(reversed(RAW_COLUMNS)))
    with pytest.raises(Exception, match="CSV header does not conform|CSV_HEADER|FAILED_READ_FILE|header"):
        read_reports(spark, str(tmp_path)).collect()


def test_headers_of_many_files_take_a_constant_number_of_jobs(spark, tmp_path):
    """Three layouts, blank lines before a header, empty files, names with blanks and per cent signs."""
    jobs = {}
    for many in (12, 120):
        folder = tmp_path / str(many)
        folder.mkdir()
        for n in range(many):
            columns = (RAW_COLUMNS, tuple(reversed(RAW_COLUMNS)), RAW_COLUMNS[5:] + RAW_COLUMNS[:5])[n % 3]
            file = folder / f"a {n}%20 [x].csv"
            write_csv(file, [report(Latitude=f"55.{n:03d}")] * 2, columns=columns)
            file.write_text("\n \n" * (n % 2) + file.read_text())
        (folder / "empty.csv").write_text("")
        files = list_report_files(spark, str(folder))
        spark.sparkContext.setJobGroup(f"headers {many}", "")
        groups = files_by_header(spark, files)
        jobs[many] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"headers {many}"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert sorted(map(len, groups.values())) == [many // 3] * 3
        rows = clean_reports(read_mixed_reports(spark, str(folder)), GLOBE).collect()
        assert sorted(row.latitude for row in rows) == sorted(float(f"55.{n:03d}") for n in range(many) for _ in range(2))
    assert jobs[120] <= jobs[12] + 1 < 10, jobs


def test_missing_column_fails(spark, tmp_path):
    write_csv(tmp_path / "a.csv", [report()], columns=RAW_COLUMNS[:-1])
    with pytest.raises(Exception, match="Draught"):
        read_mixed_reports(spark, str(tmp_path))


def test_empty_folder_fails(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_mixed_reports(spark, str(tmp_path))


def test_position_table_by_day(spark, tmp_path):
    path = str(tmp_path / "positions")
    write_positions(positions(spark, [position(seconds=0), position(seconds=86_400)]), path)
    write_positions(positions(spark, [position(seconds=2 * 86_400)]), path)
    assert sorted(p.rsplit("=")[-1] for p in glob.glob(f"{path}/event_date=*")) == ["2021-12-13", "2021-12-14", "2021-12-15"]
    assert read_positions(spark, path).count() == 3
    some = read_positions(spark, path, "2021-12-14", "2021-12-14")
    assert some.count() == 1
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan


def test_stream_takes_each_file_once(spark, tmp_path):
    folder, table, seen = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "seen")
    folder.mkdir()
    write_csv(folder / "day1.csv", [report(), report(MMSI="bad")], extra=("More",))
    ingest_new_files(spark, str(folder), table, seen, GLOBE)
    assert read_positions(spark, table).count() == 1
    ingest_new_files(spark, str(folder), table, seen, GLOBE)
    assert read_positions(spark, table).count() == 1
    write_csv(folder / "day2.csv", [report(**{"# Timestamp": "2021-12-14T01:00:00"})], extra=("More",))
    ingest_new_files(spark, str(folder), table, seen, GLOBE)
    assert read_positions(spark, table).count() == 2
    assert len(glob.glob(f"{table}/event_date=*")) == 2


@pytest.mark.parametrize("stream_first", [True, False])
def test_batch_and_stream_share_a_table(spark, tmp_path, stream_first):
    """Five rows by the batch job, seven by the stream, in files of another column order."""
    one, two, table = tmp_path / "one", tmp_path / "two", str(tmp_path / "table")
    one.mkdir(), two.mkdir()
    write_csv(one / "a.csv", [report(Latitude=f"55.{i}") for i in range(5)])
    write_csv(two / "b.csv", [report(Latitude=f"56.{i}") for i in range(4)], columns=tuple(reversed(RAW_COLUMNS)))
    write_csv(two / "c [1].csv", [report(Latitude=f"57.{i}") for i in range(3)], extra=("More",))
    steps = [
        lambda: ingest(spark, str(one), table, Rules(reports=GLOBE), mode="append"),
        lambda: ingest_new_files(spark, str(two), table, str(tmp_path / "seen"), GLOBE),
    ]
    for step in reversed(steps) if stream_first else steps:
        step()
    assert read_positions(spark, table).count() == 12


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "positions")
    for rows, batch in (([position()], "a"), ([position(), position(seconds=5)], "b"), ([position()], "a")):
        write_positions(positions(spark, rows), path, batch=batch)
    assert read_positions(spark, path).count() == 3


def test_a_new_checkpoint_at_an_old_path_is_another_stream(spark, tmp_path):
    """Five rows, then the checkpoint is removed and seven rows of other files come: all twelve are there."""
    one, two, table, seen = tmp_path / "one", tmp_path / "two", str(tmp_path / "table"), tmp_path / "seen"
    one.mkdir(), two.mkdir()
    write_csv(one / "a.csv", [report(Latitude=f"55.{i}") for i in range(5)])
    write_csv(two / "b.csv", [report(Latitude=f"56.{i}") for i in range(7)])
    ingest_new_files(spark, str(one), table, str(seen), GLOBE)
    seen.rename(tmp_path / "seen-before")
    ingest_new_files(spark, str(two), table, str(seen), GLOBE)
    assert read_positions(spark, table).count() == 12
    # The first checkpoint still knows its query: what it has seen it does not take again.
    ingest_new_files(spark, str(one), table, str(tmp_path / "seen-before"), GLOBE)
    assert read_positions(spark, table).count() == 12


def three_batches(spark, path):
    for batch, seconds in (("a", (0, 1)), ("b", (2, 86_400)), ("c", (3,))):
        write_positions(positions(spark, [position(seconds=s) for s in seconds]), path, batch=batch)


def seconds_of(table):
    return sorted((row.timestamp - START).total_seconds() for row in table.collect())


def test_merged_days_lie_in_one_folder(spark, tmp_path):
    path = str(tmp_path / "positions")
    three_batches(spark, path)
    before = DayTable(spark, path).batches()
    assert merge_positions(spark, path) == ["2021-12-13"]
    table = DayTable(spark, path)
    assert {day: len(folders) for day, folders in table.visible().items()} == {"2021-12-13": 1, "2021-12-14": 1}
    assert table.batches() == before == {"2021-12-13": {"a", "b", "c"}, "2021-12-14": {"b"}}
    read = read_positions(spark, path)
    assert seconds_of(read) == [0, 1, 2, 3, 86_400] and len({f.rsplit("/", 1)[0] for f in read.inputFiles()}) == 2
    assert merge_positions(spark, path) == []
    assert len(glob.glob(f"{path}/event_date=2021-12-13/*")) == 4
    assert table.clean() == 3 and len(glob.glob(f"{path}/event_date=2021-12-13/*")) == 1
    assert seconds_of(read_positions(spark, path)) == [0, 1, 2, 3, 86_400]


def test_writers_go_on_while_a_day_is_merged(spark, tmp_path, monkeypatch):
    """A batch job and a stream add to the day between the reading and the commit of a merge; a reader sees each row once throughout."""
    path, folder, seen = str(tmp_path / "positions"), tmp_path / "in", []
    folder.mkdir()
    three_batches(spark, path)
    commit = DayTable._commit

    def busy(self, before, change):
        seen.append(seconds_of(read_positions(spark, path)))
        write_positions(positions(spark, [position(seconds=10)]), path, batch="late")
        write_csv(folder / "a.csv", [report(**{"# Timestamp": "2021-12-13T02:00:20"})])
        ingest_new_files(spark, str(folder), path, str(tmp_path / "checkpoint"), GLOBE)
        commit(self, before, change)

    monkeypatch.setattr(DayTable, "_commit", busy)
    merge_positions(spark, path)
    monkeypatch.undo()
    assert seen == [[0, 1, 2, 3, 86_400]]
    assert seconds_of(read_positions(spark, path)) == [0, 1, 2, 3, 10, 20, 86_400]
    assert merge_positions(spark, path) == ["2021-12-13"]
    assert seconds_of(read_positions(spark, path)) == [0, 1, 2, 3, 10, 20, 86_400]


def test_of_two_merges_of_a_day_one_gives_way(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "positions")
    three_batches(spark, path)
    commit = DayTable._commit

    def overtaken(self, before, change):
        monkeypatch.undo()
        merge_positions(spark, path)
        commit(self, before, change)

    monkeypatch.setattr(DayTable, "_commit", overtaken)
    with pytest.raises(DayConflict):
        merge_positions(spark, path)
    assert seconds_of(read_positions(spark, path)) == [0, 1, 2, 3, 86_400]


def test_batches_of_merged_days_are_final(spark, tmp_path):
    path = str(tmp_path / "positions")
    three_batches(spark, path)
    merge_positions(spark, path)
    again = positions(spark, [position(seconds=s) for s in (2, 86_400)])
    with pytest.raises(ValueError, match="b is final.*2021-12-13"):
        write_positions(again, path, batch="b")
    write_positions(again, path, batch="b", again="skip")
    assert seconds_of(read_positions(spark, path)) == [0, 1, 2, 3, 86_400]
    with pytest.raises(ValueError, match="not a batch name"):
        write_positions(again, path, batch="day-1")


def test_replaced_days_change_together_and_may_become_empty(spark, tmp_path):
    path = str(tmp_path / "positions")
    three_batches(spark, path)
    table = DayTable(spark, path)
    kept = table.read().filter("minute(timestamp) = 59").drop("ingest")
    table.replace(kept, ["2021-12-13"])
    assert seconds_of(read_positions(spark, path)) == [86_400]
    table.replace(table.read().drop("ingest").limit(0), ["2021-12-14"])
    assert read_positions(spark, path).count() == 0


def test_staged_tables_can_be_removed(spark):
    staging = Staging(spark)
    staging.keep(spark.range(3), "numbers")
    staging.remove()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(f"{staging.folder}/numbers")


def test_storing_leaves_the_session_as_it_was(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    kept = Staging(spark).keep(spark.range(100).groupBy(F.col("id") % 3).count(), "groups")
    assert kept.count() == 3 and spark.conf.get(name, None) == before


def test_staging_uses_the_configured_folder(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    staging = Staging(spark)
    assert staging.folder.startswith(spark.conf.get("spark.checkpoint.dir"))
    kept = staging.keep(spark.range(3).filter("id < 0"), "empty")
    assert kept.count() == 0 and kept.columns == ["id"]


@pytest.mark.parametrize("metres, points, found", [(5.0, 20, 2), (15.0, 10, 3)])
def test_pipeline_from_files(spark, tmp_path, metres, points, found):
    folder, output = f"{tmp_path}/reports", f"{tmp_path}/out"
    reports = sample_reports(spark, "/root/testdata/sf0.001").select(*(f"`{name}`" for name in RAW_COLUMNS))
    reports.repartition(3).write.option("header", True).csv(folder)
    rules = Rules(collisions=CollisionRules(collision_metres=metres, collision_min_points=points))
    result = run(spark, folder, output, rules)
    assert (result.tracks.count(), result.candidates.count(), result.validated.count()) == (931, 4, found)
    text = "".join(open(part).read() for part in sorted(glob.glob(f"{output}/collision_result/part-*")))
    document = json.loads(text)
    assert document["collision_count"] == found == len(document["collisions"])
    times = [item["collision_time"] for item in document["collisions"]]
    assert times == sorted(times)
    lines = [line for part in glob.glob(f"{output}/collision_trajectories/part-*") for line in open(part).read().splitlines()]
    assert len(lines) == 2 * found and all(json.loads(line)["type"] == "Feature" for line in lines)
