import os

from crawlsight.sources.intake import Intake
from crawlsight.streaming import run

GOOD = '{"ip": "1.1.1.1", "timestamp": "2024-01-01T00:00:00Z", "resource": "/a", "response": "200"}'
NO_TIME = '{"ip": "1.1.1.2", "timestamp": "soon"}'
NO_IP = '{"ip": "", "timestamp": "2024-01-01T00:00:00Z"}'
CUT = '{"ip": "1.1.1.3", "timest'


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def state(intake):
    return ({(r.run_id, r.verdict): r.records for r in intake.ledger().collect() if r.records},
            sorted((r.run_id, r.verdict, r.line) for r in intake.refused().collect()),
            sorted((r.ip, r.path, r.status_code) for r in intake.records().collect()))


def test_every_line_is_kept_or_refused_once(spark, folder):
    intake = Intake(spark, folder)
    assert state(intake) == ({}, [], [])
    intake.land(lines(spark, GOOD, NO_TIME, NO_IP, CUT, "", "  ", "no json", "[1]", "null"), 1)
    counts, refused, records = state(intake)
    assert counts == {(1, "accepted"): 1, (1, "no_time"): 1, (1, "no_ip"): 1, (1, "malformed"): 4}
    assert records == [("1.1.1.1", "/a", 200)]
    assert {line for _, _, line in refused} == {NO_TIME, NO_IP, CUT, "no json", "[1]", "null"}
    assert {line for _, v, line in refused if v == "malformed"} >= {CUT, "no json"}


def test_a_run_that_repeats_replaces_its_rows_alone(spark, folder):
    intake = Intake(spark, folder)
    intake.land(lines(spark, GOOD, CUT, CUT), 1)
    intake.land(lines(spark, NO_TIME), 2)
    both = state(intake)
    intake.land(lines(spark, NO_TIME), 2)
    assert state(intake) == both and both[0] == {(1, "accepted"): 1, (1, "malformed"): 2, (2, "no_time"): 1}
    intake.land(lines(spark, GOOD), 1)  # the source was mended
    assert state(intake) == ({(1, "accepted"): 1, (2, "no_time"): 1}, [(2, "no_time", NO_TIME)], [("1.1.1.1", "/a", 200)])
    intake.land(lines(spark), 1)
    assert state(intake)[0] == {(2, "no_time"): 1} and state(intake)[2] == []


def test_dump_frame_is_no_record(spark, folder):
    intake = Intake(spark, folder, dump=True)
    intake.land(lines(spark, "{", f'"1": {GOOD},', f'"2": {CUT}', f'"3": {NO_IP}', " } ", "", '"4": 5,'), 0)
    assert state(intake)[0] == {(0, "accepted"): 1, (0, "malformed"): 2, (0, "no_ip"): 1}


def test_stream_takes_new_files_in_and_archives_them(spark, folder):
    source, archive = folder + "/in", folder + "/archive/deep"
    os.makedirs(source)
    os.makedirs(archive)
    intake = Intake(spark, folder + "/out")

    def arrive(name, *values):
        with open(f"{source}/{name}", "w") as file:
            file.write("\n".join(values) + "\n")
        run.finish(intake.stream(source, folder + "/checkpoint", once=True, files=1, archive=archive))

    arrive("a.json", GOOD, CUT)
    arrive("b.json", GOOD, NO_TIME, NO_IP)
    counts, refused, records = state(intake)
    assert counts == {(0, "accepted"): 1, (0, "malformed"): 1, (1, "accepted"): 1, (1, "no_time"): 1, (1, "no_ip"): 1}
    assert len(records) == 2 and [line for _, _, line in refused] == [CUT, NO_IP, NO_TIME]
