"""Readers on small files."""

import datetime as dt
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tidewater.plans import reports
from tidewater.sources import files as IO


def test_events(spark, tmp_path):
    row = [""] * 61
    row[0], row[1], row[26], row[30], row[60] = "1", "20250722", " 141 ", "7.2", "https://e/x"
    bad = list(row)
    bad[1] = "x"
    (tmp_path / "e.tsv").write_text("\n".join(["\t".join(row), "", "\t".join(row[:60]), "\t".join(row + ["z"]), "\t".join(bad)]) + "\n")
    got = IO.read_events(spark, str(tmp_path / "e.tsv")).collect()
    assert len(got) == 2 and got[0].cameo_code == "141" and got[0].goldstein_scale == 7.2 and got[0].lat is None


def test_mentions(spark, tmp_path):
    row = ["1"] + [""] * 15
    row[11] = "x"
    (tmp_path / "m.tsv").write_text("\t".join(row) + "\n" + "\t".join([""] + row[1:]) + "\n" + "1\t2\n")
    got = IO.read_mentions(spark, str(tmp_path / "m.tsv")).collect()
    assert len(got) == 1 and got[0].mention_confidence == 0


def test_curve(spark, tmp_path):
    (tmp_path / "c.csv").write_text('Date,"2 Yr","10 Yr"\n01/02/2024,4.5,N/A\nbad,1,1\n01/03/2024,,\n')
    got = IO.read_curve(spark, str(tmp_path / "c.csv")).collect()
    assert [r.term_rates for r in got] == [{"2yr": 4.5}]


def test_envelopes_and_whitelist(spark, tmp_path):
    (tmp_path / "l").mkdir()
    (tmp_path / "l/a.jsonl").write_text('{"v":1,"captured_at":"2024-01-01T00:00:00Z","cycle_id":"c","episode":{"episode_body":"b","content_hash":"h"}}\n{oops\n\n')
    good, bad = IO.read_envelopes(spark, str(tmp_path / "l"))
    assert [r.content_hash for r in good.collect()] == ["h"] and len(bad.collect()) == 1
    for name, text in (("o.json", '{"tickers":[{"ticker":"1","name":"a"}]}'), ("a.json", '[{"ticker":"1","name":"a"}]')):
        (tmp_path / name).write_text(text)
        assert IO.read_whitelist(spark, str(tmp_path / name)).count() == 1


def test_zip_and_manifest(spark, tmp_path):
    row = ["1"] + [""] * 15
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("note.txt", "no")
        z.writestr("m.CSV", "\t".join(row) + "\r\n" + "\t".join(["2"] + row[1:]) + "\n")
    (tmp_path / "b.zip").write_bytes(b"not a zip")
    got = IO.read_mentions(spark, str(tmp_path / "*.zip")).collect()
    assert sorted(r.event_id for r in got) == ["1", "2"]
    (tmp_path / "good.txt").write_text("".join(f"10 h{i} http://e/{i}\n" for i in range(3)))
    (tmp_path / "bad.txt").write_text("10 h http://e/1\n10 h\n")
    assert IO.read_manifest(spark, str(tmp_path / "good.txt")) == [f"http://e/{i}" for i in range(3)]
    with pytest.raises(ValueError):
        IO.read_manifest(spark, str(tmp_path / "bad.txt"))


def test_research_within_the_second(spark, tmp_path):
    """A report counts by its fraction of a second, at both bounds."""
    times = {"a": "2024-01-21 00:00:00.000", "b": "2024-01-21 00:00:00.001", "c": "2024-01-20 23:59:59.999999", "d": "2024-01-11 00:00:00", "e": "2024-01-10 23:59:59.999", "f": "2024-01-21 00:00:00.0000019", "g": "2024-01-12 00:00:00.5+08:00", "h": "2024-01-12", "i": "x"}
    (tmp_path / "r.json").write_text(json.dumps({"asked": "1", "data": [{"infoCode": k, "publishDate": v} for k, v in times.items()]}))
    got = IO.read_research(spark, str(tmp_path), F.lit("2024-01-21 00:00:00").cast("timestamp"), 10)
    assert sorted(r.info_code for r in got.collect()) == ["a", "c", "d", "g"]
    rows = [(i, dt.datetime(2024, 1, 21, 0, 0, 0, us), "view") for i, us in enumerate((0, 1, 400, 999_999))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    assert [r.info_code for r in reports.q143_read_research(spark, str(tmp_path)).collect()] == ["0"]
