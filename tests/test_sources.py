import pytest

from gridtide.schemas import METRICS
from gridtide.sources import meter, reports

FILE = """Date;Time;Global_active_power;Global_reactive_power;Voltage;Global_intensity;Sub_metering_1;Sub_metering_2;Sub_metering_3
16/12/2006;17:24:00;4.216;0.418;234.840;18.400;0.000;1.000;17.000
1/2/2007;0:05:30;?;?;;x;nan;1;2
"""


def test_raw_text(spark, tmp_path):
    path = tmp_path / "raw.txt"
    path.write_text(FILE)
    a, b = meter.read_raw(spark, str(path)).orderBy("ts").collect()
    assert str(a["ts"]) == "2006-12-16 17:24:00" and a["Voltage"] == 234.84 and a["Sub_metering_3"] == 17
    assert str(b["ts"]) == "2007-02-01 00:05:30"
    assert [b[c] for c in ("Global_active_power", "Voltage", "Global_intensity", "Sub_metering_1")] == [None] * 4


def test_missing_tables(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        meter.load_processed(spark, str(tmp_path / "gone"), ["x"])
    with pytest.raises(FileNotFoundError):
        meter.first_available(spark, [str(tmp_path / "gone")], ["x"])
    empty = reports.load_metrics(spark, str(tmp_path / "gone"))
    assert empty.count() == 0 and empty.schema == METRICS


def test_raw_columns_by_name(spark, tmp_path):
    lines = FILE.splitlines()
    swapped = [";".join([p[1], p[0], p[4], *p[2:4], *p[5:]]) for p in (x.split(";") for x in lines)]
    path = tmp_path / "swapped.txt"
    path.write_text("\n".join(swapped) + "\n")
    row = meter.read_raw(spark, str(path)).orderBy("ts").first()
    assert str(row["ts"]) == "2006-12-16 17:24:00" and row["Global_active_power"] == 4.216 and row["Voltage"] == 234.84
    path.write_text("Date;Time;Voltage\n1/2/2007;0:00:00;230\n")
    with pytest.raises(ValueError, match="Global_active_power"):
        meter.read_raw(spark, str(path))


def test_processed_keeps_series_and_misses_no_measure(spark, tmp_path):
    rows = spark.sql("SELECT cast(s AS string) series_id, TIMESTAMP_NTZ'2024-01-01 00:00:00' AS ts, s AS slot, 1.0D AS x, 2.0D AS y "
                     "FROM (SELECT explode(sequence(1L, 5L)) s)")
    path = str(tmp_path / "table")
    meter.write_table(rows, path)
    back = meter.load_processed(spark, path, ["x"])
    assert set(back.columns) == {"series_id", "ts", "slot", "x", "date"} and back.select("series_id").distinct().count() == 5
    with pytest.raises(ValueError, match="z"):
        meter.load_processed(spark, path, ["x", "z"])


def test_only_absence_counts_as_absence(spark, tmp_path):
    (tmp_path / "broken").mkdir()
    with pytest.raises(Exception) as found:
        meter.load_processed(spark, str(tmp_path / "broken"), ["x"])
    assert not isinstance(found.value, FileNotFoundError)
