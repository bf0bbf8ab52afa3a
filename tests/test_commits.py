"""A committed set of ticks against its raw files: changed months only, killed and racing runs, damage found."""

import random
import shutil

import pytest

from tidemark.operators.validate import CHECKS, TickRules
from tidemark.sources.commits import Conflict, TickSet
from tidemark.sources.ticks import TickFormat

HEADERS = ["DateTime", "Bid", "Ask", "Volume"]
ENABLED = [c for c in CHECKS if c not in ("duplicate_timestamp", "non_monotonic")]


def line(month, k, bid=None):
    return f"2021{month:02d}{1 + k % 28:02d} {k // 28 % 24:02d}:{k % 60:02d}:00.{k % 1000:03d},{bid or 1000 + k % 7},{1001 + k % 7},1"


def month(m, n=120):
    return [line(m, k) for k in range(n)]


def write(path, *blocks):
    path.write_text("\n".join([",".join(HEADERS), *[x for b in blocks for x in b]]) + "\n")


def update(s, src, **more):
    return s.update(str(src), TickFormat(), HEADERS, TickRules(), ENABLED, **more)


def rows(s):
    return sorted((str(r["timestamp"]), r["bid"], r["ask"]) for r in s.read().collect())


@pytest.fixture
def raw(tmp_path):
    src = tmp_path / "raw"
    src.mkdir()
    rng = random.Random(3)
    mixed = month(2) + month(3)
    rng.shuffle(mixed)  # two months out of order, in one file
    write(src / "a.csv", month(1), mixed, ["bad,1,2,3", ",1,2,3", "20210301 00:00:00.000,5"])
    write(src / "b.csv", month(3, 20), month(4))
    return src


def test_only_changed_months(spark, raw, tmp_path):
    s = TickSet(spark, str(tmp_path / "set"))
    first = update(s, raw, months_a_job=2)
    assert first["built"] == ["2021-01", "2021-02", "2021-03", "2021-04"] and first["reconciliation"]["ok"]
    assert first["malformed"] == 1 and first["dropped"]["unparseable_timestamp"] == 1 and first["dropped"]["missing_timestamp"] == 1
    assert first["dropped"]["duplicate_row"] == 20 and first["rows"] == 480  # what b.csv repeats of March
    assert update(s, raw)["number"] == 1
    write(raw / "b.csv", month(3, 20), month(4, 119), [line(4, 500)], month(5, 10))
    second = update(s, raw)
    assert second["built"] == ["2021-04", "2021-05"] and second["number"] == 2 and second["version"] != first["version"]
    assert second["months"]["2021-01"] == first["months"]["2021-01"]
    # Rows are those of a set built at once.
    other = TickSet(spark, str(tmp_path / "other"))
    update(other, raw)
    assert rows(s) == rows(other) and len(rows(s)) == 490
    assert {str(r["timestamp"])[:7] for r in s.read("2021-02", "2021-03").collect()} == {"2021-02", "2021-03"}
    # A month that leaves the source leaves the set; equal lines in another order are another month.
    lines = (raw / "b.csv").read_text().split("\n")
    lines = [x for x in lines if not x.startswith("202105")]
    april = [i for i, x in enumerate(lines) if x.startswith("202104")]
    lines[april[0]], lines[april[1]] = lines[april[1]], lines[april[0]]
    (raw / "b.csv").write_text("\n".join(lines))
    third = update(s, raw)
    assert third["built"] == ["2021-04"] and "2021-05" not in third["months"]
    assert s.verify().passed
    gone = s.tidy(keep=1)
    assert gone and s.verify().passed and s.manifest()["number"] == 3


def test_a_killed_run_leaves_the_old_set_and_its_finished_parts(spark, raw, tmp_path, monkeypatch):
    s = TickSet(spark, str(tmp_path / "set"))
    update(s, raw)
    before = rows(s)
    write(raw / "c.csv", month(6), month(7), month(8))
    real, calls = TickSet._write, []

    def dies(self, *a):
        calls.append(a[2])
        if len(calls) == 2:
            raise RuntimeError("killed")
        return real(self, *a)

    monkeypatch.setattr(TickSet, "_write", dies)
    with pytest.raises(RuntimeError, match="killed"):
        update(s, raw, months_a_job=1)
    assert rows(s) == before and s.manifest()["number"] == 1 and s.verify().passed
    out = update(s, raw, months_a_job=1)
    assert calls == [["2021-06"], ["2021-07"], ["2021-07"], ["2021-08"]]  # June was taken over
    assert out["built"] == ["2021-06", "2021-07", "2021-08"] and len(rows(s)) == len(before) + 360


def test_a_racing_run_is_refused(spark, raw, tmp_path):
    s = TickSet(spark, str(tmp_path / "set"))
    m = update(s, raw)
    with pytest.raises(Conflict):
        s._commit({**m, "rows": -1})
    assert s.manifest() == m


def test_damage_is_found(spark, raw, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    s = TickSet(spark, str(tmp_path / "set"))
    update(s, raw)
    good = s.verify(gap_seconds=86400 * 2)
    assert good.passed and good.absent == [] and sum(v["rows"] for v in good.months.values()) == 480 and good.gaps
    part = next(p for p in (tmp_path / "set" / "parts").rglob("kept=true/month=2021-02/*.parquet"))
    kept = part.read_bytes()
    t = pq.read_table(part).replace_schema_metadata(None)
    for i, f in enumerate(t.schema):
        if str(f.type).startswith("timestamp"):
            t = t.set_column(i, f.name, t.column(i).cast(pa.timestamp("us")).cast(pa.timestamp("us", "UTC")))

    def put(table):
        pq.write_table(table, part)
        crc = part.with_name(f".{part.name}.crc")
        if crc.exists():
            crc.unlink()
        return " | ".join(s.verify().failures)

    swapped = [1, 0, *range(2, t.num_rows)]
    assert "out of order" in put(t.take(swapped))
    bid = t.column("bid").to_pylist()
    j = next(i for i, b in enumerate(bid) if b != bid[0])
    bid[0], bid[j] = bid[j], bid[0]
    assert "digest" in put(t.set_column(t.column_names.index("bid"), "bid", [bid]))
    assert "rows is" in put(t.slice(1))
    assert "another type" in put(t.set_column(t.column_names.index("bid"), "bid", [[str(b) for b in bid]]))
    part.write_bytes(kept)
    assert s.verify().passed
    shutil.copy(part, part.parent.parent / "month=2021-01" / "stray.parquet")
    found = " | ".join(s.verify().failures)
    assert "rows of another month" in found and "2021-01: rows is" in found
    shutil.rmtree(part.parent.parent / "month=2021-01")
    assert "its files are missing" in " | ".join(s.verify().failures)


def test_empty_sources_and_refusals(spark, tmp_path):
    src = tmp_path / "raw"
    src.mkdir()
    write(src / "a.csv")
    (src / "b.csv").write_bytes(b"")
    s = TickSet(spark, str(tmp_path / "set"))
    assert not s.verify().passed
    with pytest.raises(ValueError, match="no set"):
        s.read()
    out = update(s, src)
    assert out["rows"] == 0 and out["months"] == {} and s.read().count() == 0 and s.verify().passed
    write(src / "a.csv", ["20210101 00:00:00.000,5", "20210101 00:00:01.000,-1,2,1"])  # a month without a good row
    out = update(s, src)
    assert out["rows"] == 0 and out["malformed"] == 1 and out["dropped"] == {"non_positive_price": 1} and s.read().count() == 0
    assert s.verify().passed
    with pytest.raises(ValueError, match="no month"):
        s.update(str(src), TickFormat(), HEADERS, enabled=["missing_quote"])
