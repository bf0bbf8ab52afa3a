"""Lines by byte ranges against plain reading of the same files."""

import random

import pytest

from tidemark.sources import seek as SK


def plain(path):
    out, at = [], 0
    for line in path.read_bytes().split(b"\n"):
        out.append((at, line.removesuffix(b"\r").decode("utf-8", "replace")))
        at += len(line) + 1
    return [r for r in out if r[0] < path.stat().st_size]


@pytest.mark.parametrize("body", [
    b"", b"\n", b"a", b"a\nb", b"a\n\n\nb\n", b"x" * 5000 + b"\ny\n" + b"z" * 9000, "é\nüü\n€\n".encode() * 50, b"a\r\nbb\r\nccc\r\n", b"ok\n\xff\xfe bad\nok\n",
])
@pytest.mark.parametrize("most", [1, 7, 4096, 1 << 20])
def test_every_line_once(tmp_path, body, most):
    if most == 1 and len(body) > 1000:
        body = body[:700]
    path = tmp_path / "f.txt"
    path.write_bytes(body)
    reader = SK.LineReader({"files": f'["{path}"]', "partition_bytes": str(most)})
    got = [(r["src_offset"], r["value"]) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert got == plain(path)


def test_prefix_search(tmp_path):
    rng = random.Random(5)
    for n in (0, 1, 2, 3, 50, 400):
        keys = sorted(rng.choice(["10", "11", "12", "13"]) + str(rng.randint(0, 9)) * rng.randint(0, 30) for _ in range(n))
        keys.sort(key=lambda k: k.encode())
        path = tmp_path / f"{n}.txt"
        path.write_text("Header,x\n" + "".join(k + "\n" for k in keys))
        with SK.open_file(str(path))[0] as f:
            size = path.stat().st_size
            for prefix in ("0", "1", "10", "11", "115", "1155", "12", "13999", "2"):
                at = SK.line_at_prefix(f, prefix.encode(), 9, size)
                below = [k for k in keys if k.encode()[: len(prefix)] < prefix.encode()]
                assert at == 9 + sum(len(k) + 1 for k in below), (n, prefix)


def test_a_week_reads_its_bytes(spark, tmp_path):
    path = tmp_path / "ticks.csv"
    days = [f"2021{m:02d}{d:02d}" for m in range(1, 13) for d in range(1, 29)]
    path.write_text("DateTime,Bid\n" + "".join(f"{d} {h:02d}:00:00.000,{h}\n" for d in days for h in range(24)))
    week = SK.LineReader({"files": f'["{path}"]', "header_lines": "1", "from_prefix": "20210601", "to_prefix": "20210608"})
    read = sum(p.end - p.begin for p in week.partitions())
    lines = [x for x in path.read_text().split("\n") if "20210601" <= x[:8] < "20210608"]
    assert read == sum(len(x) + 1 for x in lines)
    got = SK.read_lines(spark, [str(path)], "20210601", "20210608", 1, partition_bytes=1000)
    assert sorted(r["value"] for r in got.collect()) == lines
    assert SK.read_lines(spark, [f"file:{path}"]).count() == len(days) * 24 + 1
    assert SK.read_ranges(spark, [(str(path), 13, 40), (str(path), 20, 60)]).count() == 2


def test_merged_ranges():
    assert SK.merged([("a", 5, 9), ("a", 0, 6), ("b", 3, 3), ("a", 20, 30)]) == [("a", 0, 9), ("a", 20, 30)]
