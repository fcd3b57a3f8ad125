import json
import random

import pytest

from sparkloom.sources import tail


def test_complete_lines_only(tmp_path):
    f = tmp_path / "t.jsonl"
    f.write_bytes("a\n\né\npart".encode())
    lines, at = tail.read_new_lines(str(f), 0)
    assert lines == ["a", "é"] and at == 6
    assert tail.read_new_lines(f"file://{f}", at) == ([], 6)
    with open(f, "ab") as out:
        out.write(b"ial\n")
    assert tail.read_new_lines(str(f), at) == (["partial"], 14)
    f.write_text("n\n")
    assert tail.read_new_lines(str(f), 14) == ([], 0)


def test_blocks(tmp_path):
    f = tmp_path / "t.jsonl"
    f.write_text("one\ntwo\n\nthree\nno end")
    with open(f, "rb") as x:
        for block in (1, 2, 3, 100):
            assert tail._complete_until(x, 0, 21, block) == 15 and tail._complete_until(x, 15, 21, block) == 15
            assert list(tail._lines(x, 0, 15, 15, block)) == [(0, "one"), (4, "two"), (9, "three")]
            assert list(tail._lines(x, 4, 9, 15, block)) == [(4, "two")]
            assert tail._after_line_end(x, 4, 21, block) == 8 and tail._after_line_end(x, 15, 21, block) is None


def drained(reader, start=None):
    """(rows of each trigger, the last offset): what a query would read until nothing is new."""
    at, out = start or reader.initialOffset(), []
    while (end := reader.latestOffset()) != at:
        out.append([(p.split("/")[-1], t) for part in reader.partitions(at, end) for p, _, t in reader.read(part)])
        reader.commit(end)
        at = end
    return out, at


def test_admission(tmp_path):
    root, plans = tmp_path / "in", str(tmp_path / "plans")
    (root / "sub").mkdir(parents=True)
    for name in ("a", "b", "sub/c"):
        (root / f"{name}.jsonl").write_text("".join(f"{name[-1]}{i}\n" for i in range(9)))
    (root / "other.txt").write_text("x\n")
    # two files a trigger, in turn
    out, _ = drained(tail.TailReader(str(root), plans, max_files=2))
    assert [sorted({f for f, _ in rows}) for rows in out] == [["a.jsonl", "b.jsonl"], ["c.jsonl"]]
    # seven bytes a trigger: two lines; every file gets its turn before the first has another
    out, _ = drained(tail.TailReader(str(root), str(tmp_path / "plans2"), max_bytes=7))
    assert all(len(rows) == 2 for rows in out[:12]) and [rows[0][0][0] for rows in out[:6]] == list("abcabc")
    assert sorted(t for rows in out for _, t in rows) == sorted(f"{n}{i}" for n in "abc" for i in range(9))


def test_a_line_longer_than_the_limit_goes_alone(tmp_path):
    (tmp_path / "a.jsonl").write_text("short\n" + "x" * 50 + "\nend\n" + "y" * 50)
    out, _ = drained(tail.TailReader(str(tmp_path), str(tmp_path / "plans"), max_bytes=10))
    assert [[t for _, t in rows] for rows in out] == [["short"], ["x" * 50], ["end"]]


def test_shrunk_and_vanished_files(tmp_path):
    a, b, plans = tmp_path / "a.jsonl", tmp_path / "b.jsonl", str(tmp_path / "plans")
    a.write_text("1\n2\n3\n")
    b.write_text("x\n")
    reader = tail.TailReader(str(tmp_path), plans)
    _, at = drained(reader)
    a.write_text("new\n")
    b.unlink()
    out, at = drained(reader, at)
    assert out == [[("a.jsonl", "new")]] and list(reader.plans.offsets) == [str(a)]
    b.write_text("back\n")
    assert drained(tail.TailReader(str(tmp_path), plans), at)[0] == [[("b.jsonl", "back")]]  # and a restart knows where a was left


def test_one_file_in_several_splits(tmp_path):
    rng = random.Random(2)
    lines = ["".join(rng.choices("aé\r ", k=rng.randrange(0, 30))) + "." for _ in range(300)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\nrest", newline="")
    for split in (1, 7, 64, 1000):
        reader = tail.TailReader(str(tmp_path), str(tmp_path / f"plans{split}"), split=split)
        parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
        rows = [(at, t) for part in parts for _, at, t in reader.read(part)]
        assert len(parts) > 300 // split and [t for _, t in rows] == lines
        raw = (tmp_path / "a.jsonl").read_bytes()
        assert all(raw[at:].startswith(t.encode()) for at, t in rows)


@pytest.mark.parametrize("asked", [True, False])
def test_batches_are_read_again_as_they_were(tmp_path, asked):
    """A restart after a plan was written: the batch it belongs to, if there was one, reads the same ranges."""
    f, plans = tmp_path / "a.jsonl", str(tmp_path / "plans")
    f.write_text("1\n2\n")
    reader = tail.TailReader(str(tmp_path), plans)
    first = reader.latestOffset()
    before = [list(reader.read(p)) for p in reader.partitions(reader.initialOffset(), first)] if asked else None
    with open(f, "a") as g:
        g.write("3\n")
    again = tail.TailReader(str(tmp_path), plans)
    if asked:
        assert [list(again.read(p)) for p in again.partitions(again.initialOffset(), first)] == before
        assert [t for rows in drained(again, first)[0] for _, t in rows] == ["3"]
    else:
        assert [t for rows in drained(again)[0] for _, t in rows] == ["1", "2", "3"]


def test_old_plans_go(tmp_path):
    f, plans = tmp_path / "in" / "a.jsonl", tmp_path / "plans"
    f.parent.mkdir()
    f.write_text("".join(f"{i}\n" for i in range(100, 200)))
    out, at = drained(tail.TailReader(str(f.parent), str(plans), max_bytes=4))
    assert len(out) == 100 and len(list(plans.iterdir())) <= 2 * tail.SNAPSHOT_EVERY
    held = sorted(plans.iterdir())
    assert "offsets" in json.loads(held[0].read_text())
    assert drained(tail.TailReader(str(f.parent), str(plans)), at)[0] == []


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    tail.register(spark)
    (tmp_path / "in").mkdir()
    f = tmp_path / "in" / "a.jsonl"
    out, ck = str(tmp_path / "out"), str(tmp_path / "ck")

    def run():
        rows = spark.readStream.format("tailed_lines").option("path", f"file://{tmp_path}/in").option("plans", f"file://{tmp_path}/plans").option("splitBytes", 4).load()
        q = rows.writeStream.format("parquet").option("checkpointLocation", ck).trigger(availableNow=True).start(out)
        q.awaitTermination(60)

    f.write_text("one\ntwo\nthr")
    run()
    with open(f, "a") as g:
        g.write("ee\n")
    (tmp_path / "in" / "b.jsonl").write_text("other\n")
    run()
    assert sorted(r.value for r in spark.read.parquet(out).collect()) == ["one", "other", "three", "two"]


def test_limited_stream(spark, tmp_path):
    """Many triggers of one running query, with a file that grows in between."""
    tail.register(spark)
    (tmp_path / "in").mkdir()
    f = tmp_path / "in" / "a.jsonl"
    f.write_text("".join(f"l{i}\n" for i in range(6)))
    rows = spark.readStream.format("tailed_lines").option("path", str(tmp_path / "in")).option("plans", str(tmp_path / "plans")).option("maxBytesPerTrigger", 9).load()
    q = rows.writeStream.format("memory").queryName("tailed").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        with open(f, "a") as g:
            g.write("l6\nl7\n")
        q.processAllAvailable()
        assert [r.value for r in spark.table("tailed").orderBy("offset").collect()] == [f"l{i}" for i in range(8)]
        assert all(p.numInputRows <= 3 for p in q.recentProgress) and sum(p.numInputRows > 0 for p in q.recentProgress) >= 3
    finally:
        q.stop()
