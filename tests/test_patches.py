import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import patches

HEAD = "Index: a.ts\n" + "=" * 67 + "\n--- a.ts\t\n+++ a.ts\t\n"
NONE = "\\ No newline at end of file\n"
TEN = "".join(f"{i}\n" for i in range(1, 11))

GOLDEN = {
    "one line in the middle": (TEN, TEN.replace("5\n", "five\n"), "@@ -2,7 +2,7 @@\n 2\n 3\n 4\n-5\n+five\n 6\n 7\n 8\n"),
    "at the start": (TEN, "0\n" + TEN, "@@ -1,3 +1,4 @@\n+0\n 1\n 2\n 3\n"),
    "at the end": (TEN, TEN[:-3], "@@ -7,4 +7,3 @@\n 7\n 8\n 9\n-10\n"),
    "from nothing": ("", "x\ny", "@@ -0,0 +1,2 @@\n+x\n+y\n" + NONE),
    "to nothing": ("x\ny\n", "", "@@ -1,2 +0,0 @@\n-x\n-y\n"),
    "a line end comes": ("a\nb", "a\nb\n", "@@ -1,2 +1,2 @@\n a\n-b\n" + NONE + "+b\n"),
    "context without a line end": ("a\nb", "c\na\nb", "@@ -1,2 +1,3 @@\n+c\n a\n b\n" + NONE),
    "six lines between are one hunk": (TEN, "one\n" + TEN[2:].replace("8\n", "eight\n"), "@@ -1,10 +1,10 @@\n-1\n+one\n 2\n 3\n 4\n 5\n 6\n 7\n-8\n+eight\n 9\n 10\n"),
    "seven are two": (TEN, "one\n" + TEN[2:].replace("9\n", "nine\n"), "@@ -1,4 +1,4 @@\n-1\n+one\n 2\n 3\n 4\n@@ -6,5 +6,5 @@\n 6\n 7\n 8\n-9\n+nine\n 10\n"),
    "deletions first": ("a\nb\nc\nd\n", "a\nc\nb\nd\n", "@@ -1,4 +1,4 @@\n a\n-b\n c\n+b\n d\n"),
    "the paper's example": ("a\nb\nc\na\nb\nb\na\n", "c\nb\na\nb\na\nc\n", "@@ -1,7 +1,6 @@\n-a\n-b\n c\n+b\n a\n b\n-b\n a\n+c\n"),
    "carriage returns stay in lines": ("a\r\nb\r\n", "a\nb\r\n", "@@ -1,2 +1,2 @@\n-a\r\n+a\n b\r\n"),
    "nothing changed": ("a\n", "a\n", ""),
}


@pytest.mark.parametrize("case", GOLDEN)
def test_golden(case):
    old, new, body = GOLDEN[case]
    assert patches.make_patch(old, new, "a.ts") == HEAD + body


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_shortest_and_exact(monkeypatch, block):
    monkeypatch.setattr(patches, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(400):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(25))] for _ in range(2))
        runs = patches.edit_script(a, b)
        sizes = {k: sum(n for kind, n in runs if kind == k) for k in " -+"}
        assert (sizes[" "], sizes["-"], sizes["+"]) == ((c := common(a, b)), len(a) - c, len(b) - c)
        old, new = ("\n".join(x) + "\n" * rng.randrange(2) for x in (a, b))
        patch = patches.make_patch(old, new)
        assert patches.apply_patch(old, patch) == new
        size = len(patch.encode())
        assert patches.make_patch(old, new, below=size) is None and patches.make_patch(old, new, below=size + 1) == patch


def test_blocks_give_the_same_script(monkeypatch):
    rng = random.Random(5)
    a, b = ([rng.randrange(30) for _ in range(300)] for _ in range(2))
    whole = patches.edit_script(a, b)
    monkeypatch.setattr(patches, "BLOCK", 7)
    assert patches.edit_script(a, b) == whole


def test_texts_with_nothing_in_common_are_not_searched(monkeypatch):
    monkeypatch.setattr(patches, "edit_script", lambda *_: 1 / 0)
    assert patches.make_patch("a\n" * 50_000, "".join(f"{i}\n" for i in range(50_000)), below=288_890) is None


@pytest.mark.parametrize("old,new", [("1\n" * 50, "1\n" * 20 + "2\n" + "1\n" * 30), ("a\r\nb\r\n", "a\nb"), ("é\n\n\n", "\n\né"), ("@@ -1 +1 @@\n", "-a\n+b\n"), ("\\ x\n", "\\ y")])
def test_patches_apply(old, new):
    assert patches.apply_patch(old, patches.make_patch(old, new)) == new


def test_patch_that_does_not_fit():
    for text in ("q\nr\n", "", "a"):
        with pytest.raises(ValueError):
            patches.apply_patch(text, patches.make_patch("a\nb\n", "a\nc\n"))


def test_columns(spark):
    df = spark.createDataFrame([("a\n", "b\n", "p"), (None, "b", "p"), ("a", None, "p"), ("a", "b", None), ("x" * 500 + "\na\n", "x" * 500 + "\nb\n", "p")], "a string, b string, p string")
    got = df.select(patches.unified_patch("a", "b", "p").alias("u"), patches.smaller_patch("a", "b", "p").alias("s"), patches.patched("a", patches.unified_patch("a", "b", "p")).alias("n"), F.col("b")).collect()
    assert [r.n for r in got] == ["b\n", None, None, None, got[4].b] and [r.s is None for r in got] == [True] * 4 + [True] and got[0].u.startswith("Index: p\n")


def test_rows_reach_python_by_the_hundred(spark):
    """Not by Arrow batches of 10,000 texts."""
    df = spark.createDataFrame([("a", "b")], "a string, b string")
    plan = df.select(patches.patched("a", patches.unified_patch("a", "b", F.lit("p"))))._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
