"""Unified diffs along a shortest edit script (Myers, 1986), found greedily from the texts' beginnings.

At equal reach a script deletes before it inserts. Frontiers of the search aren't kept: only each step's choices, a bit for each diagonal,
of one block of steps, and the frontier at each block's start, from which a block's choices are found again when the script is read
back. A script of D edits so takes about D * D / 1000 + 1000 * D / 8 bytes and no more than twice the steps.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import functions as F
from pyspark.sql import types as T

# How a patch is printed.
_RULE = "=" * 67
_NO_NEWLINE = "\\ No newline at end of file"
CONTEXT = 3

#: Steps whose choices are held at once.
BLOCK = 1024
KEPT, DELETED, INSERTED = " ", "-", "+"


def lines_of(text: str) -> list[str]:
    """Lines with their line feeds; the last may lack one."""
    parts = text.split("\n")
    return [p + "\n" for p in parts[:-1]] + ([parts[-1]] if parts[-1] else [])


@dataclass
class _Frontier:
    """How many old lines the farthest script on each diagonal (old minus new lines) has passed, and the diagonals still of use."""

    old: list[int]
    new: list[int]
    reach: dict[int, int | None] = field(default_factory=dict)
    low: int = 0
    high: int = 0
    edits: int = 0

    def copy(self) -> _Frontier:
        return _Frontier(self.old, self.new, dict(self.reach), self.low, self.high, self.edits)

    def slide(self, passed: int, diagonal: int) -> int:
        old, new, n, m = self.old, self.new, len(self.old), len(self.new) + diagonal
        while passed < n and passed < m and old[passed] == new[passed - diagonal]:
            passed += 1
        return passed

    def begin(self) -> bool:
        n, m = len(self.old), len(self.new)
        self.reach, self.low, self.high = {0: self.slide(0, 0)}, -n - m, n + m
        return self.reach[0] == n == m

    def step(self) -> tuple[int, bytearray, bool]:
        """One edit more: (lowest diagonal, whether each ends with an insertion, whether the last one reached the ends)."""
        self.edits += 1
        n, m, reach = len(self.old), len(self.new), self.reach
        first, choices = max(self.low, -self.edits), bytearray()
        diagonal = first
        while diagonal <= min(self.high, self.edits):
            left, right = reach.pop(diagonal - 1, None), reach.get(diagonal + 1)
            deletes = left is not None and left < n
            inserts = right is not None and right - diagonal <= m
            by_insertion = inserts and (not deletes or left < right)
            choices.append(by_insertion)
            if deletes or inserts:
                passed = self.slide(right if by_insertion else left + 1, diagonal)
                if passed >= n and passed - diagonal >= m:
                    return first, choices, True
                reach[diagonal] = passed
                if passed >= n:
                    self.high = min(self.high, diagonal - 1)
                if passed - diagonal >= m:
                    self.low = max(self.low, diagonal + 1)
            else:
                reach[diagonal] = None
            diagonal += 2
        return first, choices, False


def _packed(first: int, choices: bytearray) -> tuple[int, int]:
    return first, int(choices.translate(bytes([48, 49]) + bytes(254)).decode()[::-1] or "0", 2)


def edit_script(old: list, new: list) -> list[tuple[str, int]]:
    """Runs of kept, deleted and inserted lines, in order."""
    number: dict = {}
    a, b = ([number.setdefault(x, len(number)) for x in side] for side in (old, new))
    now = _Frontier(a, b)
    if now.begin():
        return [(KEPT, len(a))] if a else []
    starts, block, done, diagonal = [], [], False, 0
    while not done:
        if now.edits % BLOCK == 0:
            starts.append(now.copy())
            block = []
        first, choices, done = now.step()
        block.append(_packed(first, choices))
        diagonal = first + 2 * (len(choices) - 1)
    way = []
    while starts:
        for first, bits in reversed(block):
            inserted = bits >> ((diagonal - first) // 2) & 1
            way.append(INSERTED if inserted else DELETED)
            diagonal += 1 if inserted else -1
        starts.pop()
        if starts:  # the block before, once more
            again = starts[-1].copy()
            block = [_packed(*again.step()[:2]) for _ in range(BLOCK)]
    runs: list[list] = []
    passed = diagonal = 0

    def more(kind: str, count: int) -> None:
        if runs and runs[-1][0] == kind:
            runs[-1][1] += count
        elif count:
            runs.append([kind, count])

    for edit in [*reversed(way), None]:
        upto = now.slide(passed, diagonal)
        more(KEPT, upto - passed)
        passed = upto
        if edit == DELETED:
            passed, diagonal = passed + 1, diagonal + 1
        elif edit == INSERTED:
            diagonal -= 1
        if edit:
            more(edit, 1)
    return [tuple(r) for r in runs]


@dataclass
class _Hunk:
    old_at: int
    new_at: int
    body: list[str]

    def __str__(self) -> str:
        sizes = [sum(1 for x in self.body if x[0] in kinds) for kinds in (KEPT + DELETED, KEPT + INSERTED)]
        # a side without lines is placed after the line before it
        at = [begin if size else begin - 1 for begin, size in zip((self.old_at, self.new_at), sizes)]
        out = [f"@@ -{at[0]},{sizes[0]} +{at[1]},{sizes[1]} @@\n"]
        for x in self.body:
            out.append(x if x.endswith("\n") else f"{x}\n{_NO_NEWLINE}\n")
        return "".join(out)


def _hunks(old: list[str], new: list[str], context: int) -> list[_Hunk]:
    """Changes with up to `context` lines around them; those that at most twice as many lines lie between are one hunk."""
    found: list[_Hunk] = []
    runs, x, y, near = edit_script(old, new), 0, 0, False
    for k, (kind, count) in enumerate(runs):
        lines = (new[y : y + count] if kind == INSERTED else old[x : x + count])
        if kind == KEPT:
            last = k == len(runs) - 1
            if near:
                near = not last and count <= 2 * context
                found[-1].body += [KEPT + t for t in (lines if near else lines[:context])]
        else:
            if not near:
                lead = old[max(0, x - context) : x] if context and k else []
                found.append(_Hunk(x + 1 - len(lead), y + 1 - len(lead), [KEPT + t for t in lead]))
                near = True
            found[-1].body += [kind + t for t in lines]
        x += count if kind != INSERTED else 0
        y += count if kind != DELETED else 0
    return found


def least_bytes(old: list[str], new: list[str]) -> int:
    """Bytes that any patch between these takes: lines that one side has more often must be in it."""
    a, b = Counter(old), Counter(new)
    return sum(n * (1 + len(line.encode())) for line, n in ((a - b) + (b - a)).items())


def make_patch(old: str, new: str, path: str = "file", context: int = CONTEXT, below: int | None = None) -> str | None:
    """A unified diff from old to new; below: None instead where it would take as many bytes or more."""
    a, b = lines_of(old), lines_of(new)
    head = f"Index: {path}\n{_RULE}\n--- {path}\t\n+++ {path}\t\n"
    if below is not None and len(head.encode()) + least_bytes(a, b) >= below:
        return None  # without a search
    patch = head + "".join(map(str, _hunks(a, b, context)))
    return None if below is not None and len(patch.encode()) >= below else patch


_RANGES = re.compile(r"@@ -(\d+)(?:,(\d+))? \+\d+(?:,\d+)? @@")


def apply_patch(old: str, patch: str) -> str:
    """The new text; ValueError where the patch doesn't fit the old one."""
    source, out, at, hunks = lines_of(old), [], 0, False
    lines = lines_of(patch)
    for i, line in enumerate(lines):
        if m := _RANGES.match(line):
            start = int(m[1]) - (m[2] != "0")
            if not at <= start <= len(source):
                raise ValueError("the patch doesn't apply")
            out += source[at:start]
            at, hunks = start, True
            continue
        if not hunks or line.startswith("\\"):
            continue
        body = line[1:]
        if i + 1 < len(lines) and lines[i + 1].startswith("\\"):
            body = body[:-1]
        if line[0] in KEPT + DELETED:
            if at >= len(source) or source[at] != body:
                raise ValueError("the patch doesn't apply")
            at += 1
        if line[0] in KEPT + INSERTED:
            out.append(body)
    return "".join(out + source[at:])


def _each(f) -> Callable:
    """A function of one row's texts as a column function, null where any of them is. Rows go to Python a hundred at a time: texts may be long."""
    return F.udf(lambda *texts: f(*texts) if all(isinstance(x, str) for x in texts) else None, T.StringType(), useArrow=False)


#: (old, new, path)
unified_patch = _each(make_patch)
#: (old, new, path): the patch where it takes fewer bytes than the new text, null otherwise.
smaller_patch = _each(lambda old, new, path: make_patch(old, new, path, below=len(new.encode())))
#: (old, patch)
patched = _each(apply_patch)
