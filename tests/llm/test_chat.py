import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from sparkloom.llm import chat


SIZE = len(chat.STATES) * (1 + len(chat.STATES) + len(chat.CLASSES) + len(chat.SHAPES))


def conversations(n=60, long=150):
    rng, rows = random.Random(9), []
    for c in range(n):
        size = long if c == 7 else rng.randrange(1, 9)
        roles = (["system"] if rng.random() < 0.3 else []) + ["user", "assistant"] * size
        for t, r in enumerate(roles[:size]):
            said = "\n".join(" ".join(rng.choices(["some", "plain", "words", "here", "why?"], k=rng.randrange(1, 6))) for _ in range(rng.randrange(1, 4)))
            rows.append((c, t, r, said))
    return rows


def test_roles_are_recovered(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    model = chat.fit(df, F.col("conv_id") % 5 != 0)
    got = {(r.conv_id, r.part * 64 + r.seq): (r.role, r.text) for r in chat.parse(chat.transcripts(df), model).collect()}
    right = sum(got.get((c, t)) == (r, x) for c, t, r, x in rows)
    assert right >= 0.97 * len(rows) and len(got) == len(rows)


def accuracy(rows, found):
    got = {(r.conv_id, r.part * 64 + r.seq): (r.role, r.text) for r in found.collect()}
    return sum(got.get((c, t)) == (r, x) for c, t, r, x in rows) / len(rows)


def test_styles_that_no_model_was_fitted_on(spark):
    rows = conversations(180)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    model = chat.fit(df, F.col("conv_id") % 3 > 0)
    # and on conversations that it wasn't fitted on
    rows, df = [r for r in rows if r[0] % 3 == 0], df.where("conv_id % 3 = 0")
    for style in chat.UNSEEN:
        assert accuracy(rows, chat.parse(chat.transcripts(df, styles=(style,)), model)) >= 0.95, style
    # names that say nothing are told apart by their turns alone
    assert accuracy(rows, chat.parse(chat.transcripts(df, styles=(("System: ", "Carla: ", "Assistant: "),)), model)) >= 0.95


def test_markers():
    at = lambda line: (chat.CLASSES[chat.observe(line)[0]], line[chat.observe(line)[2] :])
    for line, want in (
        ("[Alice] hi", ("other", "hi")), ("Human - hi", ("user", "hi")), ("12:01 Bob: hi", ("other", "hi")), ("[12:01:33] Assistant: hi", ("assistant", "hi")), ("2024-01-02 9:15 PM | User: hi", ("user", "hi")),
        ("<Alice> hi", ("other", "hi")), ("[Human] hi", ("user", "hi")), ("user > hi", ("user", "hi")), ("AI \u2014 hi", ("assistant", "hi")), ("### Human", ("user", "")), ("human beings - a study", ("none", "human beings - a study")),
        ("a-priori: hi", ("none", "a-priori: hi")), ("12:30 is lunch", ("none", "12:30 is lunch")), ("plain words", ("none", "plain words")),
    ):
        assert at(line) == want, line


def test_best_path_against_all_paths():
    rng = random.Random(6)
    model = chat.Hmm.counted(np.array([rng.random() * 9 for _ in range(SIZE)]))
    for _ in range(20):
        lines = [rng.choice(["User: hi", "Bob: hello", "plain", "", "Assistant: yes?", "- item"]) for _ in range(rng.randrange(1, 5))]
        e = model.emissions(lines)

        def total(path):
            return model.start[path[0]] + sum(model.move[a, b] for a, b in zip(path, path[1:])) + sum(e[k, s] for k, s in enumerate(path))

        best = max(itertools.product(range(len(chat.STATES)), repeat=len(lines)), key=total)
        found = model.decode(lines, True, 0, None)
        assert abs(total(found) - total(best)) < 1e-9
        assert abs(model.matrix(lines, True)[0].max() - total(best)) < 1e-9


def test_counts_by_hand(spark):
    rows = [(1, 0, "user", "hi\nmore\nyet more"), (1, 1, "assistant", "yes?"), (1, 2, "user", "ok"), (1, 64, "assistant", "late"), (1, None, "user", "unnumbered"), (2, 0, "other", None), (2, 0, "other", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    model = chat.fit(df, F.lit(True), styles=(("S: ", "User: ", "Bot: "),))
    u, ub, uc, b = (chat.STATES.index(x) for x in (("user", "open"), ("user", "bare"), ("user", "more"), ("assistant", "open")))
    start = np.full(9, 0.1)
    start[u], start[b] = 3.1 - 1, 1.1  # parts begin anew: turn 0 (one without a text), 64, and the one without a number
    start[ub] = 1.1
    assert np.allclose(model.start, np.log(start / start.sum()))
    assert np.isclose(np.exp(model.move[uc, b]) / np.exp(model.move[uc, uc]), 1.1 / 1.1) and np.isclose(np.exp(model.move[u, uc]) / np.exp(model.move[u, b]), 1.1 / 0.1)


def test_turns_and_rows_without_numbers(spark):
    rows = [(1, 0, "user", "a"), (1, None, "assistant", "b"), (1, None, "assistant", "b"), (1, None, "user", "c"), (None, 0, "user", "d"), (None, 1, "user", "e"), (None, None, None, None), (None, 0, "user", "d")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, part int, said int")
    model = chat.fit(df, F.lit(True))
    got = sorted(((r.conv_id, r.role, r.text) for r in chat.parse(chat.transcripts(df), model).collect()), key=repr)
    assert got == sorted([(1, "user", "a"), (1, "assistant", "b"), (1, "user", "c"), (None, "user", "d"), (None, "user", "e"), (None, "user", "")], key=repr)


def test_parts_give_the_whole_transcripts_best_path(spark):
    rng = random.Random(2)
    model = chat.Hmm.counted(np.zeros(SIZE))
    lines = [rng.choice(["User: hi", "Bob: hello there", "plain words", "", "Assistant: yes?", "- item", "what now?", "### System:"]) for _ in range(90)]
    cuts = sorted(rng.sample(range(1, 90), 20))
    parts = [(1, k, "\n".join(lines[a:b])) for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, 90]))]
    parts += [(2, 5, "User: one\nBot: two"), (None, 0, "Human: x"), (3, None, None), (2, 5, "User: one\nBot: two")]
    df = spark.createDataFrame([(*p, "z") for p in parts], "conv_id long, part long, text string, role string")
    rows = chat.parse(df, model, fan=3).collect()
    whole = chat.turns(lines, model.decode(lines, True, 0, None))
    mine = sorted((r for r in rows if r.conv_id == 1), key=lambda r: (r.part, r.seq))
    joined = []
    for r in mine:
        if r.continues and joined:
            joined[-1][1].append(r.text)
        else:
            joined.append([r.role, [r.text] if r.text else []])
    assert [(a, "\n".join(b)) for a, b in joined] == [(r, t) for r, _, t in whole]
    assert [r.role for r in rows if r.conv_id == 2] == ["user", "assistant"] * 2
    assert [(r.role, r.text) for r in rows if r.conv_id is None] == [("user", "x")]
    assert len([r for r in rows if r.conv_id == 3]) == 1


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.parse(chat.transcripts(df), chat.fit(df, F.lit(True))).collect() == []
