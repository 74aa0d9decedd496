"""Token passes against a plain loop, with blocks of 25 rows."""

import random

import pytest

from cinetrace.operators import folds, passes

SCHEMA = "run_id long, chunk_id long, prompt_tokens long, completion_tokens long, n_images long, entity_length long"


def loop(rows, budget):
    out, state = [], {}
    for run, chunk, prompt, said, n, length in rows:
        image, reply, spent, number = state.get(run, (1500, 500, 0, 0))
        prompt, said, n, length = prompt or 0, said or 0, n or 0, length or 0
        fixed = 600 + max(50, length // 3)
        size = max(2, min(50, (budget - fixed - reply) // max(1, image)))
        if prompt > 0 and n > 0:
            image = int(0.3 * image + 0.7 * max(500, (prompt - fixed) / n))
        if said > 0:
            reply = int(0.3 * reply + 0.7 * said)
        spent += prompt + said
        out.append((run, chunk, number, spent, image, reply, size))
        over = spent + fixed + size * image + reply > budget
        state[run] = (image, reply, 0, number + 1) if over else (image, reply, spent, number)
    return sorted(out)


def check(spark, rows, budget):
    got = passes.token_passes(spark.createDataFrame(rows, SCHEMA), budget)
    assert sorted(tuple(r) for r in got.collect()) == loop(rows, budget)


def rows_of(n, seed, run=1, big=5000):
    r = random.Random(seed)
    return [(run, 3 * i, r.choice([0, 900, r.randrange(1, big)]), r.choice([0, r.randrange(700)]), r.randrange(4), r.randrange(900)) for i in range(n)]


@pytest.mark.parametrize("budget", [1_000, 20_000, 150_000, 10**9])
def test_passes_equal_a_loop(spark, budget):
    """From a pass for every chunk to a run in which no pass ends."""
    check(spark, rows_of(300, 1) + rows_of(40, 2, run=2) + rows_of(1, 3, run=3), budget)


def test_rows_that_end_every_pass(spark):
    rows = rows_of(260, 4)
    wide = [(*r[:5], 3_000_000) if i in (7, 24, 25, 26, 74, 199) else r for i, r in enumerate(rows)]
    check(spark, wide, 200_000)


def test_one_large_chunk_among_idle_ones(spark):
    rows = [(1, i, 10**7 if i == 130 else i % 2, 0, 1, 0) for i in range(270)]
    check(spark, rows, 500_000)
    check(spark, [(1, i, None, None, None, None) for i in range(80)], 90_000)


def test_rounds_do_not_depend_on_what_passes_do(spark, monkeypatch):
    """64 blocks in which no pass ends, and idle chunks between measured ones, settle in a few rounds."""
    rounds = []
    real = folds.checkpointed
    monkeypatch.setattr(folds, "checkpointed", lambda d: rounds.append(1) or real(d))
    rows = [(1, i, 0 if 200 < i < 1300 else 900 + (i * 7919) % 5000, (i * 104729) % 700, 1 + i % 4, 0) for i in range(64 * 25)]
    for budget in (20_000, 10**9):
        rounds.clear()
        check(spark, rows, budget)
        assert len(rounds) <= 2 + 2 * 8


def test_no_rows(spark):
    check(spark, [], 1000)


def test_short_runs_share_a_call(spark, monkeypatch):
    """Calls to Python grow with the rows and not with the runs; runs of one block and of several stand side by side."""
    calls = spark.sparkContext.accumulator(0)
    real = folds.each_block

    def counted(*args):
        calls.add(1)
        return real(*args)

    monkeypatch.setattr(folds, "each_block", counted)
    rows = [r for run in range(300) for r in rows_of(60 if run % 50 == 0 else 2, run, run=run)]
    check(spark, rows, 20_000)
    assert 0 < calls.value <= 40
