"""Packing along the curriculum of the mix."""

import numpy as np
import pytest

from contrail.llm import mixing, packing
from contrail.llm.packing import Schedule


def test_courses_are_integrals():
    for knots, course in zip(mixing.SCHEDULES, mixing.courses(20), strict=True):
        t, w = (np.array(x, float) for x in zip(*knots, strict=True))
        fine = np.interp(np.linspace(0, 1, 200_001), t, w)
        area = np.concatenate([[0], np.cumsum((fine[1:] + fine[:-1]) / 2)])
        assert course == pytest.approx(list(area[::10_000] / area[-1]), abs=1e-6) and course[0] == 0 and course[-1] == 1


@pytest.mark.parametrize("sizes", [[40_000, 9_000, 0, 77], [5, 0, 1], [300_000, 300_000, 300_000]])
def test_every_token_has_one_place(sizes):
    courses = mixing.courses(16)
    schedule = Schedule.along(sizes, [courses[k % 3] for k in range(len(sizes))], window=4096, quantum=64)
    seen = np.zeros(sum(sizes), int)
    for source, n in enumerate(sizes):
        for start in range(0, n, 333):
            for place, k in schedule.runs(source, start, min(333, n - start)):
                seen[place : place + k] += 1
    assert (seen == 1).all()


def test_windows_follow_the_schedules():
    sizes, steps = [400_000, 400_000, 400_000], 16
    courses = mixing.courses(steps)
    schedule = Schedule.along(sizes, courses, window=4096, quantum=64)
    owner = np.zeros(sum(sizes), int)
    for source in range(3):
        for place, k in schedule.runs(source, 0, sizes[source]):
            owner[place : place + k] = source
    start = 0
    for step in range(steps):
        take = [round(n * c[step + 1]) - round(n * c[step]) for n, c in zip(sizes, courses, strict=True)]
        part = owner[start : start + sum(take)]
        for a in range(0, len(part) - 4096, 4096):  # whole windows of the step
            share = np.bincount(part[a : a + 4096], minlength=3) / 4096
            assert abs(share - np.array(take) / sum(take)).max() < 3 * 64 / 4096
        start += sum(take)


def test_another_curriculum_packs_otherwise(spark, sf):
    from contrail.llm.queries import tokenizer_file

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(150).cache()
    rows = lambda c: sorted(map(tuple, packing.pack(docs, tokenizer_file(), courses=c).collect()))
    falling, rising = [[0, 0.5, 0.8, 1]], [[0, 0.2, 0.5, 1]]
    one, other = rows(falling + rising), rows(rising + falling)
    assert one != other and sum(r[2] for r in one) == sum(r[2] for r in other)
