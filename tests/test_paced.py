"""Calls that keep to a shared pace, by a clock that only sleeping moves."""

import sys

from pyspark import cloudpickle

from polyscene.operators import models

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't find tests


class Clock:
    def __init__(self, now=100.5):
        self.now = now

    def time(self):
        return self.now

    def sleep(self, seconds):
        assert seconds > 0
        self.now += seconds


def test_slots_are_taken_in_turn():
    assert [models.own_slot(0.0, -1, k, 3, 4.0) for k in range(3)] == [0, 1, 2]
    assert models.own_slot(8.1, -1, 0, 3, 4.0) == 3 and models.own_slot(12.0, 3, 0, 3, 4.0) == 6 and models.own_slot(100.0, 3, 1, 3, 4.0) == 25


def test_calls_begin_apart_and_few_at_once(spark):
    clock = Clock()

    def client(request):
        began = clock.now
        clock.now += 9.0 if request == "3" else 0.5  # one call is longer than a slot
        if request == "5" and began < 120:
            raise RuntimeError("busy")
        return f"{began}"

    rows = spark.createDataFrame([(i, str(i)) for i in range(20)], "key long, request string").repartition(7)
    out = models.answered(rows, client, 3, clock.sleep, 4.0, clock.time)
    assert out.rdd.getNumPartitions() == 3
    got = out.collect()
    starts = sorted(float(r["answer"]) for r in got)
    assert len(starts) == 20 and all(b - a >= 4.0 for a, b in zip(starts[:-1], starts[1:])) and all(s % 4 == 0 for s in starts)
    assert {r["tries"] for r in got if r["key"] != 5} == {1}


def test_without_spacing_nothing_waits(spark):
    def pause(_):
        raise AssertionError("no pause is due")

    rows = spark.createDataFrame([(i, str(i)) for i in range(5)], "key long, request string")
    assert models.answered(rows, lambda r: r, 2, pause).filter("answer = string(key)").count() == 5
