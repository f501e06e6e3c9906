"""A breaker that tasks share."""

import os
import time

import numpy as np
from pyspark.sql import functions as F

from leafwork.operators import plugins
from leafwork.operators.breaker import Breaker


def test_states(tmp_path):
    a, b = (Breaker(str(tmp_path / "marks"), 2, 0.4, 0.0) for _ in "ab")
    assert a.state() == "closed" and a.allows() and b.allows()
    a.told(False)
    assert a.state() == "closed" and b.allows()
    b.told(True)  # a good call while closed leaves no mark
    assert a.allows()
    a.told(False)
    assert a.state() == "open" and not a.allows() and not b.allows()
    time.sleep(0.5)
    assert a.state() == "half open"
    assert a.allows() and not b.allows()  # one at a time
    a.told(False)
    assert a.state() == "open" and not b.allows()
    time.sleep(0.5)
    assert b.allows() and not a.allows()
    b.told(True)
    assert a.state() == "closed" and a.allows() and b.allows()


def pictures(spark, n, tasks):
    data = np.full((20, 30), 255, np.uint8)
    return spark.range(n).select(F.col("id").alias("doc_id"), F.lit(1).alias("page_number"), F.lit(20).alias("height"), F.lit(30).alias("width"), F.lit(bytearray(data.tobytes())).alias("data")).repartition(tasks)


def engines():
    """An engine that leaves a file for each call and fails as long as there is no file `well`. A class of
    this function, so that it travels to the workers as a whole."""

    class Failing:
        def __init__(self, folder):
            self.folder = folder

        def read(self, image):
            import os
            import time
            import uuid

            open(f"{self.folder}/call-{uuid.uuid4().hex}", "w").close()
            time.sleep(0.02)
            if not os.path.exists(f"{self.folder}/well"):
                raise RuntimeError("out of order")
            return [([(0, 0), (1, 0), (1, 1), (0, 1)], "x", 0.5)]

    return Failing


def test_calls_of_all_tasks_stay_under_a_bound(spark, tmp_path):
    folder, engine = str(tmp_path), engines()
    calls = lambda: sum(f.startswith("call-") for f in os.listdir(folder))
    shared = Breaker(f"{folder}/marks", 3, 3600.0, 0.0)
    got = plugins.recognised(pictures(spark, 400, 8), make=lambda: engine(folder), breaker=shared).collect()
    assert len(got) == 400 and all(r.failed and r.box_idx == -1 for r in got)
    assert 3 <= calls() <= 3 + 8 - 1 and sum(not r.given_up for r in got) == calls()
    # the engine is well again, and the rest is over: one try, then all
    open(f"{folder}/well", "w").close()
    again = Breaker(f"{folder}/marks", 3, 0.5, 0.0)
    time.sleep(0.6)
    got = plugins.recognised(pictures(spark, 40, 1), make=lambda: engine(folder), breaker=again).collect()
    assert not any(r.failed for r in got) and again.state() == "closed"


def test_a_good_engine_is_left_alone(spark, tmp_path):
    folder, engine = str(tmp_path), engines()
    open(f"{folder}/well", "w").close()
    got = plugins.recognised(pictures(spark, 60, 4), make=lambda: engine(folder), breaker=Breaker(f"{tmp_path}/marks")).collect()
    assert len(got) == 60 and not any(r.failed or r.given_up for r in got) and not os.path.exists(f"{tmp_path}/marks")
