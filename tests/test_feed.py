"""Two-sided verification of streams: state, timers, restarts."""

import random
from collections import Counter

import pytest

from tallyframe.plans import diff
from tallyframe.streaming import feed

SCHEMA = "_file string, _rec bigint, A string, B string"


import time


class Folders:
    """Two folders of Parquet parts that come one by one."""

    def __init__(self, spark, root):
        self.spark, self.root, self.n = spark, root, 0
        for side in "pe":
            (root / side).mkdir()

    def put(self, side, rows):
        self.n += 1
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(self.root / side))

    def stream(self, side):
        return self.spark.readStream.schema(SCHEMA).parquet(str(self.root / side))

    def run(self, wait, settle=True):
        q = feed.verify_stream(self.stream("p"), self.stream("e"), ["A", "B"], str(self.root / "out"), str(self.root / "cp"), wait, block=8, every="0 seconds", tick=0.3)
        if settle:
            feed.until_settled(q, 120)
        else:
            try:
                self.read_all(q)
            finally:
                q.stop()

    def settle(self, wait):
        """Let all that waits time out; after a restart Spark makes batches from the first new record on, so there is one, in a file of its own."""
        for side in "pe":
            self.put(side, [("z", self.n // 2, "1", "x")])
        self.run(wait)

    def read_all(self, q):
        last, idle = -1, 0
        for _ in range(1200):
            p = q.lastProgress
            if p and p["batchId"] != last:
                last, idle = p["batchId"], idle + 1 if p["numInputRows"] == 0 else 0
                if idle == 2:  # the first of a restart may be an old, empty one
                    return
            time.sleep(0.1)
        raise TimeoutError

    def events(self, settled=False):
        df = feed.settled(self.spark, str(self.root / "out"), ["A", "B"]) if settled else self.spark.read.schema(feed.FEED).parquet(str(self.root / "out"))
        return Counter((r._file, r.record, r.event, r.side, r.message) for r in df.collect() if r._file != "z")


@pytest.fixture
def folders(spark, tmp_path):
    return Folders(spark, tmp_path)


def batch(spark, p, e):
    """The same by one join, of rows that are once in each side."""
    out = diff.outcomes(spark.createDataFrame(p, SCHEMA), spark.createDataFrame(e, SCHEMA), ["A", "B"], keys=("_file", "_rec"))
    side = {(True, False): "produced", (False, True): "expected"}
    return Counter((r._file, r.record, r.event, side.get((r.p_here, r.e_here)), r.message) for r in out.select("_file", "record", "p_here", "e_here", diff.event_of().alias("event"), diff.message_of().alias("message")).collect())


def test_records_and_a_file_that_never_come(spark, folders):
    expected = [("a", i, str(i), "x") for i in range(3)] + [("b", i, str(i), "x") for i in range(2)]
    folders.put("e", expected)
    folders.put("p", expected[:3])
    folders.run(0.5)
    assert folders.events() == Counter({**{("a", i, "match", None, ""): 1 for i in range(3)}, **{("b", i, "length_mismatch", "expected", "_record"): 1 for i in range(2)}})
    got = feed.summary(spark.read.schema(feed.FEED).parquet(str(folders.root / "out"))).first()
    assert tuple(got) == (5, 3, 2, 2, 0)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_gives_the_batch_feed(spark, folders, seed):
    r = random.Random(seed)
    p = [(f, i, r.choice(["1.0", "2", None]), "x") for f in "ab" for i in range(30) if r.random() < 0.85]
    e = [(f, i, r.choice(["1", "2", None]), r.choice("xxxy")) for f in "abc" for i in range(25) if r.random() < 0.85]
    arrivals = [("p", row) for row in p] + [("e", row) for row in e] + [("p", row) for row in p if r.random() < 0.2] + [("e", row) for row in e if r.random() < 0.2]  # some come again
    r.shuffle(arrivals)
    for k in range(4):  # in four waves, restarted from the checkpoint between them
        wave = arrivals[k::4]
        for side in "pe":
            if rows := [row for s, row in wave if s == side]:
                folders.put(side, rows)
        folders.run(3600, settle=False)
    folders.settle(1)
    assert folders.events() == batch(spark, p, e)


def test_unlike_rows_of_one_number_are_surplus(spark, folders):
    folders.put("e", [("a", 1, "1", "x")])
    folders.put("p", [("a", 1, "1", "x")])
    folders.run(3600, settle=False)
    folders.put("p", [("a", 1, "1", "x"), ("a", 1, "2", "x")])
    folders.run(3600, settle=False)
    folders.settle(0.5)
    assert folders.events() == Counter({("a", 1, "match", None, ""): 1, ("a", 1, "length_mismatch", "produced", "_record"): 1})


def test_late_records_are_settled(spark, folders):
    folders.put("e", [("a", 1, "1", "x"), ("a", 2, "5", "x"), ("a", 3, "5", "x")])
    folders.run(0.2)
    folders.put("p", [("a", 1, "1.00", "x"), ("a", 2, "6", "x")])
    folders.run(0.2)
    assert sum(n for (_, _, event, *_), n in folders.events().items() if event == "length_mismatch") == 5
    assert folders.events(settled=True) == Counter({("a", 1, "match", None, ""): 1, ("a", 2, "drift", None, "A"): 1, ("a", 3, "length_mismatch", "expected", "_record"): 1})


def test_a_file_cut_short_is_told_at_its_end(spark, tmp_path):
    expected = spark.createDataFrame([("a", i, str(i), "x") for i in range(5)] + [("b", 0, "0", "x")], SCHEMA)
    (tmp_path / "in").mkdir()
    expected.where("_file = 'a' AND _rec < 3").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    feed.compare_stream(stream, expected, ["A"], str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert {x.event: x["count"] for x in feed.totals(spark, str(tmp_path / "out")).collect()} == {"match": 3, "length_mismatch": 2}
    arrived = spark.read.schema(SCHEMA).parquet(str(tmp_path / "in"))
    assert [tuple(x) for x in feed.missing_files(expected, arrived).collect()] == [("b", 1)]
