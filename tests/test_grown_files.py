"""The stream of grown files: what it gives, and that a restart neither loses nor repeats any."""

import pytest

from keysnap.streaming.grown_files import changed_files, grown_files_stream, listing_of
from test_files_archive import put


class Log:
    """Keeps what each batch was given; can fail before or after it has kept it."""

    def __init__(self):
        self.batches, self.fail = {}, None

    def __call__(self, files, batch):
        rows = sorted((r.rel_path, r.previous_length, r.length) for r in files.collect())
        if self.fail == "before":
            raise RuntimeError("killed")
        assert self.batches.setdefault(batch, rows) == rows  # a repeated number has the same rows
        if self.fail == "after":
            raise RuntimeError("killed")


def run(spark, tmp_path, log):
    query = grown_files_stream(spark, [str(tmp_path / "live")], str(tmp_path / "state"), log, once=True)
    assert query.awaitTermination(120)


def test_new_grown_and_gone_files(spark, tmp_path):
    log, live = Log(), tmp_path / "live"
    put(live / "a/w.1", b"abc")
    put(live / ".b/_w.2", b"")
    run(spark, tmp_path, log)
    put(live / "a/w.1", b"abcdef")
    put(live / "c/d/w.3", b"z")
    run(spark, tmp_path, log)
    run(spark, tmp_path, log)
    (live / "a/w.1").unlink()
    put(live / "c/d/w.3", b"")
    run(spark, tmp_path, log)
    put(live / "a/w.1", b"abcdef")
    run(spark, tmp_path, log)
    assert log.batches == {
        0: [("/.b/_w.2", None, 0), ("/a/w.1", None, 3)],
        1: [("/a/w.1", 3, 6), ("/c/d/w.3", None, 1)],
        2: [],
        3: [("/c/d/w.3", 1, 0)],
        4: [("/a/w.1", None, 6)],
    }
    assert sorted(p.name for p in (tmp_path / "state/listings").iterdir()) == ["000000000003", "000000000004"]


@pytest.mark.parametrize("fail", ["before", "after"])
def test_restart_gives_the_same_batch(spark, tmp_path, fail):
    log, live = Log(), tmp_path / "live"
    put(live / "w.1", b"a")
    run(spark, tmp_path, log)
    put(live / "w.1", b"ab")
    put(live / "w.2", b"c")
    log.fail = fail
    with pytest.raises(Exception, match="killed"):
        run(spark, tmp_path, log)
    put(live / "w.1", b"abc")  # grows once more before the restart
    put(live / "w.3", b"d")
    log.fail = None
    run(spark, tmp_path, log)  # the batch again, and perhaps a new one
    run(spark, tmp_path, log)
    given = [rows for _, rows in sorted(log.batches.items()) if rows]
    assert given == [
        [("/w.1", None, 1)],
        [("/w.1", 1, 2), ("/w.2", None, 1)],
        [("/w.1", 2, 3), ("/w.3", None, 1)],
    ]


def test_an_unsealed_listing_is_taken_again_and_a_lost_one_is_an_error(spark, tmp_path):
    log, live = Log(), tmp_path / "live"
    put(live / "w.1", b"a")
    put(tmp_path / "state/listings/000000000000/part-0.parquet", b"half written")
    run(spark, tmp_path, log)
    assert log.batches == {0: [("/w.1", None, 1)]}
    seal = listing_of(str(tmp_path / "state"), 0) + "/_SUCCESS"
    (tmp_path / seal).unlink()
    with pytest.raises(Exception, match="listing of batch 0 is gone"):
        run(spark, tmp_path, log)


def test_missing_roots(spark, tmp_path):
    log = Log()
    with pytest.raises(Exception, match="live"):
        run(spark, tmp_path, log)
    query = grown_files_stream(spark, [str(tmp_path / "live")], str(tmp_path / "other"), log, once=True, on_missing="skip")
    assert query.awaitTermination(120) and log.batches == {0: []}


def test_changes_are_found_by_a_hashed_join(spark):
    now = spark.createDataFrame([("/a", 1), ("/b", 2), ("/c", 3)], "path string, length bigint")
    before = spark.createDataFrame([("/a", 1), ("/b", 1), ("/d", 9)], "path string, length bigint")
    assert sorted(map(tuple, changed_files(now, before).collect())) == [("/b", 2, 1), ("/c", 3, None)]
    assert changed_files(now.limit(0), before).isEmpty() and changed_files(now, before.limit(0)).count() == 3
