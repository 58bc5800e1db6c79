import random

import pytest

from gaugeflow.operators import copies, late
from gaugeflow.streaming import seen

from .helpers import BRONZE, at, micros, reading, rows


def brute(data):
    """Groups of copies by union-find over both identifiers."""
    parent = {r[0]: r[0] for r in data}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = {}
    for r in data:
        keys = []
        if None not in (r[8], r[9], r[10]):
            keys.append(("p", *r[8:11]))
        if r[1] is not None and r[2] is not None:
            keys.append(("m", r[1], r[2]))
        for k in keys:
            if k in ids:
                parent[find(ids[k])] = find(r[0])
            ids[k] = r[0]
    groups = {}
    for r in data:
        groups.setdefault(find(r[0]), []).append(r)
    return list(groups.values())


def removed(data):
    lowest = (at(-1e6), -1)
    rank = lambda r: (r[12] or lowest[0], lowest[1] if r[10] is None else r[10], r[0])
    return sorted(r[0] for g in brute(data) for r in g if r is not max(g, key=rank))


def random_rows(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        kind = r.random()
        m, t = f"M-{r.randint(1, 4)}", r.choice([None, *range(0, 600, 7)]) if r.random() < 0.1 else r.randint(0, 400)
        out.append(reading(i, None if kind < 0.05 else m, t, offset=None if kind > 0.97 else r.randint(0, n), kafka=None if kind < 0.1 else at(t or 0), ingest=at((t or 0) + r.choice([0, 1, 5, 300, 700]))))
    return out


def stream(spark, folder, data, parts=1, **kw):
    step = -(-len(data) // parts) if data else 1
    for k in range(parts):
        spark.createDataFrame(data[k * step : (k + 1) * step], BRONZE).coalesce(1).write.mode("append").parquet(folder)
    return copies.copies(seen.run_seen_links(spark, folder, **{"batches": 3, "files_per_batch": 2, **kw})).where("not stays")


@pytest.mark.parametrize("seed", [1, 2])
def test_against_union_find(spark, tmp_path, seed):
    data = random_rows(300, seed)
    assert sorted(r[0] for r in rows(stream(spark, str(tmp_path / "b"), data), "row_id")) == removed(data)


@pytest.mark.parametrize("forget", ["1 day", "1 second"])
def test_expired_state_is_backed_by_the_archive(spark, tmp_path, forget):
    """Identifiers expire by event time; late ones are looked up, and blocks opened again after their marker is gone."""
    data = random_rows(200, 5)
    data += [(10_000 + i, *r[1:12], at(600 + i)) for i, r in enumerate(data[:40])]
    folder = str(tmp_path / "b")
    spark.createDataFrame(data, BRONZE).coalesce(1).write.parquet(folder)
    output = seen.run_seen_links(spark, folder, watermark="1 minute", batches=8, files_per_batch=1, forget=forget, block_offsets=8)
    tags = {r["tag"]: r["count"] for r in output.groupBy("tag").count().collect()}
    assert tags[seen.ARCHIVE] > 0 and tags[seen.LATE] > 0 and tags[seen.OPEN] > 0
    assert seen.reopened(output).isEmpty() == (forget == "1 day")
    assert sorted(r[0] for r in rows(copies.copies(output).where("not stays"), "row_id")) == removed(data)


def test_rows_older_than_the_watermark_are_not_dropped(spark, tmp_path):
    data = [reading(i, minute=i * 30.0) for i in range(20)]
    data += [reading(100 + i, minute=i * 30.0, offset=i, kafka=at(i * 30.0), ingest=at(2000 + i)) for i in range(20)]
    folder = str(tmp_path / "b")
    spark.createDataFrame(data, BRONZE).write.parquet(folder)
    output = seen.run_seen_links(spark, folder, watermark="1 minute", batches=8, files_per_batch=1)
    assert sorted(r[0] for r in rows(copies.copies(output).where("not stays"), "row_id")) == list(range(20))


def test_third_row_joins_and_latest_stays(spark, tmp_path):
    data = [reading(1, minute=0, offset=7), reading(2, minute=0, offset=8, ingest=at(9)), reading(3, None, None, ts=None, offset=8, ingest=at(5)), reading(4, minute=3)]
    assert rows(stream(spark, str(tmp_path / "b"), data), "row_id") == [(1,), (3,)]


def test_one_group_of_many_and_empty(spark, tmp_path):
    data = [reading(i, minute=0, offset=i, ingest=at(i)) for i in range(150)]
    assert stream(spark, str(tmp_path / "b"), data).count() == 149
    spark.createDataFrame([], BRONZE).write.parquet(str(tmp_path / "e"))
    assert copies.copies(seen.run_seen_links(spark, str(tmp_path / "e"))).count() == 0


def outcomes(data):
    hour, want = 3_600_000_000, set()
    for g in brute(data):
        arrivals = [micros(r[11] or r[12]) for r in g]
        for m, t in {(r[1], micros(r[2])) for r in g if r[1] is not None and r[2] is not None}:
            w = t // hour * hour
            if min(arrivals) >= w + 7 * hour:
                want.add((m, w, "cut_off"))
            elif min(arrivals) >= w + hour + 120_000_000:
                want.add((m, w, "corrected"))
    return sorted(want, key=str)


@pytest.mark.parametrize("seed", [3, 4])
def test_late_outcomes_with_mixed_places(spark, seed):
    data = random_rows(250, seed)
    messages = late.message_readings(spark.createDataFrame(data, BRONZE))
    assert rows(late.late_outcomes(late.kslack_stages(messages))) == outcomes(data)


def test_late_bounds_are_inclusive(spark):
    data = [reading(1, minute=10, kafka=at(62)), reading(2, minute=20, kafka=at(61.99)), reading(3, minute=70, kafka=at(480)), reading(4, minute=80, kafka=at(479.9))]
    messages = late.message_readings(spark.createDataFrame(data, BRONZE))
    assert rows(late.late_outcomes(late.kslack_stages(messages))) == [("M-000001", micros(at(0)), "corrected"), ("M-000001", micros(at(60)), "corrected"), ("M-000001", micros(at(60)), "cut_off")]


def test_slices_give_the_same_windows(spark):
    data = [reading(i, minute=i * 0.7, temp=None if i % 9 == 0 else 40.0 + (i * 37 % 11), kafka=at(i * 0.7 + (i % 5) * 70)) for i in range(300)]
    messages = late.message_readings(spark.createDataFrame(data, BRONZE))
    whole, cut = late.kslack_windows(messages), late.kslack_windows(messages, target_rows=20)
    near = lambda df: [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows(df)]
    assert near(whole) == near(cut)


def test_order_sensitive_aggregate(spark):
    data = [reading(1, minute=0, temp=10.0), reading(2, minute=30, temp=30.0), reading(3, minute=40, temp=30.0)]
    (r,) = late.kslack_windows(late.message_readings(spark.createDataFrame(data, BRONZE))).collect()
    assert r["weighted_mean"] == pytest.approx((30 * 20 + 10 * 30) / 40)
    assert (r["first_temp"], r["last_temp"], r["longest_gap_us"], r["n_final"]) == (10.0, 30.0, 30 * 60_000_000, 3)
