"""Missing and large whole numbers through the sorted fold and the run mapper."""

from trackspark.operators import folds, relations

BIG = (1 << 60) + 1


def test_fold_keeps_large_ids_beside_missing_ones(spark):
    df = spark.createDataFrame([(1, 1, BIG), (1, 2, None), (1, 3, BIG + 2), (None, 4, 7), (None, 5, None)], "k long, at long, id long")
    out = folds.fold_sorted(df, ["k"], ["at"], lambda: [0], lambda s, row: (s.__setitem__(0, s[0] + 1) or (row[0], row[1], s[0]),), lambda s: ((None, None, s[0]),),
                            "k long, at long, id long, n long")
    rows = sorted(map(tuple, out.collect()), key=str)
    assert rows == sorted([(1, 1, BIG, 1), (1, 2, None, 2), (1, 3, BIG + 2, 3), (1, None, None, 3), (None, 4, 7, 1), (None, 5, None, 2), (None, None, None, 2)], key=str)


def test_run_mapper_keeps_large_ids_beside_missing_ones(spark):
    df = spark.createDataFrame([(i % 3 if i % 3 else None, i, BIG + i if i % 4 else None, i % 5 == 0 or None) for i in range(40)], "k long, at long, id long, flag boolean")
    out = folds.map_runs(df, ["k"], ["at"], lambda: lambda pdf: pdf.assign(n=range(len(pdf))), "k long, at long, id long, flag boolean, n long")
    assert sorted(out.drop("n").collect(), key=lambda r: r.at) == sorted(df.collect(), key=lambda r: r.at)
    tracked = folds.annotate_frames(df, ["k"], "at", ["id"], ["id"], lambda: [0], lambda s, at, rows: [s.__setitem__(0, s[0] + 1) or s[0] for _ in rows], "n")
    assert sorted((r.at, r.id, r.n) for r in tracked.collect() if r.k is None) == [(i, BIG + i if i % 4 else None, i // 3 + 1) for i in range(0, 40, 3)]
    assert {r.at: r.id for r in tracked.collect()} == {r.at: r.id for r in df.collect()}


def test_clusters_with_missing_actors_beside_large_ids(spark):
    e = spark.createDataFrame([(1, 1.0, BIG, None, None, 0.5), (1, 2.0, BIG + 1, None, None, 0.6), (1, 3.0, BIG + 2, 9, None, 0.1), (1, 4.0, BIG + 3, 9, None, 0.7)],
                              "job_id long, sec double, event_id long, actor_uid long, object_uid long, confidence double")
    assert sorted(r.event_id for r in relations.clusters(e, "job_id").collect()) == [BIG, BIG + 1, BIG + 3]


def test_lists_of_a_fold_stay_lists(spark):
    df = spark.createDataFrame([(1, 1, [BIG, None], [True]), (1, 2, None, []), (2, 1, [], [False, True])], "k long, at long, ids array<long>, flags array<boolean>")
    out = folds.fold_sorted(df, ["k"], ["at"], list, lambda s, row: ((repr(row),),), lambda s: (), "k long, seen string")
    assert sorted(r.seen for r in out.collect()) == sorted(map(repr, [(1, [BIG, None], [True]), (2, None, []), (1, [], [False, True])]))


def test_annotated_frames_keep_columns_that_are_not_read(spark):
    """Frames that lie over several Arrow batches are seen whole, and columns of any kind pass unread."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(100).selectExpr("id % 3 AS k", "id div 30 AS at", "id", "named_struct('a', id, 'b', array(id)) AS more", "IF(id % 2 = 0, NULL, id) AS odd")
        got = folds.annotate_frames(df, ["k"], "at", ["id"], ["id"], list, lambda s, at, rows: [len(rows)] * len(rows), "n").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.id, r.more.a, r.more.b, r.odd) for r in got) == [(i, i, [i], None if i % 2 == 0 else i) for i in range(100)]
    sizes = {(k, at): sum(i % 3 == k and i // 30 == at for i in range(100)) for k in range(3) for at in range(4)}
    assert all(r.n == sizes[r.k, r.at] for r in got)


def test_videos_are_dealt_before_they_are_played(spark):
    from trackspark.plans import scenes

    cast = spark.range(20_000).coalesce(1).selectExpr("id AS video_id", "CAST(id % 7 AS int) AS scene")
    boxes, ticks, _ = scenes.staged(spark, cast, scenes.CORE)
    assert boxes.rdd.getNumPartitions() == ticks.rdd.getNumPartitions() == max(spark.sparkContext.defaultParallelism, 4)
