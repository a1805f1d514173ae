"""Session helpers: checkpoint folder, size checks, lineage cuts."""

from kestrel.session import bounded, ensure_checkpoint_dir, materialize


def test_checkpoint_dir_is_kept_and_used(spark):
    first = ensure_checkpoint_dir(spark)
    assert ensure_checkpoint_dir(spark) == first  # an existing setting is never replaced
    df = materialize(spark.range(10).withColumnRenamed("id", "k"))
    paths = df.inputFiles()
    assert paths and all(p.startswith(first.rstrip("/")) or first.split(":", 1)[-1] in p for p in paths)
    assert sorted(r.k for r in df.collect()) == list(range(10))


def test_bounded_is_exact_at_the_limit(spark):
    df = spark.range(100)
    assert bounded(df, 100) and not bounded(df, 99)
