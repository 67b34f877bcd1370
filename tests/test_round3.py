"""What a round's findings were about, on small tables."""

import numpy as np
from pyspark.sql import functions as F

from shoebox.model import SCHEMAS
from shoebox.operators import layout, ranks, vectors
from shoebox.operators.ingest import fold_records
from shoebox.plans import queries as catalogue
from shoebox.plans import whole  # noqa: F401  adds its queries
from shoebox.sources import export


def _rows(slots: np.ndarray) -> int:
    return len(np.unique(slots[:, 1].round(6)))


def test_spread_rows_end_at_their_share():
    """Rows of a half whose share is reached but for the error of a sum; two rows had been taken."""
    aspects = np.array([2380 / 2100, 1900 / 2400, 780 / 600, 1500 / 900, 1060 / 1200, 1820 / 1500, 1380 / 1800, 1500 / 2100, 1740 / 2400])
    left = layout.spread_slots(aspects, 1400.0, 933.0, 8.0)[:5]
    assert _rows(left) == 3
    assert left[0].round(6).tolist() == [0.0, 0.0, 392.987013, 237.919798]


def test_justified_takes_the_fewest_rows_of_equal_misses():
    """One row and two miss the height by the same, but for a sum's last bit; two had been taken."""
    height = (1392.0 / (18 / 7) + 2 * 1400.0 / (9 / 7) + 8.0) / 2
    assert _rows(layout.justified_slots(np.full(2, 9 / 7), 1400.0, height, 8.0)) == 1
    aspects = np.array([2340 / 1500, 2500 / 1800, 980 / 2100, 700 / 2400, 2020 / 600, 940 / 900, 2140 / 1200, 1180 / 1500, 780 / 1800])
    assert layout.justified_slots(aspects, 1400.0, 933.0, 8.0)[0].round(6).tolist() == [0.0, 0.0, 579.02113, 296.596123]


def test_an_export_writes_what_it_reads_often_once(spark, monkeypatch, tmp_path):
    """Keys of all kinds are numbered in one pass; two exports had written 24 tables for that alone."""
    wrote = []
    own = ranks.saved

    def counted(df, name):
        wrote.append(name)
        return own(df, name)

    for m in (ranks, export):
        monkeypatch.setattr(m, "saved", counted)
    got = catalogue.QUERIES["export_twice"](spark, "/root/testdata/sf0.001")
    assert wrote.count("keys") == 4 and len(wrote) <= 14
    assert got.where("what = 'loose'").isEmpty()


def test_keys_of_each_kind_go_on_behind_the_largest_id(spark):
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    none = spark.createDataFrame([], "name string, id long")
    one = export.keyed({"a": names("y", "x", "y"), "b": names("x")}, {"a": none, "b": none})
    two = export.keyed({"a": names("w", "x"), "b": names("v", "u")}, one)
    rows = {k: {r["name"]: r["id"] for r in t.collect()} for k, t in two.items()}
    assert rows == {"a": {"x": 1, "y": 2, "w": 3}, "b": {"x": 1, "u": 2, "v": 3}}


def test_blocks_of_a_pruned_join_grow_with_the_table(spark):
    """Blocks of four had left most of 750 * 750 pairs of blocks; the edges are those of all blocks."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(3000, 4))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    d = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, embedding array<double>")
    assert vectors._met(d, 0.99, "id", "embedding", 4, 4).select("i", "j").distinct().count() < 6000
    got = {(r["a"], r["b"]) for r in vectors.sim_edges(d, 0.99, "id", block=4, count=4).collect()}
    a, b = np.nonzero(np.triu(np.round(v @ v.T, 6) >= 0.99, 1))
    assert got == set(zip(a.tolist(), b.tolist(), strict=True)) and len(got) > 100


def test_an_older_snapshot_goes_when_it_is_merged(spark, monkeypatch, tmp_path):
    """Both versions of the buckets had stayed, and the fold had been shuffled three times."""
    monkeypatch.setattr(whole, "_folder", lambda spark: f"file://{tmp_path}")
    got = catalogue.QUERIES["fold_incremental"](spark, "/root/testdata/sf0.001")
    assert not list((tmp_path / "snapshot" / "1").glob("bucket=*"))
    assert len(list((tmp_path / "snapshot" / "2").glob("bucket=*"))) == 8
    assert got.count() == got.select("name").distinct().count() > 0
    assert all("zstd" in f.name for f in tmp_path.rglob("part-*.parquet") if "meta" not in str(f))


def test_records_are_folded_in_one_shuffle(spark):
    log = spark.createDataFrame([], SCHEMAS["records"]).withColumns({"bucket": F.lit(0), "part": F.lit(0)})
    folded = fold_records(log.repartition("bucket", "part"), ("bucket", "part"))
    assert folded._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 1
