"""Matrices of NPY files: partitions by byte range, checks, writing."""

import numpy as np
import pytest

from lexigrove.sources import npy, tables


@pytest.fixture(autouse=True)
def known(spark):
    npy.register(spark)


def read(spark, path, **options):
    return spark.read.format("npy").options(**options).load(str(path))


@pytest.mark.parametrize("kind", ["<f4", "<f8", "<i4", ">f4"])
def test_a_file_in_partitions(spark, tmp_path, kind):
    x = (np.random.default_rng(1).normal(size=(1003, 7)) * 100).astype(kind)
    np.save(tmp_path / "m.npy", x)
    df = read(spark, tmp_path / "m.npy", rows=100)
    assert df.rdd.getNumPartitions() == 11
    got = {r["row"]: r["vector"] for r in df.collect()}
    assert sorted(got) == list(range(1003)) and np.array_equal(np.array([got[i] for i in range(1003)]), x.astype(float))
    assert tables.vector_checks(df, "vector").first().asDict() == {"vectors": 1003, "dimensions": 1, "width": 7, "unusable": 0}


def test_folders_and_empty_files(spark, tmp_path):
    for i in range(3):
        np.save(tmp_path / f"p{i}.npy", np.full((i, 4), float(i)))
    (tmp_path / "_note.npy").write_text("not read")
    assert sorted((r["file"].rsplit("/")[-1], r["row"]) for r in read(spark, f"file://{tmp_path}", expected=3).collect()) == [("p1.npy", 0), ("p2.npy", 0), ("p2.npy", 1)]
    (tmp_path / "none").mkdir()
    assert read(spark, tmp_path / "none").count() == 0


@pytest.mark.parametrize(("made", "options", "why"), [
    (lambda p: np.save(p, np.zeros(5)), {}, "shape"), (lambda p: np.save(p, np.zeros((2, 2, 2))), {}, "shape"), (lambda p: np.save(p, np.asfortranarray(np.ones((3, 2)))), {}, "column order"),
    (lambda p: np.save(p, np.array([["a"]])), {}, "matrix of numbers"), (lambda p: p.write_bytes(b"nothing here"), {}, "no NPY"), (lambda p: np.save(p, np.ones((3, 2))), {"dimension": 3}, "components"),
    (lambda p: np.save(p, np.ones((3, 2))), {"expected": 4}, "3 vectors, not 4"), (lambda p: np.save(p, np.array([[1.0, 2.0], [np.nan, 1.0]])), {}, "row 1"),
    (lambda p: (np.save(p, np.ones((3, 2))), p.write_bytes(p.read_bytes()[:-3])), {}, "bytes long"),
])
def test_checks(spark, tmp_path, made, options, why):
    path = tmp_path / "m.npy"
    made(path)
    with pytest.raises(Exception, match=why):
        read(spark, path, **options).collect()


def test_not_finite_may_be_let_through(spark, tmp_path):
    np.save(tmp_path / "m.npy", np.array([[1.0, np.inf], [np.nan, 1.0], [1.0, 2.0]]))
    assert tables.vector_checks(read(spark, tmp_path / "m.npy", finite="false"), "vector").first()["unusable"] == 2


def test_written_files_are_matrices(spark, tmp_path):
    rows = [([float(i), i / 4],) for i in range(500)]
    df = spark.createDataFrame(rows, "vector array<double>").repartition(3)
    df.write.format("npy").mode("append").save(f"{tmp_path}/out")
    files = sorted((tmp_path / "out").iterdir())
    assert len(files) == 3 and all(f.name.startswith("part-") for f in files)
    assert sorted(np.concatenate([np.load(f) for f in files]).tolist()) == [r[0] for r in rows]
    assert sorted(r["vector"] for r in read(spark, tmp_path / "out", rows=50, dimension=2, expected=500).collect()) == [r[0] for r in rows]
    for bad in ([1.0], None, [1.0, float("nan")], [1.0, None]):
        with pytest.raises(Exception, match="one size"):
            spark.createDataFrame([([1.0, 2.0],), (bad,)], "vector array<double>").coalesce(1).write.format("npy").mode("append").save(f"{tmp_path}/bad")
    assert not [f for f in (tmp_path / "bad").iterdir() if f.name.startswith("part-")]
