import pickle
import warnings

import numpy as np
import pytest

from stitchrank.sources import arrays

RNG = np.random.default_rng(4)
X = RNG.normal(size=(1000, 6)).astype(np.float32)
IDS = np.array([f"p{i}é" for i in range(1000)])
FEATURES = RNG.normal(size=(1000, 3))


def kept(df):
    return {r.id: (list(r.v), list(r.feat) if "feat" in df.columns else None) for r in df.collect()}


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
@pytest.mark.parametrize("ids", [IDS, IDS.astype(object), np.arange(1000)])
def test_split_reads_equal_one_read(spark, tmp_path, save, ids):
    path = str(tmp_path / "index.npz")
    save(path, pids=ids, embeddings=X, box_features=FEATURES, names=np.array(["a", "b", "c"]))
    read = lambda size: arrays.read_vector_arrays(spark, path, ["ids", "pids"], ["embeddings"], ["query_features", "box_features"], False, size)
    one, many = read(1 << 30), read(5000)
    want = {str(i): (v.tolist(), f.tolist()) for i, v, f in zip(ids, X, FEATURES)}
    assert kept(one) == kept(many) == want
    assert one.rdd.getNumPartitions() == 1
    assert (many.rdd.getNumPartitions() > 5) == (save is np.savez)
    unit = kept(arrays.read_vector_arrays(spark, path, ["pids"], ["embeddings"]))
    assert np.linalg.norm(unit[str(ids[3])][0]) == pytest.approx(1)


def test_single_arrays_and_column_order(spark, tmp_path):
    np.save(tmp_path / "x.npy", X)
    np.save(tmp_path / "f.npy", np.asfortranarray(X))
    for name in ("x", "f"):
        got = kept(arrays.read_vector_arrays(spark, str(tmp_path / f"{name}.npy"), [], [], normalize=False, range_bytes=4000))
        assert got == {str(i): (v.tolist(), None) for i, v in enumerate(X)}
    assert kept(arrays.read_vector_arrays(spark, f"file://{tmp_path}/x.npy", [], [], normalize=False)) == got


def test_what_does_not_fit_fails(spark, tmp_path):
    path = str(tmp_path / "bad.npz")
    np.savez(path, ids=IDS[:-1], v=X, flat=X.ravel(), deep=X.reshape(10, 100, 6), few=FEATURES[:5], same=np.arange(1000))
    with pytest.raises(ValueError, match="999 ids 'ids' for 1000"):
        arrays.read_vector_arrays(spark, path, ["ids"], ["v"])
    with pytest.raises(ValueError, match="two-dimensional"):
        arrays.read_vector_arrays(spark, path, ["ids"], ["flat"])
    with pytest.raises(KeyError):
        arrays.read_vector_arrays(spark, path, ["ids"], ["none"])
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert arrays.read_vector_arrays(spark, path, ["same"], ["v"], ["few"]).columns == ["id", "v"]
    assert any("ignored" in str(w.message) for w in seen)
    with pytest.raises(Exception, match="dimensions"):
        arrays.read_arrays(spark, path, ["deep"]).collect()
    with pytest.raises(Exception, match="different length"):
        arrays.read_arrays(spark, path, ["ids", "v"]).collect()


class Bad:
    def __reduce__(self):
        return print, ("ran",)


def test_objects_other_than_strings_are_refused(tmp_path):
    path = str(tmp_path / "bad.npz")
    np.savez(path, ids=np.array([Bad(), "x"], dtype=object))
    with pytest.raises(pickle.UnpicklingError):
        arrays._rows(path, arrays.members(path)["ids"], 0, 2)


def test_candidate_cache(spark, tmp_path):
    path = str(tmp_path / "candidates.npz")
    indices, scores = np.array([[2, 0], [1, 2]], np.int32), np.array([[0.9, 0.5], [0.25, -1.0]], np.float32)
    np.savez_compressed(
        path, query_ids=np.array(["q1", "q2"], dtype=object), product_ids=np.array(["a", "b", "c"], dtype=object), topk=np.array([2]), topk_indices=indices, topk_scores=scores
    )
    found, k = arrays.read_candidate_arrays(spark, path)
    assert k == 2
    assert sorted((r.query_id, r["rank"], r.product_id, round(r.score, 6)) for r in found.collect()) == [("q1", 1, "c", 0.9), ("q1", 2, "a", 0.5), ("q2", 1, "b", 0.25), ("q2", 2, "c", -1.0)]


def test_empty_arrays(spark, tmp_path):
    path = str(tmp_path / "none.npz")
    np.savez(path, ids=IDS[:0], v=X[:0])
    assert arrays.read_vector_arrays(spark, path, ["ids"], ["v"]).count() == 0
