"""Fold-metric files with different headers (SRC-04)."""

from foldline.sources.readers import file_headers, read_fold_metrics, scan_fold_metrics


def _write(folder, files):
    for name, text in files.items():
        (folder / name).write_text(text)


def test_headers_are_not_mixed(spark, tmp_path):
    _write(tmp_path, {
        "a_folds.csv": "framework,fold,accuracy,f1\ncat,0,0.9,0.8\ncat,1,0.7,0.6\n",
        "b_folds.csv": "fold,f1,framework,accuracy\n0,0.5,dog,0.4\n",
        "c_folds.csv": "fold,rmse\n3,1.5\n4,2.5\n",
        "d_folds.csv": "fold,rmse\n5,3.5\n",
        "e_folds.csv": "framework,fold,accuracy,f1\nx,0,0.1,0.2\ny,1,0.3,0.4\n",
        "f_folds.csv": "",
        "g_folds.csv": "model,fold,accuracy_score\nM,0,0.25\n",
        "h_folds.csv": "framework,fold,accuracy\nh,0,0.1\nh,1\nh,2,0.3,9,9\n",
    })
    got, bad = scan_fold_metrics(spark, f"{tmp_path}/*_folds.csv")
    types = dict(got.dtypes)
    assert all(types[c] in ("double", "int", "bigint") for c in ("fold", "accuracy", "f1", "rmse"))
    rows = {(r["framework"], r["fold"]): (r["accuracy"], r["f1"], r["rmse"]) for r in got.collect()}
    assert rows == {("cat", 0): (0.9, 0.8, None), ("cat", 1): (0.7, 0.6, None), ("dog", 0): (0.4, 0.5, None),
                    ("c", 3): (None, None, 1.5), ("c", 4): (None, None, 2.5), ("d", 5): (None, None, 3.5),
                    ("e", 0): (0.1, 0.2, None), ("e", 1): (0.3, 0.4, None), ("g", 0): (0.25, None, None), ("h", 0): (0.1, None, None)}
    assert sorted((r["file"].rsplit("/", 1)[1], r["rows"]) for r in bad.collect()) == [("f_folds.csv", 0), ("h_folds.csv", 2)]
    heads = {r["file"].rsplit("/", 1)[1]: r["header"] for r in file_headers(spark, f"{tmp_path}/*_folds.csv").collect()}
    assert heads["d_folds.csv"] == "fold,rmse" and len(heads) == 7


def test_leaderboard_and_no_files(spark, tmp_path):
    _write(tmp_path, {"a_folds.csv": "fold,accuracy\n0,0.5\n0,0.5\n", "board.csv": "f1,framework\n0.4,z\n"})
    got, _ = scan_fold_metrics(spark, f"{tmp_path}/*_folds.csv", leaderboard=f"{tmp_path}/board.csv")
    assert sorted((r["framework"], r["accuracy"], r["f1"]) for r in got.collect()) == [("a", 0.5, None), ("z", None, 0.4)]
    (tmp_path / "only_folds.csv").write_text("")
    assert read_fold_metrics(spark, f"{tmp_path}/only_folds.csv").count() == 0
