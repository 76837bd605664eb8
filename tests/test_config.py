import pytest

from tidewake.plans import config as c


def test_folds():
    assert c.folds(5) == {"test": [0], "val": [1], "train": [2, 3, 4]}
    assert c.folds(5, [0], low_data=True) == {"test": [0], "train": [4], "val": [1, 2, 3]}
    assert c.folds(5, [2]) == {"test": [2], "val": [], "train": [0, 1, 3, 4]}
    assert c.folds(5, [2], val=[0]) == {"test": [2], "val": [0], "train": [1, 3, 4]}
    with pytest.raises(ValueError):
        c.folds(5, [2], val=[2])
    with pytest.raises(ValueError):
        c.folds(5, [0, 1], low_data=True)


def test_clusters():
    assert (c.cluster_count(3, False), c.cluster_count(6, False)) == (20, 24)
    assert c.cluster_count(3, True, 4) == 4
    assert c.cluster_count(3, False, given=7) == 7


def test_grid_order():
    assert c.expand({"b": ["x", "y"], "a": [1, 2]}) == [{"a": 1, "b": "x"}, {"a": 1, "b": "y"}, {"a": 2, "b": "x"}, {"a": 2, "b": "y"}]
    assert c.expand({}) == [{}]


def test_defaults_merge():
    run = c.with_defaults({"model": "wavelet_rf", "model_config": {"n_wavelets": 15}})
    assert run["model_config"]["n_wavelets"] == 15 and run["model_config"]["max_samples"] == 0.1
    assert run["static_acc_cutoff_freq"] == 0 and run["balance_classes"] is False and run["unsupervised"] is False
    with pytest.raises(ValueError):
        c.with_defaults({"model": "nothing"})
    with pytest.raises(ValueError, match="no model"):
        c.with_defaults({"seed": 1})


@pytest.mark.parametrize(("model", "dataset", "no", "want"), [("rf", "HAR", True, [1.6]), ("CRNN", "ladds_seals", True, [0]), ("rf", "desantis_rattlesnakes", False, [0]), ("kmeans", "HAR", False, [0, 0.1, 0.4, 1.6, 6.4]), ("wavelet_rf", "HAR", False, [0])])
def test_cutoffs(model, dataset, no, want):
    assert c.cutoffs(model, dataset, no) == want


def test_sweep_sizes():
    assert len(c.sweep("rf", "HAR", "d", "o")) == 30 and len(c.sweep("rf", "vehkaoja_dogs", "d", "o")) == 25
    assert len(c.sweep("wavelet_rf", "HAR", "d", "o")) == 12 and len(c.sweep("kmeans", "HAR", "d", "o")) == 5
    runs = c.sweep("rf", "vehkaoja_dogs", "d", "o", no_gyro=True)
    assert len(runs[0]["input_vars"]) == 6 and sum("skipped" in r for r in runs) == 5
    assert [r["seed"] for r in c.final_runs(runs[0])] == [1, 2, 3, 4]


def test_grids_hold_all_fixed_values():
    g = c.model_grid("CRNN", "HAR")
    assert g["temporal_window_samples"] == [2048] and g["downsizing_factor"] == [1024] and g["weight_decay"] == [0] and g["batch_size"] == [32] and g["gru_hidden_size"] == [64] and g["sparse_annotations"] == [True]
    assert len(c.sweep("CRNN", "HAR", "d", "o")) == 45 and len(c.sweep("CNN", "ladds_seals", "d", "o", no_cutoff=True)) == 9
    assert c.model_grid("CNN", "ladds_seals")["temporal_window_samples"] == [128] and c.model_grid("CNN", "HAR")["gru_depth"] == [0]
    g = c.model_grid("wavelet_dt", "HAR")
    assert g["context_window_sec"] == [8] and g["feature_set"] == ["wavelet"] and g["C_max"] == [1, 10, 100, 1000] and "n_jobs" not in g
    assert len(c.sweep("wavelet_RNN", "HAR", "d", "o")) == 36 and len(c.sweep("RNN", "HAR", "d", "o")) == 15 and len(c.sweep("harnet", "HAR", "d", "o")) == 3
    assert c.model_grid("harnet_random", "desantis_rattlesnakes") | {} and c.model_grid("harnet_random", "desantis_rattlesnakes")["harnet_version"] == ["harnet5"]
    assert c.sweep("rf", "HAR", "d", "o")[3]["experiment_name"] == "rf_hyperparameter_selection_3"


def test_defaults_have_the_public_names():
    assert c.DEFAULTS["hmm"]["matrix_concentration"] == 1.1 and c.DEFAULTS["svm"]["regularization_parameter"] == 1.0
    assert {"temporal_window_samples", "dilation", "dropout", "sparse_annotations"} <= set(c.DEFAULTS["CRNN"]) and "learning_rate" in c.DEFAULTS["vame"]
    assert all("wavelet_transform" in c.DEFAULTS[m] for m in ("rf", "dt", "svm", "kmeans", "hmm", "CRNN"))
    run = c.with_defaults({"model": "hmm", "model_config": {"covariance": "full"}})
    assert run["model_config"]["covariance"] == "full" and len(run["model_config"]) == len(c.DEFAULTS["hmm"])


def test_ablations():
    runs = c.ablations()
    assert len(runs) == 9 * (12 + 1 + 2) and runs[0]["experiment_name"] == "baglione_crows_CRNN_nogyr" and runs[9]["experiment_name"] == "baglione_crows_CRNN_low_data_nogyr"
    assert {(r["model"], r["no_cutoff"], r["low_data"], r["no_gyro"]) for r in runs if r["model"] == "wavelet_RNN"} == {("wavelet_RNN", False, True, True)}
    assert runs[-1]["experiment_name"] == "desantis_rattlesnakes_rf_low_data" and not runs[-1]["no_gyro"]


def test_metadata_channels_and_superset_map():
    m = c.Metadata.of({"dataset_name": "d", "sr": 5, "clip_column_names": ["AccX", "AccY", "AccZ", "Depth", "individual_id", "label"], "label_names": ["unknown", "a"], "clip_ids": ["p"], "clip_id_to_individual_id": {"p": 1, "q": 2}, "clip_ids_per_fold": {0: ["p"]}, "surplus": 1})
    assert m.channels(["Depth", "AccX"]) == ["AccX", "Depth"] and m.channels() == ["AccX", "AccY", "AccZ", "Depth"]
    assert m.clip_rows() == [("p", 1, 0)] and m.unknown == 0 and m.known == [1] and len(m.schema()) == 6
