"""Path model: recovery of known parameters, fit indices, bootstrap, CV."""

import math

import numpy as np

from textdrift.operators import pathmodel as pm


def _exact_sigma():
    obs = pm.BASE_MODEL.observed
    ram = pm._Ram(pm.BASE_MODEL, np.eye(len(obs)), obs)
    theta = np.array([0.8 if k == "A" else 0.3 for k, *_ in ram.params])
    return obs, ram, theta, ram.sigma(theta)


def test_recovers_parameters_from_exact_moments():
    obs, ram, theta, sig = _exact_sigma()
    res = pm.fit_moments(pm.BASE_MODEL, sig, 36, obs)
    assert res["converged"] and res["F"] < 1e-10
    assert np.allclose(res["theta"], theta, atol=1e-6)
    fit = res["fit"]
    assert fit["df"] == 18 and abs(fit["chi_square"]) < 1e-6 and fit["cfi"] == 1.0
    eff = {e[0]: e[2] for e in pm.effect_decomposition(res)}
    assert math.isclose(eff["indirect"], 0.8 * 0.8) and math.isclose(eff["total"], 0.8 + 0.64)


def test_chi_square_tail():
    # chi-square(2) survival is exp(-x/2)
    assert math.isclose(pm.chi2_sf(3.0, 2), math.exp(-1.5), rel_tol=1e-10)
    assert math.isclose(pm.chi2_sf(18.0, 18), 0.4557, abs_tol=1e-3)


def test_spark_fit_bootstrap_and_cv(spark):
    obs, ram, theta, sig = _exact_sigma()
    rng = np.random.default_rng(3)
    x = rng.multivariate_normal(np.zeros(len(obs)), sig, size=400)
    rows = [(f"r{i}", i % 3, *map(float, r)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, ["row_key", "Run", *obs])
    res = pm.fit_path_model(df)
    assert abs(pm.path_value(res, "SQ", "Diversity_scaled") - 0.8) < 0.15
    boot = pm.bootstrap_path_model(df, "row_key", replicates=20).toPandas()
    assert len(boot) == 20 and boot["converged"].all()
    ci = pm.bootstrap_ci(spark.createDataFrame(boot)).toPandas()
    assert (ci["ci_lower"] <= ci["mean"]).all() and (ci["mean"] <= ci["ci_upper"]).all()
    cv = pm.cross_validate(df, "row_key", k=3).toPandas()
    assert len(cv) == 3 and (cv["train_size"] + cv["test_size"] == 400).all()
    assert (cv["mae"] > 0).all()
    groups = pm.fit_by_group(df, "Run").toPandas()
    assert len(groups) == 3


# Lower triangles of the population covariances of the published
# 36-row feature table (all rows, and 12 rows per run) in the order of
# BASE_MODEL.observed, and the published results on that table.
COVARIANCE = {
    'all': [
        [1.0],
        [-0.970475112, 1.0],
        [-0.924560709, 0.941681267, 1.0],
        [-0.910982712, 0.938176527, 0.915715299, 1.0],
        [-0.944605827, 0.955706602, 0.95080359, 0.929487816, 1.0],
        [-0.907759963, 0.95321212, 0.934866694, 0.929654546, 0.931545508, 1.0],
        [-0.882750794, 0.924568592, 0.961254124, 0.928291303, 0.928188711, 0.953506578, 1.0],
        [0.961005302, -0.922953392, -0.850630383, -0.844994813, -0.884697201, -0.848500693, -0.788769695, 1.0],
    ],
    1: [
        [0.929922062],
        [-0.943478278, 1.027914083],
        [-0.795339872, 0.874056006, 0.869421701],
        [-0.869267077, 0.950880985, 0.847961704, 0.967590688],
        [-0.963032088, 1.022320569, 0.931093824, 0.984183864, 1.145817965],
        [-0.907978679, 0.980697707, 0.882305557, 0.941880403, 1.008484222, 0.97840227],
        [-0.819042424, 0.90145588, 0.904446149, 0.900914114, 0.963384898, 0.918760786, 0.981708057],
        [0.87965741, -0.870179939, -0.698114204, -0.817976283, -0.878639387, -0.835163227, -0.713614836, 0.902775725],
    ],
    2: [
        [1.093586825],
        [-0.994537744, 0.945934276],
        [-1.050085938, 0.993118615, 1.102323053],
        [-1.116682939, 1.057538286, 1.130760802, 1.298060051],
        [-1.020667822, 0.958349431, 1.050897942, 1.093937932, 1.019347889],
        [-0.872277386, 0.876518842, 0.958472833, 1.020429701, 0.904619549, 0.98087094],
        [-0.891666097, 0.861085447, 0.965616828, 1.035046615, 0.924387628, 0.905649923, 0.925344031],
        [1.022835632, -0.937404891, -0.975442817, -0.988258307, -0.945636767, -0.778960009, -0.761691057, 1.051867274],
    ],
    3: [
        [0.975459772],
        [-0.973573674, 1.02501599],
        [-0.924926654, 0.956682088, 1.014846026],
        [-0.745703362, 0.801870108, 0.757358902, 0.714902706],
        [-0.847145848, 0.888069987, 0.862600082, 0.711206287, 0.825086412],
        [-0.939522745, 1.003382304, 0.953144867, 0.823879583, 0.871026606, 1.028694215],
        [-0.936833258, 1.008164495, 1.006585209, 0.835543837, 0.897963472, 1.034831927, 1.083722498],
        [0.979800773, -0.963321088, -0.878992044, -0.735581157, -0.825739521, -0.928223594, -0.895923224, 1.041491707],
    ],
}
PUBLISHED_PATHS = {
    "all": (0.6447, 0.7209, -0.2959),
    1: (0.6116, 0.6169, -0.3532),
    2: (0.8624, 0.6989, -0.4205),
    3: (0.4701, 0.7370, -0.2263),
}


def _published(key):
    S = np.zeros((8, 8))
    for i, row in enumerate(COVARIANCE[key]):
        S[i, :i + 1] = S[:i + 1, i] = row
    return S


def test_published_table_from_a_cold_start():
    obs = pm.BASE_MODEL.observed
    for key, paths in PUBLISHED_PATHS.items():
        res = pm.fit_moments(pm.BASE_MODEL, _published(key), 36 if key == "all" else 12, obs)
        assert res["converged"]
        assert np.allclose([pm.path_value(res, y, x) for y, x in pm.KEY_PATHS], paths, atol=1e-3)
        if key == "all":
            fit = res["fit"]
            assert abs(fit["chi_square"] - 121.68) < 0.01 and fit["df"] == 18
            assert abs(fit["cfi"] - 0.8407) < 1e-4
            assert res["theta"][res["ram"].is_variance].min() > 0


def test_bootstrap_of_published_moments_varies(spark):
    obs = pm.BASE_MODEL.observed
    x = np.random.default_rng(1).multivariate_normal(np.zeros(8), _published("all"), size=36)
    df = spark.createDataFrame([(f"r{i}", *map(float, r)) for i, r in enumerate(x)], ["row_key", *obs])
    boot = pm.bootstrap_path_model(df, "row_key", replicates=12)
    ci = {r["path"]: r for r in pm.bootstrap_ci(boot).collect()}["Diversity_scaled~HighFreq_scaled"]
    assert ci["n_fits"] + ci["n_failed"] == 12 and ci["n_fits"] >= 10
    assert ci["std"] > 0.05 and ci["ci_lower"] < 1.155 and ci["ci_upper"] > 0.335


def test_a_constant_column_gives_an_unconverged_row(spark):
    obs = pm.BASE_MODEL.observed
    x = np.random.default_rng(2).multivariate_normal(np.zeros(8), _published("all"), size=60)
    rows = [(i % 2, *(float(v) if not (i % 2 and c == "HighFreq_scaled") else 1.0 for c, v in zip(obs, r)))
            for i, r in enumerate(x)]
    got = {r["key"]: r for r in pm.fit_by_group(spark.createDataFrame(rows, ["Run", *obs]), "Run").collect()}
    assert got["0"]["converged"] and not got["1"]["converged"]
    assert got["1"]["SQ~Diversity_scaled"] is None


def test_gradient_matches_differences():
    obs, ram, theta, _ = _exact_sigma()
    for i, d in enumerate(ram.derivatives(theta)):
        e = np.zeros_like(theta)
        e[i] = 1e-6
        assert np.allclose(d, (ram.sigma(theta + e) - ram.sigma(theta - e)) / 2e-6, atol=1e-7)


def test_only_models_of_the_same_variables_are_ranked(spark):
    rng = np.random.default_rng(7)
    small = [pm.PathModel({}, {"b": ["a"], "c": ["b"]}, "chain"), pm.PathModel({}, {"b": ["a"]}, "other")]
    df = spark.createDataFrame([tuple(map(float, r)) for r in rng.normal(size=(80, 3))], "a double, b double, c double")
    got = {r.model: r.best_by_aic for r in pm.compare_models(df, small).collect()}
    assert got["chain"] is not None and got["other"] is None
