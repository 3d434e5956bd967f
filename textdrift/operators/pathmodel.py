"""Path models with latent variables, fitted by maximum likelihood on
moments (M9-M16, A21-A25, L6, L7).

Spark computes the sufficient statistics in one aggregation each: the
covariance matrix of the whole table, of every run (``groupBy``), of every
bootstrap replicate (Poisson weights, one shuffle for all replicates) and of
every fold.  Fits run on p x p matrices: on the driver for one matrix, in
``mapInPandas`` (one fit per row of sums) for many.  No row-level data
reaches Python.

Model conventions: RAM notation, first loading of each latent fixed to 1,
variances and covariances of exogenous observed variables fixed to their
sample values, exogenous latents uncorrelated with exogenous observed
variables unless ``free_exogenous_cov``; ML discrepancy
``F = log|Sigma| + tr(S Sigma^-1) - log|S| - p`` with the population
covariance S, chi-square ``n F``; standard errors from the expected
information ``n/2 tr(Sigma^-1 dSigma Sigma^-1 dSigma)``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textdrift.operators.corpus import bootstrap_weights, kfold


@dataclass
class PathModel:
    """``measurement``: latent -> indicators; ``structural``: outcome ->
    predictors (observed or latent)."""
    measurement: dict
    structural: dict
    name: str = "model"
    free_exogenous_cov: bool = False
    observed_order: list = field(default_factory=list)

    @property
    def latents(self) -> list[str]:
        return list(self.measurement)

    @property
    def observed(self) -> list[str]:
        seen = list(self.observed_order)
        for ind in self.measurement.values():
            seen += [v for v in ind if v not in seen]
        for y, xs in self.structural.items():
            for v in [y, *xs]:
                if v not in self.measurement and v not in seen:
                    seen.append(v)
        return seen


# The four model specifications (two latents: generation
# quality GQ and semantic quality SQ).
_MEAS = {"GQ": ["Perplexity_scaled", "Entropy_scaled"],
         "SQ": ["Rouge_1_scaled", "Rouge_2_scaled", "Rouge_L_scaled", "METEOR_scaled"]}
BASE_MODEL = PathModel(_MEAS, {"Diversity_scaled": ["HighFreq_scaled", "GQ"],
                               "SQ": ["Diversity_scaled", "HighFreq_scaled"]}, "base_model")
ALT_MODEL_1 = PathModel(_MEAS, {"Diversity_scaled": ["HighFreq_scaled", "GQ"],
                                "SQ": ["Diversity_scaled"]}, "alt_model_1")
ALT_MODEL_2 = PathModel(_MEAS, {"Diversity_scaled": ["HighFreq_scaled"],
                                "SQ": ["Diversity_scaled", "HighFreq_scaled", "GQ"]}, "alt_model_2")
NONLINEAR_MODEL = PathModel(_MEAS, {"Diversity_scaled": ["HighFreq_scaled", "HighFreq_sq", "GQ"],
                                    "SQ": ["Diversity_scaled", "HighFreq_scaled"]},
                            "nonlinear_model")
MODELS = [BASE_MODEL, ALT_MODEL_1, ALT_MODEL_2, NONLINEAR_MODEL]
KEY_PATHS = [("Diversity_scaled", "HighFreq_scaled"), ("SQ", "Diversity_scaled"),
             ("SQ", "HighFreq_scaled")]


# ---------------------------------------------------------------------------
# Numerical core (p x p matrices only)
# ---------------------------------------------------------------------------

class _Ram:
    def __init__(self, model: PathModel, S: np.ndarray, obs: list[str]):
        self.model = model
        self.obs, self.lat = obs, model.latents
        names = obs + self.lat
        self.idx = {v: i for i, v in enumerate(names)}
        m, p = len(names), len(obs)
        self.m, self.p = m, p
        endo = set(model.structural) | {i for ind in model.measurement.values() for i in ind}
        preds = {x for xs in model.structural.values() for x in xs}
        exo_obs = [v for v in obs if v not in endo and v in preds]
        exo_lat = [v for v in self.lat if v not in endo]
        self.params = []       # (kind, row, col, label)
        self.fixed_A = np.zeros((m, m))
        self.fixed_S = np.zeros((m, m))
        for lat, inds in model.measurement.items():
            self.fixed_A[self.idx[inds[0]], self.idx[lat]] = 1.0
            for ind in inds[1:]:
                self.params.append(("A", self.idx[ind], self.idx[lat], (ind, "~", lat)))
        for y, xs in model.structural.items():
            for x in xs:
                self.params.append(("A", self.idx[y], self.idx[x], (y, "~", x)))
        for v in names:
            i = self.idx[v]
            if v in exo_obs:
                continue
            self.params.append(("S", i, i, (v, "~~", v)))
        for a in exo_obs:
            for b in exo_obs:
                self.fixed_S[self.idx[a], self.idx[b]] = S[obs.index(a), obs.index(b)]
        if model.free_exogenous_cov:
            for a in exo_lat:
                for b in exo_obs:
                    self.params.append(("S", self.idx[a], self.idx[b], (a, "~~", b)))
        self.F = np.zeros((p, m))
        self.F[np.arange(p), np.arange(p)] = 1.0
        # moments of exogenous observed variables are taken from the data:
        # they are not free parameters but they do use degrees of freedom
        self.n_exo = len(exo_obs) * (len(exo_obs) + 1) // 2

    def sigma(self, theta: np.ndarray) -> np.ndarray:
        A, S = self._matrices(theta)
        inv = np.linalg.inv(np.eye(self.m) - A)
        return self.F @ inv @ S @ inv.T @ self.F.T

    def _matrices(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        A, S = self.fixed_A.copy(), self.fixed_S.copy()
        for t, (kind, r, c, _) in zip(theta, self.params):
            if kind == "A":
                A[r, c] = t
            else:
                S[r, c] = S[c, r] = t
        return A, S

    def derivatives(self, theta: np.ndarray) -> list[np.ndarray]:
        """d Sigma / d theta_i of every parameter, in closed form."""
        A, S = self._matrices(theta)
        B = np.linalg.inv(np.eye(self.m) - A)
        G = self.F @ B                  # p x m
        W = B @ S @ G.T                 # m x p: covariance of all with observed
        out = []
        for kind, r, c, _ in self.params:
            d = np.outer(G[:, r], W[c]) if kind == "A" else np.outer(G[:, r], G[:, c])
            out.append(d if kind == "S" and r == c else d + d.T)
        return out

    @property
    def is_variance(self) -> np.ndarray:
        return np.array([kind == "S" and r == c for kind, r, c, _ in self.params])

    def starts(self, S: np.ndarray) -> list[np.ndarray]:
        """Start values from the data.  A latent takes a share of its first
        indicator's variance; loadings are ratios of covariances to it, the
        structural part is least squares with the first indicator standing for
        its latent.  Several shares give several starts."""
        place = {v: i for i, v in enumerate(self.obs)}
        out = []
        for share in (0.9, 0.6, 0.3):
            first = {lat: place[ind[0]] for lat, ind in self.model.measurement.items()}
            proxy = {**place, **first}
            cov = lambda a, b: S[proxy[a], proxy[b]] * (share if a == b and a in first else 1.0)
            load = {(ind, lat): S[place[ind], first[lat]] / (share * S[first[lat], first[lat]])
                    for lat, inds in self.model.measurement.items() for ind in inds}
            slope, rest = {}, {v: cov(v, v) for v in [*self.obs, *first]}
            for (ind, lat), w in load.items():
                rest[ind] = S[place[ind], place[ind]] - w * w * share * S[first[lat], first[lat]]
            for y, xs in self.model.structural.items():
                between = np.array([[cov(a, b) for b in xs] for a in xs])
                against = np.array([cov(x, y) for x in xs])
                w = np.linalg.lstsq(between, against, rcond=None)[0]
                slope.update({(y, x): float(b) for x, b in zip(xs, w)})
                rest[y] = cov(y, y) - float(w @ against)
            theta = []
            for kind, r, c, (lval, _, rval) in self.params:
                if kind == "A":
                    theta.append(load.get((lval, rval), slope.get((lval, rval), 0.0)))
                elif r == c:
                    theta.append(max(rest[lval], 0.1 * cov(lval, lval)))
                else:
                    theta.append(0.0)
            out.append(np.array(theta))
        return out


def _discrepancy(Sig: np.ndarray, S: np.ndarray) -> float:
    # positive definite only (an indefinite matrix can have a positive
    # determinant); the Cholesky factor also gives the log-determinant
    try:
        L = np.linalg.cholesky(Sig)
    except np.linalg.LinAlgError:
        return np.inf
    d = np.diag(L)
    if d.min() ** 2 < 1e-12 * d.max() ** 2:   # numerically singular
        return np.inf
    logdet = 2.0 * np.sum(np.log(d))
    return logdet + np.trace(S @ np.linalg.inv(Sig)) - np.linalg.slogdet(S)[1] - S.shape[0]


def _info(Sig: np.ndarray, d: list[np.ndarray]) -> np.ndarray:
    inv = np.linalg.inv(Sig)
    t = [inv @ di for di in d]
    return np.array([[np.sum(a * b.T) for b in t] for a in t])


MAX_ITER = 500


def _descend(ram: _Ram, S: np.ndarray, theta: np.ndarray, max_iter: int,
             tol: float) -> tuple[np.ndarray, float, bool]:
    """BFGS with variances on the log scale, started from the Fisher
    information.  Returns the estimates, the discrepancy and whether it
    converged: a positive definite Sigma and a gradient so small that a whole
    scoring step would lower the discrepancy by less than ``tol``."""
    var = ram.is_variance
    real = lambda x: np.where(var, np.exp(np.where(var, x, 0.0)), x)
    x = np.where(var, np.log(np.where(var, theta, 1.0)), theta)

    def slopes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        t = real(x)
        Sig = ram.sigma(t)
        inv = np.linalg.inv(Sig)
        d = [di * c for di, c in zip(ram.derivatives(t), np.where(var, t, 1.0))]
        resid = inv @ (Sig - S) @ inv
        return np.array([np.sum(resid * di) for di in d]), _info(Sig, d)

    f = _discrepancy(ram.sigma(real(x)), S)
    if not np.isfinite(f):
        return theta, f, False
    g, info = slopes(x)
    back = np.linalg.pinv(info + 1e-6 * np.eye(len(x)))
    for _ in range(max_iter):
        gain = 0.5 * g @ np.linalg.lstsq(info, g, rcond=None)[0]
        if gain < tol:
            return real(x), f, True
        step = -back @ g
        if g @ step >= 0:
            back = np.linalg.pinv(info + 1e-3 * np.eye(len(x)))
            step = -back @ g
        step *= min(1.0, 2.0 / max(np.max(np.abs(step)), 1e-300))
        size = 1.0
        while size > 1e-10:
            f_new = _discrepancy(ram.sigma(real(x + size * step)), S)
            if np.isfinite(f_new) and f_new <= f + 1e-4 * size * (g @ step):
                break
            size /= 2
        else:
            # no lower value can be found: converged only if the gradient is
            # as small as rounding leaves it
            return real(x), f, bool(gain < 1e-9)
        move = size * step
        x, f = x + move, f_new
        g_old, (g, info) = g, slopes(x)
        y = g - g_old
        if (c := move @ y) > 1e-14:
            left = np.eye(len(x)) - np.outer(move, y) / c
            back = left @ back @ left.T + np.outer(move, move) / c
    return real(x), f, False


def _interior(ram: _Ram, theta: np.ndarray, S: np.ndarray) -> bool:
    """No variance has run against zero."""
    return bool(np.min(theta[ram.is_variance]) > 1e-5 * np.min(np.diag(S)))


def fit_moments(model: PathModel, S: np.ndarray, n: int, obs: list[str],
                max_iter: int = MAX_ITER, tol: float = 1e-13,
                start: np.ndarray | None = None) -> dict:
    """ML fit of ``model`` to the covariance ``S`` of ``obs`` from ``n`` rows.
    Of the fits from several starts (and ``start``, if given) the one with
    the lowest discrepancy counts; converged ones without a vanishing variance
    come first.  A covariance that
    is not positive definite cannot be fitted: ``converged`` is false and the
    estimates are NaN.  Returns estimates, standard errors and fit indices."""
    ram = _Ram(model, S, obs)
    k = len(ram.params)
    best = (np.full(k, np.nan), float("nan"), False)
    se = np.full(k, np.nan)
    try:
        np.linalg.cholesky(S)
        if np.linalg.cond(S) > 1e14:
            raise np.linalg.LinAlgError("singular covariance")
        tried = []
        for theta in ([] if start is None or not np.all(np.isfinite(start)) else [np.array(start, float)]) + ram.starts(S):
            try:
                tried.append(_descend(ram, S, theta, max_iter, tol))
            except np.linalg.LinAlgError:
                continue
        if tried:
            best = min(tried, key=lambda r: (not (r[2] and _interior(ram, r[0], S)), not r[2],
                                             r[1] if np.isfinite(r[1]) else np.inf))
            info = (n / 2.0) * _info(ram.sigma(best[0]), ram.derivatives(best[0]))
            se = np.sqrt(np.clip(np.diag(np.linalg.inv(info)), 0, None))
    except np.linalg.LinAlgError:
        pass
    theta, f, converged = best
    return {"model": model, "ram": ram, "theta": theta, "se": se, "F": f, "n": n,
            "S": S, "obs": obs, "converged": converged,
            "fit": fit_indices(f, n, S, k, k + ram.n_exo)}


# --- distributions ----------------------------------------------------------

def _gammaincc(a: float, x: float) -> float:
    """Regularized upper incomplete gamma Q(a, x) (series / continued fraction)."""
    if x <= 0:
        return 1.0
    lg = math.lgamma(a)
    if x < a + 1:
        term = total = 1.0 / a
        ap = a
        for _ in range(1000):
            ap += 1
            term *= x / ap
            total += term
            if abs(term) < abs(total) * 1e-15:
                break
        return max(0.0, 1.0 - total * math.exp(-x + a * math.log(x) - lg))
    b, c, d = x + 1 - a, 1e300, 1.0 / (x + 1 - a)
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1e-300 if abs(d) < 1e-300 else d
        c = b + an / c
        c = 1e-300 if abs(c) < 1e-300 else c
        d = 1.0 / d
        delta = d * c
        h *= delta
        if abs(delta - 1) < 1e-15:
            break
    return math.exp(-x + a * math.log(x) - lg) * h


def chi2_sf(x: float, df: float) -> float:
    return _gammaincc(df / 2.0, x / 2.0) if df > 0 else float("nan")


def normal_sf2(z: float) -> float:
    """Two-sided normal tail probability."""
    return math.erfc(abs(z) / math.sqrt(2.0))


def fit_indices(f: float, n: int, S: np.ndarray, k: int, k_df: int | None = None) -> dict:
    """Chi-square, df = p(p+1)/2 - k_df, p, CFI, TLI, RMSEA (n - 1),
    AIC = chi2 + 2k, BIC = chi2 + k ln n with k the free parameters;
    baseline = independence model."""
    p = S.shape[0]
    if not math.isfinite(f):                # nothing was fitted
        nan = float("nan")
        return {"chi_square": nan, "df": p * (p + 1) / 2 - (k if k_df is None else k_df), "p_value": nan,
                "cfi": nan, "tli": nan, "rmsea": nan, "aic": nan, "bic": nan,
                "baseline_chi_square": nan, "baseline_df": p * (p - 1) / 2, "n_params": k}
    chi2 = n * f
    df = p * (p + 1) / 2 - (k if k_df is None else k_df)
    fb = float(np.sum(np.log(np.diag(S))) - np.linalg.slogdet(S)[1])
    chi2_b, df_b = n * fb, p * (p - 1) / 2
    num = max(chi2 - df, 0.0)
    den = max(chi2_b - df_b, chi2 - df, 0.0)
    cfi = 1.0 - num / den if den > 0 else 1.0
    tli = ((chi2_b / df_b) - (chi2 / df)) / ((chi2_b / df_b) - 1) if df > 0 else float("nan")
    rmsea = math.sqrt(num / (df * (n - 1))) if df > 0 and n > 1 else float("nan")
    return {"chi_square": chi2, "df": df, "p_value": chi2_sf(chi2, df), "cfi": cfi, "tli": tli,
            "rmsea": rmsea, "aic": chi2 + 2 * k, "bic": chi2 + k * math.log(n),
            "baseline_chi_square": chi2_b, "baseline_df": df_b, "n_params": k}


def parameter_rows(res: dict) -> list[tuple]:
    """Parameter table rows ``(lval, op, rval, estimate, std_err, z, p)``;
    fixed parameters have NULL statistics."""
    ram, out = res["ram"], []
    for lat, inds in res["model"].measurement.items():
        out.append((inds[0], "~", lat, 1.0, None, None, None))
    for (_, _, _, (l, op, r)), est, se in zip(ram.params, res["theta"], res["se"]):
        z = est / se if se and se > 0 else None
        out.append((l, op, r, float(est) if est == est else None, float(se) if se == se else None,
                    float(z) if z is not None else None,
                    normal_sf2(z) if z is not None else None))
    return out


def path_value(res: dict, lval: str, rval: str, op: str = "~") -> float:
    """Estimate of one parameter by (lval, op, rval)."""
    for (_, _, _, lab), est in zip(res["ram"].params, res["theta"]):
        if lab == (lval, op, rval):
            return float(est)
    return float("nan")


# ---------------------------------------------------------------------------
# Spark side: moments
# ---------------------------------------------------------------------------

def moments(df: DataFrame, cols: Sequence[str]) -> tuple[np.ndarray, int]:
    """Population covariance matrix and n over the rows in which no
    column is null, one aggregate (p x p values)."""
    c = list(cols)
    df = df.dropna(subset=c)
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, a in enumerate(c):
        for b in c[i:]:
            aggs.append(F.covar_pop(a, b).alias(f"{a}|{b}"))
    row = df.agg(*aggs).first()
    S = np.zeros((len(c), len(c)))
    for i, a in enumerate(c):
        for j, b in enumerate(c[i:], start=i):
            S[i, j] = S[j, i] = row[f"{a}|{b}"]
    return S, int(row["n"])


def fit_path_model(df: DataFrame, model: PathModel = BASE_MODEL) -> dict:
    """M9: fit on the moments of ``df``."""
    obs = model.observed
    S, n = moments(df, obs)
    return fit_moments(model, S, n, obs)


PARAM_SCHEMA = ("model string, lval string, op string, rval string, estimate double, "
                "std_err double, z_value double, p_value double")
FIT_SCHEMA = ("model string, chi_square double, df double, p_value double, cfi double, "
              "tli double, rmsea double, aic double, bic double, n_params int, n_rows long, "
              "converged boolean")


def parameters_frame(spark, res: dict) -> DataFrame:
    rows = [(res["model"].name, *r) for r in parameter_rows(res)]
    return spark.createDataFrame(rows, PARAM_SCHEMA)


def fit_frame(spark, results: Sequence[dict]) -> DataFrame:
    rows = []
    for r in results:
        f = r["fit"]
        vals = [float(f[k]) for k in ("chi_square", "df", "p_value", "cfi", "tli", "rmsea", "aic",
                                      "bic")]
        rows.append((r["model"].name, *vals, int(f["n_params"]), int(r["n"]), bool(r["converged"])))
    return spark.createDataFrame(rows, FIT_SCHEMA)


def _nested(a: PathModel, b: PathModel) -> bool:
    """One model's paths are a part of the other's, over the same variables."""
    paths = [{(y, x) for y, xs in m.structural.items() for x in xs} for m in (a, b)]
    return (set(a.observed) == set(b.observed) and a.measurement == b.measurement
            and paths[0] != paths[1] and (paths[0] <= paths[1] or paths[1] <= paths[0]))


def compare_models(df: DataFrame, models: Sequence[PathModel] = MODELS) -> DataFrame:
    """Fit indices of every model, the best converged one by AIC, and
    for models nested with the first the chi-square difference test.

    AIC compares models of the same data only, so the first model and those
    over its variables are ranked; ``best_by_aic`` is NULL for the others."""
    obs = list(dict.fromkeys(v for m in models for v in m.observed))
    S, n = moments(df, obs)
    results = []
    for m in models:
        idx = [obs.index(v) for v in m.observed]
        results.append(fit_moments(m, S[np.ix_(idx, idx)], n, m.observed))
    base = results[0]
    tests = []
    for r in results:
        ddf = abs(r["fit"]["df"] - base["fit"]["df"])
        dchi = abs(r["fit"]["chi_square"] - base["fit"]["chi_square"])
        ok = ddf > 0 and math.isfinite(dchi) and _nested(r["model"], base["model"])
        tests.append((r["model"].name, *((float(dchi), float(ddf), float(chi2_sf(dchi, ddf))) if ok else (None,) * 3)))
    spark = df.sparkSession
    fits = fit_frame(spark, results)
    ranked = F.col("model").isin([m.name for m in models if set(m.observed) == set(models[0].observed)])
    best = fits.where(F.col("converged") & ranked).agg(F.min_by("model", "aic").alias("_best"))
    test = spark.createDataFrame(tests, "model string, delta_chi_square double, delta_df double, delta_p_value double")
    return (fits.join(test, "model").crossJoin(F.broadcast(best))
            .withColumn("best_by_aic", F.when(ranked, F.coalesce(F.col("model") == F.col("_best"), F.lit(False)))).drop("_best"))


def effect_decomposition(res: dict) -> list[tuple]:
    """Direct (SQ~HighFreq), indirect (Diversity~HighFreq x
    SQ~Diversity) and total effect of HighFreq on SQ."""
    a = path_value(res, "Diversity_scaled", "HighFreq_scaled")
    b = path_value(res, "SQ", "Diversity_scaled")
    c = path_value(res, "SQ", "HighFreq_scaled")
    c = 0.0 if math.isnan(c) else c
    return [("direct", "HighFreq_scaled -> SQ", float(c)),
            ("indirect", "HighFreq_scaled -> Diversity_scaled -> SQ", float(a * b)),
            ("total", "HighFreq_scaled -> SQ", float(c + a * b))]


# ---------------------------------------------------------------------------
# Many fits: per group, per bootstrap replicate, per fold
# ---------------------------------------------------------------------------

def _sum_aggs(cols: Sequence[str], w=None):
    whole = F.lit(True)
    for c in cols:
        whole = whole & F.col(c).isNotNull()
    w = F.when(whole, F.lit(1.0) if w is None else w)   # incomplete rows count in no sum
    aggs = [F.sum(w).alias("sw")]
    aggs += [F.sum(w * F.col(c)).alias(f"s|{c}") for c in cols]
    for i, a in enumerate(cols):
        for b in cols[i:]:
            aggs.append(F.sum(w * F.col(a) * F.col(b)).alias(f"ss|{a}|{b}"))
    return aggs


def _cov_from_sums(row, cols: Sequence[str]) -> tuple[np.ndarray, float]:
    sw = float(row["sw"])
    mu = np.array([row[f"s|{c}"] / sw for c in cols])
    S = np.zeros((len(cols), len(cols)))
    for i, a in enumerate(cols):
        for j, b in enumerate(cols[i:], start=i):
            S[i, j] = S[j, i] = row[f"ss|{a}|{b}"] / sw - mu[i] * mu[j]
    return S, sw


PATH_SCHEMA = "key string, n double, converged boolean, " + ", ".join(
    f"`{y}~{x}` double" for y, x in KEY_PATHS)


def _fit_rows(model: PathModel, cols: Sequence[str], key_col: str, start=None):
    names = [c.split()[0].strip("`") for c in PATH_SCHEMA.split(", ")]

    def fn(batches):
        for pdf in batches:
            out = []
            for _, row in pdf.iterrows():
                S, n = _cov_from_sums(row, cols)
                res = fit_moments(model, S, int(round(n)), list(cols), start=start)
                ok = bool(res["converged"])
                out.append((str(row[key_col]), float(n), ok,
                            *[path_value(res, y, x) if ok else None for y, x in KEY_PATHS]))
            yield pd.DataFrame(out, columns=names)
    return fn


def _fit_each(sums: DataFrame, model: PathModel, cols: Sequence[str], start) -> DataFrame:
    """One fit per row of sums.  An explicit ``repartition(n, key)`` (which
    adaptive execution does not merge) spreads the CPU-bound fits over the
    cluster; each fit sees one row of p x p sums."""
    n = max(1, sums.sparkSession.sparkContext.defaultParallelism * 2)
    return sums.repartition(n, "key").mapInPandas(_fit_rows(model, cols, "key", start),
                                                  PATH_SCHEMA)


def fit_by_group(df: DataFrame, group: str = "Run", model: PathModel = BASE_MODEL,
                 min_rows: int = 10) -> DataFrame:
    """M13 + P12: one fit per group with more than ``min_rows`` rows; the
    sums of every group come from one aggregation, each fit runs in
    ``mapInPandas`` on one row of sums."""
    cols = model.observed
    start = fit_path_model(df, model)["theta"]
    sums = df.groupBy(group).agg(*_sum_aggs(cols)).filter(F.col("sw") > min_rows)
    sums = sums.withColumn("key", F.col(group).cast("string"))
    return _fit_each(sums, model, cols, start)


def bootstrap_path_model(df: DataFrame, id_col: str, replicates: int = 100,
                         model: PathModel = BASE_MODEL, seed: int = 0) -> DataFrame:
    """M15 + L6: Poisson-weighted replicates; all replicate moments come from
    one shuffle (``groupBy(replicate)`` over weighted sums), each replicate
    is fitted in ``mapInPandas``.  Output: one row per replicate."""
    cols = model.observed
    start = fit_path_model(df, model)["theta"]
    w = bootstrap_weights(df.select(id_col, *cols), replicates, id_col, seed)
    sums = w.groupBy("replicate").agg(*_sum_aggs(cols, F.col("weight")))
    sums = sums.withColumn("key", F.col("replicate").cast("string"))
    return _fit_each(sums, model, cols, start) \
        .withColumnRenamed("key", "replicate")


def bootstrap_ci(boot: DataFrame) -> DataFrame:
    """A23 + A25: mean, sample std, 2.5 / 97.5 percentiles per path and the
    significance flag ``|mean| > 2 std``, over the converged fits;
    ``n_fits`` counts these and ``n_failed`` the others."""
    counts = [F.sum(F.col("converged").cast("long")).alias("n_fits"),
              F.sum((~F.col("converged")).cast("long")).alias("n_failed")]
    used = lambda p: F.when(F.col("converged"), F.col(f"`{p}`"))
    paths = [f"{y}~{x}" for y, x in KEY_PATHS]
    row = boot.agg(*counts, *[F.struct(F.avg(used(p)).alias("mean"), F.stddev_samp(used(p)).alias("std"),
                                       F.percentile(used(p), 0.025).alias("ci_lower"),
                                       F.percentile(used(p), 0.975).alias("ci_upper")).alias(f"p{i}")
                              for i, p in enumerate(paths)])
    recs = [F.struct(F.lit(p).alias("path"), F.col(f"p{i}.*"), "n_fits", "n_failed") for i, p in enumerate(paths)]
    out = row.select(F.explode(F.array(*recs)).alias("r")).select("r.*")
    return out.withColumn("significant", F.abs("mean") > 2 * F.col("std"))


def cross_validate(df: DataFrame, id_col: str, k: int = 3, seed: int = 42,
                   model: PathModel = BASE_MODEL, target: str = "METEOR_scaled") -> DataFrame:
    """M14 + A22: k folds by hash; per fold, moments of the training rows are
    the totals minus the fold's sums (one aggregation for all folds); the
    model-implied covariance predicts ``target`` from the other observed
    variables of the held-out rows (target hidden); MAE per fold in Spark."""
    cols = model.observed
    folded = kfold(df, k, id_col, seed)
    sums = {r["fold"]: r for r in folded.groupBy("fold").agg(*_sum_aggs(cols)).collect()}  # k rows
    keys = [f.name for f in folded.groupBy("fold").agg(*_sum_aggs(cols)).schema
            if f.name != "fold"]
    total = {key: sum(float(r[key]) for r in sums.values()) for key in keys}
    others = [c for c in cols if c != target]
    start = fit_path_model(df, model)["theta"]
    ti, oi = cols.index(target), [cols.index(c) for c in others]
    preds, info = [], []
    for fold, r in sorted(sums.items()):
        train = {key: total[key] - float(r[key]) for key in keys}
        S, n = _cov_from_sums(train, cols)
        res = fit_moments(model, S, int(round(n)), list(cols), start=start)
        Sig = res["ram"].sigma(res["theta"])
        beta = Sig[ti, oi] @ np.linalg.inv(Sig[np.ix_(oi, oi)])
        mu = np.array([train[f"s|{c}"] / n for c in cols])
        expr = F.lit(float(mu[ti]))
        for b, c in zip(beta, others):
            expr = expr + F.lit(float(b)) * (F.col(c) - F.lit(float(mu[cols.index(c)])))
        preds.append((fold, expr))
        info.append((fold, path_value(res, *KEY_PATHS[0]), path_value(res, *KEY_PATHS[1]),
                     int(round(n)), int(round(float(r["sw"])))))
    yhat = None
    for fold, e in preds:
        yhat = F.when(F.col("fold") == fold, e) if yhat is None else yhat.when(F.col("fold") == fold, e)
    mae = folded.withColumn("_yhat", yhat).groupBy("fold").agg(
        F.avg(F.abs(F.col(target) - F.col("_yhat"))).alias("mae"))
    meta = df.sparkSession.createDataFrame(
        info, "fold int, `Diversity_scaled~HighFreq_scaled` double, "
              "`SQ~Diversity_scaled` double, train_size long, test_size long")
    return meta.join(mae, on="fold")


def findings(res: dict, ci: DataFrame) -> DataFrame:
    """Statements with their value and whether they hold."""
    eff = {e[0]: float(e[2]) for e in effect_decomposition(res)}
    cfi = float(res["fit"]["cfi"])
    spark = ci.sparkSession
    base = spark.createDataFrame(
        [("indirect effect larger than direct effect", abs(eff["indirect"]),
          bool(abs(eff["indirect"]) > abs(eff["direct"]))),
         ("total effect of HighFreq on SQ is positive", eff["total"], bool(eff["total"] > 0)),
         ("model fit acceptable (CFI >= 0.9)", cfi, bool(cfi >= 0.9))],
        "finding string, value double, holds boolean")
    boot = ci.select(F.concat(F.lit("bootstrap path significant: "), F.col("path")).alias("finding"),
                     F.col("mean").alias("value"), F.col("significant").alias("holds"))
    return base.unionByName(boot)
