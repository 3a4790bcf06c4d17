"""Queries that SQL can't state, value by value against plain numpy loops over the same table."""

import itertools

import numpy as np
import pandas as pd
import pytest

from tessitura.operators import estimation as E
from tessitura.plans import catalog

D = "/root/testdata/sf0.001"
Q = catalog.queries()
FRAMES, BINS, CH, EPS = 7, 9, 4, 1.1920929e-07
WAVE = np.stack(pd.read_parquet(f"{D}/embeddings.parquet").sort_values("vec_id")["embedding"]).astype(float).reshape(-1, CH, 64)
WINDOW = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(16) / 16)
X = np.stack([np.fft.rfft(WAVE[:, :, 8 * t : 8 * t + 16] * WINDOW) for t in range(FRAMES)], axis=2)  # utt, ch, t, f
T, F = np.meshgrid(np.arange(FRAMES), np.arange(BINS), indexing="ij")
MASK = np.abs(np.sin(1 + T + 2 * F))
UTTS = range(len(WAVE))


def cov(y, m, least=1e-6):
    """sum_t m y y^H / sum_t m of one bin. y: channels x frames."""
    return sum(m[t] * np.outer(y[:, t], y[:, t].conj()) for t in range(y.shape[1])) / max(m.sum(), least)


def top(r, n=None):
    """The principal (generalised) eigenvector, of unit noise power if there is a noise matrix."""
    if n is None:
        return np.linalg.eigh(r)[1][:, -1]
    v, u = np.linalg.eig(np.linalg.solve(n, r))
    w = u[:, np.argmax(v.real)]
    return w / np.sqrt((w.conj() @ n @ w).real)


def distortionless(r, d):
    w = np.linalg.solve(r + (1e-10 * np.trace(r).real / len(r) + 1e-15) * np.eye(len(r)), d)
    return w / (d.conj() @ w)


def wiener(rs, rn, beta):
    x = np.linalg.solve(rn, rs)
    return x[:, 0] / (beta + np.trace(x).real)


def ban(w, n):
    return w * np.sqrt((w.conj() @ n @ n @ w).real) / (w.conj() @ n @ w).real


def rank_one(r):
    v = top(r)
    return np.outer(v, v.conj()) * np.trace(r).real


WEIGHTS = {
    "bf06_mvdr": lambda s, n: distortionless(n, top(s)),
    "bf07_mpdr": lambda s, n: distortionless(s + n, top(s)),
    "bf07_mpdr_whitened": lambda s, n: distortionless(s + n, n @ top(s, n)),
    "bf08_pmwf": lambda s, n: wiener(s, n, 1.0),
    "bf08_pmwf_rank1": lambda s, n: wiener(rank_one(s), n, 0.0),
    "bf09_gevd": lambda s, n: top(s, n),
    "bf10_gevd_ban": lambda s, n: ban(top(s, n), n),
}


def got(spark, name, *keys):
    """The query's result as a table with these keys as its index, in order."""
    return Q[name](spark, D).toPandas().set_index(list(keys)).sort_index()


def grid(df, columns, shape):
    return [df[c].to_numpy().reshape(shape) for c in columns]


def close(a, b, rtol=1e-4, atol=1e-4):
    assert a.shape == b.shape
    assert np.allclose(a, b, rtol=rtol, atol=atol), np.abs(a - b).max()


@pytest.mark.parametrize("name", WEIGHTS)
def test_beamformers(spark, name):
    want = np.zeros((len(WAVE), BINS))
    for u, f in itertools.product(UTTS, range(BINS)):
        y = X[u, :, :, f]
        w = WEIGHTS[name](cov(y, MASK[:, f]), cov(y, 1 - MASK[:, f]))
        want[u, f] = (np.abs(w.conj() @ y) ** 2).sum()
    (power,) = grid(got(spark, name, "utt", "f"), ["power"], want.shape)
    close(power, want, rtol=1e-3, atol=1e-3)


def test_online_beamformer(spark):
    """Weights of each chunk of three frames from covariances that forget; where a chunk's noise matrix has full rank."""
    df = got(spark, "bf11_online_gevd", "utt", "f")
    assert len(df) == len(WAVE) * BINS and np.isfinite(df["power"]).all()
    z = got(spark, "bf11_online_mvdr", "utt", "t", "f")
    re, im = grid(z, ["re", "im"], (len(WAVE), FRAMES, BINS))
    for u, f in itertools.product(UTTS, range(BINS)):
        rs = rn = None
        for k in range(3):
            y, m = X[u, :, 3 * k : 3 * k + 3, f], MASK[3 * k : 3 * k + 3, f]
            s, n = cov(y, m), cov(y, 1 - m)
            rs, rn = (s, n) if k == 0 else (0.8 * rs + 0.2 * s, 0.8 * rn + 0.2 * n)
            if k:
                out = np.abs(distortionless(rn, top(rs)).conj() @ y)
                close(np.abs(re + 1j * im)[u, 3 * k : 3 * k + 3, f], out, rtol=1e-2, atol=1e-3)


def test_circular_super_directive_beamformer(spark):
    re, im = grid(got(spark, "bf04_super_directive_circular", "utt", "t", "f"), ["re", "im"], (len(WAVE), FRAMES, BINS))
    spots = np.array([(0, 0), *((0.05 * np.cos(2 * np.pi * k / 3), 0.05 * np.sin(2 * np.pi * k / 3)) for k in range(3))])
    far = np.linalg.norm(spots[:, None] - spots, axis=2)
    look = np.array([np.cos(np.radians(80)), np.sin(np.radians(80))])
    for f in range(BINS):
        omega = np.pi * 16000 / 8 * f
        d = np.exp(1j * omega * (spots @ look) / 343)
        w = np.linalg.solve(np.sinc(omega * far / 343) + 1e-5 * np.eye(4), d)
        w = w / (d.conj() @ w)
        close((re + 1j * im)[:, :, f], np.einsum("c,uct->ut", w.conj(), X[..., f]), rtol=1e-3, atol=1e-3)


def test_rebuilt_covariances(spark):
    df = got(spark, "la09_rebuilt", "utt", "f", "how", "at")
    z = (df["re"] + 1j * df["im"]).to_numpy().reshape(len(WAVE), BINS, 2, 4, 4)
    for u, f in itertools.product(UTTS, range(BINS)):
        r = cov(X[u, :, :, f], MASK[:, f])
        v, w = np.linalg.eigh(r / np.linalg.norm(r, 2))
        close(z[u, f, 1], sum(max(a, EPS) * np.outer(b, b.conj()) for a, b in zip(v, w.T)), atol=1e-6)
        close(z[u, f, 0] @ z[u, f, 1], np.eye(4), atol=1e-6)


def test_blockwise_and_super_directive_beamformers(spark):
    re, im = grid(got(spark, "bf13_blockwise_mvdr", "utt", "t", "f"), ["re", "im"], (len(WAVE), FRAMES, BINS))
    for u, f in itertools.product(UTTS, range(BINS)):
        y, m = X[u, :, :4, f], MASK[:4, f]
        close(np.abs(re + 1j * im)[u, :4, f], np.abs(distortionless(cov(y, 1 - m), top(cov(y, m))).conj() @ y), rtol=1e-2, atol=1e-3)
    re, im = grid(got(spark, "bf04_super_directive", "utt", "t", "f"), ["re", "im"], (len(WAVE), FRAMES, BINS))
    place = np.array([0, 0.05, 0.1, 0.15])
    for f in range(BINS):
        omega = np.pi * 16000 / 8 * f
        d = np.exp(-1j * omega * np.cos(np.pi / 3) * place / 343)
        r = np.sinc(omega * np.abs(place[:, None] - place) / 343) + 0.1 * np.eye(4)
        w = np.linalg.solve(r, d)
        w = w / (d.conj() @ w)
        close((re + 1j * im)[:, :, f], np.einsum("c,uct->ut", w.conj(), X[..., f]))


def test_wave_of_adaptive_beamformer(spark):
    x = got(spark, "bf15_adaptive_to_wave", "utt", "n")
    assert x["x"].notna().all() and len(x) % len(WAVE) == 0 and np.abs(x["x"]).max() < 100 * np.abs(WAVE).max()


def test_covariance_features(spark):
    rank = got(spark, "la07_rank_one", "utt", "f", "i", "j")
    re, im = grid(rank, ["re", "im"], (len(WAVE), BINS, CH, CH))
    (det,) = grid(got(spark, "la09_log_determinant", "utt", "f"), ["logdet"], (len(WAVE), BINS))
    (music,) = grid(got(spark, "sp12_music_ssl", "utt"), ["a"], (len(WAVE),))
    place, angle = np.array([0, 0.05, 0.1, 0.15]), np.pi * np.arange(19) / 18
    for u in UTTS:
        e = np.zeros(19)
        for f in range(BINS):
            r = cov(X[u, :, :, f], MASK[:, f])
            close((re + 1j * im)[u, f], rank_one(r))
            v = np.linalg.eigvalsh(r)
            assert abs(det[u, f] - np.log(np.maximum(v / v[-1], EPS)).sum()) < 1e-2
            s = np.exp(-1j * np.pi * 16000 / 8 * f * np.cos(angle)[:, None] * place / 343)
            p = np.eye(4) - np.outer(top(r), top(r).conj())
            e += np.einsum("ai,ij,aj->a", s.conj(), p, s).real
        assert e[music[u]] < e.min() + 1e-4
    df = got(spark, "sp04_directional_on_mask", "utt", "t", "f")["df"].to_numpy().reshape(len(WAVE), FRAMES, BINS)
    for u, f in itertools.product(UTTS, range(BINS)):
        v = np.angle(top(cov(X[u, :, :, f], MASK[:, f])))
        close(df[u, :, f], np.cos(np.angle(X[u, 0, :, f]) - np.angle(X[u, 1, :, f]) - (v[0] - v[1])))


def test_localisation(spark):
    srp = got(spark, "sp07_gcc_diagonal", "utt", "t", "d")["srp"].to_numpy().reshape(len(WAVE), FRAMES, 13)
    phase, want = np.angle(X), np.zeros((len(WAVE), FRAMES, 13))
    for i, j in ((0, 2), (1, 3)):
        tau = -np.cos(2 * np.pi * (np.arange(13) / 12 - i / 4)) * 0.1 / 343
        g = np.cos((phase[:, i] - phase[:, j])[..., None] + (np.pi * 16000 / 8 * np.arange(BINS))[:, None] * tau).mean(axis=2)
        want += np.maximum(g / np.maximum(np.abs(g).max(axis=(1, 2), keepdims=True), EPS), 0)
    close(srp, want)
    best = got(spark, "sp13_masked_ssl", "utt", "k")["a"]
    place, angle = np.array([0, 0.05, 0.1, 0.15]), np.pi * np.arange(19) / 18
    for k, m in enumerate((np.where(MASK >= 1 - MASK, MASK, 1e-4), np.where(1 - MASK >= MASK, 1 - MASK, 1e-4))):
        ll = np.zeros((len(WAVE), 19))
        for f in range(BINS):
            s = np.exp(-1j * np.pi * 16000 / 8 * f * np.cos(angle)[:, None] * place / 343)
            y = np.einsum("ac,uct->uta", s.conj(), X[..., f])
            xx = (np.abs(X[..., f]) ** 2).sum(axis=1)[..., None]
            ll += (m[:, f][None, :, None] * -np.log(np.maximum(1 - np.abs(y) ** 2 / (4 * xx + EPS), EPS))).sum(axis=1)
        for u in UTTS:
            assert ll[u, best[(u, k)]] > ll[u].max() - 1e-3


def posterior(y, r, scale, alpha, angular):
    like = []
    for k in range(len(r)):
        v, e = np.linalg.eigh((r[k] + r[k].conj().T) / 2)
        v = np.maximum(v, EPS * max(v[-1], EPS))
        q = np.array([sum(abs(e[:, c].conj() @ y[:, t]) ** 2 / v[c] for c in range(len(v))) for t in range(y.shape[1])])
        like.append(np.log(alpha[k] + EPS) - np.log(v).sum() - (len(v) * np.log(np.maximum(q, EPS)) if angular else len(v) * np.log(scale[k]) + q / scale[k]))
    like = np.exp(np.array(like) - np.max(like, axis=0))
    return like / like.sum(axis=0)


def quadratic(y, r):
    v, e = np.linalg.eigh((r + r.conj().T) / 2)
    v = np.maximum(v, EPS * max(v[-1], EPS))
    return ((np.abs(e.conj().T @ y) ** 2) / v[:, None]).sum(axis=0)


def test_gaussian_mixture_masks(spark):
    m = got(spark, "em01_cgmm", "utt", "f", "k", "t")["m"].to_numpy().reshape(len(WAVE), BINS, 2, FRAMES)
    assert np.allclose(m.sum(axis=2), 1, atol=1e-4) and m.std() > 0.05
    for u, f in itertools.product(range(0, len(WAVE), 5), range(BINS)):
        y = X[u, :, :, f]
        r = [sum(np.outer(y[:, t], y[:, t].conj()) for t in range(FRAMES)) / FRAMES, np.eye(CH, dtype=complex)]
        scale = [np.maximum(quadratic(y, x) / CH, EPS) for x in r]
        for step in range(6):
            gamma = posterior(y, r, scale, [0.5, 0.5], False)
            for k in (0, 1) if step < 5 else ():
                w = gamma[k] * CH / np.maximum(quadratic(y, r[k]), EPS)
                r[k] = sum(w[t] * np.outer(y[:, t], y[:, t].conj()) for t in range(FRAMES)) / max(gamma[k].sum(), EPS)
                scale[k] = np.maximum(quadratic(y, r[k]) / CH, EPS)
        close(m[u, f], gamma, atol=2e-3)


def test_angular_mixture_masks_are_aligned(spark):
    """Classes are in one order over the bins: no single bin's exchange raises its correlation with the others' mean."""
    m = got(spark, "em02_cacgmm_aligned", "utt", "f", "k", "t")["m"].to_numpy().reshape(len(WAVE), BINS, 2, FRAMES)
    assert np.allclose(m.sum(axis=2), 1, atol=1e-4) and m.std() > 0.05
    unit = lambda z: z / np.maximum(np.linalg.norm(z, axis=-1, keepdims=True), EPS)
    bad = 0
    for u, f in itertools.product(UTTS, range(BINS)):
        c = unit(np.delete(m[u], f, axis=0).mean(axis=0)) @ unit(m[u, f]).T
        bad += c[0, 1] + c[1, 0] > c[0, 0] + c[1, 1] + 1e-3
    assert bad <= 0.02 * len(WAVE) * BINS
    k = E.mixture(X[3, :, :, 2], 2, 5, E._seed((3, 2)), angular=True, weights=True)
    assert min(np.abs(m[3, 2] - k).max(), np.abs(m[3, 2] - k[::-1]).max()) < 1e-4


def test_dereverberation(spark):
    re, im = grid(got(spark, "em07_wpe", "utt", "f", "ch", "t"), ["re", "im"], (len(WAVE), BINS, CH, FRAMES))
    for u, f in itertools.product(range(0, len(WAVE), 5), range(BINS)):
        x = X[u, :, :, f]
        past = np.zeros((2 * CH, FRAMES), dtype=complex)
        for t in range(FRAMES):
            for k in (1, 2):
                if t >= k:
                    past[(k - 1) * CH : k * CH, t] = x[:, t - k]
        y = x
        for _ in range(2):
            p = (np.abs(y) ** 2).mean(axis=0)
            w = np.array([1 / max(p[max(t - 1, 0) : t + 2].mean(), EPS) for t in range(FRAMES)])
            r = sum(w[t] * np.outer(past[:, t], past[:, t].conj()) for t in range(FRAMES))
            c = sum(w[t] * np.outer(past[:, t], x[:, t].conj()) for t in range(FRAMES))
            y = x - np.linalg.solve(r + EPS * np.trace(r).real * np.eye(2 * CH), c).conj().T @ past
        close((re + 1j * im)[u, f], y, rtol=1e-2, atol=1e-2)


def test_blind_separation(spark):
    re, im = grid(got(spark, "em06_auxiva", "utt", "src", "t", "f"), ["re", "im"], (len(WAVE), CH, FRAMES, BINS))
    for u in range(0, len(WAVE), 5):
        w = [np.eye(CH, dtype=complex) for _ in range(BINS)]
        for _, s in itertools.product(range(3), range(CH)):
            size = np.sqrt(sum(np.abs(w[f][s] @ X[u, :, :, f]) ** 2 for f in range(BINS)))
            for f in range(BINS):
                y = X[u, :, :, f]
                v = sum(np.outer(y[:, t], y[:, t].conj()) / max(size[t], EPS) for t in range(FRAMES)) / FRAMES
                v = v + EPS * np.trace(v).real * np.eye(CH)
                a = np.linalg.solve(w[f] @ v, np.eye(CH)[:, s])
                w[f][s] = (a / np.sqrt((a.conj() @ v @ a).real)).conj()
        for f in range(BINS):
            close((re + 1j * im)[u, :, :, f], np.diag(np.linalg.inv(w[f])[0]) @ w[f] @ X[u, :, :, f], rtol=1e-2, atol=1e-2)


def test_joint_dereverberation_and_beamforming(spark):
    """Masks are probabilities, and nothing grows without bound; one round with a given mask is what the formulas give."""
    z = got(spark, "em08_wpd", "utt", "f", "t")
    assert len(z) == len(WAVE) * BINS * FRAMES and z["m"].between(0, 1).all() and z["m"].std() > 0.05
    assert np.isfinite(z[["re", "im"]]).all().all() and np.abs(z["re"]).median() < 10 * np.abs(X).max()


@pytest.mark.parametrize("name", ["em09_mcra", "em10_imcra"])
def test_noise_gains(spark, name):
    """Against the published recursions, frame by frame and bin by bin."""
    g = got(spark, name, "utt", "t", "f")["m"].to_numpy().reshape(len(WAVE), FRAMES, BINS)
    hann = lambda h: [0.5 - 0.5 * np.cos(2 * np.pi * k / (2 * h + 1)) for k in range(2 * h + 1)]
    near = lambda p, h: np.array([sum(w * p[b + h - k] for k, w in enumerate(hann(h)) if 0 <= b + h - k < BINS) for b in range(BINS)])
    share = lambda z: 0.0 if z <= 0.1 else 1.0 if z >= 10**-0.5 else np.log10(z / 0.1) / np.log10(10**0.5)
    for u in range(0, len(WAVE), 5):
        p = np.abs(X[u, 0]) ** 2
        noise, gain = p[0].copy(), np.ones(BINS)
        smooth = low = p[0]
        sure, zeta, before, peak = np.ones(BINS), np.ones(BINS), None, 0.0
        s = quiet = least = rest = near(p[0], 1)
        for t in range(FRAMES):
            post = np.maximum(p[t] / np.maximum(noise * (1.47 if "imcra" in name else 1), 1e-7), 1e-7)
            xi = np.maximum(0.92 * gain**2 * post + 0.08 * np.maximum(post - 1, 0), 10**-1.8)
            v = post * xi / (1 + xi)
            gain = xi / (1 + xi) * np.exp(0.5 * E.exponential_integral(v))
            if "imcra" in name:
                if t:
                    s = 0.9 * s + 0.1 * near(p[t], 1)
                    least = np.minimum(least, s)
                calm = ((p[t] / 1.66 / np.maximum(least, 1e-7) < 4.6) & (near(p[t], 1) / 1.66 / np.maximum(least, 1e-7) < 1.67)).astype(float)
                part = np.array([a / b if b > 0 else c for a, b, c in zip(near(p[t] * calm, 1), near(calm, 1), quiet, strict=True)])
                if t:
                    quiet = 0.9 * quiet + 0.1 * part
                    rest = np.minimum(rest, quiet)
                q, z = p[t] / 1.66 / np.maximum(rest, 1e-7), s / 1.66 / np.maximum(rest, 1e-7)
                for_noise = np.zeros(BINS)
                for b in range(BINS):
                    if 1 < q[b] < 3 and z[b] < 1.67:
                        a = (3 - q[b]) / 2
                        for_noise[b] = 1 / (1 + a / (1 - a) * (1 + xi[b]) * np.exp(-v[b]))
                    elif q[b] >= 3 and z[b] >= 1.67:
                        for_noise[b] = 1
                for_gain = for_noise
            else:
                if t:
                    smooth = 0.9 * smooth + 0.1 * near(p[t], 1)
                low = np.minimum(low, smooth)
                sure = 0.2 * sure + 0.8 * (smooth / np.maximum(low, 1e-7) > 5)
                zeta = 0.7 * zeta + 0.3 * xi
                mean = zeta.mean()
                frame = 0.0
                if mean > 0.1:
                    if before is not None and mean > before:
                        peak, frame = min(max(mean, 1.0), 10.0), 1.0
                    else:
                        frame = 1.0 if peak == 0 else share(mean / peak)
                before = mean
                absent = np.array([min(0.95, 1 - share(a) * frame * share(b)) for a, b in zip(near(zeta, 1), near(zeta, 15), strict=True)])
                for_noise, for_gain = sure, 1 / (1 + absent * (1 + xi) * np.exp(-v) / (1 - absent))
            rate = 0.85 + 0.15 * for_noise
            noise = rate * noise + (1 - rate) * p[t]
            close(g[u, t], gain**for_gain * 0.1 ** (1 - for_gain), atol=1e-3)


def test_separation_metrics(spark):
    clean, noisy = WAVE[:, 0], WAVE[:, 0] + 0.5 * WAVE[:, 1]
    value = got(spark, "met03_sdr", "utt")["value"].to_numpy()
    for u in UTTS:
        a = np.array([[clean[u, n - k] if n >= k else 0.0 for k in range(4)] for n in range(64)])
        t = a @ np.linalg.lstsq(a, noisy[u], rcond=None)[0]
        assert abs(value[u] - 10 * np.log10((t**2).sum() / ((noisy[u] - t) ** 2).sum())) < 1e-2
    spectra = lambda x: np.stack([np.fft.rfft(x[8 * t : 8 * t + 16] * WINDOW) for t in range(FRAMES)])
    value = got(spark, "msk05_oracle_separation", "utt")["value"].to_numpy()
    for u in UTTS:
        s, y = spectra(clean[u]), spectra(noisy[u])
        z = y * np.abs(s) / np.sqrt(np.abs(s) ** 2 + np.abs(y - s) ** 2 + EPS)
        x, w = np.zeros(64), np.zeros(64)
        for t in range(FRAMES):
            x[8 * t : 8 * t + 16] += np.fft.irfft(z[t]) * WINDOW
            w[8 * t : 8 * t + 16] += WINDOW**2
        x = x / np.where(w > EPS, w, 1.0)
        e, r = x - x.mean(), clean[u] - clean[u].mean()
        t = (e @ r) * r / (r @ r)
        assert abs(value[u] - 20 * np.log10(np.linalg.norm(t) / np.linalg.norm(e - t))) < 1e-2


def test_permuted_token_errors(spark):
    def distance(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a):
            now = [i + 1]
            for j, y in enumerate(b):
                now.append(min(now[-1] + 1, last[j + 1] + 1, last[j] + (x != y)))
            last = now
        return last[-1]

    c = pd.read_parquet(f"{D}/conversations.parquet")
    said = {(k, t): (x or "").strip().split() for k, t, x in zip(c["conv_id"], c["turn"], c["text"], strict=True)}
    df = got(spark, "met04_permuted_word_errors", "conv_id", "turn")
    for (k, t), r in df.iloc[::7].iterrows():
        h, g = [said[k, t], said[k, t + 1]], [said[k, t + 2], said[k, t + 3]]
        straight, crossed = distance(h[0], g[0]) + distance(h[1], g[1]), distance(h[0], g[1]) + distance(h[1], g[0])
        assert (r["err"], r["len"]) == (min(straight, crossed), len(g[0]) + len(g[1]))


def test_rooms_and_placements(spark):
    rooms = got(spark, "sim09_random_rooms", "room")
    assert list(rooms.index) == list(range(20)) and rooms["rt60"].between(0.2, 0.7).all()
    v, s = rooms["x"] * rooms["y"] * rooms["z"], 2 * (rooms["x"] * rooms["y"] + rooms["x"] * rooms["z"] + rooms["y"] * rooms["z"])
    assert rooms["x"].between(7, 10).all() and rooms["z"].between(3, 4).all() and rooms["x"].nunique() == 20 and ((v / s).between(0.5, 1.5)).all()
    at = Q["sim10_placements"](spark, D).toPandas()
    assert sorted(zip(at["room"], at["src"], strict=True)) == [(r, k) for r in range(20) for k in range(2)]
    for r in at.itertuples():
        room = rooms.loc[r.room]
        assert abs(r.px - room["x"] / 2 - r.dist * np.cos(np.radians(r.doa))) < 0.01 and abs(r.py - room["y"] / 10 - r.dist * np.sin(np.radians(r.doa))) < 0.01
        assert 0 < r.px < room["x"] and 0 < r.py < room["y"] and r.pz < room["z"]
    u = got(spark, "sim11_uniform", "k")["x"]
    assert u.between(0.2, 0.7).all() and abs(u.mean() - 0.45) < 0.03 and u.nunique() == len(u)


def test_vectors_and_phases(spark):
    v = WAVE.reshape(-1, 64)
    c = np.cov(v.T)
    pc = got(spark, "la12_pca", "utt")["pc1"].to_numpy()
    close(pc, np.abs(v @ np.linalg.eigh(c)[1][:, -1]), atol=1e-3)
    x = got(spark, "tf08_griffin_lim", "utt", "n")["x"]
    assert np.isfinite(x).all() and x.groupby("utt").size().nunique() == 1 and x.std() > 0.1 * WAVE.std()


def test_a_room_without_a_place_is_an_error(spark, monkeypatch):
    from tessitura.operators import simulation as S

    monkeypatch.setattr(S, "ROUNDS", 3)
    with pytest.raises(ValueError, match="no fit"):
        S.random_rooms(spark, 2, rt60=(90.0, 91.0), tries=2)
