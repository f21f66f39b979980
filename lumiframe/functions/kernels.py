"""Small dense kernels in numpy, for use inside grouped and block-wise functions."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np


# ---- fits -------------------------------------------------------------------------------------------------------


def fit_translation(p: np.ndarray, q: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    """3 x 4 map of the weighted mean displacement from p to q."""
    m = np.hstack([np.eye(3), np.zeros((3, 1))])
    m[:, 3] = np.average(q - p, axis=0, weights=w)
    return m


def fit_rigid(p: np.ndarray, q: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    """Rotation and translation of least squares, by the singular vectors of the cross covariance."""
    cp, cq = np.average(p, axis=0, weights=w), np.average(q, axis=0, weights=w)
    x, y = p - cp, q - cq
    h = (x * (1 if w is None else np.asarray(w)[:, None])).T @ y
    u, _, vt = np.linalg.svd(h)
    flip = np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T)) or 1])
    r = vt.T @ flip @ u.T
    return np.hstack([r, (cq - r @ cp)[:, None]])


def fit_similarity(p: np.ndarray, q: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    """Rigid map with one scale."""
    m = fit_rigid(p, q, w)
    cp, cq = np.average(p, axis=0, weights=w), np.average(q, axis=0, weights=w)
    x, y = (p - cp) @ m[:, :3].T, q - cq
    k = 1 if w is None else np.asarray(w)[:, None]
    s = (k * x * y).sum() / (k * x * x).sum()
    r = m[:, :3] * s
    return np.hstack([r, (cq - r @ cp)[:, None]])


def fit_affine(p: np.ndarray, q: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    """General map of least squares; raises LinAlgError where points lie in a plane."""
    cp, cq = np.average(p, axis=0, weights=w), np.average(q, axis=0, weights=w)
    x, y = p - cp, q - cq
    k = 1 if w is None else np.asarray(w)[:, None]
    a = np.linalg.solve((k * x).T @ x, (k * x).T @ y).T
    return np.hstack([a, (cq - a @ cp)[:, None]])


def fit_plane_rigid(p: np.ndarray, q: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    """Rotation about the axis z and translation in the plane of least squares; z stays."""
    cp, cq = np.average(p[:, :2], axis=0, weights=w), np.average(q[:, :2], axis=0, weights=w)
    x, y = p[:, :2] - cp, q[:, :2] - cq
    k = np.ones(len(p)) if w is None else np.asarray(w)
    t = math.atan2((k * (x[:, 0] * y[:, 1] - x[:, 1] * y[:, 0])).sum(), (k * (x * y).sum(1)).sum())
    m = np.hstack([np.eye(3), np.zeros((3, 1))])
    m[:2, :2] = [[math.cos(t), -math.sin(t)], [math.sin(t), math.cos(t)]]
    m[:2, 3] = cq - m[:2, :2] @ cp
    return m


FITS = {"identity": lambda p, q, w=None: np.hstack([np.eye(3), np.zeros((3, 1))]), "translation": fit_translation, "rigid": fit_rigid, "similarity": fit_similarity, "affine": fit_affine, "plane rigid": fit_plane_rigid}
LEAST_POINTS = {"identity": 0, "translation": 1, "rigid": 3, "similarity": 3, "affine": 4, "plane rigid": 2}


def fit_interpolated(model: str, other: str | None, share: float, p: np.ndarray, q: np.ndarray, w: np.ndarray | None = None) -> np.ndarray:
    """A model's map blended with that of a stiffer one, cell by cell."""
    m = FITS[model](p, q, w)
    return m if other is None else (1 - share) * m + share * FITS[other](p, q, w)


def transform(m: np.ndarray, p: np.ndarray) -> np.ndarray:
    return p @ m[:, :3].T + m[:, 3]


def map_back(m: np.ndarray, size: np.ndarray, model: str = "rigid") -> np.ndarray:
    """Map of a kind that takes four transformed corners of an image back to where they were, as well as it can."""
    if LEAST_POINTS[model] > 4:
        raise ValueError("four corners don't determine this model")
    corners = np.array([[0, 0, 0], [size[0], 0, 0], [0, size[1], 0], [0, 0, size[2]]], float)
    return FITS[model](transform(m, corners), corners)


def blended_maps(m: np.ndarray, low: np.ndarray, step: float, p: np.ndarray) -> np.ndarray:
    """Images of points under maps (nx, ny, nz, 3, 4) at the knots of a grid of so wide a step, n-linearly blended between the eight around each point.

    low: whole numbers of the first knot. Beyond the grid its outer maps go on.
    """
    at = np.clip(p / step - low, 0, np.array(m.shape[:3]) - 1)
    base = np.minimum(np.floor(at).astype(int), np.maximum(np.array(m.shape[:3]) - 2, 0))
    part = at - base
    out = np.zeros_like(p, dtype=float)
    for corner in np.ndindex(2, 2, 2):
        w = np.prod(np.where(corner, part, 1 - part), axis=1)
        use = np.flatnonzero(w)
        knot = np.minimum(base[use] + corner, np.array(m.shape[:3]) - 1)
        a = m[tuple(knot.T)]
        out[use] += w[use, None] * (np.einsum("nij,nj->ni", a[:, :, :3], p[use]) + a[:, :, 3])
    return out


# ---- robust estimation ------------------------------------------------------------------------------------------


#: Cells of a dense array that a kernel holds at a time, and the chance of having missed a larger consensus at which RANSAC ends.
AT_ONCE, MISSED = 1 << 21, 1e-12


def samples(rng: np.random.Generator, n: int, k: int, rounds: int) -> np.ndarray:
    """`rounds` rows of k different places of 0..n-1; for k = 1 each place once if that is fewer."""
    if k == 1 and n <= rounds:
        return np.arange(n)[:, None]
    out = rng.integers(0, n, (rounds, k))
    while True:
        ordered = np.sort(out, axis=1)
        again = np.flatnonzero((ordered[:, 1:] == ordered[:, :-1]).any(1))
        if not len(again):
            return out
        out[again] = rng.integers(0, n, (len(again), k))


def fit_many(model: str, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The 3 x 4 maps of many small samples (samples, points, 3); NaN where the points don't determine one."""
    if model == "plane rigid":
        return np.array([fit_plane_rigid(x, y) for x, y in zip(p, q, strict=True)])
    cp, cq = p.mean(1), q.mean(1)
    if model in ("identity", "translation"):
        a = np.broadcast_to(np.eye(3), (len(p), 3, 3))
        cp = cq if model == "identity" else cp
    else:
        x, y = p - cp[:, None], q - cq[:, None]
        if model == "affine":
            left, right = np.einsum("sni,snj->sij", x, x), np.einsum("sni,snj->sij", x, y)
            flat = np.abs(np.linalg.det(left)) <= 1e-12 * np.maximum(np.trace(left, axis1=1, axis2=2), 1e-300) ** 3
            left[flat] = np.eye(3)
            a = np.linalg.solve(left, right).transpose(0, 2, 1)
            a[flat] = np.nan
        else:
            u, _, vt = np.linalg.svd(np.einsum("sni,snj->sij", x, y))
            flip = np.sign(np.linalg.det(u @ vt))
            vt[:, 2] *= np.where(flip == 0, 1, flip)[:, None]
            a = (u @ vt).transpose(0, 2, 1)
            if model == "similarity":
                turned = np.einsum("sij,snj->sni", a, x)
                with np.errstate(all="ignore"):
                    a = a * ((turned * y).sum((1, 2)) / (x * x).sum((1, 2)))[:, None, None]
    return np.concatenate([a, (cq - np.einsum("sij,sj->si", a, cp))[:, :, None]], axis=2)


def ransac(p: np.ndarray, q: np.ndarray, model: str, epsilon: float, least_ratio: float, rounds: int, least: int, seed: int) -> np.ndarray:
    """Places of the inliers of the best model; empty if they are too few. The seed fixes the samples.

    All samples are drawn at once and their models tried in arrays of bounded size; it ends early once a larger
    consensus than the best would have been met but for a chance of MISSED.
    """
    n, k = len(p), max(1, LEAST_POINTS[model])
    if n < max(least, k):
        return np.array([], int)
    picks = samples(np.random.default_rng(seed), n, k, rounds)
    best = np.array([], int)
    step = max(1, min(len(picks), AT_ONCE // (3 * n)))
    for at in range(0, len(picks), step):
        pick = picks[at : at + step]
        maps = fit_many(model, p[pick], q[pick])
        off = np.einsum("sij,nj->sni", maps[:, :, :3], p) + maps[:, None, :, 3] - q
        with np.errstate(invalid="ignore"):
            ok = (off * off).sum(2) < epsilon**2
        counts = ok.sum(1)
        if counts.max() > len(best):
            best = np.flatnonzero(ok[counts.argmax()])
        if (1 - (len(best) / n) ** k) ** (at + step) < MISSED:
            break
    if len(best) < max(least, k) or len(best) < least_ratio * n:
        return np.array([], int)
    for _ in range(20):
        m = FITS[model](p[best], q[best])
        ok = np.flatnonzero(((transform(m, p) - q) ** 2).sum(1) < epsilon**2)
        if len(ok) < max(least, k) or np.array_equal(ok, best):
            break
        best = ok
    return best


def multi_consensus(p: np.ndarray, q: np.ndarray, *args) -> list[np.ndarray]:
    """Inlier sets of ransac() until it finds none, each of the points that the earlier ones left."""
    left, out = np.arange(len(p)), []
    while len(ok := ransac(p[left], q[left], *args)):
        out.append(left[ok])
        left = np.delete(left, ok)
    return out


def fit_line(p: np.ndarray, q: np.ndarray, w: np.ndarray | None = None) -> tuple[float, float] | None:
    """Slope and intercept of least squares; None where p doesn't vary."""
    w = np.ones(len(p)) if w is None else w
    s, sp, sq, spp, spq = w.sum(), (w * p).sum(), (w * q).sum(), (w * p * p).sum(), (w * p * q).sum()
    d = s * spp - sp * sp
    if not len(p) or abs(d) < 1e-12 * max(1.0, abs(s * spp)):
        return None
    m = (s * spq - sp * sq) / d
    return m, (sq - m * sp) / s


def ransac_line(p: np.ndarray, q: np.ndarray, epsilon: float, least_ratio: float, rounds: int, least: int, trust: float, seed: int) -> np.ndarray:
    """Inliers of the best line; those whose residual is beyond trust x median go, until none does."""
    n = len(p)
    if n < max(least, 2):
        return np.array([], int)
    picks = samples(np.random.default_rng(seed), n, 2, rounds)
    picks = picks[p[picks[:, 0]] != p[picks[:, 1]]]
    best = np.array([], int)
    step = max(1, min(max(1, len(picks)), AT_ONCE // n))
    for at in range(0, len(picks), step):
        i, j = picks[at : at + step].T
        m = (q[j] - q[i]) / (p[j] - p[i])
        ok = np.abs(m[:, None] * (p[None, :] - p[i][:, None]) + q[i][:, None] - q[None, :]) < epsilon
        counts = ok.sum(1)
        if counts.max() > len(best):
            best = np.flatnonzero(ok[counts.argmax()])
        if (1 - (len(best) / n) ** 2) ** (at + step) < MISSED:
            break
    while len(best) >= max(least, 2):
        line = fit_line(p[best], q[best])
        if line is None:
            return np.array([], int)
        r = np.abs(line[0] * p[best] + line[1] - q[best])
        keep = r <= np.median(r) * trust
        if keep.all():
            break
        best = best[keep]
    return best if len(best) >= max(least, 2) and len(best) > least_ratio * n else np.array([], int)


def icp(p: np.ndarray, q: np.ndarray, model: str, reach: float, rounds: int, least: int, robust: tuple[float, float, int] | None = None, seed: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """Map from p to q and its pairs by iterated nearest neighbours; pairs whose partner is taken twice are dropped.

    robust: epsilon, least ratio and rounds of a RANSAC that every round's pairs go through first. Ends when count and
    mean error are as before, or after so many rounds. Too few pairs give an empty result.
    """
    m = FITS["identity"](p, q)
    last, pairs, done = None, np.empty((0, 2), int), 0
    for done in range(1, rounds + 1):
        x = transform(m, p)
        j, e = nearest_rows(x, q)
        i = np.flatnonzero(e <= reach)
        if robust is not None:
            i = i[ransac(p[i], q[j[i]], model, robust[0], robust[1], robust[2], least, seed)]
        used = np.bincount(j[i], minlength=len(q))
        i = i[used[j[i]] == 1]
        if len(i) < max(least, LEAST_POINTS[model]):
            return m, np.empty((0, 2), int), done
        pairs = np.stack([i, j[i]], 1)
        m = FITS[model](p[i], q[j[i]])
        error = float(np.sqrt(((transform(m, p[i]) - q[j[i]]) ** 2).sum(1)).mean())
        if last is not None and last[0] == len(i) and abs(last[1] - error) < 1e-12:
            break
        last = (len(i), error)
    return m, pairs, done


# ---- joint placement of many images -------------------------------------------------------------------------------


def fit_moments(model: str, cross: np.ndarray, moment: np.ndarray) -> np.ndarray:
    """Maps of least squares of many point sets from their moments: cross (n, 3, 4) of target and (source, 1), moment (n, 4, 4) of (source, 1).

    The identity where there is no weight; an affine map whose points lie in a plane moves as little as it can.
    """
    w = moment[:, 3, 3]
    safe = np.where(w > 0, w, 1.0)
    source, target = moment[:, :3, 3] / safe[:, None], cross[:, :, 3] / safe[:, None]
    eye = np.broadcast_to(np.eye(3), (len(w), 3, 3))
    spread = moment[:, :3, :3] / safe[:, None, None] - source[:, :, None] * source[:, None, :]
    both = cross[:, :, :3] / safe[:, None, None] - target[:, :, None] * source[:, None, :]
    if model in ("identity", "translation"):
        a = eye
    elif model == "affine":
        a = eye + (both - spread) @ np.linalg.pinv(spread, rcond=1e-10, hermitian=True)
    else:
        u, _, vt = np.linalg.svd(both)
        flip = np.sign(np.linalg.det(u @ vt))
        u[:, :, 2] *= np.where(flip == 0, 1, flip)[:, None]
        a = u @ vt
        if model == "similarity":
            size = np.trace(spread, axis1=1, axis2=2)
            a = a * np.where(size > 0, (a * both).sum((1, 2)) / np.where(size > 0, size, 1), 1.0)[:, None, None]
    shift = np.zeros_like(target) if model == "identity" else target - np.einsum("nij,nj->ni", a, source)
    out = np.concatenate([a, shift[:, :, None]], 2)
    out[w <= 0] = np.eye(3, 4)
    return out


def tree_placement(n: int, a: np.ndarray, b: np.ndarray, pp: np.ndarray, pq: np.ndarray, qq: np.ndarray, model: str, fixed: np.ndarray) -> np.ndarray:
    """Maps of n images placed one after the other along links, the heaviest first, from those that are fixed."""
    from heapq import heappop, heappush

    out = np.broadcast_to(np.eye(3, 4), (n, 3, 4)).copy()
    _, steps = tree_steps(n, a, b, pp[:, 3, 3], fixed)
    for e, forth in steps:
        known, to = np.where(forth, a[e], b[e]), np.where(forth, b[e], a[e])
        turn = forth[:, None, None]
        out[to] = fit_moments(model, out[known] @ np.where(turn, pq[e], pq[e].transpose(0, 2, 1)), np.where(turn, qq[e], pp[e]))
    return out


def tree_steps(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray, fixed: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Which of n images links reach from the fixed ones, the heaviest link first, and the links taken, by how many lie before: places, and whether from a to b."""
    from heapq import heappop, heappush

    beside: list[list[int]] = [[] for _ in range(n)]
    first, second, heavy = a.tolist(), b.tolist(), (-weight).tolist()
    for e, (i, j) in enumerate(zip(first, second, strict=True)):
        beside[i].append(e)
        beside[j].append(e)
    depth = np.where(fixed, 0, -1).tolist()
    heap: list = []
    for i in np.flatnonzero(fixed).tolist():
        for e in beside[i]:
            heappush(heap, (heavy[e], e))
    steps: list[list[tuple[int, bool]]] = []
    while heap:
        _, e = heappop(heap)
        i, j = first[e], second[e]
        if depth[i] >= 0 and depth[j] >= 0:
            continue
        forth = depth[i] >= 0
        known, new = (i, j) if forth else (j, i)
        depth[new] = depth[known] + 1
        if len(steps) < depth[new]:
            steps.append([])
        steps[depth[new] - 1].append((e, forth))
        for f in beside[new]:
            heappush(heap, (heavy[f], f))
    return np.array(depth) >= 0, [(np.array([e for e, _ in s]), np.array([f for _, f in s])) for s in steps]


def _turned(v: np.ndarray) -> np.ndarray:
    """Rotations about many vectors by their lengths."""
    angle = np.linalg.norm(v, axis=1)
    k = np.zeros((len(v), 3, 3))
    unit = v / np.where(angle > 0, angle, 1)[:, None]
    k[:, 0, 1], k[:, 0, 2], k[:, 1, 2] = -unit[:, 2], unit[:, 1], -unit[:, 0]
    k -= k.transpose(0, 2, 1)
    return np.eye(3) + np.sin(angle)[:, None, None] * k + (1 - np.cos(angle))[:, None, None] * (k @ k)


def _directions(model: str, maps: np.ndarray) -> np.ndarray:
    """The ways (n, k, 3, 4) in which a small step of a model's parameters changes each map."""
    n = len(maps)
    shifts = np.zeros((n, 3, 3, 4))
    shifts[:, np.arange(3), np.arange(3), 3] = 1
    if model == "translation":
        return shifts
    if model == "affine":
        return np.broadcast_to(np.eye(12).reshape(12, 3, 4), (n, 12, 3, 4))
    turns = np.zeros((n, 3, 3, 4))
    for k in range(3):
        cross = np.zeros((3, 3))
        cross[(k + 2) % 3, (k + 1) % 3], cross[(k + 1) % 3, (k + 2) % 3] = 1, -1
        turns[:, k, :, :3] = cross @ maps[:, :, :3]
    if model == "rigid":
        return np.concatenate([turns, shifts], 1)
    scale = np.zeros((n, 1, 3, 4))
    scale[:, 0, :, :3] = maps[:, :, :3]
    return np.concatenate([turns, scale, shifts], 1)


def place_images(n: int, a: np.ndarray, b: np.ndarray, pp: np.ndarray, pq: np.ndarray, qq: np.ndarray, model: str, fixed: np.ndarray, other: str | None = None, share: float = 0.1, rounds: int = 200, tolerance: float = 1e-10) -> np.ndarray:
    """Maps (n, 3, 4) under which linked points of n images meet with the least sum of squares; fixed ones stay identity.

    Link e says that p of image a[e] is q of image b[e]; pp, pq, qq (e, 4, 4) are the weighted moments of (p, 1) and (q, 1),
    which are all that least squares need. Starts from tree_placement(), then takes Gauss-Newton steps, one for models
    that are linear, each solved by conjugate gradients over the links; memory is a few numbers per link and image, never
    their square. other: every image's map is the blend of its own best map of the two models, with `share` of the other;
    that is found by rounds in which each image goes halfway to its blend.
    """
    maps = tree_placement(n, a, b, pp, pq, qq, model, fixed)
    free = ~fixed
    qp = pq.transpose(0, 2, 1)
    own = np.zeros((n, 4, 4))
    np.add.at(own, a, pp)
    np.add.at(own, b, qq)

    def pull(x: np.ndarray) -> np.ndarray:
        """Half the gradient of the sum of squares at maps (or their changes) x."""
        out = np.zeros((n, 3, 4))
        np.add.at(out, a, x[a] @ pp - x[b] @ qp)
        np.add.at(out, b, x[b] @ qq - x[a] @ pq)
        return out

    for _ in range(1 if model in ("translation", "affine") else rounds):
        g = _directions(model, maps)
        block = np.einsum("nkij,njl,nmil->nkm", g, own, g)
        size = np.trace(block, axis1=1, axis2=2) / block.shape[1]
        block += np.eye(block.shape[1]) * (np.maximum(size, 1e-300) * 1e-12)[:, None, None]
        inverse = np.linalg.inv(block)
        into = lambda x: np.einsum("nkij,nij->nk", g, x) * free[:, None]  # noqa: B023, E731
        step = lambda t: np.einsum("nk,nkij->nij", t, g)  # noqa: B023, E731
        t = conjugate_gradients(lambda x: into(pull(step(x))), -into(pull(maps)), lambda r: np.einsum("nkm,nm->nk", inverse, r))  # noqa: B023
        t *= free[:, None]
        if model in ("translation", "affine"):
            maps = maps + step(t)
        else:
            maps = maps.copy()
            maps[:, :, 3] += t[:, -3:]
            maps[:, :, :3] = _turned(t[:, :3]) @ maps[:, :, :3]
            if model == "similarity":
                maps[:, :, :3] *= np.exp(t[:, 3])[:, None, None]
        if np.abs(t).max(initial=0) < tolerance:
            break
    if other is None:
        return maps
    for _ in range(rounds * 10):
        cross = np.zeros((n, 3, 4))
        np.add.at(cross, a, maps[b] @ qp)
        np.add.at(cross, b, maps[a] @ pq)
        best = (1 - share) * fit_moments(model, cross, own) + share * fit_moments(other, cross, own)
        change = np.where((free & (own[:, 3, 3] > 0))[:, None, None], (best - maps) / 2, 0)
        maps = maps + change
        if np.abs(change).max(initial=0) < tolerance:
            break
    return maps


#: Images of a component up to which its steps are solved in one dense system, and cells of a stack of systems.
FEW_IMAGES, SYSTEM_CELLS = 32, 1 << 22


def place_components(of: np.ndarray, a: np.ndarray, b: np.ndarray, pp: np.ndarray, pq: np.ndarray, qq: np.ndarray, model: str, fixed: np.ndarray, other: str | None = None, share: float = 0.1, rounds: int = 200, tolerance: float = 1e-10) -> np.ndarray:
    """place_images() of many components at once; `of` is each image's component, 0 and up, and images are in its order.

    The steps of rigid and similarity models of small components are solved in stacked dense systems, and a component
    leaves the stack when its steps have ended. Components that are large or that links don't hold together go one by one.
    """
    size = np.bincount(of)
    start = np.cumsum(size) - size
    alone = np.ones(len(size), bool)
    if model in ("rigid", "similarity") and other is None:
        reached, _ = tree_steps(len(of), a, b, pp[:, 3, 3], fixed)
        alone = (size > FEW_IMAGES) | (np.bincount(of, ~reached) > 0)
    out = np.broadcast_to(np.eye(3, 4), (len(of), 3, 4)).copy()
    group = of[a]
    order = np.argsort(group, kind="stable")
    ends = np.searchsorted(group[order], np.arange(len(size) + 1))
    for g in np.flatnonzero(alone):
        e, i = order[ends[g] : ends[g + 1]], slice(start[g], start[g] + size[g])
        out[i] = place_images(int(size[g]), a[e] - start[g], b[e] - start[g], pp[e], pq[e], qq[e], model, fixed[i], other, share, rounds, tolerance)
    small = np.flatnonzero(~alone)
    small = small[np.argsort(size[small], kind="stable")]
    step = max(1, SYSTEM_CELLS // (7 * int(size[small].max(initial=1))) ** 2)
    for at in range(0, len(small), step):
        chosen = np.zeros(len(size), bool)
        chosen[small[at : at + step]] = True
        i, e = np.flatnonzero(chosen[of]), np.flatnonzero(chosen[group])
        out[i] = _placed_together(np.unique(of[i], return_inverse=True)[1], *(np.searchsorted(i, x[e]) for x in (a, b)), pp[e], pq[e], qq[e], model, fixed[i], rounds, tolerance)
    return out


def _placed_together(of: np.ndarray, a: np.ndarray, b: np.ndarray, pp: np.ndarray, pq: np.ndarray, qq: np.ndarray, model: str, fixed: np.ndarray, rounds: int, tolerance: float) -> np.ndarray:
    """Gauss-Newton steps of place_images() of small components, each system dense and all of them in one array."""
    n, count = len(of), int(of.max(initial=-1)) + 1
    maps = tree_placement(n, a, b, pp, pq, qq, model, fixed)
    own = np.zeros((n, 4, 4))
    np.add.at(own, a, pp)
    np.add.at(own, b, qq)
    size = np.bincount(of)
    place = np.arange(n) - (np.cumsum(size) - size)[of]
    width = int(size.max(initial=0))
    work = np.ones(count, bool)
    for _ in range(rounds):
        # images and links of the components whose steps haven't ended
        i, e = np.flatnonzero(work[of]), np.flatnonzero(work[of[a]])
        if not len(i):
            break
        c, p = np.searchsorted(np.flatnonzero(work), of[i]), place[i]
        u, v = np.searchsorted(i, a[e]), np.searchsorted(i, b[e])
        x, g = maps[i], _directions(model, maps[i])
        k = g.shape[1]
        flat = g.reshape(len(i), k, 12)
        through = lambda m, t: (g[m].reshape(-1, k * 3, 4) @ t).reshape(-1, k, 12)  # noqa: B023, E731
        block = through(slice(None), own[i]) @ flat.transpose(0, 2, 1)
        scale = np.maximum(np.trace(block, axis1=1, axis2=2) / k, 1e-300)
        block += np.eye(k) * (scale * 1e-9)[:, None, None]
        cross = through(u, pq[e]) @ flat[v].transpose(0, 2, 1)
        pull = np.zeros((len(i), 3, 4))
        np.add.at(pull, u, x[u] @ pp[e] - x[v] @ pq[e].transpose(0, 2, 1))
        np.add.at(pull, v, x[v] @ qq[e] - x[u] @ pq[e])
        free = ~fixed[i]
        system = np.zeros((int(work.sum()), width, width, k, k))
        system[:, np.arange(width), np.arange(width)] = np.eye(k)
        system[c, p, p] = np.where(free[:, None, None], block, np.eye(k))
        both = (free[u] & free[v])[:, None, None]
        np.subtract.at(system, (c[u], p[u], p[v]), np.where(both, cross, 0))
        np.subtract.at(system, (c[u], p[v], p[u]), np.where(both, cross.transpose(0, 2, 1), 0))
        right = np.zeros((len(system), width, k))
        right[c, p] = -(flat @ pull.reshape(-1, 12, 1))[:, :, 0] * free[:, None]
        # systems of several scales stay well balanced
        rows = np.ones((len(system), width))
        rows[c, p] = np.where(free, np.sqrt(scale), 1)
        system /= (rows[:, :, None] * rows[:, None, :])[..., None, None]
        right /= rows[:, :, None]
        full = system.transpose(0, 1, 3, 2, 4).reshape(len(system), width * k, width * k)
        t = np.linalg.solve(full, right.reshape(len(system), width * k, 1)).reshape(len(system), width, k) / rows[:, :, None]
        t = t[c, p] * free[:, None]
        maps[i, :, 3] += t[:, -3:]
        maps[i, :, :3] = _turned(t[:, :3]) @ maps[i, :, :3]
        if model == "similarity":
            maps[i, :, :3] *= np.exp(t[:, 3])[:, None, None]
        most = np.zeros(count)
        np.maximum.at(most, of[i], np.abs(t).max(1))
        work &= most >= tolerance
    return maps


def least_lines(n: int, i: np.ndarray, j: np.ndarray, w, p, q, pp, qq, pq, rigidity: float) -> np.ndarray:
    """Lines (n, 2) of slope and offset that bring linked values of n nodes together by least squares, the first staying identity; see solve_fields()."""
    add = lambda x, y: np.bincount(i, x, n) + np.bincount(j, y, n)
    # a node's own moments: of its values, and of values by one
    own = np.stack([add(pp, qq), add(p, q), add(w, w)], 1)
    held = own[:, [0, 2]] * rigidity
    free = (np.arange(n) > 0)[:, None]

    def pull(x: np.ndarray) -> np.ndarray:
        a, b = x[:, 0], x[:, 1]
        slope = own[:, 0] * a + own[:, 1] * b - add(pq * a[j] + p * b[j], pq * a[i] + q * b[i])
        offset = own[:, 1] * a + own[:, 2] * b - add(q * a[j] + w * b[j], p * a[i] + w * b[i])
        return (np.stack([slope, offset], 1) + held * x) * free

    still = np.tile([1.0, 0.0], (n, 1))
    det = own[:, 0] * own[:, 2] * (1 + rigidity) ** 2 - own[:, 1] ** 2
    safe = det > 1e-12 * np.maximum(own[:, 0] * own[:, 2], 1e-300)

    def precondition(r: np.ndarray) -> np.ndarray:
        both = np.stack([own[:, 2] * (1 + rigidity) * r[:, 0] - own[:, 1] * r[:, 1], own[:, 0] * (1 + rigidity) * r[:, 1] - own[:, 1] * r[:, 0]], 1) / np.where(safe, det, 1)[:, None]
        plain = r / np.maximum(own[:, [0, 2]] * (1 + rigidity), 1e-300)
        return np.where(safe[:, None], both, plain) * free

    # what is to be added to identity
    return still + conjugate_gradients(pull, held * still * free - pull(still), precondition)


def place_lines(n: int, a: np.ndarray, b: np.ndarray, w, p, q, pp, qq, pq, shift: float, stay: float, rounds: int, damping: float, tolerance: float) -> np.ndarray:
    """Lines (n, 2) of slope and offset that bring linked values of n nodes together, the first staying identity; see solve_field_maps()."""
    maps = least_lines(n, a, b, w, p, q, pp, qq, pq, 1e-9)
    add = lambda x, y: np.bincount(a, x, n) + np.bincount(b, y, n)
    s, sv, svv = add(w, w), add(p, q), add(pp, qq)
    spread = svv - sv * sv / np.where(s > 0, s, 1)
    steep = spread > 1e-12 * np.maximum(svv, 1e-300)
    for _ in range(rounds):
        # where each node's values are to go: the partners' values under the partners' maps
        y = add(maps[b, 0] * q + maps[b, 1] * w, maps[a, 0] * p + maps[a, 1] * w)
        vy = add(maps[b, 0] * pq + maps[b, 1] * p, maps[a, 0] * pq + maps[a, 1] * q)
        mean = y / np.where(s > 0, s, 1)
        slope = np.where(steep, (vy - sv * mean) / np.where(steep, spread, 1), 1.0)
        offset = mean - slope * sv / np.where(s > 0, s, 1)
        moved = mean - sv / np.where(s > 0, s, 1)
        best = np.stack([(1 - shift) * slope + shift, (1 - shift) * offset + shift * moved], 1)
        best = (1 - stay) * best + stay * np.array([1.0, 0.0])
        change = damping * (best - maps)
        change[0] = 0
        maps += change
        if np.abs(change).max() < tolerance:
            break
    return maps


def link_errors(maps: np.ndarray, a: np.ndarray, b: np.ndarray, pp: np.ndarray, pq: np.ndarray, qq: np.ndarray) -> np.ndarray:
    """Root of each link's weighted mean square distance."""
    x, y = maps[a], maps[b]
    square = np.einsum("eij,ejk,eik->e", x, pp, x) - 2 * np.einsum("eij,ejk,eik->e", x, pq, y) + np.einsum("eij,ejk,eik->e", y, qq, y)
    return np.sqrt(np.maximum(square / pp[:, 3, 3], 0))


def later_within(part: np.ndarray, at: np.ndarray, ids: np.ndarray, radius: float) -> np.ndarray:
    """Which places have one of the same part with a smaller id within radius; rows are in the order of part and the first axis."""
    gone = np.zeros(len(part), bool)
    i, k = np.arange(len(part)), 0
    while len(i):
        k += 1
        i = i[i + k < len(part)]
        i = i[(part[i] == part[i + k]) & (at[i + k, 0] - at[i, 0] <= radius * (1 + 1e-12))]
        d = at[i + k] - at[i]
        near = i[d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2] <= radius * radius]
        gone[near[ids[near] > ids[near + k]]] = True
        gone[near[ids[near] < ids[near + k]] + k] = True
    return gone


# ---- descriptors ------------------------------------------------------------------------------------------------


def row_blocks(n: int, width: int) -> list[slice]:
    """Slices of n rows of `width` cells, so that a dense array over one of them has at most about AT_ONCE cells."""
    step = max(1, AT_ONCE // max(1, width))
    return [slice(i, min(n, i + step)) for i in range(0, n, step)]


def square_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of squared differences of rows of a by rows of b."""
    out = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        d = a[:, i, None] - b[None, :, i]
        out += d * d
    return out


#: Points up to which all distances are taken, and points that a cell of the grid has on average beyond that.
FEW, A_CELL = 1500, 4


def nearest(a: np.ndarray, b: np.ndarray, k: int, skip_self: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Places in b and distances of the k nearest rows of b for each row of a, by distance and place; k is cut to what there is.

    Few points are compared one and all. Of many, b is put in a grid of cells with A_CELL points on average, and a row
    looks into the cells around its own; rows whose kth distance isn't within a cell's edge look into wider grids, and at
    last at all. Distances are held for a block of rows. skip_self: a is b, and a row isn't its own neighbour.
    """
    k = min(k, len(b) - skip_self)
    at, far = np.zeros((len(a), max(k, 0)), int), np.full((len(a), max(k, 0)), np.inf)
    if k <= 0 or not len(a):
        return at, far
    todo, axes = np.arange(len(a)), b.shape[1]
    span = np.ptp(b, axis=0)
    span = np.maximum(span, max(1e-12, span.max() * 1e-3))
    cell = float((span.prod() * A_CELL * max(1, k / 2) / len(b)) ** (1 / axes))
    while len(todo) and len(b) > FEW and cell < span.max():
        shape = np.floor(span / cell).astype(np.int64) + 3
        place = np.floor((b - b.min(0)) / cell).astype(np.int64) + 1
        number = np.ravel_multi_index(tuple(place.T), shape)
        order = np.argsort(number, kind="stable")
        ordered = number[order]
        own = np.floor((a[todo] - b.min(0)) / cell).astype(np.int64) + 1
        left = []
        around = np.stack(np.meshgrid(*[(-1, 0, 1)] * axes, indexing="ij"), -1).reshape(-1, axes)
        inside = ((own >= 0) & (own < shape)).all(1)
        left.append(todo[~inside])
        todo, own = todo[inside], own[inside]
        for rows in row_blocks(len(todo), 3**axes * A_CELL * 8):
            beside = own[rows][:, None, :] + around[None]
            ok = ((beside >= 0) & (beside < shape)).all(2)
            cells = np.ravel_multi_index(tuple(np.where(ok[..., None], beside, 0).transpose(2, 0, 1)), shape)
            start, stop = np.searchsorted(ordered, cells), np.searchsorted(ordered, cells, "right")
            count = np.where(ok, stop - start, 0)
            if count.sum() > 16 * AT_ONCE:
                left.append(todo[rows])
                continue
            which = np.repeat(np.arange(len(count)), count.sum(1))
            lens = count.ravel()
            ends = np.cumsum(lens)
            j = order[np.repeat(start.ravel() - ends + lens, lens) + np.arange(ends[-1])]
            i = todo[rows][which]
            if skip_self:
                which, i, j = which[i != j], i[i != j], j[i != j]
            d = ((a[i] - b[j]) ** 2).sum(1)
            sort = np.lexsort((j, d, which))
            which, j, d = which[sort], j[sort], d[sort]
            rank = np.arange(len(which)) - np.searchsorted(which, which)
            best_at, best_far = np.zeros((len(count), k), int), np.full((len(count), k), np.inf)
            take = rank < k
            best_at[which[take], rank[take]], best_far[which[take], rank[take]] = j[take], d[take]
            done = best_far[:, -1] <= cell * cell
            at[todo[rows][done]], far[todo[rows][done]] = best_at[done], best_far[done]
            left.append(todo[rows][~done])
        todo = np.concatenate(left)
        cell *= 3
    for rows in row_blocks(len(todo), len(b)):
        d = square_distances(a[todo[rows]], b)
        if skip_self:
            d[np.arange(len(d)), todo[rows]] = np.inf
        first = np.argsort(d, axis=1, kind="stable")[:, :k]
        at[todo[rows]], far[todo[rows]] = first, np.take_along_axis(d, first, 1)
    return at, np.sqrt(far)


def nearest_rows(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a the place of the nearest row of b, the first of equal ones, and its distance."""
    at, far = nearest(a, b, 1)
    return at[:, 0], far[:, 0]


def row_blocks(n: int, width: int) -> list[slice]:
    """Slices of n rows of `width` cells, so that a dense array over one of them has at most about AT_ONCE cells."""
    step = max(1, AT_ONCE // max(1, width))
    return [slice(i, min(n, i + step)) for i in range(0, n, step)]


def square_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of squared differences of rows of a by rows of b."""
    out = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        d = a[:, i, None] - b[None, :, i]
        out += d * d
    return out


def two_nearest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in b and squared distances of the two nearest rows of b for each row of a, by distance and place; fewer if b has fewer.

    A matrix product tells which rows of b can be among them, by more than its rounding may be off; their distances are
    then summed as square_distances() does, so the result is the same. Rows with very many such take all distances.
    """
    k = min(2, len(b))
    sq_a, sq_b = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    with np.errstate(all="ignore"):
        d = a @ b.T
        d *= -2
        d += sq_b
        # of sums of n products, whose sizes are at most those of the two rows
        slack = (a.shape[1] + 8) * 4 * np.finfo(float).eps * (sq_a + sq_b.max(initial=0.0)) + np.finfo(float).tiny
        # the second smallest, in two passes over the rows
        first = d.argmin(1) if k else np.zeros(len(a), int)
        least = d[np.arange(len(a)), first] if k else np.zeros(len(a))
        if k == 2:
            d[np.arange(len(a)), first] = np.inf
            most = d.min(1)
            d[np.arange(len(a)), first] = least
        else:
            most = least
        close = d <= (most + slack)[:, None]
        close[~np.isfinite(least + most + slack)] = True
    at, found = np.empty((len(a), k), int), np.empty((len(a), k))
    r, c = np.nonzero(close)
    start = np.searchsorted(r, np.arange(len(a) + 1))
    for rows in _runs(start, AT_ONCE // 8):
        i, j = r[start[rows.start] : start[rows.stop]], c[start[rows.start] : start[rows.stop]]
        e = np.zeros(len(i))
        for n in range(a.shape[1]):
            t = a[i, n] - b[j, n]
            e += t * t
        order = np.lexsort((j, e, i))
        take = (start[rows] - start[rows.start])[:, None] + np.arange(k)
        at[rows], found[rows] = j[order][take], e[order][take]
    return at, found


def _runs(start: np.ndarray, most: int) -> list[slice]:
    """Slices of groups that begin at start[i], of at most so many members together, or of one group."""
    out, i, n = [], 0, len(start) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(start, start[i] + most, "right")) - 1)
        out.append(slice(i, min(j, n)))
        i = min(j, n)
    return out


def nearest_others(x: np.ndarray, k: int) -> np.ndarray:
    """Places of the k nearest other points of each point, by distance and place."""
    return nearest(x, x, k, True)[0]


def subsets(n: int, k: int) -> list[tuple[int, ...]]:
    """All k of n, in the order of their places."""
    return list(combinations(range(n), k))


def redundant_distance(a: np.ndarray, b: np.ndarray, neighbours: int) -> np.ndarray:
    """Least mean squared difference over all pairs of subsets of neighbours: rows of a by rows of b (points, k, 3)."""
    best = np.full((len(a), len(b)), np.inf)
    for s in subsets(a.shape[1], neighbours):
        for t in subsets(b.shape[1], neighbours):
            d = ((a[:, None, list(s)] - b[None, :, list(t)]) ** 2).sum((2, 3)) / a.shape[2]
            np.minimum(best, d, out=best)
    return best


#: Share of their lengths' product up to which vectors are in one line or plane.
FLAT = 1e-9


def local_frames(x: np.ndarray, neighbours: np.ndarray) -> np.ndarray:
    """Six rotation-invariant numbers of each point and its three nearest others; rows without a frame are NaN.

    Three places around a point have nine coordinates, of which a rotation takes three away. The frame that does so has
    its first axis towards the farthest of the three, its second in the plane that the nearest one opens with it, and its
    third across that plane, to the side of the one between. Left are the farthest one's distance, the nearest one's
    two coordinates in the plane, and all three of the one between. If all three lie in a plane with the point, the one
    between has no side, and the third axis keeps that of the nearest one and the first axis; the two must open a plane.
    Both are told within a share of FLAT, so that rounding decides neither.
    """
    nearest, between, farthest = (x[neighbours[:, i]] - x for i in range(3))
    inner = lambda u, v: (u * v).sum(1)
    length = lambda u: np.linalg.norm(u, axis=1, keepdims=True)
    unit = lambda u: u / length(u)
    with np.errstate(all="ignore"):
        first = unit(farthest)
        across = np.cross(nearest, first)
        beside = inner(across, between)[:, None] < -FLAT * length(nearest) * length(between)
        across = np.where(length(across) > FLAT * length(nearest), unit(across), np.nan)
        across = np.where(beside, -across, across)
        second = unit(np.cross(across, first))
    return np.stack([np.linalg.norm(farthest, axis=1), inner(nearest, first), inner(nearest, second), inner(between, first), inner(between, second), inner(between, across)], 1)


def ratio_matches(d: np.ndarray, ratio: float, strict: bool, threshold: float = np.inf) -> np.ndarray:
    """(row, column) of the best candidate of each row of distances that beats the second by a factor; a second is needed."""
    if d.shape[1] < 2 or not len(d):
        return np.empty((0, 2), int)
    order = np.argsort(d, axis=1, kind="stable")[:, :2]
    first, second = np.take_along_axis(d, order, 1).T
    ok = (first * ratio < second) if strict else (first * ratio <= second)
    ok &= np.isfinite(first) & (first < threshold)
    return np.stack([np.flatnonzero(ok), order[ok, 0]], 1)


def matches_by_ratio(a: np.ndarray, b: np.ndarray, ratio: float, strict: bool, threshold: float = np.inf, distance=square_distances) -> np.ndarray:
    """ratio_matches() of the distances of rows of a from rows of b, a block of rows at a time."""
    found = [ratio_matches(distance(a[rows], b), ratio, strict, threshold) + [rows.start, 0] for rows in row_blocks(len(a), len(b))]
    return np.concatenate(found) if found else np.empty((0, 2), int)


# ---- images -----------------------------------------------------------------------------------------------------


def gauss_kernel(sigma: float) -> np.ndarray:
    r = max(1, math.ceil(3 * sigma))
    x = np.arange(-r, r + 1)
    k = np.exp(-(x**2) / (2 * sigma**2))
    return k / k.sum()


def gauss(image: np.ndarray, sigma: float | list[float]) -> np.ndarray:
    """Separable Gaussian with mirrored borders."""
    out = image.astype(np.float64)
    for axis in range(image.ndim):
        s = sigma if np.isscalar(sigma) else sigma[axis]
        if s <= 0:
            continue
        k = gauss_kernel(s)
        r = len(k) // 2
        padded = np.pad(out, [(r, r) if a == axis else (0, 0) for a in range(image.ndim)], mode="symmetric" if out.shape[axis] <= r else "reflect")
        out = sum(w * np.take(padded, range(i, i + image.shape[axis]), axis=axis) for i, w in enumerate(k))
    return out


def weighted_gauss(image: np.ndarray, mask: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian of the masked values only; places that no masked value reaches keep theirs."""
    w = gauss(mask.astype(float), sigma)
    return np.where(w > 1e-12, gauss(image * mask, sigma) / np.maximum(w, 1e-12), image)


def dog_sigmas(sigma: float, blur: float = 0.5) -> tuple[float, float, float]:
    """The two sigmas to apply to an image that has a blur already, and the factor that makes the response scale free."""
    k = 2 ** (1 / 4)
    return math.sqrt(sigma**2 - blur**2), math.sqrt((sigma * k) ** 2 - blur**2), 1 / (k - 1)


def dog(image: np.ndarray, sigma: float, low: float, high: float) -> np.ndarray:
    """Difference of Gaussians of the image scaled to [0, 1]; bright blobs are minima."""
    s1, s2, k = dog_sigmas(sigma)
    x = (image - low) / (high - low)
    return (gauss(x, s2) - gauss(x, s1)) * k


def local_minima(response: np.ndarray, threshold: float) -> np.ndarray:
    """Places whose value no neighbour falls below and that are at least as far from 0 as the threshold; borders are left out."""
    inner = tuple(slice(1, -1) for _ in range(response.ndim))
    c = response[inner]
    ok = (c <= 0) & (np.abs(c) >= threshold)
    for shift in np.ndindex(*(3,) * response.ndim):
        if shift != (1,) * response.ndim:
            ok &= c <= response[tuple(slice(s, s + n - 2) for s, n in zip(shift, response.shape, strict=True))]
    return np.argwhere(ok) + 1


def refine(response: np.ndarray, place: np.ndarray, moves: int = 10) -> tuple[np.ndarray, float]:
    """Sub-pixel extremum of a quadratic through the 3^n neighbourhood, moving to a neighbour at most so often."""
    place = place.copy()
    n = response.ndim
    step, value = np.zeros(n), float(response[tuple(place)])
    for _ in range(moves):
        g, h = np.zeros(n), np.zeros((n, n))
        f = lambda *d: response[tuple(place + np.sum(d, axis=0))]  # noqa: B023, E731
        e = np.eye(n, dtype=int)
        for i in range(n):
            g[i] = (f(e[i]) - f(-e[i])) / 2
            h[i, i] = f(e[i]) - 2 * response[tuple(place)] + f(-e[i])
            for j in range(i):
                h[i, j] = h[j, i] = (f(e[i], e[j]) - f(e[i], -e[j]) - f(-e[i], e[j]) + f(-e[i], -e[j])) / 4
        try:
            step = -np.linalg.solve(h, g)
        except np.linalg.LinAlgError:
            step = np.zeros(n)
        value = float(response[tuple(place)] + g @ step / 2)
        move = np.where(np.abs(step) > 0.5, np.sign(step), 0).astype(int)
        target = place + move
        if not move.any() or (target < 1).any() or (target > np.array(response.shape) - 2).any():
            break
        place = target
    return place + np.clip(step, -1, 1), value


#: Steps of the cosine ramp's table.
RAMP = 30


def blend_weight(at: np.ndarray, size: int, border: float, width: float) -> np.ndarray:
    """Weight of places on one axis of an image: 0 in the border, half a cosine wave over `width`, 1 within, and the same on the far side.

    The wave is looked up between RAMP + 1 points joined by straight lines. Where the ramps would cross, they meet in the middle.
    """
    table = (np.cos((1 - np.arange(RAMP + 1) / RAMP) * np.pi) + 1) / 2
    ramp = lambda d: np.interp(np.clip(d, 0, 1) * RAMP, np.arange(RAMP + 1), table) if width > 0 else np.ones_like(d)
    far = size - 1 - border
    w = np.where(at < (size - 1) / 2, ramp((at - border) / max(width, 1e-300)), ramp((far - at) / max(width, 1e-300)))
    return np.where((at < border) | (at > far) | ((at >= far) & (width > 0)), 0.0, w)


def sample_blocks(at: np.ndarray, where: dict[tuple[int, int, int], int], blocks: list, size: tuple[int, int, int], dims: np.ndarray, linear: bool) -> np.ndarray:
    """Values at places (x, y, z) of an image that is held as blocks with x fastest; `where` has a block's number by its place. A missing block is 0."""
    if not len(at):
        return np.zeros(0)
    n = np.array(size)
    data = np.concatenate([np.asarray(b, float) for b in blocks] + [np.zeros(n.prod())])
    low = np.min(list(where), axis=0)
    high = np.max(list(where), axis=0)
    table = np.full(high - low + 1, len(blocks))
    for k, v in where.items():
        table[tuple(np.array(k) - low)] = v

    def value(p: np.ndarray) -> np.ndarray:
        b = p // n
        ok = ((b >= low) & (b <= high)).all(1)
        number = np.full(len(p), len(blocks))
        number[ok] = table[tuple((b[ok] - low).T)]
        o = p % n
        return data[number * n.prod() + o[:, 0] + n[0] * (o[:, 1] + n[1] * o[:, 2])]

    if not linear:
        return value(np.minimum(np.floor(at + 0.5).astype(int), dims - 1))
    base = np.minimum(np.floor(at).astype(int), np.maximum(dims - 2, 0))
    part = at - base
    out = np.zeros(len(at))
    for corner in np.ndindex(2, 2, 2):
        w = np.prod(np.where(corner, part, 1 - part), axis=1)
        use = w > 0
        out[use] += w[use] * value(np.minimum(base[use] + corner, dims - 1))
    return out


def content_weights(image: np.ndarray, small: float = 20, large: float = 40) -> np.ndarray:
    return gauss((image - gauss(image, small)) ** 2, large) / 2048


def convolve(image: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Convolution by the Fourier transform, with mirrored borders; the kernel's centre is its middle."""
    pad = [(k // 2, k - 1 - k // 2) for k in kernel.shape]
    x = np.pad(image, pad, mode="symmetric")
    shape = [x.shape[i] + kernel.shape[i] - 1 for i in range(x.ndim)]
    axes = tuple(range(x.ndim))
    y = np.fft.irfftn(np.fft.rfftn(x, shape, axes) * np.fft.rfftn(kernel, shape, axes), shape, axes)
    return y[tuple(slice(kernel.shape[i] - 1, kernel.shape[i] - 1 + image.shape[i]) for i in range(x.ndim))]


def mirrored(kernel: np.ndarray) -> np.ndarray:
    return kernel[tuple(slice(None, None, -1) for _ in kernel.shape)]


def psf_pair(psfs: list[np.ndarray], view: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The two kernels of a view's update: that which blurs, and that which spreads the ratio back, each of sum 1."""
    norm = lambda k: k / k.sum()
    k1 = norm(psfs[view])
    if kind == "independent":
        return k1, mirrored(k1)
    if kind == "optimization II":
        return k1, mirrored(norm(np.maximum(k1, 0) ** len(psfs)))
    others = [norm(p) for i, p in enumerate(psfs) if i != view]
    if kind == "optimization I":
        out = k1.copy()
        for k in others:
            out = out * convolve(k1, mirrored(k))
        return k1, mirrored(norm(np.maximum(out, 0)))
    if kind == "efficient Bayesian":
        out = mirrored(k1)
        for k in others:
            out = out * convolve(convolve(mirrored(k1), k), mirrored(k))
        return k1, norm(np.maximum(out, 0))
    raise ValueError(kind)


def deconvolve_round(psi: np.ndarray, images: list[np.ndarray], weights: list[np.ndarray], pairs: list[tuple[np.ndarray, np.ndarray]], top: float, least: float = 1e-4, damping: float = 0.0) -> np.ndarray:
    """The next estimate: views update it one after the other, each by its weight."""
    for image, weight, (k1, k2) in zip(images, weights, pairs, strict=True):
        blurred = convolve(psi, k1)
        ratio = np.where(image > 0, image / np.maximum(blurred, least), 1.0)
        value = psi * convolve(ratio, k2) / top
        if damping:
            value = (np.sqrt(1 + 2 * damping * np.maximum(value, 0)) - 1) / damping
        adjusted = np.where(np.isfinite(value) & (value > 0), np.maximum(least, value * top), least)
        psi = psi + (adjusted - psi) * weight
    return psi


def deconvolve(images: list[np.ndarray], weights: list[np.ndarray], psfs: list[np.ndarray], rounds: int, kind: str = "optimization II", least: float = 1e-4, damping: float = 0.0) -> np.ndarray:
    """Multi-view Richardson-Lucy of whole images."""
    psi = np.full(images[0].shape, max(least, float(np.mean([i.mean() for i in images]))))
    pairs = [psf_pair(psfs, v, kind) for v in range(len(images))]
    top = max(float(i.max()) for i in images)
    for _ in range(rounds):
        psi = deconvolve_round(psi, images, weights, pairs, top, least, damping)
    return psi


def ring_correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fourier ring correlation of two square images: tapered, padded to a power of two, rings over half a circle, bilinear samples."""
    n = a.shape[0]
    taper = np.minimum(1, np.minimum(np.arange(n), n - 1 - np.arange(n)) / max(1, n // 8))
    taper = (1 - np.cos(np.pi * taper)) / 2
    size = 16
    while size < n:
        size *= 2
    f = []
    for x in (a, b):
        p = np.zeros((size, size))
        p[:n, :n] = (x - x.mean()) * taper[:, None] * taper[None, :]
        f.append(np.fft.fftshift(np.fft.fft2(p)))
    c, out = size // 2, []
    for r in range(1, c - 1):
        t = np.arange(0, np.pi, 1 / r)
        x, y = c + r * np.cos(t), c + r * np.sin(t)
        i, j = np.floor(x).astype(int), np.floor(y).astype(int)
        u, v = x - i, y - j
        s = [g[j, i] * (1 - u) * (1 - v) + g[j, i + 1] * u * (1 - v) + g[j + 1, i] * (1 - u) * v + g[j + 1, i + 1] * u * v for g in f]
        d = math.sqrt((np.abs(s[0]) ** 2).sum() * (np.abs(s[1]) ** 2).sum())
        out.append(float((s[0] * s[1].conj()).real.sum() / d) if d > 0 else 0.0)
    return np.array(out)


def smooth(values: np.ndarray, bandwidth: float = 0.0707) -> np.ndarray:
    """Local linear regression with tricube weights over a share of the points."""
    n = len(values)
    k = max(2, int(bandwidth * n))
    x = np.arange(n, dtype=float)
    out = np.empty(n)
    for i in range(n):
        lo = min(max(0, i - k // 2), n - k)
        s = slice(lo, lo + k)
        d = np.abs(x[s] - i)
        w = (1 - (d / (d.max() * 1.0001 or 1)) ** 3) ** 3
        line = fit_line(x[s] - i, values[s], w)
        out[i] = line[1] if line else np.average(values[s], weights=w)
    return out


def moving_least_squares(at: np.ndarray, p: np.ndarray, q: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """Affine maps at places: matches weighted by 1 / distance^(2 alpha); a place on a match takes nearly its displacement."""
    out = []
    for x in at:
        w = 1.0 / np.maximum(((p - x) ** 2).sum(1), 1e-12) ** alpha
        try:
            out.append(fit_affine(p, q, w / w.sum()))
        except np.linalg.LinAlgError:
            out.append(fit_translation(p, q, w))
    return np.array(out)


# ---- graphs -----------------------------------------------------------------------------------------------------


def conjugate_gradients(apply, right: np.ndarray, precondition, share: float = 1e-28) -> np.ndarray:
    """x with apply(x) = right, of a symmetric map that has no negative directions; memory is a few arrays as large as x."""
    x = np.zeros_like(right)
    r = right.copy()
    z = precondition(r)
    d, rz = z.copy(), float((r * z).sum())
    first = rz
    for _ in range(20 * len(right) + 200):
        if rz <= first * share or rz <= 1e-300:
            break
        h = apply(d)
        along = float((d * h).sum())
        if along <= 0:
            break
        x += rz / along * d
        r -= rz / along * h
        z = precondition(r)
        after = float((r * z).sum())
        d, rz = z + after / rz * d, after
    return x


def solve_translations(n: int, edges: list[tuple[int, int, float, np.ndarray]], fixed: set[int]) -> np.ndarray:
    """Positions of least squares of a graph: each edge asks x[a] - x[b] = shift, with its weight; fixed nodes stay at 0.

    A component without a fixed node has its smallest node fixed.
    """
    parent = list(range(n))

    def top(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b, _, _ in edges:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    fixed = set(fixed)
    for c in {top(i) for i in range(n)} - {top(i) for i in fixed}:
        fixed.add(c)
    free = np.ones(n, bool)
    free[list(fixed)] = False
    a, b = np.array([e[0] for e in edges], int), np.array([e[1] for e in edges], int)
    w = np.array([e[2] for e in edges], float)
    shift = np.array([e[3] for e in edges], float).reshape(-1, 3)

    def gather(v: np.ndarray) -> np.ndarray:
        out = np.zeros((n, 3))
        np.add.at(out, a, v)
        np.add.at(out, b, -v)
        return out * free[:, None]

    weight = np.bincount(a, w, n) + np.bincount(b, w, n)
    out = conjugate_gradients(lambda x: gather(w[:, None] * (x[a] - x[b])), gather(w[:, None] * shift), lambda r: r / np.where(weight > 0, weight, 1.0)[:, None])
    return out
