"""Plain Python statement of the motion rules, used to check the Spark operators on small inputs."""

import math
import statistics as st

from reelgrid.config import AnalysisConfig, round_half_up, window_samples

CFG = AnalysisConfig()


def clamp(x):
    return min(1.0, max(0.0, x))


def label_of(f, s):
    c = CFG.classify
    tx, ty, px, py = abs(f["dx"]), abs(f["dy"]), abs(f["px"]), abs(f["py"])
    zoom, rot = abs(f["div"]) * c.effective_radius, abs(f["rot"]) * c.effective_radius
    if max(tx, ty, zoom, rot, px / 2, py / 2) < c.static_max:
        return "static"
    if f["fit"] < 1 - (1 - c.erratic_fit_min) / s.strictness:
        return "erratic"
    t = max(tx, ty)
    if rot >= c.rotation_dominance * max(t, zoom, px / 2):
        return "orbit_left" if f["rot"] > 0 else "orbit_right"
    d = abs(f["div"])
    centred = zoom >= c.static_max and tx <= c.foe_max_x * d and ty <= c.foe_max_y * d
    if centred or zoom >= c.zoom_dominance * max(t, px / 2):
        return "forward" if f["div"] > 0 else "backward"
    if max(tx, px / 2) >= max(ty, py / 2):
        if px >= c.orbit_parallax_min and tx <= c.orbit_parallax_ratio * px:
            return "orbit_right" if f["px"] > 0 else "orbit_left"
        return "pan_right" if f["dx"] < 0 else "pan_left"
    if py >= c.ascend_parallax_ratio * ty:
        return "ascend" if f["dy"] > 0 else "descend"
    return "tilt_up" if f["dy"] > 0 else "tilt_down"


def signals(fs, s):
    c, n, fps = CFG.segment, len(fs), s.analysis_fps
    h = window_samples(c.smooth_window_sec, fps) // 2
    near = lambda xs, i, k: xs[max(0, i - k) : i + k + 1]
    raw = [label_of(f, s) for f in fs]

    def vote(i):
        w = near(raw, i, h)
        best = max(w.count(x) for x in w)
        return raw[i] if w.count(raw[i]) == best else next(x for x in w if w.count(x) == best)

    r = CFG.classify.effective_radius
    speeds = [math.hypot(f["dx"], f["dy"]) + (abs(f["div"]) + abs(f["rot"])) * r + abs(f["px"]) / 2 for f in fs]
    speed = [st.median(near(speeds, i, h)) for i in range(n)]
    fit = [st.median(near([f["fit"] for f in fs], i, h)) for i in range(n)]
    change = [0.0] + [
        math.hypot(b["dx"] - a["dx"], b["dy"] - a["dy"]) + abs(b["div"] - a["div"]) * r + abs(b["rot"] - a["rot"]) * r
        for a, b in zip(fs, fs[1:])
    ]
    jt = max(c.jerk_floor, c.jerk_factor * st.median(change)) / s.strictness
    vt = max(c.jerk_floor**2, c.jerk_factor * st.median(f["mag_var"] for f in fs)) / s.strictness
    ref = st.median(f["sharpness"] for f in fs)
    bad, jerk = [], []
    for f, ch in zip(fs, change):
        strong = ch > 2 * jt
        dark = f["brightness"] < c.dark_luma or f["brightness"] > c.bright_luma or f["overexposed"] > c.clip_share
        bad.append(strong or dark or (ref > 0 and f["sharpness"] < c.blur_ratio * ref))
        jerk.append(not strong and (ch > jt or f["mag_var"] > vt))
    w = max(2, round_half_up(c.speed_jump_window_sec * fps))
    score = [0.0] * n
    for i in range(w, n - w + 1):
        if i < n:
            a, b = st.median(speed[i - w : i]), st.median(speed[i : i + w])
            if max(a, b) >= c.speed_jump_floor and abs(a - b) / max(a, b) > min(0.95, c.speed_jump_ratio / s.strictness):
                score[i] = abs(a - b) / max(a, b)
    jump = [
        score[i] > 0 and score[i] > max([0, *score[max(0, i - w) : i]]) and score[i] >= max([0, *score[i + 1 : i + w + 1]])
        for i in range(n)
    ]
    steps = [ch + (abs(speed[i] - speed[i - 1]) if i else 0) for i, ch in enumerate(change)]
    k = window_samples(1, fps) // 2
    return dict(
        label=[vote(i) for i in range(n)], speed=speed, fit=fit, bad=bad, jerk=jerk, jump=jump, ref=ref,
        unrest=[st.median(near(steps, i, k)) for i in range(n)],
    )


def runs_of(sig):
    """[start, end, label, joined] where joined tells that only a class change precedes the run."""
    out = []
    for i, (bad, label) in enumerate(zip(sig["bad"], sig["label"])):
        if bad:
            continue
        follows = out and out[-1][1] == i
        if follows and not sig["jump"][i] and out[-1][2] == label:
            out[-1][1] = i + 1
        else:
            out.append([i, i + 1, label, bool(follows and not sig["jump"][i])])
    return out


def merged(runs, gap):
    out, k = [], 0
    while k < len(runs):
        a, b, label, _ = runs[k]
        k += 1
        while True:
            skipped, m = 0, k
            while m < len(runs) and runs[m][3] and runs[m][2] != label and skipped + runs[m][1] - runs[m][0] <= gap:
                skipped += runs[m][1] - runs[m][0]
                m += 1
            if m == len(runs) or not runs[m][3] or runs[m][2] != label:
                break
            b, k = runs[m][1], m + 1
        out.append((a, b, label))
    return out


def pieces(a, b, sig, s):
    fps = s.analysis_fps
    lo_n, hi_n = round_half_up(s.min_duration * fps), round_half_up(s.max_duration * fps)
    size = b - a
    if size <= hi_n:
        return [(a, b)]
    fewest, most = math.ceil(size / hi_n), size // lo_n
    if fewest > most:
        starts = range(a, b - hi_n + 1)
        best = min(starts, key=lambda x: (sum(sig["unrest"][x : x + hi_n]) / hi_n, x))
        return [(best, best + hi_n)]
    n = max(fewest, min(most, round_half_up(size / (s.target_duration * fps))))
    reach = round_half_up(CFG.segment.split_search_sec * fps)
    edges = [a]
    for k in range(1, n):
        ideal = round_half_up(a + k * size / n)
        lo = max(edges[-1] + lo_n, b - (n - k) * hi_n, ideal - reach)
        hi = min(edges[-1] + hi_n, b - (n - k) * lo_n, ideal + reach)
        cost = lambda x: sig["unrest"][x] + abs(x - ideal) / max(1, reach) * 1e-3
        edges.append(min(range(lo, hi + 1), key=lambda x: (cost(x), x)) if lo <= hi else max(min(ideal, hi), lo))
    edges.append(b)
    return list(zip(edges, edges[1:]))


def segments(fs, s):
    sig, fps, trim = signals(fs, s), s.analysis_fps, CFG.segment.trim_sec
    cut = math.ceil(trim * fps - 1e-9)
    out = []
    for a, b, label in merged(runs_of(sig), round_half_up(CFG.segment.merge_gap_sec * fps)):
        start, end = fs[a]["t"] + trim, fs[b - 1]["t"] + 1 / fps - trim
        if label == "erratic" or (label == "static" and not s.include_static) or end - start < s.min_duration:
            continue
        parts = pieces(a + cut, b - cut, sig, s)
        for k, (p, q) in enumerate(parts):
            x = start if k == 0 else fs[p]["t"]
            y = end if k == len(parts) - 1 else fs[q]["t"]
            if y - x >= s.min_duration - 1e-6:
                out.append((round(x, 6), round(y, 6), label, score(fs, sig, p, q)))
    return sorted(out)


def score(fs, sig, p, q):
    c, ids = CFG.score, range(p, q)
    mean = lambda xs: sum(xs) / len(xs)
    v = [sig["speed"][i] for i in ids]
    m = mean(v)
    cv = st.pstdev(v) / m if m > CFG.classify.static_max else 0
    sharp = st.median(fs[i]["sharpness"] for i in ids) / sig["ref"] if sig["ref"] > 0 else 1

    def light(f):
        y = f["brightness"]
        q = clamp((y - 25) / 25) if y < 50 else clamp((235 - y) / 25) if y > 210 else 1
        return q * clamp(1 - f["overexposed"] / CFG.segment.clip_share)

    bumps = sum(1 for i in ids if sig["jerk"][i] and not (i and sig["jerk"][i - 1]))
    return (
        c.smoothness * clamp(mean([sig["fit"][i] for i in ids])) + c.speed_stability * clamp(1 - cv / c.speed_cv_max)
        + c.sharpness * clamp(sharp) + c.exposure * clamp(mean([light(fs[i]) for i in ids])) - c.jerk_penalty * bumps
    )
