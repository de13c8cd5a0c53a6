"""Plain restatements of the kernels, for the tests."""

import math
import re

COMPLEMENT = {"A": "T", "C": "G", "G": "C", "T": "A"}


def half_up(x):
    """Two places, as SQL rounds."""
    return math.floor(x * 100 + 0.5 + 1e-9) / 100


def greedy(rows):
    """rows: (start, end, ...) in order of preference; those that overlap none before."""
    kept = []
    for r in rows:
        if all(r[1] <= k[0] or r[0] >= k[1] for k in kept):
            kept.append(r)
    return sorted(kept)


def arms(seq, same, most_loop, longest):
    out = set()
    for i in range(len(seq) - 11):
        for loop in range(most_loop + 1):
            j = i + 6 + loop
            if j + 6 > len(seq) or not all(same(seq[i + 5 - t], seq[j + t]) for t in range(6)):
                continue
            left, right, n = i, j + 6, 6
            while n < longest and left > 0 and right < len(seq) and same(seq[left - 1], seq[right]):
                left, right, n = left - 1, right + 1, n + 1
            out.add((left, n, loop))
    return out


def cruciforms(seq, stacking):
    rows = []
    for left, arm, loop in arms(seq, lambda a, b: COMPLEMENT.get(a) == b, 12, 50):
        energy = sum(stacking[seq[i : i + 2]] for i in range(left, left + arm - 1)) + (4.0 if not loop else 1.75 + 0.6 * math.log(loop)) if arm >= 8 else 0
        raw = round(min(1, -energy / 20), 6)
        if arm >= 8 and energy <= -5 and raw > 0.2:
            rows.append((left, left + 2 * arm + loop, raw, arm))
    rows.sort(key=lambda r: (-r[2], -(r[1] - r[0]), r[0], -r[3]))
    return [r[:3] for r in greedy(rows)]


def mirrors(seq):
    rows = []
    for left, arm, loop in arms(seq, lambda a, b: a == b and a in "ACGT", 8, 100):
        p = sum(x in "AG" for x in seq[left : left + arm])
        if arm >= 10 and max(p, arm - p) / arm >= 0.9:
            score = 1 + 2 * min(1, 0.35 * min(1, math.log(arm, 35)) + 0.2 * math.exp(-0.4 * loop) + 0.3 * (max(p, arm - p) / arm - 0.8) / 0.2 + 0.15 / (1 + min(p, arm - p)))
            rows.append((left, left + 2 * arm + loop, round(score, 3), arm, loop))
    rows.sort(key=lambda r: (-r[3], r[4], r[0]))
    return [r[:3] for r in greedy(rows)]


def rloops(seq):
    """(start, end, strand, pattern, riz, rez) on both strands."""
    out = []
    for strand, s in (("+", seq), ("-", "".join(COMPLEMENT.get(x, x) for x in reversed(seq)))):
        for name, p in (("QmRLFS-m1", "G{3,}[ATCG]{1,10}?G{3,}(?:[ATCG]{1,10}?G{3,}){1,}?"), ("QmRLFS-m2", "G{4,}(?:[ATCG]{1,10}?G{4,}){1,}?")):
            for m in re.finditer(p, s):
                riz = half_up(m[0].count("G") * 100 / len(m[0]))
                if riz < 50:
                    continue
                stop, best, end, rez = min(len(s), m.end() + 2000), 0, m.end(), 0
                for a in range(m.end() + 50, stop, 100):
                    first = s[a : a + 100]
                    if first.count("G") * 100 / len(first) < 40:
                        continue
                    for b in range(a + 50, stop, 50):
                        g = s[a:b].count("G")
                        if g * 100 / (b - a) >= 40 and g > best:
                            best, end, rez = g, b, half_up(g * 100 / (b - a))
                span = (m.start(), end) if strand == "+" else (len(s) - end, len(s) - m.start())
                out.append((*span, strand, name, riz, rez))
    return sorted(out)


def quadruplexes(seq, patterns, priority):
    areas = []
    for m in re.finditer("G{3,}", seq):
        a, b = max(0, m.start() - 50), min(len(seq), m.start() + 200)
        if areas and a <= areas[-1][1]:
            areas[-1][1] = max(areas[-1][1], b)
        else:
            areas.append([a, b])
    rows = []
    for a, b in areas:
        for name, p in patterns.items():
            for m in re.finditer(p, seq[a:b]):
                n = len(m[0])
                if n >= 8:
                    w = min(25, n)
                    most = max(m[0][i : i + w].count("G") for i in range(n - w + 1))
                    rows.append((a + m.start(), a + m.end(), name, round(most / w * (n / w), 6)))
    rows.sort(key=lambda r: (-r[3], priority[r[2]], -(r[1] - r[0]), r[0]))
    return greedy(rows)


def unit(s):
    return next((s[:k] for k in range(1, len(s) // 2 + 1) if (s[:k] * len(s))[: len(s)] == s), s)


def palindrome(s):
    rc = lambda x: "".join(COMPLEMENT.get(b, b) for b in reversed(x))
    return max((j - i for i in range(len(s)) for j in range(i + 1, len(s) + 1) if s[i:j] == rc(s[i:j])), default=0)


def scores(s):
    """The nine stand-alone scores, for sequences of 20 bases or more."""
    n = len(s)
    runs = lambda p: [len(m[0]) for m in re.finditer(p, s)]
    powered = lambda p, x: sum(k**x for k in runs(p))
    tracts, skew, w = runs("C{2,}"), abs(s.count("G") - s.count("C")), min(25, n)
    pur = lambda b: b in "AG"
    steps = [1.5 if s[i : i + 2] in ("CG", "GC") else float(s[i] in "ACGT" and s[i + 1] in "ACGT" and pur(s[i]) != pur(s[i + 1])) for i in range(n - 1)]
    known = sum(s.count(b) for b in "ACGT")
    best = palindrome(s)
    out = {
        "imotif": sum(tracts) / n + len(tracts) / 4 * 0.2 if len(tracts) >= 3 else 0.0,
        "curvature": (powered("A{3,}", 1.5) + powered("T{3,}", 1.5)) / n,
        "triplex": max(powered("[AG]{5,}", 1.2), powered("[CT]{5,}", 1.2)) / n**1.2 if n >= 15 else 0.0,
        "r_loop": skew / n * 0.6 + (s.count("G") + s.count("C")) / known * 0.4,
        "a_philic": s.count("A") / n * 0.7 + powered("A{3,}", 1.2) / n * 0.3,
        "g4hunter": max(abs(s[i : i + w].count("G") - s[i : i + w].count("C")) for i in range(n - w + 1)) / w,
        "instability": max(max((len(m[0]) // k for m in re.finditer(f"([ACGTN]{{{k}}})\\1{{2,}}", s)), default=0) * k**0.5 for k in range(1, 7)) / 10,
        "cruciform": best**1.5 / n if best >= 8 else 0.0,
    }
    return {k: round(min(1.0, v), 6) for k, v in out.items()} | {"z_dna": round(sum(steps) / (n - 1), 6)}
