"""The matching rules in plain Python, written from their definitions."""

from __future__ import annotations

import math
from collections import defaultdict
from itertools import groupby

T = 31


def sizes(t=T):
    step = t // 2
    return step, t - step + 1


def seeds(text, t=T):
    step, k = sizes(t)
    return [(p, text[p : p + k]) for p in range(0, max(0, len(text) - t), step)]


def hits(reads, refs, t=T):
    _, k = sizes(t)
    where = defaultdict(list)
    for ref, text in refs.items():
        for p in range(len(text) - k + 1):
            word = text[p : p + k]
            if word != "N" * k:
                where[word].append((ref, p))
    return {(q, ref, qpos, rpos) for q, text in reads.items() for qpos, w in seeds(text, t) for ref, rpos in where[w]}


def near_best(hit_rows):
    kept = set()
    for q, rows in groupby(sorted(hit_rows), key=lambda h: h[0]):
        rows = list(rows)
        number = {p: i for i, p in enumerate(sorted({h[2] for h in rows}))}
        streak = {}
        for ref in {h[1] for h in rows}:
            got = {number[h[2]] for h in rows if h[1] == ref}
            best = 0
            for n in got:
                if n - 1 not in got:
                    length = 1
                    while n + length in got:
                        length += 1
                    best = max(best, length)
            streak[ref] = best
        floor = max(1, max(streak.values()) - 1)
        kept |= {h for h in rows if streak[h[1]] >= floor}
    return kept


def runs(hit_rows, step, diagonal=False):
    out = []
    pairs = defaultdict(list)
    for q, ref, qpos, rpos in hit_rows:
        pairs[q, ref].append((rpos, qpos))
    for (q, ref), found in pairs.items():
        lanes = defaultdict(list)
        for r, p in sorted(found):
            lanes[r - p if diagonal else 0].append((r, p))
        for lane in lanes.values():
            current = []
            for r, p in lane:
                if current and current[-1] == (r - step, p - step):
                    current.append((r, p))
                else:
                    if current:
                        out.append((q, ref, current))
                    current = [(r, p)]
            out.append((q, ref, current))
    return {(q, ref, len(c), c[0][1], c[0][0], c[-1][1] + step, c[-1][0] + step) for q, ref, c in out}


def tied_longest(run_rows):
    kept = set()
    for q in {r[0] for r in run_rows}:
        mine = [r for r in run_rows if r[0] == q]
        longest = defaultdict(int)
        for r in mine:
            longest[r[1]] = max(longest[r[1]], r[2])
        best = max(longest.values())
        if best >= 2:
            kept |= {r for r in mine if longest[r[1]] == best}
    return kept


def scores(run_rows, reads, refs, t=T, extend=True):
    totals = {}
    for q, ref, _, q0, r0, q1, r1 in run_rows:
        read, text = reads[q], refs[ref]
        head = tail = 0
        if extend:
            while head < min(t, q0, r0) and read[q0 - head - 1] == text[r0 - head - 1]:
                head += 1
            while tail < min(t, len(read) - q1, len(text) - r1) and read[q1 + tail] == text[r1 + tail]:
                tail += 1
        m = head + q1 - q0 + tail
        if m >= t:
            s, c, covered = totals.setdefault((q, ref), (0, 0, set()))
            totals[q, ref] = (s + m * (m + 1) // 2, c + m, covered | set(range(q0 - head, q0 - head + m)))
    out = {}
    for (q, ref), (s, c, covered) in totals.items():
        raw = s / c / 100 * (100 * len(covered) / len(reads[q]))
        shorter = min(len(reads[q]), len(refs[ref]))
        out[q, ref] = (s, c, len(covered), round(math.log(raw + 1) / math.log((shorter + 1) / 2 + 1), 6))
    return out
