"""Density clusters against a version that follows the definition from the top, for both ways of computing them."""
import os
import random

import pytest

from tidewatch.ml import density as D


def plain(points, pairs, reach, smallest, samples):
    """points: {id: n}, pairs: {(a, b): level}."""
    level = {**pairs, **{(b, a): v for (a, b), v in pairs.items()}}
    core = {}
    for i, n in points.items():
        near = sorted([(1, n - 1)] + [(v, points[b]) for (a, b), v in level.items() if a == i])
        have = 0
        for v, m in near:
            have += m
            if have >= samples:
                core[i] = v
                break
    join = {(a, b): max(v, core[a], core[b]) for (a, b), v in level.items() if a in core and b in core}

    def split(ids, top):
        left, out = set(ids), []
        while left:
            todo, part = [left.pop()], set()
            while todo:
                i = todo.pop()
                part.add(i)
                near = [b for b in left if join.get((i, b), top + 1) <= top]
                left -= set(near)
                todo += near
            out.append(part)
        return out

    size = lambda ids: sum(points[i] for i in ids)

    def grown(ids, level):
        """(sum of densities, value of the clusters inside, labels) of a set that is connected at a level."""
        if len(ids) == 1:
            return points[min(ids)] / core[min(ids)], 0.0, {}
        while len(parts := split(ids, level - 1)) == 1:
            level -= 1
        inside = [(p, grown(p, level - 1)) for p in parts]
        labels = {i: c for _, (_, _, found) in inside for i, c in found.items()}
        large = [(p, g) for p, g in inside if size(p) >= smallest]
        if len(large) == 1:
            ((p, (total, best, _)),) = large
            return total + (size(ids) - size(p)) / level, best, labels
        value = 0.0
        for p, g in large:
            worth, won = ended(p, g, level)
            value += worth
            labels |= won
        return size(ids) / level, value, labels

    def ended(ids, state, level):
        total, best, _ = state
        own = total - size(ids) / level
        return max(own, best), dict.fromkeys(ids, min(ids)) if own >= best - 1e-9 else {}

    out = dict.fromkeys(points)
    for part in split(core, reach):
        state = grown(part, reach)
        out |= state[2]
        if size(part) >= smallest:
            out |= ended(part, state, reach + 1)[1]
    return out


def planted(seed, reach):
    """Points on a line in groups of different density, with strays and heavy points."""
    rng, at, where = random.Random(seed), 0, {}
    for group in range(7):
        step = rng.choice([1, 1, 2, 4, 9])
        for _ in range(rng.choice([1, 3, 6, 14])):
            where[rng.randrange(10**6)] = at
            at += rng.randint(1, step) if rng.random() < 0.9 else rng.randint(0, 12)
        at += rng.choice([3, 8, 15, 40])
    points = {i: rng.choice([1, 1, 1, 2, 3, 8]) for i in where}
    width = 20 / reach
    pairs = {(a, b): max(1, int(abs(where[a] - where[b]) / width)) for a in where for b in where if a < b and int(abs(where[a] - where[b]) / width) <= reach}
    return points, pairs


@pytest.mark.parametrize("seeds,reach,part", [((1, 2, 3, 4), 20, D.PART), pytest.param((4,), 3, 10, marks=pytest.mark.skipif(not os.environ.get("SLOW_TESTS"), reason="hundreds of small jobs"))])
def test_planted_clusters(spark, seeds, reach, part):
    points, pairs = {}, {}
    for seed in seeds:                                   # parts of their own
        p, e = planted(seed, reach)
        points |= {i + seed * 10**6: n for i, n in p.items()}
        pairs |= {(a + seed * 10**6, b + seed * 10**6): v for (a, b), v in e.items()}
    points |= {1: 9, 2: 1, 3: 4, 4: 1, 5: 5, **dict.fromkeys(range(100, 120), 1)}          # alone, and a chain whose points have two neighbours each
    pairs |= {(i, i + 1): 1 for i in range(100, 119)}
    want = plain(points, pairs, reach, 5, 3)
    assert [want[i] for i in (1, 2, 3, 4, 5, 105)] == [1, None, None, None, 5, None]
    p = spark.createDataFrame(list(points.items()), "id bigint, n int")
    e = spark.createDataFrame([(a, b, v) for (a, b), v in pairs.items()], "a bigint, b bigint, level int")
    assert {r.id: r.label for r in D.density_clusters(p, e, reach, part=part).collect()} == want
    assert len(set(want.values()) - {None}) > 1 and None in want.values()
