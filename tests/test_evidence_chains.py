"""Attribution by a plain loop, grounding by fragments of odd texts, and sampled sign flips."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from palimpsest.operators import answers as N
from palimpsest.operators import attribution as A
from palimpsest.operators import grounding as G
from palimpsest.operators import scoring as K

HOOKS = "hook long, plant int, trigger int, window_start int, window_end int, last int, scoring array<int>, route string, gold boolean, seeds array<string>, attrs array<string>"
CHAINS = "hook long, predicate string, provenance string, disclosed boolean, laundered boolean, conflict boolean, used boolean"
OUTPUTS = "hook long, predicate string, place int, grounded boolean"
HISTORY = "hook long, predicate string, place int, unit string, grounded boolean, in_prompt boolean, cap string, unit_sources array<int>"
SOURCES = "hook long, predicate string, unit string, place int, grounded boolean"
HOOK = {"plant": 1, "window": range(5, 10), "scoring": [6, 8]}


def loop(chain, outputs, history, sources):
    """The rules of a valid chain, one after the other."""
    _, _, provenance, disclosed, laundered, conflict, used = chain
    if provenance not in ("D", "T") or disclosed or laundered or conflict or not used or not outputs or not history or not sources:
        return False
    if any(p not in HOOK["window"] or not ok for _, _, p, ok in outputs):
        return False
    if any(not h[3] for h in history) or {h[3] for h in history} != {s[2] for s in sources}:
        return False
    history = sorted(history, key=lambda h: (h[2], h[3]))
    if history[-1][2] not in HOOK["scoring"] or history[-1][2] not in {o[2] for o in outputs}:
        return False
    carriers = {HOOK["plant"]}
    for _, _, place, unit, ok, in_prompt, _, drawn in history:
        own = [s for s in sources if s[2] == unit]
        if not ok or in_prompt or any(s[3] not in drawn or s[3] >= place or not s[4] for s in own) or not carriers & {s[3] for s in own}:
            return False
        carriers.add(place)
    return provenance != "D" or (history[-1][6] == "D" and HOOK["plant"] in history[-1][7])


def test_valid_chains_by_a_plain_loop(spark):
    rng = random.Random(8)
    hooks = [(1, 1, 3, 5, 9, 12, [6, 8], "essential", True, ["a"], ["b"])]
    chains, outputs, history, sources = [], [], [], []
    for i in range(300):
        name = f"p{i}"
        rare = lambda: rng.random() < 0.04
        chains.append((1, name, rng.choice("DTTTX"), rare(), rare(), rare(), not rare()))
        before = [1]
        for place in sorted(rng.sample(range(2, 9), rng.randrange(3))) + [rng.choice([6, 8, 8, 7])] * (not rare()):
            unit = f"u{place}" if not rare() else ""
            drawn = sorted({*rng.sample(before, 1), rng.randrange(1, 9), 1})
            history.append((1, name, place, unit, not rare(), rare(), rng.choice("DDT"), drawn))
            for s in {rng.choice(before if not rare() else [7]), *([rng.choice(drawn)] if rare() else [])}:
                if not rare():
                    sources.append((1, name, unit, s, not rare()))
            before.append(place)
        outputs += [(1, name, p, not rare()) for p in {before[-1], rng.choice([5, 6, 9, 9, 10])} if not rare() or p == 6]
        if rare():
            sources.append((1, name, "elsewhere", 1, True))
    frames = [spark.createDataFrame(*x) for x in ((hooks, HOOKS), (chains, CHAINS), (outputs, OUTPUTS), (history, HISTORY), (sources, SOURCES))]
    got = {r["predicate"]: r["valid"] for r in A.valid_chains(*frames).collect()}
    of = lambda rows, c: [r for r in rows if r[1] == c[1]]
    want = {c[1]: loop(c, of(outputs, c), of(history, c), of(sources, c)) for c in chains}
    assert got == want and 20 < sum(want.values()) < 200
    assert A.valid_chains(frames[0], frames[1].limit(0), *frames[2:]).count() == 0


def test_categories_of_odd_hooks(spark):
    hook = lambda i, route, gold, seeds, attrs: (i, 1, 3, 5, 9, 12, [6], route, gold, seeds, attrs)
    hooks = spark.createDataFrame([hook(1, "essential", True, ["a"], ["b"]), hook(2, "essential", False, ["a"], ["b"]), hook(3, "attempted", None, ["a"], ["b"]), hook(4, None, True, ["a"], ["b"]), hook(5, "essential", True, ["a"], ["b"]), hook(6, "essential", True, ["a"], ["b", "c"]), hook(7, "essential", True, ["a"], ["a"])], HOOKS)
    chain = lambda h, p, hidden=True: (h, p, "T", not hidden, False, None, True)
    chains = spark.createDataFrame([chain(h, p, (h, p) != (3, "a")) for h in (1, 2, 3, 4, 5) for p in "ab"] + [chain(6, "a"), chain(6, "b"), chain(7, "a")], CHAINS)
    valid = spark.createDataFrame([(h, p, (h, p) in {(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "b"), (7, "a")}) for h in range(1, 8) for p in "ab"], "hook long, predicate string, valid boolean")
    local = spark.createDataFrame([(4, True), (1, True)], "hook long, local boolean")
    got = {r["hook"]: (r["status"], r["category"]) for r in A.categories(hooks, chains, valid, local).collect()}
    assert got == {1: ("full", "G"), 2: ("full", "P"), 3: ("min", "P"), 4: ("none", "L"), 5: ("none", "F"), 6: ("invalid", None), 7: ("full", "G")}


def test_local_resolutions(spark):
    roles = [("problem", 3), ("resource", 2), ("operation", 6), ("mechanism", 7), ("result", 8), ("continuity", 10), ("verification", 6)]
    change = {1: {}, 2: {"problem": 4}, 3: {"operation": 9, "result": 8}, 4: {"continuity": 13}, 5: {"resource": 7}, 6: {"result": 10}, 7: {"verification": 9}, 8: {"mechanism": None}, 9: {}, 10: {}, 11: {}, 12: {}}
    hooks = spark.createDataFrame([(h, 1, 3, 5, 9, 12, [6], "r", True, ["a"], ["b"]) for h in change], HOOKS)
    anchors = spark.createDataFrame([(h, r, c.get(r, p), True) for h, c in change.items() for r, p in roles if r not in c or c[r] is not None], "hook long, role string, place int, grounded boolean")
    kinds = {9: "prompt_scaffolded", 10: "historical_alternative", 11: "mixed", 12: None}
    resolutions = spark.createDataFrame([(h, True, kinds.get(h, "window_verified")) for h in change], "hook long, basic boolean, subtype string")
    prompts = spark.createDataFrame([(9, True), (9, False), (11, True)], "hook long, grounded boolean")
    histories = spark.createDataFrame([(10, True, [2, 5]), (11, True, [5])], "hook long, grounded boolean, unit_sources array<int>")
    got = {r["hook"]: r["local"] for r in A.local_resolutions(hooks, resolutions, anchors, prompts, histories).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False, 7: False, 8: False, 9: False, 10: True, 11: True, 12: False}


def test_grounding_of_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(G, "BLOCK", 2)
    claims = [(1, "The Quick, brown fox"), (2, "quickbrown!the lazy dog;ran away far"), (3, "ran away far;the lazy dog"), (4, "fox"), (5, None), (6, ""), (7, "ＱＵＩＣＫ　ｂｒｏｗｎ"), (8, "aaaaaaaaa;aaaaaaaaa"), (None, "quick brown"), (2, "no such words at all"), (9, "short;x;y")]
    sources = [(1, "the quick brown fox - the LAZY dog. ran away far"), (2, "a" * 18), (3, "a" * 17), (4, None), (5, ""), (None, "the quick brown fox"), (1, "shortxy")]
    got = G.grounded(spark.createDataFrame(claims, "id long, text string"), spark.createDataFrame(sources, "id long, text string"), "id", "id", "text").collect()
    assert {tuple(r) for r in got} == {(1, 1, "whole", 0), (2, 1, "fragments", 3), (7, 1, "whole", 3), (8, 2, "whole", 0)}
    assert G.grounded(spark.createDataFrame([], "id long, text string"), spark.createDataFrame(sources, "id long, text string"), "id", "id", "text").count() == 0


def test_sampled_flips_restated(spark):
    rng = np.random.default_rng(0)
    d = np.round(rng.normal(0.05, 1, 200), 6)
    frame = spark.createDataFrame([(i, float(x)) for i, x in enumerate(d)] + [(999, None)], "k long, d double")
    v, sums = np.round(d * 1e9).astype(np.int64), []
    for r in range(4096):
        sums.append(sum(-x if int(hashlib.md5(f"17:{i}:{r // 128}".encode()).hexdigest()[r % 128 // 4], 16) >> (3 - r % 4) & 1 else x for i, x in enumerate(v.tolist())))
    want = np.mean([abs(s) >= abs(int(v.sum())) for s in sums])
    for parts in (1, 7):
        row = N.sign_flip_test(frame.repartition(parts), "k", "d").first()
        assert (row["n"], row["p"]) == (200, pytest.approx(want, abs=1e-9))
    assert N.sign_flip_test(frame.limit(0), "k", "d").count() == 0


def test_sampled_flips_are_near_the_exact_test(spark):
    frame = spark.createDataFrame([(i, x) for i, x in enumerate([1.0, -0.5, 2.0, 0.25, -1.5, 0.75, 3.0, 1.25, -0.25, 0.5, 1.0, -2.0, 0.1, 0.9])], "k long, d double")
    exact, sampled = (N.sign_flip_test(frame, "k", "d", most).first()["p"] for most in (14, 3))
    assert abs(exact - sampled) < 4 * (exact * (1 - exact) / 4096) ** 0.5


def test_reliability_restated(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(2), rng.choice([0, 1, 1])) for _ in range(300)] + [("c", 1, 1), ("a", None, 1), ("b", 0, None), ("d", None, None)]
    frame = spark.createDataFrame(rows, "g string, x int, y int")
    got = {r["g"]: tuple(r)[1:] for r in K.reliability(frame.repartition(4), "g", "x", "y", 400, 5).collect()}
    want = {}
    for g in ("a", "b", None, "c"):
        own = [(x, y) for h, x, y in rows if h == g and None not in (x, y)]
        n, a, b = len(own), own.count((1, 0)), own.count((0, 1))
        drawn = np.random.default_rng([5, zlib.crc32(b"-" if g is None else f"={g}".encode())]).multinomial(n, [a / n, b / n, (n - a - b) / n], 400)
        deltas = sorted(((drawn[:, 0] - drawn[:, 1]) / n).tolist())
        want[g] = (n, a, b, *(pytest.approx(v, abs=1e-9) for v in ((a - b) / n, deltas[10], deltas[390])))
    assert got == want
    assert want["c"][3:] == (0.0, 0.0, 0.0) and K.reliability(frame.limit(0), "g", "x", "y").count() == 0
