"""Suffix-array dedup, collocations and the Merkle manifest against brute force on odd rows; their queries are held against SQL in test_operators.py."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest

from palimpsest.llm import collocations, merkle, suffix_array

LONG = "".join(f"w{i} " for i in range(30000))
ODD = [(1, None), (2, ""), (3, "   \t\n"), (4, "one"), (5, LONG), (6, LONG), (7, LONG + " x"), (None, LONG), (8, "one"), (8, "one"), (9, "İstanbul ß <|endoftext|> ▁x 日本" * 9), (10, "a" * 700), (11, "b" + "a" * 60), (12, "日本語" * 40)]
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, rid long, spans string, n_bytes long, leaf string, place long, block long, n long, chunk long, words string, count long, id long"


def clashing(spark, rows):
    """Rows (doc_id, text, lang, source, n_chars) with more columns that are called like the operators' own."""
    return spark.createDataFrame([(*r, 7, "s", 7, "l", 7, 7, 7, 7, "w", 7, 7) for r in rows], CLASHING)


def brute_bytes(rows, size):
    first, out = {}, []
    raw = [(d, (t or "").encode()) for d, t in rows]
    for d, t in raw:
        for i in range(len(t) - size + 1):
            if d is not None:
                first[t[i : i + size]] = min(d, first.get(t[i : i + size], d))
    for d, t in raw:
        gone = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if d is not None and first[t[i : i + size]] < d:
                gone[i : i + size] = b"\x01" * size
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((str(d), len(t), sum(gone), len(re.findall(b"\x01+", bytes(gone))), kept))
    return sorted(out)


def digests(df):
    return sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in df.collect())


def test_suffix_array_dedup_of_odd_rows(spark):
    docs = clashing(spark, [(d, t, None, None, None) for d, t in ODD])
    got = suffix_array.without_repeats(docs, 50, "n_bytes", "rid", "lang")
    assert digests(got) == brute_bytes(ODD, 50)
    assert all(r["n_bytes_in"] == 7 and r["rid_in"] == 7 and r["kept_sha256"] == hashlib.sha256(r["kept"]).hexdigest() for r in got.collect())
    assert suffix_array.without_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("size", [9, 20, 50])
def test_suffix_array_dedup_of_overlapping_passages(spark, monkeypatch, size):
    """Chains of copies with changes, spread over many shards, parts, blocks and salts."""
    for name, value in {"SHARD_BYTES": 400, "STREAM_BYTES": 900, "PART_WINDOWS": 300, "BLOCK": 256}.items():
        monkeypatch.setattr(suffix_array, name, value)
    rng = random.Random(size)
    passages = [bytes(rng.choice(b"abcd \n") for _ in range(rng.randrange(30, 400))).decode() for _ in range(6)]
    rows = []
    for d in range(90):
        text = ""
        for _ in range(rng.randrange(4)):
            p = list(rng.choice(passages))
            for _ in range(rng.randrange(3)):
                p[rng.randrange(len(p))] = rng.choice("xyzß")
            text += "".join(p[rng.randrange(20) :]) + rng.choice(["", "日", "q"])
        rows.append((rng.choice([d, d, d, None, 5]), text))
    got = suffix_array.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), size)
    assert digests(got) == brute_bytes(rows, size)


@pytest.mark.parametrize("held", [1, 40, 1 << 20])
def test_suffix_array_dedup_of_a_passage_that_most_documents_have(spark, monkeypatch, held):
    """Anchors of many rows of a task, of one row of many tasks, and of one document only, in few buckets of many lists."""
    for name, value in {"HELD": held, "LEAST_BITS": 2, "BLOCK": 200, "PART_WINDOWS": 150}.items():
        monkeypatch.setattr(suffix_array, name, value)
    rng = random.Random(held)
    common, own = "the passage that very many of the documents have, word by word, ", [f"{rng.random()} {rng.random()} {rng.random()} " for _ in range(40)]
    rows = [(d * (-1) ** d * 2**40, rng.choice(own) * (d % 3) + common * (d % 4 > 0) + rng.choice(own)) for d in range(120)]
    rows += [(2**63 - 1, common * 3), (-(2**63), own[0] + common[:-9]), (None, common)]
    got = suffix_array.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), 50)
    assert digests(got) == brute_bytes(rows, 50)


def test_suffix_array_dedup_shuffles_packed_lists_of_anchors(spark):
    """Rows that are shuffled one for each anchor cost more than all work on the texts."""
    rng = random.Random(8)
    rows = [(d, "".join(rng.choices("abcdefgh ", k=40000))) for d in range(20)]  # some 2,800 anchors each
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)

    def shuffled():
        jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().statusStore()
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = shuffled()
    assert all(r["n_removed"] == 0 for r in suffix_array.without_repeats(docs).collect())
    assert 0 < sum(n for stage, n in shuffled().items() if stage not in before) < 10_000


def test_suffix_array_and_common_prefixes_are_those_of_sorting():
    rng = random.Random(4)
    for _ in range(40):
        text = bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randrange(200))) + suffix_array.END
        want = sorted(range(len(text)), key=lambda i: text[i:])
        sa = suffix_array.suffix_array(text)
        assert sa.tolist() == want
        shared = [0]
        for a, b in zip(want[:-1], want[1:], strict=True):
            shared.append(next((k for k in range(len(text)) if a + k == len(text) or b + k == len(text) or text[a + k] != text[b + k]), 0))
        assert suffix_array.common_prefixes(text, sa).tolist() == shared


def brute_collocations(rows, longest, least, share, top):
    n, f = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    candidates, out = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}, []
    for (lang, p), a in candidates.items():
        score, _, left, right = min((10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        if not any(lang == other and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= share * a for (other, q), b in candidates.items()):
            out.append((lang, -score, -a, " ".join(p).encode(), left, right))
    seen, ranked = collections.Counter(), []
    for lang, score, a, phrase, left, right in sorted(out):
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(ranked)


@pytest.mark.parametrize(("longest", "share", "top"), [(3, 50, 2000), (4, 60, 7), (2, 50, 2000)])
def test_collocations_against_brute_force(spark, monkeypatch, longest, share, top):
    monkeypatch.setattr(collocations, "CHUNK", 300)
    monkeypatch.setattr(collocations, "RANKED", 5)
    rng = random.Random(longest)
    rows = [("en", None), ("fr", ""), (None, "  \t\n"), (None, "A a A a a " * 9), ("en", "x y" + ", x y" * 30), ("de", "日本 \x1c\x00 ß " * 12)]
    rows += [(rng.choice(["en", "en", "de", None]), "".join(rng.choice(["Red", "blue", "sky", "é", "of", "the"]) + rng.choice([" ", " ", "\t", ". ", "\n", "! "]) for _ in range(rng.randrange(200)))) for _ in range(60)]
    docs = clashing(spark, [(i, t, lang, None, None) for i, (lang, t) in enumerate(rows)])
    got = collocations.collocations(docs.repartition(3), longest, 10, share, top).collect()
    names = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    want = brute_collocations(rows, longest, 10, share, top)
    assert want and sorted(tuple(r[c] for c in names) for r in got) == want
    assert collocations.collocations(docs.limit(0)).count() == 0


def brute_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) by plain lists, level by level."""
    h = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    leaf = lambda *v: h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in v))

    def climb(level, place, value):
        proof = []
        while len(level) > 1:
            start = place // 16 * 16
            run = level[start : start + 16]
            at = place - start
            proof += run[:at] + run[at + 1 :]
            value = h(*run[:at], value, *run[at + 1 :])
            level, place = [h(*level[i : i + 16]) for i in range(0, len(level), 16)], place // 16
        return level[0], value, proof

    sources = collections.defaultdict(list)
    for d, text, lang, source, n in rows:
        low = None if text is None else re.sub("[A-Z]", lambda m: m[0].lower(), text)
        own = leaf(d, source, lang, n, text)
        changed = leaf(d, source, lang, n, low) if d is not None and zlib.crc32(str(d).encode()) % 5 == 0 else own
        sources[source].append((d is not None, d, own, changed))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: sorted(sources[s], key=lambda x: (x[0], x[1] or 0, x[2])) for s in order}
    subroots, out = [climb([x[2] for x in trees[s]], 0, trees[s][0][2])[0] for s in order], []
    for i, s in enumerate(order):
        for p, (_, d, own, changed) in enumerate(trees[s]):
            sub, value, low = climb([x[2] for x in trees[s]], p, changed)
            root, value, high = climb(subroots, i, value)
            out.append((str(d), own, sub, root, h(*low, *high), value, value == root))
    return sorted(out)


@pytest.mark.parametrize("levels", [1, 3])
def test_manifest_against_brute_force(spark, monkeypatch, levels):
    """One level in a task: the upper levels, of a large source and of 300 sources, are then made by further rounds."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    rng = random.Random(levels)
    rows = [(d, t, "en", None, None) for d, t in ODD] + [(d, None, None, "", 0) for d in (None, 3, 3)]
    rows += [(i, f"Text {i}" if i % 3 else f"text {i}", "de", "hot", i) for i in range(-5, 800)] + [(i, f"Row {i}", "fr", f"s{rng.randrange(300)}é", 1) for i in range(900)]
    got = merkle.manifest(clashing(spark, rows).repartition(7))
    names = ("leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert sorted((str(r["doc_id"]), *(r[c] for c in names)) for r in got.collect()) == brute_manifest(rows)
    assert merkle.manifest(clashing(spark, rows[:1])).count() == 1
    assert merkle.manifest(clashing(spark, rows[:1]).limit(0)).count() == 0


def test_a_version_shares_all_but_the_ancestors():
    leaves = [f"{i:064x}" for i in range(700)]
    tree = merkle.Node.tree(leaves)
    version = tree.changed(321, "0" * 64)
    assert version.digest == merkle.Node.tree([*leaves[:321], "0" * 64, *leaves[322:]]).digest

    def nodes(n):
        return {id(n): n} | {k: v for c in n.children for k, v in nodes(c).items()}

    assert len(nodes(version).keys() - nodes(tree).keys()) == tree.depth() + 1 == math.ceil(math.log(700, 16)) + 1
    assert merkle.folded("0" * 64, tree.path(321)) == version.digest
