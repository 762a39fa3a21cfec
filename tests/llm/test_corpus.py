"""Collocations, license scan and Merkle manifest against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np

from tidemark.llm import collocations, license_scan, merkle_manifest

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_counts(rows, most=4):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, most + 1):
                counts.setdefault(lang, Counter()).update(" ".join(words[i : i + k]) for i in range(len(words) - k + 1))
    return counts, totals


def brute_collocations(rows, least=30, top=2000, percent=80):
    counts, totals = brute_counts(rows)
    out = []
    for lang, seen in counts.items():
        often = {p: a for p, a in seen.items() if " " in p and a >= least}
        found = []
        for phrase, a in often.items():
            w = phrase.split(" ")
            score, _, left, right = min(
                (2000000 * a // (seen[" ".join(w[:k])] + seen[" ".join(w[k:])]), k, seen[" ".join(w[:k])], seen[" ".join(w[k:])])
                for k in range(1, len(w))
            )
            if not any(f" {phrase} " in f" {q} " and q != phrase and 100 * b >= percent * a for q, b in often.items()):
                found.append((-score, -a, phrase.encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def test_collocations_equal_brute_force(files):
    rng = random.Random(3)
    vocab = ["of", "the", "New", "york", "city", "times", "é", "ü b", "x", "a.b", "hot\tpair"]
    rows = [(rng.choice(["en", "fr", None, "und"]), " ".join(rng.choices(vocab, k=rng.randint(0, 40)))) for _ in range(150)]
    # A third of all rows is one copied text, and a hot pair goes before every other word.
    rows += [("en", "Hot pair one two three four. hot pair\nfive hot pair, six")] * 75 + [("en", None), ("fr", ""), (None, "...!")]
    rows += [("en", " ".join(f"hot pair {w}" for w in rng.choices(vocab, k=400)))]
    docs = files([(i, l, t, 9) for i, (l, t) in enumerate(rows)], "doc_id long, lang string, text string, n long", 5)
    for least, top, percent in ((30, 2000, 80), (3, 25, 60), (1, 10**6, 100)):
        want = brute_collocations(rows, least, top, percent)
        got = collocations.collocations(docs, least=least, top=top, percent=percent)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, got.collect())) == want and want
    empty = files([], "doc_id long, lang string, text string")
    assert collocations.collocations(empty).count() == 0


def test_multikey_quicksort_counts_equal_leading_words():
    rng = np.random.default_rng(5)
    for size, kinds, least in ((0, 3, 1), (1, 1, 1), (400, 3, 1), (3000, 12, 20), (500, 400, 2)):
        words = rng.integers(0, kinds, (size, 4)).astype(np.int32)
        ends = rng.integers(1, 5, size)
        words[np.arange(4)[None, :] >= ends[:, None]] = -1
        weights = rng.integers(1, 4, size)
        want = Counter()
        for row, weight in zip(words.tolist(), weights.tolist()):
            for k in range(1, 5):
                if row[k - 1] >= 0:
                    want[tuple(row[:k])] += weight
        got = {}
        for depth, at, sizes in collocations.equal_partitions(words, weights, least):
            for pointer, n in zip(at, sizes):
                key = tuple(words[pointer, :depth].tolist())
                assert key not in got
                got[key] = n
        assert got == {k: n for k, n in want.items() if n >= least}


def test_sort_runs_end_between_routes(files, monkeypatch):
    rows = [("en", "a b c d a b c e a b c d") for _ in range(40)] + [("fr", "a b c d") for _ in range(30)]
    docs = files([(i, l, t) for i, (l, t) in enumerate(rows)], "doc_id long, lang string, text string", 3)
    monkeypatch.setattr(collocations, "ROUTE_ROWS", 1)
    grams, _ = collocations.phrase_counts(docs, least=30)
    got = {(r["lang"], r["phrase"]): r["n"] for r in grams.collect()}
    counts, _ = brute_counts(rows)
    assert got == {(l, p): n for l, seen in counts.items() for p, n in seen.items() if n >= 30}


def brute_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_scan(text, templates, phrases, percent):
    words = brute_words(text)
    places = [
        (k, label) for k in range(len(words)) for phrase, label in phrases.items()
        if words[k : k + len(phrase.split(" "))] == phrase.split(" ")
    ]
    labels, best = {label for _, label in places}, 0.0
    for label, notice in templates:
        need = set(brute_words(notice))
        step = license_scan.step_of(len(brute_words(notice)))
        for start in range(0, max(len(words), 1), step):
            held = len(need & set(words[start : start + 2 * step]))
            if 100 * held >= percent * len(need):
                labels, best = labels | {label}, max(best, held / len(need))
    at = [k for k, _ in places]
    return (
        len(words), len(at), min(at, default=None), max(at, default=None),
        ",".join(sorted({label for _, label in places})), ",".join(sorted(labels)), 1.0 if at else best,
    )


def test_license_scan_equals_brute_force(files):
    rng = random.Random(7)
    notices = [text for _, text in license_scan.TEMPLATES]
    texts = [None, "", "...", "MIT License", "mit, license; mit license\nCC-BY 4.0 under cc by", "gnu general public licenses",
             "GNU GENERAL PUBLIC LICENSE gnu general public license version 3", "é mit license", "word " * 30000 + "mit license"]
    for _ in range(60):
        words = brute_words(rng.choice(notices))
        drop = rng.choice([0.0, 0.05, 0.2])
        kept = [w for w in words if rng.random() >= drop]
        rng.shuffle(kept) if rng.random() < 0.3 else None
        texts.append(" ".join(rng.choices(["of", "the", "plain", "ähnlich", "license"], k=rng.randint(0, 300)) + kept + ["end"] * rng.randint(0, 90)))
    texts += [notices[0].upper()] * 50
    rows = [(i if i % 9 else None, t, "x", 1) for i, t in enumerate(texts)]
    docs = files(rows, "doc_id long, text string, labels string, n_words int", 4)
    for percent in (90, 60, 100):
        got = license_scan.scan(docs, percent=percent).collect()
        want = [(r[0], *brute_scan(r[1], license_scan.TEMPLATES, license_scan.PHRASES, percent)) for r in rows]
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert {r["labels"] for r in license_scan.scan(docs, templates=[], phrases={}).collect()} == {""}
    assert license_scan.scan(files([], "doc_id long, text string")).count() == 0


def brute_hash(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([brute_hash(*levels[-1][k : k + 16]) for k in range(0, len(levels[-1]), 16)])
    return levels


def brute_fold(levels, at, digest):
    proof = []
    for nodes in levels[:-1]:
        run, slot = nodes[at // 16 * 16 : at // 16 * 16 + 16], at % 16
        proof += run[:slot] + run[slot + 1 :]
        digest, at = brute_hash(*run[:slot], digest, *run[slot + 1 :]), at // 16
    return digest, proof


def brute_manifest(rows):
    def of(row):
        return brute_hash(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    trees = {}
    for row in rows:
        trees.setdefault(row[1], []).append(((row[0] is not None, row[0] or 0), of(row), row))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for leaves in trees.values():
        leaves.sort(key=lambda x: x[:2])
    levels = {s: brute_levels([x[1] for x in leaves]) for s, leaves in trees.items()}
    upper = brute_levels([levels[s][-1][0] for s in order])
    out = []
    for s, leaves in trees.items():
        for at, (_, leaf, row) in enumerate(leaves):
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None
            low, first = brute_fold(levels[s], at, of((*row[:4], row[4].translate(LOWER))) if tampered else leaf)
            top, second = brute_fold(upper, order.index(s), low)
            out.append((row[0], leaf, levels[s][-1][0], upper[-1][0], brute_hash(*first, *second), top, top == upper[-1][0]))
    return sorted(out, key=str)


def test_merkle_manifest_equals_brute_force(files):
    rng = random.Random(11)
    schema = "doc_id long, source string, lang string, n_chars long, text string, root string"
    texts = [None, "", "plain", "UPPER é", "x" * 70000 + "Y"]

    def row(i, source):
        return (i, source, rng.choice(["en", None]), rng.choice([None, 5, -1]), rng.choice(texts))

    many = [row(i, "hot") for i in range(600)] + [row(1000 + i, f"s{i % 40}") for i in range(300)]
    many += [row(2000 + i, None) for i in range(17)] + [row(None, "hot") for _ in range(5)] + [(7, "twice", "en", 1, "Same")] * 40
    many += [row(3000, ""), row(3001, "ü"), row(3002, "Z")]
    for rows in (many, many[:1], many[:16], many[:17], many[600:640]):
        rng.shuffle(rows)
        docs = files([(*r, "other") for r in rows], schema, 5)
        got = [
            tuple(v.hex() if isinstance(v, (bytes, bytearray)) else v for v in r)
            for r in merkle_manifest.verify(docs).collect()
        ]
        assert sorted(got, key=str) == brute_manifest(rows)
    assert merkle_manifest.verify(files([], schema)).count() == 0


def test_states_go_on_as_hashlib_does():
    rng = np.random.default_rng(1)
    digests = rng.integers(0, 256, (40, 32)).astype(np.uint8)
    state = merkle_manifest.START[:, None]
    for n in range(40):
        want = hashlib.sha256("".join(d.tobytes().hex() for d in digests[:n]).encode()).digest()
        assert merkle_manifest.finish(state, np.array([n])).tobytes() == want
        state = merkle_manifest.advance(state, merkle_manifest.block_of(digests[n : n + 1]))
