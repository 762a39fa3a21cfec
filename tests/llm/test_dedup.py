"""Exact, near, suffix and line dedup against brute force."""

import hashlib
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, line_templates, simhash, suffix_dedup
from tidemark.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, keep string"


def test_components(spark):
    pairs = [(1, 2), (3, 2), (3, 4), (10, 11), (11, 12), (12, 10), (7, 7), (None, 5), (20, 25), (21, 25), (22, 25)]
    pairs += [(100 + k, 101 + k) for k in range(40)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert {found[k] for k in (1, 2, 3, 4)} == {1} and {found[k] for k in (10, 11, 12)} == {10}
    assert {found[k] for k in (20, 21, 22, 25)} == {20} and {found[100 + k] for k in range(41)} == {100}
    assert 7 not in found and 5 not in found
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_exact_keeps_the_largest_id(files):
    rows = [(1, "a", "x", "k"), (2, "a", None, "k"), (3, None, None, None), (4, "", "y", "k"), (5, "b" * 30000, "z", "k"),
            (None, "a", "x", "k"), (6, "A", "x", "k"), (6, "A", "x", "k")]
    docs = files(rows, DOCS)
    got = exact_dedup.duplicates(docs).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r["id"], []).append((r["keep_id"], r["group_size"], r["kept"]))
    assert by_id[1] == [(2, 3, False)] and by_id[2] == [(2, 3, True)] and by_id[None] == [(2, 3, False)]
    assert by_id[3] == [(4, 2, False)] and by_id[4] == [(4, 2, True)] and by_id[5] == [(5, 1, True)]
    assert sorted(k for _, _, k in by_id[6]) == [False, True]
    left = exact_dedup.keep_one(docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [2, 4, 5, 6]
    assert exact_dedup.duplicates(files([], DOCS)).count() == 0


def test_exact_settles_equal_digests_by_full_text(files):
    weak = lambda text: F.encode(F.length(text).cast("string"), "UTF-8")
    docs = files([(1, "aa", "", ""), (2, "bb", "", ""), (3, "aa", "", ""), (4, "c", "", "")], DOCS)
    got = {r["id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.duplicates(docs, digest=weak).collect()}
    assert got == {1: (3, 2, False), 3: (3, 2, True), 2: (2, 1, True), 4: (4, 1, True)}


def test_exact_state_goes_on_over_batches(spark, tmp_path):
    session, path, schema = exact_dedup.stateful_session(spark), str(tmp_path / "log"), "digest binary, id long, file string, row long"
    seen = []
    for batch in ([(b"x", 1, "f", 0), (b"y", 2, "f", 1)], [(b"x", 7, "g", 0)]):
        spark.createDataFrame(batch, schema).write.mode("append").parquet(path)
        state = exact_dedup.update_state(session.readStream.schema(schema).parquet(path), str(tmp_path / "state"))
        seen.append({bytes(r["digest"]): (r["n"], r["id"]) for r in state.collect()})
    assert seen == [{b"x": (1, 1), b"y": (1, 2)}, {b"x": (2, 7), b"y": (1, 2)}]


def brute_print(text):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    n = min(4, len(found))
    hashes = [xxhash.xxh64_intdigest(b" ".join(found[k : k + n]), 42) for k in range(len(found) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    label = dict(prints)
    parent = {k: k for k in label}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(label)
    for a in keys:
        for b in keys:
            if a < b and bin(label[a] ^ label[b]).count("1") <= 4:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in keys}


def test_simhash_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one"), (5, "x " * 20000)]
    for group in range(12):
        base = [word() for _ in range(rng.choice([3, 40, 400]))]
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), rng.choice([" ", "\n"]).join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = {r["id"]: r for r in simhash.near_duplicates(docs).collect()}
    want = {k: brute_print(t) for k, t in rows}
    assert {k: r["fp"] % 2**64 for k, r in got.items()} == want
    assert {k: r["component_id"] for k, r in got.items()} == brute_components(want)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(brute_components(want).values()))


def test_simhash_anchors_and_crowded_anchors(spark):
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    prints = {0: centre}
    for k in range(1, 220):
        flips = rng.sample(range(64), rng.randint(1, 5)) if k < 180 else []
        prints[k] = (centre if k < 180 else rng.getrandbits(64)) ^ sum(1 << b for b in flips)
    first = {}
    for k, v in sorted(prints.items()):
        first.setdefault(v, k)
    rows = [(k, v - 2**64 if v >= 2**63 else v) for v, k in first.items()]
    nodes = spark.createDataFrame(rows, "rep long, fp long")
    want = brute_components({k: v for v, k in first.items()})
    for block in (4096, 16):
        edges = simhash.links(nodes, block=block)
        found = {r["node"]: r["component"] for r in connected_components(edges).collect()}
        assert {k: found.get(k, k) for k in want} == want
    for bits, threshold, parity in ((7, 1, 3), (8, 1, 2), (6, 0, 0)):
        patterns, leaders, columns = simhash.anchor_table(bits, threshold, parity)
        near = lambda x: {x ^ int(e) for e in patterns[int(np.bitwise_xor.reduce([c for i, c in enumerate(columns) if x >> i & 1] or [0]))]}
        home = lambda x: x ^ int(leaders[int(np.bitwise_xor.reduce([c for i, c in enumerate(columns) if x >> i & 1] or [0]))])
        for x in range(1 << bits):
            for y in [x, *(x ^ 1 << b for b in range(bits) if threshold)]:
                assert home(x) in near(y)


def test_simhash_empty_and_missing_ids(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (None, "q")], "doc_id long, text string")
    assert sorted((r["id"] or -1, r["component_id"] or -1) for r in simhash.near_duplicates(docs).collect()) == [(-1, -1), (-1, 3), (3, 3), (3, 3)]
    assert simhash.keep_one(docs).count() == 4


def brute_repeats(rows):
    out, seen = {}, {}
    order = lambda r: (r[0] is None, r[0] or 0)
    for key, text in sorted(rows, key=order):
        data = (text or "").encode()
        rank = (key is None, key or 0)
        mark = bytearray(len(data))
        for k in range(len(data) - 49):
            if seen.get(data[k : k + 50], rank) < rank:
                mark[k : k + 50] = b"\1" * 50
        for k in range(len(data) - 49):
            seen.setdefault(data[k : k + 50], rank)
        kept = bytes(b for b, m in zip(data, mark) if not m)
        spans = sum(1 for k, m in enumerate(mark) if m and not (k and mark[k - 1]))
        out.setdefault(key, []).append((len(data), sum(mark), spans, hashlib.sha256(kept).hexdigest()))
    return {k: sorted(v) for k, v in out.items()}


def test_suffix_dedup_against_brute_force(files):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abé \n") for _ in range(n))
    passage, line = text(60), text(49)
    rows = [(1, text(200)), (2, None), (3, ""), (4, "a" * 300), (5, "a" * 70), (6, "short"), (7, "short"), (None, passage)]
    for k in range(10, 40):
        rows.append((k, text(rng.randint(0, 90)) + passage[: rng.randint(45, 60)] + text(rng.randint(0, 90)) + line))
    rows += [(40, rows[0][1]), (41, rows[0][1]), (42, passage * 3), (42, passage * 3), (50, text(70000) + passage)]
    docs = files([(k, t, "x") for k, t in rows], "doc_id long, text string, kept string")
    got = {}
    for r in suffix_dedup.remove_repeats(docs).collect():
        digest = hashlib.sha256(bytes(r["kept"])).hexdigest()
        got.setdefault(r["id"], []).append((r["n_bytes"], r["n_removed"], r["n_spans"], digest))
        assert sum(b - a for a, b in r["spans"]) == r["n_removed"]
    assert {k: sorted(v) for k, v in got.items()} == brute_repeats(rows)
    assert suffix_dedup.remove_repeats(files([], "doc_id long, text string")).count() == 0


def test_suffix_dedup_deals_grams_out_evenly():
    # Least hashes are small; dealt by size as they were, the largest of 64 buckets had 12 times the mean and 40 had none.
    data = random.Random(5).randbytes(400_000)
    gram = np.sort(suffix_dedup.anchors(data, np.array([len(data)]), np.array([True]))[0])
    counts = np.bincount(suffix_dedup._bucket(gram, 64), minlength=64)
    assert counts.max() < 1.4 * counts.mean() and counts.min() > 0.6 * counts.mean()
    found = [(a, z) for _, a, z in suffix_dedup._by_bucket(gram, 64)]
    assert found[0][0] == 0 and found[-1][1] == len(gram) and all(x[1] == y[0] for x, y in zip(found, found[1:]))


def test_suffix_dedup_searches_some_grams_at_a_time():
    rng = random.Random(7)
    text = lambda n: bytes(rng.choice(b"ab") for _ in range(n))
    passages = [text(60) for _ in range(40)]
    texts = [text(rng.randrange(9)) + passages[k % 40] + text(rng.randrange(9)) for k in range(300)] + [text(80)]
    gram, place = np.array([k % 40 for k in range(300)] + [99]), np.array([rng.randrange(200) for _ in texts])
    want = {}
    for k, data in enumerate(texts[:-1]):
        windows = [data[i : i + 50] for i in range(len(data) - 49)]
        others = [(texts[j], place[j]) for j in range(300) if gram[j] == gram[k] and place[j] < place[k]]
        want[k] = [any(w in other for other, _ in others) for w in windows]
    assert any(map(any, want.values())) and not all(map(all, want.values()))
    for most in (1, 2000, 1 << 30):
        runs, got = list(suffix_dedup.repeats_by_gram(texts, gram, place, most)), {}
        for chosen, goes in runs:
            ends = np.cumsum([len(texts[k]) - 49 for k in chosen])
            got |= {k: x.tolist() for k, x in zip(chosen.tolist(), np.split(goes, ends[:-1]))}
            largest = max(sum(len(texts[k]) for k in chosen if gram[k] == g) for g in set(gram[chosen].tolist()))
            assert sum(len(texts[k]) for k in chosen) <= most + largest
        assert got == want and sum(len(chosen) for chosen, _ in runs) == 300
        assert len(runs) == 40 if most == 1 else len(runs) == 1 if most > 2000 else 1 < len(runs) < 40
    assert list(suffix_dedup.repeats_by_gram(texts[-1:], gram[-1:], place[-1:])) == []


def test_suffix_dedup_cuts_pieces_of_a_frequent_gram_again(monkeypatch):
    rng = random.Random(9)
    text = lambda n, of=b"abcdefgh": bytes(rng.choice(of) for _ in range(n))
    core, left, right = text(26), [text(24) for _ in range(300)], [text(24) for _ in range(300)]
    texts = [rng.choice(left) + core + rng.choice(right) for _ in range(500)] + [text(24) + core + text(24) for _ in range(500)]
    texts += [b"a" * n for n in range(50, 90)] + [(b"ab" * 90)[k : k + n] for k in range(4) for n in range(50, 80, 7)]
    texts += [text(9, b"a") + text(rng.randrange(45, 60), b"ab") for _ in range(60)] + [core * 3, texts[0] + texts[1]]
    texts = sorted(set(texts))
    gram, place = np.zeros(len(texts), np.int64), np.array([rng.randrange(400) for _ in texts])
    size = np.array([len(x) for x in texts])
    searched, whole = [], suffix_dedup.repeated_windows
    want = whole(b"".join(texts), size, place)
    assert want.any() and not want.all()
    monkeypatch.setattr(suffix_dedup, "repeated_windows", lambda data, *rest: searched.append(len(data)) or whole(data, *rest))
    for most in (1, 500, 4000):
        [(chosen, goes)] = suffix_dedup.repeats_by_gram(texts, gram, place, most)
        assert chosen.tolist() == list(range(len(texts))) and goes.tolist() == want.tolist()
        # Runs of one letter differ in length only and cannot be told apart by windows.
        assert max(searched) <= max(2 * most, sum(len(x) for x in texts if not x.strip(b"a"))) < len(b"".join(texts)) / 4
        searched.clear()
    copies = [texts[k % len(texts)] for k in range(2 * len(texts))]
    twice = suffix_dedup.whole_or_repeated(iter(copies), np.zeros(len(copies), np.int64), np.tile(place, 2), 500)
    assert twice.tolist() == want.tolist() * 2


def test_line_templates(files):
    rows = []
    for k in range(12):
        rows.append((k, f"own words of number{k} here are {'abcdefghijkl'[k]}\nOrder {k} was shipped to {'x' * k}y today\nend"))
    rows += [(20, None), (21, ""), (22, "Order 7 was shipped to nobody today"), (None, "Order 1 was shipped to z today\r\nkeep")]
    docs = files([(k, t, 1) for k, t in rows], "doc_id long, text string, n_dropped int")
    got = {r["doc_id"]: r for r in line_templates.drop_recurring_lines(docs, min_docs=10).collect()}
    assert got[3]["text"] == "end" and got[3]["n_lines"] == 3 and got[3]["n_dropped"] == 2
    assert got[20]["text"] is None and got[20]["n_lines"] == 0 and got[21]["n_lines"] == 1
    assert got[22]["text"] == "" and got[None]["text"] == "keep"
    few = {r["doc_id"]: r["n_dropped"] for r in line_templates.drop_recurring_lines(docs, min_docs=15).collect()}
    assert set(few.values()) == {0}
    assert line_templates.drop_recurring_lines(files([], "doc_id long, text string")).count() == 0


def test_one_documents_repeats_are_no_recurrence(files):
    docs = files([(1, "same line of text\n" * 50), (2, "another line of words")], "doc_id long, text string")
    assert {r["n_dropped"] for r in line_templates.drop_recurring_lines(docs, min_docs=2).collect()} == {0}


def test_templates_with_several_variables(files):
    names = ["Anna Berg", "Ben Kohl", "Cleo Lang", "Dora Maas", "Emil Nagel", "Fritz Ott", "Gerd Pohl", "Hans Quast", "Ina Roth", "Jan Sass", "Kai Thal", "Lea Uhl"]
    rows = [(k, f"text {k}\nContact our sales desk: {name}") for k, name in enumerate(names)]
    got = line_templates.drop_recurring_lines(files(rows, "doc_id long, text string")).collect()
    assert [r["n_dropped"] for r in got] == [1] * 12


def test_several_templates_in_a_leaf(files):
    # The hot template wins the vote of the leaf; the cold one has variables without digits too.
    word = lambda k: "w" + "".join("abcdefghij"[int(c)] for c in str(k))
    rows = [(k, f"Read more about {word(k)} {word(k + 500)} on our front page") for k in range(60)]
    rows += [(k, f"Read more about prices and {word(k)} {word(k + 500)} by mail") for k in range(100, 114)]
    rows += [(k, f"Read more about {' '.join(word(k * 7 + n) for n in range(6))}") for k in range(200, 230)]
    dropped = {r["doc_id"]: r["n_dropped"] for r in line_templates.drop_recurring_lines(files(rows, "doc_id long, text string")).collect()}
    assert dropped == {k: int(k < 200) for k, _ in rows}


def test_short_and_long_lines_recur(files):
    passage = " ".join(f"w{'abcdefghij'[n % 10]}{'abcdefghij'[n // 10]}" for n in range(51))
    rows = [(k, f"text {k} stays\nLes.\nGo on\n\n") for k in range(12)]
    rows += [(30, f"one\n{passage}"), (31, f"two\n{passage}"), (40, "x" + passage), (41, "x" + passage), (42, passage.rsplit(" ", 1)[0])]
    docs = files(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_templates.drop_recurring_lines(docs, min_docs=12, min_tokens=1).collect()}
    assert all(got[k]["n_lines"] == 5 and "Les." not in got[k]["text"] and "Go on" not in got[k]["text"] for k in range(12))
    assert got[30]["text"] == "one" and got[31]["text"] == "two"
    # Whole copies are no repetition within different texts, and 50 tokens are not over 50.
    assert {got[k]["n_dropped"] for k in (40, 41, 42)} == {0}


def test_copies_do_not_empty_each_other(files):
    text = "\n".join(f"An ordinary sentence of its own, {w} by {w}." for w in ("one", "two", "three", "four", "five", "six"))
    rows = [(k, text) for k in range(12)] + [(100 + k, f"own text of {w}\nthe shared line of all") for k, w in enumerate("abcdefghijkl")]
    got = {r["doc_id"]: r for r in line_templates.drop_recurring_lines(files(rows, "doc_id long, text string"), min_tokens=1).collect()}
    assert all(got[k]["text"] == text and got[k]["n_dropped"] == 0 for k in range(12))
    assert all("shared" not in got[100 + k]["text"] for k in range(12))


def brute_recurring(rows, min_docs, long_docs, long_tokens):
    """Lines without variables or neighbours in their leaf: a masked line is its own template."""
    import re

    def masked(line):
        words = [w for w in re.split("[ \t\r\x0b\f]+", line) if w]
        return " ".join("<*>" if re.search("[0-9]", w) else w for w in words)

    texts = {}
    for _, text in rows:
        for line in {masked(x) for x in (text or "").split("\n")}:
            texts.setdefault(line, set()).add(text)
    out = {}
    for k, text in rows:
        lines = [] if text is None else text.split("\n")
        gone = [
            m != "" and (len(texts[m]) >= min_docs or (len(m.split(" ")) > long_tokens and len(texts[m]) >= long_docs))
            for m in map(masked, lines)
        ]
        out[k] = None if text is None else "\n".join(x for x, g in zip(lines, gone) if not g)
    return out


def test_recurring_lines_equal_brute_force(files):
    rng = random.Random(4)
    # Lines differ in their leading tokens, so each leaf has one template.
    pool = [f"l{'abcdefghij'[n % 10]}{'abcdefghij'[n // 10]} starts\there  {n % 7} ends" for n in range(60)]
    pool += [" ".join(f"p{'abcdefghij'[n]}{'abcdefghij'[m % 10]}{'xyzuvw'[m // 10]}" for m in range(53)) for n in range(6)] + ["", " ", "\t7\r", "solo"]
    rows = [(k, "\n".join(rng.choices(pool, k=rng.randint(0, 6)))) for k in range(150)]
    rows += [(200 + k, rows[3][1]) for k in range(40)] + [(300, None), (301, "")]
    docs = files(rows, "doc_id long, text string", 4)
    for min_docs, long_docs, long_tokens in ((10, 2, 50), (9, 4, 20), (200, 200, 50)):
        got = line_templates.drop_recurring_lines(docs, min_docs=min_docs, long_docs=long_docs, long_tokens=long_tokens, min_tokens=1)
        assert {r["doc_id"]: r["text"] for r in got.collect()} == brute_recurring(rows, min_docs, long_docs, long_tokens)
