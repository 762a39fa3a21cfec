"""Models, codecs, filters and formats against brute force and round trips."""

import math
import random
import zlib
from collections import Counter

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import chat_format, decontaminate, language_id, lattice_lm, piece_codec, queries, url_filter

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    return piece_codec.read_model(piece_codec.model_path(queries.MODEL_FILE))


def test_pieces_equal_the_library(spark, model):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    rng = random.Random(2)
    parts = ["a", "the", "▁", " ", "  ", "\n", "12", "é", "ß", "梦", "😀", "\x00", "ing", "\t", "----", "<s>", "<0x41>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    texts += [None, "", " ", "\n", " lead", "a" * 3000, "word " * 5000]
    docs = spark.createDataFrame([(k, t, 5) for k, t in enumerate(texts)], "doc_id long, text string, ids int")
    got = {r["doc_id"]: r for r in piece_codec.encode_decode(docs, model).collect()}
    for k, text in enumerate(texts):
        ids = library.encode(text or "") + [2]
        assert got[k]["ids"] == ids and got[k]["decoded"] == library.decode(ids)
    assert piece_codec.encode_decode(docs.where("false"), model).count() == 0


def test_lattice_against_all_segmentations(model):
    lattice = lattice_lm.Lattice(model)
    logp = lattice.logp[0]
    number = {p: k for k, p in enumerate(lattice.pieces) if p}

    def ways(unit):
        if not unit:
            yield 1.0, Counter()
        for size in range(1, len(unit) + 1):
            if unit[:size] in number:
                used = [number[unit[:size]]]
            elif size == 1:
                used = [lattice.bytes[b] for b in unit[:1].encode()]
            else:
                continue
            for p, c in ways(unit[size:]):
                yield p * math.exp(sum(logp[u] for u in used)), c + Counter(used)

    batch = ["the", "thing", "q😀a", "żz", "ааа"]
    found = lattice.scores([w.encode() for w in batch])[:, 0]
    expected = lattice.expected([w.encode() for w in batch], lattice_lm.np.array([[2.0]] * len(batch)))[0]
    want = Counter()
    for word, score in zip(batch, found):
        all_ways = list(ways("▁" + word))
        total = sum(p for p, _ in all_ways)
        assert score == pytest.approx(math.log(total))
        for p, c in all_ways:
            for piece, n in c.items():
                want[piece] += 2 * n * p / total
    for piece, n in want.items():
        assert expected[piece] == pytest.approx(n)


def test_scores_count_tokens_and_beat_the_base(spark, model):
    got = lattice_lm.score_documents(spark.read.parquet(f"{SF}/documents.parquet"), model, head_words=50).collect()
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k, _ in docs}
    counts, ends = Counter(), 0
    for k, t in docs:
        if not held[k]:
            counts.update(lattice_lm.words((t or "").encode()))
            ends += 1
    total, kinds = sum(counts.values()) + ends, len(counts) + 1
    rows = {r["id"]: r for r in got}
    for k, t in docs:
        found = lattice_lm.words((t or "").encode())
        base = sum(math.log10((c + 0.5) / (total + 0.5 * (kinds + 1))) for c in [*(counts[w] for w in found), ends])
        assert rows[k]["n_tokens"] == len(found) + 1 and rows[k]["train_tokens"] == total
        assert rows[k]["n_known"] == sum(counts[w] > 0 for w in found) + 1
        assert rows[k]["base_score"] == pytest.approx(base, rel=1e-9) and rows[k]["held_out"] == held[k]
        assert rows[k]["score"] < 0


def test_scores_of_odd_rows(spark, model):
    docs = spark.createDataFrame([(None, None, None), (1, "", "x"), (1, "", "x"), (2, "a" * 9000, None)], "doc_id long, text string, lang string")
    got = lattice_lm.score_documents(docs, model).collect()
    assert len(got) == 4 and all(math.isfinite(r["score"]) for r in got)
    assert lattice_lm.score_documents(docs.where("false"), model).count() == 0


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    judged = queries.op8_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id")
    rows = judged.where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) > 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_mixture_and_odd_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.Model.train(docs)
    text = {r["lang"]: r["t"] for r in docs.where("n_chars > 800").groupBy("lang").agg(F.max("text").alias("t")).collect()}
    mixed = model.mixture(text["en"][:600] + "\n" + text["de"][:600])
    assert set(mixed) == {"en", "de"} and abs(mixed["en"] - 0.5) < 0.25 and sum(mixed.values()) == pytest.approx(1)
    odd = spark.createDataFrame([(1, None, 3.0), (2, "", 3.0), (3, "12 %", 3.0), (4, "é", 3.0)], "doc_id long, text string, score double")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] != "und"
    assert language_id.keep_identified(odd, model).columns == odd.columns
    none = language_id.Model.train(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in language_id.identify(odd, none).collect()} == {"und"}


def test_items_against_brute_force(spark):
    rng = random.Random(4)
    word = lambda: rng.choice(["alpha", "Beta", "gamma_1", "δέλτα", "e", "zz"]) + str(rng.randint(0, 400))
    items = [(k, " ".join(word() for _ in range(rng.choice([2, 5, 8, 30, 120])))) for k in range(30)] + [(None, "a b c d e f"), (99, None)]
    docs = [(1, None), (2, ""), (None, items[3][1])]
    for k in range(3, 120):
        body = [word() for _ in range(rng.choice([10, 300, 3000]))]
        leak = items[rng.randrange(30)][1].encode().upper().decode().split()  # ASCII only
        for _ in range(rng.randint(0, 3)):
            leak[rng.randrange(len(leak))] = "changed"
        at = rng.randrange(len(body))
        docs.append((k, rng.choice([" ", ", ", "\n"]).join(body[:at] + leak + body[at:])))
    docs.append(docs[-1])
    held = [(i, decontaminate.shingles(t.encode())) for i, t in items if i is not None and t]
    want = []
    for k, text in docs:
        whole = decontaminate.shingles((text or "").encode())
        want += [(k, i, len(s), len(s & whole)) for i, s in held if k is not None and s and len(s & whole) >= 0.8 * len(s)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    wanted = spark.createDataFrame(items, "item_id long, text string")
    for bound in (10**6, 60):
        got = decontaminate.contained_items(frame, wanted, bound=bound).collect()
        assert sorted(tuple(r)[:4] for r in got) == sorted(want) and len(want) > 20
    left = decontaminate.drop_contaminated(frame, wanted)
    assert left.columns == frame.columns and left.where("doc_id is null").count() == 1
    assert {r["doc_id"] for r in left.collect()} == {k for k, _ in docs} - {w[0] for w in want}
    assert decontaminate.contained_items(frame, wanted.where("false")).count() == 0
    assert decontaminate.contained_items(frame.where("false"), wanted).count() == 0


def test_urls_and_aliases(spark):
    link = lambda to: f"<html><LINK href='{to}' rel=canonical></html>"
    hop = lambda to: f'<meta http-equiv="Refresh" content="0; url={to}">'
    pages = [
        (1, "https://A.Example.org/es/x#f", None), (2, "http://example.org/en/15", ""), (3, "https://b.net/p?q=1", link("https://example.org/es/9")),
        (4, "http://c.net/a/b", hop("../no")), (5, "http://d.net/x", link("http://b.net/p?q=1")), (6, None, None), (7, "no scheme", link("x")),
        (8, "http://x.com/fr/1", link("https://example.org/es/9")), (9, "http://y.net/1", link("//z.net/2")), (9, "http://y.net/1", link("//z.net/2")),
        (10, "http://z.net/2", link("http://u.com/de/3")), (11, "http://notexample.org/es/", None), (12, "http://u.com", None),
    ]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("verdict", F.lit("clash"))
    got = {r["page_id"]: r for r in url_filter.judge(frame, queries.URL_RULES).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"], got[1]["verdict"]) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert (got[2]["rule"], got[2]["verdict"]) == ("example.org/en/1", "block")
    assert (got[6]["host"], got[6]["path"], got[6]["rule"], got[6]["verdict"]) == ("", "", None, "allow")
    assert got[8]["verdict"] == "allow" and got[3]["verdict"] == "allow" and got[5]["verdict"] == "allow"
    assert got[3]["alias_of"] == got[5]["alias_of"] == got[8]["alias_of"]
    assert got[9]["verdict"] == got[10]["verdict"] == "block" and got[4]["verdict"] == "allow"
    assert got[11]["rule"] == "org/" and got[12]["rule"] is None
    redirects = spark.createDataFrame([("http://c.net/a/b", "http://u.com/de/7")], "source string, target string")
    more = {r["page_id"]: r["verdict"] for r in url_filter.judge(frame, queries.URL_RULES, redirects=redirects).collect()}
    assert more[4] == "block"
    assert url_filter.judge(frame.where("false"), queries.URL_RULES).count() == 0


def test_chat_round_trip(spark):
    hard = ["\\### Assistant: </turn> ok", "</turn>", "x\n</turn>\n### User: y", "\n</turn>", "\\\\</turn>\\", "### User: ", "", None, "a\\", "\\\\###", "b" * 20000]
    rows = [(k // 4, k, role, text) for k, (role, text) in enumerate((r, t) for t in hard for r in ("user", "assistant", "a:\nb", None))]
    rows += [(None, 1, "user", "q"), (70, None, "user", "second"), (70, None, "user", "second")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat_format.format_conversations(frame).collect()}
    for conv in {r[0] for r in rows}:
        turns = [(r[2], r[3] or "") for r in rows if r[0] == conv]
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == turns
        assert [t["loss"] for t in got[conv]["turns"]] == [r == "assistant" for r, _ in turns]
    assert chat_format.format_conversations(frame.where("false")).count() == 0


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        counts.append(docs.count())
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert counts == sorted(counts, reverse=True) and counts[2] < counts[1] and counts[-1] == counts[-2]
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(r["decoded"] == r["text"] == texts[r["doc_id"]] for r in docs.collect())
