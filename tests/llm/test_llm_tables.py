"""Operators of the llm folder against brute force, other libraries and exact round trips, on small tables."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("fluoroframe.llm")

from fluoroframe.llm import chat, decontaminate, licenses, quality, simhash, token_store, topk, toxicity  # noqa: E402
from fluoroframe.llm import sentencepiece_fst as pieces  # noqa: E402
from fluoroframe.llm.queries import tokenizer_file  # noqa: E402

DOCS = "doc_id long, text string, fingerprint string, _hash int, score int"


def rows(spark, texts, first=0):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(first + i, t, "x", 1, 2) for i, t in enumerate(texts)], DOCS)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = [words(rng, rng.randint(1, 60)) for _ in range(40)]
    near = [b + " tail" for b in base[:10]]
    return [*base, *near, *base[:5], "", " \t", None, "one", "one two", words(rng, 5000)]


# SimHash


def test_fingerprint_is_the_majority_of_shingle_bits():
    import xxhash

    text = "Ab cD\x0bÉf g"
    parts = ["ab cd Éf", "cd Éf g"]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    want = sum(1 << i for i in range(64) if sum(h >> i & 1 for h in hashes) > 1)
    assert simhash.fingerprint(text) == want
    assert simhash.fingerprint("one two") == xxhash.xxh64_intdigest(b"one two", 42)
    assert simhash.fingerprint(" \t\n") == 0


def test_masks_cover_every_pair_of_bits():
    for radius in (1, 2):
        masks = simhash.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for i in range(64):
            for j in range(64) if radius == 2 else [i]:
                assert any(not (m >> i & 1) and not (m >> j & 1) for m in masks)


def test_components_match_all_pairs(spark):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(30)]
    prints = {s ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 4))}) for s in seeds for _ in range(12)}
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    table = spark.createDataFrame([(p, i) for i, p in enumerate(prints)], "fingerprint long, first long")
    got = {r.fingerprint: r.component for r in simhash.classes(table).collect()}
    root = list(range(len(prints)))
    for _ in range(len(prints)):
        old = list(root)
        for i, a in enumerate(prints):
            for j in range(i):
                if bin((a ^ prints[j]) & (2**64 - 1)).count("1") <= 2:
                    root[i] = root[j] = min(root[i], root[j])
        if old == root:
            break
    assert got == {p: root[i] for i, p in enumerate(prints)}


def test_near_duplicates_keep_every_row(spark, texts):
    got = simhash.near_duplicates(rows(spark, texts)).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    by = {r.doc_id: r for r in got}
    assert by[50].component_id == by[0].component_id == 0
    empty = [i for i, t in enumerate(texts) if not (t or "").split()]
    assert {by[i].component_id for i in empty} == {min(empty)} and by[empty[0]].fingerprint == "0" * 16
    assert simhash.near_duplicates(rows(spark, texts).where("false")).count() == 0


def test_one_document_of_each_group_stays(spark, texts):
    docs = rows(spark, texts)
    again = docs.unionByName(docs)
    kept = simhash.keep_one(again, shingle=3)
    assert kept.columns == docs.columns
    want = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_similar_texts_leave_one_document(spark):
    rng = random.Random(12)
    texts = []
    for n in (60, 300, 900):
        base = words(rng, n).split()
        texts.append(" ".join(base))
        for share in (0.005, 0.015, 0.02, 0.3):  # changed words; the last is too far
            some = list(base)
            for i in range(int(share * n) or 1):
                some[(i * 37 + 11) % n] = "zz" + str(i)
            texts.append(" ".join(some))
    texts += ["", None, "one two", "two one"]
    sets = [{tuple((t or "").split()[i : i + 5]) for i in range(max(1, len((t or "").split()) - 4))} for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j in range(i):
                if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    kept = sorted(r.doc_id for r in simhash.keep_one(rows(spark, texts), least=0.8).collect())
    assert kept == sorted(set(root))
    assert simhash.keep_one(rows(spark, texts).where("false"), least=0.8).count() == 0
    left, right = (np.unique(simhash._hashes(texts[i], 5, 42)) for i in (5, 8))
    assert simhash.similarity(left, right) == pytest.approx(len(sets[5] & sets[8]) / len(sets[5] | sets[8]))


def test_texts_similar_only_to_an_original_are_one_group(spark):
    rng = random.Random(21)
    texts = []
    for _ in range(2):  # two originals; their variants are about 0.7 similar to each other
        base = words(rng, 400).split()
        for k in range(60):
            some = list(base)
            for i in rng.sample(range(80), 6):
                some[i * 5] = f"zz{k}x{i}"
            texts.append(" ".join(some))
        texts.append(" ".join(base))
    random.Random(4).shuffle(texts)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(texts)))
    for _ in range(4):
        for i, a in enumerate(sets):
            for j in range(i):
                if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    want = sorted(set(root))
    assert len(want) == 2
    assert sorted(r.doc_id for r in simhash.keep_one(rows(spark, texts), least=0.8).collect()) == want


def test_prefix_join_finds_all_similar_pairs(spark):
    rng = np.random.default_rng(8)
    sets = []
    for _ in range(12):
        base = rng.integers(0, 4000, 40)
        for k in range(10):
            sets.append(sorted({int(h) for h in np.where(rng.random(40) < 0.02 * k, rng.integers(0, 4000, 40), base)}))
    table = spark.createDataFrame([(f"k{i}", i, s) for i, s in enumerate(sets)], "key string, component long, hashes array<long>")
    got = {tuple(sorted((r.src, r.dst))) for r in simhash._meet(table, 0.8).collect()}
    members = [set(s) for s in sets]
    want = {(i, j) for j in range(len(sets)) for i in range(j) if 5 * len(members[i] & members[j]) >= 4 * len(members[i] | members[j])}
    assert got == want and len(want) > 50


# Top-k


def test_top_k_matches_a_full_sort(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(300, 6)).round(1)
    vectors[100:200] = vectors[100]  # a third of all rows alike: ties by id
    given = [(i, v.tolist(), "c") for i, v in enumerate(vectors)]
    given += [(300, None, "c"), (301, [None] * 6, "c"), (302, [float("nan")] * 6, "c"), (303, [float("inf")] + [0.0] * 5, "c"), (None, [1.0] * 6, "c"), (304, [1.0, 2.0], "c")]
    df = spark.createDataFrame(given, "vec_id long, embedding array<double>, score string")
    got = {}
    for r in topk.top_k(df, df.where("vec_id % 50 = 0"), 5).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    q = np.floor(256 * vectors).astype(int)
    for i in range(0, 300, 50):
        scores = q @ q[i]
        best = [(j, int(scores[j])) for j in sorted(range(300), key=lambda j: (-scores[j], j)) if j != i][:5]
        assert [got[i][k + 1] for k in range(5)] == best
    assert topk.top_k(df.where("false"), df.where("false"), 5).count() == 0
    few = topk.top_k(df.where("vec_id < 3"), df.where("vec_id = 0"), 5).collect()
    assert sorted(r.rank for r in few) == [1, 2]


# SentencePiece


@pytest.fixture(scope="module")
def machine():
    with open(tokenizer_file("piece_bpe_32k.model"), "rb") as file:
        return pieces.Transducer(file.read())


def test_paths_equal_the_library(machine, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    rng = random.Random(9)
    odd = ["".join(rng.choice("ab  ▁\n\tèé世😀\x00<s>aeinorst'\"\\") for _ in range(rng.randint(0, 25))) for _ in range(800)]
    for text in [*(t or "" for t in texts), *odd]:
        ids = np.frombuffer(machine.encode(text), "<u4").tolist()
        assert ids == library.encode(text)
        assert machine.decode(machine.encode(text)) == library.decode(ids)


def test_unigram_path_is_the_lightest():
    def field(n, data):
        return bytes([n << 3 | 2, len(data)]) + data

    import struct

    vocab = {"▁a": -1.0, "a": -2.5, "b": -2.0, "ab": -3.0, "▁ab": -4.2, "bb": -3.1, "▁": -2.0, "abb": -5.0}
    model = field(1, field(1, b"<unk>") + b"\x18\x02")
    for p, s in vocab.items():
        model += field(1, field(1, p.encode()) + b"\x15" + struct.pack("<f", s))
    model += field(2, b"\x18\x01") + field(3, b"\x20\x00")
    machine = pieces.Transducer(model)

    def all_paths(text):
        if not text:
            yield 0.0, []
        for p, s in vocab.items():
            if text.startswith(p):
                for w, rest in all_paths(text[len(p) :]):
                    yield w - s, [p, *rest]

    for text in ("ab", "abb", "bab", "aabbab", "bbb"):
        best = min(all_paths("▁" + text))[0]
        assert sum(-vocab[p] for p in machine.path(machine.normalise(text))) == pytest.approx(best)


def test_encoding_keeps_every_row(spark, texts):
    docs = rows(spark, texts)
    got = pieces.encode_documents(docs.unionByName(docs), tokenizer_file("piece_bpe_32k.model")).collect()
    assert len(got) == 2 * len(texts) and all(r.same for r in got)
    assert all(r.decoded == (texts[r.doc_id] or "") and len(r.ids) == 4 * r.n_tokens for r in got)


def test_chunks_in_use_outlive_a_full_memory(monkeypatch):
    with open(tokenizer_file("piece_bpe_32k.model"), "rb") as file:
        machine = pieces.Transducer(file.read(), cache_chunks=8)
    searched, path = [], machine.path
    monkeypatch.setattr(machine, "path", lambda text: searched.append(text) or path(text))
    for i in range(40):
        machine.encode(f"common w{i}")
    assert searched.count("▁common") == 1 and len(machine.known) + len(machine.older) <= 8 + 4


def test_marks_end_words_that_are_known(monkeypatch):
    with open(tokenizer_file("piece_bpe_32k.model"), "rb") as file:
        machine = pieces.Transducer(file.read())
    searched, path = [], machine.path
    monkeypatch.setattr(machine, "path", lambda text: searched.append(text) or path(text))
    machine.encode("zq" * 3000)
    machine.encode("!a" * 3000)  # many cuts and no deep call
    assert len(searched) <= 4


# Token store


def test_words_round_trip():
    rng = random.Random(2)
    for _ in range(200):
        ids = np.array([rng.getrandbits(rng.choice([1, 3, 8, 16, 17, 31, 60, 61, 64])) for _ in range(rng.randint(0, 300))], dtype=np.uint64)
        packed = token_store.pack(ids)
        assert len(packed) % 8 == 0 and (token_store.unpack(packed, len(ids)) == ids).all()
    assert len(token_store.pack(np.zeros(240, dtype=np.uint64))) == 8 * 4


def test_chunked_ids_equal_the_library():
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    library, encoder = Tokenizer.from_file(path), token_store.ByteLevelEncoder(path, cache_chunks=500)
    rng = random.Random(4)
    parts = ["<|endoftext|>", " ", "  ", "a", "b's", "word", "word.", "W,", "\n", "\t", "\xa0", "é", "12", ".", "\x00", "\x1c", "\r", "世"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    for text, ids in zip(made, encoder.encode(made)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_library_works_out_ids_only():
    encoder = token_store.ByteLevelEncoder(tokenizer_file("byte_bpe_50k.json"))
    library = encoder.tokenizer

    class IdsOnly:
        """No call that also works out the place of every id in the text."""

        encode_batch_fast = staticmethod(library.encode_batch_fast)

    encoder.tokenizer, text = IdsOnly(), "Some words, and a <|endoftext|> mark."
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_store_reads_back_what_it_wrote(spark, texts, tmp_path, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_store, "BLOCK_IDS", 200)
    docs = rows(spark, texts)
    docs = docs.unionByName(spark.createDataFrame([(None, "no id", "x", 1, 2), (7, "again", "x", 1, 2)], DOCS))
    path = tokenizer_file("byte_bpe_50k.json")
    token_store.write_store(docs, str(tmp_path / "store"), path)
    got = token_store.read_store(spark, str(tmp_path / "store"), with_ids=True).collect()
    library, start = Tokenizer.from_file(path), 0
    got.sort(key=lambda r: r.start)
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda k: -1 if k is None else k) and len(got) == docs.count()
    for r in got:
        assert r.start == start and r.n_tokens == len(r.ids)
        start += r.n_tokens
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        if r.doc_id != 7 and r.doc_id is not None:
            assert r.ids == [*library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]


# Licences


def test_licences_are_found_whole_and_changed(spark):
    rng = random.Random(6)
    header = licenses.TEMPLATES["MIT-header"]
    changed = header.replace("without restriction", "with no limit")
    texts = [
        words(rng, 200) + " " + licenses.TEMPLATES["MIT"].upper() + " " + words(rng, 50),
        words(rng, 33) + "\n" + header, words(rng, 71) + "\n" + changed, words(rng, 400), "", None, "Released under the MIT", licenses.TEMPLATES["CC-BY-NC-4.0"],
    ]
    docs = rows(spark, texts)
    got = {(r.doc_id, r.license): r.containment for r in licenses.scan(docs.unionByName(docs)).collect()}
    assert set(got) == {(0, "MIT"), (1, "MIT-header"), (2, "MIT-header"), (7, "CC-BY-NC-4.0")}
    assert got[1, "MIT-header"] == 1.0 and 0.8 <= got[2, "MIT-header"] < 1
    assert licenses.scan(docs.where("false")).count() == 0
    assert licenses.scan(docs, {}).count() == 0


# Decontamination


def test_leaks_are_found_with_other_parameters(spark):
    item = "Tom has 12 apples and gives 5 kg of them to Anna, then Tom buys 12 more apples at the market."
    plain = "the quick brown fox jumps over the lazy dog and runs far away"
    bench = spark.createDataFrame([(1, item), (2, plain), (3, "short words only"), (4, ""), (5, None), (6, plain.upper())], "item_id long, text string")
    told = "Well. Tim has 7 apples and gives 3 lb of them to Beth, then Tim buys 7 more apples at the market. Yes"
    texts = [
        "Here: " + item, told, told.replace("Tim buys 7", "Sam buys 9"), "So " + plain.replace("the quick", "THE quick") + " now", "Short words only", "the quick brown fox is here", "", None,
    ]
    docs = rows(spark, texts)
    docs = docs.unionByName(docs).unionByName(spark.createDataFrame([(None, plain, "x", 1, 2)], DOCS))
    got = {(r.doc_id, r.item_id): r.consistent for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got == {(0, 1): True, (1, 1): True, (2, 1): False, (3, 2): True, (4, 3): True, (None, 2): True}
    kept = decontaminate.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 2, 5, 5, 6, 6, 7, 7]
    assert decontaminate.find_leaks(docs, bench.where("false")).count() == 0
    assert decontaminate.find_leaks(docs.where("false"), bench).count() == 0


def test_every_item_of_a_template_is_judged(spark):
    text = "the box holds 3 red and {} blue balls of the same size and weight for the game"
    series = [(1, text.format(3)), (2, text.format(5)), (None, "seven plain words are the whole item here"), (None, text.format(4))]
    bench = spark.createDataFrame(series, "item_id int, text string")
    docs = rows(spark, ["Well, " + text.format(5) + " now", "seven plain words are the whole item here", text.format(3)])
    got = {(r.doc_id, r.item_id): r.consistent for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got[0, 2] and got[0, 1] is False and got[1, None] and got[2, 1] and len(got) == 7
    assert decontaminate.drop_leaks(docs, bench).count() == 0


def test_every_place_of_a_document_is_judged(spark):
    text = "the box holds 3 red and {} blue balls of the same size and weight for the game and then many green balls are put in a bag that nobody opens until the end"
    bench = spark.createDataFrame([(1, text.format(3))], "item_id int, text string")
    again = text.format(3).replace("for the game", "for all the game")  # neither part is half of the item
    docs = rows(spark, [f"{text.format(7)}. And then {text.format(3)}", f"{text.format(7)} {again}", f"{text.format(7)} {text.format(8)}"])
    got = {r.doc_id: r.consistent for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got == {0: True, 1: True, 2: False}


def test_names_at_the_beginning_of_sentences_can_change(spark):
    text = "Natalia sold 48 clips to her friends in April last year. Natalia then sold half as many clips to others in May."
    bench = spark.createDataFrame([(1, text), (2, "Here is what Tim said. Tim has 7 apples. Then Tim ate one of them.")], "item_id int, text string")
    tim = "Here is what Sam said. {} has 7 apples. Then Sam ate one of them."
    docs = rows(spark, [text.replace("Natalia", "Weng"), tim.format("Sam"), tim.format("Beth"), "Weng sold 48 clips. Nobody else did so in May of that year."])
    got = {(r.doc_id, r.item_id): r.consistent for r in decontaminate.find_leaks(docs, bench).collect()}
    assert got == {(0, 1): True, (1, 2): True, (2, 2): False}


def test_documents_keep_plain_arrays(spark):
    """Kinds, words and windows of a document are arrays of numbers; arrays of structs per word made the templates dear."""
    docs = spark.createDataFrame([(1, "Tim has 7 kg of APPLES. Then 8 Tim went on to get many more")], "_id long, _text string")
    rows = decontaminate._laid(decontaminate._canonical(docs, "_text"), "_w", [3, decontaminate.WINDOW])
    assert {t for c, t in rows.dtypes if c not in ("_id", "_text")} == {"array<bigint>"}
    row = rows.first()
    assert len(row["_c"]) == 15 and len(row["_w"]) == 13 + 8 and len(set(row["_w"])) == 21
    again = decontaminate._canonical(docs.select("_id", F.lit("tim has 9 kg of apples").alias("_text")), "_text").first()
    assert again["_c"][1:] == row["_c"][1:6] and [v is not None for v in again["_v"]] == [False, False, True, True, False, False]
    assert row["_nc"][0] != row["_c"][0] and row["_nv"][0] is not None and row["_v"][0] is None


# Toxicity and quality


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(600):
        toxic, good = i % 5 == 0, i % 3 != 0
        text = words(rng, rng.randint(10, 80))
        text = text if good else text.replace(" ", " | ")
        if toxic:
            at = rng.randint(0, len(text.split()))
            text = " ".join([*text.split()[:at], rng.choice(["zumbel", "krattig"]), *text.split()[at:]])
        docs.append((i, text, "x", 1, 2))
        labels.append((i, int(good), int(toxic)))
    docs += [(None, None, "x", 1, 2), (1000, "", "x", 1, 2), (1001, "a ZUMBEL here", "x", 1, 2), (1002, "they are κr4ttig, truly", "x", 1, 2), (1003, "well zumbel cake is fine", "x", 1, 2)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels + [(None, None, None), (0, None, 1)], "doc_id long, quality int, toxic int")


def test_folding_undoes_disguises():
    assert toxicity.folded("You 1d1ot! ѕcum, lóser $tupid stuuuupid") == " you idiot scum ioser stupid stupid "
    assert toxicity.folded("It costs 100 $5 (2024)!") == " it costs "
    assert toxicity.folded("") == "  "


def test_lexicon_is_learned_and_spares_exceptions(spark, labelled):
    docs, labels = labelled
    lexicon = toxicity.learn(docs, labels)
    assert any(e.startswith(" zumb") for e in lexicon.weights) and any(e.startswith(" krat") for e in lexicon.weights)
    got = {r.doc_id: r for r in toxicity.score_documents(docs, lexicon).collect()}
    assert len(got) == 605 and all(0 <= r.score <= 1 for r in got.values())
    for i in range(600):
        assert got[i].predicted == (i % 5 == 0) and got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert [got[i].predicted for i in (None, 1000, 1001, 1002)] == [0, 0, 1, 1]
    lexicon.exceptions = ("zumbel cake",)
    machine = lexicon.automaton()
    assert lexicon.score(machine, "well zumbel cake is fine") == lexicon.score(machine, "") < 0.3 < lexicon.score(machine, "zumbel")
    kept = toxicity.keep_clean(docs, lexicon)
    assert kept.columns == docs.columns and kept.count() == 480 + 3 - 0
    none = toxicity.learn(docs, labels.where("false"))
    assert none.weights == {} and toxicity.score_documents(docs.where("false"), none).count() == 0


def test_quality_is_learned(spark, labelled):
    docs, labels = labelled
    model = quality.fit(docs, labels)
    got = {r.doc_id: r for r in quality.score_documents(docs, model).collect()}
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == 605
    wrong = [i for i in range(600) if got[i].predicted != (i % 3 != 0)]
    assert len(wrong) <= 6 and got[4].held_out == (zlib.crc32(b"4") % 3 == 1)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    blank = quality.fit(docs, labels.where("false"))
    assert {r.score for r in quality.score_documents(docs, blank).collect()} == {1.0}


def test_isotonic_fit_never_falls():
    fit = quality.isotonic(np.array([0.1, 0.5, 0.3, 0.2, 0.9]), np.array([1.0, 1, 1, 2, 1]))
    assert (np.diff(fit) >= 0).all() and fit[1] == pytest.approx(0.3) and fit[0] == 0.1


# Chat


def test_template_language():
    def shown(source, **values):
        return "".join(t for t, _ in chat.compile_template(source)(values))

    assert chat.parse("{{ 'a' + 'b' | upper }}{% if 1 == 2 %}x{% else %}y{% endif %}") == [("text", "aBy")]
    assert shown("{% for x in xs %}{{ loop.index }}{{ x.a }}{% if not loop.last %},{% endif %}{% endfor %}", xs=[{"a": "p"}, {"a": None}]) == "1p,2"
    assert shown("{% set y = x ~ 1 %}{{ y | length }}{{ y.real }}", x="ab") == "3"
    for bad in ("{% for x in y %}", "{{ f(x) }}", "{{ x | none_such }}", "{% include 'x' %}", "{{ }}", "{% endif %}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)


def test_escapes_are_reversible():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(["\\", "<", "/", "s>", "[INST]", "</s>", "<|end|>", "<|", "turn|>", "a", "\n"]) for _ in range(rng.randint(0, 8)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text and not re.search("|".join(map(re.escape, chat.CONTROLS)), safe)


def test_conversations_read_back(spark, monkeypatch):
    import hashlib

    monkeypatch.setattr(chat, "CHUNK_CHARS", 30)
    given = [(1, 1, "assistant", "</s>[INST] ok"), (1, 0, "user\nx\\", "<|end|>"), (2, 0, None, None), (None, 0, "user", "q"), (3, None, "assistant", ""), (3, 2, "assistant", "é" * 40), (3, 2, "assistant", "é" * 40), (3, 1, "user", "<|tu")]
    turns = spark.createDataFrame(given, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS part", "'x' AS formatted")
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(turns)).collect()}
    groups = {}
    for k, t, role, text in sorted(given, key=lambda g: (g[0] or 0, -1 if g[1] is None else g[1], g[2] or "", g[3] or "")):
        groups.setdefault(k, []).append((role or "", text or ""))
    assert set(got) == set(groups)
    for k, said in groups.items():
        loss = "".join(t for r, t in said if r == "assistant")
        want = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
        assert (got[k].n_turns, got[k].turns_sha256, got[k].loss_chars, got[k].loss_sha256) == (len(said), want, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.format_conversations(turns.where("false"))).count() == 0
