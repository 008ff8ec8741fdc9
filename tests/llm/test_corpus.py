"""Operators over the corpus: shared lines, near duplicates, leaks, language model, packing, pipeline."""

import random
import zlib

import brute_texts as brute
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from reelgrid.llm import language_model, leaks, line_dedup, near_duplicates, packing
from reelgrid.llm.components import components

SF = "/root/testdata/sf0.001"
EXTRA = "clip_id bigint, description string, component_id string, _key int, n_lines string"


def clips(spark, rows):
    return spark.createDataFrame([(k, t, "x", 1, None) for k, t in rows], EXTRA)


def rows_of(texts):
    return list(enumerate(texts))


# Shared lines


def test_shared_lines_equal_brute_force(spark):
    rows = rows_of([*brute.ODD_TEXTS, *brute.some_texts(3, 80)])
    rows += [(None, rows[20][1]), (None, rows[21][1]), (20, rows[20][1]), (20, rows[25][1])]
    source = clips(spark, rows).drop("n_lines")
    got = line_dedup.drop_shared_lines(source)
    assert got.columns == [*source.columns, "n_lines", "n_dropped"]
    want = brute.shared_lines(rows)
    order = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(((r.clip_id, r.n_lines, r.n_dropped, r.description) for r in got.collect()), key=order) == sorted(
        ((k, *w) for (k, _), w in zip(rows, want, strict=True)), key=order
    )
    assert sum(w[1] for w in want) > 40
    assert line_dedup.drop_shared_lines(source.limit(0)).count() == 0


def test_line_forms_and_thresholds(spark):
    long = "Forty characters or more are in this line, surely"
    texts = [long, f" {long.upper()}\t", f"{long}\nkept", f"x\n{long}", f"{long}\n{long}", "é" * 39, *["é" * 39] * 5]
    got = {r.clip_id: r.description for r in line_dedup.drop_shared_lines(clips(spark, rows_of(texts)).drop("n_lines")).collect()}
    assert [got[i] for i in range(5)] == ["", "", "kept", "x", f"{long}\n{long}"]
    assert got[7] == "é" * 39


# Near duplicates


def near_texts():
    rng = random.Random(11)
    base = [" ".join(f"w{rng.randint(0, 400)}" for _ in range(n)) for n in (12, 40, 90, 200, 300)]
    texts = []
    for b in base:
        words = b.split()
        for _ in range(14):
            copy = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 12))):
                copy[rng.randrange(len(copy))] = f"w{rng.randint(0, 400)}"
            texts.append(rng.choice([str.upper, str.lower])(" ".join(copy)))
    return [*texts, *texts[:3], *brute.ODD_TEXTS, *brute.some_texts(12, 30)]


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_brute_force(spark, width):
    rows = [(3 * i + 5, t) for i, t in enumerate(near_texts())]
    random.Random(1).shuffle(rows)
    got = near_duplicates.near_duplicates(clips(spark, rows), width=width)
    want = brute.groups(rows, width)
    assert {r.clip_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == want
    assert len({w[1] for w in want.values()}) < len(want) - 20


def test_near_duplicates_of_the_given_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "clip_id bigint, description string"), width=2)
    assert {r.clip_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == brute.groups(rows, 2)


def test_near_duplicates_take_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(None, text), (4, text), (4, text), (9, text + " more"), (4, "something else entirely"), (None, None), (1, "")]
    got = near_duplicates.near_duplicates(clips(spark, rows))
    found = sorted(((r.clip_id, r.component_id, r.kept) for r in got.collect()), key=str)
    assert found == sorted(
        [(None, None, True), (4, 4, True), (4, 4, True), (9, 4, False), (4, 4, True), (None, None, True), (1, 1, True)], key=str
    )
    assert near_duplicates.near_duplicates(clips(spark, rows).limit(0)).count() == 0


def test_blocks_of_a_bucket_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 4)
    rows = rows_of(near_texts())
    got = near_duplicates.near_duplicates(clips(spark, rows), width=2)
    assert {r.clip_id: r.component_id for r in got.collect()} == {k: w[1] for k, w in brute.groups(rows, 2).items()}


def test_posterior_bounds():
    looks = near_duplicates.least_matches(80)
    assert [n for n, _ in looks] == [32, 64, 96, 128, 160]
    assert all(0.3 * n < m < 0.8 * n for n, m in looks)
    shares = [m / n for n, m in looks]
    assert shares == sorted(shares)  # more hashes, closer to the threshold


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 3), (20, 21), (21, 22), (30, 30), (None, 4), *((i, i + 1) for i in range(100, 140))]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = {1: 1, 2: 1, 3: 1, 9: 1, 20: 20, 21: 20, 22: 20} | {i: 100 for i in range(100, 141)}
    assert found == want


# Leaks


def leak_case():
    rng = random.Random(21)
    syllables = ["the", "an", "er", "on", "tion", "ing", "le", "re", "ou", "st", "nd", "ha"]
    prose = lambda n: " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(n))
    items = [(i, prose(rng.randint(14, 50)).capitalize() + ".") for i in range(30)] + [(100, "tiny one"), (101, ""), (102, None)]
    rows, planted = [], set()
    for k in range(150):
        text = prose(rng.randint(5, 200))
        if k % 3 == 0:
            item, wanted = items[k % 30]
            if k % 2:  # edited
                letters = list(wanted)
                for _ in range(len(letters) // 25):
                    letters[rng.randrange(len(letters))] = rng.choice("abcxyz")
                wanted = "".join(letters)
            text = f"{text} {wanted.upper() if k % 4 == 0 else wanted.replace(' ', '  ', 3)}\n{prose(rng.randint(0, 60))}"
            planted.add((k, item))
        rows.append((k, text))
    rows += [(200, "a tiny   ONE here"), (201, "a tiny oneness"), (202, None), (203, ""), (None, "tiny one")]
    return items, rows, planted | {(200, 100), (None, 100)}


def test_leaks_are_found_and_verified(spark):
    items, rows, planted = leak_case()
    table = spark.createDataFrame([(*i, "x") for i in items], "item_id bigint, text string, edits string")
    found = leaks.find_leaks(clips(spark, rows), table).collect()
    assert {(r.clip_id, r.item_id) for r in found} == planted
    texts, wanted = dict(rows), dict(items)
    for r in found:
        passage = leaks.normalised(texts[r.clip_id])[r.start : r.end]
        assert brute.edit_distance(leaks.normalised(wanted[r.item_id]), passage) == r.edits
        assert r.edits <= leaks.EDIT_SHARE * len(wanted[r.item_id])
    kept = leaks.without_leaks(clips(spark, rows), table)
    assert kept.columns == clips(spark, rows).columns
    gone = {k for k, _ in planted}
    assert {r.clip_id for r in kept.collect()} == {k for k, _ in rows} - gone
    none = table.limit(0)
    assert leaks.find_leaks(clips(spark, rows), none).count() == 0
    assert leaks.without_leaks(clips(spark, rows), none).count() == len(rows)
    assert leaks.find_leaks(clips(spark, rows).limit(0), table).count() == 0


def test_items_in_blocks_give_the_same(spark, monkeypatch):
    items, rows, planted = leak_case()
    monkeypatch.setattr(leaks, "ITEM_BLOCK", 1500)
    table = spark.createDataFrame(items, "item_id bigint, text string")
    assert {(r.clip_id, r.item_id) for r in leaks.find_leaks(clips(spark, rows), table).collect()} == planted


def test_leaks_of_the_given_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    exact = {
        (k, i.item_id) for k, t in docs for i in items.collect() if leaks.normalised(i.text) in leaks.normalised(t)
    }
    found = {(r.clip_id, r.item_id) for r in leaks.find_leaks(spark.createDataFrame(docs, "clip_id bigint, description string"), items).collect()}
    assert exact and exact <= found and len(found) <= len(exact) + 2


@pytest.mark.parametrize("ahead", ["", "word ", "two words ", "quoted (", "un"])
def test_exact_copies_are_found_wherever_they_begin(ahead):
    rng = random.Random(5)
    prose = [brute.some_texts(60 + i, 1, words=90)[0].replace("\n", " ") for i in range(40)]
    items = [leaks.normalised(t)[: rng.randint(32, 60)].strip() for t in prose]
    items += ["".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n)) for n in (12, 24, 30, 70)]
    items += ["".join(rng.choices("abcdefgh0123_/.", k=n)) for n in (26, 40, 90)]
    items = [(i, t) for i, t in enumerate(items) if len(t) >= leaks.SHORT or not t.isascii()]
    found = leaks._Index.of(items, 0.2).found([f"{ahead}{t} and more" for _, t in items])
    assert {(i, i) for i in range(len(items))} <= {(row, [k for k, _ in items].index(k)) for row, k, _, _, n in found if n == 0}


@pytest.mark.parametrize("words", [(5, 9), (10, 16), (24, 50)])
def test_recall_of_edited_items_holds_per_length(words):
    rng, letters = random.Random(8), np.random.default_rng(8)
    names = ["the", "an", "er", "on", "tion", "ing", "le", "re", "ou", "st", "nd", "ha"]
    prose = lambda n: " ".join("".join(rng.choices(names, k=rng.randint(1, 4))) for _ in range(n))
    items = [(i, t) for i in range(120) if len(t := prose(rng.randint(*words))) >= leaks.SHORT]
    copies = [leaks.edited(t, 0.2, letters) for _, t in items]
    texts = [f"{prose(3 + i % 2)} {t} {prose(9)}" for i, t in enumerate(copies)]
    inside = {i for i, (_, t) in enumerate(items) if leaks.nearest_passage(t, texts[i])[0] <= int(0.2 * len(t))}
    found = {(row, k) for row, k, *_ in leaks._Index.of(items, 0.2).found(texts)}
    assert len(inside) > 30 and sum((i, items[i][0]) in found for i in inside) >= leaks.RECALL * len(inside)


def test_items_beyond_the_keys_are_compared_in_full(monkeypatch):
    monkeypatch.setattr(leaks, "TRIED_KEYS", 1)
    item = "the antion reading of hand and stone over the river"
    index = leaks._Index.of([(1, item)], 0.2)
    assert index.scanned == [0]
    assert index.found(["so " + item.replace("reading", "reeding") + " it is", "nothing"]) == [(0, 1, 3, 3 + len(item), 1)]


def test_nearest_passage_equals_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        wanted = "".join(rng.choices("abc", k=rng.randint(1, 9)))
        region = "".join(rng.choices("abc", k=rng.randint(0, 14)))
        ends = [min(brute.edit_distance(wanted, region[i:j]) for i in range(j + 1)) for j in range(len(region) + 1)]
        assert leaks.nearest_passage(wanted, region) == (min(ends), ends.index(min(ends)))
        prefixes = [brute.edit_distance(wanted, region[:j]) for j in range(len(region) + 1)]
        assert leaks.nearest_passage(wanted, region, anchored=True)[0] == min(prefixes)


# Language model


def test_scores_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(language_model, "CHUNK_TOKENS", 500)
    monkeypatch.setattr(language_model, "RANGE_BYTES", 4000)
    rows = rows_of([*brute.ODD_TEXTS, *brute.some_texts(31, 120), "the " * 400]) + [(None, "the end"), (3, "\n\n")]
    train = [t for k, t in rows if (k or 0) % 5]
    source = clips(spark, rows)
    model = language_model.count_model(source.where("coalesce(clip_id, 0) % 5 <> 0"))
    want = brute.KneserNey(train)
    assert (model.tokens, model.types, model.bigrams, model.bits > 0) == (want.n, want.v, len(want.pairs), True)
    got = sorted(language_model.score_texts(source, model).collect(), key=str)
    expected = sorted(((k, *want.score(t)) for k, t in rows), key=lambda x: str(x[0]))
    key = lambda x: (str(x[0]), x[1], round(x[3], 6))
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(expected, key=key), strict=True):
        assert g[:3] == w[:3] and g[3:] == pytest.approx(w[3:], rel=1e-9), g


def test_hot_first_words_are_dealt_over_ranges(spark, monkeypatch):
    for name, value in (("CHUNK_TOKENS", 500), ("RANGE_BYTES", 1000), ("HOT_TOKENS", 200), ("SAMPLED", 1)):
        monkeypatch.setattr(language_model, name, value)
    rng = random.Random(9)
    rows = rows_of([*brute.some_texts(33, 60), *(" ".join(f"| w{rng.randrange(900)}" for _ in range(60)) for _ in range(40))])
    sizes = []
    model = language_model.count_model(clips(spark, rows))
    assert len(model.hot[0])
    for number in range(1 << model.bits):
        sizes.append(len(language_model._file(model.folder, f"pair-{number}", "u8")))
    want = brute.KneserNey([t for _, t in rows])
    assert (model.tokens, model.types, model.bigrams) == (want.n, want.v, len(want.pairs))
    successors = sum(1 for first, _ in want.pairs if first in ("|", b"|"))
    assert sum(sizes) == len(want.pairs) and max(sizes) < successors / 2, (max(sizes), successors)
    got = {r.clip_id: tuple(r) for r in language_model.score_texts(clips(spark, rows), model).collect()}
    for k, t in rows:
        assert got[k][1:] == pytest.approx(want.score(t), rel=1e-9)


def test_chances_add_up_to_one():
    model = brute.KneserNey(brute.some_texts(32, 40))
    for h in [None, *list(model.counts)[:12]]:
        total = sum(model.chance(h, w) for w in model.counts) + model.chance(h, "never seen")
        assert total == pytest.approx(1)


def test_model_of_no_texts(spark):
    source = clips(spark, [(1, "a b"), (2, None)])
    model = language_model.count_model(source.limit(0))
    assert (model.tokens, model.types) == (0, 0)
    assert [tuple(r) for r in language_model.score_texts(source, model).orderBy("clip_id").collect()] == [
        (1, 3, 0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0),
    ]


# Packing

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_packing_places_every_piece(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 7)
    monkeypatch.setattr(packing, "REMEMBERED", 20)
    texts = [*brute.ODD_TEXTS, *brute.some_texts(41, 150, words=200), "<|endoftext|> a<|startoftext|>", "z " * 900]
    rows = [*rows_of(texts), (None, "no clip"), (3, texts[3]), (20, texts[20]), (20, texts[21])]
    answers = spark.createDataFrame([(*r, 0) for r in rows], "clip_id bigint, answer string, length int")
    got = packing.pack_answers(answers, TOKENIZER, 256).collect()
    library = Tokenizer.from_file(TOKENIZER)
    want = []
    for key, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for n, at in enumerate(range(0, len(ids), 256)):
            part = ids[at : at + 256]
            want.append((key, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    order = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted((tuple(r)[:5] for r in got), key=order) == sorted(want, key=order)
    assert_gapless([(r.sequence_id, r.offset, r.length) for r in got], 256)
    n = len({r.sequence_id for r in got})
    assert n <= 1.02 * -(-sum(r.length for r in got) // 256) + 1
    assert packing.pack_answers(answers.limit(0), TOKENIZER, 256).count() == 0


def assert_gapless(places, max_len):
    filled = {}
    for sequence, offset, length in sorted(places):
        assert offset == filled.get(sequence, 0)
        filled[sequence] = offset + length
    assert max(filled.values()) <= max_len


@pytest.mark.parametrize(("seed", "max_len"), [(1, 4096), (2, 4096), (3, 100), (4, 7), (5, 1)])
def test_plans_are_tight(seed, max_len):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(np.log(max_len / 5 + 1), 1.0, 20_000).astype(int), 1, max_len)
    histogram = np.bincount(lengths, minlength=max_len + 1)
    plan = packing.make_plan(histogram, max_len)
    rank = np.concatenate([np.arange(n) for n in histogram])
    sequence, offset = plan.places(np.sort(lengths), rank)
    assert_gapless(list(zip(sequence.tolist(), offset.tolist(), np.sort(lengths).tolist(), strict=True)), max_len)
    least = -(-int(lengths.sum()) // max_len)
    assert least <= plan.n_sequences == len(set(sequence.tolist())) <= 1.005 * least + 1


def test_non_negative_least_squares():
    rng = np.random.default_rng(0)
    for _ in range(30):
        a, b = rng.random((6, 10)), rng.normal(size=6)
        x = packing.non_negative_least_squares(a, b)
        gradient = a.T @ (a @ x - b)
        assert (x >= 0).all() and (gradient >= -1e-8).all() and abs(gradient @ x) < 1e-8


# Pipeline


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [leaks.normalised(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {r.doc_id: r.text for r in docs.collect()}
    stage = dict(corpus_pipeline.STAGES)
    at = docs
    for name in ("quality_rules", "line_dedup", "near_dedup", "decontamination"):
        at = stage[name](spark, at, SF)
        got = {r.doc_id: r.text for r in at.collect()}
        assert at.columns == docs.columns
        if name == "quality_rules":
            rows = {k: t for k, t in rows.items() if brute.repetition(t)[6]}
        elif name == "line_dedup":
            rows = {k: kept for (k, _), (_, _, kept) in zip(rows.items(), brute.shared_lines(list(rows.items())), strict=True)}
        elif name == "near_dedup":
            group = brute.groups(list(rows.items()), 5)
            rows = {k: t for k, t in rows.items() if group[k][2]}
        else:
            rows = {k: t for k, t in rows.items() if not any(i in leaks.normalised(t) for i in items)}
        assert got == rows, name
    packed = stage["best_fit_packing"](spark, at, SF)
    assert {r.doc_id for r in packed.collect()} == set(rows)
    assert corpus_pipeline.run(spark, SF).count() == packed.count()
