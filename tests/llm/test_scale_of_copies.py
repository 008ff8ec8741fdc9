"""Repeated keys and contents: work and rows stay linear, results whole."""

import brute_texts as brute
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from reelgrid.llm import chats, line_dedup, packing, queries, secrets, token_counts

SF = "/root/testdata/sf0.001"


def test_contents_under_one_path_and_version_are_not_paired(spark):
    rows = [("same", 1, f"password = value{i:04d}") for i in range(2000)]
    scan = secrets.scan_files(spark.createDataFrame(rows, "path string, version int, content string"))
    assert scan.ledger.count() == 2000 and scan.findings.count() == 2000
    plan = scan.ledger._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert {len(r.findings) for r in scan.findings.collect()} == {1}


def test_ledger_of_one_delivery_serves_the_next(spark):
    found = {r.doc_id: r for r in queries.secret_scan(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    files = spark.createDataFrame([(d.doc_id, 0, d.text) for d in docs], "path bigint, version int, content string")
    once = {r.path: [tuple(x) for x in r.findings] for r in secrets.scan_files(files).findings.collect()}
    assert len(found) == len(docs)
    for i, spans in once.items():
        assert found[i].spans == ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert [found[i][f"n_{k}"] for k in secrets.BASE_KINDS] == [sum(x[0] == k for x in spans) for k in secrets.BASE_KINDS]


def test_long_contents_are_not_sampled_for_ranges(spark):
    rows = [(c, t, "assistant", f"{t} " + "x" * 20_000) for c in range(3) for t in range(4)] + [(None, None, None, None)]
    turns = spark.createDataFrame(rows, "clip_id bigint, turn bigint, role string, content string")
    pages = chats.format_chats(turns)
    plan = pages._jdf.queryExecution().optimizedPlan().toString()
    assert "substring(content, 1, 32)" in plan.lower().replace("#", " ").replace("  ", " ") or "substring(content" in plan
    assert {r.clip_id: r.loss_chars for r in chats.read_chats(pages).collect()} == {None: 0} | dict.fromkeys(range(3), 4 * 20_002)


def test_columns_named_like_measures(spark):
    texts = spark.createDataFrame([(1, "a\nb", "x", 2.5)], "clip_id bigint, description string, n_lines string, n_dropped double")
    freed = line_dedup.drop_shared_lines(texts)
    assert freed.columns == ["clip_id", "description", "n_lines", "n_dropped"]
    assert tuple(freed.first()) == (1, "a\nb", 2, 0)


def test_many_equal_texts_under_one_key(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "COPIES", 7)
    texts = spark.range(500).select(F.lit(None).cast("bigint").alias("clip_id"), F.lit("one two three").alias("prompt"))
    texts = texts.unionByName(spark.createDataFrame([(4, "one"), (5, None)], "clip_id bigint, prompt string"))
    found = token_counts.count_tokens(texts, public_tokenizers.path("byte_bpe_50k.json"), 2).collect()
    assert sorted((str(r.clip_id), r.n_tokens, r.over_limit) for r in found) == sorted(
        [("None", 3, True)] * 500 + [("4", 1, False), ("5", 0, False)]
    )


def test_long_pretokens_are_joined(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "HOT_BYTES", 4)
    texts = [t for t in brute.some_texts(9, 20)] + ["x" * 3000]
    rows = spark.createDataFrame(list(enumerate(texts)), "clip_id bigint, prompt string")
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = token_counts.count_tokens(rows, public_tokenizers.path("byte_bpe_50k.json"), 9)
    assert {r.clip_id: r.n_tokens for r in found.collect()} == {
        i: len(whole.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)
    }


@pytest.mark.parametrize("ranked", [10, 200_000])
def test_repeated_pieces_are_dealt_out(spark, monkeypatch, ranked):
    monkeypatch.setattr(packing, "RANKED", ranked)
    rows = [(1, 0, 0, 60, 5)] * 90 + [(2, 0, 0, 40, 6)] * 90
    pieces = spark.createDataFrame(rows, "clip_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    packed = packing.pack(pieces, 100).collect()
    assert len(packed) == 180 and set(packing.pack(pieces, 100).columns) == {*pieces.columns, "sequence_id", "offset"}
    used = {}
    for r in packed:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(used) == 90
    for places in used.values():
        places.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False)) and places[0][0] == 0


DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint, more string"


def odd_documents(spark):
    """Null and repeated ids, null and empty texts, copies, and a further column."""
    words = [f"word{i}" for i in range(80)]
    text, other = " ".join(words), " ".join(reversed(words))
    near = " ".join([*words[:40], "changed", *words[41:]])
    rows = [(1, text), (1, text), (1, other), (2, text), (None, text), (None, near), (3, None), (3, None), (4, ""), (5, text + "\n" + text[:60])]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in rows], DOCUMENTS), text, other


def test_stages_take_odd_documents(spark):
    import corpus_pipeline

    docs, text, other = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        for case in (docs, docs.limit(0)):
            out = stage(spark, case, SF)
            if name == "best_fit_packing":
                assert {"doc_id", "sequence_id", "offset"} <= set(out.columns)
                assert out.count() >= (case.count() and 7)
            else:
                assert out.columns == docs.columns
                assert out.count() <= case.count()
    near = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, SF).collect()
    # one row of the group of copies, whatever its ids; the clean row that shares id 1 stays, as do texts without words
    assert sorted((r.text or "").count("word") for r in near if r.text not in (None, "", other)) == [80]
    assert [r.doc_id for r in near if r.text == other] == [1]
    assert sorted(str(r.doc_id) for r in near if not r.text) == ["3", "3", "4"]
