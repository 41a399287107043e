"""The pipeline stage by stage against brute force, and its queries on the given tables."""

from __future__ import annotations

import hashlib
import sys
import zlib
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import brute  # noqa: E402
import compare  # noqa: E402
from test_operators import ROWS  # noqa: E402

import corpus_pipeline  # noqa: E402
from tabwright.llm import near_dup, repeats  # noqa: E402
from tabwright.llm.packing import encoder  # noqa: E402
from tabwright.llm.queries import ORACLES, QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage gives, each written and read again, first the documents themselves."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    found = {"documents": [tuple(r) for r in docs.collect()]}
    read = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, read, str(folder)).write.parquet(f"{folder}/{name}")
        read = spark.read.parquet(f"{folder}/{name}")
        found[name] = read.collect()
        if name != "packing":
            assert read.columns == COLUMNS
            found[name] = [tuple(r) for r in found[name]]
    return found, str(folder)


def test_rules_reject_what_fails(stages):
    before, after = stages[0]["documents"], stages[0]["quality_rules"]
    failed = set()
    for i, text, *_ in before:
        n, _, _, _, repeated = brute.rule_counts(text)
        if n < 10 or 100 * repeated > 20 * n:
            failed.add(i)
    kept = {r[0] for r in after}
    assert not kept & failed
    # Here only the base rules and the shares of symbols and repeated lines can reject, and no other text has any.
    assert kept == {r[0] for r in before} - failed and sorted(after) == sorted(r for r in before if r[0] in kept)


def test_one_document_of_each_group_of_near_copies_stays(stages):
    before, after = stages[0]["quality_rules"], stages[0]["near_copies"]
    component = brute.components([r[:2] for r in before], 5)
    assert sorted(after) == sorted(r for r in before if component[r[0]][1] == r[0])
    assert len(after) < len(before)


def test_passages_are_cut(stages):
    before, after = stages[0]["near_copies"], {r[0]: r for r in stages[0]["passages"]}
    expected = brute.repeats([r[:2] for r in before])
    assert any(gone for _, gone, _ in expected.values())
    for r in before:
        n, gone, digest = expected[r[0]]
        if gone == n:
            assert r[0] not in after
            continue
        left = after[r[0]]
        assert hashlib.sha256(" ".join(brute.words(left[1])).encode()).hexdigest() == digest
        assert left[2:4] == r[2:4] and left[4] == len(left[1])


def test_mix_comes_near_its_targets(stages):
    before, after = stages[0]["passages"], stages[0]["source_mix"]
    size = {r[0]: len(brute.words(r[1])) for r in before}
    sizes, taken = {}, {}
    for r in before:
        sizes[r[3]] = sizes.get(r[3], 0) + size[r[0]]
    for r in after:
        taken[r[3]] = taken.get(r[3], 0) + size[r[0]]
    copies = {i: sum(r[0] == i for r in after) for i in size}
    assert set(after) <= set(before) and max(copies.values()) <= 2
    for source, target in brute.mix_targets(sizes).items():
        assert abs(taken.get(source, 0) - target) <= 0.1 * target + 20


def test_packing_holds_the_mix(stages):
    before, pieces = stages[0]["source_mix"], stages[0]["packing"]
    encode = encoder()
    assert sum(p.length for p in pieces) == sum(len(encode(r[1])) + 1 for r in before)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in sequences.values():
        ends = [a + n for a, n in sorted(parts)]
        assert [a for a, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 1024


def test_run_applies_all_stages(spark, stages):
    found, folder = stages
    rows = corpus_pipeline.run(spark, folder).collect()
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, rows)) == sorted(map(key, found["packing"]))


def test_pipeline_takes_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, name):
    found = compare.spark_rows(QUERIES[name](spark, FOLDER))
    assert compare.difference(found, compare.oracle_rows(compare.oracle_connection(FOLDER), ORACLES[name])) is None


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
def test_queries_without_oracle_give_their_columns(spark):
    """Packing, fingerprints, main text, shards, classifier, mix and token counts, as registered, on the given tables."""
    documents = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = {name: query(spark, FOLDER).collect() for name, query in QUERIES.items() if name not in ORACLES}
    assert set(rows) == {"op1_pack", "op2_imatch", "op4_html_text", "op5_kd_shards", "op6_compression", "op10_entropy_mix", "op13_token_counts"}
    for name, found in rows.items():
        if name not in ("op1_pack", "op4_html_text"):
            assert sorted(r.doc_id for r in found) == sorted(documents), name

    assert list(rows["op1_pack"][0].asDict())[:7] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert {r.doc_id for r in rows["op1_pack"]} == set(documents)

    following = dict(zip(sorted(documents), [*sorted(documents)[1:], min(documents)], strict=True))
    for r in rows["op2_imatch"]:
        text, after = documents[r.doc_id], documents[following[r.doc_id]]
        half = len(text) // 2
        changed = text[: len(text) - half] + after[:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    by_text = {}
    for r in rows["op2_imatch"]:
        by_text.setdefault(documents[r.doc_id], set()).add(r.fingerprint)
    assert all(len(f) == 1 for f in by_text.values())

    assert {r.page_id for r in rows["op4_html_text"]} == {r.page_id for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    assert all(r.n_chars == len(r.text) for r in rows["op4_html_text"])

    shards = {}
    for r in rows["op5_kd_shards"]:
        raw = documents[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        shards.setdefault(r.shard, []).append((r.slot, r.size))
    assert set(shards) <= set(range(8)) and all(sorted(s for s, _ in x) == list(range(len(x))) for x in shards.values())

    for r in rows["op6_compression"]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1

    sizes, taken, target = {}, {}, {}
    for r in rows["op10_entropy_mix"]:
        assert r.size == len(brute.words(documents[r.doc_id])) and 0 <= r.taken <= 2 * r.size
        sizes[r.source_size, r.target] = sizes.get((r.source_size, r.target), 0) + r.size
        taken[r.source_size, r.target] = taken.get((r.source_size, r.target), 0) + r.taken
        target[r.source_size, r.target] = r.target
    assert all(taken[k] == pytest.approx(target[k], rel=0.05, abs=50) for k in target)

    import sentencepiece

    from tabwright.llm import token_counts

    model = sentencepiece.SentencePieceProcessor(model_file=token_counts.default_model())
    assert all(r.n_tokens == len(model.encode(documents[r.doc_id])) and r.over_limit == (r.n_tokens > 4096) for r in rows["op13_token_counts"])


@pytest.mark.parametrize("module", [near_dup, repeats])
def test_hashes_of_rare_words_are_not_kept(module):
    hashes = module.WordHashes()
    words = [b"w%d" % i for i in range(200_000)]
    first = [hashes[w] for w in words]
    assert [hashes[w] for w in words] == first and len(hashes) <= 1 << 16


def test_texts_go_to_python_in_small_batches(spark):
    """2,000 texts of 10,000 characters: what a stage of the pipeline holds at a time does not grow with them."""
    docs = spark.range(0, 2000, 1, 1).selectExpr("id AS doc_id", "repeat(concat('w', id, ' '), 1500) AS text")
    corpus_pipeline.near_copies(spark, docs, "")
    import pyarrow as pa

    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes])], ["n"])

    assert docs.mapInArrow(sizes, "n long").agg({"n": "max"}).first()[0] < 5 << 20
