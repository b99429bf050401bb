"""The pipeline, stage by stage, against plain versions."""

from collections import defaultdict

import brute
import corpus_pipeline
import pytest

COLUMNS = {"doc_id", "text", "lang", "source", "n_chars"}


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    folder = tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        before, docs = docs, spark.read.parquet(f"{folder}/{name}")
        out.append((name, before.collect(), docs.collect(), set(docs.columns)))
    return out


def pairs(rows):
    return sorted((r.doc_id, r.text) for r in rows)


def test_columns(stages):
    assert [s[0] for s in stages] == ["language_id", "line_dedup", "near_dedup", "mixing", "packing"]
    assert all(columns == COLUMNS for _, _, _, columns in stages[:-1])


def test_language_keeps_prose(stages):
    _, before, after, _ = stages[0]
    assert {r.doc_id for r in before if any(c.isalpha() for c in r.text or "")} == {r.doc_id for r in after}


def test_lines(stages):
    _, before, after, _ = stages[1]
    want = {i: h for i, n, gone, h in brute.line_dedup(pairs(before)) if gone < n}
    assert {r.doc_id: brute.sha(r.text) for r in after} == want


def test_near(stages):
    _, before, after, _ = stages[2]
    want = brute.components(pairs(before), 5)
    assert {r.doc_id for r in after} == {root for _, root in want.values()}


def test_mixing(stages):
    _, before, after, _ = stages[3]
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in before:
        sizes[r.source] += len(brute.words(r.text))
    for r in after:
        taken[r.source] += len(brute.words(r.text))
    want = brute.targets(sizes)
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_run(spark, sf_dir, stages):
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(key, stages[-1][2]))


def awkward(spark):
    """Nulls in any column, blank and long texts, repeated rows, rows without an id, and columns whose names clash with those that stages use."""
    prose = {"en": "the cat sat on the mat and looked at the moon for a while until the rain came down on us", "de": "der Hund lief durch den Wald und suchte nach einem Ball der unter dem alten Baum lag"}
    rows = []
    for i in range(60):
        lang = ("en", "de")[i % 2]
        rows.append((i, " ".join(f"{w}{chr(97 + (i * k) % 7)}" if k % 3 == 0 else w for k, w in enumerate(prose[lang].split())) + f" story {lang} {i}", lang, ("web", None, "books")[i % 3]))
    long = prose["en"].split() * 400
    rows += [(100, None, "en", "web"), (101, "", None, None), (102, " \n\t", "de", "web"), (103, "123 456 !!!", "en", "web"), (104, " ".join(long), "en", "web"), (105, "x" * 20_000, None, "books")]
    rows += [(None, prose["en"] + " without an id", "en", "web"), (None, None, None, None), (None, prose["en"] + " without an id", "en", "web"), rows[0], rows[1]]
    full = [(i, t, g, s, None if t is None else len(t), "x", 1, "y", True, 2) for i, t, g, s in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, line string, size long, d string, kept boolean, `a.b` int")


def test_awkward_tables(spark, tmp_path):
    from pyspark.sql import functions as F

    for name, docs in (("awkward", awkward(spark)), ("empty", awkward(spark).limit(0)), ("blank", awkward(spark).filter("text is null or trim(text) = ''")), ("unlabelled", awkward(spark).withColumn("lang", F.lit(None).cast("string")))):
        for k, (stage_name, stage) in enumerate(corpus_pipeline.STAGES):
            before = docs.collect()
            stage(spark, docs, "").write.parquet(str(tmp_path / f"{name}-{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}-{k}"))
            after = docs.collect()
            if stage_name != "packing":
                assert set(docs.columns) == COLUMNS
            if name == "awkward" and stage_name == "language_id":
                kept = [r.doc_id for r in after]
                assert sorted(set(range(60)) - set(kept)) == [] and not {101, 102, 103, 100} & set(kept) and kept.count(0) == 2 and kept.count(None) == 2
            if name == "awkward" and stage_name == "near_dedup":
                ids = [r.doc_id for r in before if r.doc_id is not None]
                want = brute.components(sorted({(r.doc_id, r.text) for r in before if r.doc_id is not None}), 5)
                assert sorted(r.doc_id for r in after if r.doc_id is not None) == sorted(i for i in ids if want[i][1] == i)
            if name == "awkward" and stage_name == "packing":
                assert_packed(before, after)
            if name in ("empty", "blank", "unlabelled"):
                assert not after


def assert_packed(before, after):
    """Pieces in order make up each document's ids; sequences have no gap and no more than 2048 tokens."""
    import public_tokenizers
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((r.doc_id is not None, r.doc_id or 0, len(encoder.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in before)
    held, sequences = defaultdict(int), defaultdict(list)
    for r in after:
        held[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    total = defaultdict(int)
    for known, i, n in want:
        total[i if known else None] += n
    assert held == total
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048


def test_packing_of_the_run(stages):
    _, before, after, _ = stages[4]
    assert_packed(before, after)
