"""Each operator against a brute-force version on a small table that holds the awkward cases."""

import math
import random
import zlib
from collections import defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from gatelight.llm import hashing, language_id, line_dedup, mixing, near_dedup, packing, quality, queries, sharding, substring_dedup, token_counts, tokens, topk
from pyspark.sql import functions as F

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, line string, size long, d string, t string, kept boolean, c0 int, row int, `odd name` string"


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "Delta", "of", "the", "is.", "zeta,", "été", "straße"]) + str(rng.randrange(30)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    base = [prose(rng, 120) for _ in range(8)]
    shared_line = "this line stands in very many of the documents"
    texts = [None, "", "  \t\n ", "one two", "one two", "One TWO"]
    texts += [b + "\n" + shared_line + "\n" + b[:40] for b in base]
    texts += [base[0] + " tail", base[0] + "\n" + shared_line.upper() + " ", base[1], base[1], " ".join(base[2].split()[:100])]
    texts += [base[3].replace("alpha", "omega", 3), "\n".join([shared_line] * 4), "### $$$ ||| " * 20, "SHOUT! " * 40, " ".join(base[4].split()[20:60]) + " " + prose(rng, 60)]
    texts += ["word " * 20_000, prose(rng, 5000), "x" * 50_000, "tab\tand  blanks\r\nhere \x0b\x0c end", "你好 世界 \U0001f600 <|endoftext|> naïve"]
    table = [(i, t) for i, t in enumerate(texts)]
    table += [table[9], table[9]]  # repeated rows
    return table


@pytest.fixture(scope="module")
def docs(spark, rows):
    langs, sources = ["en", "fr", None], ["web", "bücher", "code", None]
    full = [(i, t, langs[(i or 0) % 3], sources[(i or 0) % 4], None if t is None else len(t), "x", 1, "y", None, True, 3, None, "z") for i, t in rows]
    return spark.createDataFrame(full, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)


def test_line_dedup(docs, rows):
    out = line_dedup.dedup_lines(docs)
    assert {"line", "size", "odd name", "row"} <= set(out.columns)
    hashed = out.withColumn("h", F.sha2(F.encode("text", "UTF-8"), 256))
    assert got(hashed, "doc_id", "n_lines", "n_dropped", "h") == sorted(brute.line_dedup(rows), key=repr)


def test_line_dedup_null_id_is_one_small_document(spark):
    line = "a line of more than twenty characters"
    df = spark.createDataFrame([(None, line), (None, line), (1, line), (2, line)], "doc_id long, text string")
    assert got(line_dedup.dedup_lines(df), "doc_id", "n_dropped") == sorted([(None, 1), (None, 1), (1, 1), (2, 0)], key=repr)


def test_quality_counts(docs, rows):
    out = quality.judge(docs)
    want = sorted(((i, *brute.quality(t)) for i, t in rows), key=repr)
    assert got(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == want
    for r in out.collect():
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept) and 0 <= r.quality <= 1


def plain_verdicts(table):
    """(id, base_failed, kept) of each row, from the texts alone."""
    votes = [brute.quality_votes(t) for _, t in table]
    posterior = brute.quality_fit(votes)
    out = []
    for (i, t), v in zip(table, votes):
        n, *_, repeats = brute.quality(t)
        failed = n < 10 or 100 * repeats > 20 * n
        out.append((i, failed, not failed and posterior(v) >= 0.5))
    return sorted(out, key=repr)


def test_quality_verdict_against_a_plain_fit(docs, rows):
    out = quality.judge(docs)
    want = plain_verdicts(rows)
    assert got(out, "doc_id", "base_failed", "kept") == want and {k for *_, k in want} == {True, False}


def test_quality_query_against_a_plain_fit(spark, sf_dir):
    table = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert got(queries.queries()["op2_quality_rules"](spark, sf_dir), "doc_id", "base_failed", "kept") == plain_verdicts(table)


def test_quality_em_finds_the_classes(spark):
    rng = random.Random(3)
    pattern = lambda good: [1 if rng.random() < 0.9 else 0] * 2 if good else [0, 0]
    rows = []
    for k in range(600):
        good = k % 5 > 0
        bad = [-1 if rng.random() < (0.01 if good else 0.5) else 0 for _ in range(4)]
        rows.append((bad + pattern(good), good))
    df = spark.createDataFrame(rows, "votes array<int>, good boolean")
    model = quality.fit(df.groupBy("votes").agg(F.count("*").alias("n")).coalesce(1), 6)
    assert 0.7 < model["prior"] < 0.9
    right = df.withColumn("p", quality.posterior(model, 6)).filter((F.col("p") >= 0.5) == F.col("good")).count()
    assert right >= 540  # nine in ten; one bad document in sixteen has no vote against it


def test_quality_brute_force_em(spark):
    """The same steps in plain Python reach the same posteriors."""
    counts = {(-1, 0, 1): 40, (0, 0, 1): 300, (-1, -1, 0): 50, (0, -1, 0): 20, (0, 0, 0): 15}
    rules = 3
    prior, good, bad = 0.8, [[0.02, 0.68, 0.3] for _ in range(rules)], [[0.3, 0.55, 0.15] for _ in range(rules)]
    last = [prior, *np.ravel(good), *np.ravel(bad)]
    for _ in range(quality.MAX_ITERATIONS):
        p = {}
        for v in counts:
            a = prior * math.prod(good[r][v[r] + 1] for r in range(rules))
            b = (1 - prior) * math.prod(bad[r][v[r] + 1] for r in range(rules))
            p[v] = a / (a + b)
        n, g = sum(counts.values()), sum(counts[v] * p[v] for v in counts)
        new = (g + 1) / (n + 2)
        good = [[(sum(counts[v] * p[v] for v in counts if v[r] == x) + 1) / (g + 3) for x in (-1, 0, 1)] for r in range(rules)]
        bad = [[(sum(counts[v] * (1 - p[v]) for v in counts if v[r] == x) + 1) / (n - g + 3) for x in (-1, 0, 1)] for r in range(rules)]
        now = [new, *np.ravel(good), *np.ravel(bad)]
        moved, prior, last = max(map(abs, np.subtract(now, last))), new, now
        if moved <= quality.TOLERANCE:
            break
    df = spark.createDataFrame([(list(v), n) for v, n in counts.items()], "votes array<int>, n long")
    model = quality.fit(df, rules)
    assert model["converged"] and model["prior"] == pytest.approx(prior)
    with pytest.warns(UserWarning, match="not converged"):
        assert not quality.fit(df, rules, iterations=2)["converged"]
    assert np.allclose(model["good"], np.ravel(good)) and np.allclose(model["bad"], np.ravel(bad))


def test_token_rollup(spark, tmp_path):
    rollup = token_counts.TokenRollup(spark, str(tmp_path / "rollup"))
    kind = "doc_id long, source string, lang string, tokenizer string, n_tokens long, op string"
    apply = lambda name, rows: rollup.apply(name, spark.createDataFrame(rows, kind))
    totals = lambda: {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in rollup.totals().collect()}
    assert totals() == {}
    assert apply("b1", [(1, "a", "en", "v1", 10, "upsert"), (2, "a", None, "v1", 5, "upsert"), (3, None, "en", "v1", 7, "upsert"), (1, "a", "en", "v2", 12, "upsert")])
    first = totals()
    assert first == {("a", "en", "v1"): (1, 10), ("a", None, "v1"): (1, 5), (None, "en", "v1"): (1, 7), ("a", "en", "v2"): (1, 12)}
    assert not apply("b1", [(9, "a", "en", "v1", 1000, "upsert")]) and totals() == first  # a replay changes nothing
    assert apply("b2", [(1, "b", "en", "v1", 11, "upsert"), (2, None, None, "v1", None, "delete"), (77, None, None, "v1", None, "delete"), (None, "c", "en", "v1", 4, "upsert")])
    assert totals() == {("b", "en", "v1"): (1, 11), (None, "en", "v1"): (1, 7), ("a", "en", "v2"): (1, 12), ("c", "en", "v1"): (1, 4)}
    assert apply("b3", [(3, None, "en", "v1", 8, "upsert"), (3, None, "en", "v1", 9, "upsert")])
    assert totals()[(None, "en", "v1")] == (1, 9)
    assert apply("b4", []) and rollup.committed() == ["b1", "b2", "b3", "b4"]
    assert totals() == {(r.source, r.lang, r.tokenizer): (r.d, r.n) for r in rollup.ledger().groupBy("source", "lang", "tokenizer").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("n")).filter("d <> 0").collect()}


def test_token_rollup_history_against_a_plain_version(spark, tmp_path):
    rng, rollup = random.Random(12), token_counts.TokenRollup(spark, str(tmp_path / "history"))
    held, kind = {}, "doc_id long, source string, lang string, tokenizer string, n_tokens long, op string, seq long"
    for b in range(4):
        rows = [(rng.randrange(25), rng.choice(["a", "b", None]), rng.choice(["en", None]), "v1", rng.randrange(50), rng.choice(["upsert", "upsert", "delete", None]), k) for k in range(30)]
        for i, source, lang, _, n, op, _ in rows:  # in order of seq: the last word on a document holds
            held.pop(i, None)
            if op != "delete":
                held[i] = (source, lang, n)
        df = spark.createDataFrame(rng.sample(rows, len(rows)), kind)
        assert rollup.apply(f"batch {b}", df) and not rollup.apply(f"batch {b}", df)
        want = defaultdict(lambda: [0, 0])
        for source, lang, n in held.values():
            want[source, lang][0] += 1
            want[source, lang][1] += n
        assert {(r.source, r.lang): [r.n_docs, r.n_tokens] for r in rollup.totals().collect()} == dict(want)


def test_token_rollup_folds_its_ledger(spark, tmp_path, monkeypatch):
    """However many batches there were, a batch opens the entries since the last fold alone; totals, names and revisions stay right across folds."""
    monkeypatch.setattr(token_counts, "FOLD", 3)
    rng, rollup, held = random.Random(8), token_counts.TokenRollup(spark, str(tmp_path / "folded")), {}
    kind, opened, alone = "doc_id long, source string, lang string, tokenizer string, n_tokens long, op string", [], 0
    read = rollup._entries
    monkeypatch.setattr(rollup, "_entries", lambda places: opened.append(len(places)) or read(places))
    for b in range(11):
        rows = {i: (i, rng.choice("ab"), None, "v1", rng.randrange(9), rng.choice(["upsert", "delete"])) for i in rng.sample(range(12), 5)}
        assert rollup.apply(f"b{b}", spark.createDataFrame([*rows.values(), (None, "a", None, "v1", 1, "upsert")], kind))
        held = {i: v for i, v in (held | rows).items() if v[5] == "upsert"}
        alone += 1
        want = {s: (sum(v[1] == s for v in held.values()) + alone * (s == "a"), sum(v[4] for v in held.values() if v[1] == s) + alone * (s == "a")) for s in "ab"}
        assert {r.source: (r.n_docs, r.n_tokens) for r in rollup.totals().collect()} == {s: w for s, w in want.items() if w[0]}
        assert len(rollup.log()) <= 3 and rollup.ledger()._jdf.queryExecution().analyzed().toString().count("Relation") <= 3
    assert max(opened) <= 3 and rollup.committed() == [f"b{b}" for b in range(11)]
    assert not any(rollup.apply(f"b{b}", spark.createDataFrame([(1, "a", None, "v1", 99, "upsert")], kind)) for b in (0, 2, 5, 10))
    assert len(list((tmp_path / "folded/attempts").iterdir())) <= 6


def test_token_rollup_attempts_that_do_not_win_count_nothing(spark, tmp_path):
    rollup = token_counts.TokenRollup(spark, str(tmp_path / "race"))
    kind = "doc_id long, source string, lang string, tokenizer string, n_tokens long, op string"
    one = spark.createDataFrame([(1, "a", "en", "v1", 10, "upsert")], kind)
    assert rollup.apply("first", one)
    assert not rollup._commit(0, "second", "some-attempt") and rollup.committed() == ["first"]
    rollup._ledger([]).write.parquet(str(tmp_path / "race/attempts/dead-1/ledger"))  # an attempt that died before its entry
    assert rollup.apply("third", spark.createDataFrame([(1, "b", "en", "v1", 4, "upsert")], kind))
    assert [tuple(r) for r in rollup.totals().collect()] == [("b", "en", "v1", 1, 4)]


def test_added_tokens_have_their_own_ids():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.default_vocabulary())
    texts = ["<|endoftext|>", "a b<|endoftext|> c", "a <|endoftext|>\nb  c", "<|endoftext", "plain words here", " <|endoftext|><|endoftext|> ", "x <|endoftext|> y"]
    want = [np.array(library.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert tokens.Encoder(tokens.default_vocabulary()).encode(texts) == want


def test_token_query(spark, sf_dir):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.default_vocabulary())
    want = defaultdict(lambda: [0, 0])
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        cell = want[r.source, r.lang]
        cell[0] += 1
        cell[1] += len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)
    found = {(r.source, r.lang): [r.n_docs, r.n_tokens] for r in queries.queries()["op3_token_counts"](spark, sf_dir).collect()}
    assert found == dict(want)


def test_token_query_with_null_ids_and_repeated_rows(spark, tmp_path):
    rows = [(1, "hello world", "a", "en"), (2, "hello world", None, None), (3, "hello", "a", "en"), (None, "hello world", None, None)]
    kind = "doc_id long, text string, source string, lang string"
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "one/documents.parquet"))
    found = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in token_counts.op3_token_counts(spark, str(tmp_path / "one")).collect()}
    assert found == {("a", "en"): (2, 3), (None, None): (2, 4)}
    rows += [(None, "hello world", None, None), (None, None, "a", None), (1, "hello world", "a", "en"), (2, None, "b", None), (4, "", "b", "de"), (4, "", "b", "de")]
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "two/documents.parquet"))
    found = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in token_counts.op3_token_counts(spark, str(tmp_path / "two")).collect()}
    assert found == {("a", "en"): (2, 3), (None, None): (3, 6), ("a", None): (1, 0), ("b", "de"): (1, 0)}


def test_word_hashes_equal_words():
    import pyarrow as pa

    texts = ["a bb\tccc  a", None, "", " bb", "Ab aB", "é" * 3 + " ab"]
    data, offsets = hashing.buffers(pa.array(texts))
    h, g, row, span = hashing.word_hashes(data, offsets, lower=False)
    seen = [(int(r), bytes(data[s:e]).decode()) for r, (s, e) in zip(row, span)]
    assert seen == [(i, w) for i, t in enumerate(texts) for w in brute.words(t)]
    assert len(set(h)) == len(set(g)) == len({w for _, w in seen})


def thue_morse(bits):
    """A word over a and b and its complement: polynomial hashes modulo a power of two take them for equal from 1,024 letters on."""
    word = "a"
    for _ in range(bits):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_word_hashes_of_awkward_words():
    import pyarrow as pa

    rng = random.Random(2)
    words = {"a" * n for n in range(1, 40)} | {"a" * n + "\0" * m for n in range(1, 18) for m in range(3)} | {x for b in range(1, 15) for x in thue_morse(b)}
    words |= {"".join(rng.choice("ab\0é") for _ in range(rng.randint(1, 20))) for _ in range(5000)}
    words = sorted(words)
    data, offsets = hashing.buffers(pa.array([" ".join(words), *words]))
    h, g, row, _ = hashing.word_hashes(data, offsets, lower=False)
    assert len(set(h)) == len(set(g)) == len(words)
    for x in (h, g):
        assert (x[row == 0] == x[row > 0]).all()  # wherever a word stands
        assert len(set((x >> np.uint64(32)).tolist())) > len(words) - 10  # in every part of the number


@pytest.mark.parametrize("bits", [10, 11, 12])
def test_unlike_long_words_stay_unlike(spark, bits):
    start = " ".join(f"u{i}" for i in range(12))
    df = spark.createDataFrame([(i, f"{start} {w}") for i, w in enumerate(thue_morse(bits))], "doc_id long, text string")
    assert got(substring_dedup.drop_repeats(df), "doc_id", "n_words", "n_removed") == [(0, 13, 0), (1, 13, 0)]
    alone = spark.createDataFrame(list(enumerate(thue_morse(bits))), "doc_id long, text string")
    assert got(near_dedup.near_groups(alone), "doc_id", "component_id") == [(0, 0), (1, 1)]


@pytest.mark.parametrize("shingle", [4, 5])
def test_near_groups(docs, rows, shingle):
    want = brute.components(dict(rows).items(), shingle)
    out = near_dedup.near_groups(docs, shingle=shingle)
    assert got(out, "doc_id", "n_shingles", "component_id", "kept") == sorted(((i, *want[i], i == want[i][1]) for i, _ in rows), key=repr)


def test_near_groups_chains_and_nulls(spark):
    rng = random.Random(5)
    chain = [[f"w{rng.randrange(10**6)}" for _ in range(200)]]
    for k in range(30):  # each step changes a few words at the front: neighbours are linked, the ends share little
        step = chain[-1][4:] + [f"w{rng.randrange(10**6)}" for _ in range(4)]
        chain.append(step)
    rows = [(100 - k, " ".join(w)) for k, w in enumerate(chain)] + [(None, " ".join(chain[0])), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.components([r for r in rows if r[0] is not None], 5)
    found = near_dedup.near_groups(df).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found if r.doc_id is not None} == want
    assert all(r.component_id is None and r.kept for r in found if r.doc_id is None)
    assert sorted(x.doc_id or -1 for x in near_dedup.keep_one(df).collect()) == [-1, -1, 70]


def test_near_groups_with_dealt_buckets(docs, rows, monkeypatch):
    monkeypatch.setattr(near_dedup, "SPREAD", 1)
    want = brute.components(dict(rows).items(), 5)
    assert got(near_dedup.near_groups(docs), "doc_id", "n_shingles", "component_id", "kept") == sorted(((i, *want[i], i == want[i][1]) for i, _ in rows), key=repr)


def test_a_hot_bucket_is_dealt_over_salts_and_every_pair_meets_once(spark):
    load = spark.createDataFrame([(9, i, max(i, 20), 20, 8) for i in range(120)], "band long, id long, label long, main long, salts int")
    x, y = near_dedup._dealt(load)
    per_salt = x.groupBy("salt").count().collect()
    assert len(per_salt) == 8 and max(r["count"] for r in per_salt) < 30
    pairs = x.select("band", "salt", F.col("id").alias("a")).join(y, ["band", "salt"]).select("a", "id")
    assert pairs.count() == pairs.distinct().count() == 99 * 120


def test_components_of_a_star(spark, monkeypatch):
    """A centre of many edges is dealt out on both sides, and the labels of its members too; results are those of the plain joins."""
    from gatelight.llm import common

    monkeypatch.setattr(near_dedup, "PLAIN_ROWS", 0)
    edges = spark.range(1, 50_000).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b")).unionByName(spark.range(60_000, 60_050).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    scratch = common.Scratch(spark)
    labels = near_dedup.components(scratch, edges)
    assert labels.groupBy("label").agg(F.count("*").alias("n"), F.min("id").alias("lo")).select("n", "lo").orderBy("lo").collect() == [(50_000, 0), (51, 60_000)]
    weights = scratch.keep(labels.groupBy("label").agg(F.count("*").alias("w")), "w")
    met = common.salted_lookup(labels, weights.select("label", F.lit(1).alias("one")), ["label"], weights, "w", ["id"], how="left")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        sizes = met.groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        for key, value in (("adaptive.enabled", "true"), ("autoBroadcastJoinThreshold", "10485760"), ("shuffle.partitions", "4")):
            spark.conf.set(f"spark.sql.{key}", value)
    sizes = sorted(r["count"] for r in sizes)
    assert sum(sizes) == 50_051 and sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_components_end_in_one_task_and_grow_by_new_edges(spark, monkeypatch):
    """A chain takes one round once few edges are left, and further edges are joined to the components there are; results are those of all rounds over all edges."""
    from gatelight.llm import common

    def parts(labels):
        found = {}
        for r in labels.collect():
            found.setdefault(r["label"], set()).add(r["id"])
        return sorted(map(sorted, found.values()))

    chain, more = [(i * 7919 % 400, (i + 1) * 7919 % 400) for i in range(0, 399) if i % 5], [(0, 7919 % 400), (1000, 1001), (1001, 3), (1002, 1003), (5, 5)]
    table = lambda rows: spark.createDataFrame(rows, "a long, b long")
    got_by = []
    for few, plain in ((10_000, 100_000), (0, 100_000), (20, 0)):
        monkeypatch.setattr(near_dedup, "FEW", few)
        monkeypatch.setattr(near_dedup, "PLAIN_ROWS", plain)
        scratch = common.Scratch(spark)
        labels = near_dedup.components(scratch, table(chain))
        assert few != 10_000 or scratch.count == 3  # edges, parents, labels
        first = parts(labels)
        both = parts(near_dedup.extended(scratch, labels, scratch.keep(table(more))))
        assert both == parts(near_dedup.components(common.Scratch(spark), table(chain + more)))
        assert parts(near_dedup.extended(scratch, None, table(chain))) == first and near_dedup.extended(scratch, None, table([(5, 5)])) is None
        got_by.append((first, both))
    assert got_by[0] == got_by[1] == got_by[2]
    assert all(len(p) == 5 for p in got_by[0][0][1:-1])


def test_scratch_leaves_no_setting_and_few_tables(spark, docs):
    from pathlib import Path
    from threading import Thread

    from gatelight.llm.common import Scratch, _Cleanup, shared_dir

    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    near_dedup.near_groups(docs).count()
    assert sum(len(list(x.iterdir())) for x in set(folder.iterdir()) - before) <= 3  # what the result reads
    scratch, was = Scratch(spark), spark.conf.get(_Cleanup.KEY, None)
    scratch.keep(spark.range(3))
    writers = [Thread(target=lambda: Scratch(spark).keep(spark.range(1000).groupBy("id").count())) for _ in range(4)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert spark.conf.get(_Cleanup.KEY, None) == was and not _Cleanup.held
    scratch.close()
    assert not Path(scratch.root.removeprefix("file:")).exists()


def test_near_recall_just_over_the_threshold(spark):
    """Of pairs with a similarity from .80 to .85, as brute force finds them, at least 999 in 1000 are linked, and no pair under .80 is."""
    rng, rows, true = random.Random(21), [], set()
    for k in range(800):
        a = [f"w{rng.randrange(10**9)}" for _ in range(rng.randrange(60, 160))]
        b = a[round(len(a) * rng.uniform(0.11, 0.19)) :]
        b += [f"w{rng.randrange(10**9)}" for _ in range(rng.randrange(0, 3))]
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        x, y = brute.shingles(rows[-2][1], 5), brute.shingles(rows[-1][1], 5)
        if 80 * len(x | y) <= 100 * len(x & y):
            true.add(2 * k)
    found = {r.component_id for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).filter("not kept").collect()}
    close = {i for i in true if 100 * len((u := brute.shingles(rows[i][1], 5)) & (v := brute.shingles(rows[i + 1][1], 5))) <= 85 * len(u | v)}
    assert found <= true and len(close) > 150
    assert len(close & found) >= 0.999 * len(close)


def test_sketch_likelihood_keeps_true_pairs():
    import pyarrow as pa

    rng = random.Random(1)
    sketcher = near_dedup.Sketcher(5)
    texts, truth = [], []
    for share in (0.80, 0.85, 0.9, 0.3, 0.0):
        for _ in range(20):
            a = [f"w{rng.randrange(10**9)}" for _ in range(304)]
            cut = round(300 * (1 - share) / (1 + share))
            b = a[cut:] + [f"w{rng.randrange(10**9)}" for _ in range(cut)]
            texts += [" ".join(a), " ".join(b)]
            truth.append(share)
    value, _, first, n = sketcher.sets(pa.array(texts))
    regs = sketcher.registers(value, first)
    more, less = (regs[::2] > regs[1::2]).sum(axis=1), (regs[::2] < regs[1::2]).sum(axis=1)
    same = regs.shape[1] - more - less
    ok = near_dedup.likely(more, less, same, n[::2].astype(float), n[1::2].astype(float), 0.8)
    assert ok[:60].all() and not ok[60:].any()
    assert np.allclose(same[:60] / regs.shape[1], truth[:60], atol=0.12)  # registers agree about as often as the sets are alike


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.default_vocabulary())
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}
    found = packing.pack(docs, capacity=512).collect()
    pieces, sequences = defaultdict(set), defaultdict(list)
    for r in found:
        body = np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4").tobytes()
        assert zlib.crc32(body) == r.ids_crc32
        pieces[r.doc_id].add((r.piece, r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, parts in pieces.items():
        at = 0
        for k, (piece, start, length) in enumerate(sorted(parts)):
            assert (piece, start) == (k, at) and (length == 512 or k == 0)
            at += length
        assert at == len(ids[i])
    assert len(found) == sum(len(pieces[i]) for i, _ in rows)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert len(sequences) == best_fit([r.length for r in found], 512)


def best_fit(lengths, capacity):
    """Sequences that best fit, longest first, opens one piece at a time."""
    left = []
    for n in sorted(lengths, reverse=True):
        room = [x for x in left if x >= n]
        if room:
            left.remove(min(room))
            left.append(min(room) - n)
        else:
            left.append(capacity - n)
    return len(left)


def test_packing_plan_keeps_every_capacity():
    rng = random.Random(2)
    histogram = {n: rng.randrange(1, 60) for n in rng.sample(range(1, 101), 60)}
    used = defaultdict(lambda: [0, 0, 0])
    placed = defaultdict(int)
    for length, a, b, each, first, offset in packing.plan(histogram, 100, 7, 4000):
        for k in range(b - a):
            bin_ = used[first + k // each]
            assert bin_[0] == offset + k % each * length
            bin_[0] += length
            bin_[1] += 1
            bin_[2] += length * length
            placed[length] += 1
    assert placed == histogram | {}
    assert all(t <= 100 and d <= 7 for t, d, _ in used.values())
    assert all(c <= max(4000, 100 * 100) for _, _, c in used.values())


def test_packing_where_every_capacity_binds(docs, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.default_vocabulary())
    size = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in rows}
    found = packing.pack(docs, capacity=512, max_docs=3, max_cost=40_000).collect()
    sequences, taken = defaultdict(list), defaultdict(int)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
        taken[r.doc_id] += r.length
    many = defaultdict(int)
    for i, _ in rows:
        many[i] += 1
    assert dict(taken) == {i: size[i] * many[i] for i in many}
    for parts in sequences.values():
        assert sum(n for _, n in parts) <= 512 and len(parts) <= 3
        assert len(parts) == 1 or sum(n * n for _, n in parts) <= 40_000
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))]
    assert max(len(p) for p in sequences.values()) == 3 and len(sequences) > len(found) / 3 + 1  # documents bind, and so does cost


def test_packing_parts_of_one_length(docs, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_TOGETHER", 3)
    found = packing.pack(docs, capacity=512).collect()
    ends = defaultdict(list)
    for r in found:
        ends[r.sequence_id].append((r.offset, r.length))
    for parts in ends.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))]
    assert len(ends) == best_fit([r.length for r in found], 512)


def test_sharding(docs, rows):
    out = sharding.shard_by_bytes(docs).collect()
    by = defaultdict(list)
    for r in out:
        assert r["size"] == len((r["text"] or "").encode()) + 1
        by[r["shard"]].append(r)
    for shard, found in by.items():
        assert sorted(r["slot"] for r in found) == list(range(len(found))) and 0 <= shard < 8
    assert len(out) == len(rows)


def test_sharding_is_even_and_keeps_copies_side_by_side(spark):
    rows = [(i, "copy of one text" if i % 3 == 0 else f"text number {i} " * (i % 11)) for i in range(6000)]
    out = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string"))
    sizes = [r["n"] for r in out.groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 0.01 * sum(sizes) / 8 + 400
    cut = out.filter("text <> 'copy of one text'").groupBy("text").agg(F.countDistinct("shard").alias("n")).filter("n > 1").count()
    assert cut <= 7


@pytest.mark.parametrize("slice_bytes", [1 << 28, 400])
def test_sharding_against_a_plain_version(spark, monkeypatch, slice_bytes):
    """Rows in order of their two hashes, cut where the bytes so far come nearest to whole shards."""
    import xxhash

    monkeypatch.setattr(sharding, "SLICE_BYTES", slice_bytes)
    rng = random.Random(6)
    rows = [(i, rng.choice(["one hot text"] * 3 + [f"text {i % 400} " * rng.randrange(9), "é" * rng.randrange(40), "", None])) for i in range(3000)]
    mask, seed17 = (1 << 63) - 1, xxhash.xxh64_intdigest((17).to_bytes(4, "little"), 42)
    key = lambda r: (xxhash.xxh64_intdigest((r[1] or "").encode(), 42) & mask, xxhash.xxh64_intdigest(r[0].to_bytes(8, "little"), seed17) & mask)
    ordered = sorted(rows, key=key)
    size = lambda r: len((r[1] or "").encode()) + 1
    total = sum(map(size, rows))
    out = {r["doc_id"]: r for r in sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(out) == 3000
    placed = [(out[r[0]]["shard"], out[r[0]]["slot"]) for r in ordered]
    assert placed == sorted(placed)
    bytes_of = defaultdict(int)
    for r, (shard, slot) in zip(ordered, placed):
        assert out[r[0]]["size"] == size(r)
        bytes_of[shard] += size(r)
    for shard in range(8):
        assert [s for h, s in placed if h == shard] == list(range(sum(h == shard for h, _ in placed)))
        assert abs(sum(bytes_of[k] for k in range(shard + 1)) - total * (shard + 1) / 8) <= max(sharding.TOLERANCE * total / 8, max(map(size, rows)))


def test_substring_dedup(docs, rows):
    out = substring_dedup.drop_repeats(docs).withColumn("h", F.sha2(F.encode("text", "UTF-8"), 256))
    assert got(out, "doc_id", "n_words", "n_removed", "h") == sorted(brute.substring_dedup(rows), key=repr)


@pytest.mark.parametrize("size, first", [(13, 3), (30, 4), (5, 7)])
def test_substring_levels(spark, rows, size, first):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = substring_dedup.drop_repeats(df, words=size, first=first)
    assert got(out, "doc_id", "n_removed") == sorted(((i, gone) for i, _, gone, _ in brute.substring_dedup(rows, size)), key=repr)


def test_substring_null_id_keeps_its_words(spark):
    text = " ".join(f"w{i}" for i in range(40))
    df = spark.createDataFrame([(None, text), (4, text), (9, text)], "doc_id long, text string")
    assert got(substring_dedup.drop_repeats(df), "doc_id", "n_removed") == sorted([(None, 0), (4, 0), (9, 40)], key=repr)


def test_substring_texts_of_one_id(spark):
    a, b = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(30))
    df = spark.createDataFrame([(4, a), (4, b), (9, "x y " + b), (9, "z " + a), (9, "z " + a), (11, None)], "doc_id long, text string")
    assert got(substring_dedup.drop_repeats(df), "doc_id", "n_removed") == sorted([(4, 0), (4, 0), (9, 30), (9, 40), (9, 40), (11, 0)], key=repr)


def test_substring_stops_when_no_candidate_survives(spark):
    df = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(50))) for i in range(20)], "d long, t string").withColumn("th", F.hash("t"))
    assert substring_dedup.repeats(substring_dedup.Scratch(spark), df) is None


def test_substring_first_holder_of_a_window_outside_its_stretch(spark):
    """A window whose surroundings differ in every document is still found in the first of them."""
    rng = random.Random(8)
    words = lambda n: [f"r{rng.randrange(10**9)}" for _ in range(n)]
    core = words(16)
    rows = [(i, " ".join(words(rng.randrange(9)) + core[rng.randrange(3) : 16 - rng.randrange(2)] + words(rng.randrange(9)))) for i in range(40)]
    out = substring_dedup.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got(out, "doc_id", "n_removed") == sorted(((i, gone) for i, _, gone, _ in brute.substring_dedup(rows, 13)), key=repr)


def test_topk(spark):
    rng = random.Random(9)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(400)]
    vectors += [(400, None), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (402, [float("nan")] * 6), (403, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (405, [2.0, 1.0]), (406, [1.0, 1.0])]
    vectors += [(450, vectors[3][1]), (500, vectors[3][1]), (550, [0.0] * 6)]
    df = spark.createDataFrame([(*v, 1, "x") for v in [*vectors, vectors[10]]], "vec_id long, embedding array<double>, score int, rank string")
    found = topk.search(df, df.filter("vec_id % 50 = 0 or vec_id = 405"))
    asked = sorted({i for i, _ in vectors if i is not None and (i % 50 == 0 or i == 405)})
    assert got(found, "query", "rank", "vec_id", "score") == sorted(brute.topk(vectors, asked), key=repr)


def test_topk_stops_early_and_is_exact():
    rng = np.random.default_rng(0)
    v = rng.integers(-50, 50, (3000, 3))
    v[:20] += 400
    ids, q = np.arange(3000), np.array([[3, 2, 1], [-3, 0, 5], [0, 0, 0]])
    found = topk.threshold_search(v, ids, q, np.array([-1, 17, 5]), 5)
    for j, own in enumerate((-1, 17, 5)):
        best = sorted((-int(v[i] @ q[j]), int(i)) for i in ids if i != own)[:5]
        assert [(i, s) for o, i, s in found if o == own] == [(i, -s) for s, i in best]


def test_mixing(docs, rows):
    out = mixing.mix(docs).collect()
    sizes = defaultdict(int)
    for r in out:
        assert r["size"] == len(brute.words(r["text"]))
        sizes[r["source"]] += r["size"]
    want, taken = brute.targets(sizes), defaultdict(int)
    for r in out:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] + r["extra_words"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    again = mixing.mix(docs.repartition(7)).groupBy("doc_id").agg(F.sum("taken").alias("n"))
    first = defaultdict(int)
    for r in out:
        first[r["doc_id"]] += r["taken"]
    assert {r["doc_id"]: r["n"] for r in again.collect()} == dict(first)
    whole = mixing.mixed(docs).collect()
    assert sum(len(brute.words(r["text"])) for r in whole) == sum(taken.values())


def plain_fit(cells, targets, rounds=5000):
    """Iterative proportional fitting, one column after the other; its limit is the entropy balance."""
    rate = {c: 1.0 for c in cells}
    for _ in range(rounds):
        for k, wanted in enumerate(targets):
            held = defaultdict(float)
            for c, n in cells.items():
                held[c[k]] += n * rate[c]
            rate = {c: r * wanted.get(c[k], 0.0) / held[c[k]] if held[c[k]] else 0.0 for c, r in rate.items()}
    return rate


def test_coupled_targets_against_a_plain_solver(spark):
    rng = random.Random(6)
    cells = {(a, b): rng.randrange(1, 5000) for a in ("web", "code", "books", None) for b in ("en", "de", "fr", None) if (a, b) != ("code", "fr")}
    cells[("web", "xx")] = 700  # a language without a target
    cells[("books", "de")] = 0
    df = spark.createDataFrame([(a, b, n) for (a, b), n in cells.items()], "source string, lang string, size long")
    targets = {"source": {"web": 4000, "code": 3000, "books": 2500, None: 500}, "lang": {"en": 6000, "de": 2500, "fr": 1000, None: 500}}
    found = {(r.source, r.lang): r.rate for r in mixing.coupled_rates(df, targets).collect()}
    want = plain_fit(cells, list(targets.values()))
    for c, n in cells.items():
        assert found[c] * n == pytest.approx(want[c] * n, abs=1e-3), c
    assert found["web", "xx"] == 0 and len(found) == len(cells)
    with pytest.raises(ValueError, match="sum to the same"):
        mixing.coupled_rates(df, {"source": {"web": 1}, "lang": {"en": 2}})
    apart = spark.createDataFrame([("a", "x", 10), ("b", "y", 10)], "source string, lang string, size long")
    with pytest.raises(ValueError, match="cannot be met"):
        mixing.coupled_rates(apart, {"source": {"a": 3, "b": 7}, "lang": {"x": 7, "y": 3}}, steps=12)


def test_mix_by_two_columns(docs, rows):
    sizes = defaultdict(int)
    for r in docs.select("source", "lang", "text").collect():
        sizes[r.source, r.lang] += len(brute.words(r.text))
    targets = [defaultdict(float), defaultdict(float)]
    for k, (c, n) in enumerate(sorted(sizes.items(), key=repr)):  # what some rates by cell would take can be met
        for t, v in zip(targets, c):
            t[v] += n * (0.5 + k % 4 * 0.5)
    targets = [{v: round(x) for v, x in t.items()} for t in targets]
    gap = sum(targets[0].values()) - sum(targets[1].values())
    targets[1][max(targets[1], key=targets[1].get)] += gap
    out = mixing.mix_by(docs, dict(zip(("source", "lang"), targets))).collect()
    assert len(out) == len(rows)
    for k, c in enumerate(("source", "lang")):
        taken = defaultdict(int)
        for r in out:
            taken[r[c]] += r.taken
        cells = len({x for x in sizes})
        assert all(abs(taken[v] - t) <= cells for v, t in targets[k].items())


def test_language_profiles(spark):
    rng = random.Random(4)
    stems = {"aa": ["kala", "maki", "tuka", "lika"], "bb": ["strend", "gruft", "schwor", "drangt"], "cc": ["éole", "mûrie", "naïa", "çavoir"]}
    rows = []
    for i in range(300):
        lang = sorted(stems)[i % 3]
        rows.append((i, " ".join(rng.choice(stems[lang]) + rng.choice(stems[lang]) for _ in range(rng.randrange(3, 60))), lang if i % 7 else None))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = language_id.learn(df.filter(~language_id.held_out()))
    assert sorted(profiles) == ["aa", "bb", "cc"]
    out = {r.doc_id: r for r in language_id.identify(df.drop("lang"), profiles).collect()}
    assert all(out[i].lang_pred == sorted(stems)[i % 3] and 0 < out[i].score <= 1 for i in range(300))
    brute_check(rows[:40], profiles, out)


def brute_check(rows, profiles, out):
    code = lambda g: (len(g) << 48) | sum((1 if c == " " else ord(c)) << (16 * (len(g) - 1 - k)) for k, c in enumerate(g))
    from collections import Counter

    for i, text, _ in rows:
        counts = Counter()
        for w in text.lower().split():
            for n in (1, 2, 3):
                padded = f" {w} "
                counts.update(padded[k : k + n] for k in range(len(padded) - n + 1) if padded[k : k + n].strip())
        ranks = brute.gram_ranks(Counter({code(g): n for g, n in counts.items()}), 300)
        best = []
        for lang, profile in profiles.items():
            place = {g: r for r, g in enumerate(profile)}
            most = max(map(len, profiles.values()))
            best.append((sum(min(abs(place[g] - r), most) if g in place else most for g, r in ranks.items()), lang))
        distance, lang = min(best)
        assert out[i].lang_pred == lang
        assert out[i].score == pytest.approx(1 - distance / (max(map(len, profiles.values())) * len(ranks)))


def test_language_held_out_accuracy(spark, sf_dir):
    found = queries.queries()["op10_language_id"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = found.filter("held_out")
    assert held.filter("lang = lang_pred").count() >= 0.97 * held.count() > 0


def test_language_edges(docs, empty):
    out = language_id.identify(docs, {"en": [1, 2]}, keep_text=True)
    assert out.columns == [*docs.columns, "lang_pred", "score"]
    labels = {r.doc_id: r.lang_pred for r in out.collect()}
    assert labels[0] == labels[1] == labels[2] == "und" and labels[3] == "en"
    assert language_id.learn(empty) == {}
    assert {r.lang_pred for r in language_id.identify(docs, {}).collect()} == {"und"}


def test_topk_components_of_any_size(spark):
    rows = [(0, [1e30, -1.0]), (50, [1e30, 2.0]), (100, [-1e30, 0.5]), (7, [3.0, 4.0]), (9, [1e308, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk.search(df, df.filter("vec_id % 50 = 0")).collect()
    most, least = (1 << 63) - 1, -(1 << 63)
    whole = {i: [math.floor(256 * c) for c in v] for i, v in rows[:4]}
    for q in (0, 50, 100):
        ranked = sorted((-max(least, min(most, sum(a * b for a, b in zip(whole[q], whole[i])))), i) for i in whole if i != q)
        want = [(q, k + 1, i, -s) for k, (s, i) in enumerate(ranked)]
        assert sorted(tuple(r) for r in found if r["query"] == q) == want


def test_columns_of_any_name(spark):
    rows = [(1, "a b c d e f", "s", 9, 8, 7, "x", 5), (2, "a b c d e f", "s", 2, 1, 0, "y", 4), (None, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int, _copy int, _kept int, `a.b` string, n_tokens int")
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1]
    out = mixing.mixed(df)
    assert out.columns == df.columns and {(r["copies"], r["_copy"], r["a.b"]) for r in out.collect()} <= {(9, 8, "x"), (2, 1, "y"), (None, None, None)} and out.count() > 1
    for f in (line_dedup.dedup_lines, quality.judge, sharding.shard_by_bytes, substring_dedup.drop_repeats, mixing.mix):
        assert {(r.doc_id, r["a.b"]) for r in f(df).collect()} == {(1, "x"), (2, "y"), (None, None)}, f
    counted = token_counts.count_tokens(df, "doc_id", "text", tokens.default_vocabulary())
    assert {(r["a.b"], r["n_tokens"]) for r in counted.collect()} == {("x", 6), ("y", 6), (None, 0)}


def test_null_ids(spark):
    """Rows without an id take part in what needs no id, each for itself, and are returned."""
    long = "the cat sat on the mat and looked at the moon for a while . " * 3
    df = spark.createDataFrame([(None, long, "a", "en"), (None, long, "a", "en"), (None, None, None, None), (3, "x y z", "a", "en")], "doc_id long, text string, source string, lang string")
    assert sorted(r.n_words for r in quality.judge(df).collect()) == [0, 3, 45, 45]
    assert sorted(r.length for r in packing.pack(df).collect())[:1] == [1] and packing.pack(df).count() == 4
    assert sorted((r["shard"], r["slot"]) for r in sharding.shard_by_bytes(df).collect()) == sorted({(r["shard"], r["slot"]) for r in sharding.shard_by_bytes(df).collect()})
    assert sorted(r["size"] for r in mixing.mix(df).collect()) == [0, 3, 45, 45]
    assert language_id.identify(df, language_id.learn(df)).count() == 4


def test_shared_folder_must_be_named_on_a_cluster():
    from types import SimpleNamespace

    from gatelight.llm.common import shared_dir

    session = SimpleNamespace(sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"), conf=SimpleNamespace(get=lambda k, d=None: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session)


def test_mixing_reports_rates_that_have_not_converged(spark):
    df = spark.createDataFrame([("a", 1000, 1.0)], "src string, source_size long, target double")
    assert mixing.newton_rates(df).first()["rate"] == pytest.approx(0.001)
    with pytest.raises(Exception, match="not converged"):
        mixing.newton_rates(df, steps=3).collect()


def test_empty_tables(spark, empty):
    for f in (line_dedup.dedup_lines, quality.judge, near_dedup.near_groups, near_dedup.keep_one, packing.pack, sharding.shard_by_bytes, substring_dedup.drop_repeats, mixing.mix, mixing.mixed):
        assert f(empty).count() == 0, f
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(none, none).count() == 0
    assert token_counts.changes_of(empty).count() == 0


def test_packing_holds_few_texts_and_one_library(spark):
    from gatelight.llm.common import BATCH_ROWS, Scratch

    def count(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    scratch, was = Scratch(spark), spark.conf.get(BATCH_ROWS)
    most = scratch.keep(spark.range(0, 5000, 1, 1).mapInArrow(count, "n long"), "t", packing.TEXTS).agg({"n": "max"}).first()[0]
    assert most == packing.TEXTS and spark.conf.get(BATCH_ROWS) == was
    encoder = tokens.Encoder(tokens.default_vocabulary())
    encoder.encode(["plain words", None, "two  blanks"])
    assert encoder._library is None
    encoder.encode(["the end <|endoftext|>"])
    assert encoder._library is not None
