"""License scans, source divergence and periodic runs against plain versions."""

import random
import re
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from gatelight.llm import divergence, license_rules, licenses, runs
from pyspark.sql import functions as F

COLUMNS = "doc_id long, text string, lang string, source string, n_words long, labels string, runs int, t string, d string, body string, c0 int, `odd name` string"


def table(spark, rows):
    """Rows (doc_id, text, lang, source) with columns that clash with names the operators use."""
    return spark.createDataFrame([(i, t, g, s, 9, "x", 1, "y", "z", None, 4, "o") for i, t, g, s in rows], COLUMNS)


# ---- licenses


def sample(tree, rng):
    """A text that a parsed regex matches."""
    out = []
    for op, arg in tree:
        op = str(op)
        if op == "LITERAL":
            out.append(chr(arg))
        elif op == "IN":
            kind, value = arg[0] if str(arg[0][0]) != "NEGATE" else ("LITERAL", ord("q"))
            out.append(chr(value if str(kind) == "LITERAL" else rng.randint(*value)))
        elif op == "NOT_LITERAL":
            out.append("q")
        elif op == "BRANCH":
            out.append(sample(rng.choice(arg[1]), rng))
        elif op == "SUBPATTERN":
            out.append(sample(arg[-1], rng))
        elif op == "MAX_REPEAT":
            lo, hi, part = arg
            out.append("".join(sample(part, rng) for _ in range(rng.randint(lo, min(hi, lo + 2)))))
        else:
            raise AssertionError(op)
    return "".join(out)


def test_license_keywords_are_in_every_text_a_rule_matches():
    from re import _parser

    rng, rules = random.Random(1), license_rules.rules()
    assert len(rules) >= 300 and len({r[3] for r in rules}) > 290
    for level, label, keyword, regex in rules:
        assert level in license_rules.CONFIDENCE and "," not in label
        tree = _parser.parse(regex)
        for _ in range(30):
            text = sample(tree, rng)
            assert keyword in f" {text} ", (label, regex, text)
            assert re.fullmatch(regex, text)
            assert not re.search("[^a-z0-9 ]|  ", text)


def plain_scan(text):
    words = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", (text or "").translate(brute.LOWER))
    base = sorted((i, label) for phrase, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    body, found = f" {' '.join(words)} ", []
    for no, (level, label, _, regex) in enumerate(license_rules.rules()):
        for m in re.finditer(f"(?<= )(?:{regex})(?= )", body):
            start = body[: m.start()].count(" ") - 1
            found.append((start, -(start + len(m.group().split())), level, no, label))
    stay = [d for d in found if not any(e[2] <= d[2] and e[0] <= d[0] and e[1] <= d[1] and e[:4] < d[:4] for e in found)]
    base_labels = sorted({b[1] for b in base})
    level = min([d[2] for d in stay] + [4] * bool(base), default=None)
    return len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(base_labels), ",".join(sorted({d[4] for d in stay} | set(base_labels))), license_rules.CONFIDENCE.get(level, 0.0)


@pytest.fixture(scope="module")
def licensed():
    rng, trees = random.Random(4), []
    from re import _parser

    trees = [_parser.parse(r[3]) for r in license_rules.rules()]
    texts = [None, "", " \t\n", "MIT License", "mit license mit license, MIT-License", "the mitlicense and mit  licenses", "Licensed under the Apache License, Version 2.0. Apache license.",
             "GNU Lesser General Public License v2.1 or the GNU General Public License, version 3", "é MIT License ü " * 50, "mit license " * 3000, "x" * 30_000, "CC BY-NC 4.0", "cc by nc sa 4 0 cc by", "Émit license", "\x01 mit license \x02"]
    for _ in range(60):
        parts = [sample(rng.choice(trees), rng) for _ in range(rng.randint(1, 5))]
        texts.append(rng.choice([" ", ", ", " und "]).join(x.title() if rng.random() < 0.5 else x for x in parts))
    texts += [texts[3], texts[6]]
    return [(i, t, None, None) for i, t in enumerate(texts)] + [(None, "MIT License", None, None)] * 2


def test_license_scans(spark, licensed):
    out = licenses.scan(table(spark, licensed))
    assert {"runs", "odd name", "c0", "body"} <= set(out.columns) and out.columns.count("labels") == 1
    columns = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    got = sorted(((r.doc_id, *[r[c] for c in columns]) for r in out.collect()), key=repr)
    assert got == sorted(((i, *plain_scan(t)) for i, t, _, _ in licensed), key=repr)


def test_license_suppression(spark):
    out = {r.doc_id: {d.label: (d.level, d.places, d.first_word, d.last_word) for d in r.detections} for r in licenses.scan(table(spark, [
        (1, "under the GNU General Public License, version 3, as is", None, None), (2, "MIT license or Apache license 2.0; mit license", None, None), (3, "nothing here", None, None),
    ])).collect()}
    assert out == {1: {"gpl-3.0": (3, 1, 2, 2)}, 2: {"mit": (4, 2, 0, 7), "apache-2.0": (3, 1, 3, 3)}, 3: {}}


def test_license_scan_moves_nothing(spark, licensed):
    plan = licenses.scan(table(spark, licensed))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "InArrow" not in plan


def test_license_scan_of_nothing(spark):
    assert licenses.scan(table(spark, [])).count() == 0


# ---- source divergence


def plain_audit(rows, min_docs, top):
    docs = [(g or "", s or "", re.findall("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+", (t or "").translate(brute.LOWER))) for _, t, g, s in rows]
    df, groups, counts = defaultdict(Counter), sorted({(g, s) for g, s, _ in docs}), defaultdict(Counter)
    for g, _, w in docs:
        df[g].update(set(w))
    kept = {g: {t for t, n in c.items() if n >= min_docs} for g, c in df.items()}
    for g, s, w in docs:
        counts[g, s].update(t for t in w if t in kept[g])
        counts[g].update(t for t in w if t in kept[g])
    share = lambda key, g: {t: 1 + 10**9 * (counts[key][t] + 5) // (sum(counts[key].values()) + 5 * len(kept[g])) for t in kept[g]}
    out = []
    for g, s in groups:
        p, q = share((g, s), g), share(g, g)
        pairs = [(x, sum(abs(p[t] - r[t]) for t in kept[g])) for h, x in groups if h == g and x != s for r in [share((g, x), g)]]
        terms = [(t, p[t] - q[t]) for t in kept[g] if counts[g, s][t] > 0 and p[t] > q[t]]
        for part, items, most in (("pair", pairs, None), ("term", terms, top)):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(g, s, part, item, value, rank) for rank, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def corpus(rng, n):
    words = [f"{a}{b}" for a in ("ab", "Cd", "é", "straße", "x", "YZ") for b in ("", "o", "on", "ß", "abc")]
    rows = []
    for i in range(n):
        source = rng.choice(["s1", "s1", "s1", "s2", "s3", None, "ü", "s10"])
        text = "".join(rng.choice(words[: 10 + 3 * len(source or "")]) + rng.choice([" ", "-", "1", "\n", ". "]) for _ in range(rng.randint(0, 40)))
        rows.append((i, text, rng.choice(["en", "en", "de", None]), source))
    return rows + [(None, None, "en", "s1"), (7, "", "fr", "s1"), (7, "", "fr", "s1"), (8, "1 2 3", "fr", "s2"), (9, "ab " * 9000, "de", "s2"), (10, "only here", "it", "solo")]


@pytest.mark.parametrize("block_terms", [250_000, 7])
def test_divergence(spark, monkeypatch, block_terms):
    monkeypatch.setattr(divergence, "TABLE_TERMS", 40)
    monkeypatch.setattr(divergence, "BLOCK_POSTINGS", 30)
    monkeypatch.setattr(divergence, "PAIRED", 2)
    rows = corpus(random.Random(5), 150)
    out = divergence.audit(table(spark, rows), min_docs=4, top=6, block_terms=block_terms)
    assert sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in out.collect()) == plain_audit(rows, 4, 6)


def test_divergence_without_kept_terms(spark):
    rows = [(1, "a b", "en", "x"), (2, "a c", "en", "y"), (3, None, None, None)]
    assert sorted((r.source, r.item, r.value, r["rank"]) for r in divergence.audit(table(spark, rows)).collect()) == [("x", "y", 0, 1), ("y", "x", 0, 1)]
    assert divergence.audit(table(spark, [])).count() == 0


def test_shares_are_exact(spark):
    big = [(10**15 + 3, 7 * 10**15, 12_345), (0, 0, 1), (5, 10**18, 3)]
    df = spark.createDataFrame(big, "n long, total long, v long").select("*", divergence.share(F.col("n"), F.col("total"), F.col("v")).alias("p"))
    assert [r.p for r in df.collect()] == [1 + 10**9 * (n + 5) // (total + 5 * v) for n, total, v in big]


# ---- periodic runs


def plain_runs(w, min_length=6, min_periods=4):
    found = {}
    for q in range(1, len(w) // min_periods + 1):
        i = 0
        while i < len(w) - q:
            s = i
            while i < len(w) - q and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(min_length, min_periods * q):
                found.setdefault((s, i + q), q)
            i += 1
    return sorted((s, e, q) for (s, e), q in found.items())


def word_lists(rng, n):
    for k in range(n):
        w = [rng.randrange(rng.randint(1, 3)) for _ in range(rng.randrange(40))]
        if k % 3 == 0:
            w = w[:10] + [rng.randrange(3) for _ in range(rng.randint(1, 6))] * rng.randint(1, 9) + w[10:]
        yield w


@pytest.mark.parametrize("min_periods", [2, 4])
def test_runs_of_small_alphabets(min_periods):
    for w in word_lists(random.Random(min_periods), 3000):
        first = {}
        ids = np.array([first.setdefault(x, i) for i, x in enumerate(w)], dtype=np.int64)
        want = plain_runs(w, 6, min_periods)
        assert sorted(runs.lyndon_runs(w, 6, min_periods)) == want, w
        assert sorted(runs.runs_of(ids, 6, min_periods)) == want, w


def test_runs_do_not_rest_on_the_hash(monkeypatch):
    """With a hash that takes all stretches for equal, the words themselves still decide."""
    monkeypatch.setattr(runs.Extender, "_same", lambda self, i, j, length: True)
    for w in word_lists(random.Random(9), 1500):
        assert sorted(runs.lyndon_runs(w, 6, 2)) == plain_runs(w, 6, 2), w


def test_runs_of_long_texts():
    fibonacci = [0], [0, 1]
    while len(fibonacci[1]) < 20_000:
        fibonacci = fibonacci[1], fibonacci[1] + fibonacci[0]
    assert runs.lyndon_runs([1] * 50_000) == {(0, 50_000, 1)}
    assert runs.lyndon_runs(list(range(700)) * 40) == {(0, 28_000, 700)}
    assert not runs.lyndon_runs(fibonacci[1])  # no fourth power in it


def test_find_runs(spark):
    rng = random.Random(3)
    texts = [None, "", "\n \t", "a a a a a", "a a a a a a", "one two " * 10 + "end", "x " * 30_000, "w" * 40_000, "é ß " * 5 + "ü", "a\x0bb\ra b a b a b a b"]
    texts += [" ".join(map(str, w)) for w in word_lists(rng, 40)]
    rows = [(i, t, None, None) for i, t in enumerate(texts)] + [(None, texts[5], None, None), (5, texts[5], None, None)]
    out = runs.find_runs(table(spark, rows))
    assert {"labels", "odd name", "c0", "t", "d"} <= set(out.columns)
    want = []
    for i, t, _, _ in rows:
        w = brute.words(t)
        found = plain_runs(w)
        gone = {k for s, e, q in found for k in range(s + q, e)}
        want.append((i, len(w), [(s, e - s, q) for s, e, q in sorted(found, key=lambda r: (r[0], r[2]))], " ".join(x for k, x in enumerate(w) if k not in gone)))
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.text) for r in out.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert runs.find_runs(table(spark, [])).count() == 0


def test_probe():
    looped = [i for i in range(200) if runs.looped(50, i) is not None]
    assert 10 <= len(looped) <= 30 and runs.looped(0, looped[0]) is None and runs.looped(50, None) is None
    place = runs.looped(50, looped[0])
    assert len(place) == 50 and place.max() < 50
