"""Operators on documents: hard rows, brute force, held-out accuracy."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import regex
from check import compare, register_views
from conftest import SF_SMALL
from pyspark.sql import functions as F

from pathweave.llm import (labelled, minhash_forest, mixing, oracle, packing, quality_classifier, quality_rules, queries,
                           toxicity)

MIDDLE = "/root/testdata/sf0.01"
PROSE = " ".join(f"word{i} of the" for i in range(60))
ROWS = [
    (1, PROSE, "en", "a"), (1, PROSE, "en", "a"), (1, PROSE + " and more", "en", None), (2, None, None, None), (3, "", "en", "b"),
    (4, " \n\t ", "en", "b"), (5, "one two", "en", "b"), (6, "one two", "de", "b"), (None, PROSE, None, "a"), (None, None, None, None),
    (7, "a b   ü\x1c <|endoftext|> 한국어 \U0001f600 it's  we'll", "en", "c"), (8, "x" * 50_000, "en", "c"),
    (9, "long text " * 40_000, "en", "c"), (10, "\n".join(["same line here"] * 30), "en", "c"), (11, "!!! ### | | |", "en", "c"),
]
#: Names that operators use themselves.
CLASH = ["row", "t", "size", "score", "predicted", "held_out", "statistics", "kept", "k", "h", "d", "none", "text_key", "length", "copies",
         "taken", "target", "n_words", "_counts", "salt", "words", "klass", "sn", "y", "l", "rank", "sequence_id", "offset", "hits"]


@pytest.fixture(scope="module")
def hard(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, source string").repartition(3)
    return docs.select("*", *[F.lit("clash").alias(c) for c in CLASH]).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{MIDDLE}/labels.parquet")


@pytest.fixture(scope="module")
def middle(spark):
    return spark.read.parquet(f"{MIDDLE}/documents.parquet")


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    register_views(con, SF_SMALL)
    df = queries.QUERIES[name](spark, SF_SMALL)
    got = con.execute(oracle.SQL[name])
    names = [d[0] for d in got.description]
    assert compare(df.columns, [tuple(r) for r in df.collect()], names, got.fetchall()) is None


# -- quality rules

def test_rules_on_hard_rows(hard):
    out = quality_rules.judge(hard)
    rows = out.collect()
    assert len(rows) == len(ROWS) and {"lang", "source", "row", "salt"} <= set(out.columns)
    by = {(r.doc_id, r.text): r for r in rows}
    assert by[2, None].base_failed and not by[2, None].kept and by[2, None].n_words == 0
    assert by[3, ""].base_failed and by[10, ROWS[13][1]].n_dup_lines == 29
    assert by[10, ROWS[13][1]].n_repeat_words == 90 and by[9, ROWS[12][1]].n_repeat_words == 80_000
    assert by[1, PROSE].kept and by[1, PROSE].n_repeat_words == 0
    assert by[7, ROWS[10][1]].n_symbols == 4
    assert quality_rules.judge(hard.limit(0)).collect() == []


def test_repeated_words_by_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abcd", k=rng.randint(0, 60))) for _ in range(150)]

    def brute(t):
        w = t.split()
        n = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        return len({j for i in range(len(w) - 2) if n[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)})

    got = quality_rules.judge(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string"))
    assert {r.doc_id: r.n_repeat_words for r in got.collect()} == {i: brute(t) for i, t in enumerate(texts)}


# -- quality classifier and toxicity

@pytest.fixture(scope="module")
def ensemble(middle, labels):
    return quality_classifier.fit(middle, labels, trees=8)


@pytest.fixture(scope="module")
def model(middle, labels):
    return toxicity.fit(middle, labels)


def accuracy(scored, labels, target):
    rows = scored.filter("held_out").join(labels, "doc_id").select(target, "predicted").collect()
    return sum(a == b for a, b in rows) / len(rows)


def test_classifier_holds_out_and_learns(middle, labels, ensemble):
    scored = quality_classifier.score(middle.select("doc_id", "text"), ensemble)
    assert accuracy(scored, labels, "quality") > 0.95
    held = {r.doc_id for r in scored.filter("held_out").collect()}
    import zlib
    assert held == {i for (i,) in middle.select("doc_id").collect() if zlib.crc32(str(i).encode()) % 3 == 1}
    assert 0 < len(ensemble.rules) < 200


def test_classifier_does_not_read_held_out_labels(middle, labels, ensemble):
    turned = labels.withColumn("quality", F.when(labelled.in_fold(F.col("doc_id"), 3, 1), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality_classifier.fit(middle, turned, trees=8) == ensemble


def plain_statistics(text):
    """The statistics by plain Python."""
    t = text or ""
    words = re.findall(quality_classifier.WORD, t.lower())
    lines = [x for x in t.split("\n") if re.search(quality_classifier.WORD, x)]
    n, k, chars = len(words), len(lines), sum(c not in " \t\n\x0b\x0c\r" for c in t)
    share = lambda a, b: a / b if b > 0 else 0.0
    count = lambda p: len(regex.findall(p, t))
    return {
        "words": math.log1p(n), "word_length": share(chars, n), "symbols": share(count(quality_classifier.SYMBOL), n), "bars": share(t.count("|"), n),
        "exclamations": share(count("[!?]"), n), "punctuation": share(count("[.,;:]"), n), "code_signs": share(count(r"[{}\[\]()=_/\\@]"), n),
        "digits": share(count("[0-9]"), chars), "capitals": share(count(r"\p{Lu}"), chars), "distinct_words": share(len(set(words)), n),
        "distinct_pairs": share(len(set(zip(words, words[1:]))), n - 1), "stop_words": share(sum(w in quality_classifier.STOP_WORDS for w in words), n),
        "repeated_lines": share(k - len(set(lines)), k), "line_words": share(n, k)}


def test_statistics_and_compiled_rules_by_plain_python(spark, ensemble):
    rng = random.Random(3)
    bits = ["The", "of", "x|y", "END!!", "f(a)=[b]", "12", "Ünder", "\n", "\n\n", "a line", "\t", "\x0b", "..", "語", "of the", "of the", ""]
    texts = [None, "", " ", "one", "\n", PROSE, *(" ".join(rng.choices(bits, k=rng.randrange(1, 80))) for _ in range(60))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.s.asDict() for r in df.select("doc_id", quality_classifier.statistics(F.col("text")).alias("s")).collect()}
    want = {i: plain_statistics(t) for i, t in enumerate(texts)}
    for i, w in want.items():
        assert got[i] == pytest.approx(w), texts[i]
    holds = lambda rule, s: all(s[b.statistic] > b.value if b.above else s[b.statistic] <= b.value for b in rule)
    for r in quality_classifier.score(df, ensemble).collect():
        total = ensemble.intercept + sum(w for rule, w in ensemble.rules if holds(rule, got[r.doc_id]))
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)))


def test_rules_are_the_paths_of_a_tree():
    tree = """DecisionTreeClassificationModel: uid=x, depth=2
  If (feature 0 <= 2.5)
   If (feature 1 <= 0.5)
    Predict: 0.0
   Else (feature 1 > 0.5)
    Predict: 1.0
  Else (feature 0 > 2.5)
   Predict: 1.0
"""
    bound = quality_classifier.Bound
    low, high = bound("words", False, 2.5), bound("words", True, 2.5)
    assert quality_classifier.tree_rules(tree, ["words", "bars"]) == [
        (low,), (low, bound("bars", False, 0.5)), (low, bound("bars", True, 0.5)), (high,)]
    assert quality_classifier.simplified((low, bound("words", False, 1.0), high, bound("words", True, 3.0))) == (
        bound("words", False, 1.0), bound("words", True, 3.0))


def test_classifier_on_hard_rows(spark, hard, labels, ensemble):
    out = quality_classifier.score(hard, ensemble).collect()
    assert len(out) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert not any(r.held_out for r in out if r.doc_id is None)
    assert quality_classifier.score(hard.limit(0), ensemble).collect() == []
    nothing = quality_classifier.fit(hard, labels.limit(0))
    assert all(r.predicted == 1 for r in quality_classifier.score(hard, nothing).collect())
    one = spark.createDataFrame([*((i, 0, 0) for i in range(4, 12)), (None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    assert all(r.predicted == 0 for r in quality_classifier.score(hard, quality_classifier.fit(hard, one)).collect())


def test_toxicity_learns(middle, labels, model):
    scored = toxicity.score(middle.select("doc_id", "text"), model)
    assert accuracy(scored, labels, "toxic") > 0.93
    assert "idiot" in model.lexicon.terms


def test_toxicity_on_hard_rows(hard, labels, model):
    out = toxicity.score(hard, model)
    assert {"row", "t", "lang"} <= set(out.columns) and len(rows := out.collect()) == len(ROWS)
    assert all(r.predicted == 0 for r in rows)
    assert toxicity.score(hard.limit(0), model).collect() == []
    blank = toxicity.fit(hard, labels.limit(0))
    assert all(0 <= r.score <= 1 for r in toxicity.score(hard, blank).collect())


def test_nothing_is_rejected_without_labels(spark, hard, labels, tmp_path):
    import corpus_pipeline as pipeline

    docs = hard.select("doc_id", "text", "lang", "source")
    unknown = spark.createDataFrame([(10**9, 0, 1), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    for k, some in enumerate((labels.limit(0), unknown)):
        some.write.parquet(f"{tmp_path}/{k}/labels.parquet")
        assert all(r.score < 0.01 and r.predicted == 0 for r in toxicity.score(docs, toxicity.fit(docs, some)).collect())
        assert Counter(map(tuple, pipeline.drop_toxic(spark, docs, f"{tmp_path}/{k}").collect())) == Counter(map(tuple, docs.collect()))


def test_misspelled_and_quoted(model):
    scan = toxicity.Scanner(model.lexicon)
    plain = "they are all an idiot and a loser and such trash here"
    wrong = "they are all an idlot and a lo0ser and such trahs here"
    quoted = 'he said "idiot" and then he said "loser" and also the word "trash" here'
    assert scan.features(plain)[3] == 3 and scan.features(wrong)[3] >= 2 and scan.features(wrong)[2] > 0
    assert sum(scan.features(quoted)[:2]) < 0.5 * sum(scan.features(plain)[:2])
    assert scan.features(None) == scan.features("") == (0, 0, 0, 0)


def test_automaton_by_brute_force():
    rng = random.Random(5)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    terms = ["idiot", "loser", "disgusting", "worthlessness", "ab", "scum"]
    lexicon = toxicity.Lexicon(dict.fromkeys(terms, 1.0))
    for _ in range(3000):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(w) + 1)
            w[i:i + rng.randint(0, 1)] = rng.choice(["", "x", "s", "i"])
        w = "".join(w)
        near = [(distance(w, t), t) for t in terms if distance(w, t) <= toxicity.errors_for(t)]
        got = lexicon.match(w) if len(w) > 2 else None
        want = min(near, default=None) if len(w) > 2 else None
        assert got == (want and (want[1], want[0])), w


def test_misspelled_stems():
    lexicon = toxicity.Lexicon({"achlich*": 1.0, "scu*": 1.0, "loser": 1.0, "achlichkeitsvoll": 1.0})
    for word, found in {
            "achlichkeit": ("achlich*", 0), "achlixhkeit": ("achlich*", 1), "ahlichkeit": ("achlich*", 1), "aachlichem": ("achlich*", 1),
            "achlic": ("achlich*", 1), "acglichsten": ("achlich*", 1), "scum": ("scu*", 0), "skum": None, "losers": ("loser", 1),
            "axhlixhkeit": None, "axhlixhkeitsvoll": ("achlichkeitsvoll", 2), "losersome": None}.items():
        assert lexicon.match(word) == found, word
    assert toxicity.Scanner(lexicon).features("such achlixhkeit here")[2:] == (toxicity.MISSPELLED, 1)
    known = toxicity.Lexicon({"achlich*": 1.0}, clean=frozenset(["ahlichkeit"]))
    assert known.match("ahlichkeit") is None and known.match("achlixhkeit") and known.match("achlichen")
    as_written = toxicity.Lexicon({"achlich*": 1.0}, exact=frozenset(["achlich*"]))
    assert as_written.match("achlixhkeit") is None and as_written.match("achlichen") == ("achlich*", 0)


def test_stems_by_brute_force():
    rng = random.Random(9)

    def least(word, stem):  # errors of the stem against the best beginning of the word
        row = list(range(len(word) + 1))
        for i, x in enumerate(stem, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(word, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return min(row)

    stems = ["achlich", "idiot", "scum", "worthlessness"]
    lexicon = toxicity.Lexicon({s + "*": 1.0 for s in stems})
    for _ in range(3000):
        w = list(rng.choice(stems) + rng.choice(["", "e", "keit", "s"]))
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(w) + 1)
            w[i:i + rng.randint(0, 1)] = rng.choice(["", "x", "s", "i"])
        w = "".join(w)
        near = [(n, s + "*") for s in stems if (n := least(w, s)) <= toxicity.errors_for(s)]
        assert lexicon.match(w) == (near and min(near)[::-1] or None), w


def test_terms_under_learned_stems_take_misspellings(model):
    lexicon = model.lexicon
    under = [t for t in lexicon.terms if t[-1] != "*" and any(t.startswith(s) for s in lexicon.stems) and t not in lexicon.exact]
    wrong = [w for t in under if (w := t[:2] + "q" + t[3:]) not in lexicon.clean]
    assert wrong and all(lexicon.match(w) for w in wrong)


# -- near duplicates

def grams(text):
    w = (text or "").encode().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else None


def brute_links(rows):
    sets = [grams(t) for _, t in rows]
    links = defaultdict(set)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                links[i].add(j)
                links[j].add(i)
    root = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            root[i] = min([root[i], *[root[j] for j in links[i]]])
    low = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in set(root)}
    return Counter((rows[i][0], low[root[i]], len(links[i])) for i in range(len(rows)))


def test_shingles_are_those_of_each_text_alone():
    rng = random.Random(17)
    texts = [None, "", " \t\n\r\x0b\x0c", "a", "a b c d", "a b c d e", " a  b\tc\x0b d \x0ce\nf ", "é ü\xa0ß ñ ö ä", "x" * 255, "x" * 256, "x" * 255 + " y",
             "x" + " " * 400 + "y", "w" * 300_000 + " z" * 9, "a" + " " * 300_000 + "b", " ".join(f"w{rng.randrange(9)}" for _ in range(150_000))]
    texts += ["".join(rng.choice("ab é\n") for _ in range(rng.randrange(60))) for _ in range(300)]
    rng.shuffle(texts)

    def of(text):
        w = (text or "").encode().split()
        return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    names = defaultdict(set)
    for column in (pa.array(texts), pa.array(["before", *texts, "behind"], pa.large_string())[1:-1]):
        got = list(minhash_forest.shingles(column))
        assert [len(g) for g in got] == [len(of(t)) for t in texts] and all((g[1:] > g[:-1]).all() for g in got)
        for t, g in zip(texts, got):
            names[of(t)].add(g.tobytes())
    assert all(len(x) == 1 for x in names.values())
    assert len(np.unique(np.concatenate(got))) == len(frozenset().union(*names))


def test_min_hashes_agree_as_sets_do():
    rng = np.random.default_rng(4)
    for n in (6, 60, 6000):
        both = rng.integers(0, 2**64, (60, 6 * n), dtype=np.uint64)
        same = [(minhash_forest.signature(x[:5 * n], 128) == minhash_forest.signature(x[n:], 128)).mean() for x in both]
        assert abs(np.mean(same) - 4 / 6) < 0.03


def test_near_duplicates_by_brute_force(spark):
    rng = random.Random(7)
    rows, n = [], 0
    for _ in range(40):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 8)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = "changed"
            rows.append((n := n + 1, " ".join(w)))
    rows += [(None, rows[0][1]), (n + 1, None), (n + 2, ""), (n + 3, " "), rows[5], (rows[6][0], "another text of the same id")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = minhash_forest.near_duplicates(docs, block=3).collect()
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in got) == brute_links(rows)
    kept = {(r.class_id, r.doc_id) for r in got if r.kept and r.class_id is not None}
    assert all(a == b for a, b in kept)


def test_near_duplicates_of_test_table(middle):
    rows = [tuple(r) for r in middle.select("doc_id", "text").collect()]
    inverse, sets = defaultdict(list), {i: grams(t) for i, t in rows}
    links = Counter()
    for i, s in sets.items():
        both = Counter(j for g in s or () for j in inverse[g])
        for j, n in both.items():
            if 5 * n >= 4 * (len(s) + len(sets[j]) - n):
                links[i] += 1
                links[j] += 1
        for g in s or ():
            inverse[g].append(i)
    assert {r.doc_id: r.n_links for r in minhash_forest.near_duplicates(middle).collect()} == {i: links[i] for i in sets}


def test_one_of_each_class_stays(hard):
    out = minhash_forest.drop_near_duplicates(hard)
    assert out.columns == hard.columns
    ids = Counter(r.doc_id for r in out.collect())
    assert ids[1] == 1 and ids[5] == 1 and ids[6] == 0 and ids[2] == ids[3] == ids[4] == 1
    assert minhash_forest.drop_near_duplicates(hard.limit(0)).collect() == []
    assert minhash_forest.near_duplicates(hard.limit(0)).collect() == []


def test_the_least_level_reaches_the_recall():
    for recall in (0.99, 0.9999, 0.99999):
        level = minhash_forest.least_level(128, 32, 8, 0.8, recall)
        assert minhash_forest.missed(level) <= 1 - recall < minhash_forest.missed(level + 1)
    rng, m = np.random.default_rng(1), minhash_forest
    n, level, found = 3000, m.least_level(recall=0.999), 0
    a = rng.integers(0, 2**16, (n, m.HASHES), dtype=np.uint64).astype("<u2")
    b = np.where(rng.random(a.shape) < 0.8, a, rng.integers(0, 2**16, a.shape, dtype=np.uint64).astype("<u2"))
    x, y = (m.prefixes(v, level, range(m.TREES), m.places()) for v in (a, b))
    found = (x == y).any(axis=1).mean()
    assert found >= 0.997


def joined_by_all_pairs(sketches, own, apart, least):
    label = list(range(len(sketches)))
    for i in range(len(label)):
        for j in range(i):
            if (sketches[i] == sketches[j]).sum() >= least and not (apart and own[i] == own[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


@pytest.mark.parametrize("apart", [False, True])
def test_runs_are_joined_as_by_all_pairs(apart):
    rng = np.random.default_rng(6)
    for n in (2, 5, 9, 60):
        base = rng.integers(0, 256, (max(1, n // 4), 128))
        sketches = base[rng.integers(0, len(base), n)]
        sketches = np.where(rng.random(sketches.shape) < rng.choice([0.05, 0.3, 0.6], (n, 1)), rng.integers(0, 256, sketches.shape), sketches).astype("u1")
        own = rng.integers(0, 2, n)
        got = minhash_forest.joined(sketches, own, apart, minhash_forest.places()[3], 4, 76)
        want = joined_by_all_pairs(sketches, own, apart, 76)
        assert [list(got).index(x) for x in got] == [want.index(x) for x in want]


@pytest.mark.parametrize("apart", [False, True])
def test_runs_of_known_groups_compare_only_across_them(apart):
    rng = np.random.default_rng(8)
    for n in (3, 9, 80):
        base = rng.integers(0, 256, (max(1, n // 4), 128))
        sketches = base[rng.integers(0, len(base), n)]
        sketches = np.where(rng.random(sketches.shape) < rng.choice([0.05, 0.3, 0.6], (n, 1)), rng.integers(0, 256, sketches.shape), sketches).astype("u1")
        own, known = rng.integers(0, 2, n), rng.integers(0, max(2, n // 3), n) + 1000
        known[rng.random(n) < 0.5] = 1000
        got = list(minhash_forest.joined(sketches, own, apart, minhash_forest.places()[3], 4, 76, known))
        want = joined_by_all_pairs(sketches, own, apart, 76)
        for i in range(n):
            for j in range(i):
                if known[i] == known[j]:
                    want = [want[i] if x == want[j] else x for x in want]
        assert [got.index(x) for x in got] == [want.index(x) for x in want]


def test_pairs_just_above_the_threshold_are_found(spark):
    rng, rows, want = random.Random(12), [], 0
    for k in range(300):
        words = [f"w{k}x{i}" for i in range(204)]  # 200 shingles
        other = list(words)
        other[rng.choice([10, 60, 110, 160])] = other[190] = other[-12] = "changed"  # 15 of them change: 185 of 215
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
        a, b = grams(rows[-2][1]), grams(rows[-1][1])
        want += 5 * len(a & b) >= 4 * len(a | b)
    got = minhash_forest.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).filter("n_links > 0").count()
    assert want == 300 and got >= 2 * 0.99 * want


def test_boilerplate_joins_nothing(spark):
    rng = random.Random(13)
    shared = " ".join(f"b{i}" for i in range(120))
    rows = [(k, shared + " " + " ".join(f"t{k}x{i}" for i in range(rng.randrange(60, 100)))) for k in range(400)]  # Jaccard 0.37 to 0.5
    signed = minhash_forest._signed(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("text_key", F.lit("")), 5, 128)
    sketch = F.unhex(F.regexp_replace(F.hex("signature"), "(..)..", "$1"))
    classes = signed.select(F.col("doc_id").alias("rep"), "signature", sketch.alias("sketch")).cache()
    groups = minhash_forest._groups(classes, 128, 32, 8, 0.8, 0.99999, 512).groupBy("component").count().collect()
    assert sum(g["count"] * (g["count"] - 1) // 2 for g in groups) < 400 * 399 // 2 // 10
    assert minhash_forest.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).filter("n_links > 0").count() == 0


# -- mixing

def test_mix_on_hard_rows(hard):
    docs = hard.drop("size").withColumn("n", mixing.word_count(F.col("text")))
    rows = mixing.mix_sources(docs, "n").collect()
    assert len(rows) == len(ROWS) and all(0 <= r.taken <= 3 * r.n for r in rows)
    assert mixing.mix_sources(docs.limit(0), "n").collect() == []
    copies = mixing.emitted(mixing.mix_sources(docs, "n"))
    assert copies.count() == sum(r.copies for r in rows)


def test_mix_comes_near_targets(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("abc") if i % 3 else "hot", 100 if i % 2 else rng.randint(0, 3000)) for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, size bigint")
    out = mixing.mix_sources(docs, "size")
    by = {r.source: r for r in out.groupBy("source").agg(
        F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("source_size").alias("size")).collect()}
    total = sum(r[2] for r in rows)
    assert abs(sum(r.target for r in by.values()) - total) < 1
    for r in by.values():
        assert r.target <= 3 * r["size"] and abs(r.taken - r.target) <= 3500
    again = mixing.mix_sources(docs.repartition(7), "size")
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, out.collect()))


# -- packing

TOKENIZER = queries.TOKENIZER


def test_ids_equal_the_tokenizers_library():
    from tokenizers import Tokenizer

    whole, mine = Tokenizer.from_file(TOKENIZER), packing.ByteBpe(TOKENIZER)
    whole.encode_special_tokens = True
    rng = random.Random(2)
    parts = [" ", "\n", "\t", "a", "bc", "Ti", "'s", "12", "é", "ß", "!!", "\xa0", "<|endoftext|>", "\x1c", "²", "한", "\r\n", "  "]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(3000)] + [t for _, t, *_ in ROWS if t and len(t) < 10_000]
    for t, e in zip(texts, whole.encode_batch(texts, add_special_tokens=False), strict=True):
        assert mine.ids(t) == packing.array("I", e.ids).tobytes(), t


def test_pieces_equal_the_librarys_defaults(spark):
    import zlib

    from tokenizers import Tokenizer

    whole, mine = Tokenizer.from_file(TOKENIZER), packing.ByteBpe(TOKENIZER)
    rng = random.Random(12)
    parts = [" ", "\n", "a", "bc", "'s", "12", "é", "!!", "<|endoftext|>", "<|endoftext", "|>", "<|", "  ", "\r\n", "한"]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "<|ENDOFTEXT|>", "", "a <|endoftext|>  b"]
    texts += ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(2000)]
    want = [packing.array("I", e.ids).tobytes() for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert [mine.library_ids(t) for t in texts] == want
    assert want[0] == packing.array("I", [64, 220, 50256, 275]).tobytes()
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string")
    end = packing.array("I", [packing.END_ID]).tobytes()
    got = {r.doc_id: (r.length, r.ids_crc32) for r in packing.token_pieces(docs, TOKENIZER).collect()}
    assert got == {i: (len(w) // 4 + 1, zlib.crc32(w + end)) for i, w in enumerate(want)}


def check_sequences(rows, most=packing.MAX_TOKENS):
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= most
    return len(seqs)


def test_packing_on_hard_rows(hard):
    pieces = packing.token_pieces(hard, TOKENIZER)
    rows = packing.pack(pieces).collect()
    n = check_sequences(rows)
    assert n - 1 <= sum(r.length for r in rows) / packing.MAX_TOKENS <= n
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == Counter(map(tuple, pieces.collect()))
    long = sorted((r.piece, r.start, r.length) for r in rows if r.doc_id == 9)
    assert all(x[2] == 2048 for x in long[1:]) and all(a[1] + a[2] == b[1] for a, b in zip(long, long[1:], strict=False))
    assert [(r.length, r.piece) for r in rows if r.doc_id == 2] == [(1, 0)]
    assert packing.pack_documents(hard.limit(0), TOKENIZER).collect() == []
    clash = pieces.select("*", *[F.lit(1).alias(c) for c in ("sequence_id", "offset", "l", "row", "rank", "h")])
    assert packing.pack(clash).count() == len(rows)


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_fit_respects_every_capacity(score):
    rng = random.Random(4)
    for _ in range(60):
        cap, docs = rng.choice([(64, 3), (64, 64), (2048, 5)])
        counts = Counter(rng.randint(1, cap) for _ in range(rng.randint(1, 300)))
        cost = cap * cap // 2 if docs == 5 else cap * cap
        counts = Counter({k: v for k, v in counts.items() if k * k <= cost}) or Counter([1])
        slots, n = packing.fit(dict(counts), cap, max_docs=docs, max_cost=cost, score=score)
        seqs, ranks = defaultdict(list), defaultdict(list)
        for length, first, number, base, offset in slots:
            ranks[length] += range(first, first + number)
            for i in range(number):
                seqs[base + i].append((offset, length))
        assert len(seqs) == n and all(sorted(ranks[k]) == list(range(v)) for k, v in counts.items())
        for s in seqs.values():
            assert len(s) <= docs and sum(x * x for _, x in s) <= cost
            assert [o for o, _ in sorted(s)] == [sum(x for _, x in sorted(s)[:i]) for i in range(len(s))]


def test_fit_is_near_the_lower_bound():
    rng = random.Random(6)
    counts = Counter(min(2048, max(1, int(rng.lognormvariate(6.5, 1.1)))) for _ in range(20_000))
    _, n = packing.fit(dict(counts))
    assert n <= 1.01 * sum(k * v for k, v in counts.items()) / 2048 + 1


# -- the pipeline

def test_pipeline_against_brute_force(spark, middle, labels):
    import corpus_pipeline as pipeline

    docs = middle
    truth = {r.doc_id: (r.quality, r.toxic) for r in labels.collect()}
    for name, stage in pipeline.STAGES[:-1]:
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        docs = stage(spark, docs, MIDDLE).cache()
        assert docs.columns == middle.columns
        after = Counter(r.doc_id for r in docs.select("doc_id").collect())
        clean = [i for i, _ in before if truth.get(i) == (1, 0)]
        if name in ("toxicity", "quality classifier"):
            assert set(after) <= {i for i, _ in before} and sum(i in after for i in clean) >= 0.99 * len(clean)
        elif name == "n-gram Jaccard join":
            classes = brute_links(before)
            assert set(after) == {i for i, low, _ in classes if i == low} and set(after.values()) == {1}
        else:
            assert max(after.values()) <= mixing.CAP
    rows = pipeline.pack(spark, docs, MIDDLE).collect()
    n = check_sequences(rows)
    assert Counter(r.doc_id for r in rows if r.piece == 0) == Counter(r.doc_id for r in docs.collect())
    assert n <= 1.02 * sum(r.length for r in rows) / packing.MAX_TOKENS + 1


def test_stages_keep_columns_of_any_name(spark, labels, tmp_path):
    import corpus_pipeline as pipeline

    names = ["doc_id", "text", "lang", "source", *CLASH, "copy", "copies", "source_size", "_words", "class_id", "n_links", "piece", pipeline.ROW]
    taken = [n for n in dict.fromkeys(names) if n not in ("doc_id", "text", "lang", "source")]
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, source string").repartition(3)
    docs = docs.select("*", *[F.concat(F.lit(f"{n} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n) for n in taken])
    at = str(tmp_path)
    labels.write.parquet(f"{at}/labels.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, at)
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert all(r[n] == f"{n} of {'none' if r.doc_id is None else r.doc_id}" for n in taken), name
        assert stage(spark, docs.limit(0), at).collect() == [], name
    assert pipeline.pack(spark, docs, at).count() >= len(ROWS)
    assert pipeline.pack(spark, docs.limit(0), at).collect() == []
    near = Counter(r.doc_id for r in pipeline.drop_near_copies(spark, docs, at).collect())
    assert near[2] == near[3] == near[4] == 1 and near[5] == 1 and near[6] == 0  # texts without words stay, copies go
    mixed = Counter(r.doc_id for r in pipeline.mix(spark, docs, at).collect())
    assert mixed and max(mixed.values()) <= mixing.CAP * 3  # three rows have the id 1
