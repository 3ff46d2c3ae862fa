"""Operators on documents against brute force, and their awkward cases."""

import gc
import hashlib
import random
import re
import sys
import time
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from llm_fixtures import docs, no_docs, sf_dir, texts  # noqa: F401
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType
from tokenizers import Tokenizer

from tidemark import staging
from tidemark.llm import bpe, common, fingerprints, jaccard, language, lines, mixing, repeats
from tidemark.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def pairs_of(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


# --- repeated byte strings ----------------------------------------------------------


def removed(rows, window):
    bodies = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i : i + window] for b in bodies for i in range(len(b) - window + 1))
    out = Counter()
    for (doc_id, _), b in zip(rows, bodies, strict=True):
        gone = [False] * len(b)
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[doc_id, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize(("window", "gram", "group"), [(200, 80, 4096), (40, 12, 4096), (40, 12, 2), (7, 3, 3)])
def test_repeats_equal_brute_force(docs, monkeypatch, window, gram, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    out = repeats.without_repeats(docs, window, gram)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert pairs_of(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == removed(rows, window)


def test_repeats_of_a_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = repeats.without_repeats(docs, keep_text=False)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert pairs_of(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == removed(rows, 200)


# --- near copies --------------------------------------------------------------------


def linked(rows, words, share):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(low))
        sets.append(frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows[:i]):
            common = len(sets[i] & sets[j])
            near = common and share[1] * common >= share[0] * len(sets[i] | sets[j])
            if a is not None and b is not None and sets[i] and sets[j] and (near or a == b):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (a, _) in enumerate(rows):
        least[find(i)].append(a)
    return Counter((a, len(sets[i]), None if a is None else min(least[find(i)])) for i, (a, _) in enumerate(rows))


@pytest.mark.parametrize(("words", "share", "long_list"), [(4, (85, 100), 2048), (5, (80, 100), 2048), (2, (60, 100), 2)])
def test_near_components_equal_brute_force(docs, monkeypatch, words, share, long_list):
    monkeypatch.setattr(jaccard, "LONG_LIST", long_list)
    out = jaccard.near_components(docs, words, share)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert pairs_of(out, "doc_id", "n_shingles", "component_id") == linked(rows, words, share)


def test_near_components_of_a_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    out = jaccard.near_components(docs)
    assert pairs_of(out, "doc_id", "n_shingles", "component_id") == linked(rows, 4, (85, 100))


def test_one_of_each_keeps_one(docs):
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    found = {r[0] for r in kept.select("doc_id").collect()}
    assert {9, 15, 18} & found == {9} and {None, 0, 3, 6} <= found


def test_one_row_of_each_id_stays(spark):
    body = " ".join(f"w{i}" for i in range(50))
    rows = [(1, body, "b"), (1, body, "a"), (1, body, "a"), (2, body + " x", "c"), (3, None, "d"), (3, " ", "e"), (3, "own words", "f")]
    rows += [(None, body, "g"), (None, body, "g"), (4, "z" * 3, "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rank string")
    kept = Counter(tuple(r) for r in jaccard.one_of_each(df).collect())
    assert kept == Counter([(1, body, "a"), *rows[4:]])


@pytest.fixture
def no_broadcast(spark):
    """Plans as for large tables, whose exchanges can be read."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    before = {name: spark.conf.get(name) for name in names}
    spark.conf.set(names[0], "-1")
    spark.conf.set(names[1], "false")
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def rows_shuffled(df):
    """The rows that ``df`` shuffles, and its result."""
    rows = df.collect()

    def walk(node):
        children = node.children()
        own = node.metrics().apply("shuffleRecordsWritten").value() if node.nodeName() == "Exchange" else 0
        return own + sum(walk(children.apply(i)) for i in range(children.size()))

    return walk(df._jdf.queryExecution().executedPlan()), rows


def test_only_texts_that_may_go_are_shuffled(spark, no_broadcast):
    """One of two near copies goes; the other 300 documents stay where they are."""
    body = " ".join(f"w{i}" for i in range(50))
    rows = [(i, " ".join(f"v{i}_{j}" for j in range(20))) for i in range(300)] + [(400, body), (401, body + " x"), (None, body)]
    moved, kept = rows_shuffled(jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")))
    assert Counter(tuple(r) for r in kept) == Counter([*rows[:301], rows[302]])
    assert moved < 10


def test_rows_without_ids_that_go(spark, no_broadcast):
    rows = [(str(i), i) for i in range(2000)] * 2 + [(None, -1)] * 2
    df = spark.createDataFrame(rows, "`doc id` string, n long")
    gone = spark.createDataFrame([(i,) for i in range(0, 2000, 7)] + [(5000,)], "gone long")
    moved, kept = rows_shuffled(jaccard._without(df, "doc id", gone))
    assert Counter(tuple(r) for r in kept) == Counter(r for r in rows if r[1] % 7 or r[1] < 0)
    assert moved < 1200
    _, kept = rows_shuffled(jaccard._without(df, "doc id", gone.where("gone < 0")))
    assert Counter(tuple(r) for r in kept) == Counter(rows)


def test_near_components_keeps_no_table_it_is_done_with(spark, docs):
    before = set(staging.held(spark))
    out = jaccard.near_components(docs)
    left = {path.rpartition("/")[2].partition("-")[0] for path in staging.held(spark) if path not in before}
    assert not left & {"described", "prefixes", "lists", "across"} and out.count() == docs.count()


def test_written_lets_go_of_shuffles_that_nothing_reads(spark):
    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    gc.collect()
    gc.disable()  # Python's collector runs by itself when it happens to
    try:
        before = shuffles()
        spark.range(1000).repartition(7).select("id").collect()
        made = shuffles() - before
        for _ in range(10):  # Spark deletes them soon after
            common.written(spark.range(1), "one")
            time.sleep(0.2)
        assert made and not made & shuffles()
    finally:
        gc.enable()


def test_many_equal_rows_of_lines(spark):
    """Equal rows are one document to line dedup, at no quadratic cost."""
    text = "first line here\nsecond line here\nthird"
    rows = [(1, text)] * 600 + [(2, text)] * 600
    out = lines.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter((r.doc_id, r.text, r.n_deleted) for r in out.collect()) == Counter({(1, text, 0): 600, (2, "", 3): 600})


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(60, 50), (50, 50), (60, 50)], "u long, v long")
    expected = Counter({(i, 0): 1 for i in range(1, 41)} | {(60, 50): 1})
    assert pairs_of(components(edges), "node", "component") == expected


# --- tokens ----------------------------------------------------------------------------


def test_tokens_equal_the_library(docs):
    library = Tokenizer.from_file(VOCABULARY)
    expected = Counter()
    for doc_id, text in docs.select("doc_id", "text").collect():
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        expected[doc_id, tuple(ids), decoded] += 1
    out = bpe.encode(docs, VOCABULARY)
    assert out.columns == [c for c in docs.columns if c != "token"] + ["token"]
    assert Counter((r[0], tuple(r[1]), r[2]) for r in out.select("doc_id", "token.ids", "token.decoded").collect()) == expected


def test_word_merging_agrees_with_its_long_form():
    vocabulary = bpe.Vocabulary(bpe.vocabulary_text(VOCABULARY))
    for word in (b"ab" * 40, b"abcabcabd" * 9, "ñandú日本".encode() * 5, b" " * 70, b"a"):
        assert vocabulary.exact(word) == vocabulary.exact_long(word)


def test_words_merged_together_agree_with_single_ones():
    vocabulary = bpe.Vocabulary(bpe.vocabulary_text(VOCABULARY))
    rng = random.Random(5)
    words = ["".join(rng.choices("aeinrst hotEé日\n0", k=rng.choice([1, 2, 3, 5, 9, 16, 40, 70]))).encode() for _ in range(3000)]
    assert [m.tolist() for m in vocabulary.exact_all(words)] == [vocabulary.exact(w) for w in words]

    def greedy(word):
        out = []
        while word:
            size = next(n for n in range(len(word), 0, -1) if word[:n] in vocabulary.proposed)
            out.append(vocabulary.proposed[word[:size]])
            word = word[size:]
        return out

    flat, lengths = vocabulary.propose([b"", *words, b""])
    assert [p.tolist() for p in np.split(flat, np.cumsum(lengths)[:-1])] == [[], *map(greedy, words), []]
    assert vocabulary.exact_all([]) == []


def test_words_met_in_any_order_give_the_tokens_of_the_library(monkeypatch):
    library = Tokenizer.from_file(VOCABULARY)
    vocabulary = bpe.Vocabulary(bpe.vocabulary_text(VOCABULARY))
    special = next(iter(vocabulary.special), "")
    rng = random.Random(6)
    parts = [" ", "  ", "\n", "\r\n ", "\u00a0", "\u3000", "\u0085", "don't", "ñandú", "日本語", "the", "anthaion", "12", "?!", "🎉", special, "x" * 300, "thst" * 30]
    texts = ["".join(rng.choices(parts, weights=[20, *[1] * (len(parts) - 1)], k=rng.randrange(40))) for _ in range(600)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    for remembered in (bpe.REMEMBERED, 1):  # with all words kept, and with none
        monkeypatch.setattr(bpe, "REMEMBERED", remembered)
        for size in (600, 7):
            got = [ids for i in range(0, 600, size) for ids in vocabulary.encode(texts[i : i + size])]
            assert got == want
    ids, ends = vocabulary.encode_flat(texts)
    assert vocabulary.decode_flat(ids, ends) == texts
    assert vocabulary.decode([vocabulary.single[0xE6], vocabulary.single[0x41]]) == "\ufffdA"


def test_a_worker_remembers_words_in_few_bytes():
    vocabulary = bpe.Vocabulary(bpe.vocabulary_text(VOCABULARY))
    rng, most = random.Random(7), 0
    for _ in range(12):
        vocabulary.encode_flat([" ".join("".join(rng.choices("aeinrsth", k=8)) for _ in range(1000)) for _ in range(20)])
        met = [vocabulary.words, vocabulary.pieces]
        size = sum(map(sys.getsizeof, met)) + sum(sys.getsizeof(k) + 32 for d in met for k in d)
        most = max(most, size + vocabulary.flat.nbytes + vocabulary.begin.nbytes + vocabulary.size.nbytes)
    assert most < 40 << 20


def test_tokens_take_arrow_texts_not_pandas(docs):
    plan = bpe.encode(docs, VOCABULARY)._jdf.queryExecution().optimizedPlan()
    arrow_iterator = PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF
    assert f"], {arrow_iterator}" in plan.toString()


# --- language, lines, mix, fingerprints ------------------------------------------------


def test_language_of_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = language.identify(docs).where("held_out").select("lang", "lang_pred", "score").collect()
    right = sum(r.lang == r.lang_pred for r in out)
    assert len(out) > 20 and right >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 for r in out)


def test_language_of_awkward_rows(docs, no_docs):
    out = language.identify(docs)
    assert out.columns == [*docs.columns, "held_out", "lang_pred", "score"]
    for row in out.collect():
        letters = any(map(str.isalpha, row.text or ""))
        assert (row.lang_pred == "und") == (not letters) and 0 <= row.score <= 1
    assert language.identify(no_docs).count() == 0
    unlabelled = language.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r[0] for r in unlabelled.select("lang_pred").collect()} == {"und"}
    assert language.drop_unidentified(docs).columns == docs.columns


def test_lines_of_awkward_rows(docs):
    out = lines.drop_repeated_lines(docs)
    assert out.columns == [c for c in docs.columns] + ["n_lines", "n_deleted"]
    found = {(r.doc_id, r.n_lines, r.n_deleted, r.text) for r in out.collect()}
    long = " ".join(f"w{i}" for i in range(60))
    assert (0, 0, 0, None) in found and (3, 1, 0, "") in found
    # the second copy in the document and the run in the next document go
    assert (21, 6, 2, f"{long}\nshort\nother line here\ntail") in found
    assert (24, 3, 2, "fresh words only") in found
    # a long single line that is a copy goes; the first, of the null id, stays
    assert any(r[:3] == (None, 1, 0) for r in found)
    assert {(9, 1, 1, ""), (12, 1, 1, "")} <= found


def test_longer_line_runs(spark):
    rows = [(1, "a\nb\nc\nd\ne"), (2, "x\na\nb\nc\nd\ny"), (3, "a\nb\nq"), (4, "b\nc\nd")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = lambda n: dict(lines.drop_repeated_lines(docs, min_lines=n).select("doc_id", "text").collect())
    assert kept(3) == {1: "a\nb\nc\nd\ne", 2: "x\ny", 3: "a\nb\nq", 4: ""}
    assert kept(2) == {1: "a\nb\nc\nd\ne", 2: "x\ny", 3: "q", 4: ""}
    assert kept(1) == {1: "a\nb\nc\nd\ne", 2: "x\ny", 3: "q", 4: ""}
    assert kept(5)[2] == "x\na\nb\nc\nd\ny"


def test_mix_meets_targets(docs, no_docs, sf_dir, spark):
    for table in (docs, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        out = [r for r in mixing.mix(table, block=16).collect()]
        assert len(out) == table.count()
        assert all(0 <= r.taken <= 3 * r.size for r in out)
        sources = dict(table.select("doc_id", "source").distinct().collect())
        taken, target = defaultdict(int), {}
        for r in out:
            taken[sources[r.doc_id]] += r.taken
            target[sources[r.doc_id]] = r.target
        if table is not docs:  # there ids are unique
            assert all(abs(taken[s] - target[s]) <= 1 for s in target)
        assert sum({s: t for s, t in target.items()}.values()) == pytest.approx(sum(r.size for r in out))
        again = [r for r in mixing.mix(table, block=16).collect()]
        assert Counter(map(tuple, out)) == Counter(map(tuple, again))
    assert mixing.mix(no_docs).count() == 0
    assert mixing.mix_documents(docs).columns == docs.columns


def test_schedule_spreads_sources(spark):
    targets = spark.createDataFrame([("a", 3000, 2000.0), ("b", 3000, 4000.0)], "source string, source_size long, target double")
    slots = mixing.schedule(targets, 10).orderBy("slot").collect()
    assert sum(s.words for s in slots if s.source == "a") == 2000
    assert sum(s.words for s in slots if s.source == "b") == 4000
    firsts = [s.source for s in slots[:300]]
    assert 95 <= firsts.count("a") <= 105
    assert [s.rank for s in slots if s.source == "b"] == list(range(400))


def test_edited_texts(docs, no_docs, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 4)
    out = fingerprints.edited_likeness(docs).collect()
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is None, [-b for b in (r[1] or "").encode()] + [1]))
    expected = Counter()
    for i, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(i + 1) % len(order)][1] or ""
        edited = text[: len(text) - len(text) // 2] + following[: len(text) // 2]
        expected[doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in out) == expected
    prints = {(r.doc_id, r.fingerprint) for r in out}
    assert dict(prints)[9] == dict(prints)[12] != dict(prints)[30]
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    assert fingerprints.edited_likeness(no_docs).count() == 0


def test_block_tables_find_all_within_radius(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    prints = fingerprints.fingerprint(docs).select("doc_id", "fingerprint")
    found = pairs_of(fingerprints.within_radius(prints, 40), "left_id", "right_id", "distance")
    least = {}
    for doc_id, code in prints.collect():
        least[code] = min(doc_id, least.get(code, doc_id))
    codes = [(i, int(c, 16)) for c, i in least.items()]
    near = Counter(
        (a, b, (x ^ y).bit_count()) for a, x in codes for b, y in codes if a < b and (x ^ y).bit_count() <= 40
    )
    assert found == near and len(near) > 0


@pytest.mark.parametrize(
    "operator",
    [repeats.without_repeats, jaccard.near_components, lines.drop_repeated_lines, lambda d: bpe.encode(d, VOCABULARY)],
)
def test_empty_tables(no_docs, operator):
    assert operator(no_docs).count() == 0


