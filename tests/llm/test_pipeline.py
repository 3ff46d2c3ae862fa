"""Rows of every pipeline stage against a version of its own: SQL, brute force or the library."""

import re
from collections import Counter

import duckdb
import public_tokenizers
import pytest
from llm_fixtures import sf_dir  # noqa: F401
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark import staging
from tidemark.llm import language, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Input and result of every stage, each written and read again, as pandas frames."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(folder / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        result = spark.read.parquet(path)
        out[name] = docs, result
        docs = result
    return out


def rows(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def sql_over(docs, sql):
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    return con.execute(sql).fetchall(), [c[0] for c in con.description]


def test_names_and_order():
    assert list(STAGES) == ["language", "lines", "near_copies", "mix", "tokens"]


def test_language_stage(stages):
    docs, kept = stages["language"]
    found = language.identify(docs).where("score >= 0.5")
    assert kept.columns == docs.columns and rows(kept, *docs.columns) == rows(found, *docs.columns)
    clean = [r for r in docs.collect() if r.lang and len(WORD.findall(r.text or "")) > 50]
    ids = {r.doc_id for r in kept.collect()}
    assert sum(r.doc_id in ids for r in clean) > 0.97 * len(clean)


def test_lines_stage(stages):
    docs, kept = stages["lines"]
    found, names = sql_over(docs, queries.LINES_SQL)
    at = {n: i for i, n in enumerate(names)}
    want = Counter(
        (r[at["doc_id"]], r[at["text"]])
        for r in found
        if not (r[at["n_deleted"]] and not WORD.search(r[at["text"]] or ""))
    )
    assert kept.columns == docs.columns and rows(kept, "doc_id", "text") == want
    assert kept.where("n_chars <> length(text)").count() == 0


def test_near_copies_stage(stages):
    docs, kept = stages["near_copies"]
    sets = {}
    for r in docs.collect():
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)] or ([tuple(words)] if words else [])
        sets[r.doc_id] = frozenset(runs)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    want = {i for i in ids if root(i) == i}
    assert {r.doc_id for r in kept.collect()} == want and kept.count() == len(want)
    assert kept.columns == docs.columns


def test_mix_stage(stages):
    docs, mixed = stages["mix"]
    found, names = sql_over(docs, queries.MIX_SQL)
    at = {n: i for i, n in enumerate(names)}
    want = Counter()
    for r in found:
        if r[at["taken"]]:
            want[r[at["doc_id"]]] = min(3, -(-r[at["taken"]] // r[at["size"]]))
    assert Counter(r.doc_id for r in mixed.collect()) == want
    assert set(rows(mixed, "doc_id", "text")) <= set(rows(docs, "doc_id", "text"))


def test_tokens_stage(stages):
    docs, coded = stages["tokens"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((r.doc_id, tuple(library.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    got = coded.collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got)


def test_run_is_the_stages_in_order(spark, sf_dir, stages):
    out = corpus_pipeline.run(spark, sf_dir)
    assert rows(out, "doc_id", "n_tokens", "round_trip") == rows(stages["tokens"][1], "doc_id", "n_tokens", "round_trip")


def test_a_stage_releases_what_earlier_stages_wrote(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    STAGES["lines"](spark, docs, sf_dir).write.parquet(str(tmp_path / "lines"))
    made = corpus_pipeline._made[spark.sparkContext.applicationId][:]
    assert made and set(made) <= set(staging.held(spark))
    lazy = STAGES["lines"](spark, docs, sf_dir)  # not written: the next stage must keep its tables
    assert not set(made) & set(staging.held(spark))
    mixed = STAGES["mix"](spark, lazy, sf_dir)
    assert mixed.count() > 0
    STAGES["language"](spark, spark.read.parquet(str(tmp_path / "lines")), sf_dir)
    assert corpus_pipeline._made[spark.sparkContext.applicationId] == []
