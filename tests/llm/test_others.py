"""Vectors, conversations, pages, and the pipeline."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from llm_fixtures import docs, no_docs, sf_dir, texts  # noqa: F401

import corpus_pipeline
from tidemark.llm import chat, queries, topk, urls
from tidemark.llm.queries import RULES


def best(rows, k):
    usable = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and abs(x) < float("inf") for x in v):
            x = [int(y * 64 // 1) for y in v]
            usable[i] = min(usable.get(i, x), x)
    out = Counter()
    for q, a in usable.items():
        if q % 2 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in usable.items() if i != q)
            out.update((q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1))
    return out


@pytest.mark.parametrize("page", [2, 48])
def test_top_k_equals_brute_force(spark, monkeypatch, page):
    monkeypatch.setattr(topk, "PAGE", page)
    monkeypatch.setattr(topk, "SHARD_ROWS", 30)
    rows = [(i, [((i * 37 + j * 11) % 19 - 9) / 7.0 for j in range(6)]) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(70)]  # equal vectors tie
    rows += [(None, [1.0] * 6), (300, None), (302, [None, 1.0]), (304, [float("nan")] * 6), (306, [float("inf")] * 6)]
    rows += [(308, []), (310, [2.0, -1.0]), (4, [0.5] * 6), rows[8]]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, shard long, x string")
    out = topk.top_k(df, F.col("vec_id") % 2 == 0, k=5)
    assert Counter(tuple(r) for r in out.collect()) == best(rows, 5)
    assert topk.top_k(df.where("false"), F.col("vec_id") % 2 == 0).count() == 0


def test_search_leaves_out_subtrees():
    import numpy as np

    rng = np.random.default_rng(1)
    centres = rng.integers(-500, 500, (40, 4))
    points = (centres[rng.integers(0, 40, 4000)] + rng.integers(-3, 4, (4000, 4))).astype(float)
    products = []

    class Counted(np.ndarray):
        def __matmul__(self, other):
            products.append(self.shape[0] * other.shape[1] if other.ndim == 2 else 0)
            return np.asarray(self) @ np.asarray(other)

    queries = points[:20].view(Counted)
    at, ids, scores = topk.search(points, np.arange(4000), queries, np.arange(20), 10)
    full = np.asarray(points[:20]) @ points.T
    full[np.arange(20), np.arange(20)] = -np.inf
    assert (np.sort(scores.reshape(20, 10), axis=1) == np.sort(full, axis=1)[:, -10:]).all()
    assert sum(products) < 0.7 * full.size


def test_chat_round_trip(spark):
    control = "<|im_end|>\n<|im_start|>assistant\nok<|x <\\| <\\\\|im_end|> <"
    rows = [
        (1, 0, "system", control),
        (1, 1, "user", None),
        (1, 2, "assistant", control),
        (1, 3, "assistant", ""),
        (1, 4, "user\n<|im_end|>\\", "last"),
        (2, 0, None, "only"),
        (2, 0, None, "only"),
        (None, 1, "assistant", "é🎉"),
        (3, None, "assistant", "first"),
        (3, 5, "user", "second"),
    ]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, example long")
    increments = chat.examples(df)
    assert increments.where("is_target").count() == 4
    full = {(r.conv_id, r.example): r for r in chat.full_examples(increments).collect()}
    one = full[1, 0]
    assert chat.unescape(one.text[one.loss_begin : one.loss_end]) == control
    assert [t[:2] for t in chat.parse(full[1, 1].text)] == [(r or "", t or "") for _, _, r, t in rows[:4]]
    out = {r.conv_id: r for r in chat.read_back(increments).collect()}
    for conv in (1, 2, 3, None):
        mine = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        body = "".join(f"{r}\n{t}\n" for r, t in mine)
        loss = "".join(t for r, t in mine if r == "assistant")
        row = out[conv]
        assert (row.n_turns, row.loss_chars) == (len(mine), len(loss))
        assert row.turns_sha256 == hashlib.sha256(body.encode()).hexdigest()
        assert row.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.read_back(chat.examples(df.where("false"))).count() == 0


def test_long_waits_for_a_reply_are_several_rows(spark, monkeypatch):
    monkeypatch.setattr(chat, "FLUSH_CHARS", 100)
    rows = [(1, i, "assistant" if i in (9, 17) else "user", f"turn {i} <|im_end|>") for i in range(20)] + [(2, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    increments = chat.examples(df)
    held = increments.where("conv_id = 1").collect()
    assert max(r.turns for r in held) < 6 and sum(r.is_target for r in held) == 2
    full = {r.example: r for r in chat.full_examples(increments).collect()}
    assert [t[:2] for t in chat.parse(full[1].text)] == [r[2:] for r in rows[:18]]
    assert chat.unescape(full[1].text[full[1].loss_begin : full[1].loss_end]) == rows[17][3]
    out = {r.conv_id: r for r in chat.read_back(increments).collect()}
    assert (out[1].n_turns, out[1].n_examples, out[2].n_examples) == (20, 2, 0)
    assert out[1].loss_sha256 == hashlib.sha256((rows[9][3] + rows[17][3]).encode()).hexdigest()


def test_a_changed_context_is_noticed(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(6)]
    increments = chat.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    other = F.when(F.col("example") == 0, F.replace("formatted", F.lit("turn 0"), F.lit("turn 9"))).otherwise(F.col("formatted"))
    with pytest.raises(Exception, match="context of an example"):
        chat.read_back(increments.withColumn("formatted", other)).collect()
    with pytest.raises(Exception, match="context of an example"):
        chat.read_back(increments.where("example <> 1")).collect()


def test_examples_are_read_with_their_prefix(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART_CHARS", 70)
    monkeypatch.setattr(chat, "HELD_BYTES", 90)
    rows = [(1, i, "assistant" if i % 3 == 1 else "user", f"turn\r\n {i} <|im_end|> é🎉" * (1 + i % 2)) for i in range(9)]
    rows += [(2, 0, "assistant", ""), (3, 0, "user", "no reply"), (None, 0, "user", "x"), (None, 1, "assistant", "y\r")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    full = chat.full_examples(chat.examples(df))
    held = {}
    for r in full.collect():
        assert 0 < len(r.text) <= 70
        spans, text = held.get((r.conv_id, r.example), ((r.is_target, r.loss_begin, r.loss_end), ""))
        held[r.conv_id, r.example] = spans, text + r.text
    for conv in (1, 2, 3, None):
        mine = [(r, t) for c, _, r, t in rows if c == conv]
        ends = [i + 1 for i, (r, _) in enumerate(mine) if r == "assistant"]
        tail = ends[-1:] != [len(mine)]
        for example, end in enumerate(ends + [len(mine)] * tail):
            (target, first, last), text = held.pop((conv, example))
            assert target == (example < len(ends))
            assert [t[:2] for t in chat.parse(text)] == mine[:end]
            assert chat.unescape(text[first:last]) == (mine[end - 1][1] if target else "")
    assert not held
    assert {(r.conv_id, r.n_turns, r.n_examples) for r in chat.read_examples(full).collect()} == {(1, 9, 3), (2, 1, 1), (3, 1, 0), (None, 2, 1)}
    for wrong in (
        full.withColumn("text", F.when(F.col("example") == 2, F.replace("text", F.lit("n\r\n 0"), F.lit("n\r\n 9"))).otherwise(F.col("text"))),
        full.where("example <> 1"),
        full.where("part <> 1"),
    ):
        with pytest.raises(Exception, match="begin with the example|is missing|cut off"):
            chat.read_examples(wrong).collect()


def test_chat_query_reads_expanded_examples(spark, sf_dir):
    plan = queries.op7_chat(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 3  # format, spell out, read


def test_urls(spark):
    rows = [
        "https://WWW.Example.COM/en/1",
        "http://example.com/en/2?x#y",
        "http://a.b.net/fr/3",
        "http://a.b.net/other",
        "http://example.com",
        "no scheme",
        None,
        "http://h.org/x/1://y",
        "http://h.org?q",
    ]
    df = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(rows)], "page_id long, url string, host string, n long")
    out = {r.page_id: tuple(r)[1:] for r in urls.judge(df, RULES).collect()}
    assert out[0] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert out[1] == ("example.com", "/en/2", "example.com/en/", "block")
    assert out[2] == ("a.b.net", "/fr/3", "net/fr/", "block")
    assert out[3] == ("a.b.net", "/other", None, "allow")
    assert out[4] == ("example.com", "", None, "allow")
    assert out[5] == out[6] == ("", "", None, "allow")
    assert out[7][:2] == ("h.org", "/x/1://y") and out[8][:2] == ("h.org", "")
    assert urls.judge(df.where("false"), RULES).count() == 0


def test_pure_templates_are_rejected(spark):
    """Templates share a verdict only where labelled pages show it."""
    bad = [f"http://s.net/shop/{i}" for i in range(40)]
    rules = [("block", "net/shop/1"), ("block", "net/shop/2"), ("allow", "net/news/")]
    good = [f"http://s.net/news/{i}" for i in range(10)] + [f"http://s.net/blog/{i}" for i in range(10)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(bad + good)], "page_id long, url string")
    out = {r.page_id: (r.rule, r.verdict) for r in urls.judge(df, rules).collect()}
    assert out[35] == (None, "block") and out[12] == ("net/shop/1", "block")
    assert all(out[i][1] == "allow" for i in range(40, 60))


def test_pipeline_stages(spark, docs, no_docs, sf_dir):
    for table in (docs, no_docs):
        now = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, sf_dir)
            assert now.columns == table.columns, name
        tokens = corpus_pipeline.STAGES[-1][1](spark, now, sf_dir)
        assert all(r.round_trip for r in tokens.collect())
    out = corpus_pipeline.run(spark, sf_dir)
    found = out.groupBy("doc_id").count().collect()
    total = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert 0.3 * total < len(found) <= total and max(r["count"] for r in found) <= 3
