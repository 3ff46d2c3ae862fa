"""Large documents read by byte ranges, against Spark's own reader."""

import json
import random
from collections import Counter

import pytest
from conftest import tuples

import tidemark as tm
from tidemark.sources.large_json import State, chained, read_large_documents, structure, write_large_documents

TRICKY = ['plain', 'quote " in', "back\\slash", "end\\", '\\"', "{[", "]}", '"tags": [', "é日本🎉", "", "\\\\\\", "a\nb", "null,"]


def document(seed, n, nulls=False, **around):
    rnd = random.Random(seed)
    tags = []
    for i in range(n):
        if nulls and rnd.random() < 0.1:
            tags.append(None)
            continue
        tag = {"slug": rnd.choice(TRICKY) + str(i), "created_at": "2023-03-08"}
        if rnd.random() < 0.3:
            tag["extra"] = {"tags": [{"slug": "inner"}], "text": rnd.choice(TRICKY), "n": [1, [2, {"x": "}"}]]}
        if rnd.random() < 0.05:
            del tag["created_at"]
        tags.append(tag)
    return {**around.get("before", {}), "tags": tags, **around.get("after", {})}


def expected(doc):
    return Counter((t and t.get("slug"), t and t.get("created_at")) for t in doc["tags"])


@pytest.mark.parametrize("range_bytes", [1, 2, 3, 7, 64, 1000, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_every_cut_gives_the_same_elements(tmp_path, range_bytes, indent):
    """Without Spark: every range on its own, then chained."""
    from tidemark.sources import large_json as lj

    before = {"meta": {"tags": [{"slug": "no"}], "s": "\\"}, "text": '"tags": [{"slug": 1}]', "list": [{"a": 1}]}
    after = {"other": [{"slug": "no"}], "last": "tags"}
    doc = document(range_bytes, 6 if range_bytes < 64 else 60, True, before=before, after=after)
    path = tmp_path / "doc.json"
    path.write_text(json.dumps(doc, indent=indent, ensure_ascii=False), encoding="utf-8")
    size = path.stat().st_size
    with lj.opened_file(path.as_uri()) as file:
        cuts = [(a, min(a + range_bytes, size)) for a in range(0, size, range_bytes)]
        starts = chained([(a, *lj.summary(file, size, a, b, "tags")) for a, b in cuts])
        texts = []
        for (a, b), start in zip(cuts, starts, strict=True):
            if start["opened"] is not None and start["opened"] < b:
                texts += lj.elements(file, size, a, b, start)
    assert [t and json.loads(t) for t in texts] == doc["tags"]


def test_equals_the_reader_of_documents(spark, tmp_path):
    for i in range(3):
        doc = document(i, 3000, before={"head": [{"slug": "no"}]}, after={"tail": {"tags": []}})
        (tmp_path / f"{i}.json").write_text(json.dumps(doc, indent=i or None), encoding="utf-8")
    whole = tm.unnest_documents(tm.read_documents(spark, str(tmp_path)))
    ranges = read_large_documents(spark, str(tmp_path), range_bytes=20_000)
    assert ranges.rdd.getNumPartitions() > 20
    assert Counter(tuples(ranges)) == Counter(tuples(whole))


def test_written_documents_are_read_by_both_readers(spark, tmp_path):
    rows = [(t + str(i), "2023-03-08", [i, None]) for i, t in enumerate(TRICKY * 20)]
    df = spark.createDataFrame(rows, "slug string, created_at string, `more` array<int>").repartition(3)
    path = str(tmp_path / "out")
    write_large_documents(df.union(df.where("false")), path, "items")
    want = Counter((r[0], r[1]) for r in rows)
    assert Counter(tuples(read_large_documents(spark, path, "items", range_bytes=500))) == want
    documents = tm.read_documents(spark, path, "items")
    assert Counter(tuples(tm.unnest_documents(documents, "items"))) == want


def test_large_document_is_many_tasks(spark, tmp_path):
    path = tmp_path / "large.json"
    n = 200_000
    with path.open("w") as out:
        out.write('{"tags": [\n')
        out.write(",\n".join(f'{{"slug": "s{i}", "created_at": "2023-03-{i % 28 + 1:02d}", "pad": "{"x" * 80}"}}' for i in range(n)))
        out.write("\n]}")
    rows = read_large_documents(spark, str(path), range_bytes=1 << 20)
    assert rows.rdd.getNumPartitions() == -(-path.stat().st_size // (1 << 20))
    assert rows.count() == n and rows.distinct().count() == n
    days = tm.daily_counts(tm.parse_days(rows), "created_at")
    assert days.count() == 28


def test_empty_missing_and_malformed(spark, tmp_path):
    cases = {"empty": '{"tags": []}', "missing": '{"other": [{"slug": "a"}]}', "none": '{"tags": null}'}
    for name, text in cases.items():
        (tmp_path / name).write_text(text)
        assert read_large_documents(spark, str(tmp_path / name), range_bytes=4).collect() == []
    (tmp_path / "cut").write_text('{"tags": [{"slug": "a"}')
    with pytest.raises(ValueError, match="does not end"):
        read_large_documents(spark, str(tmp_path / "cut"), range_bytes=4)
    (tmp_path / "numbers").write_text('{"tags": [1, 2]}')
    with pytest.raises(Exception, match="not an object"):
        read_large_documents(spark, str(tmp_path / "numbers")).collect()


@pytest.mark.parametrize("range_bytes", [8, 30, 45, 60])
def test_an_array_that_ends_early_is_not_confused_with_later_ones(spark, tmp_path, range_bytes):
    path = tmp_path / "short.json"
    path.write_text('{"tags": [{"slug": "a"}, null], "other": [{"slug": "no"}, {"slug": "never"}], "z": [{"slug": "x"}]}')
    rows = read_large_documents(spark, str(path), range_bytes=range_bytes).select("slug")
    assert Counter(tuples(rows)) == Counter([("a",), (None,)])


def test_structure_of_escapes():
    import numpy as np

    data = np.frombuffer(rb'{"a\\": "x\"}{", "b": [1]}', np.uint8)
    brackets, change, after, _ = structure(data, State())
    assert change.tolist() == [1, 1, -1, -1] and after == State()
    assert structure(np.frombuffer(rb"\\\ "[:3], np.uint8), State(True, False))[2] == State(True, True)
    assert structure(np.frombuffer(rb'"', np.uint8), State(True, True))[2] == State(True, False)
