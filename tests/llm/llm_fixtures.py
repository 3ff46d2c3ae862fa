import os
from pathlib import Path

import pytest

SF_DIR = "/root/testdata/sf0.001"
DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf_dir():
    if not Path(SF_DIR).exists():
        pytest.skip("no test tables")
    return os.fspath(SF_DIR)


@pytest.fixture(scope="session")
def texts():
    """Texts with the awkward cases: null, empty, blank, copies, long, no letters, odd bytes."""
    words = [f"w{i}" for i in range(400)]
    body = " ".join(words)
    line = " ".join(words[:60])
    return [
        None,
        "",
        "   \n\t ",
        body,
        body,
        body.replace("w7 ", "x "),
        body.replace("w200 ", "<|endoftext|> "),
        f"{line}\nshort\nother line here\n{line}\nshort\ntail",
        f"{line}\nshort\nfresh words only",
        "1234 !!! ???",
        "héllo ñandú Straße 日本語 🎉\x1c end",
        "tie tie tie tie tie tie tie",
        "one two",
        "One TWO",
        "ab" * 900,
    ]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts as documents, with a null id, a repeated row, a repeated id, null
    sources, and extra columns whose names an operator might use itself."""
    rows = [
        (i * 3, t, [None, "xx", "yy"][i % 3], [None, "src1", "src0"][i % 3], len(t or "")) for i, t in enumerate(texts)
    ]
    rows += [rows[3], (6, "another text under id six", "xx", "src1", 25), (None, texts[3], "yy", None, 5)]
    extra = [(*r, "k", 1, 2, "r", 3, 4) for r in rows]
    return spark.createDataFrame(
        extra, DOCUMENT + ", key string, a long, n long, `row` string, size long, token long"
    ).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCUMENT)
