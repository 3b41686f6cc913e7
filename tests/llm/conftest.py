import pytest

LONG = " ".join(f"w{i % 700}x{i}" for i in range(20_000))
PASSAGE = " ".join(f"common{i}" for i in range(70))
TEXTS = [
    None, "", " \n\t ", "One", "Two words", "three short words here.", LONG, LONG + " more", PASSAGE,
    f"before it {PASSAGE} behind it\nand a line", f"{PASSAGE} then other words", "a a a a a a a a a a a a",
    "Line one is here.\nLine one is here.\nLine two.", "x\x1cy\xa0z \x85 w", "Éa! #$% <|endoftext|> DON'T 12 中文",
    "same text twice. Same text.", "same text twice. Same text.",
]


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text): nulls, empty and long texts, ties, a repeated row."""
    rows = list(enumerate(TEXTS))
    return [*rows, rows[8], (None, "no id here"), (None, None)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The rows with columns whose names clash with those of results."""
    clash = "fingerprint string, score int, key int, id int, n_words string, component_id long, label int, row int, copy int"
    rows = [(d, t, *("x" if " string" in c else 0 for c in clash.split(", "))) for d, t in odd_rows]
    return spark.createDataFrame(rows, f"doc_id long, text string, {clash}").repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
