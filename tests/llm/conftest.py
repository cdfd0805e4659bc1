"""The documents of the smallest test table and rows of every awkward kind, with clashing extra columns."""

import pytest

SMALL = "/root/testdata/sf0.001"
DDL = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, body string, content string, "
    "doc string, row bigint, tokens int, key string, kept boolean, stats int, digest string, _source string"
)
SPACES = b" \t\n\r\x0b\x0c"


def long_text():
    return " ".join(f"w{n * n % 7919}x{n % 613}" for n in range(40_000)) + "\n" + "same line of the end\n" * 50


def awkward():
    line = "A shared line of some length"
    return [
        (10_000, None, "en", "src0"), (10_001, "", "en", "src0"), (10_002, " \n\t\r ", "en", None),
        (10_003, "one two three", None, "src0"), (10_004, "One  two\tthree", None, None),
        (None, "one two three", "en", "src1"), (10_005, long_text(), "en", "src1"),
        (10_006, f"{line}\nfirst own line here\n{line.upper()} ", "en", "src1"),
        (10_006, f"{line}\nfirst own line here\n{line.upper()} ", "en", "src1"),
        (10_007, f"x\n  {line}\ny\n\nÀ LA CARTE, Ünder Straße", "de", "src1"),
        (10_008, "<|endoftext|> it's a <|startoftext|>test ΣΑΣ 日本語 1234 é <<>> '' 're", "xx", "src2"),
        (10_009, "a " * 5000, "en", "src2"), (10_010, "ab" * 3000, "en", "src2"), (10_011, "  x y", "en", "src2"),
    ]


@pytest.fixture(scope="session")
def docs(spark, tmp_path_factory):
    rows = [tuple(row)[:4] for row in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows = [(r[0], r[1], r[2], r[3]) for r in rows] + awkward()
    extra = (0, 1, "b", "c", "d", 2, 3, "k", None, 5, "e", "s")
    folder = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    frame = spark.createDataFrame([(*row, *extra) for row in rows], DDL).repartition(5)
    frame.write.parquet(folder)
    return spark.read.parquet(folder)


@pytest.fixture(scope="session")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.where("doc_id = -1")

