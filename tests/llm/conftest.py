import pytest

EDGE_TEXTS = [
    None, "", " ", "  ", "one", "one", " lead", "trail ", "a  b   c", "tab\tand\nnew \n line", "▁mark ▁▁ x",
    "it's <|endoftext|> we'll <s> go</s>", "日本語のテキスト éàü", " nbsp em", "x" * 5000, "word, " * 3000, "\r\n\r\n",
    "1234 5678!! ((", "a\x00b",
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, odd texts, repeated rows, and columns named like the operators' own."""
    rows = [(i, t, "en", f"src{i % 3}", "a", 1.0) for i, t in enumerate(EDGE_TEXTS)]
    rows += [(3, "  ", "en", "src0", "a", 1.0), (None, "no id", None, None, None, None), (None, "no id", None, None, None, None)]
    rows += [(None, None, None, None, None, None), (100, "one", "de", None, "b", 2.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, size string, score double")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("false")


def texts_by_id(docs):
    return sorted(((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), key=repr)
