import glob

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    if not glob.glob(f"{SF}/documents.parquet"):
        pytest.skip("no test tables here")
    return SF


@pytest.fixture(scope="session")
def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path


#: Texts that have broken tokenizers before.
ODD_TEXTS = [
    None, "", "  ", "\t\n x  ", "aaaa" * 500, "ÀÉΣΑΣ ΟΔΟΣ İstanbul", "<|startoftext|>Hi <|endoftext|> there\n\n x",
    "áë ﬁ ½ ١٢٣ 中文 тест 😀👍🏽", "it's WE'LL don't 'S", "\x00\x01\x85  ​　x y",
    "\x1ca\x1fb c", "▁▁ a ▁b", "<s> </s> <unk>", "a " * 3000, "Ⅷ ǅ ß ẞ K Å", "word. word, word! (word)",
    "x" * 20000, "é Å", "1234 5,6.7",
]


@pytest.fixture(scope="session")
def odd_texts(sf_dir):
    import pyarrow.parquet as pq

    return ODD_TEXTS + pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"])["text"].to_pylist()
