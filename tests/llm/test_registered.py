"""The registered queries of text operators on a small folder of tables, against plain versions of their contracts."""

import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from threatloom.llm import queries

LANGS = ["en", "de", None]
BODIES = [None, "", " \n ", "one", "a b c " * 40, "Straße, naïve 日本 🎉 <|endoftext|>", "z" * 4000]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def documents():
    random.seed(11)
    made = [" ".join(random.choice("ab cde fgh ij".split()) for _ in range(random.randrange(120))) for _ in range(60)]
    texts = BODIES + made + made[:5]
    return [(i, t, LANGS[i % 3], "web" if i % 4 else None, None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def folder(spark, documents, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    table = spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long")
    table.withColumn("coded", F.lit(1)).write.parquet(f"{path}/documents.parquet")
    return path


def test_op1(spark, folder, documents):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = {r["doc_id"]: r for r in queries.op1_bpe(spark, folder).collect()}
    for doc_id, text, *_ in documents:
        ids = library.encode(text or "", add_special_tokens=False).ids
        told = library.decode(ids, skip_special_tokens=False)
        assert tuple(found[doc_id]) == (doc_id, len(ids), sha(",".join(map(str, ids))), sha(told))
