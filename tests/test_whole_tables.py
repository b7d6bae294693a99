"""Queries over all rows and letters, which SQL cannot say alike, against plain Python."""

import math
import re

import __spark_entry__ as entry
from foliograph.operators.tfidf import char_ngrams

UNIT = re.compile(r"[\u4e00-\u9fff]|[A-Za-z0-9_]+|[^\s]")


def _rows(spark, where, name):
    return spark.read.parquet(f"{where}/{name}.parquet").collect()


def test_tokens_of_all_documents(spark, tmp_path):
    texts = [(1, "plain words"), (2, "深度学习 und Gr\u00fc\u00dfe\u00a0x\u3000y"), (3, None), (4, "tab\tand \U0001f600"), (5, "")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.tokens for r in entry.queries()["token_estimates"](spark, str(tmp_path)).collect()}
    assert got == {i: math.ceil(len(UNIT.findall(t)) * 0.9) for i, t in texts if t is not None}


def test_tokens_on_tables(spark, root):
    got = {(r.doc_id, r.tokens) for r in entry.queries()["token_estimates"](spark, root).collect()}
    assert got == {(r.doc_id, math.ceil(len(UNIT.findall(r.text)) * 0.9)) for r in _rows(spark, root, "documents") if r.text is not None}


def test_ngrams_of_all_letters(spark, root):
    got = {(r.key, r.gram, r.n) for r in entry.queries()["char_ngram_counts"](spark, root).collect()}
    assert got == {(r.paper_id, g, n) for r in _rows(spark, root, "papers") if r.title is not None for g, n in char_ngrams(r.title).items()}


def test_labels_of_all_entries(spark, tmp_path):
    blocks = [("a", "reference", "[1] Ann, 2019.\n[2a] Bob, 1987.", None), ("b", "ref_text", "3. Cy, no year.", None), ("c", "ref_text", None, ["[4] D, 2001.", "[5] E."]), ("d", "other", "[6] F, 2002.", None)]
    spark.createDataFrame(blocks, "block_id string, sub_type string, text string, list_items array<string>").write.parquet(f"{tmp_path}/paper_content_list.parquet")
    got = {tuple(r) for r in entry.queries()["reference_labels"](spark, str(tmp_path)).collect()}
    assert got == {("a", 1, "1", "2019"), ("a", 2, "2a", "1987"), ("b", 1, "3", ""), ("c", 1, "4", "2001"), ("c", 2, "5", "")}
