"""Each query on odd and empty tables: a row for each document, defined values, no failure."""

import hashlib

import pytest

from lexarium.llm import registry
from tests.llm.conftest import ROWS
from tests.llm.test_turns import plain_trie, rows_of

BY_DOCUMENT = ["op1_toxicity", "op2_fingerprint", "op3_simhash", "op4_pii", "op6_ngrams", "op7_licences", "op9_bpe", "op10_quality", "op12_setsketch"]


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_empty_tables(spark, odd, name):
    assert registry.queries()[name](spark, odd[1]).count() == 0


@pytest.mark.parametrize("name", BY_DOCUMENT)
def test_a_row_for_each_document(spark, odd, name):
    got = registry.queries()[name](spark, odd[0]).toPandas()
    want = sorted(str(r[0]) for r in ROWS)
    assert sorted("None" if x != x or x is None else str(int(x)) for x in got.doc_id) == want
    if "score" in got and name not in ("op6_ngrams", "op7_licences"):
        assert got.score.between(0, 1).all()
    if name == "op9_bpe":
        nothing = hashlib.sha256(b"").hexdigest()
        assert got[got.doc_id.isin([2, 3])].decoded_sha256.eq(nothing).all() and got[got.doc_id.isin([2, 3])].n_tokens.eq(0).all()
    if name == "op3_simhash":
        by = got.set_index("doc_id")
        assert by.loc[[2, 3, 8]].fingerprint.eq("0" * 16).all() and by.loc[[2, 3, 8]].component_id.eq(2).all()
    if name == "op12_setsketch":
        by = got.set_index("doc_id")
        assert by.loc[[2, 3, 8]].n_shingles.eq(0).all() and by.loc[[2, 3, 8]].kept.all() and by.loc[7, "component_id"] == 1 and not got.kept.isna().any()
        assert by.loc[1, "component_id"].eq(1).all()
    if name == "op6_ngrams":
        assert got[got.doc_id.isin([2, 3, 8])].n_tokens.eq(1).all()


def test_packing(spark, odd):
    got = registry.queries()["op5_packing"](spark, odd[0]).toPandas()
    assert got.groupby("sequence_id").length.sum().max() <= 4096
    assert got[got.doc_id.isin([2, 3])].doc_tokens.eq(1).all()
    assert got.length.sum() == got[got.start == 0].doc_tokens.sum() and (got.start == 0).sum() == len(ROWS)


def test_neighbours(spark, odd):
    got = registry.queries()["op8_neighbours"](spark, odd[0]).toPandas().sort_values(["query_id", "rank"])
    assert got[got.query_id == 0].vec_id.tolist() == [1, 8, 50, 6, 6] and got[got.query_id == 50].vec_id.tolist() == [0, 1, 8, 6, 6]  # two rows have the id 6


def test_conversations(spark, odd):
    got = registry.queries()["op11_trie"](spark, odd[0]).toPandas()
    root = got[got.depth == 0].iloc[0]
    assert len(got[got.depth == 0]) == 1 and root.n_convs == 4 and root.conv_id == 0 and root.isna().parent_conv_id and not got[got.depth > 0].parent_conv_id.isna().any()
    rows = [tuple(r) for r in spark.read.parquet(f"{odd[0]}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert set(rows_of(registry.queries()["op11_trie"](spark, odd[0]))) == plain_trie(rows)


def test_spelling(spark, odd):
    got = registry.queries()["op13_spelling"](spark, odd[0])
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"] and got.count() == 0  # LONG has words of four letters at most


def test_pipeline_keeps_clean_documents(spark, odd):
    got = registry.queries()["pipeline"](spark, odd[0])
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    rows = got.toPandas()
    # toxic, junk or repeated rows may go; every piece that stays is whole and in place
    assert rows.doc_id.isin([r[0] for r in ROWS if r[0] is not None]).sum() + rows.doc_id.isna().sum() == len(rows)
    assert (rows.groupby(["sequence_id"]).length.sum() <= 4096).all() and rows[rows.start == 0].doc_tokens.sum() == rows.length.sum()
