"""Registered corpus queries against their DuckDB twins, or brute force where SQL has no word for them, over sf0.001."""

import duckdb
import pytest
from brute import sha
from tokenizers import Tokenizer

from pathloom.llm.queries import ORACLES, QUERIES, TOKENIZER
from tools.check import norm

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_twin(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings", "pages", "conversations"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    text = lambda row, cs: "|".join(norm(row[cs.index(c)]) for c in sorted(cs))
    assert sorted(text(tuple(r), df.columns) for r in df.collect()) == sorted(text(r, names) for r in cur.fetchall())


def test_language_accuracy_on_held_out_rows(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op4_language_id"](spark, SF).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and held and all(0 <= r.score <= 1 for r in rows)
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.97 * len(held)


def test_bpe_equals_the_tokenizers_library(spark):
    t = Tokenizer.from_file(TOKENIZER)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op8_bpe"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = t.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
        assert r.decoded_sha256 == sha(t.decode(ids, skip_special_tokens=False))


def test_every_contract_has_its_query():
    assert [n.split("_")[0] for n in sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 14)]
