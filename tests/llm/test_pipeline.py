"""The pipeline's stages against brute force, over a small corpus written as tables."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
from brute import components, contamination, sha
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from corpus_pipeline import decontamination, near_duplicates, personal_data
from pathloom.llm.pii import pseudonymise
from pathloom.llm.queries import PII_KEY, TOKENIZER

ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def tables(path):
    rng = random.Random(4)
    say = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 6))) for _ in range(n))
    rows = [(i, say("abcdef" if i % 2 else "klmnop", 40), "x" if i % 2 else "y") for i in range(60)]
    rows += [(100 + i, rows[i][1] + " tail", rows[i][2]) for i in range(10)] + [(120, rows[3][1], None)]
    rows += [(130, "12 34 !", "x"), (131, None, "x"), (132, "", "y"), (133, rows[5][1][:20] + " " + ITEM, "x"), (134, say("abcdef", 400) + " " + ITEM, "x")]
    rows += [(135, rows[7][1] + " mail jo@example.com card 4111111111111111", "x"), (None, say("klmnop", 30), None), (136, say("abcdef", 20000), "x")]
    full = [(i, t, lang, "s", len(t or "")) for i, t, lang in rows]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    pq.write_table(pa.table([pa.array(c, t) for c, t in zip(zip(*full), types)], COLUMNS), f"{path}/documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([1], pa.int64()), "text": [ITEM]}), f"{path}/benchmark.parquet")
    return full


def test_stages_equal_brute_force(spark, tmp_path):
    rows = tables(tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "decontaminate", "pii", "bpe"]
    named = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    expected = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == COLUMNS
        if name == "jaccard_join":
            own = {i: c for i, _, c in components([r[:2] for r in expected])}
            expected = [r for r in expected if r[0] is None or own[r[0]] == r[0]]
        if name == "decontaminate":
            bad = {i for i, *_, b in contamination([r[:2] for r in expected], [(1, ITEM)]) if b}
            expected = [r for r in expected if r[0] not in bad]
            assert {r[0] for r in expected} >= {134, 136} and bad == {133}
        if name == "pii":
            schema = spark.read.parquet(f"{tmp_path}/documents.parquet").schema
            kept = pseudonymise(spark.createDataFrame(expected, schema), PII_KEY).collect()
            expected = [(r.doc_id, r.text, r.lang, r.source, len(r.text)) for r in kept]
            assert not any("jo@example.com" in r[1] or "4111111111111111" in r[1] for r in expected)
        assert named(docs) == sorted(expected, key=str), name
    t = Tokenizer.from_file(TOKENIZER)
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == {r[0] for r in expected}
    for i, text, *_ in expected:
        ids = t.encode(text, add_special_tokens=False).ids
        assert (out[i].n_tokens, list(out[i].ids), out[i].decoded_sha256) == (len(ids), ids, sha(text))


def test_stages_on_empty_tables(spark, tmp_path):
    tables(tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).collect() == []


def test_one_row_of_each_group_stays(spark, tmp_path):
    rng = random.Random(6)
    one, two, three, four = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(4))
    rows = [
        (1, one, "a"), (1, one, "a"), (1, one, "b"), (2, one + " tail", "c"),  # repeated rows and a near copy
        (None, two, "d"), (None, two, "d"), (None, two + " tail", "e"),  # only null ids
        (None, three, "f"), (7, three, "g"), (9, three, "h"),  # a null id comes last
        (1, four, "i"), (8, four, "j"), (1, three + " end", "k"),  # an id in several groups
        (5, None, "l"), (5, "", "m"), (None, " ", "n"), (None, None, "o"),
    ]
    docs = spark.createDataFrame([(i, t, None, s, 0) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    out = [(r.doc_id, r.text, r.source) for r in corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)).collect()]
    words = sorted(((i, t) for i, t, _ in out if t and t.strip()), key=str)
    assert [(i, t) for i, t in words if t == one] == [(1, one)] and len([r for r in words if r[1].startswith(two)]) == 1
    assert [(i, t) for i, t in words if t.startswith(three)] == [(1, three + " end")] and [(i, t) for i, t in words if t == four] == [(1, four)]
    assert len(words) == 4 and {s for *_, s in out} >= {"l", "m", "n", "o"} and len(out) == 8


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    texts = ["one two three four five six seven", "one two three four five six seven", "call 469-555-8958 on 2021-02-28 says the note", None, ""]
    names = "doc_id long, text string, row string, no int, pii string, component_id long, `a.b` int, __row int, class string"
    docs = spark.createDataFrame([(i if i < 4 else None, t, f"r{i}", i, "kept", 7, i, i, "c") for i, t in enumerate(texts)], names)
    kept = near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r["a.b"] for r in kept.collect()) == [0, 2, 3, 4]
    out = personal_data(spark, docs, "")
    assert out.columns == docs.columns
    rows = {r["a.b"]: r for r in out.collect()}
    assert rows[0].text == texts[0] and rows[3].text is None and rows[4].text == "" and rows[2].text != texts[2] and rows[2].pii == "kept" and rows[2].row == "r2"
    with_size = personal_data(spark, docs.select("doc_id", "text").withColumn("n_chars", F.lit(5)), "").collect()
    assert {r.doc_id: r.n_chars for r in with_size} == {0: len(texts[0]), 1: len(texts[0]), 2: len(rows[2].text), 3: None, None: 0}
    bench = spark.createDataFrame([(1, "nothing of this is there")], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = decontamination(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and clean.count() == 5
