"""Alignment of two tokenizers against brute force: the tokenizers' own libraries and a walk over byte ranges."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from brute import sha
from pyspark.sql import functions as F
from test_cases import corpus, frame, same
from tokenizers import Tokenizer

from pathloom.llm.alignment import ByteTokens, align, align_tokenizers, merge_path
from pathloom.llm.bpe import SPLIT, byte_letters
from pathloom.llm.queries import PIECES, QUERIES, TOKENIZER

WHOLE = Tokenizer.from_file(TOKENIZER)
WHOLE.encode_special_tokens = True
MODEL = sentencepiece.SentencePieceProcessor(model_file=PIECES)
LETTERS = byte_letters()


def sides(text):
    if not text:
        return [], []
    a = [(i, bytes(LETTERS[c] for c in WHOLE.id_to_token(i))) for i in WHOLE.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in MODEL.encode([text])[0]:
        p = MODEL.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if MODEL.is_byte(i) else p.replace("▁", " ").encode()))
    raw = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b) else ([], [])


def ranges(tokens):
    at, out = 0, []
    for i, raw in tokens:
        out.append((at, at + len(raw), i))
        at += len(raw)
    return out


def slow(rows):
    linked, docs = Counter(), []
    for i, text in rows:
        a, b = map(ranges, sides(text))
        common = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        low, groups = 0, []
        for end in common:
            groups.append(",".join(str(t) for s, _, t in a if low <= s < end) + "|" + ",".join(str(t) for s, _, t in b if low <= s < end))
            low = end
        links, k = [], 0
        for s, e, t in a:
            while k < len(b) and b[k][1] <= s:
                k += 1
            j = k
            while j < len(b) and b[j][0] < e:
                links.append((t, b[j][2]))
                j += 1
        linked.update(links)
        docs.append((i, len(a), len(b), ";".join(groups), links))
    most = {}
    for (_, t), n in linked.items():
        most[t] = max(most.get(t, 0), n)
    return [
        (i, na, nb, g.count(";") + bool(g), len(ls), g, sum(linked[x] == most[x[1]] for x in ls), sum(linked[x] for x in ls)) for i, na, nb, g, ls in docs]


@pytest.mark.parametrize("piece", [1, 2, 7, 1 << 16])
def test_pieces_equal_the_whole_merge(piece):
    rng = random.Random(piece)
    for _ in range(60):
        last = rng.randrange(1, 80)
        a, b = (np.array(sorted({last, *(rng.randrange(1, last + 1) for _ in range(rng.randrange(40)))})) for _ in range(2))
        end, x, y, both = align(a, b, piece)
        assert end.tolist() == sorted({*a.tolist(), *b.tolist()})
        assert both.tolist() == [e in a and e in b for e in end]
        assert x.tolist() == np.searchsorted(a, end).tolist() and y.tolist() == np.searchsorted(b, end).tolist()


def test_merge_path():
    rng = random.Random(2)
    for _ in range(50):
        a, b = (np.array(sorted(rng.randrange(30) for _ in range(rng.randrange(12))), np.int64) for _ in range(2))
        order = sorted([(v, 0) for v in a.tolist()] + [(v, 1) for v in b.tolist()])
        wanted = [sum(side == 0 for _, side in order[:d]) for d in range(len(order) + 1)]
        assert merge_path(a, b, np.arange(len(order) + 1)).tolist() == wanted


def texts():
    rng = random.Random(9)
    odd = "a  b\n\n\tc|é ▁ü|<|endoftext|> x|日本語 text|</s><s><unk>|<0x41>| lead|trail |   | x|é|😀 ok|don't we'll 12345|\x00\x01z|\r\n".split("|")
    rows = [r for r in corpus(6) if r[0] != 110] + [(200 + i, t) for i, t in enumerate(odd)]
    rows += [(300 + i, "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x250), 0x20, rng.randrange(0x4E00, 0x9FFF)])) for _ in range(50))) for i in range(40)]
    return rows + [(400, "ab" * 20000), (401, " " * 9000 + "x"), (402, "Ünder " * 4000)]


def test_byte_tokens_equal_the_library():
    assert SPLIT.pattern == public_tokenizers.PATTERN
    every = [t for _, t in texts() if t]
    assert ByteTokens(TOKENIZER)(every) == [WHOLE.encode(t, add_special_tokens=False).ids for t in every]


@pytest.mark.parametrize("chunk_bytes", [1 << 25, 1000])
def test_alignment(spark, chunk_bytes):
    rows = texts()
    out = align_tokenizers(frame(spark, rows), TOKENIZER, PIECES, chunk_bytes=chunk_bytes)
    assert out.columns == ["row", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum"]
    assert out.select("row.*").columns == frame(spark, rows).columns
    same(out.select("row.doc_id", *out.columns[1:]).collect(), slow(rows))


def test_no_rows_and_no_tokens(spark):
    assert align_tokenizers(frame(spark, []), TOKENIZER, PIECES).count() == 0
    out = align_tokenizers(frame(spark, [(1, None), (2, ""), (3, "▁")]), TOKENIZER, PIECES).drop("row").collect()
    same(out, [(0, 0, 0, 0, "", 0, 0)] * 3)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = QUERIES["op13_alignment"](spark, sf)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    same(found.collect(), [(i, a, b, g, n, best, total, sha(t) if t else "") for i, a, b, g, n, t, best, total in slow(rows)])
    assert found.where(F.col("n_links") > 0).count()
