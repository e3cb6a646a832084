"""Words of structured texts keep apart: what a polynomial modulo a power of two would confuse."""

import re

import numpy as np
import pytest
from brute import SPACES, components, contamination, dedup
from test_cases import frame, same

from pathloom.llm.decontaminate import benchmark_matches
from pathloom.llm.jaccard_join import jaccard_components
from pathloom.llm.substring_dedup import substring_dedup
from pathloom.llm.words import NOT_SPACE, find_words, word_hashes


def thue_morse(n):
    word = "".join("ab"[i.bit_count() % 2] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [64, 1024, 4096])
def test_structured_words(spark, n):
    one, two = thue_morse(n)
    head = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{head} {one}"), (2, f"{head} {two}"), (3, one), (4, two), (5, f"{head} {one}")]
    same(substring_dedup(frame(spark, rows)).collect(), dedup(rows))
    same(jaccard_components(frame(spark, rows)).collect(), components(rows))
    items = [(7, one)]
    out = benchmark_matches(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    same(out.select("row.doc_id", "n_words", "n_hit", "items", "contaminated").collect(), contamination(rows, items))


def test_hashes_of_many_words():
    words = [*(f"{a}{b}" for a in "abcdefgh" for b in range(20000)), *("x" * n for n in range(1, 300)), *("y" * n + "x" for n in range(300)), "é", "日本"]
    text = " ".join(words) + " TAIL"
    data = np.frombuffer(text.encode(), np.uint8)
    found = find_words(data, np.array([0, len(data)]), NOT_SPACE)
    assert [data[a:b].tobytes().decode() for a, b in zip(found.starts, found.ends)] == re.findall(SPACES, text)
    for hashes in (found.hashes, found.second):
        assert len(np.unique(hashes)) == len(set(words)) + 1
    assert not (found.hashes == found.second).any()
    folded = find_words(data, np.array([0, len(data)]), NOT_SPACE, fold=True)
    assert folded.hashes[-1] == word_hashes(np.frombuffer(b"tail", np.uint8), np.array([0]), np.array([4]))[0] != found.hashes[-1]
