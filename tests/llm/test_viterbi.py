import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from tokenizers.models import Unigram

from spoorline.llm import viterbi

PIECES = viterbi.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
COUNTER = viterbi.Counter(PIECES)


def library(pieces):
    """The library's unigram model; the unknown token's own score is none of the pieces'."""
    own = [("<unk>", max(s for _, s in pieces)), *pieces]
    return Tokenizer(Unigram(own, 0))


LIBRARY = library(PIECES)
TIES = [("▁", -1.0), ("a", -1.0), ("b", -2.0), ("ab", -3.0), ("aa", -2.0), ("aab", -4.0), ("ba", -3.0), ("▁a", -2.0)]


def expected(model, text):
    return len(model.encode(viterbi.MARK + text.replace(" ", viterbi.MARK)).ids) if text else 0


@given(st.one_of(st.text(alphabet="ab c", max_size=30), st.text(alphabet="abz ▁", max_size=12)))
@settings(max_examples=400, deadline=None)
def test_ties_and_unknowns_follow_the_library(text):
    own = viterbi.Counter(TIES)
    assert own.count(text)[0] == expected(library(TIES), text)
    assert own.word(text) == own.path(text)


@given(st.text(max_size=80))
@settings(max_examples=200, deadline=None)
def test_any_text(text):
    assert COUNTER.count(text)[0] == expected(LIBRARY, text)


def test_words_apart_equal_the_whole_text():
    text = "The  quick\nbrown ▁ fox 中文 中 jumps \x00\x01 over"
    whole = COUNTER.path(viterbi.MARK + text.replace(" ", viterbi.MARK))
    assert COUNTER.count(text) == pytest.approx(whole)


def test_documents(spark):
    from spoorline.llm.queries import QUERIES

    sf_dir = "/root/testdata/sf0.001"
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    rows = QUERIES["op6_token_counts"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    assert all(r.n_tokens == expected(LIBRARY, texts[r.doc_id]) for r in rows)


def test_nulls_long_texts_and_clashing_columns(spark):
    rows = [(1, None, "x"), (None, "a b", "y"), (2, "", "z"), (3, "q" * 100_000 + "中" * 1000, "l"), (2, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    count = viterbi.counter(spark, PIECES)
    found = sorted((r.n_tokens, r.f.n_tokens) for r in docs.withColumn("f", count("text")).collect())
    assert found == [("l", expected(LIBRARY, rows[3][1])), ("x", 0), ("y", 2), ("z", 0), ("z", 0)]
    assert docs.limit(0).select(count("text")).count() == 0
    assert viterbi.Counter([]).count("abc")[0] == 1
