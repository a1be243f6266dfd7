"""Encoding against the tokenizers library, and its round trip."""

import os

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tillweave.llm import byte_bpe as B

JSON = "/opt/tokenizers/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(JSON), reason="no vocabulary files")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return t


TRICKY = ["", " ", "  a", "a  ", "I'll don't 'S's 'll''re", "\n\n x\t\ty \r\n", "abc123.45!?  <|endoftext|>", "naïve ½ 日本語のテスト　x", "👩‍🔬 é x", "a" * 3000, "=" * 999, "\x1c\x85​", "'", "'s", " 's", "x'", "don'"]


def expect(library, texts):
    return [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_tricky_texts(library):
    assert B.encode_batch(pa.array(TRICKY), B.DEFAULT_VOCABULARY)[0].to_pylist() == expect(library, TRICKY)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" '\n\tsdmtlver.é1A　"), st.characters(exclude_categories=["Cs"], max_codepoint=0x2FFF)), max_size=40), min_size=1, max_size=8))
def test_any_text_is_encoded_and_decoded(texts):
    got, offsets = (a.to_pylist() for a in B.encode_batch(pa.array(texts), B.DEFAULT_VOCABULARY))
    assert [B.decode(ids) for ids in got] == texts
    for text, ids, at in zip(texts, got, offsets):
        raw = text.encode()
        ends = [*at[1:], len(raw)] if at else []
        assert at[:1] == [0][: len(at)] and [raw[a:b] for a, b in zip(at, ends)] == [B._pieces(B.DEFAULT_VOCABULARY)[i] for i in ids]
        assert B.decode_part(ids, at, len(raw) // 3, len(raw)) == raw[len(raw) // 3 :]


def test_spark_rows(spark, library):
    rows = [(1, None, 7), (2, "", 7), (3, "Hello world", 7), (3, "Hello world", 8), (4, "x y " * 50_000, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted((r.doc_id, r.ids) for r in B.encode(df, run_bytes=1000).collect())
    hello = expect(library, ["Hello world"])[0]
    assert got == [(1, []), (2, []), (3, hello), (3, hello), (4, expect(library, ["x y " * 50_000])[0])]
    assert B.encode(df.limit(0)).count() == 0
    placed = {r.doc_id: r for r in B.encode(df, with_offsets=True).collect()}
    assert placed[3].offsets == [0, 5] and placed[1].offsets == placed[2].offsets == [] and len(placed[4].offsets) == len(placed[4].ids)


def test_scan_is_the_sequential_automaton():
    import numpy as np

    rng = np.random.default_rng(1)
    of_class, _, rows = B.transition_monoid()
    for n in (1, 5, 513, 3000):
        classes = rng.integers(0, 6, n).astype(np.uint8)
        classes[rng.random(n) < 0.02] += B.RESET
        classes[0] = classes[0] % 8 + B.RESET
        state, want = B.S_SPACE, []
        for c in classes:
            want.append(state)
            state = rows[of_class[c], state]
        got = B.scan_states(classes, 64)
        assert got[1:].tolist() == want[1:]


def test_long_text_in_segments(library):
    text = ("It's a long  text's\n\twith 'quotes' and 123 numbers; naïve 日本 " * 300) + "x" * 5000 + " 'll end'"
    got = B.encode_batch(pa.array([text]), B.DEFAULT_VOCABULARY, run_bytes=700)[0].to_pylist()
    assert got == expect(library, [text])
