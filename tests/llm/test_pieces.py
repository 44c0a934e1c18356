import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gristmill.llm import pieces

SCHEMA = "doc_id long, text string, ids string, n_tokens string"


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load()


SMALL = pieces.Vocabulary({"a": (-5, 256), "b": (-6, 257), "ab": (-7, 258), "aba": (-9, 259), "▁": (-4, 260), "▁a": (-6, 261), "▁▁": (-5, 262), "bb": (-6, 263)}, 0, [bytes([i]) for i in range(256)] + [b"a", b"b", b"ab", b"aba", b" ", b" a", b"  ", b"bb"])


def best_score(vocabulary, text):
    """The whole table at once: largest sum of scores over all segmentations."""
    fallback = min(s for s, _ in vocabulary.pieces.values()) - 10
    best = [0] + [None] * len(text)
    for end in range(1, len(text) + 1):
        best[end] = best[end - 1] + fallback
        for start in range(max(0, end - 40), end):
            if text[start:end] in vocabulary.pieces:
                best[end] = max(best[end], best[start] + vocabulary.pieces[text[start:end]][0])
    return best[-1]


def score_of(vocabulary, ids):
    by_id = {i: s for s, i in vocabulary.pieces.values()}
    fallback = min(by_id.values()) - 10
    held, total = b"", 0
    for i in ids:
        if i in by_id:
            total += by_id[i]
        else:
            held += vocabulary.texts[i]
    return total + fallback * len(held.decode())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \nx▁é", max_size=60))
def test_small_vocabulary(text):
    ids = pieces.Encoder(SMALL).encode(text).tolist()
    assert list(pieces.Encoder(SMALL).stream(text)) == pieces.Encoder(SMALL)._search(text)
    assert pieces.Decoder(SMALL).decode(ids) == text
    if text:
        parts = ("▁" + text.replace("▁", "﷐").replace(" ", "▁"))
        assert score_of(SMALL, ids) == best_score(SMALL, parts)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_any_text_comes_back(vocabulary, text):
    text = text.encode("utf-8", "ignore").decode()
    assert pieces.Decoder(vocabulary).decode(pieces.Encoder(vocabulary).encode(text).tolist()) == text


def test_long_chunk_is_streamed(vocabulary):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdeinrst") for _ in range(5000))
    encoder = pieces.Encoder(vocabulary)
    ids = list(encoder.stream(text))
    assert score_of(vocabulary, ids) == best_score(vocabulary, text)
    meetings = []
    meeting = pieces.Encoder._meeting

    class Watched(pieces.Encoder):
        def _meeting(self, back, best, done):
            meetings.append(len(back))
            return meeting(self, back, best, done)

    assert list(Watched(vocabulary).stream(text)) == ids
    assert meetings and max(meetings) < 20 * encoder.window  # what is held doesn't grow with the text


def test_table(spark, vocabulary):
    rows = [(1, "Hello  world\n and more", None, None), (None, None, "x", None), (2, "", None, None), (2, "", None, None), (3, "word " * 30000, None, None), (4, "▁ ▁a", None, None)]
    got = pieces.encoded(spark.createDataFrame(rows, SCHEMA), vocabulary).collect()
    assert len(got) == len(rows) and all(r.exact and r.n_tokens == len(r.ids) for r in got)
    assert sorted(r.n_tokens for r in got)[:3] == [0, 0, 0]
    df = spark.createDataFrame(rows, SCHEMA).select("text", pieces.encode(F.col("text"), vocabulary).alias("i"))
    assert all(r.d == (r.text or "") for r in df.select("text", pieces.decode(F.col("i"), vocabulary).alias("d")).collect())
    assert pieces.encoded(spark.createDataFrame([], SCHEMA), vocabulary).count() == 0


def test_fractional_scores(monkeypatch):
    """Scores are taken as they are, not rounded."""
    import sentencepiece

    class Model:
        told = [("<0x%02X>" % i, 0.0) for i in range(256)] + [("a", -1.4), ("b", -1.4), ("ab", -2.6)]

        def __init__(self, model_file):
            pass

        def get_piece_size(self):
            return len(self.told)

        def id_to_piece(self, i):
            return self.told[i][0]

        def get_score(self, i):
            return self.told[i][1]

        def is_byte(self, i):
            return i < 256

        def is_control(self, i):
            return False

        is_unknown = is_unused = is_control

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Model)
    found = pieces.load("none")
    assert found.pieces["ab"][0] == -2.6 and list(pieces.Encoder(found).stream("ab")) == [258]
