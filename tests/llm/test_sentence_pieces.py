import os
import pickle
import random

import numpy as np
import pytest

from lodestone.llm import sentence_pieces as S

sentencepiece = pytest.importorskip("sentencepiece")
pytestmark = pytest.mark.skipif(not os.path.exists(S.MODEL), reason="no model file")


@pytest.fixture(scope="module")
def pieces():
    return S.Pieces.load(S.MODEL)


TEXTS = ["", " ", "  two  spaces ", "Hello, world! 3.14", "éauxouaile straße ñandú", "日本語 and 😀 emoji", "a\tb\nc\r\n", "▁odd▁", "x" * 500, "ab" * 300, "the " * 200, "....----====", "\u0000\u0001", "नमस्ते दुनिया"]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_are_the_models_own(pieces, text):
    own = sentencepiece.SentencePieceProcessor(model_file=S.MODEL).encode(text)
    e = S.Encoder(pieces)
    assert np.frombuffer(e.encode(text), "<i4").tolist() == own
    if text:  # the stream alone, without cuts and memory, a character at a time
        assert [i for part in e.stream(S.SPACE + text.replace(" ", S.SPACE)) for i in part] == own


def test_short_segments(pieces):
    """Pieces side by side, at random: the longest first is often wrong, and some places lead nowhere."""
    own, e, rng = sentencepiece.SentencePieceProcessor(model_file=S.MODEL), S.Encoder(pieces), random.Random(4)
    some = [t for t in sorted(pieces.ids) if S.SPACE not in t]
    for _ in range(3000):
        text = "".join(rng.choices(some, k=rng.randint(1, 6)))
        text = "".join(c if rng.random() < 0.9 else rng.choice("aeinrst\u0378") for c in text)
        got = e.short(S.SPACE + text)
        assert got == own.encode(text) == [i for part in e.stream(S.SPACE + text) for i in part]


def test_short_segments_take_few_steps(pieces):
    """Less than a few parts of the text are looked at for each of its characters, not one of each length."""

    class Counted(str):
        looks = 0

        def __getitem__(self, k):
            Counted.looks += 1
            return str.__getitem__(self, k)

    for text in ("undividedprose" * 4, "interoperabilidadestraße", "xqzjkvxqzjkvxqzjkv"):
        Counted.looks = 0
        assert len(S.Encoder(pieces).short(Counted(S.SPACE + text))) > 1 and Counted.looks <= 4 * len(text)


def test_memory_serves_all_tasks_of_a_worker():
    """What was broadcast stays with a worker; so does its encoder, which isn't sent along."""
    pieces = pickle.loads(pickle.dumps(S.Pieces.load(S.MODEL)))
    assert "encoder" not in vars(pieces)
    pieces.encoder.encode("some words")
    assert len(pieces.encoder.memory) == 2


def test_window_is_bounded(pieces):
    """Ids come long before the end, and no window holds more than a few times the longest piece."""
    taken = 0

    def chars():
        nonlocal taken
        for c in S.SPACE + "undividedprose" * 3000:
            taken += 1
            yield c

    parts = S.Encoder(pieces).stream(chars())
    next(parts)
    assert taken <= 8 * pieces.longest


def test_round_trip(spark, odd, none):
    out = S.encode(odd)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == odd.count() and rows[0]["ids"] is None and rows[1]["ids"] == [] and S.encode(none).count() == 0
    back = {r["doc_id"]: r["text"] for r in S.decode(out).collect()}
    for r in odd.collect():
        if "▁" not in (r["text"] or ""):
            assert back[r["doc_id"]] == r["text"]


def test_only_merges_are_taken(monkeypatch):
    class Unigram:
        def __init__(self, **_):
            pass

        get_piece_size = lambda _: 3
        id_to_piece = lambda _, i: "abc"[i]
        get_score = lambda _, i: -1.5 * i
        is_byte = is_control = is_unknown = is_unused = lambda *_: False

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Unigram)
    with pytest.raises(ValueError):
        S.Pieces.load("some.model")
