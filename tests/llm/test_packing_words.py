"""Words that a worker of the packing operator keeps for later tasks."""

import random

import numpy as np
import public_tokenizers

from marlstone.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_kept_words_do_not_change_the_pieces(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgßéжД.,'1") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 90)))) for i in range(80)], "doc_id long, text string").repartition(8)
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    kept, dropped = (sorted(packing.pack_documents(docs, PATH, with_ids=False, remember=r).collect()) for r in (True, False))
    assert kept == dropped


def test_a_later_task_learns_new_words_only(monkeypatch):
    encoder, learned = packing.WordEncoder(PATH), []
    monkeypatch.setitem(packing._encoders, PATH, encoder)
    plain = encoder.learn
    monkeypatch.setattr(encoder, "learn", lambda words: learned.extend(words) or plain(words))
    for text in ("one two three", "two three four", "one four"):
        assert encoder.encode(text) == np.array(encoder.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert sorted(learned) == ["four", "one", "three", "two"]


def test_pieces_of_letters_get_the_librarys_ids():
    encoder, rng = packing.WordEncoder(PATH), random.Random(5)
    letters = [chr(c) for a, b in ((97, 123), (0xDF, 0x180), (0x3B1, 0x3C2), (0x430, 0x460), (0x5D0, 0x5EA), (0x3041, 0x3090), (0xAC00, 0xAC40)) for c in range(a, b) if chr(c).isalpha()]
    texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(40)) for _ in range(60)]
    assert encoder.bare.pre_tokenizer is not None
    assert encoder.encode_all(texts) == [np.array(encoder.model.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_plain_words_are_not_cut(monkeypatch):
    cut, seen = packing.WordEncoder.cut, []
    monkeypatch.setattr(packing.WordEncoder, "cut", lambda self, word: seen.append(word) or cut(self, word))
    encoder = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    for t in ["Plain words IN Letters", "ǅ ß plain, x1 a.b.c 'tis", "", "plain words", "A  b"]:
        assert list(memoryview(encoder.encode(t)).cast("I")) == encoder.model.encode(t, add_special_tokens=False).ids
    assert {"ß", "plain,", "x1"} <= set(seen) and not {"Plain", "IN", "b"} & set(seen)
