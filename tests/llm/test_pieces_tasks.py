"""The BPE fold of texts in the tasks that read them."""

import random

import public_tokenizers

from marlstone.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_occurrences_are_not_shuffled_and_ids_are_the_librarys(spark, monkeypatch):
    import sentencepiece

    monkeypatch.setattr(pieces, "REMEMBERED", 5)
    rng = random.Random(3)
    letters = ["the", "ing", "a", "b", "e", "s", "t", " ", "  ", "\n", "é", "ß", "漢", "\U0001f600", "\U000e0041", "▁", "0", "x" * 60]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 90))) for _ in range(150)]
    rows = [*enumerate(texts), (None, "no id"), (3, "id again"), (3, "id again"), (900, ""), (901, None), (902, " "), (903, "q" * 48), (904, "q" * 47)]
    table = pieces.piece_table(spark, PATH)
    out = pieces.decode(pieces.encode(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2), table), table)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = out.collect()
    assert sorted((r["id"] or -1, r["text"]) for r in got) == sorted((i or -1, t or "") for i, t in rows)
    model, scored = sentencepiece.SentencePieceProcessor(model_file=PATH), pieces._known(table)
    for r in got:
        units = pieces._UNITS.findall(pieces.MARK + r["text"].replace(" ", pieces.MARK)) if r["text"] else []
        assert r["ids"] == [i for u in units for i in pieces.merged_ids(u, *scored)]
        assert r["decoded"] == r["text"].replace(pieces.MARK, " ")
        if pieces.MARK not in r["text"]:
            assert r["ids"] == model.encode(r["text"])


def test_decode_takes_unknown_and_missing_ids(spark):
    table = pieces.piece_table(spark, PATH)
    first = {r["piece"]: r["id"] for r in table.collect()}
    rows = [(1, [first["▁the"], 10_000_000, -5, None]), (2, []), (3, None)]
    got = {r["k"]: r["decoded"] for r in pieces.decode(spark.createDataFrame(rows, "k int, ids array<int>"), table).collect()}
    assert got == {1: "the", 2: "", 3: ""}
