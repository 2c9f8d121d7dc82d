"""The pipeline's stages and the queries themselves, against brute force or held-out rows."""

import random
import re
import zlib

import pytest
from test_operators_llm import WORD, brute_passages, components

import corpus_pipeline
from marlstone.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = list(corpus_pipeline.COLUMNS)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    rng = random.Random(90)
    words = ["".join(rng.choice("aeioubcdrst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    fresh = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage, secret = fresh(200), fresh(70), "".join(rng.choice("0123456789abcdef") for _ in range(32))
    texts = [None, "", "12 34 !!", base, base, base.replace(" ", "  ", 3), base + " " + fresh(12), fresh(100)]
    texts += [f"{fresh(40)}\n{passage}\n{fresh(30)}" for _ in range(4)]
    texts += [f'{fresh(10)} password = "{secret}" {fresh(10)}', *(f"{fresh(9)} token: 0123456789abcdef01234567 {fresh(9)}" for _ in range(4)), fresh(3000), "x" * 20_000]
    out = [(i, t, "en" if i % 4 else None, f"s{i}", len(t or "")) for i, t in enumerate(texts)]
    return [*out, (50, texts[7], None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).persist()


def collected(df):
    assert df.columns == COLUMNS
    out = {r["doc_id"]: r for r in df.collect()}
    for r in out.values():
        assert r["text"] is None or r["n_chars"] in (len(r["text"]), None)
    return out


def test_stage_names_and_empty_tables(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard_join", "suffix_array_dedup", "secret_scan", "packing"]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_language_stage_rejects_texts_without_letters(spark, docs):
    got = collected(corpus_pipeline.identify_language(spark, docs, SF))
    assert set(got) == {i for i, t, *_ in rows() if t and re.search("[a-z]", t)}
    assert all(got[i]["text"] == t for i, t, *_ in rows() if i in got)


def test_near_copies_keep_one_of_each_group(spark, docs):
    want = components(rows(), 5, 80)
    assert set(collected(corpus_pipeline.near_copies(spark, docs, SF))) == {i for i, (_, c) in want.items() if i == c}


def test_repeats_are_cut_as_by_brute_force(spark, docs):
    got = collected(corpus_pipeline.cut_repeats(spark, docs, SF))
    texts = [(i, [w.lower() for w in WORD.findall(t or "")]) for i, t, *_ in rows()]
    _, removed = brute_passages(texts)
    assert len(got) == len(texts)
    for i, w in texts:
        assert [x.lower() for x in WORD.findall(got[i]["text"] or "")] == [x for k, x in enumerate(w) if k not in removed[i]]


def test_live_secrets_are_redacted(spark, docs):
    got = collected(corpus_pipeline.redact_secrets(spark, docs, SF))
    for i, t, *_ in rows():
        live = re.sub(r'password = "[0-9a-f]{32}', "[secret]", t) if t else t
        assert got[i]["text"] == live
    assert sum("[secret]" in (r["text"] or "") for r in got.values()) == 1


def test_whole_run(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path)).persist()
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in now.collect()}
    for i in {r["doc_id"] for r in got}:
        own = [r for r in got if r["doc_id"] == i]
        assert sum(r["length"] for r in own) == own[0]["doc_tokens"]


def test_language_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op1_language_id(spark, sf).collect()
    assert len(got) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and truth[r["doc_id"]]]
    assert len(held) > 150 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) > 0.97 * len(held)


def test_toxicity_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op7_toxicity(spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [(r["score"], truth[r["doc_id"]]) for r in got if r["held_out"] and truth.get(r["doc_id"]) is not None]
    yes, no = [s for s, y in held if y], [s for s, y in held if not y]
    wins = sum((a > b) + 0.5 * (a == b) for a in yes for b in no)
    area = wins / (len(yes) * len(no))
    print(f"area under the curve {area:.3f} on {len(yes)} toxic and {len(no)} other held-out documents")
    assert len(yes) > 30 and area > 0.7


@pytest.mark.parametrize("name", ["op2_html_extraction", "op3_ngram_jaccard_join", "op4_secret_scan", "op8_sum_of_squares_packing", "op9_lossless_webp"])
def test_queries_return_their_columns(spark, name):
    want = {
        "op2_html_extraction": "page_id url text n_chars", "op3_ngram_jaccard_join": "doc_id n_shingles component_id", "op4_secret_scan": "doc_id n_assign n_access n_hex base_sha256 spans",
        "op8_sum_of_squares_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op9_lossless_webp": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    }[name].split()
    df = queries.QUERIES[name](spark, SF)
    assert set(want) <= set(df.columns)
    n = spark.read.parquet(f"{SF}/{'pages' if name.startswith('op2') else 'documents'}.parquet").count()
    assert df.count() >= n


def test_unigram_query_finds_the_best_paths(spark):
    import public_tokenizers

    from marlstone.llm import pieces

    table = pieces.piece_table(spark, public_tokenizers.path("piece_bpe_32k.model")).collect()
    score = {r["piece"]: r["score"] for r in table if r["kind"] == pieces.NORMAL}
    names = {r["id"]: r["piece"] for r in table}
    longest = max(map(len, score))
    texts = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    for r in queries.unigram_viterbi(spark, SF).collect():
        whole = pieces.MARK + texts[r["item_id"]].replace(" ", pieces.MARK)
        best = [0.0]
        for e in range(1, len(whole) + 1):
            # No piece goes over a mark inside.
            best.append(max((best[s] + score[whole[s:e]] for s in range(max(0, e - longest), e) if whole[s:e] in score and pieces.MARK not in whole[s:e].lstrip(pieces.MARK)), default=best[-1] - 1e6))
        got = sum(score.get(names[i], 0.0) for i in r["ids"])
        assert got == pytest.approx(best[-1]) or best[-1] < -1e5


def test_media_are_smaller_than_their_payloads(spark):
    got = queries.op9_lossless_webp(spark, SF).collect()
    assert sum(r["media_bytes"] for r in got) < 0.7 * sum(r["payload_bytes"] for r in got)
