"""Input columns of any name, letters above U+FFFF, and time in proportion to long texts."""

import random
import time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from passageworks.llm import decontaminate, langid, piece_bpe, sharding, simhash, suffix_dedup, toxicity

CLASH = "doc_id long, text string, lang string, _row long, _h string, _block long, _n long, _ce array<double>, _kept string, _f long, row long, word string"
OWN = [7, "h", 8, 9, [1.5], "k", 10, 11, "w"]


def rows(texts):
    return [(i, t, "en" if i % 2 else "fr", *OWN) for i, t in enumerate(texts)]


TEXTS = [f"some words that tell number {i} of this small corpus from the others in it {'abc' * i}" for i in range(12)] + [None, ""]


def same(got, docs):
    """The rows are input rows, with all their columns as they were."""
    assert got.columns == docs.columns
    full = {r["doc_id"]: r for r in docs.collect()}
    out = got.collect()
    assert out and all(r == full[r["doc_id"]] for r in out)
    return {r["doc_id"] for r in out}


def test_stages_keep_columns_of_any_name(spark, table):
    docs = table(rows(TEXTS + [TEXTS[3]]), CLASH)
    assert same(simhash.drop_near_duplicates(docs), docs) == set(range(13))  # both texts without words are one group
    assert same(suffix_dedup.drop_repeats(docs.where("doc_id < 12")), docs) == set(range(12))
    bench = table([(1, " ".join(TEXTS[5].split()))], "item_id long, text string")
    assert 5 not in same(decontaminate.drop_contaminated(docs, bench), docs)


@pytest.mark.parametrize("local", [langid.LOCAL, 1])
def test_language_keeps_columns_of_any_name(table, local):
    docs = table(rows(TEXTS), CLASH)
    model = langid.train(docs.select("doc_id", "text", "lang"), local=local)
    got = langid.identify(docs, model)
    assert len(got.columns) == len(docs.columns) + 4
    assert len(same(got.select(docs.columns), docs)) == len(TEXTS)


def test_shards_keep_columns_of_any_name(table):
    docs = table([(*r, 10) for r in rows(TEXTS)], CLASH + ", n_bytes long")
    got = sharding.assign(docs, 30)
    assert len(same(got.select(docs.columns), docs)) == len(TEXTS)
    assert got.select("shard").distinct().count() > 1


def test_letters_above_the_first_plane(table):
    han = ["\U00020061\U00020061\U00020062", "\U00020020", "\U00020020 \U00020021"]
    code = lambda t: langid.codes([t])[0].tolist()
    assert code(han[0]) != code("aab") and langid.codes([han[1]])[1][0] > 0
    assert code("\U00010400") == code("\U00010428")  # a capital of Deseret and its small letter
    assert langid.codes(["\U0001F600"])[1][0] == 0  # no letter
    docs = table([(i, t, "han") for i, t in enumerate(han * 3)] + [(100 + i, "plain latin text " * 3, "en") for i in range(9)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.identify(docs, langid.train(docs)).collect()}
    assert all(got[i]["lang_pred"] == "han" for i in range(9)) and all(got[100 + i]["lang_pred"] == "en" for i in range(9))


def test_codes_of_mixed_texts_stay_with_their_text():
    texts = ["ab \U00020061", "", "\U00020061\U00020062", "xy"]
    all_codes, sizes = langid.codes(texts)
    at = 0
    for t, n in zip(texts, sizes):
        own, m = langid.codes([t])
        assert m[0] == n and (all_codes[at:at + n] == own).all()
        at += n


def test_segments_take_linear_time():
    def took(n):
        x = np.tile([1.0, -3.0], n)
        t = time.perf_counter()
        assert len(toxicity.segments(x)) == n
        return time.perf_counter() - t

    took(1000)
    assert took(200_000) < 6 * took(50_000) + 0.5


def test_every_stage_of_an_empty_table(table, tmp_path, spark):
    sf = str(tmp_path)
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, table([], "doc_id long, text string, lang string, source string, n_chars long"), sf).count() == 0, name


def test_pieces_of_long_unbroken_texts():
    """Ids equal the library's, and time doubles with the text."""
    rng = random.Random(3)
    path = public_tokenizers.path("piece_bpe_32k.model")
    library, codec = sentencepiece.SentencePieceProcessor(model_file=path), piece_bpe.Codec(path)
    texts = [unit * (20_000 // len(unit)) for unit in ("the", "ing", "aab", "=", "a", "tion", "中文", "1")]
    texts += ["".join(rng.choice("etaoinshrdlu") for _ in range(20_000))]
    texts += ["".join(rng.choice(a) for _ in range(rng.randrange(1, 60))) for a in ("the", "ab", "aab ", "abc12", "éàè", "=-", "aA") for _ in range(60)]
    for t, ids in zip(texts, codec.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == [library.bos_id(), *library.encode(t), library.eos_id()]

    def took(n):
        t = time.perf_counter()
        codec.m.encode(["the" * n])
        return time.perf_counter() - t

    assert took(66_000) < 6 * took(16_500) + 0.5
