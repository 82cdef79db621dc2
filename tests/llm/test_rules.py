"""Windows, rare languages and the fit, against plain counts."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyspan.llm import bradley_terry, divergence, queries, token_store
from tests.llm.test_corpus import _repeat_words


@pytest.mark.parametrize("hashed", [F.xxhash64, lambda *c: F.lit(1).cast("long"), lambda *c: F.length(c[0]).cast("long")])
def test_windows_are_told_apart_whatever_their_hashes(spark, hashed):
    draw = random.Random(2)
    texts = ["", "a", "a b", "a b c", "a b c a b c", "a a a a a", *(" ".join(draw.choices(["a", "b", "cc", "dd"], k=draw.randint(3, 40))) for _ in range(60))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    words = F.array_remove(F.split("t", " "), "")
    found = df.select("t", divergence.repeat_words(words, hashed).alias("n")).collect()
    assert [(r["t"], r["n"]) for r in found] == [(t, _repeat_words(re.findall(r"\S+", t))) for t in texts]


def test_rare_languages_are_held_against_all_characters(spark):
    draw = random.Random(3)
    common, rare = [f"word{k}x" for k in range(200)], [f"mot{k}y" for k in range(200)]
    rows = [(i, " ".join(draw.choices(common, k=120)), "en") for i in range(60)]
    rows += [
        (100, " ".join(draw.choices(rare, k=120)), "zz"), (101, " ".join(draw.choices(["##", "$$", "%%"], k=120)), "zz"),
        (102, " ".join(f"{k * 7919}" for k in range(120)), None)
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in divergence.quality_rules(df, divergence.Rules(min_share=0.3)).collect()}
    assert found[100]["kept"] and not found[101]["kept"] and not found[102]["kept"]
    assert found[100]["word_distance"] is None and found[100]["char_distance"] is not None
    assert all(found[i]["kept"] and found[i]["word_distance"] is not None for i in range(60))
    alone = divergence.quality_rules(df.where("doc_id = 101"), divergence.Rules(min_share=2.0)).first()
    assert alone["char_distance"] is not None  # all documents are the one


def test_the_fit_is_the_least_loss_and_the_best_cut():
    """Plain gradient descent over the same pairs, and every cut tried."""
    draw = np.random.default_rng(5)
    x = draw.standard_normal((300, bradley_terry.WIDTH))
    good = (x[:, 0] - x[:, 3] + 0.5 * draw.standard_normal(300) > 0).astype(int)
    settings = bradley_terry.Settings(pairs=4000)
    model = bradley_terry.fit(x, good, settings)
    z = ((x - x.mean(0)) / x.std(0)).clip(-8, 8)
    better, worse = bradley_terry.pairs(good, settings)
    assert (good[better] == 1).all() and (good[worse] == 0).all() and len(better) == 4000
    assert np.ptp(np.bincount(better, minlength=300)[good == 1]) <= 1  # all rows take part alike
    w = np.zeros(bradley_terry.WIDTH)
    for _ in range(3000):
        d = z[better] - z[worse]
        w -= 0.5 * (settings.ridge * w - (d / (1 + np.exp(d @ w))[:, None]).mean(0))
    assert np.abs(w - model.weights).max() < 1e-3
    s = z @ model.weights
    balance = lambda cut: ((s >= cut) & (good == 1)).sum() / (good == 1).sum() + ((s < cut) & (good == 0)).sum() / (good == 0).sum()
    assert balance(model.threshold) >= max(balance(c) for c in np.sort(s)) - 1e-12


def test_token_files_of_long_texts_and_equal_ids(spark):
    import public_tokenizers as P
    from keyspan.llm.segments import tokenizer

    library, path = tokenizer(P.path("byte_bpe_50k.json")), token_store.token_file_path(spark)
    texts = [(4, "long words and, marks! " * 20_000), (4, "a"), (4, "b"), (1, "x" * 100_000), (2, "<|endoftext|> \n")]
    token_store.write_tokens(spark.createDataFrame(texts, "doc_id long, text string"), path, P.path("byte_bpe_50k.json"), end_id=2)
    found = token_store.read_tokens(spark, path).orderBy("part", "block", "seq").collect()
    assert [r["id"] for r in found] == [1, 2, 4, 4, 4]
    stored = sorted(np.frombuffer(r["ids"], "<u4").tolist() for r in found)
    assert stored == sorted([*library.encode(t, add_special_tokens=False).ids, 2] for _, t in texts)
    again = token_store.token_file_path(spark)
    token_store.write_tokens(spark.createDataFrame(texts[::-1], "doc_id long, text string").repartition(4), again, P.path("byte_bpe_50k.json"), end_id=2)
    key = lambda p: [(r["doc_id"], r["start"], r["ids_crc32"]) for r in token_store.stored_digests(spark, p).orderBy("start").collect()]
    assert key(path) == key(again)


def test_target_weights_want_every_source():
    assert all(w > 0 for w in queries.MIX_WEIGHTS.values())
