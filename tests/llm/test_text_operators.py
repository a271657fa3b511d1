"""SentencePiece, licences, chats, quality, language: brute force, exact round trips, held-out accuracy, odd rows."""

import hashlib
import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from partita.llm import chat, language, licenses, quality
from partita.llm import sentencepiece_bpe as sp

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, lang_pred string, n_words string, score string"


def docs(spark, texts, lang="en"):
    rows = [(i, t, lang, "s", 0, "own", "own", "own", "own") for i, t in enumerate(texts)] + [(None, "no id here", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


ODD = [None, "", " ", "\n\n", "a", "word " * 30000, "x" * 70000, "<s> </s> <unk> <0x41> ▁▁ \x00 \t\r\n", "日本語 \U0001f600 é", "same", "same"]


def library():
    return sentencepiece.SentencePieceProcessor(model_file=sp.default_model())


def test_prefix_table_equals_the_library_on_random_strings():
    enc, lib = sp.encoder(sp.default_model()), library()
    rng = random.Random(5)
    pieces = [lib.id_to_piece(i).replace("▁", " ") for i in range(3, lib.vocab_size())]
    for _ in range(4000):
        s = "".join(rng.choice([rng.choice(pieces), rng.choice("ab e▁ \n\t<é中\U0001f600"), " " * rng.randint(1, 20), "aaaa" * rng.randint(1, 6)]) for _ in range(rng.randint(0, 20)))
        assert enc.encode(s) == lib.encode(s)


def test_pair_test_equals_merging_the_pair():
    enc = sp.encoder(sp.default_model())
    rng = random.Random(6)
    live = list(enc.right)
    for _ in range(20000):
        a, b = rng.choice(live), rng.choice(live)
        x, y = enc.name[a], enc.name[b]
        assert enc._apart(x[-1], enc.right[a], y[0], enc.left[b]) == (enc._merged(x + y) == [x, y])


def test_words_that_go_on_being_met_stay_in_the_full_table(monkeypatch):
    monkeypatch.setattr(sp, "WORD_BYTES", 20_000)
    enc, lib, made = sp.PrefixTableEncoder(sp.default_model()), library(), []
    word = enc._word
    monkeypatch.setattr(enc, "_word", lambda s: made.append(s) or word(s))
    for i in range(2000):
        s = f"once the{i}x"
        assert enc.encode(s) == lib.encode(s)
    assert made.count("▁once") == 1


def test_user_defined_pieces_are_refused(monkeypatch):
    lib = library()
    kinds = sp.piece_types(lib.serialized_model_proto())
    assert len(kinds) == lib.vocab_size()
    for i, k in enumerate(kinds):
        assert (k == 6, k == 3, k == 2, k == 5) == (lib.is_byte(i), lib.is_control(i), lib.is_unknown(i), lib.is_unused(i))
    monkeypatch.setattr(sp, "piece_types", lambda model: [*kinds[:-1], sp.USER_DEFINED])
    with pytest.raises(ValueError, match="user-defined"):
        sp.PrefixTableEncoder(sp.default_model())


def test_sentencepiece_clashing_columns_and_cut_batches(spark, monkeypatch):
    names = ["c0", "c1", "_encode_text", "t", "ids", "decoded"]
    df = spark.createDataFrame([(i, f"some text {i}") for i in range(50)], "doc_id long, text string")
    got = sp.encode_texts(df.select("doc_id", "text", *[F.lit(7).alias(n) for n in names]))
    assert got.columns == ["doc_id", "text", *names[:4], "ids", "decoded"]
    assert all(r.c0 == r.t == 7 and r.decoded == r.text == f"some text {r.doc_id}" for r in got.collect())
    rb = pa.RecordBatch.from_pydict({"i": list(range(5)), "text": ["a" * 9, None, "b" * 30, "", "c"]})
    whole = pa.Table.from_batches(sp._over(sp.default_model(), sp._ids_and_text)([rb])).to_pylist()
    monkeypatch.setattr(sp, "SLICE", 10)
    cut = list(sp._over(sp.default_model(), sp._ids_and_text)([rb]))
    assert len(cut) == 3 and pa.Table.from_batches(cut).to_pylist() == whole


def test_sentencepiece_odd_texts(spark):
    lib = library()
    got = {r.doc_id: r for r in sp.encode_texts(docs(spark, ODD)).collect()}
    assert got[0].source == "s" and set(got[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars", "lang_pred", "n_words", "score", "ids", "decoded"}
    for i, t in enumerate(ODD):
        want = lib.encode(t or "", add_bos=True, add_eos=True)
        assert got[i].ids == want and got[i].decoded == lib.decode(want)
    assert sp.encode_texts(docs(spark, []).limit(0)).count() == 0


def test_sentencepiece_query_equals_the_library(spark, sf):
    lib = library()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = sp.op1_sentencepiece(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = lib.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_licences(spark):
    mit = dict(licenses.TEXTS)["MIT"]
    texts = [
        "The MIT LICENSE".replace("The ", "") + mit.removeprefix("MIT License").replace("sublicense", "sub-license").replace('"', "“"),
        mit.replace("\n", "\nCopyright (c) 2020 Someone, all of it\n", 1),
        mit + " more",
        "prose\n  released under the mit LICENCE \nmore prose\nLicensed under CC BY-NC 4.0.",
        None,
        "",
        "...",
    ]
    got = {r.doc_id: (r.licence, r.notices) for r in licenses.scan(docs(spark, texts)).collect()}
    assert got[0] == got[1] == ("MIT", "") and got[2] == (None, "") and got[3] == (None, "CC-BY-NC-4.0,MIT")
    assert got[4] == got[5] == got[6] == (None, "") and got[None] == (None, "")
    assert licenses.scan(docs(spark, []).limit(0)).count() == 0


def test_every_known_licence_finds_itself(spark):
    names = [n for n, _ in licenses.TEXTS]
    got = {r.doc_id: r.licence for r in licenses.scan(docs(spark, [t.upper() for _, t in licenses.TEXTS])).collect()}
    assert [got[i] for i in range(len(names))] == names


def test_licences_by_digest(spark):
    folder = Path("/usr/share/common-licenses")
    if not folder.exists():
        pytest.skip("no published licence texts here")
    names = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "BSD": "BSD-3-Clause"}
    texts = [(folder / n).read_text(encoding="utf-8").upper().replace("LICENSE", "licence").replace("\n", "\n# ") for n in names]
    got = {r.doc_id: r.licence for r in licenses.scan(docs(spark, texts + [texts[0] + " with a change"])).collect()}
    assert [got[i] for i in range(len(names))] == list(names.values()) and got[len(names)] is None


def test_licence_lines_that_lose_letters(spark):
    long = "All rights reserved." + " https://www. http://" * 40 + " "
    notices = [("x", "All rights reserved."), ("y", "favor of the acknowledgment")]
    texts = [long, "in favour of none\nFavour of the acknowledgement", "All rights reserved. " * 400, "All rights reserved.\n" * 3000, "All rights reserved.\n" * 3000]
    got = {r.doc_id: r.notices for r in licenses.scan(docs(spark, texts), notices=notices).collect()}
    assert [got[i] for i in range(5)] == ["x", "y", "", "x", "x"]


def test_chat_round_trip(spark):
    rng = random.Random(7)
    bits = ["<|", "|>", "<|im_end|>", "<|im_start|>", "<|im_sep|>", "\\", "<\\|", "<\\\\|", "\n", "a", "é", "<", "|"]
    rows = [(c, t, rng.choice(["user", "assistant", "a\\n\nb", None, "system"]), rng.choice([None, "", "".join(rng.choices(bits, k=8))]), 1) for c in (1, 2, None) for t in range(700)]
    rows += [(3, None, "user", "first", 1), (3, 5, "user", "twice", 1), (3, 5, "user", "twice", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    for c in (1, 2, None, 3):
        want = sorted(((t is not None, t or 0, r or "", x or "") for k, t, r, x, _ in rows if k == c))
        assert [(t.role, t.text) for t in got[c].turns] == [(r, x) for _, _, r, x in want]
        pos, under = 0, []
        for m in got[c].mask:
            pos += m.skip
            under += [got[c].formatted[pos : pos + m["take"]]] if m.loss else []
            pos += m["take"]
        assert pos + len(chat.END) + 1 == len(got[c].formatted)
        assert len(under) == sum(r == "assistant" for _, _, r, _ in want)
    assert chat.format_chats(df.limit(0)).count() == 0


def test_chat_ties_go_by_the_unescaped_text_and_the_loss_is_cut_by_the_mask(spark):
    df = spark.createDataFrame([(1, 1, "assistant", "<]"), (1, 1, "assistant", "<|"), (1, 2, "user", "u")], "conv_id long, turn long, role string, text string")
    made = chat.format_chats(df.withColumn("mask", F.lit(1)).withColumn("_found", F.lit(1)))
    assert [t.text for t in chat.read_chats(made).first().turns] == ["<]", "<|", "u"]
    moved = F.transform("mask", lambda k, i: F.struct((k["skip"] + F.when(i == 0, 1).otherwise(0)).alias("skip"), k["take"].alias("take"), k["loss"].alias("loss")))
    with pytest.raises(Exception, match="differ"):
        chat.read_chats(made.withColumn("mask", moved)).collect()


def test_rules_go_by_rejections_per_cost(spark):
    df = spark.createDataFrame([(i, f"word {i} " * (30 if i % 4 else 3)) for i in range(400)], "doc_id long, text string")
    slow = quality.Rule("slow", lambda t: F.regexp_count(F.repeat(t, 40), F.lit(r"(w|o|r|d)+ \\d")) < 0)
    half = quality.Rule("half", lambda t: F.col("doc_id") % 2 == 0)
    costly = quality.Rule("costly", lambda t: (F.regexp_count(F.repeat(t, 40), F.lit(r"(w|o|r|d)+ \\d")) < 0) | (F.col("doc_id") % 2 == 0))
    assert [r.name for r in quality.order_rules(df, (slow, costly, half))] == ["half", "costly", "slow"]


def test_quality_with_clashing_columns(spark):
    names = ["_h", "_l", "_k", "_p", "row", "t", "kept"]
    df = docs(spark, ["a b c", None]).select("doc_id", "text", *[F.lit(7).alias(n) for n in names])
    got = quality.quality_filter(df).collect()
    assert all(r._h == r.row == r.t == 7 and r.kept is False for r in got)


def test_quality_statistics_on_odd_texts(spark):
    texts = [*ODD[:6], "a b c d e f g h a b c d e f g h", " ".join("abcdefg") + " " + " ".join("abcdefgh"), "l one\nl one\n \n \nl two"]
    got = {r.doc_id: r for r in quality.quality_filter(docs(spark, texts)).collect()}
    assert got[0].n_words == 0 and not got[0].kept and got[5].n_repeat_words == 30000
    assert got[6].n_repeat_words == 16 and got[7].n_repeat_words == 0
    assert got[8].n_dup_lines == 1 and got[8].word_chars == 12
    assert quality.quality_filter(docs(spark, []).limit(0)).count() == 0


def test_cascade_order_does_not_change_what_is_kept(spark, sf):
    stats = quality.base_statistics(spark.read.parquet(f"{sf}/documents.parquet")).cache()
    a = stats.where(quality.cascade(list(quality.RULES))).select("doc_id").collect()
    b = stats.where(quality.cascade(list(quality.RULES)[::-1])).select("doc_id").collect()
    assert sorted(a) == sorted(b) and 0 < len(a) < stats.count()


def test_language_accuracy_on_held_out_texts(spark):
    sf = "/root/testdata/sf0.01"
    got = language.op9_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98


def test_language_odd_texts(spark):
    learn = docs(spark, ["the cat and the dog"] * 3).unionByName(docs(spark, ["el gato y el perro"] * 3, "es"))
    profiles = language.learn_profiles(learn)
    assert list(profiles) == ["en", "es"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs(spark, [*ODD[:5], "12 34 !!", "the dog", "y el gato"]), profiles).collect()}
    assert [got[i] for i in (0, 1, 2, 3, 5)] == [("und", 0.0)] * 5 and got[6][0] == "en" and got[7][0] == "es"
    assert all(0 <= s <= 1 for _, s in got.values())
    assert language.learn_profiles(learn.limit(0)) == {} and language.identify(docs(spark, ["a b"]), {}).first().lang_pred == "und"


def test_profiles_equal_a_plain_count(spark):
    texts = ["Banana, bandana!", "an ant"]
    grams = {}
    for t in texts:
        words = "".join(c.lower() if c.isalpha() else " " for c in t).split()
        s = " " + " ".join(words) + " "
        for n in (1, 2, 3):
            for i in range(len(s) - n + 1):
                g = s[i : i + n]
                if g == " " or (n == 3 and g[1] == " "):
                    continue
                code = 0
                for c in g:
                    code = code << 21 | (1 if c == " " else ord(c) + 1)
                grams[code] = grams.get(code, 0) + 1
    want = [k for k, _ in sorted(grams.items(), key=lambda x: (-x[1], x[0]))]
    assert language.learn_profiles(docs(spark, texts).where(F.col("doc_id").isNotNull()))["en"] == want
