"""Token counts, packing, chat, decontamination, language, quality: brute force and edge cases."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tabreg.llm import chat, decontamination, language_id, packing, quality, token_counts, tokens
from tabreg.llm.common import normal_words, scratch_path, table, word_bounds
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, `__text` string, `a.b` string"
ODD = "It's we'll 'S don't.. a\x1c,b  x́ É É ΣΑΣ İstanbul 12ab ½ 日本 <|endoftext|>hi ſtraße STRASSE x.\x85y a b"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 0, "clash", "dot") for i, t, lang in rows], DOCS).repartition(3, "doc_id")


def odd_rows():
    return [(1, "one two three", "en"), (2, None, None), (3, "", "en"), (4, " \n\t ", "de"), (5, ODD, "fr"), (None, "no id", None),
            (7, "same", "en"), (7, "same", "en"), (8, "word " * 9000, "en"), (9, "#" * 30, "en")]


@pytest.fixture(scope="module")
def whole():
    t = Tokenizer.from_file(tokens.default_tokenizer())
    t.encode_special_tokens = True
    return t


def test_word_encoder_is_the_tokenizer(whole, spark):
    encode = tokens.WordEncoder(tokens.default_tokenizer()).encode
    texts = [ODD, "", "a\x00b", *(r[0] for r in table(spark, SF, "documents").select("text").limit(60).collect())]
    for t in texts + texts[:5]:
        assert np.frombuffer(encode(t.encode()), "<u2").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_word_encoder_generations(whole, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO_WORDS", 3)
    encode = tokens.WordEncoder(tokens.default_tokenizer()).encode
    for t in ["a b c d e f a b", "g h Éa i a b c", "a, b! c d"] * 3:
        assert np.frombuffer(encode(t.encode()), "<u2").tolist() == whole.encode(t, add_special_tokens=False).ids


def test_token_counts(spark, whole):
    rows = odd_rows()
    files = token_counts.write_token_files(docs(spark, rows), scratch_path(spark, "t"))
    sized = files.where("ordinal IS NULL").select("file", "bytes")
    names = {(r["file"], r["ordinal"]): r["doc_id"] for r in files.where("ordinal IS NOT NULL").collect()}
    expected = sorted((str(i), len(whole.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows)
    for block in (1, 7, 64, 1 << 20):  # documents span blocks, blocks span documents
        got = token_counts.count_tokens(sized, block_tokens=block).collect()
        assert sorted((str(names[r["file"], r["ordinal"]]), r["n_tokens"]) for r in got) == expected
    assert {r["tail"] for r in token_counts.tail_tokens(sized, block_tokens=7).collect()} == {0}


def test_token_count_groups_of_blocks(spark, whole, monkeypatch):
    monkeypatch.setattr(token_counts, "GROUP", 3)
    files = token_counts.write_token_files(docs(spark, odd_rows()), scratch_path(spark, "t"))
    got = token_counts.count_tokens(files.where("ordinal IS NULL").select("file", "bytes"), block_tokens=5)
    assert sorted(r["n_tokens"] for r in got.collect()) == sorted(len(whole.encode(t or "", add_special_tokens=False).ids) for _, t, _ in odd_rows())


def test_token_counts_query(spark, whole):
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.op1_token_counts(spark, SF).collect()}
    assert got == {r["doc_id"]: len(whole.encode(r["text"], add_special_tokens=False).ids) for r in table(spark, SF, "documents").collect()}


def test_tail_of_a_file_cut_short(spark, tmp_dir):
    path = f"{tmp_dir}/x.bin"
    np.array([5, 6, 49407, 7, 8, 9], "<u2").tofile(path)
    files = spark.createDataFrame([(path, 12)], "file string, bytes long")
    assert [r["n_tokens"] for r in token_counts.count_tokens(files, block_tokens=2).collect()] == [2]
    assert token_counts.tail_tokens(files, block_tokens=2).first()["tail"] == 3


def check_pieces(pieces, ids_of, window):
    """Every id in one piece, sequences gapless from 0, all full but the last."""
    by_seq, by_doc = {}, {}
    for p in pieces:
        ids = ids_of[p["doc_id"]]
        assert p["doc_tokens"] == len(ids) and p["length"] > 0
        assert p["ids_crc32"] == zlib.crc32(np.array(ids[p["start"]: p["start"] + p["length"]], "<u4").tobytes())
        by_seq.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
        by_doc.setdefault(p["doc_id"], []).append((p["start"], p["length"]))
    sizes = []
    for s in sorted(by_seq):
        at = 0
        for offset, length in sorted(by_seq[s]):
            assert offset == at
            at += length
        sizes.append(at)
    assert sorted(by_seq) == list(range(len(by_seq))) and all(x == window for x in sizes[:-1]) and (not sizes or 0 < sizes[-1] <= window)
    return by_doc


def test_packing(spark, whole):
    rows = [r for r in odd_rows() if r[0] != 7]
    ids = {i: [*whole.encode(t or "", add_special_tokens=False).ids, 2] for i, t, _ in rows}
    for window in (1, 5, 4096):
        stream = packing.written(packing.token_stream(docs(spark, rows)), "s")
        pieces = packing.pack(stream, window=window).collect()
        by_doc = check_pieces(pieces, ids, window)
        assert set(by_doc) == set(ids)
        for i, parts in by_doc.items():
            at = 0
            for start, length in sorted(parts):
                assert start == at
                at += length
            assert at == len(ids[i])


def test_packing_repeated_rows(spark):
    got = packing.packed_documents(docs(spark, [(7, "same", "en")] * 3)).collect()
    assert sum(r["length"] for r in got) == 6 and sorted(r["offset"] for r in got) == [0, 2, 4]


def test_packing_query(spark, whole):
    ids = {r["doc_id"]: [*whole.encode(r["text"], add_special_tokens=False).ids, 2] for r in table(spark, SF, "documents").collect()}
    pieces = packing.op6_packing(spark, SF).collect()
    check_pieces(pieces, ids, 4096)
    assert sum(p["length"] for p in pieces) == sum(map(len, ids.values()))


# ------------------------------------------------------------------ chat

TURNS = "conv_id long, turn long, role string, text string, formatted string, t string"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS)


def test_chat_round_trip(spark):
    nasty = ["", "\x1b", "\x1b0", "\x1b1", "<|start|>user<|text|>", "<", "<|", "|>", "<|end|>\n", "</s>[INST] ok [/INST]", "a\nb", "<<SYS>>", "<\x1b1|", "é日\U0001f600", "<|turn|>"]
    roles = ["user", "assistant", "system", "<|text|>", None]
    rows = [(c, t, roles[(c + t) % 5] if c % 3 else roles[c % 2], nasty[(7 * c + t) % len(nasty)] if (c + t) % 9 else None) for c in range(40) for t in range(c % 6 + 1)]
    rows += [(50, 1, "user", "b"), (50, 1, "user", "a"), (50, None, "user", "first"), (51, 0, "assistant", "x"), (51, 0, "assistant", "x"), (None, 0, "user", "z"), (None, 1, "user", "y"), (None, 0, "assistant", "x")]
    got = chat.format_conversations(turns(spark, rows)).withColumn("turns", chat.read_turns(F.col("formatted"))).collect()
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for r in got:
        mine = sorted((x for x in rows if x[0] == r["conv_id"]), key=key)
        if r["conv_id"] is None:      # each of these rows is a conversation
            mine = [x for x in mine if [(x[2], x[3])] == [(t["role"], t["text"]) for t in r["turns"]]]
            assert len(mine) == 1
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[2] or "", x[3] or "") for x in mine]
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        loss = "".join(s["text"] for s in r["segments"] if s["loss"]).replace("\x1b1", "").replace("\x1b0", "\x1b")
        assert loss == "".join(x[3] or "" for x in mine if x[2] == "assistant")
        blocks = 1 + sum((a[2] or "") != (b[2] or "") for a, b in zip(mine, mine[1:], strict=False))
        assert r["formatted"].count(chat.START) == r["formatted"].count(chat.END) == blocks
        assert "[INST]" not in r["formatted"] and "</s>" not in r["formatted"]
    assert len(got) == len({x[0] for x in rows} - {None}) + 3


def test_chat_empty_table(spark):
    assert chat.format_conversations(turns(spark, []).limit(0)).count() == 0


def test_chat_query(spark):
    got = {r["conv_id"]: r for r in chat.op2_chat_formatting(spark, SF).collect()}
    rows = sorted((r["conv_id"], r["turn"], r["role"], r["text"] or "") for r in table(spark, SF, "conversations").collect()) + list(chat.PROBE)
    for c in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == c]
        loss = "".join(r[3] for r in mine if r[2] == "assistant")
        assert got[c]["n_turns"] == len(mine) and got[c]["loss_chars"] == len(loss)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r[2]}\n{r[3]}\n" for r in mine).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


# ------------------------------------------------------------------ decontamination

ITEMS = "item_id long, text string, `__id` string"


def brute_hits(words, items, window):
    hit, found = set(), set()
    for item, w in items:
        k = min(window, len(w))
        runs = {tuple(w[i: i + k]) for i in range(len(w) - k + 1)} if w else set()
        for i in range(len(words) - k + 1 if w else 0):
            if tuple(words[i: i + k]) in runs:
                hit |= set(range(i, i + k))
                found.add(item)
    return hit, found


@pytest.mark.parametrize("shard_words", [3, 1000])
def test_decontamination(spark, shard_words):
    rng = np.random.default_rng(5)
    draw = lambda n: [bytes([97 + x]) for x in rng.integers(0, 3, n)]
    items = [(i, draw(int(rng.integers(0, 9)))) for i in range(8)] + [(3, draw(6))]
    texts = [(i, b" ".join(draw(int(rng.integers(0, 40)))).decode(), None) for i in range(60)] + [(100, None, None), (101, "", None), (102, "!!", "x"), (102, "!!", "x")]
    bench = spark.createDataFrame([(i, b" ".join(w).decode(), "c") for i, w in items] + [(None, None, "c"), (77, None, "c")], ITEMS)
    shards = decontamination.automata(bench, window=4, shard_words=shard_words)
    got = decontamination.find_items(docs(spark, texts), shards).collect()
    assert len(got) == len(texts)
    by_text = {i: normal_words((t or "").encode()) for i, t, _ in texts}
    for r in got:
        hit, found = brute_hits(by_text[r["doc_id"]], items, 4)
        assert (r["n_words"], r["n_hit"], r["items"]) == (len(by_text[r["doc_id"]]), len(hit), sorted(found))
        assert {x for s in r["spans"] for x in range(s["first"], s["end"])} == hit
    frame = docs(spark, texts)
    kept = decontamination.without_contaminated(frame, shards)
    assert kept.columns == frame.columns
    clean = [i for i, _, _ in texts if not (h := len(brute_hits(by_text[i], items, 4)[0])) or 20 * h < len(by_text[i])]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(clean)


def test_items_longer_than_a_shard(spark):
    """Items of many words are cut into parts of several shards; no window is lost at a cut."""
    rng = np.random.default_rng(11)
    draw = lambda n: [b"%d" % x for x in rng.integers(0, 400, n)]
    items = [(1, draw(3000)), (2, draw(700)), (3, draw(2)), (None, draw(300))]
    pieces = [items[int(k)][1][a: a + int(n)] for k, a, n in zip(rng.integers(0, 2, 60), rng.integers(0, 600, 60), rng.integers(1, 90, 60), strict=True)]
    texts = [(i, b" ".join(draw(5) + p + draw(30) + items[2][1]).decode(), None) for i, p in enumerate(pieces)]
    texts += [(90, b" ".join(items[0][1]).decode(), None), (91, b" ".join(items[3][1][100:180]).decode(), None)]
    bench = spark.createDataFrame([(i, b" ".join(w).decode(), "c") for i, w in items] * 2, ITEMS)
    shards = decontamination.automata(bench, shard_words=320)
    assert len(shards) > 4
    for r in decontamination.find_items(docs(spark, texts), shards).collect():
        hit, found = brute_hits([w.encode() for w in dict((i, t) for i, t, _ in texts)[r["doc_id"]].split()], items, 13)
        assert r["n_hit"] == len(hit) and r["items"] == sorted(x for x in found if x is not None)


def test_decontamination_without_items(spark):
    bench = spark.createDataFrame([], ITEMS)
    got = decontamination.find_items(docs(spark, odd_rows()), decontamination.automata(bench)).collect()
    assert len(got) == len(odd_rows()) and all(r["n_hit"] == 0 and r["items"] == [] for r in got)


def test_normal_words():
    text = "Hé\x00llo—wOrld 12ab~ÀB\x7f_x"
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    assert [w.decode() for w in normal_words(text.encode())] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    assert [text.encode()[a:b] for a, b in word_bounds(text.encode())] == ["Hé".encode(), "llo—wOrld".encode(), b"12ab", "ÀB".encode(), b"x"]


def test_cut_spans(spark):
    bench = spark.createDataFrame([(1, "a b c d e", "")], ITEMS)
    rows = [(1, "x, A b! c-d. Y " + "z " * 200, None), (2, "a b c d", None), (3, None, None)]
    got = {r["doc_id"]: r for r in decontamination.cut_spans(docs(spark, rows), decontamination.automata(bench, window=4), window=4).collect()}
    assert got[1]["text"] == "x, . Y " + "z " * 200 and got[1]["n_removed"] == 4
    assert got[2]["text"] == "" and got[3]["text"] is None


# ------------------------------------------------------------------ language

def test_language_accuracy_and_edges(spark):
    known = table(spark, SF, "documents")
    model = language_id.learn(known)
    got = language_id.predict(known, model).join(known.select("doc_id", "lang"), "doc_id").where(language_id.held_out("doc_id")).collect()
    assert len(got) > 20 and np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.95
    odd = language_id.predict(docs(spark, odd_rows()), model).collect()
    by = {r["doc_id"]: r for r in odd}
    assert len(odd) == len(odd_rows()) and all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (2, 3, 4, 9))
    assert by[1]["lang_pred"] in model["langs"] and all(0 <= r["score"] <= 1 for r in odd)


def test_language_rejects_what_is_far(spark):
    known = table(spark, SF, "documents")
    far = language_id.predict(docs(spark, [(1, "日本語の文章です " * 20, None)]), language_id.learn(known)).first()
    assert far["rejected"] and far["lang_pred"] != "und"


def test_language_nothing_to_learn(spark):
    rows = docs(spark, [(1, "abc", None), (2, "x", None)])
    assert {r["lang_pred"] for r in language_id.predict(rows, language_id.learn(rows)).collect()} == {"und"}
    assert language_id.predict(rows.limit(0), language_id.learn(rows.limit(0))).count() == 0


def test_language_long_texts_are_counted_whole(monkeypatch):
    text = ("abc déf ghi " * 500).encode()
    one = language_id.counts([text])
    monkeypatch.setattr(language_id, "SLICE_BYTES", 64)
    assert np.array_equal(one, language_id.counts([text]))


# ------------------------------------------------------------------ quality

def test_quality_accuracy(spark):
    known, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    got = quality.score(known, quality.learn(known, labels)).join(labels, "doc_id").where(language_id.held_out("doc_id")).collect()
    assert len(got) > 50 and np.mean([(r["score"] >= quality.THRESHOLD) == (r["quality"] == 1) for r in got]) > 0.95


def test_quality_edges(spark):
    rows = docs(spark, odd_rows())
    none = spark.createDataFrame([(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(rows, quality.learn(rows, none))
    assert got.columns == [*rows.columns, "score"] and {r["score"] for r in got.collect()} == {0.5}
    one = spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.score(rows, quality.learn(rows, one)).collect()} == {1.0}
    assert quality.score(rows.limit(0), "0.5D").count() == 0


def test_tree_rules():
    tree = "Tree\n  If (feature 2 <= 0.5)\n   If (feature 0 > 1.0E-3)\n    Predict: 0.0\n   Else (feature 0 <= 1.0E-3)\n    Predict: 1.0\n  Else (feature 2 > 0.5)\n   Predict: 1.0\n"
    assert quality.tree_rules(tree) == [((2, "<=", 0.5),), ((0, ">", 0.001), (2, "<=", 0.5)), ((0, "<=", 0.001), (2, "<=", 0.5)), ((2, ">", 0.5),)]
