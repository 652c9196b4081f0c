"""Operators that work row by row, against plain Python."""

import hashlib
import io
import re
import tarfile
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from lodestone.llm import bpe, media, quality_rules, token_files, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rule_figures(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {p for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for p in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_rules_on_odd_rows(odd):
    got = quality_rules.apply_rules(odd).collect()
    assert len(got) == odd.count()
    for r in got:
        want = rule_figures(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_rules_on_repeats(spark):
    part = " ".join(f"w{i}" for i in range(12))
    texts = [f"{part} x {part}", f"{part}\n{part}\n{part}", "a " * 40, " ".join(f"w{i % 9}" for i in range(60)), "\n".join(["same line"] * 5 + ["other"])]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in quality_rules.apply_rules(df).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == rule_figures(r["text"])


def test_rules_keep_clean_texts(spark, data):
    d = quality_rules.op4_quality_rules(spark, data).toPandas().merge(spark.read.parquet(f"{data}/labels.parquet").toPandas(), on="doc_id")
    good = d[(d.quality == 1) & ~d.base_failed]
    assert good.kept.mean() > 0.98


def test_rules_match_sql(spark, data, duck, same_rows):
    same_rows(quality_rules.op4_quality_rules(spark, data).toPandas(), duck.execute(quality_rules.ORACLES["op4_quality_rules"]).df())


def test_rules_use_no_python(spark, data):
    plan = quality_rules.op4_quality_rules(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan and "Exchange" not in plan


# --- byte-level BPE ---


def tiktoken_encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.Merges().ranks, special_tokens={})


def strange_texts(n=400, seed=3):
    rng = np.random.default_rng(seed)
    bits = [" ", "\n", "\t", "a", "aa", "the", "é", "ß", "中文", "1", "22", "'s", "'", "!", "...", "\x1c", "\x85", "\xa0", "　", "​", "🙂", "x" * 50, " " * 20, "\r\n", "\x00", "<|endoftext|>", "abab", "ing"]
    return ["".join(rng.choice(bits, rng.integers(0, 60))) for _ in range(n)] + ["a" * 3000, " " * 2000, "aaaaa", ""]


def test_merges_equal_the_library():
    import regex

    texts, e = strange_texts(), tiktoken_encoding()
    got = bpe.encode_texts(texts, bpe.Merges(), regex.compile(public_tokenizers.PATTERN))
    assert [x.tolist() for x in got] == [e.encode_ordinary(t) for t in texts]


def test_pieces_merged_one_by_one_agree():
    m = bpe.Merges()
    pieces = [w.encode() for w in (" internationalization", "zzzzzzz", " éèê", "aaaa", "x")]
    ids, starts = m.replay(pieces)
    assert [ids[a:b].tolist() for a, b in zip(starts, starts[1:])] == [m.one(p) for p in pieces]


def test_pieces_merged_one_by_one_equal_the_library():
    import time

    m, e, rng = bpe.Merges(), tiktoken_encoding(), np.random.default_rng(8)
    for _ in range(200):
        piece = "".join(rng.choice(list("aeinrst"), rng.integers(1, 80)))
        assert m.one(piece.encode()) == e.encode_ordinary(piece)
    began = time.time()
    m.one(b"ab" * 100_000)
    assert time.time() - began < 20  # grows nearly as the piece does


def test_bpe_query(spark, odd, folder):
    e = tiktoken_encoding()
    got = bpe.op6_bpe(spark, folder()).collect()
    assert len(got) == odd.count()
    texts = {(r["doc_id"], r["text"] or "") for r in odd.collect()}
    want = Counter((i, len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts for x in [e.encode_ordinary(t)])
    assert set(want) == {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got}


def test_bpe_round_trip(odd, none):
    back = bpe.decode(bpe.encode(odd, chunk=200)).collect()
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in back)
    assert bpe.encode(none).count() == 0


# --- token files ---


def fresh_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_added_tokens_are_ids_of_their_own():
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z  <|endoftext|> ", " <|endoftext|><|endoftext|> w"]
    ids, sizes = token_files.Coder(token_files.load_tokenizer()).encode(texts)
    want = [fresh_tokenizer().encode(t, add_special_tokens=False).ids + [0] for t in texts]
    assert want[0] == [64, 220, 50256, 275, 0]
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == want


def test_parts_equal_whole_texts():
    k, library = token_files.load_tokenizer(), fresh_tokenizer()
    texts = strange_texts() + [None]
    coder = token_files.Coder(k)
    for some in (texts[:150], texts[150:]):
        ids, sizes = coder.encode(some)
        ends = np.cumsum(sizes)
        for t, a, b in zip(some, ends - sizes, ends, strict=True):
            assert ids[a:b].tolist() == library.encode(t or "", add_special_tokens=False).ids + [0]


def test_pieces_equal_whole_texts():
    """Cuts before marks and at line ends change no id, whatever stands beside them."""
    k, library, rng = token_files.load_tokenizer(), fresh_tokenizer(), np.random.default_rng(12)
    signs = np.array([*"aBz19éØ×ª中.,;:!?*%&$#)]}\"'-<|>(", *" \n\n\r\t", "\x0b", "\x85", "\xa0", "\u2028", "  ", "'s", "'ll", ".\n", "lo", "Lo.\nMe", "<|endoftext|>"])
    texts = ["".join(rng.choice(signs, n)) for n in rng.integers(0, 40, 3000)] + ["x\x01.\ny a."]
    coder = token_files.Coder(k)
    for some in (texts[:1500], texts[1500:-1], texts[-1:]):
        ids, sizes = coder.encode(some)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [library.encode(t, add_special_tokens=False).ids + [0] for t in some]


def test_words_reach_the_library_once():
    """Whatever mark or line end follows them."""
    k, sent = token_files.load_tokenizer(), []
    encode = k.encode_batch_fast
    k.encode_batch_fast = lambda strings, **a: sent.extend(strings) or encode(strings, **a)
    coder = token_files.Coder(k)
    for text in ("say lodestone lodestone. lodestone, lodestone!!", "lodestone; lodestone.\nlodestone lodestone?\nlodestone. lodestone:"):
        ids, _ = coder.encode([text])
        assert ids.tolist() == [*fresh_tokenizer().encode(text, add_special_tokens=False).ids, 0]
    assert "".join(sent).count(" lodestone") == 1 and "".join(sent).count("\nlodestone") == 1


@pytest.mark.parametrize("ids", [[], [1], [1, 2] * 500, [7] * 333, list(np.random.default_rng(1).integers(0, 30, 5000))])
def test_grammar_round_trip(ids, tmp_path):
    ids = np.array(ids, np.uint32)
    g = token_files.compress(ids, 100, least=4, rounds=5)
    assert token_files.expand(g).tolist() == ids.tolist()
    path = tmp_path / "s"
    path.write_bytes(b"before" + token_files.pack(g, b"", [len(ids)]))
    import pyarrow as pa

    shard = token_files.Shard(pa.OSFile(str(path)), 6)
    assert shard.all().tolist() == ids.tolist()
    for start, n in ((0, 3), (10, 100), (max(0, len(ids) - 5), 5)):
        assert shard.ids(start, n).tolist() == ids[start : start + n].tolist()
    if len(ids) > 300:
        assert len(g.symbols) < len(ids) / 1.5


@pytest.mark.parametrize("bits", [20, 6])
def test_grammar_leaves_no_frequent_pair(monkeypatch, bits):
    monkeypatch.setattr(token_files, "HASH_BITS", bits)
    rng = np.random.default_rng(3)
    passage = rng.integers(0, 5000, 200)
    ids = np.concatenate([x for _ in range(60) for x in (rng.integers(0, 5000, 100), passage)]).astype(np.uint32)
    g = token_files.compress(ids, 5000)
    assert max(Counter(zip(g.symbols[:-1].tolist(), g.symbols[1:].tolist())).values()) < token_files.LEAST
    assert g.lengths().max() >= 190  # nearly all of the passage is one symbol
    assert token_files.expand(g).tolist() == ids.tolist()


def test_token_file_query(spark, data):
    library = fresh_tokenizer()
    got = {r["doc_id"]: r for r in token_files.op9_token_files(spark, data).collect()}
    start = 0
    for r in spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array(library.encode(r["text"], add_special_tokens=False).ids + [0], "<u4")
        assert (got[r["doc_id"]]["start"], got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_rows_of_one_id_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(token_files, "TASK_BYTES", 1)
    monkeypatch.setattr(token_files, "tasks_for", lambda *_: 6)
    rows = [(None if i % 3 else i, "same text" if i % 5 else f"text {i}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    manifest = token_files.write_ids(df)
    assert manifest.agg({"n_docs": "max"}).first()[0] < 250
    got = token_files.read_ids(manifest, df.schema["doc_id"].dataType, outputs=("start", "n_tokens", "ids")).orderBy("start").collect()
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    library = fresh_tokenizer()
    want = Counter((i, tuple(library.encode(t, add_special_tokens=False).ids + [0])) for i, t in rows)
    assert want == Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got)
    assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in got), key=lambda i: -1 if i is None else i)


def test_token_files_of_odd_rows(spark, odd, none, folder):
    got = token_files.op9_token_files(spark, folder()).orderBy("start").collect()
    assert len(got) == odd.count()
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    assert token_files.op9_token_files(spark, folder(none)).count() == 0


# --- media ---


def test_media_query(spark, odd, none, folder):
    got = media.op3_media(spark, folder()).collect()
    assert len(got) == odd.count()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in odd.collect()}
    for r in got:
        raw = texts[r["doc_id"]]
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        png = media.png(payload)
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(png), hashlib.sha256(png).hexdigest(), media.feature(payload))
    assert media.op3_media(spark, folder(none)).count() == 0


def test_shards_are_tars_and_headers_suffice(spark, odd, tmp_path):
    at = f"file://{tmp_path}/media"
    manifest = media.store(odd, folder=at, shard_bytes=4000)
    rows = media.media_columns(odd.select("doc_id", "text"), manifest, full=False).collect()
    assert {"width", "height", "bits"} <= set(rows[0].asDict()) and all(r["width"] == 192 for r in rows)
    for r in rows:
        with open(r["shard"].removeprefix("file://"), "rb") as f:
            data = f.read()
        members = {m.name: m for m in tarfile.open(fileobj=io.BytesIO(data)).getmembers()}
        assert members[r["digest"] + ".png"].offset_data == r["offset"]
        payload = media.samples(data[r["offset"] : r["offset"] + r["length"]])
        assert payload.rstrip(b" ") == (r["text"] or "").encode().rstrip(b" ")
    assert len({r["digest"] for r in rows}) == len({(r["text"] or "").rstrip(" ") for r in rows})


# --- WARC ---


def pages(spark):
    big, other = "<p>" + "x" * 1200 + "</p>", "é" * 700
    rows = [(1, "u1", big), (2, "u\r\n2", big), (9, None, big), (3, "u3", "small"), (4, "u4", "small"), (5, "u5", None), (6, "u6", ""), (7, "u7", other), (8, "u8", other), (8, "u8", other), (10, "u10", "y" * 50_000), (None, "n", big)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", __import__("pyspark").sql.functions.lit(1))


def test_warc_roles(spark, folder):
    got = warc.op5_warc(spark, folder(pages(spark), "pages")).collect()
    texts = [(r["page_id"], (r["html"] or "").encode()) for r in pages(spark).collect()]
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got) == Counter((i, len(t), hashlib.sha1(t).hexdigest()) for i, t in texts)
    kinds = Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in got)
    assert kinds[(9, "response", None)] == 1 and kinds[(1, "revisit", 9)] == 1 and kinds[(2, "revisit", 9)] == 1 and kinds[(None, "revisit", 9)] == 1
    assert kinds[(8, "response", None)] == 1 and kinds[(8, "revisit", 8)] == 1 and kinds[(7, "revisit", 8)] == 1
    assert kinds[(3, "response", None)] == kinds[(4, "response", None)] == kinds[(5, "response", None)] == 1
    assert warc.op5_warc(spark, folder(pages(spark).where("false"), "pages")).count() == 0


def test_archives_hold_their_dictionary():
    records = [warc.record(i, f"http://x/{i}", f"<html>{'shared words ' * 20}{i}</html>".encode(), None) for i in range(400)]
    data = warc.archive(records)
    assert int.from_bytes(data[:4], "little") == 0x184D2A5D and int.from_bytes(data[4:8], "little") > 0
    assert list(warc.records_in(data)) == records
    assert len(data) < sum(map(len, records)) / 4
    few = [warc.record(1, "u", b"", None)]
    assert list(warc.records_in(warc.archive(few))) == few
    assert warc.parsed(few[0])["payload"] == b""


def test_warc_matches_sql(spark, data, duck, same_rows):
    same_rows(warc.op5_warc(spark, data).toPandas(), duck.execute(warc.ORACLES["op5_warc"]).df())
