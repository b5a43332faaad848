"""The operators against plain Python on small tables with nulls, empty and long texts, ties, repeated rows and more columns."""

import collections
import hashlib
import math
import random
import re
import time
import wave
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from varve.llm import chat, common, langid, linededup, media, mixing, packing, simhash, substrings, tokencounts, topk
from varve.llm.tokens import WordTokenizer, default_path

SF = "/root/testdata/sf0.001"
#: More columns, named like the operators' own.
EXTRA = "id long, hash string, h int, at int, size int, taken int, score string, lang_pred int, component_id int, key string, node int, fp int, line_dedup int, sketch string, text_hash int, __id int"
N_EXTRA = len(EXTRA.split(","))


def docs(spark, rows, extra=True):
    """rows: (doc_id, text, lang, source)."""
    schema = "doc_id long, text string, lang string, source string, n_chars long" + (f", {EXTRA}" if extra else "")
    return spark.createDataFrame([(*r, len(r[1] or ""), *([None] * N_EXTRA if extra else [])) for r in rows], schema)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}x" for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    """Nulls, empties, blanks, repeats, one id with two texts, a long text, other scripts."""
    rng = random.Random(5)
    base = words(rng, 120)
    long_ = words(rng, 30000)
    near = base.replace(base.split()[7], "changed", 1)
    lines = "\n".join(words(rng, 6) for _ in range(12))
    return [
        (0, base, "en", "a"),
        (1, base, "en", "b"),
        (2, near, None, "a"),
        (3, None, "en", "a"),
        (4, "", None, None),
        (5, " \t\n\x0b\x0c\r ", "en", ""),
        (6, "one", "en", "c"),
        (7, "one TWO three", "fr", "c"),
        (8, long_, "en", "a"),
        (9, lines, "en", "a"),
        (9, lines, "en", "a"),
        (10, lines + "\nmore", "en", "b"),
        (11, "x" * 5000, None, "c"),
        (12, "x" * 5000, None, "c"),
        (13, "Straße été 你好 \U0001f600 é   naïve!!", "de", "é"),
        (14, "1234 !!! 5678", "en", "a"),
        (15, lines, None, "z"),
        (15, base, None, "z"),
        (None, base, "en", None),
        (16, long_[1000:9000], "en", "a"),
    ]


# 1


def brute_top_k(rows, queries, k):
    fit = [(i, np.floor(1024 * np.array(v, np.float64)).astype(int).tolist()) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, v in [f for f in fit if queries(f[0])]:
        scores = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i) for i, w in fit if i != q and len(w) == len(v))
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])}
    return out


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.1, 16).tolist()) for i in range(700)]
    rows += [(700 + i, rows[i][1]) for i in range(40)]  # ties
    rows += [(800, None), (900, [None] * 16), (901, [float("nan")] * 16), (902, [float("inf")] + [0.0] * 15), (None, [0.1] * 16), (1000, [0.5] * 3), (1001, [-0.5] * 3), (1100, [])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, block int, dim string")
    rows = [(i, v if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    for k in (3, 10):
        got = topk.exact_top_k(df.where("vec_id % 100 = 0"), df, k).collect()
        assert {tuple(r) for r in got} == brute_top_k(rows, lambda i: i % 100 == 0, k) and len(got) == len(set(got))
    assert topk.exact_top_k(df.limit(0), df).count() == 0 and topk.exact_top_k(df, df.limit(0)).count() == 0


def test_top_k_of_repeats_and_large_values(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e30, 2.0]), (1, [3.0, 4.0]), (2, [-1e30, 0.0]), (0, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.exact_top_k(df.where("vec_id = 0"), df, 2).collect()
    assert len(got) == 4 and {r["vec_id"] for r in got} <= {1, 2} and max(r["score"] for r in got) == (1 << 63) - 1


def test_top_k_of_repeats_by_value(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), rng.integers(-3, 4, 6).astype(float).tolist()) for i in rng.integers(0, 40, 300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    floor = [(i, [int(1024 * x) for x in v]) for i, v in rows]
    want = collections.Counter()
    for q, v in floor:
        if q % 10 == 0:
            scores = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i) for i, w in floor if i != q)
            want.update((q, n + 1, i, -x) for n, (x, i) in enumerate(scores[:10]))
    assert collections.Counter(tuple(r) for r in topk.exact_top_k(df.where("vec_id % 10 = 0"), df, 10).collect()) == want


def test_top_k_by_groups_of_queries(spark, monkeypatch):
    """Small blocks, and groups of query blocks that are broadcast one after another."""
    monkeypatch.setattr(topk, "QUERIES", 5)
    monkeypatch.setattr(topk, "CANDIDATES", 40)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.1, 8).astype(np.float32).astype(float).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6)
    got = topk.exact_top_k(df.where("vec_id % 10 = 0"), df, 7, group=1000).collect()
    assert {tuple(r) for r in got} == brute_top_k(rows, lambda i: i % 10 == 0, 7) and len(got) == 280


def test_top_k_on_table(spark):
    table = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert {tuple(r) for r in topk.op1_exact_top_k(spark, SF).collect()} == brute_top_k(table, lambda i: i % 100 == 0, 10)


# 2


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "\\", "\\\\<|", "<|end|><|start|>", "<\\|", "a\nb", "", None, "<<SYS>>x<</SYS>>", "é\U0001f600", "[[INST]]", "<s><s>"]
    rows = [(i // 4, i, ["user", "assistant", None, "<|sep|>"][i % 4], t, "p") for i, t in enumerate(texts)] + [(9, 1, "user", "b", "p"), (9, 1, "user", "a", "p"), (9, None, "system", "s", "p"), (9, 1, "user", "a", "p"), (None, 1, "assistant", "z", "p")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, prompt string")
    out = chat.format_conversations(df).select("conv_id", "turns", "formatted", chat.read_back(F.col("formatted")).alias("back")).collect()
    assert len(out) == 5
    for r in out:
        assert r["turns"] == r["back"]
        bare = r["formatted"].replace(chat.START, "").replace(chat.SEP, "").replace(chat.END, "")
        assert not any(c in bare for c in chat.CONTROLS)
    nine = next(r for r in out if r["conv_id"] == 9)
    assert [(t["role"], t["text"]) for t in nine["turns"]] == [("system", "s"), ("user", "a"), ("user", "a"), ("user", "b")]


def test_chat_layouts(spark):
    turn = [("user", "q"), ("assistant", "a")]
    tables = [
        spark.createDataFrame([(1, [("human", "q"), ("gpt", "a")])], "conv_id long, conversations array<struct<from: string, value: string>>"),
        spark.createDataFrame([(1, [("user", "q"), ("assistant", "a")])], "conv_id long, messages array<struct<role: string, content: string>>"),
        spark.createDataFrame([(1, "q", None, "a", 5)], "conv_id long, instruction string, input string, output string, other int"),
        spark.createDataFrame([(1, "q", "a")], "conv_id long, prompt string, response string"),
        spark.createDataFrame([(1, "q", "a")], "conv_id long, prompt string, completion string"),
        spark.createDataFrame([(1, None, "q", "a")], "conv_id long, system string, prompt string, response string"),
        spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a")], "conv_id long, turn int, role string, text string"),
    ]
    for df in tables:
        assert [tuple(t) for t in chat.canonical_turns(df).first()["turns"]] == turn, df.columns
    both = spark.createDataFrame([(1, "i", "x", "o")], "conv_id long, instruction string, input string, output string")
    assert chat.canonical_turns(both).first()["turns"][0]["text"] == "i\n\nx"
    none = spark.createDataFrame([(1, None)], "conv_id long, messages array<struct<role: string, content: string>>")
    assert chat.format_conversations(none).first()["formatted"] == ""
    with pytest.raises(ValueError, match="no mapping"):
        chat.canonical_turns(spark.createDataFrame([(1, "x")], "conv_id long, body string"))


def test_chat_of_nothing_and_of_long_texts(spark):
    schema = "conv_id long, turn int, role string, text string, h int, turns string, formatted int"
    none = chat.format_conversations(spark.createDataFrame([], schema))
    assert none.columns == ["conv_id", "turns", "formatted"] and none.count() == 0
    long_ = "<|end|> \\ [INST] é\n" * 200_000
    df = spark.createDataFrame([(1, 0, "user", long_, 1, "x", 2), (1, 1, "assistant", "ok", 1, "x", 2), (2, None, None, None, None, None, None)], schema)
    got = {r["conv_id"]: [(t["role"], t["text"]) for t in r["back"]] for r in chat.format_conversations(df).select("conv_id", chat.read_back(F.col("formatted")).alias("back")).collect()}
    assert got == {1: [("user", long_), ("assistant", "ok")], 2: [("", "")]}


def test_chat_on_table(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    convs = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["conv_id"], r["turn"])):
        convs[r["conv_id"]].append((r["role"], r["text"]))
    said = "</s>[INST] ok [/INST]"
    convs[-1] = [("user", said), ("assistant", said)]
    got = {r["conv_id"]: r for r in chat.op2_chat_format(spark, SF).collect()}
    assert set(got) == set(convs)
    for c, turns in convs.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        want = (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == want


# 3


def brute_repeats(rows):
    data = sorted(((i, (t or "").encode()) for i, t in rows if i is not None), key=lambda r: r[0])
    first = {}
    for i, b in data:
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            first[w] = min(first.get(w, (i, s)), (i, s))
    out = collections.Counter()
    for i, t in rows:
        b = (t or "").encode()
        covered = bytearray(len(b))
        for s in range(len(b) - 99 if i is not None else 0):
            if first[b[s : s + 100]] < (i, s):
                covered[s : s + 100] = b"\1" * 100
        kept = bytes(x for x, c in zip(b, covered, strict=True) if not c)
        spans = len(re.findall(b"\1+", bytes(covered)))
        out[(i, len(b), sum(covered), spans, kept)] += 1
    return out


def repeats(df, **how):
    return collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in substrings.remove_repeats(df, **how).collect())


def spliced(seed, alphabet, n=60):
    """Texts with passages of others, of lengths about that of a window."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        text = "".join(rng.choices(alphabet, k=rng.randrange(400)))
        for _ in range(rng.randrange(4)):
            source = rng.choice(out)[1] if out else "q" * 300
            a, at = rng.randrange(max(1, len(source))), rng.randrange(len(text) + 1)
            text = text[:at] + source[a : a + rng.choice([98, 99, 100, 101, 150, 300])] + text[at:]
        out.append((rng.randrange(n // 2) if seed % 2 else i, text))
    return out


@pytest.mark.parametrize(("seed", "alphabet"), [(0, "abcdefghij é"), (1, "abc"), (2, "a"), (3, "ab"), (4, "abcdefghijklmnopqrstuvwxyz")])
def test_repeats(spark, seed, alphabet):
    rows = spliced(seed, alphabet)
    df = docs(spark, [(i, t, None, None) for i, t in rows])
    want = brute_repeats(rows)
    assert repeats(df) == want
    if seed in (0, 3):
        assert repeats(df, hot=2) == want  # owners with more than two contexts, window by window


def test_repeats_of_odd_rows(spark, odd_rows):
    assert repeats(docs(spark, odd_rows)) == brute_repeats([(r[0], r[1]) for r in odd_rows])
    assert substrings.remove_repeats(docs(spark, odd_rows).limit(0)).count() == 0


def test_repeats_in_a_text_over_a_slice(spark):
    rng = random.Random(1)
    a = "".join(rng.choices("abcdefgh ", k=substrings.TEXT + 5000))
    rows = [(1, a), (0, a[substrings.TEXT - 300 : substrings.TEXT + 300]), (2, a[:500])]
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in substrings.remove_repeats(docs(spark, [(*r, None, None) for r in rows])).collect()}
    assert got == {0: (0, 0), 1: (600, 1), 2: (500, 1)}


def test_resolve_over_batches():
    """Cuts of the sorted rows into batches don't change what is found."""
    import pyarrow as pa

    rng = random.Random(2)
    rows = sorted((rng.randrange(6), rng.randrange(3), rng.randrange(8), 0, rng.randrange(3), 1, False) for _ in range(80))
    want = None
    for size in (80, 7, 1):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + size], strict=True), substrings.FOUND_KINDS, strict=True)], names=substrings.FOUND) for i in range(0, 80, size)]
        for most in (100, 4):
            got = [r for b in substrings._resolve(iter(batches), most) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            covered = sorted(r for r in got if r[0] == 0)
            several = {r[1:] for r in got if r[0] > 0}
            want = want or (covered, several)
            assert (covered, several) == want


def test_run_length_index():
    rng = random.Random(0)
    strings = ["".join(rng.choices("ab", k=rng.randrange(1, 60))).encode() for _ in range(30)]
    index = substrings.RunLengthIndex(strings, 5)
    text = b"\0".join(strings) + b"\0"
    symbols = [x + 30 for x in text]
    for i, (b, n) in enumerate(zip(index.begin, index.sizes, strict=True)):
        symbols[b + n] = i
    order = sorted(range(len(symbols)), key=lambda i: symbols[i:])
    before = [symbols[i - 1] for i in order]
    assert [symbols[order[s] - 1] for s in index.starts] == index.chars.tolist()
    assert len(index.starts) == 1 + sum(x != y for x, y in zip(before, before[1:], strict=False)) and index.samples[0].tolist() == [order[s] for s in index.starts]
    place, kind = index.streamed()
    by = collections.defaultdict(set)
    for p, k in zip(place.tolist(), kind.tolist(), strict=True):
        by[k].add(tuple(symbols[p : p + 5]))
    assert sorted(place.tolist()) == [i for i in range(len(symbols)) if symbols[i] >= 30] and all(len(x) == 1 for x in by.values())


# 4


def packed_well(rows, length):
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    return len(bins)


def test_packing(spark, odd_rows):
    df = docs(spark, odd_rows)
    model = WordTokenizer(default_path()).model
    got = packing.pack(packing.pieces(df)).collect()
    want = collections.Counter()
    for i, t, *_ in odd_rows:
        ids = np.array([*model.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for n, a in enumerate(range(0, len(ids), 2048)):
            part = ids[a : a + 2048]
            want[(i, n, a, len(part), zlib.crc32(part.tobytes()))] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    total = sum(r["length"] for r in got)
    assert packed_well(got, 2048) <= -(-total // 2048) + 1
    assert packing.pack(packing.pieces(df.limit(0))).count() == 0


def test_packing_over_shards(spark):
    rng = random.Random(0)
    cut = spark.createDataFrame([(i, 0, 0, rng.randrange(1, 129), 0, 0) for i in range(3000)], "doc_id long, piece int, start long, length long, ids_crc32 long, tie long")
    total = sum(r["length"] for r in cut.collect())
    one = packing.pack(cut, 128, 256, 400, 4).collect()
    assert len(one) == 3000 and packed_well(one, 128) <= 1.03 * total / 128
    assert sorted((r["doc_id"], r["offset"]) for r in one) == sorted((r["doc_id"], r["offset"]) for r in packing.pack(cut.repartition(5), 128, 256, 400, 4).collect())


def test_packer_is_best_fit():
    p = packing.Packer(10, 2)
    assert [p.place(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    p = packing.Packer(10, 2)
    assert [p.place(n) for n in (5, 8, 6, 2, 5)] == [(0, 0), (1, 0), (2, 0), (2, 6), (0, 5)]  # bin 1, the fullest, was closed


@pytest.mark.parametrize("text", ["Hello, world!!", "can't won't they're", "a.b,c", "İstanbul! Straße.", "été, x", "<|endoftext|> a", "A B c\td", "12,5 x; :: ... ?!", "ΣΣ. ABC,,", "ﬁne"])
def test_word_tokenizer(text):
    t = WordTokenizer(default_path())
    assert np.frombuffer(t(text), "<u4").tolist() == t.model.encode(text, add_special_tokens=False).ids


def test_word_tokenizer_on_all_letters():
    """Every letter with marks after it: some end in a combining mark once they are lower-cased or composed."""
    t = WordTokenizer(default_path())
    letters = [chr(c) for c in range(0x80, 0x32400) if chr(c).isalpha()]
    assert len(letters) > 100_000
    for a in range(0, len(letters), 2000):
        for form in ("{}!!", "x{}.", "A{}?;", "{}"):
            text = " ".join(form.format(x) for x in letters[a : a + 2000])
            assert np.frombuffer(t(text), "<u4").tolist() == t.model.encode(text, add_special_tokens=False).ids
    t.pieces.clear()
    rng = random.Random(9)
    for _ in range(300):
        text = "".join(rng.choice([" ", ".", "!!", "\n", "\u0307", "\u0130", "e\u0301", "\u095a", "a", "Z", "\u00df", "'s", "7", chr(rng.randrange(0x20, 0xD7FF)), chr(rng.randrange(0xE000, 0x1FFFF))]) for _ in range(rng.randrange(60)))
        assert np.frombuffer(t(text), "<u4").tolist() == t.model.encode(text, add_special_tokens=False).ids, repr(text)


# 5


def test_features_by_a_plain_transform(spark):
    """Peaks and pairs against a transform written out sum by sum."""
    rng = np.random.default_rng(8)
    text = bytes(rng.integers(32, 127, 900, dtype=np.uint8)).decode()
    x = [b - 128 for b in media.padded(text.encode())]
    n = max(1, -(-(len(x) - media.WINDOW) // media.HOP) + 1)
    bins = []
    for w in range(n):
        own = [x[i] if i < len(x) else 0 for i in range(w * media.HOP, w * media.HOP + media.WINDOW)]
        mean = sum(own) / media.WINDOW
        own = [(v - mean) * (0.5 - 0.5 * math.cos(2 * math.pi * i / (media.WINDOW - 1))) for i, v in enumerate(own)]
        power = [abs(sum(v * complex(math.cos(2 * math.pi * f * i / media.WINDOW), -math.sin(2 * math.pi * f * i / media.WINDOW)) for i, v in enumerate(own))) ** 2 for f in range(media.WINDOW // 2 + 1)]
        bins.append(max(range(media.LOWEST, len(power)), key=lambda f: power[f]))
    want = sorted((w, bins[w] << 12 | bins[w + g] << 2 | g) for w in range(n) for g in range(1, media.FAN + 1) if w + g < n)
    want.append((n - 1, bins[-1] << 12))
    (row,) = media.media_columns(docs(spark, [(1, text, None, None)])).collect()
    assert [(p["at"], p["code"]) for p in row["fingerprint"]] == want


def test_media_of_a_long_text():
    at, code = media.pairs(media.peaks(bytes(range(256)) * (1 << 15)))  # 8 MB
    assert len(at) == len(code) == 2 * 65535 - 2 and at.dtype == np.int32


def test_media(spark, odd_rows):
    got = media.media_columns(docs(spark, odd_rows)).collect()
    assert len(got) == len(odd_rows)
    by_text = collections.defaultdict(set)
    texts = collections.Counter((r[0], len((r[1] or "").encode())) for r in odd_rows)
    assert collections.Counter((r["doc_id"], r["n_bytes"]) for r in got) == texts
    for r in got:
        back = media.from_wav(bytes(r["media"]))
        assert len(back) % 64 == 0 and len(back) == r["payload_bytes"] and hashlib.sha256(back).hexdigest() == r["payload_sha256"]
        assert zlib.crc32(back[-64:]) == r["tail_crc32"] and hashlib.sha256(bytes(r["media"])).hexdigest() == r["media_sha256"] and len(r["media"]) == r["media_bytes"]
        assert any((t or "").encode() == back[: r["n_bytes"]] and not any(back[r["n_bytes"] :]) for _, t, *_ in odd_rows) and r["fingerprint"]
        by_text[back].add(str(r["fingerprint"]))
    assert all(len(x) == 1 for x in by_text.values())
    assert media.media_columns(docs(spark, odd_rows).limit(0)).count() == 0


def test_media_query_stores_the_media(spark, monkeypatch):
    stored = []

    def keep(df, name):
        stored.append(common.written(df, name))
        return stored[-1]

    monkeypatch.setattr(media, "written", keep, raising=False)
    got = {r["doc_id"]: r for r in media.op5_media_columns(spark, SF).collect()}
    assert len(stored) == 1
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = stored[0].collect()
    assert len(rows) == len(texts) == len(got)
    for r in rows:
        back, data = media.from_wav(bytes(r["media"])), (texts[r["doc_id"]] or "").encode()
        assert back == media.padded(data) and hashlib.sha256(bytes(r["media"])).hexdigest() == got[r["doc_id"]]["media_sha256"]
        feature = " ".join(f"{a}:{c}" for a, c in zip(*media.pairs(media.peaks(back)), strict=True))
        assert feature == got[r["doc_id"]]["feature"] and len(data) == got[r["doc_id"]]["n_bytes"]


def test_peaks_find_tones(tmp_path):
    n, hz = 4096, 1000
    tone = (128 + 100 * np.sin(2 * np.pi * hz * np.arange(n) / media.RATE)).astype(np.uint8).tobytes()
    assert set(media.peaks(tone).tolist()) == {hz * media.WINDOW // media.RATE}
    path = tmp_path / "x.wav"
    path.write_bytes(media.to_wav(tone))
    with wave.open(str(path)) as w:
        assert (w.getnchannels(), w.getsampwidth(), w.readframes(n)) == (1, 1, tone)


# 6


def brute_fingerprint(text, width=3):
    ws = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    grams = [b" ".join(ws[i : i + width]) for i in range(len(ws) - width + 1)] or ([b" ".join(ws)] if ws else [])
    out = 0
    for bit in range(64):
        out |= (2 * sum(xxhash.xxh64_intdigest(g, 42) >> bit & 1 for g in grams) > len(grams)) << bit
    return out


def brute_components(items, linked):
    """items: id -> thing. The smallest id of each one's component."""
    ids, parent = sorted(items), {i: i for i in items}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if linked(items[a], items[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_simhash(spark, odd_rows):
    rows = [(r["doc_id"], r["text"], None, None) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(1000 + (r[0] or 0) + 50 * n, *r[1:]) for n, r in enumerate(odd_rows)]
    want = {r[0]: brute_fingerprint(r[1]) for r in rows}
    component = brute_components(want, lambda x, y: (x ^ y).bit_count() <= 3)
    got = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    assert got == {i: (want[i], component[i]) for i in want}
    odd = simhash.near_duplicates(docs(spark, odd_rows)).collect()
    assert len(odd) == len(odd_rows) and len({r["component_id"] for r in odd if r["fp"] == 0}) == 1
    assert simhash.near_duplicates(docs(spark, odd_rows).limit(0)).count() == 0


def test_links_of_close_fingerprints(spark, monkeypatch):
    """Dense groups, cut by finer blocks, lose no link."""
    rng = random.Random(4)
    fps = set()
    for _ in range(3):
        centre = rng.getrandbits(64)
        for _ in range(150):
            x = centre
            for _ in range(rng.randrange(9)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    items = dict(enumerate(sorted(fps)))
    want = brute_components(items, lambda x, y: (x ^ y).bit_count() <= 3)
    nodes = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for i, x in items.items()], "fp long, node long")
    for hot in (4096, 5):
        monkeypatch.setattr(simhash, "HOT_BUCKET", hot)
        found = {r["node"]: r["component"] for r in simhash.components(simhash.links(nodes)).collect()}
        assert {i: found.get(i, i) for i in items} == want


def test_components_of_chains(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(200) if i % 17]
    rng.shuffle(edges)
    found = {r["node"]: r["component"] for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = brute_components({i: i for i in range(201)}, lambda a, b: b == a + 1 and a % 17)
    assert {i: found.get(i, i) for i in range(201)} == want


def test_components_of_hubs(spark, monkeypatch):
    """Stars of a third of all edges each, one of them around the largest node, with and without hot nodes."""
    rng = random.Random(8)
    edges = [(i, 0) for i in range(2, 300)] + [(9999, i) for i in range(1000, 1300)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(300)]
    links = {(a, b) for a, b in edges} | {(b, a) for a, b in edges}
    nodes = {x: x for e in edges for x in e if e[0] != e[1]}
    want = brute_components(nodes, lambda a, b: (a, b) in links)
    for most in (1, 4, simhash.HOT_NODES):
        monkeypatch.setattr(simhash, "HOT_NODES", most)
        found = {r["node"]: r["component"] for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
        assert found == {x: want[x] for x in found} and set(found) == set(nodes)


def test_near_copies(spark):
    rng = random.Random(9)
    rows = []
    for n in range(40):
        base = words(rng, rng.randrange(20, 300), 100000).split()
        for edits in (0, 0, 1, 2, 4, 9, 30):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w), None, None))
    rng.shuffle(rows)
    sets = {r[0]: set(simhash.shingles(r[1].encode(), 5)) for r in rows}
    want = brute_components(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    kept = {r["doc_id"] for r in simhash.one_of_each(docs(spark, rows)).collect()}
    assert kept == set(want.values())


def test_near_copies_around_a_hub(spark):
    """More than FEW variants that link to a common original, with the largest id, and mostly not to each other."""
    rng = random.Random(13)
    base = rng.sample([f"w{i}x" for i in range(1000)], 120)
    spots = [(i, j) for i in range(5, 114) for j in range(i + 7, 114)]
    rows = []
    for i, j in rng.sample(spots, simhash.FEW + 100):
        w = list(base)
        for at in (i, j):
            w[at], w[at + 1] = w[at + 1], w[at]
        rows.append((len(rows), " ".join(w), None, None))
    rows.append((len(rows), " ".join(base), None, None))
    sets = [set(simhash.shingles(r[1].encode(), 5)) for r in (rows[0], rows[-1])]
    assert len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1])
    assert [r["doc_id"] for r in simhash.one_of_each(docs(spark, rows, extra=False)).collect()] == [0]


def test_near_copies_by_passages(spark):
    """Pairs of a similarity of 0.80 to 0.85 by a passage added or replaced: all are found, and none under 0.8."""
    rng = random.Random(17)
    rows, linked = [], 0
    for n in range(360):
        a = words(rng, rng.randrange(80, 400), 100000).split()
        m = len(a)
        if n % 3 == 0:
            b = a + words(rng, round(m * rng.uniform(0.19, 0.26)), 100000).split()
        elif n % 3 == 1:
            k = round(m * rng.uniform(0.09, 0.125))
            b = a[:-k] + words(rng, k, 100000).split()
        else:
            at = rng.randrange(m)
            b = a[:at] + words(rng, round(m * rng.uniform(0.17, 0.24)), 100000).split() + a[at:]
        rows += [(2 * n, " ".join(a), None, None), (2 * n + 1, " ".join(b), None, None)]
        x, y = (set(simhash.shingles(r[1].encode(), 5)) for r in rows[-2:])
        linked += len(x & y) >= 0.8 * len(x | y)
    assert 100 < linked < 350
    sets = {r[0]: set(simhash.shingles(r[1].encode(), 5)) for r in rows}
    want = brute_components(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    assert {r["doc_id"] for r in simhash.one_of_each(docs(spark, rows, extra=False)).collect()} == set(want.values())


def test_pipeline_links_close_fingerprints(spark):
    """The pipeline's stage loses no link of op6, links pairs of 0.8 besides, and joins both kinds in one group."""
    import corpus_pipeline

    rng = random.Random(21)
    texts = []
    for _ in range(60):
        a = words(rng, rng.randrange(200, 500), 100000).split()
        b = list(a)
        for at in rng.sample(range(len(a)), len(a) // 30):
            b[at] = f"new{rng.randrange(10**6)}"
        c = b + words(rng, round(len(b) * 0.2), 100000).split()
        texts += [" ".join(x) for x in (a, b, c)]
    # within 3 bits, and far under 0.8
    texts += ["la " * 400 + words(rng, n, 100000) for n in (150, 160, 170)]
    rng.shuffle(texts)
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    items = {i: (brute_fingerprint(t), set(simhash.shingles(t.encode(), 5))) for i, t, *_ in rows}
    close = lambda x, y: (x[0] ^ y[0]).bit_count() <= 3
    alike = lambda x, y: len(x[1] & y[1]) >= 0.8 * len(x[1] | y[1])
    want = brute_components(items, lambda x, y: close(x, y) or alike(x, y))
    by_prints, by_shingles = set(brute_components(items, close).values()), set(brute_components(items, alike).values())
    assert set(want.values()) < by_prints and set(want.values()) < by_shingles
    kept = [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs(spark, rows), SF).collect()]
    assert sorted(kept) == sorted(set(want.values()))


def test_proposals_of_large_buckets(monkeypatch):
    """A large bucket's first round asks for another, whatever is linked before and even if its text has no partner."""
    monkeypatch.setattr(simhash, "FEW", 4)
    other, same = (rng.integers(0, 1 << 16, simhash.MINIMA, np.uint16).tobytes() for rng in map(np.random.default_rng, (1, 2)))
    for label in ([0, 1, 2, 3, 4, 5], [0, 0, 2, 3, 4, 5]):
        sketched = [other if x == 0 else same for x in label]
        batch = pa.RecordBatch.from_arrays([pa.array([7] * 6), pa.array(range(6)), pa.array(label), pa.array(sketched, pa.binary())], names=["bucket", "node", "label", "sketch"])
        first, second = (pa.Table.from_batches(simhash._proposed(0.55, most)([batch])).to_pylist() for most in (simhash.MOST, simhash.MOST * simhash.MORE))
        assert any(r["more"] for r in first) and all(r["u"] == r["v"] for r in first)
        nodes = [i for i in range(6) if label[i]]
        assert {(r["u"], r["v"]) for r in second} == {(x, y) for x in nodes for y in nodes if x > y}


def test_one_of_each_odd(spark, odd_rows):
    out = simhash.one_of_each(docs(spark, odd_rows))
    assert out.columns == docs(spark, odd_rows).columns
    ids = [r["doc_id"] for r in out.collect()]
    assert ids.count(None) == 1 and ids.count(9) == 1 and not {1, 2} & set(ids) and {0, 3, 6, 8} <= set(ids)


# 7


def test_token_counts(spark, odd_rows):
    model = WordTokenizer(default_path()).model
    want = collections.Counter((i, len(model.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in odd_rows)
    for block in (1 << 16, 64, 1):
        blocks, separator, kind = tokencounts.flat_files(docs(spark, odd_rows if block > 1 else odd_rows[:8]), block=block)
        if block > 1:
            counts = tokencounts.separator_scan(blocks, separator, kind)
            got = tokencounts._ids(blocks).join(counts, ["file", "block", "ordinal"]).collect()
            assert collections.Counter((r["doc_id"], r["n_tokens"]) for r in got) == want
    assert tokencounts.flat_files(docs(spark, odd_rows).limit(0))[0].count() == 0


def test_token_counts_of_a_text_over_many_blocks(spark):
    rows = [(1, words(random.Random(1), 200_000), None, None), (2, "a b", None, None), (3, None, None, None)]
    blocks, separator, kind = tokencounts.flat_files(docs(spark, rows).coalesce(1), block=64)
    counts = tokencounts.separator_scan(blocks, separator, kind)
    got = dict(tuple(r) for r in tokencounts._ids(blocks).join(counts, ["file", "block", "ordinal"]).select("doc_id", "n_tokens").collect())
    t = WordTokenizer(default_path())
    assert got == {i: len(t(x)) // 4 for i, x, *_ in rows}


def test_separator_scan(spark, monkeypatch):
    """Boundaries are stitched over blocks and over groups of blocks, with empty documents and blocks without separators."""
    monkeypatch.setattr(tokencounts, "GROUP", 3)
    rng = random.Random(0)
    lengths = {f: [rng.choice([0, 0, 1, 5, 40, 200]) for _ in range(30)] for f in range(3)}
    rows = []
    for f, sizes in lengths.items():
        ids = np.array([x for n in sizes for x in [*([7] * n), 9]] + [7] * 5, "<u2")
        rows += [(f, b, bytearray(ids[a : a + 13].tobytes())) for b, a in enumerate(range(0, len(ids), 13))]
    blocks = spark.createDataFrame(rows, "file int, block long, ids binary")
    got = collections.defaultdict(list)
    for r in tokencounts.separator_scan(blocks, 9).orderBy("file", "block", "ordinal").collect():
        got[r["file"]].append(r["n_tokens"])
    assert got == lengths


# 8


def test_mix(spark, odd_rows):
    rows = [*odd_rows, *((100 + i, words(random.Random(i), 50 + i % 300), None, f"s{i % 7}") for i in range(300))]
    df = docs(spark, rows)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    size = collections.Counter()
    for _, t, _, s in rows:
        size[s] += len(re.findall(mixing.WORD, t or ""))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    open_, left, want = set(size), 1.5 * sum(size.values()), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if 2 * size[s] <= level * weight[s]}
        want |= {s: 2.0 * size[s] for s in over} if over else {s: level * weight[s] for s in open_}
        left -= sum(2 * size[s] for s in over)
        open_ = open_ - over if over else set()
    taken = collections.Counter()
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(want[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 2 * mixing.BLOCK for s in size)
    key = lambda r: (str(r["doc_id"]), str(r["source"]), r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, mixing.mix(df.repartition(7)).collect()))
    shards = mixing.mix(df, shard=2000).collect()
    again = collections.Counter()
    for r in shards:
        assert 0 <= r["taken"] <= 2 * r["size"]
        again[r["source"]] += r["taken"]
    assert all(abs(again[s] - want[s]) <= mixing.BLOCK * (2 + size[s] // 1000) for s in size)
    texts = mixing.mixed_texts(df)
    assert texts.columns == df.columns
    n = collections.Counter()
    for r in texts.collect():
        n[r["source"]] += len(re.findall(mixing.WORD, r["text"]))
    assert +n == +taken
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed_texts(df.limit(0)).count() == 0


def test_mix_of_empty_texts(spark):
    """A source without a word is dealt over shards by its rows."""
    df = docs(spark, [(i % 50, None if i % 2 else "", None, "e") for i in range(400)] + [(i, "a b c", None, "w") for i in range(100)])
    got = mixing.mix(df, rows=20).collect()
    assert len(got) == 500 and all(r["taken"] == 0 and r["target"] == 0 for r in got if r["source"] == "e")
    assert abs(sum(r["taken"] for r in got) - 450) <= mixing.BLOCK * 5 and all(r["taken"] <= 2 * r["size"] for r in got)


def test_sainte_lague():
    rng = np.random.default_rng(0)
    for _ in range(60):
        w, seats = rng.integers(0, 1000, rng.integers(1, 9)).astype(float), int(rng.integers(0, 60))
        got = mixing.sainte_lague(w, seats)
        quotients = sorted(((-x / (2 * n - 1), i) for i, x in enumerate(w) for n in range(1, seats + 1) if x > 0))[:seats]
        assert got.tolist() == np.bincount([i for _, i in quotients], minlength=len(w)).tolist()


# 9


def test_language_id(spark, odd_rows):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.op9_language_id(spark, "/root/testdata/sf0.01").join(table.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["lang"]]
    assert len(got) == 1000 and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held)
    profiles = langid.fit(docs(spark, odd_rows))
    assert set(profiles) == {"en", "fr", "de"}
    out = langid.predict(docs(spark, odd_rows), profiles)
    assert set(out.columns) == set(docs(spark, odd_rows).columns)
    by = collections.defaultdict(set)
    for r in out.collect():
        by[r["text"]].add((r["lang_pred"], r["score"]))
    assert by[None] == by[""] == by["1234 !!! 5678"] == {("und", 0.0)} and all(len(x) == 1 for x in by.values())
    assert langid.fit(docs(spark, odd_rows).limit(0)) == {} and langid.predict(docs(spark, odd_rows), {}).where("lang_pred <> 'und'").count() == 0


def test_out_of_place_distance(spark):
    """Profiles, distances and scores against the definition, word by word."""
    rows = [(i, words(random.Random(i), 3 + 4 * i, 60), ("en", "fr", "de")[i % 3], None) for i in range(30)] + [(90, "Straße ½ naïve x2y été!", None, None), (91, "a_b c", None, None)]

    def profile(texts):
        n = collections.Counter()
        for text in texts:
            for w in re.findall(r"[^\W\d_]+", text.lower()):
                for part in "".join(c if c.isalpha() else " " for c in w).split():
                    w_ = f"_{part}_"
                    n.update(w_[i : i + k] for k in (1, 2, 3) for i in range(len(w_) - k + 1) if w_[i : i + k] != "_")
        return sorted(n, key=lambda g: (-n[g], [len(g), *map(ord, g)]))[: langid.PROFILE]

    learned = {lang: profile([t for _, t, own, _ in rows if own == lang]) for lang in ("de", "en", "fr")}
    for r in langid.predict(docs(spark, rows), langid.fit(docs(spark, rows))).collect():
        own = profile([r["text"]])
        far = {lang: sum(abs(p.index(g) - i) if g in p else langid.PROFILE for i, g in enumerate(own)) for lang, p in learned.items()}
        best = min(far, key=lambda lang: (far[lang], lang))
        assert (r["lang_pred"], r["score"]) == (best, pytest.approx(1 - far[best] / (langid.PROFILE * len(own))))


def test_languages_among_null_and_repeated_texts(spark):
    """Labelled rows without a text, and many equal ones, take no other row's place."""
    rows = [(1, "sole texte de cette langue", "fr", None)] + [(2, "the same row", "en", None)] * 3000 + [(10 + i, f"another row {i}", "en", None) for i in range(40)]
    df = docs(spark, rows).select("doc_id", "text", "lang").unionByName(spark.range(20_000).selectExpr("id AS doc_id", "string(null) AS text", "'fr' AS lang"))
    got = collections.Counter(r["lang"] for r in langid.drawn(df, 20).collect())
    assert got == {"fr": 1, "en": 20}
    assert set(langid.fit(df)) == {"fr", "en"} and set(langid.fit(df, languages=1)) == {"en"}


# 10


def brute_lines(rows, width=3):
    first = {}
    for i, t in rows:
        lines = (t if t is not None else "").split("\n") if t is not None else []
        for n in range(len(lines) - width + 1):
            w, at = tuple(lines[n : n + width]), (i is not None, i or 0, n)
            first[w] = min(first.get(w, at), at)
    out = collections.Counter()
    for i, t in rows:
        lines = t.split("\n") if t is not None else []
        gone = {n + k for n in range(len(lines) - width + 1) if first[tuple(lines[n : n + width])] < (i is not None, i or 0, n) for k in range(width)}
        kept = None if t is None else "\n".join(x for n, x in enumerate(lines) if n not in gone)
        out[(i, kept, len(lines), len(gone))] += 1
    return out


def test_line_dedup(spark, odd_rows):
    rng = random.Random(6)
    rows = [(r[0], r[1]) for r in odd_rows] + [(100 + i, "\n".join(rng.choice("abcd") for _ in range(rng.randrange(14)))) for i in range(60)] + [(200, "\n\n\n\n"), (201, "\n\n\n")]
    df = docs(spark, [(*r, None, None) for r in rows])
    out = linededup.line_dedup(df)
    got = collections.Counter((r["doc_id"], r["text"], r["line_dedup"]["n_lines"], r["line_dedup"]["n_removed"]) for r in out.collect())
    assert got == brute_lines(rows) and set(out.columns) == set(df.columns)
    assert linededup.line_dedup(df.limit(0)).count() == 0


def test_line_dedup_of_very_long_texts(spark):
    text = "\n".join(f"line {i % 1000}" for i in range(128_000))
    start = time.monotonic()
    got = {r["doc_id"]: tuple(r["line_dedup"]) for r in linededup.line_dedup(docs(spark, [(1, text, None, None), (2, text, None, None)])).collect()}
    assert got == {1: (128_000, 127_000), 2: (128_000, 128_000)} and time.monotonic() - start < 60


def test_line_dedup_of_hot_windows(spark, monkeypatch):
    rows = [(i, f"a\nb\nc\nd\nx{i % 7}\ny{i % 5}", None, None) for i in range(80)]
    want = brute_lines([(r[0], r[1]) for r in rows])
    for hot in (0.5, 4, 1000):
        monkeypatch.setattr(linededup, "HOT", hot)
        got = linededup.line_dedup(docs(spark, rows)).collect()
        assert collections.Counter((r["doc_id"], r["text"], r["line_dedup"]["n_lines"], r["line_dedup"]["n_removed"]) for r in got) == want


# The registered queries


def test_sql(spark):
    import duckdb

    from varve.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in ORACLE_SQL.items():
        df = QUERIES[name](spark, SF)
        rel = con.execute(sql)
        at = [[x[0] for x in rel.description].index(c) for c in df.columns]
        assert sorted(tuple(r) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in rel.fetchall())
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11))


def test_packing_and_counts_agree(spark):
    packed = packing.op4_best_fit_packing(spark, SF).groupBy("doc_id").agg(F.sum("length").alias("n"))
    counts = tokencounts.op7_token_counts(spark, SF)
    assert counts.join(packed, "doc_id").where("n = n_tokens + 1").count() == counts.count() == 200


def test_pipeline(spark):
    import __spark_entry__
    import corpus_pipeline

    assert __spark_entry__.queries()["pipeline"].__wrapped__ is corpus_pipeline.run
    given = spark.read.parquet(f"{SF}/documents.parquet")
    at = given
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, at, SF)
        assert after.columns == given.columns, name
        rows = after.collect()
        assert rows and {r["doc_id"] for r in rows} <= {r["doc_id"] for r in at.collect()}
        at = spark.createDataFrame(rows, given.schema)
    out = corpus_pipeline.run(spark, SF).collect()
    packed_well(out, 2048)
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in at.collect()}


def test_pipeline_rejects_languages_without_labels(spark):
    import corpus_pipeline

    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    learned = [r for r in given.where("lang is not null").collect() if len(r["text"].split()) > 4]
    other = [
        "Tämä on suomenkielinen lause, jonka tarkoitus on kertoa jotakin tavallisesta päivästä kaupungissa ja sen ihmisistä.",
        "To jest zwykłe zdanie napisane po polsku, które opowiada o zwyczajnym dniu w mieście i jego mieszkańcach.",
        "Ez egy magyar mondat, amely egy hétköznapi napról szól a városban.",
        "zxq vbn kjh wqr " * 20,
    ]
    short = [" ".join(r["text"].split()[:n]) for r in learned[:20] for n in (2, 3) if all(w.isalpha() for w in r["text"].split()[:n])]
    rows = [(10**9 + i, t, None, "a", len(t)) for i, t in enumerate([*other, *short])]
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, given.unionByName(spark.createDataFrame(rows, given.schema)), SF).collect()}
    assert not kept & {10**9 + i for i in range(len(other))}
    assert {10**9 + len(other) + i for i in range(len(short))} <= kept and {r["doc_id"] for r in learned} <= kept


def test_pipeline_on_odd_rows(spark, odd_rows):
    import corpus_pipeline

    at = docs(spark, odd_rows)
    for _, stage in corpus_pipeline.STAGES:
        for empty in (at.limit(0),):
            assert stage(spark, empty, SF).count() == 0
        at = spark.createDataFrame(stage(spark, at, SF).collect(), at.schema) if stage is not corpus_pipeline.best_fit_packing else stage(spark, at, SF)
    assert at.count() > 0
