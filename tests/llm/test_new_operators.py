"""Token shards, alignment of two tokenizers and the audit of sources, against brute force on fixtures."""

import collections
import hashlib
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from sparrowdoc.llm import alignment, divergence, pieces, repair

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
public_tokenizers = pytest.importorskip("public_tokenizers")
JSON, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: Blanks of all kinds, contractions, letters of one to four bytes, special tokens' strings, the mark that stands for a blank.
PARTS = [*"ab .,'\n\t\x0b\r0-|<A\x00\x85​ 　éßñ中▁", "'s", " the", "   ", "\r\n", "🙂", "é", "<s>", "<unk>", "<|endoftext|>", "the", " der", "\n\n", "Ungeheuerlichkeiten"]


def texts(seed: int, n: int, most: int = 30) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choices(PARTS, k=r.randint(0, most))) for _ in range(n)]


def rows():
    out = [(i, t) for i, t in enumerate(texts(3, 400))]
    long_ = "".join(texts(4, 800))
    return [*out, (None, None), (None, "a b"), (7, "x y"), (7, "x y"), (7, None), (900, ""), (901, " "), (902, "   "), (903, "▁"), (904, long_), (905, "\n"), (906, "no blank line")]


@pytest.fixture(scope="module")
def docs(spark):
    # columns that clash with those of the operators
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows()], "doc_id long, text string, ids string, part int, uid int").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def order(r):
    return [(x is not None, str(x)) for x in r]


def same(df, expected):
    assert sorted((tuple(r) for r in df.collect()), key=order) == sorted(expected, key=order)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(JSON)


def test_words_are_cut_where_nothing_merges(tokenizer):
    words = pieces.Words(pieces.byte_encoder(tokenizer), most=300)  # so that it forgets
    plain = [t for t in texts(5, 3000) if "<|endoftext|>" not in t]
    for i in range(0, len(plain), 5):
        data, ends = pieces.flat(pa.array(plain[i : i + 5]))
        places = pieces.cut(data, ends, signs=True)
        got, _ = words.spell(*pieces.distinct(data, places))
        assert got.tolist() == [x for t in plain[i : i + 5] for x in tokenizer.encode(t, add_special_tokens=False).ids]


def test_distinct_words():
    said = [b"a", b"", b"abcdefgh", b"abcdefghi", b"abcdefgh", b"0123456789abcdef", b"0123456789abcdefg", b"0123456789abcdefg", b"a", b"0123456789abcde"]
    for words in (said, [*said, b"a\x00", b"a"]):
        words = [w for w in words if w]
        data = np.frombuffer(b"".join(words), np.uint8)
        known, at = pieces.distinct(data, np.concatenate([[0], np.cumsum([len(w) for w in words])]))
        assert [known[i] for i in at] == words and sorted(known) == sorted(set(words))


@pytest.mark.parametrize("least", [2, 8])
def test_grammars_give_back_their_ids(least):
    r = np.random.default_rng(1)
    cases = [np.full(1001, 5), np.tile([5, 6, 7], 300), np.array([], np.int64), np.array([3]), *(r.integers(0, high, n) for n in (2, 50, 4000) for high in (2, 4, 30))]
    for ids in cases:
        rules, body = repair.compress(ids, 100, 2, least=least)
        assert repair.Expansion(rules, repair.spans(rules, 100), 100).of(body).tolist() == ids.tolist()
        made = body[body >= 100] - 100
        assert all((rules[i] != 2).all() for i in made)
    rules, body = repair.compress(np.full(1024, 5), 100, 2)
    assert len(body) < 200 and len(rules) >= 3


def test_shards_are_read_at_random(tokenizer):
    r = random.Random(2)
    said = texts(6, 300) + ["the der " * 700]
    ids = [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in said]
    flat = np.array([x for i in ids for x in i])
    blob = repair.pack(flat, np.array([len(i) for i in ids]), 50257, 2)
    shard = repair.Shard(blob)
    assert shard.ids().tolist() == flat.tolist() and len(shard.rules) > 3
    for _ in range(400):
        a, b = sorted(r.choices(range(len(flat) + 1), k=2))
        assert shard.read(a, b).tolist() == flat[a:b].tolist()
    assert shard.read(-5, 10**9).tolist() == flat.tolist()
    with pytest.raises(ValueError):
        repair.Shard(b"XXXX" + blob[4:])


@pytest.mark.parametrize("shard", [1, 500, 1 << 19])
def test_token_shards_are_the_public_encoding(spark, docs, tokenizer, tmp_path, shard):
    shards = repair.write(docs, JSON, 2, shard=shard, path=f"{tmp_path}/shards")
    got = repair.documents(shards, with_ids=True).collect()
    expected, at = [], 0
    # documents of one id follow in the order of their hashes: those of id 7 and of none are told by what they hold
    told = sorted(got, key=lambda x: x["start"])
    assert [x["doc_id"] for x in told] == sorted((i for i, _ in rows()), key=lambda i: (i is not None, i or 0))
    encoded = [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows()]
    for x in told:
        expected.append((x["doc_id"], at, x["n_tokens"], zlib.crc32(np.array(x["ids"], "<u4").tobytes())))
        at += len(x["ids"])
    assert [(x["doc_id"], x["start"], x["n_tokens"], x["ids_crc32"]) for x in told] == expected
    assert sorted((str(x["doc_id"]), x["ids"]) for x in told) == sorted((str(i), ids) for i, ids in encoded)
    if shard == 1:
        assert shards.count() == len(got)


def test_token_shards_of_nothing(empty):
    shards = repair.write(empty, JSON, 2)
    assert shards.count() == 0 and repair.documents(shards).collect() == []


def alignments(said, tokenizer):
    """Of (doc_id, text) rows, by the two libraries on whole texts."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    back = {c: b for b, c in enumerate(pieces.byte_letters())}
    out, counts = [], collections.Counter()
    for doc, text in said:
        a = tokenizer.encode(" " + text, add_special_tokens=False).ids if text else []
        b = model.encode(text) if text else []
        bytes_a = [bytes(back[c] for c in tokenizer.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            out.append((doc, 0, 0, [], collections.Counter()))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        groups, linked, i, j = [], collections.Counter(), 0, 0
        for stop in sorted(set(ends_a) & set(ends_b)):
            m, n = ends_a.index(stop) + 1, ends_b.index(stop) + 1
            groups.append((a[i:m], b[j:n]))
            linked.update((x, y) for x in a[i:m] for y in b[j:n])
            i, j = m, n
        counts.update(linked.keys())
        out.append((doc, len(a), len(b), groups, linked))
    best = collections.defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    say = lambda groups: hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups).encode()).hexdigest() if groups else ""
    return [(d, a, b, len(g), sum(l.values()), sum(n for k, n in l.items() if counts[k] == best[k[0]]), sum(n * counts[k] for k, n in l.items()), say(g)) for d, a, b, g, l in out]


def test_alignment_of_two_tokenizers(spark, docs, empty, monkeypatch):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(JSON)
    plain.encode_special_tokens = True
    expected = alignments(rows(), plain)
    assert sum(r[1] > 0 for r in expected) > 200 and any(r[1] == 0 for r in expected)
    same(alignment.align(docs, JSON, PIECES), expected)
    monkeypatch.setattr(alignment, "SLICE_BYTES", 200)
    same(alignment.align(docs, JSON, PIECES), expected)
    assert alignment.align(empty, JSON, PIECES).collect() == []


def divergences(said, least, top=10):
    """Of (text, lang, source) rows, over whole vocabularies."""
    words = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), lang or "", source or "") for t, lang, source in said]
    out = []
    for lang in {w[1] for w in words}:
        mine = [w for w in words if w[1] == lang]
        held = collections.Counter(t for w in mine for t in set(w[0]))
        kept = sorted(t for t, n in held.items() if n >= least)
        sources = sorted({w[2] for w in mine})

        def rates(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        whole = rates(collections.Counter(t for w in mine for t in w[0]))
        count = {s: collections.Counter(t for w in mine if w[2] == s for t in w[0]) for s in sources}
        own = {s: rates(count[s]) for s in sources}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            pairs = [(o, sum(f(own[s][t], own[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(own[s][t], whole[t])) for t in kept if count[s][t] and own[s][t] > whole[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, n) for n, (item, value) in enumerate(ranked, 1) if part == "pair" or n <= top]
    return out


def sources_rows():
    r = random.Random(9)
    vocabulary = ["ab", "AB", "Äb", "äb", "é", "ﬂuss", "中文", *("w" + chr(97 + i) * (1 + i % 5) for i in range(26))]
    out = []
    for i in range(420):
        source = "hot" if i % 3 == 0 else f"s{r.randrange(40)}"
        out.append((" ".join(r.choices(vocabulary, k=r.randint(0, 12))) + r.choice(["", "1x_y'z", "\n"]), r.choice(["en", "en", "de", None]), source))
    return [*out, (None, "en", "silent"), ("", "en", "mute"), ("ab", "rare", "one"), ("ab ab", "rare", "two"), ("only", None, None), *[("same same", "tie", s) for s in "abcdefghij"], ("word " * 5000, "en", "long")]


def test_divergence_of_sources(spark, empty, monkeypatch):
    said = sources_rows()
    df = spark.createDataFrame([(*r, 1, "x") for r in said], "text string, lang string, source string, value int, term string").repartition(3)
    same(divergence.audit(df), divergences(said, 10))
    monkeypatch.setattr(divergence, "HELD", 20)  # tasks hand on their sums again and again
    monkeypatch.setattr(divergence, "BLOCK", 5)
    same(divergence.audit(df, least=2, top=3), divergences(said, 2, 3))
    assert divergence.audit(empty).collect() == []


def test_rates_leave_64_bits_behind(spark):
    from pyspark.sql import functions as F

    n, total, v = 3 * 10**12, 10**14, 5 * 10**6
    got = spark.range(1).select(divergence.rate(F.lit(n), F.lit(total), F.lit(v)).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * v)


def shingle_likeness(a, b):
    cut = lambda t: {t[i : i + 12] for i in range(len(t) - 11)}
    return len(cut(a) & cut(b)) / len(cut(a) | cut(b))


@pytest.mark.parametrize("kind", ["0123456789abcdef", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "жзийклмноп", ""])
def test_long_alike_lines_are_found_whatever_they_hold(spark, kind):
    """Prose with a token of which some characters in a row differ, and prose of which words differ."""
    from sparrowdoc.llm import lines

    r = random.Random(3)
    vocabulary = ["".join(r.choice("etaoinshrdlucmfwyp") for _ in range(r.randint(2, 9))) for _ in range(4000)]

    def pair():
        while True:
            words = [r.choice(vocabulary) for _ in range(r.randint(18, 24))]
            if kind:
                token = [r.choice(kind) for _ in range(r.randint(50, 80))]
                n = r.randint(8, 18)
                at = r.randint(0, len(token) - n)
                other = token[:at] + [r.choice(kind) for _ in range(n)] + token[at + n :]
                a, b = (" ".join([*words, "".join(t)]) for t in (token, other))
            else:
                other = list(words)
                for _ in range(r.randint(1, 3)):
                    other[r.randrange(len(other))] = r.choice(vocabulary)
                a, b = " ".join(words), " ".join(other)
            if 0.75 <= shingle_likeness(a.lower(), b.lower()) <= 0.82:
                return a, b

    pairs = [pair() for _ in range(200)]
    docs = spark.createDataFrame([(2 * i + k, p[k]) for i, p in enumerate(pairs) for k in (0, 1)], "doc_id long, text string")
    gone = {x.doc_id for x in lines.dedup(docs).where("n_removed > 0").select("doc_id").collect()}
    assert not any(d % 2 == 0 for d in gone) and len(gone) >= 190
