"""Operators over documents against brute force on small tables with odd rows."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, pre_tokenizers

from tidelog.llm import bpe, decontaminate, fm_index, langid, licenses, pieces, rans, simhash, token_file, toxicity
from tidelog.llm.common import new_path
from tidelog.llm.queries import QUERIES

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")
LONG = ("word " * 30 + "éclair 漢字 12345 \n\t") * 400
ODD = [
    (1, "The quick brown fox, it's 42 o'clock.\n  Two  spaces"),
    (2, None),
    (3, ""),
    (4, "   \n\t "),
    (5, LONG),
    (5, LONG),
    (None, "no id"),
    (7, " \u0085  \x1c mixed\x00null <|endoftext|> 😀😀"),
    (8, "a" * 5000),
]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def merges():
    return bpe.Merges(bpe.read_ranks(RANKS))


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


# 1: byte-level BPE


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_bpe_is_the_librarys(merges, library, text):
    packed = bpe.TextCodec(merges, public_tokenizers.PATTERN).encode(text)
    assert np.frombuffer(packed, "<u4").tolist() == library.encode_ordinary(text)
    assert bpe.decode_ids(merges.bytes_of, packed) == text.encode()


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.binary(max_size=10), st.data())
def test_bpe_appends_and_edits(merges, data, new, draw):
    e = bpe.PrefixEncoding(merges, data)
    assert e.tokens() == merges.encode(data)
    e.append(new)
    assert e.tokens() == merges.encode(data + new)
    start = draw.draw(st.integers(0, len(e.data)))
    end = draw.draw(st.integers(start, len(e.data)))
    whole = e.data[:start] + b"xyz" + e.data[end:]
    e.replace(start, end, b"xyz")
    assert e.data == whole and e.tokens() == merges.encode(whole) and e.last == bpe.PrefixEncoding(merges, whole).last
    e.truncate(len(whole) // 2)
    assert e.tokens() == merges.encode(whole[: len(whole) // 2])


def test_bpe_edit_is_local(merges):
    e = bpe.PrefixEncoding(merges, b" some words of a text that goes on and on" * 200)
    assert e.replace(100, 103, b"other") < 600


def test_bpe_columns(spark, library):
    df = spark.createDataFrame([(*r, "x", 1) for r in ODD], "doc_id long, text string, `a.b` string, IDS int")
    model = bpe.BpeModel(spark, RANKS, public_tokenizers.PATTERN)
    out = bpe.bpe_decode(bpe.bpe_encode(df, model, ids="packed"), model, ids="packed").collect()
    assert len(out) == len(ODD)
    for r in out:
        ids = np.frombuffer(bytes(r.packed), "<u4").tolist()
        assert ids == library.encode_ordinary(r.text or "") and r.n_tokens == len(ids) and bytes(r.decoded) == (r.text or "").encode()
        assert r["a.b"] == "x"
    assert bpe.bpe_encode(df.limit(0), model).count() == 0


# 2: SimHash


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=100, deadline=None)
@given(st.one_of(st.none(), st.text(alphabet="aAbÉ \t\x0b c", max_size=60)))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_fingerprint_in_blocks(monkeypatch):
    want = simhash.fingerprint(LONG)
    monkeypatch.setattr(simhash, "BLOCK_BYTES", 10)
    monkeypatch.setattr(simhash, "BLOCK_WORDS", 7)
    assert simhash.fingerprint(LONG) == want == brute_fingerprint(LONG)


@pytest.mark.parametrize("hot", [1, 48])
def test_components(spark, hot):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.int64).tolist()
    fps = []
    for b in base:  # chains of fingerprints, one or two bits apart, that wander off
        now = b
        for _ in range(int(rng.integers(1, 12))):
            fps.append(now)
            for bit in rng.choice(64, int(rng.integers(1, 3)), replace=False):
                now ^= (1 << int(bit)) if bit < 63 else -(1 << 63)
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = {r.node: r.root for r in simhash.components(simhash.links(df, hot)).collect()}
    assert {f: found.get(f, f) for f in fps} == {f: find(f) for f in fps}


def test_near_duplicates_of_odd_rows(spark):
    df = spark.createDataFrame([(*r, "src") for r in ODD], SCHEMA + ", fp string")
    rows = simhash.near_duplicates(df).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    assert by[2].fp == by[3].fp == by[4].fp == 0 and by[2].component_id == by[3].component_id == by[4].component_id == 2
    assert by[5].component_id == 5 and by[None].component_id is None and by[8].component_id == 8
    assert simhash.near_duplicates(df.limit(0)).count() == 0


# 3: licenses


def brute_licenses(text, templates):
    def shingles(t):
        w = [x for x in re.split("[^a-z0-9]+", (t or "").lower()) if x]
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    own = shingles(text)
    out = {}
    for name, t in templates.items():
        s = shingles(t)
        if s and len(s & own) >= 0.8 * len(s):
            out[name] = len(s & own)
    return out


def test_licenses(spark):
    t = licenses.TEMPLATES
    edited = t["BSD-2-Clause"].replace("source and binary", "any sort of").replace("disclaimer in the", "disclaimer within the")
    texts = [r[1] for r in ODD] + [f"before the text {x} and after it" for x in t.values()] + ["x " * 999 + t["MIT"].upper(), t["MIT-notice"], "the MIT License", edited, "", "Released under the"]
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(texts)], "doc_id long, text string, license int")
    found = {}
    for r in licenses.scan(df, licenses.template_table(spark)).collect():
        assert found.setdefault(r.doc_id, {}).setdefault(r.license, r.n_found) == r.n_found and r.containment == r.n_found / r.n_shingles
    assert found == {i: b for i, x in enumerate(texts) if (b := brute_licenses(x, t))}
    assert licenses.scan(df, licenses.template_table(spark, {})).count() == 0 and licenses.scan(df.limit(0), licenses.template_table(spark)).count() == 0


def test_whole_license_texts(spark, tmp_path):
    t = licenses.whole_templates()
    assert len(licenses.anchors(list(t.values()))) > licenses.MOST_ANCHORS  # the scan does without its first filter
    names = ["MPL-2.0-text", "LGPL-2.1-text", "BSD-3-Clause-text", "GPL-3-text", "MPL-2.0-notice", "LGPL-2.1-or-later-notice", "AGPL-3.0-or-later-notice", "EPL-2.0-notice", "CC-BY-4.0-notice", "CC-BY-SA-4.0-notice", "Unlicense"]
    texts = [f"before {t[n]} after" for n in names] + ["no license here", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {}
    for r in QUERIES["op3_licenses_whole"](spark, str(tmp_path)).collect():
        found.setdefault(r.doc_id, {})[r.license] = r.n_found
    assert found == {i: b for i, x in enumerate(texts) if (b := brute_licenses(x, t))}
    assert all(n in found[i] for i, n in enumerate(names))


def test_license_scan_has_no_python(spark):
    plan = licenses.scan(spark.createDataFrame([(1, "x")], SCHEMA), licenses.template_table(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan


# 4: token files


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(0, 300), max_size=200), max_size=6))
def test_rans(blocks):
    arrays = [np.array(b, np.uint32) for b in blocks]
    table = rans.FrequencyTable.from_counts(np.bincount(np.concatenate([*arrays, np.zeros(0, np.uint32)]).astype(np.int64), minlength=301))
    back = rans.decode_blocks(rans.encode_blocks(arrays, table), table)
    assert [b.tolist() for b in back] == blocks


def test_rans_large_and_damaged():
    rng = np.random.default_rng(1)
    blocks = [(rng.zipf(1.3, n) % 5000).astype(np.uint32) for n in (1, 8191, 8192, 8193, 70_001)] + [np.zeros(30_000, np.uint32)]
    table = rans.FrequencyTable.from_counts(np.bincount(np.concatenate(blocks), minlength=5000))
    payloads = rans.encode_blocks(blocks, table)
    assert all((a == b).all() for a, b in zip(rans.decode_blocks(payloads, table), blocks, strict=True))
    assert rans.decode_blocks([payloads[2]], table)[0].tolist() == blocks[2].tolist()
    for i in range(0, len(payloads[1]), 997):
        bad = payloads[1][:i] + bytes([payloads[1][i] ^ 4]) + payloads[1][i + 1 :]
        with pytest.raises(ValueError):
            rans.decode_blocks([bad], table)
    with pytest.raises(ValueError):
        rans.encode_blocks([np.array([7], np.uint32)], rans.FrequencyTable.from_counts(np.array([1, 1])))
    one = rans.FrequencyTable.from_counts(np.array([0, 5, 0]))
    assert rans.decode_blocks(rans.encode_blocks([np.array([1, 1, 1], np.uint32)], one), one)[0].tolist() == [1, 1, 1]


_codec, _library = token_file.LibraryCodec(JSON, public_tokenizers.PATTERN), Tokenizer.from_file(JSON)
_PARTS = ["a", "word", " ", "  ", "\n", "\t ", " \n ", "\u00a0", "\u2003", "\x1c", "'s", "don't", "12", "?!", "<|endoftext|>", "<|endoftext|", "|>", "\u00e9t\u00e9", "\u4f60\u597d", "\U0001f600", "\x00", "\x85"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(_PARTS), max_size=30).map("".join), max_size=5))
def test_codec_equals_the_library(texts):
    """Whole texts by the library as it comes, its added token included."""
    found = [np.frombuffer(x, _codec.kind).tolist() for x in _codec.encode(texts)]
    assert found == [_library.encode(t, add_special_tokens=False).ids for t in texts]


def test_codec_of_long_and_odd_texts(monkeypatch):
    monkeypatch.setattr(token_file, "GROUP_CHARS", 40)
    texts = [None, "", "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>", "one two  three \n four " * 30, " ".join(["x" * 50, "y"]), "tail ", "tail  ", "\n "]
    found = [np.frombuffer(x, _codec.kind).tolist() for x in _codec.encode(texts)]
    assert found == [_library.encode(t or "", add_special_tokens=False).ids for t in texts]
    _codec.known.clear()
    assert found == [np.frombuffer(x, _codec.kind).tolist() for x in _codec.encode(texts)]


def _split(texts):
    data = np.frombuffer(b"".join(t.encode() + pieces.CLOSE for t in texts), np.uint8)
    starts = _codec.runs.starts(data).tolist()
    found = [data[i:j].tobytes() for i, j in zip(starts, [*starts[1:], len(data)], strict=False)]
    ends = [i for i, p in enumerate(found) if p == pieces.CLOSE]
    return [[p.decode() for p in found[i:j]] for i, j in zip([0, *(e + 1 for e in ends)], ends, strict=False)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*_PARTS, "'", "'ll", "'r", "'re", "'m", "s", "d", "\u3000", "\U0001d7d8"]), max_size=12).map("".join), max_size=5))
def test_runs_are_the_matches_of_the_pattern(texts):
    assert _split(texts) == [regex.findall(public_tokenizers.PATTERN, t) for t in texts]


def test_runs_of_every_character():
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["".join(f"{c}a {c}{c} 1{c}.{c}" for c in points[i : i + 2000]) for i in range(0, len(points), 2000)]
    assert _split(texts) == [regex.findall(public_tokenizers.PATTERN, t) for t in texts]


def test_codec_looks_up_distinct_pieces_only():
    """What op4_token_file spends on a text: a look-up for each distinct piece of many texts, not for each piece."""

    class Counted(dict):
        n = 0

        def get(self, *args):
            self.n += 1
            return super().get(*args)

    codec = token_file.LibraryCodec(JSON, public_tokenizers.PATTERN)
    codec.known = Counted()
    texts = ["the same few words again\n" * 1000] * 20
    found = codec.encode(texts)
    assert [np.frombuffer(x, codec.kind).tolist() for x in found] == [_library.encode(t, add_special_tokens=False).ids for t in texts]
    assert codec.known.n < 50


@pytest.mark.parametrize("group", [12, 10**6])
@pytest.mark.parametrize("more", [0, 2, 9])
def test_codec_of_many_added_tokens_and_cut_texts(monkeypatch, tmp_path, group, more):
    monkeypatch.setattr(token_file, "GROUP_CHARS", group)
    library = Tokenizer.from_file(JSON)
    library.add_tokens(["<a>", "<a> b", *(f"<{i}>" for i in range(9))][:more])
    library.save(str(tmp_path / "own.json"))
    codec = token_file.LibraryCodec(str(tmp_path / "own.json"), public_tokenizers.PATTERN)
    assert bool(codec.marks) == (more < 9)
    draw = random.Random(5)
    texts = ["".join(draw.choices([*_PARTS, "<a>", " b", "<3>", "'ll"], k=draw.randrange(40))) for _ in range(300)]
    assert [np.frombuffer(x, codec.kind).tolist() for x in codec.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("group", [30, 10**6])
def test_codec_of_another_pattern(monkeypatch, group):
    monkeypatch.setattr(token_file, "GROUP_CHARS", group)
    pattern = r"\s+|\S+"
    codec, library = token_file.LibraryCodec(JSON, pattern), Tokenizer.from_file(JSON)
    library.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    texts = ["it's one  two\n", "", "caf\u00e9 \u4f60\u597d " * 9, "a<|endoftext|> b"]
    assert [np.frombuffer(x, codec.kind).tolist() for x in codec.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    ids, sizes = codec.flat(texts, np.array([7], codec.kind).tobytes())
    assert sizes.tolist() == [len(library.encode(t, add_special_tokens=False).ids) + 1 for t in texts]
    assert (ids[np.cumsum(sizes) - 1] == 7).all()


@pytest.mark.parametrize("partitions", [0, 5])
def test_token_file(spark, partitions, monkeypatch):
    monkeypatch.setattr(token_file, "BLOCK_IDS", 50)
    library = Tokenizer.from_file(JSON)
    rows = ODD + [(i, f"text number {i}") for i in range(-3, 40)]
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA + ", start int")
    df = df.repartition(partitions) if partitions else df
    folder = token_file.write_tokens(df, new_path(spark, "test"), JSON, public_tokenizers.PATTERN)
    found = sorted(token_file.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    assert [(r.id is not None, r.id or 0) for r in found] == sorted((d is not None, d or 0) for d, _ in rows)
    texts = {}
    for d, t in rows:
        texts.setdefault(d, []).append(library.encode(t or "", add_special_tokens=False).ids + [0])
    at = 0
    for r in found:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert r.start == at and ids in texts[r.id]
        texts[r.id].remove(ids)
        at += len(ids)
    empty = token_file.write_tokens(df.limit(0), new_path(spark, "test"), JSON, public_tokenizers.PATTERN)
    assert token_file.read_tokens(spark, empty).count() == 0


def test_token_file_of_ordered_parts(spark, tmp_path):
    for n in range(3):
        spark.createDataFrame([(10 * n + i, f"some text {n} {i}") for i in range(10)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    folder = token_file.write_tokens(spark.read.parquet(str(tmp_path / "docs")), new_path(spark, "test"), JSON, public_tokenizers.PATTERN)
    found = sorted(token_file.read_tokens(spark, folder).collect(), key=lambda r: r.id)
    assert [r.id for r in found] == list(range(30))
    assert [r.start for r in found] == np.cumsum([0] + [len(r.ids) // 4 for r in found])[:-1].tolist()
    # parts that are apart, but not in order within
    spark.createDataFrame([(90 - i, f"later {i}") for i in range(10)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    folder = token_file.write_tokens(spark.read.parquet(str(tmp_path / "docs")), new_path(spark, "test"), JSON, public_tokenizers.PATTERN)
    found = sorted(token_file.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    assert [r.id for r in found] == [*range(30), *range(81, 91)]


# 6: decontamination


def brute_hits(text, items, window):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own, hit, found = words(text), set(), set()
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            phrase = w[k : k + window]
            for at in range(len(own) - len(phrase) + 1):
                if own[at : at + len(phrase)] == phrase:
                    hit |= set(range(at, at + len(phrase)))
                    found |= {i} - {None}
    return len(own), len(hit), sorted(map(str, found))


@pytest.mark.parametrize("shard", [7, 2_000_000])
def test_decontamination(spark, monkeypatch, shard):
    rng = np.random.default_rng(4)
    word = lambda: "abcdéZ9"[rng.integers(7)]
    docs = [(i, " ".join(word() for _ in range(int(rng.integers(0, 80))))) for i in range(40)] + ODD + [(99, "a a a a a a a a a a")]
    items = [(i, " ".join(word() for _ in range(int(rng.integers(0, 8))))) for i in range(60)] + [(61, None), (62, "!!"), (None, "b c b c"), (63, "a a a"), (63, "a a a")]
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard)
    df, bench = spark.createDataFrame([(*r, "x") for r in docs], SCHEMA + ", spans string"), spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.find_phrases(df.coalesce(2), bench, window=4).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, hits, found = brute_hits(r.text, items, 4)
        assert (r.n_words, sum(s.stop - s.start for s in r.spans), sorted(map(str, r["items"]))) == (n, hits, found)
    monkeypatch.setattr(decontaminate, "BENCHMARK_BLOCK", 150)  # the same in several passes
    blocks = decontaminate.find_phrases(df, bench, window=4).collect()
    key = lambda r: (r.text or "", str(r.doc_id), r.n_words, [tuple(s) for s in r.spans], sorted(r["items"]))
    assert sorted(map(key, blocks)) == sorted(map(key, rows))
    cut = {(r.doc_id, r.n_words): r.text for r in decontaminate.find_phrases(df, bench, window=4, cut=True).collect()}
    for r in rows:
        if not r.spans:
            assert cut[r.doc_id, r.n_words] == r.text
    assert decontaminate.find_phrases(df, bench.limit(0)).where("size(spans) > 0").count() == 0
    assert decontaminate.find_phrases(df.limit(0), bench).count() == 0


def test_cutting_a_passage():
    assert decontaminate.without_spans("Keep, this (and that) x!", [(1, 3)]) == "Keep,  that) x!"
    assert decontaminate.without_spans("a b", [(0, 2)]) == ""


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=40), st.lists(st.integers(1, 4), min_size=1, max_size=5))
def test_fm_index(text, phrase):
    symbols = np.array([*text, 0], np.int64)
    index = fm_index.FmIndex(symbols)
    low, high = index.search(np.array([phrase]), np.array([len(phrase)]))
    at = sorted(index.locate(np.arange(low[0], max(low[0], high[0]))).tolist())
    assert at == [i for i in range(len(text) - len(phrase) + 1) if text[i : i + len(phrase)] == phrase]


# 7: toxicity


def test_folding_and_exceptions():
    assert toxicity.fold("1D10T idïot іdiоt ｉｄｉｏｔ id​iot") == "idiot idiot idiot idiot idiot"
    lexicon = toxicity.Lexicon({"trash ": 2.0, "mor": 1.0, "moron ": 3.0})
    assert lexicon.match("Trash! a MORON, mortal, a trash can. untrash trashy m0r0n") == (2 + 3 + 1 + 3, 4)
    assert lexicon.match(None) == lexicon.match("") == (0.0, 0) and toxicity.Lexicon({}).match("trash") == (0.0, 0)


def test_matching_in_windows(monkeypatch):
    lexicon = toxicity.Lexicon({"moron ": 1.0})
    text = "some moron said " * 50
    want = lexicon.match(text)
    monkeypatch.setattr(toxicity, "WINDOW", 64)
    assert lexicon.match(text) == want == (50.0, 50)


def _plain_match(text: str, weights: dict[str, float], exceptions: tuple[str, ...]) -> tuple[float, int]:
    """Every entry tried at every beginning of a word."""
    f = toxicity.fold(text)
    begins = [i for i in range(len(f)) if i == 0 or not f[i - 1].isalnum()]
    ends = lambda i: i == len(f) or not f[i].isalnum()
    free = [(i, i + len(p)) for i in begins for p in map(toxicity.fold, exceptions) if f.startswith(p, i) and ends(i + len(p))]
    total, count = 0.0, 0
    for i in begins:
        fit = [w for k, w in weights.items() if f.startswith(k.strip(), i) and (not k.endswith(" ") or ends(i + len(k.strip())))]
        if fit and not any(a <= i < b for a, b in free):
            total, count = total + max(fit), count + 1
    return total, count


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["trash", "can", "cans", "tr4sh", "bin", "a", "trashy", " ", "  ", "-", "!", "Çan", "\u0301"]), max_size=25), st.integers(1, 12))
def test_matching_against_brute_force(parts, window):
    """Also with phrases that windows cut."""
    weights, exceptions = {"trash ": 2.0, "tra": 1.0, "can ": 0.5, "bin": 4.0}, ("trash can", "a trash can bin", "can")
    lexicon, text = toxicity.Lexicon(weights, exceptions), " ".join(parts)
    want = _plain_match(text, weights, exceptions)
    assert lexicon.match(text) == want
    before, toxicity.WINDOW = toxicity.WINDOW, window
    try:
        assert lexicon.match(text) == want
    finally:
        toxicity.WINDOW = before


def test_toxicity_of_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0


def test_toxicity_of_held_out_rows(spark):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    bad = ["wretch", "fool", "zounder"]
    docs, labels = [], []
    for i in range(800):
        t = [words[k] for k in rng.integers(0, 300, 40)]
        if i % 5 == 0:
            for _ in range(3):
                t.insert(int(rng.integers(0, len(t))), bad[int(rng.integers(3))] + ("s" if i % 2 else ""))
        docs.append((i, " ".join(t)))
        labels.append((i, 0, int(i % 5 == 0)))
    df = spark.createDataFrame([(*r, 9.0) for r in docs + ODD], SCHEMA + ", score double")
    lab = spark.createDataFrame([*labels, (None, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df, lab)
    assert {"wretch", "fool"} <= {k.strip()[:6] for k in model.lexicon.weights}
    rows = toxicity.score(df, model).withColumn("held", toxicity.held_out()).collect()
    assert len(rows) == len(docs) + len(ODD) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    held = [r for r in rows if r.held and r.doc_id is not None and r.doc_id > 9]
    assert np.mean([r.predicted == int(r.doc_id % 5 == 0) for r in held]) > 0.98
    none = toxicity.score(df, toxicity.fit(df, lab.limit(0))).collect()
    assert {r.predicted for r in none} == {0}


# 10: language identification


def test_kneser_ney_sums_to_one():
    grams = [langid._grams(["abracadabra abba", "cab"])[0], langid._grams(["xyz zyx xyzzy"])[0]]
    model = langid.Model(["a", "b"], [np.unique(g, return_counts=True) for g in grams])
    alphabet = np.append(np.unique(np.concatenate(grams) & np.uint64(0xFFFF)), np.uint64(ord("ñ")))  # the last: all that no text has
    for context in ("abr", "xyz", "qqq"):
        packed = np.uint64(0)
        for c in context:
            packed = packed << np.uint64(16) | np.uint64(ord(c))
        keys = (packed << np.uint64(16)) | alphabet
        p = np.exp(model._score(keys, langid.ORDER).astype(float))
        assert np.allclose(p.sum(axis=0), 1, atol=1e-6) and (p > 0).all()


def _plain_kneser_ney(texts: list[str], alphabet: int, order: int = 4):
    """Probability of a symbol behind its context, by the definition and with dictionaries."""
    symbols = []
    for t in texts:
        line = "\0\0\0"
        for c in " " + t.lower() + " ":
            c = c if c.isalpha() else " "
            line += "" if c == line[-1] == " " else c
        symbols.append(line)
    counts = {order: {}}
    for line in symbols:
        for i in range(order - 1, len(line)):
            if line[i] != "\0":
                g = line[i - order + 1 : i + 1]
                counts[order][g] = counts[order].get(g, 0) + 1
    for o in range(order - 1, 0, -1):
        counts[o] = {}
        for g in counts[o + 1]:
            counts[o][g[1:]] = counts[o].get(g[1:], 0) + 1

    def prob(gram: str) -> float:
        if not gram:
            return 1 / (alphabet + 1)
        table = counts[len(gram)]
        once, twice = (sum(n == k for n in table.values()) for k in (1, 2))
        d = min(0.95, max(0.1, once / max(1.0, once + 2.0 * twice)))
        same = [n for g, n in table.items() if g[:-1] == gram[:-1]]
        if not same:
            return prob(gram[1:])
        return max(table.get(gram, 0) - d, 0) / sum(same) + d * len(same) / sum(same) * prob(gram[1:])

    return symbols, prob


def test_kneser_ney_against_its_definition(spark):
    texts = {"xx": ["banana bandana", "An apple, a day!", "aaa"], "yy": ["zig zag zigzag", "été à la plage"]}
    alphabet = len({c if c.isalpha() else " " for ts in texts.values() for t in ts for c in t.lower()} | {" "})
    df = spark.createDataFrame([(k, t) for k, ts in texts.items() for t in ts], "lang string, text string")
    grams = [np.unique(np.concatenate([langid._grams([t])[0] for t in texts[k]]), return_counts=True) for k in ("xx", "yy")]
    asked = ["banana zag", "plage ñandu", "", "b"]
    for model in (langid.fit(df), langid.Model(["xx", "yy"], grams)):
        found = model.entropies(asked)[0]
        for k, lang in enumerate(("xx", "yy")):
            _, prob = _plain_kneser_ney(texts[lang], alphabet)
            for i, t in enumerate(asked):
                line = _plain_kneser_ney([t], 1)[0][0]
                want = [-np.log(prob(line[j - 3 : j + 1])) for j in range(3, len(line))] if t else [0.0]
                assert np.isclose(found[i, k], np.mean(want), atol=1e-4), (t, lang)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("abé \n1.\0"), max_size=60), max_size=4), st.integers(1, 9))
def test_pieces_change_nothing(texts, size):
    grams = [np.unique(langid._grams([t])[0], return_counts=True) for t in ("abab ba", "bé éa ")]
    model = langid.Model(["x", "y"], grams)
    whole = model.entropies(texts)
    before, langid.PIECE = langid.PIECE, size
    try:
        parts = model.entropies(texts)
    finally:
        langid.PIECE = before
    assert np.allclose(parts[0], whole[0], atol=1e-6) and (parts[1] == whole[1]).all() and (parts[2] == whole[2]).all()


def test_other_languages_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fitted(docs.where("lang in ('de', 'en', 'fr')"))
    rows = langid.identify(docs.where("text is not null"), model).select("lang", "rejected", F.length("text").alias("n")).collect()
    own = [r.rejected for r in rows if r.lang in ("de", "en", "fr")]
    other = [r.rejected for r in rows if r.lang == "es" and r.n > 200]
    assert sum(own) <= 0.01 * len(own) and len(other) > 10 and sum(other) > 0.8 * len(other)



def test_hash_array():
    keys = np.unique(np.random.default_rng(2).integers(0, 2**63, 5000).astype(np.uint64))
    table = langid.HashArray(keys)
    at = table.find(keys)
    assert (at >= 0).all() and (keys[table.order][at] == keys).all()
    assert (table.find(keys + np.uint64(1)) < 0).sum() >= len(keys) - 2
    assert (langid.HashArray(np.zeros(0, np.uint64)).find(keys) < 0).all()


def test_language_of_held_out_rows(spark, monkeypatch):
    rng = np.random.default_rng(1)
    syllables = {"xx": ["ka", "to", "mi", "ru", "se"], "yy": ["schl", "ber", "ung", "ein", "pf"], "zz": ["ção", "lha", "dor", "que", "é"]}
    docs = []
    for i in range(300):
        lang = "xyz"[i % 3] * 2
        docs.append((i, " ".join("".join(rng.choice(syllables[lang], 3)) for _ in range(20)), lang))
    odd = [(1000 + i if d is not None else None, t, None) for i, (d, t) in enumerate(ODD)] + [(2000, "12345 !!", "xx")]
    df = spark.createDataFrame([(*r, "p") for r in docs + odd], "doc_id long, text string, lang string, rejected string")
    model = langid.fitted(df)
    rows = langid.identify(df, model).withColumn("held", langid.held_out()).collect()
    assert len(rows) == len(docs) + len(odd)
    for r in rows:
        assert 0 <= r.score <= 1
        if r.doc_id is not None and r.doc_id < 300:
            assert r.lang_pred == r.lang and not r.rejected and r.held == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if not any(c.isalpha() for c in r.text or ""):
            assert r.lang_pred == "und" and r.score == 0 and r.rejected
    want = {r.doc_id: r.lang_pred for r in rows if r.doc_id is not None and r.doc_id < 300}
    none = langid.identify(df, langid.fitted(df.limit(0))).collect()
    assert {r.lang_pred for r in none} == {"und"}
    texts = [t for _, t, _ in docs[:6]]
    monkeypatch.setattr(langid, "PIECE", 40)
    assert model.predict(texts)[0] == [want[i] for i in range(6)]


def test_language_model_keeps_all_grams(spark, monkeypatch):
    rng = np.random.default_rng(4)
    texts = [("xy"[i % 2], "".join(rng.choice(list("abcdefghijklmnop qrstuvwxyzéß"), 400))) for i in range(60)]
    df = spark.createDataFrame(texts, "lang string, text string")
    grams = [np.unique(np.concatenate([langid._grams([t])[0] for x, t in texts if x == lang]), return_counts=True) for lang in "xy"]
    assert sum(len(k) for k, _ in grams) > 20_000 and all((n == 1).mean() > 0.9 for _, n in grams)
    want = langid.Model(["x", "y"], grams)
    monkeypatch.setattr(langid, "MOST_GRAMS", 5_000, raising=False)  # the bound that once was
    asked = [t for _, t in texts[:5]] + ["unseen word of ñ", "", None]
    whole = want.entropies(asked)[0]
    for values in (4_000_000, 20_000):
        monkeypatch.setattr(langid, "SHARD_VALUES", values, raising=False)
        model = langid.fit(df)
        assert np.allclose(model.entropies(asked)[0], whole, atol=1e-5)
        assert (len(model.shards) > langid.KEPT_SHARDS) == (values == 20_000)
        found = langid.identify(spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "id long, text string"), model).collect()
        assert [r.lang_pred for r in sorted(found, key=lambda r: r.id)] == want.predict(asked)[0]


def test_calibration_takes_all_distinct_texts(spark):
    rng = np.random.default_rng(6)
    made = [("xy"[i % 2] * 2, " ".join("".join(rng.choice(["kat", "omi", "rus"] if i % 2 else ["sch", "ber", "ung"], 3)) for _ in range(12))) for i in range(40)]
    df = spark.createDataFrame(made, "lang string, text string")
    model = langid.fit(df)
    # one text's copies have the least hash and alone fill any bounded sample
    least = df.orderBy(F.xxhash64("text")).first()
    copies = spark.range(3000).select(F.lit(least.lang).alias("lang"), F.lit(least.text).alias("text"))
    usual = langid.calibrate(model, df.unionByName(copies)).usual
    h = dict(zip([t for _, t in made], model.entropies([t for _, t in made])[0].min(axis=1), strict=True))
    assert set(usual) == {"xx", "yy"}
    for lang, (mean, sd) in usual.items():
        own = [h[t] for t in {t for x, t in made if x == lang}]
        assert np.isclose(mean, np.mean(own)) and np.isclose(sd, np.std(own)) and sd > 0


def test_digests_are_of_little_endian_ids(merges):
    packed = bpe.TextCodec(merges, public_tokenizers.PATTERN).encode("hello world")
    assert packed == struct.pack("<2I", *merges.encode(b"hello"), *merges.encode(b" world"))
    assert len(hashlib.sha256(packed).hexdigest()) == 64
