"""Top-k search, chat formatting, WARC and the pipeline against brute force on small tables with odd rows."""

import base64
import gzip
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tidelog.llm import bpe, chat, langid, simhash, topk, toxicity, warc
from tidelog.llm.common import new_path

# 5: top-k


def brute_topk(rows, queries, k):
    ok = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    width = max({len(v) for _, v in ok}, key=lambda n: (sum(len(v) == n for _, v in ok), -n)) if ok else 0
    ok = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in ok if len(v) == width]
    out = []
    for qi, q in ok:
        if qi in queries:
            scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), i) for i, v in ok if i != qi)[:k]
            out += [(qi, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize(("count", "k"), [(0, 3), (4, 10), (300, 3), (900, 10)])
def test_topk(spark, monkeypatch, count, k):
    monkeypatch.setattr(topk, "BLOCK", 32)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    monkeypatch.setattr(topk, "PIVOTS", 6)
    rng = np.random.default_rng(count)
    centres = rng.normal(size=(5, 8))
    rows = [(i, (centres[i % 5] * rng.uniform(0.5, 2) + rng.normal(size=8) * 0.2).tolist()) for i in range(count)]
    for i in range(0, count, 3):
        rows[i] = (i, [0.25] * 8)  # a third are equal
    if count:
        rows += [(10_000, None), (10_001, []), (10_002, [float("nan")] * 8), (10_003, [float("inf")] * 8), (10_004, [None] * 8), (None, [0.1] * 8), (10_005, [0.5])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, id int")
    index = topk.Index(df, k)
    found = topk.search(index, index.rows.where(F.col("id") % 10 == 0))
    assert sorted(tuple(r) for r in found.collect()) == brute_topk(rows, set(range(0, count, 10)), k)


def test_topk_of_repeated_ids(spark):
    rows = [(i % 7, [float(i % 5), 1.0, float(i)]) for i in range(60)] + [(100, [9.0, 1.0, 59.0])] * 30
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    index = topk.Index(df, 4)
    found = topk.search(index, index.rows.where("id in (3, 100)").distinct())
    want = []
    whole = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows]
    for qi, q in {(i, tuple(v)) for i, v in whole if i in (3, 100)}:
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), i) for i, v in whole if i != qi)[:4]
        want += [(qi, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)


def test_topk_stops_early_on_clustered_vectors(spark):
    """Most annuli stay closed where vectors lie in clusters; the answers are exact all the same."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    rows = [(i, (centres[i % 40] + rng.normal(size=16) * 0.02).tolist()) for i in range(4000)]
    index = topk.Index(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 10)
    found = topk.search(index, index.rows.where(F.col("id") % 100 == 0), opened=True).collect()
    opened = {r.query_id: r.opened for r in found}
    assert index.annuli > 100 and len(opened) == 40 and np.mean(list(opened.values())) < 0.2 * index.annuli
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == brute_topk(rows, set(range(0, 4000, 100)), 10)


def test_topk_beside_a_huge_vector(spark):
    rows = [(i, [float(i % 11), float(i % 3)]) for i in range(50)] + [(1000, [4e6, 0.0]), (1001, [-1e200, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk.search(index := topk.Index(df, 3), index.rows.where("id in (0, 10)"))
    whole = [(i, [int(math.floor(1024 * x)) for x in v]) for i, v in rows]
    want = []
    for q in (0, 10):
        scored = sorted((-sum(a * b for a, b in zip(whole[q][1], v, strict=True)), i) for i, v in whole if i != q)[:3]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    assert sorted(tuple(r) for r in found.collect()) == want


def test_topk_of_large_vectors(spark):
    rows = [(i, [float(2 ** (9 + i % 7)) * (1 + i), float(i), 3.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = topk.Index(df, 5)
    assert index.top >= 2**53
    found = topk.search(index, index.rows.where(F.col("id") % 10 == 0))
    whole = [[math.floor(1024 * x) for x in v] for _, v in rows]
    want = []
    for q in range(0, 40, 10):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in enumerate(whole) if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    assert sorted(tuple(r) for r in found.collect()) == want


# 8: chat


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool]", "\\", "", None]), st.text(alphabet="<>/sINST[]\\ SYROLE:a", max_size=25)), max_size=4))
def test_rendered_turns_read_back(turns):
    out = "".join(chat.render(r, t)[0] for r, t in turns)
    assert [(r, t) for r, t, _, _ in chat.parse(out)] == [(r or "", t) for r, t in turns]
    assert all(chat.unescape(chat.escape(t)) == t for _, t in turns)


def test_chat_grammar():
    out, start, stop = chat.render("assistant", "</s>[INST] ok [/INST]")
    assert out == "<s> <\\/s>[\\INST] ok [\\/INST] </s>" and chat.unescape(out[start:stop]) == "</s>[INST] ok [/INST]"
    for bad in ("x", "[INST] a", "[INST] a </s> [/INST]", "<s> a </s>x"):
        with pytest.raises(chat.Ungrammatical):
            list(chat.parse(bad))


@pytest.mark.parametrize("part", [40, 1 << 20])
def test_conversations(spark, monkeypatch, part):
    monkeypatch.setattr(chat, "PART", part)
    rows = [(c, t, ["system", "user", "assistant"][t % 3], f"text {c} {t} é [INST] </s>") for c in range(12) for t in range(c)]
    rows += [(7, 99, "assistant", None), (7, None, "user", ""), (None, 0, "user", "no id"), (3, 0, None, "no role"), (3, 0, None, "no role"), (500, 0, "assistant", "x" * 3000)]
    rows += [(77, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(300)]  # one long conversation
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, part string")
    found = {r.conv_id: r for r in chat.read_back(chat.format_conversations(chat.planted(df))).collect()}
    said = "</s>[INST] ok [/INST]"
    want = {}
    for r in [*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)]:
        want.setdefault(r[0], []).append(r)
    assert set(found) == set(want)
    low = lambda v: (v is not None, v if v is not None else 0)
    for conv, turns in want.items():
        turns.sort(key=lambda r: (low(r[1]), (r[2] is not None, r[2] or ""), (r[3] is not None, r[3] or "")))
        digest = hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns).encode()).hexdigest()
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        f = found[conv]
        assert (f.n_turns, f.turns_sha256, f.loss_chars, f.loss_sha256) == (len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert f.formatted_chars == sum(len(chat.render(r[2], r[3])[0]) for r in turns)
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


# 9: WARC


def pages():
    rng = np.random.default_rng(8)
    rows = [(i, f"http://x/{i} a\r\nb", bytes(rng.integers(32, 127, int(rng.integers(0, 3000)), dtype=np.uint8)).decode()) for i in range(60)]
    rows += [(100 + i, None, "<p>same é</p>") for i in range(30)] + [(200, "u", None), (201, "u", ""), (100, "u", "<p>same é</p>"), (None, "u", "<p>same é</p>"), (None, None, "alone"), (300, "u", "ab"), (301, "u", "ab")]
    return rows


@pytest.mark.parametrize(("split", "least"), [(200, 0), (4096, 3), (1 << 27, 0)])
def test_warc(spark, split, least):
    rows = pages()
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    path = warc.write_warc(df, new_path(spark, "test"), least)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found = warc.read_warc(spark, path).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    least_of = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= least:
            least_of[html or ""] = min(i, least_of.get(html or "", i))
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        first = least_of.get(html or "")
        refers = first if first is not None and first != i else None
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if refers is None else "revisit", refers, data if refers is None else None))
    key = lambda r: str(r)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in found]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_warc_files_are_gzip_members(spark, tmp_path):
    df = spark.createDataFrame(pages()[:5], "page_id long, url string, html string").coalesce(1)
    warc.write_warc(df, str(tmp_path / "w"))
    data = b"".join(p.read_bytes() for p in (tmp_path / "w").glob("part-*"))
    text = gzip.decompress(data)
    assert text.count(b"WARC/1.1\r\n") == 5 and b"WARC-Type: response" in text
    assert warc.read_warc(spark, warc.write_warc(df.limit(0), str(tmp_path / "e"))).count() == 0


def false_magic() -> bytes:
    """A record whose compressed form holds the gzip magic (stored, not deflated), thrice."""
    data = warc.record(1, "u", b"x\x1f\x8b\x08y" * 3 + b"z" * 50)
    pack = zlib.compressobj(0, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


@pytest.mark.parametrize("split", [37, 64, 100, 1 << 20])
def test_false_magic_across_ranges(spark, tmp_path, split):
    one = false_magic()
    assert one.count(warc.MAGIC) == 4
    (tmp_path / "a.warc").write_bytes(one + warc.member(warc.record(2, "u", b"plain")) + one)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found = warc.read_warc(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted((r.page_id, bytes(r.payload)) for r in found) == sorted([(1, b"x\x1f\x8b\x08y" * 3 + b"z" * 50)] * 2 + [(2, b"plain")])


def magic_in_header(page_id: int, payload: bytes) -> bytes:
    """A record's member whose gzip header (a file name) holds the magic, so that its first piece decodes to nothing."""
    data = warc.record(page_id, "u", payload)
    pack = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = pack.compress(data) + pack.flush()
    return warc.MAGIC + b"\x08" + bytes(6) + b"na\x1f\x8b\x08me\x1f\x8b\x08\x04.\0" + body + zlib.crc32(data).to_bytes(4, "little") + len(data).to_bytes(4, "little")


@pytest.mark.parametrize("split", [7, 37, 100, 1 << 20])
def test_magic_before_a_record_decodes(spark, tmp_path, split):
    plain = [warc.member(warc.record(i, "u", b"plain %d" % i)) for i in range(3)]
    (tmp_path / "a.warc").write_bytes(plain[0] + magic_in_header(7, b"seven") + false_magic() + magic_in_header(8, b"eight") + plain[1])
    (tmp_path / "b.warc").write_bytes(magic_in_header(9, b"nine") + plain[2] + magic_in_header(10, b"ten"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found = warc.read_warc(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = [(i, b"plain %d" % i) for i in range(3)] + [(1, b"x\x1f\x8b\x08y" * 3 + b"z" * 50), (7, b"seven"), (8, b"eight"), (9, b"nine"), (10, b"ten")]
    assert sorted((r.page_id, bytes(r.payload)) for r in found) == sorted(want)


def test_bytes_behind_a_record_are_an_error():
    data = warc.record(1, "u", b"p")
    assert warc.parse_record(data)[1].endswith(b"p")
    with pytest.raises(ValueError, match="longer"):
        warc.parse_record(data + warc.record(2, "u", b"q"))


def test_large_member_ends_in_zero():
    big = warc.member(bytes(17 << 20))
    assert big[-1] == 0 and warc._inflate(big) == bytes(17 << 20)


# The pipeline


def test_pipeline_against_its_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "", None, None, None), (None, "the and of", "en", "s", 10), (9003, "12 34", "en", "s", 5)], docs.schema)
    now = docs.unionByName(extra)
    rows = {r.doc_id: r for r in now.collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, sf)
        if name != "tokens":
            assert sorted(out.columns) == sorted(docs.columns)
        found = out.collect()
        ids = {r.doc_id for r in found}
        assert len(ids) == len(found)
        if name == "toxicity":
            bad = toxicity.Model(model.lexicon, model.curve)
            assert ids <= set(rows) and all((bad.scores([rows[i].text])[0][0] < 0.5) == (i in ids) for i in rows if i is None or i < 9000)
        elif name == "language":
            assert not {9001, 9002, 9003} & ids and None in ids
            assert all(re.search(r"[^\W\d_]", rows[i].text or "") for i in ids)
        elif name == "near_duplicates":
            prints = {}
            for r in before:
                prints.setdefault(simhash.fingerprint(r.text), []).append(r.doc_id)
            assert all(sum(i in ids for i in group) <= 1 for group in prints.values())
            assert all(any(((f ^ g).bit_count() <= 2) and set(prints[g]) & ids for g in prints) for f in prints)
        elif name == "decontamination":
            assert ids == {r.doc_id for r in before}
            assert all(r.n_chars == len(r.text) for r in found if r.text != rows[r.doc_id].text)
        else:
            library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
            texts = {r.doc_id: r.text or "" for r in before}
            assert all(r.same and r.n_tokens == len(library.encode_ordinary(texts[r.doc_id])) for r in found)
        before, now = found, out
    assert langid.UNKNOWN == "und"


@pytest.fixture(scope="module")
def odd_documents():
    """(doc_id, text, lang, source, n_chars, and columns with names that stages use): nulls, empty and long texts, repeated rows."""
    rows = [(i, f"word{i % 7} plain text number {i} of some language", "en" if i % 2 else "de", "s", 10) for i in range(30)]
    rows += [(None, None, None, None, None), (40, "", "en", "s", 0), (41, None, "en", "s", None), (42, "!! 12", None, None, 1), (43, "plain text of some language " * 20_000, "en", "s", 1)]
    rows += [(50, "the same row twice", "en", "s", 1)] * 3 + [(None, "no id", "en", "s", 1)] * 2
    names = ("row_key", "score", "rejected", "spans", "items", "predicted", "component_id", "fp", "n")
    kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    return [(*r, *names) for r in rows], kinds


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_of_odd_and_empty_tables(spark, odd_documents, name):
    stage, (rows, kinds) = dict(corpus_pipeline.STAGES)[name], odd_documents
    docs, sf = spark.createDataFrame(rows, kinds), "/root/testdata/sf0.001"
    found = stage(spark, docs, sf)
    got = sorted(((r.doc_id is not None, r.doc_id or 0) for r in found.collect()))
    ids = sorted((r[0] is not None, r[0] or 0) for r in rows)
    if name in ("toxicity", "decontamination", "tokens"):
        assert got == ids
    elif name == "language":
        assert set(ids) - set(got) == {(True, i) for i in (40, 41, 42)} and len(got) == len(ids) - 4
    else:  # the null and empty texts and the one without shingles of three are groups; of repeated rows one stays
        prints = {}
        for r in rows:
            prints.setdefault(simhash.fingerprint(r[1]), set()).add((r[0] is None, r[0] or 0))
        assert len(got) == len(set(got) | {None}) - 1 or got.count((False, 0)) <= 2
        for group in prints.values():
            assert sum((not a, b) in group for a, b in got) <= 2 and got.count((True, 50)) == 1
    if name != "tokens":
        assert found.columns == list(corpus_pipeline.COLUMNS)
    assert stage(spark, docs.limit(0), sf).count() == 0
