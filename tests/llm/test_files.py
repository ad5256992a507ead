"""Byte-level BPE, token files, WARC bundles, pages and the pipeline."""

import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from ruleloom.llm import queries
from ruleloom.llm.bpe import Codec, Transducer, decode_table, digest_table, encode_table, read_ranks
from ruleloom.llm.common import per_chunk
from ruleloom.llm.html_text import blocks, extract, synthetic_pages, train_labeller
from ruleloom.llm.near_dup import near_duplicates
from ruleloom.llm.token_files import SequenceFile, WordEncoder, read_tokens, write_tokens
from ruleloom.llm.toxicity import score_toxicity, train_toxicity
from ruleloom.llm.warc import Bundle, BundleWriter, parse, read_archive, record, write_archive
from tests.llm.test_text_operators import ODD, odd, shingles

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
BITS = ["a", "E", " ", "  ", "\n", "th", "ing", "é", "É", "ß", "İ", "Σ", "日本", "😀", "'s", "'S", "12", "...", "́", "\t", "\x0b", "\x1c", "ª", "×", "<|endoftext|>", "$%", "___"]


@pytest.fixture(scope="module")
def texts(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def strange(n=600, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(BITS) for _ in range(r.randint(0, 25))) for _ in range(n)]


def test_bpe_as_the_library(texts):
    codec = Codec.of(RANKS, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    for x in [*(t for _, t in texts), *strange(), "x" * 3000, "é" * 500]:
        ids = codec.encode(x)
        assert ids == library.encode_ordinary(x)
        assert codec.decode(ids) == x


def test_few_states_change_nothing(texts):
    ranks = read_ranks(RANKS)
    small, large = Transducer(ranks, max_moves=20, max_pieces=10, max_pairs=10), Transducer(ranks)
    for w in {w for _, t in texts[:20] for w in t.split()}:
        assert small.piece(w) == large.piece(w) == tuple(ranks[p] for p in large.merge(w.encode()))
        assert len(small.moves) < 20 + 100 and len(small.pieces) <= 10


def test_full_tables_are_small():
    """At a thirtieth of the default bounds 4 MB (9 with a tuple a state, an integer a token and every piece kept); words met once aren't kept."""
    r = random.Random(5)
    words = ["".join(r.choice("etaoinshrdlu") + r.choice(["th", "in", "er", "on", "ça", "x9"]) for _ in range(5)) for _ in range(12_000)]
    ranks = read_ranks(RANKS)
    tracemalloc.start()
    try:
        machine = Transducer(ranks, max_moves=20_000, max_pieces=10_000, max_pairs=20_000, max_heads=300)
        empty = tracemalloc.get_traced_memory()[0]
        once = [machine.piece(w) for w in words]
        assert len(machine.pieces) < 1000 and len(machine.heads) <= 300
        again = [machine.piece(w) for w in words]
        assert tracemalloc.get_traced_memory()[0] - empty < 6e6
    finally:
        tracemalloc.stop()
    assert len(machine.pieces) + len(machine.older) >= 10_000 and len(machine.moves) > 10_000
    assert once == again == [machine.run(w.encode()) for w in words]
    assert all(machine.run(w.encode()) == tuple(ranks[p] for p in machine.merge(w.encode())) for w in words[:500])


def test_workers_keep_one_operators_tables():
    codec = Codec.of(RANKS, public_tokenizers.PATTERN)
    list(per_chunk(lambda part: part, keeps=True)(iter([])))
    assert Codec.of(RANKS, public_tokenizers.PATTERN) is codec
    list(per_chunk(lambda part: part)(iter([])))
    assert Codec.of(RANKS, public_tokenizers.PATTERN) is not codec


def test_every_byte_is_read_by_a_transition(texts):
    """The transitions left behind spell every piece, and merging is only asked about single tokens."""
    machine = Transducer(read_ranks(RANKS))
    asked, merge = [], machine.merge
    machine.merge = lambda piece, least_parts=1: asked.append(piece) or merge(piece, least_parts)
    pieces = {w.encode() for _, t in texts for w in t.split()} | {b"x" * 500}
    tokens = {w: machine.run(w) for w in pieces}
    read = 0
    for w, ids in tokens.items():
        assert b"".join(map(machine.tokens.__getitem__, ids)) == w
        if w not in machine.ranks:
            state = 0
            for byte in w:
                state = machine.moves[state | byte] >> 20
                read += 1
    assert read > 10_000 and all(p in machine.ranks for p in asked)


def test_border_rule_is_what_merging_gives():
    machine = Transducer(read_ranks(RANKS))
    r = random.Random(3)
    words = [b" the", b"ing", b"ation", b"th", b"e", b"s", b"er", b"o", b" un", b"lock", b"ed", b"n", b"t"]
    pairs = [(machine.ranks[u], machine.ranks[t]) for u in words for t in words] + [(r.randrange(50256), r.randrange(50256)) for _ in range(5000)]
    for u, t in pairs:
        left, right = machine.tokens[u], machine.tokens[t]
        assert machine.may_follow(u, t) == (machine.merge(left + right) == [left, right]), (left, right)
    assert sum(machine.may_follow(u, t) for u, t in pairs) not in (0, len(pairs))


def test_stream_decoding():
    codec = Codec.of(RANKS, public_tokenizers.PATTERN)
    r = random.Random(2)
    for _ in range(300):
        ids = [r.randrange(50256) for _ in range(r.randint(0, 40))]
        cuts = sorted(r.randint(0, len(ids)) for _ in range(3))
        parts = [ids[a:b] for a, b in zip([0, *cuts], [*cuts, len(ids)], strict=True)]
        whole = b"".join(codec.transducer.tokens[i] for i in ids)
        assert codec.decode_bytes(ids) == whole and "".join(codec.stream(parts)) == whole.decode("utf-8", "replace")


def test_bpe_tables(spark):
    coded = encode_table(odd(spark), RANKS, public_tokenizers.PATTERN)
    back = decode_table(coded, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted(map(str, (r["text"] for r in back))) == sorted(str(t or "") for _, t in ODD)
    got = digest_table(odd(spark), RANKS, public_tokenizers.PATTERN).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(got) == len(ODD) and sum(r["n_tokens"] == 0 and r["ids_sha256"] == r["decoded_sha256"] == empty for r in got) == 2
    assert digest_table(odd(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def test_words_as_the_library(texts):
    library, encoder = Tokenizer.from_file(WORDS), WordEncoder.of(WORDS)
    every = [*(t for _, t in texts), *strange(seed=3), "", None]
    got = encoder.encode(every)
    want = library.encode_batch([x or "" for x in every], add_special_tokens=False)
    assert encoder.cuts
    assert all(np.frombuffer(a, encoder.dtype).tolist() == b.ids for a, b in zip(got, want, strict=True))


def test_token_files(spark, texts):
    rows = [*texts, (10**9, None), (-5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = write_tokens(docs, WORDS, length=64, partitions=3)
    got = {r["doc_id"]: r for r in read_tokens(spark, index).collect()}
    library, at = Tokenizer.from_file(WORDS), 0
    every = []
    for i, t in sorted(rows):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
        every += ids
    uris = [r["uri"] for r in index.select("part", "uri").distinct().orderBy("part").collect()]
    read = []
    for uri in uris:
        f = SequenceFile(uri)
        assert pa.types.is_fixed_size_list(f.batches[0].schema.field("ids").type)
        before = pa.total_allocated_bytes()
        parts = [(f.ids(i), f.mask(i)) for i in range(len(f))]
        assert pa.total_allocated_bytes() - before <= 4096 * len(f) and all(len(a) == len(m) == 64 for a, m in parts)
        assert all(m.all() for _, m in parts[:-1])
        read += [x for a, m in parts for x in a[m].tolist()]
        with pytest.raises(IndexError):
            f.ids(len(f))
    assert read == every


def test_token_files_odd(spark):
    index = write_tokens(odd(spark), WORDS)
    got = read_tokens(spark, index).collect()
    assert len(got) == len(ODD) and sum(r["n_tokens"] for r in got) == max(r["start"] + r["n_tokens"] for r in got)
    assert read_tokens(spark, write_tokens(odd(spark, []), WORDS)).count() == 0


def test_bundle_random_access(tmp_path):
    path, r = tmp_path / "a.warc.zst", random.Random(1)
    bodies = [r.randbytes(r.randint(0, 5000)) for _ in range(60)]
    with path.open("wb") as f:
        w = BundleWriter(f, frame_bytes=8000)
        places = [w.add(record(f"urn:x:{i}", f"http://e/{i}", b, hashlib.sha1(b).hexdigest())) for i, b in enumerate(bodies)]
        w.close()
    bundle = Bundle(str(path))
    assert len(bundle.frames) > 5
    for i in r.sample(range(60), 60):
        head, body = bundle.record(*places[i])
        assert head["WARC-Record-ID"] == f"<urn:x:{i}>" and body == bodies[i]
    import zstandard

    with path.open("rb") as f:  # any Zstandard reader passes over the seek table
        whole = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    assert parse(whole, 0)[1] == bodies[0]


def test_archive_keys_and_urls_of_any_characters(spark):
    body = "b" * 2000
    rows = [("a:1", "http://e/a b\r\nX-Fake: 1", body), ("a:2", None, body), ("k\r\nWARC-Type: revisit %3A<é>", "http://e/é?q=1&r=%20", "small"), (None, "u", body)]
    index = write_archive(spark.createDataFrame(rows, "page_id string, url string, html string"))
    got = {x["page_id"]: x for x in read_archive(index).collect()}
    assert set(got) == {k for k, _, _ in rows}
    assert got["a:2"]["record_type"] == "response" and got["a:1"]["refers_to"] == got[None]["refers_to"] == "a:2"
    for x in index.collect():
        head, _ = Bundle(x["uri"]).record(x["frame"], x["offset"])
        assert "X-Fake" not in head and not set(head["WARC-Target-URI"]) & set(" \r\n")
    assert "http://e/é?q=1&r=%20" in [x["url"] for x in index.collect()]


def test_archive_against_rows(spark):
    r = random.Random(2)
    bodies = ["x" * 1000, "y" * 999, "é" * 500, "z" * 5000, None, ""]
    rows = [(i, f"http://e/{i} b", r.choice(bodies)) for i in range(80)]
    got = {x["page_id"]: x for x in read_archive(write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"))).collect()}
    last = {}
    for i, _, b in rows:
        last[b] = i
    for i, _, b in rows:
        data = (b or "").encode()
        again = len(data) >= 1000 and last[b] != i
        assert (got[i]["payload_bytes"], got[i]["payload_digest"], got[i]["record_type"], got[i]["refers_to"]) == (len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", last[b] if again else None)
    none = spark.createDataFrame([(None, None, "q" * 2000), (1, None, "q" * 2000), (1, None, "q" * 2000), (None, "u", None)], "page_id long, url string, html string")
    assert read_archive(write_archive(none)).count() == 4
    assert read_archive(write_archive(none.limit(0))).count() == 0


def test_blocks():
    page = "<html><head><title>T</title><script>var a='<p>x</p>';</script></head><body><p>one &amp; two<br>three <b>bo</b>ld<p>four<ul><li>a<li>b</ul><!-- no --><style>p{}</style>&nbsp;end"
    assert [b.text for b in blocks(page)] == ["T", "one & two three bold", "four", "a", "b", "end"]
    assert blocks(None) == blocks("") == blocks("<!-- never closed <p>x") == [] and [b.text for b in blocks("plain < text")] == ["plain < text"]


def test_labeller_held_out():
    model = train_labeller()
    data = synthetic_pages(150, seed=77)
    wrong = [((z > 0) != y).any() for z, (_, y) in zip(model.logits([model.vectors(p) for p, _ in data]), data, strict=True)]
    assert np.mean(wrong) < 0.02


def test_gradients_are_right():
    from ruleloom.llm.html_text import Labeller

    model, data = Labeller(1), synthetic_pages(3, seed=4)
    pages, labels = [p for p, _ in data], [y for _, y in data]
    _, g = model.gradients(pages, labels)
    for k, i in (("wf", (3, 5)), ("wb", (20, 40)), ("out", (2,)), ("cf", (7,)), ("skip", (16,))):
        e = np.zeros_like(model.p[k])
        e[i] = 1e-5
        keep = model.p[k]
        model.p[k] = keep + e
        up, _ = model.gradients(pages, labels)
        model.p[k] = keep - e
        down, _ = model.gradients(pages, labels)
        model.p[k] = keep
        assert g[k][i] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_long_and_broken_pages_are_read_in_linear_time():
    import time

    def seconds(page):
        t = time.process_time()
        found = blocks(page)
        return time.process_time() - t, found

    shapes = {"stray quotes": "<p title=\"it's><b class='x\">text </p>", "nested": "<div class=a>t", "unclosed tags": "<a <b ", "declarations": "<! ", "open scripts": "<script ", "end tags": "<div></section>x"}
    for name, shape in shapes.items():
        few, _ = seconds(shape * 2_000)
        many, found = seconds(shape * 20_000)
        assert many < 40 * max(few, 0.02), (name, few, many)
    assert len(seconds("<div>t" * 5_000)[1]) == 5_000
    # A bracket in a quoted value is no end of the tag; text after a stray quote is kept.
    assert [b.text for b in blocks("<p title='a > b' id=\"x<1\">one</p><p title=\"oops>two</p>")] == ["one", "two"]


def test_pages_table(spark):
    import html as h
    import re

    for r in queries.op5_html_text(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(h.unescape(re.sub(r"<[^>]+>", " " if False else "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == " ".join(p for p in parts if p) and r["n_chars"] == len(r["text"])
    rows = spark.createDataFrame([(1, None, None, "t"), (1, "u", "", "t"), (None, "u", "<article><p>kept", "t")], "page_id long, url string, html string, text string")
    got = extract(rows).collect()
    assert sorted(r["text"] for r in got) == ["", "", "kept"] and extract(rows.limit(0)).count() == 0


def test_pipeline_against_plain_python(spark):
    """Every stage against its own operator or brute force over what its predecessor kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = train_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    left = {i for i, r in rows.items() if model.scores([r["text"]])[0] < 0.5}
    assert {r["doc_id"] for r in score_toxicity(docs, model).where("predicted = 0").collect()} == left
    from ruleloom.llm.quality import quality

    left &= {r["doc_id"] for r in quality(docs).where("kept").collect()}
    kept, seen = set(), {}
    part = docs.where(docs["doc_id"].isin(sorted(left)))
    for r in near_duplicates(part).collect():
        seen.setdefault(r["component_id"], set()).add(r["doc_id"])
    kept = {min(v) for v in seen.values()}
    items = [s for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if (s := shingles(r["text"], 5))]
    clean = {i for i in kept if not any(len(s & shingles(rows[i]["text"], 5)) >= 0.8 * len(s) for s in items)}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == clean
    assert all(r["decoded_sha256"] == hashlib.sha256(rows[i]["text"].encode()).hexdigest() for i, r in got.items())


def test_pipeline_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
