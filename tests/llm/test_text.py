"""Language ID, token shards, HTML text, top-k and WARC."""

import io
import os
import random
import re
import zlib
from types import SimpleNamespace

import numpy as np
import pytest

from lectorium.llm.html_text import extract, op7_html_text
from lectorium.llm.language_id import PpmModel, identify, op5_language_id, train
from lectorium.llm.tokens import _LEARNED, Encoder, PerfectHash, Shard, default_tokenizer, encoder, key_hash, op6_token_ids, read_tokens, write_tokens
from lectorium.llm.top_k import exact_top_k, op8_exact_top_k
from lectorium.llm.warc import digest32, member, op10_warc, page_record, read_records, read_warc, write_warc

SAMPLES = {"en": "the house of the people and the sea that they have seen with this other day", "de": "das haus der leute und die see die sie mit diesem anderen tag gesehen haben", "fr": "la maison des gens et la mer qu'ils ont vue avec cet autre jour"}


def labelled(n, rng):
    out = []
    for i in range(n):
        lang = rng.choice(list(SAMPLES))
        w = SAMPLES[lang].split()
        out.append((1000 + i, " ".join(rng.choice(w) for _ in range(rng.randint(5, 40))), lang, "a"))
    return out


def test_language_id(spark, store, odd_documents):
    rows = odd_documents + labelled(400, random.Random(1))
    got = op5_language_id(spark, store(rows)).collect()
    assert len(got) == len(rows)
    truth = {d: lang for d, _, lang, _ in rows if d is not None and d >= 1000}
    held = [r for r in got if r.doc_id is not None and r.doc_id >= 1000 and r.held_out]
    assert len(held) > 40 and np.mean([truth[r.doc_id] == r.lang_pred for r in held]) > 0.95
    for r in got:
        assert 0 <= r.score <= 1
        assert r.doc_id is None or r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.doc_id in (4, 5, 6, 7):
            assert (r.lang_pred, r.score) == ("und", 0)


def test_language_id_without_labels(spark, store):
    assert [r.lang_pred for r in op5_language_id(spark, store([(1, "some text", None, "a")])).collect()] == ["und"]
    assert op5_language_id(spark, store([])).count() == 0


def test_ppm_code_lengths_one_by_one():
    model = PpmModel.fit({k: [v.encode()] * 3 for k, v in SAMPLES.items()}, least=2)
    assert np.allclose(np.exp2(-model.bits.astype(float)).sum(axis=1), 1, atol=1e-4)  # a distribution after every context
    text = np.frombuffer("Übung der leute".encode(), np.uint8)
    s = [0, 0, 0, *model.symbol[text]]
    expected = sum(model.bits[model.state[(s[i - 3] * model.size + s[i - 2]) * model.size + s[i - 1]], s[i]] for i in range(3, len(s)))
    assert np.allclose(model.code_lengths([text])[0], expected, rtol=1e-4)
    long = np.tile(text, 60_000)
    whole = model.code_lengths([text, long, text])
    assert np.allclose(whole[0], whole[2]) and np.allclose(whole[1] / 60_000, whole[0], rtol=0.1)


def test_encoder_equals_the_library():
    enc, rng = encoder(default_tokenizer()), random.Random(3)
    alphabet = "aA zZ09'sSTtd \t\n\r\x0b\x0c\x1c\x1f\x85\xa0éÉßẞΣσİı<|endoftext|>.,!%é́中文ﬁ​☃\U0001f600"
    for _ in range(500):
        t = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) + rng.choice(["", "<|endoftext|>", "<|ENDOFTEXT|>", "IT'S we'LL"])
        assert enc.encode(t) == np.asarray(enc.tokenizer.encode(t, add_special_tokens=False).ids, enc.dtype).tobytes()


def test_learned_characters_are_parted_as_the_library_does():
    """Chunks of ASCII and learned characters need the library's model alone, and give its ids."""
    enc = Encoder(default_tokenizer())
    whole = enc.tokenizer
    texts = [f"{x}" for c in _LEARNED for x in (c, f"A{c}1{c.upper()}!", f"!{c}'s", f"{c}{c}", f"'{c}", f"{c}\u0301")] + ["L'ÉTÉ «naïve» straße—Ærø's €5…", "ЁЖ, жёлтый"]
    for t in texts:
        assert enc.encode(t) == np.asarray(whole.encode(t, add_special_tokens=False).ids, enc.dtype).tobytes()
    fresh = Encoder(default_tokenizer())
    fresh.tokenizer = SimpleNamespace(model=whole.model)
    assert all(fresh.encode(t) == enc.encode(t) for t in texts[-2:])


def test_token_ids_round_trip(spark, store, odd_documents):
    got = op6_token_ids(spark, store(odd_documents)).collect()
    enc, start, expected = encoder(default_tokenizer()), 0, []
    for d, t, *_ in sorted(odd_documents, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.asarray([*enc.tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        expected.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert op6_token_ids(spark, store([])).count() == 0


def test_shards_find_only_their_keys(spark, tmp_path):
    docs = spark.createDataFrame([(i * 3, f"text number {i}") for i in range(500)], "doc_id long, text string")
    manifest = write_tokens(docs, f"file://{tmp_path}", default_tokenizer(), 2, shard_rows=100)
    assert len(manifest) > 1 and sum(m["docs"] for m in manifest) == 500
    shard = Shard(manifest[0]["shard"])
    absent = key_hash(np.arange(10_000) * 3 + 1, np.zeros(10_000, bool), np.zeros(10_000, np.int64))
    assert (shard.find(absent) >= 0).sum() <= 1
    with pytest.raises(Exception, match="isn't in"):
        read_tokens(spark.createDataFrame([(4,)], "doc_id long"), manifest).collect()


def test_perfect_hash():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64)
    assert sorted(PerfectHash.build(keys).slots(keys)) == list(range(5000))


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><p>Site name and a long slogan of the site that has the words of the language in it for the reader</p></header><nav><ul><li><a href=1>Home</a></li></ul></nav><!-- <p>no</p> --><div class="cookie-notice">We use cookies.</div>
<article><header><h1>Title&nbsp;of
 it</h1></header><p>First &lt;para&gt; with <b>bold</b> <a href="x">link</a> text<br>next line<p>Short.<form><input>Send</form><div class="ad">Buy</div><p>Tom &#38; Ann</article>
<aside>See also</aside><section id="comments"><p>I think that the article is good and the best of all that I have read in the last year.</p></section><footer>&copy; us</footer></body></html>"""


def test_language_of_long_texts_only(spark):
    """A language whose labelled texts are all longer than the training slice is learned from slices."""
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(SAMPLES[k].split()) for _ in range(900 if k == "de" else 30)), k) for i, k in enumerate(["de", "en"] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = train(docs, max_chars=1000)
    assert model.languages == ["de", "en"]
    assert {r.doc_id: r.lang_pred for r in identify(docs, model).collect()} == {d: k for d, _, k in rows}


def test_html_text():
    assert extract(PAGE) == "Title of it\n\nFirst <para> with bold link text next line\n\nShort.\n\nTom & Ann"
    assert extract(None) == extract("") == extract("<p></p>") == extract("<!-- open") == extract("<script>x") == ""
    assert extract("<article><p>One<p>Two <b") == "One\n\nTwo"
    plain = "This is the text of a page that has no article and it is long enough to be good for the reader of it."
    assert extract(f"<body><div>Menu</div><div><a href=1>a link with words</a></div><p>{plain}</p><p>Short tail.</p><p>{plain}</p>") == f"{plain}\n\nShort tail.\n\n{plain}"


def test_html_articles_are_kept_whole():
    russian = "Вчера вечером в городе прошёл сильный дождь и многие улицы оказались под водой до самого утра"
    chinese = "昨天晚上城里下了一场大雨很多街道直到早上都还在水里市民只好步行回家学校也推迟了上课时间"
    english = "The man that was in the house had a letter for the people of the town and it was from the king"
    tags = '<p><a href="#">more of this</a></p>'
    for text in (russian, chinese):
        assert extract(f"<body><p>{text}</p><p>{text}</p></body>") == f"{text}\n\n{text}"
        assert extract(f"<article>{tags}<p>{text}</p>{tags}</article>") == text
    assert extract(f"<article><p>A short line.</p><p>Another line.</p>{tags}</article>") == "A short line.\n\nAnother line."
    assert extract(f"<article>{tags}<p>A short line.</p>{tags}</article>") == "A short line."
    assert extract(f'<div style="overflow:hidden" data-id="share"><p>{english}</p></div>') == english
    assert extract(f'<div hidden><p>{english}</p></div><div id="share"><p>{english}</p></div>') == ""
    for inner in ("main", "article"):
        assert extract(f'<div class="has-sidebar"><{inner}><p>{english}</p></{inner}></div>') == english
    assert extract(f'<article><p>{english}</p></article><div class="comments"><article><p>{english} too</p></article></div>') == english


def test_html_attributes_and_names():
    """Apostrophes in unquoted values, names that only hold a mark, and a main container with a heading alone."""
    english = "The man that was in the house had a letter for the people of the town and it was from the king"
    assert extract("<article><p title=it's>Hello there.</p><p>Second it's one.</p></article>") == "Hello there.\n\nSecond it's one."
    assert extract("<article><p title='a>b' data-x=\"c>d\" e=f/>One.</p><br/><p / >Two.</p></article>") == "One.\n\nTwo."
    for name in ("share-price", "comment-free", "hidden-gem", "seaside", "promo_code", "adsorption"):
        assert extract(f"<article><p class='{name}'>The words of it.</p></article>") == "The words of it."
    for name in ("share", "site-header", "comment-list", "cookie-notice", "x related-posts", "ad ad-1", "sidebar2"):
        assert extract(f"<article><p>Kept.</p><div class='{name}'><p>Gone.</p></div></article>") == "Kept."
    assert extract(f"<body><main><h1>T</h1></main><div><p>{english}</p></div></body>") == f"T\n\n{english}"
    assert extract(f"<body><main><h1>T</h1></main><div class='comments'><p>{english}</p></div></body>") == "T"
    assert extract(f"<body><main><p>{english}</p></main><div><p>{english} too</p></div></body>") == english
    assert extract("<p " + "a=b " * 50_000) == extract("<p " + "'" * 50_000) == extract("<p a='" + "x" * 200_000) == ""


def test_html_table(spark, store):
    rows = [(1, "u", PAGE, "p", "f"), (1, "u", PAGE, "p", "f"), (None, None, None, None, None), (2, None, "", "p", "f"), (3, "v", "<article><p>" + "wörd " * 50_000, "p", "f")]
    got = sorted(op7_html_text(spark, store(pages=rows)).collect(), key=str)
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got) and {r.n_chars for r in got if r.page_id == 3} == {249_999}
    assert op7_html_text(spark, store(pages=[])).count() == 0


def brute_top(rows, k=5, modulus=50):
    ok = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % modulus == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in ok if i != q and len(a) == len(b))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


def test_top_k(spark, store):
    rng = random.Random(6)
    f32 = lambda: float(np.float32(rng.uniform(-1, 1)))
    hot = [f32() for _ in range(8)]
    rows = [(i, hot if i % 3 == 0 else [f32() for _ in range(8)]) for i in range(400)] + [(1000, None), (1050, [None] * 8), (1100, [float("nan")] * 8), (1150, []), (1201, [float("inf")] + [0.0] * 7), (None, hot), (1250, [3e12, 2.0] + [0.5] * 6), (1300, hot[:4]), (1301, hot[:4])]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = op8_exact_top_k(spark, store(embeddings=[(i, v, 0, 1) for i, v in rows])).collect()
    small = [r for r in rows if r[0] != 1250]
    assert sorted(map(tuple, got)) == brute_top(rows)
    vectors = spark.createDataFrame(small, "vec_id long, embedding array<float>")
    blocks = exact_top_k(vectors.filter("vec_id % 50 = 0"), vectors, block_rows=3, tile_rows=7).collect()
    assert sorted(map(tuple, blocks)) == brute_top(small)
    assert op8_exact_top_k(spark, store(embeddings=[])).count() == 0


def test_top_k_bundles_and_tree(spark, monkeypatch):
    """Several bundles of blocks and a merge tree of several levels give what one gives; products beyond 64
    bits are compared exactly and given as the nearest long."""
    monkeypatch.setattr("lectorium.llm.top_k.BUNDLE_BYTES", 1)
    monkeypatch.setattr("lectorium.llm.top_k.FAN", 2)
    rng = random.Random(5)
    rows = [(i, [rng.randint(-4, 4) / 256 for _ in range(6)]) for i in range(200)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(9)
    got = exact_top_k(vectors.filter("vec_id % 50 = 0"), vectors, block_rows=2, tile_rows=7).collect()
    assert sorted(map(tuple, got)) == brute_top(rows)
    huge = [(0, [1e300, 1.0]), (50, [-1e300, 1.0]), (1, [1e300, 0.0]), (2, [1e200, 0.0]), (3, [0.0, 3.0]), (4, [3e17, 0.0])]
    vectors = spark.createDataFrame(huge, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in exact_top_k(vectors.filter("vec_id = 0"), vectors).collect()}
    most = (1 << 63) - 1
    assert [got[0, k] for k in range(1, 5)] == [(1, most), (2, most), (4, most), (3, 256 * 768)] and got[0, 5] == (50, -most)


def test_warc_round_trip(spark, store):
    rows = [(1, "u", "same", "p", "f"), (2, "u", "same", "p", "f"), (3, None, None, "p", "f"), (4, "u\r\nWARC-Type: x", "", "p", "f"), (5, "u", "é" * 200_000, "p", "f"), (7, "u", "twice", "p", "f"), (7, "u", "twice", "p", "f"), (None, "n", "alone", "p", "f")]
    got = op10_warc(spark, store(pages=rows)).collect()
    expected = []
    for i, _, html, *_ in rows:
        raw = (html or "").encode()
        kept = max((j for j, _, h, *_ in rows if (h or "") == (html or "") and j is not None), default=None)
        revisit = kept is not None and i != kept
        expected.append((i, len(raw), digest32(raw), "revisit" if revisit else "response", kept if revisit else None))
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)
    assert op10_warc(spark, store(pages=[])).count() == 0


def test_warc_records_are_valid(spark, tmp_path):
    """Every record has the named fields that the format asks for, an id of its own and an HTTP message;
    revisits name a record that is there."""
    rows = [(1, "u", "same"), (2, "u", "same"), (2, "u", "other"), (3, "u", "twice"), (3, "u", "twice"), (None, "n", "same")]
    files = write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}")
    found = []
    for path in sorted(r.file.removeprefix("file://") for r in files.collect()):
        with open(path, "rb") as f:
            found += [x for x in read_records(f, os.path.getsize(path))]
    assert len(found) == len(rows) and all(kind == "record" for kind, *_ in found)
    ids = [h["warc-record-id"] for _, _, _, h, _ in found]
    assert len(set(ids)) == len(ids)
    for _, _, _, h, block in found:
        assert {"warc-type", "warc-record-id", "warc-date", "content-length"} <= set(h) and re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", h["warc-date"])
        assert block.startswith(b"HTTP/1.1 200 OK\r\n") and h["content-type"] == "application/http; msgtype=response"
        assert h["warc-type"] == "response" or h["warc-refers-to"] in ids


def test_salvage_of_false_lengths():
    """A length that the file or the member can't hold is a gap; a long header is none."""
    good = page_record(7, "u" * 2_000_000, b"payload")
    lie = b"WARC/1.1\r\nContent-Length: 999999999999\r\n\r\nx"
    for raw, kinds in ((lie + good, ["gap", "record"]), (member(lie) + member(good), ["gap", "record"]), (good, ["record"])):
        assert [x[0] for x in read_records(io.BytesIO(raw), len(raw))] == kinds


def test_salvage():
    rng = random.Random(8)
    records = [page_record(i, f"u{i}", bytes(rng.randrange(256) for _ in range(rng.randrange(3000))) + b"\x1f\x8b\x08WARC/1.1\r\n") for i in range(40)]
    for packed in (True, False):
        parts = [member(r) if packed else r for r in records]
        offsets = np.cumsum([0] + [len(p) for p in parts])
        raw = bytearray(b"".join(parts))
        broken = [3, 4, 20, 39]
        for k in broken:
            at = int(offsets[k]) + len(parts[k]) // 2
            raw[at : at + 3] = bytes(x ^ 0x5A for x in raw[at : at + 3])
        raw += b"trailing"
        found = list(read_records(io.BytesIO(bytes(raw)), len(raw)))
        whole = [(s, e) for kind, s, e, _, _ in found if kind == "record"]
        assert whole == [(int(offsets[k]), int(offsets[k + 1])) for k in range(40) if k not in broken]
        edges = sorted((s, e) for _, s, e, _, _ in found)
        assert edges[0][0] == 0 and edges[-1][1] == len(raw) and all(a[1] == b[0] for a, b in zip(edges, edges[1:], strict=False))


def test_salvage_from_files(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"html {i}" * 50) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    files = write_warc(pages, f"file://{tmp_path}", roll_bytes=4000)
    paths = [r.file.removeprefix("file://") for r in files.collect()]
    assert len(paths) > 1
    with open(paths[0], "r+b") as f:
        f.seek(os.path.getsize(paths[0]) // 2)
        f.write(b"\0\0\0\0")
    got = read_warc(files, with_block=True).collect()
    assert sum(r.record_type == "gap" for r in got) == 1 and sum(r.record_type == "response" for r in got) == 59
    assert all(r.block == (f"html {r.page_id}" * 50).encode() for r in got if r.record_type != "gap")
